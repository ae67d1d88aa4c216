"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors stand in the list of their nearest centroid, those near a boundary in the next lists too. A query finds the
lists to search over a graph of centroids and leaves out those too far beyond the nearest. Lists are packed, neighbours
together, into parts of bounded size: a query goes once to each part that has lists of its, with their numbers, and is
compared with these lists' vectors there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewater.llm.tables import table
from tidewater.llm.vectors import matrix, usable_rows
from tidewater.spool import spool

#: Vectors the centroids are fitted on at most (the smallest by a hash of the vector), and centroids of one length at most.
SAMPLE = 16_384
MOST_CENTROIDS = 8192
#: Vectors of a list that a centroid is made for.
LIST = 32
#: A vector is put into every list whose centroid is at most so much farther than its nearest, up to so many lists.
BOUNDARY, REPLICAS = 1.01, 3
#: Share of the sample's true neighbours that the lists searched must hold; the distance ratio is fitted to it.
RECALL = 0.97
#: Parts that the vectors are dealt into, as long as these have no fewer and no more vectors than so many.
PARTS, LEAST_PART, MOST_PART = 32, 256, 65_536
#: Queries compared with a part in one task.
QUERIES = 8192
#: Near centroids that each is joined with in the graph, half as many at random, and where a search starts.
DEGREE, ENTRIES = 16, 32
#: Centroids that a search looks from at a time, and nearest found ones that it looks from in any case; rows worked through together.
BEAM, WIDTH, ROWS = 8, 32, 512


class Index:
    """Centroids, a graph over them, and the ratio that selects lists.

    The largest inner product is the smallest distance once every vector has one more coordinate that brings all to
    one norm (queries have 0 there).
    """

    def __init__(self, sample: np.ndarray, norm: float, count: int, k: int):
        self.norm = norm
        x = self.raised(sample)
        n = max(1, min(MOST_CENTROIDS, len(x) // 4, round(count / LIST)))
        self.centroids = _balanced_means(x, n)
        rng = np.random.default_rng(5)
        near = [_nearest(self.centroids[i : i + ROWS], self.centroids, min(DEGREE, n)) for i in range(0, n, ROWS)]
        # Near ones, and far ones so that no group of centroids is cut off; the search starts from some at random.
        self.graph = np.hstack([np.vstack(near), rng.integers(0, n, (n, DEGREE // 2)), (np.arange(n)[:, None] + 1) % n])
        self.entries = np.sort(rng.choice(n, min(n, ENTRIES), replace=False))
        self.ratio = self._fitted(sample, k)

    def raised(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1, keepdims=True), 0))])

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``x`` and lists that hold them."""
        rows, lists = [], []
        for i in range(0, len(x), ROWS):
            d = _distances(self.raised(x[i : i + ROWS]), self.centroids)
            near = np.argpartition(d, min(REPLICAS, d.shape[1]) - 1, axis=1)[:, :REPLICAS]
            dn = np.take_along_axis(d, near, axis=1)
            row, place = np.nonzero(dn <= BOUNDARY * dn.min(axis=1, keepdims=True))
            rows.append(row + i)
            lists.append(near[row, place])
        return np.concatenate(rows), np.concatenate(lists)

    def search(self, q: np.ndarray, ratio: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``q`` and lists to search for them: best-first over the graph, all queries side by side.

        The nearest centroids not yet looked from are taken next; a query ends when all that are left are too far and
        not among the ``WIDTH`` nearest found.
        """
        ratio, q = self.ratio if ratio is None else ratio, np.hstack([q, np.zeros((len(q), 1))])
        rows, lists = [], []
        for i in range(0, len(q), ROWS):
            dist = self._reached(q[i : i + ROWS], ratio)
            row, which = np.nonzero(dist <= ratio * dist.min(axis=1, keepdims=True) + 1e-6 * self.norm)
            rows.append(row + i)
            lists.append(which)
        return np.concatenate(rows), np.concatenate(lists)

    def _reached(self, q: np.ndarray, ratio: float) -> np.ndarray:
        """Distances of the centroids that the search has come to, infinite for others; each is worked out once."""
        n = len(self.centroids)
        size, square = (q**2).sum(axis=1), (self.centroids**2).sum(axis=1)
        dist, looked = np.full((len(q), n), np.inf), np.zeros((len(q), n), bool)
        dist[:, self.entries] = _distances(q, self.centroids[self.entries])
        live, beam = np.arange(len(q)), min(BEAM, n)
        while len(live):
            best = dist[live].min(axis=1)
            open_ = np.where(looked[live], np.inf, dist[live])
            take = np.argpartition(open_, beam - 1, axis=1)[:, :beam]
            bound = np.maximum(ratio * best, np.partition(dist[live], min(WIDTH, n) - 1, axis=1)[:, min(WIDTH, n) - 1])[:, None]
            far = np.take_along_axis(open_, take, axis=1)
            go = (far <= bound + 1e-6 * self.norm) & np.isfinite(far)
            at, place = np.nonzero(go)
            if not len(at):
                break
            row, node = live[at], take[at, place]
            looked[row, node] = True
            flat = np.unique(np.repeat(row, self.graph.shape[1]) * n + self.graph[node].ravel())
            flat = flat[np.isinf(dist.ravel()[flat])]
            r, c = flat // n, flat % n
            dot = np.einsum("nd,nd->n", q[r], self.centroids[c])
            dist[r, c] = np.sqrt(np.maximum(size[r] + square[c] - 2 * dot, 0))
            live = live[go.any(axis=1)]
        return dist

    def _fitted(self, sample: np.ndarray, k: int) -> float:
        """The smallest ratio at which the lists searched hold enough of the true neighbours, in the sample, of 256 of it."""
        if len(sample) < 2:
            return 1.0
        at = np.arange(0, len(sample), max(1, len(sample) // 256))[:256]
        scores = sample[at] @ sample.T
        scores[np.arange(len(at)), at] = -np.inf
        k = min(k, len(sample) - 1)
        top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        d = _distances(np.hstack([sample[at], np.zeros((len(at), 1))]), self.centroids)
        d = d / np.maximum(d.min(axis=1, keepdims=True), 1e-12 * self.norm)
        row, which = self.lists_of(sample)
        held = np.full((len(sample), REPLICAS), -1)
        held[row, np.arange(len(row)) - np.searchsorted(row, row)] = which
        lists = held[top]
        need = np.where(lists >= 0, d[np.arange(len(at))[:, None, None], lists], np.inf).min(axis=2)
        return float(np.quantile(need, RECALL, method="higher"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * x @ y.T, 0))


def _nearest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    return np.argpartition(_distances(x, y), n - 1, axis=1)[:, :n]


def _balanced_means(x: np.ndarray, n: int) -> np.ndarray:
    """k-means in which a centroid with more than its share is put a little farther away in the next round."""
    rng = np.random.default_rng(11)
    centroids = x[np.sort(rng.choice(len(x), n, replace=False))].copy()
    extra = np.zeros(n)
    for _ in range(5):
        own, least = np.empty(len(x), np.int64), np.empty(len(x))
        for i in range(0, len(x), ROWS):
            d = _distances(x[i : i + ROWS], centroids)
            own[i : i + ROWS], least[i : i + ROWS] = (d + extra).argmin(axis=1), d.min(axis=1)
        size = np.bincount(own, minlength=n)
        extra = 0.02 * least.mean() * np.log(np.maximum(size, 1) * n / len(x)).clip(-2, 2)
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(size)
        centroids[filled] = np.add.reduceat(x[order], (np.cumsum(size) - size)[filled]) / size[filled, None]
    return centroids


def fit(held: DataFrame, k: int) -> dict[int, Index]:
    """An index for each length of the distinct vectors in ``held``; ``SAMPLE`` of all come to the driver, and one of each length."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sizes = held.groupBy("dims").agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.min_by("embedding", "hash").alias("one")).collect()
    total = sum(r["n"] for r in sizes)
    share = F.pmod(F.shiftright("hash", 4), F.lit(1 << 40)) / float(1 << 40)
    some = held.where(share < SAMPLE / max(total, 1)).orderBy("hash").limit(SAMPLE).select("dims", "embedding").toPandas()
    own = {d: matrix(x["embedding"]) for d, x in some.groupby("dims")}
    return {r["dims"]: Index(own.get(r["dims"], np.array([r["one"]], np.float64)), r["norm"], r["n"], k) for r in sorted(sizes, key=lambda r: r["dims"])}


class _Packing:
    """Which part each list is in; a list too large for one has several of its own."""

    def __init__(self, sizes: dict[tuple[int, int], int], indexes: dict[int, Index]):
        room = max(LEAST_PART, min(MOST_PART, -(-sum(sizes.values()) // PARTS)))
        self.first = {d: np.zeros(len(x.centroids), np.int64) for d, x in indexes.items()}
        self.blocks = {d: np.ones(len(x.centroids), np.int64) for d, x in indexes.items()}
        part, used = -1, room + 1
        for d, x in indexes.items():
            used = room + 1  # vectors of one length only in a part
            for i in _side_by_side(x):
                n = sizes.get((d, i), 0)
                if n > room:
                    self.blocks[d][i] = -(-n // room)
                    self.first[d][i] = part + 1
                    part, used = part + int(self.blocks[d][i]), room + 1
                    continue
                if used + n > room:
                    part, used = part + 1, 0
                self.first[d][i] = part
                used += n


def _side_by_side(x: Index) -> list[int]:
    """The lists so that near ones mostly follow each other: along the graph, depth first."""
    seen, out = np.zeros(len(x.centroids), bool), []
    for start in range(len(x.centroids)):
        todo = [start]
        while todo:
            i = todo.pop()
            if not seen[i]:
                seen[i] = True
                out.append(i)
                todo += x.graph[i, : min(DEGREE, len(x.centroids))][::-1].tolist()
    return out


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows of ``vectors`` (``vec_id, embedding``) that are queries, the ``k``
    rows found with the largest inner product, themselves left out, ties to the smaller ``vec_id``.

    Equal vectors are searched once, and since only the first ``k + 1`` ids of them can ever be in a result, no more
    are carried; that loses none. Vectors are compared with those of their own length. Unusable vectors (null, zero,
    not finite) and rows without an id take no part; of repeated rows one does. Other columns are ignored.
    """
    spark = vectors.sparkSession
    good = usable_rows(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).withColumn("hash", F.xxhash64("embedding")).dropDuplicates(["vec_id", "hash", "embedding"])
    good = spool(good)
    same = Window.partitionBy("hash", "embedding").orderBy("vec_id")
    held = good.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).groupBy("hash", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("dims").alias("dims"))
    held = spool(held.withColumn("vec_id", F.col("ids")[0]))
    indexes = fit(held, k)
    if not indexes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(indexes)
    kind = vectors.schema["embedding"].dataType.simpleString()

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, x in batch.groupby("dims"):
                row, which = shared.value[d].lists_of(matrix(x["embedding"]))
                yield pd.DataFrame({"dims": d, "list": which, "vec_id": x["vec_id"].to_numpy()[row], "embedding": x["embedding"].to_numpy()[row]})

    postings = spool(held.select("dims", "vec_id", "embedding").mapInPandas(post, f"dims int, list int, vec_id long, embedding {kind}"))
    # As many rows as there are lists, MOST_CENTROIDS a length.
    packed = spark.sparkContext.broadcast(_Packing({(r["dims"], r["list"]): r["n"] for r in postings.groupBy("dims", "list").agg(F.count("*").alias("n")).collect()}, indexes))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, x in batch.groupby("dims"):
                which = x["list"].to_numpy()
                yield x[["list", "vec_id", "embedding"]].assign(part=packed.value.first[d][which] + x["vec_id"].to_numpy() % packed.value.blocks[d][which])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, x in batch.groupby("dims"):
                for at in range(0, len(x), ROWS):
                    some = x[at : at + ROWS]
                    row, which = shared.value[d].search(matrix(some["embedding"]))
                    n = packed.value.blocks[d][which]
                    row, which = np.repeat(row, n), np.repeat(which, n)
                    part = packed.value.first[d][which] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    order = np.lexsort((which, part, row))
                    row, which, part = row[order], which[order], part[order]
                    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1]))) if len(row) else np.zeros(0, np.int64)
                    lists = np.split(which.astype(np.int32), new[1:]) if len(row) else []
                    yield pd.DataFrame({"part": part[new], "query": some["vec_id"].to_numpy()[row[new]], "embedding": some["embedding"].to_numpy()[row[new]], "lists": lists})

    placed = postings.mapInPandas(place, f"list int, vec_id long, embedding {kind}, part long")
    asked = spool(good.where(is_query(F.col("vec_id"))).select("hash", "embedding", F.col("vec_id").alias("query_id")).join(held.select("hash", "embedding", "vec_id"), ["hash", "embedding"]).select("query_id", F.col("vec_id").alias("query")))
    queries = held.join(asked.select(F.col("query").alias("vec_id")).distinct(), "vec_id", "left_semi").select("dims", "vec_id", "embedding")
    queries = queries.repartition(max(1, spark.sparkContext.defaultParallelism))
    probes = spool(queries.mapInPandas(probe, f"part long, query long, embedding {kind}, lists array<int>"))
    blocks = spool(probes.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("n")))
    left = placed.join(blocks, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), "list", "vec_id", "embedding")
    right = probes.join(blocks, "part").select("part", F.pmod(F.xxhash64("query"), F.col("n")).cast("int").alias("block"), "query", "embedding", "lists")

    def compare(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query": [], "vec_id": [], "score": []})
        return _top(v.sort_values(["list", "vec_id"]), q, k + 1)

    near = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(compare, "query long, vec_id long, score double")
    best = lambda by: Window.partitionBy(by).orderBy(F.desc("score"), "vec_id")
    top = near.distinct().withColumn("nth", F.row_number().over(best("query"))).where(F.col("nth") <= k + 1).select("query", "vec_id", "score")
    ids = held.select("vec_id", "ids")
    found = spool(top.join(ids, "vec_id").select("query", "score", F.explode("ids").alias("vec_id")).withColumn("nth", F.row_number().over(best("query"))).where(F.col("nth") <= k + 1).drop("nth"))
    rows = asked.join(found, "query").where("vec_id <> query_id")
    return rows.withColumn("rank", F.row_number().over(best("query_id"))).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top(v: pd.DataFrame, q: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best vectors of a part for each query, out of the lists that it asks for; scores are worked out pair by pair in the end."""
    x, y, ids = matrix(v["embedding"]), matrix(q["embedding"]), v["vec_id"].to_numpy()
    which, start = np.unique(v["list"].to_numpy(), return_index=True)
    ends = np.append(start[1:], len(v))
    asks = np.zeros((len(q), len(which)), bool)
    lists = q["lists"].to_numpy()
    of, at = np.repeat(np.arange(len(q)), [len(a) for a in lists]), np.searchsorted(which, np.concatenate(lists))
    real = (at < len(which)) & (which[np.minimum(at, len(which) - 1)] == np.concatenate(lists))
    asks[of[real], at[real]] = True
    out = []
    for i in range(0, len(q), ROWS):
        scores = np.full((min(ROWS, len(q) - i), len(v)), -np.inf)
        for j in np.flatnonzero(asks[i : i + ROWS].any(axis=0)):
            own = np.flatnonzero(asks[i : i + ROWS, j])
            scores[own, start[j] : ends[j]] = y[i + own] @ x[start[j] : ends[j]].T
        n = min(k * REPLICAS, scores.shape[1])
        col = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        row, col = np.repeat(np.arange(len(scores)), n), col.ravel()
        real = np.isfinite(scores[row, col])
        row, col = row[real], col[real]
        exact = np.concatenate([np.einsum("nd,nd->n", y[i + row[a : a + 65_536]], x[col[a : a + 65_536]]) for a in range(0, len(row), 65_536)]) if len(row) else np.zeros(0)
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        new = np.append(True, (row[1:] != row[:-1]) | (ids[col[1:]] != ids[col[:-1]])) if len(row) else np.zeros(0, bool)  # replicas follow each other
        row, col, exact = row[new], col[new], exact[new]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        out.append(pd.DataFrame({"query": q["query"].to_numpy()[i + row[nth < k]], "vec_id": ids[col[nth < k]], "score": exact[nth < k]}))
    return pd.concat(out)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
