"""Embedding near-duplicates by dual traversal of cover trees.

Each label's unit vectors are one tree. Its upper levels are tables: a cell with too many vectors is divided around
centres from a sample of it, until half its radius covers them, and every cell's radius is that of its farthest vector. Pairs of
cells are followed down level by level by joins, leaving aside those whose centres are farther apart than both radii and
the distance asked for. What is left at the leaves is compared in tasks, each with the two leaves' lower levels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewater.llm.tables import table
from tidewater.llm.vectors import matrix, usable, usable_rows
from tidewater.operators.components import connected_components
from tidewater.spool import drop_spool, spool

COSINE = 0.93
#: Vectors of a cell that the centres below it are chosen from, and such centres at most.
SAMPLE, TOP = 512, 32
#: Vectors of a leaf; two leaves are compared in one task.
PART = 4096
#: Levels of cells; a cell still too large below them is dealt into parts with the same centre and radius.
LEVELS = 16
#: Radii of the levels within a leaf, each half the one before.
RADII = (1.0, 0.5, 0.25, 0.125)
#: Tables of cells up to so many rows are broadcast, larger ones shuffled.
BROADCAST_ROWS = 2_000
#: Trees are compared in single precision, which is never off by so much.
SLACK = 4e-3
#: Rows whose pairs are verified together.
ROWS = 256


def scaled(x: np.ndarray) -> np.ndarray:
    """The vectors times powers of two that bring their largest number near 1: no square is too small or too large."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * x @ y.T, 0))


def farthest_first(x: np.ndarray, n: int, cover: float = 0.0) -> np.ndarray:
    """Indices of up to ``n`` vectors, each the farthest from those before it, until all are within ``cover`` of one."""
    out, gap = [0], _apart(x, x[:1])[:, 0]
    while len(out) < n and gap.max() > cover:
        out.append(int(gap.argmax()))
        gap = np.minimum(gap, _apart(x, x[out[-1:]])[:, 0])
    return np.array(out)


class CoverTree:
    """Nested levels over unit vectors: every node is within a level's radius of its parent on that level.

    ``levels`` go from coarse to fine; each has the nodes' vectors, their radius (farthest vector below them) and the
    node above. The last level is the vectors themselves. Distances from a centre are worked out once, when it is made.
    """

    def __init__(self, x: np.ndarray):
        x = np.ascontiguousarray(x, np.float32)
        gap, near = np.full(len(x), np.inf, np.float32), np.full(len(x), -1)
        centres, nets, above = np.zeros(0, np.int64), [], []
        for r in RADII:
            before = near.copy()
            centres = np.append(centres, self._more(x, r, gap, near))
            nets.append(centres)
            above.append(before[centres])
        nets.append(np.arange(len(x)))
        above.append(near)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        place = np.zeros(len(x), np.int64)
        for i, (net, up) in enumerate(zip(nets, above, strict=True)):
            self.levels.append((x[net], np.zeros(len(net)), place[up] if i else np.zeros(len(net), np.int64)))
            place = np.zeros(len(x), np.int64)
            place[net] = np.arange(len(net))
        node = np.arange(len(x))  # of each vector, from the finest level up
        for i in range(len(nets) - 1, -1, -1):
            vectors, radius, up = self.levels[i]
            if i < len(nets) - 1:
                np.maximum.at(radius, node, np.sqrt(np.maximum(((x - vectors[node]) ** 2).sum(axis=1), 0)))
            node = up[node]

    @staticmethod
    def _more(x: np.ndarray, r: float, gap: np.ndarray, near: np.ndarray) -> np.ndarray:
        """More of the vectors as centres, more than ``r`` from all others, so that each is within ``r`` of one.

        ``gap`` and ``near`` are each vector's distance to its nearest centre and which that is.
        """
        out: list[int] = []
        while True:
            free = np.flatnonzero(gap > r)[:256]
            if not len(free):
                return np.array(out, np.int64)
            close = _apart(x[free], x[free]) <= r
            open_, new = np.ones(len(free), bool), []
            for j in range(len(free)):
                if open_[j]:
                    new.append(int(free[j]))
                    open_ &= ~close[j]
            d = _apart(x, x[new])
            least = d.argmin(axis=1)
            d = d[np.arange(len(x)), least]
            nearer = d < gap
            gap[nearer], near[nearer] = d[nearer], np.array(new)[least[nearer]]
            gap[new], near[new] = 0, new
            out += new


def dual_pairs(a: CoverTree, b: CoverTree, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of vectors, one below each tree, at most ``most`` apart (a few more by ``SLACK``), some rows of ``a`` at a time.

    Both trees are descended together. A pair of nodes is left aside if its centres are farther apart than their two
    radii and ``most``; only children of pairs that stay are looked at.
    """
    stay = np.ones((1, 1), bool)
    for (x, rx, ux), (y, ry, uy) in zip(a.levels, b.levels, strict=True):
        new = np.zeros((len(x), len(y)), bool)
        for at in range(0, len(x), ROWS):
            open_ = stay[np.ix_(ux[at : at + ROWS], uy)]
            bound = rx[at : at + ROWS, None] + ry[None] + (most + SLACK)
            if open_.mean() < 0.05:
                i, j = np.nonzero(open_)
                new[at + i, j] = np.sqrt(((x[at + i] - y[j]) ** 2).sum(axis=1)) <= bound[i, j]
            else:
                new[at : at + ROWS] = open_ & (_apart(x[at : at + ROWS], y) <= bound)
        stay = new
    for at in range(0, len(stay), ROWS):
        i, j = np.nonzero(stay[at : at + ROWS])
        yield i + at, j


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (the smallest number known to be reached) after more pairs."""
    while True:
        new = label.copy()
        np.minimum.at(new, label[i], label[j])
        np.minimum.at(new, label[j], label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _leaves(same: DataFrame, dims: str, reach: float) -> tuple[DataFrame, list[DataFrame]]:
    """``group, dims, cell, embedding, cid, n`` of all vectors, and for each level ``group, dims, cell, above, centre, radius, size``.

    A cell that is not divided stands on all levels below, as its own child. Each level is one pass; too large cells are
    halved in radius, or at least divided, every time, until all their vectors are sure to be within ``reach``.
    """
    placed = same.withColumn("cell", F.lit("0"))
    levels: list[DataFrame] = []
    key = ["group", "dims", "cell"]
    large = spool(same.groupBy("group", "dims").agg(F.count("*").alias("size")).withColumns({"cell": F.lit("0"), "radius": F.lit(2.0)}).where(F.col("size") > PART))
    while len(levels) < LEVELS and not large.isEmpty():
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("cid")))
        sample = placed.join(_small(large), key).withColumn("nth", nth).where(F.col("nth") <= SAMPLE).select(*key, "embedding", "size", "radius")

        def divide(x: pd.DataFrame) -> pd.DataFrame:
            unit = _unit(matrix(x["embedding"]))
            n = min(TOP, max(2, math.ceil(2 * x["size"].iloc[0] / PART)))
            return x[key][:1].assign(centres=[unit[farthest_first(unit, n, x["radius"].iloc[0] / 2)].tolist()])

        centres = spool(sample.groupBy(*key).applyInPandas(divide, f"{dims}, cell string, centres array<array<double>>"))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, own in batch.groupby(["cell", "group", "dims"], sort=False):
                    around = np.array(own["centres"].iloc[0].tolist(), np.float64)
                    d = _apart(_unit(matrix(own["embedding"])), around)
                    node = d.argmin(axis=1)
                    below = [f"{own['cell'].iloc[0]}.{i}" for i in range(len(around))]
                    yield own[["group", "dims", "cid", "n", "embedding"]].assign(cell=np.array(below)[node], above=own["cell"].iloc[0], far=d[np.arange(len(own)), node])

        schema = f"{dims}, cid long, n long, embedding {same.schema['embedding'].dataType.simpleString()}, cell string, above string, far double"
        moved = spool(placed.join(_small(centres), key).mapInPandas(place, schema))
        cells = moved.groupBy("group", "dims", "cell", "above").agg(F.max("far").alias("radius"), F.count("*").alias("size"))
        parents = centres.withColumnRenamed("cell", "above")
        which = F.element_at("centres", F.element_at(F.split("cell", r"\."), -1).cast("int") + 1)
        cells = spool(cells.join(_small(parents), ["group", "dims", "above"]).withColumn("centre", which).drop("centres"))
        if levels:  # those that were not divided
            kept = levels[-1].join(_small(centres.select(*key)), key, "left_anti").withColumn("above", F.col("cell"))
            cells = spool(cells.unionByName(kept))
        placed = spool(placed.join(_small(centres.select(*key)), key, "left_anti").select("group", "dims", "cell", "embedding", "cid", "n").unionByName(moved.select("group", "dims", "cell", "embedding", "cid", "n")))
        drop_spool(moved)
        levels.append(cells)
        large = spool(cells.where((F.col("size") > PART) & (F.col("radius") > reach / 2 - 1e-6)).select(*key, "size", "radius"))
    return placed, levels


def _leaf_pairs(levels: list[DataFrame], reach: float) -> DataFrame:
    """``group, dims, a, b`` with ``a <= b``, leaves that can hold vectors at most ``reach`` apart: level by level from the root.

    ``sure`` tells those all of whose vectors are that close.
    """
    pairs = levels[0].select("group", "dims", F.lit("0").alias("a"), F.lit("0").alias("b")).distinct()
    for cells in levels:
        side = lambda p: cells.select(F.col("group").alias(f"{p}g"), F.col("dims").alias(f"{p}d"), F.col("above").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("cell", "centre", "radius")])  # noqa: E731, B023
        up = lambda p: (F.col("group") == F.col(f"{p}g")) & (F.col("dims") == F.col(f"{p}d"))
        x, y = side("x"), side("y")
        gap = F.sqrt(F.aggregate(F.zip_with("x_centre", "y_centre", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
        both = pairs.join(x, up("x") & (F.col("a") == F.col("x"))).join(y, up("y") & (F.col("b") == F.col("y")))
        both = both.where((F.col("a") < F.col("b")) | (F.col("x_cell") <= F.col("y_cell"))).where(gap <= F.col("x_radius") + F.col("y_radius") + reach + 1e-9)
        pairs = spool(both.select("group", "dims", F.least("x_cell", "y_cell").alias("a"), F.greatest("x_cell", "y_cell").alias("b"), (gap + F.col("x_radius") + F.col("y_radius") < reach - 1e-6).alias("sure")))
    return pairs


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row for each row of ``vectors`` (``vec_id, embedding, label``): ``vec_id, n_links, component_id, kept``.

    Vectors of one label and length link if their cosine is at least ``cosine``. ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest ``vec_id`` reachable, ``kept`` whether that is the row's own. Rows
    with a null label or id, and unusable vectors (null, zero, not finite), link with nothing: a row without an id has
    no component and is kept. Repeated rows are separate vectors. Other columns are ignored.

    Equal vectors are one node with a count. Tasks return counts and a spanning forest, never their pairs.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").alias("group"))
    good = spool(usable_rows(rows.where("group is not null")).withColumn("hash", F.xxhash64("embedding")))
    node = ["group", "dims", "hash", "embedding"]
    same = spool(good.groupBy(*node).agg(F.min("vec_id").alias("cid"), F.count("*").alias("n")))
    dims = f"group {rows.schema['group'].dataType.simpleString()}, dims int"
    reach = math.sqrt(2 - 2 * cosine)
    placed, levels = _leaves(same.drop("hash"), dims, reach)
    key = ["group", "dims", "cell"]
    leaf = spool(placed.groupBy(*key).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.sum("n").alias("total"), F.min("cid").alias("least")))
    pairs = leaf.where("cell = '0'").select("group", "dims", F.col("cell").alias("a"), F.col("cell").alias("b"), F.lit(False).alias("sure"))
    if levels:
        pairs = spool(_leaf_pairs(levels, reach).unionByName(pairs))
    side = lambda p: leaf.select("group", "dims", F.col("cell").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("parts", "total", "least")])
    pairs = spool(pairs.join(side("a"), ["group", "dims", "a"]).join(side("b"), ["group", "dims", "b"]))
    sure, pairs = pairs.where("sure"), pairs.where("not sure")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = pairs.withColumn("a_part", each("a_parts")).withColumn("b_part", each("b_parts")).where("a < b or a_part <= b_part")
    task = F.concat_ws(":", "a", "a_part", "b", "b_part")
    two = F.array(F.struct(F.col("a").alias("cell"), F.col("a_part").alias("part"), F.lit(0).alias("side")), F.struct(F.col("b").alias("cell"), F.col("b_part").alias("part"), F.lit(1).alias("side")))
    sides = pairs.select("group", "dims", task.alias("task"), F.explode(F.when((F.col("a") == F.col("b")) & (F.col("a_part") == F.col("b_part")), F.slice(two, 1, 1)).otherwise(two)).alias("s")).select("group", "dims", "task", "s.*")
    dealt = placed.join(_small(leaf), key).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    dealt = dealt.join(_small(spool(sides)), [*key, "part"]).select("group", "dims", "task", "side", "embedding", "cid", "n")

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["side", "cid"])
        raw, cid, n = scaled(matrix(x["embedding"])), x["cid"].to_numpy(), x["n"].to_numpy()
        size = np.sqrt((raw**2).sum(axis=1))
        unit, cut = raw / size[:, None], int((x["side"] == 0).sum())
        one = CoverTree(unit[:cut])
        links, label = np.zeros(len(x)), np.arange(len(x))
        for i, j in dual_pairs(one, one if cut == len(x) else CoverTree(unit[cut:]), reach):
            j = j + (0 if cut == len(x) else cut)
            i, j = i[i < j], j[i < j]
            ok = np.concatenate([np.einsum("nd,nd->n", raw[i[k : k + 65_536]], raw[j[k : k + 65_536]]) / (size[i[k : k + 65_536]] * size[j[k : k + 65_536]]) >= cosine for k in range(0, len(i), 65_536)]) if len(i) else np.zeros(0, bool)
            i, j = i[ok], j[ok]
            links += np.bincount(i, n[j], len(x)) + np.bincount(j, n[i], len(x))
            label = _merged(label, i, j)
        has = np.flatnonzero(links)
        return pd.DataFrame({"cid": cid[has], "links": links[has].astype(np.int64), "least": cid[label[has]]})

    found = spool(dealt.groupBy("group", "dims", "task").applyInPandas(compare, "cid long, links long, least long"))
    if not sure.isEmpty():
        found = found.unionByName(_sure_links(placed, sure))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("cid").alias("a"), F.col("least").alias("b")))
    of_node = spool(links.join(joined.withColumnRenamed("node", "cid"), "cid", "left"))
    by_node = spool(same.join(of_node, "cid", "left").select(*node, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id")))
    linked = good.join(by_node, node).select("vec_id", "n_links", "component_id")
    rest = rows.where(~_takes_part()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _sure_links(placed: DataFrame, sure: DataFrame) -> DataFrame:
    """Counts and edges from pairs of leaves (``a, b``) whose vectors all link: no vector of theirs is compared."""
    one = sure.select("group", "dims", F.col("a").alias("cell"), F.col("b_total").alias("others"), F.col("a_least").alias("least"), (F.col("a") == F.col("b")).alias("own"))
    two = sure.where("a < b").select("group", "dims", F.col("b").alias("cell"), F.col("a_total").alias("others"), F.col("b_least").alias("least"), F.lit(False).alias("own"))
    of_leaf = spool(one.unionByName(two).groupBy("group", "dims", "cell").agg(F.sum("others").alias("others"), F.min("least").alias("least"), F.max("own").alias("own")))
    rows = placed.select("group", "dims", "cell", "cid", "n").join(_small(of_leaf), ["group", "dims", "cell"])
    rows = rows.select("cid", (F.col("others") - F.when(F.col("own"), F.col("n")).otherwise(0)).alias("links"), "least")
    return rows.unionByName(sure.where("a < b").select(F.col("a_least").alias("cid"), F.lit(0).cast("long").alias("links"), F.col("b_least").alias("least")))


def _takes_part() -> Column:
    return F.coalesce(usable(F.col("embedding")) & F.col("group").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
with recursive v as (select vec_id, embedding::double[] as e, label from embeddings
), ok as (
  select * from v where vec_id is not null and label is not null and e is not null
    and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), link as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93
), reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join link l on r.b = l.a
), least as (select a, min(b) as component_id from reach group by a)
select v.vec_id, (select count(*) from link l where l.a = v.vec_id) as n_links, component_id, coalesce(v.vec_id = component_id, true) as kept from v left join least on least.a = v.vec_id
"""
