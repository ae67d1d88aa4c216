"""Vector and chat operators, and the pipeline, against brute force and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import covertree, neighbours, registry, toolcalls

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    rows, n = [], 0
    for i, b in enumerate(base):
        for _ in range(1 + i % 5):
            rows.append((n, [float(v) for v in (b + rng.normal(size=8) * 0.12).astype(np.float32)], i % 3))
            n += 1
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], rows[0][2]), (n + 2, rows[0][1], None), (n + 3, [0.0] * 8, 0), (n + 4, None, 0), (n + 5, [None] * 8, 0), (n + 6, [float("nan")] * 8, 0), (n + 7, [1.0] * 3, 0), (n + 8, [-v for v in rows[0][1]], rows[0][2])]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("clash"), "n": F.lit(0)})


def usable(e):
    return e is not None and len(e) == 8 and all(v is not None and np.isfinite(v) for v in e) and any(e)


@pytest.mark.parametrize("part", [covertree.PART, 7])
def test_cover_tree_of_near_copies_and_other_lengths(spark, monkeypatch, part):
    monkeypatch.setattr(covertree, "PART", part)
    rng = np.random.default_rng(4)
    x = [*(rng.normal(size=12) * 0.02 + np.arange(1, 13)), *rng.normal(size=(30, 12)), *(rng.normal(size=(40, 12)) * 0.02 + np.eye(12)[0]), *rng.normal(size=(12, 3)), np.full(12, 1e-200), np.full(12, 2e-200)]
    x = [v for v in x if np.ndim(v)]
    rows = [(i, [float(a) for a in v], "one") for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    unit = [v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for v in x]
    assert got == {i: sum(i != j and len(a) == len(b) and float(a @ b) >= 0.93 for j, b in enumerate(unit)) for i, a in enumerate(unit)}
    assert got[len(x) - 1] >= 1 and max(got.values()) >= 39


@pytest.mark.parametrize("part", [covertree.PART, 7])
def test_cover_tree_links(spark, vectors, monkeypatch, part):
    monkeypatch.setattr(covertree, "PART", part)
    rows = vectors.collect()
    got = {r["vec_id"]: r for r in covertree.near_vectors(vectors).collect()}
    assert len(got) == len(rows)
    x = {r["vec_id"]: (np.array(r["embedding"], np.float64), r["label"]) for r in rows if usable(r["embedding"]) and r["label"] is not None}
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    link = {i: {j for j in x if j != i and x[i][1] == x[j][1] and cos(x[i][0], x[j][0]) >= 0.93} for i in x}
    label = {r["vec_id"]: r["vec_id"] for r in rows}
    for _ in range(20):
        label |= {i: min([label[i], *(label[j] for j in link[i])]) for i in x}
    for i, r in got.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(link.get(i, ())), label[i], label[i] == i)
    assert sum(map(len, link.values())) > 50
    assert covertree.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dual_traversal_finds_every_pair():
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(np.repeat(rng.normal(size=(40, 6)), 5, axis=0) + rng.normal(size=(200, 6)) * 0.05)
    y = unit(np.vstack([x[:50] + 0.01, rng.normal(size=(80, 6))]))
    i, j = map(np.concatenate, zip(*covertree.dual_pairs(covertree.CoverTree(x), covertree.CoverTree(y), 0.3), strict=True))
    d = np.sqrt(np.maximum(2 - 2 * x @ y.T, 0))
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    assert set(zip(*map(np.ndarray.tolist, np.nonzero(d <= 0.3 - 1e-6)), strict=True)) <= found and (d[i, j] <= 0.3 + 3 * covertree.SLACK).all()


def test_nearest_neighbours(spark, vectors):
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in vectors.collect() if usable(r["embedding"])}
    got = {}
    for r in neighbours.nearest(vectors, lambda i: i % 5 == 0, k=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in rows if i % 5 == 0}
    right = 0
    for q, found in got.items():
        want = sorted(((-float(np.dot(rows[q], v)), i) for i, v in rows.items() if i != q))[:4]
        assert [f[0] for f in sorted(found)] == [1, 2, 3, 4]
        assert all(s == pytest.approx(float(np.dot(rows[q], rows[i])), abs=1e-12) for _, i, s in found)
        right += len({i for _, i, _ in found} & {i for _, i in want})
    assert right >= 0.9 * 4 * len(got)
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), lambda i: i % 5 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 0), (5, [1.0, 2.0], 0)], SCHEMA)
    assert sorted((r["query_id"], r["vec_id"]) for r in neighbours.nearest(one, lambda i: i % 5 == 0).collect()) == [(0, 5), (5, 0)]


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_the_shared_vectors(spark, folder):
    sf_dir = f"/root/testdata/{folder}"
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r["embedding"] is not None}
    ids, x = np.array(sorted(rows)), np.stack([rows[i] for i in sorted(rows)])
    got: dict[int, set] = {}
    for r in neighbours.op8(spark, sf_dir).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = [len(got[q] & set(ids[[i for i in np.lexsort((ids, -(x @ rows[q]))) if ids[i] != q][:20]].tolist())) / 20 for q in ids[ids % 20 == 0].tolist()]
    assert np.mean(hits) >= 0.95


def test_lists_prune_vectors_with_structure():
    """Of vectors in clusters a query is compared with few, and still finds its neighbours."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(200, 32))
    x = centre[rng.integers(0, 200, 8000)] + rng.normal(size=(8000, 32)) * 0.25
    index = neighbours.Index(x, float(np.linalg.norm(x, axis=1).max()), len(x), 20)
    row, which = index.lists_of(x)
    size = np.bincount(which, minlength=len(index.centroids))
    held = np.zeros((len(x), len(index.centroids)), bool)
    held[row, which] = True
    at = np.arange(0, len(x), 20)
    asked = np.zeros((len(at), len(index.centroids)), bool)
    asked[index.search(x[at])] = True
    scores = x[at] @ x.T
    scores[np.arange(len(at)), at] = -np.inf
    top = np.argpartition(-scores, 20, axis=1)[:, :20]
    found = np.mean([(held[t] & a).any(axis=1).mean() for t, a in zip(top, asked, strict=True)])
    assert found >= 0.95 and (asked @ size).mean() < 0.15 * len(x)


def test_tool_calls(spark):
    rows = [
        (1, 0, '{"tool_calls":[{"id":"a","name":"reply","arguments":{"words":1,"z":2,"chars":"x"},"after":["b"]},{"id":"b","name":"nope","arguments":[1],"after":["a"]},{"id":"d","name":"reply","arguments":{"words":1,"chars":3},"after":["gone"]},{"id":"e","name":"reply","arguments":{"words":1},"after":["d"]}]}'),
        (1, 1, '{"tool_result":{"id":"d","content":"x é"}}'),
        (1, 2, '{"tool_result":{"id":"q","content":"x"}}'),
        (1, 3, '{"tool_calls":[{"id":"d","name":"reply","arguments":{}}]}'),
        (None, 2, None),
        (2, 0, "{bad"),
        (2, 1, ""),
        (None, 3, '{"tool_calls":[{"id":"a"}]}'),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn int, text string").withColumn("level", F.lit("clash"))
    got = {(r["conv_id"], r["call_id"]): r for r in toolcalls.link(messages).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (1, "d"), (1, "e"), (1, "q"), (None, "a")}
    assert got[1, "a"]["level"] is None and got[1, "a"]["errors"] == ["unknown argument: z", "wrong type: chars"]
    d = got[1, "d"]
    assert (d["level"], d["status"], d["repeats"], d["missing"], d["errors"], d["result_turn"]) == (0, "linked", 1, ["gone"], [], 1)
    assert d["json"] == '{"after":["gone"],"arguments":{"chars":3,"words":1},"id":"d","name":"reply","result":"x é"}'
    assert got[1, "e"]["level"] == 1 and got[1, "e"]["errors"] == ["missing argument: chars"]
    assert got[1, "q"]["status"] == "orphan" and got[None, "a"]["errors"] == ["unknown tool"]
    assert toolcalls.link(spark.createDataFrame([], "conv_id long, turn int, text string")).count() == 0


def test_levels_of_chains_joins_and_cycles(spark):
    """Long chains, calls that wait for several, cycles and what waits behind them, against a walk over the graph."""
    import random

    r = random.Random(2)
    after = {i: [i - 1] if i else [] for i in range(40)}  # one chain
    after |= {i: r.sample(range(i), r.choice([0, 1, 1, 2, 3])) for i in range(40, 120)}
    after |= {200: [202], 201: [200], 202: [201], 203: [200, 5], 204: [203], 205: [5, 39, 119]}
    level: dict[int, int] = {}
    for _ in after:
        level |= {i: max((level[j] + 1 for j in on), default=0) for i, on in after.items() if all(j in level for j in on)}
    calls = spark.createDataFrame([(1, str(i)) for i in after], "conv_id long, call_id string")
    waits = spark.createDataFrame([(1, str(i), str(j)) for i, on in after.items() for j in on], "conv_id long, call_id string, on string")
    got = {int(x["call_id"]): x["level"] for x in toolcalls._levels(calls, waits).collect()}
    assert got == level and max(level.values()) >= 39 and 203 not in got


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    from same import assert_same, database

    folder = "/root/testdata/sf0.001"
    assert_same(registry.queries()[name](spark, folder), database(folder), registry.oracle_sql()[name])


def test_pipeline_stages_follow_each_other(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if i < 4:
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[1] >= 0.95 * sizes[0]
    assert docs.count() == sizes[4] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_on_odd_rows(spark):
    """Null and empty texts, repeats, rows without id, language or source, columns named like the stages' own; an empty table."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    good = plain.where("lang is not null and length(text) > 200").orderBy("doc_id").first()["text"]
    odd = [(900001, None, "en", "a", None), (900002, "", None, None, 0), (900003, good, None, None, 5), (900003, good, None, None, 5), (None, good + " more", "en", None, 1), (900004, "12 34\n\n", None, "a", 8)]
    names = {c: F.lit("mine") for c in ("row", "key", "size", "taken", "marks", "o", "f", "of", "n_lines", "lang_pred", "_copy")}
    docs = plain.unionByName(spark.createDataFrame(odd, plain.schema)).withColumns(names)
    for start in (docs, docs.where("doc_id < 0")):
        now, counts = start, [start.count()]
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, folder)
            if i < 4:
                assert now.columns == docs.columns
                assert now.where("row <> 'mine' or size <> 'mine' or n_lines <> 'mine' or o <> 'mine'").count() == 0
            counts.append(now.count())
            if i == 0:
                assert now.where("doc_id in (900001, 900002, 900004)").count() == 0
            if i == 2:
                assert now.where("doc_id = 900003 or doc_id is null").count() <= 1
        assert (counts[0] == 0) == (counts[-1] == 0) and counts[4] == counts[5]
