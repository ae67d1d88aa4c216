"""Operators on small tables with answers worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import mesh, series, spatial, tables, vertical
from tidewater.operators.components import connected_components, least_reachable
from tidewater.sources import text

H = 3_600_000_000


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_fill_gaps_fills_first_nulls_only(spark):
    values = [None, 1.0, None, None, None, 5.0, None, None]
    df = spark.createDataFrame([("a", i * H, v) for i, v in enumerate(values)], "k string, t long, value double")
    got = [r[2] for r in rows(series.fill_gaps(df, ["k"], 1), "t")]
    assert got == [None, 1.0, 2.0, None, None, 5.0, 5.0, None]


def test_carried_values_cross_spans(spark):
    df = spark.createDataFrame([("a", i, 1.0 if i == 0 else None) for i in range(10)], "k string, t long, value double")
    got = series.last_known(df, ["k"], "value", "last", span=3)
    assert {r["last"]["v"] for r in got.collect()} == {1.0}
    back = series.next_known(df.withColumn("value", F.when(F.col("t") == 9, 2.0)), ["k"], "value", "n", span=2)
    assert {r["n"]["t"] for r in back.collect()} == {9}


def test_before_start_keeps_last_earlier_row(spark):
    df = spark.createDataFrame([("a", t, float(t)) for t in (0, 10, 20)], "k string, t long, value double")
    assert [r[1] for r in rows(series.before_start(df, ["k"], 15), "t")] == [10, 20]
    assert [r[1] for r in rows(series.before_start(df, ["k"], 10), "t")] == [10, 20]
    assert [r[1] for r in rows(series.before_start(df, ["k"], 99), "t")] == [20]


def test_merge_blocks_nested_and_clamped(spark):
    df = spark.createDataFrame([(2, 9), (3, 4), (12, 30), (0, 0)], "a long, b long")
    assert rows(series.merge_blocks(df, 1, 15), "a") == [(1, 1, False), (2, 9, True), (10, 11, False), (12, 15, True)]


def test_unknown_unit_is_an_error(spark):
    df = spark.createDataFrame([(1.0, "furlong")], "v double, u string")
    with pytest.raises(Exception, match="unknown unit"):
        df.select(series.to_si(F.col("v"), F.col("u"))).collect()


def test_th_comments_and_nan(spark):
    content = "# top\ndatetime a b\n2000-01-01T00:00 1 2 # first\n2000-01-02T00:00 3 nan\n# after\n2000-01-03T00:00 5 6\n"
    got = text.read_th_dated(spark.createDataFrame([("f", content)], "file string, content string"))
    by = {(r["row_no"], r["name"]): (r["value"], r["comment"]) for r in got.collect()}
    assert by == {(0, "a"): (1.0, "first"), (0, "b"): (2.0, "first"), (1, "a"): (3.0, "after"), (1, "b"): (None, "after"), (2, "a"): (5.0, None), (2, "b"): (6.0, None)}
    assert [(r["elapsed"]) for r in text.detect_elapsed(spark.createDataFrame([("f", "0 1\n"), ("g", "1e5 2\n")], "file string, content string")).orderBy("file").collect()] == [True, False]


def test_geometry_of_a_square_and_a_triangle(spark):
    node = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 10.0, 0.0, 2.0), (2, 10.0, 10.0, 3.0), (3, 0.0, 10.0, 4.0), (4, 20.0, 0.0, 5.0)], "node_id long, x double, y double, depth double")
    en = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 0, 1), (1, 1, 4), (1, 2, 2)], "elem_id long, pos int, node_id long")
    geo = {r["elem_id"]: r for r in mesh.elem_geometry(en, node).collect()}
    assert (geo[0]["area"], geo[0]["cx"], geo[0]["cy"], geo[1]["area"]) == (100.0, 5.0, 5.0, 50.0)
    edges = {(r["a"], r["b"]): r["etype"] for r in mesh.build_edges(en).collect()}
    assert edges[1, 2] == mesh.INTERNAL and sum(edges.values()) == 5
    at = spark.createDataFrame([(0, 10.0, 5.0), (1, 15.0, 2.0), (2, 50.0, 0.0)], "point_id long, x double, y double")
    assert rows(spatial.find_elem(at, en, node, 7.0), "point_id") == [(0, 0), (1, 1)]
    assert rows(spatial.snap_points(at, en, node, 7.0), "point_id")[2] == (2, 1, True)


def test_dense_ids_over_gaps(spark):
    ids = spark.createDataFrame([(i,) for i in (5, -3, 10**12, 7, 7)], "i long")
    assert rows(mesh.dense_ids(ids, "i", 3), "i") == [(-3, 0), (5, 1), (7, 2), (10**12, 3)]


def test_formula_lets_nothing_else_in(spark):
    assert spark.range(1).select(F.lit(3.0).alias("x"), F.lit(4.0).alias("y"), F.lit(1.0).alias("z")).select(spatial.formula("max(0., (x + y) * .5 - z)")).first()[0] == 2.5
    for bad in ("__import__('os')", "x; y", "reflect(x)", "'a'"):
        with pytest.raises(ValueError):
            spatial.formula(bad)


def test_build_pairs_reasons(spark):
    df = spark.createDataFrame([("delta_src_1",), ("delta_sink_1",), ("suisun_src_1",), ("x",)], "name string")
    got = {(r["src"], r["sink"]): r["reason"] for r in tables.build_pairs(df).collect()}
    assert got == {("delta_src_1", "delta_sink_1"): None, ("suisun_src_1", None): "no sink", ("x", None): "bad name"}


def test_a_long_path_is_connected_in_tasks(spark, monkeypatch):
    from tidewater.operators import components

    rounds, state = [], components._state
    monkeypatch.setattr(components, "_state", lambda e: rounds.append(1) or state(e))
    path = spark.range(20_000).selectExpr("id a", "id + 1 b")
    assert connected_components(path).where("component = 0").count() == 20_001
    assert len(rounds) <= 6


def test_least_reachable_against_brute_force():
    r = np.random.default_rng(5)
    for n, m in ((1, 1), (30, 12), (30, 40), (400, 300)):
        u, v = r.integers(-n, n, (2, m))
        label = {int(x): int(x) for x in [*u, *v]}
        for _ in range(len(label)):
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                label[a] = label[b] = min(label[a], label[b])
        node, least = least_reachable(u, v)
        assert dict(zip(node.tolist(), least.tolist(), strict=True)) == {k: x for k, x in label.items() if k != x}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    got = connected_components(spark.createDataFrame([*path, *star, (5, 5), (None, 3)], "a long, b long"))
    comp = {r["node"]: r["component"] for r in got.collect()}
    assert len(comp) == 501 and {comp[i] for i in range(301)} == {0} and {comp[1000 + i] for i in range(200)} == {1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_utm_on_the_central_meridian(spark):
    at = spark.createDataFrame([(-123.0, 0.0), (-123.0, 45.0), (-120.0, 0.0)], "lon double, lat double")
    x, y = vertical.utm(F.col("lon"), F.col("lat"))
    got = [(round(r["x"], 2), round(r["y"], 2)) for r in at.select(x.alias("x"), y.alias("y")).collect()]
    # The meridian is 4,984,944.378 m long from the equator to 45 degrees.
    assert got[0] == (500000.0, 0.0) and got[1] == (500000.0, round(0.9996 * 4984944.378, 2)) and got[2] == (833978.56, 0.0)
