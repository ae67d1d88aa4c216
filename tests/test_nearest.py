"""Nearest sites in dense, piled-up and far-flung sets against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import spatial as P

CELL = 50.0


def sets(kind):
    r = random.Random(5)
    if kind == "clusters":
        return [(i, r.choice([r.random() * 500, r.gauss(100, 1e-3)]), r.random() * 300) for i in range(400)], [(i, r.random() * 900 - 200, r.random() * 900 - 300) for i in range(200)]
    if kind == "piles":
        return [(i, float(i % 5), float(i % 3)) for i in range(300)], [(i, i % 7 + 0.5, float(i % 4)) for i in range(150)]
    return [(i, 1.0, 2.0) for i in range(7)] + [(99, None, 1.0)], [(1, 1.0, 2.0), (2, 1e6, -1e6), (3, None, 1.0)]


@pytest.mark.parametrize("kind", ["clusters", "piles", "far"])
def test_nearest_against_brute_force(spark, kind):
    sites, points = sets(kind)
    known = [s for s in sites if s[1] is not None]
    for k in (1, 10):
        got = P.nearest(spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(sites, "site_id long, x double, y double"), k, CELL).collect()
        want = [(p, n + 1, i) for p, x, y in points if x is not None for n, (_, i) in enumerate(sorted(((x - a) ** 2 + (y - b) ** 2, i) for i, a, b in known)[:k])]
        assert sorted((r["point_id"], r["rank"], r["site_id"]) for r in got) == sorted(want)


def test_cells_are_as_small_as_sites_are_dense(spark):
    # 10,000 sites in one cell of the width given: nine such cells would bring each point all of them.
    places = spark.range(10_000).select(F.col("id").alias("site_id"), (F.col("id") % 100 / 4).alias("sx"), (F.floor(F.col("id") / 100) / 4).alias("sy"))
    down = P._levels_down(places, 1, CELL, 100.0)
    cells = places.groupBy(P.cell_of(F.col("sx"), CELL / 2**down), P.cell_of(F.col("sy"), CELL / 2**down)).count()
    assert cells.agg(F.max("count")).first()[0] <= P.CROWD
    # Many at one place can't be told apart by any cell.
    assert P._levels_down(places.withColumns({"sx": F.lit(1.0), "sy": F.lit(1.0)}), 1, CELL, 100.0) <= P.DEEPEST + 10
