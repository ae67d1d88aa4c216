"""Scores, lags and splines of series with few records or that never change."""

import random
import numpy as np
from pyspark.sql import functions as F

from tidewater.operators import series as S


def test_constant_series_have_no_correlation(spark):
    rows = [(1, i, float(i), 5.0) for i in range(4)] + [(2, 0, 1.0, 2.0)] + [(3, i, float(i), 2.0 * i) for i in range(4)]
    pairs = spark.createDataFrame(rows, "station long, t long, sim double, obs double")
    got = {r["station"]: r for r in S.skill_scores(pairs, ["station"]).collect()}
    assert got[1]["corr"] is None and got[2]["corr"] is None and abs(got[3]["corr"] - 1) < 1e-12
    lag = S.best_lag(pairs.select("station", "t", F.col("sim").alias("value")), pairs.select("station", "t", F.col("obs").alias("value")), ["station"], 1, 3).collect()
    assert [(r["station"], r["lag"], r["r"]) for r in lag] == [(3, 0, 1.0)]


def test_correlation_skips_rows_with_a_null(spark):
    x, y = [1.0, 2.0, None, 4.0, 7.5], [3.0, None, 1.0, -2.0, 6.0]
    df = spark.createDataFrame(list(zip(x, y)), "sim double, obs double")
    both = np.array([(a, b) for a, b in zip(x, y) if a is not None and b is not None])
    assert abs(df.agg(S.correlation("sim", "obs").alias("r")).first()["r"] - np.corrcoef(both.T)[0, 1]) < 1e-12


def test_spline_through_one_record(spark):
    for n in (1, 2, 3):
        own = spark.createDataFrame([(1, i * 4, i + 0.5) for i in range(n)], "station long, t long, value double")
        got = sorted((r["t"], r["value"]) for r in S.tide_spline(own, ["station"], 4, 1).collect())
        assert [t for t, _ in got] == list(range(4 * (n - 1) + 1)) and all(abs(v - (t / 4 + 0.5)) < 1e-9 for t, v in got)


# --- grids are laid out where their rows are known -----------------------------------------------------------------------

GRID_STEP = 6 * 3_600_000_000


def _loose(spark):
    r = random.Random(8)
    day = 86_400_000_000
    out = []
    for k in range(6):
        for t in sorted(r.sample(range(-40 * 24, 90 * 24), 9)) + [100 * 24 * k]:
            out.append((k, t * 3_600_000_000 + (0 if r.random() < 0.7 else 1234), None if r.random() < 0.3 else r.random()))
    out += [(7, 3 * day + 5, 1.5), (8, 2 * day, None), (9, None, 2.0), (9, day, 2.5)]
    return spark.createDataFrame(list({(k, t): (k, t, v) for k, t, v in out}.values()), "k long, t long, value double")


def _same(a, b):
    columns = sorted(a.columns)
    one, two = (sorted(map(repr, (tuple(x) for x in df.select(*columns).collect()))) for df in (a, b))
    assert one == two and one


def test_grids_from_rows_are_those_of_joins(spark):
    df = _loose(spark)
    grid = S.regular_grid(df, ["k"], GRID_STEP)
    _same(S.filled_grid(df, ["k"], GRID_STEP, 5), S.fill_gaps(grid.join(df, ["k", "t"], "left"), ["k"], 5))
    known = df.where("value is not null")
    for way in ("nearest", "backward", "forward"):
        _same(S.as_of_grid(df, ["k"], GRID_STEP, way), S.as_of(grid, known, ["k"], way))
    _same(S.bracket_grid(df, ["k"], GRID_STEP), S.bracket_interp(grid, known, ["k"]))
    _same(S.resample_ffill(df, ["k"], GRID_STEP), S.as_of(grid, known, ["k"]).select("k", "t", F.col("r_value").alias("value")))


def test_rows_are_shuffled_and_not_the_grid(spark):
    from tidewater.operators import casts

    df = _loose(spark)
    made = {
        "ffill": S.resample_ffill(df, ["k"], GRID_STEP),
        "linear": S.resample_linear(df, ["k"], GRID_STEP, 1),
        "open": S.openness(df.withColumn("name", F.lit("a")), ["k"], GRID_STEP),
        "days": casts.daily_blocks(df, ["k"], 86_400_000_000, 3_600_000_000),
    }
    for name, out in made.items():
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert 0 <= plan.index("Generate") < plan.index("Exchange"), name


def test_series_without_a_name_keep_their_times(spark):
    own = spark.createDataFrame([(None, 0, 1.0), (None, 2 * GRID_STEP, 3.0)], "k long, t long, value double")
    assert sorted(map(tuple, S.resample_ffill(own, ["k"], GRID_STEP).collect())) == [(None, i * GRID_STEP, None) for i in range(3)]


def test_days_tell_hours_without_rows(spark):
    from tidewater.operators import casts

    hour = 3_600_000_000
    own = spark.createDataFrame([(1, 2 * hour, 5.0), (1, 2 * hour + 7, 6.0), (1, 20 * hour + 1, 7.0)], "k long, t long, value double")
    got = {r["hour"]: (r["t"], r["value"]) for r in casts.daily_blocks(own, ["k"], 24 * hour, hour).collect()}
    want = {h: (2 * hour, 5.0) if h <= 2 else (20 * hour + 1, 7.0) if h <= 20 else (None, None) for h in range(24)}
    assert got == want
