"""Which joins broadcast: those of sides that were measured, not those whose exploded rows the planner takes for none."""

from pyspark.sql import functions as F

from tidewater.jobs import catalog
from tidewater.measured import measured


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_rows_are_not_broadcast_unseen(spark):
    for name in ("vgrid_checks", "depth_average", "tide_spline", "cell_nearest_fill"):
        # The plan before AQE has seen any rows; what is marked by hand has one row.
        first = plan(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
        assert first.count("BroadcastHashJoin") == 0, name


def test_a_measured_side_is_broadcast_and_settings_stay(spark):
    before = dict(spark.conf.getAll.items())
    own = measured(spark)
    assert dict(spark.conf.getAll.items()) == before
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    small = own.range(10).groupBy("id").agg(F.count("*").alias("n"))
    both = own.range(100_000).join(small, "id")
    assert "BroadcastHashJoin" not in plan(both)
    assert both.count() == 10 and both.collect()
    assert "BroadcastHashJoin" in plan(both)


def test_megabytes_are_not_broadcast_however_many_joins_ask_for_them(spark):
    from tidewater import measured as m

    own = measured(spark)
    large = own.range(200_000).groupBy("id").agg(F.count("*").alias("n"))  # 4.8 MB of rows, half of what Spark broadcasts
    both = own.range(400_000).join(large, "id")
    assert both.collect() and "BroadcastHashJoin" not in plan(both)
    for size, n in (("-1", -1), ("10485760b", 10 << 20), ("10MB", 10 << 20), ("3k", 3 << 10), ("1 gib", 1 << 30)):
        assert m._bytes(size) == n
    assert int(own.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")) == m.MOST
