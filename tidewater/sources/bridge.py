"""The shared tables as series and meshes, and the same as SQL common table expressions.

Times are whole microseconds since 1970 (``t``), so that grids and differences are exact and need no time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Nodes of one row of the bridge mesh.
ACROSS = 20
SECOND, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def micros(ts: Column) -> Column:
    """A timestamp without zone as microseconds since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``station, variable, t, value`` from ``events``: long form, irregular times."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("station"), F.col("event_type").alias("variable"), micros(F.col("ts")).alias("t"), "value")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of ``series``; hours without a record have no row."""
    s = series(spark, sf_dir)
    return s.groupBy("station", "variable", (F.col("t") - F.pmod("t", F.lit(HOUR))).alias("t")).agg(F.round(F.avg("value"), 6).alias("value"))


def node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node_id, x, y, depth`` from ``part``: a grid of 20 columns, 10 apart."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("node_id"),
        (F.pmod(k, F.lit(ACROSS)) * 10.0).alias("x"),
        (F.floor(k / ACROSS) * 10.0).cast("double").alias("y"),
        F.round(F.col("p_retailprice") - 905 + F.pmod("p_size", F.lit(7)), 6).alias("depth"),
    )


def elem_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``elem_id, pos, node_id``: quads and pairs of triangles by turns."""
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"))
    most = n.agg(F.max("n").alias("top"))
    cell = n.join(F.broadcast(most)).where((F.pmod("n", F.lit(ACROSS)) < ACROSS - 1) & (F.col("n") + ACROSS + 1 <= F.col("top")))
    corner = lambda *d: F.array(*[F.col("n") + i for i in d])
    e = lambda half, nodes: F.struct((F.col("n") * 2 + half).alias("elem_id"), nodes.alias("nodes"))
    even = F.pmod(F.pmod("n", F.lit(ACROSS)) + F.floor(F.col("n") / ACROSS), F.lit(2)) == 0
    quad = F.array(e(0, corner(0, 1, ACROSS + 1, ACROSS)))
    tris = F.array(e(0, corner(0, 1, ACROSS + 1)), e(1, corner(0, ACROSS + 1, ACROSS)))
    return cell.select(F.explode(F.when(even, quad).otherwise(tris)).alias("e")).select("e.elem_id", F.posexplode("e.nodes").alias("pos", "node_id"))


def level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node_id, k, sigma``: 3 to 10 even levels at each node."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), (F.pmod("p_size", F.lit(8)) + 3).cast("int").alias("n"))
    return p.select("node_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select("node_id", "k", F.round(-1 + F.col("k") / (F.col("n") - 1), 6).alias("sigma"))


SERIES = "series as (select user_id as station, event_type as variable, epoch_us(ts) as t, value from events)"
HOURLY = SERIES + f", hourly as (select station, variable, t - t % {HOUR} as t, round(avg(value), 6) as value from series group by 1, 2, 3)"
NODE = f"""node as (select p_partkey as node_id, (p_partkey % {ACROSS}) * 10.0::double as x, (p_partkey // {ACROSS}) * 10.0::double as y,
  round(p_retailprice - 905 + p_size % 7, 6) as depth from part)"""
ELEM = f"""cell as (select p_partkey as n from part where p_partkey % {ACROSS} < {ACROSS - 1} and p_partkey + {ACROSS + 1} <= (select max(p_partkey) from part)),
elem as (select n * 2 as elem_id, [n, n + 1, n + {ACROSS + 1}, n + {ACROSS}] as nodes from cell where (n % {ACROSS} + n // {ACROSS}) % 2 = 0
  union all select n * 2, [n, n + 1, n + {ACROSS + 1}] from cell where (n % {ACROSS} + n // {ACROSS}) % 2 = 1
  union all select n * 2 + 1, [n, n + {ACROSS + 1}, n + {ACROSS}] from cell where (n % {ACROSS} + n // {ACROSS}) % 2 = 1),
elem_node as (select elem_id, len(nodes) as nn, generate_subscripts(nodes, 1) - 1 as pos, unnest(nodes) as node_id from elem)"""
LEVEL = """level as (select p_partkey as node_id, k::int as k, round(-1 + k / (p_size % 8 + 2)::double, 6) as sigma
  from part, lateral (select unnest(generate_series(0, p_size % 8 + 2)) as k))"""
MESH = NODE + ", " + ELEM
