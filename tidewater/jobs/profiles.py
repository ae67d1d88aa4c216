"""Queries over vertical grids, profiles and filters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tidewater.jobs.places import NBR, _smooth_sql, _smoothed
from tidewater.operators import mesh as M, series as S, vertical as V
from tidewater.sources.bridge import HOUR, HOURLY, LEVEL, MESH, NODE, hourly, level, node, table

START = 1_704_067_200_000_000
SIGMA, ZED = [-1.0, -0.75, -0.5, -0.25, 0.0], [-100.0, -60.0, -30.0]


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


def _profile(s, d):
    return M.build_z(level(s, d), node(s, d)).withColumn("value", F.round(F.col("z") * 2 + F.pmod("node_id", F.lit(7)), 6)).select("node_id", "z", "value")


def _targets(s, d):
    return node(s, d).select("node_id", F.explode(F.array(*[F.lit(v) for v in (-12.3, -3.7, -0.9, 0.4)])).alias("z"))


def _field(s, d):
    return table(s, d, "part").select(F.floor(F.col("p_partkey") / 3).cast("long").alias("node_id"), F.pmod("p_partkey", F.lit(3)).cast("int").alias("tracer"), F.col("p_retailprice").alias("value"))


def outliers(s, d):
    return V.rolling_outliers(hourly(s, d), ["station", "variable"], 0.0, 150.0, 4.0, 3)


def tidal(s, d):
    keys = ["variable"]
    h = hourly(s, d).groupBy("variable", "t").agg(F.round(F.avg("value"), 6).alias("value"))
    filled = S.resample_ffill(h, keys, HOUR)
    return _r(V.tidal_filter(filled, keys, HOUR, 40, 24), "value")


_P = NODE + ", " + LEVEL + ", pr as (select l.node_id, greatest(n.depth, 0.1::double) * l.sigma as z, round(greatest(n.depth, 0.1::double) * l.sigma * 2 + l.node_id % 7, 6) as value from level l join node n using (node_id)), tg as (select node_id, unnest([-12.3::double, -3.7, -0.9, 0.4]) as z from node)"
_C = [(1 - 0.5) * math.sinh(4.0 * x) / math.sinh(4.0) + 0.5 * (math.tanh(4.0 * (x + 0.5)) - math.tanh(2.0)) / 2 / math.tanh(2.0) for x in SIGMA]

def restarts(s, d):
    """Files of all orders against those that a run as long as theirs should have left, one every six hours."""
    names = table(s, d, "orders").select(F.concat(F.lit("hotstart_000000_"), (F.col("o_orderkey") * 80).cast("string"), F.lit(".nc")).alias("file"))
    found = V.existing_restarts(names, START, 90).select("iteration", "file")
    last = found.agg(F.max("iteration")).first()[0] or 0
    return V.expected_restarts(s, START, last // 240 // 4 + 1, 21600, 90).join(found, "iteration", "full")


QUERIES = {
    "build_z_sz": (
        lambda s, d: _r(V.sz_levels(node(s, d).withColumn("depth", F.col("depth") * 4), SIGMA, ZED, 25.0, 5.0, 0.5, 4.0), "z"),
        f"with {NODE}, h as (select node_id, depth * 4 as d, greatest(least(depth * 4, 25.0), 0.1)::double as h from node), s as (select * from (values "
        + ", ".join(f"({i + 3}, {x!r}::double, {c!r}::double)" for i, (x, c) in enumerate(zip(SIGMA, _C, strict=True)))
        + ") v(k, s, c)), z as (select * from (values (0, -100.0::double), (1, -60.0), (2, -30.0)) v(k, z)) select node_id, k, round(case when h <= 5 then h * s.s else 5 * s.s + (h - 5) * s.c end + 1e-9, 6) as z from h, s union all select node_id, k, round(z + 1e-9, 6) from h, z where d > -z",
    ),
    "normalize_sigma": (
        lambda s, d: _r(node(s, d).select("node_id", V.normalize_sigma(F.col("depth"), F.col("depth") * F.pmod("node_id", F.lit(5)) / 3).alias("v")), "v"),
        f"with {NODE} select node_id, round(greatest(least(depth * (node_id % 5) / 3 / greatest(depth, 1e-6::double), 1), 0)::double + 1e-9, 6) as v from node",
    ),
    "depth_average": (
        lambda s, d: _r(V.depth_average(_profile(s, d), ["node_id"]), "value"),
        f"with {_P}, l as (select node_id, z, value, lead(z) over w as z2, lead(value) over w as v2 from pr window w as (partition by node_id order by z)) select node_id, round(sum((z2 - z) * (value + v2) / 2) / nullif(max(z) - min(z), 0) + 1e-9, 6) as value from l group by 1",
    ),
    "vertical_linear_clamped": (
        lambda s, d: _r(V.profile_at(_profile(s, d), _targets(s, d), ["node_id"]), "value"),
        f"with {_P}, b as (select t.node_id, t.z, max([p.z, p.value]) filter (p.z <= t.z) as a, min([p.z, p.value]) filter (p.z >= t.z) as c from tg t join pr p using (node_id) group by 1, 2) select node_id, z, round(case when a is null then c[2] when c is null then a[2] when c[1] = a[1] then a[2] else a[2] + (z - a[1]) / (c[1] - a[1]) * (c[2] - a[2]) end + 1e-9, 6) as value from b",
    ),
    "vertical_nearest": (
        lambda s, d: V.level_nearest(_profile(s, d), _targets(s, d), ["node_id"]),
        f"with {_P} select t.node_id, t.z, min([abs(p.z - t.z), p.z, p.value])[3] as value from tg t join pr p using (node_id) group by 1, 2",
    ),
    "unpack_tracers": (
        lambda s, d: V.unpack_tracers(_field(s, d), ["temp", "salt", "age"]),
        "select p_partkey // 3 as node_id, max(p_retailprice) filter (p_partkey % 3 = 0) as temp, max(p_retailprice) filter (p_partkey % 3 = 1) as salt, max(p_retailprice) filter (p_partkey % 3 = 2) as age from part group by 1",
    ),
    "pack_tracers": (
        lambda s, d: V.pack_tracers(V.unpack_tracers(_field(s, d), ["temp", "salt", "age"]), ["temp", "salt", "age"]).where("value is not null"),
        "select p_partkey // 3 as node_id, (p_partkey % 3)::int as tracer, p_retailprice as value from part",
    ),
    "expected_and_existing_restarts": (
        restarts,
        f"""with o as (select o_orderkey * 80 as i, 'hotstart_000000_' || o_orderkey * 80 || '.nc' as file from orders), e as (select n * 240 as i, {START} + n * 21600000000 as t from (select unnest(generate_series(0, (select max(i) // 240 // 4 * 4 + 3 from o))) as n))
select coalesce(e.i, o.i) as iteration, t, file from e full join o on e.i = o.i""",
    ),
    "median_outliers": (
        outliers,
        f"with {HOURLY}, a as (select station, variable, t, case when value between 0 and 150 then value end as value from hourly), m as (select *, median(value) over (partition by station, variable order by t rows between 3 preceding and 3 following) as m from a), d as (select *, abs(value - m) as d from m), s as (select *, median(d) over (partition by station, variable order by t rows between 3 preceding and 3 following) as s from d) select station, variable, t, case when s > 0 and d > 4 * s then null else value end as value from s",
    ),
    "tidal_filter": (
        tidal,
        f"with {HOURLY}, v as (select variable, t, round(avg(value), 6) as value from hourly group by 1, 2), g as (select variable, unnest(generate_series(min(t), max(t), {HOUR})) as t from v group by 1), f as (select g.variable, g.t, v.value from g asof left join v on g.variable = v.variable and g.t >= v.t), w as (select * from (values "
        + ", ".join(f"({k - 24}, {x!r}::double)" for k, x in enumerate(V.lanczos_weights(40, 24)))
        + f") x(k, w)), s as (select f.variable, f.t + k * {HOUR} as t, sum(w * value) as y, count(*) as n from f, w where value is not null group by 1, 2) select f.variable, f.t, round(case when n = 49 then y end + 1e-9, 6) as value from f left join s on s.variable = f.variable and s.t = f.t",
    ),
    "laplace_forced": (
        lambda s, d: _r(_smoothed(s, d, node(s, d).select("node_id", (F.pmod("node_id", F.lit(3)) / 10).alias("value"))), "value"),
        f"with recursive {MESH}, {NBR}, {_smooth_sql(150, '(o.node_id % 3) / 10.0::double')} select node_id, round(v + 1e-9, 6) as value from sm where i = 150",
    ),
}
