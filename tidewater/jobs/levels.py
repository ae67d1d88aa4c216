"""Queries of projections, level counts, fills, splines and states, and the same in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewater.operators import casts as K, mesh as M, series as S, vertical as V
from tidewater.sources.bridge import HOUR, LEVEL, NODE, SERIES, level, node, series, table
from tidewater.streaming import feeds as R

QUARTER = HOUR // 4


def _places(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(k.alias("k"), (-124 + F.pmod(k, F.lit(50)) / 12.5).alias("lon"), (36 + F.pmod(k * 7, F.lit(40)) / 13.0).alias("lat"))


def projected(s, d):
    x, y = V.utm(F.col("lon"), F.col("lat"))
    return _places(s, d).select("k", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def unprojected(s, d):
    own = _places(s, d).select("k", *[v.alias(n) for v, n in zip(V.utm(F.col("lon"), F.col("lat")), ("x", "y"), strict=True)])
    lon, lat = V.utm_to_ll(F.col("x"), F.col("y"))
    return own.select("k", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def sigmas(s, d):
    return V.z_to_sigma(M.build_z(level(s, d), node(s, d))).withColumn("sigma", F.round(F.col("sigma") + 1e-9, 6))


def _holes(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select(F.floor(k / 25).alias("row"), F.pmod(k, F.lit(25)).alias("col"), F.when(F.pmod(k * 7, F.lit(11)) > 3, F.col("p_retailprice")).alias("value"))


def wanted(s, d):
    own = V.desired_levels(node(s, d), lambda n, depth: n * 0.4 + n * n * 0.02 + depth * n * 0.002, 40)
    return own.withColumn("wanted", F.round(F.col("wanted") + 1e-9, 6))


def _hours(s, d):
    """Each station's hours from its first record to its last, with the values of a polynomial of them."""
    grid = S.regular_grid(series(s, d).withColumn("t", F.col("t") - F.pmod("t", F.lit(HOUR))), ["station"], HOUR)
    first = grid.groupBy("station").agg(F.min("t").alias("a"))
    h = (F.col("t") - F.col("a")) / HOUR / 100
    return grid.join(first, "station").select("station", "t", (F.pmod("station", F.lit(7)) + h * 2 - h * h * 0.5 + h * h * h * 0.01).alias("value"))


def splined(s, d):
    return S.tide_spline(_hours(s, d), ["station"], HOUR, QUARTER, chunk=100, halo=20).withColumn("value", F.round(F.col("value") + 1e-7, 5))


def operations(s, d):
    feed = R.read_feed(s, d).withColumn("op", F.when(F.col("variable") == "signup", F.col("value")))
    return R.run_to_end(R.last_operation(feed))


_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_BIG = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = math.sqrt(_F * (2 - _F))
_PLACE = "pl as (select s_suppkey as k, -124 + (s_suppkey % 50) / 12.5::double as lon, 36 + ((s_suppkey * 7) % 40) / 13.0::double as lat from supplier)"
#: Krueger's coefficients to the third order, as the fourth changes no millimetre here.
_AL = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)

QUERIES = {
    "ll_to_utm": (
        projected,
        f"""with {_PLACE}, a as (select k, radians(lat) as p, radians(lon + 123) as l from pl), t as (select k, l, tan(p) * sqrt(1 + g * g) - g * sqrt(1 + tan(p) ** 2) as t from (select *, sinh({_E} * atanh({_E} * tan(p) / sqrt(1 + tan(p) ** 2))) as g from a)),
c as (select k, atan2(t, cos(l)) as xi, asinh(sin(l) / sqrt(t * t + cos(l) ** 2)) as eta from t)
select k, round(500000 + {0.9996 * _BIG} * (eta + {_AL[0]} * cos(2 * xi) * sinh(2 * eta) + {_AL[1]} * cos(4 * xi) * sinh(4 * eta) + {_AL[2]} * cos(6 * xi) * sinh(6 * eta)), 3) as x,
 round({0.9996 * _BIG} * (xi + {_AL[0]} * sin(2 * xi) * cosh(2 * eta) + {_AL[1]} * sin(4 * xi) * cosh(4 * eta) + {_AL[2]} * sin(6 * xi) * cosh(6 * eta)), 3) as y from c""",
    ),
    "utm_to_ll": (unprojected, f"with {_PLACE} select k, round(lon, 7) as lon, round(lat, 7) as lat from pl"),
    "z_to_sigma": (sigmas, f"with {NODE}, {LEVEL}, z as (select node_id, k, greatest(depth, 0.1) * sigma as z from level join node using (node_id)) select node_id, k, round((z - arg_max(z, k) over w) / nullif(arg_max(z, k) over w - min(z) over w, 0) + 1e-9, 6) as sigma from z window w as (partition by node_id)"),
    "cell_nearest_fill": (
        lambda s, d: K.cell_nearest_fill(_holes(s, d)),
        """with f as (select p_partkey as k, p_partkey // 25 as r, p_partkey % 25 as c, case when (p_partkey * 7) % 11 > 3 then p_retailprice end as v from part),
n as (select a.k, arg_min(b.v, struct_pack(d := (a.r - b.r) ** 2 + (a.c - b.c) ** 2, k := b.k)) as v from f a join f b on a.v is null and b.v is not null and b.r between a.r - 4 and a.r + 4 group by 1)
select r as row, c as col, coalesce(f.v, n.v) as value from f left join n using (k)""",
    ),
    "desired_levels": (
        wanted,
        f"""with {NODE}, h as (select node_id, greatest(depth, 1e-6) as d, n, n * 0.4 + n * n * 0.02 + greatest(depth, 1e-6) * n * 0.002 as h from node, (select unnest(range(0, 40))::double as n)),
j as (select node_id, any_value(d) as d, count(*) filter (h < d) as j, max(h) filter (n = 39) as top, max(h) filter (n = 38) as low from h group by 1)
select j.node_id, round(greatest(2, case when j.j = 0 then 2 when j.j >= 40 then 39 + (j.d - top) / greatest(top - low, 1e-6) else j.j - 1 + (j.d - a.h) / greatest(b.h - a.h, 1e-9) end) + 1e-9, 6) as wanted
from j left join h a on a.node_id = j.node_id and a.n = j.j - 1 left join h b on b.node_id = j.node_id and b.n = j.j""",
    ),
    "tide_spline": (
        splined,
        f"""with {SERIES}, e as (select station, min(t - t % {HOUR}) as a, max(t - t % {HOUR}) as z from series group by 1), g as (select station, a, unnest(range(a, z + 1, {QUARTER})) as t from e), h as (select station, t, (t - a) / {HOUR}::double / 100 as h from g)
select station, t, round(station % 7 + h * 2 - h * h * 0.5 + h * h * h * 0.01 + 1e-7, 5) as value from h""",
    ),
    "stream_last_operation": (
        operations,
        f"with {SERIES} select station, variable, t, last_value(case when variable = 'signup' then value end ignore nulls) over (partition by station order by t, (variable <> 'signup')::int rows between unbounded preceding and current row) as op from series",
    ),
}
