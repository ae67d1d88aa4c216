"""Queries of paths, floods, level counts with hysteresis, piled-up levels and boundaries that touch themselves, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewater.jobs.meshes import EDGE
from tidewater.jobs.places import CELL, NBR
from tidewater.operators import mesh as M, outlines as O, paths, refine as R, vertical as V
from tidewater.sources.bridge import ACROSS, LEVEL, MESH, NODE, elem_node, level, node, table


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


def _edges(s, d):
    return M.build_edges(elem_node(s, d))


# Pairs of nodes: one for each nation, from all over the mesh; lengths from one seed for each region.


def _nodes(s, d):
    return node(s, d).agg(F.count("*").alias("nn"))


def _pairs(s, d):
    k = F.col("n_nationkey")
    return table(s, d, "nation").join(F.broadcast(_nodes(s, d))).select(k.alias("pair"), F.pmod(k * 79, F.col("nn")).alias("start"), (F.col("nn") - 1 - F.pmod(k * 53, F.col("nn"))).alias("stop"))


def _seeds(s, d):
    k = F.col("r_regionkey")
    return table(s, d, "region").join(F.broadcast(_nodes(s, d))).select(k.alias("seed"), F.pmod(k * 83, F.col("nn")).alias("node_id"))


_STEPS = "st as (select a, b, sqrt(0.0::double + (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.depth - q.depth) ** 2) as step from {links} join node p on p.node_id = a join node q on q.node_id = b)"
_REACH = """lab(pair, node_id, length, hops) using key (pair, node_id) as (
  select pair, start, 0::double, 0::bigint from prs
  union
  select pair, b, (min(struct_pack(l := length + step, h := hops + 1))).l, (min(struct_pack(l := length + step, h := hops + 1))).h from lab join st on a = lab.node_id
  where not exists (select 1 from recurring.lab o where o.pair = lab.pair and o.node_id = b and (o.length < lab.length + step or (o.length = lab.length + step and o.hops <= lab.hops + 1))) group by pair, b
)"""
_BOTH = "(select a, b from edge union all select b, a from edge)"
_SHORE = "(select a, b from edge where etype = 1 union all select b, a from edge where etype = 1)"
_PRS = "prs as (select n_nationkey::bigint as pair, n_nationkey * 79 % nn as start, nn - 1 - n_nationkey * 53 % nn as stop from nation, (select count(*) as nn from node))"


def _path_sql(links: str) -> str:
    return f"""with recursive {MESH}, {EDGE}, {_PRS}, {_STEPS.format(links=links)}, {_REACH},
prv as (select l.pair, l.node_id, min(p.node_id) as up from lab l join st on st.b = l.node_id join lab p on p.pair = l.pair and p.node_id = st.a where p.length + step = l.length and p.hops + 1 = l.hops group by 1, 2),
pth as (select prs.pair, stop as node_id from prs join lab on lab.pair = prs.pair and lab.node_id = stop union all select pth.pair, up from pth join prv on prv.pair = pth.pair and prv.node_id = pth.node_id)
select pair, hops as seq, node_id, round(length + 1e-9, 6) as length from pth join lab using (pair, node_id)"""


# A sea of patches: dry, shallow and deep ones.

SHORE, WET = 1.5, 0.5


def _sea(s, d):
    k = F.col("node_id")
    patch = F.pmod(F.floor(F.pmod(k, F.lit(ACROSS)) / 4) * 2 + F.floor(F.floor(k / ACROSS) / 4), F.lit(3))
    return node(s, d).select("node_id", "x", "y", F.round(patch * 3.0 + F.pmod(k * 7, F.lit(5)) * 0.4, 6).alias("depth"))


def _flood(s, d):
    own = _sea(s, d)
    surface = own.select("node_id", (2.0 + F.pmod("node_id", F.lit(3)) * 0.25).alias("h0"))
    seeds = elem_node(s, d).join(own, "node_id").groupBy("elem_id").agg(F.min("depth").alias("least")).where("least >= 6.4")
    return R.flood_fill(_edges(s, d), own, seeds, surface, SHORE, WET)


_FLOOD = f"""{MESH}, {EDGE}, sea as (select node_id, round((node_id % {ACROSS} // 4 * 2 + node_id // {ACROSS} // 4) % 3 * 3.0::double + node_id * 7 % 5 * 0.4::double, 6) as depth, 2 + node_id % 3 * 0.25::double as h0 from node),
mk as (select edge.*, (p.depth + q.depth) / 2 > (p.h0 + q.h0) / 2 - {WET} as wet, p.depth >= p.h0 + {SHORE} and q.depth >= q.h0 + {SHORE} as deep, p.depth >= p.h0 + {WET} or q.depth >= q.h0 + {WET} as soft from edge join sea p on p.node_id = a join sea q on q.node_id = b),
able as (select elem_id from (select el as elem_id, wet from mk union all select er, wet from mk where er >= 0) group by 1 having bool_and(wet)),
adj as (select el, er from mk where er >= 0 and el in (from able) and er in (from able)), adj2 as (select el, er from adj union all select er, el from adj),
in1 as (select elem_id from elem_node join sea using (node_id) group by 1 having min(depth) >= 6.4 union select er from in1 join adj2 on el = elem_id),
out1 as (select *, el in (from in1) as l_in, er in (from in1) as r_in from mk where (el in (from in1)) <> (er in (from in1))),
add2 as (select case when l_in then er else el end as elem_id from out1 where soft), elems as (select elem_id, 1 as stage from in1 union all select distinct elem_id, 2 from add2 where elem_id in (from able) and elem_id not in (from in1))"""


# Level counts.

UP, DOWN, LIKE = 0.3, 0.8, 3.0


def _wanted(s, d):
    return node(s, d).select("node_id", (F.pmod(F.col("node_id") * 37, F.lit(100)) / 40 + 2.0).alias("wanted"))


def moved_levels(s, d):
    depth = node(s, d).select("node_id", F.pmod("depth", F.lit(13.0)).alias("depth"))
    return R.hysteretic_levels(_wanted(s, d), depth, M.neighbors(_edges(s, d)), UP, DOWN, 1, LIKE)


def settled_levels(s, d):
    return R.quantize_levels(_wanted(s, d), M.neighbors(_edges(s, d)), start=moved_levels(s, d))


_WALK = f"""with recursive {MESH}, {NBR}, w as (select node_id, (node_id * 37) % 100 / 40.0::double + 2 as wanted, fmod(fmod(depth, 13) + 13, 13) as depth, row_number() over (order by node_id % 2, node_id) as pos from node),
near as (select a, b from nbr join w p on p.node_id = a join w q on q.node_id = b where abs(p.depth - q.depth) <= {LIKE}),
run(node_id, n, pos) using key (node_id) as (
  select node_id, round_even(wanted, 0)::bigint, 0::bigint from w union all select -1, 0, 0
  union
  (with cur as (select n as sweep, pos from run where node_id = -1),
  cand as (select w.node_id, w.pos, r.n, case when wanted - r.n > {UP} then r.n + 1 when wanted - r.n < -{DOWN} then r.n - 1 end as to_ from w join recurring.run r using (node_id)),
  nxt as (select cand.* from cand, cur where to_ is not null and cand.pos > cur.pos order by cand.pos limit 1),
  ok as (select * from nxt where not exists (select 1 from near join recurring.run o on o.node_id = near.b where near.a = nxt.node_id and abs(nxt.to_ - o.n) > 1))
  select node_id, to_, 0 from ok
  union all select -1, sweep, (select pos from nxt) from cur where exists (from nxt)
  union all select -1, sweep + 1, 0 from cur where not exists (from nxt) and sweep < 5)
)"""


# Levels that pile up: even ones pressed to one end or the other, to three decimals.


def _piled(s, d):
    own = level(s, d)
    top = own.groupBy("node_id").agg(F.max("k").alias("m"))
    u = F.col("k") / F.col("m")
    k = F.pmod("node_id", F.lit(5))
    power = lambda v: F.when(k == 0, v).when(k < 3, v * v * v).otherwise(v * v * v * v * v * v)
    pressed = F.when(F.pmod("node_id", F.lit(2)) == 0, power(u)).otherwise(1 - power(1 - u))
    return own.join(top, "node_id").select("node_id", "k", F.round(pressed, 3).alias("sigma"))


def _shoal(s, d):
    return node(s, d).select("node_id", F.pmod("depth", F.lit(23.0)).alias("depth"))


def _fixed(s, d):
    return V.sigma_pileup_fix(_piled(s, d), _shoal(s, d), 0.5 + F.pmod("node_id", F.lit(3)) * 0.75)


def _cell_sql(src: str, out: str, up: bool) -> str:
    """Rows ``node_id, i, v`` (i from the end that is fixed) of one fixed cell, from those of the column before."""
    g = "+" if up else "-"
    gap = lambda a, b: f"({a} - {b})" if up else f"-({a} - {b})"
    return f"""{out}_e as (select node_id, any_value(depth) as depth, any_value(tmin) as tmin, min(v) filter (where i = 0) as s0, max(i) as m from {src} group by 1),
{out}_l as (select {src}.node_id, i, v, lead(v) over (partition by {src}.node_id order by i) as nx, e.s0, e.m, e.s0 {g} e.tmin / greatest(e.depth, 1e-12) as goal, e.depth as dp, e.tmin as tm from {src} join {out}_e e using (node_id)),
{out}_c as (select node_id, i, goal, dp * {gap('v', 's0')} + 1e-15 >= tm as far, {gap('nx', 'goal')} > 1e-10 as room from {out}_l where i between 1 and m - 1),
{out}_p as (select node_id, min(i) as pick from {out}_c where far or room group by 1),
{out} as (select l.node_id, row_number() over (partition by l.node_id order by i) - 1 as i, case when i = pick and not (dp * {gap('v', 's0')} + 1e-15 >= tm) and dp > 0 and m >= 2 then goal else v end as v, dp as depth, tm as tmin,
  case when dp > 0 and m >= 2 then coalesce(pick, m) - 1 else 0 end as drops from {out}_l l left join {out}_p using (node_id) where i = 0 or i = m or not (dp > 0 and m >= 2) or i >= pick)"""


_PILED = f"""{NODE}, {LEVEL}, lv as (select node_id, k, k / (max(k) over (partition by node_id))::double as u from level),
pw as (select node_id, k, case when node_id % 2 = 0 then u else 1 - u end as b, node_id % 5 as q from lv), pr as (select node_id, k, case when q = 0 then b when q < 3 then b * b * b else b * b * b * b * b * b end as p from pw),
raw as (select node_id, k, round(case when node_id % 2 = 0 then p else 1 - p end, 3) as v from pr),
gp as (select *, v - lag(v) over (partition by node_id order by k) as step from raw), dd as (select node_id, v, row_number() over (partition by node_id order by k) - 1 as i, count(*) over (partition by node_id) as n from gp where step is null or abs(step) > 1e-10),
nb as (select node_id, count(*)::int as n_before from raw group by 1), du as (select node_id, count(*)::int as n from dd group by 1),
c0 as (select node_id, i, case when n > 2 and i = n - 1 and abs(v - 1) <= 1e-10 then 1 when n <= 2 then i else v end as v, fmod(fmod(depth, 23) + 23, 23) as depth, 0.5 + node_id % 3 * 0.75 as tmin from dd join node using (node_id)),
{_cell_sql('c0', 'c1', True)}, r1 as (select node_id, max(i) over (partition by node_id) - i as i, v, depth, tmin from c1), {_cell_sql('r1', 'c2', False)},
mv as (select node_id, max(i) over (partition by node_id) - i as i, max(i) over (partition by node_id) as m, v, depth from c2),
rd as (select *, case when i = 0 then 0 when i = m then 1 else round_even(v * 1000000, 0) / 1000000 end as r from mv), rk as (select *, r - lag(r) over (partition by node_id order by i) as step from rd),
kp as (select *, i = 0 or i = m or (step > 0 and r < 1) as keep from rk), sq as (select *, bool_and(keep) over (partition by node_id) as same from kp),
fx as (select node_id, row_number() over (partition by node_id order by i) - 1 as k, case when same then v else r end as v from sq where keep)"""


# A mesh with diagonal rows of elements left out: its boundary touches itself wherever two of them meet in a node.


def _striped(s, d):
    cell = F.floor(F.col("elem_id") / 2)
    out = F.pmod(F.pmod(cell, F.lit(ACROSS)) + F.floor(cell / ACROSS), F.lit(6)) == 3
    return elem_node(s, d).where(~out)


def _rings(s, d):
    none = s.createDataFrame([], "ord int, x0 double, y0 double, x1 double, y1 double")
    return O.boundary_strings(_striped(s, d), node(s, d), none, CELL)


def covered(s, d):
    """For each boundary edge how many strings run along it."""
    from pyspark.sql import Window

    own = _rings(s, d)
    nxt = F.lead("node_id").over(Window.partitionBy("kind", "string_no").orderBy("seq"))
    along = own.withColumn("nxt", nxt).where("nxt is not null").groupBy(F.least("node_id", "nxt").alias("a"), F.greatest("node_id", "nxt").alias("b")).agg(F.count("*").alias("strings"))
    return M.build_edges(_striped(s, d)).where("etype = 1").select("a", "b").join(along, ["a", "b"], "full")


_STRIPED = f"""{MESH}, kept as (select elem_id, pos, node_id from elem_node where (elem_id // 2 % {ACROSS} + elem_id // 2 // {ACROSS}) % 6 <> 3),
side as (select node_id as p, coalesce(lead(node_id) over w, first_value(node_id) over w) as q from kept window w as (partition by elem_id order by pos)),
bd as (select p, q from side s where not exists (select 1 from side t where t.p = s.q and t.q = s.p))"""
_SUCCEED = f"""{_STRIPED}, trn as (select e.p, e.q, f.q as p2, atan2(u.y - v.y, u.x - v.x) - atan2(w.y - v.y, w.x - v.x) as t from bd e join bd f on f.p = e.q join node u on u.node_id = e.p join node v on v.node_id = e.q join node w on w.node_id = f.q),
suc as (select p, q, arg_min(p2, case when t <= 1e-12 then t + 2 * pi() else t end) as p2 from trn group by 1, 2),
reach as (select p as p0, q as q0, p, q from bd union select p0, q0, reach.q, p2 from reach join suc using (p, q)),
isl as (select p, q, row_number() over (order by p, q) - 1 as no from (select p, q, bool_and((p0, q0) >= (p, q)) as least from reach group by 1, 2) where least),
wk as (select no, 0 as seq, p, q, p as p0, q as q0 from isl union all select no, seq + 1, wk.q, p2, p0, q0 from wk join suc using (p, q) where not (seq > 0 and p = p0 and q = q0))"""


QUERIES = {
    "shortest_paths": (lambda s, d: _r(paths.shortest_paths(_pairs(s, d), _edges(s, d), node(s, d)), "length"), _path_sql(_BOTH)),
    "shortest_boundary_paths": (lambda s, d: _r(paths.shortest_paths(_pairs(s, d), _edges(s, d), node(s, d), boundary_only=True), "length"), _path_sql(_SHORE)),
    "shortest_lengths": (
        lambda s, d: _r(paths.shortest_lengths(_seeds(s, d), _edges(s, d), node(s, d)), "length"),
        f"""with recursive {MESH}, {EDGE}, prs as (select r_regionkey::bigint as pair, r_regionkey * 83 % nn as start from region, (select count(*) as nn from node)), {_STEPS.format(links=_BOTH)}, {_REACH}
select pair as seed, node_id, round(length + 1e-9, 6) as length from lab""",
    ),
    "flood_fill_wet": (lambda s, d: _flood(s, d)[0], f"with recursive {_FLOOD} select elem_id, stage::int as stage from elems"),
    "flood_outline": (
        lambda s, d: _flood(s, d)[1],
        f"""with recursive {_FLOOD}, ins as (select elem_id from elems), out2 as (select * from mk where (el in (from ins)) <> (er in (from ins)))
select a, b, 1 as stage, case when deep then 'deep' else 'shore' end as label from out1 union all select a, b, 2, case when deep then 'deep' else 'shore' end from out2""",
    ),
    "hysteretic_levels": (moved_levels, f"{_WALK} select node_id, n from run where node_id >= 0"),
    "quantize_with_hysteresis": (
        settled_levels,
        f"""{_WALK}, r as (select a as node_id, n from nbr join run on run.node_id = b union all select node_id, n from run where node_id >= 0), m as (select node_id, list_sort(list(n)) as s from r group by 1)
select node_id, greatest(least(s[len(s) // 2 + 1], ceil(wanted)), floor(wanted), 2)::bigint as nlevel from m join w using (node_id)""",
    ),
    "sigma_pileup_fix": (lambda s, d: _r(_fixed(s, d).select("node_id", F.posexplode("levels").alias("k", "sigma")), "sigma"), f"with {_PILED} select node_id, k::int as k, round(v + 1e-9, 6) as sigma from fx"),
    "sigma_pileup_log": (
        lambda s, d: _r(_fixed(s, d).drop("levels"), "dz_surface", "dz_bed"),
        f"""with {_PILED}, na as (select node_id, count(*)::int as n_after from fx group by 1), d1 as (select node_id, max(drops)::int as surface_drops from c1 group by 1), d2 as (select node_id, max(drops)::int as bed_drops from c2 group by 1),
dz as (select node_id, depth * (max(v) filter (where i = 1) - max(v) filter (where i = 0)) as a, depth * (max(v) filter (where i = m) - max(v) filter (where i = m - 1)) as b from mv group by node_id, depth)
select node_id, n_before, n_after, n_before - du.n as dupes, surface_drops, bed_drops, round(case when depth > 0 and du.n > 2 then a end + 1e-9, 6) as dz_surface, round(case when depth > 0 and du.n > 2 then b end + 1e-9, 6) as dz_bed
from nb join du using (node_id) join na using (node_id) join d1 using (node_id) join d2 using (node_id) join dz using (node_id) join (select distinct node_id, depth from c0) using (node_id)""",
    ),
    "touching_boundaries": (_rings, f"with recursive {_SUCCEED} select 'island' as kind, no::bigint as string_no, seq::bigint as seq, p as node_id from wk"),
    "boundary_edges_covered": (covered, f"with {_STRIPED} select least(p, q) as a, greatest(p, q) as b, 1::bigint as strings from bd"),
}
