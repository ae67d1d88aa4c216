"""The query that moves pairs of sources and sinks, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.jobs.places import CELL, TRIANGLE, _in_tri
from tidewater.operators.relocate import relocate_pairs
from tidewater.sources.bridge import MESH, elem_node, node, table

#: Rings searched, least and mean depth, depth from which roles are drawn by lot, and largest distance.
RINGS, LEAST, MEAN, LOT_FROM, WITHIN = (1, 3), 8.0, 20.0, 60.0, 28.0


def _pairs(s, d):
    """Suppliers as pairs over the mesh and around it: of three one has its ends apart."""
    k = F.col("s_suppkey")
    x, y = F.pmod(k * 37, F.lit(211)) + 0.25, F.pmod(k * 53, F.lit(223)) + 0.75
    off = F.when(F.pmod(k, F.lit(3)) == 0, 41.5).otherwise(0.0)
    return table(s, d, "supplier").select(k.alias("pair_id"), x.alias("xs"), y.alias("ys"), (x + off).alias("xn"), (y - off).alias("yn"))


def relocated(s, d):
    out = relocate_pairs(_pairs(s, d), elem_node(s, d), node(s, d), CELL, RINGS, LEAST, MEAN, LOT_FROM, within=WITHIN)
    return out.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in ("xs", "ys", "xn", "yn")})


_R1, _R2 = RINGS
SQL = f"""with recursive {MESH}, {TRIANGLE}, pr as (select s_suppkey as pair_id, (s_suppkey * 37) % 211 + 0.25::double as xs, (s_suppkey * 53) % 223 + 0.75::double as ys,
  (s_suppkey * 37) % 211 + 0.25::double + case when s_suppkey % 3 = 0 then 41.5 else 0 end as xn, (s_suppkey * 53) % 223 + 0.75::double - case when s_suppkey % 3 = 0 then 41.5 else 0 end as yn from supplier),
ask as (select pair_id, 'both' as side, xs as x, ys as y from pr where xs = xn union all select pair_id, 'source', xs, ys from pr where xs <> xn union all select pair_id, 'sink', xn, yn from pr where xs <> xn),
askp as (select *, pair_id || ':' || side as point_id from ask), {_in_tri('askp')},
geo as (select elem_id, avg(x) as cx, avg(y) as cy, min(depth) as zmin, avg(depth) as z from elem_node join node using (node_id) group by 1),
near as (select point_id, elem_id from (select p.point_id, g.elem_id, row_number() over (partition by p.point_id order by (p.x - g.cx) ** 2 + (p.y - g.cy) ** 2, g.elem_id) as r from askp p, geo g where p.point_id not in (select point_id from inel)) where r = 1),
own as (select a.*, t.elem_id, t.snapped, g.cx, g.cy, g.z, g.zmin >= {LEAST} and g.z >= {MEAN} as deep, case when snapped then cx else x end as ox, case when snapped then cy else y end as oy
  from askp a join (select point_id, elem_id, false as snapped from inel union all select point_id, elem_id, true from near) t using (point_id) join geo g using (elem_id)),
adj as (select distinct a.elem_id as e, b.elem_id as f from elem_node a join elem_node b using (node_id)),
ring as (select point_id, elem_id as elem, 0 as hop from own where side = 'both' or not deep union select r.point_id, adj.f, hop + 1 from ring r join adj on adj.e = r.elem where hop < {_R2}),
hops as (select point_id, elem, min(hop) as hop from ring group by 1, 2),
cand as (select o.*, h.elem, h.hop, g.cx as ex, g.cy as ey, g.z as ez, g.zmin >= {LEAST} and g.z >= {MEAN} and sqrt((g.cx - ox) ** 2 + (g.cy - oy) ** 2) <= {WITHIN} as fits, md5('0:' || pair_id || ':' || h.elem) as lot
  from hops h join own o using (point_id) join geo g on g.elem_id = h.elem),
pick as (select point_id, w.n, any_value(pair_id) as pair_id, any_value(side) as side, any_value(snapped) as snapped, any_value(deep) as deep, any_value(elem_id) as elem_id, any_value(c.cx) as cx, any_value(c.cy) as cy, any_value(c.z) as z,
  list(struct_pack(e := elem, z := ez, x := ex, y := ey) order by lot) filter (fits and elem <> elem_id) as drawn, list(struct_pack(e := elem, z := ez, x := ex, y := ey) order by ez desc, elem) filter (fits) as best,
  list(struct_pack(e := elem, z := ez, x := ex, y := ey) order by ez desc, elem) as every from cand c join (values ({_R1}), ({_R2})) w(n) on hop <= w.n group by 1, 2),
ab as (select *, case when len(drawn) >= 2 then drawn[1] when len(drawn) = 1 and deep then struct_pack(e := elem_id, z := z, x := cx, y := cy) end as a, case when len(drawn) >= 2 then drawn[2] when len(drawn) = 1 and deep then drawn[1] end as b from pick),
turn as (select *, case when greatest(a.z, b.z) >= {LOT_FROM} then md5('0:' || pair_id) >= '8' else a.z >= b.z end as flip from ab),
pq as (select *, case when side = 'both' then case when flip then b else a end else best[1] end as p, case when side = 'both' then case when flip then a else b end end as q from turn),
got as (select * from (select *, row_number() over (partition by point_id order by n) as r from pq where p is not null) where r = 1),
fin as (select point_id, pair_id, side, snapped, 'separated' as status, null::varchar as severity, 0 as rings, struct_pack(e := elem_id, z := z, x := x, y := y) as p, null::struct(e bigint, z double, x double, y double) as q from own where side <> 'both' and deep and not snapped
  union all select point_id, pair_id, side, snapped, 'relocated', null::varchar, 0, struct_pack(e := elem_id, z := z, x := cx, y := cy), null from own where side <> 'both' and deep and snapped
  union all select point_id, pair_id, side, snapped, 'relocated', null::varchar, n, p, q from got
  union all select point_id, pair_id, side, snapped, 'failed', case when side = 'both' and len(every) < 2 then 'hard' else 'soft' end, n, case when side = 'both' then coalesce(every[2], every[1]) else every[1] end, case when side = 'both' then every[1] end from pq where n = {_R2} and point_id not in (select point_id from got)),
one as (select pair_id, max(case status when 'failed' then 2 when 'relocated' then 1 else 0 end) as w, min(severity) as severity, coalesce(max(rings) filter (status = 'failed'), max(rings)) as rings, bool_or(snapped) as snapped,
  any_value(p) filter (side <> 'sink') as s, coalesce(any_value(q) filter (side = 'both'), any_value(p) filter (side = 'sink')) as n from fin group by 1)
select pair_id, ['separated', 'relocated', 'failed'][w + 1] as status, severity, round(s.x + 1e-9, 6) as xs, round(s.y + 1e-9, 6) as ys, round(n.x + 1e-9, 6) as xn, round(n.y + 1e-9, 6) as yn,
  case when w > 0 then s.e end as source_elem, case when w > 0 then n.e end as sink_elem, rings::int as rings_used, snapped from one"""

QUERIES = {"relocate_pairs": (relocated, SQL)}
