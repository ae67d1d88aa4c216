"""Queries over the mesh bridge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewater.operators import mesh as M
from tidewater.sources.bridge import ELEM, LEVEL, MESH, NODE, elem_node, level, node


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _settled(df: DataFrame, *names: str) -> DataFrame:
    """Rounded off the halves that means of rounded values land on."""
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


def _depth(s, d):
    return node(s, d).select("node_id", F.col("depth").alias("value"))


def _geometry(s, d):
    return M.elem_geometry(elem_node(s, d), node(s, d))


def _half(s, d):
    return _geometry(s, d).where("mx < 95").select("elem_id")


def _z(s, d):
    return M.build_z(level(s, d), node(s, d))


RING = """en as (select e.*, n.x, n.y, n.depth, lead(n.x) over w as nx, lead(n.y) over w as ny, first_value(n.x) over w as fx, first_value(n.y) over w as fy
  from elem_node e join node n using (node_id) window w as (partition by elem_id order by pos)),
ring as (select *, coalesce(nx, fx) as x2, coalesce(ny, fy) as y2 from en),
geo as (select elem_id, count(*)::int as n, abs(sum(x * y2 - x2 * y)) / 2 as area, sum((x + x2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)) as cx,
  sum((y + y2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)) as cy, avg(x) as mx, avg(y) as my, avg(sqrt((x - x2) ** 2 + (y - y2) ** 2)) as edge, min(depth) as depth_min, avg(depth) as depth_mean from ring group by 1)"""
EDGE = """pair as (select elem_id, node_id as p, coalesce(lead(node_id) over w, first_value(node_id) over w) as q from elem_node window w as (partition by elem_id order by pos)),
edge as (select least(p, q) as a, greatest(p, q) as b, case count(*) when 1 then 1 else 0 end as etype, min(elem_id) as el, case count(*) when 1 then -1 else max(elem_id) end as er from pair group by 1, 2)"""
Z = NODE + ", " + LEVEL + ", z as (select l.node_id, l.k, greatest(n.depth, 0.1::double) * l.sigma as z from level l join node n using (node_id))"

QUERIES = {
    "elem_geometry": (
        lambda s, d: _r(_geometry(s, d), "area", "cx", "cy", "mx", "my", "edge", "depth_min", "depth_mean"),
        f"with {MESH}, {RING} select elem_id, n, " + ", ".join(f"round({c}, 6) as {c}" for c in "area cx cy mx my edge depth_min depth_mean".split()) + " from geo",
    ),
    "build_edges": (lambda s, d: M.build_edges(elem_node(s, d)), f"with {MESH}, {EDGE} select * from edge"),
    "neighbors": (lambda s, d: M.neighbors(M.build_edges(elem_node(s, d))), f"with {MESH}, {EDGE} select a as node_id, b as nbr from edge union all select b, a from edge"),
    "node_elems": (
        lambda s, d: M.node_elems(elem_node(s, d)).select("node_id", F.array_join(F.transform("elems", lambda e: e.cast("string")), ",").alias("elems")),
        f"with {MESH} select node_id, string_agg(elem_id::varchar, ',' order by elem_id) as elems from elem_node group by 1",
    ),
    "elem_on_boundary": (
        lambda s, d: M.elem_on_boundary(M.build_edges(elem_node(s, d))),
        f"with {MESH}, {EDGE} select elem_id, bool_or(etype <> 0) as on_boundary from (select el as elem_id, etype from edge union all select er, etype from edge) where elem_id >= 0 group by 1",
    ),
    "node_to_elem": (lambda s, d: _r(M.node_to_elem(elem_node(s, d), _depth(s, d)), "value"), f"with {MESH} select elem_id, round(avg(depth), 6) as value from elem_node join node using (node_id) group by 1"),
    "elem_to_node": (
        lambda s, d: _r(M.elem_to_node(elem_node(s, d), M.node_to_elem(elem_node(s, d), _depth(s, d))), "value"),
        f"with {MESH}, f as (select elem_id, avg(depth) as v from elem_node join node using (node_id) group by 1) select node_id, round(avg(v), 6) as value from elem_node join f using (elem_id) group by 1",
    ),
    "node_to_prism": (
        lambda s, d: _settled(M.node_to_prism(elem_node(s, d), _z(s, d).select("node_id", "k", F.col("z").alias("value"))), "value"),
        f"with {Z}, {ELEM}, f as (select elem_id, k, avg(z) as v from elem_node join z using (node_id) group by 1, 2), h as (select *, (v + lag(v) over (partition by elem_id order by k)) / 2 as h from f) select elem_id, k, round(coalesce(h, lead(h) over (partition by elem_id order by k)) + 1e-9, 6) as value from h",
    ),
    "wet_dry_nodes": (lambda s, d: M.wet_dry(elem_node(s, d), M.build_edges(elem_node(s, d)), _shallow(s, d))[0], f"with {Z} select node_id, min(z + 900 - node_id % 1000) >= 0 as dry from z group by 1"),
    "wet_dry_edges": (
        lambda s, d: M.wet_dry(elem_node(s, d), M.build_edges(elem_node(s, d)), _shallow(s, d))[1],
        f"with {Z}, {ELEM}, {EDGE}, dn as (select node_id, min(z + 900 - node_id % 1000) >= 0 as dry from z group by 1) select a, b, p.dry or q.dry as dry from edge join dn p on a = p.node_id join dn q on b = q.node_id",
    ),
    "wet_dry_elems": (
        lambda s, d: M.wet_dry(elem_node(s, d), M.build_edges(elem_node(s, d)), _shallow(s, d))[2],
        f"with {Z}, {ELEM}, dn as (select node_id, min(z + 900 - node_id % 1000) >= 0 as dry from z group by 1) select elem_id, bool_or(dry) as dry from elem_node join dn using (node_id) group by 1",
    ),
    "mesh_volume": (lambda s, d: M.mesh_volume(elem_node(s, d), node(s, d)).select(F.round("volume", 3).alias("volume")), f"with {MESH}, {RING} select round(sum(area * depth_mean), 3) as volume from geo"),
    "tv_energy": (
        lambda s, d: M.tv_energy(M.build_edges(elem_node(s, d)), node(s, d)).select(F.round("energy", 4).alias("energy")),
        f"with {MESH}, {EDGE} select round(sum(abs(p.depth - q.depth) / (sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) + 1e-12)), 4) as energy from edge join node p on a = p.node_id join node q on b = q.node_id",
    ),
    "level_counts": (lambda s, d: M.level_counts(level(s, d)), f"with {LEVEL} select node_id, count(*) as nlevel, greatest(count(*) - 1, 0) as nlayer from level group by 1"),
    "build_z_local": (lambda s, d: _settled(_z(s, d), "z"), f"with {Z} select node_id, k, round(z + 1e-9, 6) as z from z"),
    "sigma_to_z": (
        lambda s, d: _settled(M.sigma_to_z(level(s, d), node(s, d), 0.5), "z"),
        f"with {NODE}, {LEVEL} select node_id, k, round(case when 0.5 + depth >= 0 then 0.5 + (0.5 + depth) * sigma end + 1e-9, 6) as z from level join node using (node_id)",
    ),
    "flip_sigma": (lambda s, d: M.flip_sigma(level(s, d)), f"with {LEVEL} select node_id, max(k) over (partition by node_id) - k as k, sigma from level"),
    "vgrid_compare": (
        lambda s, d: M.vgrid_compare(level(s, d), level(s, d).where("node_id % 10 <> 0 or k > 0").withColumn("sigma", F.when(F.pmod("node_id", F.lit(7)) == 0, F.round(F.col("sigma") / 2, 6)).otherwise(F.col("sigma")))),
        f"with {LEVEL}, b as (select node_id, k, case when node_id % 7 = 0 then round(sigma / 2, 6) else sigma end as sigma from level where node_id % 10 <> 0 or k > 0) select node_id, k, l.sigma as sigma_a, b.sigma as sigma_b from level l full join b using (node_id, k) where l.sigma is distinct from b.sigma",
    ),
    "vgrid_checks": (
        lambda s, d: _r(M.vgrid_checks(_bent(s, d), M.build_edges(elem_node(s, d))), "detail"),
        f"""with {MESH}, {LEVEL}, {EDGE}, l as (select node_id, k, case when node_id % 11 = 0 and k = 1 then sigma - 0.6 when node_id % 13 = 0 and k = 1 then -0.99 else sigma end as sigma from level),
st as (select *, lead(sigma) over w as up, count(*) over (partition by node_id) as n from l window w as (partition by node_id order by k)),
mid as (select a, b, k, (p.sigma + q.sigma) / 2 as m from edge join l p on p.node_id = a join l q using (k) where q.node_id = b),
mu as (select *, lead(m) over (partition by a, b order by k) as up from mid),
f as (select 'V2' as "check", node_id, k, up - sigma as detail from st where up <= sigma union all select 'V3', node_id, k, up - sigma from st where round(up, 6) <= round(sigma, 6)
 union all select 'V4', node_id, k, up - sigma from st where up - sigma < 0.2::double / (n - 1) union all select 'V5', a, k, up - m from mu where up <= m)
select "check", node_id, k, round(detail, 6) as detail from (select *, row_number() over (partition by "check" order by node_id, k, detail) as r from f) where r <= 100""",
    ),
    "small_areas": (lambda s, d: _r(M.small_areas(_geometry(s, d), 80.0, 10.0), "area"), f"with {MESH}, {RING} select elem_id, round(area, 6) as area, area < 10 as fatal from geo where area < 80"),
    "elem_skewness": (
        lambda s, d: _r(M.skewness(elem_node(s, d), node(s, d)), "skew", "ratio"),
        f"""with {MESH}, c as (select e.elem_id, e.nn, n.x, n.y, p.x as px, p.y as py, q.x as qx, q.y as qy from elem_node e join node n using (node_id)
 join elem_node ep on ep.elem_id = e.elem_id and ep.pos = (e.pos + e.nn - 1) % e.nn join node p on p.node_id = ep.node_id join elem_node eq on eq.elem_id = e.elem_id and eq.pos = (e.pos + 1) % e.nn join node q on q.node_id = eq.node_id),
ang as (select elem_id, case when nn = 3 then pi() / 3 else 2 * pi() / 3 end as e, acos(greatest(least(((qx - x) * (px - x) + (qy - y) * (py - y)) / sqrt(((qx - x) ** 2 + (qy - y) ** 2) * ((px - x) ** 2 + (py - y) ** 2)), 1.0), -1.0)) as g from c),
m as (select elem_id, e, max(g) as hi, min(g) as lo from ang group by 1, 2) select elem_id, round(greatest((hi - e) / (pi() - e), (e - lo) / e), 6) as skew, round(hi / lo, 6) as ratio from m""",
    ),
    "renumber_mesh": (
        lambda s, d: M.renumber(elem_node(s, d).where("elem_id % 3 <> 0").unionByName(elem_node(s, d).where("elem_id % 5 = 1").withColumn("elem_id", F.col("elem_id") + 1_000_000_000))),
        f"""with {MESH}, u as (select elem_id, pos, node_id from elem_node where elem_id % 3 <> 0 union all select elem_id + 1000000000, pos, node_id from elem_node where elem_id % 5 = 1),
st as (select elem_id, list_sort(list(distinct node_id)) as ns from u group by 1), f as (select min(elem_id) as elem_id from st group by ns), k as (select u.* from u join f using (elem_id)),
ni as (select node_id, row_number() over (order by node_id) - 1 as new_node from (select distinct node_id from k)), ei as (select elem_id, row_number() over (order by elem_id) - 1 as new_elem from f)
select new_elem as elem_id, pos, new_node as node_id from k join ni using (node_id) join ei using (elem_id)""",
    ),
    "perimeter_edges": (
        lambda s, d: M.perimeter_edges(M.build_edges(elem_node(s, d)), _half(s, d)),
        f"with {MESH}, {RING}, {EDGE}, h as (select elem_id from geo where mx < 95) select a, b, el, er from edge where (el in (select elem_id from h)) <> (er in (select elem_id from h))",
    ),
    "top_deepest": (
        lambda s, d: _r(M.top_deepest(_geometry(s, d).withColumn("region", F.floor(F.col("mx") / 50).cast("long")), "region", 3).select("region", "rank", "elem_id", "depth_mean"), "depth_mean"),
        f"with {MESH}, {RING} select region, \"rank\", elem_id, round(depth_mean, 6) as depth_mean from (select *, floor(mx / 50)::bigint as region, row_number() over (partition by floor(mx / 50) order by depth_mean desc, elem_id)::int as \"rank\" from geo) where \"rank\" <= 3",
    ),
    "ball_max": (
        lambda s, d: M.ball_max(elem_node(s, d), _depth(s, d)),
        f"with {MESH}, h as (select elem_id, max(depth) as v from elem_node join node using (node_id) group by 1) select node_id, max(v) as value from elem_node join h using (elem_id) group by 1",
    ),
    "prop_from_nodes": (
        lambda s, d: M.prop_from_nodes(elem_node(s, d), node(s, d).select("node_id", F.when(F.pmod("node_id", F.lit(9)) == 0, 1.0).otherwise(0.0).alias("value"))),
        f"with {MESH} select elem_id, case when bool_or(node_id % 9 = 0) then 1 else 0 end as flag from elem_node group by 1",
    ),
}


def _shallow(s, d):
    return _z(s, d).withColumn("z", F.col("z") + 900 - F.pmod("node_id", F.lit(1000)))


def _bent(s, d):
    k, n = F.col("k"), F.col("node_id")
    bad = F.when((F.pmod(n, F.lit(11)) == 0) & (k == 1), F.col("sigma") - 0.6).when((F.pmod(n, F.lit(13)) == 0) & (k == 1), -0.99).otherwise(F.col("sigma"))
    return level(s, d).withColumn("sigma", bad)
