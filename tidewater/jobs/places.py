"""Queries of spatial joins, transfers and neighbour iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewater.operators import graph as G, mesh as M, spatial as P
from tidewater.operators.components import connected_components
from tidewater.sources.bridge import MESH, NODE, elem_node, node, table

CELL = 50.0
#: Hand-made polygons over the bridge mesh, in order (fixed values of these queries).
POLYGONS = [
    {"name": "channel", "type": "none", "attribute": "12.5", "vertices": [(5.5, 5.5), (95.5, 15.5), (85.5, 75.5), (15.5, 65.5)]},
    {"name": "shelf", "type": "min", "attribute": "x * 0.1 + 3", "vertices": [(45.5, 35.5), (155.5, 45.5), (135.5, 95.5)]},
    {"name": "basin", "type": "max", "attribute": "min(z, 20.) + y / 10", "vertices": [(75.5, 0.5), (185.5, 0.5), (185.5, 195.5), (125.5, 145.5), (75.5, 85.5)]},
]
LINES = [(0, 0, 3.3, 12.7, 92.3, 71.1), (0, 1, 92.3, 71.1, 171.9, 33.3), (1, 0, 41.1, 3.7, 47.7, 88.9)]


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


def _polygons(s):
    rows = [(i, i, p["type"], [(float(x), float(y)) for x, y in p["vertices"]]) for i, p in enumerate(POLYGONS)]
    return s.createDataFrame(rows, "poly_id int, ord int, ptype string, ring array<struct<x:double,y:double>>")


def _points(s, d, name: str = "supplier", key: str = "s_suppkey"):
    k = F.col(key)
    return table(s, d, name).select(k.alias("point_id"), (F.pmod(k * 37, F.lit(211)) + 0.25).cast("double").alias("x"), (F.pmod(k * 53, F.lit(223)) + 0.75).cast("double").alias("y"))


def _sites(s, d):
    own = _points(s, d).withColumnRenamed("point_id", "site_id")
    return own.join(table(s, d, "supplier").select(F.col("s_suppkey").alias("site_id"), F.when(F.pmod("s_suppkey", F.lit(4)) != 1, F.col("s_acctbal")).alias("value")), "site_id")


def _customers(s, d):
    return _points(s, d, "customer", "c_custkey")


def _raster(s, d, top: int = 30):
    """Pixels from keys of ``part``: row and column, as far as they go."""
    k = F.col("p_partkey")
    return table(s, d, "part").select(F.floor(k / top).cast("long").alias("row"), F.pmod(k, F.lit(top)).alias("col"), F.pmod(7 * F.floor(k / top) + 13 * F.pmod(k, F.lit(top)), F.lit(4)).cast("long").alias("val"))


def dem_stack(s, d):
    r = _raster(s, d)
    linear = (2.0 * F.col("row") + 3.0 * F.col("col")).cast("double")
    fine = r.where("col < 20").select(F.lit(1).alias("raster_id"), "row", "col", F.when(F.pmod(F.col("row") + F.col("col"), F.lit(17)) != 3, linear).alias("val"))
    wide = r.select(F.lit(2).alias("raster_id"), "row", "col", (linear + 100).alias("val"))
    tops = r.agg((F.max("row") + 1).alias("rows"))
    meta = s.createDataFrame([(1, 0, 10.0, 0.0, 5.0, 5.0, 20), (2, 1, 0.0, 0.0, 8.0, 8.0, 30)], "raster_id int, prio int, x0 double, y0 double, dx double, dy double, cols long").join(F.broadcast(tops))
    return P.dem_sample(_customers(s, d), P.raster_tiles(fine.unionByName(wide)), meta, CELL)


def like_class(s, d):
    kinds = P.raster_stencil(_customers(s, d), _raster(s, d), 0.0, 0.0, 8.0, 8.0, 1)
    bins = kinds.withColumn("val", F.pmod(F.col("val") + F.col("di") + 5, F.lit(3)).cast("long"))
    lookup = s.createDataFrame([(a, b, a + b / 10) for a in range(4) for b in range(3)], "kind long, bin long, density double")
    return P.like_class_mean(kinds, bins, lookup, _customers(s, d).withColumn("z", F.col("y")), 180.0)


def zonal(s, d):
    pixels = _raster(s, d).select((F.col("row") * 1000 + F.col("col")).alias("point_id"), (F.col("col") * 6.0 + 3.1).alias("x"), (F.col("row") * 6.0 + 3.3).alias("y"), F.col("val").cast("double").alias("val"))
    e, n = elem_node(s, d), node(s, d)
    return P.zonal_to_nodes(pixels, e, n, M.elem_geometry(e, n), CELL)


def _lines(s):
    return s.createDataFrame([(a, b, *map(float, r)) for a, b, *r in LINES], "line_id int, seg int, x0 double, y0 double, x1 double, y1 double")


def _blend(s, d):
    c = table(s, d, "customer")
    part = c.select((F.pmod("c_custkey", F.lit(50))).alias("node_id"), F.when(F.pmod("c_custkey", F.lit(9)) != 0, F.col("c_acctbal")).alias("value"), (F.pmod("c_custkey", F.lit(7)) / 7.0).alias("weight"))
    return P.overlap_blend(part, ["node_id"])


def _shore(s, d):
    """The nodes of the boundary, as one seed."""
    outer = M.build_edges(elem_node(s, d)).where("etype = 1")
    return outer.select(F.explode(F.array("a", "b")).alias("node_id")).distinct().select(F.lit(0).alias("seed"), "node_id")


def _seeds(s, d):
    """Each element with an edge on the boundary is a seed of its own."""
    outer = M.build_edges(elem_node(s, d)).where("etype = 1").select(F.col("el").alias("elem_id")).distinct()
    return outer.select(F.col("elem_id").alias("seed"), "elem_id")


POINTS = """pts as (select s_suppkey as point_id, (s_suppkey * 37) % 211 + 0.25::double as x, (s_suppkey * 53) % 223 + 0.75::double as y, case when s_suppkey % 4 <> 1 then s_acctbal end as value from supplier),
cust as (select c_custkey as point_id, (c_custkey * 37) % 211 + 0.25::double as x, (c_custkey * 53) % 223 + 0.75::double as y from customer)"""
POLY = "poly as (" + " union all ".join(
    f"select {i} as poly_id, '{p['type']}' as ptype, {x1}::double as x1, {y1}::double as y1, {x2}::double as x2, {y2}::double as y2"
    for i, p in enumerate(POLYGONS)
    for (x1, y1), (x2, y2) in zip(p["vertices"], p["vertices"][1:] + p["vertices"][:1], strict=True)
) + ")"


def _hit(points: str, key: str) -> str:
    """SQL: (key, poly_id) of points inside polygons."""
    return f"hit as (select {key}, poly_id, any_value(ptype) as ptype from {points} p, poly where (y1 > p.y) <> (y2 > p.y) and p.x < x1 + (p.y - y1) * (x2 - x1) / nullif(y2 - y1, 0) group by {key}, poly_id having count(*) % 2 = 1)"


RASTER = 'ras as (select p_partkey // 30 as r, p_partkey % 30 as c, (7 * (p_partkey // 30) + 13 * (p_partkey % 30)) % 4 as val from part)'
TRIANGLE = """fan as (select a.elem_id, a.node_id as n0, b.node_id as n1, c.node_id as n2 from elem_node a join elem_node b on a.elem_id = b.elem_id and a.pos = 0 and b.pos >= 1 join elem_node c on c.elem_id = a.elem_id and c.pos = b.pos + 1),
tri as (select elem_id, a.x as ax, a.y as ay, b.x as bx, b.y as by_, c.x as cx, c.y as cy from fan join node a on a.node_id = n0 join node b on b.node_id = n1 join node c on c.node_id = n2)"""


def _in_tri(points: str) -> str:
    return f"""bary as (select p.point_id, elem_id, ((p.x - ax) * (cy - ay) - (cx - ax) * (p.y - ay)) / ((bx - ax) * (cy - ay) - (cx - ax) * (by_ - ay)) as u,
 ((bx - ax) * (p.y - ay) - (p.x - ax) * (by_ - ay)) / ((bx - ax) * (cy - ay) - (cx - ax) * (by_ - ay)) as v from {points} p join tri on p.x between least(ax, bx, cx) and greatest(ax, bx, cx) and p.y between least(ay, by_, cy) and greatest(ay, by_, cy)),
inel as (select point_id, min(elem_id) as elem_id from bary where u >= 0 and v >= 0 and u + v <= 1 group by 1)"""


NEAR = "near as (select c.point_id, s.point_id as site_id, (c.x - s.x) ** 2 + (c.y - s.y) ** 2 as d2, s.value, row_number() over (partition by c.point_id order by (c.x - s.x) ** 2 + (c.y - s.y) ** 2, s.point_id)::int as rnk from cust c, pts s)"
LINE = "line as (select * from (values " + ", ".join(f"({a}, {b}, {x0}::double, {y0}::double, {x1}::double, {y1}::double)" for a, b, x0, y0, x1, y1 in LINES) + ") t(line_id, seg, x0, y0, x1, y1))"
CROSSED = LINE + """, crossed as (select line_id, seg, elem_id from elem_node join node using (node_id), line group by line_id, seg, elem_id, x0, x1, y0, y1
 having min(sign((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0))) < 0 and max(sign((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0))) > 0 and min(x) <= greatest(x0, x1) and max(x) >= least(x0, x1) and min(y) <= greatest(y0, y1) and max(y) >= least(y0, y1))"""
NBR = """pair as (select elem_id, node_id as p, coalesce(lead(node_id) over w, first_value(node_id) over w) as q from elem_node window w as (partition by elem_id order by pos)),
nbr as (select distinct p as a, q as b from pair union select distinct q, p from pair)"""


OUTER = "outer_ as (select least(p, q) as a, greatest(p, q) as b from pair group by 1, 2 having count(*) = 1)"


def _smooth_sql(rounds: int, velocity: str = "0") -> str:
    """``sm``: round i from round i - 1; the last one is asked for."""
    return f"""sm(i, node_id, v) as (select 0, node_id, depth::double from node
  union all select o.i + 1, o.node_id, o.v + coalesce(0.05::double * (m.m - o.v), 0) + {velocity} from sm o left join (select a as node_id, avg(v) as m from nbr join sm on b = sm.node_id group by 1) m on m.node_id = o.node_id where o.i < {rounds})"""


def _smoothed(s, d, velocity=None):
    return G.laplace_smooth(node(s, d).select("node_id", F.col("depth").alias("value")), M.neighbors(M.build_edges(elem_node(s, d))), velocity=velocity, node=node(s, d))


QUERIES = {
    "points_in_box": (lambda s, d: P.points_in_box(node(s, d), 20.0, 90.0, 10.0, 60.0), f"with {NODE} select * from node where x between 20 and 90 and y between 10 and 60"),
    "points_in_polygon": (
        lambda s, d: P.points_in_polygon(node(s, d), _polygons(s), CELL).select("node_id", "poly_id"),
        f"with {NODE}, {POLY}, {_hit('node', 'node_id')} select node_id, poly_id from hit",
    ),
    "apply_polygons": (
        lambda s, d: _r(P.apply_polygons(node(s, d), POLYGONS, CELL), "value"),
        f"""with {NODE}, {POLY}, {_hit('node', 'node_id')}, f as (select n.*, exists (select 1 from hit h where h.node_id = n.node_id and poly_id = 0) as a, exists (select 1 from hit h where h.node_id = n.node_id and poly_id = 1) as b,
 exists (select 1 from hit h where h.node_id = n.node_id and poly_id = 2) as c from node n), g as (select *, case when a then 12.5 else depth end as v from f), h as (select *, case when b then greatest(v, x * 0.1::double + 3) else v end as w from g)
select node_id, round(case when c then least(w, least(depth, 20.0) + y / 10) else w end + 1e-9, 6) as value from h""",
    ),
    "region_constraints": (
        lambda s, d: P.region_constraints(P.points_in_polygon(node(s, d), _polygons(s), CELL).where("ptype <> 'none'").select("node_id", "ptype", (F.col("poly_id") * 4).alias("layers"))),
        f"with {NODE}, {POLY}, {_hit('node', 'node_id')} select node_id, greatest(coalesce(max(poly_id * 4 + 1) filter (ptype = 'min'), 2), 2) as nmin, min(poly_id * 4) filter (ptype = 'max') as nmax from hit where ptype <> 'none' group by 1",
    ),
    "partition_check": (
        lambda s, d: P.partition_check(M.elem_geometry(elem_node(s, d), node(s, d)).select(F.col("elem_id").alias("cell_id"), F.col("mx").alias("x"), F.col("my").alias("y")), _polygons(s), CELL),
        f"with {MESH}, {POLY}, c as (select elem_id as cell_id, avg(x) as x, avg(y) as y from elem_node join node using (node_id) group by 1), {_hit('c', 'cell_id')} select c.cell_id, count(poly_id) as n, max(poly_id) as region from c left join hit using (cell_id) group by 1",
    ),
    "find_elem": (lambda s, d: P.find_elem(_customers(s, d), elem_node(s, d), node(s, d), CELL), f"with {MESH}, {POINTS}, {TRIANGLE}, {_in_tri('cust')} select * from inel"),
    "closest_node": (
        lambda s, d: P.nearest(_customers(s, d), _sites(s, d), 3, CELL),
        f"with {POINTS}, {NEAR} select point_id, site_id, d2, rnk as rank from near where rnk <= 3",
    ),
    "snap_points": (
        lambda s, d: P.snap_points(_customers(s, d), elem_node(s, d), node(s, d), CELL),
        f"""with {MESH}, {POINTS}, {TRIANGLE}, {_in_tri('cust')}, ctr as (select elem_id, avg(x) as x, avg(y) as y from elem_node join node using (node_id) group by 1),
n as (select c.point_id, min([(c.x - t.x) ** 2 + (c.y - t.y) ** 2, t.elem_id])[2]::bigint as elem_id from cust c, ctr t where c.point_id not in (select point_id from inel) group by 1)
select point_id, elem_id, false as snapped from inel union all select point_id, elem_id, true from n""",
    ),
    "nearest_node_map": (
        lambda s, d: P.nearest(_customers(s, d), _sites(s, d), 1, CELL).select(F.lit(1).alias("one"), "d2").groupBy("one").agg(F.round(F.avg(F.when(F.col("d2") <= 100, 100.0).otherwise(0.0)), 6).alias("percent")).select("percent"),
        f"with {POINTS}, {NEAR} select round(avg(case when d2 <= 100 then 100.0::double else 0 end), 6) as percent from near where rnk = 1",
    ),
    "idw_interp": (
        lambda s, d: _r(P.idw(_customers(s, d), _sites(s, d), CELL), "value"),
        f"with {POINTS}, {NEAR}, k as (select *, row_number() over (partition by point_id order by rnk) as n from near where rnk <= 10 and value is not null) select point_id, round(coalesce(avg(value) filter (d2 = 0), sum(value / nullif(d2, 0)) / sum(1 / nullif(d2, 0))) + 1e-9, 6) as value from k where n <= 6 group by 1",
    ),
    "nearest_station_fill": (
        lambda s, d: P.nearest(_customers(s, d), _sites(s, d).where("value is not null"), 1, CELL).join(_sites(s, d), "site_id").select("point_id", "value"),
        f"with {POINTS}, n as (select c.point_id, s.value, row_number() over (partition by c.point_id order by (c.x - s.x) ** 2 + (c.y - s.y) ** 2, s.point_id) as rnk from cust c, pts s where s.value is not null) select point_id, value from n where rnk = 1",
    ),
    "line_elements": (lambda s, d: P.line_elements(_lines(s), elem_node(s, d), node(s, d), CELL), f"with {MESH}, {CROSSED} select * from crossed"),
    "line_local_ops": (
        lambda s, d: _r(P.line_local(P.line_elements(_lines(s), elem_node(s, d), node(s, d), CELL), elem_node(s, d), node(s, d)), "lo", "hi", "mean", "mid"),
        f"""with {MESH}, {CROSSED}, sup as (select distinct line_id, seg, e.node_id, f.node_id as support from crossed c join elem_node e using (elem_id) join elem_node f using (elem_id)),
st as (select line_id, seg, s.node_id, min(depth) as lo, max(depth) as hi, avg(depth) as mean, median(depth) as mid, row_number() over (partition by s.node_id order by line_id desc, seg desc) as r from sup s join node n on n.node_id = support group by 1, 2, 3)
select node_id, round(lo + 1e-9, 6) as lo, round(hi + 1e-9, 6) as hi, round(mean + 1e-9, 6) as mean, round(mid + 1e-9, 6) as mid from st where r = 1""",
    ),
    "dem_stack_sample": (
        lambda s, d: _r(dem_stack(s, d), "value"),
        f"""with {POINTS}, {RASTER}, dem as (select 1 as id, 0 as prio, r, c, 2.0::double * r + 3.0::double * c as val from ras where c < 20 and (r + c) % 17 <> 3 union all select 2, 1, r, c, 2.0::double * r + 3.0::double * c + 100 from ras),
meta as (select 1 as id, 10.0::double as x0, 5.0::double as dx union all select 2, 0.0, 8.0), f as (select point_id, id, (x - x0) / dx - 0.5 as fx, y / dx - 0.5 as fy from cust, meta),
q as (select f.point_id, dem.prio, sum(dem.val * (1 - abs(fx - dem.c)) * (1 - abs(fy - dem.r))) as v, count(*) as n from f join dem on dem.id = f.id and dem.c between floor(fx) and floor(fx) + 1 and dem.r between floor(fy) and floor(fy) + 1 group by 1, 2)
select point_id, round(arg_min(v, prio) + 1e-9, 6) as value from q where n = 4 group by 1""",
    ),
    "raster_stencil": (
        lambda s, d: P.raster_stencil(_customers(s, d), _raster(s, d), 0.0, 0.0, 8.0, 8.0, 1),
        f"with {POINTS}, {RASTER}, o as (select unnest([-1, 0, 1])::int as o) select point_id, a.o as di, b.o as dj, coalesce(val, 0) as val from cust, o a, o b left join ras on r = floor(y / 8)::bigint + a.o and c = floor(x / 8)::bigint + b.o",
    ),
    "like_class_mean": (
        lambda s, d: _r(like_class(s, d), "density"),
        f"""with {POINTS}, {RASTER}, o as (select unnest([-1, 0, 1])::int as o), st as (select point_id, y, a.o as di, b.o as dj, coalesce(val, 0) as k from cust, o a, o b left join ras on r = floor(y / 8)::bigint + a.o and c = floor(x / 8)::bigint + b.o),
bn as (select *, (k + di + 5) % 3 as b from st), ce as (select point_id, k as k0, b as b0 from bn where di = 0 and dj = 0)
select point_id, round(case when any_value(k0) = 0 or any_value(y) > 180 then 0.0 else avg(k + b / 10.0::double) end + 1e-9, 6) as density from bn join ce using (point_id) where k = k0 and b = b0 group by 1""",
    ),
    "zonal_mean_to_nodes": (
        lambda s, d: _r(zonal(s, d), "value"),
        f"""with {MESH}, {RASTER}, {TRIANGLE}, px as (select r * 1000 + c as point_id, c * 6.0::double + 3.1::double as x, r * 6.0::double + 3.3::double as y, val from ras), {_in_tri('px')},
em as (select elem_id, avg(val) as m from inel join px using (point_id) group by 1), ar as (select elem_id, abs(sum((bx - ax) * (cy - ay) - (cx - ax) * (by_ - ay))) / 2 as area from tri group by 1)
select node_id, round(sum(area * m) / sum(area) + 1e-9, 6) as value from elem_node join em using (elem_id) join ar using (elem_id) group by 1""",
    ),
    "overlap_blend": (
        lambda s, d: _r(_blend(s, d), "value", "weight"),
        "with c as (select c_custkey % 50 as node_id, case when c_custkey % 9 <> 0 then c_acctbal end as value, (c_custkey % 7) / 7.0::double as weight from customer), w as (select node_id, value, case when value is not null then weight end as w from c) select node_id, round(coalesce(sum(w * value) / nullif(sum(w), 0), -9999.0) + 1e-9, 6) as value, round(coalesce(sum(w * w) / nullif(sum(w), 0), 0) + 1e-9, 6) as weight from w group by 1",
    ),
    "gaussian_weights": (
        lambda s, d: _r(P.gaussian_weights(node(s, d), _sites(s, d), 15.0, 10.0, CELL), "weight"),
        f"with {NODE}, {POINTS}, e as (select n.node_id, exp(-((n.x - s.x) ** 2 + (n.y - s.y) ** 2) / (2 * 15.0::double * 15.0::double)) as e from node n, pts s) select node_id, round(least(coalesce(sum(e) filter (e >= 0.001), 0), 1) / 10 + 1e-9, 6) as weight from e group by 1",
    ),
    "mesh_ring": (
        lambda s, d: G.mesh_ring(_seeds(s, d), elem_node(s, d), 3),
        f"""with {MESH}, {NBR}, {OUTER}, adj as (select distinct a.elem_id as a, b.elem_id as b from elem_node a join elem_node b using (node_id)), r0 as (select distinct elem_id as seed, elem_id, 0 as ring from pair join outer_ on least(p, q) = a and greatest(p, q) = b),
r1 as (select seed, b as elem_id, 1 as ring from r0 join adj on elem_id = a), r2 as (select distinct seed, b as elem_id, 2 as ring from r1 join adj on elem_id = a), r3 as (select distinct seed, b as elem_id, 3 as ring from r2 join adj on elem_id = a)
select seed, elem_id, min(ring) as ring from (select * from r0 union all select * from r1 union all select * from r2 union all select * from r3) group by 1, 2""",
    ),
    "laplace_smooth": (lambda s, d: _r(_smoothed(s, d), "value"), f"with recursive {MESH}, {NBR}, {_smooth_sql(150)} select node_id, round(v + 1e-9, 6) as value from sm where i = 150"),
    "ring_distance": (
        lambda s, d: G.ring_distance(_shore(s, d), M.neighbors(M.build_edges(elem_node(s, d))), 3).select("node_id", "ring"),
        f"with {MESH}, {NBR}, {OUTER}, r0 as (select distinct node_id, 0 as ring from (select a as node_id from outer_ union all select b from outer_)), r1 as (select distinct b as node_id, 1 as ring from r0 join nbr on node_id = a), r2 as (select distinct b as node_id, 2 as ring from r1 join nbr on node_id = a), r3 as (select distinct b as node_id, 3 as ring from r2 join nbr on node_id = a) select node_id, min(ring) as ring from (select * from r0 union all select * from r1 union all select * from r2 union all select * from r3) group by 1",
    ),
    "boundary_taper": (
        lambda s, d: _r(G.boundary_taper(G.ring_distance(_shore(s, d), M.neighbors(M.build_edges(elem_node(s, d))), 3), node(s, d).select("node_id", F.col("depth").alias("value")), 5.0, 3), "value"),
        f"with {MESH}, {NBR}, {OUTER}, r0 as (select distinct node_id, 0 as ring from (select a as node_id from outer_ union all select b from outer_)), r1 as (select distinct b as node_id, 1 as ring from r0 join nbr on node_id = a), r2 as (select distinct b as node_id, 2 as ring from r1 join nbr on node_id = a), r3 as (select distinct b as node_id, 3 as ring from r2 join nbr on node_id = a), d as (select node_id, min(ring) as d from (select * from r0 union all select * from r1 union all select * from r2 union all select * from r3) group by 1), w as (select n.node_id, depth, (1 - cos(pi() * greatest(least((3 - coalesce(d, 3)) / 3.0::double, 1), 0))) / 2 as w from node n left join d using (node_id)) select node_id, round(depth * (1 - w) + 5 * w + 1e-9, 6) as value from w",
    ),
    "components": (
        lambda s, d: connected_components(_deep_edges(s, d)),
        f"with {MESH}, {NBR}, deep as (select node_id from node where depth > 2), e as (select a, b from nbr where a in (select node_id from deep) and b in (select node_id from deep)), r as (with recursive reach as (select distinct a as node, a as seen from e union select r.node, e.b from reach r join e on r.seen = e.a) select * from reach) select node, min(seen) as component from r group by 1",
    ),
}


def _deep_edges(s, d):
    deep = node(s, d).where("depth > 2").select("node_id")
    e = M.build_edges(elem_node(s, d))
    return e.join(deep.withColumnRenamed("node_id", "a"), "a", "left_semi").join(deep.withColumnRenamed("node_id", "b"), "b", "left_semi").select("a", "b")
