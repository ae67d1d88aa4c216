"""Queries of boundaries, structures and clips, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewater.jobs import refine
from tidewater.jobs.meshes import EDGE
from tidewater.jobs.places import CELL, _lines
from tidewater.operators import mesh as M, outlines as O, refine as R, spatial as P
from tidewater.sources.bridge import MESH, NODE, elem_node, node, table

#: Hand-made open boundaries, a box of elements left out as an island, and a clip box (fixed values of these queries).
SEGMENTS = [(0, "ocean", 2.0, -3.0, 171.0, -1.0), (1, "river", 193.0, 31.0, 192.0, 62.0)]
HOLE = (50.0, 80.0, 30.0, 50.0)
BOX = (31.0, 77.0, 143.0, 12.0)
CONSTITUENTS = [("M2", 0.5, 120.0), ("K1", 0.3, 210.0)]


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


def _holed(s, d):
    x0, x1, y0, y1 = HOLE
    out = M.elem_geometry(elem_node(s, d), node(s, d)).where(F.col("mx").between(x0, x1) & F.col("my").between(y0, y1)).select("elem_id")
    return elem_node(s, d).join(out, "elem_id", "left_anti")


def _segments(s):
    return s.createDataFrame([(o, n, *p) for o, n, *p in SEGMENTS], "ord int, name string, x0 double, y0 double, x1 double, y1 double")


def strings(s, d):
    return O.boundary_strings(_holed(s, d), node(s, d), _segments(s), CELL)


def forced(s, d):
    own = strings(s, d).where("kind = 'open'").join(F.broadcast(_segments(s).select(F.col("ord").cast("long").alias("string_no"), "name")), "string_no").select("name", "seq", "node_id")
    rows = s.createDataFrame([(n, k, a, p) for _, n, *_ in SEGMENTS for k, a, p in CONSTITUENTS], "name string, constituent string, a double, p double")
    # One amplitude for all nodes, a phase for each.
    size = own.groupBy("name").agg(F.count("*").alias("n"))
    phases = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: F.col("p") + i)
    return _r(O.boundary_forcing(own, rows.join(size, "name").select("name", "constituent", F.array("a").alias("amplitude"), phases.alias("phase"))), "amplitude", "phase")


def _crossings(s, d):
    got = R.crossed_edges(_lines(s), P.line_elements(_lines(s), elem_node(s, d), node(s, d), CELL), M.build_edges(elem_node(s, d)), node(s, d))
    return got.select("line_id", "seg", "rank", F.col("up").alias("down"), F.col("down").alias("up"))


def pairs(s, d):
    return O.structure_pairs(_crossings(s, d), M.build_edges(elem_node(s, d)), elem_node(s, d))


def reference(s, d):
    return O.structure_reference(pairs(s, d), M.neighbors(M.build_edges(elem_node(s, d))), node(s, d))


def _features(s, d):
    """Suppliers as lines and polygons of four vertices, in and around the mesh."""
    k = F.col("s_suppkey")
    seq = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq")
    own = table(s, d, "supplier").select(k.alias("feature_id"), (k % 2 == 0).alias("closed"), (F.pmod(k * 97, F.lit(701)) - 250.0).alias("x"), (F.pmod(k * 61, F.lit(503)) - 200.0).alias("y"), seq)
    return own.select("feature_id", "closed", "seq", (F.col("x") + F.when(F.col("seq").isin(1, 2), 90.0).otherwise(0.0)).alias("x"), (F.col("y") + F.when(F.col("seq") >= 2, 70.0).otherwise(0.0)).alias("y"))


def _meta(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(k.alias("raster_id"), (F.pmod(k * 37, F.lit(211)) - 40.3).alias("x0"), (F.pmod(k * 53, F.lit(223)) + 10.7).alias("y0"), (F.pmod(k, F.lit(4)) + 1.5).alias("dx"), (-(F.pmod(k, F.lit(3)) + 1.25)).alias("dy"), (F.pmod(k, F.lit(60)) + 5).alias("cols"), (F.pmod(k, F.lit(70)) + 5).alias("rows"))


def _grid(s, d):
    k = F.col("p_partkey")
    i, j = F.floor(k / 15), F.pmod(k, F.lit(15))
    return table(s, d, "part").select(i.alias("i"), j.alias("j"), (j * 13 + i * 0.7 + 0.37).alias("x"), (i * 12 + j * 0.5 + 0.61).alias("y"))


def _customers(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(k.alias("point_id"), (F.pmod(k * 37, F.lit(211)) + 0.25).alias("x"), (F.pmod(k * 53, F.lit(223)) + 0.75).alias("y"))


_SEG = "seg as (select * from (values " + ", ".join(f"({o}, '{n}', {a}::double, {b}::double, {x}::double, {y}::double)" for o, n, a, b, x, y in SEGMENTS) + ") v(ord, name, x0, y0, x1, y1))"
_X0, _X1, _Y0, _Y1 = HOLE
_WALK = f"""{MESH}, {_SEG}, hole as (select elem_id from elem_node join node using (node_id) group by 1 having avg(x) between {_X0} and {_X1} and avg(y) between {_Y0} and {_Y1}),
side as (select elem_id, node_id as p, coalesce(lead(node_id) over w, first_value(node_id) over w) as q from elem_node where elem_id not in (select elem_id from hole) window w as (partition by elem_id order by pos)),
nxt as (select p, q from side s where not exists (select 1 from side t where t.p = s.q and t.q = s.p)),
near as (select ord, e, arg_min(node_id, struct_pack(d := (n.x - px) ** 2 + (n.y - py) ** 2, i := node_id)) as mark from (select ord, 0 as e, x0 as px, y0 as py from seg union all select ord, 1, x1, y1 from seg) a, node n where node_id in (select p from nxt) group by 1, 2),
opn as (select a.ord, a.mark as s, b.mark as t from near a join near b on a.ord = b.ord and a.e = 0 and b.e = 1),
wo as (select 'open' as kind, ord as no, 0 as seq, s as node_id, t from opn union all select kind, no, seq + 1, q, t from wo join nxt on p = node_id where seq = 0 or node_id <> t),
wl as (select 'land' as kind, ord as no, 0 as seq, t as node_id from opn where t not in (select s from opn) union all select kind, no, seq + 1, q from wl join nxt on p = node_id where seq = 0 or node_id not in (select s from opn)),
rest as (select p from nxt where p not in (select node_id from wo) and p not in (select node_id from wl)),
reach as (select p as a, p as b from rest union select a, q from reach join nxt on p = b),
isl as (select a, row_number() over (order by a) - 1 as no from (select a from reach group by a having a = min(b))),
wi as (select 'island' as kind, no, 0 as seq, a as node_id, a from isl union all select kind, no, seq + 1, q, a from wi join nxt on p = node_id where seq = 0 or node_id <> a),
strings as (select kind, no, seq, node_id from wo union all select * from wl union all select kind, no, seq, node_id from wi)"""
_CON = "con as (select * from (values " + ", ".join(f"('{k}', {a}::double, {p}::double)" for k, a, p in CONSTITUENTS) + ") v(constituent, a, p))"
_PATHS = f"""{MESH}, {EDGE}, nbr as (select a, b from edge union all select b, a from edge), ce as ({refine.QUERIES['crossed_edges'][1]}),
two as (select line_id, 'up' as side, down as n, seg, "rank" as rk from ce union all select line_id, 'down', up, seg, "rank" from ce), fst as (select line_id, side, n, min(struct_pack(s := seg, r := rk)) as at_ from two group by 1, 2, 3),
pth as (select *, row_number() over w as pos, lead(n) over w as nx from fst window w as (partition by line_id, side order by at_, n)),
brk as (select p.*, min(a.elem_id) as elem_id from pth p join elem_node a on a.node_id = n join elem_node b on b.node_id = nx and b.elem_id = a.elem_id where not exists (select 1 from nbr where nbr.a = p.n and nbr.b = p.nx) group by all),
ins as (select line_id, side, brk.pos + 0.5 as pos, arg_min(e.node_id, e.pos) as n from brk join elem_node e using (elem_id) where e.node_id not in (n, nx) and not exists (select 1 from pth q where q.line_id = brk.line_id and q.n = e.node_id) group by 1, 2, 3),
ful as (select line_id, side, n, row_number() over (partition by line_id, side order by pos) as pair from (select line_id, side, pos::double as pos, n from pth union all select line_id, side, pos::double, n from ins)),
prs as (select u.line_id, u.pair, u.n as up, d.n as down from ful u join ful d on u.line_id = d.line_id and u.pair = d.pair and u.side = 'up' and d.side = 'down')"""
_L, _T, _RT, _B = BOX


def _area(*k: int) -> str:
    (xa, ya), (xb, yb), (xc, yc) = (("p.x", "p.y") if i == 0 else (f"c{i}.x", f"c{i}.y") for i in k)
    return f"abs(({xa} - {xc}) * ({yb} - {yc}) - ({xb} - {xc}) * ({ya} - {yc})) / 2"


QUERIES = {
    "boundary_strings": (strings, f"with recursive {_WALK} select kind, no::bigint as string_no, seq::bigint as seq, node_id from strings"),
    "boundary_forcing": (
        forced,
        f"with recursive {_WALK}, {_CON} select name, constituent, seq::bigint as seq, node_id, round(a + 1e-9, 6) as amplitude, round(p + seq + 1e-9, 6) as phase from wo join seg on ord = no, con",
    ),
    "structure_pairs": (pairs, f"with {_PATHS} select line_id, pair::int as pair, up, down from prs"),
    "structure_reference": (
        reference,
        f"""with {_PATHS}, sd as (select line_id, pair, 'up' as side, up as n from prs union all select line_id, pair, 'down', down from prs),
en as (select line_id, side, arg_min(n, pair) as f, arg_max(n, pair) as l, count(*) as k from sd group by 1, 2), md as (select sd.*, f, l from sd join en using (line_id, side) where pair = k // 2 + 1),
cd as (select md.line_id, side, nbr.b as m, abs((l_.x - f_.x) * (m_.x - n_.x) + (l_.y - f_.y) * (m_.y - n_.y)) / (sqrt((l_.x - f_.x) ** 2 + (l_.y - f_.y) ** 2) * sqrt((m_.x - n_.x) ** 2 + (m_.y - n_.y) ** 2)) as lean
 from md join nbr on nbr.a = n join node n_ on n_.node_id = n join node m_ on m_.node_id = nbr.b join node f_ on f_.node_id = f join node l_ on l_.node_id = l where not exists (select 1 from sd s where s.line_id = md.line_id and s.n = nbr.b)),
bs as (select line_id, side, arg_min(m, struct_pack(a := round(lean, 9), b := m)) as m from cd group by 1, 2)
select p.line_id, max(case when side = 'up' then m end) as up, max(case when side = 'down' then m end) as down from (select distinct line_id from prs) p left join bs using (line_id) group by 1""",
    ),
    "clip_features": (
        lambda s, d: O.clip_features(_features(s, d), node(s, d), 15.0),
        f"""with {NODE}, b as (select min(x) - 15 as x0, max(x) + 15 as x1, min(y) - 15 as y0, max(y) + 15 as y1 from node),
v as (select s_suppkey as f, s_suppkey % 2 = 0 as closed, q, (s_suppkey * 97) % 701 - 250.0::double + case when q in (1, 2) then 90 else 0 end as x, (s_suppkey * 61) % 503 - 200.0::double + case when q >= 2 then 70 else 0 end as y from supplier, (select unnest([0, 1, 2, 3]) as q)),
s as (select a.f, a.x, a.y, c.x - a.x as dx, c.y - a.y as dy from v a join v c on a.f = c.f and (c.q = a.q + 1 or (a.closed and a.q = 3 and c.q = 0))),
t as (select f, greatest(0, case when dx > 0 then (x0 - x) / dx when dx < 0 then (x1 - x) / dx end, case when dy > 0 then (y0 - y) / dy when dy < 0 then (y1 - y) / dy end) as lo,
 least(1, case when dx > 0 then (x1 - x) / dx when dx < 0 then (x0 - x) / dx end, case when dy > 0 then (y1 - y) / dy when dy < 0 then (y0 - y) / dy end) as hi, (dx <> 0 or x between x0 and x1) and (dy <> 0 or y between y0 and y1) as ok from s, b)
select distinct f as feature_id from t where ok and lo <= hi""",
    ),
    "clip_raster": (
        lambda s, d: _r(O.clip_raster(_meta(s, d), *BOX), "x0", "y0", "x1", "y1"),
        f"""with m as (select s_suppkey as id, (s_suppkey * 37) % 211 - 40.3::double as x, (s_suppkey * 53) % 223 + 10.7::double as y, s_suppkey % 4 + 1.5::double as dx, s_suppkey % 3 + 1.25::double as dy, s_suppkey % 60 + 5 as nc, s_suppkey % 70 + 5 as nr from supplier), e as (select *, x + nc * dx as xe, y - nr * dy as ye from m)
select id as raster_id, x < {_L} and y > {_T} and xe > {_RT} and ye < {_B} as complete, round(x + floor((greatest(x, {_L}) - x) / dx) * dx + 1e-9, 6) as x0, round(y - ceil((y - least(y, {_T})) / dy) * dy + 1e-9, 6) as y0,
 round(x + ceil((least(xe, {_RT}) - x) / dx) * dx + 1e-9, 6) as x1, round(y - floor((y - greatest(ye, {_B})) / dy) * dy + 1e-9, 6) as y1 from e where xe > {_L} and ye < {_T} and x < {_RT} and y > {_B}""",
    ),
    "barycentric_grid_map": (
        lambda s, d: _r(O.barycentric_map(_customers(s, d), _grid(s, d), CELL), "w0", "w1", "w2"),
        f"""with g as (select p_partkey // 15 as i, p_partkey % 15 as j, (p_partkey % 15) * 13 + (p_partkey // 15) * 0.7::double + 0.37::double as x, (p_partkey // 15) * 12 + (p_partkey % 15) * 0.5::double + 0.61::double as y from part),
p as (select c_custkey as id, (c_custkey * 37) % 211 + 0.25::double as x, (c_custkey * 53) % 223 + 0.75::double as y from customer),
a as (select p.id, c1.i, c1.j, {_area(0, 1, 2)} as a1, {_area(0, 2, 3)} as a2, {_area(0, 3, 4)} as a3, {_area(0, 4, 1)} as a4, {_area(1, 2, 3)} as b1, {_area(1, 3, 4)} as b2, {_area(0, 1, 3)} as ap
 from g c1 join g c2 on c2.i = c1.i + 1 and c2.j = c1.j join g c3 on c3.i = c1.i + 1 and c3.j = c1.j + 1 join g c4 on c4.i = c1.i and c4.j = c1.j + 1 join p on p.x between least(c1.x, c4.x) - 3 and greatest(c2.x, c3.x) + 3 and p.y between least(c1.y, c4.y) - 3 and greatest(c2.y, c3.y) + 3),
h as (select * from (select *, row_number() over (partition by id order by i, j) as r from a where abs(a1 + a2 + a3 + a4 - b1 - b2) / (b1 + b2) < 0.01) where r = 1), t as (select *, abs(a1 + a2 + ap - b1) / b1 < 0.05 as one from h),
w as (select *, greatest(least(case when one then a2 / b1 else a3 / b2 end, 1), 0) as w0, greatest(least(case when one then ap / b1 else a4 / b2 end, 1), 0) as w1 from t)
select id as point_id, i, j, case when one then 1 else 2 end as tri, round(w0 + 1e-9, 6) as w0, round(w1 + 1e-9, 6) as w1, round(greatest(least(1 - w0 - w1, 1), 0) + 1e-9, 6) as w2 from w""",
    ),
}
