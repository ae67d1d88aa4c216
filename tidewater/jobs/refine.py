"""Queries over mesh geometry beyond single elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewater.jobs.meshes import EDGE, RING, Z
from tidewater.jobs.places import CELL, LINES, NBR, _lines
from tidewater.operators import graph as G, mesh as M, refine as R, spatial as P
from tidewater.sources.bridge import ELEM, LEVEL, MESH, NODE, elem_node, level, node

#: Rounds of smoothing that interfaces get.
ROUNDS = 40
LINE = "line as (select * from (values " + ", ".join(f"({a}, {b}, {x0}::double, {y0}::double, {x1}::double, {y1}::double)" for a, b, x0, y0, x1, y1 in LINES) + ") v(line_id, seg, x0, y0, x1, y1))"


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


def _edges(s, d):
    return M.build_edges(elem_node(s, d))


def _nbrs(s, d):
    return M.neighbors(_edges(s, d))


def _bent(s, d):
    """Nodes moved off the grid, so that quads are uneven."""
    k = F.col("node_id")
    return node(s, d).withColumns({"x": F.col("x") + F.pmod(k * 7, F.lit(5)) * 1.5, "y": F.col("y") + F.pmod(k * 11, F.lit(7)) * 0.9})


BENT = "bent as (select node_id, x + (node_id * 7) % 5 * 1.5::double as x, y + (node_id * 11) % 7 * 0.9::double as y, depth from node)"


def _points(s, d):
    return R.quadrature_points(s, elem_node(s, d), _bent(s, d)).withColumn("dem", F.col("x") * 0.3 + F.col("y") * 0.2)


def _gradient(s, d):
    points = _points(s, d)
    return R.misfit_gradient(points, R.dem_misfit(points))


def _rule_rows() -> str:
    text = lambda v: "[" + ", ".join(f"{x!r}::double" for x in v) + "]"
    return ", ".join(f"('{name}', {q}, {w!r}::double, {text(n)}, {text(a)}, {text(b)})" for name, points in R.quadrature_rules().items() for q, (w, n, a, b) in enumerate(points))


_QUAD = f"""{BENT}, rule as (select * from (values {_rule_rows()}) v(rule, q, w, n, da, db)),
cr as (select elem_id, pos, node_id, x, y, depth, lead(x) over w as xl, lead(y) over w as yl, first_value(x) over w as xf, first_value(y) over w as yf, nn from elem_node join bent using (node_id) window w as (partition by elem_id order by pos)),
ar as (select elem_id, any_value(nn) as nn, abs(sum(x * coalesce(yl, yf) - coalesce(xl, xf) * y)) / 2 as area from cr group by 1),
rl as (select *, case when nn = 3 then 'tri' when area < {R.QUAD_AREAS[0]} then 'quad3' when area < {R.QUAD_AREAS[1]} then 'quad4' else 'quad5' end as rule from ar),
mx as (select elem_id, area, q, any_value(r.w) as w, sum(n[pos + 1] * x) as x, sum(n[pos + 1] * y) as y, sum(n[pos + 1] * depth) as z, abs(sum(da[pos + 1] * x) * sum(db[pos + 1] * y) - sum(da[pos + 1] * y) * sum(db[pos + 1] * x)) as jac from rl join rule r using (rule) join cr using (elem_id) group by 1, 2, 3),
qp as (select elem_id, q, x, y, z, w * jac * area / sum(w * jac) over (partition by elem_id) as w, x * 0.3 + y * 0.2 as dem from mx),
mf as (select elem_id, sum(w * (z - dem) ** 2) / sum(w) as misfit, sum(w * (z - dem)) / sum(w) as residual, sum(w) * (sum(w * (z - dem)) / sum(w)) ** 2 / 2 as energy from qp group by 1)"""
_SPLIT = f"""{BENT}, q as (select elem_id, max(case when pos = 0 then node_id end) as n0, max(case when pos = 1 then node_id end) as n1, max(case when pos = 2 then node_id end) as n2, max(case when pos = 3 then node_id end) as n3 from elem_node where nn = 4 group by 1),
cn as (select e.elem_id, n.x, n.y, p.x as px, p.y as py, u.x as qx, u.y as qy from elem_node e join bent n using (node_id) join elem_node ep on ep.elem_id = e.elem_id and ep.pos = (e.pos + 3) % 4 join bent p on p.node_id = ep.node_id join elem_node eq on eq.elem_id = e.elem_id and eq.pos = (e.pos + 1) % 4 join bent u on u.node_id = eq.node_id where e.nn = 4),
an as (select elem_id, acos(greatest(least(((qx - x) * (px - x) + (qy - y) * (py - y)) / sqrt(((qx - x) ** 2 + (qy - y) ** 2) * ((px - x) ** 2 + (py - y) ** 2)), 1.0), -1.0)) as g from cn),
bad as (select elem_id from an group by 1 having greatest((max(g) - 2 * pi() / 3) / (pi() / 3), (2 * pi() / 3 - min(g)) / (2 * pi() / 3)) > 0.35),
tr as (select elem_id, 0 as dg, 0 as half, n0 as a, n1 as b, n2 as c from q union all select elem_id, 0, 1, n0, n2, n3 from q union all select elem_id, 1, 0, n0, n1, n3 from q union all select elem_id, 1, 1, n1, n2, n3 from q),
xy as (select t.*, a.x as ax, a.y as ay, b.x as bx, b.y as by_, c.x as cx, c.y as cy, sqrt((b.x - c.x) ** 2 + (b.y - c.y) ** 2) as la, sqrt((a.x - c.x) ** 2 + (a.y - c.y) ** 2) as lb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as lc from tr t join bent a on a.node_id = t.a join bent b on b.node_id = t.b join bent c on c.node_id = t.c where elem_id in (select elem_id from bad)),
ag as (select *, degrees(acos((lb ** 2 + lc ** 2 - la ** 2) / (2 * lb * lc))) as ga, degrees(acos((la ** 2 + lc ** 2 - lb ** 2) / (2 * la * lc))) as gb, degrees(acos((la ** 2 + lb ** 2 - lc ** 2) / (2 * la * lb))) as gc, sign((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) as turn from xy),
wt as (select elem_id, dg, case when min(turn) * max(turn) > 0 then round(max(greatest((greatest(ga, gb, gc) - 60) / 120, (60 - least(ga, gb, gc)) / 60)), 9) else 'inf'::double end as worst from ag group by 1, 2),
ch as (select elem_id, dg from (select *, row_number() over (partition by elem_id order by worst, dg) as r from wt) where r = 1)"""


def _chain(rounds: int) -> str:
    """``sm``: round i from round i - 1."""
    return f"""sm(i, node_id, nl, base, v) as (select 0, node_id, nl, base, v from v0
  union all select p.i + 1, p.node_id, p.nl, p.base, p.v + 0.3::double * coalesce(m - p.v, 0) from sm p left join (select n.a as node_id, avg(case when q.nl < o.nl then q.base else q.v end) as m from nbr n join sm q on q.node_id = n.b join sm o on o.node_id = n.a group by 1) m on m.node_id = p.node_id where p.i < {rounds})"""


def _faces(rounds: int) -> str:
    return f"""sm(i, node_id, k, h) as (select 0, node_id, k, h from h0
  union all select p.i + 1, p.node_id, p.k, p.h + 0.4::double * coalesce(m - p.h, 0) from sm p left join (select o.node_id, o.k, avg(coalesce(q.h, -d.depth)) as m from sm o join nbr n on n.a = o.node_id join node d on d.node_id = n.b left join sm q on q.node_id = n.b and q.k = o.k group by 1, 2) m on m.node_id = p.node_id and m.k = p.k where p.i < {rounds})"""


def layered(s, d):
    layers = M.level_counts(level(s, d)).select("node_id", "nlayer")
    return _r(R.laplace_layered(node(s, d).select("node_id", F.col("depth").alias("value")), layers, _nbrs(s, d), 0.3, node=node(s, d)), "value")


def faces(s, d):
    h = M.build_z(level(s, d), node(s, d)).select("node_id", "k", F.col("z").alias("h"))
    return _r(G.interface_smooth(h, _nbrs(s, d), F.lit(0.4), node(s, d).select("node_id", (-F.col("depth")).alias("depth")), ROUNDS, node(s, d)), "h")


def trimmed(s, d):
    west = M.elem_geometry(elem_node(s, d), node(s, d)).where("mx < 95").select("elem_id")
    cut = M.perimeter_edges(_edges(s, d), west).where("er >= 0")
    return R.trim_side(elem_node(s, d), _edges(s, d), cut, west.where("elem_id = 0"))


def _wanted(s, d):
    return node(s, d).select("node_id", (F.pmod(F.col("node_id") * 37, F.lit(100)) / 17 + 1.2).alias("wanted"))


def _shores(s, d):
    k = F.col("node_id")
    return node(s, d).select(F.pmod(k, F.lit(20)).alias("line_id"), F.floor(k / 20).alias("seq"), "node_id", "depth")


QUERIES = {
    "crossed_edges": (
        lambda s, d: _r(R.crossed_edges(_lines(s), P.line_elements(_lines(s), elem_node(s, d), node(s, d), CELL), _edges(s, d), node(s, d)), "at"),
        f"""with {MESH}, {EDGE}, {LINE}, sd as (select l.*, a, b, p.x as xa, p.y as ya, q.x as xb, q.y as yb, (x1 - x0) * (p.y - y0) - (y1 - y0) * (p.x - x0) as sa, (x1 - x0) * (q.y - y0) - (y1 - y0) * (q.x - x0) as sb from line l, edge join node p on p.node_id = a join node q on q.node_id = b),
pt as (select *, ((xa + sa / (sa - sb) * (xb - xa) - x0) * (x1 - x0) + (ya + sa / (sa - sb) * (yb - ya) - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2) as at_ from sd where sa * sb < 0)
select line_id, seg, (row_number() over (partition by line_id, seg order by round(at_, 9), a, b))::int as "rank", a, b, case when sa > 0 then a else b end as up, case when sa > 0 then b else a end as down, round(at_ + 1e-9, 6) as "at" from pt where at_ between 0 and 1""",
    ),
    "quadrature_points": (lambda s, d: _r(_points(s, d).drop("shape", "dem"), "x", "y", "z", "w"), f"with {MESH}, {_QUAD} select elem_id, q, round(x + 1e-9, 6) as x, round(y + 1e-9, 6) as y, round(z + 1e-9, 6) as z, round(w + 1e-9, 6) as w from qp"),
    "dem_misfit": (lambda s, d: _r(R.dem_misfit(_points(s, d)), "misfit", "residual", "energy"), f"with {MESH}, {_QUAD} select elem_id, round(misfit + 1e-9, 6) as misfit, round(residual + 1e-9, 6) as residual, round(energy + 1e-9, 6) as energy from mf"),
    "misfit_gradient": (
        lambda s, d: _r(_gradient(s, d), "gradient"),
        f"with {MESH}, {_QUAD} select node_id, round(sum(residual * qp.w * n[pos + 1]) + 1e-9, 6) as gradient from qp join mf using (elem_id) join rl using (elem_id) join rule r on r.rule = rl.rule and r.q = qp.q join cr using (elem_id) group by 1",
    ),
    "elem_volume_dem": (lambda s, d: _r(R.elem_volume_dem(_points(s, d), 30.0), "volume"), f"with {MESH}, {_QUAD} select elem_id, round(sum(w * greatest(30 - dem, 0)) + 1e-9, 6) as volume from qp group by 1"),
    "split_quads": (
        lambda s, d: R.split_quads(elem_node(s, d), _bent(s, d), 0.35),
        f"with {MESH}, {_SPLIT} select elem_id, dg as diagonal, half, p as pos, case p when 0 then a when 1 then b else c end as node_id from tr join ch using (elem_id, dg), (values (0), (1), (2)) v(p)",
    ),
    "trim_side": (
        trimmed,
        f"""with recursive {MESH}, {RING}, {EDGE}, w as (select elem_id from geo where mx < 95), st as (select el, er from edge where er >= 0 and (el in (select elem_id from w)) = (er in (select elem_id from w))), tw as (select el, er from st union all select er, el from st),
rc as (select 0::bigint as elem_id union select tw.er from rc join tw on tw.el = rc.elem_id) select elem_id, pos::int as pos, node_id from elem_node where elem_id not in (select elem_id from rc)""",
    ),
    "shore_floor": (
        lambda s, d: R.shore_floor(_shores(s, d), 2, 40.0),
        f"with {NODE}, sh as (select node_id % 20 as l, node_id // 20 as seq, node_id, depth from node), en as (select l, min(seq) as f, max(seq) as z from sh where depth <= 40 group by 1) select node_id, max(depth) over (partition by l order by seq rows between 2 preceding and 2 following) as value from sh join en using (l) where seq between f and z",
    ),
    "quantize_levels": (
        lambda s, d: R.quantize_levels(_wanted(s, d), _nbrs(s, d)),
        f"with {MESH}, {NBR}, w as (select node_id, (node_id * 37) % 100 / 17.0::double + 1.2 as w, round_even((node_id * 37) % 100 / 17.0::double + 1.2, 0)::bigint as n from node), r as (select a as node_id, n from nbr join w on w.node_id = b union all select node_id, n from w), m as (select node_id, list_sort(list(n)) as s from r group by 1) select node_id, greatest(least(s[len(s) // 2 + 1], ceil(w)), floor(w), 2)::bigint as nlevel from m join w using (node_id)",
    ),
    "laplace_layered": (layered, f"with recursive {MESH}, {LEVEL}, {NBR}, v0 as (select node_id, count(*) - 1 as nl, any_value(depth) as base, any_value(depth) as v from node join level using (node_id) group by 1), {_chain(150)} select node_id, round(v + 1e-9, 6) as value from sm where i = 150"),
    "interface_smooth": (faces, f"with recursive {Z}, {ELEM}, {NBR}, h0 as (select node_id, k, z as h from z), {_faces(ROUNDS)} select node_id, k, round(h + 1e-9, 6) as h from sm where i = {ROUNDS}"),
    "bottom_thickness": (
        lambda s, d: _r(R.bottom_thickness(M.build_z(level(s, d), node(s, d)), _nbrs(s, d), 1.0), "value"),
        f"""with {Z}, {ELEM}, {NBR}, u as (select node_id, k, lead(z) over (partition by node_id order by k) - z as t from z), t0 as (select node_id, greatest(min_by(t, k), 1)::double as v from u where t is not null group by 1),
t1 as (select p.node_id, v + 0.5 * coalesce(m - v, 0) as v from t0 p left join (select a, avg(v) as m from nbr join t0 on node_id = b group by 1) m on m.a = p.node_id), t2 as (select p.node_id, v + 0.5 * coalesce(m - v, 0) as v from t1 p left join (select a, avg(v) as m from nbr join t1 on node_id = b group by 1) m on m.a = p.node_id) select node_id, round(greatest(v, 1) + 1e-9, 6) as value from t2""",
    ),
    "tv_step": (
        lambda s, d: _r(R.tv_step(_edges(s, d), node(s, d), M.elem_geometry(elem_node(s, d), node(s, d)), elem_node(s, d)), "value"),
        f"""with {MESH}, {RING}, {NBR}, ms as (select node_id, sum(area / n) as mass from elem_node join geo using (elem_id) group by 1), g as (select p.node_id, any_value(p.depth) as depth, sum(sign(p.depth - q.depth) / (sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) + 1e-12)) as g, sum(1 / (sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) + 1e-12)) as p, min(q.depth) as lo, max(q.depth) as hi
 from nbr join node p on p.node_id = a join node q on q.node_id = b group by 1), dt as (select 0.5 / max(p / mass) as dt from g join ms using (node_id)) select node_id, round(greatest(least(depth - dt * g / mass, greatest(hi, depth)), least(lo, depth)) + 1e-9, 6) as value from g join ms using (node_id), dt""",
    ),
}
