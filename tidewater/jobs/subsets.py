"""Queries that cut meshes and outputs down."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.jobs.places import CELL, CROSSED, POLY, _hit, _lines, _polygons
from tidewater.jobs.meshes import EDGE
from tidewater.operators import mesh as M, regions as R, spatial as P
from tidewater.sources.bridge import LEVEL, MESH, elem_node, level, node, table


def _inside(s, d):
    centre = M.elem_geometry(elem_node(s, d), node(s, d)).select("elem_id", F.col("mx").alias("x"), F.col("my").alias("y"))
    return P.points_in_polygon(centre, _polygons(s), CELL).select("elem_id").distinct()


_CUT = f"""ctr as (select elem_id, avg(x) as x, avg(y) as y from elem_node join node using (node_id) group by 1), {_hit('ctr', 'elem_id')}, kept as (select e.* from elem_node e where elem_id in (select elem_id from hit)),
ni as (select node_id, row_number() over (order by node_id) - 1 as new_id from (select distinct node_id from kept)), ei as (select elem_id, row_number() over (order by elem_id) - 1 as new_elem from (select distinct elem_id from kept))"""

QUERIES = {
    "subset_region": (lambda s, d: R.subset_region(elem_node(s, d), _inside(s, d))[0], f"with {MESH}, {POLY}, {_CUT} select new_elem as elem_id, pos, new_id as node_id from kept join ni using (node_id) join ei using (elem_id)"),
    "subset_field": (
        lambda s, d: R.subset_field(level(s, d), R.subset_region(elem_node(s, d), _inside(s, d))[1]).select("node_id", "k", "sigma"),
        f"with {MESH}, {LEVEL}, {POLY}, {_CUT} select new_id as node_id, k, sigma from level join ni using (node_id)",
    ),
    "flux_flags": (
        lambda s, d: R.flux_flags(P.line_elements(_lines(s), elem_node(s, d), node(s, d), CELL), M.build_edges(elem_node(s, d)), node(s, d), _lines(s)),
        f"""with {MESH}, {EDGE}, {CROSSED}, two as (select a, b, el as elem_id, er as other from edge where er >= 0 union all select a, b, er, el from edge where er >= 0),
f as (select elem_id, line_id, seg, 0 as step, line_id + 1 as flag from crossed union all select t.other, l.line_id, l.seg, 1, l.line_id from crossed c join two t using (elem_id) join line l using (line_id, seg) join node p on p.node_id = t.a join node q on q.node_id = t.b
 where (x1 - x0) * (p.y - y0) - (y1 - y0) * (p.x - x0) > 0 and (x1 - x0) * (q.y - y0) - (y1 - y0) * (q.x - x0) > 0)
select elem_id, flag from (select *, row_number() over (partition by elem_id order by line_id desc, seg desc, step desc, flag desc) as r from f) where r = 1""",
    ),
    "label_values": (
        lambda s, d: R.label_values(table(s, d, "nation").select("n_nationkey", F.concat(F.lit("m"), F.pmod("n_nationkey", F.lit(3)).cast("string")).alias("label")), s.createDataFrame([("m0", 0.5), ("m1", 1.5), ("m2", 2.5)], "label string, value double")),
        "select n_nationkey, 'm' || n_nationkey % 3 as label, 0.5::double + n_nationkey % 3 as value from nation",
    ),
    "bounding_boxes": (
        lambda s, d: R.bounding_boxes(elem_node(s, d), node(s, d), elem_node(s, d).select("elem_id", F.pmod("elem_id", F.lit(6)).alias("part")).distinct()),
        f"with {MESH} select elem_id % 6 as part, min(x) as xmin, max(x) as xmax, min(y) as ymin, max(y) as ymax, count(distinct node_id) as n from elem_node join node using (node_id) group by 1",
    ),
}
