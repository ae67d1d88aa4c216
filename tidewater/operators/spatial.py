"""Joins of points with polygons, elements, lines and rasters, by equal grid cells.

Cells are of several sizes, ``cell`` wide and that doubled again and again. A shape stands on the level at which its bounding
box touches four cells at most, however large it is; points, and lines along their way, look at each level on which a shape
stands. Both are joined on level and cell before the exact test.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.spool import spool

#: Pixels along a side of a raster's tile.
TILE = 64


def cell_of(v: Column, cell: float) -> Column:
    return F.floor(v / cell).cast("long")


def on_levels(shapes: DataFrame, cell: float) -> DataFrame:
    """``shapes`` (with ``xmin, xmax, ymin, ymax``) with their level ``_cl`` and a row for each cell ``_cx, _cy`` of it that the box touches, four at most."""
    wide = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) / cell
    own = shapes.withColumn("_cl", F.when(wide > 1, F.ceil(F.log2(wide))).otherwise(F.lit(0)).cast("int"))
    at = lambda v: F.floor(F.col(v) / (cell * F.pow(F.lit(2.0), "_cl"))).cast("long")
    return own.withColumn("_cx", F.explode(F.sequence(at("xmin"), at("xmax")))).withColumn("_cy", F.explode(F.sequence(at("ymin"), at("ymax"))))


def _levels(shapes: DataFrame) -> DataFrame:
    """The levels that shapes stand on, as one row; there are at most as many as a double has powers of two."""
    return shapes.agg(F.collect_set("_cl").alias("_ls"))


def _seen(df: DataFrame, levels: DataFrame) -> DataFrame:
    """A row for each level, with ``_w``, its cells' width over the smallest one's."""
    own = df.join(F.broadcast(levels)).withColumn("_cl", F.explode("_ls")).drop("_ls")
    return own.withColumn("_w", F.pow(F.lit(2.0), "_cl"))


def probe(points: DataFrame, shapes: DataFrame, cell: float) -> DataFrame:
    """``points`` (``x, y`` and more) with their cell on each level of ``shapes``."""
    at = lambda v: F.floor(F.col(v) / (cell * F.col("_w"))).cast("long")
    return _seen(points, _levels(shapes)).withColumns({"_cx": at("x"), "_cy": at("y")}).drop("_w")


def probe_lines(lines: DataFrame, shapes: DataFrame, cell: float) -> DataFrame:
    """``lines`` (``x0, y0, x1, y1`` and more) with the cells they pass on each level of ``shapes``: as many as they are long."""
    c, w = F.col, cell * F.col("_w")
    low, high = F.least("x0", "x1"), F.greatest("x0", "x1")
    own = _seen(lines, _levels(shapes)).withColumn("_cx", F.explode(F.sequence(F.floor(low / w), F.floor(high / w))))
    slope = F.coalesce(F.try_divide(c("y1") - c("y0"), c("x1") - c("x0")), F.lit(0.0))
    y_at = lambda x: F.when(c("x1") == c("x0"), None).otherwise(c("y0") + slope * (x - c("x0")))
    ends = [y_at(F.greatest(low, c("_cx") * w)), y_at(F.least(high, (c("_cx") + 1) * w))]
    slack = 1e-9 * (F.abs("y0") + F.abs("y1") + w)
    least, most = (F.coalesce(f(*ends), f("y0", "y1")) for f in (F.least, F.greatest))
    cells = F.sequence(F.floor((least - slack) / w).cast("long"), F.floor((most + slack) / w).cast("long"))
    return own.withColumns({"_cx": c("_cx").cast("long"), "_cy": F.explode(cells)}).drop("_w")


CELLS = ["_cl", "_cx", "_cy"]


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is within a polygon, by counting crossings (``ring``: array of x, y without the first repeated)."""
    n = F.size(ring)
    turned = F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1))

    def crosses(a: Column, b: Column) -> Column:
        at = a["x"] + (y - a["y"]) * F.try_divide(b["x"] - a["x"], b["y"] - a["y"])
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(F.zip_with(ring, turned, crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


def with_box(polygons: DataFrame) -> DataFrame:
    side = lambda f, k: f(F.transform("ring", lambda p: p[k]))
    return polygons.withColumns({"xmin": side(F.array_min, "x"), "xmax": side(F.array_max, "x"), "ymin": side(F.array_min, "y"), "ymax": side(F.array_max, "y")})


def points_in_box(points: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    return points.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))


def points_in_polygon(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Each point (``x, y`` and more) with each polygon (``poly_id, ring`` and more) around it; edges don't count."""
    shapes = on_levels(with_box(polygons), cell)
    near = probe(points, shapes, cell).join(shapes, CELLS).where("x >= xmin and x <= xmax and y >= ymin and y <= ymax")
    return near.where(inside_ring(F.col("x"), F.col("y"), F.col("ring"))).drop(*CELLS, "ring", "xmin", "xmax", "ymin", "ymax")


_WORDS = re.compile(r"\s*(?:([A-Za-z_]+)|([0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+)|([-+*/(),]))")
_NAMES = {"x": "x", "y": "y", "z": "z", "min": "least", "max": "greatest", "abs": "abs", "sqrt": "sqrt", "exp": "exp"}


def formula(text: str) -> Column:
    """A number or a formula in x, y and z as a Column; only these, numbers, arithmetic and a few functions are let in."""
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _WORDS.match(text, at)
        if not m or m[1] and m[1] not in _NAMES:
            raise ValueError(f"not a formula in x, y, z: {text!r}")
        out.append(_NAMES[m[1]] if m[1] else f"{m[2]}D" if m[2] else m[3])
        at = m.end()
    return F.expr(" ".join(out)).cast("double")


def apply_polygons(nodes: DataFrame, polygons: list[dict], cell: float, default: float | None = None) -> DataFrame:
    """``node_id, value``: polygons in order over ``default`` or the depth: none assigns, min raises, max lowers.

    Polygons are dictionaries (name, type, attribute, vertices), a list written by hand; each attribute is a formula.
    """
    spark = nodes.sparkSession
    shapes = spark.createDataFrame(
        [(i, i, p.get("type", "none"), [(float(x), float(y)) for x, y in p["vertices"]]) for i, p in enumerate(polygons)],
        "poly_id int, ord int, ptype string, ring array<struct<x:double,y:double>>",
    )
    hit = points_in_polygon(nodes.withColumn("z", F.col("depth")), shapes, cell)
    value = F.coalesce(*[F.when(F.col("ord") == i, formula(str(p["attribute"]))) for i, p in enumerate(polygons)])
    steps = hit.select("node_id", "ord", "ptype", value.alias("v")).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("ord", "ptype", "v"))).alias("steps"))
    base = F.col("depth") if default is None else F.lit(float(default))

    def step(a: Column, p: Column) -> Column:
        return F.when(p["ptype"] == "min", F.greatest(a, p["v"])).when(p["ptype"] == "max", F.least(a, p["v"])).otherwise(p["v"])

    return nodes.join(steps, "node_id", "left").select("node_id", F.when(F.col("steps").isNull(), base).otherwise(F.aggregate("steps", base, step)).alias("value"))


def region_constraints(hits: DataFrame) -> DataFrame:
    """``node_id, nmin, nmax`` from (node_id, ptype, layers): most layers + 1 over min polygons (2 at least), least over max."""
    return hits.groupBy("node_id").agg(
        F.greatest(F.coalesce(F.max(F.when(F.col("ptype") == "min", F.col("layers") + 1)), F.lit(2)), F.lit(2)).alias("nmin"),
        F.min(F.when(F.col("ptype") == "max", F.col("layers"))).alias("nmax"),
    )


def partition_check(cells: DataFrame, regions: DataFrame, cell: float) -> DataFrame:
    """``cell_id, n, region``: how many regions each cell is in, and the last of them in order; null for orphans."""
    hit = points_in_polygon(cells, regions, cell).groupBy("cell_id").agg(F.count("*").alias("n"), F.max_by("poly_id", "ord").alias("region"))
    return cells.join(hit, "cell_id", "left").select("cell_id", F.coalesce("n", F.lit(0)).alias("n"), "region")


def element_boxes(elem_node: DataFrame, node: DataFrame) -> DataFrame:
    full = elem_node.join(node, "node_id")
    ring = F.array_sort(F.collect_list(F.struct("pos", "x", "y")))
    return full.groupBy("elem_id").agg(ring.alias("ring"), F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))


def find_elem(points: DataFrame, elem_node: DataFrame, node: DataFrame, cell: float) -> DataFrame:
    """``point_id, elem_id``: the element with the point in one of its fan triangles, edges included; lowest id at ties."""
    shapes = spool(on_levels(element_boxes(elem_node, node), cell))
    near = probe(points, shapes, cell).join(shapes, CELLS).where("x >= xmin and x <= xmax and y >= ymin and y <= ymax")

    def within(a: Column, b: Column, c: Column) -> Column:
        det = (b["x"] - a["x"]) * (c["y"] - a["y"]) - (c["x"] - a["x"]) * (b["y"] - a["y"])
        u = F.try_divide((F.col("x") - a["x"]) * (c["y"] - a["y"]) - (c["x"] - a["x"]) * (F.col("y") - a["y"]), det)
        v = F.try_divide((b["x"] - a["x"]) * (F.col("y") - a["y"]) - (F.col("x") - a["x"]) * (b["y"] - a["y"]), det)
        return (u >= 0) & (v >= 0) & (u + v <= 1)

    r = F.col("ring")
    hit = within(r[0], r[1], r[2]) | F.when(F.size(r) == 4, within(r[0], r[2], F.get(r, F.lit(3)))).otherwise(F.lit(False))
    return near.where(hit).groupBy("point_id").agg(F.min("elem_id").alias("elem_id"))


#: Sites in the densest of the smallest cells, for each one that is looked for; levels of cells below the width given.
CROWD, DEEPEST = 4, 40


def _levels_down(places: DataFrame, k: int, cell: float, reach: float) -> int:
    """How often ``cell`` is halved until no cell holds more than ``CROWD * k`` places, or doubles (up to ``reach``) tell no smaller ones apart."""
    down = 0
    while True:
        at = [cell_of(F.col(v), cell / 2**down) for v in ("sx", "sy")]
        most = places.groupBy(at[0].alias("x"), at[1].alias("y")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if most <= CROWD * k or down >= DEEPEST or reach / cell * 2 ** (down + 1) > 2**50:
            return down
        down += max(1, math.ceil(math.log2(most / (CROWD * k)) / 2))


def nearest(points: DataFrame, sites: DataFrame, k: int, cell: float) -> DataFrame:
    """``point_id, site_id, d2, rank``: the ``k`` nearest sites of each point, the smaller id first at ties.

    Places are looked at, not points and sites: points at one place have the same nearest sites, and of sites at one place
    only the ``k`` smallest ids count. Cells are ``cell`` wide, or that halved where sites are dense and doubled where they
    are sparse; a place looks at the nine cells around it on the first level where they hold ``k`` sites, told by the counts of
    sites in cells. Where the farthest of the ``k`` it finds is farther than a cell is wide, a nearer one may be outside; it is
    within three cells' width then, so a second look one or two levels up settles those places.
    """
    c = F.col
    nth = F.row_number().over(Window.partitionBy("sx", "sy").orderBy("site_id"))
    places = sites.select("site_id", c("x").alias("sx"), c("y").alias("sy")).where("sx is not null and sy is not null")
    places = spool(places.withColumn("_n", nth).where(c("_n") <= k).drop("_n"))
    ends = places.agg(F.min("sx"), F.max("sx"), F.min("sy"), F.max("sy"), F.count("*")).first()
    if not ends[4]:
        return points.select("point_id", F.lit(None).cast("long").alias("site_id"), F.lit(0.0).alias("d2"), F.lit(0).alias("rank")).limit(0)
    k = min(k, ends[4])
    own = spool(points.where("x is not null and y is not null").select("x", "y").distinct())
    far = own.agg(*[F.max(F.abs(c(v) - e)) for v, e in (("x", ends[0]), ("x", ends[1]), ("y", ends[2]), ("y", ends[3]))]).first()
    apart = max(v or 0.0 for v in far)
    down = _levels_down(places, k, cell, apart + max(abs(e) for e in ends[:4]))
    top = down + max(0, math.ceil(math.log2(max(1.0, apart / cell))))
    cell = cell / 2**down
    around = lambda v: F.explode(F.sequence(c(v) - 1, c(v) + 1))
    up = lambda x, y: {"_cx": F.expr(f"shiftright({x}, _cl)"), "_cy": F.expr(f"shiftright({y}, _cl)")}
    # Sites in each cell of each level, cells with enough of them around, and for each place's cell the first such level.
    level = F.explode(F.sequence(F.lit(0), F.lit(top)))
    held = places.groupBy(cell_of(c("sx"), cell).alias("x"), cell_of(c("sy"), cell).alias("y")).agg(F.count("*").alias("n"))
    held = held.withColumn("_cl", level).withColumns(up("x", "y")).groupBy(*CELLS).agg(F.sum("n").alias("n"))
    enough = held.withColumn("_cx", around("_cx")).withColumn("_cy", around("_cy")).groupBy(*CELLS).agg(F.sum("n").alias("n")).where(c("n") >= k).select(*CELLS)
    own = own.withColumns({"px": cell_of(c("x"), cell), "py": cell_of(c("y"), cell)})
    asked = own.select("px", "py").distinct().withColumn("_cl", level).withColumns(up("px", "py"))
    begin = asked.join(enough, CELLS).groupBy("px", "py").agg(F.min("_cl").alias("_cl"))
    begin = own.join(begin, ["px", "py"])

    def looked(left: DataFrame) -> DataFrame:
        """The best of the nine cells around each place on its level ``_cl``."""
        cells = left.withColumns(up("px", "py")).withColumn("_cx", around("_cx")).withColumn("_cy", around("_cy"))
        there = places.join(F.broadcast(_levels(left))).withColumn("_cl", F.explode("_ls")).drop("_ls")
        there = there.withColumns({"_x": cell_of(c("sx"), cell), "_y": cell_of(c("sy"), cell)}).withColumns(up("_x", "_y")).drop("_x", "_y")
        near = cells.join(there, CELLS).withColumn("d2", (c("x") - c("sx")) ** 2 + (c("y") - c("sy")) ** 2)
        rank = F.row_number().over(Window.partitionBy("x", "y").orderBy("d2", "site_id"))
        return near.withColumn("rank", rank).where(c("rank") <= k).select("x", "y", "site_id", "d2", "rank", "px", "py", "_cl")

    first = spool(looked(spool(begin)))
    ratio = F.sqrt("d2") / (cell * F.pow(F.lit(2.0), "_cl"))
    again = spool(first.where((c("rank") == k) & (ratio > 1)).select("x", "y", "px", "py", (c("_cl") + F.when(ratio < 2, 1).otherwise(2)).alias("_cl")))
    told = ["x", "y", "site_id", "d2", "rank"]
    best = spool(first.join(again.select("x", "y"), ["x", "y"], "left_anti").select(*told).unionByName(looked(again).select(*told)))
    return points.select("point_id", "x", "y").join(best, ["x", "y"]).select("point_id", "site_id", "d2", "rank")


def snap_points(points: DataFrame, elem_node: DataFrame, node: DataFrame, cell: float) -> DataFrame:
    """``point_id, elem_id, snapped``: the element around each point, or the one with the nearest mean of corners."""
    found = find_elem(points, elem_node, node, cell)
    centre = elem_node.join(node, "node_id").groupBy("elem_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    rest = points.join(found, "point_id", "left_anti")
    near = nearest(rest, centre.withColumnRenamed("elem_id", "site_id"), 1, cell).select("point_id", F.col("site_id").alias("elem_id"), F.lit(True).alias("snapped"))
    return found.withColumn("snapped", F.lit(False)).unionByName(near)


def idw(points: DataFrame, sites: DataFrame, cell: float, k: int = 10, use: int = 6) -> DataFrame:
    """``point_id, value``: of the ``k`` nearest sites the first ``use`` with a value, weighted by 1 / d2; d = 0 gives it."""
    near = nearest(points, sites, k, cell).join(sites.select("site_id", "value"), "site_id").where("value is not null")
    nth = F.row_number().over(Window.partitionBy("point_id").orderBy("rank"))
    w = F.try_divide(F.lit(1.0), F.when(F.col("d2") > 0, F.col("d2")))
    kept = near.withColumn("_n", nth).where(F.col("_n") <= use).withColumn("_w", w)
    same = F.avg(F.when(F.col("d2") == 0, F.col("value")))
    return kept.groupBy("point_id").agg(F.coalesce(same, F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value"))


def line_elements(lines: DataFrame, elem_node: DataFrame, node: DataFrame, cell: float) -> DataFrame:
    """``line_id, seg, elem_id``: elements with corners on both sides of the line through a segment, boxes meeting.

    ``lines``: line_id, seg, x0, y0, x1, y1. Such an element's box has a point of the segment in it, so only elements in the
    cells that a segment passes are looked at.
    """
    elems = spool(on_levels(element_boxes(elem_node, node), cell))
    near = probe_lines(lines, elems, cell).join(elems, CELLS).where("xmin <= greatest(x0, x1) and xmax >= least(x0, x1) and ymin <= greatest(y0, y1) and ymax >= least(y0, y1)")
    side = F.transform("ring", lambda p: F.signum((F.col("x1") - F.col("x0")) * (p["y"] - F.col("y0")) - (F.col("y1") - F.col("y0")) * (p["x"] - F.col("x0"))))
    return near.where((F.array_min(side) < 0) & (F.array_max(side) > 0)).select("line_id", "seg", "elem_id").distinct()


def line_local(hits: DataFrame, elem_node: DataFrame, node: DataFrame) -> DataFrame:
    """Nodes of crossed elements with min, max, mean and median of all nodes that share a crossed element with them.

    Of several segments over a node the last (by line, then segment) counts.
    """
    own = hits.join(elem_node.select("elem_id", "node_id"), "elem_id")
    near = own.join(elem_node.select("elem_id", F.col("node_id").alias("support")), "elem_id").select("line_id", "seg", "node_id", "support").distinct()
    depth = near.join(node.select(F.col("node_id").alias("support"), "depth"), "support")
    stats = depth.groupBy("line_id", "seg", "node_id").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.avg("depth").alias("mean"), F.median("depth").alias("mid"))
    return stats.groupBy("node_id").agg(F.max_by(F.struct("lo", "hi", "mean", "mid"), F.struct("line_id", "seg")).alias("s")).select("node_id", "s.*")


def raster_tiles(rasters: DataFrame, size: int = TILE) -> DataFrame:
    """``raster_id, tr, tc, vals``: rasters (raster_id, row, col, val) as tiles, ``vals`` an array of rows of an array of values.

    A tile has ``size`` rows and columns and one more of each from the next ones, so that all four pixels around a place are
    in one tile. Pixels that are missing are null. Each pixel comes once.
    """
    c = F.col
    two = lambda k: F.explode(F.array_compact(F.array(F.floor(c(k) / size), F.when((F.pmod(c(k), F.lit(size)) == 0) & (c(k) > 0), F.floor(c(k) / size) - 1))))
    dense = lambda found: F.transform(F.sequence(F.lit(0), F.lit(size)), lambda i: F.try_element_at(found, i))
    listed = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key.cast("int").alias("k"), value.alias("v"))))
    cut = rasters.where("val is not null").withColumn("tc", two("col"))
    rows = cut.groupBy("raster_id", "row", "tc").agg(listed(c("col") - c("tc") * size, c("val").cast("double")).alias("m")).select("raster_id", "row", "tc", dense(c("m")).alias("v"))
    return rows.withColumn("tr", two("row")).groupBy("raster_id", "tr", "tc").agg(listed(c("row") - c("tr") * size, c("v")).alias("m")).select("raster_id", "tr", "tc", dense(c("m")).alias("vals"))


def dem_sample(points: DataFrame, tiles: DataFrame, meta: DataFrame, cell: float, size: int = TILE) -> DataFrame:
    """``point_id, value``: bilinear from the four cell centres of the first raster (by ``prio``) that has all four.

    ``tiles`` as of ``raster_tiles``; ``meta``: raster_id, prio, x0, y0, dx, dy, rows, cols, a row for each raster. Points meet
    the rasters whose box is around them, then the one tile of each that has the four pixels.
    """
    c = F.col
    edge = lambda o, d, k: c(o) + k * c(d)
    half = F.lit(0.5)
    sides = {v: [edge(f"{v}0", f"d{v}", half), edge(f"{v}0", f"d{v}", c(n) - 0.5)] for v, n in (("x", "cols"), ("y", "rows"))}
    boxes = on_levels(meta.withColumns({f"{v}{m}": f(*sides[v]) for v in "xy" for m, f in (("min", F.least), ("max", F.greatest))}), cell)
    at = probe(points, boxes, cell).join(boxes, CELLS).where("x >= xmin and x <= xmax and y >= ymin and y <= ymax")
    fx, fy = (c("x") - c("x0")) / c("dx") - 0.5, (c("y") - c("y0")) / c("dy") - 0.5
    at = at.select("point_id", "raster_id", "prio", F.floor(fx).alias("c"), F.floor(fy).alias("r"), (fx - F.floor(fx)).alias("u"), (fy - F.floor(fy)).alias("v"))
    at = at.withColumns({"tr": F.floor(c("r") / size), "tc": F.floor(c("c") / size)})
    pixel = lambda j, i: F.get(F.get("vals", (F.pmod(c("r"), F.lit(size)) + j).cast("int")), (F.pmod(c("c"), F.lit(size)) + i).cast("int"))
    value = sum(((c("u") if i else 1 - c("u")) * (c("v") if j else 1 - c("v")) * pixel(j, i) for j in (0, 1) for i in (0, 1)), F.lit(0.0))
    got = at.join(tiles, ["raster_id", "tr", "tc"]).select("point_id", "prio", value.alias("value")).where("value is not null")
    return got.groupBy("point_id").agg(F.min_by("value", "prio").alias("value"))


def raster_stencil(points: DataFrame, raster: DataFrame, x0: float, y0: float, dx: float, dy: float, reach: int) -> DataFrame:
    """``point_id, di, dj, val``: the pixel around each point and those up to ``reach`` away; outside is 0."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    own = points.select("point_id", F.floor((F.col("y") - y0) / dy).alias("r"), F.floor((F.col("x") - x0) / dx).alias("c"), F.explode(span).alias("di")).withColumn("dj", F.explode(span))
    own = own.withColumn("row", F.col("r") + F.col("di")).withColumn("col", F.col("c") + F.col("dj"))
    return own.join(raster, ["row", "col"], "left").select("point_id", "di", "dj", F.coalesce("val", F.lit(0)).alias("val"))


def like_class_mean(kinds: DataFrame, bins: DataFrame, lookup: DataFrame, depth: DataFrame, deepest: float) -> DataFrame:
    """``point_id, density``: mean of the looked-up density over stencil pixels of the centre's kind and bin.

    Kind 0 and points deeper than ``deepest`` give 0. ``lookup`` (kind, bin, density) is a table of classes.
    """
    both = kinds.withColumnRenamed("val", "kind").join(bins.withColumnRenamed("val", "bin"), ["point_id", "di", "dj"]).join(lookup, ["kind", "bin"], "left")
    centre = both.where("di = 0 and dj = 0").select("point_id", F.col("kind").alias("k0"), F.col("bin").alias("b0"))
    same = both.join(centre, "point_id").where("kind = k0 and bin = b0").groupBy("point_id", "k0").agg(F.avg("density").alias("m"))
    full = same.join(depth.select("point_id", F.col("z")), "point_id")
    return full.select("point_id", F.when((F.col("k0") == 0) | (F.col("z") > deepest), 0.0).otherwise(F.coalesce("m", F.lit(0.0))).alias("density"))


def zonal_to_nodes(pixels: DataFrame, elem_node: DataFrame, node: DataFrame, area: DataFrame, cell: float) -> DataFrame:
    """``node_id, value``: pixels (``point_id, x, y, val``) averaged by the element around them, then by area at nodes."""
    own = find_elem(pixels, elem_node, node, cell).join(pixels.select("point_id", "val"), "point_id").where("val is not null")
    mean = own.groupBy("elem_id").agg(F.avg("val").alias("m")).join(area.select("elem_id", "area"), "elem_id")
    return elem_node.select("elem_id", "node_id").join(mean, "elem_id").groupBy("node_id").agg((F.sum(F.col("area") * F.col("m")) / F.sum("area")).alias("value"))


def overlap_blend(fields: DataFrame, keys: list[str]) -> DataFrame:
    """``value, weight`` by key from regions' values and weights: sum(w v) / sum(w), sum(w w) / sum(w); null becomes -9999."""
    w = F.when(F.col("value").isNotNull(), F.col("weight"))
    total = F.when(F.sum(w) > 0, F.sum(w))
    return fields.groupBy(*keys).agg(F.coalesce(F.sum(w * F.col("value")) / total, F.lit(-9999.0)).alias("value"), F.coalesce(F.sum(w * w) / total, F.lit(0.0)).alias("weight"))


def gaussian_weights(nodes: DataFrame, sites: DataFrame, scale: float, time_scale: float, cell: float) -> DataFrame:
    """``node_id, weight``: exp(-r^2 / 2 L^2) of all sites in sum, at most 1, by the time scale; tiny parts are 0.

    Below a thousandth of its highest (at the site itself) a site's part is 0, so only sites within sqrt(2 ln 1000) L
    are joined.
    """
    reach = scale * 3.7169  # sqrt(2 ln 1000)
    boxes = on_levels(sites.select("site_id", F.col("x").alias("sx"), F.col("y").alias("sy"), (F.col("x") - reach).alias("xmin"), (F.col("x") + reach).alias("xmax"), (F.col("y") - reach).alias("ymin"), (F.col("y") + reach).alias("ymax")), cell)
    r2 = (F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2
    part = probe(nodes, boxes, cell).join(boxes, CELLS).select("node_id", F.exp(-r2 / (2 * scale * scale)).alias("e")).where("e >= 0.001")
    total = part.groupBy("node_id").agg(F.least(F.sum("e"), F.lit(1.0)).alias("s"))
    return nodes.select("node_id").join(total, "node_id", "left").select("node_id", (F.coalesce("s", F.lit(0.0)) / time_scale).alias("weight"))
