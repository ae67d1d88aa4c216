"""Boundaries of a mesh as strings of nodes, pairs of nodes across structures, and what lies on or outside them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.operators.components import connected_components
from tidewater.operators.mesh import corners
from tidewater.operators.spatial import CELLS, nearest, on_levels, probe
from tidewater.spool import drop_spool, spool


def directed_boundary(elem_node: DataFrame, node: DataFrame) -> DataFrame:
    """``p, q, p2``: boundary edges from p to q with their element on the left, and the node p2 after q on the same boundary.

    Where a boundary touches itself, several of its edges meet in a node. The one that follows is that which bounds the same
    run of elements: the first that a turn clockwise around q meets, from the edge it comes by. Elements given clockwise are
    turned. A boundary edge is followed by exactly one and follows exactly one.
    """
    c = F.col
    ring = corners(elem_node, node).select(F.transform("ring", lambda r: F.struct(r["node_id"].alias("n"), r["x"].alias("x"), r["y"].alias("y"))).alias("r"))
    turned = lambda r: F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    area = F.aggregate(F.zip_with("r", turned(c("r")), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda t, v: t + v)
    ring = ring.withColumn("r", F.when(area < 0, F.reverse("r")).otherwise(c("r")))
    sides = ring.select(F.explode(F.zip_with("r", turned(c("r")), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).alias("e")).select("e.p", "e.q")
    once = sides.groupBy(F.least("p.n", "q.n").alias("a"), F.greatest("p.n", "q.n").alias("b")).agg(F.count("*").alias("n"), F.first("p").alias("p"), F.first("q").alias("q")).where("n = 1")
    once = spool(once.select("p", "q"))
    out = once.select(c("p.n").alias("at"), c("q").alias("to"))
    back = F.atan2(c("p.y") - c("q.y"), c("p.x") - c("q.x"))
    ahead = F.atan2(c("to.y") - c("q.y"), c("to.x") - c("q.x"))
    turn = F.pmod(back - ahead, F.lit(2 * math.pi))
    turn = F.when(turn <= 1e-12, F.lit(2 * math.pi)).otherwise(turn)
    return once.join(out, c("q.n") == c("at")).groupBy(c("p.n").alias("p"), c("q.n").alias("q")).agg(F.min(F.struct(turn.alias("turn"), c("to.n").alias("n"))).alias("f")).select("p", "q", c("f.n").alias("p2"))


def boundary_strings(elem_node: DataFrame, node: DataFrame, segments: DataFrame, cell: float) -> DataFrame:
    """``kind, string_no, seq, node_id`` of all of a mesh's boundary.

    ``segments``: ord, x0, y0, x1, y1. An ``open`` string runs along the boundary, counterclockwise, from the boundary
    node nearest to the first point to that nearest to the second; ``land`` ones from the end of an open one to the start
    of the next; rings without an open string are ``island`` ones, from their smallest node back to it. An open string whose
    ends are on different rings is an error.

    Each boundary edge is in exactly one string, also where the boundary touches itself (``directed_boundary``): walks go over
    edges, and a node there is in several strings. An edge's place is found by pointers to the edge before that are doubled
    until they reach a string's end, in as many rounds as the logarithm of the longest string. Only the ends are then walked
    one by one.
    """
    c = F.col
    # Edges of nodes near each other get ids near each other, so that rings are mostly found within tasks.
    made = spool(directed_boundary(elem_node, node).repartitionByRange("p", "q").withColumn("eid", F.monotonically_increasing_id()))
    follows = made.select(c("p").alias("q"), c("q").alias("p2"), c("eid").alias("nxt"))
    walk = spool(made.join(follows, ["q", "p2"]).select("eid", "p", "q", "nxt"))
    shore = node.join(walk.select(c("p").alias("node_id")), "node_id", "left_semi").select(c("node_id").alias("site_id"), "x", "y")
    ask = lambda x, y, at: segments.select((c("ord") * 2 + at).alias("point_id"), c(x).alias("x"), c(y).alias("y"))
    ends = spool(nearest(ask("x0", "y0", 0).unionByName(ask("x1", "y1", 1)), shore, 1, cell).select("point_id", c("site_id").alias("mark")))
    rings = spool(connected_components(walk.select(c("eid").alias("a"), c("nxt").alias("b"))).withColumnRenamed("node", "eid"))
    # For each open string the edge it begins with, and the ring on which it ends.
    at_ends = ends.join(walk.select(c("p").alias("mark"), c("q").alias("toward"), "eid"), "mark").join(rings, "eid").withColumn("string_no", F.floor(c("point_id") / 2))
    first = at_ends.where("point_id % 2 = 0").select("string_no", "component", c("eid").alias("start"), "toward")
    last = at_ends.where("point_id % 2 = 1").select("string_no", "component", c("mark").alias("stop")).distinct()
    both = first.join(last, ["string_no", "component"]).groupBy("string_no").agg(F.min(F.struct("toward", "start", "stop", "component")).alias("f")).select("string_no", "f.*")
    asked = segments.select(c("ord").cast("long").alias("string_no")).join(both, "string_no", "left")
    missing = F.raise_error(F.concat(F.lit("no boundary from end to end of open string "), c("string_no").cast("string"))).cast("long")
    open_ = spool(asked.select("string_no", F.coalesce("start", missing).alias("start"), "stop", "component"))
    islands = spool(walk.join(rings, "eid").join(open_.select("component").distinct(), "component", "left_anti").groupBy("component").agg(F.min(F.struct("p", "q", "eid")).alias("f")).select("f.*"))
    # Marked edges: those that a string begins with, and all that leave a node at which one stops.
    stops = walk.join(rings, "eid").join(open_.select(c("stop").alias("p"), "component").distinct(), ["p", "component"], "left_semi").select("eid")
    marks = spool(open_.select(c("start").alias("eid")).unionByName(stops).unionByName(islands.select("eid")).distinct())
    # For each edge the mark at or before it, and how many edges it is behind.
    marked = walk.join(marks.withColumn("end", F.lit(True)), "eid", "left").select("eid", c("end").isNotNull().alias("end"))
    at = marked.join(walk.select(c("nxt").alias("eid"), c("eid").alias("prev")), "eid").select("eid", F.when(c("end"), c("eid")).otherwise(c("prev")).alias("up"), F.when(c("end"), 0).otherwise(1).cast("long").alias("steps"), (~c("end")).alias("open"))
    at = spool(at)
    while not at.where("open").isEmpty():
        up = at.select(c("eid").alias("up"), c("up").alias("further"), c("steps").alias("more"), c("open").alias("on"))
        moved = at.where("open").join(up, "up").select("eid", c("further").alias("up"), (c("steps") + c("more")).alias("steps"), c("on").alias("open"))
        nxt = spool(at.where("not open").unionByName(moved))
        drop_spool(at)
        at = nxt
    # Pieces from mark to mark: as many as there are ends and islands.
    begins = marks.join(walk, "eid").select(c("eid").alias("to"), c("p").alias("to_node"))
    pieces = spool(at.join(walk, "eid").join(begins, c("nxt") == c("to")).select(c("up").alias("mark"), "to", "to_node", (c("steps") + 1).alias("length")))
    starts = open_.select(c("start").alias("to")).distinct().withColumn("begins", F.lit(True))
    shores = pieces.join(starts, "to", "left")
    opened = _runs(open_.select("string_no", "start", "stop").withColumn("kind", F.lit("open")), pieces, c("to_node") == c("stop"))
    opened = spool(opened)
    after = opened.where("final").join(starts, "to", "left_anti").select("string_no", c("to").alias("start"))
    landed = _runs(after.withColumn("kind", F.lit("land")), shores, F.coalesce(c("begins"), F.lit(False)))
    loops = islands.select((F.row_number().over(Window.orderBy("p", "q")) - 1).cast("long").alias("string_no"), c("eid").alias("start"))
    looped = _runs(loops.withColumn("kind", F.lit("island")), pieces, F.lit(True))
    run = spool(opened.unionByName(landed).unionByName(looped))
    inside = run.join(at.select(c("up").alias("mark"), "steps", "eid"), "mark").join(walk.select("eid", "p"), "eid").select("kind", "string_no", (c("before") + c("steps")).alias("seq"), c("p").alias("node_id"))
    end = run.where("final").select("kind", "string_no", (c("before") + c("length")).alias("seq"), c("to_node").alias("node_id"))
    return inside.unionByName(end)


def _runs(strings: DataFrame, pieces: DataFrame, over: Column) -> DataFrame:
    """``kind, string_no, mark, to, to_node, before, length, final``: the pieces that each string is made of, found one after the other."""
    now = strings.withColumns({"at": F.col("start"), "before": F.lit(0).cast("long")})
    out = None
    while True:
        step = now.join(pieces, F.col("at") == F.col("mark")).withColumn("final", over)
        own = spool(step.select(*strings.columns, "mark", "to", "to_node", "before", "length", "final"))
        part = own.select("kind", "string_no", "mark", "to", "to_node", "before", "length", "final")
        out = part if out is None else out.unionByName(part)
        now = own.where("not final").select(*strings.columns, F.col("to").alias("at"), (F.col("before") + F.col("length")).alias("before"))
        if now.isEmpty():
            return out


def boundary_forcing(strings: DataFrame, forcing: DataFrame) -> DataFrame:
    """``name, constituent, seq, node_id, amplitude, phase`` of open boundaries (``name, seq, node_id``).

    ``forcing``: name, constituent, amplitude and phase, each an array of one value for all nodes or of one for each in
    the order of ``seq``. A boundary without a forcing, or a forcing without a boundary, is an error, and so is an array
    of another length.
    """
    size = strings.groupBy("name").agg(F.count("*").alias("n"))
    own = size.join(forcing, "name", "full")
    known = F.when(F.col("n").isNull(), F.raise_error(F.concat(F.lit("no boundary of the name "), "name"))).when(F.col("constituent").isNull(), F.raise_error(F.concat(F.lit("no forcing of the boundary "), "name"))).otherwise(F.col("n"))
    for v in ("amplitude", "phase"):
        known = F.when((F.size(v) != 1) & (F.size(v) != F.col("n")), F.raise_error(F.concat(F.lit(f"{v}s do not match the nodes of "), "name"))).otherwise(known)
    own = own.withColumn("n", known.cast("long")).where("n > 0")
    value = lambda v: F.get(v, F.when(F.size(v) == 1, 0).otherwise(F.col("seq")).cast("int"))
    return strings.join(own, "name").select("name", "constituent", "seq", "node_id", value("amplitude").alias("amplitude"), value("phase").alias("phase"))


def structure_pairs(crossings: DataFrame, edges: DataFrame, elem_node: DataFrame) -> DataFrame:
    """``line_id, pair, up, down``: nodes on both sides of each line, paired in order along it.

    ``crossings`` as from ``crossed_edges`` (line_id, seg, rank and the edge's end on the left and right of the line, here
    ``down`` and ``up``). A side's path is its nodes in order of first appearance. Where two that follow each other share no
    edge, a node of an element of both, on neither path, comes between. The longer path's rest has no pair.
    """
    c = F.col
    two = crossings.select("line_id", "seg", "rank", F.explode(F.array(F.struct(F.lit("up").alias("side"), c("up").alias("node_id")), F.struct(F.lit("down").alias("side"), c("down").alias("node_id")))).alias("s"))
    path = two.groupBy("line_id", "s.side", "s.node_id").agg(F.min(F.struct("seg", "rank")).alias("at"))
    along = Window.partitionBy("line_id", "side").orderBy("at", "node_id")
    path = spool(path.withColumns({"pos": F.row_number().over(along), "nxt": F.lead("node_id").over(along)}))
    pair = path.where("nxt is not null").withColumns({"a": F.least("node_id", "nxt"), "b": F.greatest("node_id", "nxt")})
    broken = pair.join(edges.select("a", "b"), ["a", "b"], "left_anti")
    of = lambda name: elem_node.select(c("node_id").alias(name), "elem_id")
    shared = broken.join(of("node_id"), "node_id").join(of("nxt"), ["nxt", "elem_id"]).groupBy("line_id", "side", "pos", "node_id", "nxt").agg(F.min("elem_id").alias("elem_id"))
    others = shared.join(elem_node.select("elem_id", c("pos").alias("corner"), c("node_id").alias("extra")), "elem_id").where("extra <> node_id and extra <> nxt")
    taken = path.select("line_id", c("side").alias("other"), c("node_id").alias("extra"))
    free = others.join(taken, ["line_id", "extra"], "left_anti").groupBy("line_id", "side", "pos").agg(F.min_by("extra", "corner").alias("node_id"))
    full = path.select("line_id", "side", c("pos").cast("double").alias("pos"), "node_id").unionByName(free.select("line_id", "side", (c("pos") + 0.5).alias("pos"), "node_id"))
    full = full.withColumn("pair", F.row_number().over(Window.partitionBy("line_id", "side").orderBy("pos")))
    side = lambda s: full.where(c("side") == s).select("line_id", "pair", c("node_id").alias(s))
    return side("up").join(side("down"), ["line_id", "pair"])


def structure_reference(pairs: DataFrame, nbrs: DataFrame, node: DataFrame) -> DataFrame:
    """``line_id, up, down``: for each side a neighbour of its middle node that is on neither side's path.

    Of several, the one whose direction from there is nearest to a right angle with the side's ends, the smaller id at
    ties; null where there is none.
    """
    c = F.col
    two = pairs.select("line_id", "pair", F.explode(F.array(F.struct(F.lit("up").alias("side"), c("up").alias("n")), F.struct(F.lit("down").alias("side"), c("down").alias("n")))).alias("s")).select("line_id", "pair", "s.side", "s.n")
    path = spool(two)
    ends = path.groupBy("line_id", "side").agg(F.min_by("n", "pair").alias("first"), F.max_by("n", "pair").alias("last"), F.count("*").alias("k"))
    middle = path.join(ends, ["line_id", "side"]).where(c("pair") == F.floor(c("k") / 2) + 1).select("line_id", "side", "n", "first", "last")
    near = middle.join(nbrs.select(c("node_id").alias("n"), c("nbr").alias("m")), "n").join(path.select("line_id", c("n").alias("m")), ["line_id", "m"], "left_anti")
    for key in ("n", "first", "last", "m"):
        near = near.join(node.select(c("node_id").alias(key), c("x").alias(f"x_{key}"), c("y").alias(f"y_{key}")), key)
    tx, ty, vx, vy = c("x_last") - c("x_first"), c("y_last") - c("y_first"), c("x_m") - c("x_n"), c("y_m") - c("y_n")
    lean = F.abs(tx * vx + ty * vy) / (F.sqrt(tx * tx + ty * ty) * F.sqrt(vx * vx + vy * vy))
    best = near.groupBy("line_id", "side").agg(F.min_by("m", F.struct(F.round(lean, 9), "m")).alias("m"))
    pick = lambda s: F.max(F.when(c("side") == s, c("m"))).alias(s)
    return pairs.select("line_id").distinct().join(best, "line_id", "left").groupBy("line_id").agg(pick("up"), pick("down"))


def clip_features(vertices: DataFrame, node: DataFrame, buffer: float) -> DataFrame:
    """``feature_id`` of the lines and polygons that meet the mesh's bounding rectangle, widened by ``buffer``.

    ``vertices``: feature_id, closed (a polygon, whose outline counts), seq, x, y. A segment meets the rectangle if their
    boxes meet and the rectangle's corners are not all on one side of it.
    """
    c = F.col
    box = node.agg((F.min("x") - buffer).alias("x0"), (F.max("x") + buffer).alias("x1"), (F.min("y") - buffer).alias("y0"), (F.max("y") + buffer).alias("y1"))
    by = Window.partitionBy("feature_id").orderBy("seq")
    whole = Window.partitionBy("feature_id")
    first = lambda k: F.min_by(k, "seq").over(whole)
    ends = vertices.withColumns({"px": F.coalesce(F.lead("x").over(by), F.when(c("closed"), first("x"))), "py": F.coalesce(F.lead("y").over(by), F.when(c("closed"), first("y")))}).where("px is not null")
    own = ends.join(F.broadcast(box)).where("least(x, px) <= x1 and greatest(x, px) >= x0 and least(y, py) <= y1 and greatest(y, py) >= y0")
    side = lambda x, y: (c("px") - c("x")) * (c(y) - c("y")) - (c("py") - c("y")) * (c(x) - c("x"))
    corners = [side(x, y) for x in ("x0", "x1") for y in ("y0", "y1")]
    return own.where((F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)).select("feature_id").distinct()


def clip_raster(meta: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """``raster_id, complete, x0, y0, x1, y1`` of the rasters that meet a box, cut to whole pixels.

    ``meta``: raster_id, x0, y0 (upper left corner), dx, dy (below 0), cols, rows. The left and right edges go outwards to
    a pixel's edge, the upper and lower ones inwards; ``complete`` if the raster reaches beyond the box on all sides.
    """
    c = F.col
    own = meta.withColumns({"xe": c("x0") + c("cols") * c("dx"), "ye": c("y0") + c("rows") * c("dy")})
    own = own.where((c("xe") > left) & (c("ye") < top) & (c("x0") < right) & (c("y0") > bottom))
    snap = lambda f, v, o, d: f((v - c(o)) / c(d)) * c(d) + c(o)
    return own.select(
        "raster_id",
        ((c("x0") < left) & (c("y0") > top) & (c("xe") > right) & (c("ye") < bottom)).alias("complete"),
        snap(F.floor, F.greatest(F.lit(left), "x0"), "x0", "dx").alias("x0"),
        snap(F.ceil, F.least(F.lit(top), "y0"), "y0", "dy").alias("y0"),
        snap(F.ceil, F.least(F.lit(right), "xe"), "x0", "dx").alias("x1"),
        snap(F.floor, F.greatest(F.lit(bottom), "ye"), "y0", "dy").alias("y1"),
    )


def barycentric_map(points: DataFrame, grid: DataFrame, cell: float, slack: float = 0.01) -> DataFrame:
    """``point_id, i, j, tri, w0, w1, w2``: the cell of another model's grid around each point, and weights of its corners.

    ``grid``: i, j, x, y. A cell's corners are (i, j), (i+1, j), (i+1, j+1), (i, j+1); a point is in it if the triangles it
    makes with the sides are as large in all as the cell, but for ``slack``; of several the first by i and j. Weights are for the
    corners 1, 2, 3 (``tri`` 1) or 1, 3, 4 (``tri`` 2) by areas of triangles.
    """
    c = F.col
    at = lambda k, di, dj: grid.select((c("i") - di).alias("i"), (c("j") - dj).alias("j"), c("x").alias(f"x{k}"), c("y").alias(f"y{k}"))
    cells = at(1, 0, 0).join(at(2, 1, 0), ["i", "j"]).join(at(3, 1, 1), ["i", "j"]).join(at(4, 0, 1), ["i", "j"])
    xs, ys = [c(f"x{k}") for k in range(1, 5)], [c(f"y{k}") for k in range(1, 5)]
    over = slack * F.greatest(F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys))
    boxed = on_levels(cells.withColumns({"xmin": F.least(*xs) - over, "xmax": F.greatest(*xs) + over, "ymin": F.least(*ys) - over, "ymax": F.greatest(*ys) + over}), cell)
    own = probe(points.select("point_id", "x", "y"), boxed, cell)

    def area(*k: int) -> Column:
        (xa, ya), (xb, yb), (xc, yc) = ((c("x"), c("y")) if i == 0 else (c(f"x{i}"), c(f"y{i}")) for i in k)
        return F.abs((xa - xc) * (yb - yc) - (xb - xc) * (ya - yc)) / 2

    near = own.join(boxed, CELLS).withColumns({f"a{k}": area(0, k, k % 4 + 1) for k in range(1, 5)}).withColumns({"b1": area(1, 2, 3), "b2": area(1, 3, 4), "ap": area(0, 1, 3)})
    ratio = F.abs(c("a1") + c("a2") + c("a3") + c("a4") - c("b1") - c("b2")) / (c("b1") + c("b2"))
    hit = near.where(ratio < slack).groupBy("point_id").agg(F.min(F.struct("i", "j", "a1", "a2", "a3", "a4", "ap", "b1", "b2")).alias("h")).select("point_id", "h.*")
    first = F.abs(c("a1") + c("a2") + c("ap") - c("b1")) / c("b1") < 5 * slack
    held = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))
    w0 = held(F.when(first, c("a2") / c("b1")).otherwise(c("a3") / c("b2")))
    w1 = held(F.when(first, c("ap") / c("b1")).otherwise(c("a4") / c("b2")))
    return hit.select("point_id", "i", "j", F.when(first, 1).otherwise(2).alias("tri"), w0.alias("w0"), w1.alias("w1"), held(1 - w0 - w1).alias("w2"))
