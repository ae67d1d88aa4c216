"""Work on mesh geometry: line crossings, quadrature against a terrain, quad splits, flooding, level counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewater.operators import mesh as M
from tidewater.operators.blocks import BLOCK, blocks
from tidewater.operators.components import connected_components
from tidewater.operators.graph import RINGS, in_blocks, laplace_rounds
from tidewater.spool import drop_spool, spool

#: Quads below the first area take 3 x 3 points, below the second 4 x 4, larger ones 5 x 5.
QUAD_AREAS = (60.0, 200.0)


def crossed_edges(lines: DataFrame, hits: DataFrame, edges: DataFrame, node: DataFrame) -> DataFrame:
    """``line_id, seg, rank, a, b, up, down, at``: element edges that each segment crosses, in order from its start.

    ``hits`` are the crossed elements (``line_id, seg, elem_id``). ``up`` is the end left of the line, ``at`` the share
    of the segment before the crossing. Edges that only touch the line are no crossings.
    """
    two = edges.select("a", "b", F.col("el").alias("elem_id")).unionByName(edges.where("er >= 0").select("a", "b", F.col("er").alias("elem_id")))
    own = hits.join(two, "elem_id").select("line_id", "seg", "a", "b").distinct().join(lines, ["line_id", "seg"])
    for end in ("a", "b"):
        own = own.join(node.select(F.col("node_id").alias(end), F.col("x").alias(f"x{end}"), F.col("y").alias(f"y{end}")), end)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    side = lambda e: dx * (F.col(f"y{e}") - F.col("y0")) - dy * (F.col(f"x{e}") - F.col("x0"))
    own = own.withColumns({"sa": side("a"), "sb": side("b")}).where("sa * sb < 0")
    u = F.col("sa") / (F.col("sa") - F.col("sb"))
    px, py = F.col("xa") + u * (F.col("xb") - F.col("xa")), F.col("ya") + u * (F.col("yb") - F.col("ya"))
    own = own.withColumn("at", ((px - F.col("x0")) * dx + (py - F.col("y0")) * dy) / (dx * dx + dy * dy)).where("at between 0 and 1")
    nth = F.row_number().over(Window.partitionBy("line_id", "seg").orderBy(F.round("at", 9), "a", "b"))
    left = F.col("sa") > 0
    return own.select("line_id", "seg", nth.alias("rank"), "a", "b", F.when(left, F.col("a")).otherwise(F.col("b")).alias("up"), F.when(left, F.col("b")).otherwise(F.col("a")).alias("down"), "at")


def quadrature_rules() -> dict[str, list[tuple[float, list[float], list[float], list[float]]]]:
    """By rule: points as (weight, shape functions at the corners, their derivatives along both local axes).

    ``tri``: six points, exact to degree 4; ``quad3`` to ``quad5``: products of Gauss-Legendre points.
    """
    tri = []
    for a, w in ((0.445948490915965, 0.223381589678011), (0.091576213509771, 0.109951743655322)):
        for k in range(3):
            tri.append((w, [1 - 2 * a if i == k else a for i in range(3)], [-1.0, 1.0, 0.0], [-1.0, 0.0, 1.0]))
    rules = {"tri": tri}
    sx, sy = (-1, 1, 1, -1), (-1, -1, 1, 1)
    for n in (3, 4, 5):
        at, weight = (v.tolist() for v in np.polynomial.legendre.leggauss(n))
        rules[f"quad{n}"] = [
            (wa * wb, [(1 + p * a) * (1 + q * b) / 4 for p, q in zip(sx, sy)], [p * (1 + q * b) / 4 for p, q in zip(sx, sy)], [q * (1 + p * a) / 4 for p, q in zip(sx, sy)])
            for a, wa in zip(at, weight)
            for b, wb in zip(at, weight)
        ]
    return rules


def quadrature_points(spark: SparkSession, elem_node: DataFrame, node: DataFrame) -> DataFrame:
    """``elem_id, q, x, y, z, w, shape``: each element's quadrature points; the weights sum to its area.

    ``z`` is the depth between the corners, ``shape`` has (node_id, n): the corners' shares in the point.
    """
    rows = [(name, [(q, *p) for q, p in enumerate(points)]) for name, points in quadrature_rules().items()]
    rules = spark.createDataFrame(rows, "rule string, points array<struct<q:int,w:double,n:array<double>,da:array<double>,db:array<double>>>")
    area = M.elem_geometry(elem_node, node).select("elem_id", "area")
    own = M.corners(elem_node, node).join(area, "elem_id")
    small, middle = QUAD_AREAS
    rule = F.when(F.size("ring") == 3, "tri").when(F.col("area") < small, "quad3").when(F.col("area") < middle, "quad4").otherwise("quad5")
    own = own.withColumn("rule", rule).join(F.broadcast(rules), "rule")
    mix = lambda share, key: F.aggregate(F.zip_with(share, F.col("ring"), lambda s, c: s * c[key]), F.lit(0.0), lambda t, v: t + v)
    stretch = lambda p: F.abs(mix(p["da"], "x") * mix(p["db"], "y") - mix(p["da"], "y") * mix(p["db"], "x"))
    made = F.transform("points", lambda p: F.struct(p["q"].alias("q"), mix(p["n"], "x").alias("x"), mix(p["n"], "y").alias("y"), mix(p["n"], "depth").alias("z"), (p["w"] * stretch(p)).alias("w"), F.zip_with(F.col("ring"), p["n"], lambda c, n: F.struct(c["node_id"].alias("node_id"), n.alias("n"))).alias("shape")))
    own = own.withColumn("made", made).withColumn("whole", F.aggregate("made", F.lit(0.0), lambda t, p: t + p["w"]))
    return own.select("elem_id", "area", "whole", F.explode("made").alias("p")).select("elem_id", "p.q", "p.x", "p.y", "p.z", (F.col("p.w") * F.try_divide("area", "whole")).alias("w"), "p.shape")


def dem_misfit(points: DataFrame) -> DataFrame:
    """By element: ``misfit`` (mean of squared differences to ``dem``), ``residual`` (mean difference), ``energy``.

    ``points``: quadrature points with the terrain's ``dem`` at each.
    """
    d = F.col("z") - F.col("dem")
    own = points.groupBy("elem_id").agg(F.sum("w").alias("area"), F.sum(F.col("w") * d * d).alias("s2"), F.sum(F.col("w") * d).alias("s1"))
    residual = F.col("s1") / F.col("area")
    return own.select("elem_id", (F.col("s2") / F.col("area")).alias("misfit"), residual.alias("residual"), (F.col("area") * residual * residual / 2).alias("energy"))


def misfit_gradient(points: DataFrame, misfit: DataFrame) -> DataFrame:
    """``node_id, gradient``: residuals of a node's elements times the integral of its shape function over them."""
    share = points.select("elem_id", "w", F.explode("shape").alias("s")).groupBy("elem_id", F.col("s.node_id").alias("node_id")).agg(F.sum(F.col("w") * F.col("s.n")).alias("share"))
    return share.join(misfit.select("elem_id", "residual"), "elem_id").groupBy("node_id").agg(F.sum(F.col("residual") * F.col("share")).alias("gradient"))


def elem_volume_dem(points: DataFrame, surface: float) -> DataFrame:
    """``elem_id, volume`` of water between ``surface`` and the terrain's height ``dem``; dry points count 0."""
    return points.groupBy("elem_id").agg(F.sum(F.col("w") * F.greatest(surface - F.col("dem"), F.lit(0.0))).alias("volume"))


def split_quads(elem_node: DataFrame, node: DataFrame, most: float) -> DataFrame:
    """``elem_id, diagonal, half, pos, node_id``: quads of skewness above ``most``, cut in two triangles.

    Of both diagonals (0 from the first corner, 1 from the second) the one with the less skewed worse triangle, the
    first at ties; a diagonal outside a concave quad is infinitely skewed.
    """
    bad = M.skewness(elem_node, node).where(F.col("skew") > most).select("elem_id")
    quads = M.corners(elem_node, node).where("size(ring) = 4").join(bad, "elem_id", "left_semi")
    tri = lambda diagonal, half, *at: F.struct(F.lit(diagonal).alias("diagonal"), F.lit(half).alias("half"), F.array(*[F.get("ring", F.lit(i)) for i in at]).alias("c"))
    parts = quads.select("elem_id", F.explode(F.array(tri(0, 0, 0, 1, 2), tri(0, 1, 0, 2, 3), tri(1, 0, 0, 1, 3), tri(1, 1, 1, 2, 3))).alias("t")).select("elem_id", "t.*")

    def angle(i: int) -> Column:
        at, p, q = (F.get("c", F.lit((i + k) % 3)) for k in (0, 1, 2))
        ax, ay, bx, by = p["x"] - at["x"], p["y"] - at["y"], q["x"] - at["x"], q["y"] - at["y"]
        return F.degrees(F.abs(F.atan2(ax * by - ay * bx, ax * bx + ay * by)))

    a, b, c = (F.get("c", F.lit(i)) for i in range(3))
    turn = F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))
    high, low = F.greatest(*[angle(i) for i in range(3)]), F.least(*[angle(i) for i in range(3)])
    parts = parts.withColumns({"skew": F.greatest((high - 60) / 120, (60 - low) / 60), "turn": turn})
    each = parts.groupBy("elem_id", "diagonal").agg(F.when(F.min("turn") * F.max("turn") > 0, F.round(F.max("skew"), 9)).otherwise(float("inf")).alias("worst"), F.sort_array(F.collect_list(F.struct("half", "c"))).alias("halves"))
    best = each.groupBy("elem_id").agg(F.min_by(F.struct("diagonal", "halves"), F.struct("worst", "diagonal")).alias("b"))
    return best.select("elem_id", "b.diagonal", F.explode("b.halves").alias("h")).select("elem_id", "diagonal", "h.half", F.posexplode("h.c").alias("pos", "c")).select("elem_id", "diagonal", "half", "pos", "c.node_id")


def region_edges(edges: DataFrame, region: DataFrame) -> DataFrame:
    """``a, b, inside, outside``: edges with an element of ``region`` (elem_id) on one side only; ``outside`` is -1 where no element is."""
    c = F.col
    two = edges.select("a", "b", F.explode(F.array(F.struct(c("el").alias("elem_id"), c("er").alias("other")), F.struct(c("er").alias("elem_id"), c("el").alias("other")))).alias("s"))
    own = two.select("a", "b", "s.*").where("elem_id >= 0").join(region.select("elem_id").distinct(), "elem_id", "left_semi")
    return own.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("elem_id").alias("inside"), F.min("other").alias("outside")).where("n = 1").drop("n")


def flood_fill(edges: DataFrame, node: DataFrame, seeds: DataFrame, surface: DataFrame, shore: float, wet: float) -> tuple[DataFrame, DataFrame]:
    """``elem_id, stage`` of what is always wet, and ``a, b, stage, label`` of its outline.

    ``surface``: node_id, h0, the depth at which a node falls dry; an edge's is the mean of its ends'. An edge is wet if its
    mean depth is above h0 - ``wet``; an element may be flooded if all its edges are. Stage 1 is all that connects to the
    elements of ``seeds`` (elem_id) over edges between such elements; a seed that may not be flooded is an error. Stage 2
    adds elements beyond the outline that may be flooded too, where an end of the edge between is as deep as h0 + ``wet``.
    An edge of the outline is ``deep`` if both its ends are at least h0 + ``shore`` deep, else ``shore``.

    Connection takes a logarithmic number of rounds (components), not one for each element on the way.
    """
    c = F.col
    ends = edges
    for end in ("a", "b"):
        ends = ends.join(node.join(surface, "node_id").select(c("node_id").alias(end), c("depth").alias(f"d{end}"), c("h0").alias(f"h{end}")), end)
    marked = spool(ends.select("a", "b", "el", "er", ((c("da") + c("db")) / 2 > (c("ha") + c("hb")) / 2 - wet).alias("wet"), ((c("da") >= c("ha") + shore) & (c("db") >= c("hb") + shore)).alias("deep"), ((c("da") >= c("ha") + wet) | (c("db") >= c("hb") + wet)).alias("soft")))
    two = marked.select(c("el").alias("elem_id"), "wet").unionByName(marked.where("er >= 0").select(c("er").alias("elem_id"), "wet"))
    able = spool(two.groupBy("elem_id").agg(F.min("wet").alias("able")))
    checked = seeds.select("elem_id").distinct().join(able, "elem_id", "left")
    begun = checked.select(F.when(c("able"), c("elem_id")).otherwise(F.raise_error(F.concat(F.lit("no element to flood from: "), c("elem_id").cast("string"))).cast("long")).alias("elem_id"))
    begun = spool(begun)
    able = able.where("able").select("elem_id")
    between = marked.where("er >= 0").select("el", "er").join(able.withColumnRenamed("elem_id", "el"), "el", "left_semi").join(able.withColumnRenamed("elem_id", "er"), "er", "left_semi")
    of = connected_components(between.select(c("el").alias("a"), c("er").alias("b")))
    hit = of.join(begun.withColumnRenamed("elem_id", "node"), "node", "left_semi").select("component").distinct()
    first = spool(of.join(hit, "component", "left_semi").select(c("node").alias("elem_id")).unionByName(begun).distinct())
    outline = spool(region_edges(marked, first))
    near = outline.join(marked.where("soft").select("a", "b"), ["a", "b"], "left_semi").select(c("outside").alias("elem_id")).where("elem_id >= 0").distinct()
    second = near.join(able, "elem_id", "left_semi").join(first, "elem_id", "left_anti")
    elems = spool(first.withColumn("stage", F.lit(1)).unionByName(second.withColumn("stage", F.lit(2))))
    label = F.when(c("deep"), "deep").otherwise("shore").alias("label")
    told = lambda out, stage: out.select("a", "b").join(marked, ["a", "b"]).select("a", "b", F.lit(stage).alias("stage"), label)
    return elems, told(outline, 1).unionByName(told(region_edges(marked, elems), 2))


def trim_side(elem_node: DataFrame, edges: DataFrame, cut: DataFrame, seeds: DataFrame) -> DataFrame:
    """``elem_node`` without the elements connected to those of ``seeds`` over edges that are not in ``cut`` (a, b)."""
    inner = edges.where("er >= 0").join(cut.select("a", "b"), ["a", "b"], "left_anti")
    of = connected_components(inner.select(F.col("el").alias("a"), F.col("er").alias("b")))
    hit = of.join(seeds.withColumnRenamed("elem_id", "node"), "node", "left_semi").select("component").distinct()
    gone = of.join(hit, "component", "left_semi").select(F.col("node").alias("elem_id")).unionByName(seeds.select("elem_id")).distinct()
    return elem_node.join(gone, "elem_id", "left_anti")


def shore_floor(shores: DataFrame, half: int, deep: float, middle: bool = False) -> DataFrame:
    """``node_id, value``: the largest (``middle``: median) depth within ``half`` nodes along each shoreline.

    ``shores``: line_id, seq, node_id, depth. Ends deeper than ``deep`` are cut off first; windows shrink at the ends; a
    node on several shorelines takes the largest.
    """
    ends = shores.where(F.col("depth") <= deep).groupBy("line_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    own = shores.join(ends, "line_id").where("seq between first and last")
    near = Window.partitionBy("line_id").orderBy("seq").rowsBetween(-half, half)
    value = (F.median if middle else F.max)("depth").over(near)
    return own.select("node_id", value.alias("value")).groupBy("node_id").agg(F.max("value").alias("value"))


def quantize_levels(wanted: DataFrame, nbrs: DataFrame, fewest: int = 2, start: DataFrame | None = None) -> DataFrame:
    """``node_id, nlevel``: real level counts ``wanted`` rounded, then the upper median over a node and its neighbours.

    The median stays between the real count rounded down and up, and is ``fewest`` at least. ``start`` (node_id, n) are
    counts to take instead of the rounded ones.
    """
    now = start or wanted.select("node_id", F.rint("wanted").cast("long").alias("n"))
    ring = nbrs.join(now.withColumnRenamed("node_id", "nbr"), "nbr").select("node_id", "n").unionByName(now)
    mid = ring.groupBy("node_id").agg(F.array_sort(F.collect_list("n")).alias("s")).select("node_id", F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1).alias("mid"))
    within = F.greatest(F.least("mid", F.ceil("wanted")), F.floor("wanted"), F.lit(fewest))
    return wanted.join(mid, "node_id").select("node_id", within.cast("long").alias("nlevel"))


def hysteretic_levels(wanted: DataFrame, depth: DataFrame, nbrs: DataFrame, up: float = 0.7, down: float = 0.7, jump: int = 1, like: float = 0.75, sweeps: int = 6, order: Column | None = None) -> DataFrame:
    """``node_id, n``: real level counts ``wanted`` rounded, then moved by one where that is more than ``up`` or ``down`` away.

    A node may not move if that takes it more than ``jump`` from a neighbour whose ``depth`` is within ``like`` of its own.
    In a sweep nodes move one after the other in the ``order`` of that column (even ids, then odd ones, each by id); sweeps
    end when none moves, or after ``sweeps``. The outcome is that of a single walk through all nodes: a round takes each node
    that could move and whose neighbours before it have had their turn, so only chains of such neighbours take more rounds.
    """
    c = F.col
    rank = order if order is not None else F.struct(F.pmod("node_id", F.lit(2)), "node_id")
    own = wanted.join(depth, "node_id").select("node_id", "wanted", "depth", rank.alias("rank"))
    state = spool(own.withColumn("n", F.rint("wanted").cast("long")))
    other = own.select(c("node_id").alias("nbr"), c("depth").alias("_d"), c("rank").alias("_r"))
    near = spool(nbrs.distinct().join(own, "node_id").join(other, "nbr").where(F.abs(c("depth") - c("_d")) <= like).select("node_id", "nbr", (c("_r") < c("rank")).alias("first")))
    for _ in range(sweeps):
        off = c("wanted") - c("n")
        to = F.when(off > up, c("n") + 1).when(off < -down, c("n") - 1)
        waiting = spool(state.withColumn("to", to).where("to is not null").select("node_id", "n", "to"))
        moved = spool(waiting.where("false").select("node_id", c("to").alias("new")))
        while not waiting.isEmpty():
            held = near.where("first").join(waiting.select(c("node_id").alias("nbr")), "nbr", "left_semi").select("node_id")
            ready = waiting.join(held, "node_id", "left_anti")
            now = state.select(c("node_id").alias("nbr"), c("n").alias("old")).join(moved.withColumnRenamed("node_id", "nbr"), "nbr", "left").select("nbr", F.coalesce("new", "old").alias("_n"))
            stuck = ready.join(near, "node_id").join(now, "nbr").where(F.abs(c("to") - c("_n")) > jump).select("node_id").distinct()
            told = spool(ready.join(stuck.withColumn("stuck", F.lit(True)), "node_id", "left").select("node_id", F.when(c("stuck"), c("n")).otherwise(c("to")).alias("new")))
            left = spool(waiting.join(told, "node_id", "left_anti"))
            total = spool(moved.unionByName(told))
            for done in (waiting, moved, told):
                drop_spool(done)
            waiting, moved = left, total
        changed = moved.join(state.select("node_id", "n"), "node_id").where("new <> n").select("node_id", "new")
        if changed.isEmpty():
            break
        nxt = spool(state.join(changed, "node_id", "left").withColumn("n", F.coalesce("new", "n")).drop("new"))
        drop_spool(state)
        state = nxt
    return state.select("node_id", "n")


def laplace_layered(value: DataFrame, layers: DataFrame, nbrs: DataFrame, kappa: float, rounds: int = 150, node: DataFrame | None = None, size: int = BLOCK, rings: int = RINGS) -> DataFrame:
    """Jacobi smoothing of ``value`` where neighbours with fewer layers (``nlayer``) stand at their first value; blocks as in ``laplace_smooth``."""
    state = value.join(layers, "node_id").select("node_id", F.col("value").cast("double").alias("value"), F.col("value").cast("double").alias("base"), F.col("nlayer").cast("double").alias("nlayer"))

    def advance(own, ring, n):
        v, base, layer = (own[c].to_numpy() for c in ("value", "base", "nlayer"))
        fewer = layer[ring.nbr] < layer[ring.row]
        for _ in range(n):
            v = ring.blend(v, np.where(fewer, base[ring.nbr], v[ring.nbr]), kappa)
        return own.assign(value=v)

    return in_blocks(state, nbrs, blocks(node if node is not None else value, size), advance, rounds, rings).select("node_id", "value")


def bottom_thickness(level_z: DataFrame, nbrs: DataFrame, least: float, kappa: float = 0.5) -> DataFrame:
    """``node_id, value``: the lowest layer's thickness, ``least`` or more, after two smoothing passes."""
    up = F.lead("z").over(Window.partitionBy("node_id").orderBy("k"))
    last = level_z.withColumn("up", up).where("up is not null").groupBy("node_id").agg(F.min_by(F.col("up") - F.col("z"), "k").alias("t"))
    start = last.select("node_id", F.greatest("t", F.lit(least)).alias("value"))
    return laplace_rounds(start, nbrs, kappa, 2).select("node_id", F.greatest("value", F.lit(least)).alias("value"))


def tv_step(edges: DataFrame, node: DataFrame, geometry: DataFrame, elem_node: DataFrame, cfl: float = 0.5, clip: bool = True) -> DataFrame:
    """``node_id, value``: depths after one subgradient step of the total variation over edges.

    Each edge pulls its ends together by one over its length; an element's area is dealt evenly to its corners as mass;
    the step is ``cfl`` over the largest pull by mass. ``clip`` holds values within those of a node and its neighbours.
    """
    ends = edges.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(node.select(F.col("node_id").alias(end), F.col("x").alias(f"x{end}"), F.col("y").alias(f"y{end}"), F.col("depth").alias(f"d{end}")), end)
    pull = 1 / (F.sqrt((F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2) + 1e-12)
    two = ends.withColumn("pull", pull)
    both = two.select(F.col("a").alias("node_id"), F.col("da").alias("own"), F.col("db").alias("other"), "pull").unionByName(two.select(F.col("b").alias("node_id"), F.col("db").alias("own"), F.col("da").alias("other"), "pull"))
    slope = both.groupBy("node_id").agg(F.sum(F.signum(F.col("own") - F.col("other")) * F.col("pull")).alias("g"), F.sum("pull").alias("p"), F.min("other").alias("lo"), F.max("other").alias("hi"))
    mass = elem_node.join(geometry.select("elem_id", (F.col("area") / F.col("n")).alias("share")), "elem_id").groupBy("node_id").agg(F.sum("share").alias("mass"))
    own = spool(node.select("node_id", "depth").join(slope, "node_id").join(mass, "node_id"))
    dt = own.agg((cfl / F.max(F.col("p") / F.col("mass"))).alias("dt"))
    new = F.col("depth") - F.col("dt") * F.col("g") / F.col("mass")
    held = F.greatest(F.least(new, F.greatest("hi", "depth")), F.least("lo", "depth"))
    return own.join(F.broadcast(dt)).select("node_id", (held if clip else new).alias("value"))
