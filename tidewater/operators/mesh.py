"""Mesh tables: ``node(node_id, x, y, depth)``, ``elem_node(elem_id, pos, node_id)``, ``level(node_id, k, sigma)``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

INTERNAL, BOUNDARY = 0, 1


def corners(elem_node: DataFrame, node: DataFrame) -> DataFrame:
    """``elem_id, ring``: each element's corners in order, as (pos, node_id, x, y, depth)."""
    full = elem_node.join(node, "node_id")
    return full.groupBy("elem_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "x", "y", "depth"))).alias("ring"))


def _turned(ring: Column, by: int = 1) -> Column:
    """The ring begun one corner later."""
    n = F.size(ring)
    return F.concat(F.slice(ring, by + 1, n), F.slice(ring, 1, by))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def elem_geometry(elem_node: DataFrame, node: DataFrame) -> DataFrame:
    """Area, centroid of the polygon, mean of the corners, mean edge length, least and mean depth of each element."""
    c = corners(elem_node, node).withColumn("next", _turned(F.col("ring")))
    pair = lambda f: F.zip_with("ring", "next", f)
    cross = pair(lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    area2 = _sum(cross)
    cx = _sum(pair(lambda a, b: (a["x"] + b["x"]) * (a["x"] * b["y"] - b["x"] * a["y"])))
    cy = _sum(pair(lambda a, b: (a["y"] + b["y"]) * (a["x"] * b["y"] - b["x"] * a["y"])))
    mean = lambda k: _sum(F.transform("ring", lambda a: a[k])) / F.size("ring")
    edge = pair(lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])))
    flat = F.when(area2 != 0, area2)
    return c.select(
        "elem_id",
        F.size("ring").alias("n"),
        (F.abs(area2) / 2).alias("area"),
        (cx / (3 * flat)).alias("cx"),
        (cy / (3 * flat)).alias("cy"),
        mean("x").alias("mx"),
        mean("y").alias("my"),
        (_sum(edge) / F.size("ring")).alias("edge"),
        F.array_min(F.transform("ring", lambda a: a["depth"])).alias("depth_min"),
        mean("depth").alias("depth_mean"),
    )


def build_edges(elem_node: DataFrame) -> DataFrame:
    """``a, b, etype, el, er``: each pair of neighbouring corners once, with the elements on its sides (er -1 outside).

    More than two elements on an edge are an error.
    """
    ring = elem_node.groupBy("elem_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("r"))
    pairs = ring.select("elem_id", F.explode(F.zip_with("r", _turned(F.col("r")), lambda p, q: F.struct(p["node_id"].alias("p"), q["node_id"].alias("q")))).alias("e"))
    sides = pairs.groupBy(F.least("e.p", "e.q").alias("a"), F.greatest("e.p", "e.q").alias("b")).agg(F.count("*").alias("n"), F.min("elem_id").alias("el"), F.max("elem_id").alias("er"))
    etype = F.when(F.col("n") == 1, BOUNDARY).when(F.col("n") == 2, INTERNAL).otherwise(F.raise_error(F.lit("an edge has more than two elements")).cast("int"))
    return sides.select("a", "b", etype.alias("etype"), "el", F.when(F.col("n") == 1, -1).otherwise(F.col("er")).alias("er"))


def neighbors(edges: DataFrame) -> DataFrame:
    """``node_id, nbr``: nodes that share an edge, both ways."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("node_id"), F.col("b").alias("nbr")), F.struct(F.col("b").alias("node_id"), F.col("a").alias("nbr")))).alias("e")).select("e.*")


def node_elems(elem_node: DataFrame) -> DataFrame:
    """``node_id, elems``: elements around each node, sorted."""
    return elem_node.groupBy("node_id").agg(F.array_sort(F.collect_set("elem_id")).alias("elems"))


def elem_on_boundary(edges: DataFrame) -> DataFrame:
    sides = edges.select(F.explode(F.array("el", "er")).alias("elem_id"), "etype").where("elem_id >= 0")
    return sides.groupBy("elem_id").agg(F.max(F.col("etype") != INTERNAL).alias("on_boundary"))


def node_to_elem(elem_node: DataFrame, value: DataFrame) -> DataFrame:
    """Mean of the corners' ``value`` (node_id, value)."""
    return elem_node.join(value, "node_id").groupBy("elem_id").agg(F.avg("value").alias("value"))


def elem_to_node(elem_node: DataFrame, value: DataFrame) -> DataFrame:
    return elem_node.join(value, "elem_id").groupBy("node_id").agg(F.avg("value").alias("value"))


def node_to_prism(elem_node: DataFrame, value: DataFrame) -> DataFrame:
    """``value`` (node_id, k, value) at elements' half levels: mean of the corners, then of two levels; level 0 copies 1."""
    face = elem_node.join(value, "node_id").groupBy("elem_id", "k").agg(F.avg("value").alias("v"))
    by = Window.partitionBy("elem_id").orderBy("k")
    half = face.withColumn("h", (F.col("v") + F.lag("v").over(by)) / 2)
    return half.select("elem_id", "k", F.coalesce("h", F.lead("h").over(by)).alias("value"))


def wet_dry(elem_node: DataFrame, edges: DataFrame, level_z: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dry flags: a node if its least ``z`` is at or above 0; an edge or element if one of its nodes is."""
    nodes = level_z.groupBy("node_id").agg((F.min("z") >= 0).alias("dry"))
    elems = elem_node.join(nodes, "node_id").groupBy("elem_id").agg(F.max("dry").alias("dry"))
    ends = edges.select("a", "b", F.explode(F.array("a", "b")).alias("node_id")).join(nodes, "node_id")
    return nodes, ends.groupBy("a", "b").agg(F.max("dry").alias("dry")), elems


def mesh_volume(elem_node: DataFrame, node: DataFrame) -> DataFrame:
    """Sum of area times mean depth."""
    return elem_geometry(elem_node, node).agg(F.sum(F.col("area") * F.col("depth_mean")).alias("volume"))


def tv_energy(edges: DataFrame, node: DataFrame) -> DataFrame:
    """Sum over edges of the depth difference by length."""
    e = _ends(edges, node)
    length = F.sqrt((F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2)
    return e.agg(F.sum(F.abs(F.col("za") - F.col("zb")) / (length + 1e-12)).alias("energy"))


def _ends(edges: DataFrame, node: DataFrame) -> DataFrame:
    side = lambda s: node.select(F.col("node_id").alias(s), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"), F.col("depth").alias(f"z{s}"))
    return edges.join(side("a"), "a").join(side("b"), "b")


def level_counts(level: DataFrame) -> DataFrame:
    """Levels and layers (at least 0) of each node."""
    return level.groupBy("node_id").agg(F.count("*").alias("nlevel")).withColumn("nlayer", F.greatest(F.col("nlevel") - 1, F.lit(0)))


def build_z(level: DataFrame, node: DataFrame, eta: float = 0.0) -> DataFrame:
    """``z``: sigma times the water depth, which is at least 0.1."""
    return level.join(node.select("node_id", "depth"), "node_id").select("node_id", "k", (F.greatest(F.col("depth") + eta, F.lit(0.1)) * F.col("sigma")).alias("z"))


def sigma_to_z(level: DataFrame, node: DataFrame, eta: float) -> DataFrame:
    own = level.join(node.select("node_id", "depth"), "node_id")
    z = eta + (eta + F.col("depth")) * F.col("sigma")
    return own.select("node_id", "k", F.when(eta + F.col("depth") >= 0, z).alias("z"))


def flip_sigma(level: DataFrame) -> DataFrame:
    """Each node's levels in reverse."""
    n = level.groupBy("node_id").agg(F.max("k").alias("top"))
    return level.join(n, "node_id").select("node_id", (F.col("top") - F.col("k")).alias("k"), "sigma")


def vgrid_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Levels that differ, on either side."""
    both = a.select("node_id", "k", F.col("sigma").alias("sigma_a")).join(b.select("node_id", "k", F.col("sigma").alias("sigma_b")), ["node_id", "k"], "full")
    return both.where(~F.col("sigma_a").eqNullSafe(F.col("sigma_b")))


def vgrid_checks(level: DataFrame, edges: DataFrame, least_fraction: float = 0.2, most: int = 100) -> DataFrame:
    """``check, node_id, k, detail``: V2 not increasing, V3 not after rounding to 6 decimals, V4 a layer thinner than a
    fraction of an even one, V5 not increasing at the middle of an edge. At most ``most`` of each check, a report.
    """
    by = Window.partitionBy("node_id").orderBy("k")
    n = F.count("*").over(Window.partitionBy("node_id"))
    step = level.withColumn("up", F.lead("sigma").over(by)).withColumn("n", n).where("up is not null")
    row = lambda check, bad, detail: step.where(bad).select(F.lit(check).alias("check"), "node_id", "k", detail.alias("detail"))
    thick = F.col("up") - F.col("sigma")
    found = row("V2", F.col("up") <= F.col("sigma"), thick)
    found = found.unionByName(row("V3", F.round("up", 6) <= F.round("sigma", 6), thick))
    found = found.unionByName(row("V4", thick < least_fraction / (F.col("n") - 1), thick))
    top = level.groupBy("node_id").agg(F.max("k").alias("top"))
    side = lambda s: level.select(F.col("node_id").alias(s), "k", F.col("sigma").alias(f"s{s}")).join(top.select(F.col("node_id").alias(s), F.col("top").alias(f"t{s}")), s)
    mids = edges.select("a", "b").join(side("a"), "a").join(side("b").withColumnRenamed("k", "kb"), "b").where("k = kb and k <= least(ta, tb)")
    mid = mids.select("a", "b", "k", ((F.col("sa") + F.col("sb")) / 2).alias("m"))
    mid = mid.withColumn("up", F.lead("m").over(Window.partitionBy("a", "b").orderBy("k"))).where("up <= m")
    found = found.unionByName(mid.select(F.lit("V5").alias("check"), F.col("a").alias("node_id"), "k", (F.col("up") - F.col("m")).alias("detail")))
    nth = F.row_number().over(Window.partitionBy("check").orderBy("node_id", "k", "detail"))
    return found.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def small_areas(geometry: DataFrame, warn: float, fail: float) -> DataFrame:
    """Elements smaller than ``warn`` with whether they are smaller than ``fail``."""
    return geometry.where(F.col("area") < warn).select("elem_id", "area", (F.col("area") < fail).alias("fatal"))


def skewness(elem_node: DataFrame, node: DataFrame) -> DataFrame:
    """Normalized skewness of each element: max((amax - e) / (pi - e), (e - amin) / e), e 60 degrees or, of quads, 120."""
    c = corners(elem_node, node).withColumn("next", _turned(F.col("ring"))).withColumn("prev", F.concat(F.slice("ring", -1, 1), F.slice("ring", 1, F.size("ring") - 1)))
    tri = F.arrays_zip("ring", "next", "prev")

    def angle(t: Column) -> Column:
        ax, ay = t["next"]["x"] - t["ring"]["x"], t["next"]["y"] - t["ring"]["y"]
        bx, by = t["prev"]["x"] - t["ring"]["x"], t["prev"]["y"] - t["ring"]["y"]
        cos = (ax * bx + ay * by) / F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by))
        return F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0)))

    e = F.when(F.size("ring") == 3, math.pi / 3).otherwise(2 * math.pi / 3)
    angles = F.transform(tri, angle)
    own = c.select("elem_id", e.alias("e"), F.array_max(angles).alias("hi"), F.array_min(angles).alias("lo"))
    return own.select("elem_id", F.greatest((F.col("hi") - F.col("e")) / (math.pi - F.col("e")), (F.col("e") - F.col("lo")) / F.col("e")).alias("skew"), (F.col("hi") / F.col("lo")).alias("ratio"))


def dense_ids(ids: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """``column, new_id``: consecutive numbers from 0 in the order of the ids.

    Numbered in ``parts`` ranges side by side: each range's count gives the next one's first number, so that no task
    orders all ids.
    """
    ends = ids.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = F.greatest(F.ceil((F.col("_hi") - F.col("_lo") + 1) / parts), F.lit(1))
    own = ids.select(column).distinct().join(F.broadcast(ends)).withColumn("_part", F.floor((F.col(column) - F.col("_lo")) / width)).select(column, "_part")
    counts = own.groupBy("_part").agg(F.count("*").alias("_n"))
    start = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return own.withColumn("_k", nth).join(F.broadcast(start), "_part").select(column, (F.col("_before") + F.col("_k")).alias("new_id"))


def renumber(elem_node: DataFrame) -> DataFrame:
    """Elements without duplicates, unused nodes gone, both numbered densely in old order: ``elem_id, pos, node_id``.

    Elements with the same set of nodes are duplicates; the smallest id stays.
    """
    sets = elem_node.groupBy("elem_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))
    first = sets.groupBy("nodes").agg(F.min("elem_id").alias("elem_id")).select("elem_id")
    kept = elem_node.join(first, "elem_id", "left_semi")
    nodes = dense_ids(kept, "node_id").withColumnRenamed("new_id", "new_node")
    elems = dense_ids(kept, "elem_id").withColumnRenamed("new_id", "new_elem")
    return kept.join(nodes, "node_id").join(elems, "elem_id").select(F.col("new_elem").alias("elem_id"), "pos", F.col("new_node").alias("node_id"))


def perimeter_edges(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Edges with exactly one side among the elements of ``inside``; the outside of the mesh is not inside."""
    l, r = inside.select(F.col("elem_id").alias("el"), F.lit(True).alias("_l")), inside.select(F.col("elem_id").alias("er"), F.lit(True).alias("_r"))
    both = edges.join(l, "el", "left").join(r, "er", "left")
    return both.where(F.coalesce("_l", F.lit(False)) != F.coalesce("_r", F.lit(False))).select("a", "b", "el", "er")


def top_deepest(elems: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` deepest elements of each group, the smaller id first at ties."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("depth_mean"), "elem_id"))
    return elems.withColumn("rank", nth).where(F.col("rank") <= k)


def ball_max(elem_node: DataFrame, value: DataFrame) -> DataFrame:
    """The largest node value over all elements that touch a node."""
    high = elem_node.join(value, "node_id").groupBy("elem_id").agg(F.max("value").alias("v"))
    return elem_node.join(high, "elem_id").groupBy("node_id").agg(F.max("v").alias("value"))


def prop_from_nodes(elem_node: DataFrame, value: DataFrame) -> DataFrame:
    """1 for elements whose largest node value is 1, else 0."""
    return elem_node.join(value, "node_id").groupBy("elem_id").agg(F.when(F.max("value") == 1.0, 1).otherwise(0).alias("flag"))
