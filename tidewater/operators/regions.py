"""Cutting meshes and outputs down to regions and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewater.operators.mesh import dense_ids


def subset_region(elem_node: DataFrame, elems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The elements of ``elems`` with dense new ids in old order: (elem_node, map of nodes ``node_id, new_id``)."""
    kept = elem_node.join(elems.select("elem_id"), "elem_id", "left_semi")
    nodes, faces = dense_ids(kept, "node_id"), dense_ids(kept, "elem_id").withColumnRenamed("new_id", "new_elem")
    cut = kept.join(nodes, "node_id").join(faces, "elem_id")
    return cut.select(F.col("new_elem").alias("elem_id"), "pos", F.col("new_id").alias("node_id")), nodes


def subset_field(field: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of an output field (``node_id`` and more) at the nodes kept, with their new ids; every time step."""
    return field.join(nodes, "node_id").drop("node_id").withColumnRenamed("new_id", "node_id")


def flux_flags(crossed: DataFrame, edges: DataFrame, node: DataFrame, lines: DataFrame) -> DataFrame:
    """``elem_id, flag``: of line i, elements it crosses get i + 1, their neighbours across an edge with both nodes
    strictly on its positive side i. Later lines overwrite, and in one line neighbours come second.
    """
    side = lambda s: node.select(F.col("node_id").alias(s), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    two = edges.where("er >= 0").select("a", "b", F.explode(F.array(F.struct(F.col("el").alias("elem_id"), F.col("er").alias("other")), F.struct(F.col("er").alias("elem_id"), F.col("el").alias("other")))).alias("s")).select("a", "b", "s.*")
    near = crossed.join(two, "elem_id").join(side("a"), "a").join(side("b"), "b").join(lines, ["line_id", "seg"])
    at = lambda s: (F.col("x1") - F.col("x0")) * (F.col(f"y{s}") - F.col("y0")) - (F.col("y1") - F.col("y0")) * (F.col(f"x{s}") - F.col("x0"))
    over = near.where((at("a") > 0) & (at("b") > 0))
    own = crossed.select("elem_id", "line_id", "seg", F.lit(0).alias("step"), (F.col("line_id") + 1).alias("flag"))
    both = own.unionByName(over.select(F.col("other").alias("elem_id"), "line_id", "seg", F.lit(1).alias("step"), F.col("line_id").alias("flag")))
    return both.groupBy("elem_id").agg(F.max_by("flag", F.struct("line_id", "seg", "step")).alias("flag"))


def label_values(labels: DataFrame, values: DataFrame) -> DataFrame:
    """Each row with its label's number (``values``: label, value, a short list); a label without one is an error."""
    both = labels.join(values, "label", "left")
    return both.withColumn("value", F.coalesce("value", F.raise_error(F.concat(F.lit("no value for "), F.col("label"))).cast("double")))


def bounding_boxes(elem_node: DataFrame, node: DataFrame, by: DataFrame) -> DataFrame:
    """Box and node count of each group of elements (``by``: elem_id, part)."""
    own = elem_node.join(by, "elem_id").join(node, "node_id")
    return own.groupBy("part").agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.countDistinct("node_id").alias("n"))
