"""Mesh nodes in blocks of neighbours, so that many steps of an iteration are done in a block between two shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.spool import spool

#: Nodes of a block, about.
BLOCK = 16_384
#: Bits of each coordinate in the order of the blocks.
BITS = 30


def _spread(v: Column) -> Column:
    """The bits of a number below 2^32, each followed by a zero bit."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def z_order(x: Column, y: Column, x0: Column, y0: Column, wide: Column) -> Column:
    """A place in a square of side ``wide`` from (``x0``, ``y0``) as a number: places near each other are mostly near in its order."""
    at = lambda v, v0: F.coalesce(F.floor(F.try_divide(v - v0, wide) * (2**BITS - 1)), F.lit(0)).cast("long")
    return _spread(at(x, x0)).bitwiseOR(F.shiftleft(_spread(at(y, y0)), 1))


def blocks(node: DataFrame, size: int = BLOCK, few: int | None = None) -> DataFrame:
    """``node_id, block``: nodes in blocks of about ``size`` along a space-filling curve, whatever their density.

    With ``few`` there are no more than so many as long as they needn't be larger than eight times ``size`` for that.
    Nodes without columns ``x, y`` go by their ids. Written out, so that all who read it see the same blocks.
    """
    if "x" not in node.columns:
        node = node.select("node_id", F.col("node_id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    box = node.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("wide"), F.count("*").alias("n"))
    n = box.first()["n"]
    parts = max(1, -(-n // size))
    if few is not None:
        parts = max(min(parts, few), -(-n // (8 * size)))
    code = z_order(*(F.col(c) for c in ("x", "y", "x0", "y0", "wide")))
    placed = node.join(F.broadcast(box.drop("n"))).select("node_id", code.alias("code"))
    return spool(placed.repartitionByRange(parts, "code", "node_id").select("node_id", F.spark_partition_id().alias("block")))
