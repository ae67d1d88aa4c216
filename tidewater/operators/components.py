"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewater.spool import drop_spool, spool

#: Edges that a task looks at together.
EDGES = 1 << 20


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges that are not the smallest they reach by these, and that smallest one."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (nxt := label[label]).tobytes() != label.tobytes():
            label = nxt
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _contracted(edges: DataFrame) -> DataFrame:
    """``u, v``: stars that connect the same, of ``EDGES`` edges at a time. Edges of nodes with ids near each other are looked at together."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= EDGES:
                yield told(held)
                held, n = [], 0
        if held:
            yield told(held)

    def told(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        found = least_reachable(*(np.concatenate(v) for v in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(f) for f in found], schema=schema)

    return edges.repartitionByRange("v", "u").mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns ``a, b`` (long) in; ``node, component`` out, component being the smallest node reachable.

    Nodes appear only if they have an edge to another node. Edges with a null end and loops are ignored;
    direction and repeats don't matter. What neighbouring ids connect is found in the tasks first, so that rounds grow with
    the steps between such parts and not with a mesh's length. Each round is two joins on node ids and is written to the shared
    folder; the number of rounds grows with the logarithm of the component sizes. Hub nodes are only ever
    the split side of a join or reduced by a map-side minimum.
    """
    own = spool(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .distinct()
    )
    e = spool(_contracted(own).distinct())
    drop_spool(own)
    before = _state(e)
    while before[0]:
        # Written out, so that both sides of the next join are dealt anew and Spark can split a hub's rows.
        least = spool(e.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")))
        large = (
            e.join(least, e.v == least.x, "left")
            .select("u", F.coalesce("m", "v").alias("v"))
            .distinct()
        )
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(low, large.u == low.x).select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("s")
        )
        nxt = spool(small.select("s.u", "s.v").where("u <> v").distinct())
        after = _state(nxt)
        drop_spool(e)
        drop_spool(least)
        e = nxt
        if after == before:
            break
        before = after
    roots = e.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(e: DataFrame) -> tuple:
    """Equal between two rounds only if the edges are."""
    h = F.xxhash64("u", "v")
    return tuple(
        e.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    )
