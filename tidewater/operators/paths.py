"""Least paths over mesh edges, for many pairs of nodes at once."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewater.operators.blocks import BLOCK, blocks
from tidewater.operators.mesh import BOUNDARY
from tidewater.spool import drop_spool, spool

#: Blocks that paths are searched in, at most, as long as these don't grow beyond eight times their size: rounds grow with them.
FEW = 128

_GATE = "pair long, node_id long, block int, length double, hops long, own boolean"
_PACKED = "block int, nodes array<long>, row array<int>, nbr array<int>, step array<double>, out_row array<int>, out array<long>, out_step array<double>, out_block array<int>"
_WAYS = "pair long, block int, nodes array<long>, length array<double>, hops array<long>, up array<long>, ends array<long>, lands array<long>"


def edge_steps(edges: DataFrame, node: DataFrame, boundary_only: bool = False) -> DataFrame:
    """``a, b, step``: edges both ways with their length in x, y and depth; ``boundary_only`` those of the boundary."""
    ends = (edges.where(F.col("etype") == BOUNDARY) if boundary_only else edges).select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(node.select(F.col("node_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("x", "y", "depth")]), end)
    span = F.sqrt(sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in ("x", "y", "depth")), F.lit(0.0)))
    return ends.select("a", "b", span.alias("step")).unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"), span.alias("step")))


def _pack(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """A block in one row: its nodes, the steps between them by their places, and those to other blocks."""
    nodes = np.sort(own["node_id"].to_numpy())
    row = np.searchsorted(nodes, links["a"].to_numpy()).astype(np.int32)
    inside = (links["to_block"] == key[0]).to_numpy()
    out = links[~inside]
    nbr = np.searchsorted(nodes, links["b"].to_numpy()[inside]).astype(np.int32)
    cells = [key[0], nodes, row[inside], nbr, links["step"].to_numpy()[inside], row[~inside], *(out[c].to_numpy() for c in ("b", "step", "to_block"))]
    return pd.DataFrame({name.split()[0]: [cell] for name, cell in zip(_PACKED.split(", "), cells)})


class _Block:
    """A block's nodes and steps as ``_pack`` has put them in a row."""

    def __init__(self, packed: pd.DataFrame):
        for name in packed.columns:
            setattr(self, name, packed[name].iloc[0])
        self.near = [[] for _ in self.nodes]
        for r, n, s in zip(self.row.tolist(), self.nbr.tolist(), self.step.tolist()):
            self.near[r].append((n, s))
        self.gates = np.unique(self.out_row)

    def place(self, ids: pd.Series) -> np.ndarray:
        return np.searchsorted(self.nodes, ids.to_numpy())

    def settled(self, labels: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray, np.ndarray, float]]:
        """For each pair its labels, the least lengths and hops of all nodes that follow from them, and the largest length."""
        for pair, own in labels.groupby("pair", sort=False):
            most = float(own["most"].min())
            x, h = [float("inf")] * len(self.nodes), [0] * len(self.nodes)
            for i, length, hops in zip(self.place(own["node_id"]).tolist(), own["length"].tolist(), own["hops"].tolist()):
                if length <= most and (length, hops) < (x[i], h[i]):
                    x[i], h[i] = length, hops
            heap = [(x[i], h[i], i) for i in np.flatnonzero(np.isfinite(x)).tolist()]
            heapq.heapify(heap)
            while heap:
                length, hops, i = heapq.heappop(heap)
                if length != x[i] or hops != h[i]:
                    continue
                hops += 1
                for j, step in self.near[i]:
                    further = length + step
                    if further <= most and (further < x[j] or (further == x[j] and hops < h[j])):
                        x[j], h[j] = further, hops
                        heapq.heappush(heap, (further, hops, j))
            yield pair, own, np.array(x), np.array(h, np.int64), most


def _gate_labels(key: tuple, labels: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
    """Least labels of the nodes asked for and of those with steps to other blocks (``own``), and what goes over these steps."""
    block, out = _Block(packed), []
    for pair, own, x, h, most in block.settled(labels):
        at = np.union1d(block.gates, block.place(own["node_id"]))
        at = at[np.isfinite(x[at])]
        out.append(pd.DataFrame({"pair": pair, "node_id": block.nodes[at], "block": key[0], "length": x[at], "hops": h[at], "own": True}))
        sent = pd.DataFrame({"pair": pair, "node_id": block.out, "block": block.out_block, "length": x[block.out_row] + block.out_step, "hops": h[block.out_row] + 1, "own": False})
        sent = sent[np.isfinite(sent["length"]) & (sent["length"] <= most)]
        out.append(sent.sort_values(["node_id", "length", "hops"]).drop_duplicates("node_id"))
    return pd.concat(out)


def _all_labels(key: tuple, labels: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
    block, out = _Block(packed), []
    for pair, _, x, h, _ in block.settled(labels):
        at = np.flatnonzero(np.isfinite(x))
        out.append(pd.DataFrame({"pair": pair, "node_id": block.nodes[at], "length": x[at], "hops": h[at]}))
    return pd.concat(out)


def _ways(key: tuple, labels: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
    """A row for each pair: all labels, the node before each (-1 where none) and, for each of ``ends``, where its way leaves the block."""
    block, out = _Block(packed), []
    none = np.iinfo(np.int64).max
    for pair, own, x, h, _ in block.settled(labels):
        tight = np.isfinite(x[block.row]) & (x[block.row] + block.step == x[block.nbr]) & (h[block.row] + 1 == h[block.nbr])
        up, inside = np.full(len(x), none), np.arange(len(x))
        np.minimum.at(up, block.nbr[tight], block.nodes[block.row[tight]])
        there = up != none
        inside[there] = np.searchsorted(block.nodes, up[there])
        from_other = own[own["up"].notna()]
        at, other = block.place(from_other["node_id"]), from_other["up"].to_numpy().astype(np.int64)
        first = other < up[at]
        at, other = at[first], other[first]
        up[at], inside[at] = other, at
        up[up == none] = -1
        ends = np.unique(block.place(own.loc[own["is_end"], "node_id"]))
        ends = ends[np.isfinite(x[ends])]
        root = inside
        for _ in range(max(1, len(x)).bit_length()):
            root = root[root]
        kept = np.flatnonzero(np.isfinite(x))
        out.append((pair, key[0], block.nodes[kept], x[kept], h[kept], up[kept], block.nodes[ends], up[root[ends]]))
    return pd.DataFrame(out, columns=[name.split()[0] for name in _WAYS.split(", ")])


def _walked(key: tuple, ways: pd.DataFrame, marked: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a block on the way back from those marked."""
    if not len(ways) or not len(marked):
        return pd.DataFrame({"pair": [], "seq": [], "node_id": [], "length": []})
    nodes, length, hops, up = (np.asarray(ways[c].iloc[0]) for c in ("nodes", "length", "hops", "up"))
    before, seen = np.searchsorted(nodes, up), set()
    here = (before < len(nodes)) & (nodes[np.minimum(before, len(nodes) - 1)] == up)
    for i in np.searchsorted(nodes, marked["node_id"].to_numpy()).tolist():
        while i not in seen:
            seen.add(i)
            if not here[i]:
                break
            i = int(before[i])
    at = np.array(sorted(seen))
    return pd.DataFrame({"pair": key[0], "seq": hops[at], "node_id": nodes[at], "length": length[at]})


class _Search:
    """Least labels of all gates, the nodes with steps to other blocks, found in rounds; what lies between them follows block by block."""

    def __init__(self, seeds: DataFrame, steps: DataFrame, of: DataFrame, goals: DataFrame | None, limit: float):
        place = lambda end, name: of.select(F.col("node_id").alias(end), F.col("block").alias(name))
        links = spool(steps.join(place("a", "block"), "a").join(place("b", "to_block"), "b").select("a", "b", "step", "block", "to_block"))
        self.between = links.where("block <> to_block")
        self.packed = spool(of.groupBy("block").cogroup(links.groupBy("block")).applyInPandas(_pack, _PACKED))
        self.goals, self.limit = goals, limit
        label = lambda df, length, new: df.select("pair", "node_id").distinct().join(of, "node_id").select("pair", "node_id", "block", F.lit(length).alias("length"), F.lit(0).cast("long").alias("hops"), F.lit(new).alias("new"))
        first = label(seeds, 0.0, True)
        if goals is not None:
            first = first.unionByName(label(goals, float("inf"), False).join(first.select("pair", "node_id"), ["pair", "node_id"], "left_anti"))
        self.gates = spool(first)
        while not self.gates.where("new").isEmpty():
            self._round()

    def in_blocks(self, labels: DataFrame, run: Callable, schema: str) -> DataFrame:
        """``run`` on the labels of each block and its row of ``packed``; there is a row of the broadcast side for each block."""
        if self.goals is None:
            labels = labels.withColumn("most", F.lit(self.limit))
        else:
            reached = self.gates.join(self.goals, ["pair", "node_id"]).groupBy("pair").agg(F.min("length").alias("most"))
            labels = labels.join(reached, "pair", "left").withColumn("most", F.least(F.coalesce("most", F.lit(self.limit)), F.lit(self.limit)))
        asked = self.packed.join(F.broadcast(labels.select("block").distinct()), "block", "left_semi")
        return labels.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(run, schema)

    def _round(self) -> None:
        came = self.gates.where("new").select("pair", "block").distinct()
        got = spool(self.in_blocks(self.gates.join(came, ["pair", "block"], "left_semi").drop("new"), _gate_labels, _GATE))
        label = F.struct("length", "hops")
        both = self.gates.drop("new").withColumn("own", F.lit(True)).unionByName(got)
        least = both.groupBy("pair", "node_id", "block").agg(F.min(label).alias("l"), F.min(F.when(F.col("own"), label)).alias("k"))
        after = spool(least.select("pair", "node_id", "block", "l.*", (F.col("k").isNull() | (F.col("l") < F.col("k"))).alias("new")))
        for done in (self.gates, got):
            drop_spool(done)
        self.gates = after

    def labels(self) -> DataFrame:
        return self.in_blocks(self.gates.drop("new"), _all_labels, "pair long, node_id long, length double, hops long")

    def paths(self) -> DataFrame:
        """``pair, seq, node_id, length``: ways back from the goals, over steps between blocks by doubled pointers, then within blocks."""
        known = self.gates.where(F.col("length") < float("inf")).drop("new")
        before = known.select("pair", F.col("node_id").alias("a"), F.col("length").alias("_x"), F.col("hops").alias("_h"))
        back = known.join(self.between.select("a", F.col("b").alias("node_id"), "step"), "node_id").join(before, ["pair", "a"]).where((F.col("_x") + F.col("step") == F.col("length")) & (F.col("_h") + 1 == F.col("hops")))
        over = spool(back.groupBy("pair", "node_id").agg(F.min("a").alias("up")))
        goals = self.goals.select("pair", "node_id").distinct()
        ends = over.select("pair", F.col("up").alias("node_id")).unionByName(goals).distinct().withColumn("is_end", F.lit(True))
        asked = known.join(over, ["pair", "node_id"], "left").join(ends, ["pair", "node_id"], "left").withColumn("is_end", F.coalesce("is_end", F.lit(False)))
        ways = spool(self.in_blocks(asked, _ways, _WAYS))
        jumps = spool(ways.select("pair", F.explode(F.arrays_zip("ends", "lands")).alias("j")).select("pair", F.col("j.ends").alias("node_id"), F.col("j.lands").alias("up")).where("up >= 0"))
        path = spool(known.join(goals, ["pair", "node_id"], "left_semi").select("pair", "node_id"))
        while not jumps.isEmpty():
            path = spool(path.unionByName(path.join(jumps, ["pair", "node_id"]).select("pair", F.col("up").alias("node_id"))))
            far = jumps.select("pair", F.col("node_id").alias("up"), F.col("up").alias("_far"))
            jumps = spool(jumps.join(far, ["pair", "up"]).select("pair", "node_id", F.col("_far").alias("up")))
        marked = path.join(known.select("pair", "node_id", "block"), ["pair", "node_id"])
        asked = ways.join(marked.select("pair", "block").distinct(), ["pair", "block"], "left_semi").select("pair", "block", "nodes", "length", "hops", "up")
        return asked.groupBy("pair", "block").cogroup(marked.groupBy("pair", "block")).applyInPandas(_walked, "pair long, seq long, node_id long, length double")


def least_labels(seeds: DataFrame, steps: DataFrame, of: DataFrame, goals: DataFrame | None = None, limit: float = float("inf")) -> DataFrame:
    """``pair, node_id, length, hops``: the least length from each pair's seed (``pair, node_id``), and the fewest edges at that length.

    A round settles all blocks that something came into (``of``: node_id, block), each in a task with a queue of its own, and
    keeps the labels of their gates only; these then go to the blocks beside them. So rounds grow with the blocks that paths
    cross, and what a round writes with their borders. The nodes within are labelled once, from the gates, when these are settled.
    Labels above ``limit`` are left out, and with ``goals`` (``pair, node_id``) those above that of a pair's goal: no least
    path passes there.
    """
    return _Search(seeds, steps, of, goals, limit).labels()


def shortest_lengths(seeds: DataFrame, edges: DataFrame, node: DataFrame, boundary_only: bool = False, size: int = BLOCK) -> DataFrame:
    """``seed, node_id, length``: least path lengths (in x, y and depth) over edges from each seed to all nodes it reaches."""
    found = least_labels(seeds.withColumnRenamed("seed", "pair"), edge_steps(edges, node, boundary_only), blocks(node, size, FEW))
    return found.select(F.col("pair").alias("seed"), "node_id", "length")


def shortest_paths(pairs: DataFrame, edges: DataFrame, node: DataFrame, boundary_only: bool = False, size: int = BLOCK) -> DataFrame:
    """``pair, seq, node_id, length``: the nodes of a least path of each pair (``pair, start, stop``), and the length to each.

    Lengths are in x, y and depth. Of several least paths one with the fewest edges, and then from its end backwards the
    node with the smallest id. A pair without a path has no rows; one node is a path to itself. ``boundary_only`` keeps to
    edges of the boundary. Paths are read back from block to block by doubled pointers, in as many joins as the logarithm of
    the blocks crossed, and within a block by its own task.
    """
    starts, stops = (pairs.select("pair", F.col(c).alias("node_id")) for c in ("start", "stop"))
    return _Search(starts, edge_steps(edges, node, boundary_only), blocks(node, size, FEW), stops, float("inf")).paths()
