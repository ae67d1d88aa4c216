"""Iteration over mesh neighbours. Smoothing is done block by block, many rounds between two shuffles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.operators.blocks import BLOCK, blocks
from tidewater.operators.paths import least_labels
from tidewater.spool import drop_spool, spool

#: Rounds done in a block between two shuffles, and so the rings of nodes around it that it holds besides its own.
RINGS = 50


class Ring:
    """The neighbours of a block's nodes, by their place among them."""

    def __init__(self, row: np.ndarray, nbr: np.ndarray, n: int):
        self.row, self.nbr, self.n = row, nbr, n

    def mean(self, values: np.ndarray) -> np.ndarray:
        """Mean of ``values`` (one for each pair of neighbours) by node, missing ones left out; missing where there is none."""
        there = ~np.isnan(values)
        count = np.bincount(self.row[there], minlength=self.n)
        total = np.bincount(self.row[there], weights=values[there], minlength=self.n)
        return np.divide(total, count, out=np.full(self.n, np.nan), where=count > 0)

    def blend(self, own: np.ndarray, near: np.ndarray, share) -> np.ndarray:
        """``own`` moved by ``share`` of the way to the mean of the neighbours' values; it stays where there are none."""
        mean = self.mean(near)
        return np.where(np.isnan(mean), own, own + share * (mean - own))


def _packed(nbrs: DataFrame, of: DataFrame, rings: int) -> DataFrame:
    """``block, nodes, own, row, nbr``: a row for each block with its nodes and those up to ``rings`` around, and their neighbours.

    Nodes around are found by the steps to a block's border, in rounds that grow with the blocks within ``rings``.
    """
    c = F.col
    links = spool(nbrs.select(c("node_id").alias("a"), c("nbr").alias("b")).distinct())
    place = lambda end, name: of.select(c("node_id").alias(end), c("block").alias(name))
    border = links.join(place("a", "pair"), "a").join(place("b", "to"), "b").where("pair <> to").select(c("pair").cast("long").alias("pair"), c("a").alias("node_id")).distinct()
    around = least_labels(border, links.withColumn("step", F.lit(1.0)), of, limit=float(rings)).select(c("pair").cast("int").alias("block"), "node_id")
    members = spool(of.select("block", "node_id", F.lit(True).alias("own")).unionByName(around.join(of, ["block", "node_id"], "left_anti").withColumn("own", F.lit(False))))
    pairs = members.select(c("block").alias("at"), c("node_id").alias("a")).join(links, "a").select("at", "a", "b")

    def pack(key: tuple, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node_id")
        nodes = own["node_id"].to_numpy()
        at = np.searchsorted(nodes, near["b"].to_numpy())
        known = (at < len(nodes)) & (nodes[np.minimum(at, len(nodes) - 1)] == near["b"].to_numpy())
        row = np.searchsorted(nodes, near["a"].to_numpy())
        return pd.DataFrame({"block": [key[0]], "nodes": [nodes], "own": [own["own"].to_numpy()], "row": [row[known].astype(np.int32)], "nbr": [at[known].astype(np.int32)]})

    packed = members.groupBy("block").cogroup(pairs.groupBy("at")).applyInPandas(pack, "block int, nodes array<long>, own array<boolean>, row array<int>, nbr array<int>")
    return spool(packed)


def in_blocks(state: DataFrame, nbrs: DataFrame, of: DataFrame, advance: Callable[[pd.DataFrame, Ring, int], pd.DataFrame], rounds: int, rings: int = RINGS) -> DataFrame:
    """``state`` (node_id and more) after ``rounds``, some of them done by each call of ``advance``, which has all nodes of a block and their ``Ring``.

    A round looks at neighbours only, so a block that holds ``rings`` more rings of nodes around it gets its own ones right
    for as many rounds. Then each node's new state goes to the blocks that hold it: a join by node and a grouping by block
    every ``rings`` rounds. The outcome is that of one round after the other. ``of``: node_id, block; nodes without a
    block are left out.
    """
    rings = max(1, min(rings, rounds))
    packed = _packed(nbrs, of, rings)
    held = spool(packed.select("block", F.explode("nodes").alias("node_id")))
    now = state

    def some(n: int):
        def run(own: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            nodes, mine, row, nbr = (np.asarray(block[c].iloc[0]) for c in ("nodes", "own", "row", "nbr"))
            own = own.set_index("node_id").reindex(nodes).rename_axis("node_id").reset_index()
            own = advance(own, Ring(row, nbr, len(nodes)), n)
            there = np.asarray(mine, bool) & own["_here"].notna().to_numpy()
            return own.loc[there].drop(columns=["block", "_here"])

        return run

    for done in range(0, rounds, rings):
        placed = held.join(now, "node_id").withColumn("_here", F.lit(1))
        nxt = spool(placed.groupBy("block").cogroup(packed.groupBy("block")).applyInPandas(some(min(rings, rounds - done)), state.schema))
        if done:
            drop_spool(now)
        now = nxt
    return now


def laplace_smooth(
    value: DataFrame,
    nbrs: DataFrame,
    kappa: float = 0.05,
    dt: float = 1.0,
    rounds: int = 150,
    velocity: DataFrame | None = None,
    node: DataFrame | None = None,
    size: int = BLOCK,
    rings: int = RINGS,
) -> DataFrame:
    """Jacobi smoothing of ``value`` (node_id, value): v += kappa dt (mean of neighbours - v) [+ dt vel].

    ``nbrs``: node_id, nbr. A node without neighbours keeps its value. ``node`` (node_id, x, y) tells which nodes lie
    near each other; without it their ids do. Blocks of ``size`` nodes do ``rings`` rounds between two shuffles.
    """
    state = value.select("node_id", F.col("value").cast("double").alias("value"))
    if velocity is not None:
        state = state.join(velocity.select("node_id", F.col("value").alias("vel")), "node_id", "left").select("node_id", "value", F.coalesce("vel", F.lit(0.0)).alias("vel"))

    def advance(own: pd.DataFrame, ring: Ring, n: int) -> pd.DataFrame:
        v = own["value"].to_numpy()
        for _ in range(n):
            v = ring.blend(v, v[ring.nbr], kappa * dt)
            if "vel" in own:
                v = v + dt * own["vel"].to_numpy()
        return own.assign(value=v)

    return in_blocks(state, nbrs, blocks(node if node is not None else value, size), advance, rounds, rings).select("node_id", "value")


def laplace_rounds(value: DataFrame, nbrs: DataFrame, share: float, rounds: int) -> DataFrame:
    """``laplace_smooth`` for a few rounds (``share`` being kappa dt): each is a join by neighbour and one by node, and no blocks are laid out."""
    links = spool(nbrs.select("node_id", "nbr").distinct())
    now = spool(value.select("node_id", F.col("value").cast("double").alias("value")))
    for _ in range(rounds):
        near = now.where("not isnan(value)").select(F.col("node_id").alias("nbr"), F.col("value").alias("near"))
        mean = links.join(near, "nbr").groupBy("node_id").agg(F.avg("near").alias("mean"))
        moved = F.coalesce(F.col("value") + share * (F.col("mean") - F.col("value")), "value")
        nxt = spool(now.join(mean, "node_id", "left").select("node_id", moved.alias("value")))
        drop_spool(now)
        now = nxt
    drop_spool(links)
    return now


def ring_distance(seeds: DataFrame, nbrs: DataFrame, most: int) -> DataFrame:
    """``seed, node_id, ring``: hops from each seed's nodes, up to ``most``; all seeds in one loop."""
    found = seeds.select("seed", "node_id", F.lit(0).alias("ring")).distinct()
    front = found
    for i in range(1, most + 1):
        step = front.join(nbrs, "node_id").select("seed", F.col("nbr").alias("node_id")).distinct()
        front = spool(step.join(found, ["seed", "node_id"], "left_anti").withColumn("ring", F.lit(i)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
        front = front.select("seed", "node_id")
    return found


def mesh_ring(seeds: DataFrame, elem_node: DataFrame, most: int) -> DataFrame:
    """``seed, elem_id, ring``: elements within ``most`` hops over shared nodes of each seed's element."""
    found = seeds.select("seed", "elem_id", F.lit(0).alias("ring")).distinct()
    front = found
    for i in range(1, most + 1):
        nodes = front.join(elem_node, "elem_id").select("seed", "node_id").distinct()
        step = nodes.join(elem_node, "node_id").select("seed", "elem_id").distinct()
        front = spool(step.join(found, ["seed", "elem_id"], "left_anti").withColumn("ring", F.lit(i)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
        front = front.select("seed", "elem_id")
    return found


def boundary_taper(ring: DataFrame, base: DataFrame, target: float, width: int) -> DataFrame:
    """``node_id, value``: blended to ``target`` near the seeds: w = (1 - cos(pi clip((R - d) / R))) / 2."""
    near = ring.groupBy("node_id").agg(F.min("ring").alias("d"))
    share = F.greatest(F.least((width - F.coalesce("d", F.lit(width))) / float(width), F.lit(1.0)), F.lit(0.0))
    w = (1 - F.cos(F.pi() * share)) / 2
    return base.join(near, "node_id", "left").select("node_id", (F.col("value") * (1 - w) + target * w).alias("value"))


def interface_smooth(level: DataFrame, nbrs: DataFrame, alpha: Column, depth: DataFrame, rounds: int, node: DataFrame | None = None, size: int = BLOCK, rings: int = RINGS) -> DataFrame:
    """Jacobi over interface heights ``level`` (node_id, k, h), neighbours without the level standing at their ``depth``.

    ``alpha``, of the columns of ``level``, is the share by which a height moves to its neighbours' mean. Blocks as in
    ``laplace_smooth``; a node's levels go together.
    """
    columns = level.withColumn("_a", alpha.cast("double")).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("k", "h", "_a"))).alias("c"))
    each = lambda name, kind: F.transform("c", lambda x: x[name]).cast(f"array<{kind}>").alias(name)
    state = depth.select("node_id", F.col("depth").cast("double").alias("depth")).join(columns.select("node_id", each("k", "int"), each("h", "double"), each("_a", "double")), "node_id", "left")

    def advance(own: pd.DataFrame, ring: Ring, n: int) -> pd.DataFrame:
        sizes = np.array([len(k) if isinstance(k, np.ndarray) else 0 for k in own["k"]])
        row = np.repeat(np.arange(len(own)), sizes)
        k, h, a = (np.concatenate([np.array([]), *(x for x in own[name] if isinstance(x, np.ndarray))]) for name in ("k", "h", "_a"))
        k = k.astype(int)
        grid, share = (np.full((len(own), k.max(initial=-1) + 1), np.nan) for _ in range(2))
        grid[row, k], share[row, k] = h, a
        there, bed = ~np.isnan(grid), own["depth"].to_numpy()
        for _ in range(n):
            near = [np.where(there[ring.nbr, i], grid[ring.nbr, i], bed[ring.nbr]) for i in range(grid.shape[1])]
            grid = np.column_stack([np.where(there[:, i], ring.blend(grid[:, i], x, share[:, i]), np.nan) for i, x in enumerate(near)]) if near else grid
        parts = np.split(grid[row, k], np.cumsum(sizes)[:-1])
        return own.assign(h=pd.Series([p if len(p) else None for p in parts], index=own.index, dtype=object))

    done = in_blocks(state, nbrs, blocks(node if node is not None else depth, size), advance, rounds, rings)
    return done.where("k is not null").select("node_id", F.explode(F.arrays_zip("k", "h")).alias("z")).select("node_id", F.col("z.k").cast(level.schema["k"].dataType).alias("k"), "z.h")
