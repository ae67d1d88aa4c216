"""Moving pairs of sources and sinks to elements that are deep enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.operators import mesh as M, spatial as P
from tidewater.operators.graph import mesh_ring
from tidewater.spool import spool

#: Kinds of asks: both ends of a pair from one point, or one end by itself.
BOTH, SOURCE, SINK = "both", "source", "sink"


def _lot(seed: int, *keys: Column) -> Column:
    """A random word that depends on the seed and the keys only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def relocate_pairs(
    pairs: DataFrame,
    elem_node: DataFrame,
    node: DataFrame,
    cell: float,
    rings: tuple[int, int] = (3, 10),
    least: float = 0.0,
    mean: float = 1.0,
    random_from: float = 2.0,
    apart: float = 0.01,
    move_both: bool = True,
    within: float | None = 100.0,
    seed: int = 0,
) -> DataFrame:
    """``pair_id, status, severity, xs, ys, xn, yn, source_elem, sink_elem, rings_used, snapped`` of ``pairs`` (``pair_id, xs, ys, xn, yn``).

    An element will do if its corners are ``least`` deep and ``mean`` on average, and its centre is ``within`` of where
    the search began: the point, or the centre of the nearest element for a point outside the mesh (``snapped``).

    Ends no more than ``apart`` apart go to two different elements drawn by lot from the first, then the second number of
    rings around their midpoint's element (with ``move_both`` that one is used only if there is but one other; else one
    end stays there if it is deep enough). The shallower is the source, by lot if the deeper has ``random_from``.
    Where there is no such pair the two deepest elements of the last rings are taken (status ``failed``, severity
    ``soft``; ``hard`` where there is only one). Ends farther apart are looked at one by one: one in an element that will
    do stays (``separated`` if both do), others go to the deepest element that will do, or the deepest.
    """
    where = lambda side, x, y: F.struct(F.lit(side).alias("side"), x.alias("x"), y.alias("y"))
    c = F.col
    two = F.array(where(SOURCE, c("xs"), c("ys")), where(SINK, c("xn"), c("yn")))
    one = F.array(where(BOTH, (c("xs") + c("xn")) / 2, (c("ys") + c("yn")) / 2))
    far = F.sqrt((c("xs") - c("xn")) ** 2 + (c("ys") - c("yn")) ** 2) > apart
    asks = pairs.select("pair_id", F.explode(F.when(far, two).otherwise(one)).alias("a")).select("pair_id", F.concat_ws(":", "pair_id", "a.side").alias("point_id"), "a.*")
    geometry = spool(M.elem_geometry(elem_node, node).select("elem_id", c("mx").alias("cx"), c("my").alias("cy"), "depth_min", c("depth_mean").alias("depth")))
    deep = (c("depth_min") >= least) & (c("depth") >= mean)
    own = asks.join(P.snap_points(asks, elem_node, node, cell), "point_id").join(geometry, "elem_id").withColumn("deep", deep)
    own = spool(own.withColumns({"ox": F.when(c("snapped"), c("cx")).otherwise(c("x")), "oy": F.when(c("snapped"), c("cy")).otherwise(c("y"))}))
    facts = ["point_id", "pair_id", "side", "snapped"]
    spot = lambda e, z, x, y: F.struct(e.alias("elem"), z.alias("depth"), x.alias("x"), y.alias("y"))
    here = spot(c("elem_id"), c("depth"), F.when(c("snapped"), c("cx")).otherwise(c("x")), F.when(c("snapped"), c("cy")).otherwise(c("y")))
    single = (c("side") != BOTH) & c("deep")
    stays = F.when(c("snapped"), "relocated").otherwise("separated")
    done = [own.where(single).select(*facts, stays.alias("status"), F.lit(None).cast("string").alias("severity"), F.lit(0).alias("rings_used"), here.alias("p"), F.lit(None).cast("struct<elem:bigint,depth:double,x:double,y:double>").alias("q"))]
    left = own.where(~single)
    for i, n in enumerate(rings):
        around = mesh_ring(left.select(c("point_id").alias("seed"), "elem_id"), elem_node, n).select(c("seed").alias("point_id"), c("elem_id").alias("elem"))
        near = around.join(geometry.withColumnRenamed("elem_id", "elem"), "elem").join(left.select(*facts, c("elem_id").alias("start"), c("deep").alias("start_deep"), "ox", "oy", c("cx").alias("sx"), c("cy").alias("sy"), c("depth").alias("sz")), "point_id")
        close = F.lit(True) if within is None else F.sqrt((c("cx") - c("ox")) ** 2 + (c("cy") - c("oy")) ** 2) <= within
        at = spot(c("elem"), c("depth"), c("cx"), c("cy"))
        by_lot = F.struct(_lot(seed, c("pair_id"), c("elem")).alias("lot"), at.alias("at"))
        by_depth = F.struct((-c("depth")).alias("rank"), c("elem").alias("tie"), at.alias("at"))
        near = near.withColumn("fits", deep & close)
        best = near.groupBy(*facts, "start", "start_deep", "sx", "sy", "sz").agg(
            F.slice(F.array_sort(F.collect_list(F.when(c("fits") & (c("elem") != c("start")), by_lot))), 1, 2).alias("drawn"),
            F.min(F.when(c("fits"), by_depth)).alias("deepest"),
            F.slice(F.array_sort(F.collect_list(by_depth)), 1, 2).alias("any"),
        )
        start = spot(c("start"), c("sz"), c("sx"), c("sy"))
        first, second = F.get("drawn", F.lit(0))["at"], F.get("drawn", F.lit(1))["at"]
        with_start = c("start_deep") & first.isNotNull() & (F.lit(not move_both) | second.isNull())
        a = F.when(with_start, start).when(second.isNotNull() & (F.lit(move_both) | ~c("start_deep")), first)
        b = F.when(with_start, first).when(second.isNotNull() & (F.lit(move_both) | ~c("start_deep")), second)
        deeper_first = F.when(F.greatest(a["depth"], b["depth"]) >= random_from, _lot(seed, c("pair_id")) >= "8").otherwise(a["depth"] >= b["depth"])
        p = F.when(c("side") == BOTH, F.when(deeper_first, b).otherwise(a)).otherwise(c("deepest.at"))
        q = F.when(c("side") == BOTH, F.when(deeper_first, a).otherwise(b))
        best = spool(best.withColumns({"p": p, "q": q}))
        done.append(best.where("p is not null").select(*facts, F.lit("relocated").alias("status"), F.lit(None).cast("string").alias("severity"), F.lit(n).alias("rings_used"), "p", "q"))
        missed = best.where("p is null")
        if i + 1 < len(rings):
            left = left.join(missed.select("point_id"), "point_id", "left_semi")
            continue
        sink, source = F.get("any", F.lit(0))["at"], F.coalesce(F.get("any", F.lit(1))["at"], F.get("any", F.lit(0))["at"])
        both = c("side") == BOTH
        severity = F.when(both & (F.size("any") < 2), "hard").otherwise("soft")
        done.append(missed.select(*facts, F.lit("failed").alias("status"), severity.alias("severity"), F.lit(n).alias("rings_used"), F.when(both, source).otherwise(sink).alias("p"), F.when(both, sink).alias("q")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return _put_together(spool(out))


def _put_together(ends: DataFrame) -> DataFrame:
    """One row a pair of its one or two asks: the worse status counts, and the larger number of rings."""
    c = F.col
    of = lambda side, spot: F.max(F.when(c("side") == side, c(spot)))
    worst = F.max(F.when(c("status") == "failed", 2).when(c("status") == "relocated", 1).otherwise(0))
    own = ends.groupBy("pair_id").agg(
        worst.alias("w"),
        F.min("severity").alias("severity"),
        F.max("rings_used").alias("rings"),
        F.max(F.when(c("status") == "failed", c("rings_used"))).alias("failed_rings"),
        F.max("snapped").alias("snapped"),
        F.coalesce(of(BOTH, "p"), of(SOURCE, "p")).alias("s"),
        F.coalesce(of(BOTH, "q"), of(SINK, "p")).alias("n"),
    )
    status = F.element_at(F.array(F.lit("separated"), F.lit("relocated"), F.lit("failed")), c("w") + 1)
    moved = lambda spot: F.when(c("w") > 0, c(spot))
    return own.select(
        "pair_id", status.alias("status"), "severity", c("s.x").alias("xs"), c("s.y").alias("ys"), c("n.x").alias("xn"), c("n.y").alias("yn"),
        moved("s.elem").alias("source_elem"), moved("n.elem").alias("sink_elem"), F.coalesce("failed_rings", "rings").alias("rings_used"), "snapped",
    )
