"""Time series in long form: keys, ``t`` (microseconds), ``value``.

Every window is cut into spans of time as well as by series (``SPAN``), with what a span needs from the one before it
carried over a table of one row a span, so that one long series is the work of many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: 16 days.
SPAN = 16 * 86_400_000_000


def _span(t: str, span: int) -> Column:
    return F.floor(F.col(t) / span).cast("long")


def last_known(df: DataFrame, keys: Sequence[str], what: str, out: str, t: str = "t", span: int = SPAN, first: Column | None = None) -> DataFrame:
    """Adds ``out``: ``t`` and value of the last row at or before each row whose ``what`` is not null (a struct).

    Rows of one series and time must be one, or be told apart by ``first``: the smaller one comes first.
    """
    return _carried(df, keys, what, out, t, span, first, forward=True)


def next_known(df: DataFrame, keys: Sequence[str], what: str, out: str, t: str = "t", span: int = SPAN) -> DataFrame:
    """Adds ``out``: the first row at or after each row whose ``what`` is not null."""
    return _carried(df, keys, what, out, t, span, None, forward=False)


def _carried(df, keys, what, out, t, span, first, forward):
    own = df.withColumn("_span", _span(t, span))
    pair = F.when(F.col(what).isNotNull(), F.struct(F.col(t).alias("t"), F.col(what).alias("v")))
    order = F.col(t) if forward else F.col(t).desc()
    near = F.last(pair, ignorenulls=True).over(Window.partitionBy(*keys, "_span").orderBy(order, *([] if first is None else [first])).rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("_near", near)
    edge = (F.max_by if forward else F.min_by)(pair, F.when(F.col(what).isNotNull(), F.col(t)))
    spans = own.groupBy(*keys, "_span").agg(edge.alias("_edge"))
    before = Window.partitionBy(*keys).orderBy(F.col("_span") if forward else F.col("_span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "_span", F.last("_edge", ignorenulls=True).over(before).alias("_edge"))
    return own.join(spans, [*keys, "_span"]).withColumn(out, F.coalesce("_near", "_edge")).drop("_span", "_near", "_edge")


def known_around(df: DataFrame, keys: Sequence[str], what: str, before: str, after: str, t: str = "t", span: int = SPAN, facts: dict[str, tuple[str, Column]] | None = None, first: Column | None = None) -> DataFrame:
    """Adds ``before`` and ``after``, as ``last_known`` and ``next_known`` do, dealt out once.

    Of rows of one series and time the one with the smaller ``first`` counts for the others, both ways.

    ``facts`` are aggregates over all rows of a series to add besides: they are made from those of its spans. Each must be
    a sum, least or largest of a column, and is told by ``("sum" | "min" | "max", column)``.
    """
    own = df.withColumn("_span", _span(t, span))
    pair = F.when(F.col(what).isNotNull(), F.struct(F.col(t).alias("t"), F.col(what).alias("v")))
    # Both frames grow from their first row: one that shrinks would be worked out anew for each row.
    upto = lambda order: Window.partitionBy(*keys, "_span").orderBy(order, *([] if first is None else [first])).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({"_near_a": F.last(pair, ignorenulls=True).over(upto(F.col(t))), "_near_b": F.last(pair, ignorenulls=True).over(upto(F.col(t).desc()))})
    known = F.when(F.col(what).isNotNull(), F.col(t))
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    parts = [kinds[k](c).alias(f"_{n}") for n, (k, c) in (facts or {}).items()]
    spans = own.groupBy(*keys, "_span").agg(F.max_by(pair, known).alias("_last"), F.min_by(pair, known).alias("_first"), *parts)
    along, whole = Window.partitionBy(*keys).orderBy("_span"), Window.partitionBy(*keys)
    ahead, behind = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "_span", F.last("_last", ignorenulls=True).over(ahead).alias("_edge_a"), F.last("_first", ignorenulls=True).over(behind).alias("_edge_b"), *[kinds[k](f"_{n}").over(whole).alias(n) for n, (k, _) in (facts or {}).items()])
    both = own.join(spans, [*keys, "_span"]).withColumns({before: F.coalesce("_near_a", "_edge_a"), after: F.coalesce("_near_b", "_edge_b")})
    return both.drop("_span", "_near_a", "_near_b", "_edge_a", "_edge_b")


def row_before(df: DataFrame, keys: Sequence[str], what: Column, out: str, t: str = "t", span: int = SPAN) -> DataFrame:
    """Adds ``out``: a struct with ``v``, ``what`` of the row before in time; null at a series' first row.

    Rows are put in order within spans; a span's first row takes the last one of the spans before.
    """
    own = df.withColumns({"_span": _span(t, span), "_v": F.struct(what.alias("v"))})
    own = own.withColumn("_in", F.lag("_v").over(Window.partitionBy(*keys, "_span").orderBy(t)))
    ahead = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    tails = own.groupBy(*keys, "_span").agg(F.max_by("_v", t).alias("_tail")).select(*keys, "_span", F.last("_tail", ignorenulls=True).over(ahead).alias("_tail"))
    return own.join(tails, [*keys, "_span"]).withColumn(out, F.coalesce("_in", "_tail")).drop("_span", "_v", "_in", "_tail")


def regular_grid(df: DataFrame, keys: Sequence[str], step: int, span: int = SPAN) -> DataFrame:
    """``keys, t``: from each series' first time, floored to ``step``, to its last, every ``step``.

    Laid out span by span, each a row of its own that is dealt out before its times are: a long series' grid is the
    work of many tasks and never one array.
    """
    ends = df.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("z"))
    wide = max(1, span // step) * step
    start = F.col("a") - F.pmod("a", F.lit(step))
    spans = ends.select(*keys, "z", F.explode(F.sequence(start, F.col("z"), F.lit(wide))).alias("_from")).repartition(*keys, "_from")
    return spans.select(*keys, F.explode(F.sequence(F.col("_from"), F.least(F.col("z"), F.col("_from") + wide - step), F.lit(step))).alias("t"))


def stretches(df: DataFrame, keys: Sequence[str], step: int, on_grid: bool = False, span: int = SPAN) -> DataFrame:
    """``keys, from, to, a, b``: the times ``from`` to ``to`` of ``regular_grid`` with the same rows ``a`` at or before and ``b`` after them.

    ``a`` and ``b`` are structs of ``t, v``, null where there is no row; rows without a value don't count, nor do those off the
    grid with ``on_grid``, but for a series' ends. Each row is put beside the next one in spans, so that what is shuffled grows
    with the rows and not with the grid, and a task sorts rows only.
    """
    c = F.col
    known = c("value").isNotNull()
    for k in keys:
        known = known & c(k).isNotNull()
    if on_grid:
        known = known & (F.pmod("t", F.lit(step)) == 0)
    own = df.where("t is not null").select(*keys, "t", F.when(known, F.struct(c("t").alias("t"), c("value").alias("v"))).alias("a"), _span("t", span).alias("_span"))
    upper = lambda t: t + F.pmod(-t, F.lit(step))
    found = own.where("a is not null").withColumn("_in", F.lead("a").over(Window.partitionBy(*keys, "_span").orderBy("t")))
    spans = own.groupBy(*keys, "_span").agg(F.min("a").alias("_first"), F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    behind, whole = Window.partitionBy(*keys).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    start = F.min("_t0").over(whole)
    spans = spans.select(*keys, "_span", F.last("_first", ignorenulls=True).over(behind).alias("_edge"), F.min("_first").over(whole).alias("_head"), F.row_number().over(Window.partitionBy(*keys).orderBy("_span")).alias("_nth"), (start - F.pmod(start, F.lit(step))).alias("_from"), F.max("_t1").over(whole).alias("_to"))
    last = lambda b: F.least(F.coalesce(b["t"] - 1, c("_to")), c("_to"))
    each = found.join(spans.select(*keys, "_span", "_edge", "_to"), [*keys, "_span"]).withColumn("b", F.coalesce("_in", "_edge"))
    each = each.select(*keys, upper(c("a.t")).alias("from"), last(c("b")).alias("to"), "a", "b")
    head = spans.where("_nth = 1").select(*keys, c("_from").alias("from"), last(c("_head")).alias("to"), F.lit(None).cast(own.schema["a"].dataType).alias("a"), c("_head").alias("b"))
    return each.unionByName(head).where("`from` <= `to`")


def laid_out(rows: DataFrame, step: int, deal: Sequence[str], span: int = SPAN) -> DataFrame:
    """``rows`` of ``stretches`` at each of their times ``t``, and ``_span`` of it: cut at spans and dealt by ``deal`` and span before they are laid out."""
    c = F.col
    cut = rows.withColumn("_span", F.explode(F.sequence(_span("from", span), _span("to", span))))
    first = F.greatest(c("from"), c("_span") * span + F.pmod(-(c("_span") * span), F.lit(step)))
    cut = cut.withColumns({"from": first, "to": F.least(c("to"), (c("_span") + 1) * span - 1)}).where("`from` <= `to`").repartition(*deal, "_span")
    return cut.withColumn("t", F.explode(F.sequence("from", "to", F.lit(step)))).drop("from", "to")


def resample_ffill(df: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """On the regular grid, the last value at or before each label; null before the first row.

    Rows are shuffled, labels are laid out after.
    """
    return laid_out(stretches(df, keys, step), step, keys).select(*keys, "t", F.col("a.v").alias("value"))


def around_grid(df: DataFrame, keys: Sequence[str], step: int, on_grid: bool = False) -> DataFrame:
    """``keys, t, _a, _b`` on the regular grid: the rows at or before and at or after each time, as structs of ``t, v``."""
    laid = laid_out(stretches(df, keys, step, on_grid), step, keys)
    return laid.select(*keys, "t", F.col("a").alias("_a"), F.when(F.col("a.t") == F.col("t"), F.col("a")).otherwise(F.col("b")).alias("_b"))


def _line() -> Column:
    """The value at ``t`` on the line from ``_a`` to ``_b``."""
    a, b = F.col("_a.v"), F.col("_b.v")
    return a + (b - a) * (F.col("t") - F.col("_a.t")) / F.nullif(F.col("_b.t") - F.col("_a.t"), F.lit(0))


def fill_gaps(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Fills at most the first ``limit`` nulls of each gap of a regular series, linearly in time.

    Trailing nulls repeat the last value (same limit); leading ones stay.
    """
    # How many rows of the gap lie before this one: rows are regular, so times tell.
    near = known_around(df, keys, "value", "_a", "_b", facts={"_t0": ("min", F.col("t")), "_t1": ("max", F.col("t")), "_rows": ("sum", F.lit(1))})
    near = near.withColumn("_step", (F.col("_t1") - F.col("_t0")) / F.greatest(F.col("_rows") - 1, F.lit(1)))
    nth = F.when(F.col("_step") > 0, F.round((F.col("t") - F.col("_a.t")) / F.col("_step")))
    a, b = F.col("_a.v"), F.col("_b.v")
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when((nth <= limit) & b.isNotNull(), _line()).when(nth <= limit, a)
    return near.select(*[c for c in df.columns if c != "value"], filled.alias("value"))


def filled_grid(df: DataFrame, keys: Sequence[str], step: int, limit: int) -> DataFrame:
    """``fill_gaps`` of the regular grid with those rows that are exactly on it: the grid is laid out where its rows are known."""
    near = around_grid(df, keys, step, on_grid=True)
    nth = (F.col("t") - F.col("_a.t")) / step
    filled = F.when(F.col("_a.t") == F.col("t"), F.col("_a.v")).when((nth <= limit) & F.col("_b").isNotNull(), _line()).when(nth <= limit, F.col("_a.v"))
    return near.select(*keys, "t", filled.alias("value"))


def resample_linear(df: DataFrame, keys: Sequence[str], step: int, limit: int) -> DataFrame:
    """On the regular grid: only rows exactly on it count, nulls between are filled linearly (first ``limit`` of a gap)."""
    return filled_grid(df, keys, step, limit)


def combine_restarts(df: DataFrame, keys: Sequence[str], prefer: str = "first") -> DataFrame:
    """Stitches overlapping files (column ``file``, ordered by their start) of a run.

    ``first``: a file begins after the end of the one before; ``last``: it ends before the start of the next. Only
    the files' ends are ordered, the rows are filtered.
    """
    ends = df.groupBy(*keys, "file").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    by = Window.partitionBy(*keys).orderBy("a", "file")
    cut = ends.select(*keys, "file", F.lag("z").over(by).alias("_prev"), F.lead("a").over(by).alias("_next"))
    own = df.join(cut, [*keys, "file"])
    keep = F.col("_prev").isNull() | (F.col("t") > F.col("_prev")) if prefer == "first" else F.col("_next").isNull() | (F.col("t") < F.col("_next"))
    return own.where(keep).drop("_prev", "_next")


def nested_files(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files that end before an earlier-starting one does: restarts can't be stitched over them."""
    ends = df.groupBy(*keys, "file").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    prev = F.max("z").over(Window.partitionBy(*keys).orderBy("a", "file").rowsBetween(Window.unboundedPreceding, -1))
    return ends.withColumn("prev_z", prev).where("z <= prev_z").drop("prev_z")


def splice(first: DataFrame, second: DataFrame, keys: Sequence[str], at: int, prefer: str = "last") -> DataFrame:
    """Two gridded series joined at a time: ``last`` takes the second from ``at`` on, ``first`` the first up to ``at``."""
    early = (F.col("t") < at) if prefer == "last" else (F.col("t") <= at)
    return first.where(early).unionByName(second.where(~early))


def check_monotonic(df: DataFrame, keys: Sequence[str], order: str, span: int = 100_000) -> DataFrame:
    """Rows whose time is not after the time of the row before (by ``order``, a dense row number)."""
    own = df.withColumn("_span", F.floor(F.col(order) / span))
    inner = F.lag("t").over(Window.partitionBy(*keys, "_span").orderBy(order))
    own = own.withColumn("_in", inner)
    tail = own.groupBy(*keys, "_span").agg(F.max_by("t", order).alias("_tail")).withColumn("_span", F.col("_span") + 1)
    prev = F.coalesce("_in", "_tail")
    return own.join(tail, [*keys, "_span"], "left").withColumn("prev_t", prev).where("t <= prev_t").drop("_span", "_in", "_tail")


def before_start(df: DataFrame, keys: Sequence[str], start: int) -> DataFrame:
    """Rows from ``start`` on, with the last row before it unless one is exactly there."""
    ends = df.groupBy(*keys).agg(F.max(F.when(F.col("t") < start, F.col("t"))).alias("_before"), F.min(F.when(F.col("t") >= start, F.col("t"))).alias("_first"))
    own = df.join(ends, keys)
    return own.where((F.col("t") >= start) | ((F.col("t") == F.col("_before")) & (F.coalesce("_first", F.lit(start + 1)) != start))).drop("_before", "_first")


def time_clip(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows within start and end, both included."""
    return df.where(F.col("t").between(start, end))


def _with_around(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each left row with ``_a`` and ``_b``, the right rows (t, v) at or before and at or after it; ordered together, dealt out once."""
    keyed = lambda df: df.dropna(subset=[*keys, "t"])
    asks = keyed(left).withColumns({"_ask": F.lit(True), "_v": F.lit(None).cast("double")})
    points = keyed(right).select(*keys, "t", F.lit(False).alias("_ask"), F.col("value").cast("double").alias("_v"))
    both = asks.unionByName(points, allowMissingColumns=True)
    return known_around(both, keys, "_v", "_a", "_b", first=F.col("_ask")).where("_ask").drop("_ask", "_v")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], direction: str = "backward") -> DataFrame:
    """Each left row with ``t`` and ``value`` (as ``r_t, r_value``) of the last right row at or before it.

    ``forward``: the first at or after; ``nearest``: the nearer one, the earlier at ties. Right rows of one series and
    time must be one, values not null. Left rows without a key or time are left out.
    """
    return _picked(_with_around(left, right, keys), direction)


def _picked(near: DataFrame, direction: str) -> DataFrame:
    a, b = F.col("_a"), F.col("_b")
    nearer = F.when(b.isNull() | (F.col("t") - F.col("_a.t") <= F.col("_b.t") - F.col("t")), a).otherwise(b)
    pick = {"backward": a, "forward": b, "nearest": nearer}[direction]
    return near.withColumn("_p", pick).withColumns({"r_t": F.col("_p.t"), "r_value": F.col("_p.v")}).drop("_a", "_b", "_p")


def as_of_grid(df: DataFrame, keys: Sequence[str], step: int, direction: str = "backward") -> DataFrame:
    """``as_of`` at the times of the series' own regular grid."""
    return _picked(around_grid(df, keys, step), direction)


def bracket_interp(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each left row with the right series' value at its time, linear between the rows around it; null outside."""
    return _between(_with_around(left, right, keys))


def _between(near: DataFrame) -> DataFrame:
    w = (F.col("t") - F.col("_a.t")) / F.nullif(F.col("_b.t") - F.col("_a.t"), F.lit(0))
    value = F.when(F.col("_a.t") == F.col("t"), F.col("_a.v")).otherwise(F.col("_a.v") + w * (F.col("_b.v") - F.col("_a.v")))
    return near.withColumn("r_value", value).drop("_a", "_b")


def bracket_grid(df: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """``bracket_interp`` at the times of the series' own regular grid."""
    return _between(around_grid(df, keys, step))


def infer_frequency(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, step, regular``: the commonest step (the smallest at ties), and whether it is the only one."""
    n = row_before(df.select(*keys, "t"), keys, F.col("t"), "_prev").withColumn("step", F.col("t") - F.col("_prev.v")).where("step is not null").groupBy(*keys, "step").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min_by("step", F.struct(-F.col("n"), F.col("step"))).alias("step"), (F.count("*") == 1).alias("regular"))


def merge_blocks(ranges: DataFrame, first: int, last: int, span: int = 4096) -> DataFrame:
    """``a, b`` block ranges clamped to ``first..last``, overlapping and touching ones merged; with the rest between.

    Columns ``a, b, wanted``. Ranges are put in order within spans of ``span`` blocks; what a span needs from those before,
    the largest end and the number of merged ranges, comes from a table of one row a span.
    """
    c = F.col
    own = ranges.where((c("b") >= first) & (c("a") <= last)).select(F.greatest("a", F.lit(first)).alias("a"), F.least("b", F.lit(last)).alias("b")).distinct()
    own = own.withColumn("_span", F.floor(c("a") / span))
    by = Window.partitionBy("_span").orderBy("a", "b")
    along = Window.orderBy("_span")
    ahead = along.rowsBetween(Window.unboundedPreceding, -1)
    tops = own.groupBy("_span").agg(F.max("b").alias("_b")).select("_span", F.max("_b").over(ahead).alias("_edge"))
    own = own.join(tops, "_span").withColumn("_top", F.greatest(F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1)), "_edge"))
    own = own.withColumn("_new", (c("_top").isNull() | (c("a") > c("_top") + 1)).cast("int"))
    counts = own.groupBy("_span").agg(F.sum("_new").alias("_n")).select("_span", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    own = own.join(counts, "_span").withColumn("_i", c("_before") + F.sum("_new").over(by))
    wanted = own.groupBy("_i").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("a", "b")
    gap = own.where("_new = 1").select((F.coalesce("_top", F.lit(first - 1)) + 1).alias("a"), (c("a") - 1).alias("b"))
    end = own.agg((F.coalesce(F.max("b"), F.lit(first - 1)) + 1).alias("a")).select("a", F.lit(last).alias("b"))
    rest = gap.unionByName(end).where("a <= b")
    return wanted.withColumn("wanted", F.lit(True)).unionByName(rest.withColumn("wanted", F.lit(False)))


def combine_columns(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums by time of named groups of series (``groups``: name, group); nulls are skipped, none gives 0."""
    return df.join(groups, "name").groupBy("group", "t").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def minmax_normalize(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(value - min) / (max - min); a constant series gives 1 if it isn't 0, else 0."""
    ends = df.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("value") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    flat = F.when(F.col("value").isNotNull(), F.when(F.col("value") != 0, 1.0).otherwise(0.0))
    return df.join(ends, keys).withColumn("value", F.when(F.col("_hi") > F.col("_lo"), scaled).otherwise(flat)).drop("_lo", "_hi")


def openness(df: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """Product of the normalized columns (``name``) of a structure at each time, forward-filled to ``step``.

    A column's ends come from its rows that stand at some time; all columns of a structure are laid out in one place.
    """
    rows = stretches(df, [*keys, "name"], step).withColumn("value", F.col("a.v")).drop("a", "b")
    each = laid_out(minmax_normalize(rows, [*keys, "name"]), step, keys)
    return each.groupBy(*keys, "_span", "t").agg(F.product("value").alias("up"), (-F.product("value")).alias("down")).drop("_span")


def daily_mean(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    day = 86_400_000_000
    return df.groupBy(*keys, (F.col("t") - F.pmod("t", F.lit(day))).alias("t")).agg(F.avg("value").alias("value"))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation; null where one of both is constant, for which Spark's own divides by zero."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)), F.lit(0.0)))


def skill_scores(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMSE, bias, Nash-Sutcliffe efficiency, Willmott's index and correlation of ``sim`` and ``obs`` at common times."""
    both = pairs.where("sim is not null and obs is not null")
    mean = both.groupBy(*keys).agg(F.avg("obs").alias("_m"))
    d = F.col("sim") - F.col("obs")
    spread = F.abs(F.col("sim") - F.col("_m")) + F.abs(F.col("obs") - F.col("_m"))
    sums = both.join(mean, keys).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(d).alias("bias"),
        F.sum(d * d).alias("_se"),
        F.sum((F.col("obs") - F.col("_m")) * (F.col("obs") - F.col("_m"))).alias("_so"),
        F.sum(spread * spread).alias("_sw"),
        correlation("sim", "obs").alias("corr"),
    )
    part = lambda c: 1 - F.try_divide("_se", F.when(F.col(c) > 1e-12, F.col(c)))
    corr = F.when(F.isnan("corr"), None).otherwise(F.col("corr"))
    return sums.select(*keys, "n", "rmse", "bias", part("_so").alias("nse"), part("_sw").alias("willmott"), corr.alias("corr"))


def regression_line(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.regr_slope("sim", "obs").alias("slope"), F.regr_intercept("sim", "obs").alias("intercept"))


def best_lag(sim: DataFrame, obs: DataFrame, keys: Sequence[str], step: int, most: int) -> DataFrame:
    """The shift of ``sim`` (within ``most`` steps) with the highest correlation, null if it lies on the limit.

    Each obs row meets ``2 * most + 1`` shifted times; sums for the correlations are made before the shuffle.
    """
    lags = obs.select(*keys, F.col("value").alias("obs"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"), "t").withColumn("t", F.col("t") + F.col("lag") * step)
    both = lags.join(sim.select(*keys, "t", F.col("value").alias("sim")), [*keys, "t"])
    each = both.groupBy(*keys, "lag").agg(F.round(correlation("sim", "obs"), 6).alias("r"), F.count("*").alias("n")).where("n >= 3 and r is not null and not isnan(r)")
    top = each.groupBy(*keys).agg(F.max_by("lag", F.struct("r", -F.abs("lag"), "lag")).alias("lag"), F.max("r").alias("r"))
    return top.select(*keys, F.when(F.abs("lag") < most, F.col("lag")).alias("lag"), "r")


def datum_adjust(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``obs`` moved by the difference of the whole series' means, where both have rows."""
    mean = pairs.groupBy(*keys).agg((F.avg("sim") - F.avg("obs")).alias("_d"))
    return pairs.join(mean, keys).withColumn("obs", F.col("obs") + F.coalesce("_d", F.lit(0.0))).drop("_d")


def stokes_drift(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(mean(uh) - mean(u) mean(h)) / (max|u - mean| max|h - mean|) of ``u`` and ``h``; null where one is constant."""
    mean = df.groupBy(*keys).agg(F.avg("u").alias("_u"), F.avg("h").alias("_h"), F.avg(F.col("u") * F.col("h")).alias("_uh"))
    far = df.join(mean, keys).groupBy(*keys, "_u", "_h", "_uh").agg(F.max(F.abs(F.col("u") - F.col("_u"))).alias("_mu"), F.max(F.abs(F.col("h") - F.col("_h"))).alias("_mh"))
    scale = F.col("_mu") * F.col("_mh")
    return far.select(*keys, F.try_divide(F.col("_uh") - F.col("_u") * F.col("_h"), F.when(scale > 1e-9, scale)).alias("drift"))


def time_gaps(df: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """``keys, from_t, to_t``: consecutive times that are not one ``step`` apart."""
    told = row_before(df.select(*keys, "t"), keys, F.col("t"), "_prev")
    return told.select(*keys, F.col("_prev.v").alias("from_t"), F.col("t").alias("to_t")).where(F.col("to_t") - F.col("from_t") != step)


def distinct_states(df: DataFrame, keys: Sequence[str], columns: Sequence[str], consecutive_only: bool = False) -> DataFrame:
    """Rows of a structure's history without repeats of the same state: the first of each kept.

    The time between is ignored, so a return to an earlier state is dropped as well;
    ``consecutive_only`` keeps it.
    """
    if consecutive_only:
        told = row_before(df, keys, F.struct(*columns), "_p")
        return told.where(F.col("_p").isNull() | ~F.struct(*columns).eqNullSafe(F.col("_p.v"))).drop("_p")
    return df.groupBy(*keys, *columns).agg(F.min("t").alias("t")).select(*df.columns)


def elapsed_to_t(elapsed: Column, basis: int, factor: int = 1) -> Column:
    """Elapsed seconds (``factor`` 1) or days (86400) after ``basis``, rounded half to even to the second."""
    return (F.rint(elapsed * factor).cast("long") * 1_000_000) + basis


def to_elapsed(t: Column, start: Column) -> Column:
    return (t - start) / 1e6


def mask_sentinel(value: Column, at_most: float = -999.0) -> Column:
    return F.when(value > at_most, value)


def to_si(value: Column, unit: Column) -> Column:
    """ft to m, cfs to m3/s, degF to degC, EC (microsiemens at 25 degrees) to practical salinity; others pass if known."""
    known = ["ft", "cfs", "degF", "ec", "m", "cms", "degC", "psu", "mg/L"]
    return (
        F.when(unit == "ft", value * 0.3048)
        .when(unit == "cfs", value * 0.028316846592)
        .when(unit == "degF", (value - 32) * 5 / 9)
        .when(unit == "ec", salinity(value))
        .when(unit.isin(*known), value)
        .when(unit.isNull() | (unit == ""), value)
        .otherwise(F.raise_error(F.concat(F.lit("unknown unit "), unit)).cast("double"))
    )


def salinity(ec: Column) -> Column:
    """Practical salinity from specific conductance at 25 degrees (Schemel 2001)."""
    r = ec / 53087.0
    root = F.sqrt(r)
    return 0.0120 - 0.2174 * root + 25.3283 * r + 13.7714 * r * root - 6.4788 * r * r + 2.5842 * r * r * root


#: Records of a regular series that a spline is laid through at a time, and those before and after that it takes in besides.
SPLINE, HALO = 1000, 200


def spline_values(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A cubic spline through even ``x`` (four or more), with the third derivative going on over the second and last but one."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x - x[0], y, n - 1), at - x[0])
    h = x[1] - x[0]
    # Second derivatives m: inner rows m[i-1] + 4 m[i] + m[i+1] = 6 second differences / h^2; ends by m[0] = 2 m[1] - m[2].
    rhs = 6 * (y[:-2] - 2 * y[1:-1] + y[2:]) / h**2
    diag, upper, lower = np.full(n - 2, 4.0), np.ones(n - 2), np.ones(n - 2)
    diag[0] = diag[-1] = 6.0
    upper[0] = lower[-1] = 0.0
    for i in range(1, n - 2):
        w = lower[i] / diag[i - 1]
        diag[i] -= w * upper[i - 1]
        rhs[i] -= w * rhs[i - 1]
    m = np.zeros(n)
    for i in range(n - 3, -1, -1):
        m[i + 1] = (rhs[i] - (upper[i] * m[i + 2] if i < n - 3 else 0)) / diag[i]
    m[0], m[-1] = 2 * m[1] - m[2], 2 * m[-2] - m[-3]
    i = np.clip(((at - x[0]) / h).astype(np.int64), 0, n - 2)
    a, b = (x[i + 1] - at) / h, (at - x[i]) / h
    return a * y[i] + b * y[i + 1] + ((a**3 - a) * m[i] + (b**3 - b) * m[i + 1]) * h**2 / 6


def tide_spline(df: DataFrame, keys: Sequence[str], every: int, step: int, chunk: int = SPLINE, halo: int = HALO) -> DataFrame:
    """``keys, t, value`` every ``step`` of regular series (a record ``every`` microseconds), by cubic splines.

    A series is cut into pieces of ``chunk`` records, each of which takes in ``halo`` more on both sides: pieces are
    tasks of their own and hardly differ from a spline through the whole series. A series must have all
    its records: fill gaps first.
    """
    ends = df.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_z"))
    own = df.where("value is not null").join(ends, list(keys)).withColumn("_i", F.floor((F.col("t") - F.col("_a")) / every))
    piece = F.floor(F.col("_i") / chunk)
    near = F.array_distinct(F.array(piece, F.floor((F.col("_i") - halo) / chunk), F.floor((F.col("_i") + halo) / chunk)))
    last = F.floor((F.col("_z") - F.col("_a")) / every / chunk)
    dealt = own.withColumn("_piece", F.explode(near)).where((F.col("_piece") >= 0) & (F.col("_piece") <= last))
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + ["t long", "value double"])

    def lay(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("t")
        first, end, p = int(x["_a"].iloc[0]), int(x["_z"].iloc[0]), int(x["_piece"].iloc[0])
        start, stop = first + p * chunk * every, min(end + 1, first + (p + 1) * chunk * every)
        at = np.arange(start, stop, step)
        t = x["t"].to_numpy()
        value = spline_values((t - start) / every, x["value"].to_numpy(), (at - start) / every)
        return pd.DataFrame({k: x[k].iloc[0] for k in keys} | {"t": at, "value": value})

    return dealt.groupBy(*keys, "_piece").applyInPandas(lay, schema)
