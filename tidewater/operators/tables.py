"""Joins and checks over stations, sources, sinks and parameter lists (long tables)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.operators.series import SPAN

AMBIENT = -9999.0
_NAME = r"^(delta|suisun)_(src|sink)_([0-9]+)$"


def station_subloc_merge(stations: DataFrame, sublocs: DataFrame, default_z: float = -0.5) -> DataFrame:
    """Each station with its sublocations; one without gets ``default`` at ``default_z``."""
    both = stations.join(sublocs, "station_id", "left")
    return both.withColumn("subloc", F.coalesce("subloc", F.lit("default"))).withColumn("z", F.coalesce("z", F.lit(default_z)))


def obs_lookup(wanted: DataFrame, links: DataFrame, files: DataFrame, repositories: DataFrame) -> DataFrame:
    """``station_id, subloc, variable, path``: the linked file in the first repository (by ``prio``) that has it."""
    there = links.join(files, "filename").join(repositories, "repo")
    first = there.groupBy("station_id", "subloc", "variable").agg(F.min_by("path", F.struct("prio", "path")).alias("path"))
    return wanted.join(first, ["station_id", "subloc", "variable"], "left")


def station_select(series: DataFrame, request: DataFrame, miss: str = "drop") -> DataFrame:
    """Series of the requested labels (``label, alias, ord``), renamed; of several per label and time the first (``pos``).

    Labels without a series are dropped, kept with null (``nan``) or an error (``raise``).
    """
    first = series.groupBy("label", "t").agg(F.min_by("value", "pos").alias("value"))
    out = request.join(first, "label", "left" if miss != "drop" else "inner")
    value = F.col("value")
    if miss == "raise":
        value = F.when(F.col("t").isNull(), F.raise_error(F.concat(F.lit("no series "), F.col("label"))).cast("double")).otherwise(value)
    return out.select("ord", F.coalesce("alias", "label").alias("label"), "t", value.alias("value"))


def on_all_times(values: DataFrame, names: DataFrame, times: DataFrame, span: int = SPAN) -> DataFrame:
    """``t, value`` of each of ``names`` at all ``times``: its ``values``, and null where it has none.

    Names meet spans of time, not times. What a name lacks of a span is told from two lists of times and laid out last, so
    that only rows with a value and one row for each name and span are shuffled, not the product of names and times.
    """
    c = F.col
    by = names.columns
    spanned = lambda df: df.withColumn("_span", F.floor(c("t") / span).cast("long"))
    spans = spanned(times.select("t").where("t is not null").distinct()).groupBy("_span").agg(F.collect_list("t").alias("_all"))
    held = values.select(*by, "t", "value").join(names, by, "left_semi")
    own = spanned(held).groupBy(*by, "_span").agg(F.collect_list("t").alias("_own"))
    frame = names.crossJoin(spans.select("_span")).join(own, [*by, "_span"], "left").join(spans, "_span")
    lacks = F.array_except("_all", F.coalesce("_own", F.array().cast("array<long>")))
    rest = frame.select(*by, F.explode(lacks).alias("t"), F.lit(None).cast(values.schema["value"].dataType).alias("value"))
    return held.unionByName(rest)


def concat_sources(first: DataFrame, second: DataFrame, sites: DataFrame) -> DataFrame:
    """Values (site, variable, t, value) of two source tables at the first one's times, for all sites and variables of both.

    What is missing is the ambient value. Sites and variables are lists, of which each pair is a column of the outcome.
    """
    both = first.unionByName(second)
    times, names = first.select("t").distinct(), sites.distinct().crossJoin(both.select("variable").distinct())
    at = both.join(times, "t", "left_semi").groupBy("site", "variable", "t").agg(F.max("value").alias("value"))
    return on_all_times(at, names, times).withColumn("value", F.coalesce("value", F.lit(AMBIENT)))


def merge_th(inputs: DataFrame, targets: DataFrame, start: int, end: int, rules: Sequence[tuple[str, float, bool]] = (), ambient: bool = True) -> DataFrame:
    """Stacked inputs (file_no, variable, loc, t, value) as the wanted histories (``targets``: variable, loc).

    The later file wins on the same series and time; clipped to start..end; constants by pattern on ``variable.loc``
    (pattern, value, overwrite); the rest ambient if asked.
    """
    clipped = inputs.where(F.col("t").between(start, end))
    last = clipped.groupBy("variable", "loc", "t").agg(F.max_by("value", "file_no").alias("value"))
    out = on_all_times(last, targets.select("variable", "loc").distinct(), clipped.select("t").distinct())
    name = F.concat_ws(".", "variable", "loc")
    value = F.col("value")
    for pattern, constant, overwrite in rules:
        value = F.when(F.regexp_like(name, F.lit(pattern)) & (F.lit(overwrite) | value.isNull()), F.lit(float(constant))).otherwise(value)
    return out.withColumn("value", F.coalesce(value, F.lit(AMBIENT)) if ambient else value)


def sign_violations(flows: DataFrame) -> DataFrame:
    """Sources below 0 (ambient aside) and sinks above 0, counted by series."""
    bad = ((F.col("kind") == "source") & (F.col("value") < 0) & (F.col("value") > AMBIENT)) | ((F.col("kind") == "sink") & (F.col("value") > 0))
    return flows.groupBy("kind", "loc").agg(F.count_if(bad).alias("bad")).where("bad > 0")


def missing_report(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null counts by series, and whether it has gaps or is absent entirely."""
    n = series.groupBy(*keys).agg(F.count_if(F.col("value").isNull()).alias("missing"), F.count("*").alias("n"))
    return n.where("missing > 0").select(*keys, "missing", F.when(F.col("missing") == F.col("n"), "absent").otherwise("gaps").alias("kind"))


def net_source_sink(sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Sum of sources plus sum of sinks by time; null where one side has none."""
    total = lambda df, n: df.groupBy("t").agg(F.sum("value").alias(n))
    return total(sources, "_a").join(total(sinks, "_b"), "t", "full").select("t", (F.col("_a") + F.col("_b")).alias("net"))


def point_name(name: Column) -> dict[str, Column]:
    """Prefix, role and number of a source or sink name; null if it is no such name."""
    part = lambda i: F.nullif(F.regexp_extract(name, _NAME, i), F.lit(""))
    return {"prefix": part(1), "role": part(2), "number": part(3).cast("int")}


def build_pairs(points: DataFrame) -> DataFrame:
    """``prefix, number, src, sink, reason``: sources and sinks of one number paired; the others with what is wrong."""
    named = points.withColumns(point_name(F.col("name")))
    good = named.where("prefix is not null")
    side = lambda role: good.where(F.col("role") == role).select("prefix", "number", F.col("name").alias(role))
    both = side("src").join(side("sink"), ["prefix", "number"], "full")
    reason = F.when(F.col("src").isNull(), "no source").when(F.col("sink").isNull(), "no sink")
    bad = named.where("prefix is null").select(F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("int").alias("number"), F.col("name").alias("src"), F.lit(None).cast("string").alias("sink"), F.lit("bad name").alias("reason"))
    return both.withColumn("reason", reason).unionByName(bad)


def param_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Parameters (section, name, value) that differ or stand on one side only."""
    both = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), ["section", "name"], "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def concat_points(first: DataFrame, second: DataFrame) -> DataFrame:
    """Named points of both; of one name the second's."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)))
    value = F.struct(*[c for c in first.columns if c != "name"])
    return both.groupBy("name").agg(F.max_by(value, F.col("_o")).alias("v")).select("name", "v.*")


def repeated_stations(*lists: DataFrame) -> DataFrame:
    """(id, subloc) that several rows of the lists have, with how many: a merged list must have none."""
    both = lists[0]
    for x in lists[1:]:
        both = both.unionByName(x)
    return both.groupBy("id", "subloc").agg(F.count("*").alias("n")).where("n > 1")


def missing_columns(request: DataFrame, present: DataFrame) -> DataFrame:
    """Requested names (``name, ord``) that aren't present."""
    return request.join(present.select("name").distinct(), "name", "left_anti")


def wanted_unwanted(first: int, last: int, wanted: DataFrame) -> DataFrame:
    """``block, wanted`` for every block number."""
    every = wanted.sparkSession.range(first, last + 1).withColumnRenamed("id", "block")
    return every.join(wanted.select("block", F.lit(True).alias("wanted")).distinct(), "block", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))


def ordered_distinct(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values numbered in the order they are first seen."""
    first = df.groupBy(column).agg(F.min(order).alias("_first"))
    return first.withColumn("ord", F.row_number().over(Window.orderBy("_first", column)) - 1).drop("_first")


def status_counts(report: DataFrame) -> DataFrame:
    """Counts by status, severity and in all."""
    return report.rollup("status", "severity").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def run_speed(files: DataFrame) -> DataFrame:
    """Simulated days a day of each run from output files' times (``run, sim_t, wall_t``): mean and median."""
    by = Window.partitionBy("run").orderBy("sim_t")
    d = files.withColumn("ds", F.col("sim_t") - F.lag("sim_t").over(by)).withColumn("dw", F.col("wall_t") - F.lag("wall_t").over(by)).where("ds is not null and dw > 0")
    return d.groupBy("run").agg(F.avg(F.col("ds") / F.col("dw")).alias("mean"), F.median(F.col("ds") / F.col("dw")).alias("median"))


def canopy_height(kind: Column, bin_no: Column, z: Column, fractions: Sequence[float], least: float, most: float, floating: float, emergent: float) -> Column:
    """Canopy height of vegetation kinds: 0 none, 1 a fraction of the depth within bounds, 2 floating, 3 emergent."""
    share = F.element_at(F.array(*map(F.lit, fractions)), bin_no + 1) * F.greatest(z, F.lit(0.0))
    grown = F.least(F.when(bin_no > 0, F.greatest(share, F.lit(least))).otherwise(share), F.lit(most))
    return F.when(kind == 0, 0.0).when(kind == 1, grown).when(kind == 2, floating).when(kind == 3, emergent).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), kind.cast("string"))).cast("double"))


def bin_map(value: Column, edges: Sequence[float], classes: Sequence[float]) -> Column:
    """The class of the bin a value falls in: bins begin at their edge."""
    n = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= value))
    return F.element_at(F.array(*map(F.lit, classes)), n + 1)


def bound_linear(z: Column, z_low: float, z_high: float, low: float, high: float) -> Column:
    """A ramp between two depths, level outside."""
    return F.least(F.greatest(low + (z - z_low) * (high - low) / (z_high - z_low), F.lit(min(low, high))), F.lit(max(low, high)))


def cycle_time(hour: Column, period: int, up: bool = False) -> Column:
    """The hour at or before (``up``: after) that is a multiple of ``period``, within its day."""
    return ((F.ceil(hour / period) if up else F.floor(hour / period)) * period % 24).cast("long")
