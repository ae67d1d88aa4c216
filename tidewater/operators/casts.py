"""Casts, masked columns, daily blocks and fields composed by region."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.operators.tables import station_select
from tidewater.operators.vertical import profile_at


def profile_regrid(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, z, value`` at whole depths from 0 to the deepest level, linear; null at 0 takes the next one's."""
    deep = profile.groupBy(*keys).agg(F.floor(F.max("z")).cast("int").alias("most")).where("most >= 0")
    grid = deep.select(*keys, F.explode(F.sequence(F.lit(0), "most")).alias("z")).withColumn("z", F.col("z").cast("double"))
    own = profile_at(profile, grid, keys, clamp=False)
    after = own.where("z = 1").select(*keys, F.col("value").alias("_next"))
    return own.join(after, keys, "left").select(*keys, "z", F.when(F.col("z") == 0, F.coalesce("value", "_next")).otherwise(F.col("value")).alias("value"))


def cast_to_levels(profile: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``value`` at target levels ``z``: linear between levels, and on past the ends; one level alone is the value."""
    whole = profile.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("z", "value"))).alias("p"))
    at = F.greatest(F.least(F.size(F.filter("p", lambda v: v["z"] <= F.col("z"))), F.size("p") - 1), F.lit(1))
    own = targets.join(whole, keys).withColumn("_a", F.element_at("p", at)).withColumn("_b", F.element_at("p", F.least(at + 1, F.size("p"))))
    slope = F.coalesce(F.try_divide(F.col("_b.value") - F.col("_a.value"), F.col("_b.z") - F.col("_a.z")), F.lit(0.0))
    return own.select(*keys, "z", (F.col("_a.value") + (F.col("z") - F.col("_a.z")) * slope).alias("value"))


def bottom_fill(field: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nulls below a column's lowest valid level (``k`` upwards) copy it."""
    low = field.where("value is not null").groupBy(*keys).agg(F.min(F.struct("k", "value")).alias("_l"))
    fill = F.when(F.col("value").isNull() & (F.col("k") < F.col("_l.k")), F.col("_l.value")).otherwise(F.col("value"))
    return field.join(low, keys, "left").select(*keys, "k", fill.alias("value"))


def column_max_fill(field: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nulls take the largest value of their column."""
    most = field.groupBy(*keys).agg(F.max("value").alias("_m"))
    return field.join(most, keys).select(*keys, "k", F.coalesce("value", "_m").alias("value"))


def daily_blocks(series: DataFrame, keys: Sequence[str], day: int, hour: int) -> DataFrame:
    """``keys, day, hour, t, value``: for each hour of each day with rows the first row at or after it, null past the last."""
    own = series.withColumn("day", F.floor(F.col("t") / day).cast("long"))
    told = F.col("day").isNotNull()
    for k in keys:
        told = told & F.col(k).isNotNull()
    # A row is the first one at or after the hours since the row before it, and a day's last row tells which hours have none:
    # no hour meets a day's rows, and hours are laid out after the shuffle.
    near = Window.partitionBy(*keys, "day").orderBy("t", "value")
    into = F.col("t") - F.col("day") * day
    upto = F.when(told, F.floor(into / hour)).otherwise(-1).cast("int")
    spans = own.withColumns({"_to": upto, "_from": F.coalesce(F.floor(F.lag(into).over(near) / hour) + 1, F.lit(0)).cast("int"), "_more": F.lead(F.lit(True)).over(near)})
    hit = F.struct(F.col("_from").alias("a"), F.col("_to").alias("z"), "t", "value")
    rest = F.struct((F.col("_to") + 1).alias("a"), F.lit(23).alias("z"), F.lit(None).cast(series.schema["t"].dataType).alias("t"), F.lit(None).cast(series.schema["value"].dataType).alias("value"))
    laid = spans.select(*keys, "day", F.explode(F.when(F.col("_more"), F.array(hit)).otherwise(F.array(hit, rest))).alias("r")).where("r.a <= r.z")
    return laid.select(*keys, "day", F.explode(F.sequence("r.a", "r.z")).alias("hour"), "r.t", "r.value")


def cast_requests(casts: DataFrame, stations: DataFrame, start: int) -> DataFrame:
    """``cast_no, station, x, y, elapsed``: a row a cast (file, station, t) with its place and seconds since ``start``."""
    each = casts.groupBy("file", "station").agg(F.min("t").alias("t"))
    own = each.join(stations, "station")
    return own.select("file", F.row_number().over(Window.partitionBy("file").orderBy("t", "station")).alias("cast_no"), "station", "x", "y", ((F.col("t") - start) / 1e6).alias("elapsed"))


def multirun_subset(runs: list[tuple[str, DataFrame]], request: DataFrame, miss: str = "drop") -> DataFrame:
    """Requested series of several runs, with the run's name in ``sim``."""
    out = None
    for name, df in runs:
        own = station_select(df, request, miss).withColumn("sim", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def patch_init(nodes: DataFrame, regions: DataFrame, parts: dict[str, Column | DataFrame], default: Column | DataFrame) -> DataFrame:
    """``node_id, value, missing``: a field put together from regions (``node_id, region``), each with its own source.

    A source is an expression over the nodes' columns or a table (node_id, value). ``missing`` marks nodes left null.
    """
    own = nodes.join(regions, "node_id", "left")

    def part(rows: DataFrame, source: Column | DataFrame) -> DataFrame:
        if isinstance(source, Column):
            return rows.select("node_id", source.cast("double").alias("value"))
        return rows.select("node_id").join(source.select("node_id", "value"), "node_id", "left")

    out = part(own.where(~F.coalesce(F.col("region").isin(*parts), F.lit(False))), default)
    for name, source in parts.items():
        out = out.unionByName(part(own.where(F.col("region") == name), source))
    return out.withColumn("missing", F.col("value").isNull())


def raster_blur(raster: DataFrame, sigma: float) -> DataFrame:
    """``row, col, val`` after a Gaussian blur over present pixels, in two passes of one direction each."""
    reach = math.ceil(4 * sigma)
    weights = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(math.exp(-i * i / (2 * sigma * sigma))).alias("w")) for i in range(-reach, reach + 1)])
    out = raster
    for along in ("col", "row"):
        spread = out.withColumn("k", F.explode(weights)).withColumn(along, F.col(along) + F.col("k.i"))
        sums = spread.groupBy("row", "col").agg((F.sum(F.col("k.w") * F.col("val")) / F.sum("k.w")).alias("val"))
        out = sums.join(raster.select("row", "col"), ["row", "col"], "left_semi")
    return out


def color_to_class(pixels: DataFrame, classes: DataFrame) -> DataFrame:
    """``class`` of each pixel by its exact colour (r, g, b); a colour that ``classes`` lacks is an error."""
    own = pixels.join(classes, ["r", "g", "b"], "left")
    unknown = F.raise_error(F.format_string("no class for colour %d %d %d", "r", "g", "b")).cast("int")
    return own.withColumn("class", F.coalesce("class", unknown))


def cell_nearest_fill(field: DataFrame, cell: float = 4.0) -> DataFrame:
    """``row, col, value`` of a field on a grid, cells without a value taking that of the nearest one with a value.

    Of several as near, the first by row and column.
    """
    from tidewater.operators.spatial import nearest

    width = field.agg(F.max("col") + 1).first()[0] or 1
    key = F.col("row") * width + F.col("col")
    holes = field.where("value is null").select(key.alias("point_id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    known = field.where("value is not null").select(key.alias("site_id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "value")
    near = nearest(holes, known.drop("value"), 1, cell).join(known.select("site_id", "value"), "site_id")
    filled = near.select(F.floor(F.col("point_id") / width).alias("row"), F.pmod("point_id", F.lit(width)).alias("col"), "value")
    return field.where("value is not null").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value").unionByName(filled.withColumns({c: F.col(c).cast("long") for c in ("row", "col")}))
