"""Vertical grids, profiles and outputs that come by level or by file."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.operators.series import SPAN


def sz_levels(node: DataFrame, sigma: Sequence[float], z_levels: Sequence[float], h_s: float, h_c: float, theta_b: float, theta_f: float) -> DataFrame:
    """``node_id, k, z`` of a grid of S levels above and Z levels below depth ``h_s``; surface at 0.

    S levels: s h where h <= h_c, else h_c s + (h - h_c) C(s), h the depth within 0.1 and h_s.
    """
    h = F.greatest(F.least(F.col("depth"), F.lit(float(h_s))), F.lit(0.1))
    c = [(1 - theta_b) * math.sinh(theta_f * s) / math.sinh(theta_f) + theta_b * (math.tanh(theta_f * (s + 0.5)) - math.tanh(theta_f / 2)) / 2 / math.tanh(theta_f / 2) for s in sigma]
    s_part = [F.when(h <= h_c, h * s).otherwise(h_c * s + (h - h_c) * cs) for s, cs in zip(sigma, c, strict=True)]
    z_part = [F.when(F.col("depth") > -z, F.lit(float(z))) for z in z_levels if z < -h_s]
    return node.select("node_id", F.posexplode(F.array(*z_part, *s_part)).alias("k", "z")).where("z is not null")


def normalize_sigma(depth: Column, h: Column) -> Column:
    """Height over depth within 0 and 1."""
    return F.greatest(F.least(h / F.greatest(depth, F.lit(1e-6)), F.lit(1.0)), F.lit(0.0))


def depth_average(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Integral of ``value`` over ``z`` by trapezoids, by the depth of the profile; null for one level."""
    by = Window.partitionBy(*keys).orderBy("z")
    step = profile.withColumn("_z", F.lead("z").over(by)).withColumn("_v", F.lead("value").over(by))
    part = (F.col("_z") - F.col("z")) * (F.col("value") + F.col("_v")) / 2
    sums = step.groupBy(*keys).agg(F.sum(part).alias("_s"), (F.max("z") - F.min("z")).alias("_h"))
    return sums.select(*keys, F.try_divide("_s", F.when(F.col("_h") > 0, F.col("_h"))).alias("value"))


def profile_at(profile: DataFrame, targets: DataFrame, keys: Sequence[str], clamp: bool = True) -> DataFrame:
    """``value`` of each target level ``z``: linear between the levels around it; outside the end level's (or null)."""
    own = _around(profile, targets, keys)
    w = F.try_divide(F.col("tz") - F.col("a.z"), F.nullif(F.col("b.z") - F.col("a.z"), F.lit(0.0)))
    inner = F.col("a.value") + F.coalesce(w, F.lit(0.0)) * (F.col("b.value") - F.col("a.value"))
    edge = F.coalesce("a.value", "b.value") if clamp else F.lit(None).cast("double")
    return own.select(*keys, F.col("tz").alias("z"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), inner).otherwise(edge).alias("value"))


def level_nearest(profile: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``value`` of the level nearest to each target ``z``, the lower one at ties."""
    own = _around(profile, targets, keys)
    below = F.col("b").isNull() | (F.col("tz") - F.col("a.z") <= F.col("b.z") - F.col("tz"))
    return own.select(*keys, F.col("tz").alias("z"), F.when(F.col("a").isNotNull() & below, F.col("a.value")).otherwise(F.col("b.value")).alias("value"))


def _around(profile: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, tz, a, b``: the levels (z, value) at or below and at or above each distinct target of a profile.

    Levels and targets are put in order together, so that no target meets all levels of its profile. Targets without a
    profile have no row.
    """
    level = F.struct("z", "value")
    both = profile.select(*keys, "z", level.alias("level")).unionByName(targets.select(*keys, "z").distinct().withColumn("level", F.lit(None)))
    upto = lambda order: Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"a": F.max("level").over(upto("z")), "b": F.min("level").over(upto(F.desc("z")))})
    return seen.where("level is null and (a is not null or b is not null)").select(*keys, F.col("z").alias("tz"), "a", "b")


def unpack_tracers(field: DataFrame, names: Sequence[str]) -> DataFrame:
    """``tracer`` numbers of a field to a column each."""
    return field.groupBy(*[c for c in field.columns if c not in ("tracer", "value")]).pivot("tracer", list(range(len(names)))).agg(F.max("value")).withColumnsRenamed({str(i): n for i, n in enumerate(names)})


def pack_tracers(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """A column for each tracer to rows with ``tracer`` numbers."""
    keys = [c for c in wide.columns if c not in names]
    return wide.select(*keys, F.posexplode(F.array(*names)).alias("tracer", "value"))


def expected_restarts(spark, start: int, days: int, every: int, dt: int) -> DataFrame:
    """``t, iteration`` of the restart files of a run: from ``start``, every ``every`` seconds for ``days``, end excluded."""
    n = -(-days * 86400 // every)
    return spark.range(n).select((F.col("id") * every * 1_000_000 + start).alias("t"), (F.col("id") * (every // dt)).alias("iteration"))


def existing_restarts(files: DataFrame, start: int, dt: int) -> DataFrame:
    """``file, iteration, t`` from names like ``hotstart_000000_960.nc``; others are left out."""
    n = F.regexp_extract("file", r"^hotstart_[0-9]+_([0-9]+)\.nc$", 1)
    own = files.where(n != "").select("file", n.cast("long").alias("iteration"))
    return own.withColumn("t", F.col("iteration") * dt * 1_000_000 + start)


def _middle(values: Column) -> Column:
    """Median of an array of a few numbers; null for none."""
    v, n = F.array_sort(values), F.size(values)
    return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2


def rolling_outliers(df: DataFrame, keys: Sequence[str], low: float, high: float, level: float, half: int, span: int = SPAN, chunk: int = 4096) -> DataFrame:
    """``value`` null outside a range, or farther from the rolling median than ``level`` times the rolling median distance.

    Both medians are over ``half`` rows before and after. Rows are numbered span by span, and windows are over ``chunk`` rows
    and the ``2 half`` before and after them: a series of any length is the work of many tasks.
    """
    c = F.col
    chunk = max(chunk, 2 * half)
    own = df.withColumns({"value": F.when(c("value").between(low, high), c("value")), "_span": F.floor(c("t") / span).cast("long")})
    ahead = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy(*keys, "_span").agg(F.count("*").alias("_n")).select(*keys, "_span", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_from"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy("t")) - 1
    told = own.withColumn("_nth", nth).join(sizes, [*keys, "_span"]).withColumn("_i", c("_from") + c("_nth")).drop("_span", "_nth", "_from")
    at = lambda shift: F.floor((c("_i") + shift) / chunk)
    dealt = told.withColumn("_chunk", F.explode(F.array_distinct(F.array(at(0), at(-2 * half), at(2 * half)))))
    by = Window.partitionBy(*keys, "_chunk").orderBy("_i").rowsBetween(-half, half)
    dealt = dealt.withColumn("_m", _middle(F.collect_list("value").over(by)))
    dealt = dealt.withColumn("_d", F.abs(c("value") - c("_m"))).withColumn("_s", _middle(F.collect_list("_d").over(by)))
    kept = dealt.where(c("_chunk") == at(0)).withColumn("value", F.when((c("_s") > 0) & (c("_d") > level * c("_s")), None).otherwise(c("value")))
    return kept.drop("_m", "_d", "_s", "_i", "_chunk")


def lanczos_weights(cutoff: int, half: int) -> list[float]:
    """Cosine-Lanczos low-pass weights for lags -half..half, ``cutoff`` in steps; they sum to 1."""
    raw = []
    for k in range(-half, half + 1):
        x = 2 * k / cutoff
        sinc = 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
        raw.append(sinc * (1 + math.cos(math.pi * k / (half + 1))) / 2)
    return [w / sum(raw) for w in raw]


def tidal_filter(df: DataFrame, keys: Sequence[str], step: int, cutoff: int, half: int) -> DataFrame:
    """The series without its tides; null where any input of the filter is missing.

    Each row is sent to the times it adds to, so that the sums are made before the shuffle, whatever a series' length.
    """
    weights = F.array(*[F.lit(w) for w in lanczos_weights(cutoff, half)])
    own = df.where("value is not null").select(*keys, "t", "value", F.posexplode(weights).alias("_k", "_w"))
    sums = own.withColumn("t", F.col("t") + (F.col("_k") - half) * step).groupBy(*keys, "t").agg(F.sum(F.col("_w") * F.col("value")).alias("_f"), F.count("*").alias("_n"))
    return df.join(sums, [*keys, "t"], "left").select(*keys, "t", F.when(F.col("_n") == 2 * half + 1, F.col("_f")).alias("value"))


def utm(lon: Column, lat: Column, zone: int = 10) -> tuple[Column, Column]:
    """Easting and northing on WGS84 by Krueger's series to the fourth order."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    al = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    c = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e, nn = eta, xi
    for j, v in enumerate(al, 1):
        e = e + v * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        nn = nn + v * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * big * e, 0.9996 * big * nn


def utm_to_ll(x: Column, y: Column, zone: int = 10) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of easting and northing on WGS84, by the inverse of the same series."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    be = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    de = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    xi, eta = y / (0.9996 * big), (x - 500000) / (0.9996 * big)
    u, v = xi, eta
    for j, b in enumerate(be, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(de, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (6 * zone - 183), F.degrees(lat)


def z_to_sigma(level_z: DataFrame) -> DataFrame:
    """``node_id, k, sigma`` of heights ``z``: by each node's surface (its highest level) and lowest height; null without a depth."""
    ends = level_z.groupBy("node_id").agg(F.max_by("z", "k").alias("_top"), F.min("z").alias("_low"))
    sigma = F.try_divide(F.col("z") - F.col("_top"), F.nullif(F.col("_top") - F.col("_low"), F.lit(0.0)))
    return level_z.join(ends, "node_id").select("node_id", "k", sigma.alias("sigma"))


def desired_levels(node: DataFrame, cumulative: Callable[[Column, Column], Column], most: int = 80) -> DataFrame:
    """``node_id, wanted``: the real number of levels at which the depths that a size function adds up to reach the node's.

    ``cumulative`` gives the depth of the levels from 0 to a number of them, for a water depth; it is made not to fall. It
    is inverted between whole numbers below ``most``, and carried on by its last step beyond; 2 at least.
    """
    depth = F.greatest(F.col("depth"), F.lit(1e-6))
    raw = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: cumulative(i.cast("double"), depth))
    rising = F.aggregate(raw, F.array().cast("array<double>"), lambda out, v: F.concat(out, F.array(F.greatest(v, F.coalesce(F.try_element_at(out, F.lit(-1)), v)))))
    own = node.select("node_id", depth.alias("d"), rising.alias("h")).withColumn("j", F.size(F.filter("h", lambda v: v < F.col("d"))))
    before, at = F.get("h", F.col("j") - 1), F.get("h", F.col("j"))
    step = F.greatest(F.get("h", F.lit(most - 1)) - F.get("h", F.lit(most - 2)), F.lit(1e-6))
    beyond = most - 1 + (F.col("d") - F.get("h", F.lit(most - 1))) / step
    inner = F.col("j") - 1 + (F.col("d") - before) / F.greatest(at - before, F.lit(1e-9))
    return own.select("node_id", F.greatest(F.when(F.col("j") == 0, 2.0).when(F.col("j") >= most, beyond).otherwise(inner), F.lit(2.0)).alias("wanted"))


#: Levels closer than this are one; decimals that a grid's file keeps.
SAME, DECIMALS = 1e-10, 6


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _first_cell(levels: Column, depth: Column, least: Column, raised: bool) -> Column:
    """``levels`` (from 0 up, or from 1 down where not ``raised``) with a first cell of ``least`` or more, and how many were dropped.

    The first level that leaves room is moved to make the cell exactly ``least``, or stays where it is if it is far enough;
    all before it go. Without such a level only the ends stay. Fewer than three levels are left alone.
    """
    sign = 1.0 if raised else -1.0
    at = lambda i: F.get(levels, i)
    none, last = F.lit(0), F.size(levels) - 1
    goal = at(none) + sign * least / F.greatest(depth, F.lit(1e-12))
    far = lambda i: depth * (sign * (at(i) - at(none))) + 1e-15 >= least
    room = lambda i: sign * (at(i + 1) - goal) > SAME
    told = lambda s, drops: F.struct(s.alias("s"), drops.cast("int").alias("drops"))
    fixed = lambda i: F.when(i.isNull(), told(F.array(at(none), at(last)), last - 1)).otherwise(told(F.concat(F.array(at(none), F.when(far(i), at(i)).otherwise(goal)), F.slice(levels, i + 2, F.size(levels))), i - 1))
    pick = F.get(F.filter(F.sequence(F.lit(1), last - 1), lambda i: far(i) | room(i)), none)
    return F.when((depth > 0) & (least > 0) & (last >= 2), _let(pick, fixed)).otherwise(told(levels, none))


def sigma_pileup_fix(sigma: DataFrame, depth: DataFrame, least: Column) -> DataFrame:
    """``node_id, levels, n_before, n_after, dupes, surface_drops, bed_drops, dz_surface, dz_bed``: columns without piled-up levels.

    ``sigma``: node_id, k, sigma from 0 at the surface to 1 at the bed; ``depth``: node_id, depth and what ``least``, the
    least thickness of the first and last cell, is made of. Levels equal to the one before go. Then the surface's cell, and
    after it the bed's, is made ``least`` thick: the next level is moved, or dropped where the one after it is in the way, and
    so on. Last, levels that are the same after rounding to six decimals become one, so that what is written is strictly
    increasing; a column that has none of these keeps its unrounded levels. Columns of two levels or fewer become 0 and 1.
    ``dz_surface`` and ``dz_bed`` are the cells after the moves, before the rounding; null where no depth is.

    All of a column's levels are one row; the rest is built-in array functions, each step's outcome bound once.
    """
    h, t = F.col("depth").cast("double"), least.cast("double")

    def apart(raw: Column) -> Column:
        before = lambda i: F.get(raw, i - 1)
        return F.filter(raw, lambda x, i: F.when(i == 0, True).otherwise(F.abs(x - before(i)) > SAME))

    def ended(own: Column) -> Column:
        one = F.concat(F.slice(own, 1, F.size(own) - 1), F.array(F.lit(1.0)))
        return F.when(F.size(own) <= 2, F.array(F.lit(0.0), F.lit(1.0))).when(F.abs(F.element_at(own, -1) - 1) <= SAME, one).otherwise(own)

    def written(moved: Column) -> Column:
        last = F.size(moved) - 1
        rounded = F.transform(moved, lambda x, i: F.when(i == 0, 0.0).when(i == last, 1.0).otherwise(F.rint(x * 10.0**DECIMALS) / 10.0**DECIMALS))
        kept = lambda r: F.filter(r, lambda x, i: F.when((i == 0) | (i == F.size(r) - 1), True).otherwise((x > F.get(r, i - 1)) & (x < 1.0)))
        return _let(_let(rounded, kept), lambda k: F.when(F.size(k) < F.size(moved), k).otherwise(moved))

    def told(raw: Column, own: Column, top: Column, bed: Column, moved: Column) -> Column:
        cell = lambda i, j: F.when((h > 0) & (F.size(own) > 2), h * (F.element_at(moved, j) - F.element_at(moved, i)))
        made = {"n_before": F.size(raw), "dupes": F.size(raw) - F.size(own), "surface_drops": top["drops"], "bed_drops": bed["drops"], "dz_surface": cell(1, 2), "dz_bed": cell(-2, -1)}
        return F.struct(written(moved).alias("levels"), *[v.alias(k) for k, v in made.items()])

    steps = lambda raw, own, top: _let(_first_cell(F.reverse(top["s"]), h, t, False), lambda bed: _let(F.reverse(bed["s"]), lambda moved: told(raw, own, top, bed, moved)))
    fixed = _let(F.col("raw"), lambda raw: _let(apart(raw), lambda own: _let(ended(own), lambda whole: _let(_first_cell(whole, h, t, True), lambda top: steps(raw, own, top)))))
    columns = sigma.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sigma"))), lambda x: x["sigma"].cast("double")).alias("raw")).join(depth, "node_id")
    out = columns.select("node_id", F.inline(F.array(fixed)))
    return out.select("node_id", "levels", "n_before", F.size("levels").alias("n_after"), "dupes", "surface_drops", "bed_drops", "dz_surface", "dz_bed")
