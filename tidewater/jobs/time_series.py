"""Queries over the series bridge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewater.operators import series as S
from tidewater.sources.bridge import DAY, HOUR, HOURLY, SERIES, hourly, series

MINUTE = 60_000_000
#: Minutes from 2024-01-03 to 2024-01-28, between which blocks are merged.
BLOCKS = (19725 * 1440, 19750 * 1440)
KEYS = ["station", "variable"]
#: 2024-01-20 and 2024-01-10 in microseconds: where the bridge's two restart files end and begin (fixed values).
JAN_20, JAN_10 = 1_705_708_800_000_000, 1_704_844_800_000_000
#: Gaps up to so many hours are filled.
GAP = 3


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _settled(df: DataFrame, *names: str) -> DataFrame:
    """Rounded off the halves that interpolation between rounded values lands on."""
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


def _once(df: DataFrame) -> DataFrame:
    """One row for each series and time: the mean."""
    return df.groupBy(*KEYS, "t").agg(F.round(F.avg("value"), 6).alias("value"))


def _restarts(spark, d):
    s = series(spark, d)
    return s.where(F.col("t") < JAN_20).withColumn("file", F.lit(0)).unionByName(s.where(F.col("t") >= JAN_10).withColumn("file", F.lit(1)))


def flagship_skill(spark: SparkSession, d: str) -> DataFrame:
    """Simulated (clicks) against observed (views) series: hourly means, gaps filled, scored by station."""
    h = hourly(spark, d).where("variable in ('view', 'click')")
    filled = _settled(S.filled_grid(h, KEYS, HOUR, GAP), "value")
    pick = lambda v, name: filled.where((F.col("variable") == v) & F.col("value").isNotNull()).select("station", "t", F.col("value").alias(name))
    scores = S.skill_scores(pick("click", "sim").join(pick("view", "obs"), ["station", "t"]), ["station"])
    return _settled(scores.where("n >= 3"), "rmse", "bias", "nse", "willmott", "corr")


def _pairs(spark, d):
    day = S.daily_mean(series(spark, d), KEYS).withColumn("value", F.round("value", 6))
    pick = lambda v, name: day.where(F.col("variable") == v).select("station", "t", F.col("value").alias(name))
    return pick("click", "sim").join(pick("view", "obs"), ["station", "t"])


def resample_ffill(spark, d):
    return S.resample_ffill(_once(series(spark, d)), KEYS, HOUR).withColumn("value", F.round("value", 6))


def fill_gaps(spark, d):
    return _settled(S.filled_grid(hourly(spark, d), KEYS, HOUR, GAP), "value")


def resample_linear(spark, d):
    return _settled(S.resample_linear(hourly(spark, d), KEYS, 2 * HOUR, 1), "value")


def combine_first(spark, d):
    return S.combine_restarts(_restarts(spark, d), KEYS, "first").select("station", "variable", "t", "value", "file")


def combine_last(spark, d):
    return S.combine_restarts(_restarts(spark, d), KEYS, "last").select("station", "variable", "t", "value", "file")


def splice(spark, d):
    h = hourly(spark, d)
    return S.splice(h.where(F.col("t") < JAN_20), h.withColumn("value", F.col("value") + 1).where(F.col("t") >= JAN_10), KEYS, JAN_10 + 5 * DAY)


def check_monotonic(spark, d):
    e = series(spark, d).select("station", "variable", F.floor(F.col("t") / (2 * DAY)).cast("long").alias("t"), F.col("t").alias("o"))
    own = e.withColumn("row_no", F.row_number().over(Window.partitionBy(*KEYS).orderBy("o")))
    return S.check_monotonic(own, KEYS, "row_no", 16).select("station", "variable", "row_no", "t", "prev_t")


def before_start(spark, d):
    return S.before_start(series(spark, d), KEYS, JAN_10)


def time_clip(spark, d):
    return S.time_clip(series(spark, d), JAN_10, JAN_20)


def nearest_time(spark, d):
    return S.as_of_grid(_once(series(spark, d)), KEYS, 6 * HOUR, "nearest")


def as_of_backward(spark, d):
    s = _once(series(spark, d))
    view, click = s.where("variable = 'view'"), s.where("variable = 'click'")
    return S.as_of(view.select("station", "t", "value"), click.select("station", "t", "value"), ["station"])


def bracket_interp(spark, d):
    return _settled(S.bracket_grid(_once(series(spark, d)), KEYS, 12 * HOUR), "r_value")


def infer_frequency(spark, d):
    return S.infer_frequency(hourly(spark, d), KEYS)


def merge_blocks(spark, d):
    minute = series(spark, d).select(F.floor(F.col("t") / MINUTE).cast("long").alias("a")).distinct()
    return S.merge_blocks(minute.select("a", (F.col("a") + F.pmod("a", F.lit(3))).alias("b")), *BLOCKS)


def combine_columns(spark, d):
    h = hourly(spark, d).withColumn("name", F.col("variable"))
    groups = h.select("name").distinct().withColumn("group", F.when(F.col("name").isin("view", "click"), "reads").otherwise("writes"))
    return _r(S.combine_columns(h, groups), "value")


def minmax_normalize(spark, d):
    return _r(S.minmax_normalize(hourly(spark, d), KEYS), "value")


def structure_openness(spark, d):
    h = hourly(spark, d).withColumnRenamed("variable", "name")
    return _r(S.openness(h, ["station"], 6 * HOUR), "up", "down")


def daily_mean(spark, d):
    return _r(S.daily_mean(series(spark, d), KEYS), "value")


def regression_line(spark, d):
    return _r(S.regression_line(_pairs(spark, d), ["station"]), "slope", "intercept").where("slope is not null")


def best_lag(spark, d):
    day = S.daily_mean(series(spark, d), KEYS).withColumn("value", F.round("value", 6))
    return S.best_lag(day.where("variable = 'click'").drop("variable"), day.where("variable = 'view'").drop("variable"), ["station"], DAY, 3)


def datum_adjust(spark, d):
    return _settled(S.datum_adjust(_pairs(spark, d), ["station"]), "obs")


def stokes_drift(spark, d):
    return _r(S.stokes_drift(_pairs(spark, d).select("station", F.col("sim").alias("u"), F.col("obs").alias("h")), ["station"]), "drift")


def time_gaps(spark, d):
    return S.time_gaps(hourly(spark, d), KEYS, HOUR)


def distinct_states(spark, d):
    h = hourly(spark, d).select("station", "variable", "t", F.floor(F.col("value") / 40).cast("long").alias("state"))
    return S.distinct_states(h, KEYS, ["state"])


def distinct_states_consecutive(spark, d):
    h = hourly(spark, d).select("station", "variable", "t", F.floor(F.col("value") / 40).cast("long").alias("state"))
    return S.distinct_states(h, KEYS, ["state"], consecutive_only=True)


def elapsed_times(spark, d):
    s = series(spark, d)
    e = S.to_elapsed(F.col("t"), F.lit(JAN_10))
    return s.select("station", "variable", F.round(e, 6).alias("elapsed"), S.elapsed_to_t(F.floor(e), JAN_10).alias("t"), S.elapsed_to_t(F.round(F.floor(e) / 43200, 0) / 2, JAN_10, 86400).alias("t_day"))


def units_and_sentinels(spark, d):
    s = series(spark, d)
    unit = F.element_at(F.array(*map(F.lit, ["ft", "cfs", "degF", "ec", "psu"])), (F.pmod("station", F.lit(5)) + 1).cast("int"))
    value = S.mask_sentinel(F.when(F.col("value") > 90, -999.0).otherwise(F.col("value") * 10))
    return s.select("station", "variable", "t", F.round(S.to_si(value, unit), 6).alias("si"))


_ONCE = "once as (select station, variable, t, round(avg(value), 6) as value from series group by 1, 2, 3)"

def _grid(step: int, src: str) -> str:
    return f"grid as (select station, variable, unnest(generate_series(a - a % {step}, z, {step})) as t from (select station, variable, min(t) as a, max(t) as z from {src} group by 1, 2))"


def _filled(src: str, step: int, limit: int, out: str = "filled") -> str:
    """SQL: gaps of ``src`` on ``grid`` filled linearly."""
    return f"""g as (select grid.station, grid.variable, grid.t, h.value from grid left join {src} h on h.station = grid.station and h.variable = grid.variable and h.t = grid.t),
{out} as (select station, variable, t, round(case when value is not null then value when (t - ta) / {step} <= {limit} and vb is not null then va + (vb - va) * (t - ta)::double / (tb - ta)
  when (t - ta) / {step} <= {limit} then va end + 1e-9, 6) as value from (
  select *, last_value(case when value is not null then t end ignore nulls) over w as ta, last_value(value ignore nulls) over w as va,
    first_value(case when value is not null then t end ignore nulls) over v as tb, first_value(value ignore nulls) over v as vb from g
  window w as (partition by station, variable order by t rows between unbounded preceding and current row), v as (partition by station, variable order by t rows between current row and unbounded following)))"""


_DAY = f"day as (select station, variable, t - t % {DAY} as t, round(avg(value), 6) as value from series group by 1, 2, 3)"
_PAIRS = _DAY + ", pairs as (select a.station, a.t, a.value as sim, b.value as obs from day a join day b on a.station = b.station and a.t = b.t and a.variable = 'click' and b.variable = 'view')"
_RESTARTS = f"files as (select *, 0 as file from series where t < {JAN_20} union all select *, 1 as file from series where t >= {JAN_10}), ends as (select station, variable, file, min(t) as a, max(t) as z from files group by 1, 2, 3)"

QUERIES = {
    "flagship_skill": (
        flagship_skill,
        f"""with {HOURLY}, hh as (select * from hourly where variable in ('view', 'click')), {_grid(HOUR, 'hh')}, {_filled('hh', HOUR, GAP)},
both_ as (select s.station, s.value as sim, o.value as obs, avg(o.value) over (partition by s.station) as m from filled s join filled o on s.station = o.station and s.t = o.t
  and s.variable = 'click' and o.variable = 'view' and s.value is not null and o.value is not null)
select station, count(*) as n, round(sqrt(avg((sim - obs) ** 2)) + 1e-9, 6) as rmse, round(avg(sim - obs) + 1e-9, 6) as bias,
  round(case when sum((obs - m) ** 2) > 1e-12 then 1 - sum((sim - obs) ** 2) / sum((obs - m) ** 2) end + 1e-9, 6) as nse,
  round(case when sum((abs(sim - m) + abs(obs - m)) ** 2) > 1e-12 then 1 - sum((sim - obs) ** 2) / sum((abs(sim - m) + abs(obs - m)) ** 2) end + 1e-9, 6) as willmott,
  round(case when stddev_pop(sim) > 0 and stddev_pop(obs) > 0 then corr(sim, obs) end + 1e-9, 6) as corr from both_ group by station having count(*) >= 3""",
    ),
    "resample_ffill": (
        resample_ffill,
        f"""with {SERIES}, {_ONCE}, {_grid(HOUR, 'once')} select grid.station, grid.variable, grid.t, o.value from grid asof left join once o on grid.station = o.station and grid.variable = o.variable and grid.t >= o.t""",
    ),
    "fill_gaps": (fill_gaps, f"with {HOURLY}, {_grid(HOUR, 'hourly')}, {_filled('hourly', HOUR, GAP)} select * from filled"),
    "resample_linear": (resample_linear, f"with {HOURLY}, {_grid(2 * HOUR, 'hourly')}, {_filled('hourly', 2 * HOUR, 1)} select * from filled"),
    "combine_restarts_first": (
        combine_first,
        f"with {SERIES}, {_RESTARTS} select f.station, f.variable, f.t, f.value, f.file from files f left join ends p on p.station = f.station and p.variable = f.variable and p.file = 0 and f.file = 1 where p.z is null or f.t > p.z",
    ),
    "combine_restarts_last": (
        combine_last,
        f"with {SERIES}, {_RESTARTS} select f.station, f.variable, f.t, f.value, f.file from files f left join ends n on n.station = f.station and n.variable = f.variable and n.file = 1 and f.file = 0 where n.a is null or f.t < n.a",
    ),
    "splice_series": (splice, f"with {HOURLY} select station, variable, t, value from hourly where t < {JAN_10 + 5 * DAY} union all select station, variable, t, value + 1 from hourly where t >= {JAN_10 + 5 * DAY}"),
    "check_monotonic": (
        check_monotonic,
        f"with {SERIES}, r as (select station, variable, t // {2 * DAY} as t, row_number() over w as row_no, lag(t // {2 * DAY}) over w as prev_t from series window w as (partition by station, variable order by t)) select station, variable, row_no::int as row_no, t, prev_t from r where t <= prev_t",
    ),
    "before_start": (
        before_start,
        f"with {SERIES}, e as (select station, variable, max(t) filter (t < {JAN_10}) as b, min(t) filter (t >= {JAN_10}) as f from series group by 1, 2) select s.* from series s join e on s.station = e.station and s.variable = e.variable where s.t >= {JAN_10} or (s.t = e.b and coalesce(e.f, 0) <> {JAN_10})",
    ),
    "time_clip": (time_clip, f"with {SERIES} select * from series where t between {JAN_10} and {JAN_20}"),
    "nearest_time": (
        nearest_time,
        f"""with {SERIES}, {_ONCE}, {_grid(6 * HOUR, 'once')}, a as (select g.*, o.t as ta, o.value as va from grid g asof left join once o on g.station = o.station and g.variable = o.variable and g.t >= o.t),
b as (select a.*, o.t as tb, o.value as vb from a asof left join once o on a.station = o.station and a.variable = o.variable and a.t <= o.t)
select station, variable, t, case when tb is null or t - ta <= tb - t then ta else tb end as r_t, case when tb is null or t - ta <= tb - t then va else vb end as r_value from b""",
    ),
    "as_of_backward": (
        as_of_backward,
        f"with {SERIES}, {_ONCE} select v.station, v.t, v.value, c.t as r_t, c.value as r_value from (select * from once where variable = 'view') v asof left join (select * from once where variable = 'click') c on v.station = c.station and v.t >= c.t",
    ),
    "bracket_interp": (
        bracket_interp,
        f"""with {SERIES}, {_ONCE}, {_grid(12 * HOUR, 'once')}, a as (select g.*, o.t as ta, o.value as va from grid g asof left join once o on g.station = o.station and g.variable = o.variable and g.t >= o.t),
b as (select a.*, o.t as tb, o.value as vb from a asof left join once o on a.station = o.station and a.variable = o.variable and a.t <= o.t)
select station, variable, t, round(case when ta = t then va when ta is null or tb is null then null else va + (t - ta)::double / (tb - ta) * (vb - va) end + 1e-9, 6) as r_value from b""",
    ),
    "infer_frequency": (
        infer_frequency,
        f"with {HOURLY}, d as (select station, variable, t - lag(t) over (partition by station, variable order by t) as step from hourly), n as (select station, variable, step, count(*) as n from d where step is not null group by 1, 2, 3) select station, variable, min([-n, step])[2] as step, count(*) = 1 as regular from n group by 1, 2",
    ),
    "merge_blocks": (
        merge_blocks,
        f"""with {SERIES}, r as (select distinct t // {MINUTE} as a from series),
days as (select distinct unnest(generate_series(a, a + a % 3)) as d from r), inside as (select d from days where d between {BLOCKS[0]} and {BLOCKS[1]}),
flag as (select d, exists (select 1 from inside i where i.d = x.d) as wanted from (select unnest(generate_series({BLOCKS[0]}, {BLOCKS[1]})) as d) x),
isl as (select *, d - row_number() over (partition by wanted order by d) as i from flag) select min(d) as a, max(d) as b, wanted from isl group by wanted, i""",
    ),
    "combine_columns": (combine_columns, f"with {HOURLY} select case when variable in ('view', 'click') then 'reads' else 'writes' end as \"group\", t, round(sum(value), 6) as value from hourly group by 1, 2"),
    "minmax_normalize": (
        minmax_normalize,
        f"with {HOURLY} select station, variable, t, round(case when max(value) over w > min(value) over w then (value - min(value) over w) / (max(value) over w - min(value) over w) when value <> 0 then 1.0 else 0.0 end, 6) as value from hourly window w as (partition by station, variable)",
    ),
    "structure_openness": (
        structure_openness,
        f"""with {HOURLY}, {_grid(6 * HOUR, 'hourly')}, f as (select grid.station, grid.variable, grid.t, h.value from grid asof left join hourly h on grid.station = h.station and grid.variable = h.variable and grid.t >= h.t),
n as (select station, t, case when max(value) over w > min(value) over w then (value - min(value) over w) / (max(value) over w - min(value) over w) when value <> 0 then 1.0 when value is not null then 0.0 end as v from f window w as (partition by station, variable))
select station, t, round(product(v), 6) as up, round(-product(v), 6) as down from n group by 1, 2""",
    ),
    "daily_mean": (daily_mean, f"with {SERIES} select station, variable, t - t % {DAY} as t, round(avg(value), 6) as value from series group by 1, 2, 3"),
    "regression_line": (regression_line, f"with {SERIES}, {_PAIRS} select station, round(regr_slope(sim, obs), 6) as slope, round(regr_intercept(sim, obs), 6) as intercept from pairs group by 1 having isfinite(regr_slope(sim, obs))"),
    "lag_of_max_correlation": (
        best_lag,
        f"""with {SERIES}, {_DAY}, l as (select o.station, lag, round(corr(s.value, o.value), 6) as r, count(*) as n from day o, (select unnest(generate_series(-3, 3)) as lag) x, day s
  where o.variable = 'view' and s.variable = 'click' and s.station = o.station and s.t = o.t + x.lag * {DAY} group by 1, 2)
select station, case when abs(lag) < 3 then lag::int end as lag, r from (select *, row_number() over (partition by station order by r desc, abs(lag), lag desc) as k from l where n >= 3 and r is not null and not isnan(r)) where k = 1""",
    ),
    "datum_adjust": (datum_adjust, f"with {SERIES}, {_PAIRS} select station, t, sim, round(obs + avg(sim) over w - avg(obs) over w + 1e-9, 6) as obs from pairs window w as (partition by station)"),
    "stokes_drift": (
        stokes_drift,
        f"with {SERIES}, {_PAIRS}, m as (select *, avg(sim) over w as mu, avg(obs) over w as mh from pairs window w as (partition by station)) select station, round(case when max(abs(sim - mu)) * max(abs(obs - mh)) > 1e-9 then (avg(sim * obs) - max(mu) * max(mh)) / (max(abs(sim - mu)) * max(abs(obs - mh))) end, 6) as drift from m group by 1",
    ),
    "time_gaps": (time_gaps, f"with {HOURLY}, g as (select station, variable, lag(t) over (partition by station, variable order by t) as from_t, t as to_t from hourly) select * from g where to_t - from_t <> {HOUR}"),
    "interpolate_structure": (distinct_states, f"with {HOURLY} select station, variable, min(t) as t, floor(value / 40)::bigint as state from hourly group by 1, 2, 4"),
    "interpolate_structure_consecutive": (
        distinct_states_consecutive,
        f"with {HOURLY}, s as (select station, variable, t, floor(value / 40)::bigint as state, lag(floor(value / 40)::bigint) over (partition by station, variable order by t) as p from hourly) select station, variable, t, state from s where p is distinct from state",
    ),
    "elapsed_times": (
        elapsed_times,
        f"with {SERIES} select station, variable, round((t - {JAN_10}) / 1e6, 6) as elapsed, floor((t - {JAN_10}) / 1e6)::bigint * 1000000 + {JAN_10} as t, round_even(round(floor((t - {JAN_10}) / 1e6) / 43200, 0) / 2 * 86400, 0)::bigint * 1000000 + {JAN_10} as t_day from series",
    ),
    "units_and_sentinels": (
        units_and_sentinels,
        f"""with {SERIES}, v as (select *, case when value > 90 then null else value * 10 end as w, station % 5 as u from series)
select station, variable, t, round(case u when 0 then w * 0.3048::double when 1 then w * 0.028316846592::double when 2 then (w - 32) * 5 / 9 when 3 then 0.0120::double - 0.2174::double * sqrt(w / 53087.0::double) + 25.3283::double * (w / 53087.0::double)
  + 13.7714::double * (w / 53087.0::double) * sqrt(w / 53087.0::double) - 6.4788::double * (w / 53087.0::double) ** 2 + 2.5842::double * (w / 53087.0::double) ** 2 * sqrt(w / 53087.0::double) else w end, 6) as si from v""",
    ),
}
