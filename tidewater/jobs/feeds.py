"""Queries over files and feeds made from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.sources import text as X
from tidewater.sources.bridge import DAY, HOURLY, SERIES, hourly, series, table
from tidewater.streaming import feeds as R

NAMES = ["click", "error", "purchase", "signup", "view"]
START = 1_704_067_200_000_000  # 2024-01-01


def _wide(s, d):
    h = hourly(s, d)
    return h.select(F.concat(F.lit("f"), F.col("station").cast("string")).alias("file"), "t", F.col("variable").alias("name"), F.round(F.col("value") + 1e-9, 2).alias("value"))


def _with_notes(files):
    """A comment line before the header, one behind a row and one after it."""
    content = F.concat(F.lit("# made by hand\n"), F.regexp_replace("content", r"(T00:00 [^\n]*)", "$1 # night\n# checked"))
    return files.select("file", content.alias("content"))


def read_th(s, d):
    return X.read_th_dated(_with_notes(X.write_th(_wide(s, d), NAMES)))


def read_elapsed(s, d):
    return X.read_th_elapsed(X.write_th(_wide(s, d), NAMES, dated=False, start=START))


def detect(s, d):
    both = X.write_th(_wide(s, d), NAMES).unionByName(X.write_th(_wide(s, d).withColumn("file", F.concat(F.lit("e"), "file")), NAMES, dated=False, start=START))
    return X.detect_elapsed(both.withColumn("content", F.regexp_replace("content", "^datetime[^\n]*\n", "")).withColumn("content", F.regexp_replace("content", r"\bnan\b", "0")))


def station_in(s, d):
    rows = table(s, d, "supplier").select(F.concat(F.lit("l"), (F.col("s_suppkey") % 3).cast("string")).alias("file"), F.col("s_suppkey").alias("k"))
    line = F.format_string('%d %d.25 %d.5 -1.0 ! s%d %s"Station %d"', "k", "k", F.col("k") * 2, "k", F.when(F.col("k") % 2 == 0, "upper ").otherwise(""), "k")
    files = rows.groupBy("file").agg(F.concat(F.lit("1 0 0\n0\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("l")))), lambda r: r["l"]), "\n")).alias("content"))
    return X.read_station_in(files).drop("pos")


def staout(s, d):
    sent = _wide(s, d).withColumn("value", F.when(F.pmod(F.floor(F.col("t") / 3_600_000_000), F.lit(5)) == 0, -9999.0).otherwise(F.col("value")))
    files = X.write_th(sent, NAMES, dated=False, start=START).withColumn("content", F.regexp_replace("content", "^#[^\n]*\n", ""))
    return X.read_staout(files, s.createDataFrame(list(enumerate(NAMES)), "pos int, station string"), START)


def params(s, d):
    n = table(s, d, "nation").select(F.concat(F.lit("f"), (F.col("n_nationkey") % 2).cast("string")).alias("file"), F.col("n_regionkey").alias("r"), "n_name", "n_nationkey")
    line = F.format_string("&SEC%d\n  %s = %d ! note = x", "r", "n_name", "n_nationkey")
    files = n.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))
    return X.params_table(files)


_WIDE = HOURLY + ", w as (select 'f' || station as file, t, variable as name, round(value + 1e-9, 2) as value from hourly), tt as (select distinct file, t from w), g as (select tt.file, tt.t, n.name, w.value from tt, (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as name) n left join w on w.file = tt.file and w.t = tt.t and w.name = n.name), k as (select *, dense_rank() over (partition by file order by t) - 1 as row_no from g)"

QUERIES = {
    "read_th_dated": (read_th, f"with {_WIDE} select file, row_no::bigint as row_no, t, name, value, case when t % {DAY} = 0 then 'checked' end as comment from k"),
    "read_th_elapsed": (read_elapsed, f"with {_WIDE} select file, row_no::bigint as row_no, (t - {START}) / 1e6 as elapsed, name, value from k"),
    "detect_elapsed": (detect, f"with {_WIDE} select distinct file, false as elapsed from w union all select distinct 'e' || file, true from w"),
    "write_th": (
        lambda s, d: X.write_th(_wide(s, d), NAMES),
        f"with {_WIDE}, l as (select file, t, strftime(make_timestamp(t), '%Y-%m-%dT%H:%M') || ' ' || string_agg(coalesce(printf('%.2f', value), 'nan'), ' ' order by name) as line from g group by 1, 2) select file, 'datetime click error purchase signup view' || chr(10) || string_agg(line, chr(10) order by t) as content from l group by 1",
    ),
    "read_station_in": (
        station_in,
        "select 'l' || s_suppkey % 3 as file, s_suppkey + 0.25::double as x, s_suppkey * 2 + 0.5::double as y, -1.0::double as z, 's' || s_suppkey as id, case when s_suppkey % 2 = 0 then 'upper' else 'default' end as subloc, 'Station ' || s_suppkey as name from supplier",
    ),
    "read_staout": (staout, f"with {_WIDE} select file, name as station, t, case when (t // 3600000000) % 5 = 0 then null else value end as value from k"),
    "params_table": (params, "select 'f' || n_nationkey % 2 as file, 'SEC' || n_regionkey as section, n_name as name, n_nationkey::varchar as value from nation"),
    "stream_restart_dedup": (
        lambda s, d: R.run_to_end(R.restart_dedup(R.read_feed(s, d).withColumn("ts", F.date_trunc("hour", "ts")), "60 days").select("station", "variable", F.unix_micros("ts").alias("t"))),
        f"with {HOURLY} select station, variable, t from hourly",
    ),
    "stream_daily_mean": (
        lambda s, d: R.run_to_end(R.daily_mean(R.read_feed(s, d))).withColumn("value", F.round("value", 6)),
        f"with {SERIES} select station, variable, t - t % {DAY} as t, round(avg(value), 6) as value, count(*) as n from series group by 1, 2, 3 having t - t % {DAY} + {DAY} <= (select (max(t) // 1000) * 1000 - {DAY} from series)",
    ),
    "stream_sliding_mean": (
        lambda s, d: R.run_to_end(R.sliding_mean(R.read_feed(s, d))).withColumn("value", F.round("value", 6)),
        f"with {SERIES}, w as (select variable, value, t - t % 21600000000 - o * 21600000000 as a from series, (select unnest([0, 1, 2, 3]) as o)) select variable, a as t, round(avg(value), 6) as value from w group by 1, 2 having a + {DAY} <= (select (max(t) // 1000) * 1000 - {DAY} from series)",
    ),
    "stream_coverage_sessions": (
        lambda s, d: R.run_to_end(R.coverage_sessions(R.read_feed(s, d))),
        f"with {SERIES}, f as (select station, t, case when t - lag(t) over (partition by station order by t) <= 43200000000 then 0 else 1 end as n from series), g as (select station, t, sum(n) over (partition by station order by t rows unbounded preceding) as i from f) select station, min(t) as a, max(t) + 43200000000 as z, count(*) as n from g group by station, i having max(t) + 43200000000 <= (select (max(t) // 1000) * 1000 - {DAY} from series)",
    ),
    "stream_station_lookup": (
        lambda s, d: R.run_to_end(R.with_station(R.read_feed(s, d), series(s, d).where("station % 2 = 0").select("station", (F.col("station") / 10).alias("datum")).distinct()).select("station", "variable", F.unix_micros("ts").alias("t"), F.round(F.col("value") + F.coalesce("datum", F.lit(0.0)), 6).alias("value"))),
        f"with {SERIES} select station, variable, t, round(value + case when station % 2 = 0 then station / 10.0::double else 0 end, 6) as value from series",
    ),
}
