"""Queries over stations, sources, sinks and lists made from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import tables as T
from tidewater.sources.bridge import DAY, HOUR, HOURLY, SERIES, hourly, series, table

START, END = 1_704_844_800_000_000, 1_705_708_800_000_000


def _stations(s, d):
    return series(s, d).select(F.concat(F.lit("st"), F.col("station").cast("string")).alias("station_id"), "station").distinct()


def _sublocs(s, d):
    own = _stations(s, d).where("station % 3 <> 0")
    return own.select("station_id", F.explode(F.when(F.col("station") % 3 == 1, F.array(F.struct(F.lit("upper").alias("subloc"), F.lit(-1.0).alias("z")))).otherwise(F.array(F.struct(F.lit("upper").alias("subloc"), F.lit(-1.0).alias("z")), F.struct(F.lit("lower").alias("subloc"), F.lit(-5.0).alias("z"))))).alias("v")).select("station_id", "v.*")


def _points(s, d):
    k = F.col("s_suppkey")
    one = table(s, d, "supplier").select(k.alias("k"), F.col("s_acctbal").alias("x"))
    name = lambda role: F.when(F.pmod(F.col("k"), F.lit(11)) == 3, F.concat(F.lit("odd_"), F.col("k").cast("string"))).otherwise(F.concat(F.lit(f"delta_{role}_"), F.col("k").cast("string")))
    return one.select(name("src").alias("name"), "x").unionByName(one.where("k % 7 <> 0 and k % 11 <> 3").select(name("sink").alias("name"), "x"))


def merge_th(s, d):
    h = hourly(s, d).withColumn("loc", F.concat(F.lit("l"), F.col("station").cast("string"))).drop("station")
    second = h.where(F.col("t") >= START + 3 * DAY).withColumn("value", F.col("value") + 100)
    inputs = h.withColumn("file_no", F.lit(0)).unionByName(second.withColumn("file_no", F.lit(1)))
    absent = s.createDataFrame([(v, "l-1") for v in ("view", "click")], "variable string, loc string")
    targets = h.select("variable", "loc").distinct().unionByName(absent)
    return T.merge_th(inputs, targets, START, END, [(r"view\.l2$", 7.0, False), (r"click\.l3$", 5.0, True)])


def concat_sources(s, d):
    h = hourly(s, d)
    site = lambda df: df.select(F.col("station").alias("site"), "variable", "t", "value")
    a, b = h.where("station % 2 = 0"), h.where("station % 2 = 1")
    return T.concat_sources(site(a), site(b), site(a).unionByName(site(b)).select("site").distinct())


def station_select(s, d):
    h = hourly(s, d).select(F.concat("variable", F.lit("_"), F.col("station").cast("string")).alias("label"), "t", "value", F.lit(1).alias("pos"))
    twice = h.unionByName(h.withColumn("pos", F.lit(0)).withColumn("value", F.col("value") * 2).where("t % 7200000000 = 0"))
    request = s.createDataFrame([(0, "view_1", "a"), (1, "click_2", None), (2, "none_1", None)], "ord int, label string, alias string")
    return T.station_select(twice, request, "nan")


def obs_lookup(s, d):
    wanted = T.station_subloc_merge(_stations(s, d), _sublocs(s, d)).select("station_id", "subloc").withColumn("variable", F.lit("elev"))
    links = wanted.where("subloc <> 'lower'").withColumn("filename", F.concat("station_id", F.lit("_"), "subloc"))
    files = links.select("filename", F.explode(F.array(F.lit("new"), F.lit("old"))).alias("repo")).where("not (repo = 'new' and filename like '%1\\_%')").withColumn("path", F.concat("repo", F.lit("/"), "filename"))
    return T.obs_lookup(wanted, links, files, s.createDataFrame([("new", 0), ("old", 1)], "repo string, prio int"))


def param_diff(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    a = n.select(F.concat(F.lit("s"), F.col("n_regionkey").cast("string")).alias("section"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("value"))
    b = a.where("cast(value as int) % 5 <> 0").withColumn("value", F.when(F.col("value").cast("int") % 4 == 0, F.lit("x")).otherwise(F.col("value")))
    return T.param_diff(a, b.unionByName(r.select(F.lit("r").alias("section"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("value"))))


_ST = "stn as (select distinct 'st' || station as station_id, station from series), sub as (select station_id, 'upper' as subloc, -1.0::double as z from stn where station % 3 <> 0 union all select station_id, 'lower', -5.0 from stn where station % 3 = 2)"
_MERGED = _ST + ", sm as (select station_id, station, coalesce(subloc, 'default') as subloc, coalesce(z, -0.5::double) as z from stn left join sub using (station_id))"
_PTS = "p0 as (select s_suppkey as k, s_acctbal as x from supplier), pt as (select case when k % 11 = 3 then 'odd_' || k else 'delta_src_' || k end as name, x from p0 union all select 'delta_sink_' || k, x from p0 where k % 7 <> 0 and k % 11 <> 3)"
_R = lambda df, *n: df.withColumns({c: F.round(c, 6) for c in n})

QUERIES = {
    "station_subloc_merge": (lambda s, d: T.station_subloc_merge(_stations(s, d), _sublocs(s, d)), f"with {SERIES}, {_MERGED} select * from sm"),
    "obs_lookup": (
        obs_lookup,
        f"with {SERIES}, {_MERGED} select station_id, subloc, 'elev' as variable, case when subloc = 'lower' then null when station_id || '_' || subloc like '%1$_%' escape '$' then 'old/' || station_id || '_' || subloc else 'new/' || station_id || '_' || subloc end as path from sm",
    ),
    "station_select": (
        station_select,
        f"with {HOURLY}, l as (select variable || '_' || station as label, t, case when t % 7200000000 = 0 then value * 2 else value end as value from hourly), r as (select * from (values (0, 'view_1', 'a'), (1, 'click_2', null), (2, 'none_1', null)) v(ord, label, alias)) select ord, coalesce(alias, r.label) as label, t, value from r left join l on l.label = r.label",
    ),
    "concat_sources_time_join": (
        concat_sources,
        f"with {HOURLY}, a as (select * from hourly where station % 2 = 0), b as (select * from hourly where station % 2 = 1), u as (select * from a union all select * from b), f as (select site, variable, t from (select distinct station as site from u), (select distinct variable from u), (select distinct t from a)) select f.site, f.variable, f.t, coalesce(u.value, -9999.0) as value from f left join u on u.station = f.site and u.variable = f.variable and u.t = f.t",
    ),
    "merge_th": (
        merge_th,
        f"with {HOURLY}, h as (select variable, 'l' || station as loc, t, case when t >= {START + 3 * DAY} then value + 100 else value end as value from hourly where t between {START} and {END}), g as (select v.variable, v.loc, t.t from (select distinct variable, 'l' || station as loc from hourly union all select * from (values ('view', 'l-1'), ('click', 'l-1')) w) v, (select distinct t from h) t) select g.variable, g.loc, g.t, coalesce(case when g.variable = 'click' and g.loc = 'l3' then 5.0 when g.variable = 'view' and g.loc = 'l2' and h.value is null then 7.0 else h.value end, -9999.0) as value from g left join h on h.variable = g.variable and h.loc = g.loc and h.t = g.t",
    ),
    "sign_violations": (
        lambda s, d: T.sign_violations(table(s, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "source").otherwise("sink").alias("kind"), (F.col("c_custkey") % 13).alias("loc"), F.col("c_acctbal").alias("value"))),
        "with f as (select case when c_custkey % 2 = 0 then 'source' else 'sink' end as kind, c_custkey % 13 as loc, c_acctbal as value from customer) select kind, loc, count(*) filter ((kind = 'source' and value < 0 and value > -9999) or (kind = 'sink' and value > 0)) as bad from f group by 1, 2 having count(*) filter ((kind = 'source' and value < 0 and value > -9999) or (kind = 'sink' and value > 0)) > 0",
    ),
    "missing_report": (
        lambda s, d: T.missing_report(merge_th(s, d).withColumn("value", F.when(F.col("value") != T.AMBIENT, F.col("value"))), ["variable", "loc"]),
        f"with {HOURLY}, h as (select variable, 'l' || station as loc, t, value from hourly where t between {START} and {END}), g as (select v.variable, v.loc, t.t from (select distinct variable, 'l' || station as loc from hourly union all select * from (values ('view', 'l-1'), ('click', 'l-1')) w) v, (select distinct t from h) t), m as (select g.variable, g.loc, case when g.variable = 'click' and g.loc = 'l3' then 5.0 when g.variable = 'view' and g.loc = 'l2' and h.value is null then 7.0 else h.value end as value from g left join h on h.variable = g.variable and h.loc = g.loc and h.t = g.t) select variable, loc, count(*) filter (value is null) as missing, case when count(value) = 0 then 'absent' else 'gaps' end as kind from m group by 1, 2 having count(*) filter (value is null) > 0",
    ),
    "net_source_sink": (
        lambda s, d: _R(T.net_source_sink(hourly(s, d).where("station % 2 = 0"), hourly(s, d).where("station % 2 = 1").withColumn("value", -F.col("value"))), "net"),
        f"with {HOURLY}, a as (select t, sum(value) as v from hourly where station % 2 = 0 group by 1), b as (select t, sum(-value) as v from hourly where station % 2 = 1 group by 1) select coalesce(a.t, b.t) as t, round(a.v + b.v, 6) as net from a full join b on a.t = b.t",
    ),
    "parse_point_name": (
        lambda s, d: _points(s, d).select("name").distinct().withColumns(T.point_name(F.col("name"))),
        f"with {_PTS} select distinct name, nullif(regexp_extract(name, '^(delta|suisun)_(src|sink)_([0-9]+)$', 1), '') as prefix, nullif(regexp_extract(name, '^(delta|suisun)_(src|sink)_([0-9]+)$', 2), '') as role, nullif(regexp_extract(name, '^(delta|suisun)_(src|sink)_([0-9]+)$', 3), '')::int as number from pt",
    ),
    "build_pairs": (
        lambda s, d: T.build_pairs(_points(s, d)),
        "with k as (select s_suppkey as k from supplier) select 'delta' as prefix, k::int as number, 'delta_src_' || k as src, case when k % 7 <> 0 then 'delta_sink_' || k end as sink, case when k % 7 = 0 then 'no sink' end as reason from k where k % 11 <> 3 union all select null, null, 'odd_' || k, null, 'bad name' from k where k % 11 = 3",
    ),
    "param_diff": (
        param_diff,
        "with a as (select 's' || n_regionkey as section, n_name as name, n_nationkey::varchar as value from nation), b as (select section, name, case when value::int % 4 = 0 then 'x' else value end as value from a where value::int % 5 <> 0 union all select 'r', r_name, r_regionkey::varchar from region) select section, name, a.value as a, b.value as b from a full join b using (section, name) where a.value is distinct from b.value",
    ),
    "concat_points": (
        lambda s, d: T.concat_points(_points(s, d), _points(s, d).where("name like '%1'").withColumn("x", -F.col("x"))),
        f"with {_PTS} select name, case when name like '%1' then -x else x end as x from pt",
    ),
    "merge_station_lists": (
        lambda s, d: T.repeated_stations(*[T.station_subloc_merge(_stations(s, d), _sublocs(s, d)).where(c).select(F.col("station_id").alias("id"), "subloc") for c in ("station < 60", "station >= 50")]),
        f"with {SERIES}, {_MERGED}, u as (select station_id as id, subloc from sm where station < 60 union all select station_id, subloc from sm where station >= 50) select id, subloc, count(*) as n from u group by 1, 2 having count(*) > 1",
    ),
    "missing_columns": (
        lambda s, d: T.missing_columns(table(s, d, "nation").select(F.concat(F.lit("view_"), (F.col("n_nationkey") * 3).cast("string")).alias("name"), F.col("n_nationkey").alias("ord")), series(s, d).select(F.concat("variable", F.lit("_"), F.col("station").cast("string")).alias("name"))),
        f"with {SERIES} select 'view_' || (n_nationkey * 3) as name, n_nationkey as ord from nation where 'view_' || (n_nationkey * 3) not in (select variable || '_' || station from series)",
    ),
    "wanted_unwanted": (
        lambda s, d: T.wanted_unwanted(19720 * 1440, 19760 * 1440, series(s, d).select(F.floor(F.col("t") / 60_000_000).cast("long").alias("block"))),
        f"with {SERIES}, w as (select distinct t // 60000000 as b from series) select x as block, b is not null as wanted from (select unnest(generate_series(19720 * 1440, 19760 * 1440)) as x) left join w on b = x",
    ),
    "ordered_distinct": (lambda s, d: T.ordered_distinct(series(s, d), "variable", "t"), f"with {SERIES}, f as (select variable, min(t) as m from series group by 1) select variable, row_number() over (order by m, variable)::int - 1 as ord from f"),
    "pair_status_counts": (
        lambda s, d: T.status_counts(T.build_pairs(_points(s, d)).select(F.coalesce("reason", F.lit("paired")).alias("status"), F.when(F.col("reason").isNull(), "ok").otherwise("warn").alias("severity"))),
        "with k as (select s_suppkey as k from supplier), p as (select case when k % 11 = 3 then 'bad name' when k % 7 = 0 then 'no sink' else 'paired' end as status, case when k % 11 = 3 or k % 7 = 0 then 'warn' else 'ok' end as severity from k) select status, severity, count(*) as n, grouping_id(status, severity)::bigint as level from p group by rollup (status, severity)",
    ),
    "run_speed": (
        lambda s, d: _R(T.run_speed(table(s, d, "orders").select((F.col("o_custkey") % 10).alias("run"), F.col("o_orderkey").alias("sim_t"), (F.col("o_orderkey") * 2 + F.col("o_orderkey") % 5).alias("wall_t"))), "mean", "median"),
        "with o as (select o_custkey % 10 as run, o_orderkey as s, o_orderkey * 2 + o_orderkey % 5 as w from orders), l as (select run, s - lag(s) over v as ds, w - lag(w) over v as dw from o window v as (partition by run order by s)) select run, round(avg(ds / dw::double), 6) as mean, round(median(ds / dw::double), 6) as median from l where ds is not null and dw > 0 group by 1",
    ),
    "canopy_height": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.round(T.canopy_height(F.col("p_partkey") % 4, (F.col("p_partkey") % 3).cast("int"), (F.col("p_retailprice") - 1000) / 100, [0.0, 0.4, 0.9], 0.3, 2.7, 1.5, 100.0) + 1e-9, 6).alias("height")),
        "select p_partkey, round(case p_partkey % 4 when 0 then 0.0 when 2 then 1.5 when 3 then 100.0 else least(case when p_partkey % 3 > 0 then greatest([0.0, 0.4, 0.9][p_partkey % 3 + 1]::double * greatest((p_retailprice - 1000) / 100, 0), 0.3) else 0 end, 2.7) end::double + 1e-9, 6) as height from part",
    ),
    "bin_map": (
        lambda s, d: table(s, d, "part").select("p_partkey", T.bin_map(F.col("p_retailprice"), [950.0, 1000.0, 1500.0], [0.1, 0.2, 0.3, 0.4]).alias("cls")),
        "select p_partkey, case when p_retailprice >= 1500 then 0.4 when p_retailprice >= 1000 then 0.3 when p_retailprice >= 950 then 0.2 else 0.1 end::double as cls from part",
    ),
    "bound_linear": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.round(T.bound_linear(F.col("p_retailprice"), 950.0, 1400.0, 0.2, 0.9) + 1e-9, 6).alias("v")),
        "select p_partkey, round(least(greatest(0.2::double + (p_retailprice - 950) * (0.9::double - 0.2::double) / 450, 0.2), 0.9)::double + 1e-9, 6) as v from part",
    ),
    "cycle_time": (
        lambda s, d: series(s, d).select("station", "t", T.cycle_time(F.floor(F.pmod("t", F.lit(DAY)) / HOUR), 6).alias("down"), T.cycle_time(F.floor(F.pmod("t", F.lit(DAY)) / HOUR), 6, up=True).alias("up")),
        f"with {SERIES} select station, t, floor((t % {DAY} // {HOUR}) / 6.0)::bigint * 6 % 24 as down, ceil((t % {DAY} // {HOUR}) / 6.0)::bigint * 6 % 24 as up from series",
    ),
}
