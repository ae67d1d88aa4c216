"""Queries over line formats, casts, masked fields and patches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tidewater.functions import columns as C
from tidewater.jobs.places import CELL, POLY, POLYGONS, RASTER, _hit, _polygons, _raster
from tidewater.operators import casts as K, mesh as M, spatial as P
from tidewater.sources import lines as L
from tidewater.sources.bridge import DAY, HOUR, HOURLY, LEVEL, MESH, NODE, SERIES, elem_node, hourly, level, node, series, table
from tidewater.streaming import feeds as R

START = 1_704_067_200_000_000  # 2024-01-01
NAMES = ["Click", "View"]


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


def _strings(s, d):
    k = F.col("node_id")
    n = node(s, d)
    row = lambda kind, no, where: n.where(where).select(F.lit(kind).alias("kind"), F.lit(no).alias("string_no"), k.alias("seq"), "node_id")
    return row("open", 1, k < 20).unionByName(row("land", 1, F.pmod(k, F.lit(20)) == 0)).unionByName(row("land", 2, F.pmod(k, F.lit(20)) == 19))


def _gr3(s, d, part: int):
    return L.read_gr3(L.write_gr3(node(s, d), elem_node(s, d), _strings(s, d), "mesh"))[part]


def source_sink(s, d):
    k = F.col("s_suppkey")
    rows = table(s, d, "supplier").select((k + 1).alias("line_no"), F.format_string("%d ! %s_%d", k, F.element_at(F.array(*map(F.lit, ["delta_src", "suisun_src", "dicu", "potw", "other"])), (F.pmod(k, F.lit(5)) + 1).cast("int")), k).alias("raw"))
    sinks = rows.where("line_no % 3 = 0").select((F.col("line_no") + 1_000_000_000_000).alias("line_no"), "raw")
    heads = s.createDataFrame([(0, "9 ! total # of elems with sources"), (999_999_999_999, ""), (1_000_000_000_000, "3 ! total # of elems with sinks")], "line_no long, raw string")
    return L.read_source_sink(rows.unionByName(sinks).unionByName(heads).withColumn("file", F.lit("f")))


def _cruise(s, d):
    e = table(s, d, "events")
    salinity = F.when(F.pmod("event_id", F.lit(41)) == 5, "n/a").otherwise(F.format_string("%.2f", F.round(F.col("value") + 1e-9, 2)))
    raw = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm"), F.format_string("%d.0", "user_id"), F.format_string("%d", F.pmod("event_id", F.lit(30))), salinity)
    return L.read_cruise(e.select(F.format_string("c%d", F.pmod("user_id", F.lit(3))).alias("file"), F.col("event_id").alias("line_no"), raw.alias("raw")))


_CRUISE = """cr as (select 'c' || user_id % 3 as file, event_id, user_id::varchar as station, epoch_us(date_trunc('minute', ts)) as t, (event_id % 30)::double as depth, case when event_id % 41 <> 5 then round(value + 1e-9, 2) end as salinity from events),
bd as (select file, station, max(event_id) as bad from cr where salinity is null group by 1, 2), kp as (select cr.* from cr left join bd using (file, station) where bad is null or event_id > bad),
fs as (select file, station, min_by(t, event_id) as t from kp group by 1, 2), cruise as (select kp.file, kp.station, fs.t, depth, salinity from kp join fs on fs.file = kp.file and fs.station = kp.station)"""


def station_db(s, d):
    k = F.col("s_suppkey")
    raw = F.format_string("'S%d',%d.5,%d.25,\"Station, %d\",\"a'%d'\" # note, %d", k, k, k, k, k, k)
    rows = table(s, d, "supplier").select(F.format_string("f%d", F.pmod(k, F.lit(2))).alias("file"), k.alias("line_no"), raw.alias("raw"))
    return L.read_station_db(rows.unionByName(rows.where("line_no % 10 = 3")).unionByName(s.createDataFrame([("f0", -2, "# stations"), ("f0", -1, "station_id,x,y,name,agency_id"), ("f1", -1, "")], "file string, line_no long, raw string")))


def _listed(s, d, head: str, raw) -> DataFrame:
    """Lines of two files, made of suppliers, under a comment and a header."""
    k = F.col("s_suppkey")
    rows = table(s, d, "supplier").select(F.format_string("f%d", F.pmod(k, F.lit(2))).alias("file"), k.alias("line_no"), raw.alias("raw"))
    heads = [(f, n, text) for f in ("f0", "f1") for n, text in ((-3, "# made of suppliers"), (-2, ""), (-1, head))]
    return rows.unionByName(s.createDataFrame(heads, "file string, line_no long, raw string"))


def station_sublocs(s, d):
    k = F.col("s_suppkey")
    raw = F.format_string("S%d, \"%s\",note %d,-%d.5 # at %d", F.floor(k / 2), F.when(k % 4 < 2, "upper, left").otherwise("lower"), k, k, k)
    return L.read_station_sublocs(_listed(s, d, "station_id,subloc,remark,z", raw))


def obs_links(s, d):
    k = F.col("s_suppkey")
    raw = F.format_string("%s,S%d,default,file_%d.csv,%s", F.when(k % 3 == 0, "elev").otherwise("flow"), k, k, F.when(k % 5 == 0, "").otherwise(F.format_string("-0.%d", k % 7)))
    return L.read_obs_links(_listed(s, d, "variable,station_id,subloc,filename,datum_adj", raw))


def flux(s, d):
    wide = hourly(s, d).where("variable in ('view', 'click')").groupBy("station", "t").pivot("variable", ["click", "view"]).agg(F.max("value"))
    cell = lambda c: F.coalesce(F.format_string("%.2f", F.when(F.col(c).isNotNull(), F.round(F.col(c) + 1e-9, 2))), F.lit("nan"))
    text = F.concat_ws(" ", F.format_string("%.6f", (F.col("t") - START) / DAY), *[F.when(F.col(c).isNull(), "nan").otherwise(cell(c)) for c in ("click", "view")])
    return L.read_flux(wide.select(F.format_string("f%d", "station").alias("file"), F.col("t").alias("line_no"), text.alias("raw")), NAMES, START)


def archived(s, d):
    e = series(s, d).select(F.format_string("%s_%d", "variable", F.pmod("station", F.lit(3))).alias("file"), "station", "t", "value")
    return L.archive_series([(e, "base", "run_a"), (e.where("station % 2 = 0").withColumn("value", F.col("value") + 1), "more", "run_b")])


def _cast(s, d):
    return M.build_z(level(s, d), node(s, d)).select("node_id", (-F.col("z")).alias("z"), F.round(F.col("z") * 2 + F.pmod("node_id", F.lit(7)), 6).alias("value"))


def _holes(s, d):
    return level(s, d).select("node_id", "k", F.when((F.col("k") >= F.pmod("node_id", F.lit(4))) & (F.pmod(F.col("node_id") + F.col("k"), F.lit(5)) != 2), F.col("sigma")).alias("value"))


def requests(s, d):
    places = series(s, d).select("station").distinct().select(F.col("station").cast("string").alias("station"), (F.col("station") * 2.5).alias("x"), (F.col("station") * 0.5).alias("y"))
    return K.cast_requests(_cruise(s, d), places, START)


def multirun(s, d):
    h = hourly(s, d).select(F.format_string("%s_%d", "variable", "station").alias("label"), "t", "value", F.lit(0).alias("pos"))
    request = s.createDataFrame([(0, "view_1", "a"), (1, "click_2", None), (2, "none_1", None)], "ord int, label string, alias string")
    return K.multirun_subset([("one", h), ("two", h.where("t % 7200000000 = 0"))], request)


def patched(s, d):
    n = node(s, d)
    first = P.points_in_polygon(n, _polygons(s), CELL).groupBy("node_id").agg(F.min("poly_id").alias("p"))
    names = F.element_at(F.array(*[F.lit(p["name"]) for p in POLYGONS]), F.col("p") + 1)
    restart = n.where("node_id % 5 <> 0").select("node_id", (F.col("depth") * 2).alias("value"))
    return _r(K.patch_init(n, first.select("node_id", names.alias("region")), {"channel": F.lit(12.5), "shelf": F.col("x") * 0.1 + 3, "basin": restart}, F.col("depth")), "value")


def blurred(s, d):
    return _r(K.raster_blur(_raster(s, d).withColumn("val", F.col("val").cast("double")), 1.0), "val")


def colors(s, d):
    k = F.col("p_partkey")
    pixels = table(s, d, "part").select(k.alias("pixel"), (F.pmod(k, F.lit(3)) * 90).alias("r"), (F.pmod(k, F.lit(2)) * 60).alias("g"), F.lit(10).cast("long").alias("b"))
    return K.color_to_class(pixels, s.createDataFrame([(i * 90, j * 60, 10, i * 2 + j) for i in range(3) for j in range(2)], "r long, g long, b long, class int"))


def times(s, d):
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, F.format_string("%d s", k * 100)).when(k % 3 == 1, F.format_string("%d.5d", k)).otherwise(F.format_string("%d days", k))
    own = table(s, d, "supplier").select("s_suppkey", C.seconds(text).alias("sec"))
    return own.withColumns(C.model_step(F.col("sec"), 90.0)).withColumn("step", F.round(F.col("step") + 1e-9, 6))


def fields(s, d):
    own = level(s, d).join(node(s, d), "node_id")
    z = F.col("depth") * F.col("sigma")
    return _r(own.select("node_id", "k", C.near_surface_temperature(F.col("x") / 30, z, F.pmod("node_id", F.lit(3)) != 0).alias("temperature"), C.reference_surface(F.col("x"), F.col("y"), 20.0, 0.1, 100.0, 5.0, 0.02).alias("surface")), "temperature", "surface")


def flags(s, d):
    own = series(s, d).where(F.col("variable").contains("i"))
    unit = F.element_at(F.array(*map(F.lit, ["m", "cms", "psu"])), (F.pmod("station", F.lit(3)) + 1).cast("int"))
    return _r(own.select("station", "variable", "t", C.from_si(C.flag_mask(F.col("value"), F.pmod("station", F.lit(4))), unit).alias("value")), "value")


_BLUR = ", ".join(f"({i}, {math.exp(-i * i / 2)!r}::double)" for i in range(-4, 5))
_CAST = NODE + ", " + LEVEL + ", ca as (select l.node_id, -greatest(depth, 0.1::double) * sigma as z, round(greatest(depth, 0.1::double) * sigma * 2 + l.node_id % 7, 6) as value from level l join node using (node_id))"
_HOLES = LEVEL + ", f as (select node_id, k, case when k >= node_id % 4 and (node_id + k) % 5 <> 2 then sigma end as value from level)"

QUERIES = {
    "read_gr3_nodes": (lambda s, d: _gr3(s, d, 0), f"with {NODE} select 'mesh' as file, node_id + 1 as node_id, x, y, depth from node"),
    "read_gr3_elems": (lambda s, d: _gr3(s, d, 1), f"with {MESH}, e as (select elem_id, row_number() over (order by elem_id) as n from elem) select 'mesh' as file, n as elem_id, pos::int as pos, node_id + 1 as node_id from elem_node join e using (elem_id)"),
    "read_gr3_strings": (
        lambda s, d: _gr3(s, d, 2),
        f"with {NODE}, st as (select 'open' as kind, 1 as string_no, node_id from node where node_id < 20 union all select 'land', 1, node_id from node where node_id % 20 = 0 union all select 'land', 2, node_id from node where node_id % 20 = 19) select 'mesh' as file, kind, string_no, row_number() over (partition by kind, string_no order by node_id) as seq, node_id + 1 as node_id from st",
    ),
    "read_vgrid": (lambda s, d: L.read_vgrid(L.write_vgrid(level(s, d), 10, "v")), f"with {LEVEL} select 'v' as file, node_id + 1 as node_id, 11 - count(*) over (partition by node_id) as kbp, k, sigma from level"),
    "read_source_sink": (
        source_sink,
        "with r as (select s_suppkey as k, ['delta_src', 'suisun_src', 'dicu', 'potw', 'other'][s_suppkey % 5 + 1] || '_' || s_suppkey as name, ['delta', 'suisun', 'dicu', 'potw', 'unknown'][s_suppkey % 5 + 1] as origin from supplier) select 'f' as file, 'source' as role, k as elem, name, origin from r union all select 'f', 'sink', k, name, origin from r where (k + 1) % 3 = 0",
    ),
    "read_cruise": (_cruise, f"with {_CRUISE} select * from cruise"),
    "cast_requests": (requests, f"with {_CRUISE}, e as (select distinct file, station, t from cruise) select file, (row_number() over (partition by file order by t, station))::int as cast_no, station, station::int * 2.5::double as x, station::int * 0.5::double as y, (t - {START}) / 1e6 as elapsed from e"),
    "read_station_db": (
        station_db,
        "select 'f' || s_suppkey % 2 as file, 's' || s_suppkey as station_id, 'a' || s_suppkey as agency_id, s_suppkey + 0.5::double as x, s_suppkey + 0.25::double as y, 'Station, ' || s_suppkey as name, n as repeats from (select *, unnest(range(n)) from (select s_suppkey, case when s_suppkey % 10 = 3 then 2 else 1 end as n from supplier))",
    ),
    "read_station_sublocs": (
        station_sublocs,
        "select 'f' || s_suppkey % 2 as file, 'S' || s_suppkey // 2 as station_id, case when s_suppkey % 4 < 2 then 'upper, left' else 'lower' end as subloc, -s_suppkey - 0.5::double as z from supplier",
    ),
    "read_obs_links": (
        obs_links,
        "select 'f' || s_suppkey % 2 as file, 's' || s_suppkey as station_id, 'default' as subloc, case when s_suppkey % 3 = 0 then 'elev' else 'flow' end as variable, 'file_' || s_suppkey || '.csv' as filename, null::varchar as selector, case when s_suppkey % 5 <> 0 then -(s_suppkey % 7) / 10.0::double end as datum_adj from supplier",
    ),
    "read_flux": (
        flux,
        f"with {HOURLY}, w as (select station, t, max(value) filter (variable = 'click') as click, max(value) filter (variable = 'view') as view from hourly where variable in ('view', 'click') group by 1, 2), n as (select *, row_number() over (partition by station order by t) - 1 as row_no from w), dt as (select station, max(t) - min(t) as dt from n where row_no < 2 group by 1) select 'f' || station as file, row_no, {START} + row_no * dt as t, v.name, round(case v.name when 'click' then click else view end + 1e-9, 2) as value from n join dt using (station), (values ('click'), ('view')) v(name)",
    ),
    "archive_series": (
        archived,
        f"with {SERIES}, a as (select 'base' as scenario, 'run_a' as rundir, variable, station % 3 as shard, station, t, value from series) select * from a union all select 'more', 'run_b', variable, shard, station, t, value + 1 from a where station % 2 = 0",
    ),
    "profile_regrid": (
        lambda s, d: _r(K.profile_regrid(_cast(s, d).where("z > 0.5"), ["node_id"]), "value"),
        f"with {_CAST}, p as (select * from ca where z > 0.5), g as (select node_id, unnest(range(0, floor(max(z))::bigint + 1))::double as z from p group by 1), lo as (select g.node_id, g.z, struct_pack(z := p.z, v := p.value) as a from g asof left join p on p.node_id = g.node_id and g.z >= p.z), hi as (select g.node_id, g.z, struct_pack(z := p.z, v := p.value) as b from g asof left join p on p.node_id = g.node_id and g.z <= p.z), near as (select node_id, z, case when a.z is not null then a end as a, case when b.z is not null then b end as b from lo join hi using (node_id, z)), o as (select node_id, z, case when a.z = b.z then a.v else a.v + (z - a.z) / (b.z - a.z) * (b.v - a.v) end as value from near) select o.node_id, o.z, round(case when o.z = 0 then coalesce(o.value, n.value) else o.value end + 1e-9, 6) as value from o left join o n on n.node_id = o.node_id and n.z = 1",
    ),
    "cast_to_levels": (
        lambda s, d: _r(K.cast_to_levels(_cast(s, d), node(s, d).select("node_id", F.explode(F.array(*map(F.lit, [-1.5, 0.7, 4.2, 88.8]))).alias("z")), ["node_id"]), "value"),
        f"with {_CAST}, p as (select node_id, list(struct_pack(z := z, v := value) order by z) as p from ca group by 1), t as (select node_id, unnest([-1.5::double, 0.7, 4.2, 88.8]) as z, p from p), i as (select *, greatest(least(len([x for x in p if x.z <= t.z]), len(p) - 1), 1) as i from t), ab as (select node_id, z, p[i] as a, p[i + 1] as b from i) select node_id, z, round(a.v + (z - a.z) * ((b.v - a.v) / (b.z - a.z)) + 1e-9, 6) as value from ab",
    ),
    "bottom_fill": (lambda s, d: K.bottom_fill(_holes(s, d), ["node_id"]), f"with {_HOLES}, l as (select node_id, min(k) as lk, min_by(value, k) as lv from f where value is not null group by 1) select node_id, k, case when value is null and k < lk then lv else value end as value from f left join l using (node_id)"),
    "column_max_fill": (lambda s, d: K.column_max_fill(_holes(s, d), ["node_id"]), f"with {_HOLES} select node_id, k, coalesce(value, max(value) over (partition by node_id)) as value from f"),
    "daily_blocks": (
        lambda s, d: K.daily_blocks(hourly(s, d), ["station", "variable"], DAY, HOUR),
        f"with {HOURLY}, o as (select *, t // {DAY} as day from hourly), h as (select distinct station, variable, day, h.hour from o, (select unnest(range(24))::int as hour) h) select h.*, min(o.t) as t, min_by(o.value, o.t) as value from h left join o on o.station = h.station and o.variable = h.variable and o.day = h.day and o.t >= h.day * {DAY} + h.hour * {HOUR} group by 1, 2, 3, 4",
    ),
    "multirun_subset": (
        multirun,
        f"with {HOURLY}, r as (select * from (values (0, 'view_1', 'a'), (1, 'click_2', null), (2, 'none_1', null)) v(ord, label, alias)) select ord, coalesce(alias, label) as label, t, value, sim from r join hourly on variable || '_' || station = label, (values ('one'), ('two')) m(sim) where sim = 'one' or t % 7200000000 = 0",
    ),
    "patch_init": (
        patched,
        f"with {NODE}, {POLY}, {_hit('node', 'node_id')}, f as (select node_id, min(poly_id) as p from hit group by 1), v as (select node_id, case when p = 0 then 12.5::double when p = 1 then x * 0.1::double + 3 when p = 2 then case when node_id % 5 <> 0 then depth * 2 end else depth end as v from node left join f using (node_id)) select node_id, round(v + 1e-9, 6) as value, v is null as missing from v",
    ),
    "raster_blur": (
        blurred,
        f"with {RASTER}, w as (select * from (values {_BLUR}) v(i, w)), a as (select r, c + i as c, sum(w * val) / sum(w) as val from ras, w group by 1, 2), b as (select a.* from a join ras using (r, c)), e as (select r + i as r, c, sum(w * val) / sum(w) as val from b, w group by 1, 2) select e.r as row, e.c as col, round(e.val + 1e-9, 6) as val from e join ras using (r, c)",
    ),
    "color_to_class": (colors, "select p_partkey as pixel, p_partkey % 3 * 90 as r, p_partkey % 2 * 60 as g, 10::bigint as b, (p_partkey % 3 * 2 + p_partkey % 2)::int as class from part"),
    "describe_times": (times, "with t as (select s_suppkey, case s_suppkey % 3 when 0 then s_suppkey * 100.0::double when 1 then (s_suppkey + 0.5::double) * 86400 else s_suppkey * 86400.0::double end as sec from supplier) select s_suppkey, sec, round(sec / 90 + 1e-9, 6) as step, sec % 90 > 1e-6 as off from t"),
    "field_corrections": (
        fields,
        f"with {NODE}, {LEVEL} select node_id, k, round(greatest(case when node_id % 3 <> 0 and depth * sigma > -10 then x / 30 - 1 else x / 30 end, 0) + 1e-9, 6) as temperature, round(greatest((x - 20) * 0.1::double + case when x > 100 then (y - 5) * 0.02::double else 0 end, 0) + 1e-9, 6) as surface from level join node using (node_id)",
    ),
    "flags_and_units": (flags, f"with {SERIES} select station, variable, t, round(case when station % 4 = 1 then null when station % 3 = 0 then value / 0.3048::double when station % 3 = 1 then value / 0.028316846592::double else value end + 1e-9, 6) as value from series where contains(variable, 'i')"),
    "stream_block_completeness": (
        lambda s, d: R.run_to_end(R.block_completeness(R.read_feed(s, d), 4)),
        f"with {SERIES}, b as (select station, t - t % {5 * DAY} as a, count(distinct variable) as n from series group by 1, 2) select station, a, n, n >= 4 as complete from b where a + {5 * DAY} <= (select (max(t) // 1000) * 1000 - {DAY} from series)",
    ),
}
