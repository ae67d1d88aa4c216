"""Queries over more text formats, written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.jobs.feeds import START
from tidewater.sources import lines as L, text as X, writers as W
from tidewater.sources.bridge import ELEM, LEVEL, MESH, NODE, SERIES, elem_node, level, node, series, table

TYPES = ["click", "error", "purchase", "signup", "view"]
MINUTE = 60_000_000
MOST = 12


def _cells(s, d):
    """One value a station, minute and type, with one decimal."""
    e = series(s, d)
    t = F.col("t") - F.pmod("t", F.lit(MINUTE))
    return e.groupBy(F.concat(F.lit("f"), F.col("station").cast("string")).alias("file"), t.alias("t"), F.col("variable").alias("name")).agg((F.floor(F.max(F.col("value")) * 10) / 10).alias("value"))


def _source_files(s, d):
    """Dated histories whose values have one to three decimals, by minute; some rows have a comment."""
    c = _cells(s, d)
    wide = c.groupBy("file", "t").pivot("name", TYPES).agg(F.max("value"))
    digits = F.pmod(F.floor(F.col("t") / MINUTE), F.lit(3)) + 1
    cell = lambda n: F.when(F.col(n).isNull(), "nan").otherwise(F.call_function("printf", F.concat(F.lit("%."), digits.cast("string"), F.lit("f")), F.col(n)))
    stamp = F.date_format(F.expr("timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, t / 1000000)"), "yyyy-MM-dd'T'HH:mm")
    note = F.when(F.pmod(F.floor(F.col("t") / MINUTE), F.lit(7)) == 0, "# seen by hand")
    lines = wide.select("file", "t", F.concat_ws(" ", stamp, *map(cell, TYPES), note).alias("raw"))
    return lines.groupBy("file").agg(F.concat(F.lit("# source\ndatetime " + " ".join(TYPES) + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "raw"))), lambda r: r["raw"]), "\n")).alias("content"))


def formats(s, d):
    return W.th_formats(_source_files(s, d))


def th_lines(s, d):
    files = _source_files(s, d)
    return W.write_th_lines(X.read_th_dated(files), W.th_formats(files))


def _stations(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select((k * 3).alias("pos"), (k * 1.5).alias("x"), (k * 0.25).alias("y"), F.lit(-0.5).alias("z"), F.concat(F.lit("s"), k.cast("string")).alias("station_id"), F.when(k % 2 == 0, "upper").otherwise("default").alias("subloc"), F.concat(F.lit("Station "), k.cast("string")).alias("name"))


def _output(s, d):
    own = F.array_position(F.array(*map(F.lit, TYPES)), F.col("name")).cast("int") - 1
    return _cells(s, d).select("file", "t", own.alias("pos"), F.when(F.pmod(F.floor(F.col("t") / MINUTE), F.lit(5)) != 0, F.col("value")).alias("value"))


def _broken(s, d):
    """A transposed grid whose lowest levels are given one too high at every ninth node and one too low at every eleventh."""
    lines = W.write_vgrid_levels(level(s, d), MOST, "vgrid")
    off = F.transform(X._tokens(F.col("raw")), lambda v, i: F.format_string("%10d", v.cast("long") + F.when(F.pmod(F.col("block") * W.BLOCK + i, F.lit(9)) == 0, 1).when(F.pmod(F.col("block") * W.BLOCK + i, F.lit(11)) == 0, -1).otherwise(0)))
    return lines.withColumn("raw", F.when(F.col("line_no") == 2, F.array_join(off, " ")).otherwise(F.col("raw")))


def _2dm(s, d):
    n, e = node(s, d), elem_node(s, d)
    nodes = n.select((F.col("node_id") + 1).alias("line_no"), F.format_string("ND %d %.6f %.6f %.6f", F.col("node_id") + 1, "x", "y", "depth").alias("raw"))
    ring = e.groupBy("elem_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("r"))
    corners = F.array_join(F.transform("r", lambda c: (c["node_id"] + 1).cast("string")), " ")
    elems = ring.select((F.col("elem_id") + 10**12).alias("line_no"), F.concat_ws(" ", F.when(F.size("r") == 3, "E3T").otherwise("E4Q"), (F.col("elem_id") + 1).cast("string"), corners, F.lit("1")).alias("raw"))
    # A string of every row of 20 nodes, ten nodes a line, the last of each negative.
    part = n.withColumn("line_no", F.floor(F.col("node_id") / 10))
    signed = F.when(F.pmod("node_id", F.lit(20)) == 19, -(F.col("node_id") + 1)).otherwise(F.col("node_id") + 1)
    strings = part.groupBy("line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", signed.alias("v")))), lambda r: r["v"].cast("string")), " ").alias("ids"))
    strings = strings.select((F.col("line_no") + 2 * 10**12).alias("line_no"), F.concat(F.lit("NS  "), F.col("ids")).alias("raw"))
    return nodes.unionByName(elems).unionByName(strings).withColumn("file", F.lit("mesh"))


def _props(s, d):
    return elem_node(s, d).select("elem_id").distinct().withColumn("value", F.pmod("elem_id", F.lit(5)).cast("double"))


def named(s, d):
    sources = table(s, d, "nation").select(F.explode(F.array(F.lit("flow"), F.lit("tracer"))).alias("file"), F.col("n_nationkey").alias("ord"), F.lower("n_name").alias("name"))
    k = F.col("s_suppkey")
    flow = table(s, d, "supplier").select(F.lit("flow").alias("file"), k.alias("row_no"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("pos"))
    tracer = table(s, d, "supplier").select(F.lit("tracer").alias("file"), k.alias("row_no"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("pos"))
    return W.name_source_columns(flow.unionByName(tracer).withColumn("value", F.col("row_no") * 100.0 + F.col("pos")), sources)


def skipped(s, d):
    files = _source_files(s, d)
    rows = X.read_th_dated(files).join(W.th_formats(files).select("file", "name", "pos"), ["file", "name"])
    return W.skip_nan_rows(rows).select("file", "row_no", "name", "value")


def ingested(s, d):
    k = F.col("o_orderkey")
    names = F.element_at(F.array(*map(F.lit, ["elevation", "salinity", "dryFlagElement", "flow_side", "out2d"])), (F.pmod(k, F.lit(5)) + 1).cast("int"))
    files = table(s, d, "orders").select(F.concat(names, F.lit("_"), F.floor(k / 5).cast("string"), F.when(F.pmod(k, F.lit(13)) == 0, ".txt").otherwise(".nc")).alias("file"))
    return W.ingest_field(files, ["elevation", "dryFlagElement", "flow_side"], {"dryFlagElement": "face", "flow_side": "edge"})


_IN = "', '".join(TYPES)
CELLS = SERIES + f", c as (select 'f' || station as file, t - t % {MINUTE} as t, variable as name, floor(max(value) * 10) / 10 as value from series group by 1, 2, 3)"
_DIGITS = f"(t // {MINUTE}) % 3 + 1"
_FORMATS = f"fm as (select file, name, max(case when value is not null then {_DIGITS} else 0 end)::int as decimals from (select g.file, g.t, n.name, c.value from (select distinct file, t from c) g, (select unnest(['{_IN}']) as name) n left join c on c.file = g.file and c.t = g.t and c.name = n.name) group by 1, 2)"
_POS = f"list_position(['{_IN}'], name)::int - 1"

QUERIES = {
    "th_formats": (formats, f"with {CELLS}, {_FORMATS} select file, {_POS} as pos, name, decimals from fm"),
    "write_th_lines": (
        th_lines,
        f"""with {CELLS}, {_FORMATS}, row as (select g.file, g.t, string_agg(case when c.value is null then 'nan' else printf('%.' || fm.decimals || 'f', c.value) end, ' ' order by fm.name) as v from (select distinct file, t from c) g join fm on fm.file = g.file left join c on c.file = g.file and c.t = g.t and c.name = fm.name group by 1, 2)
select file, 2 as section, t as at, strftime(make_timestamp(t), '%Y-%m-%dT%H:%M') || ' ' || v || case when (t // {MINUTE}) % 7 = 0 then ' # seen by hand' else '' end as raw from row union all select distinct file, 1, 0, 'datetime {" ".join(TYPES)}' from c""",
    ),
    "write_station_in": (
        lambda s, d: W.write_station_in(_stations(s, d), ["elev", "salt"], "station.in"),
        """select 'station.in' as file, 0 as line_no, '1 0 0 0 0 1 0 0 0 !elev,air pressure,wind_x,wind_y,temp,salt,u,v,w' as raw union all select 'station.in', 1, count(*)::varchar from supplier
union all select 'station.in', row_number() over (order by s_suppkey) + 1, row_number() over (order by s_suppkey) || printf(' %.2f %.2f -0.50 ! s%d %s "Station %d"', s_suppkey * 1.5, s_suppkey * 0.25, s_suppkey, case when s_suppkey % 2 = 0 then 'upper' else 'default' end, s_suppkey) from supplier""",
    ),
    "write_station_output": (
        lambda s, d: W.write_station_output(_output(s, d), START),
        f"""with {CELLS}, w as (select file, max({_POS}) as most from c group by 1), p as (select file, unnest(range(0, most + 1)) as pos from w), g as (select distinct file, t from c),
o as (select c.file, c.t, {_POS} as pos, case when (t // {MINUTE}) % 5 <> 0 then value end as value from c)
select g.file, g.t as at, printf('%.6E', (g.t - {START}) / 1e6) || chr(9) || string_agg(case when coalesce(o.value, -999) = -999 then '-999' else printf('%.6E', o.value) end, chr(9) order by p.pos) as raw from g join p using (file) left join o on o.file = g.file and o.t = g.t and o.pos = p.pos group by 1, 2""",
    ),
    "write_vgrid_levels": (
        lambda s, d: W.write_vgrid_levels(level(s, d), MOST, "vgrid"),
        f"""with {LEVEL}, n as (select node_id, {MOST} - count(*) as kbp from level group by 1), f as (select node_id, kbp, unnest(range(0, {MOST})) as l from n), c as (select f.node_id, l, coalesce(sigma, -9.0) as v from f left join level on level.node_id = f.node_id and level.k = l - kbp)
select 'vgrid' as file, 0 as line_no, 0 as block, '1' as raw union all select 'vgrid', 1, 0, '{MOST}' union all select 'vgrid', 2, node_id // {W.BLOCK}, string_agg(printf('%10d', kbp + 1), ' ' order by node_id) from n group by 3
union all select 'vgrid', l + 3, node_id // {W.BLOCK}, case when node_id // {W.BLOCK} = 0 then printf('%10d', l + 1) || ' ' else '' end || string_agg(printf('%14.6f', v), ' ' order by node_id) from c group by 2, 3, l""",
    ),
    "read_vgrid_levels": (
        lambda s, d: W.read_vgrid_levels(W.write_vgrid_levels(level(s, d), MOST, "vgrid"))[0],
        f"with {LEVEL} select 'vgrid' as file, node_id, k::bigint as k, sigma from level",
    ),
    "vgrid_pad_issues": (
        lambda s, d: W.pad_issues(_broken(s, d)),
        f"""with {LEVEL}, n as (select node_id, {MOST} - count(*) + 1 as own from level group by 1)
select 'vgrid' as file, node_id, own + case when node_id % 9 = 0 then 1 else -1 end as kbp, case when node_id % 9 = 0 then 0 else 1 end as missing, case when node_id % 9 = 0 then 1 else 0 end as extra from n where node_id % 9 = 0 or node_id % 11 = 0""",
    ),
    "read_2dm_nodes": (lambda s, d: W.read_2dm(_2dm(s, d))[0], f"with {NODE} select 'mesh' as file, node_id + 1 as node_id, x, y, round(depth, 6) as z from node"),
    "read_2dm_elements": (lambda s, d: W.read_2dm(_2dm(s, d))[1], f"with {ELEM} select 'mesh' as file, elem_id + 1 as elem_id, pos::int as pos, node_id + 1 as node_id from elem_node"),
    "read_2dm_strings": (lambda s, d: W.read_2dm(_2dm(s, d))[2], f"with {NODE} select 'mesh' as file, node_id // 20 as string_no, (node_id % 20)::int as seq, node_id + 1 as node_id from node"),
    "prop_round_trip": (lambda s, d: W.read_prop(W.write_prop(_props(s, d), "p")), f"with {ELEM} select 'p' as file, elem_id, (elem_id % 5)::double as value from elem"),
    "name_source_columns": (
        named,
        """with f as (select 'flow' as file, s_suppkey as row_no, unnest(range(0, 25)) as pos from supplier union all select 'tracer', s_suppkey, unnest(range(0, 100)) from supplier)
select file, row_no, pos::int as pos, lower(n_name) as source, v as variable, coalesce(v || '_', '') || lower(n_name) as label, row_no * 100.0::double + pos as value
from (select *, case when file = 'flow' then null when pos < 25 then 'T' when pos < 50 then 'S' else 'B' || (pos // 25 - 1) end as v from f) join nation on n_nationkey = pos % 25""",
    ),
    "skip_nan_rows": (
        skipped,
        f"""with {CELLS}, g as (select file, t, row_number() over (partition by file order by t) - 1 as row_no from (select distinct file, t from c)), k as (select g.* from g join c on c.file = g.file and c.t = g.t and c.name = '{TYPES[-1]}')
select k.file, k.row_no, n.name, c.value from k, (select unnest(['{_IN}']) as name) n left join c on c.file = k.file and c.t = k.t and c.name = n.name""",
    ),
    "ingest_field": (
        ingested,
        """with f as (select ['elevation', 'salinity', 'dryFlagElement', 'flow_side', 'out2d'][o_orderkey % 5 + 1] as v, o_orderkey // 5 as b, o_orderkey % 13 = 0 as other from orders)
select v || '_' || b || '.nc' as file, v as variable, b as block, case v when 'dryFlagElement' then 'face' when 'flow_side' then 'edge' else 'node' end as place from f where v in ('elevation', 'dryFlagElement', 'flow_side') and not other""",
    ),
}
