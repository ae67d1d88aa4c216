"""Readers and writers over tables of numbered lines (``file, line_no, raw``).

A large file's lines are rows of their own, so that no task holds a whole mesh or grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.operators.mesh import dense_ids
from tidewater.sources.bridge import micros
from tidewater.sources.text import _number, _tokens


def lines_of(files: DataFrame) -> DataFrame:
    """Numbered lines of whole files (``file, content``)."""
    return files.select("file", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "raw"))


def _whole(token: Column) -> Column:
    return token.try_cast("long")


def write_gr3(node: DataFrame, elem_node: DataFrame, strings: DataFrame, file: str) -> DataFrame:
    """A mesh as numbered lines: counts, nodes and elements numbered from 1, then open and land strings.

    ``strings``: kind (open, land), string_no, seq, node_id. Ids become dense numbers in their order.
    """
    ids = dense_ids(node, "node_id")
    number = lambda df: df.join(ids, "node_id").withColumn("n", F.col("new_id") + 1).drop("new_id")
    elems = number(elem_node).groupBy("elem_id").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("ring")).join(dense_ids(elem_node, "elem_id"), "elem_id")
    size = node.agg(F.count("*").alias("nn")).join(F.broadcast(elem_node.agg(F.count_distinct("elem_id").alias("ne"))))
    at = lambda df, line, raw: df.join(F.broadcast(size)).select(line.cast("long").alias("line_no"), raw.alias("raw"))
    out = size.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("line_no"), F.lit(file).alias("raw")), F.struct(F.lit(1).cast("long").alias("line_no"), F.format_string("%d %d", "ne", "nn").alias("raw")))).alias("l")).select("l.*")
    out = out.unionByName(at(number(node), F.col("n") + 1, F.format_string("%d %.6f %.6f %.6f", "n", "x", "y", "depth")))
    ring = F.array_join(F.transform("ring", lambda c: c["n"].cast("string")), " ")
    out = out.unionByName(at(elems, F.col("new_id") + 2 + F.col("nn"), F.concat_ws(" ", (F.col("new_id") + 1).cast("string"), F.size("ring").cast("string"), ring)))
    # One row a string from here on: their lengths give every string's first line.
    each = strings.groupBy("kind", "string_no").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.col("kind") == "land", "string_no")
    start = each.withColumn("start", F.sum(F.col("n") + 1).over(order) - F.col("n") - 1 + F.when(F.col("kind") == "land", 4).otherwise(2))
    heads = start.select("start", F.when(F.col("kind") == "land", F.format_string("%d 0 = Number of nodes for land boundary %d", "n", "string_no")).otherwise(F.format_string("%d = Number of nodes for open boundary %d", "n", "string_no")).alias("raw"))
    is_open = F.col("kind") == "open"
    total = each.agg(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in (("ko", F.count_if(is_open)), ("to", F.sum(F.when(is_open, F.col("n")))), ("kl", F.count_if(~is_open)), ("tl", F.sum(F.when(~is_open, F.col("n")))))])
    past = F.col("ko") + F.col("to") + 2
    rows = [(F.lit(0), "%d = Number of open boundaries", "ko"), (F.lit(1), "%d = Total number of open boundary nodes", "to"), (past, "%d = Number of land boundaries", "kl"), (past + 1, "%d = Total number of land boundary nodes", "tl")]
    counts = total.select(F.explode(F.array(*[F.struct(p.cast("long").alias("start"), F.format_string(f, c).alias("raw")) for p, f, c in rows])).alias("l")).select("l.*")
    body = number(strings).withColumn("rank", F.row_number().over(Window.partitionBy("kind", "string_no").orderBy("seq"))).join(F.broadcast(start.drop("n")), ["kind", "string_no"])
    body = body.select((F.col("start") + F.col("rank")).alias("start"), F.col("n").cast("string").alias("raw"))
    tail = heads.unionByName(counts).unionByName(body)
    out = out.unionByName(at(tail, F.col("start") + 2 + F.col("nn") + F.col("ne"), F.col("raw")))
    return out.select(F.lit(file).alias("file"), "line_no", "raw")


def read_gr3(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (file, node_id, x, y, depth), elements (file, elem_id, pos, node_id), strings (file, kind, string_no, seq, node_id).

    Of the lines behind the elements those of more than one word are heads: two of the open part, one for each open
    string, two of the land part, one for each land string.
    """
    tok = _tokens(F.col("raw"))
    size = lines.where("line_no = 1").select("file", _whole(F.get(tok, F.lit(0))).alias("ne"), _whole(F.get(tok, F.lit(1))).alias("nn"))
    body = lines.where("line_no >= 2 and trim(raw) <> ''").join(size, "file").withColumn("tok", tok)
    at = lambda i: F.get("tok", F.lit(i))
    nodes = body.where("line_no < 2 + nn").select("file", _whole(at(0)).alias("node_id"), *[_number(at(i)).alias(c) for i, c in ((1, "x"), (2, "y"), (3, "depth"))])
    elems = body.where("line_no >= 2 + nn and line_no < 2 + nn + ne").select("file", _whole(at(0)).alias("elem_id"), F.posexplode(F.slice("tok", 3, F.size("tok"))).alias("pos", "v")).select("file", "elem_id", "pos", _whole(F.col("v")).alias("node_id"))
    tail = body.where("line_no >= 2 + nn + ne")
    heads = tail.where("size(tok) > 1").withColumn("h", F.row_number().over(Window.partitionBy("file").orderBy("line_no")))
    first = heads.where("h = 1").select("file", _whole(at(0)).alias("ko"))
    spans = heads.join(first, "file").withColumn("next", F.lead("line_no").over(Window.partitionBy("file").orderBy("line_no")))
    is_open = F.col("h") <= F.col("ko") + 2
    spans = spans.where((F.col("h") > 2) & ~(F.col("h").between(F.col("ko") + 3, F.col("ko") + 4)))
    spans = spans.select("file", F.col("line_no").alias("head"), "next", F.when(is_open, "open").otherwise("land").alias("kind"), F.when(is_open, F.col("h") - 2).otherwise(F.col("h") - F.col("ko") - 4).alias("string_no"))
    own = tail.where("size(tok) = 1").join(spans, "file").where("line_no > head and (next is null or line_no < next)")
    return nodes, elems, own.select("file", "kind", "string_no", (F.col("line_no") - F.col("head")).alias("seq"), _whole(at(0)).alias("node_id"))


def write_vgrid(level: DataFrame, most: int, file: str) -> DataFrame:
    """Local levels as numbered lines: kind, level count, then a line a node: number, lowest level, sigmas upwards."""
    own = level.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("k", "sigma"))).alias("s"))
    text = F.array_join(F.transform("s", lambda v: F.format_string("%.6f", v["sigma"])), " ")
    body = own.select((F.col("node_id") + 2).alias("line_no"), F.concat_ws(" ", (F.col("node_id") + 1).cast("string"), (most + 1 - F.size("s")).cast("string"), text).alias("raw"))
    head = level.sparkSession.createDataFrame([(0, "1 ! ivcor"), (1, f"{most} ! nvrt")], "line_no long, raw string")
    return head.unionByName(body).select(F.lit(file).alias("file"), "line_no", "raw")


def read_vgrid(lines: DataFrame) -> DataFrame:
    """``file, node_id, kbp, k, sigma`` of local levels, a line a node; k counts from the lowest level; pads (-9) go."""
    tok = _tokens(F.col("raw"))
    rows = lines.where("line_no >= 2 and trim(raw) <> ''").select("file", _whole(F.get(tok, F.lit(0))).alias("node_id"), _whole(F.get(tok, F.lit(1))).alias("kbp"), F.slice(tok, 3, F.size(tok)).alias("s"))
    sigma = F.filter(F.transform("s", _number), lambda v: v != -9)
    return rows.select("file", "node_id", "kbp", F.posexplode(sigma).alias("k", "sigma"))


def read_source_sink(lines: DataFrame) -> DataFrame:
    """``file, role, elem, name, origin`` of source and sink lists: a count line opens each part, then ``elem ! name``."""
    own = lines.where("trim(raw) <> ''").withColumn("total", F.regexp_extract("raw", r"(?i)total.*elems with (source|sink)", 1))
    heads = own.where("total <> ''").groupBy("file").agg(F.min(F.when(F.lower("total") == "sink", F.col("line_no"))).alias("sink"))
    rows = own.where("total = ''").join(heads, "file", "left")
    part = F.split("raw", "!", 2)
    name = F.trim(F.get(part, F.lit(1)))
    origin = F.coalesce(*[F.when(F.lower(name).contains(o), o) for o in ("delta", "suisun", "dicu", "potw")], F.lit("unknown"))
    return rows.select("file", F.when(F.col("line_no") > F.col("sink"), "sink").otherwise("source").alias("role"), _whole(F.trim(part[0])).alias("elem"), name.alias("name"), origin.alias("origin"))


def read_cruise(lines: DataFrame) -> DataFrame:
    """``file, station, t, depth, salinity`` of casts from ``date,time,station,depth,salinity`` lines.

    A salinity that is no number drops its station's rows up to there; a cast's time is that of its first row left.
    """
    part = F.split("raw", ",")
    at = lambda i: F.trim(F.get(part, F.lit(i)))
    rows = lines.where("trim(raw) <> ''").select("file", "line_no", F.regexp_replace(at(2), r"\.0$", "").alias("station"), micros(F.to_timestamp_ntz(F.concat_ws(" ", at(0), at(1)), F.lit("yyyy-MM-dd HH:mm"))).alias("t"), _number(at(3)).alias("depth"), _number(at(4)).alias("salinity"))
    bad = rows.where("salinity is null").groupBy("file", "station").agg(F.max("line_no").alias("bad"))
    kept = rows.join(bad, ["file", "station"], "left").where("bad is null or line_no > bad")
    first = kept.groupBy("file", "station").agg(F.min_by("t", "line_no").alias("t"))
    return kept.drop("t").join(first, ["file", "station"]).select("file", "station", "t", "depth", "salinity")


def read_station_db(lines: DataFrame) -> DataFrame:
    """``file, station_id, agency_id, x, y, name, repeats`` of station lists: comma separated, comments behind ``#``.

    Ids lose their quotes and case; ``repeats`` counts the rows of an id, which must be 1.
    """
    own = lines.withColumn("own", F.trim(F.regexp_replace("raw", "#.*$", ""))).where("own <> '' and own not like 'station_id,%'")
    row = F.from_csv("own", F.lit("station_id string, x double, y double, name string, agency_id string"))
    plain = lambda c: F.regexp_replace(F.col(c), "[\"']", "")
    got = own.select("file", row.alias("r")).select("file", "r.*").withColumns({"station_id": F.lower(plain("station_id")), "agency_id": plain("agency_id")})
    times = got.groupBy("file", "station_id").agg(F.count("*").alias("repeats"))
    return got.join(times, ["file", "station_id"]).select("file", "station_id", "agency_id", "x", "y", "name", "repeats")


def _keyed(lines: DataFrame, keys: list[str], values: dict[str, str], lower: bool) -> DataFrame:
    """``file``, ``keys`` and ``values`` (name: type) of comma separated files whose first line names their columns.

    Comments begin with ``#`` outside quotes, other columns are passed over, a value's missing column is null, and so is what
    is no number where one belongs. A missing key column and a key that comes twice are errors of the row that has them, so
    that nothing is checked on the driver.
    ``lower`` takes the first key in lower case.
    """
    c = F.col
    own = lines.withColumn("own", F.trim(F.regexp_replace("raw", '^((?:[^"#]|"[^"]*")*)#.*$', "$1"))).where("own <> ''")
    cells = F.split("own", ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    plain = lambda v: F.regexp_replace(F.regexp_replace(F.trim(v), '^"(.*)"$', "$1"), '""', '"')
    own = own.select("file", "line_no", F.transform(cells, plain).alias("cells"))
    heads = own.groupBy("file").agg(F.min_by("cells", "line_no").alias("names"), F.min("line_no").alias("first"))
    rows = own.join(heads, "file").where("line_no > first")
    place = lambda name: F.array_position("names", name).cast("int")
    cell = lambda name: F.nullif(F.when(place(name) > 0, F.get("cells", place(name) - 1)), F.lit(""))
    key = {k: F.when(place(k) > 0, cell(k)).otherwise(F.raise_error(F.concat(F.lit(f"no column {k} in "), c("file"))).cast("string")) for k in keys}
    if lower:
        key[keys[0]] = F.lower(key[keys[0]])
    got = rows.select("file", *[v.alias(k) for k, v in key.items()], *[cell(v).try_cast(t).alias(v) for v, t in values.items()])
    told = F.concat_ws(", ", "file", *keys)
    each = got.groupBy("file", *keys).agg(F.count("*").alias("n"), F.first(F.struct(*values)).alias("v"))
    once = F.when(c("n") > 1, F.raise_error(F.concat(F.lit("key comes twice: "), told)).cast("string")).otherwise(c("file"))
    return each.select(once.alias("file"), *keys, "v.*")


def read_station_sublocs(lines: DataFrame) -> DataFrame:
    """``file, station_id, subloc, z`` of lists of sublocations; a sublocation that a station has twice is an error."""
    return _keyed(lines, ["station_id", "subloc"], {"z": "double"}, False)


def read_obs_links(lines: DataFrame) -> DataFrame:
    """``file, station_id, subloc, variable, filename, selector, datum_adj`` of links to observations; ids in lower case, each key once."""
    return _keyed(lines, ["station_id", "subloc", "variable"], {"filename": "string", "selector": "string", "datum_adj": "double"}, True)


def read_flux(lines: DataFrame, names: list[str], start: int) -> DataFrame:
    """``file, row_no, t, name, value`` of flux output: days, then a column for each of ``names``.

    Times are made anew: ``start`` and whole steps, a step being the first two rows' distance to the second.
    """
    low = [n.lower() for n in names]
    if len(set(low)) < len(low):
        raise ValueError("names of flux columns must differ")
    tok = _tokens(F.col("raw"))
    rows = lines.where("trim(raw) <> ''").select("file", "line_no", tok.alias("tok")).withColumn("row_no", (F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1).cast("long"))
    two = rows.where("row_no < 2").groupBy("file").agg(F.min_by(_number(F.get("tok", F.lit(0))), "row_no").alias("d0"), F.max_by(_number(F.get("tok", F.lit(0))), "row_no").alias("d1"))
    t = F.col("row_no") * F.rint((F.col("d1") - F.col("d0")) * 86400).cast("long") * 1_000_000 + start
    pairs = F.arrays_zip(F.array(*map(F.lit, low)).alias("name"), F.slice("tok", 2, len(low)).alias("v"))
    return rows.join(two, "file").select("file", "row_no", t.alias("t"), F.explode(pairs).alias("p")).select("file", "row_no", "t", "p.name", _number(F.col("p.v")).alias("value"))


def archive_series(runs: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Outputs of runs (``file, station, t, value``; scenario; folder) as one table, to be partitioned by scenario and variable.

    Files are named ``variable_shard``; ``shard`` is the number at the end.
    """
    out = None
    for df, scenario, folder in runs:
        own = df.select(F.lit(scenario).alias("scenario"), F.lit(folder).alias("rundir"), F.regexp_extract("file", r"^(.*)_\d+$", 1).alias("variable"), F.regexp_extract("file", r"_(\d+)$", 1).cast("int").alias("shard"), "station", "t", "value")
        out = own if out is None else out.unionByName(own)
    return out
