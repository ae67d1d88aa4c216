"""More formats, read from and written to numbered lines, so that no row holds a whole file.

Lines of a written table come with the columns they are ordered by: write them with ``repartitionByRange`` on these and
``sortWithinPartitions``, and a file is as many tasks as it is long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.operators.mesh import dense_ids
from tidewater.sources.lines import _whole
from tidewater.sources.text import _lines, _number, _tokens

#: What a station list can ask for, in the order of its first line (fixed values).
STATION_VARIABLES = ("elev", "air pressure", "wind_x", "wind_y", "temp", "salt", "u", "v", "w")
#: Nodes of a level whose sigmas stand in one row of a transposed grid; a line of the file is all its blocks in order.
BLOCK = 4096
PAD = -9.0


def _printf(form: Column, value: Column) -> Column:
    return F.call_function("printf", form, value)


def th_formats(files: DataFrame) -> DataFrame:
    """``file, pos, name, decimals`` of the columns of dated histories: the most decimals that any of their values has."""
    data = _lines(files).withColumn("data", F.trim(F.regexp_replace("raw", "#.*$", ""))).where("data <> ''").withColumn("tok", _tokens(F.col("data")))
    head = ~F.regexp_like(F.get("tok", F.lit(0)), F.lit("[0-9]"))
    names = data.where(head).groupBy("file").agg(F.min_by("tok", "line_no").alias("names"))
    cells = data.where(~head).join(names, "file").select("file", F.explode(F.arrays_zip(F.slice("names", 2, F.size("names")).alias("name"), F.sequence(F.lit(0), F.size("names") - 2).alias("pos"), F.slice("tok", 2, F.size("tok")).alias("v"))).alias("c"))
    decimals = F.length(F.regexp_extract("c.v", r"\.([0-9]*)$", 1))
    return cells.where("c.name is not null").groupBy("file", "c.pos", "c.name").agg(F.coalesce(F.max(decimals), F.lit(0)).alias("decimals"))


def write_th_lines(series: DataFrame, formats: DataFrame, dated: bool = True, start: int | None = None) -> DataFrame:
    """``file, section, at, raw``: a header (section 1), then a line a time (section 2) in the order of ``at``.

    ``series``: file, t, name, value and maybe comment, which stands behind its line; ``formats`` as from ``th_formats``:
    columns in order of ``pos``, each with its decimals, null as nan. Elapsed times need ``start``.
    """
    if not dated and start is None:
        raise ValueError("elapsed times need a start")
    columns = formats.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "decimals"))).alias("columns"))
    note = F.max("comment") if "comment" in series.columns else F.lit(None).cast("string")
    rows = series.groupBy("file", "t").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("own"), note.alias("note")).join(columns, "file")
    cell = lambda c: F.coalesce(_printf(F.concat(F.lit("%."), c["decimals"].cast("string"), F.lit("f")), F.try_element_at("own", c["name"])), F.lit("nan"))
    cell_or_nan = lambda c: F.when(F.try_element_at("own", c["name"]).isNull(), "nan").otherwise(cell(c))
    stamp = F.date_format(F.expr("timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, t / 1000000)"), "yyyy-MM-dd'T'HH:mm") if dated else F.format_string("%.1f", (F.col("t") - start) / 1e6)
    line = F.concat_ws(" ", stamp, F.array_join(F.transform("columns", cell_or_nan), " "), F.concat(F.lit("# "), F.col("note")))
    head = F.concat_ws(" ", F.lit("datetime" if dated else "# time"), F.array_join(F.transform("columns", lambda c: c["name"]), " "))
    return columns.select("file", F.lit(1).alias("section"), F.lit(0).cast("long").alias("at"), head.alias("raw")).unionByName(rows.select("file", F.lit(2).alias("section"), F.col("t").alias("at"), line.alias("raw")))


def write_station_in(stations: DataFrame, request: Sequence[str] | None, file: str) -> DataFrame:
    """``file, line_no, raw``: flags of the variables asked for (``None``: all), the count, then a line a station.

    ``stations``: pos (ascending), x, y, z, station_id, subloc, name; texts with a space or quote are quoted.
    """
    wrong = set(request or ()) - set(STATION_VARIABLES)
    if wrong:
        raise ValueError(f"no such variables: {sorted(wrong)}")
    flags = " ".join("1" if request is None or v in request else "0" for v in STATION_VARIABLES) + " !" + ",".join(STATION_VARIABLES)
    own = stations.join(dense_ids(stations, "pos"), "pos")
    quoted = lambda c: F.when(F.regexp_like(c, F.lit('[ "]')), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(F.col(c))
    line = F.concat_ws(" ", (F.col("new_id") + 1).cast("string"), *[F.format_string("%.2f", c) for c in ("x", "y", "z")], F.lit("!"), *[quoted(c) for c in ("station_id", "subloc", "name")])
    count = own.agg(F.count("*").alias("n")).select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("line_no"), F.lit(flags).alias("raw")), F.struct(F.lit(1).cast("long").alias("line_no"), F.col("n").cast("string").alias("raw")))).alias("l")).select("l.*")
    return count.unionByName(own.select((F.col("new_id") + 2).alias("line_no"), line.alias("raw"))).select(F.lit(file).alias("file"), "line_no", "raw")


def write_station_output(values: DataFrame, start: int, days: bool = False) -> DataFrame:
    """``file, at, raw`` of ``file, t, pos, value``: tab separated, elapsed seconds (or days), then a column for each ``pos``; null and absent as -999."""
    width = values.groupBy("file").agg(F.max("pos").alias("most"))
    rows = values.groupBy("file", "t").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("own")).join(width, "file")
    value = lambda p: F.coalesce(F.try_element_at("own", p), F.lit(-999.0))
    cells = F.transform(F.sequence(F.lit(0), F.col("most")), lambda p: F.when(value(p) == -999, "-999").otherwise(F.format_string("%.6E", value(p))))
    elapsed = (F.col("t") - start) / 1e6
    stamp = F.format_string("%.6f", elapsed / 86400) if days else F.format_string("%.6E", elapsed)
    return rows.select("file", F.col("t").alias("at"), F.concat_ws("\t", stamp, F.array_join(cells, "\t")).alias("raw"))


def write_vgrid_levels(level: DataFrame, most: int, file: str) -> DataFrame:
    """Local levels in the layout with a line a level: ``file, line_no, block, raw``.

    Kind, level count, lowest levels of all nodes, then for each level the sigmas of all nodes, pads below the lowest.
    A line's raws are joined by spaces in the order of ``block``, each of ``BLOCK`` nodes: no row holds a level of all.
    """
    own = level.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("k", "sigma"))).alias("s")).withColumn("kbp", most - F.size("s"))
    cells = own.withColumn("all", F.concat(F.array_repeat(F.lit(PAD), F.col("kbp")), F.transform("s", lambda v: v["sigma"])))
    rows = cells.select("node_id", F.posexplode("all").alias("k", "sigma")).select((F.col("k") + 3).alias("line_no"), "node_id", F.format_string("%14.6f", "sigma").alias("v"))
    rows = rows.unionByName(cells.select(F.lit(2).alias("line_no"), "node_id", F.format_string("%10d", F.col("kbp") + 1).alias("v")))
    block = F.floor(F.col("node_id") / BLOCK)
    text = rows.groupBy("line_no", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "v"))), lambda r: r["v"]), " ").alias("raw"))
    numbered = F.when((F.col("line_no") > 2) & (F.col("block") == 0), F.concat(F.format_string("%10d", F.col("line_no") - 2), F.lit(" "), F.col("raw"))).otherwise(F.col("raw"))
    head = level.sparkSession.createDataFrame([(0, 0, "1"), (1, 0, str(most))], "line_no int, block long, raw string")
    return head.unionByName(text.select(F.col("line_no").cast("int"), F.col("block").cast("long"), numbered.alias("raw"))).select(F.lit(file).alias("file"), F.col("line_no").cast("long").alias("line_no"), "block", "raw")


def read_vgrid_levels(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sigmas (``file, node_id, k, sigma``, k from the lowest level) and lowest levels (``file, node_id, kbp``) of that layout.

    Pads go; ``block`` may be missing where each line is one row.
    """
    own = lines if "block" in lines.columns else lines.withColumn("block", F.lit(0).cast("long"))
    tok = _tokens(F.col("raw"))
    bottom = own.where("line_no = 2").select("file", "block", F.posexplode(tok).alias("i", "v")).select("file", (F.col("block") * BLOCK + F.col("i")).alias("node_id"), _whole(F.col("v")).alias("kbp"))
    body = own.where("line_no >= 3 and trim(raw) <> ''")
    values = F.when(F.col("block") == 0, F.slice(tok, 2, F.size(tok))).otherwise(tok)
    cells = body.select("file", "block", (F.col("line_no") - 2).alias("level"), F.posexplode(values).alias("i", "v")).select("file", (F.col("block") * BLOCK + F.col("i")).alias("node_id"), "level", _number(F.col("v")).alias("sigma"))
    sigma = cells.where(F.col("sigma") != PAD).join(bottom, ["file", "node_id"]).select("file", "node_id", (F.col("level") - F.col("kbp")).alias("k"), "sigma")
    return sigma, bottom


def pad_issues(lines: DataFrame) -> DataFrame:
    """``file, node_id, kbp, missing, extra``: nodes with pads at or above their lowest level, or values below it."""
    own = lines if "block" in lines.columns else lines.withColumn("block", F.lit(0).cast("long"))
    tok = _tokens(F.col("raw"))
    bottom = own.where("line_no = 2").select("file", "block", F.posexplode(tok).alias("i", "v")).select("file", "block", "i", _whole(F.col("v")).alias("kbp"))
    values = F.when(F.col("block") == 0, F.slice(tok, 2, F.size(tok))).otherwise(tok)
    cells = own.where("line_no >= 3 and trim(raw) <> ''").select("file", "block", (F.col("line_no") - 2).alias("level"), F.posexplode(values).alias("i", "v")).join(bottom, ["file", "block", "i"])
    pad = F.coalesce(_number(F.col("v")) == PAD, F.lit(True))
    counts = cells.groupBy("file", (F.col("block") * BLOCK + F.col("i")).alias("node_id"), "kbp").agg(F.count_if(pad & (F.col("level") >= F.col("kbp"))).alias("missing"), F.count_if(~pad & (F.col("level") < F.col("kbp"))).alias("extra"))
    return counts.where("missing > 0 or extra > 0")


def read_2dm(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (file, node_id, x, y, z), elements (file, elem_id, pos, node_id), strings (file, string_no, seq, node_id).

    Records begin with ND, E3T, E4Q and NS; a negative node ends a string, so a string's number is that of the negative
    ones before it. Only string records are put in order. Numbers stay as they stand in the file.
    """
    tok = _tokens(F.col("raw"))
    own = lines.select("file", "line_no", tok.alias("tok")).withColumn("kind", F.get("tok", F.lit(0)))
    at = lambda i: F.get("tok", F.lit(i))
    nodes = own.where("kind = 'ND'").select("file", _whole(at(1)).alias("node_id"), *[_number(at(i)).alias(c) for i, c in ((2, "x"), (3, "y"), (4, "z"))])
    corners = F.slice("tok", 3, F.when(F.col("kind") == "E3T", 3).otherwise(4))
    elems = own.where("kind in ('E3T', 'E4Q')").select("file", _whole(at(1)).alias("elem_id"), F.posexplode(corners).alias("pos", "v")).select("file", "elem_id", "pos", _whole(F.col("v")).alias("node_id"))
    parts = own.where("kind = 'NS'").select("file", "line_no", F.posexplode(F.slice("tok", 2, F.size("tok"))).alias("i", "v")).withColumn("n", _whole(F.col("v")))
    order = Window.partitionBy("file").orderBy("line_no", "i")
    parts = parts.withColumn("string_no", F.coalesce(F.sum((F.col("n") < 0).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seq = F.row_number().over(Window.partitionBy("file", "string_no").orderBy("line_no", "i")) - 1
    return nodes, elems, parts.select("file", "string_no", seq.alias("seq"), F.abs("n").alias("node_id"))


def write_prop(values: DataFrame, file: str) -> DataFrame:
    """``file, line_no, raw`` of ``elem_id, value``: elements numbered from 1."""
    return values.select(F.lit(file).alias("file"), F.col("elem_id").alias("line_no"), F.format_string("%d %s", F.col("elem_id") + 1, F.col("value").cast("string")).alias("raw"))


def read_prop(lines: DataFrame) -> DataFrame:
    """``file, elem_id, value``: elements numbered from 0."""
    tok = _tokens(F.col("raw"))
    return lines.where("trim(raw) <> ''").select("file", (_whole(F.get(tok, F.lit(0))) - 1).alias("elem_id"), _number(F.get(tok, F.lit(1))).alias("value"))


def name_source_columns(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """``cells`` (file, row_no, pos from 0, value) with the source and variable of their column, and its ``label``.

    ``sources``: file, ord from 0, name. As many columns as sources are the flows, named like these; else they come
    source by source for T, then S, then B1, B2 and so on.
    """
    n = sources.groupBy("file").agg(F.count("*").alias("n"))
    width = cells.groupBy("file").agg((F.max("pos") + 1).alias("width"))
    own = cells.join(n, "file").join(width, "file")
    nth = F.floor(F.col("pos") / F.col("n"))
    kind = F.when(F.col("width") == F.col("n"), F.lit(None).cast("string")).when(nth == 0, "T").when(nth == 1, "S").otherwise(F.concat(F.lit("B"), (nth - 1).cast("string")))
    own = own.withColumns({"variable": kind, "ord": F.pmod("pos", F.col("n"))}).join(sources, ["file", "ord"])
    return own.select("file", "row_no", "pos", F.col("name").alias("source"), "variable", F.concat_ws("_", "variable", "name").alias("label"), "value")


def skip_nan_rows(series: DataFrame) -> DataFrame:
    """``series`` (file, row_no, pos, value and more) without the rows whose last column has no value."""
    last = series.groupBy("file", "row_no").agg(F.max_by("value", "pos").alias("last")).where("last is not null and not isnan(last)")
    return series.join(last.select("file", "row_no"), ["file", "row_no"], "left_semi")


def ingest_field(files: DataFrame, variables: Sequence[str], places: dict[str, str]) -> DataFrame:
    """``file, variable, block, place``: output files ``variable_block.nc`` to read for the variables listed.

    ``places`` has the variables that stand on faces or edges; all others stand on nodes. Files of other names are left out.
    """
    name = F.regexp_extract("file", r"^(.+)_(\d+)\.nc$", 1)
    own = files.select("file", name.alias("variable"), F.nullif(F.regexp_extract("file", r"^(.+)_(\d+)\.nc$", 2), F.lit("")).cast("long").alias("block"))
    place = F.create_map(*[F.lit(x) for kv in places.items() for x in kv])[F.col("variable")] if places else F.lit(None).cast("string")
    return own.where(F.col("variable").isin(*variables)).withColumn("place", F.coalesce(place, F.lit("node")))
