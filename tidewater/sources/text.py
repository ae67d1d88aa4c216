"""Readers and writers of the text formats, over tables of whole files (``file, content``).

``spark.read.text(path, wholetext=True)`` gives such a table; each file is parsed where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewater.sources.bridge import micros

_NUMBER = r"^[-+]?[0-9]*\.?[0-9]+$"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("file", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "raw")).where(F.trim("raw") != "")


def _tokens(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def _number(token: Column) -> Column:
    """The token as double; nan and what is no number become null."""
    v = token.try_cast("double")
    return F.when(~F.isnan(v), v)


def read_th_dated(files: DataFrame) -> DataFrame:
    """``file, row_no, t, name, value, comment`` of dated histories.

    The header is the first line, comments aside, whose first word has no digit. A comment behind ``#`` belongs to its
    row; a whole comment line after data to the row before it, the last such line winning.
    """
    lines = _lines(files).withColumn("data", F.trim(F.regexp_replace("raw", "#.*$", ""))).withColumn("note", F.nullif(F.trim(F.regexp_extract("raw", "#(.*)$", 1)), F.lit("")))
    head = (F.col("data") != "") & ~F.regexp_like(F.element_at(_tokens(F.col("data")), 1), F.lit("[0-9]"))
    header = lines.where(head).groupBy("file").agg(F.min(F.struct("line_no", "data")).alias("h")).select("file", F.col("h.line_no").alias("h_no"), _tokens(F.col("h.data")).alias("names"))
    body = lines.join(header, "file").where("line_no > h_no")
    by = Window.partitionBy("file").orderBy("line_no")
    body = body.withColumn("row_no", F.sum(F.when(F.col("data") != "", 1).otherwise(0)).over(by) - 1).where("row_no >= 0")
    rows = body.groupBy("file", "row_no").agg(F.max("data").alias("data"), F.max_by("note", F.when(F.col("note").isNotNull(), F.col("line_no"))).alias("comment"), F.first("names").alias("names"))
    tok = _tokens(F.col("data"))
    ts = F.to_timestamp_ntz(F.regexp_replace(F.element_at(tok, 1), "T", " "), F.lit("yyyy-MM-dd HH:mm[:ss]"))
    pairs = F.arrays_zip(F.slice("names", 2, F.size("names")).alias("name"), F.slice(tok, 2, F.size(tok)).alias("v"))
    return rows.select("file", F.col("row_no").cast("long").alias("row_no"), micros(ts).alias("t"), F.explode(pairs).alias("p"), "comment").select("file", "row_no", "t", "p.name", _number(F.col("p.v")).alias("value"), "comment")


def read_th_elapsed(files: DataFrame) -> DataFrame:
    """``file, row_no, elapsed, name, value`` of elapsed histories: names from a ``# time a b`` line, else 1, 2, ..."""
    lines = _lines(files)
    data = lines.where(~F.regexp_like("raw", F.lit(r"^\s*#")))
    tok = _tokens(F.col("raw"))
    rows = data.withColumn("row_no", F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1).select("file", "row_no", tok.alias("tok"))
    named = lines.where(F.regexp_like("raw", F.lit(r"^\s*#\s*time\b"))).groupBy("file").agg(F.min(F.struct("line_no", _tokens(F.regexp_replace("raw", r"^\s*#\s*", "")).alias("names")))["names"].alias("names"))
    both = rows.join(named, "file", "left").withColumn("n", F.size("tok") - 1)
    names = F.when(F.size("names") == F.col("n") + 1, F.slice("names", 2, F.col("n"))).when(F.size("names") == F.col("n"), F.col("names")).otherwise(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i.cast("string")))
    pairs = F.arrays_zip(names.alias("name"), F.slice("tok", 2, F.size("tok")).alias("v"))
    return both.select("file", F.col("row_no").cast("long").alias("row_no"), _number(F.element_at("tok", 1)).alias("elapsed"), F.explode(pairs).alias("p")).select("file", "row_no", "elapsed", "p.name", _number(F.col("p.v")).alias("value"))


def detect_elapsed(files: DataFrame) -> DataFrame:
    """``file, elapsed``: whether all words of the first data line are plain numbers."""
    data = _lines(files).where(~F.regexp_like("raw", F.lit(r"^\s*#")))
    first = data.groupBy("file").agg(F.min(F.struct("line_no", "raw"))["raw"].alias("raw"))
    return first.select("file", F.forall(_tokens(F.col("raw")), lambda w: F.regexp_like(w, F.lit(_NUMBER))).alias("elapsed"))


def read_station_in(files: DataFrame) -> DataFrame:
    """``file, pos, x, y, z, id, subloc, name`` of station lists: two header lines, then ``i x y z ! id subloc "name"``."""
    rows = _lines(files).where("line_no >= 2")
    part = F.split("raw", "!", 2)
    left, right = _tokens(part[0]), F.trim(part[1])
    return rows.select(
        "file",
        (F.col("line_no") - 2).alias("pos"),
        *[_number(F.get(left, F.lit(i))).alias(n) for i, n in ((1, "x"), (2, "y"), (3, "z"))],
        F.get(_tokens(right), F.lit(0)).alias("id"),
        F.coalesce(F.get(_tokens(F.regexp_replace(right, '".*$', "")), F.lit(1)), F.lit("default")).alias("subloc"),
        F.regexp_extract(right, '"([^"]*)"', 1).alias("name"),
    )


def read_staout(files: DataFrame, stations: DataFrame, start: int, factor: int = 1) -> DataFrame:
    """``file, station, t, value`` of station output: elapsed time (``factor`` 1 or 86400), a column for each ``pos``.

    Values at or below -999 are null; times are rounded to the second.
    """
    rows = _lines(files).select("file", _tokens(F.col("raw")).alias("tok"))
    t = F.rint(_number(F.element_at("tok", 1)) * factor).cast("long") * 1_000_000 + start
    long = rows.select("file", t.alias("t"), F.posexplode(F.slice("tok", 2, F.size("tok"))).alias("pos", "v"))
    value = _number(F.col("v"))
    return long.join(stations, "pos").select("file", "station", "t", F.when(value > -999, value).alias("value"))


def write_th(series: DataFrame, names: list[str], decimals: int = 2, dated: bool = True, start: int = 0) -> DataFrame:
    """``file, content`` from ``file, t, name, value``: a line a time, a column for each of ``names``, null as nan.

    A file's lines are put in order in one row, the unit a file is written in.
    """
    wide = series.groupBy("file", "t").pivot("name", names).agg(F.max("value"))
    text = lambda c: F.when(F.col(f"`{c}`").isNull(), "nan").otherwise(F.format_string(f"%.{decimals}f", F.col(f"`{c}`")))
    stamp = F.concat(F.date_format(F.expr("timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, t / 1000000)"), "yyyy-MM-dd'T'HH:mm")) if dated else F.format_string("%.1f", (F.col("t") - start) / 1e6)
    line = F.concat_ws(" ", stamp, *[text(n) for n in names])
    body = wide.select("file", "t", line.alias("line")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("t", "line"))).alias("l"))
    head = F.lit(" ".join(["datetime" if dated else "# time", *names]))
    return body.select("file", F.concat(head, F.lit("\n"), F.array_join(F.transform("l", lambda r: r["line"]), "\n")).alias("content"))


def params_table(files: DataFrame) -> DataFrame:
    """``file, section, name, value`` of namelists: a section runs from ``&NAME`` on, comments behind ``!`` are cut."""
    lines = _lines(files).withColumn("own", F.trim(F.regexp_replace("raw", "!.*$", "")))
    section = F.nullif(F.regexp_extract("own", r"^&(\w+)", 1), F.lit(""))
    by = Window.partitionBy("file").orderBy("line_no")
    named = lines.withColumn("section", F.last(section, ignorenulls=True).over(by)).where(F.col("own").contains("="))
    return named.select("file", "section", F.trim(F.split("own", "=", 2)[0]).alias("name"), F.trim(F.split("own", "=", 2)[1]).alias("value"))
