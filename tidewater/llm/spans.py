"""Positions of pattern matches in texts, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Code points of text before a span that its context takes in.
BEFORE = 48


#: Matches laid out one after the other at a time; a text with more is laid out in blocks of so many.
BLOCK = 256
_SPANS = "array<struct<start:int,end:int,m:string>>"


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _laid_out(pairs: Column, at: Column) -> Column:
    def step(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["piece"])
        end = start + F.length(p["m"])
        own = F.struct(start.alias("start"), end.alias("end"), p["m"].alias("m"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(own).cast(_SPANS)).alias("out"))

    return F.aggregate(pairs, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out")), step, lambda s: s["out"])


def _in_blocks(pairs: Column) -> Column:
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda i: F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)))
    widths = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda n, p: n + F.length(p["piece"]) + F.length(p["m"])))
    starts = lambda ws: F.aggregate(ws, F.array(F.lit(0)), lambda out, w: F.concat(out, F.array(F.element_at(out, -1) + w)))
    return _bound(blocks, lambda bs: F.flatten(F.zip_with(bs, F.slice(starts(widths(bs)), 1, F.size(bs)), _laid_out)))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of ``start, end`` (code points, end exclusive) and ``m``, the match.

    The pattern must not match nothing. What stands between the matches gives the positions: a match begins where
    all pieces and matches before it end.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("piece"), found.alias("m"))
    placed = _bound(pairs, lambda ps: F.when(F.size(ps) <= BLOCK, _laid_out(ps, F.lit(0))).otherwise(_in_blocks(ps)))
    return F.when(F.regexp_like(text, F.lit(pattern)), placed).otherwise(F.array().cast(_SPANS))


def of_kind(spans: Column, kind: str, number: int) -> Column:
    """The spans with their kind and the kind's place in the listing."""
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["m"].alias("m")),
    )


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_kind(spans: Column) -> Column:
    """Sorted by the kinds' listing, then by start."""
    keyed = F.transform(spans, lambda s: F.struct(s["no"].alias("k"), s["start"].alias("s"), s["end"].alias("e"), s.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def count_kind(spans: Column, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["no"] == number)).cast("long")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of the value pass the Luhn check."""
    each = F.split(F.reverse(digits(value)), "(?<=.)(?=.)")
    doubled = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


#: Code points of a bin in which spans of one text meet.
BIN = 512


def _bins(parts: DataFrame, reach: int) -> DataFrame:
    first, last = F.floor((F.col("start") - reach) / BIN), F.floor((F.col("end") - 1 + reach) / BIN)
    return parts.withColumn("bin", F.explode(F.sequence(first, last)))


def within_scope(asks: DataFrame, offers: DataFrame, reach: int, fits: Column, apart: bool) -> DataFrame:
    """The rows of ``asks`` (``row, start, end`` and more) near which one of ``offers`` (likewise) stands in the same text.

    An interval join: spans meet in bins of a text, so that it's an equi-join on text and bin however many spans a text
    has. Near is at most ``reach`` code points away; with ``apart`` the two must not overlap, else they must. ``fits``
    is a further condition on the columns of the two, ``a.*`` and ``o.*``. Rows come out once.
    """
    a, o = _bins(asks, reach).alias("a"), _bins(offers, 0).alias("o")
    clear = (F.col("o.end") <= F.col("a.start")) | (F.col("o.start") >= F.col("a.end"))
    close = (F.col("o.start") <= F.col("a.end") + reach) & (F.col("o.end") >= F.col("a.start") - reach)
    same = (F.col("a.row") == F.col("o.row")) & (F.col("a.bin") == F.col("o.bin"))
    return a.join(o, same & fits & (close & clear if apart else ~clear), "left_semi").drop("bin").distinct()
