"""Secret scans with multipart credential linking. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewater.llm.spans import count_kind, listed, matches, of_kind, within_scope
from tidewater.llm.tables import table
from tidewater.spool import spool

#: Kinds in their listing order: the first three count by themselves, the others only with their counterparts.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: What a kind is a part of a credential as.
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
#: The parts that a weak candidate must have near it.
NEEDS = {"weak_id": ("secret",), "weak_secret": ("id",), "endpoint": ("id", "secret")}
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)"""
#: The lengths asked for stand in these two: a shorter run holds no longer one, so nothing else is matched.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: Identifiers of the forms that access keys are issued in, and values given to a name of an identifier.
WEAK_ID = r"""(?<![A-Za-z0-9_])(?:(?:ASIA|AIDA|AROA|GOOG)[A-Z0-9]{12,60}(?![A-Za-z0-9])|(?i:user(?:name)?|login|account|(?:client|tenant|access_?key|key)_?id)["']?\x20?[:=]\x20?["']?[A-Za-z0-9._@-]{3,64})"""
#: Forty characters of base 64 that stand alone, and values given to a name of a secret that are too short by themselves or whose name says less.
WEAK_SECRET = r"""(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])|(?<![A-Za-z0-9_])(?i:password|passwd|secret|token|api_?key)["']?\x20?[:=]\x20?["']?[A-Za-z0-9+/_.=-]{4,7}(?![A-Za-z0-9+/_.=-])|(?<![A-Za-z0-9_])(?i:pwd|pass|passphrase|private_?key|bearer)["']?\x20?[:=]\x20?["']?[A-Za-z0-9+/_.=-]{4,128}"""
ENDPOINT = r"""https?://[A-Za-z0-9.-]++[^\s\"'<>]*+|(?<![A-Za-z0-9_])(?i:host(?:name)?|server|endpoint|bucket|region)["']?\x20?[:=]\x20?["']?[A-Za-z0-9.:_-]{3,128}"""
#: Code points around a part within which its counterparts must stand.
SCOPE = 400


def _mixed(m: Column) -> Column:
    """Whether a match is no bare run of base 64, or one of digits, small and large letters."""
    run = F.regexp_like(m, F.lit("^[A-Za-z0-9+/]{40}$"))
    return ~run | (F.regexp_like(m, F.lit("[0-9]")) & F.regexp_like(m, F.lit("[a-z]")) & F.regexp_like(m, F.lit("[A-Z]")))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in; ``doc_id, base, linked`` out, arrays of spans (start, no, end, kind, m) by start and kind.

    ``base`` holds assignments of a secret-like name with 8 or more characters, access identifiers of 16 or more and
    hexadecimal strings of 32 or more. ``linked`` adds weak candidates, which say nothing alone: an identifier with a
    secret within ``SCOPE`` code points, a secret with an identifier, an endpoint with both; parts that overlap don't
    count for each other. Null texts count as empty; repeated rows each have a row; other columns are left out; an
    empty table gives an empty one.

    Texts are read once and never shuffled. The parts of texts with a weak candidate are rows of their own, linked by an
    interval join over bins of their text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "weak_id": WEAK_ID, "weak_secret": WEAK_SECRET, "endpoint": ENDPOINT}
    keep = {"assign": lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 1)) >= 8, "weak_secret": lambda s: _mixed(s["m"])}
    found = docs.select(F.col("doc_id").alias("doc_id"), *[F.filter(matches(text, p), keep[k]).alias(k) if k in keep else matches(text, p).alias(k) for k, p in patterns.items()])
    found = found.select("doc_id", F.monotonically_increasing_id().alias("row"), *[of_kind(F.col(k), k, i).alias(k) for i, k in enumerate(KINDS)])
    found = found.select("doc_id", "row", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), F.concat(*NEEDS).alias("weak"))
    found = spool(found)
    open_ = found.where(F.size("weak") > 0)
    part = F.explode(F.concat("base", "weak"))
    role = lambda k: F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[k]
    offers = open_.select("row", part.alias("s")).select("row", "s.start", "s.end", role(F.col("s.kind")).alias("role"))
    wanted = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])
    asks = open_.select("row", F.explode("weak").alias("s")).select("row", "s.start", "s.end", "s", F.explode(wanted[F.col("s.kind")]).alias("need"))
    met = within_scope(asks, offers, SCOPE, F.col("a.need") == F.col("o.role"), apart=True)
    full = met.groupBy("row", "s").agg(F.count("*").alias("n")).where(F.col("n") == F.size(wanted[F.col("s.kind")]))
    linked = full.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("linked"))
    none = F.slice("weak", 1, 0)
    rest = found.where(F.size("weak") == 0).select("doc_id", "base", none.alias("linked"))
    return rest.unionByName(open_.join(linked, "row", "left").select("doc_id", "base", F.coalesce("linked", none).alias("linked")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count_kind(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "linked"))).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
