"""SimHash near-duplicates by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.llm import golay
from tidewater.llm.tables import row_key, table
from tidewater.operators.components import connected_components
from tidewater.spool import scratch, spool

#: Bits of the three segments of a fingerprint, from the lowest; each fits a Golay word.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MOST_BITS = 2
#: Fingerprints under one key that are compared pairwise; keys with more go by common neighbours, which is as exact.
PAIRWISE = 64
_SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles in order, at most 4096 at a time; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    total = len(words) - k + 1
    starts, ends = starts[:total].tolist(), ends[k - 1 :].tolist()
    for i in range(0, total, 4096):
        yield np.array([digest(joined[a:z], _SEED) for a, z in zip(starts[i : i + 4096], ends[i : i + 4096], strict=True)], "<u8")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, each set if set in over half the shingles' hashes; 0 without words."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: Iterable[np.ndarray]) -> int:
    total, votes = 0, np.zeros(64, np.int64)
    for h in hashes:
        total += len(h)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, text`` in, ``doc_id, fp`` (a signed long holding the 64 bits) out. A null text has fingerprint 0."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], schema=out)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, fp long")


def golay_keys(fps: DataFrame) -> DataFrame:
    """``fp, key`` with up to 18 keys for a fingerprint.

    Of three segments, two wrong bits leave at least one untouched, and the segment after it has at most two wrong
    bits. So a key is: which segment, its exact bits, and one Golay index of the segment after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            bits = fp.view(np.uint64)
            parts = [(bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
            for i in range(3):
                near = golay.near_indices(parts[(i + 1) % 3])
                keys = (i << 40) | (parts[i][:, None] << 12) | near
                real = near >= 0
                own = np.repeat(fp, real.sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(keys[real])], names=["fp", "key"])

    return fps.select("fp").mapInArrow(run, "fp long, key long")


def linked(fps: DataFrame) -> DataFrame:
    """Edges ``a, b`` over distinct fingerprints (a spooled table with column ``fp``) that connect all within 2 bits.

    Keys held by up to ``PAIRWISE`` fingerprints are joined with themselves and verified. Under larger keys, which
    hold groups of near copies, every fingerprint is instead linked to the smallest one that has a common neighbour
    at most one bit from both: that connects exactly those within 2 bits, and makes 65 rows for each, not pairs.
    """
    keys = golay_keys(fps)
    shared = spool(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    held = spool(keys.join(shared, "key"))
    few = held.where(F.col("n") <= PAIRWISE)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where((F.col("a") < F.col("b")) & near)
    one_off = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    middles = spool(held.where(F.col("n") > PAIRWISE).select("fp").distinct().select("fp", F.explode(one_off).alias("middle")))
    least = spool(middles.groupBy("middle").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("middle", "b"))
    stars = middles.join(least, "middle").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.select("a", "b").unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fp, component_id`` (smallest ``doc_id`` reachable by links).

    Two fingerprints are linked if they differ in at most 2 bits; equal ones count as one from the start, so that
    copies, however many, are one row. Null and empty texts have fingerprint 0. Rows with a null ``doc_id`` belong
    to a component but don't name it, unless it has no other. Repeated rows each keep their row; other columns of
    ``docs`` are left out, and an empty table gives an empty one.
    """
    marked = spool(with_fingerprints(docs, shingle))
    distinct = spool(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = connected_components(linked(distinct)).withColumnRenamed("node", "fp")
    owner = distinct.join(nodes, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = owner.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = spool(owner.join(names, "component").select("fp", "component_id"))
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` with the smallest ``doc_id`` of each group of near copies; of its repeated rows, one.

    Near copies are linked by their fingerprints and Golay keys (``linked``), and such links are checked: texts whose
    ``shingle``-word shingles have a Jaccard similarity of 4/5 or more. Most such texts are far more than 2 of 64 bits
    apart; those that fingerprints left apart are found by their rarest shingles (``nearcopies.near_copies``), so that none
    is missed. Rows without a ``doc_id`` come after all others and go by their text. The texts are shuffled once.
    """
    from tidewater.llm.nearcopies import near_copies

    keyed = docs.select(row_key().alias("key"), F.struct("*").alias("row"))
    with scratch(docs.sparkSession) as keep:
        groups = near_copies(docs.select(row_key().alias("doc_id"), "text"), shingle)
        stay = keep(groups.where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct())
    return keyed.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
