"""The tables these operators read, and small helpers they share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space: a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key() -> Column:
    """A row's document as a long: its ``doc_id``, below 2^62; one without an id comes after all that have one and goes by 62 bits of its ``text``."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1) - F.pmod(F.xxhash64("text"), F.lit(1 << 62)))


def give_back() -> None:
    """Lets go of memory that a Python worker no longer uses: it lives on after its task, and what it keeps is missing in the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)
