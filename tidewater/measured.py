"""Joins that broadcast what was measured, not what was guessed."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows up to which AQE broadcasts a table. Iterations join dozens of times: what they broadcast in all stays small.
MOST = 1 << 20
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}
_PLANNED, _ADAPTIVE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]?)i?b?\s*", size.lower()).groups()
    return int(number) * _UNITS["" if unit == "b" else unit]


def measured(spark: SparkSession) -> SparkSession:
    """A session beside ``spark``, with its settings, that broadcasts a table by the size it turned out to have.

    The planner takes exploded rows for none and a compressed file for its rows, so it would gather tables of millions of rows on the
    driver. Here only AQE, which has seen a side's rows, broadcasts without a hint; its limit is that of ``spark``, ``MOST`` at most.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    if spark.conf.get("spark.sql.adaptive.enabled") == "true":
        own.conf.set(_ADAPTIVE, str(min(MOST, _bytes(spark.conf.get(_ADAPTIVE, None) or spark.conf.get(_PLANNED)))))
        own.conf.set(_PLANNED, "-1")
    return own


def with_measured_joins(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: query(measured(spark), folder)
