"""The registry of queries: name -> function, and name -> the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.jobs import casts, feeds, formats, levels, lists, meshes, outlines, places, profiles, refine, relocation, routes, subsets, time_series
from tidewater.measured import with_measured_joins

MODULES = (time_series, lists, meshes, places, profiles, refine, routes, subsets, casts, relocation, outlines, formats, levels, feeds)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: with_measured_joins(q[0]) for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for m in MODULES for name, q in m.QUERIES.items() if q[1]}
