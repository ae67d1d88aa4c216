"""Streaming forms of the series operators, for runs that still write their output."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState

from tidewater.spool import shared_dir


def restart_dedup(feed: DataFrame, late: str = "2 days") -> DataFrame:
    """The first copy of each station's time, as overlapping restarts send it again (``station, variable, ts``)."""
    return feed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["station", "variable", "ts"])


def daily_mean(feed: DataFrame, late: str = "1 day") -> DataFrame:
    """Mean by station, variable and day; a day comes out once it can get no more rows."""
    day = feed.withWatermark("ts", late).groupBy("station", "variable", F.window("ts", "1 day"))
    return day.agg(F.avg("value").alias("value"), F.count("*").alias("n")).select("station", "variable", F.unix_micros("window.start").alias("t"), "value", "n")


def sliding_mean(feed: DataFrame, width: str = "1 day", step: str = "6 hours", late: str = "1 day") -> DataFrame:
    own = feed.withWatermark("ts", late).groupBy("variable", F.window("ts", width, step))
    return own.agg(F.avg("value").alias("value")).select("variable", F.unix_micros("window.start").alias("t"), "value")


def coverage_sessions(feed: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Spans in which a station's records follow each other within ``gap``."""
    own = feed.withWatermark("ts", late).groupBy("station", F.session_window("ts", gap))
    return own.agg(F.count("*").alias("n")).select("station", F.unix_micros("session_window.start").alias("a"), F.unix_micros("session_window.end").alias("z"), "n")


def block_completeness(feed: DataFrame, expected: int, width: str = "5 days", late: str = "1 day") -> DataFrame:
    """``station, a, n, complete``: whether ``expected`` of the few variables came in each block, once it is over."""
    own = feed.withWatermark("ts", late).groupBy("station", F.window("ts", width))
    n = F.size(F.collect_set("variable")).cast("long")
    return own.agg(n.alias("n")).select("station", F.unix_micros("window.start").alias("a"), "n", (F.col("n") >= expected).alias("complete"))


def with_station(feed: DataFrame, stations: DataFrame) -> DataFrame:
    """Each record with its station's unit and datum (static, small by nature); unknown stations stay."""
    return feed.join(stations, "station", "left")


def last_operation(feed: DataFrame) -> DataFrame:
    """``station, variable, t, op`` of a feed (``station, variable, ts, op``): each record's last operation at or before it.

    The state of a structure is its last operation. Records of a batch are put in order of time, operations first; one that
    comes later than a newer operation takes what was known before its batch only if that is not newer.
    """
    own = feed.select("station", "variable", F.unix_micros("ts").alias("t"), "op")

    def carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(batches))
        at, op = state.get if state.exists else (None, None)
        x = x.assign(none=x["op"].isna()).sort_values(["t", "none"])
        known = x["op"].ffill()
        if at is not None:
            known = known.where(known.notna() | (x["t"] < at), op)
        ops = x[~x["none"]]
        if len(ops) and (at is None or ops["t"].iloc[-1] >= at):
            state.update((int(ops["t"].iloc[-1]), float(ops["op"].iloc[-1])))
        yield pd.DataFrame({"station": key[0], "variable": x["variable"], "t": x["t"], "op": known})

    schema = "station long, variable string, t long, op double"
    return own.groupBy("station").applyInPandasWithState(carry, schema, "at long, op double", "append", "NoTimeout")


def read_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/event[s].parquet")
    return raw.select(F.col("user_id").alias("station"), F.col("event_type").alias("variable"), F.col("ts").cast("timestamp").alias("ts"), "value")


def run_to_end(stream: DataFrame) -> DataFrame:
    """Runs a stream over what is there, to a table in the shared folder, and reads that."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
