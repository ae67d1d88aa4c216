"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders spooled within the innermost ``scratch``; None outside of any.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a local one for a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-spool-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir() or made


def run_dir(spark: SparkSession) -> str:
    """The folder below the shared one in which this application's tables are; ``drop_run`` deletes it."""
    return f"{shared_dir(spark).rstrip('/')}/spool-{spark.sparkContext.applicationId}"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def spool(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends here and it is computed once.

    Shuffle files of the write are let go of as it ends, where the session can do so: nothing reads them again.
    """
    path = f"{run_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables spooled within go when it ends, but for those given to the function it yields, which spools them to be read after it."""
    outer, made, stay = _MADE.get(), [], []

    def keep(df: DataFrame) -> DataFrame:
        kept = spool(df)
        stay.append(made.pop())
        return kept

    token = _MADE.set(made)
    try:
        yield keep
    finally:
        _MADE.reset(token)
        for path in made:
            _delete(spark, path)
        if outer is not None:
            outer.extend(stay)


def drop_run(spark: SparkSession) -> None:
    """Deletes all spooled tables of this application: for when its results are written. Tables that read them are lost."""
    _delete(spark, run_dir(spark))


def drop_spool(df: DataFrame) -> None:
    """Deletes the files of a spooled table that no later step reads."""
    for name in df.inputFiles()[:1]:
        folder = name.rsplit("/", 1)[0]
        if "/spool-" in folder:
            _delete(df.sparkSession, folder)

