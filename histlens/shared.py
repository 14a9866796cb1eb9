"""The folder that driver and executors share, and tables written there once."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ADAPTIVE = "spark.sql.adaptive.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the checkpoint folder the context was given.

    Where neither is set, one machine's own run (tests) gets a folder of its own;
    on a cluster such a folder would lose data, so that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not found:
        if held.isDefined():
            return held.get()
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="histlens-checkpoint-")
    if held.isEmpty():
        context.setCheckpointDir(found)
    return found


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _shuffles_go(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries made and run here leave no shuffle files; for tables that are written, so that nothing reads those again."""
    return _set(spark, CLEANUP, "true")


def checkpointed(df: DataFrame, dealt: bool = False) -> DataFrame:
    """df, computed once into the shared folder; later reads survive lost executors and never compute it again.

    dealt: what reads it knows how df's last shuffle dealt the rows and doesn't deal them again; for that its plan may not adapt.
    """
    shared_folder(df.sparkSession)
    with _shuffles_go(df.sparkSession), _set(df.sparkSession, ADAPTIVE, "false") if dealt else nullcontext():
        # A frame takes the setting when it is made.
        return df.select("*").checkpoint()


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, computed once into Parquet in the shared folder: packed, so for tables of many rows; the folder is the run's own and stays until that goes."""
    path = path or work_path(df.sparkSession, "table")
    with _shuffles_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(df: DataFrame) -> Iterator[DataFrame]:
    """written(df), for steps that are run before this ends: then the table goes."""
    path = work_path(df.sparkSession, "table")
    yield written(df, path)
    remove(df.sparkSession, path)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/histlens-{uuid.uuid4().hex}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more, wherever Spark's file systems keep it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
