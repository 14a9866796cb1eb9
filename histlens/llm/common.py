"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpointed, remove, shared_folder, work_path

__all__ = ["binary", "checkpointed", "documents", "kept_between_tasks", "lean_worker", "map_batches", "remove", "select_columns", "shared_folder", "text_key", "texts", "work_path"]


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as UTF-8 bytes, without copying where Arrow allows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each text as bytes, one at a time, so that a batch is never held twice; null counts as empty."""
    for value in binary(column):
        yield value.as_py() or b""


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            made = function(batch)
            if made is not None and made.num_rows:
                yield made

    return df.mapInArrow(run, schema)


#: What frees memory that an operator keeps between tasks of one Python worker.
_RELEASES: list[Callable[[], None]] = []


def kept_between_tasks(release: Callable[[], None]) -> None:
    """Registers how to give back what later tasks of the same operator would use again."""
    _RELEASES.append(release)


def lean_worker() -> None:
    """Gives back what other operators' tasks left in this Python worker; workers live on from stage to stage."""
    for release in _RELEASES:
        release()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key() -> Column:
    """A hash of column text, which with the id tells rows apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def select_columns(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns; a lacking one is an error of the caller's, extra ones are ignored."""
    return df.select(*[F.col(f"`{n}`") for n in names])
