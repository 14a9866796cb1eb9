"""Small keyed tables and JSON sinks."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.paths import is_snapshot_source

MOST_FILES, MOST_BYTES = 5000, 200 * 1024


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The store, or an empty one where there is none; rows that can't be read are left out."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with new's rows in place of those of the same keys; a null key matches a null key."""
    turn = Window.partitionBy(*keys).orderBy(F.col("__age"))
    rows = new.withColumn("__age", F.lit(0)).unionByName(stored.withColumn("__age", F.lit(1)))
    return rows.withColumn("__turn", F.row_number().over(turn)).where("__turn = 1").drop("__turn", "__age")


#: Tries to publish a version, each after another writer was first.
TRIES = 20


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, text: str) -> str:
    """Writes a small text to a new file, unless there is one; gives what the file holds.

    Of two writers one creates the file and both read the same, so a salt made so is
    made once.  That is as safe as the file system's exclusive create: HDFS has one,
    a local disk may let two writers through at the same moment.
    """
    where, files = _hadoop(spark, path)
    try:
        out = files.create(where, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
    except Py4JJavaError as error:
        if not files.exists(where):
            raise error
    return spark.read.text(path, wholetext=True).first()[0]


def latest_version(spark: SparkSession, path: str) -> int:
    """The number of the last version of a store that was published, 0 where there is none."""
    where, files = _hadoop(spark, f"{path}/published")
    return max((int(f.getPath().getName()) for f in files.listStatus(where)), default=0) if files.exists(where) else 0


def read_version(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """A version of a store, the last one unless told; empty where there is none.  Rows that can't be read are left out."""
    version = latest_version(spark, path) if version is None else version
    if not version:
        return spark.createDataFrame([], schema)
    return read_store(spark, f"{path}/{spark.read.text(f'{path}/published/{version}', wholetext=True).first()[0]}", schema)


def commit_upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], schema: str) -> int:
    """Publishes a version of the store with new's rows in place of those of the same keys; gives its number.

    A version is written beside the others and published by creating the next
    number, which one writer can do; who comes second starts again from that
    version, so no one's rows are lost.  Readers see whole versions only.
    """
    for _ in range(TRIES):
        version, name = latest_version(spark, path), f"data-{uuid.uuid4().hex}"
        upsert(read_version(spark, path, schema, version), new, keys).write.json(f"{path}/{name}")
        if create_once(spark, f"{path}/published/{version + 1}", name) == name:
            return version + 1
        where, files = _hadoop(spark, f"{path}/{name}")
        files.delete(where, True)
    raise RuntimeError(f"{path}: others published a version at each of {TRIES} tries")


def write_json(bundles: DataFrame, path: str) -> None:
    """A JSON text a line, from the column json."""
    bundles.select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def snapshot_files(tree: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The first source files of each tree(repo_id, path, size) by path, without large and generated ones."""
    good = tree.where(is_snapshot_source(F.col("path")) & (F.col("size") <= most_bytes))
    turn = Window.partitionBy("repo_id").orderBy("path")
    return good.withColumn("__turn", F.row_number().over(turn)).where(F.col("__turn") <= most_files).drop("__turn")
