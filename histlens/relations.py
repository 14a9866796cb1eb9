"""Driver tables as relations of the data model, and readers of dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.times import as_timestamp
from .schema import SIGNATURES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_repository(key: Column) -> Column:
    """A constant that the optimizer doesn't know to be one; it would turn joins on it into crossed ones."""
    return F.when(key >= 0, "tables").otherwise("none")


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as commits: the customer is the author, the first ship date the committer date."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped"))
    return orders.join(shipped, orders["o_orderkey"] == shipped["l_orderkey"]).select(
        one_repository(F.col("o_orderkey")).alias("repo_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("sha"), F.lit(None).cast("string").alias("parent_sha"), F.col("o_custkey").cast("string").alias("email"),
        as_timestamp(F.col("o_orderdate")).alias("author_ts"), as_timestamp(F.col("shipped")).alias("committer_ts"), (F.col("o_orderstatus") == "F").alias("signed"), F.lit(False).alias("is_merge"),
    )


def line_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as churn: a part's type and brand stand for directory and extension."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).drop("p_partkey")


def package_map(spark: SparkSession, path: str) -> DataFrame:
    """package, slug of a JSON file {"map": {package: slug}}; the file is a dictionary, small by nature."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema("map map<string, string>").json(path).select(F.explode("map").alias("package", "slug"))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """slug, label of a JSON file {"skills": [{slug, label}]}."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema("version string, skills array<struct<slug: string, label: string>>").json(path).select(F.inline("skills"))


def signatures(spark: SparkSession, folder: str) -> DataFrame:
    """All signature files below a folder, without package maps; a file without slug or fixtures is an error."""
    rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema(SIGNATURES).json(folder)
    rows = rows.withColumn("file", F.input_file_name()).where(~F.col("file").endswith("/package-map.json"))
    broken = F.raise_error(F.concat(F.lit("malformed signature file: "), F.element_at(F.split("file", "/"), -1)))
    return rows.withColumn("slug", F.when(F.col("slug").isNull() | F.col("fixtures").isNull(), broken).otherwise(F.col("slug"))).drop("file")
