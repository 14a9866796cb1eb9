"""Skills from packages and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import as_timestamp
from ..shared import checkpointed


def package_slugs(packages: DataFrame, package_map: DataFrame, package: str = "package") -> DataFrame:
    """Inner join with the map(package, slug), a dictionary of fixed size that the session may broadcast by its own threshold."""
    return packages.join(package_map, package)


def rollup(hits: DataFrame, keys: list[str], commit: str, ts: str) -> DataFrame:
    """Distinct commits, first and last time of each slug."""
    return hits.groupBy(*keys).agg(F.count_distinct(commit).alias("commit_count"), F.min(as_timestamp(F.col(ts))).alias("first_seen"), F.max(as_timestamp(F.col(ts))).alias("last_seen"))


def outside_vocabulary(values: DataFrame, vocabulary: DataFrame, column: str = "slug") -> DataFrame:
    """Distinct values that the vocabulary lacks."""
    return values.select(column).distinct().join(vocabulary.select(column).distinct(), column, "left_anti")


def require_vocabulary(values: DataFrame, vocabulary: DataFrame, column: str = "slug") -> None:
    """Raises with a few of the values that the vocabulary lacks."""
    if lacking := outside_vocabulary(values, vocabulary, column).orderBy(column).head(5):
        raise ValueError(f"not in the vocabulary: {', '.join(str(r[0]) for r in lacking)}")


def map_faults(package_map: DataFrame, taxonomy: DataFrame, least: int = 585) -> DataFrame:
    """rule, detail rows where a package map breaks its rules: size, repeated keys, unknown slugs, dotted keys that are strict prefixes of others."""
    few = package_map.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least).select(F.lit("too_few").alias("rule"), F.col("n").cast("string").alias("detail"))
    twice = package_map.groupBy("package").count().where("count > 1").select(F.lit("repeated").alias("rule"), F.col("package").alias("detail"))
    unknown = outside_vocabulary(package_map, taxonomy).select(F.lit("unknown_slug").alias("rule"), F.col("slug").alias("detail"))
    # Keys once each: rows that repeat a head would meet all that repeat a longer key.
    dotted = checkpointed(package_map.where(F.col("package").contains(".")).select("package").distinct())
    parts = F.split("package", r"\.")
    heads = dotted.select(F.col("package").alias("longer"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).alias("package"))
    prefix = heads.join(dotted, "package", "left_semi").select(F.lit("prefix").alias("rule"), F.concat_ws(" < ", "package", "longer").alias("detail"))
    return few.unionByName(twice).unionByName(unknown).unionByName(prefix)


def release_list_faults(listed: DataFrame, package_map: DataFrame) -> DataFrame:
    """Listed packages that repeat or that the map lacks."""
    twice = listed.groupBy("package").count().where("count > 1").select(F.lit("repeated").alias("rule"), F.col("package").alias("detail"))
    unknown = listed.select("package").distinct().join(package_map, "package", "left_anti").select(F.lit("unmapped").alias("rule"), F.col("package").alias("detail"))
    return twice.unionByName(unknown)


def merged(*skills: DataFrame) -> DataFrame:
    """Union of skill tables, by slug."""
    first, *rest = skills
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first.orderBy("slug")


def release_candidates(listed: DataFrame, package_map: DataFrame, skills: DataFrame) -> DataFrame:
    """Listed packages of detected slugs, grouped by slug."""
    return listed.join(package_map, "package").join(skills.select("slug").distinct(), "slug", "left_semi").groupBy("slug").agg(F.array_sort(F.collect_set("package")).alias("packages"))


def anachronisms(skills: DataFrame, releases: DataFrame, keys: list[str] = ["slug"]) -> DataFrame:  # noqa: B006
    """Skills first seen before any of their packages existed.

    skills(keys, first_seen), releases(keys, created): created null for a package that could not be resolved, which
    clears its skill.
    """
    known = releases.groupBy(*keys).agg(F.min(as_timestamp(F.col("created"))).alias("earliest"), F.bool_and(F.col("created").isNotNull()).alias("complete"))
    return skills.join(known, keys).where(F.col("complete") & (as_timestamp(F.col("first_seen")) < F.col("earliest"))).drop("complete")


def timeline_warnings(found: DataFrame) -> DataFrame:
    text = F.format_string("%s: first seen %s, but released %s", "slug", F.date_format("first_seen", "yyyy-MM-dd"), F.date_format("earliest", "yyyy-MM-dd"))
    return found.select("slug", text.alias("warning")).orderBy("slug")
