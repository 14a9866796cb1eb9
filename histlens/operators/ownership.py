"""Whose work it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import salted


def selected(commits: DataFrame, authors: DataFrame, author: str = "email") -> DataFrame:
    """Commits of these authors, by exact equality."""
    return commits.join(authors.select(author).distinct(), author, "left_semi")


def ownership_ratio(commits: DataFrame, authors: DataFrame, author: str = "email", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """user_total, all_total and user_commit_ratio, in one pass: a mark from an outer join instead of two scans."""
    marks = authors.select(F.col(author)).distinct().withColumn("__mine", F.lit(True))
    joined = commits.join(marks, author, "left")
    found = joined.groupBy(*keys).agg(F.count_if(F.col("__mine")).alias("user_total"), F.count(F.lit(1)).alias("all_total"))
    return found.withColumn("user_commit_ratio", F.when(F.col("all_total") > 0, F.col("user_total").cast("double") / F.col("all_total")).otherwise(0.0))


def other_contributors(commits: DataFrame, authors: DataFrame, author: str = "email", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Distinct authors who were not selected."""
    others = commits.join(authors.select(author).distinct(), author, "left_anti")
    return others.groupBy(*keys).agg(F.count_distinct(author).alias("other_contributors"))


def corroborated(claims: DataFrame, verified: DataFrame, salt: str, most: int = 1000, keys: tuple[str, ...] = ()) -> DataFrame:
    """How many claimed hashes belong to verified emails, for each of `keys` of the claims; null for over `most` claims.

    claims(keys, hash), verified(email).
    """
    known = verified.select(salted(F.col("email"), salt).alias("hash")).distinct().withColumn("__known", F.lit(True))
    found = claims.join(known, "hash", "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("__known")).alias("hits"))
    return found.select(*keys, "claims", F.when(F.col("claims") <= most, F.col("hits")).alias("corroborated"))


def selection_state(stored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of each stored selection(emails) against all rows of candidates(emails): whether all are there, and which still are, in order.

    No rows of candidates are no candidates; an empty selection is all there.
    """
    known = candidates.select(F.explode("emails").alias("email")).distinct().withColumn("__known", F.lit(True))
    marked = stored.select(F.monotonically_increasing_id().alias("__id"), F.array_distinct("emails").alias("emails"))
    rows = marked.select("__id", F.posexplode_outer("emails").alias("at", "email"))
    here = F.coalesce("__known", F.lit(False))
    found = rows.join(known, "email", "left").groupBy("__id").agg(F.bool_and(here | F.col("at").isNull()).alias("all_present"), F.sort_array(F.collect_list(F.when(here, F.struct("at", "email")))).alias("kept"))
    return found.select("all_present", F.col("kept.email").alias("still_present"))
