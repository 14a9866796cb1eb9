"""When and how much: rankings, spans, histograms, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import as_timestamp, days_between, hour_of, weekday_of


def author_ranking(commits: DataFrame, author: str = "email", pos: str = "pos", keys: tuple[str, ...] = ()) -> DataFrame:
    """Authors by number of commits, then by first appearance."""
    found = commits.groupBy(*keys, author).agg(F.count(F.lit(1)).alias("commits"), F.min(pos).alias("first_pos"))
    return found.orderBy(*keys, F.desc("commits"), "first_pos")


def activity_span(commits: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """True first and last time, and whole days between."""
    found = commits.groupBy(*keys).agg(F.min(as_timestamp(F.col(ts))).alias("first_at"), F.max(as_timestamp(F.col(ts))).alias("last_at"))
    return found.withColumn("span_days", days_between(F.col("first_at"), F.col("last_at")))


def histogram(slot: Column, size: int) -> Column:
    """An aggregate: counts of slots 0 to size - 1, zeros included, in one pass without a join."""
    return F.array(*[F.count_if(slot == k) for k in range(size)])


def hour_histogram(ts: str) -> Column:
    return histogram(hour_of(F.col(ts)), 24)


def weekday_histogram(ts: str) -> Column:
    return histogram(weekday_of(F.col(ts)), 7)


def unrolled(df: DataFrame, column: str, slot: str, value: str) -> DataFrame:
    """A row for each slot of a histogram column."""
    return df.select(*[c for c in df.columns if c != column], F.posexplode(column).alias(slot, value))


def signed_share(signed: Column) -> tuple[Column, Column]:
    """Aggregates: number of signed rows and their share."""
    return F.count_if(signed), F.count_if(signed).cast("double") / F.count(F.lit(1))


def thin_history(profile: DataFrame, commits: str = "commits", days: str = "span_days", shallow: str = "shallow") -> DataFrame:
    """Why a history is too thin to say much: shallow clone first, then under ten commits, then a single day; else null."""
    reason = F.when(F.col(shallow), "shallow").when(F.col(commits) < 10, "few_commits").when(F.col(days) <= 0, "single_day")
    return profile.withColumn("thin_reason", reason)
