"""Streaming variants over a landing folder of commits; an extension, the batch operators are the definition."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import COMMITS

DAY_MS = 86_400_000


def commit_stream(spark: SparkSession, folder: str, late: str = "2 days") -> DataFrame:
    """commits as Parquet files land, with a watermark on the committer's time."""
    return spark.readStream.schema(COMMITS).parquet(folder).withWatermark("committer_ts", late)


def daily_activity(commits: DataFrame) -> DataFrame:
    """Commits of each repository and author in tumbling days, append-only once a day is past the watermark."""
    day = F.window("committer_ts", "1 day")
    found = commits.groupBy(day, "repo_id", "email").agg(F.count(F.lit(1)).alias("commits"), F.count_if(F.col("signed")).alias("signed"))
    return found.select("repo_id", "email", F.col("window.start").alias("day"), "commits", "signed")


def densest_window(commits: DataFrame, window_ms: int = DAY_MS) -> DataFrame:
    """repo_id, n, densest: the sliding maximum so far, kept as state.

    The state holds the times of the last window only, so it is bounded by the busiest window of a repository; rows
    older than that which come late count by themselves.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, densest, recent = state.get if state.exists else (0, 0, [])
        times = sorted([*recent, *(int(t.timestamp() * 1000) for b in batches for t in b["committer_ts"])])
        n += len(times) - len(recent)
        low = 0
        for high, t in enumerate(times):
            while t - times[low] > window_ms:
                low += 1
            densest = max(densest, high - low + 1)
        state.update((n, densest, times[low:]))
        yield pd.DataFrame({"repo_id": [key[0]], "n": [n], "densest": [densest]})

    return commits.groupBy("repo_id").applyInPandasWithState(update, "repo_id string, n long, densest long", "n long, densest long, recent array<long>", "update", GroupStateTimeout.NoTimeout)
