"""Whether dates look rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import DAY_MS, as_timestamp, days_between, millis
from .ordered import preceding

MISMATCH_MS = 48 * 3_600_000
EPSILON_MS = 7 * DAY_MS


def mismatch(first: Column, second: Column, most_ms: int = MISMATCH_MS) -> Column:
    """Whether two dates differ by strictly more."""
    return F.abs(millis(first) - millis(second)) > most_ms


def mismatch_share(first: Column, second: Column, most_ms: int = MISMATCH_MS) -> Column:
    """An aggregate."""
    return F.avg(F.when(mismatch(first, second, most_ms), 1.0).otherwise(0.0))


def bursts(rows: DataFrame, keys: list[str], ts: str, window_ms: int = DAY_MS) -> DataFrame:
    """Rows in the densest window of each group, over all rows of the group; a gap of exactly the window still counts.

    Rows are dealt by group and window-long slot, with a copy for the slot that
    follows, where a window that starts here may still end.  So a hot group is as
    many tasks' work as it has slots, and no task holds more than two slots.
    """
    at = rows.select(*keys, millis(F.col(ts)).alias("__ms")).withColumn("__slot", F.floor(F.col("__ms") / window_ms))
    dealt = at.withColumn("__ahead", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__slot", F.col("__slot") + F.col("__ahead"))
    near = Window.partitionBy(*keys, "__slot").orderBy("__ms").rangeBetween(-window_ms, 0)
    counted = dealt.withColumn("__near", F.count(F.lit(1)).over(near)).where("__ahead = 0")
    found = counted.groupBy(*keys).agg(F.max("__near").alias("densest"), F.count(F.lit(1)).alias("n"))
    return found.withColumn("burst_ratio", F.col("densest").cast("double") / F.col("n"))


def date_forensics(commits: DataFrame, keys: list[str]) -> DataFrame:
    """author_span_days, committer_span_days, mismatch_ratio, committer_burst_ratio of commits(author_ts, committer_ts)."""
    a, c = F.col("author_ts"), F.col("committer_ts")
    spans = commits.groupBy(*keys).agg(
        days_between(F.min(as_timestamp(a)), F.max(as_timestamp(a))).alias("author_span_days"),
        days_between(F.min(as_timestamp(c)), F.max(as_timestamp(c))).alias("committer_span_days"),
        mismatch_share(a, c).alias("mismatch_ratio"),
    )
    return spans.join(bursts(commits, keys, "committer_ts").withColumnRenamed("burst_ratio", "committer_burst_ratio").drop("densest", "n"), keys)


def chain_check(chain: DataFrame, epsilon_ms: int = EPSILON_MS) -> DataFrame:
    """Verdicts of a chain(chain_id, seq, prev_hash, head_hash, claimed_ts, received_ts) against each row's predecessor.

    A long chain is checked in ranges, each of which hands its last row to the next.
    """
    rows = preceding(chain, ["seq"], ["chain_id"], ["seq", "head_hash", "received_ts"], "__before")
    before = lambda c: F.col(f"__before.{c}")
    first = before("seq").isNull()
    verdict = (
        F.when(first & F.col("prev_hash").isNotNull(), "unknown_start")
        .when(first, "start")
        .when(F.col("seq") != before("seq") + 1, "gap")
        .when(~F.col("prev_hash").eqNullSafe(before("head_hash")), "broken_link")
        .when(millis(F.col("claimed_ts")) < millis(before("received_ts")) - epsilon_ms, "backdated")
        .otherwise("ok")
    )
    return rows.withColumn("verdict", verdict).drop("__before")
