"""What changed: exclusions, generated files, shares by category and extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import category, extension, is_excluded

GENERATED_LINES = 1000


def generated_paths(churn: DataFrame, path: list[str], added: str = "added", least: float = GENERATED_LINES) -> DataFrame:
    """Paths with a single churn row, which added `least` lines or more."""
    found = churn.groupBy(*path).agg(F.count(F.lit(1)).alias("touches"), F.max(added).alias("lines"))
    return found.where((F.col("touches") == 1) & (F.col("lines") >= least)).drop("touches")


def without(churn: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """Churn of other paths; paths(keys) has each at most once, and adaptive execution broadcasts it if it is small."""
    return churn.join(paths.select(*keys), keys, "left_anti")


def kept_churn(churn: DataFrame, generated: DataFrame) -> DataFrame:
    """Churn rows that count: with lines, on paths that are neither excluded nor generated."""
    rows = churn.where((F.col("added") + F.col("deleted") > 0) & ~is_excluded(F.col("path")))
    return without(rows, generated, ["repo_id", "path"])


def shares(rows: DataFrame, keys: list[str], label: Column, amount: Column, commit: str | None = None, order: Column | None = None) -> DataFrame:
    """Share of the amount by label within keys; rows without a label are out, of the total too.

    commit adds distinct commits; order adds where a label was first seen.
    """
    what = [F.sum(amount).alias("amount")]
    if commit:
        what.append(F.count_distinct(commit).alias("commits"))
    if order is not None:
        what.append(F.min(order).alias("first_seen"))
    found = rows.withColumn("label", label).where(F.col("label").isNotNull()).groupBy(*keys, "label").agg(*what)
    total = F.sum("amount").over(Window.partitionBy(*(keys or [F.lit(1)])))
    return found.withColumn("share", F.when(total > 0, F.col("amount").cast("double") / total).otherwise(0.0))


def category_shares(churn: DataFrame) -> DataFrame:
    """repo_id, label, amount, commits, first_seen, share over kept churn(repo_id, sha, pos, file_pos, path, added, deleted)."""
    return shares(churn, ["repo_id"], category(F.col("path")), F.col("added") + F.col("deleted"), "sha", F.struct("pos", "file_pos"))


def extension_shares(churn: DataFrame) -> DataFrame:
    """Likewise by extension; files without one are not in the total."""
    return shares(churn, ["repo_id"], extension(F.col("path")), F.col("added") + F.col("deleted"), None, F.struct("pos", "file_pos"))
