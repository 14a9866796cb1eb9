"""Order within a scope: look-ups before writes, snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import preceding, running


def preceded_by(rows: DataFrame, keys: list[str], order: list[str], earlier: Column, value: Column) -> DataFrame:
    """rows with `seen_before` (an earlier-or-same row matched) and `first_seen` (the least value of such rows).

    A large group is read in ranges, each of which hands its running minimum to the next.
    """
    return running(rows, order, keys, {"first_seen": (F.min, F.when(earlier, value))}).withColumn("seen_before", F.col("first_seen").isNotNull())


def added(child: Column, parent: Column) -> Column:
    """Distinct items of a child that its parent lacks; all of them without a parent."""
    return F.when(parent.isNull(), F.array_distinct(child)).otherwise(F.array_except(child, parent))


def successive_additions(snapshots: DataFrame, keys: list[str], order: str, items: str) -> DataFrame:
    """Each snapshot's items that the one before it, by key, did not have."""
    rows = preceding(snapshots, [order], keys, [items], "__parent")
    return rows.withColumn("added", added(F.col(items), F.col(f"__parent.{items}"))).drop("__parent")


def manifest_additions(manifests: DataFrame, commits: DataFrame, blobs: DataFrame, dependencies: Column, valid: Column) -> DataFrame:
    """Dependencies that a commit added to a manifest: (repo_id, sha, path, package).

    manifests(repo_id, sha, path) touched; blobs(repo_id, revision, path, content).
    dependencies and valid are columns of `content`.  A manifest without a parent
    version adds all of its dependencies; one that can't be read, or whose parent
    can't, adds none.
    """
    parsed = blobs.select("repo_id", "revision", "path", dependencies.alias("deps"), valid.alias("valid"))
    child = parsed.select("repo_id", F.col("revision").alias("sha"), "path", "deps", "valid")
    parent = parsed.select("repo_id", F.col("revision").alias("parent_sha"), "path", F.col("deps").alias("parent_deps"), F.col("valid").alias("parent_valid"))
    rows = manifests.select("repo_id", "sha", "path").join(commits.select("repo_id", "sha", "parent_sha"), ["repo_id", "sha"]).join(child, ["repo_id", "sha", "path"]).join(parent, ["repo_id", "parent_sha", "path"], "left")
    rows = rows.where(F.col("valid") & F.coalesce(F.col("parent_valid"), F.lit(True)))
    return rows.select("repo_id", "sha", "path", F.explode(added(F.col("deps"), F.col("parent_deps"))).alias("package"))
