"""Session factory: UTC, adaptive execution, modest shuffle partitions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "histlens", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; conf overrides them (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        # What operators write into the shared folder goes when nothing refers to it any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
