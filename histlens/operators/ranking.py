"""Top rows, group caps and presentation rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import slug_prefix


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group.  A rank filter right above the window lets Spark drop rows before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def group_remainder(rows: DataFrame, keys: list[str], order: list[Column], n: int, item: Column) -> DataFrame:
    """The first n items of each group, how many more there are, and how many in all."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("__rank", F.row_number().over(w))
    found = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("__rank") <= n, F.struct(F.col("__rank"), item.alias("item"))))).alias("__top"), F.count(F.lit(1)).alias("total"))
    return found.select(*keys, F.transform("__top", lambda x: x["item"]).alias("top_items"), F.greatest(F.col("total") - n, F.lit(0)).alias("remainder"), "total")


def visible(shares: DataFrame, least: float = 0.02) -> DataFrame:
    """Categories worth showing."""
    return shares.where((F.col("label") != "other") & (F.col("share") >= least))


def labelled(skills: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Skills with their label, or their slug where the taxonomy has none."""
    return skills.join(taxonomy.select("slug", F.col("label").alias("__label")), "slug", "left").withColumn("label", F.coalesce("__label", "slug")).drop("__label")


def capability_groups(skills: DataFrame, n: int = 4) -> DataFrame:
    """Skills(slug, commit_count) by slug prefix: total, the first n slugs and the remainder; structural ones are set apart."""
    plain = skills.where(~F.coalesce(F.col("evidence") == "structural", F.lit(False))) if "evidence" in skills.columns else skills
    grouped = plain.withColumn("prefix", slug_prefix(F.col("slug")))
    found = group_remainder(grouped, ["prefix"], [F.desc("commit_count"), F.col("slug")], n, F.col("slug"))
    totals = grouped.groupBy("prefix").agg(F.sum("commit_count").alias("commits"))
    return found.join(totals, "prefix").orderBy(F.desc("commits"), "prefix")


def structural_count(skills: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How many skills, in all or for each of `keys`, rest on structure."""
    return skills.groupBy(*keys).agg(F.count_if(F.col("evidence") == "structural").alias("structural"))


def skills_line(count: Column, top: Column, width: int, most: int = 3) -> Column:
    """How many skills there are, with as many of the top labels as fit in the width, and how many are not named."""
    base = F.concat(count.cast("string"), F.lit(" detected skills"))
    line = base
    for shown in range(1, most + 1):
        rest = count - shown
        more = F.when(rest > 0, F.concat(F.lit(", +"), rest.cast("string"), F.lit(" more"))).otherwise("")
        named = F.concat(base, F.lit(" (top: "), F.array_join(F.slice(top, 1, shown), ", "), more, F.lit(")"))
        line = F.when((F.size(top) >= shown) & (F.length(named) <= width), named).otherwise(line)
    return line
