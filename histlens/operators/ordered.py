"""Order over whole tables, however many rows one group has: positions, running aggregates, the row before.

Groups of up to BIG rows are left to a window.  Larger ones, and tables that are
one group, are range-partitioned by group and order and sorted, once, into the
shared folder.  Each partition then hands on only what later ones need of it:
counts, an aggregate or its last row for each group that it holds.  A group of
any size is as many tasks' work as it has partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import checkpointed

PART, AT = "__part", "__at"
#: Rows of a group that one task sorts, at most.
BIG = 100_000
#: monotonically_increasing_id keeps the row's place in its partition in so many bits.
_BITS = 33


def laid_out(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """rows sorted by `order`, with __part (partitions ascend with the order) and __at (place in the partition, from 0).

    Rows equal in all of `order` share a partition, so end it with what tells rows apart.
    rows are computed twice (bounds are sampled first); write them before if that is costly.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    return checkpointed(dealt.withColumns({PART: F.shiftright("__place", _BITS), AT: F.col("__place").bitwiseAND((1 << _BITS) - 1)}).drop("__place"))


def _handed_on(laid: DataFrame, keys: Sequence[str], facts: dict[str, Column], before: dict[str, Column]) -> DataFrame:
    """laid with `before`: columns over the rows of facts(__part, keys) of one group, by partition."""
    held = laid.groupBy(PART, *keys).agg(*[c.alias(n) for n, c in facts.items()])
    earlier = Window.partitionBy(*keys).orderBy(PART)
    handed = held.select(F.col(PART).alias("__of"), *[F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)], *[c.over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias(n) for n, c in before.items()])
    same = F.col(PART) == F.col("__of")
    for i, k in enumerate(keys):
        same &= F.col(f"`{k}`").eqNullSafe(F.col(f"__key{i}"))
    # Without groups there is one row a partition.
    return laid.join(handed if keys else F.broadcast(handed), same, "left").drop("__of", *[f"__key{i}" for i in range(len(keys))])


def _by_size(rows: DataFrame, keys: Sequence[str], windowed: Callable[[DataFrame], DataFrame], dealt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """windowed(rows of groups up to BIG) and dealt(those of larger ones)."""
    if not keys:
        return dealt(rows)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > BIG)
    big = checkpointed(sizes.select(*[F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)]))
    if big.isEmpty():
        return windowed(rows)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(f"`{k}`").eqNullSafe(F.col(f"__key{i}"))
    return windowed(rows.join(big, same, "left_anti")).unionByName(dealt(rows.join(big, same, "left_semi")))


def numbered(rows: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """rows with their position (long, from 0 without gaps) by `order`, in each group of `keys` or in all.

    Null keys are a group.  An empty table stays empty.  rows are read more than once.
    """

    def dealt(rows: DataFrame) -> DataFrame:
        laid = laid_out(rows, [*keys, *order])
        inside = F.col(AT)
        if keys:
            laid = laid.withColumn("__low", F.min(AT).over(Window.partitionBy(PART, *keys)))
            inside = F.col(AT) - F.col("__low")
        found = _handed_on(laid, keys, {"__n": F.count(F.lit(1))}, {"__before": F.sum("__n")})
        return found.withColumn(name, F.coalesce("__before", F.lit(0)) + inside).drop(PART, AT, "__low", "__before")

    return _by_size(rows, keys, lambda r: r.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1), dealt)


def running(rows: DataFrame, order: Sequence[str | Column], keys: Sequence[str], values: dict[str, tuple[Callable[[Column], Column], Column]]) -> DataFrame:
    """rows with each name of `values` = (aggregate, column): the aggregate over the group's rows up to and with this one.

    An aggregate is F.sum, F.min or F.max: one that can be taken of its own results and skips nulls.
    """
    if any(aggregate not in (F.sum, F.min, F.max) for aggregate, _ in values.values()):
        raise ValueError("running takes F.sum, F.min and F.max")
    over = lambda r, w: r.withColumns({n: aggregate(column).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for n, (aggregate, column) in values.items()})

    def dealt(rows: DataFrame) -> DataFrame:
        laid = laid_out(rows, [*keys, *order])
        facts = {f"__held_{n}": aggregate(column) for n, (aggregate, column) in values.items()}
        earlier = {f"__earlier_{n}": aggregate(F.col(f"__held_{n}")) for n, (aggregate, _) in values.items()}
        found = over(_handed_on(laid, keys, facts, earlier), Window.partitionBy(PART, *keys).orderBy(AT))
        return found.withColumns({n: _both(aggregate, F.col(f"__earlier_{n}"), F.col(n)) for n, (aggregate, _) in values.items()}).drop(PART, AT, *earlier)

    return _by_size(rows, keys, lambda r: over(r, Window.partitionBy(*keys).orderBy(*order)), dealt)


def _both(aggregate: Callable[[Column], Column], a: Column, b: Column) -> Column:
    """The aggregate of two values, either of which may be null."""
    if aggregate is F.sum:
        return F.coalesce(a + b, a, b)
    return F.least(a, b) if aggregate is F.min else F.greatest(a, b)


def preceding(rows: DataFrame, order: Sequence[str | Column], keys: Sequence[str], columns: Sequence[str], name: str = "before") -> DataFrame:
    """rows with a struct `name` of the columns of the row before in its group; null for a group's first row."""
    whole = F.struct(*columns)

    def dealt(rows: DataFrame) -> DataFrame:
        laid = _handed_on(laid_out(rows, [*keys, *order]), keys, {"__last": F.max_by(whole, AT)}, {"__handed": F.last("__last")})
        own = F.lag(whole).over(Window.partitionBy(PART, *keys).orderBy(AT))
        return laid.withColumn(name, F.coalesce(own, F.col("__handed"))).drop(PART, AT, "__handed")

    return _by_size(rows, keys, lambda r: r.withColumn(name, F.lag(whole).over(Window.partitionBy(*keys).orderBy(*order))), dealt)
