"""Mixing sources to target weights on a time-varying curriculum.

Targets: the words of all sources are shared out by weight; a source gets at
most three times its own words and what it can't take is shared out again.
Order: within a source documents follow the MD5 of their id and their text's MD5.  Their cumulative
words are the source's token supply, walked again from the start for repeats.
Curriculum: a source's weight at time t in [0, 1] is target * (1 + a * (2t - 1)),
so its integrated demand is target * (t + a * (t * t - t)); the time at which a
document's turn comes is the inverse of that at its cumulative demand.

That time is told as a position: the number of words the whole mix has served by
then, from 0 to the words of all documents.  Documents are range-sorted by it.

Rows with one id, source and text are copies of one unit, each with a stretch of
supply of its own, so that any source can reach its target however its ids
repeat.  Prefix sums take two levels: MD5-prefix buckets of bounded size (a hot
source has many), then units within a bucket.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import checkpointed, lean_worker, select_columns, texts

WEIGHTS = (5, 2, 1)
#: Slope of the weight schedule of sources with the first, second and third weight.
SLOPES = (-0.5, 0.0, 0.5)
MOST = 3
#: Rows of a prefix-sum bucket, at most about so many; a source's share of rows in one task falls with it.
BUCKET_ROWS = 1_000
#: Copies of a unit that are dealt out together.
CHUNK = 1_000


@F.arrow_udf(LongType())
def n_words(text: pa.Array) -> pa.Array:
    lean_worker()
    return pa.array([len(t.split()) for t in texts(text)], pa.int64())


# Marked so that a join's null check doesn't run it again.
n_words = n_words.asNondeterministic()


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, docs, weight, slope, target, total: a row for each source of sizes(source, size).

    A source is held to MOST times its size if the level that remains for it and
    those with a larger size for their weight is above that; as level only rises,
    one pass in ascending order of size over weight finds all of them.  The
    windows run over one row a source.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (rank + 1).cast("int"))
    own = own.withColumn("weight", pick(WEIGHTS).cast("long")).withColumn("slope", pick(SLOPES))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy((wide("source_size") * math.lcm(*WEIGHTS) / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({"total": F.sum("source_size").over(every), "spent": F.coalesce(F.sum(F.col("source_size") * MOST).over(before), F.lit(0)), "weights": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    own = own.withColumn("held", (wide("total") - wide("spent")) * F.col("weight") > wide("source_size") * MOST * F.col("weights"))
    own = own.withColumns({"rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("held"), F.col("source_size") * MOST)).over(every), F.lit(0)), "open": F.sum(F.when(~F.col("held"), F.col("weight"))).over(every)})
    target = F.when(F.col("held"), (F.col("source_size") * MOST).cast("double")).otherwise((F.col("rest") * F.col("weight")).cast("double") / F.col("open").cast("double"))
    return own.select("source", "source_size", "docs", "weight", "slope", target.alias("target"), "total")


def position(share: Column, slope: Column) -> Column:
    """Inverse of t + a * (t * t - t) = share on [0, 1]."""
    return 2 * share / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share))


def schedule(sizes: DataFrame) -> DataFrame:
    """A row for each run of at most CHUNK copies of a unit of sizes(doc_id, source, key, size).

    Columns: doc_id, source, key, size, copies (of the unit), from and to (the
    run's copies, to exclusive), source_size, target, slope, total, and supply:
    the words of the source before the unit.  What a copy is due follows from
    these alone, so reruns agree whatever the order of the input.
    """
    goals = checkpointed(targets(sizes))
    most = goals.agg(F.max("docs")).first()[0] or 0
    digits = max(0, math.ceil(math.log(max(1, most / BUCKET_ROWS), 16)))
    units = sizes.groupBy("doc_id", "source", "key", "size").agg(F.count(F.lit(1)).alias("copies"))
    # The text counts too, so that units of one id (or of none) are spread over buckets.
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("key"))
    units = units.withColumn("words", F.col("size") * F.col("copies")).withColumn("hash", F.md5(name)).withColumn("bucket", F.substring("hash", 1, digits))
    sums = units.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("source").alias("start_source"), F.col("bucket").alias("start_bucket"), before.alias("before"))
    starts = starts.join(goals.drop("docs", "weight").withColumnRenamed("source", "goal"), F.col("start_source").eqNullSafe(F.col("goal")))
    inner = Window.partitionBy("source", "bucket").orderBy("hash", F.col("doc_id").asc_nulls_first(), "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("within", F.coalesce(F.sum("words").over(inner), F.lit(0)))
    placed = units.join(starts, F.col("source").eqNullSafe(F.col("start_source")) & (F.col("bucket") == F.col("start_bucket")))
    chunks = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))
    runs = placed.select("doc_id", "source", "key", "size", "copies", "source_size", "target", "slope", "total", (F.col("before") + F.col("within")).alias("supply"), F.explode(chunks).alias("from"))
    return runs.withColumn("to", F.least(F.col("from") + CHUNK, F.col("copies")))


def due(copy: Column) -> Column:
    """Ascending positions at which this copy of a row of schedule() is taken."""
    # Twice the middle of the copy's stretch of supply, in each walk: taken if that is below twice the target.
    middle = 2 * (F.col("supply") + copy * F.col("size")) + F.col("size")
    turns = F.filter(F.array(*[middle + 2 * k * F.col("source_size") for k in range(MOST)]), lambda x: x.cast("double") < 2 * F.col("target"))
    time = lambda x: position(x.cast("double") / (2 * F.col("target")), F.col("slope"))
    return F.transform(turns, lambda x: F.floor(time(x) * F.col("total").cast("double")).cast("long"))


def _key() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (a hash of the text), size of each row."""
    rows = select_columns(docs, "doc_id", "source", "text").select("doc_id", "source", _key().alias("key"), "text")
    return rows.select("doc_id", "source", "key", n_words("text").alias("size"))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, positions for each row of docs(doc_id, source, text), range-sorted by first position.

    positions ascend, one for each time that the row is taken; rows never taken
    come last.  Null text has size 0 (it is never taken for any words); a null
    source is the last source.  Null ids count like an empty id for the order.
    Equal rows are copies of one unit with turns of their own.  An empty table
    gives an empty result; other columns are ignored.
    """
    runs = schedule(checkpointed(_sizes(docs)))
    copies = runs.select("*", F.explode(F.sequence("from", F.col("to") - 1)).alias("copy"))
    placed = copies.select("doc_id", "size", "source_size", "target", due(F.col("copy")).alias("positions"))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"), "positions").orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), F.col("doc_id").asc_nulls_first())


def mix(docs: DataFrame) -> DataFrame:
    """docs as the curriculum takes them: a row for each time, range-sorted by position; just the columns of docs.

    Null text, null source, null ids and empty tables are as in mixed.  Rows
    with one id, source and text count as one row, the smallest as JSON, taken as often as all of them are due.
    """
    runs = schedule(checkpointed(_sizes(docs)))
    turns = F.flatten(F.transform(F.sequence("from", F.col("to") - 1), due))
    plan = runs.select(F.col("doc_id").alias("plan_id"), F.col("source").alias("plan_source"), F.col("key").alias("plan_key"), "copies", turns.alias("positions")).where(F.size("positions") > 0)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"), _key().alias("key"))
    same = F.col("id").eqNullSafe(F.col("plan_id")) & F.col("of").eqNullSafe(F.col("plan_source")) & (F.col("key") == F.col("plan_key"))
    once = whole.join(plan.where("copies = 1"), same)
    # One row of each repeated unit, folded before it is shuffled.
    several = whole.join(plan.where("copies > 1").select("plan_id", "plan_source", "plan_key").distinct(), same, "left_semi")
    several = several.groupBy("id", "of", "key").agg(F.min_by("row", F.to_json("row")).alias("row")).join(plan.where("copies > 1"), same)
    taken = once.select("row", "id", F.explode("positions").alias("position")).unionByName(several.select("row", "id", F.explode("positions").alias("position")))
    return taken.orderBy("position", F.col("id").asc_nulls_first()).select("row.*")
