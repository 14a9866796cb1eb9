"""Quality rules with adaptive thresholds.

Each document is measured once.  For every measure, integer values go into a
quantile sketch for each (lang, source): exact buckets below 64, then 32
buckets for each power of two (relative error below 1/32).  Sketches merge by
adding counts, so they are partial aggregates in Spark, a hot source sends a
bounded number of rows from each task, and parent sketches (language, all) are
sums of their children.  What is usual in a group tells what is too much there:

    upper = q3 + 3 * (q3 - q1)        lower = q1 - 3 * (q3 - q1)

A measure that most documents don't have at all has equal quartiles, and a long
tail above; such a measure's upper fence is as far beyond a high quantile as that
is beyond the median:

    upper = max(that, t + (t - median))

t is the measure's tail quantile, or the 99th percentile where that is no more
than the median.  A (lang, source) with under `least` documents, or in which a
measure doesn't vary that far, uses its language's sketch, a language the sketch
of all; where even that doesn't vary, any other value is too much.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import checkpointed, lean_worker, select_columns, texts

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Measure: its tail quantile, per mille.  Values are per mille, but word_length is in thousandths of a character.
MEASURES = {"word_length": 990, "symbols": 950, "dup_lines": 990, "repeats": 990}
#: Word length varies little around its middle in any text; it has fences on both sides, and room for short texts beyond them.
WORD_LENGTH, ROOM = "word_length", 1000
FURTHEST = 990
LEAST = 100
#: Groups whose fences are broadcast, at about 100 bytes each; more are joined by key.
BROADCAST_GROUPS = 50_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that are found twice or more, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, windows, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[windows] > 1
    if not twice.any():
        return 0
    marked = np.zeros(len(words), bool)
    for k in range(3):
        marked[k : k + n] |= twice
    return int(marked.sum())


def measures(text: bytes) -> tuple[int, ...]:
    """The columns of STATS."""
    words = text.split()
    seen: set[bytes] = set()
    lines = repeats = 0
    for line in text.split(b"\n"):
        if line.strip(WHITE):
            lines += 1
            repeats += line in seen
            seen.add(line)
    # Code points in words: bytes that start a character, less white space.
    points = len(text.decode("utf-8", "replace")) - sum(text.count(c) for c in WHITE)
    return len(words), points, sum(text.count(c) for c in SYMBOLS), repeats, repeated_words(words), lines


@F.arrow_udf(StructType([StructField(name, LongType()) for name in STATS]))
def measured(text: pa.Array) -> pa.Array:
    lean_worker()
    rows = [measures(t) for t in texts(text)]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(STATS))], list(STATS))


# Marked so that no copy of it is pushed below a join: it runs once a text.
measured = measured.asNondeterministic()


def base_failed(stats: str) -> Column:
    words, repeats = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (words < 50) | (100 * repeats > 50 * words)


def _values(stats: str) -> dict[str, Column]:
    """Integer value of each measure; only for documents with words."""
    of = lambda top, low: F.floor(1000 * F.col(f"{stats}.{top}") / F.greatest(F.col(f"{stats}.{low}"), F.lit(1))).cast("long")
    return {"word_length": of("word_chars", "n_words"), "symbols": of("n_symbols", "word_chars"), "dup_lines": of("n_dup_lines", "n_lines"), "repeats": of("n_repeat_words", "n_words")}


def bucket(value: Column) -> Column:
    """The smallest value of the sketch's bucket."""
    width = F.pow(F.lit(2), F.greatest(F.length(F.bin(value)) - 6, F.lit(0))).cast("long")
    return value - value % width


def bucket_end(low: Column) -> Column:
    """The largest value of a sketch's bucket, given its smallest."""
    return low + F.pow(F.lit(2), F.greatest(F.length(F.bin(low)) - 6, F.lit(0))).cast("long") - 1


_SKETCH = ("q1", "q2", "q3", "tail", "n")


def fences(stats: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, <measure>_high, word_length_low) of stats(lang, source, stats), learnt from all documents that pass the base rules."""
    values = _values("stats")
    long = stats.where(~base_failed("stats")).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(v).alias("bucket")) for m, v in values.items()])).alias("x"))
    leaves = checkpointed(long.groupBy("lang", "source", "x.measure", "x.bucket").count())
    own_tail = F.element_at(F.create_map(*[x for m, t in MEASURES.items() for x in (F.lit(m), F.lit(t))]), F.col("measure"))

    def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys, "measure")
        run = sketch.withColumn("upto", F.sum("count").over(w.orderBy("bucket"))).withColumn("n", F.sum("count").over(w))
        at = lambda share: F.min(F.when(1000 * F.col("upto") >= share * F.col("n"), F.col("bucket")))
        found = run.groupBy(*keys, "measure").agg(at(F.lit(250)).alias("q1"), at(F.lit(500)).alias("q2"), at(F.lit(750)).alias("q3"), at(own_tail).alias("t"), at(F.lit(FURTHEST)).alias("furthest"), F.max("n").alias("n"))
        return found.withColumn("tail", F.when(F.col("t") > F.col("q2"), F.col("t")).otherwise(F.col("furthest")))

    merged = lambda keys: leaves.groupBy(*keys, "measure", "bucket").agg(F.sum("count").alias("count"))
    own = quantiles(leaves, ["lang", "source"]).select("lang", "source", "measure", F.struct(*_SKETCH).alias("own"))
    language = quantiles(merged(["lang"]), ["lang"]).select(F.col("lang").alias("l"), F.col("measure").alias("m"), F.struct(*_SKETCH).alias("language"))
    every = quantiles(merged([]), []).select(F.col("measure").alias("e"), F.struct(*_SKETCH).alias("every"))
    # Documents that fail the base rules may have a (lang, source) without a sketch of its own.
    groups = stats.select("lang", "source").distinct().withColumn("measure", F.explode(F.array(*map(F.lit, MEASURES))))
    joined = (
        groups.alias("g")
        .join(own.alias("o"), F.expr("g.lang <=> o.lang AND g.source <=> o.source AND g.measure = o.measure"), "left")
        .select("g.lang", "g.source", "g.measure", "own")
        .join(language, F.expr("lang <=> l AND measure = m"), "left")
        .join(every, F.expr("measure = e"), "left")
    )
    varies = lambda level: (F.col(f"{level}.q3") > F.col(f"{level}.q1")) | (F.col(f"{level}.tail") > F.col(f"{level}.q2"))
    picked = F.when((F.col("own.n") >= least) & varies("own"), F.col("own")).when((F.col("language.n") >= least) & varies("language"), F.col("language")).otherwise(F.col("every"))
    q = lambda name: F.col(f"q.{name}")
    joined = joined.select("lang", "source", "measure", picked.alias("q")).withColumn("reach", 3 * (q("q3") - q("q1")))
    far = bucket_end(q("tail"))
    beyond = far + (far - q("q2"))
    lengths = F.col("measure") == WORD_LENGTH
    level = F.col("reach") > 0
    high = F.when(lengths & level, q("q3") + F.col("reach") + ROOM).when(level, F.greatest(q("q3") + F.col("reach"), beyond)).otherwise(beyond)
    columns = [F.max(F.when(F.col("measure") == m, high)).alias(f"{m}_high") for m in MEASURES]
    columns.append(F.max(F.when(lengths & level, q("q1") - F.col("reach") - ROOM)).alias(f"{WORD_LENGTH}_low"))
    found = checkpointed(joined.groupBy("lang", "source").agg(*columns))
    return F.broadcast(found) if found.count() <= BROADCAST_GROUPS else found


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows(…, lang, source, stats) with base_failed and kept; limits is what fences() gave for the same rows."""
    joined = rows.join(limits.withColumnsRenamed({"lang": "__lang", "source": "__source"}), F.expr("lang <=> __lang AND source <=> __source"), "left")
    fine = F.lit(True)
    for m, value in _values("stats").items():
        fine &= F.coalesce(value <= F.col(f"{m}_high"), F.lit(True))
    fine &= F.coalesce(_values("stats")[WORD_LENGTH] >= F.col(f"{WORD_LENGTH}_low"), F.lit(True))
    return joined.withColumn("base_failed", base_failed("stats")).withColumn("kept", ~F.col("base_failed") & fine)


def quality_rules(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row of docs(doc_id, text, lang, source).

    Null text has no words and fails.  A null lang or source is a value of its
    own.  Repeated rows come out once each; an empty table gives an empty
    result; other columns are ignored.
    """
    stats = checkpointed(select_columns(docs, "doc_id", "lang", "source", "text").select("doc_id", "lang", "source", measured("text").alias("stats")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged(stats, fences(stats, least)).select("doc_id", *[f"stats.{n}" for n in names], "base_failed", "kept")


def only_good(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs without the rows that quality_rules would reject; all columns stay.

    Null and empty texts go, repeated rows stay or go together, an empty table stays empty.
    """
    stats = checkpointed(select_columns(docs, "lang", "source", "text").select("lang", "source", measured("text").alias("stats")))
    limits = fences(stats, least)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "lang", "source", measured("text").alias("stats"))
    return judged(whole, limits).where("kept").select("row.*")
