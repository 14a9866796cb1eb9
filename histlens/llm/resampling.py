"""Importance resampling towards a target: the documents whose features the target has more often are drawn.

Features are runs of 1 to `longest` consecutive words, in buckets by CRC32.  Each
task walks its texts through a trie of words: a node stands for the run of words
on its path and keeps its count and the CRC state from which its children's
follow, so a run is hashed once for all its occurrences.  Counts leave a task as
bucket totals, which Spark adds up; there are as many as buckets.  The second
walk goes through tries whose nodes carry their bucket's gain.  A trie that has
grown to NODES nodes is given up and started again, its counts kept as totals.

The draw is without replacement: a Gumbel deviate, from a hash of the id, is added
to a document's weight, and the highest scores are drawn by their position in a
range sort of all documents.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .common import checkpointed, lean_worker, select_columns, texts

#: Nodes of a task's trie, at most; about 200 bytes each.
NODES = 200_000
#: Words that are walked at once.
STRETCH = 100_000
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Fixed by what a score is: hash values are eight hex digits.
HASHES = 4294967296


def words(text: bytes) -> list[bytes]:
    """Runs of characters other than ASCII ones that are no letters or digits, A-Z lower-cased."""
    return text.translate(_LETTERS).split()


class Node(dict):
    """A run of words; its items are the runs one word longer."""

    __slots__ = ("count", "crc", "gain", "trie")

    def __init__(self, trie: Trie, crc: int, gain: int) -> None:
        self.trie, self.crc, self.gain, self.count = trie, crc, gain, 0

    def __missing__(self, word: bytes) -> Node:
        trie = self.trie
        crc = zlib.crc32(word) if self is trie.root else zlib.crc32(word, zlib.crc32(b" ", self.crc))
        node = self[word] = Node(trie, crc, trie.gains[crc % trie.buckets] if trie.gains else 0)
        trie.nodes.append(node)
        return node


class Trie:
    """Words of one task's texts; gains is a list by bucket, or None while counting."""

    def __init__(self, longest: int, buckets: int, gains: list[int] | None = None) -> None:
        self.longest, self.buckets, self.gains = longest, buckets, gains
        self.totals = np.zeros(buckets, np.int64)
        self._renew()

    def _renew(self) -> None:
        self.nodes: list[Node] = []
        self.root = Node(self, 0, 0)

    def _settle(self) -> None:
        if self.gains is None and self.nodes:
            np.add.at(self.totals, np.array([n.crc % self.buckets for n in self.nodes]), np.array([n.count for n in self.nodes], np.int64))
        # Parents and children hold each other; cut, they go at once.
        for node in self.nodes:
            node.clear()
        self._renew()

    def runs(self, found: list[bytes]) -> Iterator[list[Node]]:
        """The nodes of all runs in these words, a list for each length and stretch of words."""
        for start in range(0, len(found), STRETCH):
            if len(self.nodes) > NODES:
                self._settle()
            # A run starts in the stretch and may end after it.
            part = found[start : start + STRETCH + self.longest - 1]
            here = list(map(self.root.__getitem__, part[:STRETCH]))
            yield here
            for more in range(1, self.longest):
                here = list(map(operator.getitem, here[: len(part) - more], part[more : more + STRETCH]))
                yield here

    def count(self, text: bytes) -> None:
        for nodes in self.runs(words(text)):
            for node in nodes:
                node.count += 1

    def bucket_totals(self) -> np.ndarray:
        self._settle()
        return self.totals

    def score(self, text: bytes) -> tuple[int, int, int]:
        """Words, features and the sum of their gains."""
        found, n, gain = words(text), 0, 0
        for nodes in self.runs(found):
            n += len(nodes)
            gain += sum(map(_gain, nodes))
        return len(found), n, gain


_gain = operator.attrgetter("gain")


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: features of all texts of docs(text) by bucket; null texts have none, buckets without features are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        trie = Trie(longest, buckets)
        for batch in batches:
            for text in texts(batch.column(0)):
                trie.count(text)
        totals = trie.bucket_totals()
        held = np.nonzero(totals)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(totals[held], pa.int64())], ["bucket", "n"])

    return select_columns(docs, "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """The gain of each bucket from bucket_counts of the source and the target: `buckets` numbers, whatever the input."""
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    held = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    whole = held.agg(F.sum("s").alias("whole_s"), F.sum("t").alias("whole_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("whole_s") + buckets) / ((d("s") + 1) * (d("whole_t") + buckets))
    rows = held.join(F.broadcast(whole), F.lit(True)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    return [r["gain"] for r in sorted(rows)]


def deviate(seed: int, doc_id: Column) -> Column:
    """floor of 1000 times a standard Gumbel deviate, fixed by seed and id; a null id counts as an empty one."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / HASHES)))


def weighted(docs: DataFrame, gain: list[int], longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of gains over the features of docs(doc_id, text), 0 without any."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        trie = Trie(longest, len(gain), gain)
        for batch in batches:
            found = [trie.score(text) for text in texts(batch.column(1))]
            columns = [[w for w, _, _ in found], [n for _, n, _ in found], [g // n if n else 0 for _, n, g in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "n_words", "n_features", "weight"])

    return select_columns(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs(doc_id, text); target(text).

    Of the N rows with at least `least_words` words, floor(percent * N / 100) have a
    rank: 1, 2, 3... by falling score, ties to the smaller doc_id (a null one first).
    A null or empty text has no features and weight 0.  Repeated rows are rows of
    their own, scored alike.  An empty target has no counts, an empty table of
    documents gives no rows; other columns are ignored.  A text is held whole, its
    words walked in stretches.
    """
    if not re.fullmatch(r"string|.*int|long", docs.schema["doc_id"].dataType.simpleString()):
        raise ValueError("doc_id must be an integer or a string")
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets), buckets)
    # Written: the range sort reads its rows twice.  `row` tells equal rows apart, so that copies are dealt evenly.
    scored = checkpointed(weighted(docs, gain, longest).withColumn("score", F.col("weight") + deviate(seed, F.col("doc_id"))).withColumn("row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    placed = numbered(scored.where(able), [F.desc("score"), F.col("doc_id").asc_nulls_first(), F.col("row")])
    rank = F.when(F.col("pos") < drawn, F.col("pos") + 1).alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, rank).unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
