"""Line dedup that can be taken back.

Each document counts once for each distinct key of its lines (128-bit BLAKE2b
of the stripped, lower-cased line).  The exact reference counts are a table
(key, n).  Keys that reach the threshold are also in cuckoo filters, one for
each hash shard of at most about `SHARD_KEYS` keys and `SHARD_PAIRS` lookups;
filters support insertion and deletion, so adding or removing documents updates
counts and filters without a new pass over the rest, and an index can be saved
and loaded.

Looking up starts where the texts are: all filters together have a counted size,
and in at most `PASSES` groups of at most `FILTER_BYTES` they are sent to all
tasks, which let go of most lines at once.  What a filter lets pass, a small part
of the (text, key) pairs, is joined with the exact counts.  Filters beyond that
size stay in their shards: then the pairs of all texts are dealt to the shards,
where each meets its filter and then the shard's exact keys.  Keys that over 1 in
`HOT_SHARE` of all pairs hold are found in the counts first; there are fewer than
`HOT_SHARE` of them, so they are sent to all tasks and need no looking up, which
leaves no shard or key hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import checkpointed, lean_worker, map_batches, select_columns, text_key, texts

WHITE = b" \t\n\x0b\x0c\r"
SLOTS = 4
SHARD_KEYS = 1 << 16
SHARD_PAIRS = 1 << 17
#: Shards of a small corpus, so that its lookups too are dealt over many tasks.
LEAST_SHARDS = 256
HOT_SHARE = 1024
#: Bytes of filters that all tasks get at once, and how often at most.
FILTER_BYTES = 32 << 20
PASSES = 4
MADE = StructType([StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])


def line_key(line: bytes) -> bytes:
    """The normalised line; empty for a line of white space."""
    return line.strip(WHITE).lower()


def key_hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Buckets of four 16-bit fingerprints.  A key is a 16-byte hash; the filter doubles when an insertion fails."""

    def __init__(self, buckets: int, table: bytes | None = None) -> None:
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(buckets, SLOTS).copy()

    @staticmethod
    def sized(keys: int) -> CuckooFilter:
        buckets = 16
        while buckets * SLOTS * 4 < keys * 5:
            buckets *= 2
        return CuckooFilter(buckets)

    @staticmethod
    def _parts(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and first bucket before the modulus."""
        words = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        return np.maximum(words[:, 1] & np.uint64(0xFFFF), np.uint64(1)), words[:, 1] >> np.uint64(16)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def insert(self, key: bytes) -> bool:
        """False if no place was found; the caller then rebuilds from the exact table."""
        marks, firsts = self._parts([key])
        mark, bucket = int(marks[0]), int(firsts[0]) & (self.buckets - 1)
        for at in (bucket, self._other(bucket, mark)):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        for turn in range(500):
            slot = (mark + turn) % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        marks, firsts = self._parts([key])
        mark, bucket = int(marks[0]), int(firsts[0]) & (self.buckets - 1)
        for at in (bucket, self._other(bucket, mark)):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        marks, firsts = self._parts(keys)
        mask = np.uint64(self.buckets - 1)
        first = firsts & mask
        second = (first ^ (marks * np.uint64(0x5BD1E995))) & mask
        marks16 = marks.astype(np.uint16)[:, None]
        return ((self.table[first.astype(np.int64)] == marks16) | (self.table[second.astype(np.int64)] == marks16)).any(axis=1)

    @staticmethod
    def built(keys: list[bytes]) -> CuckooFilter:
        made = CuckooFilter.sized(len(keys))
        while not all(made.insert(k) for k in keys):
            made = CuckooFilter(made.buckets * 2)
        return made


def shard_of(key: bytes, shards: int) -> int:
    return int.from_bytes(key[:4], "little") & (shards - 1)


def _keys(docs: DataFrame) -> DataFrame:
    """(key) for each distinct key of each row of docs(text)."""

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [key_hash(k) for text in texts(batch["text"]) for k in _distinct(text)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["key"])

    return map_batches(select_columns(docs, "text"), made, "key binary")


def _distinct(text: bytes) -> set[bytes]:
    """The keys of a text's lines, but for lines of white space."""
    return {k for k in map(line_key, text.split(b"\n")) if k}


def _batch_keys(batch: pa.RecordBatch) -> tuple[list[int], list[bytes]]:
    """Rows and key hashes of the distinct keys of each text, each text hash once."""
    where, keys, met = [], [], set()
    for i, (text, this) in enumerate(zip(texts(batch["text"]), batch["at"].to_pylist())):
        if this not in met:
            met.add(this)
            mine = [key_hash(k) for k in _distinct(text)]
            keys += mine
            where += [i] * len(mine)
    return where, keys


def _shards_of(keys: list[bytes], shards: int) -> np.ndarray:
    return (np.frombuffer(b"".join(keys), "<u4")[::4] & np.uint32(shards - 1)).astype(np.int32)


def _probed(docs: DataFrame, shards: int, hot, group, first: bool) -> DataFrame:  # noqa: ANN001
    """(at, key, sure) of the pairs that this group's filters let pass, and in the first pass those of hot keys, which are sure."""

    made_filters: dict[int, CuckooFilter] = {}

    def made(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        where, keys = _batch_keys(batch)
        if not keys:
            return None
        known = np.fromiter((k in hot.value for k in keys), bool, len(keys))
        good = known & first
        shard = _shards_of(keys, shards)
        order = np.argsort(shard, kind="stable")
        ends = [0, *(np.flatnonzero(np.diff(shard[order])) + 1), len(keys)]
        for low, high in zip(ends, ends[1:]):
            this = int(shard[order[low]])
            if this in group.value:
                if this not in made_filters:
                    made_filters[this] = CuckooFilter(*group.value[this])
                here = order[low:high]
                good[here] |= made_filters[this].contains([keys[i] for i in here]) & ~known[here]
        kept = np.flatnonzero(good)
        return pa.RecordBatch.from_arrays([batch["at"].take(pa.array(np.array(where, np.int32)[kept])), pa.array([keys[i] for i in kept], pa.binary()), pa.array(known[kept])], ["at", "key", "sure"])

    return map_batches(docs.select("text", text_key().alias("at")), made, "at long, key binary, sure boolean")


def _pairs(docs: DataFrame, shards: int, hot) -> DataFrame:  # noqa: ANN001
    """(shard, at, key) for each distinct key of each text; at is the text's hash.

    Texts that share a hash share what is looked up, which drops no line more:
    a key is dropped everywhere or nowhere; so a batch looks up each hash once.
    Hot keys need no looking up; they go to shards below zero, evenly.
    """

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        where, keys = _batch_keys(batch)
        at = batch["at"].take(pa.array(where, pa.int32()))
        shard = _shards_of(keys, shards)
        if hot.value:
            known = np.fromiter((k in hot.value for k in keys), bool, len(keys))
            shard = np.where(known, -1 - (at.to_numpy(zero_copy_only=False) + np.arange(len(keys)) & 0x3FF), shard).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(shard), at, pa.array(keys, pa.binary())], ["shard", "at", "key"])

    return map_batches(docs.select("text", text_key().alias("at")), made, "shard int, at long, key binary")


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, key) of the pairs whose key is frequent, from rows sorted by (shard, kind).

    Of a shard come its filter (kind 0), its exact keys (1), and then the pairs
    (2), of which just a batch is in memory.
    """
    lean_worker()
    at, held, exact = None, None, set()
    for batch in batches:
        shards, kinds = batch["shard"].to_numpy(), batch["kind"].to_numpy()
        ends = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1), len(shards)]
        good = np.zeros(len(shards), bool)
        for low, high in zip(ends, ends[1:]):
            if low == high:
                continue
            if shards[low] != at:
                at, held, exact = shards[low], None, set()
            if kinds[low] == 0:
                held = CuckooFilter(batch["buckets"][low].as_py(), batch["cells"][low].as_py())
            elif kinds[low] == 1:
                exact.update(batch["key"].slice(low, high - low).to_pylist())
            elif at < 0:
                good[low:high] = True
            elif held is not None:
                keys = batch["key"].slice(low, high - low).to_pylist()
                good[low:high] = [passed and k in exact for passed, k in zip(held.contains(keys), keys)]
        if good.any():
            yield pa.RecordBatch.from_arrays([batch["at"].filter(pa.array(good)), batch["key"].filter(pa.array(good))], ["at", "key"])


def _shard_column(shards: int):  # noqa: ANN202
    """shard_of, on a binary column."""
    word = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")
    swapped = F.shiftleft(word.bitwiseAND(F.lit(0xFF)), 24) + F.shiftleft(word.bitwiseAND(F.lit(0xFF00)), 8) + F.shiftright(word.bitwiseAND(F.lit(0xFF0000)), 8) + F.shiftright(word, 24)
    return swapped.bitwiseAND(F.lit(shards - 1)).cast("int").alias("shard")


FILTER_SCHEMA = "shard int, buckets int, cells binary"


def _built(group: pd.DataFrame) -> pd.DataFrame:
    made = CuckooFilter.built([bytes(x) for x in group["key"]])
    return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "buckets": [made.buckets], "cells": [made.table.tobytes()]})


@dataclass
class LineIndex:
    """counts(key, n): documents that hold a line of this key.  filters: the cuckoo filter of each shard of frequent keys."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    least_documents: int

    @staticmethod
    def of(docs: DataFrame, least_documents: int = 10) -> LineIndex:
        """The index of these documents: every row counts, also one that repeats an id or is null; an empty table gives an empty index."""
        counts = checkpointed(_keys(docs).groupBy("key").agg(F.count(F.lit(1)).alias("n")))
        return LineIndex._with_filters(counts, least_documents)

    @staticmethod
    def _shards(counts: DataFrame, least_documents: int) -> int:
        """How many shards the counts need, a power of two."""
        frequent, pairs = counts.agg(F.count_if(F.col("n") >= least_documents), F.sum("n")).first()
        shards = LEAST_SHARDS
        while shards * SHARD_KEYS < frequent or shards * SHARD_PAIRS < (pairs or 0):
            shards *= 2
        return shards

    @staticmethod
    def _with_filters(counts: DataFrame, least_documents: int) -> LineIndex:
        shards = LineIndex._shards(counts, least_documents)
        frequent = counts.where(F.col("n") >= least_documents)
        filters = checkpointed(frequent.select("key", _shard_column(shards)).groupBy("shard").applyInPandas(_built, FILTER_SCHEMA))
        return LineIndex(counts, filters, shards, least_documents)

    def save(self, path: str) -> None:
        """Writes the index as tables below path, which must not hold one; load() gives it back in any later session."""
        spark = self.counts.sparkSession
        self.counts.write.parquet(f"{path}/counts")
        self.filters.write.parquet(f"{path}/filters")
        spark.createDataFrame([(self.shards, self.least_documents)], "shards int, least_documents int").coalesce(1).write.parquet(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LineIndex:
        settings = spark.read.parquet(f"{path}/settings").first()
        return LineIndex(spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/filters"), settings["shards"], settings["least_documents"])

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n") >= self.least_documents).select("key")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with these documents, which count as in of()."""
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without these documents, which must have been inserted before."""
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        delta = _keys(docs).groupBy("key").agg((F.count(F.lit(1)) * sign).alias("d"))
        # Both sides have one row a key at most.
        merged = checkpointed(self.counts.join(delta, "key", "full_outer").select("key", F.coalesce("n", F.lit(0)).alias("was"), (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n")))
        counts = merged.where("n > 0").select("key", "n")
        k = self.least_documents
        crossed = merged.where((F.col("was") >= k) != (F.col("n") >= k)).select("key", (F.col("n") >= k).alias("up"), _shard_column(self.shards))
        shards = self.shards
        if LineIndex._shards(counts, k) > 2 * shards:
            return LineIndex._with_filters(counts, k)

        def changed(held: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
            shard = int((held if len(held) else changes)["shard"].iloc[0])
            made = CuckooFilter(int(held["buckets"].iloc[0]), held["cells"].iloc[0]) if len(held) else CuckooFilter.sized(len(changes))
            full = False
            for key, up in sorted(zip(map(bytes, changes["key"]), changes["up"]), key=lambda x: x[1]):
                if not up:
                    made.delete(key)
                elif not made.insert(key):
                    full = True
            return pd.DataFrame({"shard": [shard], "buckets": [0 if full else made.buckets], "cells": [made.table.tobytes()]})

        filters = checkpointed(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(changed, FILTER_SCHEMA))
        if filters.where("buckets = 0").limit(1).count():
            return LineIndex._with_filters(counts, k)
        return LineIndex(counts, filters, shards, k)

    def _hot(self):  # noqa: ANN202
        """A broadcast of the frequent keys that over 1 in HOT_SHARE of all pairs hold: fewer than HOT_SHARE keys of 16 bytes."""
        pairs = self.counts.agg(F.sum("n")).first()[0] or 0
        rows = self.frequent_counts().where(F.col("n") * HOT_SHARE > pairs).select("key").collect()
        return self.counts.sparkSession.sparkContext.broadcast(frozenset(bytes(r["key"]) for r in rows))

    def frequent_counts(self) -> DataFrame:
        return self.counts.where(F.col("n") >= self.least_documents)

    def drops(self, docs: DataFrame) -> DataFrame:
        """(at, drops): the frequent keys among the lines of texts with hash at, exactly; texts without any have no row."""
        total = self.filters.agg(F.sum(F.length("cells"))).first()[0] or 0
        passes, hot = max(1, -(-total // FILTER_BYTES)), self._hot()
        found = self._near(docs, hot, passes) if passes <= PASSES else self._dealt(docs, hot)
        return found.groupBy("at").agg(F.collect_set("key").alias("drops"))

    def _near(self, docs: DataFrame, hot, passes: int) -> DataFrame:  # noqa: ANN001
        """(at, key) by filters that come to the texts."""
        context, rows = docs.sparkSession.sparkContext, None
        for turn in range(passes):
            own = self.filters.where(F.pmod("shard", F.lit(passes)) == turn).collect()
            group = context.broadcast({r["shard"]: (r["buckets"], bytes(r["cells"])) for r in own})
            part = _probed(docs, self.shards, hot, group, turn == 0)
            rows = part if rows is None else rows.unionByName(part)
        # Written, for both ways read it and texts are read once.
        rows = checkpointed(rows)
        return rows.where("sure").select("at", "key").unionByName(rows.where("NOT sure").select("at", "key").join(self.frequent(), "key", "left_semi").select("at", "key"))

    def _dealt(self, docs: DataFrame, hot) -> DataFrame:  # noqa: ANN001
        """(at, key) by pairs that go to the filters' shards."""
        columns = ("shard", "kind", "at", "key", "buckets", "cells")
        nothing = {"at": "long", "key": "binary", "buckets": "int", "cells": "binary"}

        def shaped(rows: DataFrame, kind: int) -> DataFrame:
            lacking = {c: F.lit(None).cast(t) for c, t in nothing.items() if c not in rows.columns}
            return rows.withColumns(lacking | {"kind": F.lit(kind)}).select(*columns)

        exact = self.frequent().select("key", _shard_column(self.shards))
        rows = shaped(self.filters, 0).unionByName(shaped(exact, 1)).unionByName(shaped(_pairs(docs, self.shards, hot), 2))
        return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_looked_up, "at long, key binary")


def _kept(text: bytes, drops: set[bytes]) -> tuple[bytes, int, int]:
    """Kept text, lines before, lines dropped."""
    lines = text.split(b"\n")
    if not drops:
        return text, len(lines), 0
    kept = [x for x in lines if not (k := line_key(x)) or key_hash(k) not in drops]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _cleaned(docs: DataFrame, index: LineIndex) -> DataFrame:
    """(row, made): each row of docs as a struct, with the text that is kept, n_lines and n_dropped."""
    drops = index.drops(docs).withColumnRenamed("at", "drop_at")

    @F.arrow_udf(MADE)
    def made(text: pa.Array, gone: pa.Array) -> pa.Array:
        lean_worker()
        rows = [_kept(t, set(g.as_py() or ())) for t, g in zip(texts(text), gone)]
        kept = pa.array([r[0] for r in rows], pa.binary()).cast(pa.string())
        return pa.StructArray.from_arrays([kept, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["text", "n_lines", "n_dropped"])

    # Rows are one struct, so that no column of docs can clash with another.  The
    # join is null-safe so that it has shuffles of its own, whose hot texts adaptive execution splits.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key().alias("at"))
    joined = rows.join(drops, F.col("at").eqNullSafe(F.col("drop_at")), "left").withColumn("text", F.coalesce("row.text", F.lit("")))
    # Texts that lose nothing stay out of Python.
    whole = F.struct("text", (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    joined = joined.withColumn("made", made(F.when(F.col("drops").isNotNull(), F.col("text")), F.col("drops")))
    return joined.select("row", F.when(F.col("drops").isNull(), whole).otherwise(F.col("made")).alias("made"))


def clean_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """docs with text replaced by what is kept; all other columns stay.

    A null text stays null (one empty line); a document that loses every line
    has an empty text.  Each row, also one that repeats an id or has none, is
    cleaned by itself; an empty table stays empty.
    """
    text = F.when(F.col("row.text").isNotNull(), F.col("made.text")).alias("text")
    return _cleaned(docs, index).select(*[text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def line_dedup(docs: DataFrame, least_documents: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what is kept; null counts as empty) for each row of docs(doc_id, text), by an index of these very rows.

    Every row is a document of its own, also one that repeats an id or is null.
    An empty table gives an empty result; other columns are ignored.
    """
    docs = select_columns(docs, "doc_id", "text")
    return _cleaned(docs, LineIndex.of(docs, least_documents)).select("row.doc_id", "made.n_lines", "made.n_dropped", "made.text")
