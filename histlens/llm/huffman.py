"""Token-id files: canonical length-limited Huffman codes in independent blocks.

A file set is a folder with two Parquet tables.
codebook: id, n (its count over all documents), length (bits of its code).
    Codes are canonical: by length, then id.
blocks: bucket, block, before (ids of the bucket's documents before the block),
    n (its ids), docs (list of doc_id in ascending order, null first), counts,
    bits (bit offset in payload of each checkpoint: one at each document's
    start and after every EVERY ids of it), payload (each document's codes,
    most significant bit first, padded to whole bytes).
A block decodes alone: all its checkpoints advance together through one table
that maps the next `longest` bits to an id and a length.

Texts are encoded once; ids are staged compressed, counted by the tasks that
made them, coded where they lie, and only coded bytes are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, remove, select_columns, texts, work_path
from .tokens import encoder

EVERY = 512
#: Most bits of a code, unless the vocabulary needs more.
LONGEST = 18
#: Ids that one block or one step of coding holds, or one document if that is longer.
BLOCK_IDS = 1 << 20
#: Ids of a bucket, which is sorted and written by one task.
BUCKET_IDS = 4 << 20
MOST_BUCKETS = 1 << 15


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits for these counts (0: no code), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(len(used) - 1).bit_length() + 1)
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, packed = [], np.zeros(0)
    for _ in range(longest):
        merged = np.concatenate([weights, packed])
        at = np.argsort(merged, kind="stable")
        merged = merged[at]
        levels.append(at < len(weights))
        packed = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, sums = 2 * len(order) - 2, np.zeros(len(order) + 1, np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        sums[0] += 1
        sums[leaves] -= 1
        take = 2 * (take - leaves)
    lengths[order] = np.cumsum(sums[:-1])
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    for x in np.lexsort((np.arange(len(lengths)), lengths)):
        if n := int(lengths[x]):
            code <<= n - last
            codes[x], last = code, n
            code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[int, np.ndarray]:
    """The table's bits, and for each pattern of that many bits id << 5 | length."""
    bits = max(1, int(lengths.max(initial=0)))
    table, at = np.zeros(1 << bits, np.uint32), 0
    for x in np.lexsort((np.arange(len(lengths)), lengths)):
        if n := int(lengths[x]):
            table[at : at + (1 << bits - n)] = x << 5 | n
            at += 1 << bits - n
    return bits, table


def encode_documents(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Of documents of these counts that follow one another in ids: payload, first byte of each (and the end), bit of each id."""
    sizes = lengths[ids].astype(np.int64)
    bits = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.concatenate([[0], np.cumsum(counts)])
    bytes_of = (np.diff(bits[ends]) + 7) // 8
    firsts = np.concatenate([[0], np.cumsum(bytes_of)])
    at = bits[:-1] + np.repeat(8 * firsts[:-1] - bits[ends[:-1]], counts)
    made = np.zeros(int(firsts[-1] + 7) // 8 + 1, np.uint64)
    if len(ids):
        word, left = at >> 6, 64 - (at & 63) - sizes
        code, over = codes[ids], np.flatnonzero(left < 0)
        value = code << np.maximum(left, 0).astype(np.uint64)
        value[over] = code[over] >> (-left[over]).astype(np.uint64)
        # Codes share no bit, so sums are unions.
        starts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        made[word[starts]] = np.add.reduceat(value, starts)
        made[word[over] + 1] += code[over] << (64 + left[over]).astype(np.uint64)
    return made.astype(">u8").tobytes()[: int(firsts[-1])], firsts, at


def decode_block(payload: bytes, counts: np.ndarray, marks: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    """All ids of a block, from its checkpoints' bit offsets."""
    data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    windows = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    pieces = (counts + EVERY - 1) // EVERY
    owner = np.repeat(np.arange(len(counts)), pieces)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    left = np.minimum(counts[owner] - turn * EVERY, EVERY)
    to = (np.cumsum(counts) - counts)[owner] + turn * EVERY
    order = np.argsort(-left, kind="stable")
    left, to, at = left[order], to[order], marks[order].astype(np.int64)
    out = np.zeros(int(counts.sum()), np.uint32)
    # How many segments still run at each step.
    running = len(left) - np.searchsorted(left[::-1], np.arange(1, EVERY + 1), side="left")
    keep, shift = np.uint32((1 << bits) - 1), 32 - bits
    for step in range(int(left[0]) if len(left) else 0):
        n = running[step]
        at, to = at[:n], to[:n]
        found = table[windows[at >> 3] >> (shift - (at & 7)).astype(np.uint32) & keep]
        out[to + step] = found >> np.uint32(5)
        at = at + (found & np.uint32(31))
    return out


def _flat(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a binary column of ids: all ids, without copying, and the first of each row (and the end)."""
    column = binary(column)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    firsts = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[firsts[0] : firsts[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(f"<u{width}"), (firsts - firsts[0]) // width


def _steps(firsts: np.ndarray, most: int = BLOCK_IDS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` ids, or of one row."""
    low, n = 0, len(firsts) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(firsts, firsts[low] + most, side="right")) - 1)
        yield low, high
        low = high


def tokenized(docs: DataFrame, path: str, end: int) -> tuple[DataFrame, int]:
    """(doc_id, ids as little-endian bytes, n, counts) with the end id appended, and the bytes of an id.

    Each task ends with a row without ids, whose counts are (id, count) of all its ids, 64-bit each.
    """
    width = 4 if encoder(path).vocabulary > 1 << 16 or end >= 1 << 16 else 2
    tail = end.to_bytes(width, "little")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        total = np.zeros(max(encode.vocabulary, end + 1), np.int64)
        names = ["doc_id", "ids", "n", "counts"]
        for batch in batches:
            rows = []
            for text in texts(batch["text"]):
                found = encode.encode(text)
                rows.append((np.frombuffer(found, "<u2").astype("<u4").tobytes() if width > encode.width else found) + tail)
            ids = pa.array(rows, pa.binary())
            del rows
            values, firsts = _flat(ids, width)
            for low, high in _steps(firsts):
                total += np.bincount(values[firsts[low] : firsts[high]], minlength=len(total))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], ids, pa.array(np.diff(firsts)), pa.nulls(len(ids), pa.binary())], names)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([0], pa.int64()), pa.array([np.stack([used, total[used]], axis=1).astype("<i8").tobytes()], pa.binary())], names)

    rows = select_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(made, "doc_id long, ids binary, n long, counts binary"), width


def id_counts(staged: DataFrame) -> np.ndarray:
    """Counts of all ids over all tasks; what is collected is bounded by the vocabulary."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch["counts"]:
                found = np.frombuffer(x.as_py(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["id", "n"])

    rows = staged.where("counts IS NOT NULL").select("counts").mapInArrow(each, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids = rows["id"].to_numpy()
    counts = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    counts[ids] = rows["n"].to_numpy()
    return counts


def write_tokens(docs: DataFrame, tokenizer: str, end: int = 1, to: str | None = None) -> str:
    """Encodes docs(doc_id, text) and writes the file set; returns its path.

    Null text is empty text; each document ends with the id `end`.  Documents
    are written in ascending doc_id order, null ids first; rows that share an id
    follow one another, ordered by length and codes, or by hash first if they
    fill several buckets.  Other columns are ignored.
    """
    spark = docs.sparkSession
    to = to or work_path(spark, "tokens")
    rows, width = tokenized(docs, tokenizer, end)
    rows.write.option("compression", "zstd").parquet(f"{to}/staged")
    staged = spark.read.parquet(f"{to}/staged")
    counts = id_counts(staged)
    staged = staged.where("counts IS NULL").select("doc_id", "ids")
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": pa.array(used), "n": pa.array(counts[used]), "length": pa.array(lengths[used].astype(np.int32))})).coalesce(1).write.parquet(f"{to}/codebook")
    buckets = int(min(MOST_BUCKETS, counts.sum() // BUCKET_IDS + 1))
    cuts, (every, nulls) = [], (1, 0)
    if buckets > 1:
        cuts = staged.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 100 * buckets)).first()[0] or []
        every, nulls = staged.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    ranges = Ranges.of(cuts, -(-buckets * nulls // max(every, 1)))
    coded = staged.mapInArrow(_coder(ranges, lengths, width), "bucket int, doc_id long, n long, marks binary, payload binary")
    dealt = coded.repartitionById(ranges.slots, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "n", "payload")
    dealt.mapInArrow(_blocks, BLOCKS).write.option("compression", "none").parquet(f"{to}/blocks")
    remove(spark, f"{to}/staged")
    return to


@dataclass(frozen=True)
class Ranges:
    """Buckets of ascending doc_id, null first; an id that several cuts fall on, or none, has as many buckets of its own."""

    bounds: np.ndarray
    #: Of each bound its first bucket, and the buckets of its own id after that one, 0 if it shares it.
    first: np.ndarray
    own: np.ndarray
    nulls: int
    slots: int

    @staticmethod
    def of(cuts: list[int], nulls: int) -> Ranges:
        bounds, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        own = np.where(times > 1, times, 0)
        first = nulls + np.cumsum(1 + own) - 1 - own
        return Ranges(bounds, first, own, nulls, int(nulls + len(bounds) + own.sum() + 1))

    def bucket(self, owner: pa.Array, payloads: list[bytes]) -> np.ndarray:
        """The bucket of each document; payloads deal out those of a bucket's only id."""
        null = owner.is_null().to_numpy(zero_copy_only=False)
        ids = owner.fill_null(0).to_numpy()
        at = np.searchsorted(self.bounds, ids, side="left")
        found = np.append(self.first, self.slots - 1)[at]
        many = np.append(self.own, 0)[at] * (np.append(self.bounds, 0)[at] == ids)
        many = np.where(null, self.nulls, many)
        found = np.where(null, 0, found + (many > 0))
        for i in np.flatnonzero(many > 1):
            found[i] += zlib.crc32(payloads[i]) % many[i]
        return found


def _coder(ranges: Ranges, lengths: np.ndarray, width: int) -> Callable:
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        for batch in batches:
            ids, bounds_of = _flat(batch["ids"], width)
            for low, high in _steps(bounds_of):
                counts = np.diff(bounds_of[low : high + 1])
                payload, firsts, at = encode_documents(ids[bounds_of[low] : bounds_of[high]], counts, codes, lengths)
                starts = np.cumsum(counts) - counts
                owner = batch["doc_id"][low:high]
                payloads = [payload[a:b] for a, b in zip(firsts[:-1], firsts[1:])]
                marks = [(at[s : s + n : EVERY] - 8 * f).astype("<u8").tobytes() for s, n, f in zip(starts, counts, firsts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ranges.bucket(owner, payloads).astype(np.int32)), owner, pa.array(counts), pa.array(marks, pa.binary()), pa.array(payloads, pa.binary())], ["bucket", "doc_id", "n", "marks", "payload"]
                )

    return coded


BLOCKS = "bucket int, block int, before long, n long, docs array<long>, counts binary, bits binary, payload binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents of a bucket to blocks; before: ids of the bucket's documents before the block."""
    rows: list[tuple] = []
    at, block, before, held = None, 0, 0, 0

    def made() -> pa.RecordBatch:
        _, docs, counts, marks, payloads = zip(*rows)
        firsts = np.cumsum([0, *map(len, payloads)])[:-1]
        bits = b"".join((np.frombuffer(m, "<u8") + np.uint64(8 * f)).tobytes() for m, f in zip(marks, firsts))
        return pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([list(docs)], pa.list_(pa.int64())), pa.array([np.array(counts, "<u8").tobytes()], pa.binary()), pa.array([bits], pa.binary()), pa.array([b"".join(payloads)], pa.binary())],
            ["bucket", "block", "before", "n", "docs", "counts", "bits", "payload"],
        )

    for batch in batches:
        columns = [batch[c] for c in ("bucket", "doc_id", "n", "marks", "payload")]
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in columns)
            if rows and (row[0] != at or held + row[2] > BLOCK_IDS):
                yield made()
                block, before = (block + 1, before + held) if row[0] == at else (0, 0)
                rows, held = [], 0
            at = row[0]
            rows.append(row)
            held += row[2]
    if rows:
        yield made()


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit), decoded from a file set.

    With digest, ids_crc32 (unsigned, of the same bytes) in place of ids.
    """
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"].to_numpy(np.int64)] = book["length"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One number for each bucket, of which there are MOST_BUCKETS at most.
    ends = {r["bucket"]: r["n"] for r in blocks.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    starts, total = {}, 0
    for bucket in sorted(ends):
        starts[bucket] = total
        total += ends[bucket]
    kind = ("ids_crc32", pa.int64(), "long") if digest else ("ids", pa.binary(), "binary")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, table = decoding_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                counts = np.frombuffer(batch["counts"][i].as_py(), "<u8").astype(np.int64)
                ids = decode_block(batch["payload"][i].as_py(), counts, np.frombuffer(batch["bits"][i].as_py(), "<u8"), bits, table).astype("<u4")
                ends_of = np.cumsum(counts)
                parts = [memoryview(ids[e - n : e]) for e, n in zip(ends_of, counts)]
                start = starts[batch["bucket"][i].as_py()] + batch["before"][i].as_py() + ends_of - counts
                yield pa.RecordBatch.from_arrays([batch["docs"][i].values, pa.array(start), pa.array(counts), pa.array([zlib.crc32(p) for p in parts] if digest else [p.tobytes() for p in parts], kind[1])], ["doc_id", "start", "n_tokens", kind[0]])

    return blocks.select("bucket", "before", "docs", "counts", "bits", "payload").mapInArrow(decoded, f"doc_id long, start long, n_tokens long, {kind[0]} {kind[2]}")
