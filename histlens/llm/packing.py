"""Best-fit packing by sum of squares.

Documents become pieces of at most `capacity` tokens; only longer documents are
cut, and then the first piece is the shorter one.  Pieces are dealt to shards of
about `SHARD_PIECES` by hash and packed longest first: each goes to the open
sequence whose choice leaves the sum over residual gaps g of N(g) squared, N(g)
being the number of open sequences with gap g, smallest.  A new sequence is
opened only where no open one has room (of the two readings of the rule this
needs fewer sequences when pieces come longest first).  A shard leaves at most
a sequence or so partly filled, whatever the size of the corpus.

Documents that come in an order, as a curriculum's, are dealt by ranges of it
instead, and sequences are numbered by range: all of a range come before all of
the next, and only within a range are pieces rearranged.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, texts
from .tokens import encoder

CAPACITY = 2048
SHARD_PIECES = 16_384
#: Pieces that leave a task together, so that ids are not all widened at once.
_AT_ONCE = 512
#: Part number and number within the part, in the names of files that Spark writes.
_PART = r"^part-(\d+)-.*-c(\d+)\."
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def file_order(docs: DataFrame) -> Column | None:
    """The place of each row in the sorted table that docs was read from, or None if it was not read from files.

    Readers take files up in any order; Spark numbers the parts of a table that it
    writes sorted.  Files of other names, or two of one number (a table that was
    renamed, appended to or put together), have no such order: that raises.
    """
    try:
        files = docs.select(F.col("_metadata.file_name").alias("file"), "_metadata.row_index")
    except AnalysisException:
        return None
    # A sorted part may be split into several files, numbered at the name's end.
    number = F.regexp_extract("file", _PART, 1).try_cast("long").alias("number")
    named = files.select("file").distinct().select(number, F.regexp_extract("file", _PART, 2).try_cast("long").alias("split"))
    odd = named.groupBy("number", "split").agg(F.count(F.lit(1)).alias("n")).where("number IS NULL OR split IS NULL OR n > 1")
    if not odd.isEmpty():
        raise ValueError("these files do not number the parts of one sorted table, so they have no order: carry it as a column")
    place = lambda group: F.regexp_extract("_metadata.file_name", _PART, group).cast("long")
    return F.shiftleft(place(1), 44) + F.shiftleft(place(2), 32) + F.col("_metadata.row_index")


def pieces(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY, order: Column | None = None, keep_ids: bool = False) -> DataFrame:
    """A row of PIECES, position (of order) and ids for each piece of docs(doc_id, text), each document ending with the id `end`.

    ids (little-endian, as wide as the vocabulary needs) are null unless asked for.
    A null or empty text is just the end id, an empty table has no pieces; a text is
    encoded whole; other columns are ignored.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        kind, tail = f"<u{encode.width}", np.array([end], "<u4")
        for batch in batches:
            owner, rows, kept = [], [], []
            for i, text in enumerate(texts(batch["text"])):
                ids = np.concatenate([np.frombuffer(encode.encode(text), kind).astype("<u4"), tail])
                high = (len(ids) - 1) % capacity + 1
                low = 0
                while low < len(ids):
                    owner.append(i)
                    rows.append((low, high - low, zlib.crc32(memoryview(ids[low:high]))))
                    kept.append(ids[low:high].astype(kind).tobytes() if keep_ids else None)
                    low, high = high, high + capacity
            number = [0] * len(owner)
            for k in range(1, len(owner)):
                number[k] = number[k - 1] + 1 if owner[k] == owner[k - 1] else 0
            starts, lengths, sums = zip(*rows) if rows else ((), (), ())
            owner = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(owner), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()), batch["position"].take(owner), pa.array(kept, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "position", "ids"],
            )

    position = F.lit(None).cast("long") if order is None else order.cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", position.alias("position"))
    return rows.mapInArrow(made, f"{PIECES}, position long, ids binary")


def sum_of_squares(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece; lengths are in the order of placing."""
    squares = np.zeros(capacity + 1)  # N(g)
    open_by_gap: dict[int, list[int]] = defaultdict(list)
    sequence, offset, made = [], [], 0
    for length in lengths:
        here = squares[length:]
        if not here.any():
            at, left = made, capacity - length
            made += 1
        else:
            # Moving one sequence from gap g to g - length changes the sum by 2 * (N(g - length) - N(g) + 1); to none, by 1 - 2 * N(g).
            after = squares[: capacity + 1 - length].copy()
            after[0] = -0.5
            left = int(np.where(here > 0, after - here, np.inf).argmin())
            at = open_by_gap[left + length].pop()
            squares[left + length] -= 1
        sequence.append(at)
        offset.append(capacity - left - length)
        if left:
            squares[left] += 1
            open_by_gap[left].append(at)
    return sequence, offset


def _as_lists(ids: pa.Array, lengths: pa.Array) -> pa.Array:
    """Encoded ids as lists of ints; their width follows from the lengths."""
    ends = np.concatenate([[0], np.cumsum(lengths.to_numpy())])
    joined = b"".join(x.as_py() for x in ids)
    values = np.frombuffer(joined, f"<u{len(joined) // int(ends[-1])}").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _packer(capacity: int, keep_ids: bool):  # noqa: ANN202
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def made() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows).combine_chunks()
            sequence, offset = sum_of_squares(table["length"].to_pylist(), capacity)
            first = (at + 1) << 32
            for low in range(0, len(offset), _AT_ONCE):
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                part = table.slice(low, _AT_ONCE)
                columns = [part[c].combine_chunks() for c in names]
                columns += [pa.array([first + x for x in sequence[low : low + _AT_ONCE]], pa.int64()), pa.array(offset[low : low + _AT_ONCE], pa.int64())]
                names += ["sequence_id", "offset"]
                if keep_ids:
                    names, columns = [*names, "ids"], [*columns, _as_lists(part["ids"].combine_chunks(), columns[3])]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            shards = batch["shard"].to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
            for low, high in zip(ends, ends[1:]):
                if low == high:
                    continue
                if shards[low] != at:
                    if rows:
                        yield from made()
                    at, rows = int(shards[low]), []
                rows.append(batch.slice(low, high - low))
        if rows:
            yield from made()

    return packed


def packed(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY, order: Column | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for each piece of docs(doc_id, text).

    With keep_ids a row has the piece's ids, an array of int, so that sequences can
    be put together from the result alone.

    order, if given, is a whole number a row: sequence ids then rise with it
    from range to range.  Null text is empty text, a document of just the end
    id.  A repeated row is a document of its own, so (doc_id, piece) may repeat.
    Ties go by doc_id, piece and checksum, so reruns agree.  An empty table
    gives an empty result; other columns are ignored.
    """
    found = checkpointed(pieces(docs, tokenizer, end, capacity, order, keep_ids))
    shards = int(found.count() // SHARD_PIECES + 1)
    if order is None:
        dealt = found.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard"))
    else:
        dealt = found.repartitionByRange(shards, "position", "doc_id", "piece", "ids_crc32").withColumn("shard", F.spark_partition_id())
    dealt = dealt.sortWithinPartitions("shard", F.col("length").desc(), "doc_id", "piece", "ids_crc32").drop("position")
    if not keep_ids:
        dealt = dealt.drop("ids")
    return dealt.mapInArrow(_packer(capacity, keep_ids), f"{PIECES}, sequence_id long, offset long" + ", ids array<int>" * keep_ids)
