"""Shards of near equal bytes: contiguous cuts of the documents' order at equal targets of the bytes before them.

Documents are in order of doc_id, copies of a text with the first of them.  They
are range-sorted once; each partition's bytes, rows and last group are all that
the others need for the bytes before every row (one row a partition goes to the
driver).  A row goes to the shard in which the middle of its stretch of bytes
lies; a group of equal texts goes as a whole, unless it has more bytes than a
shard's share: such a group fills shards of its own, so that all stay near equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import AT, PART, laid_out
from .common import checkpointed, lean_worker, select_columns

#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Groups with over one in so many rows meet their rows by broadcast; there are fewer than that.
HOT = 1000


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, digest, copies, and the place in the order (first doc_id of the text's group, doc_id)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = select_columns(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"))
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    groups = checkpointed(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    least = rows.count() // HOT
    hot, cold = F.broadcast(groups.where(F.col("copies") > least)), groups.where(F.col("copies") <= least)
    met = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(cold, "digest", "left").withColumns({"first": F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("first")), "copies": F.coalesce("copies", F.lit(1))}))
    order = [F.col("first").asc_nulls_first(), F.col("digest"), F.col("doc_id").asc_nulls_first(), F.col("row")]
    return laid_out(met, order).select("doc_id", "size", "text_crc32", "digest", "copies", PART, AT)


def _totals(rows: DataFrame) -> dict[int, tuple[int, int, str, int]]:
    """By partition: rows and bytes before it, and the group that runs on into it, with the bytes before that group."""
    ends = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max_by("digest", AT).alias("last"), F.min_by("digest", AT).alias("head"))
    runs = rows.join(F.broadcast(ends.select(F.col(PART).alias("of"), "last")), (F.col(PART) == F.col("of")) & (F.col("digest") == F.col("last"))).groupBy(PART).agg(F.sum("size").alias("run"))
    found, n, size, last, start = {}, 0, 0, "", 0
    for r in ends.join(runs, PART).orderBy(PART).collect():
        found[r[PART]] = (n, size, last, start)
        n, size = n + r["n"], size + r["bytes"]
        if not r["head"] == r["last"] == last:
            last, start = r["last"], size - r["run"]
    found[-1] = (n, size, last, start)
    return found


def balanced(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1), slot (from 0 without gaps) of each row of docs(doc_id, text).

    size is the text's UTF-8 bytes plus OVERHEAD; a null text has none and is a copy
    of the empty one.  Null ids come first.  Repeated rows are copies of a text.
    A shard's bytes differ from the equal share by less than one group or long text
    at each end.  With fewer documents than shards some shards are empty; an empty
    table gives no rows.  Other columns are ignored.
    """
    rows = _in_order(docs)
    totals = _totals(rows)
    whole = totals[-1][1]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if part != batch.column(PART)[0].as_py():
                part = batch.column(PART)[0].as_py()
                n, before, last, start = totals[part]
            size = batch.column("size").to_numpy()
            digest = batch.column("digest").to_numpy(zero_copy_only=False)
            starts = before + np.cumsum(size) - size
            fresh = np.concatenate([[digest[0] != last], digest[1:] != digest[:-1]])
            # Where a row's group starts: at the last row before it that began one.
            group = np.maximum.accumulate(np.where(fresh, starts, start))
            together = size * batch.column("copies").to_numpy()
            kept = together * shards <= whole
            twice = np.where(kept, 2 * group + together, 2 * starts + size)
            shard = np.array([min(int(x) * shards // (2 * whole), shards - 1) for x in twice], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array(shard), pa.array(n + np.arange(len(size)))], ["doc_id", "size", "text_crc32", "shard", "place"])
            n, before, last, start = n + len(size), before + int(size.sum()), digest[-1], int(group[-1])

    # One partition's rows are one task's, in order, as they were written.
    placed = rows.mapInArrow(run, f"doc_id {kind}, size long, text_crc32 long, shard int, place long")
    # One row a shard.
    firsts = placed.groupBy("shard").agg(F.min("place").alias("from"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("from")).alias("slot"))
