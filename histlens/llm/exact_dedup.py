"""Exact dedup by Patricia tries.

Texts are dealt to partitions by length class (the power of two below their
size) and a short content hash, so a partition holds many different texts.
There their full byte strings go into one compressed radix trie, whose terminal
nodes keep the smallest identifier and the number of copies: strings that share
beginnings share branches, and equal ones meet in a terminal.

Memory: tasks fold their own copies before anything is shuffled, so a text that
a third of all rows share leaves a task a few times, not once a row.  A trie
that holds over `SPILL_BYTES` spills its largest subtrees: their terminals leave
as rows of (digest, smallest identifier, copies), and the trie goes on without
them.  Rows that a later copy adds for such a text are merged by a last
aggregate, as are those of partitions that a retry computes again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean_worker, map_batches, select_columns, texts

WHITE = b" \t\n\x0b\x0c\r"
#: Values of the short content hash; with the length classes they make the partitions.
SHORT = 1 << 10
#: Bytes of text that a trie may hold, and that a task may hold back to fold copies.
SPILL_BYTES = 48 << 20
FOLD_BYTES = 24 << 20


def normalised(text: bytes) -> bytes:
    """Each run of space, tab, line feed, vertical tab, form feed and return becomes one space."""
    inner = b" ".join(text.split())
    if not inner:
        return b" " if text else b""
    return (b" " if text[0] in WHITE else b"") + inner + (b" " if text[-1] in WHITE else b"")


class RadixTrie:
    """A compressed radix trie over bytes.  A terminal holds [smallest id or None, copies]; size is the bytes of all labels."""

    __slots__ = ("root", "size")

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]  # label, children by first byte, terminal
        self.size = 0

    def insert(self, key: bytes, identifier: int | None, copies: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, [identifier, copies]]
                self.size += len(key) - at
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, key, at)
            upper = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = upper
            node, at = upper, at + same
        if node[2] is None:
            node[2] = [identifier, copies]
        else:
            held = node[2]
            held[0] = identifier if held[0] is None else held[0] if identifier is None else min(held[0], identifier)
            held[1] += copies

    def terminals(self) -> Iterator[tuple[bytes, int | None, int]]:
        """(string, smallest id, copies) of every terminal."""
        yield from _under(self.root, b"")

    def spill(self, most: int) -> Iterator[tuple[bytes, int | None, int]]:
        """Takes out largest subtrees until the labels that stay are at most `most` bytes; gives their terminals."""
        node, path = self.root, b""
        # Walk down while one child holds nearly all: what is above it is shared and stays.
        while True:
            sizes = {first: _size(child) for first, child in node[1].items()}
            if len(sizes) != 1:
                break
            node = next(iter(node[1].values()))
            path += node[0]
        for first in sorted(sizes, key=sizes.__getitem__, reverse=True):
            if self.size <= most:
                break
            yield from _under(node[1].pop(first), path)
            self.size -= sizes[first]


def _size(node: list) -> int:
    total, waiting = 0, [node]
    while waiting:
        label, children, _ = waiting.pop()
        total += len(label)
        waiting.extend(children.values())
    return total


def _under(node: list, path: bytes) -> Iterator[tuple[bytes, int | None, int]]:
    """Terminals of a subtree below path."""
    waiting = [(node, path)]
    while waiting:
        node, path = waiting.pop()
        path += node[0]
        if node[2] is not None:
            yield path, *node[2]
        waiting.extend((child, path) for child in node[1].values())


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of label and key[at:], by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[:middle] == key[at : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes, hashes = [], []
    for text in texts(batch["text"]):
        text = normalised(text)
        sizes.append(len(text))
        hashes.append(hashlib.sha256(text).digest())
    return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary())], ["doc_id", "size", "hash"])


def _partition(text: bytes, short: int) -> int:
    """Length class and short content hash, as one number."""
    return len(text).bit_length() * short + zlib.crc32(text) % short


def _folded(batches: Iterator[pa.RecordBatch], short: int, fold_bytes: int) -> Iterator[pa.RecordBatch]:
    """A row for each distinct text of what a task holds back at a time; texts met again stay held to the end, while they are few."""
    lean_worker()
    held: dict[bytes, list] = {}  # text: [smallest id, copies since it last left]
    size = 0

    def made(leaving: list[tuple[bytes, list]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([_partition(t, short) for t, _ in leaving], pa.int64()), pa.array([t for t, _ in leaving], pa.binary()), pa.array([x[0] for _, x in leaving], pa.int64()), pa.array([x[1] for _, x in leaving], pa.int64())],
            ["part", "body", "smallest", "copies"],
        )

    for batch in batches:
        for identifier, text in zip(batch["doc_id"], texts(batch["text"])):
            text, identifier = normalised(text), identifier.as_py()
            mine = held.get(text)
            if mine is None:
                held[text] = [identifier, 1]
                size += len(text) + 100
            else:
                if mine[0] is None or identifier is not None and identifier < mine[0]:
                    mine[0] = identifier
                mine[1] += 1
            if size > fold_bytes:
                again = {t: x for t, x in held.items() if x[1] > 1}
                staying = again if sum(map(len, again)) <= fold_bytes // 2 else {}
                yield made([(t, x) for t, x in held.items() if t not in staying])
                held, size = staying, sum(len(t) + 100 for t in staying)
    if held:
        yield made(list(held.items()))


def _owners(batches: Iterator[pa.RecordBatch], spill_bytes: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by partition: a row for each terminal, also of subtrees that were spilled on the way."""
    lean_worker()
    at, trie, out = None, RadixTrie(), []

    def rows() -> Iterator[pa.RecordBatch]:
        if out:
            sizes, hashes, ids, copies = zip(*out)
            out.clear()
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(ids, pa.int64()), pa.array(copies, pa.int64())], ["size", "hash", "keep_id", "group_size"])

    for batch in batches:
        for part, body, smallest, copies in zip(batch["part"].to_pylist(), batch["body"], batch["smallest"].to_pylist(), batch["copies"].to_pylist()):
            if part != at:
                out += map(_digest, trie.terminals())
                at, trie = part, RadixTrie()
            trie.insert(body.as_py(), smallest, copies)
            if trie.size > spill_bytes:
                out += map(_digest, trie.spill(spill_bytes // 2))
        yield from rows()
    out += map(_digest, trie.terminals())
    yield from rows()


def _digest(terminal: tuple[bytes, int | None, int]) -> tuple[int, bytes, int | None, int]:
    text, identifier, copies = terminal
    return len(text), hashlib.sha256(text).digest(), identifier, copies


def exact_dedup(docs: DataFrame, short: int = SHORT, spill_bytes: int = SPILL_BYTES, fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text).

    Null text is empty text.  keep_id is the smallest doc_id among equal texts;
    null ids lose to any other, and keep_id is null if there is no other.  Just
    one row of a group is kept, also when a row is repeated with its id.  An
    empty table gives an empty result; other columns of docs are ignored.  Rows
    find their text's terminal by the text's length and SHA-256 digest.
    """
    rows = select_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    digests = map_batches(rows, _digests, "doc_id long, size long, hash binary")
    folded = rows.mapInArrow(lambda batches: _folded(batches, short, fold_bytes), "part long, body binary, smallest long, copies long")
    ends = folded.repartition("part").sortWithinPartitions("part").mapInArrow(lambda batches: _owners(batches, spill_bytes), "size long, hash binary, keep_id long, group_size long")
    # Merged by digest alone, so that the join on both columns has a shuffle of its own, whose hot groups adaptive execution splits.
    owners = ends.groupBy("hash").agg(F.max("size").alias("size"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    # A repeated id must be kept once only.
    turn = Window.partitionBy("hash", "doc_id").orderBy("size")
    return (
        digests.withColumn("turn", F.row_number().over(turn))
        .join(owners, ["size", "hash"])
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"), F.lower(F.hex("hash")).alias("text_sha256"))
    )
