"""SimHash near-dedup with BK-trees.

A fingerprint bit is set if it is set in over half of the 64-bit shingle
hashes.  Two fingerprints that differ in at most `RADIUS` = 3 of 64 bits agree
in at least two of five blocks, so distinct fingerprints are dealt to ten
shards, each a mask of two blocks and the bits under it.  A shard of over
`DENSE` fingerprints is dealt once more, by each quarter of the bits not yet
under its mask (three differing bits leave one quarter equal), and so on; as
masks grow a shard can hold ever fewer distinct fingerprints, so this ends.

Each shard becomes a BK-tree, children keyed by their integer Hamming distance
to the parent, and a search follows only edges within the radius of the
distance at hand.  The trees' bytes are counted, and they are broadcast in as many
rounds as keep each near `BROADCAST_BYTES`; every task probes each round's trees
with its fingerprints.  Beyond `ROUNDS` rounds the trees are searched in the tasks
that hold them, for just their own members.  All ways find the same links.

Of the smaller neighbours that a fingerprint finds it links to one of each
cluster that is near to itself, never to all: what it leaves out is linked
already, as that pair is searched by its own larger member.  Components come
from alternating star contraction over the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, select_columns, texts

SEED = 42
RADIUS = 3
#: First bit and width of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIRS = [(a, b) for a in range(5) for b in range(a)]
DENSE = 2048
#: Bytes of trees that all tasks get at once, and in how many rounds at most.
BROADCAST_BYTES = 32 << 20
ROUNDS = 16
#: Edges that a part of a round's table has, about, and how many parts there are at least.
EDGES, PARTS = 100_000, 16
_ALL = (1 << 64) - 1
_SLICE = 1 << 15


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of a whole text, repeats included, some at a time; of fewer words there is one shingle, of none none."""
    parts = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters only
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if 0 < len(parts) <= words:
        yield np.array([digest(join(parts), SEED)], "<u8")
        return
    for low in range(0, len(parts) - words + 1, _SLICE):
        yield np.array([digest(join(x), SEED) for x in zip(*(parts[low + k : min(len(parts) - words + 1, low + _SLICE) + k] for k in range(words)))], "<u8")


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 bits, lowest first, for each hash."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def majority(hashes: list[np.ndarray]) -> int:
    """The bits that are set in over half of all hashes; 0 without any."""
    if not hashes:
        return 0
    totals = sum(set_bits(h).sum(axis=0, dtype=np.int64) for h in hashes)
    return int.from_bytes(np.packbits(2 * totals > sum(map(len, hashes)), bitorder="little").tobytes(), "little")


def simhash(text: bytes, words: int = 3) -> int:
    """The fingerprint of a whole text; 0 without any word."""
    return majority(list(shingle_hashes(text, words)))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp."""

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([signed(simhash(x, words)) for x in texts(batch["text"])], pa.int64())], ["doc_id", "fp"])

    rows = select_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_batches(rows, made, "doc_id long, fp long")


def _first_masks() -> list[int]:
    """Ten masks, each of two blocks."""
    blocks = [((1 << width) - 1) << first for first, width in BLOCKS]
    return [blocks[a] | blocks[b] for a, b in PAIRS]


def _finer(mask: int) -> list[int]:
    """The mask with each of four runs of the bits that it lacks."""
    rest = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(len(rest) * k / 4) for k in range(5)]
    return [mask | sum(1 << b for b in rest[low:high]) for low, high in zip(cuts, cuts[1:])]


def _under(masks: list[int]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for m in masks]))


def build_tree(members: list[int]) -> tuple[list[int], list[int]]:
    """Parent's place and edge of each member; the first is the root."""
    children: list[dict[int, int]] = [{} for _ in members]
    parents, edges = [0], [0]
    for new in range(1, len(members)):
        value, node = members[new], 0
        while True:
            distance = (members[node] ^ value).bit_count()
            following = children[node].get(distance)
            if following is None:
                children[node][distance] = new
                parents.append(node)
                edges.append(distance)
                break
            node = following
    return parents, edges


class Tree:
    """A BK-tree, from members and what build_tree gives for them."""

    def __init__(self, members: list[int], parents: list[int], edges: list[int]) -> None:
        self.members = members
        self.children: list[dict[int, int]] = [{} for _ in members]
        for child in range(1, len(members)):
            self.children[parents[child]][edges[child]] = child

    @staticmethod
    def read(data: bytes) -> Tree:
        n = len(data) // 11
        return Tree(np.frombuffer(data, "<u8", n).tolist(), np.frombuffer(data, "<u2", n, 8 * n).tolist(), np.frombuffer(data, "u1", n, 10 * n).tolist())

    @staticmethod
    def written(members: list[int]) -> bytes:
        parents, edges = build_tree(members)
        return np.array(members, "<u8").tobytes() + np.array(parents, "<u2").tobytes() + np.array(edges, "u1").tobytes()

    def near(self, value: int, radius: int) -> list[int]:
        """Members within the radius: only edges within the radius of a node's distance can lead to one."""
        found, waiting = [], [0]
        while waiting:
            node = waiting.pop()
            distance = (self.members[node] ^ value).bit_count()
            if distance <= radius:
                found.append(self.members[node])
            edges = self.children[node]
            if len(edges) > 2 * radius:
                for edge in range(distance - radius, distance + radius + 1):
                    if edge in edges:
                        waiting.append(edges[edge])
            else:
                waiting.extend(child for edge, child in edges.items() if abs(edge - distance) <= radius)
        return found

    def links(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(value, a smaller member near it), one for each cluster of those."""
        kept: list[int] = []
        for member in sorted(self.near(value, radius)):
            if member < value and all((member ^ k).bit_count() > radius for k in kept):
                kept.append(member)
        return [(value, k) for k in kept]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (mask, bits, fp) a tree for each shard; one shard is in memory at a time."""
    at, members = None, []
    out: list[tuple[int, int, bytes]] = []

    def made() -> pa.RecordBatch:
        masks, bits, trees = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(masks, pa.int64()), pa.array(bits, pa.int64()), pa.array(trees, pa.binary())], ["mask", "bits", "tree"])

    for batch in batches:
        masks, bits, fps = (batch[c].to_numpy(zero_copy_only=False) for c in ("mask", "bits", "fp"))
        ends = np.flatnonzero((np.diff(masks) != 0) | (np.diff(bits) != 0)) + 1
        for low, high in zip([0, *ends], [*ends, len(masks)]):
            if low == high:
                continue
            here = (int(masks[low]), int(bits[low]))
            if here != at:
                if at is not None:
                    out.append((*at, Tree.written(members)))
                at, members = here, []
            members += fps[low:high].view("<u8").tolist()
        if out:
            yield made()
    if at is not None:
        out.append((*at, Tree.written(members)))
        yield made()


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, "<u8").view("<i8")) for x in (a, b)], ["a", "b"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each tree's members, where the tree is."""
    for batch in batches:
        trees = (Tree.read(t.as_py()) for t in batch["tree"])
        found = [link for tree in trees for value in tree.members for link in tree.links(value, RADIUS)]
        if found:
            yield _links(found)


def _probe(sent):  # noqa: ANN001, ANN202
    """Links of any fingerprints with the members of the trees of a broadcast (mask: (sorted bits, ends of trees, all trees' bytes))."""

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy(zero_copy_only=False)
            found: list[tuple[int, int]] = []
            for mask, (bits, ends, data) in sent.value.items():
                own = fps & np.int64(mask)
                place = np.minimum(np.searchsorted(bits, own), len(bits) - 1)
                mine = np.flatnonzero(bits[place] == own)
                mine = mine[np.argsort(place[mine], kind="stable")]
                at, tree = -1, None
                for i, k in zip(fps[mine].view("<u8").tolist(), place[mine].tolist()):
                    if k != at:
                        at, tree = k, Tree.read(data[ends[k - 1] if k else 0 : ends[k]])
                    found += tree.links(i, RADIUS)
            if found:
                yield _links(found)

    return probed


def _broadcast(trees: DataFrame):  # noqa: ANN202
    """The trees by mask; the caller has counted their bytes."""
    table = trees.toArrow().combine_chunks().sort_by([("mask", "ascending"), ("bits", "ascending")])
    held = {}
    masks = table["mask"].to_numpy()
    ends = [0, *(np.flatnonzero(np.diff(masks)) + 1), len(masks)]
    for low, high in zip(ends, ends[1:]):
        if low < high:
            part = table.slice(low, high - low)
            data = part["tree"].to_pylist()
            held[int(masks[low])] = (part["bits"].to_numpy(), np.cumsum([len(t) for t in data]), b"".join(data))
    return trees.sparkSession.sparkContext.broadcast(held)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints of fps(fp) at RADIUS or fewer differing bits."""
    spark = fps.sparkSession
    masks, plain = _first_masks(), None
    rows = fps.select("fp", _under(masks).alias("x")).select("fp", "x.*")
    while True:
        counts = checkpointed(rows.groupBy("mask", "bits").count().where("count > 1"))
        fit = rows.join(counts.where(F.col("count") <= DENSE), ["mask", "bits"]).select("fp", "mask", "bits")
        plain = fit if plain is None else plain.unionByName(fit)
        dense = counts.where(F.col("count") > DENSE).select("mask", "bits")
        if dense.isEmpty():
            break
        # At most four times as many masks as before, each with fewer bits to go.
        finer = spark.createDataFrame([(signed(m), signed(f)) for m in masks for f in _finer(m)], "was long, mask long")
        masks = sorted({f for m in masks for f in _finer(m)})
        rows = rows.join(dense, ["mask", "bits"]).select("fp", F.col("mask").alias("was")).join(F.broadcast(finer), "was")
        rows = checkpointed(rows.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits")).distinct())
    trees = checkpointed(plain.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp").mapInArrow(_trees, "mask long, bits long, tree binary"))
    size = trees.agg(F.sum(F.octet_length("tree") + 24)).first()[0] or 0
    # Rounds of even shares, by a hash of the shard, so that each stays near BROADCAST_BYTES.
    rounds = max(1, -(-size // max(1, BROADCAST_BYTES)))
    if rounds > ROUNDS:
        return trees.mapInArrow(_searched, "a long, b long").distinct()
    found, probing = None, fps.select("fp")
    if rounds > 1:
        probing = checkpointed(probing)
    for turn in range(rounds):
        share = trees.where(F.pmod(F.xxhash64("mask", "bits"), F.lit(rounds)) == turn)
        part = probing.mapInArrow(_probe(_broadcast(share)), "a long, b long")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of links(a, b), by alternating star contraction.

    Hubs cost no collected neighbour lists: minima are aggregated map-side and
    the join on a hub is one that adaptive execution can split.  A round's edges
    are written in as few parts as their number asks for.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, parts = now, max(PARTS, -(-now[0] // EDGES))
        edges = edges.coalesce(parts)
        # Large star: every larger neighbour hangs on the smallest of the neighbourhood.
        least = _ends(edges, ("u", "v"), ("v", "u")).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = edges.join(least.withColumnRenamed("u", "of"), F.col("v") == F.col("of")).select("u", F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = checkpointed(_ends(large.join(least, "u"), ("v", "m"), ("u", "m")).where("u <> v").distinct().coalesce(parts))


def _ends(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v): a row for each of these pairs of columns; no union, which would read the rows once for each."""
    return rows.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("end")).select("end.*")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, fp (the number) for every row of docs(doc_id, text).

    Null and wordless texts have fingerprint 0 and link like any other.  A
    component's id is its smallest doc_id; null ids are never smallest, and a
    component of null ids alone has a null id.  Repeated rows come out once
    each.  An empty table gives an empty result; other columns are ignored.
    """
    found = checkpointed(_fingerprints(docs, words))
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(fingerprint_links(distinct))
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = checkpointed(classes)
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")
