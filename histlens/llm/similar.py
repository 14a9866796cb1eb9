"""Near-duplicate classes of texts by the Jaccard similarity of their word shingles, with SimHash as the search.

Texts whose share of common five-word shingles is 0.8 differ in about ten of 64
bits of their fingerprints, which no index of bits finds.  So besides the
fingerprint of the whole text, linked by BK-trees, each text gets fingerprints
of sections: its distinct shingles are dealt by their hash to classes of four to
eight (fewer in short texts), and each of the first `SECTIONS` classes has a
SimHash of its own.  What two texts share falls in the same classes, so of
similar texts some sections are equal, and of others hardly any.  The number of
classes is a power of two; a text near the next one has sections of both, so
that texts similar in size meet.

Candidates are never all pairs: a text meets the smallest and the largest text
of each section, and what its whole fingerprint links it to.  Every candidate is
then checked exactly, on the full sets of shingle hashes; components of the
links that pass are classes.

Sections miss some pairs, so what is left is looked for exactly, by prefixes:
two sets that are similar enough share one of the first n - ceil(0.8 n) + 1
shingles of each, in any order that is one for all.  Rare shingles come first (how
rare, a sample tells; it only decides the order).  Only texts of different classes
that share such a shingle meet: first each with the ends of its shingle, then, of
what is still apart, all with all whose sizes and places in the prefixes allow it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lean_worker, map_batches, select_columns, text_key, texts
from ..shared import written
from .simhash_dedup import connected, fingerprint_links, majority, set_bits, shingle_hashes, signed

SECTIONS = 16
#: Members that one task compares with a text at most.
RUN = 256
#: Texts to compare, at about 40 bytes each, that are found in documents by broadcast; more are joined by key.
BROADCAST_TEXTS = 250_000
#: Texts, and of them the shingles found twice or more, that tell which shingles are frequent, at most.
SAMPLE, FREQUENT = 4000, 200_000
#: Shingles of prefixes that one bucket holds, about.
BUCKET = 1 << 19
#: Texts whose numbers a part of a written table has, about, and how many parts there are at least; tables of few long numbers in many parts are mostly files and tasks.
TEXTS, PARTS = 100_000, 16
# Multipliers of the SplitMix64 generator.
MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)))


def _distinct_hashes(text: bytes, words: int) -> np.ndarray:
    found = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, "<u8")


def section_keys(distinct: np.ndarray, similarity: float) -> np.ndarray:
    """A 64-bit key for each section of a text with these shingle hashes: which class at which level, and its SimHash."""
    n = len(distinct)
    if not n:
        return np.zeros(0, np.int64)
    first, keys = max(2, (n // 4).bit_length() - 1), []
    for level in (first, first + 1) if n >= similarity * (8 << first) else (first,):
        for turn in range(max(1, SECTIONS >> level)):
            # Each turn deals the shingles by other bits of their hashes.
            turned = distinct << np.uint64(13 * turn) | distinct >> np.uint64(64 - 13 * turn) if turn else distinct
            of = turned >> np.uint64(64 - level)
            mine = np.flatnonzero(of < SECTIONS)
            if not len(mine):
                continue
            mine = mine[np.argsort(of[mine], kind="stable")]
            starts = np.r_[0, np.flatnonzero(np.diff(of[mine])) + 1]
            sums = np.add.reduceat(set_bits(distinct[mine]), starts, axis=0, dtype=np.int32)
            marks = np.packbits(2 * sums > np.diff(np.r_[starts, len(mine)])[:, None], axis=1, bitorder="little").view("<u8").ravel()
            # Which section it is goes into the key by the steps of a 64-bit mixer.
            key = marks + (of[mine[starts]] + np.uint64(level << 32 | turn << 16)) * MIX[0]
            for k, shift in ((1, 30), (2, 27)):
                key = (key ^ key >> np.uint64(shift)) * MIX[k]
            keys.append(key ^ key >> np.uint64(31))
    return np.concatenate(keys).view("<i8")


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, ascending, that texts of a sample share, and how many do: a bounded table that orders prefixes, nothing else."""
    rows = select_columns(docs, "text").withColumn("key", text_key())
    some = rows.where(F.pmod("key", F.lit(max(1, rows.count() // SAMPLE))) == 0).repartition("key")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            found = [np.zeros(0, "<u8"), *(_distinct_hashes(text, words) for text in texts(batch["text"]))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view("<i8"))], ["h"])

    held = some.mapInArrow(made, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("many")).where("many > 1").orderBy(F.desc("many"), "h").limit(FREQUENT).toPandas()
    hashes, many = held["h"].to_numpy(np.int64).view("<u8"), held["many"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], many[order]


def prefix(distinct: np.ndarray, similarity: float, hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 shingles, those that few texts have before others."""
    n = len(distinct)
    if not n:
        return np.zeros(0, np.int64)
    count = np.zeros(n, np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
        count = np.where(hashes[at] == distinct, many[at], 0)
    # distinct ascends, and the sort is stable.
    return distinct[np.argsort(count, kind="stable")[: n - math.ceil(similarity * n - 1e-9) + 1]].view("<i8")


def _ident(text: bytes) -> int:
    return signed(xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 11))


def _measured(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, key (of the text), ident (of its lower-cased words), n (distinct shingles), fp, sections for each row."""

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        idents, sizes, fps, sections = [], [], [], []
        for text in texts(batch["text"]):
            hashes = list(shingle_hashes(text, words))
            distinct = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, "<u8")
            idents.append(_ident(text))
            sizes.append(len(distinct))
            fps.append(signed(majority(hashes)))
            sections.append(section_keys(distinct, similarity))
        columns = [pa.array(idents, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(sections, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], *columns], ["doc_id", "key", "ident", "n", "fp", "sections"])

    rows = select_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")
    return map_batches(rows, made, "doc_id long, key long, ident long, n long, fp long, sections array<long>")


def _packed(docs: DataFrame, words: int, similarity: float, bits: int) -> DataFrame:
    """bucket (first bits of a shingle), h, ident, at (bytes): the prefixes of all texts, the same many bytes for each shingle.

    A row for each shingle would be twice as many bytes, and nearly all of them are of one text alone.
    """
    order = _frequent(docs, words)

    def made(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = {}
        for text in texts(batch["text"]):
            ident = _ident(text)
            if ident not in found:
                found[ident] = prefix(_distinct_hashes(text, words), similarity, *order)
        many = [len(x) for x in found.values()]
        if not sum(many):
            return None
        h, ident = np.concatenate(list(found.values())), np.repeat(np.fromiter(found, np.int64, len(found)), many)
        at = np.concatenate([np.arange(n, dtype="<i4") for n in many])
        bucket = (h.view("<u8") >> np.uint64(64 - bits)).astype(np.int32)
        turn = np.argsort(bucket, kind="stable")
        starts = np.r_[0, np.flatnonzero(np.diff(bucket[turn])) + 1]
        cut = lambda values: pa.array([x.tobytes() for x in np.split(values[turn], starts[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(bucket[turn][starts]), cut(h), cut(ident), cut(at)], ["bucket", "h", "ident", "at"])

    return map_batches(select_columns(docs, "text"), made, "bucket int, h binary, ident binary, at binary")


def _of_many(bucket: pa.Table) -> pa.Table:
    """h, ident, at of a bucket's shingles that more than one text has."""
    h, ident, at = (np.frombuffer(b"".join(bucket[c].to_pylist()), t) for c, t in (("h", "<i8"), ("ident", "<i8"), ("at", "<i4")))
    turn = np.lexsort((ident, h))
    h, ident, at = h[turn], ident[turn], at[turn]
    # Texts with the same words have the same prefixes.
    first = np.r_[True, (np.diff(h) != 0) | (np.diff(ident) != 0)]
    h, ident, at = h[first], ident[first], at[first]
    new = np.r_[True, np.diff(h) != 0]
    many = ~(new & np.r_[new[1:], True])
    return pa.table({"h": h[many], "ident": ident[many], "at": at[many]})


def _met(rows: DataFrame, group: str) -> DataFrame:
    """(member, other) of rows(ident, n, group): each with the smallest and the largest of its group, if sizes allow."""
    pair = F.struct("ident", "n")
    ends = rows.groupBy(group).agg(F.min(pair).alias("low"), F.max(pair).alias("high")).where("low.ident <> high.ident")
    # Null-safe, so that the join has shuffles of its own, whose hot groups adaptive execution splits.
    met = rows.join(ends.withColumnRenamed(group, "of"), F.col(group).eqNullSafe(F.col("of")))
    return met.select("ident", "n", F.explode(F.array("low", "high")).alias("end")).select(F.col("ident").alias("member"), F.col("n").alias("m"), F.col("end.ident").alias("other"), F.col("end.n").alias("o"))


def _candidates(uniq: DataFrame, similarity: float) -> DataFrame:
    """(member, other): pairs of idents to compare."""
    met = _met(uniq.select("ident", "n", F.explode("sections").alias("section")), "section").unionByName(_met(uniq.select("ident", "n", "fp"), "fp"))
    ends = uniq.groupBy("fp").agg(F.min(F.struct("ident", "n")).alias("low"))
    near = fingerprint_links(uniq.select("fp").distinct())
    near = near.join(ends.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(ends.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b")
    near = near.select(F.col("x.ident").alias("member"), F.col("x.n").alias("m"), F.col("y.ident").alias("other"), F.col("y.n").alias("o"))
    # Sets whose sizes differ by more cannot be similar enough.
    sizes = F.least("m", "o") >= F.lit(similarity) * F.greatest("m", "o")
    return met.unionByName(near).where((F.col("member") != F.col("other")) & sizes).select("member", "other").distinct()


def _placed(uniq: DataFrame, links: DataFrame) -> DataFrame:
    """ident, n, root (of its class by the links)."""
    return uniq.select("ident", "n").join(connected(links), F.col("ident") == F.col("node"), "left").select("ident", "n", F.coalesce("root", "ident").alias("root"))


def _joined(placed: DataFrame, links: DataFrame) -> DataFrame:
    """placed(ident, root) after these further links: only classes are connected, not their texts once more."""
    for end in ("a", "b"):
        links = links.join(placed.select(F.col("ident").alias(end), F.col("root").alias(f"{end}_root")), end)
    found = connected(links.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))).withColumnRenamed("root", "under")
    return placed.join(found, F.col("root") == F.col("node"), "left").select("ident", F.coalesce("under", "root").alias("root"))


def _enough(similarity: float) -> Column:
    """Whether sets of m and o shingles, with a first common one at places at_m and at_o of their prefixes, may be similar enough."""
    most = 1 + F.least(F.col("m") - F.col("at_m") - 1, F.col("o") - F.col("at_o") - 1)
    sizes = F.least("m", "o") >= F.lit(similarity) * F.greatest("m", "o")
    return sizes & (most >= F.lit(similarity / (1 + similarity)) * (F.col("m") + F.col("o")) - 1e-6)


def _rest(docs: DataFrame, uniq: DataFrame, links: DataFrame, words: int, similarity: float, shingles: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): links between classes of `links`, so many that no similar pair is left in two classes, and (ident, root) by all links; `shingles` of all texts tell how many buckets."""
    placed = checkpointed(_placed(uniq, links).coalesce(parts))
    bits = min(16, max(6, math.ceil((1 - similarity) * shingles / BUCKET).bit_length()))
    shared = _packed(docs, words, similarity, bits).groupBy("bucket").applyInArrow(_of_many, "h long, ident long, at int")
    rows = written(shared.join(placed, "ident").select("h", "ident", "n", "at", "root"))
    # Only shingles of more than one class; null-safe for the same reason as in _met.
    classes = rows.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select(F.col("h").alias("of"))
    shared = written(rows.join(classes, F.col("h").eqNullSafe(F.col("of"))).drop("of"))
    item = F.struct("root", "ident", "n", "at")
    ends = shared.groupBy("h").agg(F.min(item).alias("low"), F.max(item).alias("high")).withColumnRenamed("h", "of")
    met = shared.join(ends, F.col("h").eqNullSafe(F.col("of"))).select("ident", "n", "at", "root", F.explode(F.array("low", "high")).alias("end"))
    pair = ["ident AS member", "n AS m", "at AS at_m", "end.ident AS other", "end.n AS o", "end.at AS at_o"]
    met = met.where("root <> end.root").selectExpr(*pair).where(_enough(similarity))
    pairs = checkpointed(met.select("member", "other").distinct().coalesce(parts))
    more = checkpointed(_similar(docs, uniq, pairs, words, similarity, parts)).coalesce(parts)
    roots = checkpointed(_joined(placed, more).coalesce(parts))
    # What is still apart meets at each shingle that it shares.
    held = written(shared.select("h", "ident", "n", "at").join(roots, "ident"))
    still = held.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("h")
    held = written(held.join(still, "h"))
    left = held.selectExpr("h", "ident AS member", "n AS m", "at AS at_m", "root AS r")
    right = held.selectExpr("h AS of", "ident AS other", "n AS o", "at AS at_o", "root AS q")
    every = left.join(right, F.col("h").eqNullSafe(F.col("of")) & (F.col("r") != F.col("q")) & (F.col("member") < F.col("other")))
    every = every.groupBy("member", "other").agg(F.count(F.lit(1)).alias("common"), F.max("m").alias("m"), F.max("o").alias("o"), F.max(_enough(similarity)).alias("may"))
    # Where the prefix that ends first ends, all common shingles are in both prefixes; beyond it are at most what that prefix leaves out.
    beyond = F.ceil(F.lit(similarity) * F.greatest("m", "o") - 1e-9) - 1
    every = every.where(F.col("may") & (F.col("common") + beyond >= F.lit(similarity / (1 + similarity)) * (F.col("m") + F.col("o")) - 1e-6)).select("member", "other")
    every = checkpointed(every.join(pairs.select(F.least("member", "other").alias("member"), F.greatest("member", "other").alias("other")), ["member", "other"], "left_anti")).coalesce(parts)
    last = checkpointed(_similar(docs, uniq, every, words, similarity, parts)).coalesce(parts)
    return more.unionByName(last), checkpointed(_joined(roots, last).coalesce(parts))


def _compared(words: int, similarity: float):  # noqa: ANN202
    """(a, b) of similar pairs, from rows sorted by (other, run, kind): the other's own text comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        held = np.zeros(0, "<u8")
        for batch in batches:
            found = []
            for kind, member, other, text in zip(batch["kind"].to_pylist(), batch["member"].to_pylist(), batch["other"].to_pylist(), texts(batch["text"])):
                mine = _distinct_hashes(text, words)
                if kind == 0:
                    held = mine
                else:
                    common = len(np.intersect1d(mine, held, assume_unique=True))
                    if common >= similarity * (len(mine) + len(held) - common):
                        found.append((member, other))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _similar(docs: DataFrame, uniq: DataFrame, pairs: DataFrame, words: int, similarity: float, parts: int) -> DataFrame:
    """(a, b): the pairs whose Jaccard similarity is enough, compared in runs of about RUN members."""
    # One row's text of each ident that is in a pair; rows that repeat it are folded before they are shuffled.
    wanted = checkpointed(pairs.select(F.explode(F.array("member", "other")).alias("ident")).distinct().join(uniq.select("ident", "row.doc_id", "row.key"), "ident").coalesce(parts))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_key().alias("mark"), "text")
    sent = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    held = rows.join(sent, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("mark") == F.col("key")))
    bodies = checkpointed(held.groupBy("ident").agg(F.first("text").alias("text")))
    runs = pairs.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / RUN).alias("runs"))
    own = runs.join(bodies, F.col("other") == F.col("ident")).select("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"), F.lit(0).alias("kind"), F.col("other").alias("member"), "text")
    # Null-safe for the same reason as in _met.
    dealt = pairs.join(runs.withColumnRenamed("other", "of"), F.col("other").eqNullSafe(F.col("of"))).withColumn("run", F.pmod(F.xxhash64("member"), "runs"))
    members = dealt.join(bodies, F.col("member") == F.col("ident")).select("other", "run", F.lit(1).alias("kind"), "member", "text")
    rows = own.unionByName(members).repartition("other", "run").sortWithinPartitions("other", "run", "kind")
    return rows.mapInArrow(_compared(words, similarity), "a long, b long")


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, key (a hash of the text), component_id, links for every row of docs(doc_id, text).

    component_id is the smallest doc_id of the class; null ids are never
    smallest, and a class of null ids alone has a null id.  links counts the
    compared texts to which the row's text was found similar.  Texts with the
    same words, case aside, are of one class, as are all without words (null,
    empty, white).  Repeated rows come out once each; an empty table gives an
    empty result; other columns are ignored.
    """
    found = checkpointed(_measured(docs, words, similarity))
    rows, shingles = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = max(PARTS, -(-rows // TEXTS))
    uniq = checkpointed(found.groupBy("ident").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("row"), F.max("n").alias("n"), F.max("fp").alias("fp"), F.max("sections").alias("sections")).coalesce(parts))
    pairs = checkpointed(_candidates(uniq, similarity).coalesce(parts))
    links = checkpointed(_similar(docs, uniq, pairs, words, similarity, parts)).coalesce(parts)
    more, roots = _rest(docs, uniq, links, words, similarity, shingles, parts)
    links = links.unionByName(more)
    classes = uniq.select("ident", "least").join(roots, "ident")
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("links"))
    named = checkpointed(classes.join(smallest, "root").join(degree, F.col("ident") == F.col("end"), "left").select("ident", "component_id", F.coalesce("links", F.lit(0)).alias("links")))
    return found.join(named.withColumnRenamed("ident", "of"), F.col("ident").eqNullSafe(F.col("of"))).select("doc_id", "key", "component_id", "links")


def without_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each class: one with the smallest doc_id, of several such the one with the smallest hash of its text.

    Null ids are never smallest; of classes of null ids alone each distinct
    text keeps a row.  A repeated row stays once.  An empty table stays empty.
    """
    found = checkpointed(similar_classes(docs, words, similarity).select("doc_id", "key", "component_id"))
    rows = found.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("copies"), F.max("component_id").alias("component_id"))
    named = rows.where("component_id IS NOT NULL")
    stays = named.where("doc_id = component_id").groupBy("component_id").agg(F.min("key").alias("key")).select(F.col("component_id").alias("doc_id"), "key")
    gone = named.where("doc_id IS NOT NULL").join(stays, ["doc_id", "key"], "left_anti").select("doc_id", "key").unionByName(named.where("doc_id IS NULL").select("doc_id", "key"))
    # Rows that share a null id can be told apart by text only.
    stays = stays.unionByName(rows.where("component_id IS NULL").select("doc_id", "key"))
    again = rows.where("copies > 1").select("doc_id", "key")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key().alias("mark"))

    def same(other: DataFrame) -> tuple[DataFrame, Column]:
        return other.select(F.col("doc_id").alias("other_id"), F.col("key").alias("other_key")), F.col("id").eqNullSafe(F.col("other_id")) & (F.col("mark") == F.col("other_key"))

    once = whole.join(*same(gone.unionByName(again).distinct()), "left_anti").select("row")
    repeated = again.alias("r").join(stays.alias("s"), F.expr("r.doc_id <=> s.doc_id AND r.key = s.key"), "left_semi")
    folded = whole.join(*same(repeated), "left_semi").groupBy("id", "mark").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return once.unionByName(folded).select("row.*")
