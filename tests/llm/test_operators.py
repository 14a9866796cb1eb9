import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from histlens.llm import common, exact_dedup, huffman, language_id, license_scan, line_dedup, mixing, packing, pii, quality, simhash_dedup, similar, tokens

WHITE = re.compile("[\x20\x09-\x0d]+")
WORDS = tokens.tokenizer_path("word_bpe_49k.json")
BYTES = tokens.tokenizer_path("byte_bpe_50k.json")


def words(text):
    return [w for w in WHITE.split(text or "") if w]


def plain(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# 1


def brute_simhash(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_parts(values):
    values, parent = sorted(values), {}

    def top(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                if x != y:
                    parent[y] = x
    return {v: top(v) for v in values}


def check_components(rows, found):
    marks = [(i, brute_simhash(t)) for i, t in rows]
    parts = brute_parts({m for _, m in marks})
    least = defaultdict(lambda: None)
    for i, m in marks:
        if i is not None and (least[parts[m]] is None or i < least[parts[m]]):
            least[parts[m]] = i
    assert Counter(found) == Counter((i, f"{m:016x}", least[parts[m]]) for i, m in marks)


def test_simhash_hard_rows(hard):
    check_components(plain(hard, "doc_id", "text"), plain(simhash_dedup.near_duplicates(hard), "doc_id", "fingerprint", "component_id"))


def test_simhash_sample(sample):
    check_components(plain(sample, "doc_id", "text"), plain(simhash_dedup.near_duplicates(sample), "doc_id", "fingerprint", "component_id"))


def close_values(seed, bases, each):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(bases)]
    return sorted({b ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for b in base for _ in range(each)})


def test_bk_tree_finds_what_brute_force_finds():
    members = close_values(2, 12, 30)
    random.Random(1).shuffle(members)
    tree = simhash_dedup.Tree.read(simhash_dedup.Tree.written(members))
    for value in [*members[:100], *close_values(5, 3, 3)]:
        assert sorted(tree.near(value, 3)) == sorted(m for m in members if (m ^ value).bit_count() <= 3)
    for child, (parent, edge) in enumerate(zip(*simhash_dedup.build_tree(members))):
        assert child == 0 or edge == (members[child] ^ members[parent]).bit_count()


def test_masks_leave_two_blocks_or_a_quarter_equal():
    masks, rng = simhash_dedup._first_masks(), random.Random(7)
    for _ in range(300):
        differing = sum(1 << b for b in rng.sample(range(64), 3))
        fit = [m for m in masks if not m & differing]
        assert fit
        for _ in range(5):
            fit = [f for m in fit for f in simhash_dedup._finer(m) if not f & differing]
            assert fit
    assert max(64 - m.bit_count() for m in fit) <= 11


@pytest.mark.parametrize("room", [1 << 20, 6000, 0])
@pytest.mark.parametrize("dense", [2048, 40])
def test_links_join_what_brute_force_joins(spark, monkeypatch, room, dense):
    """Trees broadcast at once, in rounds, and searched where they are; shards dealt once, and again and again."""
    monkeypatch.setattr(simhash_dedup, "BROADCAST_BYTES", room)
    monkeypatch.setattr(simhash_dedup, "DENSE", dense)
    values = close_values(4, 4, 90) + [random.Random(9).getrandbits(30) << 20 | x for x in range(200)]
    values = sorted(set(values))
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = simhash_dedup.fingerprint_links(rows)
    found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash_dedup.connected(links).collect()}
    groups = lambda roots: {frozenset(k for k in values if roots.get(k, k) == r) for r in {roots.get(v, v) for v in values}}
    assert groups(found) == groups(brute_parts(values))
    assert links.count() < 12 * len(values)


def test_components_of_a_long_chain(spark):
    rows = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert dict(plain(simhash_dedup.connected(rows), "node", "root")) == {i: 0 for i in range(1, 61)} | {101: 100}


def test_few_edges_are_written_in_few_parts(spark):
    """However many shuffle partitions are held, rounds of few edges are few files and tasks (pipeline's finding of round 3)."""
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found = simhash_dedup.connected(spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long"))
        assert found.rdd.getNumPartitions() <= simhash_dedup.PARTS
        assert dict(plain(found, "node", "root")) == {i: 0 for i in range(1, 13)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shingle_set(text, n=5):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([" ".join(w)])


def jaccard(a, b):
    return len(a & b) / len(a | b)


def variants(rng, base, many):
    """Copies of a text with words changed, so that similarities run from about 0.6 to 1."""
    out = []
    for _ in range(many):
        w = base.split()
        for _ in range(rng.randint(0, max(1, len(w) // 30))):
            w[rng.randrange(len(w))] = f"changed{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


def test_similar_classes_against_all_pairs(spark):
    """Links are right without exception, and nearly all similar pairs are in one class, short texts and long ones."""
    rng = random.Random(12)
    rows = []
    for size in (8, 14, 30, 50, 70, 120, 300, 1500):
        for _ in range(6):
            base = " ".join(f"w{rng.randrange(50_000)}" for _ in range(size))
            rows += variants(rng, base, 8)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in similar.similar_classes(docs).collect()}
    sets = [shingle_set(t) for t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i // 8 * 8, i) if jaccard(sets[i], sets[j]) >= 0.8]
    exact = {i: i for i in range(len(rows))}
    for _ in rows:
        for i, j in near:
            exact[i] = exact[j] = min(exact[i], exact[j])
    assert all(exact[i] == exact[found[i]] for i in found)
    caught = sum(found[i] == found[j] for i, j in near)
    assert len(near) > 300 and caught >= 0.97 * len(near)


def test_no_similar_pair_is_left_in_two_classes(spark, monkeypatch):
    """Without sections and fingerprints' links everything is left to prefixes, which leave nothing out; with them all the same (finding F3)."""
    rng = random.Random(21)
    rows = [v for size in (9, 25, 50, 90, 200, 600) for _ in range(5) for v in variants(rng, " ".join(f"w{rng.randrange(50_000)}" for _ in range(size)) + " a line that all of these texts have in common", 8)]
    sets = [shingle_set(t) for t in rows]
    exact = list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    for _ in range(20):
        for i, j in near:
            exact[i] = exact[j] = min(exact[i], exact[j])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert dict(plain(similar.similar_classes(docs), "doc_id", "component_id")) == dict(enumerate(exact))
    monkeypatch.setattr(similar, "_candidates", lambda uniq, _: uniq.selectExpr("ident AS member", "ident AS other").where("false"))
    monkeypatch.setattr(similar, "SAMPLE", 40)
    assert len(near) > 200 and dict(plain(similar.similar_classes(docs), "doc_id", "component_id")) == dict(enumerate(exact))


def test_shingles_that_one_text_has_are_not_written(spark):
    """Texts that share nothing leave less in the shared folder than eight bytes for each shingle of their prefixes, copies or not."""
    rng = random.Random(5)
    rows = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(804)) for _ in range(250)]
    shingles = sum(800 - 640 + 1 for _ in rows)
    docs = spark.createDataFrame(list(enumerate(rows + rows)), "doc_id long, text string").repartition(4)
    folder = Path(common.shared_folder(spark).removeprefix("file:"))
    before = set(folder.rglob("*"))
    found = dict(plain(similar.similar_classes(docs), "doc_id", "component_id"))
    assert found == {i: i % 250 for i in range(500)}
    assert sum(x.stat().st_size for x in set(folder.rglob("*")) - before if x.is_file()) < 8 * shingles


def test_similar_classes_of_one_large_group_in_runs(spark, monkeypatch):
    monkeypatch.setattr(similar, "RUN", 7)
    rng = random.Random(3)
    base = " ".join(f"w{i}" for i in range(150))
    rows = [(i, base.replace(f" w{rng.randrange(1, 149)} ", f" other{i} ")) for i in range(120)] + [(500, " ".join(f"x{i}" for i in range(150)))]
    found = dict(plain(similar.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id"))
    assert found == {i: 0 for i in range(120)} | {500: 500}


def test_section_keys_stay_few():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 31, 32, 63, 64, 5000, 200_000):
        distinct = np.unique(rng.integers(0, 1 << 63, n, np.int64).astype("<u8") * np.uint64(2))
        keys = similar.section_keys(distinct, 0.8).tolist()
        assert len(keys) <= 2 * similar.SECTIONS and len(set(keys)) == len(keys) and bool(keys) == bool(n)


def test_near_dedup_keeps_one_of_each(hard, none):
    kept = similar.without_near_duplicates(hard)
    assert kept.columns == hard.columns
    rows = plain(kept, "doc_id", "text")
    assert Counter(i for i, _ in rows) == Counter([1, 2, 6, 7, -8])
    assert similar.without_near_duplicates(none).count() == 0
    clash = hard.selectExpr("doc_id", "text", "lang AS id", "lang AS mark", "lang AS row", "lang AS __id", "lang AS other_key")
    assert Counter(i for i, *_ in plain(similar.without_near_duplicates(clash), *clash.columns)) == Counter([1, 2, 6, 7, -8])


def test_near_dedup_of_null_ids_alone(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "quite another text here")], "doc_id long, text string")
    assert sorted(r[1] for r in plain(similar.without_near_duplicates(rows), "doc_id", "text")) == ["a b c d", "quite another text here"]


# 2


def test_language_held_out_accuracy(sample):
    held = language_id.is_held_out()
    model = language_id.fit(sample.where(~held))
    found = language_id.identify(sample.where(held), model).join(sample.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 20 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_held_out_is_crc32(spark):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), language_id.is_held_out("id").alias("h")).collect()
    assert [r["h"] for r in rows] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(40)]


def test_mixed_text_gets_spans(spark, sample):
    model = language_id.fit(sample)
    by = {r["lang"]: r["text"] for r in sample.where(F.length("text") > 600).orderBy("doc_id").collect()}
    text = " ".join(by["de"].split()[:40]) + " " + " ".join(by["fr"].split()[:60])
    found = language_id.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert found["lang_pred"] == "fr" and {s.split(":")[0] for s in found["spans"].split(",")} >= {"de", "fr"}


def test_language_hard_rows(hard, none):
    model = language_id.fit(hard)
    got = dict(plain(language_id.identify(hard.where("doc_id IN (2, 4)"), model), "doc_id", "lang_pred"))
    assert got == {2: "und", 4: "und"}
    everyone = [r[0] for r in plain(hard, "text")]
    want = Counter((i, lang, round(score, 6)) for (i,), (lang, score, _) in zip(plain(hard, "doc_id"), brute_language(everyone, [(t, x) for t, x in plain(hard, "text", "lang") if t is not None and x is not None])))
    assert Counter((i, lang, round(score, 6)) for i, lang, score in plain(language_id.identify(hard, model), "doc_id", "lang_pred", "score")) == want
    assert {r[0] for r in plain(language_id.identify(hard, language_id.fit(none)), "lang_pred")} == {"und"}


def test_script_narrows_candidates(spark):
    rows = spark.createDataFrame([(1, "привет мир как дела", "ru"), (2, "hello world how are you", "en")], "doc_id long, text string, lang string")
    found = language_id.identify(spark.createDataFrame([(1, "мир"), (2, "zzz"), (3, "漢字"), (4, "123 !")], "doc_id long, text string"), language_id.fit(rows))
    got = {r["doc_id"]: r["lang_pred"] for r in found.collect()}
    assert got[1] == "ru" and got[2] == "en" and got[3] in ("ru", "en") and got[4] == "und"


def brute_language(rows, labelled):
    """Languages, and (language, share, spans) of each text, from words one by one in plain numbers."""

    def mixed_hash(*points):
        x = len(points)
        for p in points:
            x = (x * 0x9E3779B97F4A7C15 + p) * 0xBF58476D1CE4E5B9 % (1 << 64)
        return x >> (64 - 15)

    def script(c):
        return next((name for name, a, b in language_id.SCRIPTS if a <= ord(c) <= b), "other")

    cache = {}

    def features(word):
        if word not in cache:
            letters = [c for c in word.lower() if c.isalpha()]
            p = [10, *map(ord, letters), 10]
            found = [mixed_hash(a, b) for a, b in zip(p, p[1:])] + [mixed_hash(a, b, c) for a, b, c in zip(p, p[1:], p[2:])]
            found.append(mixed_hash(sum(x * int(language_id._MIX[k % 64]) for k, x in enumerate(p[1:-1], 1))))
            tally = Counter(map(script, letters))
            cache[word] = (letters, max(language_id.SCRIPT_NAMES, key=lambda s: (tally[s], -language_id.SCRIPT_NAMES.index(s))), found if letters else [])
        return cache[word]

    languages = sorted({lang for _, lang in labelled})
    counts, scripts, many = {k: Counter() for k in languages}, {k: Counter() for k in languages}, Counter(lang for _, lang in labelled)
    for text, lang in labelled:
        for word in words(text):
            letters, own, found = features(word)
            counts[lang].update(found)
            scripts[lang][own] += len(letters)
    sums = {k: sum(c.values()) + 0.1 * language_id.BUCKETS for k, c in counts.items()}
    every = sum(n + 1 for n in many.values())
    out = []
    for text in rows:
        value, back, sizes = [np.log((many[k] + 1) / every) for k in languages], [], []
        for word in words(text):
            letters, own, found = features(word)
            if not letters:
                continue
            logs = [[np.log((counts[k][f] + 0.1) / sums[k]) for k in languages] for f in found]
            score = [sum(row[i] - max(row) for row in logs) for i in range(len(languages))]
            fits = [scripts[k][own] >= 0.02 * max(sum(scripts[k].values()), 1) for k in languages]
            score = [s if ok else min(score) - 100 for s, ok in zip(score, fits)] if any(fits) else [0.0] * len(languages)
            best = value.index(max(value))
            came = [i if value[i] >= value[best] - language_id.SWITCH else best for i in range(len(languages))]
            value = [max(value[i], value[best] - language_id.SWITCH) + score[i] for i in range(len(languages))]
            back.append(came)
            sizes.append(len(letters))
        if not sizes:
            out.append(("und", 0.0, ""))
            continue
        path = [value.index(max(value))]
        for came in reversed(back):
            path.append(came[path[-1]])
        path = path[::-1][1:]
        share = [sum(n for n, p in zip(sizes, path) if p == i) for i in range(len(languages))]
        cuts = [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1]), len(path)]
        spans = ",".join(f"{languages[path[a]]}:{a}:{b}" for a, b in zip(cuts, cuts[1:]))
        best = share.index(max(share))
        out.append((languages[best], share[best] / sum(share), spans))
    return out


def test_labels_equal_brute_force(spark, sample):
    rows = sample.where(F.length("text") < 1500).select("doc_id", "text", "lang").orderBy("doc_id").collect()
    labelled, texts = [(r["text"], r["lang"]) for r in rows[:60]], [r["text"] for r in rows[60:100]] + ["", "12 !", "привет world", "der die das und the of"]
    model = language_id.fit(spark.createDataFrame([(i, *x) for i, x in enumerate(labelled)], "doc_id long, text string, lang string"))
    found = {r["doc_id"]: (r["lang_pred"], r["score"], r["spans"]) for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, (lang, score, spans) in enumerate(brute_language(texts, labelled)):
        assert (found[i][0], found[i][2]) == (lang, spans) and found[i][1] == pytest.approx(score)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(9, 3)).astype(np.float32)
    lengths = np.array([6, 4, 1])
    at = rng.integers(0, 9, lengths.sum())
    path = language_id.viterbi(at, lengths, scores, np.zeros(3), switch=1.5)
    from itertools import product

    low = 0
    for n in lengths:
        part = at[low : low + n]
        value = lambda p: sum(scores[w, s] for w, s in zip(part, p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(value(p) for p in product(range(3), repeat=int(n)))
        assert value(tuple(path[low : low + n])) == pytest.approx(best, abs=1e-4)
        low += n


# 3


def whole(path, text, end):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


def check_files(spark, docs, rows):
    path = huffman.write_tokens(docs, WORDS)
    got = huffman.read_tokens(spark, path).orderBy("start").collect()
    assert len(got) == len(rows)
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    want = Counter((i, np.array(whole(WORDS, t, 1), "<u4").tobytes()) for i, t in rows)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    digest = huffman.read_tokens(spark, path, digest=True)
    assert Counter(plain(digest, "doc_id", "ids_crc32")) == Counter({(i, zlib.crc32(b)): n for (i, b), n in want.items()})


def test_token_files_round_trip(spark, hard, sample):
    for docs in (hard, sample.limit(40)):
        docs = docs.persist()
        check_files(spark, docs, plain(docs, "doc_id", "text"))


def test_token_files_many_buckets(spark, sample, monkeypatch):
    monkeypatch.setattr(huffman, "BUCKET_IDS", 5000)
    monkeypatch.setattr(huffman, "BLOCK_IDS", 2000)
    check_files(spark, sample, plain(sample, "doc_id", "text"))


def test_token_files_of_ids_that_fill_many_buckets(spark, monkeypatch):
    """A third of the rows without an id, a third with the same one; none of the buckets holds them all."""
    monkeypatch.setattr(huffman, "BUCKET_IDS", 200)
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else i, f"some text number {i % 70} " * 4) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_files(spark, docs, rows)
    path = huffman.write_tokens(docs, WORDS)
    held = spark.read.parquet(f"{path}/blocks").select("bucket", F.explode("docs").alias("doc_id")).groupBy("bucket", "doc_id").count().collect()
    for hot in (None, 50):
        assert max(r["count"] for r in held if r["doc_id"] == hot) < 50 < sum(r["count"] for r in held if r["doc_id"] == hot)


def test_ranges_of_ids():
    owner, ranges = huffman.pa.array([None, 1, 5, 5, 6, 7, 9, None]), huffman.Ranges.of([5, 5, 5, 7], 2)
    found = ranges.bucket(owner, [b"a", b"", b"b", b"c", b"", b"", b"", b"d"]).tolist()
    assert ranges.slots == 2 + 1 + 3 + 1 + 1 and found[1] == 2 and all(3 <= x <= 5 for x in found[2:4]) and found[4:7] == [6, 6, 7] and found[0] < 2 > found[7]
    assert huffman.Ranges.of([], 0).bucket(owner, [b""] * 8).tolist() == [0] * 8 and huffman.Ranges.of([4], 0).bucket(owner, [b""] * 8).tolist() == [0, 0, 1, 1, 1, 1, 1, 0]


def test_token_files_empty(spark, none):
    assert huffman.read_tokens(spark, huffman.write_tokens(none, WORDS)).count() == 0


def test_code_lengths_are_limited_and_optimal():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 50, 700):
        counts = (rng.pareto(0.6, n) * 10 + 1).astype(np.int64)
        lengths = huffman.code_lengths(counts, 12)
        assert lengths.max() <= 12 and (n == 1 or sum(2.0 ** -int(x) for x in lengths) == 1)
        bits, table = huffman.decoding_table(lengths)
        assert len(table) == 1 << bits
    # With room enough it is as short as plain Huffman coding.
    import heapq

    counts = rng.integers(1, 1000, 200)
    heap, cost = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((huffman.code_lengths(counts, 40) * counts).sum()) == cost


# 4

BASE = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute_spans(text):
    def good(kind, found):
        digits = [int(c) for c in found if c in "0123456789"]
        if kind == 1:
            return all(int(p) <= 255 for p in found.split("."))
        if kind == 2:
            return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
        return kind == 0 or 10 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(BASE) for m in p.finditer(text) if good(k, m[0]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(11)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789 .-@+()aé%1.1..  ++") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_base_spans_stay_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "@" * 400_000):
        pii.candidates(text)


def planted(n=600):
    """(id, text, spans to add, base spans, decoys): personal data as people write it beside numbers that are none."""
    rng = random.Random(21)
    word = lambda: rng.choice("lorem ipsum dolor sit amet quis nostrud magna erat sed diam".split())
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    card = lambda: next(c for c in iter(lambda: "4" + digits(15), "") if pii.luhn(c))
    names = "jane.doe sam_lee max mia.fox".split()
    rows = []
    for i in range(n):
        text, add, base, decoys = "", [], [], []

        def put(before, kind, span, into):
            nonlocal text
            text += " ".join(word() for _ in range(rng.randint(4, 9))) + f" {before} "
            into.append((len(text), kind, len(text) + len(span)))
            text += span + ". "

        for _ in range(rng.randint(1, 3)):
            c = card()
            put(*rng.choice([
                ("call me", 3, f"({rng.randint(200, 999)}) 555-{digits(4)}", add), ("my phone", 3, f"{rng.randint(200, 999)}-555-{digits(4)}", add), ("reach her mobile", 3, f"({rng.randint(200, 999)}) 555-{digits(4)}", add),
                ("contact me by mail", 0, f"{rng.choice(names)} [at] mail{digits(1)}.example.org", add), ("my email", 0, f"{rng.choice(names)} (at) example.com", add),
                ("his server address", 1, f"10[.]{rng.randint(1, 250)}[.]{rng.randint(1, 250)}[.]7", add), ("my credit card", 2, f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}", add),
            ]))
        for _ in range(rng.randint(1, 3)):
            put(*rng.choice([("write to", 0, f"{rng.choice(names)}@mail.example.org", base), ("phone", 3, f"+1 (415) 555-{digits(4)}", base), ("ip", 1, f"10.0.0.{rng.randint(1, 250)}", base), ("card", 2, card(), base)]))
        for _ in range(rng.randint(1, 3)):
            put(*rng.choice([("order", 3, f"{digits(3)} {digits(4)} {digits(3)}", decoys), ("ticket", 3, f"{digits(10)}", decoys), ("isbn", 3, f"978 {digits(3)} {digits(4)}", decoys), ("version", 1, "1 . 2 . 3 . 4", decoys), ("serial", 2, "4111/1111/2222/3333", decoys)]))
        rows.append((i, text, add, base, decoys))
    return rows


def test_personal_data_against_brute_force(spark):
    """Every span, with dense matrices and plain loops over all candidates; and how much of what was planted is found."""
    rows = planted()
    found = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    every = {i: pii.candidates(t) for i, t, *_ in rows}
    counts = Counter((c[1], c[3]) for cs in every.values() for c in cs)
    distinct = Counter((c[1], c[3], tuple(c[5])) for cs in every.values() for c in cs)
    assert len(distinct) < pii.SAMPLE
    weights = {}
    for kind in range(4):
        patterns = sorted(v for k, v in counts if k == kind)
        votes = np.array([[v // 4**i % 4 for i in range(len(pii.LABELERS))] for v in patterns])
        truth = dict(zip(patterns, pii.reliabilities(votes, np.array([float(counts[kind, v]) for v in patterns]))[1]))
        seen = [(v, f, n) for (k, v, f), n in distinct.items() if k == kind]
        x, y, n = np.zeros((len(seen), pii.WIDTH)), np.array([truth[v] for v, _, _ in seen]), np.array([float(n) for _, _, n in seen])
        for i, (_, f, _) in enumerate(seen):
            x[i, list(f)] = 1
        w, moved = np.zeros(pii.WIDTH), np.zeros(pii.WIDTH)
        for _ in range(300):
            moved = 0.9 * moved - 0.1 * (x.T @ (n / n.sum() * (1 / (1 + np.exp(-x @ w)) - y)) + 1e-4 * w)
            w = w + moved
        weights[kind] = w
    hits = added = wrong = 0
    for i, text, add, base, decoys in rows:
        spans = brute_spans(text)
        assert sorted(base) == spans
        mine = [(s, k, e) for s, k, e, _, is_base, f in every[i] if not is_base and weights[k][f].sum() >= 0]
        mine = [m for n, m in enumerate(mine) if not any(o[0] < m[2] and m[0] < o[2] for o in mine[:n])]
        assert found[i] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans + mine)), text
        hits += len(set(mine) & set(add))
        added += len(add)
        wrong += len(set(mine) - set(add))
    assert hits >= 0.95 * added and wrong <= 0.05 * hits, (hits, added, wrong)


def test_classifier_decides_where_votes_tie():
    """Two candidates with the same votes, of probability one half, are told apart by the span's features."""
    shared = pii.features(3, 0, "x 555-123-4567", 2, 14, [])
    other = pii.features(3, 0, "x 12 34 56 78 9", 2, 15, [])
    true, false = [1, *shared], [2, *other]
    rows, truth = [true, shared, false, other], np.array([0.98, 0.5, 0.02, 0.5])
    weights = pii.train(rows, truth, np.array([50.0, 20.0, 50.0, 20.0]))
    assert weights[shared].sum() > 0 > weights[other].sum()


def test_sample_bound_and_repeats(spark):
    rows = [(i, t) for i, t, *_ in planted(80)] + [(None, planted(1)[0][1])] * 50
    found = pii._found(spark.createDataFrame(rows, "doc_id long, text string"))
    a, b = pii.fitted(found, sample=40), pii.fitted(found.repartition(3), sample=40)
    assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) for k in a)


def test_personal_data_hard_rows(spark, hard, none):
    def want(text):
        base = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_spans(text or "")]
        return len(base), hashlib.sha256(",".join(base).encode()).hexdigest()

    rows = spark.createDataFrame([(3, None), (3, None), (3, ""), (None, "+1 (415) 555-0100 a@b.c"), (4, "555-123-4567 " * 5000 + "a@b.c")], "doc_id long, text string")
    for docs in (hard, rows):
        found = pii.personal_data(docs)
        got = Counter(plain(found, "doc_id", F.expr("n_email + n_ip + n_card + n_phone"), "base_sha256"))
        assert got == Counter((i, *want(t)) for i, t in plain(docs, "doc_id", "text"))
        assert all(("" if not n else s) is not None for s, n in plain(found, "spans", "n_email"))
    assert pii.personal_data(none).count() == 0


def test_reliabilities_find_the_good_labeler():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.5
    votes = np.stack([np.where(rng.random(4000) < q, np.where(truth, 2, 1), np.where(truth, 1, 2)) for q in (0.95, 0.9, 0.55, 0.9, 0.85, 0.9)], axis=1)
    chances, guess = pii.reliabilities(votes, np.ones(4000))
    assert ((guess > 0.5) == truth).mean() > 0.95 and chances[0, 0, 2] > 0.9 > 0.65 > chances[0, 2, 2]


# 5


def check_exact(docs, **bounds):
    found = plain(exact_dedup.exact_dedup(docs, **bounds), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups = defaultdict(list)
    for i, t in plain(docs, "doc_id", "text"):
        groups[WHITE.sub(" ", t or "")].append(i)
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    assert Counter((*f[:3], f[4]) for f in found) == want
    assert sum(f[3] for f in found) == len(groups)


def test_exact_dedup(hard, none, sample):
    check_exact(hard)
    check_exact(sample)
    assert exact_dedup.exact_dedup(none).count() == 0


def near_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(3000)] + ["same beginning " * 20 + str(i % 40) for i in range(300)]
    return spark.createDataFrame([(rng.randrange(10_000), t) for t in texts], "doc_id long, text string")


def test_the_trie_decides_where_the_hash_says_nothing(spark):
    check_exact(near_texts(spark), short=1)


def test_spilled_subtrees_lose_nothing(spark):
    check_exact(near_texts(spark), short=1, spill_bytes=40, fold_bytes=600)


def test_radix_trie_counts_and_smallest_ids():
    rng = random.Random(9)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 8))).encode() for _ in range(600)]
    trie, want, spilled = exact_dedup.RadixTrie(), {}, []
    for i, k in enumerate(keys):
        trie.insert(k, 1000 - i)
        want[k] = [min(want.get(k, [1000 - i])[0], 1000 - i), want.get(k, [0, 0])[1] + 1]
    assert sorted(trie.terminals()) == sorted((k, *v) for k, v in want.items())
    assert trie.size < sum(map(len, want)) / 2 and trie.size == exact_dedup._size(trie.root)
    before = trie.size
    spilled = list(trie.spill(before // 2))
    assert spilled and trie.size <= before // 2 and trie.size == exact_dedup._size(trie.root)
    assert sorted([*spilled, *trie.terminals()]) == sorted((k, *v) for k, v in want.items())


# 6


def brute_measures(text):
    text = text or ""
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    marked = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_quality_measures(hard, sample):
    for docs in (hard, sample):
        found = plain(quality.quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        want = Counter()
        for i, t in plain(docs, "doc_id", "text"):
            m = brute_measures(t)
            want[(i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
        assert Counter(found) == want


def test_quality_keeps_clean_and_drops_junk(spark, sample):
    clean = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) for i in range(8))
    junk = " ".join(f"word{i}###$$$%%%" for i in range(90))
    rows = [(i, clean.replace("x", chr(97 + i % 26)), "en", "s") for i in range(200)] + [(900, junk, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = dict(plain(quality.quality_rules(docs), "doc_id", "kept"))
    assert not found[900] and all(found[i] for i in range(200))
    assert {r[0] for r in plain(quality.only_good(docs), "doc_id")} == set(range(200))


def habits(rng, n, lang, source, length, symbols, lines, repeats):
    """Documents of 100 words; most have no symbols, no line twice and no repeated words, a tenth have some of each, as the source does."""
    rows = []
    for i in range(n):
        made = [[f"{rng.choice('abcdefgh')}{rng.randrange(10**6):06}" + "x" * (length + rng.randrange(3)) for _ in range(5)] for _ in range(20)]
        if i % 10 == 0:
            k = 1 + i // 10 % 3
            for j in range(symbols * k):
                made[j % 11][4] += "#"
            for j in range(min(lines * k, 8)):
                made[19 - j] = made[12]
            for j in range(min(repeats * k, 5)):
                made[j][0:3] = ["so", "it", "goes"]
        rows.append((i, "\n".join(" ".join(x) for x in made), lang, source))
    return rows


def test_quality_thresholds_follow_each_source(spark):
    """Two sources of other habits get other fences of all measures, all of them above what is usual and from their own sketches."""
    rng = random.Random(4)
    rows = habits(rng, 600, "en", "prose", 1, 1, 1, 1) + habits(rng, 600, "en", "forum", 6, 12, 3, 2) + [(1, "few words", "en", "rare"), (2, None, None, None)]
    stats = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("lang", "source", quality.measured("text").alias("stats"))
    found = {r["source"]: r.asDict() for r in quality.fences(stats).collect()}
    values = stats.where(~quality.base_failed("stats")).select("source", *[v.alias(m) for m, v in quality._values("stats").items()]).collect()
    for m in quality.MEASURES:
        assert found["prose"][f"{m}_high"] != found["forum"][f"{m}_high"], m
        for source in ("prose", "forum"):
            own = sorted(r[m] for r in values if r["source"] == source)
            high = found[source][f"{m}_high"]
            assert own[int(len(own) * 0.9)] <= high and (m == "word_length" or high <= 3 * own[-1]), (m, source)
    # Too few documents: the language's fences, then those of all.
    assert found["rare"]["symbols_high"] is not None and found[None]["symbols_high"] is not None
    # With another least, a source of 600 documents is too small, and both get what holds for the language.
    found = {r["source"]: r.asDict() for r in quality.fences(stats, least=1000).collect()}
    assert all(found["prose"][f"{m}_high"] == found["forum"][f"{m}_high"] for m in quality.MEASURES)


def test_quality_of_what_never_varies(spark):
    """No document has a symbol or a repeat: nothing can be too much, and nothing is rejected."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu".split()
    rows = [(i, " ".join(f"{words[(i + j) % 12]}{j}" for j in range(60)), "en", "s") for i in range(150)]
    assert quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("NOT kept").count() == 0


def test_quality_empty(none, hard):
    assert quality.quality_rules(none).count() == 0
    assert quality.only_good(hard).columns == hard.columns


# 7


def brute_lines(rows, least):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < least]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup(hard, sample, none, least):
    for docs in (hard, sample, none):
        got = Counter(plain(line_dedup.line_dedup(docs, least), "doc_id", "n_lines", "n_dropped", "text"))
        assert got == brute_lines(plain(docs, "doc_id", "text"), least)


@pytest.mark.parametrize(("keys", "pairs", "share"), [(7, 1 << 17, 1), (1 << 16, 500, 1 << 40), (1 << 16, 1 << 17, 30)])
def test_line_dedup_in_many_shards(sample, monkeypatch, keys, pairs, share):
    """Filters alone, hot keys alone, and both."""
    for name, value in (("SHARD_KEYS", keys), ("SHARD_PAIRS", pairs), ("HOT_SHARE", share)):
        monkeypatch.setattr(line_dedup, name, value)
    monkeypatch.setattr(line_dedup, "LEAST_SHARDS", 1)
    assert line_dedup.LineIndex.of(sample, 3).shards > 1 or share == 30
    assert Counter(plain(line_dedup.line_dedup(sample, 3), "doc_id", "n_lines", "n_dropped", "text")) == brute_lines(plain(sample, "doc_id", "text"), 3)


def test_clean_lines_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "drops", "drop_at", "at", "made", "row", "__made", "__n_lines", "__drop_id", "key", "shard"]
    docs = spark.createDataFrame([(i if i % 2 else None, "same\nown %d" % i, *("x" * 10)) for i in range(12)], names)
    found = line_dedup.clean_lines(docs, line_dedup.LineIndex.of(docs, 10))
    assert found.columns == names
    assert Counter(plain(found, *names)) == Counter((i if i % 2 else None, f"own {i}", *("x" * 10)) for i in range(12))


@pytest.mark.parametrize(("size", "passes", "share"), [(1 << 25, 4, 1024), (20_000, 100, 1024), (20_000, 100, 20), (1, 4, 1024)])
def test_line_dedup_by_filters_near_and_far(sample, monkeypatch, size, passes, share):
    """Filters sent to the texts in one group or several, and pairs sent to the filters: the same lines go, and few pairs pass a filter for nothing."""
    for name, value in (("FILTER_BYTES", size), ("PASSES", passes), ("HOT_SHARE", share)):
        monkeypatch.setattr(line_dedup, name, value)
    assert Counter(plain(line_dedup.line_dedup(sample, 3), "doc_id", "n_lines", "n_dropped", "text")) == brute_lines(plain(sample, "doc_id", "text"), 3)
    if size > 1:
        index = line_dedup.LineIndex.of(sample, 3)
        spark = sample.sparkSession
        group = spark.sparkContext.broadcast({r["shard"]: (r["buckets"], bytes(r["cells"])) for r in index.filters.collect()})
        passed = line_dedup._probed(sample, index.shards, index._hot(), group, True)
        frequent = {bytes(r["key"]) for r in index.frequent().collect()}
        rows = passed.collect()
        assert sum(bytes(r["key"]) not in frequent for r in rows) <= 0.01 * line_dedup._keys(sample).count()


def test_line_index_lives_on_in_files(spark, sample, tmp_path):
    first, second = sample.where("doc_id % 2 = 0"), sample.where("doc_id % 2 = 1")
    line_dedup.LineIndex.of(sample, 3).save(str(tmp_path / "index"))
    back = line_dedup.LineIndex.load(spark, str(tmp_path / "index")).delete(second)
    assert Counter(plain(back.counts, "key", "n")) == Counter(plain(line_dedup.LineIndex.of(first, 3).counts, "key", "n"))
    got = plain(line_dedup.clean_lines(first, back), "doc_id", F.coalesce("text", F.lit("")))
    assert Counter(got) == Counter((k[0], k[3]) for k, n in brute_lines(plain(first, "doc_id", "text"), 3).items() for _ in range(n))


def test_line_index_is_reversible(sample):
    first, second = sample.where("doc_id % 2 = 0"), sample.where("doc_id % 2 = 1")
    index = line_dedup.LineIndex.of(first, 3)
    both = index.insert(second)
    whole_index = line_dedup.LineIndex.of(sample, 3)
    assert Counter(plain(both.counts, "key", "n")) == Counter(plain(whole_index.counts, "key", "n"))
    back = both.delete(second)
    assert Counter(plain(back.counts, "key", "n")) == Counter(plain(index.counts, "key", "n"))
    frequent = [bytes(r[0]) for r in plain(back.frequent(), "key")]
    held = {r["shard"]: line_dedup.CuckooFilter(r["buckets"], bytes(r["cells"])) for r in back.filters.collect()}
    assert all(held[line_dedup.shard_of(k, back.shards)].contains([k])[0] for k in frequent)
    assert sum(int((f.table != 0).sum()) for f in held.values()) == len(frequent)


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(5000)]
    made = line_dedup.CuckooFilter.built(keys[:4000])
    assert made.contains(keys[:4000]).all() and made.contains(keys[4000:]).mean() < 0.01
    for k in keys[:2000]:
        assert made.delete(k)
    assert made.contains(keys[2000:4000]).all() and made.contains(keys[:2000]).mean() < 0.01


def test_shard_column_agrees(spark):
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(50)]
    rows = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary").select("key", line_dedup._shard_column(64)).collect()
    assert all(r["shard"] == line_dedup.shard_of(bytes(r["key"]), 64) for r in rows)


# 8


def test_licenses(spark):
    rows = [
        (1, "Released under the MIT License."), (2, "x\nunder the mit license under the MIT license"), (3, "Licensed under CC BY-NC 4.0."), (4, "This work is licensed under the\nGNU General Public License, version 3."),
        (5, "cc by nc cc by nc"), (6, None), (7, "the of under license"), (8, "...apache license version 2"), (9, "K under the mit license"), (9, "K under the mit license"),
    ]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pick = lambda i, *c: tuple(got[i][x] for x in c)
    assert pick(1, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == (5, 1, 1, 1, "mit", "mit", 1.0)
    assert pick(2, "n_words", "n_base", "first_word", "last_word") == (9, 2, 1, 5)
    assert pick(3, "base_labels", "labels") == ("cc-by-nc", "cc-by-nc")
    assert pick(4, "n_base", "first_word", "base_labels", "labels") == (0, None, "", "gpl-3")
    assert pick(5, "n_base", "first_word", "last_word") == (2, 0, 3)
    assert pick(6, "n_words", "n_base", "labels", "score") == (0, 0, "", 0.0)
    assert pick(7, "labels") == ("",)
    assert pick(8, "first_word", "base_labels") == (0, "apache-2")
    assert pick(9, "n_words", "first_word") == (5, 1)


def stands(words, run):
    """Whether the run begins here, each word of it after the other or one word later."""
    if words[:1] != run[:1]:
        return False
    return len(run) == 1 or stands(words[1:], run[1:]) or stands(words[2:], run[1:])


def brute_license(text):
    """Labels of the method and the score, from each window of each template."""
    w, found, best = re.findall("[a-z0-9]+", text.lower()), set(), 0.0
    for label, template, required, without in license_scan.TEMPLATES:
        tokens, span = set(template.split()), 2 * len(template.split())
        for s in range(1 - span, len(w)):
            window = w[max(s, 0) : s + span]
            block, runs = set(window), [r.split("+") for r in required.split()]
            places = [next((i for i in range(len(window)) if stands(window[i:], r)), None) for r in runs]
            if 5 * len(block & tokens) >= 4 * len(tokens) and None not in places and sorted(places) == places and not set(without.split()) & block:
                found.add(label)
                best = max(best, len(block & tokens) / len(tokens))
    return found, best


def test_license_join_is_exact(spark):
    rng = random.Random(8)
    vocabulary = sorted({w for _, t, _, _ in license_scan.TEMPLATES for w in t.split()}) + ["filler", "prose"]
    rows = []
    for i in range(300):
        parts = [["filler"] * rng.choice((0, 30, 110, 127, 128, 400))]
        for _ in range(rng.randint(1, 3)):
            template = rng.choice(license_scan.TEMPLATES)[1].split()
            kept = [w for w in template if rng.random() < 0.9] + rng.sample(vocabulary, 3)
            if rng.random() < 0.3:
                rng.shuffle(kept)
            parts += [kept, ["prose"] * rng.choice((0, 8, 60, 130))]
        rows.append((i, " ".join(w for p in parts for w in p)))
    got = dict(plain(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", F.struct("labels", "base_labels", "score")))
    for i, text in rows:
        found, best = brute_license(text)
        assert set(filter(None, got[i]["labels"].split(","))) == found | set(filter(None, got[i]["base_labels"].split(",")))
        assert got[i]["score"] == pytest.approx(best)
    assert sum(bool(got[i]["labels"]) for i, _ in rows) > 100


def test_licenses_are_told_from_their_relatives(spark):
    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    rows = [
        (1, "released under the gpl license", ""), (2, gnu.format("", 2), "gpl-2"), (3, gnu.format("", 3), "gpl-3"), (4, gnu.format("Lesser ", 3), "lgpl-3"), (5, gnu.format("Affero ", 3), "agpl-3"),
        (6, "This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"), (7, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
        (8, gnu.format("", 2) + " See section 3 of the manual.", "gpl-2"), (9, gnu.format("", 3) + " The lesser evil.", "gpl-3"), (10, gnu.format("", 3) + " word" * 40 + " " + gnu.format("Lesser ", 3), "gpl-3,lgpl-3"),
        (11, "the word mit " + "prose " * 9 + "released " + "prose " * 9 + "under the license", ""), (12, "redistribute this software to any person under the terms of the license", ""),
    ]
    got = dict(plain(license_scan.license_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")), "doc_id", "labels"))
    assert got == {i: labels for i, _, labels in rows}


def test_licenses_of_notices_as_they_are_written(spark):
    """Prose that only mentions a name has no label; notices of the usual kinds have theirs."""
    gnu = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
    cases = [
        ("The study was released under pressure from the MIT board of trustees.", ""), ("The album was released by the label while studying at MIT under the direction of its founder.", ""), ("Everything was released under the MIT umbrella.", ""),
        ("You may not use this file except in compliance with the CDDL license.", ""), ("They released students under the direction of the MIT office of the license board.", ""), ("The general public may get a license under the terms of the version 2 treaty.", ""),
        (gnu.format(what="program", name="General Public License", v=2), "gpl-2"), (gnu.format(what="program", name="General Public License", v=3), "gpl-3"), (gnu.format(what="library", name="Lesser General Public License", v="2.1"), "lgpl-2.1"),
        (gnu.format(what="library", name="Lesser General Public License", v=3), "lgpl-3"), (gnu.format(what="library", name="Library General Public License", v=2), "lgpl-2"), (gnu.format(what="program", name="Affero General Public License", v=3), "agpl-3"),
        ("SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: Apache-2.0", "apache-2"), ("# SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2"), ("/* SPDX-License-Identifier: BSD-3-Clause */", "bsd"), ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "cc-by-nc,cc-by-nc-sa"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"), ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
        ("Licensed under CC BY-ND 4.0", "cc-by-nd"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa"), ("Licensed under CC BY 4.0.", "cc-by"),
        ("This work is licensed under the GNU General Public License version 2 or version 3.", "gpl-2,gpl-3"), ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.", "apache-2"),
        ("// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.", "bsd"),
    ]
    lead = "prose " * 40
    rows = [(i, text) for i, (text, _) in enumerate(cases)] + [(100 + i, f"{lead}\n{text}\n{lead}") for i, (text, _) in enumerate(cases)]
    got = dict(plain(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "labels"))
    assert {i: got[i % 100] for i in got} == {i: cases[i % 100][1] for i in got} and got == {i: cases[i % 100][1] for i in got}


def test_licenses_in_any_wrapping(spark):
    notices = [
        ("mit", " * Permission is hereby granted, free of\n * charge, to any person obtaining a copy\n * of this software and associated\n * documentation files"),
        ("cc-by-sa", "This work is licensed under a\nCreative Commons Attribution-ShareAlike\n4.0 International License"), ("gpl-3", "This work is licensed under the\n\nGNU General Public License, version 3."),
    ]
    notices += [(label, f"{'prose ' * 60}\n" * before + "\n".join(f"{lead}{w}" for w in text.split()) + f"\n{'prose ' * 60}" * after) for n, (label, text, _, _) in enumerate(license_scan.TEMPLATES) for lead, before, after in (("", n % 2, 1), ("dnl ", 1, n % 2))]
    apart = ("released " + "prose " * 12).join(["", "\n\nunder the\n\n"]) + "prose " * 12 + "\n\nmit license"
    rows = [(i, text) for i, (_, text) in enumerate(notices)] + [(-1, apart)]
    got = dict(plain(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", F.struct("labels", "score")))
    for i, (label, _) in enumerate(notices):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
    assert (got[-1]["labels"], got[-1]["score"]) == ("", 0.0)


def test_licenses_hard_rows(spark, hard, none):
    rows = spark.createDataFrame([(1, "license " * 40_000 + "released under the mit license " * 3)], "doc_id long, text string")
    assert plain(license_scan.license_scan(rows), "doc_id", "n_words", "n_base", "labels", "score") == [(1, 40_015, 3, "mit", 1.0)]
    found = Counter(plain(license_scan.license_scan(hard), "doc_id", "n_words", "n_base", "first_word", "labels", "score"))
    assert found == Counter((i, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())), 0, None, "", 0.0) for i, t in plain(hard, "doc_id", "text"))
    assert license_scan.license_scan(none).count() == 0


# 9


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in held)
        free = [s for s in names if s not in held]
        target = {s: 3 * sizes[s] if s in held else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        held |= over


def check_mix(docs):
    rows = plain(docs, "doc_id", "source", "text")
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(words(t))
    for _, s, _ in rows:
        sizes.setdefault(s, 0)
    target, total = brute_targets(dict(sizes)), sum(sizes.values())
    # Each source's rows in turn, walked up to three times; a row is due when the middle of its words is below the target.
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = Counter()
    for s in names:
        slope = (-0.5, 0.0, 0.5)[names.index(s) % 3]
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        mine = sorted((md5(f"{'' if i is None else i}:{md5(t or '')}"), len(words(t)), i) for i, x, t in rows if x == s)
        at, due = 0, defaultdict(list)
        for _ in range(3):
            for n, (_, size, _) in enumerate(mine):
                share = (at + size / 2) / target[s] if target[s] else 1
                at += size
                if share < 1:
                    # Bisection for the time at which the integrated demand reaches the share.
                    low, high = 0.0, 1.0
                    for _ in range(80):
                        middle = (low + high) / 2
                        low, high = (middle, high) if middle + slope * (middle * middle - middle) < share else (low, middle)
                    due[n].append(round(low * total))
        for n, (_, size, i) in enumerate(mine):
            want[i, size, sizes[s], round(target[s], 6), size * len(due[n]), len(due[n])] += 1
            want["positions", i, size] += sum(due[n])
    got, placed = mixing.mixed(docs).collect(), Counter()
    for r in got:
        placed[r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"], len(r["positions"])] += 1
        placed["positions", r["doc_id"], r["size"]] += sum(r["positions"])
        assert r["positions"] == sorted(r["positions"])
    exact = lambda c: {k: n for k, n in c.items() if k[0] != "positions"}
    assert exact(placed) == exact(want)
    assert all(abs(placed[k] - n) <= 4 * len(rows) for k, n in want.items() if k[0] == "positions")
    taken = [r["positions"][0] for r in got if r["positions"]]
    assert taken == sorted(taken) and not any(r["positions"] for r in got[len(taken) :])
    for s in sizes:
        longest = max(len(words(t)) for _, x, t in rows if x == s)
        assert abs(sum(n * k[4] for k, n in exact(want).items() if k[2] == sizes[s]) - target[s] * list(sizes.values()).count(sizes[s])) <= longest * list(sizes.values()).count(sizes[s])


def test_mixing(sample, spark):
    check_mix(sample)
    check_mix(sample.withColumn("source", F.when(F.col("doc_id") % 10 < 7, "hot").when(F.col("doc_id") % 10 == 8, F.lit(None)).otherwise("cold")))


def test_mixing_in_small_buckets(sample, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    check_mix(sample)


def test_mixing_hard_rows(hard, none):
    check_mix(hard)
    assert mixing.mixed(none).count() == 0
    assert mixing.mix(hard).columns == hard.columns and mixing.mix(none).count() == 0


def test_rows_without_an_id_or_with_one_id_reach_the_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 2)
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text, "a")] * 10 + [(None, f"{text} {i}", "b") for i in range(10)] + [(7, text, "c")] * 9 + [(i, text, "d") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_mix(docs)
    plan = Counter()
    for r in mixing.mixed(docs).collect():
        plan[r["doc_id"], r["size"]] += len(r["positions"])
    drawn = Counter((r["doc_id"], len(words(r["text"]))) for r in mixing.mix(docs).collect())
    assert drawn == +plan


def test_mix_draws_what_the_plan_says_in_order(sample):
    plan = sorted((p, r["doc_id"]) for r in mixing.mixed(sample).collect() for p in r["positions"])
    assert [r["doc_id"] for r in mixing.mix(sample).select("doc_id").collect()] == [i for _, i in plan]


def test_curriculum_inverts_the_integrated_weights(spark):
    rows = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
    for slope in (-0.5, 0.0, 0.5):
        for r in rows.select("u", mixing.position(F.col("u"), F.lit(slope)).alias("t")).collect():
            assert r["t"] + slope * (r["t"] ** 2 - r["t"]) == pytest.approx(r["u"], abs=1e-12)


# 10


def check_packing(docs, order=None, slack=1.02):
    rows = plain(docs, "doc_id", "text")
    found = packing.packed(docs, BYTES, order=order).collect()
    want = Counter()
    for i, t in rows:
        ids = whole(BYTES, t, 0)
        high = (len(ids) - 1) % 2048 + 1
        low = piece = 0
        while low < len(ids):
            want[i, piece, low, high - low, zlib.crc32(np.array(ids[low:high], "<u4").tobytes())] += 1
            low, high, piece = high, high + 2048, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in found)
    assert len(bins) <= -(-total // 2048) * slack + 2


def test_packing(hard, sample, none):
    check_packing(hard)
    check_packing(sample)
    assert packing.packed(none, BYTES).count() == 0


def test_packing_keeps_an_order_from_range_to_range(spark, sample, monkeypatch, tmp_path):
    monkeypatch.setattr(packing, "SHARD_PIECES", 40)
    path = str(tmp_path / "ordered")
    sample.repartitionByRange(6, F.col("doc_id").desc()).sortWithinPartitions(F.col("doc_id").desc()).write.parquet(path)
    docs = spark.read.parquet(path)
    assert packing.file_order(sample.groupBy("doc_id").count()) is None
    place = packing.file_order(docs)
    assert [r["doc_id"] for r in docs.orderBy(place).collect()] == sorted((r["doc_id"] for r in docs.collect()), reverse=True)
    check_packing(docs, place, slack=1.2)
    shards = defaultdict(list)
    for r in packing.packed(docs, BYTES, order=place).collect():
        shards[r["sequence_id"] >> 32].append(r["doc_id"])
    order = sorted(shards)
    assert len(order) > 3 and all(min(shards[a]) >= max(shards[b]) for a, b in zip(order, order[1:]))


def test_sum_of_squares_chooses_the_smallest_sum():
    rng = random.Random(6)
    lengths = sorted((rng.randint(1, 20) for _ in range(200)), reverse=True)
    sequence, offset = packing.sum_of_squares(lengths, 20)
    gaps: dict[int, int] = {}
    for n, s, o in zip(lengths, sequence, offset):
        value = lambda moved: sum(v * v for v in Counter(g for g in moved.values() if g).values())
        fits = [b for b, g in gaps.items() if g >= n]
        if fits:
            assert value(gaps | {s: gaps[s] - n}) == min(value(gaps | {b: gaps[b] - n}) for b in fits)
        else:
            assert s not in gaps
        gaps[s] = gaps.get(s, 20) - n
        assert 20 - gaps[s] - n == o


# Tokens


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_cached_encoding_is_the_tokenizer_s_own(path):
    from tokenizers import Tokenizer

    parts = ["Word", "Word,", "x.", "A1!", "é,", "<|EndOfText|>", "<|endoftext|>", "a", "'s", "'RE", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1e", "\xa0", "é", "é", "1", "23", "!", "...", " ", "中文", "don't", "x,y", "\x00", "​", "Σ", "İ", "́", "\x85", "ſ"]
    rng, own, encode = random.Random(1), Tokenizer.from_file(path), tokens.encoder(path)
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(encode.encode(text.encode()), "<u2").tolist() == own.encode(text, add_special_tokens=False).ids, text


def test_encoder_cache_stays_bounded():
    from tokenizers import Tokenizer

    made, own = tokens.Encoder(BYTES), Tokenizer.from_file(BYTES)
    made.most = 50
    for i in range(90):
        text = " ".join(f"w{i % 45}x{j}" for j in range(i % 30)) + " the end."
        assert np.frombuffer(made.encode(text.encode()), "<u2").tolist() == own.encode(text, add_special_tokens=False).ids
        assert len(made._young) <= 50 and len(made._old) <= 50 + 40
    assert made._young or made._old
