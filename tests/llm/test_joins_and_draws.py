"""The band join, importance resampling and sharding: brute force and hard rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from histlens.llm import band_join, resampling, sharding

LINES = "sale_id long, line_no int, item_id long, quantity int, amount double, gap string, u string, p string"
ITEMS = "item_id long, price double, n string, shard string"


def cents(x):
    return None if x is None or not math.isfinite(x) or abs(100 * x + 0.5) >= 9e15 else math.floor(100 * x + 0.5)


def brute_band(lines, items, absolute, numerator, denominator, k):
    found = []
    able = []
    for sale, no, item, quantity, amount in lines:
        a = cents(amount)
        if None in (sale, item, a) or not quantity:
            continue
        able.append(((2 * a + quantity) // (2 * quantity), sale, no, item, zlib.crc32(f"{sale},{'' if no is None else no},{item}".encode())))
    for item, price in items:
        p = cents(price)
        pairs = []
        if p is not None and item is not None:
            pairs = [(abs(u - p), u, sale, no, other, crc) for u, sale, no, other, crc in able if other != item and (abs(u - p) <= absolute or denominator * abs(u - p) <= numerator * max(u, p))]
        pairs.sort(key=lambda x: (*x[:3], x[3] is not None, x[3] or 0, x[4]))
        totals = len(pairs), sum(x[0] for x in pairs), sum(x[5] for x in pairs)
        found += [(item, i + 1, *x[:5], *totals) for i, x in enumerate(pairs[:k])] or [(item, 0, *[None] * 5, 0, 0, 0)]
    return Counter(found)


def made_rows(seed, low, high, n=400):
    rng = random.Random(seed)
    price = lambda: rng.choice([round(rng.uniform(low, high), 2), low, float(round(rng.uniform(low, high)))])
    lines = [(rng.choice([None, *range(40)]), rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 1, 1, *range(12)]), q := rng.choice([None, 0, -2, 1, 1, 3, 7]), rng.choice([None, price() * (q or 1), price() * (q or 1)])) for _ in range(n)]
    lines += [lines[5], lines[5], (1, 1, 2, 1, math.nan), (1, 1, 2, 1, math.inf), (1, 1, 2, 1, 1e300), (1, 1, 2, 1, -low)]
    items = [(rng.choice([None, *range(12)]), rng.choice([None, price(), price()])) for _ in range(60)] + [(1, low), (1, low), (3, math.nan), (3, -math.inf), (4, 1e299), (5, -low), (6, 0.0)]
    return lines, items


@pytest.mark.parametrize(("seed", "low", "high", "band", "k"), [(1, 0.5, 9.0, (100, 1, 1000), 2), (2, 990.0, 1010.0, (100, 1, 1000), 2), (3, 999_000.0, 1_001_000.0, (100, 1, 1000), 3), (4, 0.01, 0.4, (7, 1, 50), 1), (5, 80.0, 120.0, (0, 3, 10), 2), (6, 1.0, 3.0, (15, 0, 1), 5)])
def test_band_join_brute_force(spark, seed, low, high, band, k):
    lines, items = made_rows(seed, low, high)
    left = spark.createDataFrame([(*x, "a", "b", "c") for x in lines], LINES)
    right = spark.createDataFrame([(*x, "a", "b") for x in items], ITEMS)
    found = band_join.band_join(left, right, band_join.Band(*band), k)
    assert Counter(map(tuple, found.collect())) == brute_band(lines, items, *band, k)


def test_band_join_empty(spark):
    lines, items = spark.createDataFrame([], LINES), spark.createDataFrame([(1, 2.0, "a", "b"), (None, None, "a", "b")], ITEMS)
    assert [tuple(r)[1:] for r in band_join.band_join(lines, items).collect()] == [(0, *[None] * 5, 0, 0, 0)] * 2
    assert band_join.band_join(lines, items.where("false")).count() == 0
    with pytest.raises(ValueError):
        band_join.Band(5, 2, 2)


def test_shards_of_intervals_are_complete_and_few(spark):
    band = band_join.Band(100, 1, 1000)
    rng = random.Random(3)
    rows = [(p,) for p in [0, 1, -1, 99, 100, 101, 9_999, 99_999, 100_000, 10**9, 10**12 + 7, -250, *(rng.randrange(10 ** rng.randrange(2, 8)) for _ in range(60))]]
    found = spark.createDataFrame(rows, "p long").select("p", band.low(F.col("p")).alias("low"), band.high(F.col("p")).alias("high"))
    found = found.select("*", band.shards(F.col("low"), F.col("high")).alias("shards"), F.transform(F.sequence("low", "high", F.greatest(F.lit(1).cast("long"), F.col("p") / 100_000).cast("long")), band.shard).alias("all"))
    for r in found.collect():
        assert set(r["all"]) <= set(r["shards"]) and len(r["shards"]) <= 5


def test_trie_against_lists():
    rng = random.Random(9)
    us = sorted(rng.sample(range(-300, 5000), 400))
    trie = band_join.DigitTrie([(u, n := rng.randrange(1, 5), rng.randrange(99), [(u, i, i) for i in range(n)]) for u in us])
    counts = {u: len(trie.lines[u]) for u in us}
    for _ in range(200):
        low, high = sorted(rng.sample(range(-400, 5200), 2))
        p = rng.randint(low, high)
        inside = [u for u in us if low <= u <= high]
        assert trie.totals(low, p, high)[:2] == (sum(counts[u] for u in inside), sum(counts[u] * abs(u - p) for u in inside))
        assert list(trie.nearest(low, p, high)) == sorted(inside, key=lambda u: (abs(u - p), u))


# 12


def plain_words(text):
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]


def brute_draw(docs, target, longest, buckets, least, percent):
    features = lambda t: [b" ".join(w[i : i + n]) for w in [plain_words(t)] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(zlib.crc32(f) % buckets for f in features(text))
    for text in target:
        t.update(zlib.crc32(f) % buckets for f in features(text))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for doc_id, text in docs:
        own = [gain(zlib.crc32(f) % buckets) for f in features(text)]
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(own) // len(own) if own else 0
        rows.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = len(able) * percent // 100
    return Counter([(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(able)] + [(*r[:4], None) for r in rows if not r[4]])


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_brute_force(spark, hard, sample, longest, monkeypatch):
    monkeypatch.setattr(resampling, "STRETCH", 50)
    docs = hard.select("doc_id", "text").unionByName(sample.select("doc_id", "text").limit(60))
    target = sample.select("text", F.lit("x").alias("n")).limit(5)
    rows = [tuple(r) for r in docs.collect()]
    found = resampling.resample(docs, target, longest, 500, 5, 30)
    assert Counter(map(tuple, found.collect())) == brute_draw(rows, [r["text"] for r in target.collect()], longest, 500, 5, 30)


def test_trie_is_renewed_without_loss(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(40))).encode() for _ in range(50)]
    whole = resampling.Trie(2, 97)
    monkeypatch.setattr(resampling, "NODES", 10)
    monkeypatch.setattr(resampling, "STRETCH", 7)
    small, gain = resampling.Trie(2, 97), list(range(97))
    for text in texts:
        small.count(text)
        w = resampling.words(text)
        pairs = [b" ".join(w[i : i + 2]) for i in range(len(w) - 1)]
        assert resampling.Trie(2, 97, gain).score(text) == (len(w), len(w) + len(pairs), sum(zlib.crc32(f) % 97 for f in w + pairs))
    monkeypatch.setattr(resampling, "NODES", 10**6)
    for text in texts:
        whole.count(text)
    assert small.bucket_totals().tolist() == whole.bucket_totals().tolist()


def test_resampling_empty(none, hard):
    assert resampling.resample(none, hard).count() == 0
    found = resampling.resample(hard, none)
    assert found.count() == hard.count()


# 13


def check_shards(rows, found, shards):
    text = defaultdict(list)
    for doc_id, t in rows:
        text[doc_id, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())].append(t or "")
    assert Counter((d, s, c) for d, s, c, _, _ in found) == Counter({k: len(v) for k, v in text.items()})
    slots, held = defaultdict(list), Counter()
    for _, size, _, shard, slot in found:
        slots[shard].append(slot)
        held[shard] += size
    assert all(0 <= s < shards and sorted(v) == list(range(len(v))) for s, v in slots.items())
    share = sum(held.values()) / shards
    groups = Counter()
    for _, size, crc, _, _ in found:
        groups[size, crc] += size
    # Groups larger than a share are cut, others stay together.
    slack = max([*(n for n in groups.values() if n <= share), *(s for _, s, _, _, _ in found)])
    assert all(abs(held[s] - share) <= slack for s in range(shards))
    places = defaultdict(set)
    for _, size, crc, shard, _ in found:
        places[size, crc].add(shard)
    assert all(len(p) == 1 for k, p in places.items() if groups[k] <= share)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_sharding_hard_rows(hard, sample, shards):
    docs = hard.select("doc_id", "text").unionByName(sample.select("doc_id", "text"))
    found = [tuple(r) for r in sharding.balanced(docs.withColumn("shard", F.lit("x")), shards).collect()]
    check_shards([tuple(r) for r in docs.collect()], found, shards)


def test_sharding_of_copies(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(10**6), "the one text" * 3 if rng.random() < 0.4 else f"text {rng.randrange(500)} " * rng.randrange(1, 9)) for _ in range(3000)]
    found = [tuple(r) for r in sharding.balanced(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()]
    check_shards(rows, found, 10)


def test_sharding_empty(none):
    assert sharding.balanced(none, 7).count() == 0
