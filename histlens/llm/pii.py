"""Personal data by weak supervision.

Base spans of four kinds come from fixed patterns.  Wider patterns propose more
candidates, among them many numbers that are no personal data; labelers then
vote on every candidate, base or not: the pattern that proposed it, a gazetteer
of words that name such data, a gazetteer of words that name other numbers, the
words before it, its check digits and shape.

Expectation-maximisation over the counts of (kind, votes) of the whole corpus,
of which there are few, estimates each labeler's reliability for and against,
and gives every vote pattern a probability.  These are the soft labels of a
logistic span classifier that sees more than the votes: the span's character
shape, length and digit groups, and the words next to it, all hashed.  So it can
tell candidates apart whose votes are equal, and find some on which the votes
are undecided.  It is fit on at most `SAMPLE` distinct (kind, votes, features),
taken by hash and weighted by their count in the whole corpus.

Candidates that it accepts are added where they overlap no base span and no
accepted span before them; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lean_worker, select_columns, texts

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider patterns of candidates, by kind; each is anchored at its first character and bounded in length.
_LOOSE_DOT = r"(?: ?[\[(]\.[\])] ?| ?[\[(]dot[\])] ?| dot | \. )"
WIDE = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,4}")),
    (1, re.compile(rf"(?<![\w.:-])[0-9]{{1,3}}(?:{_LOOSE_DOT}[0-9]{{1,3}}){{3}}(?![\w-])")),
    (1, re.compile(r"(?<![\w.:-])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:-])")),
    (2, re.compile(r"(?<![\w.-])(?:[0-9]{4}[ ./_-]{1,2}){3}[0-9]{4}(?![\w-]|\.[0-9])")),
    (3, re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![\w-]|\.[0-9])")),
    (3, re.compile(r"(?<![\w+.-])[0-9]{9,13}(?![\w-]|\.[0-9])")),
)

# Gazetteers of lower-case words within the 40 characters before a candidate.
NAMED = {
    "email": frozenset("email e-mail mail contact write correo courriel kontakt".split()),
    "ip": frozenset("ip address host server client login adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit payment tarjeta carte karte".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax whatsapp telefono telefon handy".split()),
}
OTHERWISE = frozenset("version release isbn issn order invoice ticket build section chapter page commit id sku serial token patent".split())
PERSONAL = frozenset("my his her their your me him contact reach call mr mrs ms dr name customer patient user account".split())
_WORD = re.compile(r"[a-z-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, by start, then kind.  Linear in the text, whatever it holds."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        # A match starts at the first character of the run before the sign that no earlier match took.
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            done = m.end()
            found.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    for m in NUMBERS.finditer(text):
        if m[0].count(".") >= 3:
            parts, start = m[0].split("."), m.start()
            # A chain of numbers gives a match for each whole four of them.
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    found.append((start, 1, end))
                start = end + 1
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


LABELERS = ("pattern", "named", "otherwise", "personal", "shape", "alone")


#: Features are numbers below this: 0 for all candidates, then votes, then hashed ones.
WIDTH = 1 << 12
SAMPLE = 20_000


def features(kind: int, votes: int, text: str, start: int, end: int, before: list[str]) -> list[int]:
    """What the classifier sees of a candidate, as numbers below WIDTH."""
    span = text[start:end]
    after = _WORD.findall(text[end : end + 24].lower())
    shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "9", span))
    seen = [
        "shape:" + shape[:32], "groups:" + ",".join(str(len(g)) for g in re.findall("[0-9]+", span)[:8]), f"length:{len(span) // 4}", f"digits:{len(_digits(span))}", "marks:" + "".join(sorted(set(shape) - {"9", "a"})),
        "front:" + shape[:1], "last:" + " ".join(before[-1:]), "second:" + " ".join(before[-2:-1]), "next:" + " ".join(after[:1]), "left:" + text[max(0, start - 1) : start],
    ]
    own = [1 + 2 * i + (v == 1) for i in range(len(LABELERS)) if (v := votes >> 2 * i & 3)]
    return sorted({0, *own, *(16 + zlib.crc32(f"{kind}:{x}".encode()) % (WIDTH - 16) for x in seen)})


def candidates(text: str) -> list[tuple[int, int, int, int, bool, list[int]]]:
    """(start, kind, end, votes, is base, features), by start: votes has two bits a labeler: 0 abstains, 1 against, 2 for."""
    found = [(*s, True) for s in base_spans(text)]
    starts = [s for s, *_ in found]
    ends = list(accumulate((e for _, _, e, _ in found), max))
    spelled = any(x in text for x in (" at ", "[at]", "(at)"))
    for kind, pattern in WIDE:
        for m in pattern.finditer(text) if kind or spelled else ():
            last = bisect_left(starts, m.end()) - 1
            if last < 0 or ends[last] <= m.start():
                found.append((m.start(), kind, m.end(), False))
    out = []
    for start, kind, end, is_base in sorted(set(found)):
        span = text[start:end]
        before = _WORD.findall(text[max(0, start - 40) : start].lower())
        near, digits = set(before), _digits(span)
        if kind == 0:
            shape = 2 if "@" in span or "[at]" in span or "(at)" in span else 1
        elif kind == 1:
            numbers = re.findall("[0-9]+", span)
            shape = 2 if ":" in span or not any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in numbers) else 1
        elif kind == 2:
            shape = 2 if luhn(digits) and len(set(digits)) > 2 else 1
        else:
            shape = 2 if span[0] in "+(" or span.count("-") == 2 else 0 if 9 <= len(digits) <= 13 and len(digits) < len(span) else 1
        alone = 1 if text[end : end + 1].isalnum() or start and text[start - 1].isalnum() else 2
        votes = (2 if is_base else 0, 2 if near & NAMED[KINDS[kind]] else 0, 1 if near & OTHERWISE else 0, 2 if near & PERSONAL else 0, shape, alone)
        number = sum(v << 2 * i for i, v in enumerate(votes))
        out.append((start, kind, end, number, is_base, features(kind, number, text, start, end, before)))
    return out


def _votes(patterns: np.ndarray) -> np.ndarray:
    """Votes of each pattern: a row of 0, 1, 2."""
    return np.stack([patterns >> 2 * i & 3 for i in range(len(LABELERS))], axis=1)


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """By expectation-maximisation: each labeler's chance of each vote (for true, for false), and the probability of each pattern.

    Starts from the majority of votes.  One class may be empty; smoothing keeps all chances above 0.
    """
    truth = np.clip(0.5 + 0.15 * ((votes == 2).sum(axis=1) - 2.0 * (votes == 1).sum(axis=1)), 0.05, 0.95)
    chances = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        weights = np.stack([counts * truth, counts * (1 - truth)])
        prior = (weights.sum(axis=1) + 1) / (weights.sum() + 2)
        for c in range(2):
            for v in range(3):
                # Smoothing leans to the labeler's meaning: a vote for is likelier of true candidates.
                lean = 1.0 if v == 0 else 2.0 if (v == 2) == (c == 0) else 0.5
                chances[c, :, v] = ((votes == v) * weights[c][:, None]).sum(axis=0) + lean
        chances /= chances.sum(axis=2, keepdims=True)
        logs = np.stack([np.log(prior[c]) + np.log(chances[c, np.arange(votes.shape[1]), votes]).sum(axis=1) for c in range(2)])
        truth = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
    return chances, truth


def train(rows: list[list[int]], truth: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic classifier of soft labels, by gradient steps with momentum on the mean loss; rows are lists of features."""
    lengths = [len(r) for r in rows]
    owner, at = np.repeat(np.arange(len(rows)), lengths), np.concatenate([np.array(r, np.int64) for r in rows])
    share, weights, moved = counts / counts.sum(), np.zeros(WIDTH), np.zeros(WIDTH)
    for _ in range(rounds):
        made = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights[at], len(rows)), -50, 50)))
        moved = 0.9 * moved - 0.1 * (np.bincount(at, (share * (made - truth))[owner], WIDTH) + 1e-4 * weights)
        weights = weights + moved
    return weights


FOUND = "array<struct<start int, kind int, end int, votes int, base boolean, features array<int>>>"


def _found(docs: DataFrame) -> DataFrame:
    names = (("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("votes", pa.int32()), ("base", pa.bool_()), ("features", pa.list_(pa.int32())))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            rows = [candidates(t.decode()) for t in texts(batch["text"])]
            offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
            columns = list(zip(*(c for r in rows for c in r))) or [()] * len(names)
            inner = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, names)], [n for n, _ in names])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(offsets, inner)], ["doc_id", "found"])

    rows = select_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(made, f"doc_id long, found {FOUND}")


def fitted(found: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """The classifier's weights for each kind that has candidates.

    Counts of (kind, votes) cover all candidates, and are few whatever the
    corpus; of the distinct features `sample` rows are collected at most.
    """
    every = found.select(F.explode("found").alias("c"))
    counts = every.groupBy("c.kind", "c.votes").count().collect()
    rows = every.groupBy("c.kind", "c.votes", "c.features").count().orderBy(F.xxhash64("kind", "votes", "features"), "kind", "votes", "features").limit(sample).collect()
    out = {}
    for kind in sorted({r["kind"] for r in rows}):
        mine = sorted((r["votes"], r["count"]) for r in counts if r["kind"] == kind)
        patterns, many = np.array([m[0] for m in mine]), np.array([m[1] for m in mine], float)
        _, truth = reliabilities(_votes(patterns), many)
        label = dict(zip(patterns.tolist(), truth))
        seen = sorted((r["votes"], list(r["features"]), r["count"]) for r in rows if r["kind"] == kind)
        out[kind] = train([x[1] for x in seen], np.array([label[x[0]] for x in seen]), np.array([x[2] for x in seen], float))
    return out


def chosen(row: list[dict], weights: dict[int, np.ndarray]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base spans and of accepted ones, by start, then kind; an accepted one starts after the accepted ones before it."""
    out, last = [], -1
    for c in row:
        if c["base"]:
            out.append((c["start"], c["kind"], c["end"]))
        elif c["start"] >= last and c["kind"] in weights and weights[c["kind"]][c["features"]].sum() >= 0:
            out.append((c["start"], c["kind"], c["end"]))
            last = c["end"]
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans for each row of docs(doc_id, text).

    Spans are kind:start:end in code points, by start, then kind as in KINDS,
    comma-joined.  Null text is empty text, without spans.  Repeated rows come
    out once each; an empty table gives an empty result; other columns are
    ignored.
    """
    found = checkpointed(_found(docs))
    weights = fitted(found)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        for batch in batches:
            out = []
            for row in batch["found"].to_pylist():
                base = [(c["start"], c["kind"], c["end"]) for c in row if c["base"]]
                out.append((*(sum(k == n for _, k, _ in base) for n in range(len(KINDS))), hashlib.sha256(write(base).encode()).hexdigest(), write(chosen(row, weights))))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(columns[i], kind) for i, kind in enumerate([pa.int64()] * 4 + [pa.string()] * 2))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return found.mapInArrow(made, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
