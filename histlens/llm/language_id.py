"""Language identification of mixed-language texts.

Every word gets a score for each language: the log-likelihood of its letter
bigrams, trigrams and itself, hashed to `BUCKETS`.  The word's script narrows
the candidates to languages that use it.  Viterbi over the words of a whole
text, with a penalty for each switch, labels spans; the language with most
letters is the text's.

The model is fit on at most `SAMPLE` labelled documents a language, taken by
hash of their id; its size is languages * BUCKETS numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean_worker, select_columns, texts

BUCKETS = 1 << 15
#: Labelled documents of each language that the model is fit on.
SAMPLE = 2000
#: Distinct labels, at about 50 bytes each, whose sampling rates are broadcast; more are joined by key.
BROADCAST_LANGUAGES = 50_000
#: What a change of language between two words costs, as log-likelihood.
SWITCH = 12.0
SMOOTHING = 0.1
#: Words times languages that one Viterbi pass holds, or one document if that is longer.
PASS_CELLS = 1 << 23
CACHE = 200_000
#: A language uses a script that has this share of its letters.
SCRIPT_SHARE = 0.02

# First and last code point of the scripts' main Unicode blocks.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3134F),
)
SCRIPT_NAMES = [*dict.fromkeys(s[0] for s in SCRIPTS), "other"]
_STARTS = np.array([s[1] for s in SCRIPTS])
_ENDS = np.array([s[2] for s in SCRIPTS])
_NUMBERS = np.array([SCRIPT_NAMES.index(s[0]) for s in SCRIPTS])


_ALPHA = np.array([chr(x).isalpha() for x in range(0x3400)])
_MIX = np.random.default_rng(7).integers(1, 1 << 20, 64)


def _is_alpha(points: np.ndarray) -> np.ndarray:
    found = _ALPHA[np.minimum(points, len(_ALPHA) - 1)]
    far = np.flatnonzero(points >= len(_ALPHA))
    found[far] = [chr(x).isalpha() for x in points[far]]
    return found


def _hash(*points: np.ndarray) -> np.ndarray:
    mixed = np.full(len(points[0]), len(points), np.uint64)
    for x in points:
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15) + x) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words without white space: letters of each, the script of most of them, and (word, bucket) of all features in word order."""
    text = "\n" + b"\n".join(words).decode("utf-8", "replace").lower() + "\n"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    cut = points == 10
    keep = cut | _is_alpha(points)
    points, cut = points[keep].astype(np.uint64), cut[keep]
    owner = np.cumsum(cut) - 1
    inner = np.flatnonzero(~cut)
    letters = np.bincount(owner[inner], minlength=len(words) + 1)[: len(words)]
    # Two and three neighbouring letters, with a word's ends as letters.
    two = np.flatnonzero(~(cut[:-1] & cut[1:]))
    own = [owner[two], owner[inner], np.flatnonzero(letters)]
    made = [_hash(points[two], points[two + 1]), _hash(points[inner - 1], points[inner], points[inner + 1])]
    place = inner - np.searchsorted(owner, owner[inner])
    whole = np.bincount(owner[inner], points[inner].astype(np.float64) * _MIX[place % 64], len(words) + 1)[own[2]]
    made.append(_hash(whole.astype(np.uint64)))
    own, made = np.concatenate(own), np.concatenate(made)
    order = np.argsort(own, kind="stable")
    at = np.searchsorted(_STARTS, points[inner], side="right") - 1
    script = np.where((at >= 0) & (points[inner] <= _ENDS[at]), _NUMBERS[at], len(SCRIPT_NAMES) - 1)
    n = len(SCRIPT_NAMES)
    scripts = np.bincount(owner[inner] * n + script, minlength=n * len(words))[: n * len(words)].reshape(-1, n).argmax(axis=1)
    return letters, scripts, own[order], made[order]


class Model:
    """languages; scores[bucket, language]; allowed[script, language]; prior[language]."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray, documents: np.ndarray) -> None:
        self.languages = languages
        smooth = counts + SMOOTHING
        self.scores = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
        if languages:
            self.scores -= self.scores.max(axis=1, keepdims=True)
        self.allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
        self.prior = np.log((documents + 1) / (documents + 1).sum())


def fit(labelled: DataFrame) -> Model:
    """From labelled(doc_id, text, lang): counts of hashed features of each language's sample."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPT_NAMES), 0)), np.zeros(0))
    spark = labelled.sparkSession
    # A little more than SAMPLE by hash, without a sort of a whole language; then exactly SAMPLE at most.
    rates = spark.createDataFrame([(k, min(1.0, 1.2 * SAMPLE / n)) for k, n in totals.items()], "lang string, rate double")
    hashed = known.withColumn("hash", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)))
    near = hashed.join(F.broadcast(rates) if len(languages) <= BROADCAST_LANGUAGES else rates, "lang").where(F.col("hash") < F.col("rate") * (1 << 30))
    sample = near.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))).where(F.col("turn") <= SAMPLE).select("lang", "text")
    number = {x: i for i, x in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS + len(SCRIPT_NAMES)), np.int64)
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), texts(batch["text"])):
                if words := Counter(text.split()):
                    times = np.array(list(words.values()))
                    letters, scripts, own, buckets = word_features(list(words))
                    total[number[lang]] += np.bincount(np.concatenate([buckets, BUCKETS + scripts]), np.concatenate([times[own], times * letters]), total.shape[1]).astype(np.int64)
        ks, xs = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ks.astype(np.int32)), pa.array(xs.astype(np.int32)), pa.array(total[ks, xs])], ["k", "x", "n"])

    rows = sample.mapInArrow(counted, "k int, x int, n long").groupBy("k", "x").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    counts[rows["x"].to_numpy(), rows["k"].to_numpy()] = rows["n"].to_numpy()
    return Model(languages, counts[:BUCKETS], counts[BUCKETS:], np.array([totals[x] for x in languages], float))


def viterbi(words: np.ndarray, lengths: np.ndarray, scores: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word.  words: rows of scores; documents follow one another, longest first.

    All documents advance together, a word a step.
    """
    k = scores.shape[1]
    starts = np.cumsum(lengths) - lengths
    running = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, int(lengths.max(initial=0)) + 1), side="left")
    came = np.empty((len(words), k), np.int16 if k > 127 else np.int8)
    value = np.repeat(prior[None].astype(np.float32), len(lengths), axis=0)
    own = np.arange(k)
    last = np.empty(len(lengths), np.int64)
    for step, n in enumerate(running):
        if n < len(value):
            last[n : len(value)] = value[n:].argmax(axis=1)
            value = value[:n]
        at = starts[:n] + step
        best = value.argmax(axis=1)
        jump = value[np.arange(n), best][:, None] - switch
        stays = value >= jump
        came[at] = np.where(stays, own, best[:, None])
        value = np.where(stays, value, jump) + scores[words[at]]
        value -= value.max(axis=1, keepdims=True)
    last[: len(value)] = value.argmax(axis=1)
    path = np.empty(len(words), np.int16)
    state = last
    for step in range(len(running) - 1, -1, -1):
        n = running[step]
        at = starts[:n] + step
        path[at] = state[:n]
        state[:n] = came[at, state[:n]]
    return path


class Labeler:
    """Scores of words, kept for a bounded number of them, and labels of texts."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((1024, len(model.languages)), np.float32)
        self.letters = np.zeros(1024, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        while len(self.known) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        letters, scripts, own, buckets = word_features(words)
        here = slice(first, first + len(words))
        self.letters[here] = letters
        self.rows[here] = 0
        some = np.flatnonzero(letters)
        if len(some) and self.model.languages:
            score = np.add.reduceat(self.model.scores[buckets], np.searchsorted(own, some))
            allowed = self.model.allowed[scripts[some]]
            # Languages that don't use the word's script are out, unless none does.
            score = np.where(allowed, score, score.min(axis=1, keepdims=True) - 100)
            self.rows[first + some] = np.where(allowed.any(axis=1, keepdims=True), score, 0)

    def label(self, batch: list[bytes]) -> list[tuple[str, float, str]]:
        """(language, share of letters, spans) of each text."""
        out: list[tuple[str, float, str]] = [("und", 0.0, "")] * len(batch)
        low = 0
        while low < len(batch):
            found, high, total = [], low, 0
            if len(self.known) > CACHE:
                self.known.clear()
            known = self.known
            while high < len(batch) and (high == low or total * len(self.model.languages) < PASS_CELLS):
                parts = batch[high].split()
                if unseen := [w for w in set(parts) if w not in known]:
                    self._learn(unseen)
                ids = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
                ids = ids[self.letters[ids] > 0] if len(ids) else ids
                if len(ids) and self.model.languages:
                    found.append((high, ids))
                    total += len(ids)
                high += 1
            found.sort(key=lambda x: -len(x[1]))
            if found:
                lengths = np.array([len(x[1]) for x in found], np.int64)
                words = np.concatenate([x[1] for x in found])
                path = viterbi(words, lengths, self.rows, self.model.prior)
                ends = np.cumsum(lengths)
                for (i, ids), end, n in zip(found, ends, lengths):
                    mine = path[end - n : end]
                    share = np.bincount(mine, self.letters[ids], len(self.model.languages))
                    cuts = np.flatnonzero(np.diff(mine)) + 1
                    spans = ",".join(f"{self.model.languages[mine[a]]}:{a}:{b}" for a, b in zip([0, *cuts], [*cuts, n]))
                    best = int(share.argmax())
                    out[i] = (self.model.languages[best], float(share[best] / share.sum()), spans)
            low = high
        return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, spans for each row of docs(doc_id, text).

    spans: language:first:end over the words that have a letter, comma-joined.
    score: the share of letters in spans of lang_pred.  Null texts and texts
    without a letter are `und` with score 0, as is every text of an empty model.
    Repeated rows come out once each; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        labeler = Labeler(sent.value)
        for batch in batches:
            rows = labeler.label(list(texts(batch["text"])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.string())))], ["doc_id", "lang_pred", "score", "spans"])

    rows = select_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(made, "doc_id long, lang_pred string, score double, spans string")


def is_held_out(column: str = "doc_id"):  # noqa: ANN201
    """Whether crc32 of the id as text is 2 modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2
