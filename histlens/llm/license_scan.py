"""License scan: an exact set-similarity join of text blocks with license templates.

Only DataFrame functions are used.  A block of a template is what a window of
SPREAD times as many words as the template has shows of the text, wherever the
window lies, however the text is wrapped; windows may hang over the text's ends.
A template matches a block that contains at least NUMERATOR/DENOMINATOR of its
distinct words and, in order (of first places), all of its required runs of words,
but none of the words that tell another license of its family from it.  Words are ordered by
the number of documents that hold them, rarest first; then

prefix filter: with need = ceil(share * |T|) a block holds one of the first
    |T| - need + 1 words of T, so only stretches with one of those are joined;
length filter: a stretch with fewer than need words of any template is out;
positional filter: from the first common word, at position p of T and q of the
    stretch's template words, at most min(|T| - p, |B| - q) words are common.

Stretches of STRETCH words, and as many more as the widest window has, are dealt
out as rows, so a long text is no large row; each window belongs to the stretch
in which it starts.  What passes the filters is verified exactly, window by
window.  The templates are a fixed list, so the word counts that are collected
and the index that is broadcast are bounded by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, select_columns

NUMERATOR, DENOMINATOR = 4, 5
#: A window holds this many times a template's words, so that a word put before each (a comment's leader on each line) leaves room for all.
SPREAD = 2
STRETCH = 128
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# What public licenses and the usual notices that name them say; what a match must hold, in order ("a+b": one after the other, or with one word between, as a comment's leader); words it must not.
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_WORK = "this work is licensed under the gnu {} version {}"
_COMMONS = "this work is licensed under a creative commons {} 4 0 international license"
_SPDX = "spdx license identifier {}"
_GNU_NAMES = (
    ("gpl-2", "general public license", "2", "gnu general+public version+2", "lesser affero library"),
    ("gpl-3", "general public license", "3", "gnu general+public version+3", "lesser affero library"),
    ("lgpl-2", "library general public license", "2", "gnu library+general version+2", "affero"),
    ("lgpl-2.1", "lesser general public license", "2 1", "gnu lesser+general version+2+1", "affero"),
    ("lgpl-3", "lesser general public license", "3", "gnu lesser+general version+3", "affero"),
    ("agpl-3", "affero general public license", "3", "gnu affero+general version+3", "lesser"),
)
_COMMONS_NAMES = (
    ("cc-by", "attribution", "creative attribution", "sharealike noncommercial noderivatives nc sa nd"),
    ("cc-by-sa", "attribution sharealike", "creative attribution+sharealike", "noncommercial nc"),
    ("cc-by-nd", "attribution noderivatives", "creative attribution+noderivatives", "noncommercial nc"),
    ("cc-by-nc", "attribution noncommercial", "creative attribution+noncommercial", "sharealike noderivatives sa nd"),
    ("cc-by-nc-sa", "attribution noncommercial sharealike", "creative noncommercial+sharealike", ""),
    ("cc-by-nc-nd", "attribution noncommercial noderivatives", "creative noncommercial+noderivatives", ""),
)
_SHORT_COMMONS = (("cc-by", "cc by 4 0", "nc sa nd"), ("cc-by-sa", "cc by sa 4 0", "nc"), ("cc-by-nd", "cc by nd 4 0", "nc"), ("cc-by-nc", "cc by nc 4 0", "sa nd"), ("cc-by-nc-sa", "cc by nc sa 4 0", ""), ("cc-by-nc-nd", "cc by nc nd 4 0", ""))
_IDENTIFIERS = (
    ("mit", "mit"), ("apache-2", "apache 2 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("isc", "isc"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl-2", "lgpl 2 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3", "lgpl 3 0"), ("agpl-3", "agpl 3 0"),
    ("mpl-2", "mpl 2 0"), ("epl-2", "epl 2 0"), ("unlicense", "unlicense"), ("cc0", "cc0 1 0"),
)
TEMPLATES = (
    ("mit", "released under the mit license", "under mit+license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted charge", ""),
    ("apache-2", "licensed under the apache license version 2 0", "apache+license version+2", ""),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache+license file except compliance", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary forms", ""),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file", "governed bsd+style", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission fee granted", ""),
    *((label, _WORK.format(name, version), must, without) for label, name, version, must, without in _GNU_NAMES),
    *((label, _GNU.format(name, version), must, without) for label, name, version, must, without in _GNU_NAMES),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla+public 2", ""),
    ("epl-2", "this program is made available under the terms of the eclipse public license 2 0", "eclipse+public 2", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered public+domain", ""),
    *((label, _COMMONS.format(name), must, without) for label, name, must, without in _COMMONS_NAMES),
    *((label, f"licensed under {name}", name.replace(" ", "+"), without) for label, name, without in _SHORT_COMMONS),
    *((label, _SPDX.format(name), "spdx identifier+" + name.replace(" ", "+"), without) for label, name, without in (*((x, y, "") for x, y in _IDENTIFIERS), *_SHORT_COMMONS)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived copyright", ""),
)


def required_runs(required: str) -> list[str]:
    """Regular expressions of the runs in a template's third part, over words with spaces around each."""
    return [f" {run.replace('+', ' (?:[^ ]+ )?')} " for run in required.split()]


def _lowered(text: Column) -> Column:
    """A-Z lower-cased.  lower() differs from that only on letters beyond ASCII, which never make a phrase's or template's word but for the Kelvin sign."""
    return F.when(F.contains(text, F.lit("K")), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _distinct(words: str) -> list[str]:
    return sorted(set(words.split()))


def _needed(n: int) -> int:
    return -(-n * NUMERATOR // DENOMINATOR)


def word_counts(docs: DataFrame) -> dict[str, int]:
    """The number of documents that hold each template word."""
    vocabulary = sorted({w for _, t, _, _ in TEMPLATES for w in t.split()})
    rows = docs.select(F.explode(F.array_intersect(F.split(_lowered(F.col("text")), NOT_WORD), _texts(vocabulary))).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in rows}


def _starts(phrase: str) -> Column:
    """Positions in `words` at which the phrase starts."""
    first, *rest = phrase.split()
    words = F.col("words")

    def here(word: Column, i: Column) -> Column:
        found = word == first
        for k, w in enumerate(rest, 1):
            found &= F.get(words, i + k) == w
        return F.when(found, i)

    places = F.filter(F.transform(words, here), lambda x: x.isNotNull())
    return F.when(F.array_contains(words, first), places).otherwise(F.array().cast("array<int>"))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs(doc_id, text).

    score is the largest containment of a template that reaches the threshold,
    or 0.  Null text is empty text, without words, labels or score.  Rows that
    repeat id and text get equal results; an empty table gives an empty result;
    other columns are ignored.
    """
    docs = select_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    counts = word_counts(docs)
    order = sorted(counts, key=lambda w: (counts[w], w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for label, text, required, without in TEMPLATES:
        words = sorted(_distinct(text), key=rank.__getitem__)
        need = _needed(len(words))
        index += [(words[p], label, p, words, words[:p], need, required_runs(required), without.split(), SPREAD * len(text.split()), required.replace("+", " ").split()) for p in range(len(words) - need + 1)]
    prefixes = sorted({x[0] for x in index})
    least = min(x[5] for x in index)
    reach = max(x[8] for x in index)

    # One pass over the texts: base places, and stretches that hold a prefix word and enough template words.
    split = docs.select("doc_id", F.xxhash64("text").alias("key"), _lowered(F.col("text")).alias("text")).withColumn("words", F.split("text", NOT_WORD))
    edge = F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0)
    split = split.withColumn("n_words", (F.size("words") - edge - F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)).cast("long"))
    starts = {label: _starts(phrase) for phrase, label in PHRASES.items()}
    begins = F.sequence(F.lit(0), F.size("words") - 1, F.lit(STRETCH))
    stretches = F.transform(begins, lambda i: F.struct((i == 0).alias("front"), F.slice("words", i + 1, STRETCH + reach).alias("run")))
    stretches = F.filter(stretches, lambda x: F.arrays_overlap(x["run"], _texts(prefixes)) & (F.size(F.array_intersect(_texts(order), x["run"])) >= least))
    nothing = F.array().cast("array<struct<front:boolean,run:array<string>>>")
    scanned = split.select(
        "doc_id", "key", "n_words", edge.alias("edge"), *[s.alias(label) for label, s in starts.items()],
        F.when(F.arrays_overlap("words", _texts(prefixes)), stretches).otherwise(nothing).alias("stretches"),
    )
    scanned = checkpointed(scanned)

    spark = docs.sparkSession
    rows = spark.createDataFrame(index, "word string, label string, p int, tokens array<string>, before array<string>, need int, required array<string>, without array<string>, span int, needed array<string>")
    hits = scanned.select("doc_id", "key", F.explode("stretches").alias("x")).select("doc_id", "key", "x.*").withColumn("block", F.array_intersect(_texts(order), F.col("run")))
    hits = hits.withColumn("word", F.explode(F.array_intersect(F.col("block"), _texts(prefixes))))
    pairs = hits.join(F.broadcast(rows), "word").where(~F.arrays_overlap("block", "before"))
    q = F.array_position("block", F.col("word")) - 1
    pairs = pairs.where((F.size("block") >= F.col("need")) & (F.least(F.size("tokens") - F.col("p"), F.size("block") - q) >= F.col("need")))
    pairs = pairs.where((F.size(F.array_intersect("tokens", "block")) >= F.col("need")) & (F.size(F.array_except("needed", "run")) == 0))

    def common(start: Column) -> Column:
        """The template's words in the window from there, 0 unless it holds the required runs in order and no word that it must not."""
        window = F.slice("run", F.greatest(start, F.lit(0)) + 1, F.col("span") + F.least(start, F.lit(0)))
        spelt = F.concat(F.lit(" "), F.array_join(window, " "), F.lit(" "))
        places = F.transform("required", lambda run: F.regexp_instr(spelt, run))
        return F.when((F.array_min(places) > 0) & (F.array_sort(places) == places) & ~F.arrays_overlap("without", window), F.size(F.array_intersect("tokens", window))).otherwise(0)

    windows = F.sequence(F.when(F.col("front"), 1 - F.col("span")).otherwise(0), F.least(F.lit(STRETCH), F.size("run")) - 1)
    found = pairs.withColumn("common", F.array_max(F.transform(windows, common))).where("common >= need")
    matched = found.groupBy(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key")).agg(F.collect_set("label").alias("found"), F.max(F.col("common") / F.size("tokens")).alias("score"))

    joined = scanned.join(matched, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")), "left")
    places = F.concat(*[F.col(f"`{label}`") for label in starts])
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(F.col(f"`{label}`")) > 0, F.lit(label)) for label in starts])))
    return joined.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
        (F.array_min(places) - F.col("edge")).cast("long").alias("first_word"), (F.array_max(places) - F.col("edge")).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
