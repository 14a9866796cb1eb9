"""Dictionaries of regular expressions against text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from re import _constants as constants
from re import _parser as parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.text import sanitised

KINDS = {"importPatterns": "import", "apiPatterns": "api", "configFilePatterns": "config"}


def patterns(signatures: DataFrame) -> DataFrame:
    """slug, kind, pattern: a row for each pattern."""
    rows = None
    for column, kind in KINDS.items():
        part = signatures.select("slug", F.lit(kind).alias("kind"), F.explode(column).alias("pattern"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.distinct()


#: A dictionary of so few expressions is evaluated as it is: looking for literals first costs more than it saves.
FEW = 32
#: Literals shorter than this are in most texts.
LEAST_LITERAL = 3


def required_literals(pattern: str) -> tuple[str, ...] | None:
    """Literals of which every match of a regular expression holds at least one; None if that can't be told.

    Read off the parsed expression: runs of plain characters outside of options,
    the longest of a sequence, or the best of every branch of a choice.  What does
    not read the same in both dialects (flags, classes by name, quoting) gives None.
    """
    if re.search(r"\(\?[a-zA-Z-]*[ix]|\\[QEpPhHRXk0-9]|&&", pattern):
        return None
    try:
        parsed = parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return None
    return None if parsed.state.flags & (re.IGNORECASE | re.VERBOSE) else _literals(parsed)


def _literals(parsed: Iterable) -> tuple[str, ...] | None:
    found: list[tuple[str, ...]] = []
    run = ""

    def end() -> None:
        nonlocal run
        if len(run) >= LEAST_LITERAL:
            found.append((run,))
        run = ""

    for op, value in parsed:
        if op is constants.LITERAL:
            run += chr(value)
            continue
        if op is constants.AT:
            continue  # a place between characters
        inner = None
        if op is constants.SUBPATTERN:
            inner = None if value[1] or value[2] else _literals(value[3])
        elif op in (constants.MAX_REPEAT, constants.MIN_REPEAT, constants.POSSESSIVE_REPEAT):
            inner = _literals(value[2]) if value[0] else None
        elif op is constants.BRANCH:
            branches = [_literals(x) for x in value[1]]
            inner = tuple(x for branch in branches for x in branch) if all(branches) else None
        end()
        if inner:
            found.append(inner)
    end()
    return max(found, key=lambda x: min(map(len, x)), default=None)


def _candidates(rules: list[tuple[str, str, str]]) -> Callable[[Column, Column], Column]:
    """A column of the numbers of rules (slug, kind, pattern) that text and path may match: one pass over each for all literals."""
    always, literals = [], {"text": {}, "path": {}}
    for i, (_, kind, pattern) in enumerate(rules):
        needed = required_literals(pattern)
        if needed is None:
            always.append(i)
        for literal in needed or ():
            literals["path" if kind == "config" else "text"].setdefault(literal, []).append(i)

    @F.arrow_udf(ArrayType(IntegerType()))
    def candidates(text: pa.Array, path: pa.Array) -> pa.Array:
        finders = {}
        for name, known in literals.items():
            if known:
                finders[name] = ahocorasick.Automaton()
                for literal, numbers in known.items():
                    finders[name].add_word(literal, numbers)
                finders[name].make_automaton()
        out = []
        for row in zip(text.to_pylist(), path.to_pylist(), strict=True):
            found = set(always)
            for name, value in zip(("text", "path"), row, strict=True):
                if value and name in finders:
                    for _, numbers in finders[name].iter(value):
                        found.update(numbers)
            out.append(sorted(found))
        return pa.array(out, pa.list_(pa.int32()))

    return candidates.asNondeterministic()


def matches(files: DataFrame, patterns: DataFrame, keys: list[str], text: str = "added_text", path: str = "path", clean: bool = True) -> DataFrame:
    """keys, slug for each file that any of a slug's patterns matches: config patterns on the path, others on the text.

    The dictionary's size is fixed, unlike the files'; it is read to the driver.
    With over FEW expressions, one pass over a text finds which literals it holds,
    and only the expressions whose required literal is there are evaluated; those
    without one always are.  Files are scanned once, never copied for each pattern,
    and nothing is shuffled.
    """
    rules = [tuple(r) for r in patterns.select("slug", "kind", "pattern").distinct().orderBy("slug", "kind", "pattern").collect()]
    rows = files.withColumn("__text", sanitised(F.col(text)) if clean else F.col(text))
    if not rules:
        return rows.select(*keys, F.lit(None).cast("string").alias("slug")).where("false")
    if len(rules) <= FEW:
        own: dict[str, Column] = {}
        for slug, kind, pattern in rules:
            one = F.coalesce((F.col(path) if kind == "config" else F.col("__text")).rlike(pattern), F.lit(False))
            own[slug] = own[slug] | one if slug in own else one
        found = F.array_compact(F.array(*[F.when(hit, F.lit(slug)) for slug, hit in own.items()]))
        return rows.select(*keys, F.explode(found).alias("slug"))
    rows = rows.withColumn("__maybe", _candidates(rules)(F.col("__text"), F.col(path)))
    of = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i + 1)
    slugs, kinds, expressions = zip(*rules, strict=True)
    hit = lambda i: F.coalesce(F.rlike(F.when(of(kinds, i) == "config", F.col(path)).otherwise(F.col("__text")), of(expressions, i)), F.lit(False))
    found = F.array_distinct(F.transform(F.filter("__maybe", hit), lambda i: of(slugs, i)))
    return rows.select(*keys, F.explode(found).alias("slug"))


def coverage(signatures: DataFrame) -> DataFrame:
    """slug, kind, pattern, covered: whether any positive fixture of its own matches the pattern."""
    fixtures = signatures.select("slug", F.explode("fixtures.positive").alias("f")).select("slug", "f.path", sanitised(F.col("f.diff")).alias("text"))
    joined = patterns(signatures).join(fixtures, "slug", "left")
    hit = F.when(F.col("kind") == "config", F.expr("path RLIKE pattern")).otherwise(F.expr("text RLIKE pattern"))
    return joined.groupBy("slug", "kind", "pattern").agg(F.coalesce(F.max(hit), F.lit(False)).alias("covered"))
