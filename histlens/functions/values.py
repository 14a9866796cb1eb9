"""Small scalar helpers: versions, chains, confidence, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENCE = ("ambiguous", "inferred", "direct")


def version_parts(text: Column) -> Column:
    """Three numbers of a version such as v1.2.3; null if it isn't one."""
    parts = [F.try_to_number(F.regexp_extract(text, r"^v?(\d+)\.(\d+)\.(\d+)", k), F.lit("9" * 18)).cast("long") for k in (1, 2, 3)]
    return F.when(text.rlike(r"^v?\d+\.\d+\.\d+"), F.array(*parts))


def is_newer(candidate: Column, current: Column) -> Column:
    a, b = version_parts(candidate), version_parts(current)
    newer = F.lit(False)
    same = F.lit(True)
    for k in range(3):
        newer = newer | (same & (F.get(a, F.lit(k)) > F.get(b, F.lit(k))))
        same = same & (F.get(a, F.lit(k)) == F.get(b, F.lit(k)))
    return F.coalesce(newer, F.lit(False))


def ends_with(chain: Column, suffix: Column) -> Column:
    """Whether a chain of names ends in the suffix."""
    return (F.size(suffix) > 0) & (F.size(chain) >= F.size(suffix)) & (F.slice(chain, F.greatest(F.size(chain) - F.size(suffix) + 1, F.lit(1)), F.size(suffix)) == suffix)


def confidence_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CONFIDENCE)), name) - 1


def lower_confidence(*names: Column) -> Column:
    """The weakest of these."""
    rank = F.least(*map(confidence_rank, names))
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), (rank + 1).cast("int"))


def prefixes(dotted: Column, most: int = 3) -> Column:
    """Lower-case dotted prefixes of up to `most` parts, shortest first."""
    parts = F.filter(F.split(F.lower(dotted), r"\."), lambda x: x != "")
    n = F.least(F.size(parts), F.lit(most))
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ".")))


def percent(share: Column) -> Column:
    return F.concat(F.round(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 100).cast("int").cast("string"), F.lit("%"))


def bar(share: Column, width: int = 20) -> Column:
    filled = F.round(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), F.lit(width) - filled))


SPARKS = " .:-=+*#"


def sparkline(counts: Column) -> Column:
    """A character for each count, scaled to the largest."""
    top = F.greatest(F.array_max(counts), F.lit(1))
    level = lambda n: F.ceil(n * (len(SPARKS) - 1) / top).cast("int") + 1
    return F.array_join(F.transform(counts, lambda n: F.substring(F.lit(SPARKS), level(n), F.lit(1))), "")
