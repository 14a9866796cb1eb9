"""Column functions that clean source text before it is matched."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What a commented-out line starts with, in any language.
COMMENT_MARKS = ("//", "#", "/*", "*", "<!--", "--")
COMMENT_LINE = r"^[ \t\x0b\f\r]*(//|#|/\*|\*|<!--|--)"
LONGEST_LINE = 2000

_REGIONS = (re.compile(r"/\*.*?\*/", re.S), re.compile(r"`(?:[^`\\]|\\.)*`", re.S), re.compile(r'""".*?"""|\'\'\'.*?\'\'\'', re.S))
_NOT_BREAK = re.compile(r"[^\n]")


def blanked(match: re.Match) -> str:
    """Spaces of the match's length; line feeds stay, so positions and lines do."""
    return _NOT_BREAK.sub(" ", match[0])


def without_regions(text: str) -> str:
    """Block comments, template literals and triple-quoted strings blanked, in that order."""
    for region in _REGIONS:
        text = region.sub(blanked, text)
    return text


@F.arrow_udf(StringType())
def blank_regions(text: pa.Array) -> pa.Array:
    """F16: a blank for each character, which plain replacement can't give."""
    return pa.array([None if x is None else without_regions(x) for x in text.to_pylist()], pa.string())


def is_comment_line(line: Column) -> Column:
    return line.rlike(COMMENT_LINE)


def code_lines(text: Column) -> Column:
    """Lines that are no comments."""
    return F.filter(F.split(text, "\n"), lambda x: ~is_comment_line(x))


def blank_block_comments(text: Column) -> Column:
    """Block comments as spaces of their length; their line feeds stay, so no line joins another."""
    comment = r"(?s)/\*.*?\*/"
    blanks = F.transform(F.regexp_extract_all(text, F.lit(comment), F.lit(0)), lambda c: F.regexp_replace(c, r"[^\n]", " "))
    pieces = F.zip_with(F.split(text, comment), blanks, lambda piece, blank: F.concat(piece, F.coalesce(blank, F.lit(""))))
    return F.when(F.contains(text, F.lit("/*")), F.array_join(pieces, "")).otherwise(text)


def sanitised(text: Column) -> Column:
    """F19 after P7: what signature patterns are matched against."""
    short = F.filter(F.split(text, "\n"), lambda x: F.length(x) <= LONGEST_LINE)
    return F.array_join(code_lines(blank_block_comments(F.array_join(short, "\n"))), "\n")


def without_xml_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", " ")


def without_returns(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n", "\n")


def inside_string(before: Column) -> Column:
    """whether the text before a position, on its line, leaves a quote open.

    Escapes go, then balanced literals from the left; a quote that is left is open.
    """
    return F.regexp_replace(F.regexp_replace(before, r"(?s)\\.", ""), "'[^']*'|\"[^\"]*\"|`[^`]*`", "").rlike("['\"`]")


def is_label(text: Column) -> Column:
    """A private label: 1 to 64 characters after trimming, without control characters."""
    trimmed = F.trim(text)
    return F.length(trimmed).between(1, 64) & ~trimmed.rlike(r"[\x00-\x1f\x7f]")


def account_label(text: Column) -> Column:
    """the trimmed label, or null where it is none."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
    return F.when(F.length(trimmed).between(1, 64) & ~trimmed.rlike(r"[\x00-\x1f\x7f]"), trimmed)


# Our own patterns for the families of secrets that must never leave.
SECRETS = (
    ("aws_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("api_key", r"(?i)\b(api[_-]?key|token|secret)\b[\x22']?\s*[:=]\s*[\x22'][A-Za-z0-9_\-]{16,}[\x22']"),
    ("env_line", r"(?m)^[A-Z][A-Z0-9_]*(KEY|TOKEN|SECRET|PASSWORD)=[^\s]{8,}"),
)


def secret_family(text: Column) -> Column:
    """The first family of secret found, or null."""
    chain = None
    for name, pattern in SECRETS:
        chain = F.when(text.rlike(pattern), name) if chain is None else chain.when(text.rlike(pattern), name)
    return chain
