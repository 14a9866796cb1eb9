"""Hash columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def salted(value: Column, salt: str) -> Column:
    """SHA-256 of salt then value, without a separator."""
    return F.sha2(F.concat(F.lit(salt), value), 256)


def author_list_hash(emails: Column) -> Column:
    """SHA-256 of the distinct emails in order, one a line."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(emails)), "\n"), 256)


def leaf(data: bytes) -> bytes:
    return hashlib.sha256(b"\0" + data).digest()


def node(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\1" + left + right).digest()


def tree_root(hashes: list[bytes]) -> bytes:
    """Root over leaf or subtree hashes: level by level, a lone last node moves up as it is."""
    if not hashes:
        return hashlib.sha256(b"").digest()
    while len(hashes) > 1:
        pairs = [node(a, b) for a, b in zip(hashes[::2], hashes[1::2])]
        hashes = pairs + hashes[len(hashes) // 2 * 2 :]
    return hashes[0]


def canonical_json(text: Column) -> Column:
    """A JSON text without spaces, its keys in order at every depth and numbers in their shortest form: variants hold objects so."""
    return F.to_json(F.parse_json(text))


def content_hash(bundle: Column) -> Column:
    """SHA-256 of a bundle's canonical JSON without times of making it, age and shallow flag; the order of fields doesn't count."""
    kept = bundle.dropFields("created_at", "attestation.confirmed_at", "repo.age_days", "repo.shallow")
    return F.sha2(canonical_json(F.to_json(kept)), 256)
