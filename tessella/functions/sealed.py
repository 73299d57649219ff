"""Canonical JSON, and records sealed with a keyed hash."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.scalars import col

#: Bytes that SHA-256 takes at once.
BLOCK = 64


def canonical_json(c: Column | str) -> Column:
    """A JSON text with sorted keys at all depths and no blanks; null for other texts and for
    objects that repeat a key. Numbers keep their digits, so 1 and 1.0 differ.

    A variant keeps the fields of objects in the order of their names.
    """
    return F.to_json(F.try_parse_json(col(c)))


def stable_hash(c: Column | str) -> Column:
    """SHA-256 of the canonical JSON, in hex: equal for texts that differ in the order of keys."""
    return F.sha2(canonical_json(c).cast("binary"), 256)


def hmac_sha256(message: Column | str, secret: bytes) -> Column:
    """HMAC-SHA256 of a text or binary column, in hex; null for null. The padded secret is part of
    the plan: who may read plans may seal."""
    key = (hashlib.sha256(secret).digest() if len(secret) > BLOCK else secret).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    said = F.sha2(F.concat(inner, col(message).cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(said)), 256)


def seal(record: Column | str, secret: bytes) -> Column:
    """``subject`` (32 hex digits of the record's hash) and ``signature`` of a JSON record."""
    return F.struct(F.substring(stable_hash(record), 1, 32).alias("subject"), hmac_sha256(canonical_json(record), secret).alias("signature"))


def is_sealed(record: Column | str, signature: Column | str, secret: bytes) -> Column:
    """Whether the signature is that of the record, however its keys are ordered; false for nulls."""
    return F.coalesce(seal(record, secret)["signature"] == col(signature), F.lit(False))
