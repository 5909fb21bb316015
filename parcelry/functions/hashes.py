"""Hashes of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(columns: Sequence[str]) -> Column:
    """SHA-256 of the canonical JSON of the columns as strings, in the order of their names; null is the empty string."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def fast_hash(columns: Sequence[str]) -> Column:
    """64-bit hash as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.xxhash64(*[F.col(c) for c in sorted(columns)]))), 16, "0")
