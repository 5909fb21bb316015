"""Content hashes that add up: the hash of a table is updated from the rows that came and went.

A row's SHA-256 gives LANES numbers of 60 bits. A table's hash is the number of its rows and, lane by lane, the sum of
its rows' numbers modulo 2^60 (an additive hash of a multiset, 240 bits): it doesn't depend on order, equal rows count as
often as they occur, and hashes of disjoint parts add up to that of the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import fingerprint

LANES, DIGITS = 4, 15
PARTS = tuple(f"lane_{i}" for i in range(LANES))


def _modulo(total: Column) -> Column:
    """As a decimal, so that sums of 2^60 rows fit into its 38 digits."""
    return F.pmod(total, F.lit(1 << 60).cast("decimal(38,0)")).cast("decimal(38,0)")


def _lane(fingerprint_col: Column, i: int) -> Column:
    return F.conv(F.substring(fingerprint_col, 1 + i * DIGITS, DIGITS), 16, 10).cast("long")


def _sum_of(lane: Column, sign: Column | None) -> Column:
    """The sum of lanes modulo 2^60. Rows add up thirds of 20 bits as longs, which hold those of 2^43 rows; decimals come after."""
    thirds = [F.shiftright(lane, 20 * k).bitwiseAND((1 << 20) - 1) for k in range(3)]
    sums = [F.sum(t if sign is None else sign.cast("long") * t).cast("decimal(20,0)") for t in thirds]
    return _modulo(sums[0] + _modulo(sums[1] * F.lit(1 << 20).cast("decimal(8,0)")) + _modulo(sums[2] * F.lit(1 << 40).cast("decimal(13,0)")))


def hash_parts(columns: Sequence[str], sign: Column | None = None) -> dict[str, Column]:
    """Aggregates n_rows and one sum a lane. sign: 1 for rows that came, -1 for rows that went."""
    one = F.lit(1) if sign is None else sign
    whole = fingerprint(columns)
    return {"n_rows": F.sum(one.cast("long"))} | {name: _sum_of(_lane(whole, i), sign) for i, name in enumerate(PARTS)}


def parts_of(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), sign: Column | None = None) -> DataFrame:
    """(by, n_rows, lanes) from one aggregation, partial before the shuffle."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in hash_parts(columns, sign).items()])


def merged(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds up parts; those of removed rows are negative (parts_of with sign -1)."""
    return parts.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), *[_modulo(F.sum(c)).alias(c) for c in PARTS])


def content_hash_of(prefix: str = "") -> Column:
    """The hash as 16 digits of the number of rows and 15 of each lane, hexadecimal, in lower case."""
    digits = [F.lpad(F.hex(F.coalesce(F.col(f"{prefix}n_rows"), F.lit(0).cast("long"))), 16, "0"), *[F.lpad(F.hex(F.coalesce(F.col(f"{prefix}{c}"), F.lit(0)).cast("long")), DIGITS, "0") for c in PARTS]]
    return F.lower(F.concat(*digits))


def row_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, columns, sign): what an upsert of new (one row a key) takes from old and adds to it. Keys that new repeats
    unchanged cancel out and are left away."""
    touched = old.join(new.select(*keys), list(keys), "left_semi").select(*keys, *columns, F.lit(-1).alias("sign"))
    both = touched.unionByName(new.select(*keys, *columns, F.lit(1).alias("sign")))
    return both.groupBy(*keys, *columns).agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0")
