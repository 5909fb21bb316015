"""Roll-ups of detail rows to areas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def roll_up(df: DataFrame, area: str, order: Sequence[str], first: Sequence[str] = (), largest: Sequence[str] = (), total: Sequence[str] = (), count: Mapping[str, str] | None = None) -> DataFrame:
    """One row per area, null areas dropped: first non-null values in the order, maxima, sums (0 if all are null) and counts."""
    place = F.struct(*[F.col(c) for c in order])
    aggs: list[Column] = [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in first]
    aggs += [F.max(c).alias(c) for c in largest] + [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in total]
    aggs += [F.count(c).alias(n) for n, c in (count or {}).items()]
    return df.dropna(subset=[area]).groupBy(area).agg(*aggs)


def inconsistent(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys under which a column has more than one value, with the number of values of each column."""
    n = {c: f"n_{c}" for c in columns}
    g = df.groupBy(*keys).agg(*[F.count_distinct(c).alias(n[c]) for c in columns])
    return g.filter(F.greatest(*[F.col(x) for x in n.values()], F.lit(0)) > 1)


def to_area(df: DataFrame, keys: Sequence[str], least: Sequence[str], modal: Sequence[str], keep_null_keys: bool = False) -> DataFrame:
    """One row per key: minima of `least` (their only value once inconsistent() is empty) and modes (ties: the smallest)."""
    rows = df if keep_null_keys else df.dropna(subset=list(keys))
    return rows.groupBy(*keys).agg(*[F.min(c).alias(c) for c in least], *[F.mode(c, deterministic=True).alias(c) for c in modal])


def frequency(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def ranked_counts(df: DataFrame, by: str, k: int | None = None) -> DataFrame:
    """Counts by value, most first (ties by value); all of them unless k is given."""
    out = df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(by))
    return out if k is None else out.limit(k)


def distinct_areas(df: DataFrame, area: str) -> DataFrame:
    return df.agg(F.count_distinct(area).alias("n_areas"))


def year_coverage(datasets: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """dataset, first_year, last_year, n_years, n_rows."""
    out = None
    for name, (df, year) in datasets.items():
        one = df.select(year.alias("y")).agg(F.min("y").alias("first_year"), F.max("y").alias("last_year"), F.count_distinct("y").alias("n_years"), F.count("*").alias("n_rows")).select(F.lit(name).alias("dataset"), "*")
        out = one if out is None else out.unionByName(one)
    return out
