"""Keeping one row per key, duplicates, first values in an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ascending `order`, which should be total."""
    return _ranked(df, keys, [F.col(c).asc_nulls_last() for c in order])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in ascending `order`."""
    return _ranked(df, keys, [F.col(c).desc_nulls_last() for c in order])


def keep_best(df: DataFrame, keys: Sequence[str], best: str, ties: Sequence[str]) -> DataFrame:
    """The row of each key with the largest `best` (ties: the least of `ties`). Rows with a null key stay as they are."""
    missing = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1
    # rows with a null key are dealt by all their values, so that they do not meet in one task
    marked = df.withColumn("__open", F.when(missing, F.xxhash64(*df.columns)))
    w = Window.partitionBy(*keys, "__open").orderBy(F.col(best).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties])
    return marked.withColumn("__rank", F.row_number().over(w)).filter(F.col("__open").isNotNull() | (F.col("__rank") == 1)).drop("__rank", "__open")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once, with the count as n_rows."""
    return df.withColumn("n_rows", F.count("*").over(Window.partitionBy(*keys))).filter("n_rows > 1")


def first_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], drop_null_keys: bool = True) -> DataFrame:
    """One row per key: each column's first non-null value in the order."""
    if drop_null_keys:
        df = df.dropna(subset=list(keys))
    place = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])
