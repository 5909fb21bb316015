"""Typed questions, each in a batch form: requests are a DataFrame and the answer is one join over all of them.

Predicates on the optional side are applied before a left join, never after it, so a request without a match stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keep import keep_best


def optional(requests: DataFrame, facts: DataFrame, on: Sequence[str], columns: Sequence[str], only: Column | None = None) -> DataFrame:
    """Every request with the columns of the facts that match it on `on` and satisfy `only`, or nulls."""
    side = (facts.filter(only) if only is not None else facts).select(*[F.col(c).alias(f"__{c}") for c in on], *columns)
    cond = [F.col(c) == F.col(f"__{c}") for c in on]
    return requests.join(side, cond, "left").drop(*[f"__{c}" for c in on])


def required(requests: DataFrame, facts: DataFrame, on: Sequence[str], columns: Sequence[str], only: Column | None = None) -> DataFrame:
    """Only the requests that match."""
    side = (facts.filter(only) if only is not None else facts).select(*on, *columns)
    return requests.join(side, list(on))


def status(requests: DataFrame, designations: DataFrame, on: Sequence[str], flag: str, columns: Sequence[str]) -> DataFrame:
    """The requests with flag (false without a designation) and the designation's columns where it is designated."""
    found = optional(requests, designations, on, [flag, *columns], F.col(flag))
    return found.withColumn(flag, F.coalesce(flag, F.lit(False)))


def either_kind(metro: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both kinds of area in one table, with dda_kind."""
    return metro.select(*columns, F.lit("metro").alias("dda_kind")).unionByName(other.select(*columns, F.lit("non_metro").alias("dda_kind")))


def with_fallback(requests: DataFrame, first: DataFrame, first_on: Sequence[str], second: DataFrame, second_on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The columns of the first source, or of the second where it has none; answered_by says which."""
    a = optional(requests, first.withColumn("__hit1", F.lit(True)), first_on, [*columns, "__hit1"])
    b = second.withColumn("__hit2", F.lit(True)).select(*[F.col(c).alias(f"__o_{c}") for c in second_on], *[F.col(c).alias(f"__2_{c}") for c in columns], "__hit2")
    both = a.join(b, [F.col(c) == F.col(f"__o_{c}") for c in second_on], "left").drop(*[f"__o_{c}" for c in second_on])
    use = F.col("__hit1").isNotNull()
    out = both.withColumn("answered_by", F.when(use, "first").when(F.col("__hit2").isNotNull(), "second"))
    out = out.withColumns({c: F.when(use, F.col(c)).otherwise(F.col(f"__2_{c}")) for c in columns})
    return out.drop("__hit1", "__hit2", *[f"__2_{c}" for c in columns])


def one_risk(card: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of risk per key: that with most applications."""
    return keep_best(card, keys, "total_applications", ["risk_id"])


def trend(requests: DataFrame, card: DataFrame, key: str, year: str, columns: Sequence[str]) -> DataFrame:
    """One row per request (key, start_year, end_year) and year of its range, both ends included; is_gap marks years without data."""
    years = requests.withColumn(year, F.explode(F.sequence("start_year", "end_year"))).drop("start_year", "end_year")
    found = optional(years, card.withColumn("__hit", F.lit(True)), [key, year], [*columns, "__hit"])
    return found.withColumn("is_gap", F.col("__hit").isNull()).drop("__hit")


def search(df: DataFrame, where: Column, order: Sequence[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Matching rows in order with total_count, the number of all of them; rows are cut only if a limit is given."""
    hits = df.filter(where)
    out = hits.withColumn("total_count", hits.agg(F.count("*")).scalar()).orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def both_sets(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b.select(*on), list(on), "left_semi")


def year_pair(df: DataFrame, key: str, year: str, first: int, second: int, only: Column | None = None) -> DataFrame:
    """key, in_first, in_second, in_both, first_only, second_only, from one conditional aggregation."""
    rows = (df.filter(only) if only is not None else df).filter(F.col(year).isin(first, second))
    g = rows.groupBy(key).agg(F.bool_or(F.col(year) == first).alias("in_first"), F.bool_or(F.col(year) == second).alias("in_second"))
    a, b = F.col("in_first"), F.col("in_second")
    return g.select(key, a, b, (a & b).alias("in_both"), (a & ~b).alias("first_only"), (b & ~a).alias("second_only"))


def side_by_side(df: DataFrame, key: str, year: str, years: Sequence[int], measure: str) -> DataFrame:
    """One column y<year> per year with the largest measure."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(year) == y, F.col(measure))).alias(f"y{y}") for y in years])


def run_sql(tables: dict[str, DataFrame], query: str) -> DataFrame:
    """A query whose {name} stand for the tables. No view of the session is made or replaced for good."""
    return next(iter(tables.values())).sparkSession.sql(query, **tables)
