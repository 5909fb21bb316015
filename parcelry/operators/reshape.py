"""Wide and long layouts, packed strings, token streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import Scan


def program_rows(df: DataFrame, blocks: Mapping[str, str], ids: Sequence[str], persons: int = 8, limit: str = "limit_{}person") -> DataFrame:
    """Column blocks <prefix>1.. to one row per program with limit_1person.., in one pass."""
    each = [F.struct(F.lit(program).alias("program_type"), *[F.col(f"{prefix}{n}").alias(limit.format(n)) for n in range(1, persons + 1)]) for prefix, program in blocks.items()]
    return df.select(*ids, F.explode(F.array(*each)).alias("x")).select(*ids, "x.*")


def household_rows(df: DataFrame, ids: Sequence[str], persons: int = 8, limit: str = "limit_{}person") -> DataFrame:
    """limit_1person.. to rows (household_size, income_limit)."""
    each = F.array(*[F.struct(F.lit(n).alias("household_size"), F.col(limit.format(n)).alias("income_limit")) for n in range(1, persons + 1)])
    return df.select(*ids, F.explode(each).alias("x")).select(*ids, "x.*")


def numbered_entities(df: DataFrame, text: str, ids: Sequence[str]) -> DataFrame:
    """`003-Baldwin 005-Barbour` to rows (entity_code, entity_name)."""
    part = F.explode(F.split(F.trim(F.col(text)), r",?\s+(?=\d{3}-)"))
    return df.select(*ids, part.alias("p")).filter(F.col("p").rlike(r"^\d{3}-")).select(*ids, F.regexp_extract("p", r"^(\d{3})-", 1).alias("entity_code"), F.trim(F.regexp_extract("p", r"^\d{3}-(.*?),?$", 1)).alias("entity_name"))


def zip_rows(df: DataFrame, text: str, ids: Sequence[str]) -> DataFrame:
    """A line with several five-digit codes to one row each."""
    codes = F.filter(F.split(F.col(text), r"[\s,;]+"), lambda t: t.rlike(r"^\d{5}$"))
    return df.select(*ids, F.explode(codes).alias("zcta"))


def token_names(df: DataFrame, group: str, place: str, token: str, endings: Sequence[str], block: Column | None = None) -> DataFrame:
    """Tokens of each group, in order, joined and split after each token that is an ending word: rows (group, place,
    name), title case. Tokens after the last ending are left out before any are collected, so only the tokens of one
    name meet in a row. With a block (see scans) one group is many tasks."""
    is_end = F.coalesce(F.col(token).rlike(rf"^(?:{'|'.join(endings)})$"), F.lit(False))
    scan = Scan(df.withColumn("__end", is_end.cast("int")), [group], [place], block)
    pieces = scan.counted("__upto", F.col("__end"), "__all").rows().withColumn("__piece", (F.col("__upto") - F.col("__end")).cast("int")).filter("__piece < __all")
    words = F.transform(F.array_sort(F.collect_list(F.struct(place, token))), lambda x: x[token])
    joined = pieces.groupBy(group, "__piece").agg(F.array_join(words, " ").alias("t"))
    return joined.select(group, F.col("__piece").alias("place"), F.initcap(F.lower(F.trim("t"))).alias("name"))
