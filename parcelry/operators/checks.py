"""Validation: row status, counts of violations, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.codes import NO_METRO, wrong_width
from ..functions.measures import boost_wrong, rent_off

COMPARE = {">": lambda c, a, b: c > a, ">=": lambda c, a, b: c >= a, "<": lambda c, a, b: c < a, "<=": lambda c, a, b: c <= a, "=": lambda c, a, b: c == a, "between": lambda c, a, b: c.between(a, b)}


def where(df: DataFrame, column: str, op: str, a: object, b: object = None) -> DataFrame:
    """Rows whose column compares so; fractions are stored from 0 to 1."""
    return df.filter(COMPARE[op](F.col(column), a, b))


def actionable(df: DataFrame, action: str = "action", codes: Sequence[str] = ("1", "3"), fields: str | None = None, least: int = 85) -> DataFrame:
    """Rows with one of the action codes, and with `least` fields where an array of fields, or their number, is named."""
    out = df.filter(F.col(action).isin(*codes))
    if fields is None:
        return out
    return out.filter((F.size(fields) if isinstance(df.schema[fields].dataType, ArrayType) else F.col(fields)) >= least)


def with_status(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """Adds row_status (KEEP or SKIP) and skip_reason, the reasons that hold, each ended by a semicolon. No row goes."""
    text = F.concat(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{name};")).otherwise("") for name, bad in reasons.items()])
    return df.withColumn("skip_reason", text).withColumn("row_status", F.when(F.col("skip_reason") == "", "KEEP").otherwise("SKIP"))


def without_trailers(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def count_checks(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check_name, n_bad), one row per check, from one pass."""
    names = list(checks)
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"c{i}").alias("n_bad")) for i, n in enumerate(names)])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def row_floor(df: DataFrame, least: int) -> None:
    if (n := df.count()) < least:
        raise ValueError(f"{n} rows; at least {least} are needed")


def row_floors(tables: Mapping[str, tuple[DataFrame, int]]) -> DataFrame:
    """(dataset, n_rows, least, is_enough) of several tables, by name, with the least number of rows of each."""
    out = None
    for name, (df, least) in tables.items():
        one = df.agg(F.lit(name).alias("dataset"), F.count("*").alias("n_rows"), F.lit(least).cast("long").alias("least")).withColumn("is_enough", F.col("n_rows") >= F.col("least"))
        out = one if out is None else out.unionByName(one)
    return out


def designation_checks(flag: str, code: str, width: int, boost_col: str | None = None, limit: str | None = None, rent: str | None = None) -> dict[str, Column]:
    """Domain, width, boost and rent checks for count_checks."""
    out = {"flag_domain": ~F.col(flag).cast("int").isin(0, 1), "code_width": wrong_width(F.col(code), width)}
    if boost_col:
        out["boost"] = boost_wrong(F.col(flag).cast("boolean"), F.col(boost_col))
    if limit and rent:
        out["rent"] = rent_off(F.col(limit), F.col(rent))
    return out


def monotone(columns: Sequence[str]) -> Column:
    """True unless a value is less than the one before it."""
    xs = F.array(*[F.col(c) for c in columns])
    n = len(columns)
    return F.forall(F.zip_with(F.slice(xs, 1, n - 1), F.slice(xs, 2, n - 1), lambda a, b: a <= b), lambda ok: F.coalesce(ok, F.lit(True)))


def limit_checks(columns: Sequence[str], code: str) -> dict[str, Column]:
    """Errors: no code, a null or non-positive limit. Warning: not monotone."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | (F.col(c) <= 0)
    return {"error_code": F.col(code).isNull(), "error_limit": bad, "warn_monotone": ~monotone(columns)}


def leak_checks(columns: Sequence[str]) -> dict[str, Column]:
    """Values that betray a missed cleaning: the no-metro sentinel, `.0` endings, `nan` strings."""
    out: dict[str, Column] = {}
    for c in columns:
        out[f"{c}_sentinel"] = F.col(c) == NO_METRO
        out[f"{c}_decimal"] = F.col(c).rlike(r"\.0$")
        out[f"{c}_nan"] = F.lower(F.col(c)).isin("nan", "none")
    return out


def is_territory(code: Column, prefixes: Sequence[str], name: Column, word: str) -> Column:
    """The code begins with one of the prefixes (all of one length), or the name contains the word in any case."""
    by_code = F.substring(code, 1, len(prefixes[0])).isin(*prefixes)
    return F.coalesce(by_code, F.lit(False)) | F.coalesce(F.contains(F.lower(name), F.lit(word.lower())), F.lit(False))


def unexpected(df: DataFrame, column: str, allowed: Sequence[object]) -> DataFrame:
    """Rows whose value is none of those allowed; null is none of them."""
    return df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def width_violations(df: DataFrame, id_col: str, widths: Mapping[str, int]) -> DataFrame:
    """(id, column_name, value) of codes of a wrong width."""
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"), wrong_width(F.col(c), w).alias("bad")) for c, w in widths.items()])
    return df.select(id_col, F.explode(each).alias("x")).filter("x.bad").select(id_col, "x.column_name", "x.value")
