"""Schema enforcement from a table of column kinds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import clean_code, null_words

TYPES = {"bool": "boolean", "int": "int", "long": "long", "float": "double", "text": "string"}


def number(c: Column) -> Column:
    """A double from text with $ and commas; anything unreadable (nan too) is null."""
    d = F.regexp_replace(c.cast("string"), "[$,]", "").try_cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def whole(c: Column, kind: str = "long") -> Column:
    """Rounded half to even."""
    return F.rint(number(c)).try_cast(kind)


def truth(c: Column) -> Column:
    """True only for 1 and true; null is false."""
    t = F.lower(F.trim(c.cast("string")))
    return F.coalesce(t.isin("true", "1", "1.0"), F.lit(False))


def enforce(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """One projection: each column of `kinds` in its kind (bool, int, long, float, text, or code:<width>), in that
    order, null where df lacks it; other columns are left out."""
    def cast(name: str, kind: str) -> Column:
        if kind.startswith("code:"):
            return clean_code(F.col(name), int(kind[5:])) if name in df.columns else F.lit(None).cast("string")
        if name not in df.columns:
            return F.lit(False) if kind == "bool" else F.lit(None).cast(TYPES[kind])
        c = F.col(name)
        return {"bool": truth, "int": lambda x: whole(x, "int"), "long": whole, "float": number, "text": lambda x: null_words(x.cast("string"))}[kind](c)

    return df.select(*[cast(n, k).alias(n) for n, k in kinds.items()])


def padded_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """df with each missing column as a typed null."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in types.items() if n not in df.columns})
