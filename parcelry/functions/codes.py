"""Geographic and program codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that mean "no value" in source files.
NULL_WORDS = ("", "NA", "nan", "NaN", "null", "None", "NULL")
#: The metro code of areas outside every metro area.
NO_METRO = "100000"


def null_words(c: Column) -> Column:
    """Trimmed text, null where it is one of NULL_WORDS."""
    t = F.trim(c)
    return F.when(~t.isin(*NULL_WORDS), t)


def _bare(c: Column) -> Column:
    """Trimmed text without one trailing `.0`, null for nan, none and empty in any case."""
    t = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(~F.lower(t).isin("nan", "none", ""), t)


def padded(c: Column, width: int) -> Column:
    """Zero-padded on the left; longer values stay whole."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def clean_code(c: Column, width: int) -> Column:
    """The digits of a code, zero-padded to width and never cut; null without digits."""
    digits = F.regexp_replace(_bare(c), "[^0-9]", "")
    return F.when(digits != "", padded(digits, width))


def clean_metro(c: Column, pad: bool = True) -> Column:
    """A metro code of digits only; the no-metro sentinel and anything else is null."""
    t = _bare(c)
    good = t.rlike("^[0-9]+$") & (t != NO_METRO)
    return F.when(good, padded(t, 5) if pad else t)


def county_of(tract: Column) -> Column:
    return F.substring(tract, 1, 5)


def state_of(code: Column) -> Column:
    return F.substring(code, 1, 2)


def metro_of_area(area_code: Column) -> Column:
    """The metro code inside METRO<cbsa>M<...> or <cbsa>M<...>, else null."""
    return F.nullif(F.regexp_extract(area_code, r"(?i)^(?:METRO)?(\d+)M", 1), F.lit(""))


def key(*parts: Column) -> Column:
    """Parts joined by underscores; null if any part is null."""
    out = parts[0].cast("string")
    for p in parts[1:]:
        out = F.concat(out, F.lit("_"), p.cast("string"))
    return out


def area_key(code: Column, name: Column, year: Column) -> Column:
    """code_year, or name_year for areas without a code."""
    return key(F.coalesce(code, name), year)


def wrong_width(c: Column, width: int) -> Column:
    return c.isNotNull() & (F.length(c) != width)
