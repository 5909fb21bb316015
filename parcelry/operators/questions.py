"""The typed questions with their parameters and defaults. Lookups take requests as a DataFrame and answer all of them
with one join; searches filter one table, so their predicates reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import either_kind, optional, with_fallback

#: The income program that is meant where none is named.
PROGRAM = "VLI"


def _all(*conditions: Column | None) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out if c is None else out & c
    return out


def check_dda(requests: DataFrame, metro: DataFrame, non_metro: DataFrame, columns: Sequence[str] = ("boost",)) -> DataFrame:
    """requests (code, county, year) with is_dda, dda_kind and columns: the metro area of the code and year where that is
    designated, else the non-metro area of the county and year; without either, is_dda is false and the rest null."""
    a = metro.filter("is_dda").select("code", "year", F.lit("metro").alias("dda_kind"), *columns)
    b = non_metro.filter("is_dda").select("county", "year", F.lit("non_metro").alias("dda_kind"), *columns)
    found = with_fallback(requests, a, ["code", "year"], b, ["county", "year"], ["dda_kind", *columns])
    return found.withColumn("is_dda", F.col("answered_by").isNotNull()).drop("answered_by")


def get_ami_limits(requests: DataFrame, limits: DataFrame, columns: Sequence[str], program: str = PROGRAM) -> DataFrame:
    """requests (area_code, county, year) with the limits of one program: those of the area code, else of the county."""
    one = limits.filter(F.col("program_type") == program)
    by_area = one.filter("area_code is not null").select("area_code", "year", *columns)
    by_county = one.filter("area_code is null").select("county", "year", *columns)
    return with_fallback(requests, by_area, ["area_code", "year"], by_county, ["county", "year"], columns).withColumn("program_type", F.lit(program))


def get_hmda_risk(requests: DataFrame, card: DataFrame, columns: Sequence[str]) -> DataFrame:
    """requests (cbsa_code, county_fips, assessment_year) with the risk of the metro area (its county with most
    applications), else of the county; answered_by is metro, county or null. The card is made once: each of its rows
    stands for its metro area and its county, and each request asks for both."""
    kinds = (("metro", "cbsa_code"), ("county", "county_fips"))
    each = lambda: F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("place")) for kind, c in kinds])).alias("e")
    answer = F.struct(*[F.col(c) for c in columns])
    known = card.select(each(), F.col("assessment_year").alias("__year"), F.struct(-F.col("total_applications"), F.col("risk_id")).alias("o"), answer.alias("a")).filter("e.place is not null")
    best = known.groupBy(F.col("e.kind").alias("__kind"), F.col("e.place").alias("__place"), "__year").agg(F.min_by("a", "o").alias("__answer"))
    asked = requests.withColumn("__request", F.monotonically_increasing_id()).withColumn("e", each()).withColumns({"__k": F.col("e.kind"), "__p": F.col("e.place")}).drop("e")
    joined = asked.join(best, (F.col("__k") == F.col("__kind")) & (F.col("__p") == F.col("__place")) & (F.col("assessment_year") == F.col("__year")), "left")
    found = F.when(F.col("__answer").isNotNull(), F.struct((F.col("__k") != "metro").alias("second"), F.col("__k").alias("kind"), F.col("__answer").alias("answer")))
    one = joined.groupBy(*requests.columns, "__request").agg(F.min_by(found, found["second"]).alias("f"))
    return one.select(*requests.columns, *[F.col(f"f.answer.{c}").alias(c) for c in columns], F.col("f.kind").alias("answered_by"))


def search_tracts(tracts: DataFrame, designations: DataFrame, year: int, county: str | None = None, state: str | None = None, is_qct: bool | None = None, is_dda: bool | None = None) -> DataFrame:
    """tracts (tract, county, state) with the year's is_qct and is_dda (false without a designation), filtered by what is given."""
    here = tracts.filter(_all(None if county is None else F.col("county") == county, None if state is None else F.col("state") == state))
    found = optional(here, designations.filter(F.col("year") == year), ["tract"], ["is_qct", "is_dda"])
    flags = found.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_qct", "is_dda")})
    return flags.filter(_all(None if is_qct is None else F.col("is_qct") == is_qct, None if is_dda is None else F.col("is_dda") == is_dda))


def search_dda_areas(metro: DataFrame, non_metro: DataFrame, year: int, state: str | None = None, columns: Sequence[str] = ("code", "area_name")) -> DataFrame:
    """Designated areas of both kinds in a year, and in a state if one is given."""
    where = _all(F.col("is_dda"), F.col("year") == year, None if state is None else F.col("state") == state)
    return either_kind(metro.filter(where), non_metro.filter(where), columns)


def search_hmda_risk(card: DataFrame, year: int, tier: str | None = None, state: str | None = None) -> DataFrame:
    """Rows of the card in a year, of a tier and of a state (the first two digits of the county) if given."""
    return card.filter(_all(F.col("assessment_year") == year, None if tier is None else F.col("risk_tier") == tier, None if state is None else F.col("county_fips").startswith(state)))


def get_state_ami_limits(limits: DataFrame, state: str, year: int, program: str = PROGRAM) -> DataFrame:
    return limits.filter((F.col("state") == state) & (F.col("year") == year) & (F.col("program_type") == program))


def get_special_program_limits(limits: DataFrame, year: int, area_code: str | None = None, area_name: str | None = None, state: str | None = None, usual: Sequence[str] = ("ELI", "VLI", "LI")) -> DataFrame:
    """Limits of a year outside the usual programs, by area code, part of the area's name (in any case) or state."""
    named = None if area_name is None else F.contains(F.lower("area_name"), F.lit(area_name.lower()))
    return limits.filter(_all(F.col("year") == year, ~F.col("program_type").isin(*usual), None if area_code is None else F.col("area_code") == area_code, named, None if state is None else F.col("state") == state))
