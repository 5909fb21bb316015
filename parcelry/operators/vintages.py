"""Yearly files with changing layouts: one table of candidate names drives a projection per year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


@dataclass(frozen=True)
class Field:
    """A target column: candidate source names, where {y}, {y-1}, ... stand for the year or one before it (two digits: {yy-1})."""

    name: str
    candidates: Sequence[str]
    kind: str = "string"
    required: bool = False


# Target columns of the yearly designation files and the names that they had, latest first.
TRACT_FIELDS = (
    Field("tract_fips", ("tract_id", "tract_id_{yy-3}", "tract_id_{yy-4}", "tract_id_20", "fips"), required=True),
    Field("state_fips", ("state", "statefp")),
    Field("county_fips", ("stcnty",)),
    Field("source_pk", ("qct_id",)),
    Field("cbsa_code", ("cbsa",)),
    Field("is_metro_tract", ("metro", "metrotct"), "int"),
    Field("area_population", ("area_pop", "areapop"), "double"),
    Field("is_designated", ("qct",), "int", True),
    Field("split_tr_flag", ("split_tr", "splittr"), "int"),
    Field("fmr_area_code", ("cbsasub{yy-3}", "cbsasub24", "cbsasub")),
    Field("poverty_rate_at_designation", ("pov_rate_{yy-3}", "povertyrate_{yy-3}", "pov_rate", "povrate"), "double", True),
    Field("income_criterion_ratio", ("inc_factor_{yy-3}", "icpercent_{yy-3}", "inc_factor", "pctinc"), "double", True),
    Field("vlil4_current", ("vlil4_{y-3}", "vlil4_{yy-3}", "vlil_4_person_{yy-3}", "vlil_4_person_{y-3}", "vlil_4_person", "amgi60pc", "pr4_60pc", "trinclim"), "double", True),
    Field("p1", ("p1", "p0010001", "pop100"), "double", True),
    Field("p5", ("p5", "p0420001", "p087002", "p015001", "groupqtr"), "double", True),
    Field("h1", ("h1", "p0150001", "p016001"), "double"),
    Field("poverty_rate_vintage_minus1", ("pov_rate_{yy-4}", "povertyrate_{yy-4}"), "double"),
    Field("poverty_rate_vintage_minus2", ("pov_rate_{yy-5}", "povertyrate_{yy-5}"), "double"),
    Field("income_criterion_ratio_minus1", ("inc_factor_{yy-4}", "icpercent_{yy-4}"), "double"),
    Field("income_criterion_ratio_minus2", ("inc_factor_{yy-5}", "icpercent_{yy-5}"), "double"),
    Field("median_hh_income", ("b19013est1_{yy-3}", "b19013est1", "medfminc"), "double"),
    Field("median_hh_income_moe", ("b19013me1_{yy-3}", "b19013me1"), "double"),
)
METRO_AREA_FIELDS = (
    Field("zcta_code", ("zip code tabulation area (zcta)", "zcta"), required=True),
    Field("safmr_2br", ("{y-1} final 40th percentile 2-bedroom safmr", "fy{y-1} adjusted 2-bedroom safmr", "fy{y-1} final 40th percentile 2-bedroom safmr"), "double", True),
    Field("population_in_qct", ("zcta population also in {y} qct", "population also in {y} qct", "zcta population also in {y-1} qct", "population also in {y-1} qct"), "double", True),
    Field("effective_population", ("zcta population not in {y} qct", "population not in {y} qct", "zcta population not in {y-1} qct", "population not in {y-1} qct"), "double", True),
    Field("vlil_4person", ("{y-1} 4-person vlil", "{y-1} 4-person very low income limit (vlil)", "fy{y-1} 4-person vlil"), "double", True),
    Field("is_designated", ("{y} sdda (1=sdda)",), "int", True),
)
NON_METRO_FIELDS = (
    Field("county_fips", ("fips",)),
    Field("fmr_2br", ("fy{y-1} final 40th percentile 2-bedroom fmr",), "double", True),
    Field("population_in_qct", ("population also in {y} qct", "population also in {y-1} qct", "pop in qct"), "double", True),
    Field("effective_population", ("effective pop", "population not in {y} qct", "population not in {y-1} qct"), "double", True),
    Field("vlil_4person", ("{y-1} 4-person very low income limit (vlil)", "{y-1} 4-person vlil"), "double", True),
    Field("is_designated", ("{y} nmdda",), "int", True),
)


def _named(pattern: str, year: int) -> str:
    out = pattern
    for back in range(10):
        tail = "" if back == 0 else f"-{back}"
        out = out.replace("{y" + tail + "}", str(year - back)).replace("{yy" + tail + "}", f"{(year - back) % 100:02d}")
    return out.lower()


def harmonise(df: DataFrame, year: int, fields: Sequence[Field], year_col: str = "year") -> DataFrame:
    """The fields of one year's file under their target names: the first candidate present, in any case; a typed null
    where none is. A missing required field is an error."""
    present = {c.strip().lower(): c for c in df.columns}
    out = []
    for f in fields:
        found = next((present[n] for n in (_named(c, year) for c in f.candidates) if n in present), None)
        if found is None and f.required:
            raise ValueError(f"{year}: no column for {f.name}")
        out.append((F.col(f"`{found}`").try_cast(f.kind) if found else F.lit(None).cast(f.kind)).alias(f.name))
    return df.select(*out, F.lit(year).alias(year_col))


def harmonised_union(files: Mapping[int, DataFrame], fields: Sequence[Field]) -> DataFrame:
    """All years under one layout."""
    out = None
    for year, df in sorted(files.items()):
        one = harmonise(df, year, fields)
        out = one if out is None else out.unionByName(one)
    return out


def of_year(bundle: DataFrame, year_col: str, year: int) -> DataFrame:
    """The rows of one year of a file that holds several. A year that is a number is compared as one, so a partitioned
    bundle is read in that year's folder only; as a string it may have spaces around it."""
    kind = bundle.schema[year_col].dataType
    if isinstance(kind, IntegralType):
        return bundle.filter(F.col(year_col) == F.lit(year).cast(kind))
    return bundle.filter(F.trim(F.col(year_col).cast("string")) == str(year))


#: Years that a request table may name and still be sent to all tasks.
MOST_YEARS = 10_000


def of_years(bundle: DataFrame, year_col: str, requests: DataFrame, request_year: str) -> DataFrame:
    """The rows of the years that a request table names. They are few and sent to all tasks, so Spark reads only their
    folders of a partitioned bundle (dynamic partition pruning); beyond MOST_YEARS distinct ones it is a plain join."""
    years = requests.select(F.col(request_year).cast(bundle.schema[year_col].dataType).alias("__year")).filter("__year > 0").distinct()  # a comparison: only behind one does Spark prune
    few = years.limit(MOST_YEARS + 1).count() <= MOST_YEARS
    return bundle.join(F.broadcast(years) if few else years, F.col(year_col) == F.col("__year"), "left_semi")


def sheet_union(sheets: Sequence[DataFrame], distinct: bool = False) -> DataFrame:
    """All rows of sheets whose columns may differ; missing ones are null."""
    out = sheets[0]
    for s in sheets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.distinct() if distinct else out
