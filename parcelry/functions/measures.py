"""Derived measures as column expressions. Ratios over zero or null are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOOST = 30
RENT_SHARE = 0.03


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def trigger(designated: Column, income_ratio: Column, poverty_rate: Column) -> Column:
    """both, poverty, income or area_constraint for designated rows, else none."""
    poor, low = F.coalesce(poverty_rate >= 0.25, F.lit(False)), F.coalesce(income_ratio < 1.0, F.lit(False))
    return F.when(~F.coalesce(designated, F.lit(False)), "none").when(poor & low, "both").when(poor, "poverty").when(low, "income").otherwise("area_constraint")


def boost(designated: Column) -> Column:
    return F.when(designated, F.lit(BOOST)).otherwise(F.lit(0))


def boost_wrong(designated: Column, boost_pct: Column) -> Column:
    return F.coalesce(boost_pct, F.lit(-1)) != boost(designated)


def trend(now: Column, before: Column) -> Column:
    return now - before


def direction(t: Column) -> Column:
    return F.when(t.isNull(), "unknown").when(t < -0.05, "improving").when(t > 0.05, "worsening").otherwise("stable")


def estimate_cv(moe: Column, estimate: Column) -> Column:
    return F.try_divide(F.abs(moe) / 1.645, F.nullif(estimate.cast("double"), F.lit(0.0)))


def reliable(cv: Column) -> Column:
    return F.coalesce(cv < 0.30, F.lit(False))


def share_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def max_rent(limit_4person: Column, program: Column | None = None) -> Column:
    """3 % of the 4-person limit; with a program, for VLI only."""
    rent = limit_4person * RENT_SHARE
    return rent if program is None else F.when(program == "VLI", rent)


def rent_off(limit_4person: Column, published: Column, within: float = 1.0) -> Column:
    """True where the computed rent misses the published one; nulls never do."""
    return F.coalesce(F.abs(limit_4person * RENT_SHARE - published) >= within, F.lit(False))


def overlap_share(inside: Column, total: Column) -> Column:
    return ratio(inside, total)


def is_minority(race: Column, ethnicity: Column) -> Column:
    return F.coalesce(race.isin("1", "2", "3", "4"), F.lit(False)) | F.coalesce(ethnicity == "1", F.lit(False))


def is_white_non_hispanic(race: Column, ethnicity: Column) -> Column:
    return F.coalesce((race == "5") & (ethnicity == "2"), F.lit(False))


def is_multifamily(units: Column) -> Column:
    return F.coalesce(units.isin("5-24", "25-49", "50-99", "100-149", ">149"), F.lit(False))


def is_gse(purchaser: Column) -> Column:
    return F.coalesce(purchaser.isin("1", "3"), F.lit(False))


def risk_score(disparity: Column, overall: Column, multifamily: Column) -> Column:
    """0.50, 0.30 and 0.20; 0.625 and 0.375 without a multifamily rate; null without the others."""
    full = disparity * 0.50 + overall * 0.30 + multifamily * 0.20
    return F.when(multifamily.isNotNull(), full).otherwise(disparity * 0.625 + overall * 0.375)


def tier(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score < 0.75, "low").when(score < 1.0, "moderate").when(score < 1.5, "elevated").otherwise("high")


def high_disparity(disparity: Column) -> Column:
    return F.coalesce(disparity > 2.0, F.lit(False))
