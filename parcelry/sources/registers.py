"""The yearly loan register: pipe lines without a header, in two layouts, read as one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import is_multifamily


def _numbered(name: str, first: int, last: int) -> tuple[str, ...]:
    return tuple(f"{name}{i}" for i in range(first, last + 1))


#: The first year of the shorter layout.
SHORT_SINCE = 2022
# The fields of a line by position, since SHORT_SINCE and before.
SHORT = (
    "activity_year", "lei", "action_taken", "loan_purpose", "loan_type", "preapproval", "lien_status", "loan_amount", "purchaser_type", "state_code", "county_code", "census_tract", "col_12",
    *_numbered("applicant_ethnicity_", 1, 4), *_numbered("co_applicant_ethnicity_", 1, 4), "applicant_ethnicity_5", "applicant_ethnicity_observed", "co_applicant_ethnicity_observed",
    *_numbered("applicant_race_", 1, 5), *_numbered("co_applicant_race_", 1, 5), "applicant_race_observed", "co_applicant_race_observed",
    "applicant_sex", "co_applicant_sex", "applicant_sex_observed", "co_applicant_sex_observed", "applicant_age", "applicant_age_above_62", "co_applicant_age", "co_applicant_age_above_62",
    "income", "col_45", "rate_spread", "hoepa_status", "applicant_credit_score_type", "co_applicant_credit_score_type", *_numbered("col_", 50, 54),
    "total_loan_costs", "total_points_and_fees", "origination_charges", "discount_points", "lender_credits", "interest_rate", "col_61", "debt_to_income_ratio", "combined_loan_to_value_ratio", "loan_term",
    "prepayment_penalty_term", "negative_amortization", "interest_only_payment", "balloon_payment", "other_nonamortizing_features", "property_value",
    "manufactured_home_secured_property_type", "manufactured_home_land_property_interest", "total_units", "multifamily_affordable_units", "submission_of_application", "initially_payable_to_institution",
    *_numbered("aus_", 1, 5), *_numbered("col_", 82, 84),
)
LONG = (
    "activity_year", "lei", "derived_msa_md", "state_code", "county_code", "census_tract", "derived_loan_product_type", "derived_dwelling_category", "conforming_loan_limit",
    "derived_ethnicity", "derived_race", "derived_sex", "action_taken", "purchaser_type", "preapproval", "loan_type", "loan_purpose", "lien_status", "reverse_mortgage", "open_end_line_of_credit",
    "business_or_commercial_purpose", "loan_amount", "combined_loan_to_value_ratio", "interest_rate", "rate_spread", "hoepa_status", "total_loan_costs", "total_points_and_fees", "origination_charges",
    "discount_points", "lender_credits", "loan_term", "prepayment_penalty_term", "intro_rate_period", "negative_amortization", "interest_only_payment", "balloon_payment", "other_nonamortizing_features", "property_value",
    "construction_method", "occupancy_type", "manufactured_home_secured_property_type", "manufactured_home_land_property_interest", "total_units", "applicant_age", "multifamily_affordable_units",
    "income", "debt_to_income_ratio", "applicant_credit_score_type", "co_applicant_credit_score_type", *_numbered("applicant_ethnicity_", 1, 5), *_numbered("co_applicant_ethnicity_", 1, 5),
    "applicant_ethnicity_observed", "co_applicant_ethnicity_observed", *_numbered("applicant_race_", 1, 5), *_numbered("co_applicant_race_", 1, 5), "applicant_race_observed", "co_applicant_race_observed",
    "applicant_sex", "co_applicant_sex", "applicant_sex_observed", "co_applicant_sex_observed", "applicant_age_above_62", "co_applicant_age", "co_applicant_age_above_62",
    "submission_of_application", "initially_payable_to_institution", *_numbered("aus_", 1, 5), *_numbered("denial_reason_", 1, 4),
    "tract_population", "tract_minority_population_percent", "ffiec_msa_md_median_family_income", "tract_to_msa_income_percentage", "tract_owner_occupied_units", "tract_one_to_four_family_homes", "tract_median_age_of_housing_units",
)
#: Where the shorter layout keeps the first denial reason.
SHORT_REASON = "col_82"


def layout_of(year: int) -> tuple[str, ...]:
    return SHORT if year >= SHORT_SINCE else LONG


def read_registers(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Lines of files of any years under one schema: the columns asked for (all of both layouts by default) as strings,
    then n_fields, the width of the line, and extra, the fields beyond its layout. The layout is that of the line's year,
    its first field; where that is no year, of its width. A column that a layout lacks is null, and so are those that a
    short line doesn't reach. `NA` stays text.

    Files are text to Spark, so a large one is read by many tasks, each from the first line that begins in its part, and
    only the fields asked for are taken out.
    """
    wanted = list(columns or dict.fromkeys((*SHORT, *LONG)))
    # a filter on the result stays above explode: below it, each condition would split the line again
    lines = spark.read.text(path).select(F.explode(F.array(F.split("value", r"\|", -1))).alias("p"))
    year = F.trim(F.get("p", F.lit(0))).try_cast("int")
    lines = lines.withColumn("short", F.coalesce(year >= SHORT_SINCE, F.size("p") < len(LONG)))

    def field(name: str) -> Column:
        at = lambda names: F.get("p", F.lit(names.index(name))) if name in names else F.lit(None).cast("string")
        return F.when(F.col("short"), at(SHORT)).otherwise(at(LONG)).alias(name)

    n, width = F.size("p"), F.when(F.col("short"), len(SHORT)).otherwise(len(LONG))
    return lines.select(*[field(c) for c in wanted], n.alias("n_fields"), F.slice("p", width + 1, F.greatest(n - width, F.lit(0))).alias("extra"))


def as_applications(register: DataFrame) -> DataFrame:
    """Register rows (of read_registers) as applications for the scorecard."""
    reason = F.coalesce(F.col("denial_reason_1"), F.col(SHORT_REASON))
    return register.select(
        F.col("action_taken").alias("action"), F.col("lei").alias("lender_id"), F.col("loan_amount").alias("amount"), F.col("purchaser_type").alias("purchaser"), F.col("applicant_race_1").alias("race"),
        F.col("applicant_ethnicity_1").alias("ethnicity"), is_multifamily(F.col("total_units")).alias("multifamily"), reason.alias("denial_reason"), F.col("county_code").alias("county_fips"),
        F.trim("activity_year").try_cast("int").alias("assessment_year"),
    )


#: What as_applications takes of a register.
APPLICATION_COLUMNS = ("activity_year", "lei", "action_taken", "loan_amount", "purchaser_type", "county_code", "applicant_ethnicity_1", "applicant_race_1", "total_units", "denial_reason_1", SHORT_REASON)
