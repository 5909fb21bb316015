"""Lender-behaviour risk by county and year: counters, rates, score, tier, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.codes import key
from ..functions.coerce import number
from ..sources.places import kept
from .buckets import BucketedTable
from .keep import keep_best, keep_last

# Denial reasons that mean none was given, and action codes.
NO_REASON = ("", "NA", "10", "1111")
ORIGINATED, DENIED = "1", "3"


def dimension(df: DataFrame, id_col: str, value_col: str, order: Sequence[str] = ()) -> DataFrame:
    """(id, value) with one row per id: the last in the order, so a lookup never multiplies rows."""
    return keep_last(df.dropna(subset=[id_col, value_col]), [id_col], list(order) or [value_col]).select(id_col, value_col)


def lookup(df: DataFrame, dim: DataFrame, on: str, dim_id: str, value: str, most_rows: int | None = None) -> DataFrame:
    """Left join of a dimension. It is broadcast where Catalyst knows that it is small, or where it is counted and found to
    have at most most_rows rows; else it is joined by a shuffle."""
    side = dim.select(F.col(dim_id).alias("__id"), F.col(value))
    if most_rows is not None and side.limit(most_rows + 1).count() <= most_rows:
        side = F.broadcast(side)
    return df.join(side, F.col(on) == F.col("__id"), "left").drop("__id")


#: What is counted for each lender and reason; amounts as decimals, so that their order doesn't matter.
COUNTERS = (
    "total_applications", "total_originated", "total_denied", "multifamily_applications", "multifamily_denied", "n_minority", "d_minority", "n_white", "d_white", "n_gse", "amounts", "n_amounts",
)
KEYS = ("county_fips", "assessment_year")


def partial_counts(applications: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, lender_id, reason, COUNTERS): all that a card needs of applications, from one aggregation. Counts of parts
    of the applications add up to those of all."""
    a = applications.filter(F.col("action").isin(ORIGINATED, DENIED))
    denied, made = F.col("action") == DENIED, F.col("action") == ORIGINATED
    minority, white, multi = M.is_minority(F.col("race"), F.col("ethnicity")), M.is_white_non_hispanic(F.col("race"), F.col("ethnicity")), F.coalesce(F.col("multifamily"), F.lit(False))
    reason = F.when(denied & ~F.coalesce(F.col("denial_reason"), F.lit("")).isin(*NO_REASON), F.col("denial_reason"))
    money = number(F.col("amount")).try_cast("decimal(24,4)")
    counted = (
        F.count("*"), F.count_if(made), F.count_if(denied), F.count_if(multi), F.count_if(multi & denied), F.count_if(minority), F.count_if(minority & denied), F.count_if(white), F.count_if(white & denied),
        F.count_if(made & M.is_gse(F.col("purchaser"))), F.sum(money).cast("decimal(38,4)"), F.count(money),
    )
    return a.groupBy(*keys, "lender_id", reason.alias("reason")).agg(*[c.alias(n) for n, c in zip(COUNTERS, counted, strict=True)])


def scorecard(applications: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key from applications with the columns action, lender_id, amount, purchaser, race, ethnicity,
    multifamily (boolean), denial_reason and the keys. Only originated and denied rows count; null counties are
    their own group."""
    return card_of(partial_counts(applications, keys), keys)


def card_of(counts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The scorecard of partial counts, or of several that are added up. Each row of counts goes on as one of its lender and
    one of its reason, so totals, distinct lenders and the most frequent reason (ties: the least) come from one tree of
    aggregations and the applications are read once."""
    none = lambda c: F.lit(None).cast(counts.schema[c].dataType).alias(c)
    lender = F.struct(F.lit(0).alias("kind"), F.col("lender_id").cast("string").alias("value"), *[F.col(c) for c in COUNTERS], F.lit(None).cast("long").alias("n"))
    reason = F.struct(F.lit(1).alias("kind"), F.col("reason").alias("value"), *[none(c) for c in COUNTERS], F.col("total_denied").alias("n"))
    split = counts.select(*keys, F.explode(F.array(lender, reason)).alias("e")).select(*keys, "e.*").filter("kind = 0 or value is not null")
    by_value = split.groupBy(*keys, "kind", "value").agg(*[F.sum(c).alias(c) for c in (*COUNTERS, "n")])
    is_reason = F.col("kind") == 1
    g = by_value.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in COUNTERS], F.nullif(F.count_if(~is_reason & F.col("value").isNotNull()), F.lit(0)).alias("lender_count"),
        F.min_by("value", F.when(is_reason, F.struct(-F.col("n"), F.col("value")))).alias("top_denial_reason"),
    )
    g = g.withColumn("avg_loan_amount", M.ratio(F.col("amounts"), F.col("n_amounts")))
    rates = g.select(
        "*", M.ratio(F.col("n_gse"), F.col("total_originated")).alias("gse_sold_pct"), M.ratio(F.col("total_denied"), F.col("total_applications")).alias("denial_rate_overall"),
        M.ratio(F.col("d_minority"), F.col("n_minority")).alias("denial_rate_minority"), M.ratio(F.col("d_white"), F.col("n_white")).alias("denial_rate_white"),
        M.ratio(F.col("multifamily_denied"), F.col("multifamily_applications")).alias("multifamily_denial_rate"),
    )
    with_ratio = rates.withColumn("denial_rate_disparity_ratio", M.ratio(F.col("denial_rate_minority"), F.col("denial_rate_white")))
    score = M.risk_score(F.col("denial_rate_disparity_ratio"), F.col("denial_rate_overall"), F.col("multifamily_denial_rate"))
    out = with_ratio.withColumn("fair_lending_risk_score", score)
    return out.select(
        key(*[F.col(k) for k in keys]).alias("risk_id"), *keys, "total_applications", "total_originated", "total_denied", "multifamily_applications", "multifamily_denied",
        "lender_count", "avg_loan_amount", "gse_sold_pct", "denial_rate_overall", "denial_rate_minority", "denial_rate_white", "multifamily_denial_rate",
        "denial_rate_disparity_ratio", "fair_lending_risk_score", M.tier(F.col("fair_lending_risk_score")).alias("risk_tier"), "top_denial_reason",
        M.high_disparity(F.col("denial_rate_disparity_ratio")).alias("is_high_disparity"),
    )


def outliers(card: DataFrame, measure: str, by: Sequence[str], flag: str = "is_outlier") -> DataFrame:
    """Adds flag: the measure is above the mean plus one sample standard deviation of its `by` group; null is false."""
    w = Window.partitionBy(*by)
    return card.withColumn(flag, F.coalesce(F.col(measure) > F.avg(measure).over(w) + F.stddev_samp(measure).over(w), F.lit(False)))


def by_metro(card: DataFrame, metro: str = "cbsa_code", year: str = "assessment_year") -> DataFrame:
    """The row with most applications of each metro area and year; rows outside metro areas stay."""
    return keep_best(card, [metro, year], "total_applications", ["risk_id"])


def tier_counts(card: DataFrame, *by: str) -> DataFrame:
    return card.groupBy(*by, "risk_tier").agg(F.count("*").alias("n"))


def card_state(spark: SparkSession, path: str, keys: Sequence[str] = KEYS, n_buckets: int | None = None) -> BucketedTable:
    """The table of partial counts that a card is kept up to date from, in buckets of the keys."""
    return BucketedTable(spark, path, [*keys, "lender_id", "reason"], n_buckets, by=keys)


def add_applications(state: BucketedTable, increment: DataFrame, batch: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds an increment to the state and returns the cards that it may have changed, those of the buckets that it is in.
    The last batch is not added again."""
    counts = kept(partial_counts(increment, keys))  # written once: its buckets are asked for before and after they are added
    state.add(counts, COUNTERS, batch)
    return card_of(state.near(counts), keys)


#: Registers of a sketch are 2 to this power; the relative standard error is 1.04 / sqrt(registers), 1.6 % here.
SKETCH_BITS = 12


def lender_sketches(applications: DataFrame, keys: Sequence[str], lender: str = "lender_id", bits: int = SKETCH_BITS) -> DataFrame:
    """(keys, sketch): of the distinct lenders of each key, a sketch of bounded size (null lenders are none). Where the
    exact count is wanted, scorecard has it."""
    return applications.groupBy(*keys).agg(F.hll_sketch_agg(F.col(lender).cast("string"), bits).alias("sketch"))


def sketch_state(spark: SparkSession, path: str, keys: Sequence[str], n_buckets: int | None = None) -> BucketedTable:
    return BucketedTable(spark, path, keys, n_buckets)


def add_lenders(state: BucketedTable, increment: DataFrame, batch: str, lender: str = "lender_id", bits: int = SKETCH_BITS) -> None:
    """Merges the sketches of an increment into the stored ones; merging again changes nothing."""
    state.combine(lender_sketches(increment, state.keys, lender, bits), {"sketch": F.hll_union_agg}, batch)


def rolled_up(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, sketch): sketches of counties become those of states or metro areas without reading applications again."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated_lenders(sketches: DataFrame) -> DataFrame:
    """Adds lender_count, estimated, and lender_count_error, three standard errors of it."""
    n = F.hll_sketch_estimate("sketch")
    return sketches.withColumn("lender_count", n).withColumn("lender_count_error", 3 * 1.04 / 2 ** (SKETCH_BITS / 2) * n)
