"""Housing tables derived from the given ones, so that every query grows with them.

An application is a line item with its order, customer, supplier and part; a county is a nation, a metro area a
region (region 4 is outside all metro areas), a tract a customer, a designation a part or an order year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import padded
from ..operators.risk import scorecard


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def county(nation: str | F.Column) -> F.Column:
    return padded((F.col(nation) if isinstance(nation, str) else nation).cast("string"), 5)


def applications(spark: SparkSession, sf_dir: str, by: tuple[str, str] = ("c_nationkey", "county_fips")) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus").filter(F.col("l_returnflag").isin("A", "R"))
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("assessment_year"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    race = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "1").when(F.col("c_mktsegment") == "BUILDING", "3").when(F.col("c_mktsegment") == "FURNITURE", "4").otherwise("5")
    return j.select(
        F.when(F.col("l_returnflag") == "A", "1").otherwise("3").alias("action"), F.col("s_nationkey").alias("lender_id"), F.col("l_extendedprice").alias("amount"),
        F.col("l_linenumber").cast("string").alias("purchaser"), race.alias("race"), F.when(F.col("l_linestatus") == "O", "1").otherwise("2").alias("ethnicity"),
        (F.col("l_quantity") >= 40).alias("multifamily"), F.when(F.col("p_type") == "ECONOMY", "10").otherwise(F.col("p_type")).alias("denial_reason"),
        (county("c_nationkey") if by[0] == "c_nationkey" else F.col(by[0])).alias(by[1]), "assessment_year",
    )


def card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard(applications(spark, sf_dir))


def card_with_metro(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(county("n_nationkey").alias("__c"), F.when(F.col("n_regionkey") != 4, padded(F.col("n_regionkey").cast("string"), 5)).alias("cbsa_code"))
    return card(spark, sf_dir).join(n, F.col("county_fips") == F.col("__c"), "left").drop("__c")


APPS = """apps AS (
  SELECT CASE l_returnflag WHEN 'A' THEN '1' ELSE '3' END AS action, s_nationkey AS lender_id, l_extendedprice AS amount, l_linenumber::VARCHAR AS purchaser,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '1' WHEN 'BUILDING' THEN '3' WHEN 'FURNITURE' THEN '4' ELSE '5' END AS race,
    CASE l_linestatus WHEN 'O' THEN '1' ELSE '2' END AS ethnicity, l_quantity >= 40 AS multi, CASE p_type WHEN 'ECONOMY' THEN '10' ELSE p_type END AS reason,
    lpad(c_nationkey::VARCHAR, 5, '0') AS county_fips, c_custkey, year(o_orderdate)::INTEGER AS assessment_year
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R'))"""


def card_sql(key: str = "county_fips") -> str:
    """CTEs ending in card(risk_id, ..., is_high_disparity), grouped by key and year."""
    return f"""WITH {APPS},
flags AS (SELECT *, action = '3' AS den, race IN ('1','2','3','4') OR ethnicity = '1' AS mino, race = '5' AND ethnicity = '2' AS whi FROM apps),
g AS (SELECT {key}, assessment_year, count(*) AS n, count_if(NOT den)::BIGINT AS o, count_if(den)::BIGINT AS d, count_if(multi)::BIGINT AS m, count_if(multi AND den)::BIGINT AS md,
    count_if(mino) AS mi, count_if(mino AND den) AS mid, count_if(whi) AS w, count_if(whi AND den) AS wd, count_if(NOT den AND purchaser IN ('1','3')) AS gse,
    nullif(count(DISTINCT lender_id), 0) AS lenders, sum(amount::DECIMAL(24,4))::DOUBLE / count(amount) AS amt FROM flags GROUP BY 1, 2),
reasons AS (SELECT {key}, assessment_year, reason FROM flags WHERE den AND coalesce(reason, '') NOT IN ('', 'NA', '10', '1111') GROUP BY 1, 2, 3
    QUALIFY row_number() OVER (PARTITION BY {key}, assessment_year ORDER BY count(*) DESC, reason) = 1),
r AS (SELECT *, d::DOUBLE / nullif(n, 0) AS dr, mid::DOUBLE / nullif(mi, 0) AS dmi, wd::DOUBLE / nullif(w, 0) AS dw, md::DOUBLE / nullif(m, 0) AS dm, gse::DOUBLE / nullif(o, 0) AS gs FROM g),
x AS (SELECT *, dmi / nullif(dw, 0) AS ratio FROM r),
y AS (SELECT *, CASE WHEN dm IS NOT NULL THEN ratio * 0.50::DOUBLE + dr * 0.30::DOUBLE + dm * 0.20::DOUBLE ELSE ratio * 0.625::DOUBLE + dr * 0.375::DOUBLE END AS score FROM x),
card AS (SELECT {key}::VARCHAR || '_' || assessment_year AS risk_id, {key}, assessment_year, n AS total_applications, o AS total_originated, d AS total_denied, m AS multifamily_applications, md AS multifamily_denied,
    lenders AS lender_count, amt AS avg_loan_amount, gs AS gse_sold_pct, dr AS denial_rate_overall, dmi AS denial_rate_minority, dw AS denial_rate_white, dm AS multifamily_denial_rate,
    ratio AS denial_rate_disparity_ratio, score AS fair_lending_risk_score,
    CASE WHEN score IS NULL THEN 'unknown' WHEN score < 0.75 THEN 'low' WHEN score < 1 THEN 'moderate' WHEN score < 1.5 THEN 'elevated' ELSE 'high' END AS risk_tier,
    reason AS top_denial_reason, coalesce(ratio > 2, false) AS is_high_disparity FROM y LEFT JOIN reasons USING ({key}, assessment_year))"""


#: Measures of the card that are rounded before they are compared.
MEASURES = ("gse_sold_pct", "denial_rate_overall", "denial_rate_minority", "denial_rate_white", "multifamily_denial_rate", "denial_rate_disparity_ratio", "fair_lending_risk_score")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in (columns or MEASURES) if c in df.columns})


ROUNDED = "* REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in MEASURES) + ")"
