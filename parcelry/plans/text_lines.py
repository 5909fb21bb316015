"""Queries over lines of text written from the given tables, as extracted pages have them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines
from .registry import query
from .stand_ins import table


def _written(df: DataFrame, file: Column, key: str, texts: list[Column]) -> DataFrame:
    """(file, line_no, text): the texts of each row, those that are null left out."""
    each = F.array(*[F.struct((F.col(key) * 8 + i).alias("line_no"), t.alias("text")) for i, t in enumerate(texts)])
    return df.select(file.alias("file"), F.explode(F.filter(each, lambda x: x["text"].isNotNull())).alias("x")).select("file", "x.*")


def _values(first: Column, n: int) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (first + 1_000 * i).cast("string")), " ")


_V = "array_to_string([(p_size + 1000 * i)::VARCHAR for i in range(1, 9)], ' ')"
_L1 = f"""l AS (SELECT p_brand AS file, p_partkey * 8 AS line_no, 'Area of ' || p_partkey || ', XX MSA' AS text FROM part WHERE p_partkey % 7 <> 0
  UNION ALL SELECT p_brand, p_partkey * 8 + 1, 'PAGE ' || p_partkey FROM part UNION ALL SELECT p_brand, p_partkey * 8 + 2, ' FY 2022 MFI: ' || (50000 + p_partkey) || ' 30% OF MEDIAN ' || {_V} FROM part WHERE p_partkey % 11 <> 0
  UNION ALL SELECT p_brand, p_partkey * 8 + 3, 'VERY LOW INCOME  ' || {_V} || ' ' FROM part UNION ALL SELECT p_brand, p_partkey * 8 + 4, 'LOW-INCOME ' || CASE WHEN p_size % 5 = 0 THEN '1 2 3' ELSE {_V} END FROM part)"""


def _parsed(is_area: str) -> str:
    """SQL from l(file, line_no, text) to limits: the head and income that stand above a line, and the numbers in it."""
    return f"""t AS (SELECT file, line_no, trim(text) AS text FROM l),
m AS (SELECT *, regexp_extract(text, '^(FY [0-9]+ MFI: [0-9]+ )?(30% OF MEDIAN|EXTR LOW INCOME|VERY LOW INCOME|LOW-INCOME)\\s+[0-9 ]+$', 2) AS program, regexp_extract(text, 'MFI: ([0-9]+)', 1) AS mfi, {is_area} AS is_area FROM t),
c AS (SELECT *, last_value(CASE WHEN is_area THEN text END IGNORE NULLS) OVER w AS area, last_value(CASE WHEN is_area THEN line_no END IGNORE NULLS) OVER w AS area_at, last_value(nullif(mfi, '') IGNORE NULLS) OVER w AS income, last_value(CASE WHEN mfi <> '' THEN line_no END IGNORE NULLS) OVER w AS income_at
  FROM m WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, regexp_extract_all(regexp_replace(text, '^.*(MEDIAN|INCOME) ', ''), '[0-9]+') AS numbers FROM c WHERE program <> '' AND income_at > area_at)
SELECT file, line_no, area, income::INTEGER AS mfi, CASE program WHEN 'VERY LOW INCOME' THEN 'VLI' WHEN 'LOW-INCOME' THEN 'LI' ELSE 'ELI' END AS program_type, array_to_string(numbers[1:8], ',') AS limits FROM r WHERE len(numbers) >= 8"""


def _listed(found: DataFrame) -> DataFrame:
    return found.withColumn("limits", F.array_join(F.transform("limits", lambda x: x.cast("string")), ","))


@query(f"WITH {_L1}, {_parsed("text LIKE 'Area of %'")}")
def limit_lines(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey").cast("string")
    v = _values(F.col("p_size"), 8)
    texts = [
        F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit("Area of "), k, F.lit(", XX MSA"))), F.concat(F.lit("PAGE "), k),
        F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit(" FY 2022 MFI: "), (50_000 + F.col("p_partkey")).cast("string"), F.lit(" 30% OF MEDIAN "), v)),
        F.concat(F.lit("VERY LOW INCOME  "), v, F.lit(" ")), F.concat(F.lit("LOW-INCOME "), F.when(F.col("p_size") % 5 == 0, "1 2 3").otherwise(v)),
    ]
    return _listed(lines.limit_lines(_written(p, F.col("p_brand"), "p_partkey", texts)))


_STATES = ("ALABAMA", "ALASKA", "ARIZONA")
_S = "array_to_string([(c_nationkey + 1000 * i)::VARCHAR for i in range(1, 10)], ' ')"
_L2 = f"""l AS (SELECT c_mktsegment AS file, c_custkey * 8 AS line_no, CASE c_nationkey % 4 WHEN 0 THEN 'Alabama' WHEN 1 THEN 'ALASKA' WHEN 2 THEN 'ARIZONA' ELSE 'NOWHERE' END AS text FROM customer
  UNION ALL SELECT c_mktsegment, c_custkey * 8 + 1, 'FY 2021 MFI: ' || (40000 + c_custkey) || ' EXTR LOW INCOME ' || {_S} FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_mktsegment, c_custkey * 8 + 2, 'LOW-INCOME ' || {_S} FROM customer)"""


@query(f"WITH {_L2}, {_parsed("upper(text) IN ('ALABAMA', 'ALASKA', 'ARIZONA')")}")
def state_limit_lines(spark: SparkSession, d: str) -> DataFrame:
    v, nation = _values(F.col("c_nationkey"), 9), F.col("c_nationkey") % 4
    texts = [
        F.when(nation == 0, "Alabama").when(nation == 1, "ALASKA").when(nation == 2, "ARIZONA").otherwise("NOWHERE"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("FY 2021 MFI: "), (40_000 + F.col("c_custkey")).cast("string"), F.lit(" EXTR LOW INCOME "), v)), F.concat(F.lit("LOW-INCOME "), v),
    ]
    return _listed(lines.limit_lines(_written(table(spark, d, "customer"), F.col("c_mktsegment"), "c_custkey", texts), states=_STATES))


_C5, _C3 = "lpad((c_custkey % 100000)::VARCHAR, 5, '0')", "lpad((c_custkey % 1000)::VARCHAR, 3, '0')"
_L3 = f"""l AS (SELECT c_mktsegment AS file, c_custkey * 8 AS line_no, lpad(c_nationkey::VARCHAR, 2, '0') || ' STATE OF X' AS text FROM customer WHERE c_custkey % 20 = 5
  UNION ALL SELECT c_mktsegment, c_custkey * 8 + 1, 'CBSA: Town ' || c_custkey || ', XX MSA - METRO' || {_C5} || 'M' || {_C5} || ' ' || {_C3} || '-Calhoun' FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_mktsegment, c_custkey * 8 + 2, 'NONMETROPOLITAN' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_mktsegment, c_custkey * 8 + 3, {_C3} || '-Baldwin, ' || {_C3} || '-De Kalb' FROM customer)"""


@query(f"""WITH {_L3},
c AS (SELECT file, line_no, text, last_value(nullif(regexp_extract(text, '^([0-9]{{2}}) STATE', 1), '') IGNORE NULLS) OVER w AS st,
  last_value(CASE WHEN text LIKE 'CBSA:%' THEN text WHEN text LIKE 'NON%' OR text LIKE '__ STATE%' THEN '-' END IGNORE NULLS) OVER w AS mode FROM l WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
e AS (SELECT file, st, mode, unnest(regexp_extract_all(text, '[0-9]{{3}}-[A-Z][a-z]+( [A-Z][a-z]+)?')) AS entry FROM c WHERE st IS NOT NULL AND text NOT LIKE '__ STATE%'),
f AS (SELECT *, st || entry[1:3] AS fips, entry[5:] AS name FROM e)
SELECT file, st AS state_fips, CASE WHEN mode LIKE 'CBSA:%' THEN regexp_extract(mode, 'METRO[0-9M]+') ELSE 'NCNTY' || fips || 'N' || fips END AS hud_area_code, CASE WHEN mode LIKE 'CBSA:%' THEN regexp_extract(mode, 'CBSA: (.*) - METRO', 1) ELSE name END AS hud_area_name,
  coalesce(mode LIKE 'CBSA:%', false) AS metro, fips AS county_fips, name AS county_name FROM f""")
def area_definition_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    five, three = F.lpad((k % 100_000).cast("string"), 5, "0"), F.lpad((k % 1_000).cast("string"), 3, "0")
    texts = [
        F.when(k % 20 == 5, F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit(" STATE OF X"))),
        F.when(k % 3 == 0, F.concat(F.lit("CBSA: Town "), k.cast("string"), F.lit(", XX MSA - METRO"), five, F.lit("M"), five, F.lit(" "), three, F.lit("-Calhoun"))),
        F.when(k % 5 == 0, "NONMETROPOLITAN"), F.concat(three, F.lit("-Baldwin, "), three, F.lit("-De Kalb")),
    ]
    return lines.area_definition_lines(_written(table(spark, d, "customer"), F.col("c_mktsegment"), "c_custkey", texts))
