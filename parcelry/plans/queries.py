"""One query per operator (or a few), over whole tables, each with the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import measures as M
from ..functions import text as X
from ..functions.coerce import enforce, padded_columns
from ..operators import checks, collapse, graph, keep, lines, matching, questions, reshape, risk, snapshots, tools, vintages
from ..sources import files
from .registry import ORACLES, QUERIES, query
from .stand_ins import ROUNDED, applications, card, card_sql, card_with_metro, county, rounded, table


# ---- risk -------------------------------------------------------------------------------------------------------


@query(card_sql() + f" SELECT {ROUNDED} FROM card")
def risk_scorecard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(card(spark, d))


@query(card_sql() + " SELECT risk_id, assessment_year, round(denial_rate_overall, 6) AS denial_rate_overall, coalesce(denial_rate_overall > avg(denial_rate_overall) OVER w + stddev_samp(denial_rate_overall) OVER w, false) AS is_outlier FROM card WINDOW w AS (PARTITION BY assessment_year)")
def risk_outlier_flag(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.outliers(card(spark, d), "denial_rate_overall", ["assessment_year"]).select("risk_id", "assessment_year", "denial_rate_overall", "is_outlier"))


_METRO = ", metro AS (SELECT card.*, CASE WHEN n_regionkey <> 4 THEN lpad(n_regionkey::VARCHAR, 5, '0') END AS cbsa_code FROM card LEFT JOIN nation ON lpad(n_nationkey::VARCHAR, 5, '0') = county_fips)"
_BEST = ", best AS (SELECT * FROM metro WHERE cbsa_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cbsa_code, assessment_year ORDER BY total_applications DESC, risk_id) = 1 UNION ALL SELECT * FROM metro WHERE cbsa_code IS NULL)"


@query(card_sql() + _METRO + _BEST + f" SELECT {ROUNDED} FROM best")
def risk_by_metro(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.by_metro(card_with_metro(spark, d)))


@query(card_sql("c_custkey") + " SELECT assessment_year, risk_tier, count(*) AS n FROM card GROUP BY ALL")
def risk_tier_counts(spark: SparkSession, d: str) -> DataFrame:
    by_customer = risk.scorecard(_apps_by_customer(spark, d), ["c_custkey", "assessment_year"])
    return risk.tier_counts(by_customer, "assessment_year")


def _apps_by_customer(spark: SparkSession, d: str) -> DataFrame:
    return applications(spark, d, by=("c_custkey", "c_custkey"))


# ---- codes, types, measures -------------------------------------------------------------------------------------


@query("""SELECT c_custkey, lpad(regexp_extract(c_name, '[0-9]+'), 11, '0') AS tract, CASE WHEN length(b) >= 5 THEN b ELSE lpad(b, 5, '0') END AS county,
  CASE WHEN c_nationkey % 5 <> 0 THEN lpad(c_nationkey::VARCHAR, 5, '0') END AS metro, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment, b IS NOT NULL AND length(b) <> 3 AS odd_width
FROM (SELECT *, (c_custkey % 100000)::VARCHAR AS b FROM customer)""")
def clean_codes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    key = (F.col("c_custkey") % 100_000).cast("string")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(" NaN ")).otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    metro = F.when(F.col("c_nationkey") % 5 == 0, F.lit("100000")).otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")))
    return c.select("c_custkey", C.clean_code(F.col("c_name"), 11).alias("tract"), C.clean_code(F.concat(key, F.lit(".0")), 5).alias("county"), C.clean_metro(metro).alias("metro"), C.null_words(segment).alias("segment"), C.wrong_width(key, 3).alias("odd_width"))


@query("""SELECT o_orderkey AS order_id, o_totalprice AS price, CASE WHEN o_orderkey % 7 <> 0 THEN round_even(o_totalprice, 0)::BIGINT END AS price_whole,
  o_orderstatus = 'F' AS finished, lpad((o_custkey % 100000)::VARCHAR, 5, '0') AS county, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority, NULL::VARCHAR AS notice FROM orders""")
def enforced_types(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    raw = o.select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.concat(F.lit("$"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)).alias("price"),
        F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price_whole"), F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "0").alias("finished"),
        (F.col("o_custkey") % 100_000).cast("string").alias("county"), F.when(F.col("o_orderkey") % 3 == 0, "None").otherwise(F.col("o_orderpriority")).alias("priority"),
    )
    kinds = {"order_id": "long", "price": "float", "price_whole": "long", "finished": "bool", "county": "code:5", "priority": "text", "notice": "text"}
    return enforce(raw, kinds)


@query("""SELECT n_nationkey, lpad(n_nationkey::VARCHAR, 5, '0') AS cbsa_code, lpad(n_nationkey::VARCHAR, 5, '0') || '_2024_VLI' AS limit_id, coalesce(CASE WHEN n_nationkey % 3 <> 0 THEN lpad(n_nationkey::VARCHAR, 5, '0') END, n_name) || '_2024' AS designation_id,
  substr(lpad(n_nationkey::VARCHAR, 5, '0'), 1, 2) AS state_fips FROM nation""")
def fmr_to_cbsa(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").withColumn("code", county("n_nationkey"))
    area = F.concat(F.lit("METRO"), "code", F.lit("M"), "code")
    return n.select(
        "n_nationkey", C.metro_of_area(area).alias("cbsa_code"), C.key(F.col("code"), F.lit(2024), F.lit("VLI")).alias("limit_id"),
        C.area_key(F.when(F.col("n_nationkey") % 3 != 0, F.col("code")), F.col("n_name"), F.lit(2024)).alias("designation_id"), C.state_of(F.col("code")).alias("state_fips"),
    )


@query("""SELECT p_partkey, p_size % 2 = 1 AS is_designated, CASE WHEN p_size % 2 = 0 THEN 'none' WHEN p_size / 100.0 >= 0.25 AND p_retailprice / 1000 < 1 THEN 'both' WHEN p_size / 100.0 >= 0.25 THEN 'poverty' WHEN p_retailprice / 1000 < 1 THEN 'income' ELSE 'area_constraint' END AS trigger_criterion,
  CASE WHEN p_size % 2 = 1 THEN 30 ELSE 0 END::INTEGER AS boost_pct, false AS boost_wrong FROM part""")
def designation_rules(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("p_size") % 2 == 1
    p = table(spark, d, "part").select("p_partkey", flag.alias("is_designated"), M.trigger(flag, F.col("p_retailprice") / 1000, F.col("p_size") / 100.0).alias("trigger_criterion"), M.boost(flag).alias("boost_pct"))
    return p.withColumn("boost_wrong", M.boost_wrong(F.col("is_designated"), F.col("boost_pct")))


@query("""WITH y AS (SELECT o_custkey, max(CASE WHEN y = 1998 THEN r END) AS v0, max(CASE WHEN y = 1997 THEN r END) AS v1, max(CASE WHEN y = 1996 THEN r END) AS v2 FROM
    (SELECT o_custkey, year(o_orderdate) AS y, count_if(o_orderstatus = 'F')::DOUBLE / count(*) AS r FROM orders GROUP BY 1, 2) GROUP BY 1)
SELECT o_custkey, round(v0 - v2, 6) AS trend_3yr, CASE WHEN v0 - v2 IS NULL THEN 'unknown' WHEN v0 - v2 < -0.05 THEN 'improving' WHEN v0 - v2 > 0.05 THEN 'worsening' ELSE 'stable' END AS direction FROM y""")
def trend_direction(spark: SparkSession, d: str) -> DataFrame:
    rate = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("r"))
    wide = tools.side_by_side(rate, "o_custkey", "y", [1998, 1997, 1996], "r")
    t = M.trend(F.col("y1998"), F.col("y1996"))
    return wide.select("o_custkey", F.round(t, 6).alias("trend_3yr"), M.direction(t).alias("direction"))


@query("""WITH b AS (SELECT p_brand, avg(p_retailprice) AS est, max(p_retailprice) - min(p_retailprice) AS moe, sum(CASE WHEN p_size > 25 THEN p_size ELSE 0 END) AS p5, sum(p_size) AS p1 FROM part GROUP BY 1)
SELECT p_brand, round(abs(moe) / 1.645 / nullif(est, 0), 6) AS income_cv, coalesce(abs(moe) / 1.645 / nullif(est, 0) < 0.3, false) AS is_reliable, round(coalesce(p5::DOUBLE / nullif(p1, 0), 0), 6) AS quarters_share, coalesce(p5::DOUBLE / nullif(p1, 0), 0) > 0.5 AS quarters_dominate FROM b""")
def estimate_reliability(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("est"), (F.max("p_retailprice") - F.min("p_retailprice")).alias("moe"), F.sum(F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(0)).alias("p5"), F.sum("p_size").alias("p1"))
    cv, share = M.estimate_cv(F.col("moe"), F.col("est")), M.share_or_zero(F.col("p5"), F.col("p1"))
    return b.select("p_brand", F.round(cv, 6).alias("income_cv"), M.reliable(cv).alias("is_reliable"), F.round(share, 6).alias("quarters_share"), (share > 0.5).alias("quarters_dominate"))


@query("""SELECT p_partkey, round(p_retailprice * 0.03, 6) AS max_rent, CASE WHEN p_type = 'PROMO' THEN round(p_retailprice * 0.03, 6) END AS program_rent, round(p_size::DOUBLE / nullif(p_partkey % 60, 0), 6) AS overlap, coalesce(abs(p_retailprice * 0.03 - p_size) >= 1, false) AS rent_off, p_retailprice AS max_income FROM part""")
def rent_and_overlap(spark: SparkSession, d: str) -> DataFrame:
    limit, program = F.col("p_retailprice"), F.when(F.col("p_type") == "PROMO", "VLI").otherwise("LI")
    return table(spark, d, "part").select(
        "p_partkey", F.round(M.max_rent(limit), 6).alias("max_rent"), F.round(M.max_rent(limit, program), 6).alias("program_rent"),
        F.round(M.overlap_share(F.col("p_size"), F.col("p_partkey") % 60), 6).alias("overlap"), M.rent_off(limit, F.col("p_size")).alias("rent_off"), limit.alias("max_income"),
    )


# ---- checks -----------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT *, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS st FROM orders), t AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'split_tract;' ELSE '' END || CASE WHEN o_totalprice > 400000 THEN 'too_large;' ELSE '' END || CASE WHEN st NOT IN ('F', 'O') THEN 'unexpected_state;' ELSE '' END AS skip_reason FROM o WHERE st IS NOT NULL)
SELECT o_orderkey, skip_reason, CASE WHEN skip_reason = '' THEN 'KEEP' ELSE 'SKIP' END AS row_status FROM t""")
def row_status(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("st", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")))
    tagged = checks.with_status(checks.without_trailers(o, "st"), {"split_tract": F.col("o_custkey") % 10 == 0, "too_large": F.col("o_totalprice") > 400_000, "unexpected_state": ~F.col("st").isin("F", "O")})
    return tagged.select("o_orderkey", "skip_reason", "row_status")


_LIMIT_COLS = [f"limit_{n}person" for n in range(1, 9)]
_LIMITS = ", ".join(f"(p_retailprice + {n} * (25 - p_size))::BIGINT AS l{n}" for n in range(1, 9))
_ERR = " OR ".join(f"l{n} <= 0" for n in range(1, 9))
_MONO = " OR ".join(f"l{n + 1} < l{n}" for n in range(1, 8))


@query(f"""WITH l AS (SELECT p_partkey, p_brand, p_type, {_LIMITS.replace("(p_retailprice", "(floor(p_retailprice) - 900")} FROM part),
b AS (SELECT count(*) AS n FROM (SELECT p_brand, p_type FROM l GROUP BY 1, 2 HAVING count(DISTINCT l1) > 1))
SELECT 'error_code' AS check_name, 0::BIGINT AS n_bad UNION ALL SELECT 'error_limit', count_if({_ERR})::BIGINT FROM l UNION ALL SELECT 'warn_monotone', count_if({_MONO})::BIGINT FROM l UNION ALL SELECT 'inconsistent_groups', n FROM b""")
def limit_validation(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", *[(F.floor("p_retailprice") - 900 + n * (25 - F.col("p_size"))).alias(c) for n, c in enumerate(_LIMIT_COLS, 1)])
    bad = collapse.inconsistent(p, ["p_brand", "p_type"], ["limit_1person"]).agg(F.lit("inconsistent_groups").alias("check_name"), F.count("*").alias("n_bad"))
    return checks.count_checks(p, checks.limit_checks(_LIMIT_COLS, "p_brand")).unionByName(bad.select("check_name", "n_bad"))


@query("""WITH r AS (SELECT CASE WHEN o_custkey % 50 = 0 THEN '100000' WHEN o_custkey % 50 = 1 THEN o_custkey || '.0' WHEN o_custkey % 50 = 2 THEN 'nan' ELSE o_custkey::VARCHAR END AS code FROM orders)
SELECT 'code_sentinel' AS check_name, count_if(code = '100000')::BIGINT AS n_bad FROM r UNION ALL SELECT 'code_decimal', count_if(regexp_matches(code, '\\.0$'))::BIGINT FROM r UNION ALL SELECT 'code_nan', count_if(lower(code) IN ('nan', 'none'))::BIGINT FROM r UNION ALL SELECT 'code_width', count_if(length(code) <> 3)::BIGINT FROM r UNION ALL SELECT 'not_in_text', count_if(NOT contains('tract ' || code, '1'))::BIGINT FROM r""".replace("\\\\", "\\"))
def dq_report(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey")
    code = F.when(k % 50 == 0, "100000").when(k % 50 == 1, F.concat(k.cast("string"), F.lit(".0"))).when(k % 50 == 2, "nan").otherwise(k.cast("string"))
    rows = table(spark, d, "orders").select(code.alias("code"))
    return checks.count_checks(rows, checks.leak_checks(["code"]) | {"code_width": C.wrong_width(F.col("code"), 3), "not_in_text": ~X.stated(F.lit("1"), F.concat(F.lit("tract "), "code"))})


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, n_rows FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n_rows FROM lineitem) WHERE n_rows > 1""")
def duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return keep.duplicates(line, ["l_orderkey", "l_linenumber"])


@query("""SELECT c_custkey, lpad(c_nationkey::VARCHAR, 5, '0') AS county, substr(lpad(c_custkey::VARCHAR, 9, '0'), 9, 1) IN ('7', '9') OR contains(lower(c_mktsegment), 'mach') AS is_territory FROM customer WHERE c_acctbal BETWEEN 0 AND 5000""")
def territory_flag(spark: SparkSession, d: str) -> DataFrame:
    c = checks.where(table(spark, d, "customer"), "c_acctbal", "between", 0, 5000)
    last = F.substring(C.padded(F.col("c_custkey").cast("string"), 9), 9, 1)
    return c.select("c_custkey", county("c_nationkey").alias("county"), checks.is_territory(last, ["7", "9"], F.col("c_mktsegment"), "MACH").alias("is_territory"))


# ---- roll-ups and reshaping -------------------------------------------------------------------------------------


@query("""SELECT s_nationkey, arg_min(s_name, s_suppkey) AS s_name, max(s_acctbal) AS s_acctbal, sum(s_suppkey)::BIGINT AS s_suppkey, count(s_name) AS n_named FROM supplier WHERE s_nationkey IS NOT NULL GROUP BY 1""")
def area_rollup(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("ord", F.col("s_suppkey"))
    return collapse.roll_up(s, "s_nationkey", ["ord"], first=["s_name"], largest=["s_acctbal"], total=["s_suppkey"], count={"n_named": "s_name"})


@query("""WITH m AS (SELECT p_brand, p_type FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) = 1)
SELECT p_brand, min(p_size) AS p_size, min(p_retailprice) AS p_retailprice, any_value(m.p_type) AS p_type FROM part JOIN m USING (p_brand) GROUP BY 1""")
def collapse_to_area(spark: SparkSession, d: str) -> DataFrame:
    return collapse.to_area(table(spark, d, "part"), ["p_brand"], ["p_size", "p_retailprice"], ["p_type"])


_BLOCKS = {"l50_": ("VLI", 1), "ELI_": ("ELI", 2), "l80_": ("LI", 3)}


@query("""WITH w AS (SELECT p_partkey, unnest([{'p': 'VLI', 'k': 1}, {'p': 'ELI', 'k': 2}, {'p': 'LI', 'k': 3}]) AS b, p_size FROM part)
SELECT p_partkey, b.p AS program_type, n::INTEGER AS household_size, (p_size * b.k + n)::INTEGER AS income_limit FROM w, range(1, 9) r(n)""")
def wide_to_program_rows(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "part").select("p_partkey", *[(F.col("p_size") * k + n).cast("int").alias(f"{prefix}{n}") for prefix, (_, k) in _BLOCKS.items() for n in range(1, 9)])
    rows = reshape.program_rows(wide, {p: v[0] for p, v in _BLOCKS.items()}, ["p_partkey"])
    return reshape.household_rows(rows, ["p_partkey", "program_type"])


@query("""SELECT n_regionkey, lpad(n_nationkey::VARCHAR, 3, '0') AS entity_code, replace(n_name, '_', '-') AS entity_name, NULL::VARCHAR AS zcta FROM nation
UNION ALL SELECT n_regionkey, NULL, NULL, (10000 + n_nationkey)::VARCHAR FROM nation""")
def explode_entities(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").withColumn("item", F.concat(C.padded(F.col("n_nationkey").cast("string"), 3), F.lit("-"), F.replace("n_name", F.lit("_"), F.lit("-"))))
    packed = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("item")), ", ").alias("line"), F.array_join(F.collect_list((F.col("n_nationkey") + 10_000).cast("string")), " ").alias("zips"))
    entities = reshape.numbered_entities(packed, "line", ["n_regionkey"])
    zips = reshape.zip_rows(packed, "zips", ["n_regionkey"])
    return entities.unionByName(zips, allowMissingColumns=True)


@query(r"""WITH w AS (SELECT conv_id, turn, regexp_split_to_array(coalesce(text, ''), '\s+') AS p FROM conversations), t AS (SELECT conv_id, turn, unnest(range(len(p))) AS i, unnest(p) AS token FROM w),
e AS (SELECT *, (token IN ('the', 'que', 'der'))::INTEGER AS e FROM t), g AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY conv_id ORDER BY turn, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS place FROM e),
n AS (SELECT conv_id, place, lower(trim(string_agg(token, ' ' ORDER BY turn, i), ' ')) AS name FROM g GROUP BY 1, 2 HAVING max(e) = 1)
SELECT conv_id, place, array_to_string(list_transform(string_split(name, ' '), lambda x: CASE WHEN x[1] = 'ß' THEN 'Ss' ELSE upper(x[1]) END || x[2:]), ' ') AS name FROM n""")
def token_stream_split(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "conversations").select("conv_id", F.col("turn"), F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("at", "token"))
    return reshape.token_names(words.select("conv_id", (F.col("turn") * 1_000_000 + F.col("at")).alias("place"), "token"), "conv_id", "place", "token", ["the", "que", "der"], F.floor(F.col("place") / 1_000_000))


# ---- keys, order, lines -----------------------------------------------------------------------------------------

_ALL = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_LINE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ALL.replace(',', ' DESC,')} DESC) = 1")
def keep_last(spark: SparkSession, d: str) -> DataFrame:
    return keep.keep_last(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ALL}) = 1")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    return keep.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query("SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS asked FROM conversations")
def forward_fill_headers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return lines.carried_down(c, F.col("role") == "user", F.md5("text"), ["conv_id"], ["turn", "role", "text"], "asked", F.floor(F.col("turn") / 4)).select("conv_id", "turn", "role", "asked")


#: Microseconds of time that one task scans of a user's events.
_WEEK = 7 * 86_400_000_000


@query("""WITH g AS (SELECT event_id, user_id, value, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000, true)::INTEGER AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id))
SELECT event_id, user_id, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::INTEGER AS row_no, CASE WHEN value < 5 THEN 1 WHEN value < 50 THEN 2 ELSE 3 END::INTEGER AS column_no FROM g""")
def merge_gap_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return lines.merged_rows(e, ["user_id"], "t", ["event_id"], 3_600_000_000, F.floor(F.col("t") / _WEEK)).select("event_id", "user_id", "row_no", lines.column_bucket(F.col("value"), [5, 50]).alias("column_no"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events), p AS (SELECT DISTINCT user_id, t FROM e), n AS MATERIALIZED (SELECT a.user_id, a.t, min(b.t) AS nxt FROM p a JOIN p b ON a.user_id = b.user_id AND a.t + 3600000000 < b.t GROUP BY 1, 2),
s AS (SELECT user_id, min(t) AS t, 1 AS row_no FROM p GROUP BY user_id UNION ALL SELECT s.user_id, n.nxt, row_no + 1 FROM s JOIN n ON n.user_id = s.user_id AND n.t = s.t)
SELECT event_id, e.user_id, e.t / 1e6 AS t, row_no FROM e ASOF JOIN s ON e.user_id = s.user_id AND e.t >= s.t""")
def merge_anchor_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return lines.anchored_rows(e, "user_id", "t", 3_600_000_000, _WEEK).withColumn("t", F.col("t") / 1e6)


# ---- snapshots --------------------------------------------------------------------------------------------------

_NEW = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0"
_OLD = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = o.filter("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(F.col("o_orderstatus")))
    return o.filter("o_orderkey % 3 <> 0"), new


@query(f"WITH n AS ({_NEW}), o AS ({_OLD}) SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n")
def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return snapshots.upsert(old, new, ["o_orderkey"])


@query(f"WITH n AS ({_NEW}), o AS ({_OLD}) SELECT n.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'CREATE' WHEN n.o_orderstatus = o.o_orderstatus AND n.o_custkey = o.o_custkey THEN 'SKIP' ELSE 'MERGE' END AS action FROM n LEFT JOIN o USING (o_orderkey)")
def change_actions(spark: SparkSession, d: str) -> DataFrame:
    old, new = (x.withColumn("content_hash", snapshots.fingerprint(["o_custkey", "o_orderstatus"])) for x in _versions(spark, d))
    return snapshots.change_actions(new, old, ["o_orderkey"]).select("o_orderkey", "action")


@query(r"""SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":"' || p_size || '"}') AS fingerprint FROM part""")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", snapshots.fingerprint(["p_size", "p_name", "p_brand"]).alias("fingerprint"))


@query(None)
def fast_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", snapshots.fast_hash(["p_size", "p_name", "p_brand"]).alias("hash"))


@query("""SELECT 'orders' AS dataset, min(year(o_orderdate))::INTEGER AS first_year, max(year(o_orderdate))::INTEGER AS last_year, count(DISTINCT year(o_orderdate)) AS n_years, count(*) AS n_rows FROM orders
UNION ALL SELECT 'lineitem', min(year(l_shipdate))::INTEGER, max(year(l_shipdate))::INTEGER, count(DISTINCT year(l_shipdate)), count(*) FROM lineitem""")
def snapshot_registry(spark: SparkSession, d: str) -> DataFrame:
    return collapse.year_coverage({"orders": (table(spark, d, "orders"), F.year("o_orderdate")), "lineitem": (table(spark, d, "lineitem"), F.year("l_shipdate"))})


def _registry_sql() -> str:
    lanes = " || ".join(f"format('{{:015x}}', (sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT::HUGEINT) % 1152921504606846976)::BIGINT)" for i in range(4))
    parts = []
    for name, columns in _REGISTERED.items():
        json = " || ',' || ".join(f"""'"{c}":"' || {c} || '"'""" for c in sorted(columns))
        schema = f"sha256('{_COLUMNS[name]}')"
        parts.append(f"SELECT '{name}' AS dataset, 'v1' AS version, '{name}.parquet' AS path, count(*) AS row_count, {schema} AS schema_hash, format('{{:016x}}', count(*)) || {lanes} AS content_hash, 'given' AS source_id FROM (SELECT sha256('{{' || {json} || '}}') AS h FROM {name})")
    return " UNION ALL ".join(parts)


_COLUMNS = {"part": "p_brand,p_name,p_partkey,p_retailprice,p_size,p_type", "supplier": "s_acctbal,s_name,s_nationkey,s_suppkey", "customer": "c_acctbal,c_custkey,c_mktsegment,c_name,c_nationkey"}
_REGISTERED = {"part": ["p_partkey", "p_name", "p_size"], "supplier": ["s_suppkey", "s_name"], "customer": ["c_custkey", "c_name"]}


@query(_registry_sql())
def registry_rows(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, cols in _REGISTERED.items():
        one = snapshots.registry_row(table(spark, d, name), name, "v1", f"{name}.parquet", "given", cols)
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer""")
def sheet_union(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return vintages.sheet_union([s, c, s], distinct=True)


@query("""SELECT o_orderkey AS order_id, CASE WHEN year(o_orderdate) = 1996 THEN round(o_totalprice) ELSE o_totalprice END AS price, CASE WHEN year(o_orderdate) = 1997 THEN o_orderpriority END AS priority, year(o_orderdate)::INTEGER AS year FROM orders WHERE year(o_orderdate) IN (1996, 1997)""")
def harmonised_union(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("yr", F.year("o_orderdate"))
    first = vintages.of_year(o, "yr", 1996).select(F.col("o_orderkey").alias("ID"), F.round("o_totalprice").alias("price_96"))
    second = vintages.of_year(o, "yr", 1997).select(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("PRICE_1997"), F.col("o_orderpriority").alias("Priority"))
    fields = [vintages.Field("order_id", ["order_key", "id"], "bigint", True), vintages.Field("price", ["price_{y}", "price_{yy}"], "double", True), vintages.Field("priority", ["priority"])]
    return vintages.harmonised_union({1996: first, 1997: second}, fields)


@query("SELECT p_partkey, p_brand, 2024 AS year, 'notice' AS notice_ref, NULL::BOOLEAN AS held_harmless FROM part WHERE p_size > 40")
def scan_project(spark: SparkSession, d: str) -> DataFrame:
    p = files.read_present(spark, f"{d}/part.parquet", ["p_partkey", "p_brand", "p_size", "not_there"]).filter("p_size > 40")
    p = files.with_provenance(p.drop("p_size", "source_file"), year=2024, notice_ref="notice")
    return padded_columns(p, {"held_harmless": "boolean"})


# ---- graph ------------------------------------------------------------------------------------------------------

_NODES = """nodes AS (SELECT 'State' AS label, r_regionkey::VARCHAR AS id, r_name AS name FROM region UNION ALL SELECT 'County', n_nationkey::VARCHAR, n_name FROM nation UNION ALL SELECT 'Tract', c_custkey::VARCHAR, c_name FROM customer UNION ALL SELECT 'Risk', s_suppkey::VARCHAR, s_name FROM supplier)"""
_EDGES = """edges AS (SELECT 'County' AS src_label, n_nationkey::VARCHAR AS src_id, 'IN_STATE' AS rel_type, 'State' AS dst_label, n_regionkey::VARCHAR AS dst_id FROM nation WHERE n_regionkey <> 4
  UNION SELECT 'Tract', c_custkey::VARCHAR, 'IN_COUNTY', 'County', c_nationkey::VARCHAR FROM customer
  UNION SELECT 'Risk', s_suppkey::VARCHAR, 'APPLIES_TO', 'County', s_nationkey::VARCHAR FROM supplier WHERE s_acctbal > 0)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    region, nation, customer, supplier = (table(spark, d, t) for t in ("region", "nation", "customer", "supplier"))
    parts = [("State", region, "r_regionkey", "r_name"), ("County", nation, "n_nationkey", "n_name"), ("Tract", customer, "c_custkey", "c_name"), ("Risk", supplier, "s_suppkey", "s_name")]
    n = None
    for label, df, key, name in parts:
        one = graph.nodes(df.select(key, F.col(name).alias("name")), label, key, ["name"], ["name"])
        n = one if n is None else n.unionByName(one)
    e = graph.edges(nation, "County", "n_nationkey", "IN_STATE", "State", F.when(F.col("n_regionkey") != 4, F.col("n_regionkey")), region, "r_regionkey")
    e = e.unionByName(graph.edges(customer, "Tract", "c_custkey", "IN_COUNTY", "County", F.col("c_nationkey"), nation, "n_nationkey"))
    e = e.unionByName(graph.edges(supplier, "Risk", "s_suppkey", "APPLIES_TO", "County", F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")), nation, "n_nationkey"))
    return n, e


@query(f"WITH {_NODES} SELECT * FROM nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[0]


@query(f"WITH {_EDGES} SELECT * FROM edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1]


@query(f"""WITH {_NODES}, {_EDGES}, ends AS (SELECT src_label AS l, src_id AS i FROM edges UNION SELECT dst_label, dst_id FROM edges)
SELECT label, count(*) AS n_nodes, (SELECT count(*) FROM edges WHERE src_label = label) AS n_out, (SELECT count(*) FROM edges WHERE dst_label = label) AS n_in, count(i) AS n_connected, count(*) - count(i) AS n_orphans, round((count(*) - count(i)) * 100.0::DOUBLE / count(*), 4) AS orphan_pct
FROM nodes LEFT JOIN ends ON l = label AND i = id GROUP BY label""")
def graph_audit(spark: SparkSession, d: str) -> DataFrame:
    return graph.audit(*_graph(spark, d))


@query(f"WITH {_EDGES} SELECT src_label, rel_type, dst_label, count(*) AS n FROM edges WHERE NOT (src_label = 'Risk' AND rel_type = 'APPLIES_TO') GROUP BY ALL")
def edge_pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_counts(graph.without_edges(_graph(spark, d)[1], "Risk", "APPLIES_TO", "County"))


_XW = """xw AS (SELECT DISTINCT s_nationkey::VARCHAR AS county_fips, 'A' || s_suppkey % 7 AS hud_area_code, (1995 + s_suppkey % 3)::INTEGER AS year FROM supplier), lim AS (SELECT p_partkey AS limit_id, 'A' || p_size % 9 AS hud_area_code, (1995 + p_partkey % 3)::INTEGER AS year FROM part)"""


@query(f"""WITH {_XW}, states AS (SELECT p_partkey AS limit_id, p_size % 5 AS state, (1995 + p_partkey % 3)::INTEGER AS year FROM part)
SELECT DISTINCT 'County' AS src_label, n_nationkey::VARCHAR AS src_id, 'HAS_MSA_AMI' AS rel_type, 'Section8AMILimit' AS dst_label, limit_id::VARCHAR AS dst_id FROM nation JOIN xw ON n_nationkey::VARCHAR = county_fips JOIN lim USING (hud_area_code, year)
UNION ALL SELECT DISTINCT 'County', n_nationkey::VARCHAR, 'HAS_STATE_AMI', 'StateAMILimit', limit_id::VARCHAR FROM nation JOIN states ON n_regionkey = state WHERE n_regionkey = 4 AND year = 1996""")
def crosswalk_edges(spark: SparkSession, d: str) -> DataFrame:
    nation, s, p = table(spark, d, "nation"), table(spark, d, "supplier"), table(spark, d, "part")
    xw = s.select(F.col("s_nationkey").cast("string").alias("county_fips"), F.concat(F.lit("A"), (F.col("s_suppkey") % 7).cast("string")).alias("hud_area_code"), (1995 + F.col("s_suppkey") % 3).cast("int").alias("year"))
    limits = p.select(F.col("p_partkey").alias("limit_id"), F.concat(F.lit("A"), (F.col("p_size") % 9).cast("string")).alias("hud_area_code"), (1995 + F.col("p_partkey") % 3).cast("int").alias("year"))
    many = graph.through_crosswalk(nation.select(F.col("n_nationkey").cast("string").alias("c")), "c", xw, limits, "limit_id")
    state_limits = p.select("p_partkey", (F.col("p_size") % 5).alias("state"), (1995 + F.col("p_partkey") % 3).cast("int").alias("year"))
    counties = nation.filter("n_regionkey = 4").select("n_nationkey", F.col("n_regionkey").alias("state"), F.lit(1996).alias("year"))
    fallback = tools.required(counties.distinct(), state_limits.distinct(), ["state", "year"], ["p_partkey"])  # all counties have one state and year
    return many.unionByName(fallback.select(F.lit("County").alias("src_label"), F.col("n_nationkey").cast("string").alias("src_id"), F.lit("HAS_STATE_AMI").alias("rel_type"), F.lit("StateAMILimit").alias("dst_label"), F.col("p_partkey").cast("string").alias("dst_id")))


@query("""WITH f AS (SELECT 'A' || s_suppkey % 7 AS code, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey END AS metro, s_suppkey FROM supplier), m AS (SELECT code, metro FROM f WHERE metro IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code ORDER BY s_suppkey) = 1)
SELECT p_partkey, 'A' || p_size % 9 AS code, coalesce(m.metro, CASE WHEN p_size > 25 THEN -1 END)::BIGINT AS metro FROM part LEFT JOIN m ON m.code = 'A' || p_size % 9""")
def crosswalk_enrich(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "supplier").select(F.concat(F.lit("A"), (F.col("s_suppkey") % 7).cast("string")).alias("code"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("metro"), "s_suppkey")
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("A"), (F.col("p_size") % 9).cast("string")).alias("code"), F.when(F.col("p_size") > 25, -1).alias("metro"))
    return graph.enrich(p, graph.first_metro(f, "code", "metro", ["s_suppkey"]), "code", ["metro"]).select("p_partkey", "code", F.col("metro").cast("long").alias("metro"))


# ---- questions --------------------------------------------------------------------------------------------------

_PLACES = "places AS (SELECT r_regionkey::VARCHAR AS state, r_name AS state_name, n_nationkey AS place_code, 'Nation ' || n_nationkey || ' County' AS place_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"""WITH {_PLACES}, r AS (SELECT s_suppkey AS request_id, 'nation ' || s_suppkey % 20 AS query, CASE s_suppkey % 3 WHEN 0 THEN (s_suppkey % 5)::VARCHAR WHEN 1 THEN (SELECT lower(r_name) FROM region WHERE r_regionkey = s_suppkey % 5) END AS asked FROM supplier),
h AS (SELECT request_id, query, state, place_code, place_name FROM r JOIN places ON contains(lower(place_name), lower(query)) AND (asked IS NULL OR asked = lower(state) OR asked = lower(state_name)))
SELECT *, count(*) OVER (PARTITION BY request_id) AS match_count FROM h""")
def resolve_place(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region")
    places = table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").cast("string").alias("state"), F.col("r_name").alias("state_name"), F.col("n_nationkey").alias("place_code"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string"), F.lit(" County")).alias("place_name"))
    r = table(spark, d, "supplier").withColumn("k", F.col("s_suppkey") % 5).join(region, F.col("k") == F.col("r_regionkey"), "left")
    asked = F.when(F.col("s_suppkey") % 3 == 0, F.col("k").cast("string")).when(F.col("s_suppkey") % 3 == 1, F.lower("r_name"))
    requests = r.select(F.col("s_suppkey").alias("request_id"), F.concat(F.lit("nation "), (F.col("s_suppkey") % 20).cast("string")).alias("query"), asked.alias("state"))
    return matching.resolve_places(requests, places)


@query("""WITH s AS (SELECT s_suppkey, s_nationkey % 5 AS st, CASE WHEN s_suppkey % 2 = 0 THEN 'St. Nation' || s_nationkey || ' County' ELSE 'Saint Nation' || s_nationkey END AS name, CASE WHEN s_suppkey % 10 = 0 THEN 'known' END AS code FROM supplier)
SELECT s_suppkey, coalesce(code, n_nationkey::VARCHAR) AS code FROM s LEFT JOIN nation ON n_nationkey % 5 = st AND 'nation' || n_nationkey = lower(regexp_extract(name, 'Nation[0-9]+'))""")
def county_by_name(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_nationkey").cast("string")
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("St. Nation"), k, F.lit(" County"))).otherwise(F.concat(F.lit("Saint Nation"), k))
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("st"), name.alias("name"), F.when(F.col("s_suppkey") % 10 == 0, "known").alias("code"))
    dim = table(spark, d, "nation").select((F.col("n_nationkey") % 5).alias("state"), F.concat(F.lit("Saint Nation"), F.col("n_nationkey").cast("string"), F.lit(" Parish")).alias("county_name"), F.col("n_nationkey").cast("string").alias("county_fips"))
    return matching.fill_county(s, "s_suppkey", "st", "name", "code", dim).select("s_suppkey", "code")


@query("""SELECT s_suppkey, coalesce(n_nationkey::VARCHAR, 'Area #' || s_suppkey % 30) AS area, CASE WHEN n_nationkey IS NULL THEN 'unknown_code' WHEN s_suppkey % 4 = 0 THEN 'wrong_name' ELSE 'ok' END AS status FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey % 30""")
def name_checks(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("A"), F.col("n_nationkey").cast("string"), F.lit("Z")).alias("code"), F.col("n_nationkey").cast("string").alias("plain"), F.concat(F.lit("area "), F.col("n_nationkey").cast("string")).alias("area_name"), F.lit("Alpha County").alias("full_name"))
    k = (F.col("s_suppkey") % 30).cast("string")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("claim_id"), F.concat(F.lit("Area #"), k).alias("area_text"), F.concat(F.lit("A"), k, F.lit("Z")).alias("code"), F.when(F.col("s_suppkey") % 4 == 0, "in beta").otherwise("in ALPHA").alias("text"))
    status = matching.check_codes(s, n, "code", "full_name").select(F.col("claim_id").alias("s_suppkey"), "status")
    named = matching.code_by_name(s, "area_text", n, "area_name", "plain", "area").select("claim_id", "area")
    return status.join(named, F.col("s_suppkey") == F.col("claim_id")).select("s_suppkey", "area", "status")


_DES = "des AS (SELECT DISTINCT ON (o_custkey, y) o_custkey, y, is_q, boost FROM (SELECT o_custkey, year(o_orderdate)::INTEGER AS y, max(o_totalprice) > 300000 AS is_q, CASE WHEN max(o_totalprice) > 300000 THEN 30 ELSE 0 END::INTEGER AS boost FROM orders GROUP BY 1, 2))"


def _designations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg((F.max("o_totalprice") > 300_000).alias("is_q"))
    return o.withColumn("boost", M.boost(F.col("is_q")))


@query(f"WITH {_DES} SELECT c_custkey AS o_custkey, 1997 AS y, coalesce(is_q, false) AS is_q, boost FROM customer LEFT JOIN (SELECT * FROM des WHERE is_q) des ON c_custkey = o_custkey AND y = 1997")
def point_status(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(1997).alias("y"))
    return tools.status(requests, _designations(spark, d), ["o_custkey", "y"], "is_q", ["boost"])


@query("""WITH a AS (SELECT s_nationkey AS county, max(s_acctbal) AS lim FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1), b AS (SELECT n_regionkey AS state, count(*)::DOUBLE AS lim FROM nation WHERE n_regionkey <> 2 GROUP BY 1)
SELECT n_nationkey AS county, n_regionkey AS state, coalesce(a.lim, b.lim) AS lim, CASE WHEN a.county IS NOT NULL THEN 'first' WHEN b.state IS NOT NULL THEN 'second' END AS answered_by FROM nation LEFT JOIN a ON a.county = n_nationkey LEFT JOIN b ON b.state = n_regionkey""")
def limits_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a = table(spark, d, "supplier").filter("s_nationkey % 3 <> 0").groupBy(F.col("s_nationkey").alias("county")).agg(F.max("s_acctbal").alias("lim"))
    b = n.filter("n_regionkey <> 2").groupBy(F.col("n_regionkey").alias("state")).agg(F.count("*").cast("double").alias("lim"))
    return tools.with_fallback(n.select(F.col("n_nationkey").alias("county"), F.col("n_regionkey").alias("state")), a, ["county"], b, ["state"], ["lim"])


@query(card_sql() + " SELECT lpad(n_nationkey::VARCHAR, 5, '0') AS county_fips, 1997 AS assessment_year, round(fair_lending_risk_score, 6) AS fair_lending_risk_score, risk_tier FROM nation LEFT JOIN card ON county_fips = lpad(n_nationkey::VARCHAR, 5, '0') AND assessment_year = 1997")
def risk_lookup(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "nation").select(county("n_nationkey").alias("county_fips"), F.lit(1997).alias("assessment_year"))
    one = tools.one_risk(card(spark, d), ["county_fips", "assessment_year"])
    return rounded(tools.optional(requests, one, ["county_fips", "assessment_year"], ["fair_lending_risk_score", "risk_tier"]))


@query(card_sql() + " SELECT lpad(n_nationkey::VARCHAR, 5, '0') AS county_fips, y::INTEGER AS assessment_year, total_denied, card.risk_id IS NULL AS is_gap FROM nation CROSS JOIN range(1993, 1998) r(y) LEFT JOIN card ON county_fips = lpad(n_nationkey::VARCHAR, 5, '0') AND assessment_year = y")
def risk_trend(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "nation").select(county("n_nationkey").alias("county_fips"), F.lit(1993).alias("start_year"), F.lit(1997).alias("end_year"))
    return tools.trend(requests, card(spark, d), "county_fips", "assessment_year", ["total_denied"])


@query("SELECT c_custkey, c_nationkey, c_acctbal, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000) AS total_count FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5")
def search_entities(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return tools.search(c, (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") >= 1000), [F.desc("c_acctbal"), F.asc("c_custkey")], 20, 5).select("c_custkey", "c_nationkey", "c_acctbal", "total_count")


@query("""SELECT c_custkey AS id, c_name AS name, 'metro' AS dda_kind FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT s_suppkey, s_name, 'non_metro' FROM supplier WHERE s_acctbal <= 5000""")
def both_kinds(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    with_both = tools.both_sets(c, s.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")), ["c_nationkey"])
    return tools.either_kind(with_both.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), s.filter("s_acctbal <= 5000").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), ["id", "name"])


@query(f"WITH {_DES}, g AS (SELECT o_custkey, bool_or(y = 1996) AS a, bool_or(y = 1997) AS b FROM des WHERE is_q AND y IN (1996, 1997) GROUP BY 1) SELECT o_custkey, a AS in_first, b AS in_second, a AND b AS in_both, a AND NOT b AS first_only, b AND NOT a AS second_only FROM g")
def year_pair(spark: SparkSession, d: str) -> DataFrame:
    return tools.year_pair(_designations(spark, d), "o_custkey", "y", 1996, 1997, F.col("is_q"))


@query(card_sql() + f""", {_DES} SELECT c_custkey, c_name, c_nationkey, n_name, r_name, coalesce(is_q, false) AS is_q, boost, risk_tier FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT * FROM des WHERE is_q AND y = 1997) des ON o_custkey = c_custkey LEFT JOIN card ON county_fips = lpad(c_nationkey::VARCHAR, 5, '0') AND assessment_year = 1997""")
def entity_profile(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.lit(1997).alias("y"), county("c_nationkey").alias("county_fips"), F.col("c_custkey").alias("o_custkey"), F.lit(1997).alias("assessment_year"))
    c = tools.status(c, _designations(spark, d), ["o_custkey", "y"], "is_q", ["boost"])
    c = tools.optional(c, card(spark, d), ["county_fips", "assessment_year"], ["risk_tier"])
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return tools.optional(tools.optional(c, n, ["c_nationkey"], ["n_name", "n_regionkey"]), r, ["n_regionkey"], ["r_name"]).select("c_custkey", "c_name", "c_nationkey", "n_name", "r_name", "is_q", "boost", "risk_tier")


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_nationkey LIMIT 10")
def top_geographies(spark: SparkSession, d: str) -> DataFrame:
    return collapse.ranked_counts(table(spark, d, "customer"), "c_nationkey", 10)


_VIEW_SQL = "SELECT n.n_name, count(*) AS n_tracts, max(c.c_acctbal) AS top_balance FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name HAVING count(*) > 1"


@query(_VIEW_SQL)
def sql_views(spark: SparkSession, d: str) -> DataFrame:
    return tools.run_sql({t: table(spark, d, t) for t in ("customer", "nation")}, _VIEW_SQL.replace("FROM customer", "FROM {customer}").replace("JOIN nation", "JOIN {nation}"))


# ---- typed questions --------------------------------------------------------------------------------------------

_AREAS = """des AS (SELECT o_custkey AS code, year(o_orderdate)::INTEGER AS year, max(o_totalprice) > 300000 AS is_dda, CASE WHEN max(o_totalprice) > 300000 THEN 30 ELSE 0 END::INTEGER AS boost FROM orders GROUP BY 1, 2),
metro AS (SELECT des.*, c_name AS area_name, c_nationkey % 7 AS state FROM des JOIN customer ON c_custkey = code),
rural AS (SELECT s_nationkey AS county, y::INTEGER AS year, max(s_acctbal) > 8500 AS is_dda, CASE WHEN max(s_acctbal) > 8500 THEN 30 ELSE 0 END::INTEGER AS boost, max(s_name) AS area_name, s_nationkey % 7 AS state, s_nationkey AS code FROM supplier, (VALUES (1996), (1997)) v(y) GROUP BY s_nationkey, y)"""


def _areas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    metro = _designations(spark, d).select(F.col("o_custkey").alias("code"), F.col("y").alias("year"), F.col("is_q").alias("is_dda"), "boost")
    metro = metro.join(table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("area_name"), (F.col("c_nationkey") % 7).alias("state")), "code")
    years = table(spark, d, "supplier").withColumn("year", F.explode(F.array(F.lit(1996), F.lit(1997))))
    rural = years.groupBy(F.col("s_nationkey").alias("county"), "year").agg((F.max("s_acctbal") > 8500).alias("is_dda"), F.max("s_name").alias("area_name"))
    return metro, rural.select("*", M.boost(F.col("is_dda")).alias("boost"), (F.col("county") % 7).alias("state"), F.col("county").alias("code"))


@query(f"""WITH {_AREAS} SELECT c_custkey AS code, c_nationkey AS county, 1997 AS year, coalesce(m.boost, r.boost) AS boost, CASE WHEN m.code IS NOT NULL THEN 'metro' WHEN r.county IS NOT NULL THEN 'non_metro' END AS dda_kind, m.code IS NOT NULL OR r.county IS NOT NULL AS is_dda
FROM customer LEFT JOIN (SELECT * FROM metro WHERE is_dda AND year = 1997) m ON m.code = c_custkey LEFT JOIN (SELECT * FROM rural WHERE is_dda AND year = 1997) r ON r.county = c_nationkey""")
def check_dda(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("county"), F.lit(1997).alias("year"))
    return questions.check_dda(requests, *_areas(spark, d))


@query(f"WITH {_AREAS} SELECT code, area_name, 'metro' AS dda_kind FROM metro WHERE is_dda AND year = 1997 AND state = 3 UNION ALL SELECT code, area_name, 'non_metro' FROM rural WHERE is_dda AND year = 1997 AND state = 3")
def search_dda_areas(spark: SparkSession, d: str) -> DataFrame:
    return questions.search_dda_areas(*_areas(spark, d), 1997, 3)


@query(f"""WITH {_AREAS} SELECT c_custkey AS tract, c_nationkey AS county, c_nationkey % 7 AS state, coalesce(is_dda, false) AS is_qct, coalesce(boost > 0 AND c_acctbal > 0, false) AS is_dda FROM customer LEFT JOIN (SELECT * FROM des WHERE year = 1996) ON code = c_custkey WHERE c_nationkey % 7 = 2 AND coalesce(is_dda, false)""")
def search_tracts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    tracts = c.select(F.col("c_custkey").alias("tract"), F.col("c_nationkey").alias("county"), (F.col("c_nationkey") % 7).alias("state"))
    marks = _designations(spark, d).join(c.select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    marks = marks.select(F.col("o_custkey").alias("tract"), F.col("y").alias("year"), F.col("is_q").alias("is_qct"), ((F.col("boost") > 0) & (F.col("c_acctbal") > 0)).alias("is_dda"))
    return questions.search_tracts(tracts, marks, 1996, state=2, is_qct=True)


_LIMITS = """lim AS (SELECT CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey::VARCHAR END AS area_code, s_suppkey AS county, s_nationkey % 3 AS state, 1996 + s_suppkey % 2 AS year, ['ELI', 'VLI', 'LI', 'SEC8X'][1 + s_suppkey % 4 // 1 % 4] AS program, s_name AS area_name, s_acctbal AS limit_4person FROM supplier),
prog AS (SELECT * EXCLUDE (program), unnest(['VLI', program || CASE WHEN program = 'VLI' THEN '_TOO' ELSE '' END]) AS program_type FROM lim)"""


def _limits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    program = F.element_at(F.array(*[F.lit(x) for x in ("ELI", "VLI", "LI", "SEC8X")]), (1 + k % 4).cast("int"))
    other = F.concat(program, F.when(program == "VLI", "_TOO").otherwise(""))
    s = table(spark, d, "supplier").select(F.when(k % 4 > 0, k.cast("string")).alias("area_code"), k.alias("county"), (F.col("s_nationkey") % 3).alias("state"), (1996 + k % 2).alias("year"), F.col("s_name").alias("area_name"), F.col("s_acctbal").alias("limit_4person"), F.explode(F.array(F.lit("VLI"), other)).alias("program_type"))
    return s


@query(f"""WITH {_LIMITS} SELECT s.s_suppkey::VARCHAR AS area_code, s.s_suppkey AS county, 1996 + s.s_suppkey % 3 AS year, coalesce(a.limit_4person, c.limit_4person) AS limit_4person, CASE WHEN a.county IS NOT NULL THEN 'first' WHEN c.county IS NOT NULL THEN 'second' END AS answered_by, 'VLI' AS program_type
FROM supplier s LEFT JOIN (SELECT * FROM prog WHERE program_type = 'VLI') a ON a.area_code = s.s_suppkey::VARCHAR AND a.year = 1996 + s.s_suppkey % 3 LEFT JOIN (SELECT * FROM prog WHERE program_type = 'VLI' AND area_code IS NULL) c ON c.county = s.s_suppkey AND c.year = 1996 + s.s_suppkey % 3""")
def ami_limits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    requests = table(spark, d, "supplier").select(k.cast("string").alias("area_code"), k.alias("county"), (1996 + k % 3).alias("year"))
    return questions.get_ami_limits(requests, _limits(spark, d), ["limit_4person"])


@query(f"WITH {_LIMITS} SELECT area_code, county, state, year, area_name, limit_4person, program_type FROM prog WHERE state = 1 AND year = 1997 AND program_type = 'VLI'")
def state_ami_limits(spark: SparkSession, d: str) -> DataFrame:
    return questions.get_state_ami_limits(_limits(spark, d), 1, 1997)


@query(f"WITH {_LIMITS} SELECT area_code, county, state, year, area_name, limit_4person, program_type FROM prog WHERE year = 1997 AND program_type NOT IN ('ELI', 'VLI', 'LI') AND contains(lower(area_name), 'supplier#')")
def special_program_limits(spark: SparkSession, d: str) -> DataFrame:
    return questions.get_special_program_limits(_limits(spark, d), 1997, area_name="Supplier#")


@query(card_sql() + f" SELECT {ROUNDED} FROM card WHERE assessment_year = 1996 AND risk_tier = 'moderate' AND county_fips LIKE '00%'")
def search_hmda_risk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(questions.search_hmda_risk(card(spark, d), 1996, "moderate", "00"))


@query(card_sql() + """, m AS (SELECT card.*, CASE WHEN n_regionkey <> 4 THEN lpad(n_regionkey::VARCHAR, 5, '0') END AS cbsa_code FROM card LEFT JOIN nation ON lpad(n_nationkey::VARCHAR, 5, '0') = county_fips),
b AS (SELECT * FROM m WHERE cbsa_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cbsa_code, assessment_year ORDER BY total_applications DESC, risk_id) = 1),
q AS (SELECT lpad(n_regionkey::VARCHAR, 5, '0') AS cbsa_code, lpad(n_nationkey::VARCHAR, 5, '0') AS county_fips, 1996 AS assessment_year FROM nation)
SELECT q.*, coalesce(b.risk_id, c.risk_id) AS risk_id, coalesce(b.risk_tier, c.risk_tier) AS risk_tier, CASE WHEN b.risk_id IS NOT NULL THEN 'metro' WHEN c.risk_id IS NOT NULL THEN 'county' END AS answered_by
FROM q LEFT JOIN b USING (cbsa_code, assessment_year) LEFT JOIN card c ON c.county_fips = q.county_fips AND c.assessment_year = q.assessment_year""")
def hmda_risk(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "nation").select(county("n_regionkey").alias("cbsa_code"), county("n_nationkey").alias("county_fips"), F.lit(1996).alias("assessment_year"))
    return questions.get_hmda_risk(requests, card_with_metro(spark, d), ["risk_id", "risk_tier"])


# ---- counts, checks and flags -----------------------------------------------------------------------------------


@query("SELECT count(DISTINCT c_nationkey) AS n_areas FROM customer")
def distinct_areas(spark: SparkSession, d: str) -> DataFrame:
    return collapse.distinct_areas(table(spark, d, "customer"), "c_nationkey")


@query("SELECT o_custkey, o_clerk_first AS first_clerk, o_prio AS first_priority FROM (SELECT o_custkey, arg_min(o_orderkey, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS o_clerk_first, arg_min(o_orderstatus, o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS o_prio FROM orders GROUP BY 1)")
def first_known_values(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("first_clerk"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("first_priority"))
    return keep.first_values(o, ["o_custkey"], ["o_orderkey"], ["first_clerk", "first_priority"])


@query("SELECT s_suppkey, s_nationkey AS county, n_name AS county_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 2 = 0")
def dimension_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").filter("n_nationkey % 2 = 0")
    twice = n.unionByName(n.withColumn("n_name", F.lit("")))  # a dimension with two rows an id
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("county"))
    return risk.lookup(s, risk.dimension(twice, "n_nationkey", "n_name"), "county", "n_nationkey", "n_name").select("s_suppkey", "county", F.col("n_name").alias("county_name"))


@query("""WITH o AS (SELECT c_custkey, c_nationkey AS a, c_acctbal AS b FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN -1 END::BIGINT AS a, c_acctbal + 1 AS b FROM customer WHERE c_custkey % 5 <> 0)
SELECT c_custkey, coalesce(n.a, o.a)::BIGINT AS a, round(coalesce(n.b, o.b), 4) AS b FROM o FULL JOIN n USING (c_custkey)""")
def upsert_coalesced(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"), F.col("c_acctbal").alias("b"))
    new = c.filter("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit(-1).cast("long")).alias("a"), (F.col("b") + 1).alias("b"))
    return snapshots.upsert_coalesce(c.filter("c_custkey % 3 <> 0"), new, ["c_custkey"]).withColumn("b", F.round("b", 4))


# ---- text -------------------------------------------------------------------------------------------------------


_RULES = X.term_rules(2026)


def _term_sql() -> str:
    steps, fired = ["t0 AS (SELECT doc_id, text, text AS x FROM documents)"], []
    for i, (pattern, replacement, label) in enumerate(_RULES):
        fired.append(f"CASE WHEN f{i} THEN '{label}' END")
        steps.append(f"t{i + 1} AS (SELECT * REPLACE (regexp_replace(x, '{pattern}', '{replacement}', 'g') AS x), regexp_matches(x, '{pattern}') AS f{i} FROM t{i})")
    return f"""WITH {", ".join(steps)} SELECT doc_id, md5(x) AS text_md5, array_to_string(list_filter([{", ".join(fired)}], lambda x: x IS NOT NULL), ';') AS rules, nullif(regexp_extract(text, '\\b(20[0-9]{{2}})\\b', 1), '')::INTEGER AS year, regexp_matches(text, '(?i)\\b(?:[0-9]{{11}}|fips|tract|county|state|cbsa|msa|city)\\b') AS has_place, contains(text, 'License') AS stated FROM t{len(_RULES)}"""


@query(_term_sql())
def normalize_terms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    done = table(spark, d, "documents").select("doc_id", "text", X.normalise_terms(t, _RULES).alias("terms"))
    return done.select("doc_id", F.md5("terms.text").alias("text_md5"), F.array_join("terms.labels", ";").alias("rules"), X.year_in(t).alias("year"), X.has_place(t).alias("has_place"), X.stated(F.lit("License"), t).alias("stated"))


@query("""SELECT s_suppkey, 'Los Area' || s_nationkey || ', AZ MSA' AS metro, 'los area ' || s_nationkey AS camel, 'losarea' || s_nationkey AS name_key, s_suppkey % 5 < 2 AS is_noise, CASE s_suppkey % 3 WHEN 0 THEN 'ELI' WHEN 1 THEN 'VLI' ELSE 'LI' END AS program, CASE s_suppkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 50 ELSE 80 END::INTEGER AS ami_pct FROM supplier""")
def name_repair(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_nationkey").cast("string")
    m = F.col("s_suppkey") % 5
    noise = F.when(m == 0, "Page 3 of 12").when(m == 1, F.lit("77")).otherwise("Barbour")
    label = F.when(F.col("s_suppkey") % 3 == 0, "30% OF MEDIAN").when(F.col("s_suppkey") % 3 == 1, "VERY LOW INCOME").otherwise("LOW-INCOME")
    program = F.create_map(*[F.lit(x) for kv in lines.PROGRAMS.items() for x in kv])[label]
    percent = F.create_map(*[F.lit(x) for kv in lines.AMI_PERCENT.items() for x in kv])[program]
    return table(spark, d, "supplier").select(
        "s_suppkey", X.metro_name(F.concat(F.lit("LosArea"), k, F.lit(",AZMSA[GOZone]"))).alias("metro"), F.lower(X.split_camel(F.concat(F.lit("LosArea "), k))).alias("camel"),
        X.name_key(F.concat(F.lit("Los-Area "), k)).alias("name_key"), X.is_noise(noise).alias("is_noise"), program.alias("program"), percent.alias("ami_pct"),
    )


from . import registers, small_rules, stored, text_lines, whole_graph  # noqa: E402, F401  more queries, in the same registry
