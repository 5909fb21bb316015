"""Queries of single rules: codes, flags, labels, entities, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import measures as M
from ..functions import states
from ..functions import text as X
from ..operators import checks, graph, keep, lines
from .registry import query
from .stand_ins import table

_TRACT = "lpad(c_custkey::VARCHAR, 11, '0')"


@query(f"SELECT c_custkey, {_TRACT} AS tract, substr({_TRACT}, 1, 5) AS county, substr({_TRACT}, 1, 2) AS state FROM customer")
def code_slices(spark: SparkSession, d: str) -> DataFrame:
    tract = C.padded(F.col("c_custkey").cast("string"), 11)
    return table(spark, d, "customer").select("c_custkey", tract.alias("tract"), C.county_of(tract).alias("county"), C.state_of(tract).alias("state"))


@query("SELECT l_orderkey, l_linenumber, l_quantity >= 5 AND l_quantity < 45 AS is_multifamily FROM lineitem")
def multifamily_flags(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    units = F.when(q < 5, "1").when(q < 10, "5-24").when(q < 20, "25-49").when(q < 30, "50-99").when(q < 40, "100-149").when(q < 45, ">149")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.is_multifamily(units).alias("is_multifamily"))


@query("""WITH s AS (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Puerto Rico' WHEN 1 THEN ' WYOMING ' WHEN 2 THEN 'new york' WHEN 3 THEN 'Nowhere' END AS name FROM nation)
SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'PR' WHEN 1 THEN 'WY' WHEN 2 THEN 'NY' END AS abbr, CASE n_nationkey % 5 WHEN 0 THEN '72' WHEN 1 THEN '56' WHEN 2 THEN '36' END AS fips, CASE n_nationkey % 3 WHEN 0 THEN 'SEC236' WHEN 1 THEN 'SEC221_BMIR' ELSE 'SEC235' END AS program FROM s""")
def state_and_program_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    name = F.when(k % 5 == 0, "Puerto Rico").when(k % 5 == 1, " WYOMING ").when(k % 5 == 2, "new york").when(k % 5 == 3, "Nowhere")
    label = F.when(k % 3 == 0, "Section 236").when(k % 3 == 1, "Sec. 221 BMIR").otherwise("Section 235")
    program = F.create_map(*[F.lit(x) for kv in lines.SECTION_PROGRAMS.items() for x in kv])[label]
    return table(spark, d, "nation").select(k, states.state_abbr(name).alias("abbr"), states.state_fips(name).alias("fips"), program.alias("program"))


@query(r"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'QCT status of tract ' || lpad(o_custkey::VARCHAR, 11, '0') || ' in ' || year(o_orderdate) WHEN 1 THEN 'XYZ and ABCD or QCT, XYZ?' WHEN 2 THEN 'number 123456789012 of 1999' ELSE 'in ' || o_orderpriority END AS q FROM orders)
SELECT o_orderkey, nullif(regexp_extract(q, '\b([0-9]{11})\b', 1), '') AS tract, array_to_string(list_filter(['XYZ', 'ABCD', 'URGENT', 'HIGH', 'MEDIUM', 'LOW', 'SPECIFIED', 'NOT'], lambda x: regexp_matches(q, '\b' || x || '\b') AND length(x) BETWEEN 3 AND 6 AND x <> 'NOT'), ' ') AS unknown FROM t""")
def question_entities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    q = F.when(k == 0, F.concat(F.lit("QCT status of tract "), F.lpad(F.col("o_custkey").cast("string"), 11, "0"), F.lit(" in "), F.year("o_orderdate").cast("string"))).when(k == 1, "XYZ and ABCD or QCT, XYZ?").when(k == 2, "number 123456789012 of 1999").otherwise(F.concat(F.lit("in "), F.col("o_orderpriority")))
    return table(spark, d, "orders").select("o_orderkey", X.tract_code(q).alias("tract"), F.array_join(X.unknown_acronyms(q, ["QCT", "NOT"]), " ").alias("unknown"))


@query("""WITH p AS (SELECT p_size % 3 AS flag, CASE WHEN p_partkey % 9 = 0 THEN '123' ELSE lpad(p_partkey::VARCHAR, 11, '0') END AS code, CASE WHEN p_partkey % 5 = 0 THEN 20 WHEN p_size % 3 = 1 THEN 30 ELSE 0 END AS boost, p_retailprice AS lim, p_retailprice * 0.03 + CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 0 END AS rent FROM part)
SELECT 'flag_domain' AS check_name, count_if(flag NOT IN (0, 1))::BIGINT AS n_bad FROM p UNION ALL SELECT 'code_width', count_if(length(code) <> 11)::BIGINT FROM p UNION ALL SELECT 'boost', count_if(boost <> CASE WHEN flag <> 0 THEN 30 ELSE 0 END)::BIGINT FROM p UNION ALL SELECT 'rent', count_if(abs(lim * 0.03 - rent) >= 1)::BIGINT FROM p""")
def designation_validation(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    p = table(spark, d, "part").select(
        (size % 3).alias("flag"), F.when(k % 9 == 0, "123").otherwise(F.lpad(k.cast("string"), 11, "0")).alias("code"), F.when(k % 5 == 0, 20).when(size % 3 == 1, 30).otherwise(0).alias("boost"),
        F.col("p_retailprice").alias("lim"), (F.col("p_retailprice") * 0.03 + F.when(k % 4 == 0, 2).otherwise(0)).alias("rent"),
    )
    return checks.count_checks(p, checks.designation_checks("flag", "code", 11, "boost", "lim", "rent"))


@query("SELECT 'orders' AS dataset, count(*) AS n_rows, 1000::BIGINT AS least, count(*) >= 1000 AS is_enough FROM orders UNION ALL SELECT 'region', count(*), 1000, count(*) >= 1000 FROM region")
def row_floor_report(spark: SparkSession, d: str) -> DataFrame:
    return checks.row_floors({"orders": (table(spark, d, "orders"), 1000), "region": (table(spark, d, "region"), 1000)})


@query("WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS state FROM orders) SELECT * FROM s WHERE state IS NULL OR state NOT IN ('F', 'O')")
def unexpected_states(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")).alias("state"))
    return checks.unexpected(s, "state", ["F", "O"])


@query("""WITH s AS (SELECT CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 50 END AS area, o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice END AS price FROM orders)
SELECT area, arg_min(status, o_orderkey) FILTER (status IS NOT NULL) AS status, arg_min(price, o_orderkey) FILTER (price IS NOT NULL) AS price FROM s GROUP BY 1""")
def collapse_with_null_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = table(spark, d, "orders").select(F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 50).alias("area"), "o_orderkey", F.when(k % 3 != 0, F.col("o_orderstatus")).alias("status"), F.when(k % 7 == 0, F.col("o_totalprice")).alias("price"))
    return keep.first_values(s, ["area"], ["o_orderkey"], ["status", "price"], drop_null_keys=False)


@query("SELECT 'Customer' AS label, c_custkey::VARCHAR AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def orphan_nodes(spark: SparkSession, d: str) -> DataFrame:
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders").filter("o_totalprice > 300000")
    edges = graph.edges(orders, "Order", "o_orderkey", "OF", "Customer", F.col("o_custkey"), customers, "c_custkey")
    return graph.orphans(graph.nodes(customers, "Customer", "c_custkey", [], []), edges)


@query("""WITH g AS (SELECT user_id, value AS x, lead(value) OVER (PARTITION BY user_id ORDER BY value) - value AS gap FROM events)
SELECT user_id, round(arg_max(x + gap / 2, [gap, -x]), 6) AS bound FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def column_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "value")
    return lines.widest_gap(e, ["user_id"], "value").select("user_id", F.round("bound", 6).alias("bound"))
