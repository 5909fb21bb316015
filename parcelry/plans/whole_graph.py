"""The graph of all patterns over tables that stand in for its labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from .registry import query
from .stand_ins import table

LABELS = ("State", "County", "MetroArea", "CensusTract", "QCTDesignation", "SDDADesignation", "NMDDADesignation", "StateAMILimit", "Section8AMILimit", "LenderBehaviorRisk", "SpecialProgramLimit")


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    region, nation, customer, supplier, part, orders = (table(spark, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders"))
    text: Column = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    year = (1995 + F.col("p_partkey") % 3).cast("int").alias("year")
    code = F.when(F.col("s_suppkey") % 3 != 0, (F.col("s_suppkey") % 40).cast("string")).otherwise("").alias("cbsa_code")
    return {
        "State": region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")),
        "County": nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("state_fips"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") * 10).alias("cbsa_code")),
        "MetroArea": supplier.filter("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_nationkey") % 6).alias("state_fips"), text("F", F.col("s_suppkey") % 50).alias("fmr_area_code")),
        "CensusTract": customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("county_fips"), (F.col("c_custkey") % 100).alias("cbsa_code")),
        "QCTDesignation": orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") + 5).alias("tract_fips")),
        "SDDADesignation": part.filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("id"), "p_brand", text("F", F.col("p_size")).alias("fmr_area_code")),
        "NMDDADesignation": part.filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_size").alias("county_fips")),
        "StateAMILimit": part.filter("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 7).alias("state_fips"), year),
        "Section8AMILimit": part.filter("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("id"), text("A", F.col("p_size") % 9).alias("hud_area_code"), year),
        "LenderBehaviorRisk": supplier.select(F.col("s_suppkey").alias("id"), code, F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).alias("county_fips")),
        "SpecialProgramLimit": part.filter("p_brand = 'Brand#3'").select(F.col("p_partkey").alias("id"), year),
        "crosswalk": supplier.select((F.col("s_nationkey") + 3).alias("county_fips"), text("A", F.col("s_suppkey") % 7).alias("hud_area_code"), (1995 + F.col("s_suppkey") % 3).cast("int").alias("year")),
        "non_metro": nation.filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("county_fips"), F.col("n_regionkey").alias("state_fips")),
    }


_TABLES = """st AS (SELECT r_regionkey AS id, r_name AS name FROM region), co AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey AS state_fips, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 10 END AS cbsa_code FROM nation),
me AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey % 6 AS state_fips, 'F' || s_suppkey % 50 AS fmr_area_code FROM supplier WHERE s_suppkey % 10 = 0), tr AS (SELECT c_custkey AS id, c_nationkey AS county_fips, c_custkey % 100 AS cbsa_code FROM customer),
qc AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey + 5 AS tract_fips FROM orders), sd AS (SELECT p_partkey AS id, p_brand, 'F' || p_size AS fmr_area_code FROM part WHERE p_type = 'PROMO'),
nm AS (SELECT p_partkey AS id, p_brand, p_size AS county_fips FROM part WHERE p_type = 'ECONOMY'), sl AS (SELECT p_partkey AS id, p_size % 7 AS state_fips, 1995 + p_partkey % 3 AS year FROM part WHERE p_brand = 'Brand#1'),
s8 AS (SELECT p_partkey AS id, 'A' || p_size % 9 AS hud_area_code, 1995 + p_partkey % 3 AS year FROM part WHERE p_brand = 'Brand#2'), sp AS (SELECT p_partkey AS id, 1995 + p_partkey % 3 AS year FROM part WHERE p_brand = 'Brand#3'),
ri AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 40)::VARCHAR ELSE '' END AS cbsa_code, CASE WHEN s_acctbal > 0 THEN s_nationkey END AS county_fips FROM supplier),
xw AS (SELECT s_nationkey + 3 AS county_fips, 'A' || s_suppkey % 7 AS hud_area_code, 1995 + s_suppkey % 3 AS year FROM supplier), nn AS (SELECT n_nationkey AS county_fips, n_regionkey AS state_fips FROM nation WHERE n_nationkey % 3 = 0)"""
_SIMPLE = (
    ("County", "IN_STATE", "State", "co", "state_fips", "st", "id"), ("MetroArea", "IN_STATE", "State", "me", "state_fips", "st", "id"), ("CensusTract", "IN_COUNTY", "County", "tr", "county_fips", "co", "id"),
    ("CensusTract", "IN_METRO", "MetroArea", "tr", "cbsa_code", "me", "id"), ("County", "IN_METRO", "MetroArea", "co", "cbsa_code", "me", "id"), ("QCTDesignation", "APPLIES_TO", "CensusTract", "qc", "tract_fips", "tr", "id"),
    ("SDDADesignation", "APPLIES_TO", "MetroArea", "sd", "fmr_area_code", "me", "fmr_area_code"), ("NMDDADesignation", "APPLIES_TO", "County", "nm", "county_fips", "co", "id"), ("StateAMILimit", "APPLIES_TO", "State", "sl", "state_fips", "st", "id"),
    ("LenderBehaviorRisk", "APPLIES_TO", "MetroArea", "ri", "cbsa_code", "me", "id"), ("LenderBehaviorRisk", "APPLIES_TO", "County", "ri", "county_fips", "co", "id"),
)
_EDGES = "edges AS (" + " UNION ".join(f"SELECT '{s}' AS src_label, a.id::VARCHAR AS src_id, '{r}' AS rel_type, '{t}' AS dst_label, b.id::VARCHAR AS dst_id FROM {x} a JOIN {y} b ON a.{f}::VARCHAR = b.{m}::VARCHAR" for s, r, t, x, f, y, m in _SIMPLE) + """
  UNION SELECT 'County', co.id::VARCHAR, 'HAS_MSA_AMI', 'Section8AMILimit', s8.id::VARCHAR FROM co JOIN xw ON xw.county_fips = co.id JOIN s8 USING (hud_area_code, year) UNION SELECT 'County', co.id::VARCHAR, 'HAS_STATE_AMI', 'StateAMILimit', sl.id::VARCHAR FROM co JOIN nn ON nn.county_fips = co.id JOIN sl ON sl.state_fips = nn.state_fips)"""
_NODES = "nodes AS (" + " UNION ALL ".join(
    f"SELECT '{label}' AS label, id::VARCHAR AS id, {json} AS properties FROM {t}"
    for label, t, json in (
        ("State", "st", """'{"id":' || id || ',"name":"' || name || '"}'"""), ("County", "co", """'{"id":' || id || ',"name":"' || name || '","state_fips":' || state_fips || coalesce(',"cbsa_code":' || cbsa_code, '') || '}'"""),
        ("MetroArea", "me", """'{"id":' || id || ',"name":"' || name || '","state_fips":' || state_fips || ',"fmr_area_code":"' || fmr_area_code || '"}'"""), ("CensusTract", "tr", """'{"id":' || id || ',"county_fips":' || county_fips || ',"cbsa_code":' || cbsa_code || '}'"""),
        ("QCTDesignation", "qc", """'{"id":' || id || ',"status":"' || status || '"}'"""), ("SDDADesignation", "sd", """'{"id":' || id || ',"p_brand":"' || p_brand || '"}'"""), ("NMDDADesignation", "nm", """'{"id":' || id || ',"p_brand":"' || p_brand || '"}'"""),
        ("StateAMILimit", "sl", """'{"id":' || id || ',"state_fips":' || state_fips || ',"year":' || year || '}'"""), ("Section8AMILimit", "s8", """'{"id":' || id || ',"hud_area_code":"' || hud_area_code || '","year":' || year || '}'"""),
        ("LenderBehaviorRisk", "ri", """'{"id":' || id || ',"cbsa_code":"' || cbsa_code || '"' || coalesce(',"county_fips":' || county_fips, '') || '}'"""), ("SpecialProgramLimit", "sp", """'{"id":' || id || ',"year":' || year || '}'"""),
    )
) + ")"


@query(f"WITH {_TABLES}, {_EDGES} SELECT * FROM edges")
def whole_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.all_edges(_tables(spark, d))


@query(f"WITH {_TABLES}, {_NODES} SELECT * FROM nodes")
def whole_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.all_nodes(_tables(spark, d), LABELS)


@query(f"WITH {_TABLES}, {_EDGES}, p AS (SELECT * FROM (VALUES {', '.join(repr((p.rel, p.src, p.dst)) for p in graph.PATTERNS)}) v(rel_type, src_label, dst_label)) SELECT rel_type, src_label, dst_label, count(src_id) AS n, CASE WHEN count(src_id) = 0 THEN 'MISSING' ELSE 'OK' END AS status FROM p LEFT JOIN edges USING (rel_type, src_label, dst_label) GROUP BY ALL")
def pattern_audit(spark: SparkSession, d: str) -> DataFrame:
    return graph.pattern_audit(graph.all_edges(_tables(spark, d)))


@query(f"""WITH {_TABLES}, {_EDGES}, {_NODES}, ends AS (SELECT src_label AS l, src_id AS i FROM edges UNION SELECT dst_label, dst_id FROM edges)
SELECT label, count(*) AS n_nodes, (SELECT count(*) FROM edges WHERE src_label = label) AS n_out, (SELECT count(*) FROM edges WHERE dst_label = label) AS n_in, count(i) AS n_connected, count(*) - count(i) AS n_orphans, round((count(*) - count(i)) * 100.0::DOUBLE / count(*), 4) AS orphan_pct
FROM nodes LEFT JOIN ends ON l = label AND i = id GROUP BY label""")
def standalone_audit(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d)
    return graph.audit(graph.all_nodes(t, LABELS), graph.all_edges(t))
