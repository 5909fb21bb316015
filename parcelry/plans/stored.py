"""Queries that write tables in the shared folder on their way: snapshots in buckets and what is kept with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import content, risk, snapshots
from ..operators.buckets import BucketedTable
from ..sources.places import new_folder
from .registry import query
from .stand_ins import ROUNDED, applications, card_sql, rounded, table

_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus"]


def _increments(spark: SparkSession, d: str) -> list[DataFrame]:
    """Orders as they came: the first load, then changes of one order in 211 and new and changed ones of one in 307."""
    o = table(spark, d, "orders").select(*_COLUMNS)
    first = o.filter("o_orderkey % 307 <> 5")
    second = o.filter("o_orderkey % 211 = 3 and o_orderkey % 307 <> 5").withColumn("o_orderstatus", F.lit("X"))
    third = o.filter("o_orderkey % 307 = 5 or o_orderkey % 211 = 3 and o_orderkey % 2 = 0 and o_orderkey % 307 <> 5").withColumn("o_custkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey")).otherwise(-1))
    return [first, second, third]


_INCREMENTS = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders),
i AS (SELECT 0 AS step, * FROM o WHERE o_orderkey % 307 <> 5 UNION ALL SELECT 1, o_orderkey, o_custkey, 'X' FROM o WHERE o_orderkey % 211 = 3 AND o_orderkey % 307 <> 5
  UNION ALL SELECT 2, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey ELSE -1 END, o_orderstatus FROM o WHERE o_orderkey % 307 = 5 OR o_orderkey % 211 = 3 AND o_orderkey % 2 = 0 AND o_orderkey % 307 <> 5),
f AS (SELECT o_orderkey, arg_max(o_custkey, step) AS o_custkey, arg_max(o_orderstatus, step) AS o_orderstatus FROM i GROUP BY 1)"""
_HEX = "sha256('{\"o_custkey\":\"' || o_custkey || '\",\"o_orderkey\":\"' || o_orderkey || '\",\"o_orderstatus\":\"' || o_orderstatus || '\"}')"
_HASH = "format('{:016x}', count(*)) || " + " || ".join(f"format('{{:015x}}', (sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT::HUGEINT) % 1152921504606846976)::BIGINT)" for i in range(content.LANES))
_BUCKETS = 64
_BUCKET = f"(('0x' || substr(md5('v' || o_orderkey), 1, 8))::BIGINT % {_BUCKETS})::INTEGER"


def _upserted(spark: SparkSession, d: str) -> BucketedTable:
    t = BucketedTable(spark, new_folder(spark), ["o_orderkey"], _BUCKETS)
    for i, increment in enumerate(_increments(spark, d)):
        t.upsert(increment, batch=str(i))
    return t


@query(f"WITH {_INCREMENTS} SELECT * FROM f")
def bucketed_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return _upserted(spark, d).read()


@query(f"""WITH {_INCREMENTS}, v AS (SELECT {_BUCKET} AS bucket, max(step)::BIGINT AS version FROM i GROUP BY 1)
SELECT bucket, version, count(*) AS n_rows, {_HASH} AS content_hash FROM (SELECT {_BUCKET} AS bucket, {_HEX} AS h FROM f) JOIN v USING (bucket) GROUP BY 1, 2""")
def bucket_versions(spark: SparkSession, d: str) -> DataFrame:
    return _upserted(spark, d).summary()


@query(f"WITH {_INCREMENTS} SELECT 'orders' AS dataset, count(*) AS row_count, {_HASH} AS content_hash FROM (SELECT {_HEX} AS h FROM f)")
def registry_from_buckets(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([("orders", *_upserted(spark, d).hash())], "dataset string, row_count long, content_hash string")


@query(f"WITH {_INCREMENTS} SELECT o_custkey % 16 AS part, count(*) AS n_rows, {_HASH} AS content_hash FROM (SELECT o_custkey, {_HEX} AS h FROM f) GROUP BY 1")
def updated_content_hash(spark: SparkSession, d: str) -> DataFrame:
    """The first load's hashes, and then only those of rows that increments take away and add."""
    part = (F.col("o_custkey") % 16).alias("part")
    now, *increments = _increments(spark, d)
    parts = content.parts_of(now.withColumn("part", part), _COLUMNS, ["part"])
    for new in increments:
        changes = content.row_changes(now, new, ["o_orderkey"], ["o_custkey", "o_orderstatus"]).withColumn("part", part)
        parts = parts.unionByName(content.parts_of(changes, _COLUMNS, ["part"], F.col("sign")))
        now = snapshots.upsert(now, new, ["o_orderkey"])
    return content.merged(parts, ["part"]).select("part", "n_rows", content.content_hash_of().alias("content_hash")).filter("n_rows > 0")


@query(f"""WITH {_INCREMENTS}, k AS (SELECT step, i.*, lag({_HEX}) OVER (PARTITION BY o_orderkey ORDER BY step) AS before, {_HEX} AS h FROM i)
SELECT step, CASE WHEN before IS NULL THEN 'CREATE' WHEN before = h THEN 'SKIP' ELSE 'MERGE' END AS action, count(*) AS n FROM k GROUP BY ALL""")
def incremental_application(spark: SparkSession, d: str) -> DataFrame:
    at = new_folder(spark)
    nodes, state = (BucketedTable(spark, f"{at}/{name}", ["o_orderkey"], _BUCKETS) for name in ("nodes", "state"))
    out = None
    for i, increment in enumerate(_increments(spark, d)):
        counts = snapshots.apply_changes(increment, ["o_orderkey"], _COLUMNS, nodes, state).select(F.lit(i).alias("step"), "action", "n")
        out = counts if out is None else out.unionByName(counts)
    return out


@query(card_sql() + f" SELECT {ROUNDED} FROM card")
def scorecard_from_increments(spark: SparkSession, d: str) -> DataFrame:
    """Applications come in three increments, the last of them twice; the card is made of the stored counts."""
    apps, state = applications(spark, d), risk.card_state(spark, new_folder(spark), n_buckets=16)
    for i, part in enumerate(("purchaser < '3'", "purchaser = '3'", "purchaser > '3'", "purchaser > '3'")):
        risk.add_applications(state, apps.filter(part), f"part {min(i, 2)}")
    return rounded(risk.card_of(state.read()))


_AREAS = "SELECT (l_suppkey % 25 % 5)::BIGINT AS state, year(l_shipdate)::INTEGER AS year, l_partkey FROM lineitem"


@query(f"WITH a AS ({_AREAS}), s AS (SELECT state, year, l_partkey FROM a UNION ALL SELECT state, NULL, l_partkey FROM a) SELECT state, year, count(DISTINCT l_partkey) AS exact, true AS is_within FROM s GROUP BY 1, 2")
def lender_sketch_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct parts by county and year as sketches, rolled up to states and years and again to states, beside exact counts."""
    a = table(spark, d, "lineitem").select((F.col("l_suppkey") % 25).alias("county"), F.year("l_shipdate").alias("year"), "l_partkey")
    counties = risk.lender_sketches(a, ["county", "year"], "l_partkey").withColumn("state", F.col("county") % 5)
    by_year = risk.rolled_up(counties, ["state", "year"])
    whole = risk.rolled_up(by_year, ["state"]).select("state", F.lit(None).cast("int").alias("year"), "sketch")
    estimated = risk.estimated_lenders(by_year.unionByName(whole)).select(F.col("state").alias("s"), F.col("year").alias("y"), "lender_count", "lender_count_error")
    rows = a.select((F.col("county") % 5).alias("state"), F.explode(F.array("year", F.lit(None).cast("int"))).alias("year"), "l_partkey")
    exact = rows.groupBy("state", "year").agg(F.count_distinct("l_partkey").alias("exact"))
    both = exact.join(estimated, (F.col("state") == F.col("s")) & F.col("year").eqNullSafe(F.col("y")))
    return both.select("state", "year", "exact", (F.abs(F.col("lender_count") - F.col("exact")) <= F.greatest("lender_count_error", F.lit(1.0))).alias("is_within"))
