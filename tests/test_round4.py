"""Edges without a distinct after the join, and what else larger tables asked for."""

import hashlib

from pyspark.sql import functions as F

from parcelry.operators import checks, content, graph, matching, risk
from parcelry.operators.buckets import BucketedTable
from parcelry.plans import registers as plans
from parcelry.sources import registers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ran(df):
    """The plan after optimization, from the result down."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def above_join(df):
    """Operators between the result and its first join."""
    return ran(df).split("Join ")[0]


def many_keys(spark):
    make = spark.createDataFrame
    counties = make([("01",), ("03",), ("01",)], "id string")
    crosswalk = make([("01", "A", 1), ("01", "B", 1), ("01", "B", 1), ("03", "B", 1), ("03", "C", 2), ("03", None, 2)], "county_fips string, hud_area_code string, year int")
    limits = make([("m1", "A", 1), ("m1", "B", 1), ("m1", "B", 1), ("m2", "B", 1), ("m3", "C", 1), ("m4", None, 2), (None, "A", 1)], "id string, hud_area_code string, year int")
    want = [("County", c, "HAS_MSA_AMI", "Section8AMILimit", m) for c, m in (("01", "m1"), ("01", "m2"), ("03", "m1"), ("03", "m2"))]
    return counties, crosswalk, limits, want


def test_edges_of_several_shared_keys_are_one_without_a_distinct_after_the_join(spark):
    counties, crosswalk, limits, want = many_keys(spark)
    pattern = graph.Pattern("County", "HAS_MSA_AMI", "Section8AMILimit", ("hud_area_code", "year"), ("hud_area_code", "year"), "crosswalk", "county_fips")
    found = graph.all_edges({"County": counties, "crosswalk": crosswalk, "Section8AMILimit": limits}, [pattern])
    assert rows(found) == want
    assert "Aggregate" not in above_join(found)


def test_patterns_of_one_name_give_an_edge_once(spark):
    make = spark.createDataFrame
    tables = {"A": make([("a", "b", "x"), ("a2", "b", "y")], "id string, p string, q string"), "B": make([("b", "x")], "id string, code string")}
    found = graph.all_edges(tables, [graph.Pattern("A", "TO", "B", ("p",)), graph.Pattern("A", "TO", "B", ("q",), ("code",))])
    assert rows(found) == [("A", "a", "TO", "B", "b"), ("A", "a2", "TO", "B", "b")]


def test_crosswalk_edges_are_one_without_a_distinct_after_the_join(spark):
    counties, crosswalk, limits, want = many_keys(spark)
    found = graph.through_crosswalk(counties, "id", crosswalk, limits.filter("id is not null"), "id")
    assert rows(found) == want
    assert "Aggregate" not in above_join(found)


def test_places_are_counted_by_text_before_requests_meet_them(spark):
    places = spark.createDataFrame([("AL", "Alabama", "1", "Clay County"), ("GA", "Georgia", "2", "clay county"), ("GA", "Georgia", "3", "Clayton County"), ("GA", "Georgia", "4", None)], "state string, state_name string, place_code string, place_name string")
    asked = spark.createDataFrame([(1, "clay", "georgia"), (2, "CLAY C", None), (3, "", None), (4, None, None), (5, "clay", None), (6, "nowhere", None), (7, "Clay", None), (7, "Clay", None)], "request_id int, query string, state string")
    found = matching.count_places(asked, places)
    rowwise = matching.resolve_places(asked.filter("state is null"), places).groupBy("request_id", "query").agg(F.count("*").alias("n"), F.min("place_code").alias("first_code"), F.max("place_name").alias("last_name"))
    assert rows(found) == rows(rowwise)
    # 2,000 requests of one text and 500 places: what requests are joined with has a row a text
    many = spark.createDataFrame([(k, "#", None) for k in range(2000)], "request_id int, query string, state string")
    all_places = spark.createDataFrame([("s", "s", str(k), f"c#{k}") for k in range(500)], "state string, state_name string, place_code string, place_name string")
    counted = matching.count_places(many, all_places)
    assert counted.agg(F.count("*"), F.sum("n")).first() == (2000, 1_000_000)
    assert "Aggregate [query" in ran(counted).split("Join ")[1]


def test_an_increment_is_computed_once(spark, tmp_path):
    """Its counts are written before their buckets are asked for."""
    read = spark.sparkContext.accumulator(0)

    def seen(k):
        read.add(1)
        return ("3", f"L{k % 3}", "100", "1", "5", "2", False, "4", f"{k % 5:05d}", 2020)

    columns = "action string, lender_id string, amount string, purchaser string, race string, ethnicity string, multifamily boolean, denial_reason string, county_fips string, assessment_year int"
    apps = spark.createDataFrame(spark.sparkContext.parallelize(range(100), 2).map(seen), columns)
    state = risk.card_state(spark, str(tmp_path / "state"), n_buckets=4)
    card = risk.add_applications(state, apps, "a")
    assert sum(r["total_applications"] for r in card.collect()) == 100
    assert read.value == 100


def test_register_lines_are_split_once(spark, tmp_path):
    """Filters on fields of a line don't split it again."""
    layout = registers.LONG
    (tmp_path / "r.txt").write_text("".join("|".join({"activity_year": "2019", "action_taken": str(k % 4)}.get(c, "") for c in layout) + "\n" for k in range(8)))
    found = checks.actionable(registers.read_registers(spark, str(tmp_path / "r.txt"), registers.APPLICATION_COLUMNS), "action_taken", fields="n_fields")
    assert found.count() == 4
    assert ran(found).count("split(") == 1


def test_register_lines_are_written_without_arrays_of_fields(spark):
    values = {"activity_year": F.lit("2019"), "lei": F.lit("L"), "denial_reason_1": F.lit(None).cast("string"), "action_taken": F.col("id").cast("string")}
    for layout in (registers.LONG, registers.SHORT, registers.LONG[:80], registers.SHORT[1:4]):
        line = spark.range(2, 3).select(plans._joined(values, layout).alias("t"))
        plain = "|".join({"activity_year": "2019", "lei": "L", "action_taken": "2"}.get(c, "") for c in layout)
        assert line.first()["t"] == plain


def test_first_rows_of_a_bucketed_table_are_computed_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(k):
        read.add(1)
        return (k, str(k))

    made = spark.createDataFrame(spark.sparkContext.parallelize(range(100), 2).map(seen), "k long, v string")
    assert BucketedTable(spark, str(tmp_path / "t"), ["k"], 4).upsert(made).count() == 100
    assert read.value == 100


def test_hashes_add_up_without_decimals_a_row(spark):
    parts = content.parts_of(spark.range(1000).select("id", (F.col("id") % 3).alias("p")), ["id"], ["p"])
    lanes = [[int(h[15 * i : 15 * i + 15], 16) for h in (hashlib.sha256(f'{{"id":"{k}"}}'.encode()).hexdigest() for k in range(1, 1000, 3))] for i in range(4)]
    assert [int(parts.filter("p = 1").first()[c]) for c in content.PARTS] == [sum(x) % (1 << 60) for x in lanes]
    gone = content.merged(parts.unionByName(content.parts_of(spark.range(1, 1000, 3).withColumn("p", F.lit(1).cast("long")), ["id"], ["p"], F.lit(-1))), ["p"])
    assert [int(gone.filter("p = 1").first()[c]) for c in ("n_rows", *content.PARTS)] == [0] * 5
    assert "decimal(38,0)) *" not in ran(parts)
