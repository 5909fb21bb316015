"""Whole graph, name search, registers, panels, yearly bundles and layouts on small cases."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from parcelry.operators import checks, graph, keep, matching, risk, snapshots, vintages
from parcelry.sources import files, registers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def small_graph(spark):
    make = spark.createDataFrame
    return {
        "State": make([("01", "A"), ("02", "B"), ("01", "A again")], "id string, name string"),
        "County": make([("01001", "01", "100"), ("01003", "09", ""), ("02001", None, None), (None, "01", "100")], "id string, state_fips string, cbsa_code string"),
        "MetroArea": make([("100", "02", "F1"), ("200", "01", None)], "id string, state_fips string, fmr_area_code string"),
        "CensusTract": make([(1, "01001", "200"), (2, "99999", None)], "id int, county_fips string, cbsa_code string"),
        "QCTDesignation": make([("q1", 1, "x"), ("q2", 7, None), ("q1", 1, "y")], "id string, tract_fips int, run_id string"),
        "SDDADesignation": make([("s1", "F1"), ("s2", "F9")], "id string, fmr_area_code string"),
        "NMDDADesignation": make([("n1", "01003")], "id string, county_fips string"),
        "StateAMILimit": make([("l1", "01", 2020)], "id string, state_fips string, year int"),
        "Section8AMILimit": make([("m1", "AREA", 2020), ("m2", "AREA", 2021)], "id string, hud_area_code string, year int"),
        "LenderBehaviorRisk": make([("r1", "100", None), ("r2", "", "01001")], "id string, cbsa_code string, county_fips string"),
        "crosswalk": make([("01001", "AREA", 2020), ("01001", "AREA", 2020), ("77777", "AREA", 2020), ("01003", "AREA", None)], "county_fips string, hud_area_code string, year int"),
        "non_metro": make([("01003", "01"), ("88888", "01")], "county_fips string, state_fips string"),
    }


def test_all_patterns_in_one_join(spark):
    edges = graph.all_edges(small_graph(spark))
    assert rows(edges) == sorted([
        ("County", "01001", "IN_STATE", "State", "01"), ("MetroArea", "100", "IN_STATE", "State", "02"), ("MetroArea", "200", "IN_STATE", "State", "01"), ("CensusTract", "1", "IN_COUNTY", "County", "01001"),
        ("CensusTract", "1", "IN_METRO", "MetroArea", "200"), ("County", "01001", "IN_METRO", "MetroArea", "100"), ("QCTDesignation", "q1", "APPLIES_TO", "CensusTract", "1"), ("SDDADesignation", "s1", "APPLIES_TO", "MetroArea", "100"),
        ("NMDDADesignation", "n1", "APPLIES_TO", "County", "01003"), ("StateAMILimit", "l1", "APPLIES_TO", "State", "01"), ("LenderBehaviorRisk", "r1", "APPLIES_TO", "MetroArea", "100"), ("LenderBehaviorRisk", "r2", "APPLIES_TO", "County", "01001"),
        ("County", "01001", "HAS_MSA_AMI", "Section8AMILimit", "m1"), ("County", "01003", "HAS_STATE_AMI", "StateAMILimit", "l1"),
    ], key=repr)
    assert {r["status"] for r in graph.pattern_audit(edges).collect()} == {"OK"} and graph.pattern_audit(edges).count() == 13
    missing = graph.pattern_audit(edges.filter("rel_type <> 'IN_METRO'")).filter("status = 'MISSING'")
    assert rows(missing.select("src_label", "n")) == [("CensusTract", 0), ("County", 0)]


def test_the_graph_plan_has_one_join_of_tagged_keys(spark):
    plan = graph.all_edges(small_graph(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and plan.count("Join LeftSemi") == 2 and "Window" not in plan


def test_node_properties(spark):
    t = small_graph(spark)
    got = rows(graph.all_nodes(t, ["State", "QCTDesignation", "County"], order={"State": ["name"]}))
    assert got == sorted([("State", "01", '{"id":"01","name":"A"}'), ("State", "02", '{"id":"02","name":"B"}'), ("QCTDesignation", "q1", '{"id":"q1"}'), ("QCTDesignation", "q2", '{"id":"q2"}'),
        ("County", "01001", '{"id":"01001","state_fips":"01","cbsa_code":"100"}'), ("County", "01003", '{"id":"01003","state_fips":"09","cbsa_code":""}'), ("County", "02001", '{"id":"02001"}')], key=repr)
    first = graph.nodes(spark.createDataFrame([("a", None, "late"), ("a", 2, "second"), ("a", 1, "first"), (None, 0, "x")], "k string, o int, name string"), "X", "k", ["o"], ["name"])
    assert rows(first) == [("X", "a", "first")]


def test_names_by_postings(spark):
    names = ["Clay County", "Clayton County", "clay county", "De Kalb", "Ömer ÉCounty", "", "ab", "County", None]
    queries = ["clay county", "county", "ab", "a", "", "zz", "unty", "éco", "clayt", "y c", "nothing like that"]
    postings = matching.name_postings(spark.createDataFrame([(n,) for n in names], "v string"), "v")
    found = matching.find_names(spark.createDataFrame([(q,) for q in queries], "query string"), postings)
    lower = {n.lower() for n in names if n is not None}
    assert rows(found) == sorted(((q, n) for q in queries for n in lower if q in n), key=repr)
    sizes = {r["name"]: r["n"] for r in postings.groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert all(n <= max(1, len(name)) for name, n in sizes.items())


def test_places_by_request(spark):
    places = spark.createDataFrame([("AL", "Alabama", "1", "Clay County"), ("GA", "Georgia", "2", "Clay County"), ("GA", "Georgia", "3", "Clayton County"), ("GA", "Georgia", "4", None)], "state string, state_name string, place_code string, place_name string")
    asked = spark.createDataFrame([(1, "clay", "georgia"), (2, "CLAY C", None), (3, "", None), (4, None, None), (5, "clay", None), (6, "clay", None)], "request_id int, query string, state string")
    got = rows(matching.resolve_places(asked, places).select("request_id", "place_code", "match_count"))
    assert got == sorted([(1, "2", 2), (1, "3", 2), (2, "1", 2), (2, "2", 2), *[(r, c, 3) for r in (3, 5, 6) for c in "123"]], key=repr)


def register_line(year, layout, **values):
    return "|".join({"activity_year": str(year), **values}.get(c, "") for c in layout)


@pytest.fixture
def cut_anywhere(spark):
    """Files are read in parts of a few hundred bytes, so parts begin inside lines."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, held[k]) if k in held else spark.conf.unset(k)


def test_registers_of_both_layouts(spark, tmp_path, cut_anywhere):
    assert (len(registers.SHORT), len(registers.LONG)) == (85, 99) and len(set(registers.SHORT)) == 85 and len(set(registers.LONG)) == 99
    short = [register_line(2023, registers.SHORT, lei=f"S{i}", action_taken="1", total_units="5-24", county_code="01001", loan_amount="NA", col_82="3") for i in range(40)]
    long = [register_line(2019, registers.LONG, lei=f"L{i}", action_taken="3", total_units="1", county_code="01003", denial_reason_1="7", tract_population=str(i)) for i in range(40)]
    (tmp_path / "a.txt").write_text("\n".join(short) + "\n" + register_line(2022, registers.SHORT, lei="more") + "|x|y\n2024|cut\n")
    (tmp_path / "b.txt").write_text("\n".join(long))
    (tmp_path / "c.txt").write_text("")
    read = registers.read_registers(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() > 20 and read.count() == 82
    assert {"col_82", "tract_population", "denial_reason_1", "aus_5"} < set(read.columns)
    assert rows(read.groupBy("activity_year", "n_fields").count()) == [("2019", 99, 40), ("2022", 87, 1), ("2023", 85, 40), ("2024", 2, 1)]
    assert rows(read.filter("size(extra) > 0").select("lei", "extra")) == [("more", ["x", "y"])]
    assert rows(read.filter("lei in ('S7', 'L7')").select("lei", "county_code", "loan_amount", "tract_population", "denial_reason_1", "col_82")) == [("L7", "01003", "", "7", "7", None), ("S7", "01001", "NA", None, None, "3")]
    assert rows(read.filter("lei = 'cut'").select("activity_year", "total_units", "tract_population")) == [("2024", None, None)]
    card = risk.scorecard(registers.as_applications(checks.actionable(read, "action_taken", fields="n_fields")))
    assert rows(card.select("risk_id", "total_applications", "multifamily_applications", "top_denial_reason", "lender_count")) == [("01001_2023", 40, 40, None, 40), ("01003_2019", 40, 0, "7", 40)]


def test_only_the_fields_asked_for_are_taken(spark, tmp_path):
    (tmp_path / "a.txt").write_text(register_line(2023, registers.SHORT, lei="x"))
    df = registers.read_registers(spark, str(tmp_path), ["lei", "denial_reason_1"]).select("lei")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert rows(df) == [("x",)] and "denial_reason_1" not in plan


def test_panels_with_headers_of_their_own(spark, tmp_path, cut_anywhere):
    line = lambda k, v: "|".join(["2024", k, *["x"] * 11, v])
    (tmp_path / "a.txt").write_text("\n".join(["|".join(f"h{i}" for i in range(14)), *[line(f"k{i}", f" v{i} ") for i in range(60)], "short|line", line("", "x"), line("k1", "last")]))
    (tmp_path / "b.txt").write_text("\n".join(["|".join(f"other{i}" for i in range(14)), line("k2", 'quoted "v"'), "|".join(f"h{i}" for i in range(14))]))
    got = keep.keep_last(files.read_key_values(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/b.txt"], 1, 13), ["key"], ["line_no"])
    held = {r["key"]: r["value"] for r in got.collect()}
    # the header of a.txt is a header there alone
    assert held == {f"k{i}": f"v{i}" for i in range(60)} | {"k1": "last", "k2": 'quoted "v"', "h1": "h13"}


def test_bundles_read_only_the_years_asked_for(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.write_years(spark.createDataFrame([(y, i) for y in range(2015, 2025) for i in range(3)], "year int, i int"), path)
    bundle = spark.read.parquet(path)
    one = vintages.of_year(bundle, "year", 2020)
    one.collect()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "= 2020)" in plan and one.count() == 3 and "trim" not in plan
    asked = spark.createDataFrame([("2016",), ("2018",), (None,), ("1999",)], "y string")
    some = vintages.of_years(bundle, "year", asked, "y")
    assert rows(some.groupBy("year").count()) == [(2016, 3), (2018, 3)]
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString()
    text = spark.createDataFrame([(" 2020",), ("2021",)], "year string")
    assert vintages.of_year(text, "year", 2020).count() == 1
    assert len(glob.glob(os.path.join(path, "year=*"))) == 10


def test_yearly_layouts(spark):
    old = spark.createDataFrame([("1", "01", 1, 0.2, 1.0, 60.0, 10.0, 1.0)], "fips string, statefp string, qct int, povrate double, pctinc double, amgi60pc double, pop100 double, groupqtr double")
    new = spark.createDataFrame([("2", "02", 0, 0.1, 0.9, 50.0, 20.0, 2.0, 0.3, "F")], "TRACT_ID_22 string, STATE string, QCT int, pov_rate_22 double, inc_factor_22 double, VLIL_4_Person_22 double, P1 double, P5 double, pov_rate_20 double, cbsasub22 string")
    both = vintages.harmonised_union({2005: old, 2025: new}, vintages.TRACT_FIELDS)
    assert rows(both.select("tract_fips", "poverty_rate_at_designation", "vlil4_current", "poverty_rate_vintage_minus2", "fmr_area_code", "h1", "year")) == [("1", 0.2, 60.0, None, None, None, 2005), ("2", 0.1, 50.0, 0.3, "F", None, 2025)]
    with pytest.raises(ValueError, match="p5"):
        vintages.harmonise(new.drop("P5"), 2025, vintages.TRACT_FIELDS)
    metro = spark.createDataFrame([("11111", 1.0, 2.0, 3.0, 4.0, 1)], ["ZCTA", "2024 Final 40th Percentile 2-Bedroom SAFMR", "Population also in 2024 QCT", "Population NOT in 2025 QCT", "FY2024 4-Person VLIL", "2025 SDDA (1=SDDA)"])
    assert rows(vintages.harmonise(metro, 2025, vintages.METRO_AREA_FIELDS)) == [("11111", 1.0, 2.0, 3.0, 4.0, 1, 2025)]
    non_metro = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 1)], ["FY2018 Final 40th Percentile 2-Bedroom FMR", "Pop in QCT", "Population NOT in 2018 QCT", "2018 4-Person VLIL", "2019 NMDDA"])
    assert rows(vintages.harmonise(non_metro, 2019, vintages.NON_METRO_FIELDS)) == [(None, 1.0, 2.0, 3.0, 4.0, 1, 2019)]


def test_unexpected_values_and_floors(spark):
    df = spark.createDataFrame([("23",), ("01",), (None,)], "s string")
    assert rows(checks.unexpected(df, "s", ["23", "25"])) == [("01",), (None,)]
    assert rows(checks.row_floors({"a": (df, 3), "b": (df, 4)})) == [("a", 3, 3, True), ("b", 3, 4, False)]
