
import random

import pytest
from pyspark.sql import functions as F

from parcelry.operators import checks, collapse, graph, keep, lines, matching, reshape, risk, snapshots, tools, vintages
from parcelry.sources import files
from parcelry.streaming.increments import apply_counts, apply_stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


APP = "action string, lender_id long, amount string, purchaser string, race string, ethnicity string, multifamily boolean, denial_reason string, county_fips string, assessment_year int"


def test_scorecard_counts_and_nulls(spark):
    data = [
        ("1", 1, "100", "1", "5", "2", True, None, "00001", 2020), ("3", 2, "x", "0", "5", "2", False, "1", "00001", 2020), ("3", 1, "300", "0", "1", "2", True, "3", "00001", 2020),
        ("2", 9, "900", "1", "1", "1", True, "3", "00001", 2020), ("3", None, None, None, "1", None, None, "10", None, 2020),
    ]
    card = {r["county_fips"]: r for r in risk.scorecard(spark.createDataFrame(data, APP)).collect()}
    a = card["00001"]
    assert (a["total_applications"], a["total_originated"], a["total_denied"], a["lender_count"], a["avg_loan_amount"]) == (3, 1, 2, 2, 200.0)
    assert (a["denial_rate_minority"], a["denial_rate_white"], a["denial_rate_disparity_ratio"]) == (1.0, 0.5, 2.0)
    assert a["top_denial_reason"] == "1" and not a["is_high_disparity"]
    b = card[None]
    assert b["risk_tier"] == "unknown" and b["lender_count"] is None and b["avg_loan_amount"] is None and b["top_denial_reason"] is None


def applications_of(spark, seed, n=300):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    return spark.createDataFrame([(pick("1", "2", "3"), rng.choice([None, *range(9)]), pick(None, "100", "12.5", "x"), pick("1", "2"), pick("1", "5", None), pick("1", "2", None), pick(True, False, None), pick("1", "3", "10", "", None, "7"), pick("00001", "00003", None), pick(2020, 2021)) for _ in range(n)], APP)


def test_card_of_increments_is_that_of_all(spark, tmp_path):
    parts = [applications_of(spark, i) for i in range(3)]
    state = risk.card_state(spark, str(tmp_path / "s"), n_buckets=4)
    for i, part in enumerate(parts):
        cards = risk.add_applications(state, part, str(i))
        risk.add_applications(state, part, str(i))  # a repeated batch
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert rows(risk.card_of(state.read())) == rows(risk.scorecard(everything)) == rows(cards)
    one_year = risk.add_applications(state, applications_of(spark, 9, 40).filter("assessment_year = 2020 and county_fips = '00001'"), "3")
    assert one_year.count() < cards.count() and state.entries()[0]["batch"] == "3"


def test_stream_of_applications(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(2):
        applications_of(spark, i).write.mode("append").parquet(src)
        apply_counts(spark.readStream.schema(APP).parquet(src), str(tmp_path / "s"), str(tmp_path / "c"), n_buckets=2).awaitTermination()
    assert rows(risk.card_of(risk.card_state(spark, str(tmp_path / "s")).read())) == rows(risk.scorecard(spark.read.parquet(src)))


def test_sketches(spark, tmp_path):
    apps = spark.range(60_000).select((F.col("id") % 7).alias("county"), F.when(F.col("id") % 11 != 0, F.col("id") % 20_000).alias("lender_id"))
    by_county = risk.lender_sketches(apps, ["county"])
    state = risk.sketch_state(spark, str(tmp_path / "s"), ["county"], 2)
    for i in range(3):
        risk.add_lenders(state, apps.filter(F.col("lender_id") % 3 == i), str(i))
        risk.add_lenders(state, apps.filter(F.col("lender_id") % 3 == i), f"{i} again")
    exact = apps.agg(F.count_distinct("lender_id")).first()[0]
    for sketches in (by_county, state.read()):
        whole = risk.estimated_lenders(risk.rolled_up(sketches, [])).first()
        assert abs(whole["lender_count"] - exact) <= whole["lender_count_error"] < 0.06 * exact
    assert rows(risk.estimated_lenders(state.read()).select("county", "lender_count")) == rows(risk.estimated_lenders(by_county).select("county", "lender_count"))


def test_outlier_of_one_group_is_false(spark):
    df = spark.createDataFrame([("a", 2020, 0.5), ("b", 2021, None), ("c", 2021, None)], "risk_id string, y int, m double")
    assert not any(r["is_outlier"] for r in risk.outliers(df, "m", ["y"]).collect())


def test_lookup_does_not_multiply(spark):
    dim = risk.dimension(spark.createDataFrame([("a", 1, 0), ("a", 2, 1), (None, 3, 2)], "k string, v int, o int"), "k", "v", ["o"])
    out = risk.lookup(spark.createDataFrame([("a",), ("b",)], "x string"), dim, "x", "k", "v", 10)
    assert rows(out) == [("a", 2), ("b", None)]
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert "ResolvedHint (strategy=broadcast)" in out._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in risk.lookup(spark.createDataFrame([("a",)], "x string"), dim, "x", "k", "v", 0)._jdf.queryExecution().analyzed().toString()


def test_roll_up(spark):
    df = spark.createDataFrame([("a", 1, None, 5.0), ("a", 2, "x", None), (None, 3, "y", 1.0), ("b", 4, None, None)], "area string, o int, name string, pop double")
    assert rows(collapse.roll_up(df, "area", ["o"], first=["name"], total=["pop"], count={"n": "name"})) == [("a", "x", 5.0, 1), ("b", None, 0.0, 0)]
    assert rows(keep.first_values(df, ["area"], ["o"], ["name", "pop"])) == [("a", "x", 5.0), ("b", None, None)]


def test_checks(spark):
    df = spark.createDataFrame([("a", 1, 2), (None, 0, 5), ("c", 5, 4), ("d", None, 1)], "code string, l1 int, l2 int")
    assert {r["check_name"]: r["n_bad"] for r in checks.count_checks(df, checks.limit_checks(["l1", "l2"], "code")).collect()} == {"error_code": 1, "error_limit": 2, "warn_monotone": 1}
    s = checks.with_status(df, {"no_code": F.col("code").isNull(), "low": F.col("l1") < 1})
    assert [r["skip_reason"] for r in s.filter("row_status = 'SKIP'").collect()] == ["no_code;low;"]
    with pytest.raises(ValueError):
        checks.row_floor(df, 5)
    assert rows(checks.width_violations(spark.createDataFrame([(1, "123", None)], "i int, a string, b string"), "i", {"a": 5, "b": 5})) == [(1, "a", "123")]
    assert checks.actionable(df.withColumn("action", F.lit("1")).withColumn("p", F.array(F.lit(1))), fields="p").count() == 0


def test_reshape(spark):
    wide = spark.createDataFrame([(1, *range(16))], "id int, " + ", ".join(f"a_{n} int" for n in range(1, 9)) + ", " + ", ".join(f"b_{n} int" for n in range(1, 9)))
    long = reshape.program_rows(wide, {"a_": "ELI", "b_": "VLI"}, ["id"])
    assert long.count() == 2 and reshape.household_rows(long, ["id", "program_type"]).filter("program_type = 'VLI' and household_size = 4").first()["income_limit"] == 11
    packed = spark.createDataFrame([(1, "003-Baldwin, 005-Barbour 007-De Kalb")], "id int, t string")
    assert rows(reshape.numbered_entities(packed, "t", ["id"])) == [(1, "003", "Baldwin"), (1, "005", "Barbour"), (1, "007", "De Kalb")]
    assert rows(reshape.zip_rows(spark.createDataFrame([(1, "12345 x, 99999;1234")], "id int, t string"), "t", ["id"])) == [(1, "12345"), (1, "99999")]
    tokens = spark.createDataFrame([("AL", i, t) for i, t in enumerate("BARBOUR COUNTY DE KALB COUNTY JUNEAU BOROUGH".split())], "s string, i int, t string")
    assert [r["name"] for r in reshape.token_names(tokens, "s", "i", "t", ["COUNTY", "BOROUGH"]).orderBy("place").collect()] == ["Barbour County", "De Kalb County", "Juneau Borough"]


def test_limit_lines(spark):
    v = "1 2 3 4 5 6 7 8"
    text = ["STATE: ALABAMA", "FY 2022 INCOME LIMITS", "Anniston MSA", "PAGE 3", "PROGRAM 1 2", "1 PERSON", "---", f"FY 2022 MFI: 73600 30% OF MEDIAN {v}", f"VERY LOW INCOME {v}", "LOW-INCOME 1 2", "Other County", f"VERY LOW INCOME {v}", f"FY 2022 MFI: 5 LOW-INCOME {v} 9"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line_no int, text string")
    got = sorted((r["line_no"], r["area"], r["mfi"], r["program_type"], len(r["limits"])) for r in lines.limit_lines(df).collect())
    assert got == [(7, "Anniston MSA", 73600, "ELI", 8), (8, "Anniston MSA", 73600, "VLI", 8), (12, "Other County", 5, "LI", 8)]


def test_area_definition_lines(spark):
    text = ["01 ALABAMA", "CBSA: Anniston-Oxford, AL MSA - METRO11500M11500 015-Calhoun", "NONMETROPOLITAN", "003-Baldwin 005-Barbour"]
    got = rows(lines.area_definition_lines(spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line_no int, text string")).select("hud_area_code", "metro", "county_fips", "county_name"))
    assert got == [("METRO11500M11500", True, "01015", "Calhoun"), ("NCNTY01003N01003", False, "01003", "Baldwin"), ("NCNTY01005N01005", False, "01005", "Barbour")]


def test_visual_rows(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 13.0), (1, 16.0)], "page int, y double")
    assert [r["row_no"] for r in lines.merged_rows(df, ["page"], "y", [], 4).orderBy("y").collect()] == [1, 1, 1]
    assert [r["row_no"] for r in lines.anchored_rows(df, "page", "y", 4).orderBy("y").collect()] == [1, 1, 2]
    assert rows(lines.widest_gap(spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 10.0)], "p int, x double"), ["p"], "x")) == [(1, 6.0)]


def test_matching(spark):
    dim = spark.createDataFrame([("AL", "Saint Clair County", "01115"), ("AL", "Barbour County", "01005"), ("IL", "Saint Clair County", "17163")], "state string, county_name string, county_fips string")
    df = spark.createDataFrame([(1, "AL", "St. Clair County", None), (2, "AL", "Barbour", None), (3, "AL", "Nowhere", None), (4, "AL", "x", "keep"), (5, None, "Barbour", None)], "i int, st string, name string, code string")
    assert rows(matching.fill_county(df, "i", "st", "name", "code", dim).select("i", "code")) == [(1, "01115"), (2, "01005"), (3, None), (4, "keep"), (5, None)]
    places = spark.createDataFrame([("AL", "Alabama", "1", "Clay County"), ("GA", "Georgia", "2", "Clay County"), ("GA", "Georgia", "3", "Clayton County")], "state string, state_name string, place_code string, place_name string")
    asked = spark.createDataFrame([(1, "clay", "georgia"), (2, "clay", None), (3, "zzz", "AL")], "request_id int, query string, state string")
    assert rows(matching.resolve_places(asked, places).select("request_id", "place_code", "match_count")) == [(1, "2", 2), (1, "3", 2), (2, "1", 3), (2, "2", 3), (2, "3", 3)]
    claims = spark.createDataFrame([(1, "01", "in clay"), (2, "01", "in bibb"), (3, "99", "x"), (4, "99", "code 99")], "claim_id int, code string, text string")
    assert [s for _, _, s in rows(matching.check_codes(claims, spark.createDataFrame([("01", "Clay County")], "c string, n string"), "c", "n"))] == ["ok", "wrong_name", "unknown_code", "ok"]


def test_upsert_is_idempotent_and_last_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    once = snapshots.upsert(old, new, ["k"])
    assert rows(once) == [(1, "a"), (2, "d"), (3, "e")] == rows(snapshots.upsert(once, new, ["k"]))
    assert rows(snapshots.upsert_coalesce(old, spark.createDataFrame([(2, None), (3, "e")], "k int, v string"), ["k"])) == [(1, "a"), (2, "b"), (3, "e")]


def test_second_run_skips_all(spark, tmp_path):
    nodes, state = snapshots.Table(spark, str(tmp_path / "n")), snapshots.Table(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert rows(snapshots.apply_changes(df, ["k"], ["v"], nodes, state)) == [("CREATE", 2)]
    assert rows(snapshots.apply_changes(df, ["k"], ["v"], nodes, state)) == [("SKIP", 2)]
    changed = spark.createDataFrame([(1, "z"), (2, None), (3, "n")], "k int, v string")
    assert rows(snapshots.apply_changes(changed, ["k"], ["v"], nodes, state)) == [("CREATE", 1), ("MERGE", 1), ("SKIP", 1)]
    assert rows(nodes.read()) == [(1, "z"), (2, None), (3, "n")]


def test_stream_applies_increments(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(src)
    stream = spark.readStream.schema("k int, v string").parquet(src)
    apply_stream(stream, ["k"], ["v"], str(tmp_path / "n"), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert rows(snapshots.Table(spark, str(tmp_path / "n")).read()) == [(1, "a")]


def test_years_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.write_years(spark.createDataFrame([(1, 2020), (2, 2021)], "v int, year int"), path)
    snapshots.write_years(spark.createDataFrame([(3, 2021)], "v int, year int"), path)
    assert rows(spark.read.parquet(path)) == [(1, 2020), (3, 2021)]


def test_hashes(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    import hashlib

    assert df.select(snapshots.fingerprint(["c", "a", "b"])).first()[0] == hashlib.sha256(b'{"a":"1","b":"","c":"x"}').hexdigest()
    two = spark.createDataFrame([(1,), (2,)], "a int")
    assert snapshots.content_hash(two, ["a"]).first() == snapshots.content_hash(two.orderBy(F.desc("a")), ["a"]).first()


def test_vintages(spark):
    fields = [vintages.Field("rate", ["Pov_Rate_{yy-1}"], "double", True), vintages.Field("note", ["note"])]
    one = vintages.harmonise(spark.createDataFrame([("0.5",)], "POV_RATE_19 string"), 2020, fields)
    assert rows(one) == [(0.5, None, 2020)]
    with pytest.raises(ValueError):
        vintages.harmonise(spark.createDataFrame([("0.5",)], "x string"), 2020, fields)


def test_graph(spark):
    n = spark.createDataFrame([("County", "1"), ("County", "2"), ("State", "9")], "label string, id string")
    facts = spark.createDataFrame([(1, "9"), (1, "9"), (2, None), (3, "8"), (4, "")], "i int, s string")
    e = graph.edges(facts, "County", "i", "IN_STATE", "State", F.col("s"), n.filter("label = 'State'"), "id")
    assert rows(e) == [("County", "1", "IN_STATE", "State", "9")]
    assert rows(graph.orphans(n, e)) == [("County", "2")]
    assert rows(graph.audit(n, e)) == [("County", 2, 1, 0, 1, 1, 50.0), ("State", 1, 0, 1, 1, 0, 0.0)]
    assert graph.without_edges(e, "County", "IN_STATE", "State").count() == 0


def test_optional_keeps_and_required_drops(spark):
    asked = spark.createDataFrame([("a", 2020), ("b", 2020), ("c", 2020)], "k string, y int")
    facts = spark.createDataFrame([("a", 2019, True), ("b", 2020, False)], "k string, y int, flag boolean")
    assert rows(tools.status(asked, facts, ["k", "y"], "flag", [])) == [("a", 2020, False), ("b", 2020, False), ("c", 2020, False)]
    assert tools.required(asked, facts, ["k", "y"], ["flag"], F.col("flag")).count() == 0


def test_trend_marks_gaps(spark):
    asked = spark.createDataFrame([("a", 2020, 2024)], "k string, start_year int, end_year int")
    card = spark.createDataFrame([("a", y, 1.0) for y in (2022, 2023, 2024)], "k string, y int, m double")
    assert [(r["y"], r["is_gap"]) for r in tools.trend(asked, card, "k", "y", ["m"]).orderBy("y").collect()] == [(2020, True), (2021, True), (2022, False), (2023, False), (2024, False)]


def test_year_pair(spark):
    df = spark.createDataFrame([("a", 2025), ("b", 2024), ("b", 2025)], "k string, y int")
    assert rows(tools.year_pair(df, "k", "y", 2024, 2025)) == [("a", False, True, False, False, True), ("b", True, True, True, False, False)]


def test_files(spark, tmp_path):
    (tmp_path / "r.txt").write_text("2020|L1|1|x|y\n2020|L2\n")
    assert rows(files.read_register(spark, str(tmp_path / "r.txt"), ["year", "lei", "action"])) == [("2020", "L1", "1", ["x", "y"]), ("2020", "L2", None, [])]
    assert files.read_register(spark, str(tmp_path / "r.txt"), ["year"], 3).count() == 1
    assert files.read_positional(spark, str(tmp_path / "r.txt"), ["year", "lei"]).columns == ["year", "lei", "extra_1", "extra_2", "extra_3"]
    assert files.reconciled_names(["a", "b", "c"], 2) == ["a", "b"]
    (tmp_path / "p.txt").write_text("a|b|c\nk1|x|1\nk2||1\nk1|x|2\nshort\n")
    assert rows(files.read_key_values(spark, str(tmp_path / "p.txt"), 0, 2, 3).select("key", "value")) == [("k1", "1"), ("k1", "2"), ("k2", "1")]
    (tmp_path / "many").mkdir()
    for name, lines in (("1.txt", "k1|x|1\nk2|x|5\n"), ("2.txt", "k1|x|9\n")):
        (tmp_path / "many" / name).write_text("a|b|c\n" + lines)
    found = files.read_key_values(spark, str(tmp_path / "many"), 0, 2, 3)
    assert rows(found.select("key", "value")) == [("k1", "1"), ("k1", "9"), ("k2", "5")]  # no header of any file
    assert rows(keep.keep_last(found, ["key"], ["line_no"]).select("key", "value")) == [("k1", "9"), ("k2", "5")]
    (tmp_path / "h.csv").write_text(" a ,b\n01,NA\n")
    assert rows(files.read_with_header(spark, str(tmp_path / "h.csv"), null_value="NA")) == [("01", None)]
    files.write_loader_csv(spark.createDataFrame([(1, True, None)], "i int, b boolean, s string"), str(tmp_path / "out"))
    assert any("1,true," in part.read_text() for part in (tmp_path / "out").glob("part-*"))
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(str(tmp_path / "q"))
    assert files.read_present(spark, str(tmp_path / "q"), ["a", "zz"]).columns == ["a", "source_file"]
    files.write_qa(spark.createDataFrame([(1,), (2,)], "a int"), "a > 1", str(tmp_path / "qa"))
    assert spark.read.option("header", True).csv(str(tmp_path / "qa")).count() == 1


