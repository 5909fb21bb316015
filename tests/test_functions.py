import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelry.functions import codes as C
from parcelry.functions import coerce
from parcelry.functions import measures as M
from parcelry.functions import text as X

ONCE = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, kind, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_clean_code(spark):
    given_codes = ["1001.0", " 48113 ", "nan", "", None, "A-12", "1234567"]
    assert column(spark, given_codes, "string", lambda c: C.clean_code(c, 5)) == ["01001", "48113", None, None, None, "00012", "1234567"]


def test_clean_metro(spark):
    assert column(spark, ["33860.0", "100000", "999x", "1918", None], "string", C.clean_metro) == ["33860", None, None, "01918", None]
    assert column(spark, ["1918"], "string", lambda c: C.clean_metro(c, pad=False)) == ["1918"]


def test_metro_of_area(spark):
    assert column(spark, ["METRO19100M19100", "NCNTY48113N48113", None], "string", C.metro_of_area) == ["19100", None, None]


def test_numbers(spark):
    assert column(spark, ["$1,200", "x", "nan", None], "string", coerce.number) == [1200.0, None, None, None]
    assert column(spark, ["2.5", "3.5", "nan"], "string", coerce.whole) == [2, 4, None]
    assert column(spark, [None, "0", "1", "x", "true"], "string", coerce.truth) == [False, False, True, False, True]


@ONCE
@given(st.lists(st.text("0123456789.,-x ", max_size=9), min_size=1, max_size=30))
def test_padding_never_shortens(spark, values):
    for v, c in zip(values, column(spark, values, "string", lambda c: C.clean_code(c, 5)), strict=True):
        text = v.strip()
        digits = "".join(ch for ch in (text[:-2] if text.endswith(".0") else text) if ch.isdigit())
        assert c == (digits.zfill(5) if digits else None)


def test_trigger(spark):
    rows = [(True, 0.722, 0.216), (True, 1.2, 0.3), (True, 0.5, 0.3), (True, 1.5, 0.1), (False, 0.5, 0.5), (None, 0.5, 0.5), (True, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d boolean, r double, p double").orderBy("i")
    assert [r[0] for r in df.select(M.trigger(F.col("d"), F.col("r"), F.col("p"))).collect()] == ["income", "poverty", "both", "area_constraint", "none", "none", "area_constraint"]


def test_direction_tier_and_cv(spark):
    assert column(spark, [-0.06, -0.05, 0.05, 0.06, None], "double", M.direction) == ["improving", "stable", "stable", "worsening", "unknown"]
    assert column(spark, [0.7499, 0.75, 1.0, 1.4999, 1.5, None], "double", M.tier) == ["low", "moderate", "elevated", "elevated", "high", "unknown"]
    cv = column(spark, [10_000.0, 0.0, None], "double", lambda c: M.estimate_cv(F.lit(-1645.0), c))
    assert math.isclose(cv[0], 0.1) and cv[1:] == [None, None]
    assert column(spark, [0.1, 0.3, None], "double", M.reliable) == [True, False, False]


def test_risk_score_weights(spark):
    df = spark.createDataFrame([(2.0, 0.5, 0.25), (2.0, 0.5, None), (None, 0.5, 0.25)], "d double, o double, m double")
    assert [r[0] for r in df.select(M.risk_score(F.col("d"), F.col("o"), F.col("m"))).collect()] == [2 * 0.5 + 0.5 * 0.3 + 0.25 * 0.2, 2 * 0.625 + 0.5 * 0.375, None]


def test_text_rules(spark):
    terms = X.normalise_terms(F.col("v"), X.term_rules(2026))
    texts = ["a QCT with 60 % ami this year", "2BHK flat, Max rent last year $1", "nothing of the kind, eliminated", "SDDA or nmdda boost eligible, very low income", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", terms.alias("t")).select("v", "t.text", "t.labels").collect()
    for text, got, fired in rows:
        by_hand, labels = text, []
        for pattern, replacement, label in X.term_rules(2026) if text else ():
            changed = re.sub(pattern, replacement, by_hand)
            labels += [label] * (changed != by_hand)
            by_hand = changed
        assert (got, fired) == (by_hand, labels)
    assert "2 bedroom unit, maximum allowable gross rent (max_rent) year 2025 $1" in [r[1] for r in rows]
    assert column(spark, ["in 01001020700 of 2025", "none"], "string", X.tract_code) == ["01001020700", None]
    assert column(spark, ["ABC and XYZZ, ABC"], "string", lambda c: X.unknown_acronyms(c, ["XYZZ"])) == [["ABC"]]


def test_names(spark):
    assert column(spark, ["Flagstaff,AZMSA", "LosAngeles-LongBeach,CAHMFA[GOZone]", "Flagstaff, AZ MSA [x]", "plain", None, "", ",", "A,B,TXHSD"], "string", X.metro_name) == ["Flagstaff, AZ MSA", "Los Angeles-Long Beach, CA HMFA", "Flagstaff, AZ MSA", None, None, None, None, "A,B, TX HSD"]
    assert column(spark, ["BarbourCounty", "JuneauCityandBorough"], "string", X.split_camel) == ["Barbour County", "Juneau City and Borough"]
    assert column(spark, ["Page 3 of 12", "77", "ab", "Barbour"], "string", X.is_noise) == [True, True, True, False]
    assert column(spark, ["St. Clair County, AL"], "string", X.county_candidates)[0][-1] in ("saint clair", "st. clair")
