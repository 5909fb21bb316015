"""Scans in blocks and chains against loops over lists."""

import random

import pytest
from pyspark.sql import functions as F

from parcelry.operators import lines, reshape
from parcelry.operators.scans import Scan, chain_starts
from parcelry.sources.places import kept


def ordered(spark, seed):
    rng = random.Random(seed)
    rows = []
    for key in ("a", "b", None, "c"):
        at = 0
        for _ in range(rng.choice([1, 40, 120])):
            at += rng.choice([1, 1, 2, 30, 100])
            rows.append((key, at, rng.random() < 0.2, rng.randrange(9)))
    return rows, spark.createDataFrame(rows, "k string, at long, head boolean, v int").repartition(3)


@pytest.mark.parametrize("width", [None, 1, 16, 10_000])
def test_scans_equal_loops(spark, width):
    rows, df = ordered(spark, width or 0)
    block = None if width is None else F.floor(F.col("at") / width)
    scan = Scan(df, ["k"], ["at"], block).carried({"last": F.when(F.col("head"), F.col("v")), "odd": F.when(F.col("v") % 2 == 1, F.col("at"))})
    got = scan.previous("before", "at").counted("n", F.col("head"), "all").rows()
    assert got.columns == ["k", "at", "head", "v", "last", "odd", "before", "n", "all"]
    want, state = [], {}
    for k, at, head, v in rows:
        last, odd, before, n = state.get(k, (None, None, None, 0))
        last, odd, n = (v if head else last), (at if v % 2 else odd), n + head
        want.append((k, at, head, v, last, odd, before, n))
        state[k] = last, odd, at, n
    want = [(*w, state[w[0]][3]) for w in want]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_long_group_is_many_tasks(spark):
    df = spark.range(0, 40_000, numPartitions=4).select(F.lit("f").alias("file"), F.col("id").alias("line_no"))
    got = Scan(df, ["file"], ["line_no"], lines.line_block(1_000)).carried({"head": F.when(F.col("line_no") % 7_001 == 3, F.col("line_no"))}).rows()
    assert got.filter("head <> floor((line_no - 3) / 7001) * 7001 + 3").count() == 0 and got.filter("head is null").count() == 3
    spread = got.groupBy(F.spark_partition_id().alias("p")).count()
    assert spread.count() > 1 and spread.agg(F.max("count")).first()[0] < 40_000


def test_chains(spark):
    links = spark.createDataFrame([(i, i + 3 if i + 3 < 50 else None) for i in range(50)], "node int, next int")
    got = chain_starts(links, spark.createDataFrame([(1,), (2,)], "node int"), kept)
    assert sorted(r[0] for r in got.collect()) == sorted([*range(1, 50, 3), *range(2, 50, 3)])


@pytest.mark.parametrize("size", [None, 3.0, 50.0])
def test_anchored_rows_equal_a_loop(spark, size):
    rng = random.Random(4)
    rows = [(page, round(float(rng.choice([rng.random() * 60, rng.randrange(60)])), 1), i) for page in (1, 2, None) for i in range(70)] + [(1, None, 999)]
    want = []
    for page in (1, 2, None):
        start, n = None, 0
        for y, i in sorted((y, i) for p, y, i in rows if p == page and y is not None):
            if start is None or y - start > 4:
                start, n = y, n + 1
            want.append((page, y, i, n))
    got = lines.anchored_rows(spark.createDataFrame(rows, "page int, y double, i int").repartition(3), "page", "y", 4.0, size)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([*want, (1, None, 999, None)], key=repr)


def test_open_tail_is_not_collected(spark):
    tokens = spark.createDataFrame([("g", i, "END" if i in (2, 5) else f"w{i}") for i in range(500)] + [("h", i, f"x{i}") for i in range(500)], "s string, i int, t string")
    for block in (None, F.floor(F.col("i") / 2)):
        assert sorted(map(tuple, reshape.token_names(tokens, "s", "i", "t", ["END"], block).collect())) == [("g", 0, "W0 W1 End"), ("g", 1, "W3 W4 End")]
