"""Snapshots in buckets: what is written, what a killed or repeated run leaves, and hashes that add up."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from parcelry.operators import content, snapshots
from parcelry.operators.buckets import BucketedTable, bucket_of
from parcelry.streaming.increments import apply_stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, data):
    return spark.createDataFrame(data, "k int, v string")


def full_hash(table):
    df = table.read()
    return tuple(content.parts_of(df, df.columns).select("n_rows", content.content_hash_of().alias("h")).first())


def size(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/data/*/bucket=*/*.parquet"))


def test_an_upsert_writes_what_it_touches(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), ["k"], 32)
    base = spark.range(20_000).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("value "), F.md5(F.col("id").cast("string"))).alias("v"))
    t.upsert(base)
    before, versions = size(t.path), {r["bucket"]: r["version"] for r in t.summary().collect()}
    assert len(versions) == 32 and set(versions.values()) == {0}
    t.upsert(frame(spark, [(7, "new"), (30_000, None)]))
    touched = {r[0] for r in frame(spark, [(7, ""), (30_000, "")]).select(bucket_of(["k"], 32)).collect()}
    assert {b for b, v in ((r["bucket"], r["version"]) for r in t.summary().collect()) if v == 1} == touched
    assert size(t.path) - before < 0.15 * before
    assert t.read().count() == 20_001 and rows(t.read().filter("k in (7, 30000)")) == [(30_000, None), (7, "new")]
    assert t.hash() == full_hash(t)
    near = t.near(frame(spark, [(7, "")]))
    assert near.count() < 20_001 / 16 and near.filter("k = 7").count() == 1
    assert t.vacuum() == len(touched) and t.read().count() == 20_001


def test_random_increments(spark, tmp_path):
    rng, t, want = random.Random(1), BucketedTable(spark, str(tmp_path / "t"), ["k"], 5), {}
    for step in range(4):
        new = [(rng.choice([None, *range(40)]), rng.choice([None, "", "a", "ü"])) for _ in range(12)]
        t.upsert(frame(spark, new).repartition(2), order=["v"], batch=str(step))
        last = {}
        for k, v in new:
            last[k] = max(last.get(k, (False, "")), (v is not None, v or ""))  # null is the least
        want |= {k: v if there else None for k, (there, v) in last.items()}
        assert rows(t.read()) == sorted(want.items(), key=repr) and t.hash() == full_hash(t)
        t.upsert(frame(spark, [(1, "not applied")]), batch=str(step))
    assert rows(t.read()) == sorted(want.items(), key=repr)
    assert rows(t.rebucket(2)) == sorted(want.items(), key=repr) and t.hash() == full_hash(t)


def test_a_killed_run_changes_nothing(spark, tmp_path, monkeypatch):
    t = BucketedTable(spark, str(tmp_path / "t"), ["k"], 4)
    t.upsert(frame(spark, [(1, "a"), (2, "b")]))
    monkeypatch.setattr("parcelry.operators.buckets.parts_of", lambda *a: 1 / 0)  # data are written, the list isn't
    with pytest.raises(ZeroDivisionError):
        t.upsert(frame(spark, [(1, "z"), (3, "c")]))
    monkeypatch.undo()
    assert rows(t.read()) == [(1, "a"), (2, "b")] and len(glob.glob(f"{t.path}/data/*")) == 2
    t.upsert(frame(spark, [(1, "z"), (3, "c")]))
    assert rows(t.read()) == [(1, "z"), (2, "b"), (3, "c")]
    t.vacuum()
    assert rows(t.read()) == [(1, "z"), (2, "b"), (3, "c")]


def test_of_two_runs_at_once_one_fails(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), ["k"], 4)
    t.upsert(frame(spark, [(1, "a")]))
    stale, failed = t.entries(), 0
    for v in ("b", "c", "d"):
        other = BucketedTable(spark, t.path, ["k"], 4)
        first = [stale]
        other.entries = lambda o=other, f=first: f.pop() if f else BucketedTable.entries(o)  # reads the list before the others write
        try:
            other.upsert(frame(spark, [(1, v)]))
        except RuntimeError:
            failed += 1
    assert t.read().count() == 1 and rows(t.read())[0][1] in "bcd" and t.hash() == full_hash(t)


def test_new_columns_and_empty_tables(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), ["k"], 3)
    assert t.read() is None and t.near(frame(spark, [(1, "")])) is None and t.vacuum() == 0
    assert t.upsert(frame(spark, [])).count() == 0 and t.hash() == (0, "0" * 76)
    t.upsert(frame(spark, [(1, "a"), (2, "b")]))
    t.upsert(spark.createDataFrame([(2, 5)], "k int, n long"))
    assert rows(t.read().select("k", "v", "n")) == [(1, "a", None), (2, None, 5)] and t.hash() == full_hash(t)


def test_added_counters(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), ["k"], 3)
    counters = lambda data: spark.createDataFrame(data, "k string, n long, amount decimal(24,4)")
    for batch, data in (("1", [("a", 1, None), (None, 2, None)]), ("2", [("a", 5, None), ("a", 1, None)]), ("2", [("a", 100, None)])):
        t.add(counters(data), ["n", "amount"], batch)
    assert rows(t.read()) == [("a", 7, None), (None, 2, None)]


def test_hashes_add_up(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "ü")], "k int, v string")
    whole = content.parts_of(df, ["k", "v"]).select(content.content_hash_of()).first()[0]
    halves = content.parts_of(df.filter("k = 1"), ["k", "v"]).unionByName(content.parts_of(df.filter("k > 1"), ["k", "v"]))
    assert content.merged(halves).select(content.content_hash_of()).first()[0] == whole
    gone = halves.unionByName(content.parts_of(df.filter("k = 3"), ["k", "v"], sign=F.lit(-1)))
    assert content.merged(gone).select(content.content_hash_of()).first()[0] == content.parts_of(df.filter("k < 3"), ["k", "v"]).select(content.content_hash_of()).first()[0]
    assert content.parts_of(df.distinct(), ["k", "v"]).select(content.content_hash_of()).first()[0] != whole
    changes = content.row_changes(df.distinct(), frame(spark, [(1, "b"), (2, None), (9, "n")]), ["k"], ["v"])
    assert rows(changes) == [(1, "a", -1), (1, "b", 1), (9, "n", 1)]


def test_changes_applied_to_buckets(spark, tmp_path):
    nodes, state = (BucketedTable(spark, str(tmp_path / n), ["k"], 4) for n in "ns")
    assert rows(snapshots.apply_changes(frame(spark, [(1, "a"), (2, None)]), ["k"], ["v"], nodes, state)) == [("CREATE", 2)]
    assert rows(snapshots.apply_changes(frame(spark, [(1, "a"), (2, None)]), ["k"], ["v"], nodes, state)) == [("SKIP", 2)]
    assert rows(snapshots.apply_changes(frame(spark, [(1, "z"), (2, None), (3, "n")]), ["k"], ["v"], nodes, state)) == [("CREATE", 1), ("MERGE", 1), ("SKIP", 1)]
    assert rows(nodes.read()) == [(1, "z"), (2, None), (3, "n")] and state.read().count() == 3


def test_stream_into_buckets(spark, tmp_path):
    src = str(tmp_path / "in")
    for data in ([(1, "a"), (2, "b")], [(2, "c")]):
        frame(spark, data).write.mode("append").parquet(src)
        stream = spark.readStream.schema("k int, v string").parquet(src)
        apply_stream(stream, ["k"], ["v"], str(tmp_path / "n"), str(tmp_path / "s"), str(tmp_path / "c"), 4).awaitTermination()
    assert rows(BucketedTable(spark, str(tmp_path / "n"), ["k"]).read()) == [(1, "a"), (2, "c")]
