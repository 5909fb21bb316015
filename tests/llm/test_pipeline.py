"""The pipeline's stages keep what a brute-force version keeps, on the smallest given tables."""

import os
import random
from collections import Counter

import pytest

from parcelry.llm import op5_toxicity
from tests.llm.test_llm import brute_near

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, frames = docs, {}
    for name, stage in P.STAGES:
        frames[name] = P.cut(stage(spark, kept, SF))
        kept = frames[name]
        if name != P.STAGES[-1][0]:
            assert kept.columns == docs.columns
    model = op5_toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    calm = {r["doc_id"] for r in op5_toxicity.toxicity_scores(docs, model).collect() if r["score"] < 0.5}
    ids = {n: [r["doc_id"] for r in f.select("doc_id").collect()] for n, f in frames.items()}
    assert set(ids["toxicity"]) == calm
    rows = [(r["doc_id"], r["text"], None) for r in frames["toxicity"].collect()]
    assert sorted(ids["near_duplicates"]) == sorted(d for d, _, _, k in brute_near(rows) if k)
    assert set(ids["decontamination"]) <= set(ids["near_duplicates"])
    items = [r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = {d: " ".join(t.lower().split()) for d, t, _ in rows}
    assert not [d for d in ids["decontamination"] if any(" ".join(i.split()) in text[d] for i in items)]
    assert set(ids["mixing"]) <= set(ids["decontamination"]) and max(map(ids["mixing"].count, set(ids["mixing"]))) <= 2
    assert sorted(ids["sharding"]) == sorted(ids["mixing"])
    assert {r["shard"] for r in frames["sharding"].collect()} == set(range(8))


def write(spark, folder, docs):
    """A folder of tables with these documents (with clashing names), labels and benchmark items with nulls."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "size", "shard", "slot", "key", "n", "row", "gone_id", "before", "us", "node", "t_row"]
    frame = spark.createDataFrame([(i, t, "en", s, *([k] * 12)) for k, (i, t, s) in enumerate(docs)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in names[4:]))
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(0, 40)] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return frame


ITEM = "the benchmark passage that nobody may train on since it is a test of words"


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids, ties, and columns of the names used inside."""
    import corpus_pipeline as P

    rng = random.Random(3)
    text = lambda k: " ".join(rng.choices([f"w{i}" for i in range(4000)], k=k))
    rows = [(i, text(30 + i % 5), f"s{i % 4}") for i in range(60)]
    rows += [(None, text(25), None) for _ in range(10)] + [(5, text(25), "s1") for _ in range(5)]  # null and repeated ids
    rows += [(70, rows[0][1], "s0"), (None, rows[1][1], "s0"), rows[2], rows[2]]  # copies, a null id's copy, repeated rows
    rows += [(80, f"{text(9)} {ITEM} {text(9)}", "s2"), (81, None, "s1"), (82, "", None), (83, text(30_000), "s3"), (None, None, None)]
    docs = write(spark, str(tmp_path), rows)
    kept = docs
    for name, stage in P.STAGES:
        kept = P.cut(stage(spark, kept, str(tmp_path)))
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in kept.collect()]
            assert 70 not in ids and ids.count(5) == 6 and ids.count(2) == 1 and ids.count(None) == 11 and {81, 82, 83} <= set(ids)
        if name == "decontamination":
            assert 80 not in {r["doc_id"] for r in kept.collect()}
        if name == "mixing":
            seen = Counter(tuple(r) for r in kept.collect())
            assert max(seen.values()) <= 2 and sum(r[0] is None for r in seen) >= 5 and set(seen) <= {tuple(r) for r in docs.collect()}
        if name != "sharding":
            assert kept.columns == docs.columns
    assert kept.columns == [*docs.columns, "size_", "text_crc32", "shard_", "slot_"]
    assert Counter(tuple(r)[: len(docs.columns)] for r in kept.collect()) == seen


def test_pipeline_on_no_rows(spark, tmp_path):
    import corpus_pipeline as P

    docs = write(spark, str(tmp_path), [])
    out = P.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns
