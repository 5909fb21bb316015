"""Links of pairs that are alone in their bucket group."""

import random

from parcelry.llm import op7_minhash_bayes
from tests.llm.test_llm import brute_near, by_id, frame


def test_a_pair_alone_in_its_group_is_compared_although_its_greater_class_met_another_one(spark):
    rng, rows = random.Random(5), []
    for k in range(40):  # of three windows of a text the first two reach 75 %; the third shares only buckets with them
        text = [f"w{k}_{rng.randrange(10**6)}" for _ in range(130)]
        rows += [(3 * k + i, " ".join(text[at : at + 94]), "s") for i, at in enumerate((0, 10, 32))]
    got = by_id([tuple(r) for r in op7_minhash_bayes.near_duplicates(frame(spark, rows)).collect()])
    assert got == by_id(brute_near(rows))
    assert len({r[2] for r in got}) == 80
    assert op7_minhash_bayes.keep_one(frame(spark, rows)).count() == 80
