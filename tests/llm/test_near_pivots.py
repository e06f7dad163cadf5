"""A large group of near copies is verified in few pairs a document."""

import random

from kgspark.llm import near_dedup as N


def test_near_copies_are_verified_in_few_pairs(spark, monkeypatch):
    rnd, base = random.Random(8), [f"w{i}" for i in range(150)]
    rows = []
    for k in range(300):
        own = list(base)
        for at in rnd.sample(range(150), 1):
            own[at] = f"n{k}x{at}"
        rows.append((k, " ".join(own)))
    verified, inner = [], N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, *rest: verified.append(pairs.distinct().count()) or inner(pairs, *rest))
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in found.collect()} == {0}
    assert sum(verified) < 4 * 300, verified
