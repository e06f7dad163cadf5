"""The index of near duplicates against one run over all documents and against all pairs."""

import random

from pyspark.sql import functions as F

from kgspark.operators import near_duplicates, near_index
from kgspark.shared import shared_dir


def _docs(seed):
    draw = random.Random(seed)
    texts = []
    for _ in range(6):
        base = [f"w{draw.randrange(10**6)}" for _ in range(80)]
        for _ in range(5):
            own = list(base)
            own[draw.randrange(80)] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(own))
    # a chain: each one is near the next only
    chain = [f"c{i}" for i in range(100)]
    for step in range(4):
        texts.append(" ".join([*[f"n{step}-{i}" if i < 3 * step else chain[i] for i in range(100)]]))
    texts += ["same words again and again here"] * 20 + ["", None, "lone", "..."]
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [(i, texts[j]) for i, j in enumerate(order)]


def _wanted(rows):
    sets = {i: set(near_duplicates.shingle_hashes(t or "").tolist()) for i, t in rows}
    up = {i: i for i, s in sets.items() if s}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in up:
        for b in up:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    of = {i: top(i) for i in up}
    return {i: c for i, c in of.items() if list(of.values()).count(c) > 1}


def test_batches_in_any_order_leave_the_clusters_of_all_pairs(spark):
    rows = _docs(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _wanted(rows)
    whole = near_index.add_documents(near_index.new_near_index(spark), docs)
    assert {r["id"]: r["cluster"] for r in near_index.clusters_in(whole, spark).collect()} == want
    index, kept = near_index.new_near_index(spark), f"{shared_dir(spark)}/kept-{random.randrange(1 << 60):x}"
    for i in (2, 0, 1):
        index = near_index.add_documents(index, docs.where(F.col("doc_id") % 3 == i).withColumn("node", F.lit("clash")).withColumn("band", F.lit(1)))
    near_index.save_near_index(index, spark, kept)
    index = near_index.open_near_index(spark, kept)
    assert {r["id"]: r["cluster"] for r in near_index.clusters_in(index, spark).collect()} == want
    some = docs.where("doc_id < 9").select(F.col("doc_id").alias("id"))
    assert {r["id"]: r["cluster"] for r in near_index.clusters_of(index, some).collect()} == {i: c for i, c in want.items() if i < 9}
    # known ids, an empty batch and texts without tokens change nothing
    again = near_index.add_documents(near_index.add_documents(index, docs.limit(0)), spark.createDataFrame([(0, "other words"), (None, "lone"), (900, None)], "doc_id long, text string"))
    assert {r["id"]: r["cluster"] for r in near_index.clusters_in(again, spark).collect()} == want
    assert near_index.clusters_in(near_index.new_near_index(spark), spark) is None


def test_a_band_that_all_share_is_compared_in_proportion(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(k, " ".join([*base, f"end{k}"])) for k in range(300)], "doc_id long, text string")
    compared, alike = [], near_index._alike
    monkeypatch.setattr(near_index, "_alike", lambda index, pairs, fresh: compared.append(pairs.select("a", "b").distinct().count()) or alike(index, pairs, fresh))
    index = near_index.add_documents(near_index.new_near_index(spark), docs)
    assert {r["cluster"] for r in near_index.clusters_in(index, spark).collect()} == {0}
    assert sum(compared) < 25 * 300  # of 44,850 pairs, at most one a band and document
