"""The near-duplicate stage against brute force over all pairs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kgspark.llm import near_dedup as N
from kgspark.shared import table


def words_of(text):
    words = (text or "").encode().translate(N.LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots(sets):
    """The smallest id reachable from each by pairs of similarity 0.8 and more, and the number of such pairs of different sets."""
    parent, n = {i: i for i in sets}, 0

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 5 * common >= 4 * both:
            n += common < both
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, n


@pytest.mark.parametrize("hot_key", [64, 3])
def test_all_near_copies_are_found(spark, hot_key):
    rnd = random.Random(3)
    rows = [None, "", " \n", "one", "ONE", "one two three four", "a a a a a a a a", "a a a a a a"]
    for _ in range(12):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.randint(5, 120))]
        for _ in range(8):
            x = list(base)
            for _ in range(rnd.choice((0, 1, 1, 2, 3, 5))):
                at = rnd.randrange(len(x))
                x[at : at + rnd.randint(0, 2)] = [f"n{rnd.randrange(9)}"] * rnd.randint(0, 2)
            rows.append(" ".join(x))
    shared = " ".join(f"s{i}" for i in range(30))
    rows += [f"{shared} {' '.join(f'u{k}x{i}' for i in range(k % 12))}" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want, n = roots({i: words_of(t) for i, t in enumerate(rows)} | {i: {()} for i in (0, 1, 2)})
    assert n > 50
    assert {r["id"]: r["component_id"] for r in N.near_duplicates(df, hot_key=hot_key).collect()} == want


def test_stage_keeps_one_of_each_group(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    want, _ = roots({r["doc_id"]: words_of(r["text"]) or {()} for r in docs.collect()})
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()} == {i for i, x in want.items() if i == x}
    odd = spark.createDataFrame([(None, "Same text"), (6, "same text"), (6, "same text"), (7, "other")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in N.near_dedup(odd).collect()) == ["6", "7"]  # of repeated rows one stays
    same = spark.createDataFrame([(2, "a b c d", 1), (5, "x y z w", 2), (5, "a b c d", 3)], "doc_id long, text string, t1 int")
    assert sorted(r["t1"] for r in N.near_dedup(same).collect()) == [1, 2] and N.near_dedup(same).columns == same.columns
    assert N.near_dedup(odd.where(F.lit(False))).count() == 0
