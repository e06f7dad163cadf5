"""Name linking and value leaders against brute force, and their queries against SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.functions.scalars import normalize_value
from kgspark.functions.similarity import jaro_winkler_batch, ratio
from kgspark.operators import conflicts, name_search, value_leaders
from kgspark.plans import names

SYLLABLES = "an ber cor dan el fi gor hal in jo ka li mar nor ol per qui ros ste tor ul vik wen xa yor zel ray mon tis lan".split()


def misspelt(draw, text):
    out = list(text)
    for _ in range(draw.randint(0, 3)):
        i = draw.randrange(len(out))
        out[i : i + 1] = draw.choice([[], [draw.choice("aeiourst")], [out[i], draw.choice("aeiourst ")]])
        out = out or ["x"]
    return "".join(out)


def test_names_against_all_pairs(spark):
    draw = random.Random(11)
    make = lambda: " ".join("".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(1, 2)))
    known = sorted({make() for _ in range(1000)} | {"a", "ab", "abcd", "é", "ann", "　x", "the very long name of a department with many words in it " * 2})
    asked = sorted({misspelt(draw, draw.choice(known)) if draw.random() < 0.8 else make() for _ in range(500)} | {"b", "abdc", "\t", "x　", "bac"})
    full = np.round(jaro_winkler_batch([x for x in asked for _ in known], known * len(asked)).reshape(len(asked), -1), 9)
    k = spark.createDataFrame([(x, i) for i, x in enumerate(known)], "alias string, entity_id long")
    m = spark.createDataFrame([(x,) for x in [*asked, None]], "m string")
    for threshold in (0.9, 0.75, 0.5):
        got = {(r["m"], r["entity_id"], r["score"]) for r in name_search.near_names(m, k, threshold).collect()}
        assert got == {(asked[i], int(j), float(full[i, j])) for i, j in zip(*np.nonzero(full >= threshold), strict=True)}
    got = {r["m"]: (r["entity_id"], r["score"]) for r in name_search.nearest_names(m, k, 0.75).collect()}
    assert got == {x: (int(full[i].argmax()), float(full[i].max())) for i, x in enumerate(asked) if full[i].max() >= 0.75}
    assert name_search.nearest_names(m.limit(0), k, 0.75).count() == name_search.nearest_names(m, k.limit(0), 0.75).count() == 0


def test_names_by_group(spark):
    k = spark.createDataFrame([("anna", 1, "x"), ("annb", 2, "y"), ("zed", 3, "x")], "alias string, entity_id long, block string")
    m = spark.createDataFrame([("annc", "x"), ("zed", "y")], "m string, block string")
    assert [(r["m"], r["entity_id"]) for r in name_search.near_names(m, k, 0.7, group="block").collect()] == [("annc", 1)]


def test_few_pairs_are_met():
    """Keys of a high threshold bring few of all pairs together."""
    draw = random.Random(2)
    known = ["".join(draw.choice(SYLLABLES) for _ in range(draw.randint(3, 5))) for _ in range(2000)]
    buckets = sorted({name_search.bisect_right(name_search.BUCKETS, len(x)) - 1 for x in known})
    by_key: dict = {}
    rows = 0
    for i, x in enumerate(known):
        for key in name_search.name_keys(x, 0.92, {}, buckets, i % 2 == 0).tolist():
            by_key.setdefault(key, ([], []))[i % 2].append(i)
    rows = sum(len(a) * len(b) for a, b in by_key.values())
    assert rows < 0.05 * 1000 * 1000


def test_leaders_as_in_a_walk(spark):
    draw = random.Random(5)
    words = "open closed pending in progress blocked done review waiting for customer approval by team lead deployment".split()

    def value():
        kind = draw.random()
        text = "ticket %06d" % draw.randrange(400) if kind < 0.3 else " ".join(draw.choice(words) for _ in range(draw.randint(1, 9))) if kind < 0.6 else "".join(draw.choice("abc ") for _ in range(draw.randint(1, 70))).strip()
        return misspelt(draw, text) if text and draw.random() < 0.5 else text

    pool = [value() for _ in range(300)]
    rows = [(i, f"s{draw.choice((0, 0, 0, 1, 2))}", "p", draw.choice(pool) if draw.random() < 0.9 else value(), draw.choice((None, *range(50)))) for i in range(1500)]
    df = spark.createDataFrame([*rows, (9999, "s0", "p", None, 3), (9998, "", "p", "x", 3)], "id long, subject_id string, predicate string, value string, valid_from long")
    first: dict = {}
    for r in df.select("subject_id", F.coalesce(normalize_value(F.col("value")), F.lit("")).alias("v"), "valid_from", "id").collect():
        own = ((r["valid_from"] is not None, r["valid_from"] or 0), r["id"])
        if r["subject_id"]:
            first[r["subject_id"], r["v"]] = min(first.get((r["subject_id"], r["v"]), own), own)
    for threshold in (0.92, 0.7):
        want = {}
        for s in {s for s, _ in first}:
            leaders: list = []
            for v in sorted((v for t, v in first if t == s), key=lambda v: first[s, v]):
                found = v if not v else next((x for x in leaders if x == v or ratio(v, x) >= threshold), None)
                if found is None:
                    leaders.append(v)
                want[s, v] = found or v
        assert {(r["subject_id"], r["value_key"]): r["bucket"] for r in conflicts.value_buckets(df, threshold).collect()} == want


def test_chains_are_walked_through(spark):
    """Each string is similar to its neighbours only: every second one leads, however long the chain."""
    n = 60
    edges = [(i, i + 1, (i,), f"v{i}") for i in range(n)] + [(100, 101, (100,), "w")]
    df = spark.createDataFrame(edges, "a long, b long, first_a struct<t: long>, leader string")
    assert {r["node"] for r in value_leaders.followers(df).collect()} == {*range(1, n + 1, 2), 101}
    assert value_leaders.followers(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", list(names.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("orders", "part", "documents", "embeddings", "events", "customer"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = names.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.sql(names.ORACLE_SQL[name]).select(", ".join(cols)).fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want)) and want


def test_small_groups_need_no_keys(spark, monkeypatch):
    """Groups of few values are compared pair by pair: long values would have over a thousand keys each."""
    monkeypatch.setattr(value_leaders, "_gram_ranks", lambda *_: 1 / 0)
    draw = random.Random(2)
    rows = []
    for g in range(30):
        base = "the quick brown fox number "
        for v in {base + draw.choice("012") + draw.choice(["", "abcdefgh" * 4, "abcdefg"]) + draw.choice(["", "x"]) for _ in range(8)}:
            rows.append((len(rows), f"g{g}", v, (len(rows),)))
    values = spark.createDataFrame(rows, "node long, group string, value string, first struct<n: long>")
    want = {(a, b) for a, g, v, _ in rows for b, h, w, _ in rows if g == h and a < b and ratio(w, v) >= 0.92}
    assert want and {(r["a"], r["b"]) for r in value_leaders.similar_pairs(values, 0.92).collect()} == want
