"""Operators on small literals and against SQL on the smallest tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kgspark.functions import scalars as S
from kgspark.functions.similarity import best_similarity, jaro_batch, jaro_winkler, jaro_winkler_batch, register, sequence_ratio
from kgspark.operators import conflicts, graph, near_duplicates, resolution
from kgspark.operators.components import connected_components
from kgspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("name", ["w05_conflict_cascade", "w07_apply_decisions", "j05_blocking", "j11_expand", "j16_retrieve", "s26_shingles", "a02_components", "io20_upsert"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(catalog.ORACLE_SQL[name]).select(", ".join(cols)).fetchall()
    key = lambda r: tuple(str(x) for x in r)
    tidy = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(tidy, got.select(*cols).collect()), key=key) == sorted(map(tidy, want), key=key)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(7, i) for i in range(400, 480)] + [(999, 999), (None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert dict(rows(got, "node", "component")) == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_cascade_rules(spark):
    def fact(i, s, value, t, kind):
        return (i, s, "p", value, t, f"d{i}", kind)

    facts = [
        fact(1, "single", "a", 1, "gmail"), fact(2, "authority", "a", 1, "github"), fact(3, "authority", "b", 9, "gmail"),
        fact(4, "corroboration", "a", 1, "gmail"), fact(5, "corroboration", "A ", 2, "gmail"), fact(6, "corroboration", "b", 9, "gmail"),
        fact(7, "disputed", "a", 1, "gmail"), fact(8, "disputed", "b", 2, "gmail"),
        fact(9, "recency", "a", 1, "gmail"), fact(10, "recency", "b", 5, "gmail"), fact(11, "recency", "c", 3, "gmail"), (12, "", "p", "x", 1, "d", "gmail"),
    ]
    df = spark.createDataFrame(facts, "id long, subject_id string, predicate string, value string, valid_from long, source_doc_id string, doc_source_type string")
    got = conflicts.decide(conflicts.with_authority(df))
    found = {r["subject_id"]: (r["method"], r["current_id"]) for r in got.collect()}
    assert found == {"single": ("single", 1), "authority": ("authority", 2), "corroboration": ("corroboration", 5), "disputed": ("disputed", None), "recency": ("recency", 10)}
    states = dict(rows(conflicts.apply_decisions(conflicts.with_authority(df), got), "id", "state"))
    assert states[7] == "disputed" and states[3] == "superseded" and states[12] == "candidate"


def test_similarities(spark):
    assert jaro_batch(["martha", "", "a", "dixon"], ["marhta", "", "", "dicksonx"]).tolist() == pytest.approx([0.944444, 1.0, 0.0, 0.766667], abs=1e-6)
    assert jaro_winkler_batch([" Dwayne", "CRATE", None], ["duane", "trace", "x"]).tolist() == pytest.approx([0.84, 0.733333, 0.0], abs=1e-6)
    df = spark.createDataFrame([("abc", "abd"), (None, "x")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(jaro_winkler("a", "b")).collect()] == [0.8222, 0.0]
    assert [round(r[0], 4) for r in df.select(sequence_ratio("a", "b")).collect()] == [0.6667, 0.0]


def test_scalars(spark):
    df = spark.createDataFrame([("Re: Plan ", "2024-01-02T00:00:00Z", "", None)], "subject string, t string, e string, n string")
    r = df.select(
        S.subject_key(F.col("subject")).alias("k"), S.epoch_seconds(F.col("t")).alias("t"), S.first_non_empty("e", "n", "subject").alias("f"),
        S.stable_id("subject", "e").alias("i"), S.confidence(F.col("e")).alias("c"), S.shingles(S.dedup_tokens(F.col("e"))).alias("s"),
        S.identifiers(F.array("subject", F.lit("Mail a@b.co, ping @Sam"))).alias("ids"),
    ).first()
    assert (r["k"], r["t"], r["f"], r["c"], r["s"]) == ("plan", 1704153600, "Re: Plan ", 0.5, [])
    assert len(r["i"]) == 24 and r["ids"] == ["@sam", "a@b.co"]


def test_near_duplicates_and_upsert(spark):
    base = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, base), (2, base + " more"), (3, "other words here"), (4, base), (5, None)], "doc_id long, text string")
    clusters = near_duplicates.near_duplicate_clusters(docs)
    assert dict(rows(clusters, "id", "cluster")) == {1: 1, 2: 1, 4: 1}
    assert {r["id"] for r in near_duplicates.mark_duplicates(docs, clusters).where("is_canonical").collect()} == {2}


def test_resolution_and_graph(spark):
    e = spark.createDataFrame(
        [(1, "Ann Lee", "d1", "m", ["x"], ["ann@x.co"]), (2, "Ann Leigh", "d2", "m", ["x"], ["ann@x.co"]), (3, "Bob", "d3", "m", [], [])],
        "id long, name string, source_doc_id string, doc_source_type string, signature array<string>, identifiers array<string>",
    )
    merges, pending = resolution.resolve_entities(e)
    assert rows(merges, "id", "merged_into") == [(2, 1)] and pending.count() == 0
    m = spark.createDataFrame([(3, 2), (2, 1), (8, 9), (9, 8)], "id long, merged_into long")
    links = spark.createDataFrame([(3,), (9,), (5,)], "entity_id long")
    assert rows(resolution.redirect(links, m), "entity_id") == [(1,), (5,), (8,)]
    seeds = spark.createDataFrame([(1, 1)], "question_id long, node long")
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4)], "src long, dst long")
    assert rows(graph.expand(seeds, edges), "node", "hop") == [(1, 0), (2, 1), (3, 2)]


def test_title_case(spark):
    words = ["pull_request", "custom kind", "ABC-def ghi", "they're", "x1y2", "", "éa_Éb"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(S.title_case(F.col("w"))).collect()] == [w.title() for w in words]
