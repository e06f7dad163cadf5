"""Vector search through cells against the scan of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.operators import retrieval, vector_index
from kgspark.plans import records
from kgspark.shared import shared_dir, table

SMALL = "/root/testdata/sf0.01"


def _folder(spark):
    return f"{shared_dir(spark)}/vectors-{np.random.default_rng().integers(1 << 60):x}"


def _rows(df):
    return sorted((r["question_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def _clustered(n, seed):
    draw = np.random.default_rng(seed)
    hubs = draw.normal(size=(12, 8)) * 4
    return [(i, (hubs[i % 12] + draw.normal(size=8) * 0.3).tolist(), "ab"[i % 2]) for i in range(n)]


def test_exact_search_reads_few_cells_of_clustered_vectors_and_finds_what_a_scan_finds(spark):
    rows = _clustered(1200, 1)
    rows += [(2000 + i, rows[5][1], "a") for i in range(400)]  # a third are one vector: ties by id
    docs = spark.createDataFrame(rows, "doc_id long, vector array<double>, kind string")
    index = vector_index.build_vectors(docs, _folder(spark), ["kind"])
    assert index.rows.sum() == 1600 and len(index.centers) <= 40
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("question_id"), "vector", F.create_map(F.lit("kind"), "kind").alias("filters"))
    got, want = _rows(vector_index.search_cells(index, asked, 7)), _rows(retrieval.search_vectors(asked, docs, ["kind"], 7))
    assert got == want
    blocks = _rows(vector_index.search_cells(index, asked, 7, dots=300))
    assert blocks == want
    # a bound is never below a true cosine, and closes most cells at the score of the seventh
    unit = vector_index._normal(np.array([r[1] for r in rows]))
    of = vector_index._angles(unit @ index.centers.T).argmin(axis=1)
    _, most = vector_index.cell_bounds(index, unit[:60])
    cosines = unit[:60] @ unit.T
    assert all(cosines[q, of == c].max() <= most[q, c] + vector_index.SLACK for q in range(60) for c in range(len(index.centers)) if (of == c).any())
    seventh = np.sort(cosines, axis=1)[:, -7]
    assert (most >= seventh[:, None] - vector_index.SLACK).mean() < 0.25


def test_batches_and_reopening_equal_one_index(spark):
    rows = _clustered(600, 2)
    docs = spark.createDataFrame(rows, "doc_id long, vector array<double>, kind string")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("question_id"), "vector")
    index = vector_index.build_vectors(docs.where("doc_id < 300"), _folder(spark))
    for _ in range(2):  # a batch that runs again replaces itself
        index = vector_index.add_vectors(index, docs.where("doc_id >= 300"), 1)
    assert index.rows.sum() == 600
    again = vector_index.open_vectors(spark, index.path, index.size, index.filters, index.id_type)
    assert _rows(vector_index.search_cells(again, asked)) == _rows(retrieval.search_vectors(asked.withColumn("filters", F.lit(None).cast("map<string,string>")), docs, []))


def test_odd_vectors_are_like_nothing(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [0.0, 0.0], "x"), (3, None, "x"), (4, [1.0], "x"), (5, [float("nan"), 1.0], "x"), (6, [1e300, 1e300], None), (None, [1.0, 0.0], "x"), (7, [-1.0, 0.0], "y"), (8, [1.0, None], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, vector array<double>, cell string")
    index = vector_index.build_vectors(docs, _folder(spark), ["cell"])
    assert index.rows.sum() == 3
    asked = spark.createDataFrame([(1, [2.0, 0.0], {}), (2, [2.0, 0.0], {"cell": "y"}), (3, [0.0, 0.0], {}), (4, None, None), (5, [1.0, 0.0], {"cell": None}), (6, [1.0, 0.0], {"cell": "z"})], "question_id long, vector array<double>, filters map<string,string>")
    got = _rows(vector_index.search_cells(index, asked, 2))
    assert got == [(1, 1, 1, 1.0), (1, 2, 6, pytest.approx(0.707107)), (2, 1, 7, -1.0), (5, 1, 1, 1.0), (5, 2, 6, pytest.approx(0.707107))]
    with pytest.raises(ValueError, match="no column"):
        vector_index.search_cells(index, spark.createDataFrame([(1, [1.0, 0.0], {"gone": "y"})], asked.schema))
    empty = vector_index.build_vectors(docs.limit(0), _folder(spark), ["cell"])
    assert vector_index.search_cells(empty, asked).count() == 0
    assert vector_index.add_vectors(empty, docs.limit(0), 1).rows.sum() == 0
    with pytest.raises(ValueError, match="anew"):
        vector_index.add_vectors(empty, spark.createDataFrame([(1, [1.0], "x")], docs.schema), 1)


def test_recall_of_probed_cells(spark):
    want = {(r["question_id"], r["doc_id"]) for r in records.io19_index_exact(spark, SMALL).collect()}
    got = {(r["question_id"], r["doc_id"]) for r in records.io19_index_probed(spark, SMALL).collect()}
    assert len(want) == 5 * table(spark, SMALL, "embeddings").where("vec_id % 20 = 0").count()
    recall = len(want & got) / len(want)
    print("recall", recall)
    index, asked = records._vectors(spark, SMALL)
    probes = vector_index.probes_for(index, asked, recall=1.0)
    assert 1 <= probes <= len(index.centers)
    assert {(r["question_id"], r["doc_id"]) for r in vector_index.search_cells(index, asked, probes=probes, exact=False).collect()} == want
    assert vector_index.probes_for(index, asked.limit(0)) == len(index.centers)
    assert recall >= 0.9


def test_search_in_bounded_pieces(spark):
    """Questions in several groups and blocks against brute force, with ties, nulls and zero vectors, and few scores at a time."""
    draw = np.random.default_rng(4)
    rows = [(i, draw.integers(-2, 3, 4).astype(float).tolist() if i % 13 else None, "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, vector array<double>, label string")
    asked = [(i, v, {"label": lab} if i % 2 else None) for i, v, lab in rows if i % 5 == 0]
    questions = spark.createDataFrame(asked, "question_id long, vector array<double>, filters map<string,string>")
    cosine = lambda x, y: round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6)
    want = {}
    for q, v, f in asked:
        near = sorted((-cosine(v, w), d) for d, w, lab in rows if v and w and any(v) and any(w) and (not f or f["label"] == lab))
        want |= {(q, place + 1): (d, -s) for place, (s, d) in enumerate(near[:5])}
    got = retrieval.search_vectors(questions, docs, ["label"], dots=100).collect()
    assert {(r["question_id"], r["rank"]): (r["doc_id"], r["score"] + 0.0) for r in got} == {k: (d, s + 0.0) for k, (d, s) in want.items()}
    assert retrieval.SCORES <= 10**6 and vector_index.NUMBERS <= 10**6  # what a task's memory grows to, whatever the tables' size
