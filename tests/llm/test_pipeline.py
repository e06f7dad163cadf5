"""The pipeline's stages and their chain against brute force, and on odd tables."""

from collections import defaultdict

from pyspark.sql import functions as F
from test_llm import hits_of
from test_near_dedup import roots, words_of

import corpus_pipeline
from kgspark.llm.toxicity import toxicity_report
from kgspark.shared import table

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_chain(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = toxicity_report(docs, table(spark, SF, "labels")).collect()
    left = {r["doc_id"]: texts[r["doc_id"]] for r in scores if r["score"] < 0.5}
    assert len(left) < len(texts)
    groups = defaultdict(list)
    for i, t in left.items():
        groups[lower(t)].append(i)
    left = {max(ids): left[max(ids)] for ids in groups.values()}
    names, _ = roots({i: words_of(t) or {()} for i, t in left.items()})
    left = {i: t for i, t in left.items() if names[i] == i}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    left = {i: t for i, t in left.items() if not hits_of(t, items)[1]}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(left) and len(left) > 0.5 * len(texts)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= corpus_pipeline.CAPACITY


def test_odd_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " ", "x"), (None, "some text here", "x"), (4, "some text here", "y"), (4, "some text here", "y"), (5, "b " * 300_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    for part in (docs, docs.where(F.lit(False))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            part = stage(spark, part, SF)
            assert part.columns == docs.columns, name
        kept = part.collect()
        packed = corpus_pipeline.STAGES[-1][1](spark, part, SF).collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept}
    odd = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, SF)
    assert sorted(str(r["doc_id"]) for r in odd.collect()) == ["2", "4", "5"]
