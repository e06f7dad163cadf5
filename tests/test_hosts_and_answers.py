"""Code-host and extraction-output scans, and the chain from mentions to decisions, on small literals."""

import json

from kgspark.operators import answering
from kgspark.sources import hosts, records


def test_activity(spark):
    ticket = lambda n, user, pr: ("a/b", n, f"T{n}", None, user, "2024", None, None, None, "open", pr)
    pulls = spark.createDataFrame([ticket(1, ("ann",), None)], hosts.TICKET)
    issues = spark.createDataFrame([ticket(1, ("ann",), ("u",)), ticket(2, None, None)], hosts.TICKET)
    commits = spark.createDataFrame([("a/b", "s1", ("First\nrest", ("Bob", "2023"))), ("a/b", None, None)], hosts.COMMIT)
    got = sorted((r["kind"], r["id"], r["title"], r["body"], r["author"], r["number"]) for r in hosts.activity_records(pulls, issues, commits).collect() if r["id"])
    assert got == [("commit", "s1", "First", "First\nrest", "Bob", None), ("issue", "a/b#2", "T2", "", "", 2), ("pull", "a/b#1", "T1", "", "ann", 1)]
    assert hosts.activity_records(pulls, issues, commits).count() == 4


def test_extractions(spark, tmp_path):
    one = {"document": {"source_id": "d1"}, "extraction": {"candidate_entities": [{"name": "Ann"}]}}
    flat = {"candidate_facts": [{"subject_entity": "Ann", "predicate": "p", "value": "v"}], "extraction": {}}
    for name, data in {"a": {"results": [one, flat]}, "b": [one], "c": flat}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data), encoding="utf-8-sig" if name == "c" else "utf-8")
    got = sorted((r["source_id"] or "", len(r["candidate_entities"]), len(r["candidate_facts"]), len(r["candidate_relations"])) for r in records.read_extractions(spark, f"file://{tmp_path}").collect())
    assert got == [("", 0, 1, 0), ("", 0, 1, 0), ("d1", 1, 0, 0), ("d1", 1, 0, 0)]


def test_answer(spark):
    mentions = spark.createDataFrame([(1, "Ann"), (2, "zzzz"), (3, None)], "question_id long, mention string")
    entities = spark.createDataFrame([("e1", ["Ann"]), ("e2", ["Bob"]), ("e3", ["Cy"]), ("e4", ["Di"])], "id string, aliases array<string>")
    edges = [("e1", "e2", "knows", "x1"), ("e3", "e2", "knows", "x2"), ("e3", "e4", "knows", "x3"), ("e1", "s", "has_state", "x4"), ("e1", "e2", "knows", "x1")]
    edges = spark.createDataFrame(edges, "src string, dst string, predicate string, source_doc_id string")
    facts = [("e1", "current", None, "d1"), ("e3", "current", None, "d2"), ("e3", "current", "restricted", "d3"), ("e4", "current", None, "d4"), ("e1", "superseded", None, "d5")]
    facts = spark.createDataFrame(facts, "subject_id string, state string, access_level string, source_doc_id string")
    got = {r["question_id"]: r for r in answering.answer(mentions, entities, facts, edges, "member").collect()}
    # e1, e2 and e3 are within two hops; two facts, two edges, four documents, a link of 1
    assert tuple(got[1])[1:5] == (2, 2, 4, 1.0) and round(got[1]["confidence"], 6) == round(0.4 * 0.35 + 0.8 * 0.25 + 0.3, 6) and not got[1]["abstained"]
    assert all((got[q]["n_facts"], got[q]["confidence"], got[q]["abstained"]) == (0, 0.0, True) for q in (2, 3))
    assert answering.answer(mentions, entities.limit(0), facts, edges, "member").where("not abstained").isEmpty()


def test_answer_falls_back_to_retrieved_documents(spark):
    mentions = spark.createDataFrame([(1, "Ann"), (2, "zzzz"), (3, "yyyy")], "question_id long, mention string")
    questions = spark.createDataFrame([(1, "who is Ann?"), (2, "what of di"), (3, "x")], "question_id long, question string")
    found = spark.createDataFrame([(1, "d4"), (2, "d4"), (2, "d9"), (3, "d9")], "question_id long, doc_id string")
    entities = spark.createDataFrame([("e1", ["Ann"], "d1"), ("e4", ["Di"], "d4")], "id string, aliases array<string>, source_doc_id string")
    facts = spark.createDataFrame([("e1", "current", None, "d1"), ("e4", "current", None, "d4")], "subject_id string, state string, access_level string, source_doc_id string")
    edges = spark.createDataFrame([], "src string, dst string, predicate string, source_doc_id string")
    got = {r["question_id"]: r for r in answering.answer(mentions, entities, facts, edges, "member", questions=questions, found=found).collect()}
    assert round(got[1]["confidence"], 6) == round(0.035 + 0.05 + 0.3, 6) and got[1]["mean_link"] == 1.0
    r = got[2]
    assert r["n_facts"] == 1 and r["mean_link"] >= 0.4 and round(r["confidence"], 6) == round(max(0.0, 0.035 + 0.05 + 0.3 * r["mean_link"] - 0.15), 6)
    assert got[3]["n_facts"] == 0 and got[3]["abstained"]


def test_headings_round_exactly(spark):
    """Scores to three digits as Python and the SQL's format have them: by the exact value, ties to even."""
    from kgspark.operators.retrieval import context_blocks

    scores = [12.0625, 12.1875, 1.0005, 2.0015, 3.0025, 0.1235, 57.4445]
    found = spark.createDataFrame([(1, i, s, i + 1) for i, s in enumerate(scores)], "question_id long, doc_id long, score double, rank int")
    docs = spark.createDataFrame([(i, "s", "x") for i in range(len(scores))], "doc_id long, source string, content string")
    got = {r["rank"]: r["block"] for r in context_blocks(found, docs).collect()}
    assert got == {i + 1: f"[{i + 1}] source_id={i} source=s score={s:.3f}\nx" for i, s in enumerate(scores)}
