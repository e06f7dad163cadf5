"""Scans, normalisers, resolution, evaluation, packets and streams on small literals; queries of plans.records against SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from kgspark.functions import scalars as S
from kgspark.functions.similarity import register
from kgspark.operators import build, conflicts, dashboard, evaluation, identity, packets, resolution, retrieval
from kgspark.plans import ingest
from kgspark.plans import records as queries
from kgspark.sources import chat, hosts, normalize, records
from kgspark.streaming import feeds

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(queries.ORACLE_SQL[name]).select(", ".join(f'"{c}"' for c in cols)).fetchall()
    tidy = lambda r: tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r)
    assert sorted(map(tidy, got.select(*cols).collect())) == sorted(map(tidy, want))


def test_scans(spark, tmp_path):
    (tmp_path / "slack").mkdir()
    (tmp_path / "slack" / "a.json").write_text(json.dumps({"records": [{"ts": "1", "channel": "c", "text": "hello", "n": 2}, {"ts": "2", "channel": "c", "message": "there"}]}), encoding="utf-8-sig")
    (tmp_path / "slack" / "b.jsonl").write_text('{"ts": "3", "channel": "d", "text": "x"}\n')
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "n1__20240102-plan.txt").write_text("﻿Plan\nbody")
    (tmp_path / "notes" / "n2.md").write_text("first line\nDATE:  2023-05-06 \nrest")
    got = records.read_corpus(spark, [("slack", f"{tmp_path}/slack"), ("notes", f"{tmp_path}/notes"), ("gone", f"{tmp_path}/gone")])
    rows = {r["source_id"]: r for r in got.collect()}
    assert set(rows) == {"1", "2", "3", "n1", "n2"}
    assert (rows["1"]["content"], rows["2"]["content"], rows["1"]["container_id"], json.loads(rows["1"]["metadata"])["n"]) == ("hello", "there", "c", 2)
    assert (rows["n1"]["timestamp"], rows["n1"]["content"], rows["n1"]["container_id"], json.loads(rows["n1"]["metadata"])["title"]) == ("2024-01-02", "Plan\nbody", "notes", "Plan")
    assert rows["n2"]["timestamp"] == "2023-05-06"
    assert records.read_upload(spark, f"{tmp_path}/notes/n2.md").first()["source"] == "document"
    done = {"source": "x", "source_id": "1", "content": "c", "container_id": "k", "metadata": {"a": "1"}}
    (tmp_path / "done.json").write_text(json.dumps([done]))
    assert records.read_upload(spark, f"{tmp_path}/done.json").first()["source"] == "x"
    assert normalize.infer_kind("/in/Jira/x.json", []) == "jira" and normalize.infer_kind("x.json", ["repo"]) == "github"
    with pytest.raises(ValueError):
        normalize.infer_kind("x.json", ["other"])
    (tmp_path / "q.jsonl").write_text('{"id": "q1", "query": "why", "answer": "so", "doc_ids": ["d"]}\n{"question_id": "q2", "question": "how"}\n')
    q = {r["question_id"]: r for r in records.questions_of(spark.read.json(f"{tmp_path}/q.jsonl")).collect()}
    assert (q["q1"]["question"], q["q1"]["gold_answer"], q["q1"]["ground_truth_doc_ids"], q["q2"]["category"], q["q2"]["ground_truth_doc_ids"]) == ("why", "so", ["d"], "uncategorized", [])
    (tmp_path / "e.json").write_text(json.dumps({"employees": [{"employee_id": "1"}]}))
    (tmp_path / "e.csv").write_text("employee_id,name\n1,Ann\n")
    assert records.read_employees(spark, f"{tmp_path}/e.json").first()["employee_id"] == "1" and records.read_employees(spark, f"{tmp_path}/e.csv").first()["name"] == "Ann"
    assert records.read_judged(spark, f"{tmp_path}/none.json").count() == 0
    records.write_json(spark.createDataFrame([(1, None)], "a int, b string"), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").first()["value"] == '{"a":1,"b":null}'
    stored = spark.createDataFrame([("", "", "n", "", "", {"type": "Document", "source_doc_id": "d9"}), ("x", "c", "", "", "", {"type": "entity"}), ("__collection_init__", "c", "", "", "", {"type": "document"})], "id string, content string, note string, title string, created_at string, metadata map<string,string>")
    assert [(r["id"], r["content"]) for r in records.document_records(records.without_markers(stored)).collect()] == [("d9", "n")]


def test_values_as_text(spark):
    df = spark.createDataFrame([(["a", "", "b"], (2, "y"), True, 3, None)], "l array<string>, o struct<z:int,b:string>, f boolean, n int, e string")
    row = df.select(*[normalize.text_of(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns], normalize.strings_of(F.col("o"), df.schema["o"].dataType).alias("s")).first()
    assert tuple(row) == ("a\n\nb", '{"b":"y","z":2}', "True", "3", "", ["2", "y"])
    fold = spark.createDataFrame([("body ", ["x ", " "], [("ann", "hi")])], "body string, comments array<string>, replies array<struct<author:string,body:string>>")
    row = fold.select(normalize.fold_comments(F.col("body"), F.col("comments")).alias("c"), normalize.fold_comments(F.col("body"), F.col("replies"), "Replies:", author=True).alias("r")).first()
    assert tuple(row) == ("body\n\nComments:\n- x", "body\n\nReplies:\n- ann: hi")
    texts = ["[x](https://github.com/a/b)", "git@github.com:a/b.git", "https://www.github.com/a/b/pulls?x=1", "a/b/", "https://github.com/a/b.git#x"]
    assert {r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.clean_repo(F.col("t"))).collect()} == {"a/b"}
    row = spark.createDataFrame([("Été à Zürich!", "7.9", "x", "2024-01-01T00:00:00Z", "hey @bot-1 please")], "s string, n string, x string, t string, m string").select(
        S.ascii_slug(F.col("s")).alias("s"), S.lenient_int(F.col("n")).alias("n"), S.lenient_int(F.col("x")).alias("x"), S.valid_from(F.lit(""), F.col("t")).alias("v"),
        S.without_mention(F.col("m"), "bot-1").alias("m"), S.access_level(F.lit("Admin")).alias("a"), S.access_level(F.lit("guest"), F.lit("Restricted")).alias("b"),
        S.score_word(F.lit(" YES ")).alias("w"), S.display_title(F.lit(" "), F.lit("a\nb")).alias("d"),
    ).first()
    assert tuple(row) == ("ete-a-zurich", 7, 0, 1704067200, "hey please", "internal", "restricted", "yes", "a b")
    register(spark)
    assert tuple(spark.sql("select round(jaro_winkler('martha','marhta'), 4), stable_id(array('a', '', 'b')) = left(sha1('a|b'), 24), normalize_value(' A  b! ')").first()) == (0.9611, True, "a b")


def test_resolution_of_entities(spark):
    e = spark.createDataFrame(
        [("p1", "S. Rao", ["S. Rao"], None, "mail", ["x.co"], []), ("p2", "Soham Rao", ["Soham Rao", "S. Rao"], "d2", "mail", ["x.co"], ["rao@x.co"]), ("p3", "Bob", ["Bob"], "d2", "chat", [], [])],
        "id string, name string, aliases array<string>, source_doc_id string, doc_source_type string, domains array<string>, identifiers array<string>",
    )
    assert {(r["a"], r["b"]) for r in resolution.candidate_pairs(e).collect()} == {("p1", "p2"), ("p2", "p3")}
    facts = spark.createDataFrame([("p1", "role", "d1"), ("p2", "role", "d1"), ("p2", "role", "d2"), ("p3", "", "")], "subject_id string, predicate string, source_doc_id string")
    scored = {(r["a"], r["b"]): r for r in resolution.score_pairs(e, resolution.candidate_pairs(e), facts).collect()}
    assert scored["p1", "p2"]["name_similarity"] == 1.0 and scored["p1", "p2"]["overlap"] == 0.5 and round(scored["p1", "p2"]["combined"], 6) == 0.825
    merges, pending = resolution.resolve_entities(e, auto=0.8, facts=facts)
    assert [tuple(r) for r in merges.collect()] == [("p1", "p2")] and pending.count() == 0  # the fuller one survives
    assert {r["subject_id"] for r in resolution.repoint_facts(facts, merges).collect()} == {"p2", "p3"}
    many = spark.createDataFrame([(i, "same x", None, "t", []) for i in range(25)], "id long, name string, source_doc_id string, doc_source_type string, identifiers array<string>")
    pairs = {(r["a"], r["b"]) for r in resolution.candidate_pairs(many, 10).collect()}
    assert pairs == {(a, b) for a in range(25) for b in range(a + 1, 25) if a // 10 == b // 10}
    assert resolution.candidate_pairs(many, 10, across=True).count() == 300
    assert tuple(resolution.resolution_summary(e, merges, pending).first()) == (3, 1, 0)
    assert [r["combined"] for r in resolution.best_pairs(resolution.score_pairs(e, resolution.candidate_pairs(e), facts), 1).collect()] == [pytest.approx(0.825)]


def test_truth_discovery_against_plain_rounds(spark, monkeypatch):
    patched = monkeypatch
    rows = [(i, f"s{i % 7}", "p", f"v{i % 3}", i, str(i), ["a", "b", "", "c"][i % 4]) for i in range(60)]
    f = spark.createDataFrame(rows, "id long, subject_id string, predicate string, value string, valid_from long, source_doc_id string, doc_source_type string")
    claims = [((r[1], r[3]), r[6] or "unknown") for r in rows]
    behind = {}
    for claim, kind in claims:
        behind.setdefault(claim, set()).add(kind)
    weight = dict.fromkeys({k for _, k in claims}, 0.5)
    want = [dict(weight)]
    for _ in range(8):
        trust = {}
        for claim, kinds in behind.items():
            doubt = 1.0
            for k in kinds:
                doubt *= 1 - weight[k]
            trust[claim] = 1 - doubt
        new = {k: sum(trust[c] for c, x in claims if x == k) / sum(x == k for _, x in claims) for k in weight}
        moved = max(abs(new[k] - weight[k]) for k in weight)
        weight = new
        want.append(new)
        if moved < 0.01:
            break
    got = conflicts.discover_truth(f)
    assert len(got) == len(want) and all(g == pytest.approx(w) for g, w in zip(got, want, strict=True))
    patched.setattr(conflicts, "MAX_SETS", 2)  # by Spark jobs, to the same end
    jobs = conflicts.discover_truth(f)
    assert len(jobs) == len(want) and all(g == pytest.approx(w) for g, w in zip(jobs, want, strict=True))
    patched.setattr(conflicts, "FEW_SOURCES", 0)
    wide = f.withColumn("doc_source_type", F.coalesce(F.nullif("doc_source_type", F.lit("")), F.lit("unknown")))
    found = conflicts.truth_rounds(conflicts.claims_of(wide, "doc_source_type")).collect()
    assert {(r["round"], r["source"]): r["reliability"] for r in found} == {(i, k): pytest.approx(x) for i, w in enumerate(want) for k, x in w.items()}
    assert conflicts.truth_rounds(conflicts.claims_of(f.limit(0))).count() == 0
    compared = {r["doc_source_type"]: r["fixed"] for r in conflicts.learned_against_fixed(spark, {"github": 0.5, "zz": 0.1}).collect()}
    assert compared == {"github": 0.7, "zz": 0.3}


def test_evaluation_and_packets(spark):
    raw = spark.createDataFrame([(1, "who", [" Ann ", ""], "TEMPORAL", "soon"), (2, "what", None, "odd", None)], "question_id int, question string, target_entity_mentions array<string>, intent string, time_scope string")
    assert [tuple(r)[2:] for r in evaluation.understanding(raw).orderBy("question_id").collect()] == [(["Ann"], "temporal", "historical"), (["what"], "lookup", "current")]
    ids = spark.createDataFrame([(["a", ""], ["p"]), ([], ["p", None])], "e array<string>, p array<string>").select(evaluation.evidence_ids(F.col("e"), F.col("p")).alias("x"))
    assert [r["x"] for r in ids.collect()] == [["a"], ["p"]]
    assert tuple(evaluation.abstention_rate(spark.createDataFrame([], "abstained boolean")).first()) == (0, 0, 0.0)
    links = spark.createDataFrame([(1, "Ann", "e1", 1.0)], "question_id int, mention string, entity_id string, score double")
    facts = spark.createDataFrame([(1, "f2", "e1", "p", "v", "current", 9, "d1"), (1, "f1", "e1", "p", "w", "current", 100, "")], "question_id int, id string, subject_id string, predicate string, value string, state string, valid_from long, source_doc_id string")
    entities = spark.createDataFrame([(1, "e1", "Ann", "Person", "current", "d1")], "question_id int, id string, canonical_name string, entity_type string, state string, source_doc_id string")
    edges = spark.createDataFrame([(1, "e1", "knows", "e2", "d1"), (1, "e1", "has_state", "f1", "d1")], "question_id int, src string, predicate string, dst string, source_doc_id string")
    docs = spark.createDataFrame([], "question_id int, rank int, doc_id string, source string, content string, score double")
    rows = packets.packet_rows(links, facts, entities, edges, docs).orderBy("part", "sort_key").collect()
    assert [r["part"] for r in rows] == ["edges", "entities", "facts", "facts", "links"] and json.loads(rows[2]["item"])["id"] == "f2"
    assert [r["source_doc_id"] for r in packets.packet_evidence(facts).collect()] == ["d1"]
    shaped = packets.edge_shape(spark.createDataFrame([("a", None, "b", "raw")], "source string, target_entity_id string, target string, raw_predicate string")).first()
    assert (shaped["src"], shaped["dst"], shaped["predicate"]) == ("a", "b", "raw")
    held = spark.createDataFrame([({"value": None}, {"value": "m"}, {}), ({}, {"value": "m"}, {}), ({}, {}, {"title": "t"})], "additional map<string,string>, metadata map<string,string>, fields map<string,string>")
    assert [r[0] for r in held.select(packets.fact_value()).collect()] == ["", "m", "t"]
    q = spark.createDataFrame([(1, "alpha beta"), (2, "nothing")], "question_id int, question string")
    d = spark.createDataFrame([(3, "alpha alpha beta"), (1, "beta alpha alpha"), (2, "beta"), (4, None)], "doc_id int, text string")
    assert [(r["question_id"], r["doc_id"], r["rank"]) for r in retrieval.retrieve(q, d, 2).orderBy("rank").collect()] == [(1, 1, 1), (1, 3, 2)]
    assert retrieval.retrieve(q.limit(0), d).count() == 0 == retrieval.retrieve(q, d.limit(0)).count()
    fixed = spark.createDataFrame([("d", "x" * 400, "s")], "source_id string, content string, source string")
    assert len(json.loads(normalize.model_input(fixed).first()["payload"])["content"]) == 300
    x = spark.createDataFrame([("d1", "s", "1", [(" Acme ", "Org", None, None), ("api", "org", None, None), ("Al", "person", None, None)], None, None)], f"source_id string, source string, timestamp string, {build.EXTRACTION}")
    row = build.tagged(x).first()
    assert [(c["name"], c["type"], c["record_type"], c["source_doc_id"]) for c in row["candidate_entities"]] == [("Acme", "Organization", "Entity", "d1")] and row["candidate_facts"] == []
    assert dashboard.attention(spark.createDataFrame([("1", {}, {"type": "FactState", "state": "disputed"}, {})], "id string, fields map<string,string>, metadata map<string,string>, additional map<string,string>")).first()["count"] == 1


def test_streams(spark, tmp_path):
    """The upsert reads back what a batch upsert leaves, a second run of a batch changes nothing, and late repeats are dropped."""
    schema = "id long, version long, value string"
    for i, rows in enumerate(([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (3, 1, "d")], [(2, 1, "again"), (3, 0, "old")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        query = feeds.upsert_stream(stream, f"{tmp_path}/table", f"{tmp_path}/state")
        query.processAllAvailable()
        query.stop()
        assert i == 0 or feeds.read_upserts(spark, f"{tmp_path}/table").count() == 3
    got = {r["id"]: r["value"] for r in feeds.read_upserts(spark, f"{tmp_path}/table").collect()}
    assert got == {1: "c", 2: "again", 3: "d"}
    events = [("2024-01-01 00:10:00", "x", "e1"), ("2024-01-01 00:20:00", "x", "e1"), ("2024-01-01 05:00:00", "y", "e2"), ("2024-01-03 00:00:00", "z", "e3")]
    spark.createDataFrame(events, "ts string, event_type string, event_id string").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id").coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = feeds.without_repeats(spark.readStream.schema("ts timestamp, event_type string, event_id string").parquet(f"{tmp_path}/events"))
    query = feeds.activity_counts(stream, "1 hour", "1 hour").writeStream.format("memory").queryName("feed").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["event_type"], r["n"]) for r in spark.table("feed").collect()} == {("x", 1), ("y", 1), ("z", 1)}


def test_landed_payloads(spark):
    raw = [("1", "u1", None, None, "hi <@u2> and <@u9>", None, None, None), ("2", None, "b1", None, "x", "1", None, [("u1", "3")]), ("3", "u1", None, None, " ", None, None, None)]
    users = [("u1", "ann", ("", "Ann L")), ("u2", "bob", None)]
    payload = spark.createDataFrame([("C1", "general", raw, users)], f"channel string, channel_name string, messages array<struct<{chat.RAW}>>, users array<struct<{chat.USERS}>>")
    got = {r["ts"]: r for r in chat.shape_payloads(payload).collect()}
    assert set(got) == {"1", "2"} and (got["1"]["text"], got["1"]["user_name"], got["1"]["channel_id"]) == ("hi @bob and <@u9>", "Ann L", "C1")
    assert (got["2"]["user_id"], got["2"]["thread_ts"], got["2"]["reply_count"]) == ("b1", "1", 1)
    talk = spark.createDataFrame([("a/b", 7, "T", "body", ("ann",), "2024", [(("bob",), "2024", "yes")]), ("a/b", 8, None, None, None, None, None)], hosts.DISCUSSION)
    found = {r["number"]: (r["id"], r["body"], r["author"]) for r in hosts.discussion_records(talk).collect()}
    assert found == {7: ("a/b#discussion-7", "body\n\nReplies:\n- bob: yes", "ann"), 8: ("a/b#discussion-8", "", "")}
    tickets = spark.createDataFrame([("x", "b"), ("y", None)], "id string, body string")
    notes = spark.createDataFrame([("x", "2", "second"), ("x", "1", "first")], "id string, created_at string, body string")
    assert {r["id"]: r["body"] for r in hosts.with_comments(tickets, notes).collect()} == {"x": "b\n\nComments:\n- first\n- second", "y": ""}


def test_routing(spark):
    m = spark.createDataFrame([("m1", " hi ", "g1", None, "slack", "U1"), ("m2", "", "g1", None, "slack", "U2"), ("m3", "x", "g9", "c", "slack", "U1")], "message_id string, raw_message string, agent_id string, collection string, platform string, platform_user_id string")
    links = spark.createDataFrame([("c", "slack", "U1", "e1")], "collection string, platform string, platform_user_id string, employee_id string")
    people = spark.createDataFrame([("c", "e1", "Admin")], "collection string, employee_id string, access_role string")
    agents = spark.createDataFrame([("g1", "c", "guest")], "agent_id string, collection string, role_default string")
    got = {r["message_id"]: tuple(r)[1:] for r in identity.route_messages(m, links, people, agents).collect()}
    assert got["m1"] == ("hi", "c", "g1", "e1", "admin", False, None) and got["m2"][-3:] == ("guest", True, "message is empty") and got["m3"][-1] == "agent is unknown"


def test_ingestion_in_two_batches(spark):
    shape = f"source_id string, source string, timestamp string, {build.EXTRACTION}"
    person = lambda n, *a: (n, "person", list(a) or None, None)
    fact = lambda s, v: (s, "role", v, None, None)
    first = [
        ("d1", "jira", "2024-01-01", [person("Ann Lee", "ann@x.co"), person("api")], [("Ann Lee", "knows", "Bob Roe")], [fact("Ann Lee", "lead")]),
        ("d2", "gmail", "2024-01-02", [person("Ann Leigh", "ann@x.co"), person("Bob Roe")], None, [fact("Ann Leigh", "dev"), fact("Bob Roe", "ops")]), ("", "jira", "", [person("Skip Me")], None, None),
    ]
    graph = ingest.ingest(spark.createDataFrame(first, shape), 0)
    row = graph.summary.first()
    assert (row["documents"], row["skipped"], row["entities"], row["merges_made"], row["disputed"]) == (2, 1, 3, 1, 2)
    merged = {r["canonical_name"]: r["state"] for r in graph.entities.collect()}
    assert sorted(merged.values()) == ["candidate", "candidate", "resolved"] and len({r["subject_id"] for r in graph.facts.collect()}) == 2
    second = [("d3", "jira", "2024-02-01", [person("Ann Lee", "ann@x.co")], None, [fact("Ann Lee", "lead")])]
    again = ingest.ingest(spark.createDataFrame(second, shape), 0, known=graph)
    states = {(r["source_doc_id"], r["value"]): r["state"] for r in again.facts.collect()}
    assert states == {("d1", "lead"): "superseded", ("d3", "lead"): "current", ("d2", "dev"): "superseded", ("d2", "ops"): "current"}
    assert set(again.reliability) == {"jira", "gmail"} and again.facts.count() == 4
