"""Threads, mailboxes, chat, identities, graph build, answering and calibration on small literals."""

import base64
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from kgspark.functions.similarity import jaro_winkler_batch
from kgspark.operators import answering, build, identity, threads
from kgspark.plans import people
from kgspark.sources import chat, mail

MBOX = """From a@x.co Mon Jan  1 00:00:00 2024
Message-ID: <m1@x>
From: Ann Lee <a@x.co>
Subject: Plan
Date: Mon, 01 Jan 2024 10:00:00 +0000

First body
From b@x.co Mon Jan  1 00:00:00 2024
Message-ID: <m2@x>
References: <m0@x> <m1@x>
From: b@x.co
Subject: Re: Plan
Date: no date
Content-Type: text/html

<p>Hi &amp; bye</p>
From c@x.co Mon Jan  1 00:00:00 2024
Subject: no id

dropped
"""


def test_mbox(spark, tmp_path):
    (tmp_path / "a.mbox").write_text(MBOX)
    got = {r["message_id"]: r for r in mail.read_mbox(spark, f"file://{tmp_path}/a.mbox").collect()}
    assert set(got) == {"m1@x", "m2@x"}
    assert (got["m1@x"]["sender"], got["m1@x"]["body"], got["m1@x"]["date"]) == ("Ann Lee", "First body", "2024-01-01T10:00:00+00:00")
    assert (got["m2@x"]["sender"], got["m2@x"]["body"], got["m2@x"]["date"]) == ("b@x.co", "Hi & bye", "no date")
    assert got["m2@x"]["refs"] == ["m0@x", "m1@x"]


def test_payloads(spark):
    rows = [("i1", "t", ([("Message-Id", "<p1@x>"), ("FROM", '"Ann" <a@x.co>'), ("Subject", "S")], [("text/plain", "aGk_"), ("text/html", "aGk_")]))]
    got = mail.messages_of_payloads(spark.createDataFrame(rows, mail.PAYLOAD)).first()
    assert (got["message_id"], got["sender"], got["subject"], got["body"], got["refs"]) == ("p1@x", "Ann", "S", "hi?", [])


def test_nested_payloads(spark):
    coded = lambda text: base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")
    part = lambda kind, x: {"mimeType": kind, "parts": x} if isinstance(x, list) else {"mimeType": kind, "data": coded(x)}
    deep = part("multipart/related", [part("text/html", "<b>x</b>"), part("text/plain", "deep é?~")])
    both = part("multipart/mixed", [part("text/plain", "one"), part("multipart/alternative", [part("text/html", "<p>no</p>"), part("multipart/x", [deep])]), part("text/plain", "three"), part("image/png", "zz")])
    pages = part("multipart/mixed", [part("text/html", "<i>a</i> &amp; b"), part("text/html", "c"), part("multipart/mixed", [])])
    inner = part("multipart/mixed", [part("text/html", "<i>a</i>"), part("multipart/mixed", [part("text/html", "<i>b</i>")])])  # a part of pages counts as text
    heads = lambda date, **more: [{"name": "Date", "value": date}, {"name": "FROM", "value": "old"}, {"name": "From", "value": "ann"}, *[{"name": k, "value": v} for k, v in more.items()]]
    messages = [{"id": "m2", "payload": {**both, "headers": heads("2", subject="S2")}}, {"id": "m1", "payload": {**pages, "headers": heads("1", subject="S1")}}, {"payload": {**inner, "headers": heads("3")}}, {"id": "m4"}, {"id": "m5", "payload": {"mimeType": "text/plain", "data": "!"}}]
    rows = [("t", json.dumps({"messages": messages}), 1), ("none", json.dumps({"messages": []}), 1), ("bad", "{", 1), (None, None, 1)]
    got = mail.threads_of_payloads(spark.createDataFrame(rows, "thread_id string, payload string, row int")).collect()
    assert len(got) == 1 and tuple(got[0])[:5] == ("t", "", "", "", "3")
    assert [(m["message_id"], m["sender"], m["date"], m["subject"], m["body"]) for m in got[0]["messages"]] == [
        ("m4", "", "", "", ""), ("m5", "", "", "", ""), ("m1", "ann", "1", "S1", "a  & b\n\nc"), ("m2", "ann", "2", "S2", "one\n\ndeep é?~\n\nthree"), ("", "ann", "3", "", "b"),
    ]
    assert mail.threads_of_payloads(spark.createDataFrame([], "thread_id string, payload string")).count() == 0


def test_threads(spark):
    rows = [
        ("a", [], "Plan", "ann", "1", ""), ("b", ["a"], "Re: Plan", "bob", "2", ""), ("c", ["a", "b", "c"], "Re: Plan", "cy", "3", ""),
        ("d", ["gone"], "Other", "dan", "4", ""), ("e", [], "Lone", "eve", "5", ""), ("f", None, "re: lone ", "fay", "6", ""),
        ("x", ["y"], "Loop", "x", "7", ""), ("y", ["x"], "Loop", "y", "8", ""),
    ]
    m = spark.createDataFrame(rows, mail.MESSAGE)
    assert {r["message_id"]: r["root"] for r in threads.thread_roots(m).collect()} == {"a": "a", "b": "a", "c": "a", "d": "gone", "e": "e", "f": "f", "x": "x", "y": "x"}
    got = {r["thread_id"]: (r["sender"], r["n_messages"], r["last_at"]) for r in threads.summarize_threads(m).collect()}
    assert got == {"a": ("ann", 3, "3"), "gone": ("dan", 1, "4"), "subject:lone": ("eve", 2, "6"), "x": ("x", 2, "8")}
    assert threads.summarize_threads(m.limit(0)).count() == 0


def test_chat_export(spark, tmp_path):
    (tmp_path / "general").mkdir()
    (tmp_path / "users.json").write_text(json.dumps([{"id": "U1", "name": "ann", "profile": {"display_name": "", "real_name": "Ann Lee"}}]))
    (tmp_path / "channels.json").write_text(json.dumps([{"id": "C1", "name": "general"}]))
    (tmp_path / "general" / "2024-01-01.json").write_text(json.dumps([
        {"ts": "1", "user": "U1", "text": "hi <@U1> and <@U9>", "replies": [{"user": "U1", "ts": "2"}]}, {"ts": "2", "bot_id": "B1", "text": "ok", "thread_ts": "1"}, {"ts": "3", "user": "U1", "text": " "},
    ]))
    got = sorted(chat.read_chat_export(spark, f"file://{tmp_path}").collect(), key=lambda r: r["ts"])
    assert [(r["channel_id"], r["user_name"], r["text"], r["thread_ts"], r["reply_count"]) for r in got] == [("C1", "Ann Lee", "hi @Ann Lee and <@U9>", "1", 1), ("C1", "B1", "ok", "1", 0)]


def test_identity(spark):
    messages = spark.createDataFrame([("c", "email", " A@x.co", "g1"), ("c", "whatsapp", "0 12-3", "g1"), ("c", "slack", "zz", "g9")], "collection string, platform string, platform_user_id string, agent_id string")
    ids = spark.createDataFrame([("c", "email", "a@X.co", "e1"), ("c", "whatsapp", "+0123", "e2")], "collection string, platform string, platform_user_id string, employee_id string")
    people = spark.createDataFrame([("c", "e1", "admin")], "collection string, employee_id string, access_role string")
    agents = spark.createDataFrame([("g1", "member")], "agent_id string, role_default string")
    got = {r["platform"]: (r["employee_id"], r["role"], r["is_fallback"]) for r in identity.resolve_senders(messages, ids, people, agents).collect()}
    assert got == {"email": ("e1", "admin", False), "whatsapp": ("e2", "member", True), "slack": (None, None, True)}
    users = spark.createDataFrame([("u1", "a@x.co"), ("u2", "+55")], "user_id string, identity string")
    grants = spark.createDataFrame([("u1", "c", "admin")], "user_id string, collection_name string, role string")
    asked = spark.createDataFrame([(1, "A@X.co", "c", "guest"), (2, "5 5", "c", "guest"), (3, None, "c", "guest")], "request_id long, identity string, collection_name string, role string")
    assert {r["request_id"]: (r["user_id"], r["role"]) for r in identity.resolve_roles(asked, users, grants).collect()} == {1: ("u1", "admin"), 2: ("u2", "guest"), 3: (None, "guest")}
    rows = spark.createDataFrame(
        [("c", "e1", "A", "a@x.co", "admin", 1), ("c", "e1", "B", "a@x.co", "admin", 2), ("c", "e2", "C", "nope", "boss", 3), ("c", "e3", "D", "d@x.co", "guest", 4)],
        "collection string, employee_id string, name string, work_email string, access_role string, row_no int",
    )
    got = {r["row_no"]: (r["outcome"], len(r["errors"])) for r in identity.register_employees(rows, people).collect()}
    assert got == {1: ("replaced", 0), 2: ("updated", 0), 3: ("error", 2), 4: ("added", 0)}
    records = spark.createDataFrame([("document", "d1", ""), ("document", "d2", "restricted"), ("fact", "d1", "internal")], "kind string, source_doc_id string, access_level string")
    assert {r["role"]: (r["documents"], r["facts"]) for r in identity.role_access(records).collect()} == {"guest": (1, 0), "member": (1, 1), "admin": (2, 1)}
    held = spark.createDataFrame([("g1", "slack", "on")], "agent_id string, platform string, status string")
    assert [len(r["deployments"]) for r in identity.agents_with_deployments(agents, held).collect()] == [1]


def test_build(spark):
    docs = spark.createDataFrame([("d1", "x"), ("d2", "boom")], "source_id string, content string")

    def extract(row):
        if row["content"] == "boom":
            raise ValueError("no")
        return {"n": 1}

    assert {r["source_id"]: (r["n"], r["error"]) for r in build.apply_function(docs, extract, "n long", ["source_id"]).collect()} == {"d1": (1, None), "d2": (None, "ValueError: no")}
    tries = []
    assert build.with_retry(lambda: tries.append(1) or (len(tries) > 2 or (_ for _ in ()).throw(OSError())), OSError, pause=0)() and len(tries) == 3
    rows = [("d1", "jira", "2024-01-01", [(" Ann ", "person", None, None), ("", None, None, None)], [("ann", "knows", "Bob"), ("ann", "", "Bob")], [("ANN", "role", "lead", None, "0.9"), ("Ann", "role", None, None, None)]), ("", "jira", "", [], [], [])]
    x = spark.createDataFrame(rows, f"source_id string, source string, timestamp string, {build.EXTRACTION}")
    entities = build.entity_records(x)
    ann = entities.first()
    assert (ann["canonical_name"], ann["entity_type"], ann["aliases"]) == ("Ann", "Person", ["Ann"])
    fact = build.fact_records(x, entities, 7).first()
    assert (fact["subject_id"], fact["value"], fact["valid_from"], fact["confidence"]) == (ann["id"], "lead", 1704067200, 0.9)
    edge = build.edge_records(x, entities).first()
    assert edge["src"] == ann["id"] and edge["dst"].startswith("entity-") and edge["context"] == "ann knows Bob"
    assert tuple(build.build_counts(x).first()) == (1, 1, 1, 1, 1)


def test_answering(spark):
    mentions = spark.createDataFrame([(1, "Ann Lee"), (1, "Ann Leigh"), (2, "zzzzzz"), (2, None)], "question_id long, mention string")
    entities = spark.createDataFrame([("e1", ["ann lee", "AL"]), ("e2", ["Bob"])], "id string, aliases array<string>")
    got = {(r["question_id"], r["mention"]): (r["entity_id"], round(r["score"], 3)) for r in answering.link_mentions(mentions, entities).collect()}
    assert got[1, "Ann Lee"] == ("e1", 1.0) and got[1, "Ann Leigh"][0] == "e1" and got[2, "zzzzzz"] == (None, 0.0) == got[2, None]
    links = spark.createDataFrame([(1, "e1", 1.0, False), (2, None, 0.0, False)], "question_id long, entity_id string, score double, fallback boolean")
    facts = spark.createDataFrame([(1, f"d{i}", "current" if i else "disputed") for i in range(10)], "question_id long, source_doc_id string, state string")
    edges = spark.createDataFrame([], "question_id long, source_doc_id string")
    got = {r["question_id"]: (round(r["confidence"], 6), r["abstained"]) for r in answering.decide_answers(links, facts, edges).collect()}
    assert got == {1: (0.65, False), 2: (0.0, True)}
    visited = spark.createDataFrame([(1, "s")], "question_id long, node string")
    held = spark.createDataFrame([("s", "current", None), ("s", "superseded", None), ("s", "current", "restricted")], "subject_id string, state string, access_level string")
    assert answering.facts_in_scope(visited, held, "member").count() == 1
    assert answering.facts_in_scope(visited, held, "admin", historical=True).count() == 3


def test_calibration(spark):
    judged = spark.createDataFrame([(i / 20, int(i > 9)) for i in range(20)] + [(None, 1)], "confidence double, label int")
    fit = answering.calibrate(judged)
    assert fit["coefficient"] > 0 and fit["accuracy"] == 0.5 and 0.4 < fit["threshold"] < 0.9
    assert answering.calibrate(judged.where(F.lit(False)))["threshold"] == 1.0
    assert answering.calibrate(judged.where("label = 1"))["threshold"] == 0.0
    assert answering.threshold_for_target(-1.0, 5.0) == 0.0 and answering.threshold_for_target(0.0, 1.0) == 1.0
    assert answering.threshold_for_target(2.0, 0.0, 0.5) == pytest.approx(0.0)


def test_links_against_all_pairs(spark):
    names = [f"{a} {b}" for a in ("ann", "anna", "bob", "rob", "li") for b in ("lee", "leigh", "smith", "smyth")]
    mentions = ["Ann Le", "bobb smith", "ROB SMYTHE", "x", "ilee", "leigh anna", "smith"]
    m = spark.createDataFrame([(i, x) for i, x in enumerate(mentions)], "question_id long, mention string")
    e = spark.createDataFrame([(i, [x]) for i, x in enumerate(names)], "id long, aliases array<string>")
    want = {}
    for i, x in enumerate(mentions):
        score, k = max((v, -k) for k, v in enumerate(jaro_winkler_batch([x] * len(names), names)))
        want[i] = (-k, round(score, 9)) if score >= 0.75 else (None, 0.0)
    assert {r["question_id"]: (r["entity_id"], round(r["score"], 9)) for r in answering.link_mentions(m, e).collect()} == want


@pytest.mark.parametrize("name", list(people.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("orders", "customer", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = people.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.sql(people.ORACLE_SQL[name]).select(", ".join(cols)).fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want)) and want


def test_pairs_come_once_without_a_shuffle(spark):
    """Pairs of several shared blocks, of pieces of a large block and of repeated ids come once, and are not made distinct afterwards."""
    from kgspark.operators import resolution

    rows = [(i % 2300, f"n{i % 3} x", f"d{i % 2300 // 5}", "s", [f"h{i % 2300 // 4}.co"], []) for i in range(2310)]
    people = spark.createDataFrame(rows, "id long, name string, source_doc_id string, doc_source_type string, domains array<string>, identifiers array<string>")
    blocks = {}
    for i, name, doc, _, (host,), _ in rows:
        for block in ("n:" + name, "d:" + doc, "h:" + host):
            blocks.setdefault(block, set()).add(i)
    want = {(a, b) for ids in blocks.values() for a in ids for b in ids if a < b}
    pairs = resolution.candidate_pairs(people, max_block=10, across=True)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Distinct" not in plan
    assert pairs.count() == len(want) and pairs.where("a < b").distinct().count() == len(want)
