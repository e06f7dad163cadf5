"""Queries of threads, identities and the graph build over the test tables, and their SQL.

conversations stand for mail, orders for inbound messages and extracted documents, customer for employees.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import build, identity, threads
from kgspark.shared import table
from kgspark.sources import mail

_NOW = 0


def _messages(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn").distinct()
    before = F.when(F.col("turn") > 0, F.array(F.concat_ws("-", "conv_id", (F.col("turn") - 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), before.alias("refs"))


def _employees(spark, sf):
    """Customers; every tenth has no valid address."""
    key = F.col("c_custkey")
    address = F.when(key % 10 == 0, "none").otherwise(F.concat(F.lit("u"), key.cast("string"), F.lit("@x.co")))
    return table(spark, sf, "customer").select(
        F.lit("c").alias("collection"), key.cast("string").alias("employee_id"), F.col("c_name").alias("name"), address.alias("work_email"),
        F.lit("member").alias("access_role"), key.alias("row_no"), "c_mktsegment",
    )


def _extracted(spark, sf):
    """An order as a document that states the status of its customer."""
    who = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))
    none = F.lit(None).cast("string")
    entity = F.struct(who.alias("name"), F.lit("person").alias("type"), F.lit(None).cast("array<string>").alias("aliases_hint"), none.alias("confidence"))
    relation = F.struct(who.alias("source_entity"), F.lit("placed").alias("predicate"), F.col("o_orderkey").cast("string").alias("target_entity"))
    fact = F.struct(F.upper(who).alias("subject_entity"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("value"), none.alias("stated_at"), none.alias("confidence"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("source_id"), F.lit("orders").alias("source"), F.unix_timestamp("o_orderdate").cast("string").alias("timestamp"),
        F.array(entity).alias("candidate_entities"), F.array(relation).alias("candidate_relations"), F.array(fact).alias("candidate_facts"),
    )


def j03_thread_roots(spark, sf):
    return threads.thread_roots(_messages(spark, sf))


def j18_resolve_senders(spark, sf):
    o, people = table(spark, sf, "orders"), _employees(spark, sf)
    messages = o.select("o_orderkey", F.lit("c").alias("collection"), F.lit("slack").alias("platform"), F.col("o_custkey").cast("string").alias("platform_user_id"), F.col("o_orderpriority").alias("agent_id"))
    links = people.where("row_no % 3 <> 0").select("collection", F.lit("slack").alias("platform"), F.col("employee_id").alias("platform_user_id"), "employee_id")
    roles = people.where("row_no % 2 = 0").select("collection", "employee_id", F.lower("c_mktsegment").alias("access_role"))
    agents = o.select(F.col("o_orderpriority").alias("agent_id"), F.lit("guest").alias("role_default")).distinct()
    return identity.resolve_senders(messages, links, roles, agents).select("o_orderkey", "employee_id", "role", "is_fallback")


def a28_register(spark, sf):
    people = _employees(spark, sf)
    return identity.register_employees(people, people.where("row_no % 4 = 0")).select("employee_id", "outcome")


def a04_facts(spark, sf):
    x = _extracted(spark, sf)
    return build.fact_records(x, build.entity_records(x), _NOW).select("id", "subject_id", "predicate", "value", "source_doc_id", "valid_from")


def a05_edges(spark, sf):
    x = _extracted(spark, sf)
    return build.edge_records(x, build.entity_records(x))


def a29_build_counts(spark, sf):
    return build.build_counts(_extracted(spark, sf))


def io10_nested_threads(spark, sf):
    """Conversations as landed mail threads whose texts stand four parts deep, beside HTML that doesn't count."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def leaf(kind, text):
        return F.struct(F.lit(kind).alias("mimeType"), F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_").alias("data"))

    def nested(kind, *every):
        """The JSON of a part that holds others, given as JSON."""
        return F.concat(F.lit(f'{{"mimeType":"{kind}","parts":['), F.concat_ws(",", *every), F.lit("]}"))

    plain, page = F.to_json(leaf("text/plain", F.col("text"))), F.to_json(leaf("text/html", F.lit("<p>no</p>")))
    deep = nested("multipart/mixed", nested("multipart/alternative", page, nested("multipart/related", nested("multipart/x", plain))), F.to_json(leaf("text/plain", F.col("role"))))
    headers = F.to_json(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("From", F.col("role")), ("DATE", F.lpad(F.col("turn").cast("string"), 6, "0")))]))
    payload = F.concat(F.lit('{"headers":'), headers, F.lit(","), F.substr(deep, F.lit(2)))
    message = F.concat(F.lit('{"id":"'), F.col("turn").cast("string"), F.lit('","payload":'), payload, F.lit("}"))
    held = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", message.alias("message")))).alias("all"))
    landed = held.select(F.col("conv_id").cast("string").alias("thread_id"), F.concat(F.lit('{"messages":['), F.array_join("all.message", ","), F.lit("]}")).alias("payload"))
    found = mail.threads_of_payloads(landed)
    bodies = F.transform("messages", lambda m: m["body"])
    return found.select("thread_id", "sender", "first_email_at", "last_email_at", F.size("messages").cast("long").alias("n_messages"), F.sha2(F.array_join(bodies, "|"), 256).alias("bodies"))


QUERIES = {f.__name__: f for f in (io10_nested_threads, j03_thread_roots, j18_resolve_senders, a28_register, a04_facts, a05_edges, a29_build_counts)}

ORACLE_SQL = {
    "io10_nested_threads": """WITH c AS (SELECT conv_id, lpad(CAST(turn AS VARCHAR), 6, '0') AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
        b AS (SELECT *, text || CASE WHEN text <> '' AND role <> '' THEN chr(10) || chr(10) ELSE '' END || role AS body FROM c)
        SELECT CAST(conv_id AS VARCHAR) AS thread_id, first(role ORDER BY place, role, text) AS sender, min(place) AS first_email_at, max(place) AS last_email_at, count(*) AS n_messages,
            sha256(string_agg(body, '|' ORDER BY place, role, text)) AS bodies FROM b GROUP BY conv_id""",
    "j03_thread_roots": """WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations),
        g AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
        SELECT conv_id || '-' || turn AS message_id, conv_id || '-' || greatest(min(turn) OVER (PARTITION BY conv_id, run) - 1, 0) AS root FROM g""",
    "j18_resolve_senders": """SELECT o_orderkey, CASE WHEN l.c_custkey IS NOT NULL THEN CAST(l.c_custkey AS VARCHAR) END AS employee_id,
        CASE WHEN l.c_custkey % 2 = 0 THEN lower(l.c_mktsegment) ELSE 'guest' END AS role, coalesce(l.c_custkey % 2 <> 0, true) AS is_fallback
        FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) l ON l.c_custkey = o_custkey""",
    "a28_register": """SELECT CAST(c_custkey AS VARCHAR) AS employee_id,
        CASE WHEN c_custkey % 10 = 0 THEN 'error' WHEN c_custkey % 4 = 0 THEN 'updated' ELSE 'added' END AS outcome FROM customer""",
    "a04_facts": """SELECT 'fact-' || left(sha1(o_orderkey || '|CUSTOMER ' || o_custkey || '|' || o_orderpriority || '|' || o_orderstatus), 24) AS id,
        'entity-' || left(sha1(o_orderkey || '|Customer ' || o_custkey), 24) AS subject_id, o_orderpriority AS predicate, o_orderstatus AS value,
        CAST(o_orderkey AS VARCHAR) AS source_doc_id, CAST(epoch(o_orderdate) AS BIGINT) AS valid_from FROM orders""",
    "a05_edges": """SELECT 'entity-' || left(sha1(o_orderkey || '|Customer ' || o_custkey), 24) AS src, 'placed' AS predicate,
        'entity-' || left(sha1(o_orderkey || '|' || o_orderkey), 24) AS dst, 'Customer ' || o_custkey || ' placed ' || o_orderkey AS context,
        CAST(o_orderkey AS VARCHAR) AS source_doc_id FROM orders""",
    "a29_build_counts": """SELECT count(*) AS documents, CAST(0 AS BIGINT) AS skipped, count(*) AS entities, count(*) AS facts, count(*) AS relations FROM orders""",
}
