"""Queries of documents, resolution, evaluation and dashboards over the test tables, and their SQL.

conversations stand for chat, orders for issues, customer for code-host records and people, lineitem for mail.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kgspark.functions import scalars as S
from kgspark.operators import build, conflicts, dashboard, evaluation, graph, identity, near_duplicates, packets, resolution, retrieval, threads, vector_index
from kgspark.plans.catalog import DECIDED_SQL, facts
from kgspark.plans.catalog import ORACLE_SQL as CATALOG_SQL
from kgspark.shared import cut, shared_dir, table
from kgspark.sources import normalize
from kgspark.streaming.feeds import activity_counts, newest_by_key, newest_of, read_upserts, upsert_stream


def s05_chat_documents(spark, sf):
    c = table(spark, sf, "conversations")
    raw = c.select(F.concat_ws("-", "conv_id", "turn").alias("ts"), F.col("conv_id").cast("string").alias("channel"), F.col("role").alias("user"), "text", F.col("turn"))
    return normalize.normalize(raw, "slack")


def s06_issue_documents(spark, sf):
    o = table(spark, sf, "orders")
    raw = o.select(
        F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("summary"), F.col("o_orderstatus").alias("description"), F.col("o_custkey").alias("reporter"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), F.lit("P").alias("project"),
    )
    return normalize.normalize(raw.withColumn("content_field_names", F.when(F.col("key") % 2 == 0, F.array(F.lit("description"), F.lit("project")))), "jira")


def s07_code_documents(spark, sf):
    c = table(spark, sf, "customer")
    raw = c.select(F.lit("a/b").alias("repo"), F.col("c_custkey").alias("number"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("body"))
    return normalize.normalize(raw, "github")


def s08_mail_documents(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("messages"))
    return normalize.normalize(c.select(F.col("conv_id").cast("string").alias("thread_id"), F.lit("S").alias("subject"), "messages"), "gmail")


def s20_entity_types(spark, sf):
    kinds = ["ORG", "ticket", "repo", "person", "custom kind", ""]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", S.entity_type(kind).alias("entity_type"))


def _extracted(spark, sf):
    """A part as a document with two candidates of one name in different case."""
    none = F.lit(None).cast("string")
    entity = lambda n, t: F.struct(n.alias("name"), F.lit(t).alias("type"), F.lit(None).cast("array<string>").alias("aliases_hint"), none.alias("confidence"))
    name = F.col("p_brand")
    fact = F.struct(F.lower(name).alias("subject_entity"), F.lit("size").alias("predicate"), F.col("p_size").cast("string").alias("value"), none.alias("stated_at"), none.alias("confidence"))
    relation = F.struct(none.alias("source_entity"), none.alias("predicate"), none.alias("target_entity"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("source_id"), F.lit("parts").alias("source"), F.lit("0").alias("timestamp"),
        F.array(entity(name, "ORG"), entity(F.upper(name), "ticket")).alias("candidate_entities"), F.array(relation).alias("candidate_relations"), F.array(fact).alias("candidate_facts"),
    )


def a04_entities(spark, sf):
    return build.entity_records(_extracted(spark, sf)).select("id", "canonical_name", "entity_type", "source_doc_id", "confidence")


def j04_fact_subjects(spark, sf):
    x = _extracted(spark, sf)
    return build.fact_records(x, build.entity_records(x), 0).select("id", "subject_id")


def s40_candidates(spark, sf):
    return build.filter_candidates(_extracted(spark, sf)).select("source_id", F.size("candidate_entities").alias("n"), F.element_at("candidate_entities", 1)["type"].alias("first_type"))


def _people(spark, sf):
    """Customers as entities: a tenth share a mail domain each, names are few."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    name = F.concat(F.lit("n"), (key % 50).cast("string"), F.lit(" x"), key.cast("string"))
    return c.select(
        key.alias("id"), name.alias("name"), F.array(name).alias("aliases"), F.when(key % 5 == 0, F.concat(F.lit("d"), F.expr("c_custkey div 40").cast("string"))).alias("source_doc_id"),
        F.col("c_mktsegment").alias("doc_source_type"), F.array(F.concat(F.lit("h"), F.expr("c_custkey div 7").cast("string"), F.lit(".co"))).alias("domains"), F.array().cast("array<string>").alias("identifiers"),
    )


def j05_mail_blocks(spark, sf):
    return resolution.candidate_pairs(_people(spark, sf))


def j05_whole_blocks(spark, sf):
    """Pairs of oversize blocks across their chunks too."""
    return resolution.candidate_pairs(_people(spark, sf), max_block=10, across=True)


def j06_evidence(spark, sf):
    pairs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    seen = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("subject_id"), F.col("l_returnflag").alias("predicate"), (F.col("l_partkey") % 20).alias("source_doc_id"))
    return resolution.evidence_overlap(pairs, seen).select("a", "b", F.round("overlap", 9).alias("overlap"))


def j09_repoint(spark, sf):
    merges = table(spark, sf, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") - 1).cast("string").alias("merged_into"))
    return resolution.repoint_facts(facts(spark, sf), merges).select("id", "subject_id")


def a19_histogram(spark, sf):
    scored = table(spark, sf, "lineitem").select((F.col("l_discount") * 10).cast("double").alias("combined"))
    return resolution.score_histogram(scored)


def a08_corroboration(spark, sf):
    f = facts(spark, sf).withColumn("source_doc_id", F.col("id") % 7)
    return conflicts.with_corroboration(f).select("id", "corroboration_count")


def a11_reliability(spark, sf):
    """Truth discovery over facts whose source type is constant within a group, so that one round is its end."""
    f = facts(spark, sf).withColumn("doc_source_type", F.element_at(F.array(*[F.lit(k) for k in ("a", "b", "c")]), (F.col("subject_id").cast("long") % 3 + 1).cast("int")))
    rows = [(k, v) for k, v in sorted(conflicts.discover_truth(f)[-1].items())]
    return spark.createDataFrame(rows, "doc_source_type string, reliability double")


def a27_learned_weights(spark, sf):
    f = conflicts.with_learned_authority(facts(spark, sf), {"github": 0.9, "jira": 0.25})
    return f.select("id", "authority_weight")


def p05_learned_cascade(spark, sf):
    f = conflicts.resolve_conflicts(facts(spark, sf), reliability={"github": 0.8, "jira": 0.8, "gmail": 0.8, "fireflies": 0.8})
    return f.groupBy("state").agg(F.count("*").alias("n"))


def p05_disabled(spark, sf):
    return conflicts.resolve_conflicts(facts(spark, sf), disabled=True).select("id", "state", "superseded_by")


def w08_value_buckets(spark, sf):
    """Clerks' names with one letter more or less are one value: all names of a priority that start alike."""
    o = table(spark, sf, "orders")
    value = F.concat(F.lit("the quick brown fox number "), F.expr("o_orderkey % 3").cast("string"), F.repeat(F.lit("abcdefgh"), F.expr("cast(o_orderkey % 2 as int) * 4")))
    f = o.select(F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_orderpriority").alias("predicate"), value.alias("value"), F.col("o_orderkey").alias("valid_from"), F.col("o_orderkey").alias("id"))
    return conflicts.value_buckets(f).groupBy("subject_id", "predicate").agg(F.count_distinct("bucket").alias("n_buckets"), F.count("*").alias("n_values"))


def st02_redecide(spark, sf):
    f = facts(spark, sf)
    batch = f.where(F.col("valid_from") >= F.unix_timestamp(F.lit("1997-01-01 00:00:00")))
    return conflicts.redecide(f, batch).select("id", "state")


def w01_canonical(spark, sf):
    """Documents of one source and language as one cluster: the one with the most fields, then the longest text stays."""
    d = table(spark, sf, "documents")
    clusters = d.select(F.col("doc_id").alias("id"), F.concat_ws("-", "source", "lang").alias("cluster"))
    return near_duplicates.mark_duplicates(d, clusters).where("is_canonical").select("id", "cluster")


def a03_summaries(spark, sf):
    c = table(spark, sf, "conversations")
    one = c.groupBy("conv_id", "turn").agg(F.min("role").alias("sender"))
    name = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), F.lpad(t.cast("string"), 6, "0"))
    refs = F.when(F.col("turn") > 0, F.array(name(F.lit(0)))).otherwise(F.array().cast("array<string>"))
    mail = one.select(name(F.col("turn")).alias("message_id"), refs.alias("refs"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("subject"), F.col("turn").cast("string").alias("date"), "sender")
    return threads.summarize_threads(mail).select("thread_id", "subject", "n_messages")


def _questions(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("question_id"), F.array((F.col("item_id") % 300).cast("string"), F.lit("none")).alias("ground_truth_doc_ids"), F.col("item_id").alias("position"), F.col("text").alias("question"), F.when(F.col("item_id") % 4 != 0, "g").alias("gold_answer"))


def a18_coverage(spark, sf):
    return evaluation.coverage(_questions(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_id")))


def j13_answerable(spark, sf):
    return evaluation.answerable(_questions(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_id"))).select("question_id")


def _results(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    word = F.when(F.col("quality") == 0, "no").when(F.col("toxic") == 1, "Partial ").otherwise("yes")
    config = F.element_at(F.array(*[F.lit(c) for c in evaluation.CONFIGURATIONS]), (F.col("doc_id") % 3 + 1).cast("int"))
    return evaluation.judged(rows.select(F.col("lang").alias("category"), word.alias("score"), config.alias("config"), (F.col("toxic") == 1).alias("abstained")))


def a16_comparison(spark, sf):
    return evaluation.comparison(_results(spark, sf), "partial")


def a17_abstention(spark, sf):
    return evaluation.abstention_rate(_results(spark, sf))


def p09_system_report(spark, sf):
    return evaluation.system_report(_results(spark, sf))


def a25_calibration_sample(spark, sf):
    q = _questions(spark, sf)
    answers = q.select("question_id", (F.col("question_id") % 100 / 100).alias("confidence"), F.when(F.col("question_id") % 3 == 0, "yes").otherwise("no").alias("score"))
    return evaluation.calibration_sample(q, answers)


def _records(spark, sf):
    """Orders as stored records of four kinds."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Entity", "FactState", "CandidateMerge", "document")]), (key % 4 + 1).cast("int"))
    state = F.when(key % 3 == 0, "pending").when(key % 3 == 1, "disputed").otherwise("current")
    source = F.when(key % 4 == 3, F.lit("")).otherwise(F.concat_ws("|", (F.col("o_custkey") % 100).cast("string"), F.lit("z")))
    pairs = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v)])
    return o.select(
        key.cast("string").alias("id"), pairs(kind=F.lit("none"), created_at=F.unix_timestamp("o_orderdate").cast("string")).alias("fields"),
        pairs(record_type=kind, state=state, title=F.col("o_orderpriority")).alias("metadata"), pairs(source_doc_id=source, doc_source_type=F.col("o_orderstatus")).alias("additional"),
    )


def a12_collection(spark, sf):
    return dashboard.dashboard(_records(spark, sf))


def a12_source_types(spark, sf):
    r = _records(spark, sf)
    return dashboard.source_types(r.withColumn("id", F.lpad("id", 12, "0")))


def a14_status(spark, sf):
    return dashboard.status(_records(spark, sf))


def w13_browse(spark, sf):
    return dashboard.browse(_records(spark, sf), "urgent", "entity").select("id", "title", "record_type", "source_type", "created_at")


def u02_activity(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("agent_id"), F.col("c_name").alias("agent_name"), F.lit("slack").alias("platform"), F.lit("on").alias("status"), F.lit("0").alias("deployed_at"))
    return dashboard.activity(_records(spark, sf), c).select("id", "kind", "created_at")


def a31_overview(spark, sf):
    return dashboard.overview(_records(spark, sf), table(spark, sf, "customer"), table(spark, sf, "supplier")).drop("latest")


def a30_suggestions(spark, sf):
    r = _records(spark, sf)
    return dashboard.suggestions(r, table(spark, sf, "customer"), table(spark, sf, "supplier")).select("id", "source")


def io19_search(spark, sf):
    """The five vectors of the same label that are nearest by cosine to each twentieth vector."""
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("question_id"), "vector", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("filters"))
    return retrieval.search_vectors(asked, docs, ["label"]).select("question_id", "doc_id", "score", "rank")


def _stated(spark, sf):
    """What lines say of a supplier's quantities: many claims with several source types and many sources."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("subject_id"), F.col("l_returnflag").alias("predicate"), F.col("l_quantity").cast("int").cast("string").alias("value"),
        (F.col("l_partkey") % 500).cast("string").alias("source_doc_id"), F.concat(F.lit("m"), F.col("l_partkey") % 7).alias("doc_source_type"),
    )


def a11_shared_claims(spark, sf):
    """Reliability of source types whose claims other types share, by round."""
    history = conflicts.discover_truth(_stated(spark, sf), rounds=3, delta=0.0)
    rows = [(i, k, v) for i, held in enumerate(history) for k, v in held.items()]
    return spark.createDataFrame(rows, "round int, source string, reliability double").withColumn("reliability", F.round("reliability", 9))


def a11_source_rounds(spark, sf):
    """The same of single sources, as a fixpoint of claims and sources."""
    found = conflicts.truth_rounds(conflicts.claims_of(_stated(spark, sf)), rounds=3, delta=0.0)
    return found.withColumn("reliability", F.round("reliability", 9))


def _vectors(spark, sf):
    """The vectors, an index of them, and every twentieth as a question without filters."""
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    index = vector_index.build_vectors(docs, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
    return index, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("question_id"), "vector")


def io19_index_exact(spark, sf):
    """The five vectors of all that are nearest by cosine to each twentieth vector, through cells with the exact bound."""
    return vector_index.search_cells(*_vectors(spark, sf))


def io19_index_probed(spark, sf):
    """The same through so many cells as hold 0.95 of the five nearest of other vectors, a sample of about 200."""
    index, asked = _vectors(spark, sf)
    others = table(spark, sf, "embeddings").where("vec_id % 20 <> 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    share = min(1.0, 200 / max(others.count(), 1))
    sample = others.where(F.pmod(F.xxhash64("question_id"), F.lit(1 << 32)) < share * (1 << 32)).limit(400)
    return vector_index.search_cells(index, asked, probes=vector_index.probes_for(index, sample), exact=False)


def p07_context(spark, sf):
    """Retrieved documents as context blocks."""
    d = table(spark, sf, "documents")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    found = cut(retrieval.retrieve(q, d, 2), "found")
    blocks = retrieval.context_blocks(found, d.select("doc_id", "source", F.col("text").alias("content")))
    return blocks.select("question_id", "rank", F.substring_index("block", "\n", 1).alias("heading"), F.length("block").alias("size"))


def j14_fallback(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("question"))
    found = q.select("question_id", F.col("question_id").alias("doc_id"))
    e = q.select(F.col("question_id").alias("id"), F.array("question").alias("aliases"), F.col("question_id").cast("string").alias("source_doc_id"))
    return packets.fallback_links(q, found, e)


def _directory(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.lit("c").alias("collection"), key.cast("string").alias("employee_id"), F.col("c_name").alias("name"), F.concat(F.lit("u"), key.cast("string"), F.lit("@x.co")).alias("work_email"),
        F.when(key % 7 == 0, F.lit("gone")).otherwise(F.nullif(F.expr("c_custkey div 10"), F.lit(0)).cast("string")).alias("manager_employee_id"),
    )


def p10_org_edges(spark, sf):
    return graph.org_graph(_directory(spark, sf))[1].select("src", "dst", "context", "known")


def p10_org_summary(spark, sf):
    return graph.org_summary(*graph.org_graph(_directory(spark, sf)))


def s18_unique_names(spark, sf):
    """Segments and brands as organisations; two names are in use."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.initcap("c_mktsegment"), F.lit(" Öl & Co")).alias("org_name"))
    used = table(spark, sf, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit("-ol-co-3")).alias("name")).distinct()
    return identity.unique_names(c, used).select("id", "collection_name")


def st03_feed(spark, sf):
    return activity_counts(table(spark, sf, "events"), "1 hour").groupBy("event_type").agg(F.count("*").alias("windows"), F.sum("n").alias("events"))


def st03_newest(spark, sf):
    """The newest forty events of each type, kept by a stream over files that events are cut into; late ones come in any of them."""
    files = cut(table(spark, sf, "events").select("event_id", "event_type", "ts").repartition(3, "event_id"), "events")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(files._written_to)
    folder = f"{shared_dir(spark)}/newest-{uuid.uuid4().hex}"
    upsert_stream(newest_by_key(stream), f"{folder}/slots", f"{folder}/state", "slot", available_now=True, mode="update").awaitTermination()
    return newest_of(read_upserts(spark, f"{folder}/slots", "slot")).select(F.col("key").alias("event_type"), F.col("id").alias("event_id"), "rank")


QUERIES = {f.__name__: f for f in (
    s05_chat_documents, s06_issue_documents, s07_code_documents, s08_mail_documents, s20_entity_types, a04_entities,
    j04_fact_subjects, s40_candidates, j05_mail_blocks, j05_whole_blocks, j06_evidence, j09_repoint, a19_histogram, a08_corroboration, a11_reliability, a11_shared_claims, a11_source_rounds,
    a27_learned_weights, p05_learned_cascade, p05_disabled, w08_value_buckets, st02_redecide, w01_canonical, a03_summaries,
    a18_coverage, j13_answerable, a16_comparison, a17_abstention, p09_system_report, a25_calibration_sample, a12_collection,
    a12_source_types, a14_status, w13_browse, u02_activity, a31_overview, a30_suggestions, io19_search, io19_index_exact, io19_index_probed, p07_context, j14_fallback, p10_org_edges, p10_org_summary, s18_unique_names, st03_feed, st03_newest,
)}

_FACTS = """f AS (
    SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS subject_id, o_orderpriority AS predicate, o_orderstatus AS value,
        CAST(epoch(o_orderdate) AS BIGINT) AS valid_from, ['github', 'jira', 'gmail', 'fireflies'][o_orderkey % 4 + 1] AS kind FROM orders)"""
_RECORDS = """r AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, ['entity', 'factstate', 'candidatemerge', 'document'][o_orderkey % 4 + 1] AS kind,
        ['pending', 'disputed', 'current'][o_orderkey % 3 + 1] AS state, o_orderpriority AS title, o_orderstatus AS source_type,
        CASE WHEN o_orderkey % 4 <> 3 THEN (o_custkey % 100) || '|z' END AS source_doc_id, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders)"""
_RESULTS = """l AS (
    SELECT lang AS category, CASE WHEN quality = 0 THEN 0.0 WHEN toxic = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS v, doc_id, toxic = 1 AS abstained
    FROM labels JOIN documents USING (doc_id))"""
_PARTS = "p AS (SELECT CAST(p_partkey AS VARCHAR) AS d, p_brand AS name, CAST(p_size AS VARCHAR) AS size FROM part)"
_PEOPLE = """keys AS (
    SELECT c_custkey AS id, 'n' || c_custkey % 50 AS token, lower(c_mktsegment) AS kind,
        unnest(list_filter(['name:n' || c_custkey % 50, 'email_domain:h' || c_custkey // 7 || '.co', CASE WHEN c_custkey % 5 = 0 THEN 'source_doc_id:d' || c_custkey // 40 END],
            lambda x: x IS NOT NULL)) AS block FROM customer),
sized AS (SELECT *, count(*) OVER (PARTITION BY block) AS n FROM keys)"""

def _rounds_sql(source: str) -> str:
    """Three rounds of truth discovery over lines, by this source."""
    parts = [f"""c AS (SELECT l_suppkey AS s, l_returnflag AS p, CAST(l_quantity AS INT) AS v, {source} AS source, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4),
        r0 AS (SELECT DISTINCT source, 0.5::DOUBLE AS r FROM c)"""]
    for i in range(3):
        parts.append(f"d{i} AS (SELECT s, p, v, least(greatest(1 - product(1 - r), 0), 1) AS sure FROM c JOIN r{i} USING (source) GROUP BY 1, 2, 3)")
        parts.append(f"r{i + 1} AS (SELECT source, sum(n * sure) / sum(n) AS r FROM c JOIN d{i} USING (s, p, v) GROUP BY 1)")
    every = " UNION ALL ".join(f"SELECT {i} AS round, source, round(r, 9) AS reliability FROM r{i}" for i in range(4))
    return f"WITH {', '.join(parts)} {every}"


ORACLE_SQL = {
    "a11_shared_claims": _rounds_sql("'m' || (l_partkey % 7)"), "a11_source_rounds": _rounds_sql("CAST(l_partkey % 500 AS VARCHAR)"),
    "s05_chat_documents": """SELECT 'slack' AS source, conv_id || '-' || turn AS source_id, coalesce(role, '') AS author, conv_id || '-' || turn AS timestamp,
        coalesce(text, '') AS content, CAST(conv_id AS VARCHAR) AS container_id, '{"turn":' || turn || '}' AS metadata FROM conversations""",
    "s06_issue_documents": """SELECT 'jira' AS source, CAST(o_orderkey AS VARCHAR) AS source_id, CAST(o_custkey AS VARCHAR) AS author, strftime(o_orderdate, '%Y-%m-%d') AS timestamp,
        o_orderpriority || chr(10) || chr(10) || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || 'P' ELSE '' END AS content, 'P' AS container_id,
        CASE WHEN o_orderkey % 2 = 0 THEN '{"content_field_names":["description","project"]}' ELSE '{}' END AS metadata FROM orders""",
    "s07_code_documents": """SELECT 'github' AS source, 'a/b#' || c_custkey AS source_id, '' AS author, '' AS timestamp,
        c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE chr(10) || chr(10) || c_mktsegment END AS content, 'a/b' AS container_id, '{}' AS metadata FROM customer""",
    "s08_mail_documents": r"""SELECT 'gmail' AS source, CAST(conv_id AS VARCHAR) AS source_id, '' AS author, '' AS timestamp, CAST(conv_id AS VARCHAR) AS container_id, '{}' AS metadata,
        regexp_replace('S' || chr(10) || chr(10) || coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn, text) FILTER (WHERE text <> ''), ''), '^\s+|\s+$', '', 'g') AS content
        FROM conversations GROUP BY conv_id""",
    "s20_entity_types": "SELECT p_partkey, ['Organization', 'Issue', 'Repository', 'Person', 'Custom Kind', 'Entity'][p_partkey % 6 + 1] AS entity_type FROM part",
    "a04_entities": f"""WITH {_PARTS}, c AS (
            SELECT d, name, 'Organization' AS kind, 0 AS i FROM p UNION ALL SELECT d, upper(name), 'Issue', 1 FROM p),
        u AS (SELECT *, row_number() OVER (PARTITION BY d, name ORDER BY i DESC) AS k FROM c)
        SELECT 'entity-' || left(sha1(d || '|' || name), 24) AS id, name AS canonical_name, kind AS entity_type, d AS source_doc_id, 0.5::DOUBLE AS confidence FROM u WHERE k = 1""",
    "j04_fact_subjects": f"""WITH {_PARTS} SELECT 'fact-' || left(sha1(d || '|' || lower(name) || '|size|' || size), 24) AS id,
        'entity-' || left(sha1(d || '|' || upper(name)), 24) AS subject_id FROM p""",
    "s40_candidates": "SELECT CAST(p_partkey AS VARCHAR) AS source_id, CAST(2 AS INTEGER) AS n, 'Organization' AS first_type FROM part",
    "j05_mail_blocks": f"""WITH {_PEOPLE}, k AS (
            SELECT id, block FROM sized WHERE n <= 100 UNION ALL
            SELECT id, block || '|' || token || '|' || kind || '#' || (row_number() OVER (PARTITION BY block, token, kind ORDER BY id) - 1) // 100 FROM sized WHERE n > 100)
        SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.block = y.block AND x.id < y.id""",
    "j05_whole_blocks": f"""WITH {_PEOPLE}, k AS (SELECT id, CASE WHEN n <= 10 THEN block ELSE block || '|' || token || '|' || kind END AS block FROM sized)
        SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.block = y.block AND x.id < y.id""",
    "j06_evidence": """WITH s AS (SELECT DISTINCT l_suppkey AS s, l_returnflag AS p, l_partkey % 20 AS d FROM lineitem), n AS (SELECT s, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT x.s AS a, y.s AS b, count(*) AS common FROM s x JOIN s y ON y.s = x.s + 1 AND x.p = y.p AND x.d = y.d WHERE x.s IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2)
        SELECT a, b, round(common / (m.n + o.n - common)::DOUBLE, 9) AS overlap FROM c JOIN n m ON m.s = a JOIN n o ON o.s = b""",
    "j09_repoint": """SELECT o_orderkey AS id, CAST(CASE WHEN o_custkey % 10 = 3 AND o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey - 1 ELSE o_custkey END AS VARCHAR) AS subject_id FROM orders""",
    "a19_histogram": """WITH b AS (SELECT * FROM (VALUES ('0-0.2', 0.0, 0.2), ('0.2-0.4', 0.2, 0.4), ('0.4-0.6', 0.4, 0.6), ('0.6-0.85', 0.6, 0.85), ('0.85-1', 0.85, 1.0)) AS t(bin, low, high))
        SELECT bin, (SELECT count(*) FROM lineitem WHERE l_discount * 10 >= low::DOUBLE AND (l_discount * 10 < high::DOUBLE OR high = 1 AND l_discount * 10 <= 1)) AS n FROM b""",
    "a08_corroboration": f"""WITH {_FACTS}, c AS (SELECT subject_id, predicate, value, count(DISTINCT id % 7) AS n FROM f GROUP BY 1, 2, 3)
        SELECT f.id, c.n AS corroboration_count FROM f JOIN c USING (subject_id, predicate, value)""",
    "a11_reliability": "SELECT unnest(['a', 'b', 'c']) AS doc_source_type, 0.5::DOUBLE AS reliability",
    "a27_learned_weights": f"WITH {_FACTS} SELECT id, CASE kind WHEN 'github' THEN 0.9 WHEN 'jira' THEN 0.25 ELSE 0.5 END::DOUBLE AS authority_weight FROM f",
    "p05_learned_cascade": f"""WITH {_FACTS},
        b AS (SELECT subject_id, predicate, value, count(*) AS support FROM f GROUP BY 1, 2, 3),
        g AS (SELECT subject_id, predicate, sum(support) AS n, count(*) AS values, max(support) AS top FROM b GROUP BY 1, 2),
        t AS (SELECT b.subject_id, b.predicate, count(*) AS ties FROM b JOIN g ON g.subject_id = b.subject_id AND g.predicate = b.predicate AND b.support = g.top GROUP BY 1, 2),
        m AS (SELECT CAST(n AS BIGINT) AS n, n = 2 AND values = 2 AND ties = 2 AS disputed FROM g JOIN t USING (subject_id, predicate))
        SELECT 'current' AS state, count(*) FILTER (WHERE NOT disputed) AS n FROM m
        UNION ALL SELECT 'superseded', CAST(sum(n - 1) FILTER (WHERE NOT disputed) AS BIGINT) FROM m HAVING sum(n - 1) FILTER (WHERE NOT disputed) > 0
        UNION ALL SELECT 'disputed', CAST(sum(n) FILTER (WHERE disputed) AS BIGINT) FROM m HAVING sum(n) FILTER (WHERE disputed) > 0""",
    "p05_disabled": f"""WITH {_FACTS}, w AS (SELECT *, first_value(id) OVER (PARTITION BY subject_id, predicate ORDER BY valid_from DESC, id DESC) AS best FROM f)
        SELECT id, CASE WHEN id = best THEN 'current' ELSE 'superseded' END AS state, CASE WHEN id <> best THEN best END AS superseded_by FROM w""",
    "w08_value_buckets": """WITH v AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS subject_id, o_orderpriority AS predicate, o_orderkey % 3 AS a, o_orderkey % 2 AS b FROM orders)
        SELECT subject_id, predicate, count(DISTINCT b) AS n_buckets, count(*) AS n_values FROM v GROUP BY 1, 2""",
    "a18_coverage": """WITH q AS (SELECT item_id % 300 IN (SELECT doc_id FROM documents) AS ok FROM benchmark)
        SELECT count(*) AS total_questions, count(*) FILTER (WHERE ok) AS answerable_questions, count(*) FILTER (WHERE ok) / count(*)::DOUBLE AS coverage FROM q""",
    "j13_answerable": "SELECT item_id AS question_id FROM benchmark WHERE item_id % 300 IN (SELECT doc_id FROM documents)",
    "a16_comparison": f"""WITH {_RESULTS} SELECT CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS category,
        coalesce(avg(v) FILTER (WHERE doc_id % 3 = 0), 0) AS full_system, coalesce(avg(v) FILTER (WHERE doc_id % 3 = 1), 0) AS no_entity_resolution,
        coalesce(avg(v) FILTER (WHERE doc_id % 3 = 2), 0) AS no_graph_reasoning, 0.0::DOUBLE AS no_abstention FROM l GROUP BY ROLLUP (category)""",
    "a17_abstention": f"WITH {_RESULTS} SELECT count(*) AS questions, count(*) FILTER (WHERE abstained) AS abstentions, count(*) FILTER (WHERE abstained) / count(*)::DOUBLE AS rate FROM l",
    "p09_system_report": f"""WITH {_RESULTS} SELECT category, count(*) AS n, avg(CASE WHEN v = 1 THEN 1.0 ELSE 0.0 END) AS strict, avg(v) AS partial,
        count(*) FILTER (WHERE abstained) AS abstentions FROM l GROUP BY ROLLUP (category)""",
    "a25_calibration_sample": """WITH q AS (SELECT item_id FROM benchmark WHERE text <> '' AND item_id % 4 <> 0 ORDER BY item_id LIMIT 40)
        SELECT item_id AS question_id, item_id % 100 / 100.0::DOUBLE AS confidence, CAST(item_id % 3 = 0 AS INTEGER) AS label FROM q""",
    "a12_collection": f"""WITH {_RECORDS} SELECT count(DISTINCT coalesce(source_doc_id, id)) AS documents, count(*) FILTER (WHERE kind = 'entity') AS entities,
        count(*) FILTER (WHERE kind = 'factstate') AS facts, CAST(0 AS BIGINT) AS relations, count(*) FILTER (WHERE kind = 'candidatemerge' AND state = 'pending') AS pending_merges,
        count(*) FILTER (WHERE kind = 'factstate' AND state = 'disputed') AS disputed_facts, CAST(max(t) AS VARCHAR) AS latest FROM r""",
    "a12_source_types": f"""WITH {_RECORDS}, d AS (SELECT source_doc_id, arg_min(source_type, k) AS source_type FROM r WHERE source_doc_id IS NOT NULL GROUP BY 1)
        SELECT source_type, count(*) AS documents FROM d GROUP BY 1""",
    "a14_status": f"""WITH {_RECORDS}, d AS (SELECT unnest(string_split(source_doc_id, '|')) AS d FROM r WHERE source_doc_id IS NOT NULL UNION ALL SELECT id FROM r WHERE kind = 'document')
        SELECT (SELECT count(DISTINCT d) FROM d) AS document_count, count(*) FILTER (WHERE kind = 'entity') AS entity_count, count(*) FILTER (WHERE kind = 'factstate') AS fact_count FROM r""",
    "w13_browse": f"WITH {_RECORDS} SELECT id, title, kind AS record_type, source_type, CAST(t AS VARCHAR) AS created_at FROM r WHERE kind = 'entity' AND contains(lower(title), 'urgent')",
    "u02_activity": f"WITH {_RECORDS} SELECT 'ingest-' || id AS id, 'ingestion' AS kind, CAST(t AS VARCHAR) AS created_at FROM r ORDER BY t DESC, 1 LIMIT 40",
    "a31_overview": f"""WITH {_RECORDS} SELECT count(DISTINCT coalesce(source_doc_id, id)) AS documents, count(*) FILTER (WHERE kind = 'entity') AS entities,
        count(*) FILTER (WHERE kind = 'factstate') AS facts, CAST(0 AS BIGINT) AS relations, count(*) FILTER (WHERE kind = 'candidatemerge' AND state = 'pending') AS pending_merges,
        count(*) FILTER (WHERE kind = 'factstate' AND state = 'disputed') AS disputed_facts, (SELECT count(*) FROM customer) AS people, (SELECT count(*) FROM supplier) AS agents FROM r""",
    "a30_suggestions": f"""WITH {_RECORDS}, d AS (SELECT source_doc_id, arg_min(source_type, id::BIGINT) AS lengthy, arg_min(source_type, id) AS source_type FROM r WHERE source_doc_id IS NOT NULL GROUP BY 1),
        top AS (SELECT source_type, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, source_type DESC LIMIT 1),
        newest AS (SELECT *, row_number() OVER (ORDER BY t DESC, id) AS i FROM r)
        SELECT id, source FROM (
            SELECT 0 AS place, 'top-source' AS id, n || ' documents from ' || source_type AS source FROM top
            UNION ALL SELECT 1, 'people', (SELECT count(*) FROM customer) || ' people in the directory'
            UNION ALL SELECT 2, 'agents', (SELECT count(*) FROM supplier) || ' agents deployed'
            UNION ALL SELECT 3, 'merges', count(*) || ' pending merges' FROM r WHERE kind = 'candidatemerge' AND state = 'pending' HAVING count(*) > 0
            UNION ALL SELECT 4, 'disputed', count(*) || ' disputed facts' FROM r WHERE kind = 'factstate' AND state = 'disputed' HAVING count(*) > 0
            UNION ALL SELECT 4 + i, 'recent-' || id, source_type || ' · ' || kind FROM newest WHERE i <= 3) ORDER BY place LIMIT 6""",
    "io19_search": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
        s AS (SELECT q.vec_id AS question_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.v, d.v), 6) AS score FROM e q JOIN e d ON q.label = d.label WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""",
    "io19_index_exact": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        s AS (SELECT q.vec_id AS question_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.v, d.v), 6) AS score FROM e q CROSS JOIN e d WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""",
    "p07_context": f"""WITH f AS ({CATALOG_SQL["j16_retrieve"]}),
        h AS (SELECT question_id, rank, format('[{{}}] source_id={{}} source={{}} score={{:.3f}}', rank, doc_id, source, score) AS heading, text FROM f JOIN documents USING (doc_id) WHERE rank <= 2)
        SELECT question_id, rank, heading, CAST(length(heading) + 1 + least(1500, length(coalesce(text, ''))) AS INTEGER) AS size FROM h""",
    "j14_fallback": "SELECT item_id AS question_id, item_id AS entity_id, 0.8::DOUBLE AS score, true AS fallback FROM benchmark",
    "p10_org_edges": """WITH e AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'gone' WHEN c_custkey >= 10 THEN CAST(c_custkey // 10 AS VARCHAR) END AS m FROM customer)
        SELECT 'entity-' || left(sha1(CASE WHEN h.k IS NOT NULL THEN 'org|c|u' || h.k || '@x.co' ELSE 'org|c|person|' || e.m END), 24) AS src,
            'entity-' || left(sha1('org|c|u' || e.k || '@x.co'), 24) AS dst, coalesce(h.name, e.m) || ' manages ' || e.name || CASE WHEN h.k IS NULL THEN ' (manager not in directory)' ELSE '' END AS context,
            h.k IS NOT NULL AS known FROM e LEFT JOIN e h ON CAST(h.k AS VARCHAR) = e.m WHERE e.m IS NOT NULL""",
    "p10_org_summary": """SELECT count(*) AS entities_created, count(*) FILTER (WHERE c_custkey % 7 = 0 OR c_custkey >= 10) AS edges_created,
        count(*) FILTER (WHERE c_custkey % 7 = 0 OR c_custkey >= 10 AND c_custkey // 10 NOT IN (SELECT c_custkey FROM customer)) AS skipped_missing_manager FROM customer""",
    "s18_unique_names": """WITH r AS (SELECT c_custkey AS id, lower(c_mktsegment) || '-ol-co' AS slug, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS p FROM customer)
        SELECT id, CASE WHEN p = 1 THEN slug ELSE slug || '-' || CASE WHEN p >= 3 THEN p + 1 ELSE p END END AS collection_name FROM r""",
    "st03_newest": """WITH r AS (SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events WHERE ts IS NOT NULL)
        SELECT * FROM r WHERE rank <= 40""",
    "st03_feed": """WITH w AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT event_type, count(*) AS windows, CAST(sum(n) AS BIGINT) AS events FROM w GROUP BY 1""",
    "w01_canonical": """WITH d AS (
            SELECT doc_id, concat_ws('-', source, lang) AS cluster, text, CAST(coalesce(text, '') <> '' AS INT) + CAST(coalesce(lang, '') <> '' AS INT) + CAST(coalesce(source, '') <> '' AS INT) + CAST(n_chars IS NOT NULL AS INT) AS filled
            FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY filled DESC, length(coalesce(text, '')) DESC, doc_id) AS k FROM d) SELECT doc_id AS id, cluster FROM r WHERE k = 1""",
    "a03_summaries": """SELECT CASE WHEN count(DISTINCT turn) = 1 AND min(turn) = 0 THEN 'subject:s' || conv_id ELSE conv_id || '-000000' END AS thread_id, 's' || conv_id AS subject,
        count(DISTINCT turn) AS n_messages FROM conversations GROUP BY conv_id""",
    "st02_redecide": f"""WITH {DECIDED_SQL}, touched AS (SELECT DISTINCT subject_id, predicate FROM f WHERE valid_from >= 852076800)
        SELECT id, CASE WHEN method = 'disputed' THEN 'disputed' WHEN id = current_id THEN 'current' ELSE 'superseded' END AS state
        FROM f JOIN decided USING (subject_id, predicate) JOIN touched USING (subject_id, predicate)""",
}
