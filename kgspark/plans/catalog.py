"""The library's operators as queries over the test tables, and their SQL.

orders stand for facts, part for entities, lineitem for edges, benchmark for questions, customer for employees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import scalars as S
from kgspark.operators import conflicts, dashboard, evaluation, graph, identity, near_duplicates, resolution, resolution_index, retrieval, threads
from kgspark.operators.components import connected_components
from kgspark.shared import table
from kgspark.streaming.feeds import activity_counts

KINDS = ["github", "jira", "gmail", "fireflies"]


def facts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_orderpriority").alias("predicate"),
        F.col("o_orderstatus").alias("value"), F.unix_timestamp("o_orderdate").alias("valid_from"), F.col("o_orderkey").alias("source_doc_id"), kind.alias("doc_source_type"),
    )


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Parts under a name that differs by few letters, so that some names are near each other."""
    p = table(spark, sf, "part")
    none = F.array().cast("array<string>")
    return p.select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.lit(None).cast("string").alias("source_doc_id"),
        F.col("p_type").alias("doc_source_type"), F.array(F.col("p_type")).alias("signature"), none.alias("identifiers"),
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def w05_conflict_cascade(spark, sf):
    return conflicts.decide(conflicts.with_authority(facts(spark, sf)))


def w06_last_write_wins(spark, sf):
    return conflicts.last_write_wins(facts(spark, sf))


def w07_apply_decisions(spark, sf):
    f = conflicts.with_authority(facts(spark, sf))
    return conflicts.apply_decisions(f, conflicts.decide(f)).select("id", "state", "superseded_by", "valid_to")


def a09_method_counts(spark, sf):
    return conflicts.method_counts(w05_conflict_cascade(spark, sf))


def s47_authority(spark, sf):
    return conflicts.with_authority(facts(spark, sf)).select("id", "authority_weight")


def a11_truth_discovery(spark, sf):
    history = conflicts.discover_truth(facts(spark, sf))
    rows = [(i, k, v) for i, round_ in enumerate(history) for k, v in sorted(round_.items())]
    return spark.createDataFrame(rows, "round int, doc_source_type string, reliability double")


def a01_document_frequency(spark, sf):
    return retrieval.document_frequencies(retrieval.term_counts(table(spark, sf, "documents"), "doc_id", "text"))


def j16_retrieve(spark, sf):
    found = retrieval.retrieve(questions(spark, sf), table(spark, sf, "documents"))
    return found.select("question_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def j17_near_duplicates(spark, sf):
    pairs = near_duplicates.near_duplicate_pairs(table(spark, sf, "documents"))
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


def w02_mark_duplicates(spark, sf):
    docs = table(spark, sf, "documents")
    return near_duplicates.mark_duplicates(docs, near_duplicates.near_duplicate_clusters(docs))


def a02_components(spark, sf):
    """Components of the referrals customer k -> k div 3; every seventh customer refers to nobody but itself."""
    key = F.col("c_custkey")
    parent = F.when(key % 7 == 0, key).otherwise(F.expr("c_custkey div 3"))
    return connected_components(table(spark, sf, "customer").select(key.alias("src"), parent.alias("dst")))


def j05_blocking(spark, sf):
    return resolution.candidate_pairs(entities(spark, sf))


def p03_entity_resolution(spark, sf):
    return resolution_index.merge_blocks(entities(spark, sf))


def j08_redirect(spark, sf):
    merges = table(spark, sf, "customer").where("c_custkey > 0 and c_custkey % 10 <> 1").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") - 1).alias("merged_into"))
    links = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("entity_id"))
    return resolution.redirect(links, merges)


def j11_expand(spark, sf):
    edges = table(spark, sf, "lineitem").select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    seeds = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), (F.col("item_id") * 2 + 3).alias("node"))
    return graph.expand(seeds, edges)


def j15_manager_edges(spark, sf):
    c = table(spark, sf, "customer")
    manager = F.nullif(F.expr("c_custkey div 10"), F.lit(0))
    return graph.manager_edges(c.select(F.col("c_custkey").alias("employee_id"), manager.alias("manager_id")))


def a15_accuracy(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    score = F.when(F.col("quality") == 0, 0.0).when(F.col("toxic") == 1, 0.5).otherwise(1.0)
    return graph.accuracy(rows.select(F.col("lang").alias("category"), score.alias("score_value")))


def a16_ablation(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    config = F.when(F.col("doc_id") % 2 == 0, "full").otherwise("plain")
    results = rows.select(F.col("lang").alias("category"), F.col("quality").cast("double").alias("score_value"), config.alias("config"))
    return evaluation.comparison(results, "partial", ["full", "plain"]).withColumnRenamed("category", "lang")


def a12_dashboard(spark, sf):
    return dashboard.facts_by_source(facts(spark, sf))


def a13_role_access(spark, sf):
    level = F.when(F.col("id") % 10 == 0, "restricted").when(F.col("id") % 3 == 0, "internal").otherwise("public")
    records = facts(spark, sf).select(F.when(F.col("id") % 2 == 0, "fact").otherwise("document").alias("kind"), (F.col("id") % 50).cast("string").alias("source_doc_id"), level.alias("access_level"))
    return identity.role_access(records)


def s42_access_filter(spark, sf):
    level = F.when(F.col("id") % 10 == 0, "restricted").when(F.col("id") % 3 == 0, "internal")
    return facts(spark, sf).where(S.visible_to(level, F.lit("member"))).select("id")


def s17_stable_id(spark, sf):
    return facts(spark, sf).select("id", S.stable_id("subject_id", "predicate", "value").alias("stable_id"))


def s22_normalize_value(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.normalize_value(F.concat(F.lit("  "), "p_type", F.lit(" (A,  B) "), "p_name")).alias("value"), S.slug(F.concat_ws(" / ", "p_name", "p_brand"), "-").alias("slug"))


def s26_shingles(spark, sf):
    grams = S.shingles(S.dedup_tokens(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.size(grams).cast("long").alias("n_shingles"))


def s10_html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(S.html_to_text(F.col("html"))).alias("text_md5"))


def a03_threads(spark, sf):
    return threads.summarize_turns(table(spark, sf, "conversations"))


def w12_recent(spark, sf):
    return conflicts.latest_facts(facts(spark, sf), 12).select("id", "valid_from")


def st03_activity(spark, sf):
    return activity_counts(table(spark, sf, "events"))


def io20_upsert(spark, sf):
    """Orders of even number are old, all others and every third new."""
    o = table(spark, sf, "orders")
    shape = lambda df, v: df.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.lit(v).alias("batch"))
    even = F.col("o_orderkey") % 2 == 0
    return near_duplicates.keep_latest(shape(o.where(even), "old"), shape(o.where(~even | (F.col("o_orderkey") % 3 == 0)), "new"))


QUERIES = {f.__name__: f for f in (
    w05_conflict_cascade, w06_last_write_wins, w07_apply_decisions, a09_method_counts, s47_authority, a11_truth_discovery,
    a01_document_frequency, j16_retrieve, j17_near_duplicates, w02_mark_duplicates, a02_components, j05_blocking,
    p03_entity_resolution, j08_redirect, j11_expand, j15_manager_edges, a15_accuracy, a16_ablation, a12_dashboard,
    a13_role_access, s42_access_filter, s17_stable_id, s22_normalize_value, s26_shingles, s10_html_to_text, a03_threads,
    w12_recent, st03_activity, io20_upsert,
)}

_FACTS = """f AS (
    SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS subject_id, o_orderpriority AS predicate, o_orderstatus AS value,
        CAST(epoch(o_orderdate) AS BIGINT) AS valid_from, o_orderkey AS source_doc_id,
        ['github', 'jira', 'gmail', 'fireflies'][o_orderkey % 4 + 1] AS doc_source_type FROM orders),
w AS (
    SELECT *, CASE doc_source_type WHEN 'github' THEN 0.7 WHEN 'jira' THEN 0.6 WHEN 'gmail' THEN 0.4 ELSE 0.5 END::DOUBLE AS weight,
        lower(value) AS bucket FROM f)"""
DECIDED_SQL = _DECIDED = f"""{_FACTS},
r AS (
    SELECT *, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY weight DESC, id) AS by_weight,
        row_number() OVER (PARTITION BY subject_id, predicate ORDER BY valid_from DESC, id) AS by_time FROM w),
g AS (
    SELECT subject_id, predicate, count(*) AS n_facts, max(CASE WHEN by_weight = 1 THEN id END) AS strongest,
        max(CASE WHEN by_weight = 1 THEN weight END) - max(CASE WHEN by_weight = 2 THEN weight END) AS lead,
        max(CASE WHEN by_time = 1 THEN id END) AS latest FROM r GROUP BY 1, 2),
b AS (SELECT subject_id, predicate, bucket, count(DISTINCT source_doc_id) AS support FROM w GROUP BY 1, 2, 3),
p AS (
    SELECT subject_id, predicate, bucket, id FROM (
        SELECT *, row_number() OVER (PARTITION BY subject_id, predicate, bucket ORDER BY weight DESC, valid_from DESC, id DESC) AS k FROM w) WHERE k = 1),
t AS (SELECT subject_id, predicate, max(support) AS most, count(*) AS n_buckets FROM b GROUP BY 1, 2),
m AS (
    SELECT t.subject_id, t.predicate, any_value(n_buckets) AS n_buckets, count(*) AS n_best, min(p.id) AS pick
    FROM t JOIN b ON b.subject_id = t.subject_id AND b.predicate = t.predicate AND b.support = t.most
    JOIN p ON p.subject_id = b.subject_id AND p.predicate = b.predicate AND p.bucket = b.bucket GROUP BY 1, 2),
d AS (
    SELECT g.*, m.pick, CASE WHEN n_facts = 1 THEN 'single' WHEN lead > 0.15 THEN 'authority' WHEN n_best = 1 THEN 'corroboration'
        WHEN n_facts = 2 AND n_buckets = 2 THEN 'disputed' ELSE 'recency' END AS method
    FROM g JOIN m ON g.subject_id = m.subject_id AND g.predicate = m.predicate),
decided AS (
    SELECT subject_id, predicate, method, CASE method WHEN 'single' THEN strongest WHEN 'authority' THEN strongest
        WHEN 'corroboration' THEN pick WHEN 'recency' THEN latest END AS current_id, n_facts FROM d)"""
_LABELLED = "l AS (SELECT lang, doc_id, quality, toxic FROM labels JOIN documents USING (doc_id))"

_SIMILAR = """t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS gram FROM t),
s AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS h FROM g GROUP BY 1),
h AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS head FROM s),
u AS (SELECT g.* FROM g JOIN h ON g.doc_id = h.doc_id AND h.head = h.doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM u x JOIN u y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
pairs AS (
    SELECT a, b, common / (m.n + o.n - common)::DOUBLE AS similarity FROM c JOIN s m ON m.doc_id = a JOIN s o ON o.doc_id = b WHERE 5 * common >= 4 * (m.n + o.n - common)
    UNION ALL SELECT head, doc_id, 1.0 FROM h WHERE head <> doc_id)"""

ORACLE_SQL = {
    "w05_conflict_cascade": f"WITH {_DECIDED} SELECT * FROM decided",
    "w06_last_write_wins": f"""WITH {_FACTS} SELECT subject_id, predicate, CASE WHEN count(*) = 1 THEN 'single' ELSE 'last_write_wins' END AS method,
        arg_max(id, valid_from * 1000000000 + id) AS current_id, count(*) AS n_facts FROM f GROUP BY 1, 2""",
    "w07_apply_decisions": f"""WITH {_DECIDED} SELECT id, CASE WHEN method = 'disputed' THEN 'disputed' WHEN id = current_id THEN 'current' ELSE 'superseded' END AS state,
        CASE WHEN method <> 'disputed' AND id <> current_id THEN current_id END AS superseded_by, CAST(9999999999 AS BIGINT) AS valid_to
        FROM f JOIN decided ON f.subject_id = decided.subject_id AND f.predicate = decided.predicate""",
    "a09_method_counts": f"WITH {_DECIDED} SELECT method, count(*) AS n FROM decided GROUP BY 1",
    "s47_authority": f"WITH {_FACTS} SELECT id, weight AS authority_weight FROM w",
    "a01_document_frequency": """SELECT term, count(DISTINCT doc_id) AS df FROM (
        SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9_./:-]*')) AS term FROM documents) GROUP BY 1""",
    "j16_retrieve": """WITH q AS (
            SELECT item_id AS question_id, term, count(*) AS qtf FROM (
                SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_./:-]*')) AS term FROM benchmark) GROUP BY 1, 2),
        d AS (
            SELECT doc_id, term, count(*) AS tf FROM (
                SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9_./:-]*')) AS term FROM documents) GROUP BY 1, 2),
        df AS (SELECT term, count(*) AS df FROM d GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
        s AS (
            SELECT question_id, doc_id, round(sum(qtf * (1 + ln(tf)) * (ln((n + 1.0) / (df + 1)) + 1)), 6) AS score
            FROM q JOIN df USING (term) JOIN d USING (term), n GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT question_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
    "a02_components": """WITH RECURSIVE e AS (SELECT c_custkey AS src, CASE WHEN c_custkey % 7 = 0 THEN c_custkey ELSE c_custkey // 3 END AS dst FROM customer),
        up AS (SELECT src AS node, dst AS top FROM e UNION SELECT dst, dst FROM e UNION SELECT up.node, e.dst FROM up JOIN e ON up.top = e.src)
        SELECT node, min(top) AS component FROM up GROUP BY 1""",
    "j05_blocking": """WITH p AS (
            SELECT p_partkey AS id, p_type, 'name:' || lower(split_part(trim(p_name || ' ' || p_brand), ' ', 1)) AS block FROM part),
        s AS (SELECT *, count(*) OVER (PARTITION BY block) AS n FROM p),
        k AS (
            SELECT id, block FROM s WHERE n <= 100 UNION ALL
            SELECT id, block || '|' || p_type || '#' || CAST((row_number() OVER (PARTITION BY block, p_type ORDER BY id) - 1) // 100 AS VARCHAR) FROM s WHERE n > 100)
        SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.block = y.block AND x.id < y.id""",
    "j08_redirect": """SELECT o_orderkey, CASE WHEN o_custkey BETWEEN 1 AND (SELECT max(c_custkey) FROM customer) THEN (o_custkey - 1) // 10 * 10 + 1 ELSE o_custkey END AS entity_id FROM orders""",
    "j11_expand": """WITH e AS (SELECT DISTINCT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem),
        b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
        n AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM b) WHERE r <= 50),
        s AS (SELECT DISTINCT item_id AS question_id, item_id * 2 + 3 AS node FROM benchmark),
        h1 AS (SELECT DISTINCT question_id, dst AS node FROM s JOIN n ON s.node = n.src EXCEPT SELECT * FROM s),
        h2 AS (SELECT DISTINCT question_id, dst AS node FROM h1 JOIN n ON h1.node = n.src EXCEPT (SELECT * FROM s UNION SELECT * FROM h1))
        SELECT question_id, node, 0 AS hop FROM s UNION ALL SELECT question_id, node, 1 FROM h1 UNION ALL SELECT question_id, node, 2 FROM h2""",
    "j15_manager_edges": """SELECT c.c_custkey // 10 AS manager_id, c.c_custkey AS employee_id, m.c_custkey IS NOT NULL AS known
        FROM customer c LEFT JOIN customer m ON m.c_custkey = c.c_custkey // 10 WHERE c.c_custkey // 10 <> 0""",
    "a15_accuracy": f"""WITH {_LABELLED}, s AS (SELECT lang AS category, CASE WHEN quality = 0 THEN 0.0 WHEN toxic = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS v FROM l)
        SELECT category, count(*) AS n, avg(CASE WHEN v = 1 THEN 1.0 ELSE 0.0 END) AS strict, avg(v) AS partial FROM s GROUP BY ROLLUP (category)""",
    "a16_ablation": f"""WITH {_LABELLED} SELECT CASE WHEN grouping(lang) = 1 THEN 'overall' ELSE lang END AS lang, coalesce(avg(quality) FILTER (WHERE doc_id % 2 = 0), 0) AS "full",
        coalesce(avg(quality) FILTER (WHERE doc_id % 2 = 1), 0) AS plain FROM l GROUP BY ROLLUP (lang)""",
    "a12_dashboard": f"WITH {_FACTS} SELECT doc_source_type, count(DISTINCT source_doc_id) AS documents, count(*) AS facts, max(valid_from) AS latest FROM f GROUP BY 1",
    "a13_role_access": """WITH r AS (SELECT * FROM (VALUES ('guest', 0), ('member', 1), ('admin', 2)) AS r(role, most))
        SELECT role, count(DISTINCT CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 50 END) AS documents, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS facts
        FROM orders JOIN r ON CASE WHEN o_orderkey % 10 = 0 THEN 2 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END <= most GROUP BY 1""",
    "s42_access_filter": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 <> 0",
    "s17_stable_id": f"WITH {_FACTS} SELECT id, left(sha1(subject_id || '|' || predicate || '|' || value), 24) AS stable_id FROM f",
    "s22_normalize_value": r"""SELECT p_partkey, regexp_replace(regexp_replace(trim(lower('  ' || p_type || ' (A,  B) ' || p_name)), '\s+', ' ', 'g'), '[^a-z0-9 ._:/-]', '', 'g') AS value,
        trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""",
    "s26_shingles": """WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents)
        SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 5 THEN 1
            ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END::BIGINT AS n_shingles FROM t""",
    "s10_html_to_text": r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&apos;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&'),
        '[\s\x{a0}\x0B]+', ' ', 'g'))) AS text_md5 FROM pages""",
    "a03_threads": "SELECT conv_id, count(*) AS n, arg_min(role, turn) AS first_role, arg_max(text, turn) AS last_text FROM conversations GROUP BY 1",
    "w12_recent": f"WITH {_FACTS} SELECT id, valid_from FROM f ORDER BY valid_from DESC, id DESC LIMIT 12",
    "st03_activity": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "io20_upsert": """WITH u AS (SELECT o_custkey AS id, o_orderkey AS version, 'old' AS batch FROM orders WHERE o_orderkey % 2 = 0
        UNION ALL SELECT o_custkey, o_orderkey, 'new' FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 3 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, batch) AS k FROM u) SELECT id, version, batch FROM r WHERE k = 1""",
    "j17_near_duplicates": f"WITH {_SIMILAR} SELECT a, b, round(similarity, 6) AS similarity FROM pairs",
    "w02_mark_duplicates": f"""WITH RECURSIVE {_SIMILAR},
        e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), up AS (SELECT x AS node, x AS top FROM e UNION SELECT up.node, e.y FROM up JOIN e ON up.top = e.x),
        k AS (SELECT node, min(top) AS cluster FROM up GROUP BY 1),
        r AS (SELECT node AS id, cluster, first_value(node) OVER (PARTITION BY cluster ORDER BY CAST(coalesce(text, '') <> '' AS INT) + CAST(coalesce(lang, '') <> '' AS INT)
            + CAST(coalesce(source, '') <> '' AS INT) + CAST(n_chars IS NOT NULL AS INT) DESC, length(coalesce(text, '')) DESC, node) AS best FROM k JOIN documents ON doc_id = node)
        SELECT id, cluster, id = best AS is_canonical, CASE WHEN id <> best THEN best END AS near_duplicate_of FROM r""",
}
