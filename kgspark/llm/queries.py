"""The operators as queries over the test tables: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm.decontaminate import contamination_report
from kgspark.llm.exact_dedup import exact_groups
from kgspark.llm.fill_in_middle import fim_report
from kgspark.llm.licenses import scan_licenses
from kgspark.llm.line_dedup import line_report
from kgspark.llm.ngram_lm import lm_report
from kgspark.llm.packing import pack
from kgspark.llm.simhash import simhash_report
from kgspark.llm.token_counts import token_report
from kgspark.llm.token_files import token_file_report
from kgspark.llm.toxicity import toxicity_report
from kgspark.llm.url_filter import url_report
from kgspark.llm.vantage_clusters import cluster_report
from kgspark.shared import table

CAPACITY = 2048


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_report(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), CAPACITY)
    return packed.withColumnRenamed("id", "doc_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_report(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select(found["id"].alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_report(table(spark, sf_dir, "pages"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_report(table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_report(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_packing, op3_decontamination, op4_toxicity, op5_lm_scores, op6_line_dedup, op7_licenses,
    op8_token_counts, op9_exact_dedup, op10_url_filter, op11_clusters, op12_fill_in_middle, op13_token_files,
)}

_ROUND = """
        s{n} AS MATERIALIZED (
            SELECT v.vec_id, v.x, arg_min(c.cluster, (list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.cluster)) AS cluster,
                CAST(min(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS BIGINT) AS distance
            FROM v, c{n} c GROUP BY v.vec_id, v.x),
        m{n} AS (
            SELECT cluster, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x
            FROM (SELECT cluster, i, sum(x[i]) AS total, count(*) AS n FROM s{n}, unnest(range(1, 65)) AS r(i) GROUP BY cluster, i) GROUP BY cluster),
        c{m} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (cluster))"""

ORACLE_SQL = {
    "op9_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op3_decontamination": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
        b AS (
            SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, least(len(words), 10) AS k, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS win
            FROM b, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS r(i) WHERE len(words) > 0),
        sizes AS (SELECT DISTINCT k FROM bw),
        dw AS (
            SELECT doc_id, i, k, array_to_string(words[i : i + k - 1], ' ') AS win
            FROM d, sizes, unnest(range(1, len(words) - k + 2)) AS r(i) WHERE len(words) >= k),
        hits AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, win)),
        places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + k)) AS r(p) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
            CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op11_clusters": """
        WITH v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda y: CAST(floor(64 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: isfinite(y))) = 64),
        c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INT) AS cluster, x
            FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 16)),
        """ + ",".join(_ROUND.format(n=n, m=n + 1) for n in range(4)) + """
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
            CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
        FROM s3 JOIN c3 USING (cluster)
    """,
    "op12_fill_in_middle": """
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
        h AS (
            SELECT doc_id, text, n, CAST('0x' || h[1:8] AS UBIGINT) % (n + 1) AS u, CAST('0x' || h[9:16] AS UBIGINT) % (n + 1) AS v,
                CAST('0x' || h[17:24] AS UBIGINT) % 100 AS plain, CAST('0x' || h[25:32] AS UBIGINT) % 100 AS spm FROM t),
        p AS (
            SELECT doc_id, text, n, CAST(least(u, v) AS BIGINT) AS a, CAST(greatest(u, v) AS BIGINT) AS b,
                CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR plain >= 90 THEN 'plain'
                    WHEN spm < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'psm' THEN '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
                WHEN 'spm' THEN '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a)
                ELSE text END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM p
    """,
}
