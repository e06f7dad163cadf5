"""What a question's answer is written from: links, facts, entities, edges and documents, as rows in order; and the fallback
by retrieval for questions whose mentions have no entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.similarity import best_similarity

#: What a fallback link's similarity counts, and at least.
SHARE, LEAST = 0.8, 0.4


def fallback_links(questions: DataFrame, found: DataFrame, entities: DataFrame) -> DataFrame:
    """(question_id, entity_id, score, fallback): of the entities (id, aliases, source_doc_id) of a question's retrieved documents
    (question_id, doc_id) the one most like its words; ties go to the smaller id. Questions without such an entity have no row."""
    words = F.array_join(F.regexp_extract_all("question", F.lit("[A-Za-z0-9]+"), F.lit(0)), " ")
    asked = questions.select("question_id", F.array(words).alias("words"))
    own = entities.select(F.col("id").alias("entity_id"), "aliases", F.col("source_doc_id").cast("string").alias("doc"))
    met = found.select("question_id", F.col("doc_id").cast("string").alias("doc")).hint("merge").join(own, "doc").hint("merge").join(asked, "question_id")
    scored = met.select("question_id", "entity_id", best_similarity("words", "aliases").alias("similarity"))
    best = scored.groupBy("question_id").agg(F.min(F.struct((-F.col("similarity")).alias("worse"), "entity_id")).alias("best"))
    score = F.greatest(F.lit(LEAST), -F.col("best.worse") * SHARE)
    return best.select("question_id", "best.entity_id", score.alias("score"), F.lit(True).alias("fallback"))


def _part(rows: DataFrame, name: str, order: list[Column], fields: list[str]) -> DataFrame:
    key = F.to_json(F.struct(*order))
    return rows.select("question_id", F.lit(name).alias("part"), key.alias("sort_key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("item"))


def packet_rows(links: DataFrame, facts: DataFrame, entities: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """(question_id, part, sort_key, item) of context packets: parts links, facts (by valid_from), entities, edges and documents,
    each item as JSON. All inputs have question_id; bookkeeping edges (HAS_STATE) are left out. A packet is as many rows as it
    has items, so that a question with very many facts is no single value."""
    real = edges.where(F.upper(F.trim(F.coalesce("predicate", F.lit("")))) != "HAS_STATE")
    valid = F.coalesce(F.col("valid_from").cast("long"), F.lit(0).cast("long"))
    padded = F.lpad((valid + 10**12).cast("string"), 14, "0")
    parts = [
        _part(links, "links", [F.col("mention").alias("m")], ["mention", "entity_id", "score"]),
        _part(facts, "facts", [padded.alias("v"), F.col("id").cast("string").alias("i")], ["id", "subject_id", "predicate", "value", "state", "valid_from", "source_doc_id"]),
        _part(entities, "entities", [F.col("id").cast("string").alias("i")], ["id", "canonical_name", "entity_type", "state", "source_doc_id"]),
        _part(real, "edges", [F.concat_ws("|", "src", "predicate", "dst").alias("e")], ["src", "predicate", "dst", "source_doc_id"]),
        _part(documents, "documents", [F.lpad(F.col("rank").cast("string"), 6, "0").alias("r")], ["doc_id", "source", "content", "score"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def packet_evidence(facts: DataFrame) -> DataFrame:
    """(question_id, source_doc_id): the different documents of a packet's facts."""
    return facts.where("source_doc_id <> ''").select("question_id", "source_doc_id").distinct()


def edge_shape(payloads: DataFrame) -> DataFrame:
    """payloads with src, dst and predicate from any of their field names.

    Fields: source_entity_id or source, target_entity_id or target, canonical_predicate, raw_predicate or predicate.
    """
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in payloads.columns], F.lit(None).cast("string"))
    return payloads.withColumns({
        "src": first("source_entity_id", "source"), "dst": first("target_entity_id", "target"),
        "predicate": F.coalesce(first("canonical_predicate", "raw_predicate", "predicate"), F.lit("")),
    })


def fact_value(additional: str = "additional", metadata: str = "metadata", fields: str = "fields") -> Column:
    """value of the additional map if it is there at all (null as empty), else of the metadata, else note or title."""
    get = lambda m, k: F.nullif(F.try_element_at(m, F.lit(k)), F.lit(""))
    own = F.coalesce(F.try_element_at(additional, F.lit("value")), F.lit(""))
    return F.when(F.map_contains_key(additional, "value"), own).otherwise(F.coalesce(get(metadata, "value"), get(fields, "note"), get(fields, "title"), F.lit("")))
