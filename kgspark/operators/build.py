"""From documents to graph records: the extractor hook, and entities, facts and edges of its output."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.scalars import OPEN_END, confidence, entity_type, epoch_seconds, stable_id

EXTRACTION = (
    "candidate_entities array<struct<name: string, type: string, aliases_hint: array<string>, confidence: string>>, "
    "candidate_relations array<struct<source_entity: string, predicate: string, target_entity: string>>, "
    "candidate_facts array<struct<subject_entity: string, predicate: string, value: string, stated_at: string, confidence: string>>"
)


def with_retry(function: Callable, transient: type[Exception] | tuple = (), tries: int = 4, pause: float = 1.0) -> Callable:
    """function, called again after pause, 2 pause, 4 pause .. seconds where it raises a transient error."""

    def call(*args):
        for k in range(tries):
            try:
                return function(*args)
            except transient:
                if k == tries - 1:
                    raise
                time.sleep(pause * 2**k)

    return call


def apply_function(rows: DataFrame, function: Callable[[dict], dict], schema: str, keep: list[str]) -> DataFrame:
    """Columns keep of rows, those of schema that function makes of each row, and error (null, or why it has none).

    function is the caller's: an extractor, an answerer or a judge. A row on which it fails stays, with null results.
    """
    kept = [rows.schema[c] for c in keep]
    made = rows.sparkSession.createDataFrame([], schema).schema
    out = type(made)([*kept, *made.fields]).add("error", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.to_dict("records"):
                try:
                    found.append({**{c: row[c] for c in keep}, **function(row), "error": None})
                except Exception as e:  # noqa: BLE001 - the caller's function may raise anything; the row says what
                    found.append({**{c: row[c] for c in keep}, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(found, columns=out.names)

    return rows.mapInPandas(run, out)


def _trimmed(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


#: Entity types that candidates may have, by what extractors call them, and words that are no names.
CANDIDATE_TYPES = {
    "person": "Person", "org": "Organization", "organization": "Organization", "project": "Project", "document": "Document", "doc": "Document",
    "issue": "Issue", "ticket": "Issue", "product": "Product", "team": "Team",
}
GENERIC = (
    "api and application app all bug company data database document feature for from issue kms new none platform product project "
    "repository repo sdk se service sql system task team ticket the this that with user work"
).split()
RECORD_TYPES = {"candidate_entities": "Entity", "candidate_relations": "Relation", "candidate_facts": "FactState"}


def filter_candidates(extracted: DataFrame) -> DataFrame:
    """extracted with those candidate_entities that are names: of three characters and more, of a known type, no generic word.
    Names are trimmed and types take their usual name."""
    known = F.create_map(*[F.lit(x) for pair in CANDIDATE_TYPES.items() for x in pair])
    tidy = lambda e: e.withField("name", F.trim(e["name"])).withField("type", F.try_element_at(known, F.lower(F.trim(e["type"]))))
    good = lambda e: (F.length(e["name"]) >= 3) & e["type"].isNotNull() & ~F.lower(e["name"]).isin(GENERIC)
    kept = F.filter(F.transform(F.coalesce("candidate_entities", F.array()), tidy), good)
    return extracted.withColumn("candidate_entities", kept)


def tagged(extracted: DataFrame) -> DataFrame:
    """extracted with record_type and source_doc_id in every candidate, after filter_candidates."""
    out = filter_candidates(extracted)
    tag = lambda kind: lambda x: x.withField("record_type", F.lit(kind)).withField("source_doc_id", F.col("source_id"))
    return out.withColumns({c: F.transform(F.coalesce(c, F.array()), tag(kind)) for c, kind in RECORD_TYPES.items()})


def _last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last, as an upsert leaves it; of equal order the one that sorts last."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(order, *[c for c in others if c != order])).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def entity_records(extracted: DataFrame, access: str = "public") -> DataFrame:
    """Entities of extracted rows (source_id, source, timestamp and EXTRACTION): one for each name in a document, the last of
    those with one name. position: its place among the document's candidates."""
    e = extracted.where("source_id <> ''").select("source_id", F.posexplode("candidate_entities").alias("position", "e")).withColumn("name", _trimmed(F.col("e.name")))
    e = e.where("name <> ''")
    aliases = F.when(F.size("e.aliases_hint") > 0, F.col("e.aliases_hint")).otherwise(F.array("name"))
    return _last(e.select(
        F.concat(F.lit("entity-"), stable_id("source_id", "name")).alias("id"), F.col("name").alias("canonical_name"), entity_type(_trimmed(F.col("e.type"))).alias("entity_type"),
        aliases.alias("aliases"), F.col("source_id").alias("source_doc_id"), confidence(F.col("e.confidence")).alias("confidence"),
        F.lit("candidate").alias("state"), F.lit(access).alias("access_level"), "position",
    ), "id", "position")


def _names(entities: DataFrame) -> DataFrame:
    """One id for each lower-case name of a document: that of the last entity so named."""
    return entities.groupBy("source_doc_id", F.lower("canonical_name").alias("key")).agg(F.max_by("id", F.struct("position", "id")).alias("known"))


def _named(rows: DataFrame, names: DataFrame, column: str, out: str) -> DataFrame:
    """rows with the id of the entity that column names in its document, or a minted one."""
    match = rows.withColumn("key", F.lower(column)).hint("merge").join(names, ["source_doc_id", "key"], "left")
    minted = F.concat(F.lit("entity-"), stable_id("source_doc_id", column))
    return match.withColumn(out, F.coalesce("known", minted)).drop("key", "known")


def fact_records(extracted: DataFrame, entities: DataFrame, now: int, access: str = "public") -> DataFrame:
    """Facts of extracted rows; those without subject, predicate or value are dropped, of equal ones the last stays. now: where
    no time is given."""
    f = extracted.where("source_id <> ''").select(F.col("source_id").alias("source_doc_id"), F.col("source").alias("doc_source_type"), "timestamp", F.posexplode("candidate_facts").alias("position", "f"))
    f = f.withColumns({"subject": _trimmed(F.col("f.subject_entity")), "predicate": _trimmed(F.col("f.predicate")), "value": _trimmed(F.col("f.value"))})
    f = _named(f.where("subject <> '' and predicate <> '' and value <> ''"), _names(entities), "subject", "subject_id")
    stated = F.coalesce(F.nullif("f.stated_at", F.lit("")), F.col("timestamp"))
    return _last(f.select(
        F.concat(F.lit("fact-"), stable_id("source_doc_id", "subject", "predicate", "value")).alias("id"), "subject_id", "predicate", "value",
        "source_doc_id", "doc_source_type", epoch_seconds(stated, now).alias("valid_from"), F.lit(OPEN_END).alias("valid_to"),
        F.lit(0.5).alias("authority_weight"), F.lit(1).alias("corroboration_count"), confidence(F.col("f.confidence")).alias("confidence"),
        F.lit("candidate").alias("state"), F.lit(access).alias("access_level"), "position",
    ), "id", "position").drop("position")


def edge_records(extracted: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges (src, predicate, dst, context, source_doc_id) of extracted rows; incomplete ones are dropped."""
    r = extracted.where("source_id <> ''").select(F.col("source_id").alias("source_doc_id"), F.explode("candidate_relations").alias("r"))
    r = r.withColumns({"a": _trimmed(F.col("r.source_entity")), "predicate": _trimmed(F.col("r.predicate")), "b": _trimmed(F.col("r.target_entity"))})
    r, names = r.where("a <> '' and predicate <> '' and b <> ''"), _names(entities)
    both = _named(_named(r, names, "a", "src"), names, "b", "dst")
    return both.select("src", "predicate", "dst", F.concat_ws(" ", "a", "predicate", "b").alias("context"), "source_doc_id")


def build_counts(extracted: DataFrame) -> DataFrame:
    """One row: documents, skipped (without source_id), entities, facts and relations that are complete."""
    full = lambda column, *names: F.size(F.filter(F.coalesce(column, F.array()), lambda x: F.forall(F.array(*[_trimmed(x[n]) for n in names]), lambda v: v != "")))
    good = F.coalesce(F.col("source_id"), F.lit("")) != ""
    total = lambda size: F.coalesce(F.sum(F.when(good, size)), F.lit(0))
    return extracted.agg(
        F.count_if(good).alias("documents"), F.count_if(~good).alias("skipped"), total(full("candidate_entities", "name")).alias("entities"),
        total(full("candidate_facts", "subject_entity", "predicate", "value")).alias("facts"),
        total(full("candidate_relations", "source_entity", "predicate", "target_entity")).alias("relations"),
    )
