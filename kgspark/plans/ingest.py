"""The whole way from extracted documents to decided facts, as one plan of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.scalars import email_domains, identifiers
from kgspark.operators import build, conflicts, resolution
from kgspark.operators.resolution_index import ResolutionIndex, add_batch, new_index, survivors
from kgspark.shared import cut


@dataclass(frozen=True)
class Graph:
    """What an ingestion leaves: entities with state and merged_into, facts with their state, edges, pending merges of the batch, one row of
    counts, the reliability of source types, and the index that the next batch's entities are resolved by."""

    entities: DataFrame
    facts: DataFrame
    edges: DataFrame
    pending: DataFrame
    summary: DataFrame
    reliability: dict[str, float]
    index: ResolutionIndex


def resolvable(entities: DataFrame, source: Column | None = None) -> DataFrame:
    """Entity records in the shape that resolution takes: identifiers and mail domains are those in their aliases."""
    kind = source if source is not None else F.lit(None).cast("string")
    return entities.select(
        "id", F.col("canonical_name").alias("name"), F.array_distinct(F.concat(F.array("canonical_name"), "aliases")).alias("aliases"), "source_doc_id",
        kind.alias("doc_source_type"), email_domains(F.col("aliases")).alias("domains"), identifiers(F.col("aliases")).alias("identifiers"), "entity_type",
    )


def ingest(extracted: DataFrame, now: int, access: str = "public", known: Graph | None = None) -> Graph:
    """Graph of extracted rows (source_id, source, timestamp and build.EXTRACTION), added to a known one.

    Candidates are filtered, the batch's entities resolved against those of before through the index, facts re-pointed to
    survivors, source types weighed by truth discovery, and conflicts decided by the learned weights. Rows without source_id are
    skipped and counted. With a known graph only entities that share a match key with the batch are scored, and only the groups that the
    new facts touch are decided anew. Batches in any order leave the same merges as all documents at once.
    """
    spark = extracted.sparkSession
    rows = cut(build.filter_candidates(extracted), "extracted")
    entities = cut(build.entity_records(rows, access), "entities")
    facts, edges = cut(build.fact_records(rows, entities, now, access), "facts"), cut(build.edge_records(rows, entities), "edges")
    index, changes, pending = add_batch(new_index(spark) if known is None else known.index, resolvable(entities), facts)
    held = facts.columns
    pointed = _moved(facts, survivors(index, facts.select(F.col("subject_id").alias("id"))), "subject_id")
    older = None if known is None else _moved(known.facts, changes, "subject_id")
    whole = cut(pointed if older is None else older.select(*[c for c in held if c in older.columns]).unionByName(pointed, allowMissingColumns=True), "all-facts")
    reliability = conflicts.discover_truth(whole)[-1]
    if older is None:
        decided = conflicts.resolve_conflicts(whole, reliability=reliability)
    else:
        touched = pointed.select(*conflicts.GROUP).unionByName(older.hint("merge").join(changes.select(F.col("merged_into").alias("subject_id")).distinct(), "subject_id", "left_semi").select(*conflicts.GROUP)).distinct()
        again = conflicts.resolve_conflicts(whole.hint("merge").join(touched, conflicts.GROUP, "left_semi"), reliability=reliability)
        decided = older.hint("merge").join(touched, conflicts.GROUP, "left_anti").unionByName(again, allowMissingColumns=True)
    decided = cut(decided, "decided")
    fresh = entities.withColumn("merged_into", F.lit(None).cast("string"))
    if known is not None:
        stored = _moved(known.entities, changes, "merged_into")
        fresh = fresh.hint("merge").join(known.entities.select("id"), "id", "left_anti")
        fresh = stored.unionByName(fresh, allowMissingColumns=True)
    target = changes.select(F.col("id").alias("own"), F.col("merged_into").alias("into"))
    every = fresh.hint("merge").join(target, F.col("id") == F.col("own"), "left").withColumn("merged_into", F.coalesce("into", "merged_into")).drop("own", "into")
    every = cut(every.withColumn("state", F.when(F.col("merged_into").isNotNull(), "resolved").otherwise(F.col("state"))), "graph-entities")
    counts = build.build_counts(rows).crossJoin(changes.agg(F.count("*").alias("merges_made")))
    summary = counts.crossJoin(decided.agg(F.count_if(F.col("state") == "superseded").alias("superseded"), F.count_if(F.col("state") == "disputed").alias("disputed")))
    return Graph(every, decided, edges, pending, summary, reliability, index)


def _moved(rows: DataFrame, merges: DataFrame, column: str) -> DataFrame:
    """rows with the survivor in column where what it names is merged (id, merged_into)."""
    target = merges.select(F.col("id").alias("moved_from"), F.col("merged_into").alias("moved_to"))
    out = rows.hint("merge").join(target, rows[column] == F.col("moved_from"), "left")
    return out.withColumn(column, F.coalesce("moved_to", rows[column])).select(*rows.columns)
