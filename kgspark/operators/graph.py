"""Expansion over edges, answer confidence, and the organisation graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.scalars import stable_id
from kgspark.shared import cut

#: Nodes of a frontier up to which they are broadcast to the tasks that read edges.
HELD_NODES = 1_000_000


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 2, limit: int = 50) -> DataFrame:
    """(question_id, node, hop) of nodes within so many hops of the seeds (question_id, node), over undirected edges (src, dst).

    Each node passes on its `limit` smallest neighbours.
    """
    seen = seeds.select("question_id", "node").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        asked = cut(frontier.select(F.col("node").alias("src")).distinct(), "asked")
        near = cut(_neighbours(edges, asked, limit), "near")
        step = frontier.hint("merge").join(near.withColumnRenamed("src", "node"), "node").select("question_id", F.col("dst").alias("node")).distinct()
        frontier = cut(step.hint("merge").join(seen, ["question_id", "node"], "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def _neighbours(edges: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """(src, dst): of each of asked (src; a written table) its `limit` smallest neighbours. Other nodes' edges are left where they are read."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    # few nodes are sent to all tasks, so that other edges are never shuffled
    few = asked.limit(HELD_NODES + 1).count() <= HELD_NODES
    own = both.join(F.broadcast(asked), "src", "left_semi") if few else both.hint("merge").join(asked, "src", "left_semi")
    ranked = own.distinct().withColumn("r", F.row_number().over(W.partitionBy("src").orderBy("dst")))
    return ranked.where(F.col("r") <= limit).select("src", "dst")


def answer_confidence(n_support: Column, n_evidence: Column, mean_link: Column, fallback: Column, disputed: Column) -> Column:
    raw = F.least(n_support / 10, F.lit(1.0)) * 0.35 + F.least(n_evidence / 5, F.lit(1.0)) * 0.25 + mean_link * 0.30
    raw = raw - fallback.cast("int") * 0.15 - disputed.cast("int") * 0.25
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def manager_edges(employees: DataFrame) -> DataFrame:
    """(manager_id, employee_id, known) from employees (employee_id, manager_id); managers who aren't listed are kept, not known."""
    managers = employees.select(F.col("employee_id").alias("manager_id"), F.lit(True).alias("known"))
    out = employees.where("manager_id is not null").join(managers, "manager_id", "left")
    return out.select("manager_id", "employee_id", F.coalesce("known", F.lit(False)).alias("known"))


def org_graph(employees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of a directory: employees (collection, employee_id, name, work_email, manager_employee_id).

    Edges are `manages`, with context and known (whether the manager is in the directory). A manager who isn't is the source
    of the edge under an id of its own, and no entity. Of rows with one employee_id the one with the least address is the
    manager meant.
    """
    own = F.concat(F.lit("entity-"), stable_id(F.lit("org"), "collection", "work_email"))
    document = F.concat(F.lit("org-directory:"), "collection")
    entities = employees.select(
        own.alias("id"), F.col("name").alias("canonical_name"), F.lit("Person").alias("entity_type"), F.array("name", "work_email").alias("aliases"), "employee_id",
        document.alias("source_doc_id"), F.lit(0.9).alias("confidence"), F.lit("candidate").alias("state"), F.lit("internal").alias("access_level"),
    )
    heads = employees.groupBy("collection", F.col("employee_id").alias("manager_employee_id")).agg(F.min(F.struct("work_email", "name")).alias("m"))
    led = employees.where("manager_employee_id <> ''").hint("merge").join(heads, ["collection", "manager_employee_id"], "left")
    known = F.col("m").isNotNull()
    source = F.when(known, stable_id(F.lit("org"), "collection", "m.work_email")).otherwise(stable_id(F.lit("org"), "collection", F.lit("person"), "manager_employee_id"))
    context = F.concat(F.coalesce("m.name", "manager_employee_id"), F.lit(" manages "), "name", F.when(known, "").otherwise(" (manager not in directory)"))
    edges = led.select(F.concat(F.lit("entity-"), source).alias("src"), F.lit("manages").alias("predicate"), own.alias("dst"), context.alias("context"), document.alias("source_doc_id"), known.alias("known"))
    return entities, edges


def org_summary(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entities_created, edges_created, skipped_missing_manager."""
    return entities.agg(F.count("*").alias("entities_created")).crossJoin(edges.agg(F.count("*").alias("edges_created"), F.count_if(~F.col("known")).alias("skipped_missing_manager")))


def accuracy(results: DataFrame) -> DataFrame:
    """Strict and partial-credit accuracy by category and overall (category null) of results (category, score_value)."""
    return results.rollup("category").agg(F.count("*").alias("n"), F.avg((F.col("score_value") == 1).cast("double")).alias("strict"), F.avg("score_value").alias("partial"))
