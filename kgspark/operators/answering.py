"""Answers to a table of questions up to the decision: mentions linked to entities, evidence, confidence, abstention; calibration."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.scalars import visible_to
from kgspark.operators.graph import answer_confidence, expand
from kgspark.operators.name_search import nearest_names
from kgspark.operators.packets import fallback_links
from kgspark.shared import cut

#: Link and abstention thresholds, target probability of the calibration.
LINK, ABSTAIN, TARGET = 0.75, 0.4, 0.6


def link_mentions(mentions: DataFrame, entities: DataFrame, threshold: float = LINK) -> DataFrame:
    """mentions (question_id, mention) with entity_id and score of the best entity (id, aliases), or null and 0.

    Equal names are linked by key, the other distinct mentions through name_search's index: only aliases that share enough of a
    mention's rarest letters are compared with it. Ties go to the smaller id. Null and blank mentions have no anchor; an empty
    table of either gives no links.
    """
    tidy = lambda c: F.lower(F.trim(c))
    asked = mentions.select(tidy(F.col("mention")).alias("m")).where("m <> ''").distinct()
    names = entities.select("id", F.explode("aliases").alias("alias")).select(tidy(F.col("alias")).alias("alias"), "id").where("alias <> ''")
    names = cut(names.groupBy("alias").agg(F.min("id").alias("entity_id")), "names")
    exact = cut(asked.hint("merge").join(names, F.col("m") == F.col("alias")).select("m", "entity_id", F.lit(1.0).alias("score")), "exact")
    rest = asked.hint("merge").join(exact, "m", "left_anti")
    best = exact.unionByName(nearest_names(rest, names, threshold))
    out = mentions.hint("merge").join(best, tidy(F.col("mention")) == F.col("m"), "left")
    return out.select("question_id", "mention", "entity_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def facts_in_scope(visited: DataFrame, facts: DataFrame, role: str, historical: bool = False) -> DataFrame:
    """(question_id and the columns of facts) of visited nodes (question_id, node): current ones that the role may see, with
    superseded ones too if historical."""
    states = ["current", *["superseded"] * historical]
    seen = facts.where(F.col("state").isin(states) & visible_to(F.col("access_level"), F.lit(role)))
    return visited.select("question_id", F.col("node").alias("subject_id")).distinct().join(seen, "subject_id")


def decide_answers(links: DataFrame, facts: DataFrame, edges: DataFrame, threshold: float = ABSTAIN) -> DataFrame:
    """One row for each question of links: n_facts, n_edges, n_evidence, mean_link, confidence, abstained.

    links: question_id, entity_id, score, fallback; facts: question_id, source_doc_id, state; edges: question_id,
    source_doc_id. Abstained: confidence below the threshold, or no facts.
    """
    linked = links.groupBy("question_id").agg(
        F.coalesce(F.avg(F.when(F.col("entity_id").isNotNull(), F.col("score"))), F.lit(0.0)).alias("mean_link"), F.coalesce(F.bool_or("fallback"), F.lit(False)).alias("fallback")
    )
    found = facts.groupBy("question_id").agg(F.count("*").alias("n_facts"), F.bool_or(F.col("state") == "disputed").alias("disputed"))
    walked = edges.groupBy("question_id").agg(F.count("*").alias("n_edges"))
    sources = facts.select("question_id", "source_doc_id").unionByName(edges.select("question_id", "source_doc_id")).where("source_doc_id is not null")
    evidence = sources.groupBy("question_id").agg(F.count_distinct("source_doc_id").alias("n_evidence"))
    out = linked
    for part in (found, walked, evidence):
        out = out.join(part, "question_id", "left")
    out = out.fillna(0, ["n_facts", "n_edges", "n_evidence"]).fillna(False, ["disputed"])
    n_support, fallback, disputed = F.col("n_facts") + F.col("n_edges"), F.col("fallback"), F.col("disputed")
    out = out.withColumn("confidence", answer_confidence(n_support, F.col("n_evidence"), F.col("mean_link"), fallback, disputed))
    abstained = (F.col("confidence") < threshold) | (F.col("n_facts") == 0)
    return out.select("question_id", "n_facts", "n_edges", "n_evidence", "mean_link", "confidence", abstained.alias("abstained"))


def walked_edges(visited: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(question_id and the columns of edges) of edges from a visited node (question_id, node, hop) that was passed on, hop below
    hops, to a visited one; each different edge once for a question."""
    ends = edges.select("*", F.explode(F.array(F.struct(F.col("src").alias("near"), F.col("dst").alias("far")), F.struct(F.col("dst").alias("near"), F.col("src").alias("far")))).alias("e"))
    ends = ends.select(*edges.columns, F.col("e.near").alias("node"), "e.far")
    passed = visited.where(F.col("hop") < hops).select("question_id", "node").distinct()
    reached = visited.select("question_id", F.col("node").alias("far")).distinct()
    met = ends.hint("merge").join(passed, "node").hint("merge").join(reached, ["question_id", "far"], "left_semi")
    return met.select("question_id", *edges.columns).distinct()


def with_fallback(links: DataFrame, questions: DataFrame, found: DataFrame, entities: DataFrame) -> DataFrame:
    """links (question_id, mention, entity_id, score, fallback), where those of a question without any entity are replaced by the one
    of fallback_links, if there is one; its mention is null."""
    links = cut(links, "plain-links")
    lost = links.groupBy("question_id").agg(F.bool_and(F.col("entity_id").isNull()).alias("lost")).where("lost").select("question_id")
    asked = questions.hint("merge").join(lost, "question_id", "left_semi")
    other = cut(fallback_links(asked, found.hint("merge").join(lost, "question_id", "left_semi"), entities), "fallback-links")
    kept = links.hint("merge").join(other.select("question_id"), "question_id", "left_anti")
    return kept.unionByName(other.withColumn("mention", F.lit(None).cast("string")))


def answer(
    mentions: DataFrame, entities: DataFrame, facts: DataFrame, edges: DataFrame, role: str, historical: bool = False,
    hops: int = 2, limit: int = 50, link: float = LINK, threshold: float = ABSTAIN, questions: DataFrame | None = None, found: DataFrame | None = None,
) -> DataFrame:
    """decide_answers for all questions of mentions in one job: links, expansion, facts that the role may see, decision.

    Edges (src, dst, predicate, source_doc_id) with predicate HAS_STATE are bookkeeping and left out. A question whose mentions
    have no entity abstains with confidence 0; one without any row in mentions has no row. With questions (question_id, question) and
    found, the documents that retrieval found for them (question_id, doc_id), such a question starts from an entity of those
    documents instead (entities need source_doc_id), at lower confidence.
    """
    links = link_mentions(mentions, entities, link).withColumn("fallback", F.lit(False))
    links = cut(links if questions is None or found is None else with_fallback(links, questions, found, entities), "links")
    seeds = links.where("entity_id is not null").select("question_id", F.col("entity_id").alias("node"))
    edges = edges.where(F.upper(F.trim(F.coalesce("predicate", F.lit("")))) != "HAS_STATE")
    visited = cut(expand(seeds, edges, hops, limit), "visited")
    in_scope = facts_in_scope(visited, facts, role, historical).select("question_id", "source_doc_id", "state")
    walked = walked_edges(visited, edges.select("src", "dst", "predicate", "source_doc_id"), hops)
    return decide_answers(links, in_scope, walked, threshold)


def threshold_for_target(coefficient: float, intercept: float, target: float = TARGET) -> float:
    """The least confidence in [0, 1] at which the model's probability is the target or more; 1 where there is none, or where
    confidence makes no difference."""
    lowest, highest = 1 / (1 + np.exp(-(intercept + coefficient * np.array([0.0, 1.0]))))
    if np.isclose(coefficient, 0.0, rtol=0, atol=1e-9):
        return 1.0
    if lowest >= target:
        return 0.0
    # between the ends the probability moves one way only, so that it reaches the target once or not at all
    return float((np.log(target / (1 - target)) - intercept) / coefficient) if highest >= target else 1.0


def calibrate(judged: DataFrame, target: float = TARGET) -> dict:
    """coefficient, intercept, accuracy, threshold of a logistic model of label (0 or 1) by confidence; L2 penalty of weight 1.

    Rows with a null are left out. Where all labels are equal, or there are none, the model is constant.
    """
    rows = judged.select(F.col("confidence").cast("double").alias("confidence"), F.col("label").cast("double").alias("label")).dropna()
    seen = rows.agg(F.count("*").alias("n"), F.avg("label").alias("rate")).first()
    n, rate = seen["n"], seen["rate"] or 0.0
    if rate in (0.0, 1.0):
        return {"coefficient": 0.0, "intercept": 10.0 if rate else -10.0, "accuracy": rate, "threshold": 0.0 if rate >= target else 1.0}
    model = LogisticRegression(regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9)
    model = model.fit(VectorAssembler(inputCols=["confidence"], outputCol="features").transform(rows))
    coefficient, intercept = float(model.coefficients[0]), float(model.intercept)
    return {"coefficient": coefficient, "intercept": intercept, "accuracy": rate, "threshold": threshold_for_target(coefficient, intercept, target)}
