"""Evaluation over tables of questions and judged answers: what can be answered, how much is, and comparisons of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.scalars import score_value, score_word
from kgspark.operators.graph import accuracy

#: Configurations of an ablation and what each switches off; questions of a calibration sample.
CONFIGURATIONS = {
    "full_system": {}, "no_entity_resolution": {"ignore_entity_merges": True}, "no_graph_reasoning": {"disable_graph_reasoning": True},
    "no_abstention": {"disable_abstention": True},
}
SAMPLE = 40


def answerable(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """The questions (question_id, ground_truth_doc_ids ..) of whose documents at least one is in documents (source_id)."""
    wanted = questions.select("question_id", F.explode("ground_truth_doc_ids").alias("source_id"))
    known = documents.where("source_id <> ''").select(F.col("source_id").cast("string").alias("source_id")).distinct()
    found = wanted.hint("merge").join(known, "source_id", "left_semi").select(F.col("question_id").alias("found")).distinct()
    return questions.hint("merge").join(found, questions["question_id"] == found["found"], "left_semi")


def coverage(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: total_questions, answerable_questions, coverage (0 without questions)."""
    total = questions.agg(F.count("*").alias("total_questions"))
    some = answerable(questions, documents).agg(F.count("*").alias("answerable_questions"))
    share = F.when(F.col("total_questions") > 0, F.col("answerable_questions") / F.col("total_questions")).otherwise(0.0)
    return total.crossJoin(some).withColumn("coverage", share)


def abstention_rate(results: DataFrame) -> DataFrame:
    """One row: questions, abstentions, rate (0 without questions) of results (abstained; null is false)."""
    out = results.agg(F.count("*").alias("questions"), F.count_if(F.coalesce("abstained", F.lit(False))).alias("abstentions"))
    return out.withColumn("rate", F.when(F.col("questions") > 0, F.col("abstentions") / F.col("questions")).otherwise(0.0))


def evidence_ids(evidence: Column, packet_ids: Column) -> Column:
    """The ids that an answer names, without empty ones, or its packet's where it names none."""
    full = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(F.coalesce(evidence, F.array().cast("array<string>"))) > 0, full(evidence)).otherwise(full(packet_ids))


def judged(answers: DataFrame, score_col: str = "score") -> DataFrame:
    """answers with a valid score word and its score_value."""
    word = score_word(F.col(score_col))
    return answers.withColumns({score_col: word, "score_value": score_value(word)})


def comparison(results: DataFrame, metric: str = "strict", configurations: list[str] | None = None) -> DataFrame:
    """category (overall last) and one column for each configuration with its accuracy, 0 where a category has none.

    results: config, category, score_value. metric: strict or partial.
    """
    names = list(CONFIGURATIONS) if configurations is None else configurations
    value = (F.col("score_value") == 1).cast("double") if metric == "strict" else F.col("score_value")
    cells = [F.coalesce(F.avg(F.when(F.col("config") == c, value)), F.lit(0.0)).alias(c) for c in names]
    return results.rollup("category").agg(F.grouping("category").alias("whole"), *cells).select(F.when(F.col("whole") == 1, "overall").otherwise(F.col("category")).alias("category"), *names)


def sample_of(questions: DataFrame, n: int, order: str = "position") -> DataFrame:
    """The first n questions in order: the one sample that all configurations answer."""
    return questions.orderBy(order).limit(n)


def calibration_sample(questions: DataFrame, answers: DataFrame, n: int = SAMPLE, order: str = "position") -> DataFrame:
    """question_id, confidence, label (1 if judged yes) of the first n questions that have a question and a gold answer.

    answers: question_id, confidence, score. Questions without an answer are left out.
    """
    full = questions.where("coalesce(question, '') <> '' and coalesce(gold_answer, '') <> ''")
    sample = sample_of(full, n, order).select(F.col("question_id").alias("own"))
    found = answers.join(F.broadcast(sample), answers["question_id"] == sample["own"])  # n rows
    label = (score_word(F.col("score")) == "yes").cast("int")
    return found.select("question_id", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), label.alias("label"))


def system_report(results: DataFrame) -> DataFrame:
    """accuracy by category and overall, with abstentions. results: category, score_value, abstained."""
    counted = results.rollup("category").agg(F.count_if(F.coalesce("abstained", F.lit(False))).alias("abstentions"))
    own = accuracy(results)
    counted = counted.withColumnRenamed("category", "own_category")
    return own.join(counted, own["category"].eqNullSafe(counted["own_category"])).drop("own_category")


def understanding(raw: DataFrame) -> DataFrame:
    """question_id, question, mentions, intent, time_scope of raw model output (question_id, question, target_entity_mentions,
    intent, time_scope): unknown intents are lookup, an unknown scope follows from the intent, blank mentions are dropped, and
    a question without any is its own mention."""
    intent = F.lower(F.coalesce(F.nullif("intent", F.lit("")), F.lit("lookup")))
    intent = F.when(intent.isin("lookup", "causal", "temporal", "completeness"), intent).otherwise("lookup")
    scope = F.lower(F.coalesce(F.nullif("time_scope", F.lit("")), F.lit("current")))
    scope = F.when(scope.isin("current", "historical"), scope).when(intent == "temporal", "historical").otherwise("current")
    kept = F.filter(F.transform(F.coalesce("target_entity_mentions", F.array().cast("array<string>")), lambda m: F.trim(F.coalesce(m, F.lit("")))), lambda m: m != "")
    mentions = F.when(F.size(kept) > 0, kept).otherwise(F.array("question"))
    return raw.select("question_id", "question", mentions.alias("mentions"), intent.alias("intent"), scope.alias("time_scope"))
