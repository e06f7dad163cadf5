"""Conflict cascade over facts (id, subject_id, predicate, value, valid_from, source_doc_id, doc_source_type): which fact of a
group is current. Groups are only ever aggregated, so that one of any size is no task of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.scalars import OPEN_END, normalize_value
from kgspark.operators.value_leaders import lead
from kgspark.shared import cut

#: Weight by source type and predicate, `*` for any other, and what holds without an entry.
WEIGHTS = [("github", "status", 0.9), ("github", "*", 0.7), ("jira", "status", 0.85), ("jira", "*", 0.6), ("gmail", "*", 0.4), ("fireflies", "*", 0.5)]
DEFAULT_WEIGHT, MARGIN = 0.3, 0.15
#: Rows by set of source types up to which truth discovery iterates on the driver; more are iterated by Spark, to the same end.
MAX_SETS = 10_000
#: Sources up to which their reliabilities are broadcast in a round.
FEW_SOURCES = 100_000
#: About so many sources of a claim stand in one row; a claim of more has several rows.
CHUNK = 64
GROUP = ["subject_id", "predicate"]


def with_authority(facts: DataFrame, weights: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """facts with authority_weight by (source type, predicate), else by source type, else the default."""
    out, default = F.lit(None).cast("double"), F.lit(None).cast("double")
    for kind, predicate, weight in WEIGHTS if weights is None else weights:
        if predicate == "*":
            default = F.when(F.col("doc_source_type") == kind, weight).otherwise(default)
        else:
            out = F.when((F.col("doc_source_type") == kind) & (F.lower("predicate") == predicate), weight).otherwise(out)
    return facts.withColumn("authority_weight", F.coalesce(out, default, F.lit(DEFAULT_WEIGHT)))


def decide(facts: DataFrame, margin: float = MARGIN) -> DataFrame:
    """One row for each (subject_id, predicate): method, current_id (null if disputed), n_facts.

    facts needs authority_weight. Rules in order: single; authority (the best weight leads the next by more than margin);
    corroboration (one value has more independent documents than any other); disputed (two facts, two values); recency.
    Facts with a null or empty subject or predicate are dropped; ties go to the smaller id.
    """
    live = facts.where("subject_id <> '' and predicate <> ''").withColumn("bucket", F.coalesce(normalize_value(F.col("value").cast("string")), F.lit("")))
    by_weight = live.groupBy(*GROUP, "authority_weight").agg(
        F.count("*").alias("n"), F.min("id").alias("id"), F.max(F.struct("valid_from", "id")).alias("_"),
        F.min_by("id", F.struct(-F.col("valid_from"), F.col("id"))).alias("latest"), F.max("valid_from").alias("valid_from"),
    )
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("authority_weight", "n", "id"))))  # a few weights a group
    groups = by_weight.groupBy(*GROUP).agg(
        F.sum("n").alias("n_facts"), ranked.alias("ranked"), F.min_by("latest", F.struct(-F.col("valid_from"), F.col("latest"))).alias("latest")
    )
    top, after = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    lead = F.when(top["n"] > 1, 0.0).otherwise(top["authority_weight"] - after["authority_weight"])
    groups = groups.select(*GROUP, "n_facts", "latest", top["id"].alias("strongest"), lead.alias("lead"))
    sources = F.count_distinct(F.nullif(F.col("source_doc_id").cast("string"), F.lit("")))
    buckets = live.groupBy(*GROUP, "bucket").agg(
        F.when(sources > 0, sources).otherwise(F.count("*")).alias("support"), F.max_by("id", F.struct("authority_weight", "valid_from", "id")).alias("pick")
    )
    level = buckets.groupBy(*GROUP, "support").agg(F.count("*").alias("n"), F.min("pick").alias("pick"))
    best = level.groupBy(*GROUP).agg(F.max_by(F.struct("n", "pick"), "support").alias("best"), F.sum("n").alias("n_buckets"))
    both = groups.join(best, GROUP)
    method = (
        F.when(F.col("n_facts") == 1, "single").when(F.col("lead") > margin, "authority").when(F.col("best.n") == 1, "corroboration")
        .when((F.col("n_facts") == 2) & (F.col("n_buckets") == 2), "disputed").otherwise("recency")
    )
    current = F.when(method.isin("single", "authority"), F.col("strongest")).when(method == "corroboration", F.col("best.pick")).when(method == "recency", F.col("latest"))
    return both.select(*GROUP, method.alias("method"), current.alias("current_id"), "n_facts")


def last_write_wins(facts: DataFrame) -> DataFrame:
    """As decide, by the latest valid_from and then the largest id alone."""
    live = facts.where("subject_id <> '' and predicate <> ''")
    out = live.groupBy(*GROUP).agg(F.count("*").alias("n_facts"), F.max_by("id", F.struct("valid_from", "id")).alias("current_id"))
    return out.select(*GROUP, F.when(F.col("n_facts") == 1, "single").otherwise("last_write_wins").alias("method"), "current_id", "n_facts")


def apply_decisions(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """facts with state, superseded_by and an open end of validity where there is none."""
    joined = facts.hint("merge").join(decisions.select(*GROUP, "method", "current_id"), GROUP, "left")
    state = (
        F.when(F.col("method").isNull(), "candidate").when(F.col("method") == "disputed", "disputed")
        .when(F.col("id") == F.col("current_id"), "current").otherwise("superseded")
    )
    end = F.col("valid_to") if "valid_to" in facts.columns else F.lit(None).cast("long")
    loser = F.when(state == "superseded", F.col("current_id"))
    return joined.withColumns({"state": state, "superseded_by": loser, "valid_to": F.coalesce(end, F.lit(OPEN_END))}).drop("method", "current_id")


def value_buckets(facts: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(subject_id, predicate, value_key, bucket): each different normalised value of a group and the value that leads its bucket.

    In the order of their first facts (valid_from, id), a value joins the first leader that it equals, or whose ratio to it
    is the threshold or more, and else leads a bucket of its own. Values are compared and settled in parallel, so that a group
    of any size is split over tasks. Empty values are one bucket.
    """
    key = F.coalesce(normalize_value(F.col("value").cast("string")), F.lit(""))
    values = facts.where("subject_id <> '' and predicate <> ''").groupBy(*GROUP, key.alias("value_key")).agg(F.min(F.struct("valid_from", "id")).alias("first"))
    values = values.withColumn("first", F.struct("first.valid_from", "first.id", "value_key")).withColumn("node", F.monotonically_increasing_id())
    values = cut(values, "values")
    group = F.to_json(F.array(*[F.col(c).cast("string") for c in GROUP]))
    found = lead(values.where("value_key <> ''").select("node", group.alias("group"), F.col("value_key").alias("value"), "first"), threshold)
    out = values.hint("merge").join(found, "node", "left")
    return out.select(*GROUP, "value_key", F.coalesce("leader", "value_key").alias("bucket"))


def with_similar_buckets(facts: DataFrame, threshold: float = 0.92) -> DataFrame:
    """facts with the normalised value that leads their bucket in place of their value."""
    found = cut(value_buckets(facts, threshold), "buckets").select(*[F.col(c).alias(f"own_{c}") for c in GROUP], "value_key", "bucket")
    key = F.coalesce(normalize_value(F.col("value").cast("string")), F.lit(""))
    same = (facts["subject_id"] == found["own_subject_id"]) & (facts["predicate"] == found["own_predicate"]) & (key == found["value_key"])
    out = facts.hint("merge").join(found, same, "left")
    return out.withColumn("value", F.coalesce("bucket", facts["value"].cast("string"))).select(*facts.columns)


def with_corroboration(facts: DataFrame) -> DataFrame:
    """facts with corroboration_count: the different source documents behind their value in its group, the facts where none has one."""
    bucket = F.coalesce(normalize_value(F.col("value").cast("string")), F.lit(""))
    sources = F.count_distinct(F.nullif(F.col("source_doc_id").cast("string"), F.lit("")))
    live = facts.drop("corroboration_count").withColumn("value_bucket", bucket)
    support = live.groupBy(*GROUP, "value_bucket").agg(F.when(sources > 0, sources).otherwise(F.count("*")).alias("corroboration_count"))
    return live.hint("merge").join(support, [*GROUP, "value_bucket"], "left").drop("value_bucket")


def _types(facts: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(F.lower("doc_source_type"), F.lit("")), F.lit("unknown"))
    return facts.withColumn("doc_source_type", kind)


def with_learned_authority(facts: DataFrame, reliability: dict[str, float], unseen: float = 0.5) -> DataFrame:
    """facts with the learned reliability of their source type as authority_weight."""
    kind = F.coalesce(F.nullif(F.lower("doc_source_type"), F.lit("")), F.lit("unknown"))
    held = [x for pair in sorted(reliability.items()) for x in map(F.lit, pair)]
    found = F.try_element_at(F.create_map(*held), kind) if held else F.lit(None).cast("double")
    return facts.withColumn("authority_weight", F.coalesce(found, F.lit(unseen)))


def learned_against_fixed(spark: SparkSession, reliability: dict[str, float], weights: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """(doc_source_type, fixed, learned) of each source type; fixed is the weight for any predicate, or the default."""
    fixed = {kind: w for kind, predicate, w in (WEIGHTS if weights is None else weights) if predicate == "*"}
    rows = [(kind, float(fixed.get(kind, DEFAULT_WEIGHT)), float(x)) for kind, x in sorted(reliability.items())]
    return spark.createDataFrame(rows, "doc_source_type string, fixed double, learned double")


def resolve_conflicts(facts: DataFrame, disabled: bool = False, reliability: dict[str, float] | None = None, similar: bool = False) -> DataFrame:
    """facts with authority_weight, corroboration_count, state, superseded_by and valid_to: the whole cascade.

    disabled: the latest fact wins and weights stay. reliability: learned weights in place of the fixed ones. similar: values
    count as equal as value_buckets says.
    """
    weighed = facts if disabled else with_authority(facts) if reliability is None else with_learned_authority(facts, reliability)
    alike = with_similar_buckets(weighed) if similar else weighed
    decisions = cut(last_write_wins(alike) if disabled else decide(alike), "decisions")
    if disabled:
        return apply_decisions(weighed, decisions)
    counted = with_corroboration(alike).select(F.col("id").alias("own_id"), "corroboration_count")
    weighed = weighed.drop("corroboration_count").hint("merge").join(counted, F.col("id") == F.col("own_id"), "left").drop("own_id")
    return apply_decisions(weighed, decisions)


def redecide(facts: DataFrame, batch: DataFrame) -> DataFrame:
    """Of facts (with those of batch in them) the ones of groups that batch touches, decided anew; other groups are not read again."""
    touched = batch.select(*GROUP).distinct()
    return resolve_conflicts(facts.hint("merge").join(touched, GROUP, "left_semi"))


def method_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("method").agg(F.count("*").alias("n"))


def latest_facts(facts: DataFrame, n: int = 12) -> DataFrame:
    """The n facts that hold from the latest time, of equals those with the largest id."""
    return facts.orderBy(F.desc("valid_from"), F.desc("id")).limit(n)


def fact_summaries(facts: DataFrame) -> DataFrame:
    return facts.select("id", *GROUP, "value", "source_doc_id", "doc_source_type", "valid_from", "authority_weight")


def discover_truth(facts: DataFrame, rounds: int = 8, delta: float = 0.01, start: float = 0.5) -> list[dict]:
    """Reliability of each source type by round: the mean confidence of its claims, a claim's confidence being the noisy-or of
    the reliabilities of the distinct source types behind it.

    Facts are aggregated once to (set of source types, number of claims of each); the rounds run on that. A missing source type
    is unknown. No facts: one round without types.
    """
    facts = _types(facts)
    bucket = F.coalesce(normalize_value(F.col("value").cast("string")), F.lit(""))
    claims = facts.where("subject_id <> '' and predicate <> ''").groupBy(*GROUP, bucket.alias("bucket"), "doc_source_type").agg(F.count("*").alias("n"))
    kinds = claims.groupBy(*GROUP, "bucket").agg(F.array_sort(F.collect_list(F.struct("doc_source_type", "n"))).alias("kinds"))
    names = kinds.withColumn("types", F.transform("kinds", lambda k: k["doc_source_type"])).select("types", F.inline("kinds"))
    sets = cut(names.groupBy("types", "doc_source_type").agg(F.sum("n").alias("n")), "sets")
    rows = sets.limit(MAX_SETS + 1).collect()
    if len(rows) > MAX_SETS:
        found = truth_rounds(sets.select(F.col("types").alias("claim"), F.col("doc_source_type").alias("source"), "n"), rounds, delta, start)
        return [dict(r["held"]) for r in found.groupBy("round").agg(F.map_from_entries(F.collect_list(F.struct("source", "reliability"))).alias("held")).orderBy("round").collect()]
    weight = {r["doc_source_type"]: start for r in rows}
    history = [dict(weight)]
    for _ in range(rounds):
        total: dict[str, float] = dict.fromkeys(weight, 0.0)
        count: dict[str, int] = dict.fromkeys(weight, 0)
        for r in rows:
            doubt = 1.0
            for kind in r["types"]:
                doubt *= 1 - weight[kind]
            total[r["doc_source_type"]] += r["n"] * min(max(1 - doubt, 0.0), 1.0)
            count[r["doc_source_type"]] += r["n"]
        new = {k: total[k] / count[k] for k in weight}
        moved = max((abs(new[k] - weight[k]) for k in weight), default=0.0)
        weight = new
        history.append(dict(weight))
        if moved < delta:
            break
    return history


def claims_of(facts: DataFrame, source: str = "source_doc_id") -> DataFrame:
    """(claim, source, n) of facts: how often each source states each value of a group. Facts without subject, predicate or source are left out."""
    bucket = F.coalesce(normalize_value(F.col("value").cast("string")), F.lit(""))
    stated = facts.where("subject_id <> '' and predicate <> ''").where(F.col(source).cast("string") != "")
    return stated.groupBy(F.struct(*GROUP, bucket.alias("bucket")).alias("claim"), F.col(source).alias("source")).agg(F.count("*").alias("n"))


def truth_rounds(claims: DataFrame, rounds: int = 8, delta: float = 0.01, start: float = 0.5) -> DataFrame:
    """(round, source, reliability) of claims (claim, source, n; one row for each claim and source), any number of either.

    Round 0 is start for each source. A claim's confidence is the noisy-or of its sources' reliabilities, a source's next
    reliability the mean confidence of its claims, each counted n times. It ends after so many rounds, or with the first in which
    no reliability moves by delta or more. Nulls are dropped and an empty table gives an empty result.

    Of up to FEW_SOURCES sources claims are gathered once, in rows of about CHUNK sources, and a round shuffles only the rows of
    claims that have several, and sums by source. Otherwise each round is two aggregations. Each writes its reliabilities.
    """
    claims = cut(claims.where("claim is not null and source is not null and n > 0").select("claim", "source", "n"), "claims")
    held = cut(claims.groupBy("source").agg(F.sum("n").alias("total")).withColumn("reliability", F.lit(float(start))), "reliability")
    few = held.count() <= FEW_SOURCES
    if few:  # the rows of one broadcast
        held = cut(held.withColumn("place", F.row_number().over(W.orderBy("source"))), "reliability")
    key = "place" if few else "source"
    every = held.select(F.lit(0).alias("round"), "source", "reliability")
    chunks, single = _chunks(claims, held) if few else (None, True)
    for i in range(1, rounds + 1):
        told = _told_by_chunks(chunks, single, held) if few else _told(claims, held)
        nxt = held.withColumnRenamed("reliability", "before").hint("merge").join(told, key)
        held = cut(nxt.select(*dict.fromkeys(("source", key)), "total", F.col("before"), (F.col("sum") / F.col("total")).alias("reliability")), "reliability")
        every = every.union(held.select(F.lit(i).alias("round"), "source", "reliability"))
        moved = held.agg(F.max(F.abs(F.col("reliability") - F.col("before")))).first()[0]
        held = held.drop("before")
        if moved is None or moved < delta:
            break
    return every


def _sure(doubt: str) -> Column:
    return F.least(F.greatest(1 - F.col(doubt), F.lit(0.0)), F.lit(1.0))


def _told(claims: DataFrame, held: DataFrame) -> DataFrame:
    """(source, sum): the confidence of each source's claims, each counted n times."""
    weighed = claims.hint("merge").join(held.select("source", "reliability"), "source")
    doubt = weighed.groupBy("claim").agg(F.product(1 - F.col("reliability")).alias("doubt"))
    return claims.hint("merge").join(doubt, "claim").groupBy("source").agg(F.sum(F.col("n") * _sure("doubt")).alias("sum"))


def _chunks(claims: DataFrame, held: DataFrame) -> tuple[DataFrame, bool]:
    """((claim, told: place and n), whether each claim is one row): claims in rows of about CHUNK sources, dealt by hash."""
    numbers = held.count()
    told = F.collect_list(F.struct("place", "n")).alias("told")
    claims = claims.join(F.broadcast(held.select("source", "place")), "source")
    if numbers <= CHUNK:  # no claim can have more
        return cut(claims.groupBy("claim").agg(told).select("told"), "chunks"), True
    part = F.pmod(F.xxhash64("place"), F.lit(-(-numbers // CHUNK)))
    sizes = claims.groupBy("claim").agg(F.count("*").alias("size")).where(F.col("size") > CHUNK)
    large = cut(sizes, "large-claims")
    if large.isEmpty():
        return cut(claims.groupBy("claim").agg(told).select("told"), "chunks"), True
    marked = claims.hint("merge").join(large, "claim", "left")
    marked = marked.withColumn("part", F.when(F.col("size").isNotNull(), part))
    return cut(marked.groupBy("claim", "part").agg(told, F.first("size").alias("size")).drop("part"), "chunks"), False


def _told_by_chunks(chunks: DataFrame, single: bool, held: DataFrame) -> DataFrame:
    """(place, sum) as of _told, of rows that have several sources each; the reliabilities are one broadcast row, in order of place."""
    known = F.array_sort(F.collect_list(F.struct("place", "reliability")))
    known = held.agg(known.alias("known")).select(F.col("known.reliability").alias("known"))
    doubt = F.aggregate("told", F.lit(1.0), lambda acc, t: acc * (1 - F.element_at("known", t["place"])))
    rows = chunks.crossJoin(F.broadcast(known)).withColumn("doubt", doubt).drop("known")
    if not single:
        several = rows.where("size is not null")
        whole = several.groupBy("claim").agg(F.product("doubt").alias("doubt"))
        several = several.drop("doubt").hint("merge").join(whole, "claim").select("told", "doubt")
        rows = rows.where("size is null").select("told", "doubt").union(several)
    return rows.select("doubt", F.inline("told")).groupBy("place").agg(F.sum(F.col("n") * _sure("doubt")).alias("sum"))
