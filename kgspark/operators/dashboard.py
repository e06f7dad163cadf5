"""Views of a collection of stored records: counts, status, record browser, activity, suggestions.

records have id, fields (a map of texts: the record's own fields), metadata and additional (maps of texts). A field of
metadata counts before one of additional, and both before the record's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.scalars import comparable_time, display_title


def _get(column: str, name: str) -> Column:
    return F.nullif(F.try_element_at(column, F.lit(name)), F.lit(""))


def merged(name: str) -> Column:
    return F.coalesce(_get("metadata", name), _get("additional", name))


def value_of(name: str) -> Column:
    return F.coalesce(merged(name), _get("fields", name))


def record_type() -> Column:
    """record_type or type of the metadata, else record_type, type or kind of the record; trimmed, lower case, else empty."""
    own = [_get("fields", n) for n in ("record_type", "type", "kind")]
    return F.lower(F.trim(F.coalesce(merged("record_type"), merged("type"), *own, F.lit(""))))


def title_of() -> Column:
    return display_title(*[c for n in ("title", "subject", "name", "summary", "text", "question") for c in (merged(n), _get("fields", n))])


def time_of() -> Column:
    return F.coalesce(value_of("created_at"), value_of("txn_from"))


def dashboard(records: DataFrame) -> DataFrame:
    """One row: documents, entities, facts, relations, pending_merges, disputed_facts, latest (time as it stands)."""
    kind, state = record_type(), F.lower(F.trim(F.coalesce(value_of("state"), F.lit(""))))
    document = F.coalesce(F.nullif(F.trim(value_of("source_doc_id")), F.lit("")), F.when(kind == "document", F.nullif(F.col("id"), F.lit(""))))
    when = time_of()
    return records.select(kind.alias("kind"), state.alias("state"), document.alias("document"), when.alias("time")).agg(
        F.count_distinct("document").alias("documents"), *[F.count_if(F.col("kind") == k).alias(n) for k, n in (("entity", "entities"), ("factstate", "facts"), ("relation", "relations"))],
        F.count_if((F.col("kind") == "candidatemerge") & (F.col("state") == "pending")).alias("pending_merges"),
        F.count_if((F.col("kind") == "factstate") & (F.col("state") == "disputed")).alias("disputed_facts"),
        F.max_by(F.when(F.col("time").isNotNull(), F.col("time")), comparable_time(F.col("time"))).alias("latest"),
    )


def source_types(records: DataFrame) -> DataFrame:
    """(source_type, documents): each document under the source type of its first record (by id) that has one."""
    own = records.select(F.nullif(F.trim(value_of("source_doc_id")), F.lit("")).alias("document"), value_of("doc_source_type").alias("source_type"), "id")
    first = own.where("document is not null and source_type is not null").groupBy("document").agg(F.min_by("source_type", "id").alias("source_type"))
    return first.groupBy("source_type").agg(F.count("*").alias("documents"))


def facts_by_source(facts: DataFrame) -> DataFrame:
    """(doc_source_type, documents, facts, latest) of facts."""
    return facts.groupBy("doc_source_type").agg(F.count_distinct("source_doc_id").alias("documents"), F.count("*").alias("facts"), F.max("valid_from").alias("latest"))


def status(records: DataFrame) -> DataFrame:
    """One row: document_count, entity_count, fact_count of records that are no markers. A source_doc_id may name several
    documents, parted by `|`."""
    kind = record_type()
    marked = F.lower(F.coalesce(_get("additional", "system_marker"), F.lit(""))).isin("true", "1") | (F.coalesce("id", F.lit("")) == "__collection_init__")
    live = records.where(~marked)
    names = F.filter(F.transform(F.split(F.coalesce(merged("source_doc_id"), F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    names = F.when(F.size(names) > 0, names).when(kind == "document", F.array_compact(F.array(F.nullif(F.col("id"), F.lit(""))))).otherwise(names)
    documents = live.select(F.explode(names).alias("d")).agg(F.count_distinct("d").alias("document_count"))
    counts = live.agg(F.count_if(kind == "entity").alias("entity_count"), F.count_if(kind == "factstate").alias("fact_count"))
    return documents.crossJoin(counts)


def browse(records: DataFrame, query: str = "", kind: str = "") -> DataFrame:
    """id, title, record_type, source_type, access_level, confidence, created_at of records of a kind whose title holds query in
    any case, newest first."""
    own, title = record_type(), title_of()
    out = records.select(
        F.coalesce("id", F.lit("")).alias("id"), title.alias("title"), own.alias("record_type"), F.coalesce(value_of("doc_source_type"), F.lit("knowledge")).alias("source_type"),
        F.coalesce(value_of("access_level"), F.lit("public")).alias("access_level"), value_of("confidence").alias("confidence"), time_of().alias("created_at"),
    )
    if kind.strip():
        out = out.where(F.col("record_type") == kind.strip().lower())
    if query.strip():
        out = out.where(F.contains(F.lower("title"), F.lit(query.strip().lower())))
    named = F.when(F.col("title") != "", F.col("title")).otherwise(F.concat(F.coalesce(F.nullif("record_type", F.lit("")), F.lit("record")), F.lit(" record")))
    return out.withColumn("title", named).orderBy(comparable_time(F.col("created_at")).desc(), "id")


def ingestion_events(records: DataFrame) -> DataFrame:
    """(id, kind, title, created_at) of records that have a time."""
    own = F.coalesce(F.nullif(record_type(), F.lit("")), F.lit("record"))
    title = F.concat(F.lit("Ingested "), own, F.lit(" · "), F.coalesce(F.nullif(title_of(), F.lit("")), "id"))
    return records.select(F.concat(F.lit("ingest-"), "id").alias("id"), F.lit("ingestion").alias("kind"), title.alias("title"), time_of().alias("created_at")).where("created_at is not null")


def deployment_events(deployments: DataFrame) -> DataFrame:
    """(id, kind, title, created_at) of deployments (agent_id, agent_name, platform, status, deployed_at)."""
    title = F.concat("agent_name", F.lit(" deployed to "), "platform", F.lit(" ("), "status", F.lit(")"))
    return deployments.select(F.concat_ws("-", F.lit("deploy"), "agent_id", "platform").alias("id"), F.lit("deployment").alias("kind"), title.alias("title"), F.col("deployed_at").alias("created_at"))


def activity(records: DataFrame, deployments: DataFrame, n: int = 40) -> DataFrame:
    """The newest n events of both kinds."""
    both = ingestion_events(records).unionByName(deployment_events(deployments))
    return both.orderBy(comparable_time(F.col("created_at")).desc(), "id").limit(n)


def overview(records: DataFrame, people: DataFrame, agents: DataFrame) -> DataFrame:
    """dashboard with people and agents."""
    return dashboard(records).crossJoin(people.agg(F.count("*").alias("people"))).crossJoin(agents.agg(F.count("*").alias("agents")))


def attention(records: DataFrame) -> DataFrame:
    """(place, count, message) of what awaits review: pending merges and disputed facts, if any."""
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.col(c).alias("count"), F.lit(m).alias("message")) for i, (c, m) in enumerate((("pending_merges", "entity merges awaiting review"), ("disputed_facts", "facts marked as disputed")))])
    return dashboard(records).select(F.inline(rows)).where("count > 0")


def suggestions(records: DataFrame, people: DataFrame, agents: DataFrame, n: int = 6) -> DataFrame:
    """(place, id, prompt, source): at most n questions that the collection can answer, in a fixed order."""
    top = source_types(records).agg(F.max_by(F.struct("source_type", "documents"), F.struct("documents", "source_type")).alias("top"))
    whole = overview(records, people, agents).crossJoin(top)
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    count = lambda c: F.col(c).cast("string")
    fixed = [
        (F.col("top").isNotNull(), "top-source", text("What's in the latest ", F.col("top.source_type"), " knowledge?"), text(F.col("top.documents").cast("string"), " documents from ", F.col("top.source_type"))),
        (F.col("people") > 0, "people", text("Who owns what across the organization?"), text(count("people"), " people in the directory")),
        (F.col("agents") > 0, "agents", text("What can the deployed agents answer?"), text(count("agents"), " agents deployed")),
        (F.col("pending_merges") > 0, "merges", text("Which entities still need to be merged?"), text(count("pending_merges"), " pending merges")),
        (F.col("disputed_facts") > 0, "disputed", text("Which facts are still disputed?"), text(count("disputed_facts"), " disputed facts")),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.when(when, name).alias("id"), prompt.alias("prompt"), source.alias("source")) for i, (when, name, prompt, source) in enumerate(fixed)])
    out = whole.select(F.inline(rows)).where("id is not null")
    recent = browse(records).limit(3).select("id", "title", "source_type", "record_type", F.monotonically_increasing_id().alias("at"))
    recent = recent.select((F.lit(len(fixed)) + F.col("at")).cast("int").alias("place"), F.concat(F.lit("recent-"), "id").alias("id"), text('What changed in "', F.col("title"), '"?').alias("prompt"), text(F.col("source_type"), " · ", F.col("record_type")).alias("source"))
    return out.unionByName(recent).orderBy("place").limit(n)
