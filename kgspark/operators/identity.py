"""People and roles: platform identities, sender and user roles, employee registration, agents and their deployments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.scalars import ROLE_LEVELS, ascii_slug

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def normalize_email(value: Column) -> Column:
    """Trimmed and lower case; null if it is no address."""
    tidy = F.lower(F.trim(value))
    return F.when(tidy.rlike(EMAIL), tidy)


def normalize_phone(value: Column) -> Column:
    """`+` and the digits; null without digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(digits != "", F.concat(F.lit("+"), digits))


def normalize_platform_id(platform: Column, value: Column) -> Column:
    return F.when(platform == "email", normalize_email(value)).when(platform.isin("whatsapp", "phone"), normalize_phone(value)).otherwise(F.trim(value))


def resolve_senders(messages: DataFrame, identities: DataFrame, employees: DataFrame, agents: DataFrame) -> DataFrame:
    """messages (collection, platform, platform_user_id, agent_id, ..) with employee_id, role and is_fallback.

    The role is that of the employee linked to the sender, else the agent's role_default. Each of the other tables may hold
    several rows of a key; the smallest value is taken, so that no message is doubled.
    """
    key = ["collection", "platform", "platform_user_id"]
    sender = normalize_platform_id(F.col("platform"), F.col("platform_user_id"))
    links = identities.withColumn("platform_user_id", sender).groupBy(*key).agg(F.min("employee_id").alias("employee_id"))
    roles = employees.groupBy("collection", "employee_id").agg(F.min("access_role").alias("access_role"))
    defaults = agents.groupBy("agent_id").agg(F.min("role_default").alias("role_default"))
    out = messages.withColumn("platform_user_id", sender).join(links, key, "left").join(roles, ["collection", "employee_id"], "left").join(defaults, "agent_id", "left")
    return out.withColumns({"role": F.coalesce("access_role", "role_default"), "is_fallback": F.col("access_role").isNull()}).drop("access_role", "role_default")


def resolve_roles(requests: DataFrame, users: DataFrame, grants: DataFrame) -> DataFrame:
    """requests (request_id, identity, collection_name, role) with user_id and the granted role, else the one asked for.

    identity matches a user's (user_id, identity) as it stands, else as an address, else as a phone number.
    """
    identity = F.col("identity")
    forms = F.array(*[F.struct(F.lit(i).alias("priority"), c.alias("form")) for i, c in enumerate((identity, normalize_email(identity), normalize_phone(identity)))])
    asked = requests.select("request_id", F.inline(forms)).where("form is not null")
    matched = asked.hint("merge").join(users.select("user_id", F.col("identity").alias("form")), "form")
    found = matched.groupBy("request_id").agg(F.min(F.struct("priority", "user_id"))["user_id"].alias("user_id"))
    granted = grants.groupBy("user_id", "collection_name").agg(F.min("role").alias("granted"))
    out = requests.hint("merge").join(found, "request_id", "left").hint("merge").join(granted, ["user_id", "collection_name"], "left")
    return out.withColumn("role", F.coalesce("granted", "role")).drop("granted")


def linked_identities(identities: DataFrame) -> DataFrame:
    """(collection, employee_id, identities): `platform:id` of each employee, sorted."""
    pair = F.concat_ws(":", "platform", normalize_platform_id(F.col("platform"), F.col("platform_user_id")))
    return identities.groupBy("collection", "employee_id").agg(F.array_sort(F.collect_set(pair)).alias("identities"))


def role_access(records: DataFrame) -> DataFrame:
    """(role, documents, facts) each role may see, of records (kind document or fact, source_doc_id, access_level)."""
    level = F.coalesce(F.nullif("access_level", F.lit("")), F.lit("public"))
    roles = F.array(*[F.when(level.isin(seen), F.lit(role)) for role, seen in ROLE_LEVELS.items()])
    seen = records.select("kind", "source_doc_id", F.explode(F.array_compact(roles)).alias("role"))
    documents = F.count_distinct(F.when(F.col("kind") == "document", F.col("source_doc_id")))
    return seen.groupBy("role").agg(documents.alias("documents"), F.count_if(F.col("kind") == "fact").alias("facts"))


def people_access(employees: DataFrame, records: DataFrame, identities: DataFrame) -> DataFrame:
    """employees with what their role sees and their linked identities; unknown roles see nothing."""
    out = employees.join(role_access(records).withColumnRenamed("role", "access_role"), "access_role", "left")
    out = out.hint("merge").join(linked_identities(identities), ["collection", "employee_id"], "left")
    return out.fillna(0, ["documents", "facts"]).withColumn("identities", F.coalesce("identities", F.array().cast("array<string>")))


def agents_with_deployments(agents: DataFrame, deployments: DataFrame) -> DataFrame:
    """agents with their deployments (platform, status), sorted; none is an empty array."""
    held = deployments.groupBy("agent_id").agg(F.array_sort(F.collect_set(F.struct("platform", "status"))).alias("deployments"))
    return agents.join(held, "agent_id", "left").withColumn("deployments", F.coalesce("deployments", F.array().cast("array<struct<platform:string,status:string>>")))


def validate_employees(rows: DataFrame) -> DataFrame:
    """rows (employee_id, name, work_email, access_role) with errors: an array of texts, empty if the row is good."""
    missing = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{c} is missing")) for c in ("employee_id", "name", "work_email")]
    address = F.when((F.trim("work_email") != "") & normalize_email(F.col("work_email")).isNull(), F.lit("work_email is no address"))
    role = F.when(~F.coalesce("access_role", F.lit("")).isin(list(ROLE_LEVELS)), F.lit("access_role is unknown"))
    return rows.withColumn("errors", F.array_compact(F.array(*missing, address, role)))


def register_employees(rows: DataFrame, existing: DataFrame, order: str = "row_no") -> DataFrame:
    """(collection, employee_id, row_no, outcome, errors) of each row: added, updated, replaced (by a later row) or error."""
    key = ["collection", "employee_id"]
    checked = validate_employees(rows)
    last = checked.where(F.size("errors") == 0).groupBy(*key).agg(F.max(order).alias("last_row"))
    known = existing.select(*key).distinct().withColumn("is_known", F.lit(True))
    out = checked.join(last, key, "left").join(known, key, "left")
    outcome = F.when(F.size("errors") > 0, "error").when(F.col(order) < F.col("last_row"), "replaced").when(F.col("is_known"), "updated").otherwise("added")
    return out.select(*key, order, outcome.alias("outcome"), "errors")


def route_messages(messages: DataFrame, identities: DataFrame, employees: DataFrame, agents: DataFrame) -> DataFrame:
    """Question rows of inbound messages (message_id, raw_message, agent_id, collection, platform, platform_user_id): question,
    collection, role, employee_id, is_fallback, error. A blank message and an unknown agent are errors and no questions.

    agents: agent_id, collection, role_default.
    """
    known = agents.groupBy("agent_id").agg(F.min("collection").alias("agent_collection"))
    sent = messages.hint("merge").join(known, "agent_id", "left").withColumn("collection", F.coalesce("agent_collection", "collection"))
    out = resolve_senders(sent, identities, employees, agents.drop("collection"))
    text = F.trim(F.coalesce("raw_message", F.lit("")))
    error = F.when(text == "", "message is empty").when(F.col("agent_collection").isNull(), "agent is unknown")
    return out.select("message_id", text.alias("question"), "collection", "agent_id", "employee_id", F.lower(F.trim("role")).alias("role"), "is_fallback", error.alias("error"))


def employees_in_order(employees: DataFrame) -> DataFrame:
    return employees.orderBy("collection", "employee_id")


def grants_in_order(grants: DataFrame) -> DataFrame:
    return grants.orderBy("user_id", "collection_name")


def unique_names(organisations: DataFrame, existing: DataFrame) -> DataFrame:
    """organisations (id, org_name) with collection_name: the slug of the name, or with the least suffix -2, -3 .. that is free.

    existing: names in use (name), in any case. Organisations of one slug are served by id; each takes the next free suffix.
    """
    base = organisations.select("id", "org_name", ascii_slug(F.col("org_name")).alias("slug"))
    used = existing.select(F.lower("name").alias("name")).distinct()
    parts = used.select("name", F.regexp_extract("name", r"^(.*)-([0-9]+)$", 1).alias("stem"), F.regexp_extract("name", r"-([0-9]+)$", 1).try_cast("int").alias("suffix"))
    taken = parts.select(F.col("name").alias("slug"), F.lit(1).alias("suffix")).union(parts.where("suffix >= 2 and stem <> ''").select(F.col("stem").alias("slug"), "suffix"))
    taken = taken.groupBy("slug").agg(F.array_sort(F.collect_set("suffix")).alias("taken"))
    place = F.row_number().over(W.partitionBy("slug").orderBy("id"))
    asked = base.withColumn("place", place).hint("merge").join(taken, "slug", "left")
    # the place-th number from 1 on that is not taken: one up for each taken number that it reaches
    number = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("place"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    name = F.when(number == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), number.cast("string")))
    return asked.select("id", "org_name", name.alias("collection_name"))
