"""Chat exports and landed chat payloads as one row for each message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.scalars import first_non_empty

RAW = "ts string, user string, bot_id string, username string, text string, thread_ts string, subtype string, replies array<struct<user: string, ts: string>>"
USERS = "id string, name string, profile struct<display_name: string, real_name: string>"
MENTION = r"<@(\w+)>"


def user_names(users: DataFrame) -> DataFrame:
    """(user_id, user_name): display name, else real name, else name, else the id; one row for each id."""
    named = first_non_empty("profile.display_name", "profile.real_name", "name", "id")
    return users.where("id <> ''").groupBy(F.col("id").alias("user_id")).agg(F.min(named).alias("user_name"))


def resolve_mentions(messages: DataFrame, names: DataFrame) -> DataFrame:
    """messages with `<@id>` in text replaced by `@name`; unknown ids stay. Equal texts are looked up once.

    Texts meet by two 64-bit hashes and are not sent along.
    """
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(MENTION), F.lit(1)))
    keys = lambda: [F.xxhash64(F.lit(i), "text").alias(f"text_{i}") for i in (1, 2)]
    asked = messages.where(F.col("text").rlike(MENTION)).select(*keys(), found.alias("ids")).distinct().select("text_1", "text_2", F.explode("ids").alias("user_id"))
    known = asked.hint("merge").join(names, "user_id").groupBy("text_1", "text_2").agg(F.collect_list(F.struct("user_id", "user_name")).alias("known_names"))
    tag = lambda n: F.concat(F.lit("<@"), n["user_id"], F.lit(">"))
    replaced = F.aggregate("known_names", F.col("text"), lambda t, n: F.replace(t, tag(n), F.concat(F.lit("@"), n["user_name"])))
    out = messages.select("*", *keys()).hint("merge").join(known, ["text_1", "text_2"], "left").withColumn("text", F.coalesce(replaced, "text"))
    return out.select(*messages.columns)


def shape_messages(raw: DataFrame, names: DataFrame, channels: DataFrame) -> DataFrame:
    """Messages of raw rows (RAW and channel) with names of users and ids of channels (id, name); blank texts are dropped."""
    raw = raw.where(F.trim("text") != "").withColumn("user_id", first_non_empty("user", "bot_id", "username"))
    ids = channels.groupBy(F.col("name").alias("channel")).agg(F.min("id").alias("channel_id"))
    out = resolve_mentions(raw, names).hint("merge").join(names, "user_id", "left").hint("merge").join(ids, "channel", "left")
    return out.select(
        F.coalesce("channel_id", "channel").alias("channel_id"), "channel", "ts", "user_id", F.coalesce("user_name", "user_id").alias("user_name"),
        "text", F.coalesce("thread_ts", "ts").alias("thread_ts"), "subtype", F.greatest(F.size(F.coalesce("replies", F.array())), F.lit(0)).alias("reply_count"),
    )


def shape_payloads(payloads: DataFrame) -> DataFrame:
    """Messages of landed API payloads (channel, channel_name, messages: array of RAW, users: array of USERS): one row each, in
    the same shape. The sender is user, else bot_id, else username; the payload's own users give the names."""
    raw = payloads.select(F.col("channel_name").alias("channel"), F.inline("messages"))
    users = payloads.select(F.inline("users"))
    channels = payloads.select(F.col("channel").alias("id"), F.col("channel_name").alias("name"))
    return shape_messages(raw, user_names(users), channels)


def read_chat_payloads(spark: SparkSession, path: str) -> DataFrame:
    """shape_payloads of JSON files, one payload each."""
    schema = f"channel string, channel_name string, messages array<struct<{RAW}>>, users array<struct<{USERS}>>"
    return shape_payloads(spark.read.schema(schema).json(path, multiLine=True))


def read_chat_export(spark: SparkSession, path: str) -> DataFrame:
    """An export folder: users.json, channels.json and `<channel>/<day>.json`, each a JSON list."""
    days = spark.read.schema(RAW).json(f"{path}/*/*.json", multiLine=True)
    days = days.select("*", F.url_decode(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)).alias("channel"))
    users = spark.read.schema(USERS).json(f"{path}/users.json", multiLine=True)
    channels = spark.read.schema("id string, name string").json(f"{path}/channels.json", multiLine=True)
    return shape_messages(days, user_names(users), channels)
