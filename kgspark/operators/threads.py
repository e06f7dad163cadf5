"""Mail threads by reference chains. Threads are aggregated and never collected, so that one of any size is no task of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.scalars import subject_key
from kgspark.operators.resolution import redirect


def thread_roots(messages: DataFrame) -> DataFrame:
    """(message_id, root) of messages (message_id, refs): the end of the chain of last references.

    The root may be an id that is no message. A reference to itself is none. Chains that end in a cycle have the smallest
    id of all that lead to it. Rows with one id are one message (the smallest of their parents holds); null ids are dropped.
    """
    parent = F.try_element_at(F.filter("refs", lambda r: (r != "") & (r != F.col("message_id"))), F.lit(-1))
    links = messages.where("message_id is not null").groupBy(F.col("message_id").alias("id")).agg(F.min(parent).alias("merged_into"))
    return redirect(links.select(F.col("id").alias("message_id"), F.col("id").alias("root")), links.where("merged_into is not null"), "root")


def thread_of_messages(messages: DataFrame) -> DataFrame:
    """messages with thread_id: the root, or the subject (a reply prefix off) for lone messages without references."""
    roots = thread_roots(messages)
    sizes = roots.groupBy("root").agg(F.count("*").alias("n_in_root"))
    out = messages.join(roots, "message_id").join(sizes, "root")
    lone = (F.col("n_in_root") == 1) & (F.size(F.coalesce("refs", F.array().cast("array<string>"))) == 0) & (subject_key(F.col("subject")) != "")
    thread = F.when(lone, F.concat(F.lit("subject:"), subject_key(F.col("subject")))).otherwise(F.col("root"))
    return out.withColumn("thread_id", thread).drop("root", "n_in_root")


def summarize_threads(messages: DataFrame) -> DataFrame:
    """(thread_id, sender, subject, first_at, last_at, n_messages); sender and subject of the first message by (date, id)."""
    first = F.min(F.struct("date", "message_id", "sender", "subject")).alias("first")
    out = thread_of_messages(messages).groupBy("thread_id").agg(first, F.max("date").alias("last_at"), F.count("*").alias("n_messages"))
    return out.select("thread_id", "first.sender", "first.subject", F.col("first.date").alias("first_at"), "last_at", "n_messages")


def summarize_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, first_role, last_text) of chats (conv_id, turn, role, text), by turn."""
    return conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("role", "turn").alias("first_role"), F.max_by("text", "turn").alias("last_text"))
