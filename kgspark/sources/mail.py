"""Mailbox scans: one row for each message of mbox files or of landed mail payloads."""

from __future__ import annotations

import email
import html
import re
from collections.abc import Iterator
from email.message import Message
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.functions.scalars import html_to_text
from kgspark.shared import cut

MESSAGE = "message_id string, refs array<string>, subject string, sender string, date string, body string"
#: A landed payload: headers as a list, body parts already flattened to (mime_type, data in URL-safe base 64).
PAYLOAD = "id string, threadId string, payload struct<headers: array<struct<name: string, value: string>>, parts: array<struct<mimeType: string, data: string>>>"

_IDS = re.compile(r"<([^<>\s]+)>")
_TAGS = re.compile(r"<[^>]+>")


def _text(part: Message) -> str:
    raw = part.get_payload(decode=True) or b""
    try:
        return raw.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def _body(message: Message) -> str:
    parts = [p for p in message.walk() if not p.is_multipart()]
    plain = [_text(p).strip() for p in parts if p.get_content_type() == "text/plain"]
    if any(plain):
        return "\n\n".join(p for p in plain if p)
    marked = [html.unescape(_TAGS.sub(" ", _text(p))).strip() for p in parts if p.get_content_type() == "text/html"]
    return "\n\n".join(p for p in marked if p)


def _date(value: str) -> str:
    try:
        return parsedate_to_datetime(value).isoformat()
    except (TypeError, ValueError):
        return value


def parse_message(raw: str) -> tuple | None:
    """The columns of MESSAGE, or None where there is no Message-ID."""
    message = email.message_from_bytes(raw.encode("utf-8", "surrogateescape"))
    ids = _IDS.findall(str(message.get("Message-ID", "")))
    if not ids:
        return None
    refs = _IDS.findall(str(message.get("References", ""))) + _IDS.findall(str(message.get("In-Reply-To", "")))
    shown = str(message.get("From", ""))
    name, address = (getaddresses([shown]) or [("", "")])[0]
    return ids[0], list(dict.fromkeys(refs)), str(message.get("Subject", "")), name or address or shown, _date(str(message.get("Date", ""))), _body(message)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in MESSAGE.split(", ")]
    for batch in batches:
        # the separator took "From "; what is left of that line is not part of the message
        bare = (v.removeprefix("From ").split("\n", 1) for v in batch["value"])
        rows = [parse_message(v[1]) for v in bare if len(v) == 2]
        yield pd.DataFrame([r for r in rows if r], columns=names)


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mbox files. A file is split at its `From ` lines, so that a large one is read by many tasks.

    Messages without a Message-ID are dropped; dates that can't be read stay as they are; an empty file has no rows.
    """
    return spark.read.text(path, lineSep="\nFrom ").select("value").mapInPandas(_parse, MESSAGE)


def messages_of_payloads(payloads: DataFrame) -> DataFrame:
    """Messages of landed payloads (PAYLOAD): header names in any case, text parts joined, else HTML parts without tags."""
    def header(name: str):
        hits = F.filter("payload.headers", lambda h: F.lower(h["name"]) == name)
        return F.coalesce(F.get(hits, F.lit(0))["value"], F.lit(""))

    def body(kind: str):
        parts = F.filter("payload.parts", lambda p: p["mimeType"] == kind)
        texts = F.transform(parts, lambda p: F.trim(F.decode(F.unbase64(F.translate(p["data"], "-_", "+/")), "UTF-8")))
        return F.nullif(F.array_join(F.filter(texts, lambda t: t != ""), "\n\n"), F.lit(""))

    ids = lambda text: F.regexp_extract_all(text, F.lit(r"<([^<>\s]+)>"), F.lit(1))
    shown = header("from")
    name = F.btrim(F.regexp_extract(shown, r"^([^<]*)<", 1), F.lit(' "'))
    return payloads.select(
        F.coalesce(F.get(ids(header("message-id")), F.lit(0)), F.col("id")).alias("message_id"),
        F.array_distinct(F.concat(ids(header("references")), ids(header("in-reply-to")))).alias("refs"), header("subject").alias("subject"),
        F.coalesce(F.nullif(name, F.lit("")), F.nullif(F.regexp_extract(shown, "<([^>]*)>", 1), F.lit("")), shown).alias("sender"),
        header("date").alias("date"),
        F.coalesce(body("text/plain"), html_to_text(body("text/html")), F.lit("")).alias("body"),
    )


def _field(node: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(node, path, kind)


def _decoded(data: Column) -> Column:
    """Text of URL-safe base 64, with or without padding; what isn't UTF-8 is replaced, what isn't base 64 is empty."""
    plain = F.rtrim(F.translate(data, "-_", "+/"), F.lit("="))
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.coalesce(F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")), F.lit(""))


@F.pandas_udf(T.StringType())
def _without_tags(pages: pd.Series) -> pd.Series:
    """Tags to a space, every entity unescaped, trimmed; null stays."""
    return pages.map(lambda x: html.unescape(_TAGS.sub(" ", x)).strip(), na_action="ignore")


def _level(nodes: DataFrame) -> DataFrame:
    """nodes (row, at, place, node) with kind, own (the text of a text part, else null) and parts (of others)."""
    kind, own = F.coalesce(_field("node", "$.mimeType"), F.lit("")), _decoded(F.coalesce(_field("node", "$.data"), F.lit("")))
    out = nodes.withColumn("kind", kind)
    page = _without_tags(F.when(F.col("kind") == "text/html", own))
    out = out.withColumn("own", F.when(F.col("kind") == "text/plain", own).otherwise(page))
    return out.select("row", "at", "place", "kind", "own", F.when(F.col("own").isNull(), _field("node", "$.parts", "array<variant>")).alias("parts"))


def bodies_of_parts(payloads: DataFrame) -> DataFrame:
    """(row, at, body) of payloads (row, at: their key; node: a part as VARIANT), whose parts may hold parts to any depth.

    A text part is its text, an HTML part its text without tags; any other part is what its own parts give: those that are no HTML,
    joined in order, or else the HTML ones. Parts without text are left out; a missing or malformed payload has an empty body.
    The tree is walked down by levels, each a table, and folded from the deepest up; only the parts of one part ever meet.
    """
    top = payloads.select("row", "at", F.array().cast("array<int>").alias("place"), "node")
    levels = [cut(_level(top), "parts")]
    while not levels[-1].where(F.size("parts") > 0).isEmpty():
        below = levels[-1].select("row", "at", F.col("place").alias("up"), F.posexplode("parts").alias("i", "node"))
        levels.append(cut(_level(below.select("row", "at", F.concat("up", F.array("i")).alias("place"), "node")), "parts"))
    found = levels[-1].select("row", "at", "place", "kind", F.coalesce("own", F.lit("")).alias("body"))
    for level in reversed(levels[:-1]):
        kids = found.where("body <> ''").select("row", "at", F.slice("place", 1, F.size("place") - 1).alias("place"), F.struct(F.element_at("place", -1).alias("i"), "kind", "body").alias("kid"))
        kids = kids.groupBy("row", "at", "place").agg(F.array_sort(F.collect_list("kid")).alias("kids"))
        texts = F.transform(F.filter("kids", lambda k: k["kind"] != "text/html"), lambda k: k["body"])
        pages = F.transform("kids", lambda k: k["body"])  # where there are no others
        joined = F.array_join(F.when(F.size(texts) > 0, texts).otherwise(pages), "\n\n")
        both = level.hint("merge").join(kids, ["row", "at", "place"], "left")
        found = both.select("row", "at", "place", "kind", F.coalesce("own", joined, F.lit("")).alias("body"))
    return found.select("row", "at", "body")


def threads_of_payloads(landed: DataFrame, id_col: str = "thread_id", json_col: str = "payload") -> DataFrame:
    """One row for each landed thread (an id and its JSON) with messages: thread_id, sender and subject of its first message,
    first_email_at, last_email_at, messages (message_id, sender, date, subject, body) by date as text, of equal dates in order.

    Header names count in any case, and the last of a name holds. Threads that are null, no JSON or without messages are left out;
    rows that repeat an id stay apart; other columns are ignored.
    """
    row = F.monotonically_increasing_id().alias("row")
    landed = cut(landed.select(row, F.col(id_col).alias("thread_id"), F.try_parse_json(json_col).alias("thread")), "landed")
    each = landed.select("row", "thread_id", F.posexplode(_field("thread", "$.messages", "array<variant>")).alias("at", "message"))
    each = cut(each.withColumn("node", _field("message", "$.payload", "variant")), "messages")
    headers = F.coalesce(_field("node", "$.headers", "array<struct<name: string, value: string>>"), F.array())

    def header(name: str) -> Column:
        hits = F.filter(headers, lambda h: F.lower(h["name"]) == name)
        return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit("")).alias({"from": "sender"}.get(name, name))

    told = each.select("row", "at", "thread_id", F.coalesce(_field("message", "$.id"), F.lit("")).alias("message_id"), *[header(n) for n in ("from", "date", "subject")])
    both = told.hint("merge").join(bodies_of_parts(each), ["row", "at"])
    message = F.struct("date", "at", "message_id", "sender", "subject", "body")
    threads = both.groupBy("row").agg(F.first("thread_id").alias("thread_id"), F.array_sort(F.collect_list(message)).alias("m"))
    first, last = F.col("m")[0], F.element_at("m", -1)
    shown = F.transform("m", lambda m: F.struct(*[m[c].alias(c) for c in ("message_id", "sender", "date", "subject", "body")]))
    return threads.select("thread_id", first["sender"].alias("sender"), first["subject"].alias("subject"), first["date"].alias("first_email_at"), last["date"].alias("last_email_at"), shown.alias("messages"))
