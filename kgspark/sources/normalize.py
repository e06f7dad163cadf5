"""Records of four kinds of sources to one document shape: DOCUMENT and metadata, the JSON of all fields that have no place in it.

Records come as DataFrames with whatever columns their files have; fields that aren't there count as empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a document besides metadata.
DOCUMENT = ["source", "source_id", "author", "timestamp", "content", "container_id"]


@dataclass(frozen=True)
class Shape:
    """Fields of a kind of source, by what they give; the first that is not empty counts. uses: further fields that are no metadata."""

    source_id: tuple[str, ...]
    container: tuple[str, ...]
    author: tuple[str, ...]
    timestamp: tuple[str, ...]
    title: tuple[str, ...]
    content: tuple[str, ...]
    uses: tuple[str, ...] = ()


#: Field names of the sources.
SHAPES = {
    "slack": Shape(
        ("message_id", "ts", "timestamp_id", "id", "dataset_doc_uuid"), ("channel_id", "channel", "channel_name", "conversation_id"),
        ("user_name", "user", "author", "sender", "from"), ("timestamp", "ts", "created_at", "datetime", "date"), (),
        ("text", "message", "content", "body", "description"),
    ),
    "jira": Shape(
        ("issue_key", "key", "ticket_id", "id", "dataset_doc_uuid"), ("project_key", "project", "project_name", "queue", "team"),
        ("reporter", "creator", "author", "assignee"), ("created_at", "created", "updated_at", "updated", "timestamp"),
        ("summary", "title", "subject"), ("description", "body", "content", "comments"),
    ),
    "github": Shape(
        ("id", "source_id", "dataset_doc_uuid"), ("repo", "repository", "repository_name", "owner_repo"), ("author", "user", "creator"),
        ("created_at", "updated_at", "merged_at", "closed_at"), ("title",), ("description", "body", "content", "comments", "review_conversation"),
        ("pr_number", "pull_request_number", "number"),
    ),
    "gmail": Shape(
        ("thread_id", "id", "source_id", "dataset_doc_uuid"), ("thread_id", "id", "source_id", "dataset_doc_uuid"),
        ("sender", "from", "mailbox_owner", "author"), ("first_email_at", "last_email_at", "timestamp", "date"), ("subject", "title"),
        ("messages", "body", "content", "text"),
    ),
}
#: Fields that tell the kind of a record, asked in this order.
TELLTALES = {
    "github": {"repo", "pr_number"}, "gmail": {"thread_id", "messages", "mailbox_owner"}, "slack": {"channel", "channel_id", "ts", "message"},
    "jira": {"issue_key", "project_key", "summary"},
}


def _sorted_json(value: Column, kind: T.DataType) -> Column:
    """value with the fields of all structs in the order of their names, for to_json."""
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_sorted_json(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted_json(x, kind.elementType))
    return value


def text_of(value: Column, kind: T.DataType) -> Column:
    """Any value as text: lists joined by blank lines, without empty items; objects as JSON with sorted keys; null is empty."""
    empty = F.lit("")
    if isinstance(kind, T.StringType):
        return F.coalesce(value, empty)
    if isinstance(kind, T.ArrayType):
        items = F.filter(F.transform(value, lambda x: text_of(x, kind.elementType)), lambda x: x != "")
        return F.coalesce(F.array_join(items, "\n\n"), empty)
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.coalesce(F.to_json(_sorted_json(value, kind)), empty)
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.initcap(value.cast("string")), empty)
    return F.coalesce(value.cast("string"), empty)


def strings_of(value: Column, kind: T.DataType) -> Column:
    """All texts in a value, however deep; numbers as text, nulls left out."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: strings_of(x, kind.elementType))), F.array().cast("array<string>"))
    if isinstance(kind, T.MapType):
        return strings_of(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return F.flatten(F.array(*[strings_of(value[f.name], f.dataType) for f in kind.fields]))
    return F.array_compact(F.array(value.cast("string")))


def _first(records: DataFrame, names: tuple[str, ...]) -> Column:
    found = [F.nullif(text_of(F.col(f"`{n}`"), records.schema[n].dataType), F.lit("")) for n in names if n in records.columns]
    return F.coalesce(*found, F.lit(""))


def content_of(records: DataFrame, names: tuple[str, ...]) -> Column:
    """The fields that content_field_names lists, joined by blank lines; without any, the first of names that is not empty."""
    plain = _first(records, names)
    if "content_field_names" not in records.columns:
        return plain
    fields = [c for c in records.columns if c != "content_field_names"]
    pairs = [x for c in fields for x in (F.lit(c), text_of(F.col(f"`{c}`"), records.schema[c].dataType))]
    held = F.create_map(*pairs)
    parts = F.filter(F.transform("content_field_names", lambda n: F.coalesce(F.try_element_at(held, n), F.lit(""))), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(parts, "\n\n"), F.lit("")), plain)


def normalize(records: DataFrame, kind: str) -> DataFrame:
    """Records of a kind of source (a key of SHAPES) as documents. A title stands above the content, with a blank line.

    A code-host record without id is named repository#number. Repeated records are documents each; an empty table gives an
    empty result.
    """
    shape = SHAPES[kind]
    used = {n for part in (shape.source_id, shape.container, shape.author, shape.timestamp, shape.title, shape.content, shape.uses) for n in part}
    rest = [_sorted_json(F.col(f"`{c}`"), records.schema[c].dataType).alias(c) for c in sorted(records.columns) if c not in used]
    title, body = _first(records, shape.title), content_of(records, shape.content)
    content = F.when(title == "", body).otherwise(F.regexp_replace(F.concat(title, F.lit("\n\n"), body), r"^\s+|\s+$", ""))
    own, container = _first(records, shape.source_id), _first(records, shape.container)
    if kind == "github":
        number = _first(records, shape.uses)
        own = F.when((own == "") & (container != "") & (number != ""), F.concat(container, F.lit("#"), number)).otherwise(own)
    return records.select(
        F.lit(kind).alias("source"), own.alias("source_id"), _first(records, shape.author).alias("author"), _first(records, shape.timestamp).alias("timestamp"),
        content.alias("content"), container.alias("container_id"), (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("metadata"),
    )


def infer_kind(path: str, columns: list[str]) -> str:
    """The kind of source of a file: a folder of its name, else by the fields of its records."""
    folders = path.lower().replace("\\", "/").split("/")
    for kind in SHAPES:
        if kind in folders:
            return kind
    for kind, fields in TELLTALES.items():
        if fields & set(columns):
            return kind
    raise ValueError("the kind of source can't be told from these fields; name it")


def union_documents(*parts: DataFrame) -> DataFrame:
    """Documents of several sources as one table; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def fold_comments(body: Column, comments: Column, heading: str = "Comments:", author: bool = False) -> Column:
    """body with a list under a heading: the comments' bodies (strings), or `author: body` of structs; blank ones left out."""
    own = F.coalesce(F.trim(body), F.lit(""))
    if author:
        lines = F.transform(comments, lambda c: F.concat(F.lit("- "), F.coalesce(c["author"], F.lit("")), F.lit(": "), F.coalesce(c["body"], F.lit(""))))
    else:
        lines = F.transform(F.filter(comments, lambda c: F.trim(c) != ""), lambda c: F.concat(F.lit("- "), F.trim(c)))
    some = F.size(F.coalesce(lines, F.array().cast("array<string>"))) > 0
    return F.when(some, F.btrim(F.concat(own, F.lit(f"\n\n{heading}\n"), F.array_join(lines, "\n")), F.lit(" \n\t\r"))).otherwise(own)


def model_input(documents: DataFrame, size: int = 300) -> DataFrame:
    """source_id and the seven fields as JSON with sorted keys, content cut to size: what an extractor is given."""
    fields = sorted([c for c in documents.columns if c in {*DOCUMENT, "metadata"}])
    cut_content = F.substring("content", 1, size)
    return documents.select("source_id", F.to_json(F.struct(*[cut_content.alias(c) if c == "content" else F.col(c) for c in fields])).alias("payload"))
