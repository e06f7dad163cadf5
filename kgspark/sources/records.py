"""Scans of record files and text corpora into one document shape."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.operators.build import EXTRACTION
from kgspark.sources.normalize import DOCUMENT, SHAPES, infer_kind, normalize, union_documents


def read_records(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON lines, or whole-file JSON with a list under records, documents, data or items."""
    if not multi_line:
        return spark.read.schema(schema).json(path)
    wrapped = ", ".join(f"{k} array<struct<{schema}>>" for k in ("records", "documents", "data", "items"))
    raw = spark.read.schema(wrapped).json(path, multiLine=True)
    return raw.select(F.inline(F.coalesce("records", "documents", "data", "items")))


def read_texts(spark: SparkSession, path: str, source: str, glob: str = "*.{txt,md}") -> DataFrame:
    """Text files `<id>__<date>-<slug>.txt` as documents: id, date from the name or a header line, container the folder.

    A byte-order mark is left out; metadata has the path and the title, which is the first line, or the file's name if empty.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    raw = raw.select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("content"), F.col("_metadata.file_path").alias("file"))
    stem = F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1)
    named = F.regexp_replace(F.regexp_extract(stem, r"__(\d{4}-?\d{2}-?\d{2})", 1), r"^(\d{4})-?(\d{2})-?(\d{2})$", "$1-$2-$3")
    header = F.regexp_extract("content", r"(?i)(?:Date|First email at|Created):\s*([^\n\r]+)", 1)
    title = F.coalesce(F.nullif(F.split("content", r"\R")[0], F.lit("")), stem)
    return raw.select(
        F.lit(source).alias("source"), F.split(stem, "__")[0].alias("source_id"), F.lit("").alias("author"),
        F.coalesce(F.nullif(named, F.lit("")), F.trim(header)).alias("timestamp"), "content", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("container_id"),
        F.to_json(F.struct(F.col("file").alias("path"), F.trim(title).alias("title"))).alias("metadata"),
    )


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of JSON files under path: JSON lines, a list, one object, or a list under records, documents, data or items.

    Without a schema it is inferred. A byte-order mark is tolerated.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    parts = []
    for glob, lines in (("*.jsonl", False), ("*.json", True)):
        own = reader.option("pathGlobFilter", glob)
        wrapped = ", ".join(f"{k} array<struct<{schema}>>" for k in ("records", "documents", "data", "items"))
        try:
            raw = (own.schema(f"{schema}, {wrapped}") if schema else own.option("columnNameOfCorruptRecord", "not_json")).json(path, multiLine=lines)
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # no file of this kind
                raise
            continue
        if set(raw.columns) <= {"not_json"}:
            continue
        lists = [c for c in ("records", "documents", "data", "items") if c in raw.columns and isinstance(raw.schema[c].dataType, T.ArrayType) and isinstance(raw.schema[c].dataType.elementType, T.StructType)]
        if lists:
            flat = raw.where(F.coalesce(*lists).isNull()).drop(*lists)
            inner = [raw.where(F.col(c).isNotNull()).select(F.inline(c)) for c in lists]
            raw = union_documents(*([flat] if flat.columns else []), *inner)
        if raw.columns:
            parts.append(raw)
    if not parts:
        raise ValueError(f"no records in {path}")
    return union_documents(*parts).dropna("all")


def read_corpus(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """Documents of several (source, folder) pairs: JSON files through the source's shape, text files as they are.

    Folders that aren't there are left out, as are kinds of file that a folder has none of.
    """
    parts = []
    for source, folder in sources:
        for read in (lambda s, f: read_upload(spark, f, s), lambda s, f: read_texts(spark, f, s)):
            try:
                part = read(source, folder)
            except (AnalysisException, ValueError):
                continue
            parts.append(part)
    if not parts:
        raise ValueError("no documents in these folders")
    return union_documents(*parts)


def read_upload(spark: SparkSession, path: str, source: str = "document-upload") -> DataFrame:
    """JSON files, or a text file, of an unknown kind as documents: rows in document shape pass, others by their fields."""
    if re.search(r"\.(txt|md|csv)$", path, re.IGNORECASE):
        return read_texts(spark, path, "document", "*")
    records = read_json(spark, path)
    if {"source", "source_id", "content", "container_id"} <= set(records.columns):
        return conform(records)
    return normalize(records, source if source in SHAPES else infer_kind(path, records.columns))


def questions_of(records: DataFrame) -> DataFrame:
    """question_id, question, category, gold_answer, ground_truth_doc_ids, source_types of records under any of their names."""
    texts = {
        "question_id": ("question_id", "id"), "question": ("question", "query", "prompt"), "category": ("category", "question_type"),
        "gold_answer": ("gold_answer", "answer", "expected_answer"),
    }
    lists = {"ground_truth_doc_ids": ("expected_doc_ids", "ground_truth_doc_ids", "doc_ids", "references"), "source_types": ("source_types",)}
    none = F.array().cast("array<string>")
    first = lambda names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in records.columns], F.lit(None).cast("string"))
    full = lambda names: F.coalesce(*[F.when(F.size(n) > 0, F.col(n).cast("array<string>")) for n in names if n in records.columns], none)
    found = {name: first(names) for name, names in texts.items()} | {name: full(names) for name, names in lists.items()}
    found["category"] = F.coalesce(found["category"], F.lit("uncategorized"))
    return records.select(*[c.alias(name) for name, c in found.items()])


def read_employees(spark: SparkSession, path: str) -> DataFrame:
    """Employee rows of a CSV file with a header, or of JSON with a list under employees or records, all columns as text."""
    if path.lower().endswith(".csv"):
        return spark.read.option("header", "true").csv(path)
    raw = spark.read.json(path, multiLine=True)
    lists = [c for c in ("employees", "records") if c in raw.columns]
    return raw.select(F.inline(F.coalesce(*lists))) if lists else raw


def read_judged(spark: SparkSession, path: str) -> DataFrame:
    """Judged rows (question_id, category, question, predicted_answer, gold_answer, score, score_value, confidence, abstained)
    of a JSON list; an empty table if the file isn't there."""
    schema = "question_id string, category string, question string, predicted_answer string, gold_answer string, score string, score_value double, confidence double, abstained boolean"
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, null fields included: marks, judged rows, ablations and filtered questions."""
    df.write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def document_records(records: DataFrame) -> DataFrame:
    """(id, source, timestamp, content) of stored records that are documents; without id or text they are left out.

    records: id, content, note, title, created_at and metadata, a map of texts.
    """
    held = lambda name: F.nullif(F.try_element_at("metadata", F.lit(name)), F.lit(""))
    own = lambda name: F.nullif(F.col(name), F.lit(""))
    kind = F.lower(F.coalesce(held("type"), held("record_type"), F.lit("")))
    out = records.where(kind == "document").select(
        F.coalesce(own("id"), held("source_doc_id")).alias("id"), F.coalesce(held("doc_source_type"), held("source"), F.lit("")).alias("source"),
        F.coalesce(held("timestamp"), own("created_at"), F.lit("")).alias("timestamp"), F.coalesce(own("content"), own("note"), own("title"), F.lit("")).alias("content"),
    )
    return out.where("id is not null and trim(content) <> ''")


def without_markers(records: DataFrame) -> DataFrame:
    """records (id, metadata map) without the bookkeeping ones that mark a collection as set up."""
    marked = F.lower(F.coalesce(F.try_element_at("metadata", F.lit("system_marker")), F.lit(""))).isin("true", "1")
    return records.where(~((F.coalesce("id", F.lit("")) == "__collection_init__") | marked))


def conform(df: DataFrame) -> DataFrame:
    """Already normalised rows, cast to the document shape."""
    missing = {"source", "source_id", "content", "container_id"} - set(df.columns)
    if missing:
        raise ValueError(f"not documents: {sorted(missing)} missing")
    return df.select(*[F.col(c).cast("string") if c in df.columns else F.lit("").alias(c) for c in DOCUMENT])


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extraction output files as the columns of DOCUMENT and the three arrays of EXTRACTION.

    A file holds a list under results, a bare list, or one object; an object has document and extraction, or is flat.
    Missing arrays are empty; without a document its columns are null.
    """
    record = f"document struct<{', '.join(f'{c}: string' for c in DOCUMENT)}>, extraction struct<{EXTRACTION}>, {EXTRACTION}"
    raw = spark.read.schema(f"results array<struct<{record}>>, {record}").json(path, multiLine=True)
    own = F.struct(*[c for c in raw.columns if c != "results"])
    rows = raw.select(F.explode(F.coalesce("results", F.array(own))).alias("r"))
    arrays = [c for c in raw.columns if c.startswith("candidate_")]
    nested = F.exists(F.array(*[F.col(f"r.extraction.{c}").isNotNull() for c in arrays]), lambda x: x)
    found = [F.when(nested, F.col(f"r.extraction.{c}")).otherwise(F.col(f"r.{c}")) for c in arrays]
    return rows.select("r.document.*", *[F.coalesce(x, F.array()).alias(c) for c, x in zip(arrays, found, strict=True)])
