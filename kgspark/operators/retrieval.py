"""Lexical retrieval: log term frequency times smoothed inverse document frequency, best k for each question.

Questions are the small side. Their terms' document frequencies are counted first; each text is then scored once against all
questions that share a term with it, and a task passes on its best k for each question only.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kgspark.functions.scalars import RETRIEVAL_TOKEN, retrieval_tokens
from kgspark.shared import cut

#: Different terms of questions, times questions that have them, that are scored in one pass over the documents.
POSTINGS = 2_000_000
#: Similarities of vectors that a task computes at once.
SCORES = 500_000


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = docs.select(F.col(id_col).alias("id"), F.explode(retrieval_tokens(F.col(text_col))).alias("term"))
    return words.groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def _frequencies_of(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """(term, df) of some terms (a written table): their number is bounded by POSTINGS, so that they are broadcast."""
    words = docs.select(F.explode(F.array_distinct(retrieval_tokens(F.col(text_col)))).alias("term"))
    return words.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("df"))


def _score_pass(asked: DataFrame, docs: DataFrame, n: int, k: int, doc_id: str, text: str) -> DataFrame:
    """(question_id, doc_id, score) of each task's best k. asked: question_id, term, qtf, within POSTINGS."""
    terms = cut(asked.select("term").distinct(), "terms")
    weighted = asked.hint("merge").join(cut(_frequencies_of(docs, text, terms), "frequencies"), "term")
    names: list = []
    number: dict = {}
    gathered: dict[str, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
    for r in weighted.collect():  # POSTINGS at most
        q = number.setdefault(r["question_id"], len(names))
        if q == len(names):
            names.append(r["question_id"])
        into = gathered[r["term"]]
        into[0].append(q)
        into[1].append(r["qtf"] * (math.log((n + 1.0) / (r["df"] + 1)) + 1))
    postings = {t: (np.array(q), np.array(w)) for t, (q, w) in gathered.items()}
    held = docs.sparkSession.sparkContext.broadcast((names, postings))
    kinds = [asked.schema["question_id"].dataType, docs.schema[doc_id].dataType, T.DoubleType()]
    schema = T.StructType([T.StructField(c, t) for c, t in zip(("question_id", "doc_id", "score"), kinds, strict=True)])
    asked_kind = to_arrow_type(kinds[0])

    def run(batches: Iterator[pa.RecordBatch]):
        names, postings = held.value
        best: list[list[tuple]] = [[] for _ in names]
        floor = np.zeros(len(names))
        token, kind = re.compile(RETRIEVAL_TOKEN), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [(postings[t], 1 + math.log(tf)) for t, tf in Counter(token.findall((body or "").lower())).items() if t in postings]
                if not found:
                    continue
                at = np.concatenate([q for (q, _), _ in found])
                score = np.round(np.bincount(at, np.concatenate([w * x for (_, w), x in found]), len(names)), 6)
                for q in np.flatnonzero((score >= floor) & (score > 0)).tolist():
                    heapq.heappush(best[q], (float(score[q]), _Last(own)))
                    if len(best[q]) > k:
                        heapq.heappop(best[q])
                    if len(best[q]) == k:
                        floor[q] = best[q][0][0]
        if kind is not None:
            rows = [(names[q], x.value, s) for q, found in enumerate(best) for s, x in found]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            arrow = [pa.array(columns[0], asked_kind), pa.array(columns[1], kind), pa.array(columns[2], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrow, names=schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


class _Last:
    """Orders ids the other way round, so that of equal scores the smallest id stays; a null is the largest."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __lt__(self, other: _Last) -> bool:
        if self.value is None or other.value is None:
            return self.value is None and other.value is not None
        return self.value > other.value


def retrieve(questions: DataFrame, docs: DataFrame, k: int = 5, question_id: str = "question_id", question: str = "question", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(question_id, doc_id, score, rank) of the k best documents of each question with a positive score.

    Scores are rounded to six digits and ties go to the smaller document id. Questions beyond POSTINGS terms are dealt to
    several passes by hash. Null texts have no terms; an empty table of either gives an empty result.
    """
    asked = term_counts(questions, question_id, question).select(F.col("id").alias("question_id"), "term", F.col("tf").alias("qtf"))
    asked = cut(asked, "asked")
    n, passes = docs.count(), max(1, -(-asked.count() // POSTINGS))
    scored = None
    for i in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("question_id"), F.lit(passes)) == i)
        found = _score_pass(part, docs, n, k, doc_id, text)
        scored = found if scored is None else scored.union(found)
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return cut(scored, "scored").withColumn("rank", rank).where(F.col("rank") <= k)


@F.pandas_udf(T.StringType())
def _three_digits(score: pd.Series) -> pd.Series:
    """Scores to three digits by their exact value, of ties the even one; format_string rounds the shortest decimal form half up."""
    return score.map(lambda x: f"{x:.3f}")


def context_blocks(found: DataFrame, docs: DataFrame, size: int = 1500) -> DataFrame:
    """(question_id, rank, block): retrieved documents (question_id, doc_id, score, rank) as text under a heading, content cut to
    size. docs: doc_id, source, content."""
    both = found.hint("merge").join(docs, "doc_id")
    heading = F.format_string("[%d] source_id=%s source=%s score=%s\n", F.col("rank"), F.col("doc_id").cast("string"), F.col("source"), _three_digits("score"))
    return both.select("question_id", "rank", F.concat(heading, F.substring(F.coalesce("content", F.lit("")), 1, size)).alias("block"))


def fallback_documents(found: DataFrame, docs: DataFrame, size: int = 2500) -> DataFrame:
    """(question_id, doc_id, source, timestamp, content cut to size, score) of retrieved documents, for questions without an anchor."""
    return found.hint("merge").join(docs, "doc_id").select("question_id", "doc_id", "source", "timestamp", F.substring("content", 1, size).alias("content"), "score", "rank")


def search_vectors(questions: DataFrame, docs: DataFrame, filters: list[str], k: int = 5, dots: int = 2_000_000) -> DataFrame:
    """(question_id, doc_id, score, rank) of the k documents (doc_id, vector and filter columns) nearest by cosine to each question
    (question_id, vector, filters: a map of wanted values) among those that have the values it wants.

    Questions are a query set, compared with all documents in blocks of about dots numbers: those that want the same together, with
    the documents that have it, so many at once that SCORES are computed. A task passes on its best k only. Scores are rounded to six
    digits, ties go to the smaller id. Null and zero vectors are like nothing.
    """
    size = questions.select(F.size("vector")).agg(F.max("size(vector)")).first()[0] or 1
    count = questions.count()
    blocks = max(1, -(-count * size // dots))
    out = None
    kinds = [questions.schema["question_id"].dataType, docs.schema["doc_id"].dataType]
    schema = T.StructType([T.StructField("question_id", kinds[0]), T.StructField("doc_id", kinds[1]), T.StructField("score", T.DoubleType())])
    arrow = [to_arrow_type(t) for t in kinds]
    for i in range(blocks):
        part = questions if blocks == 1 else questions.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i)
        alike = defaultdict(list)
        for r in part.where("vector is not null").collect():  # a block
            alike[tuple((c, str(v)) for c in filters if (v := dict(r["filters"] or {}).get(c)) is not None)].append(r)
        groups = [(w, [r["question_id"] for r in rows], _unit(np.array([r["vector"] for r in rows], float))) for w, rows in alike.items()]
        held = docs.sparkSession.sparkContext.broadcast(groups)

        def run(batches: Iterator[pa.RecordBatch], held=held):
            best: list[list[list[tuple]]] = [[[] for _ in names] for _, names, _ in held.value]
            floors = [np.where(matrix.any(axis=1), -2.0, np.inf) for _, _, matrix in held.value]
            for batch in batches:
                vectors = batch.column("vector").to_pylist()
                keep = [j for j, v in enumerate(vectors) if v and any(v)]
                if not keep:
                    continue
                own = _unit(np.array([vectors[j] for j in keep], float))
                ids = batch.column("doc_id").take(pa.array(keep)).to_pylist()
                have = {c: np.array([str(x) for x in batch.column(c).take(pa.array(keep)).to_pylist()]) for c in filters}
                for (wants, _, matrix), found, floor in zip(held.value, best, floors, strict=True):
                    fits = np.ones(len(keep), bool)
                    for c, value in wants:
                        fits &= have[c] == value
                    rows, many = np.flatnonzero(fits), max(1, SCORES // len(matrix))
                    for some in (rows[at : at + many] for at in range(0, len(rows), many)):
                        scores = np.round(matrix @ own[some].T, 6)
                        for q in np.flatnonzero(scores.max(axis=1) >= floor).tolist():
                            at = np.flatnonzero(scores[q] >= max(floor[q], np.partition(scores[q], -min(k, len(some)))[-min(k, len(some))]))
                            new = [(-float(scores[q, j]), (x := ids[some[j]]) is None, x) for j in at.tolist()]
                            found[q] = sorted(found[q] + new)[:k]
                            if len(found[q]) == k:
                                floor[q] = -found[q][-1][0]
            rows = [(name, x, -s) for (_, names, _), found in zip(held.value, best, strict=True) for name, own in zip(names, found, strict=True) for s, _, x in own]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], arrow[0]), pa.array(columns[1], arrow[1]), pa.array(columns[2], pa.float64())], names=schema.names)

        scored = docs.select("doc_id", "vector", *filters).mapInArrow(run, schema)
        out = scored if out is None else out.union(scored)
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), "doc_id"))
    return cut(out, "nearest").withColumn("rank", rank).where(F.col("rank") <= k)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)
