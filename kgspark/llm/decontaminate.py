"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

A text is lower-cased (A-Z), cut to words and scanned once. A window is `width` consecutive words of an item. The automaton
holds every item cut into blocks of half that width, one of which lies in each window whatever its place; a block found in a
text is extended to both sides along its item, and runs of at least `width` equal words are hits. Items that are too short for
this are patterns as a whole. So the automaton grows with the items' text and not with their windows. Hits are mapped to word
and byte offsets of the text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.text import ALNUM, free_names, slices, utf8

#: Bytes of item text in one automaton (about 40 times as much memory in a worker). A larger benchmark takes several scans.
BLOCK_BYTES = 8 << 20

#: An occurrence: first word, end word, item.
Hit = tuple[int, int, str]


class Index:
    """The automaton over items (id, text). Patterns have a space at both ends, as Latin-1 so that a character is a byte."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.width, self.half = width, max(1, width // 2)
        self.items = [(i, t.encode().translate(ALNUM).split()) for i, t in items]
        places: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(self.items):
            size, step = (self.half, self.half) if len(words) >= width else (len(words), max(1, len(words)))
            for at in range(0, len(words) - size + 1 if words else 0, step):
                places.setdefault(b" ".join(words[at : at + size]), []).append((k, at))
        self.found = None
        if places:
            self.found = ahocorasick.Automaton()
            for pattern, where in places.items():
                self.found.add_word(f" {pattern.decode('latin-1')} ", (len(pattern), pattern.count(b" ") + 1, where))
            self.found.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[Hit]]:
        """The number of words of a text, and the runs of item windows in it."""
        words = text.translate(ALNUM).split()
        if not self.found:
            return len(words), []
        joined = f" {b' '.join(words).decode('latin-1')} "
        matches = list(self.found.iter(joined))
        if not matches:
            return len(words), []
        spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
        starts = np.searchsorted(spaces, [end - n - 1 for end, (n, _, _) in matches]).tolist()
        hits: list[Hit] = []
        done: dict[tuple[int, int], int] = {}  # end of the last run by item and by how far the text is shifted against it
        for start, (_, (_, size, where)) in zip(starts, matches, strict=True):
            for k, at in where:
                name, own = self.items[k]
                if start < done.get((k, start - at), 0):
                    continue
                a, b, x, y = start, start + size, at, at + size
                while a and x and words[a - 1] == own[x - 1]:
                    a, x = a - 1, x - 1
                while b < len(words) and y < len(own) and words[b] == own[y]:
                    b, y = b + 1, y + 1
                done[k, start - at] = b
                if b - a >= min(self.width, len(own)):
                    hits.append((a, b, name))
        return len(words), hits


@lru_cache(maxsize=2)
def _index(key: str, held, width: int) -> Index:
    """One for each Python worker, kept over tasks. key: of the broadcast items."""
    return Index(held.value, width)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about block_bytes, in a fixed order."""
    empty = F.lit("")
    items = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), empty).alias("item"), F.coalesce(F.col(text_col), empty).alias("text")
    )
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r["item"], r["text"]) for r in part.orderBy("item", "text").collect()]  # at most about block_bytes


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = 10, block_bytes: int = BLOCK_BYTES, names: tuple[str, str, str] = ("n_words", "spans", "items"),
) -> DataFrame:
    """docs with the number of words, spans (first word, end word of each hit run, ascending) and items (sorted ids), so named.

    A null or empty text has no words and no hits; an empty benchmark hits nothing; a null item id is the empty string, and
    items of equal id are one. Repeated rows are scanned each for itself. All columns of docs pass through; names must be free
    (free_names makes such). An empty table stays empty. Narrow: no shuffle, whatever the size of the benchmark.
    """
    kinds = [T.LongType(), T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType())]
    added = [T.StructField(n, t) for n, t in zip(names, kinds, strict=True)]
    schema = T.StructType([*docs.schema.fields, *added])
    out = docs.withColumns({f.name: F.lit(0).cast("long") if k == 0 else F.array().cast(f.dataType) for k, f in enumerate(added)})
    for items in blocks(benchmark, item_id, item_text, block_bytes):
        held, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches, held=held, key=key):
            found = _index(key, held, width)
            for whole in batches:
                for batch in slices(whole, text_col):
                    yield _scan_batch(batch, text_col, found)

        out = out.mapInArrow(run, schema)
    return out


def _scan_batch(batch: pa.RecordBatch, text_col: str, found: Index) -> pa.RecordBatch:
    n = batch.num_columns - 3
    counts, spans, items = [], batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist()
    for i, text in enumerate(utf8(batch.column(text_col))):
        words, hits = found.scan(text)
        counts.append(words)
        if hits:
            runs: list[list[int]] = []
            for a, b in sorted([*map(tuple, spans[i]), *((a, b) for a, b, _ in hits)]):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            spans[i] = runs
            items[i] = sorted({*items[i], *(name for _, _, name in hits)})
    new = [pa.array(x, t) for x, t in zip((counts, spans, items), batch.schema.types[n:], strict=True)]
    return pa.RecordBatch.from_arrays([*batch.columns[:n], *new], names=batch.schema.names)


def byte_offsets(text: str, span: tuple[int, int]) -> tuple[int, int]:
    """Where words span[0]..span[1]-1 stand in a text: first and end byte of its UTF-8."""
    raw = text.encode()
    kept = np.concatenate(([0], (np.frombuffer(raw.translate(ALNUM), np.uint8) != 32).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(kept))
    return int(edges[2 * span[0]]), int(edges[2 * span[1] - 1])


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of find_contamination by doc_id; nulls, repeats, empty tables and other columns as there."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs without a hit, with the columns of docs, whatever their names.

    Null and empty texts stay; repeated rows share their fate; an empty benchmark drops nothing; an empty table stays empty.
    """
    names = tuple(free_names(docs, "n_words", "spans", "items"))
    return find_contamination(docs, benchmark, text_col, names=names).where(F.size(names[1]) == 0).select(*docs.columns)


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(ids))).encode()).hexdigest()
