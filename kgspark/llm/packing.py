"""Best-fit packing of tokenised documents into sequences of a fixed length, by patterns fitted to the length histogram.

Patterns are multisets of a few lengths that fill a sequence. Non-negative least squares fits how often each is used to the
histogram of piece lengths (at most `capacity` numbers, whatever the corpus); the counts are rounded down and what is left
is packed best-fit by length. Documents are then dealt to the planned places by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kgspark.llm.text import slices
from kgspark.shared import cut

#: Words that a worker remembers.
MAX_WORDS = 800_000
#: ASCII characters that are neither letters nor digits nor white space: a run of them is a pre-token.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


class WordTokenizer:
    """Ids of a tokenizer that never joins text over white space, as little-endian bytes, remembered by word."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {"": b""}
        #: Whether an id ends a word.
        ends = [self.tokenizer.id_to_token(i).endswith("</w>") for i in range(self.tokenizer.get_vocab_size())]
        self.ends = np.array(ends, bool)

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text starts in them; at last, where all end.

        The words are coded by Arrow, so that a word that stands often in a batch is looked up once.
        """
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        found = self.lookup(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), "<u4")
        codes = coded.indices.to_numpy()
        many = sizes[codes]
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - many), many) + np.arange(total)
        offsets = words.offsets.to_numpy()
        return pool[at], np.concatenate(([0], ends))[offsets - offsets[0]]

    def lookup(self, words: list[str]) -> list[bytes]:
        if len(self.memo) > MAX_WORDS:
            self.memo = {"": b""}
        found = list(map(self.memo.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            self.learn([words[i] for i in new])
            for i in new:
                found[i] = self.memo[words[i]]
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        flat, starts = self.flat(pa.array(texts, pa.string()))
        raw = flat.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]

    def learn(self, words: list[str]) -> None:
        """Remembers new words. One of letters and then marks is the ids of both; case makes no difference to ASCII letters."""
        memo, split = self.memo, []
        wanted: set[str] = set()
        for w in words:
            stem = w.rstrip(MARKS)
            low = stem.lower()
            # letters that neither lower-casing nor composition turns into letters and marks, which would go on in what follows
            if low.isalpha() and (stem.isascii() or normalize("NFC", stem).isalpha()):
                low = low if stem.isascii() else stem
                split.append((w, low, w[len(stem) :]))
                wanted.update((low, w[len(stem) :]))
            else:
                wanted.add(w)
        wanted = {w for w in wanted if w not in memo}
        letters = [w for w in wanted if w.lower().isalpha()]
        for i in range(0, len(letters), 5000):
            part = letters[i : i + 5000]
            memo.update(zip(part, self.joined(part), strict=True))
        mixed = list(wanted.difference(letters))
        for i in range(0, len(mixed), 5000):
            part = mixed[i : i + 5000]
            memo.update(zip(part, self.each(part), strict=True))
        for w, low, marks in split:
            memo[w] = memo[low] + memo[marks]

    def each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def joined(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, encoded as one text: each gives one word end, which parts them again.

        Where normalisation makes more than one pre-token of a word, the number of ends shows it and each is encoded alone.
        """
        found = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = 4 * (np.flatnonzero(self.ends[found]) + 1)
        if len(cuts) != len(words):
            if len(words) == 1:
                return self.each(words)
            half = len(words) // 2
            return self.joined(words[:half]) + self.joined(words[half:])
        raw = found.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, kept over tasks."""
    return WordTokenizer(path)


def tokenize_pieces(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, capacity: int, with_ids: bool) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, its part and its rank in the part among its length."""
    kind = docs.schema[id_col]
    fields = [T.StructField("id", kind.dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "part", "place")]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids
    schema = T.StructType(fields)

    def run(batches):
        own, seen = word_tokenizer(vocabulary), Counter()
        part = TaskContext.get().partitionId()
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, starts = own.flat(pc.fill_null(batch.column("text").cast(pa.string()), ""))
                rows = np.arange(batch.num_rows)
                ended = np.zeros(len(flat) + len(rows), "<u4")  # every document with its id 0
                ended[np.arange(len(flat)) + np.repeat(rows, np.diff(starts))] = flat
                sizes = np.diff(starts) + 1
                pieces = -(-sizes // capacity)
                row = np.repeat(rows, pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                at = (starts[:-1] + rows)[row] + start
                raw = memoryview(ended.tobytes())
                cuts = list(zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True))
                places = []
                for n in length.tolist():
                    places.append(seen[n])
                    seen[n] += 1
                numbers = (start, length, np.array([zlib.crc32(raw[a:b]) for a, b in cuts], np.int64), np.full(len(row), part), np.array(places, np.int64))
                arrays = [batch.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in numbers]]
                if with_ids:
                    arrays.append(pa.array([bytes(raw[a:b]) for a, b in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def enumerate_patterns(lengths: list[int], counts: np.ndarray, capacity: int, per_length: int = 6) -> list[tuple[int, ...]]:
    """Multisets of one to three lengths that fill a sequence, or come nearest among the lengths there are."""
    have = np.array(sorted(lengths))
    out: set[tuple[int, ...]] = {(n,) for n in lengths}
    common = [int(have[i]) for i in np.argsort(-counts[have], kind="stable")[:64]]
    for a in lengths:
        i = int(np.searchsorted(have, capacity - a, "right")) - 1
        for j in range(i, max(-1, i - 2), -1):
            out.add(tuple(sorted((a, int(have[j])), reverse=True)))
        made = 0
        for b in [*common, *have[::-1].tolist()]:
            rest = capacity - a - b
            if rest < have[0] or made >= per_length:
                continue
            c = int(have[np.searchsorted(have, rest, "right") - 1])
            if c == rest:
                out.add(tuple(sorted((a, b, c), reverse=True)))
                made += 1
    return sorted(p for p in out if sum(p) <= capacity)


def fit_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray, capacity: int, sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares of pattern uses to the histogram, by coordinate descent.

    A pattern that leaves a sequence unfilled is charged for it, so that exact patterns are used first.
    """
    use = np.zeros(len(patterns))
    left = histogram.astype(float).copy()
    columns = [(list(c), np.array([c[k] for k in c], float)) for c in map(Counter, patterns)]
    norms = [float(v @ v) for _, v in columns]
    waste = np.array([capacity - sum(p) for p in patterns], float)
    charge = waste / capacity * max(1.0, histogram.max() / 4)
    order = np.argsort(waste, kind="stable")
    for _ in range(sweeps):
        moved = 0.0
        for p in order:
            at, v = columns[p]
            step = (float(left[at] @ v) - charge[p]) / norms[p]
            new = max(0.0, use[p] + step)
            if new != use[p]:
                left[at] -= (new - use[p]) * v
                moved = max(moved, abs(new - use[p]))
                use[p] = new
        if moved < 0.05:
            break
    return use


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over lengths with multiplicity: [([(length, copies)], sequences)]."""
    bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for n in sorted(histogram, reverse=True):
        todo = histogram[n]
        for room in sorted(r for r in bins if r >= n):
            groups, bins[room] = bins[room], []
            for content, many in groups:
                fit = min(room // n, -(-todo // many)) if todo else 0
                if not fit:
                    bins[room].append((content, many))
                    continue
                whole = min(many, todo // fit)
                if whole:
                    bins.setdefault(room - fit * n, []).append(([*content, (n, fit)], whole))
                    todo -= whole * fit
                rest = many - whole
                if rest and 0 < todo < fit:
                    bins.setdefault(room - todo * n, []).append(([*content, (n, todo)], 1))
                    todo, rest = 0, rest - 1
                if rest:
                    bins[room].append((content, rest))
        if todo:
            fit = capacity // n
            if todo // fit:
                bins.setdefault(capacity - fit * n, []).append(([(n, fit)], todo // fit))
            if todo % fit:
                bins.setdefault(capacity - todo % fit * n, []).append(([(n, todo % fit)], 1))
    return [g for room in sorted(bins) for g in bins[room]]


def plan(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Places by length and rank: rank r >= lo of a length goes to sequence first + (r - lo) % many, at offset + copy * length."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in histogram.items():
        counts[n] = c
    uses: list[tuple[list[tuple[int, int]], int]] = []
    lengths = [int(n) for n in np.flatnonzero(counts) if n < capacity]
    if counts[capacity]:
        uses.append(([(capacity, 1)], int(counts[capacity])))
        counts[capacity] = 0
    if lengths:
        patterns = enumerate_patterns(lengths, counts, capacity)
        fitted = fit_counts(patterns, counts, capacity)
        for p in sorted(range(len(patterns)), key=lambda p: (capacity - sum(patterns[p]), -fitted[p])):
            need = Counter(patterns[p])
            many = min([int(fitted[p]), *(int(counts[n]) // k for n, k in need.items())])
            if many > 0 and sum(patterns[p]) == capacity:
                uses.append((sorted(need.items(), reverse=True), many))
                for n, k in need.items():
                    counts[n] -= many * k
        uses += best_fit({int(n): int(counts[n]) for n in np.flatnonzero(counts)}, capacity)
    rows, first, given = [], 0, Counter()
    for content, many in uses:
        offset = 0
        for n, copies in content:
            rows.append((n, given[n], first, many, offset))
            given[n] += many * copies
            offset += n * copies
        first += many
    rows.sort()
    names = ("length", "lo", "first", "many", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def place(places: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces. scale: above every rank."""
    key = places["length"] * scale + places["lo"]
    at = np.searchsorted(key, length * scale + rank, "right") - 1
    r, many = rank - places["lo"][at], places["many"][at]
    return places["first"][at] + r % many, places["offset"][at] + r // many * length


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, with_ids).

    A document is its ids and then id 0; only documents longer than capacity are cut. A null or empty text is one piece of
    length 1. Repeated rows are packed each; null ids stay null; other columns are ignored; an empty table gives an empty
    result. Ranks come from counts by part and length, so that a length with very many pieces is never in one task.
    """
    pieces = cut(tokenize_pieces(docs, vocabulary, id_col, text_col, capacity, with_ids), "pieces")
    counts = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    places = plan(histogram, capacity)
    scale = max([1, *histogram.values()]) + 1
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = cut(counts.select("part", "length", before.alias("base")), "bases")
    ranked = pieces.hint("merge").join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    held = docs.sparkSession.sparkContext.broadcast(places)  # a few rows for each length
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = T.StructType([*[pieces.schema[c] for c in names], *[T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]])

    def run(batches):
        for batch in batches:
            sequence, offset = place(held.value, *(batch.column(c).to_numpy() for c in ("length", "rank")), scale)
            arrays = [*(batch.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return ranked.select(*names, "rank").mapInArrow(run, schema)
