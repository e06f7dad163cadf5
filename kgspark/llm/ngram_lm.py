"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped arrays.

Words are 64-bit hashes. Each task counts the word pairs of its texts and sends, for each shard of contexts, sorted arrays
of contexts, successors and counts; the owner of a shard merges them and writes sorted hash arrays into the shared folder.
Contexts that are so frequent that one shard could not hold their successors are dealt over all shards by pair, and their
partial sums are added up. Continuation counts go to shards of words in the same way. Scoring workers map these files and look up
a batch of pairs at a time. Nothing that grows with the corpus passes the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.text import LOWER, slices, utf8
from kgspark.shared import cut, shared_dir

#: Marks before the first and after the last word; no word holds a space.
BEGIN = xxhash.xxh64_intdigest(b" <s>").to_bytes(8, "little")
END = xxhash.xxh64_intdigest(b" </s>").to_bytes(8, "little")
#: Words of a task counted at once, words in a worker's memo, and bytes of text for each shard of the model.
COUNT_WORDS, MEMO_WORDS, SHARD_BYTES = 2_000_000, 300_000, 8 << 20
#: Texts looked at for the frequent contexts, at most; shares of a shard from which a context is dealt over all. They decide where
#: counts are kept, and no count depends on them.
SAMPLE_ROWS, HOT_SHARDS = 20_000, 4.0


class Hashes(dict):
    """Word -> its XXH64 as 8 bytes, remembered up to a bound."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > MEMO_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word).to_bytes(8, "little")
        return found


def sentences(texts: list[bytes], memo: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of begin, words, end of each text, one after the other, and where each text starts."""
    parts, sizes = [], []
    for t in texts:
        words = t.translate(LOWER).split()
        parts.append(BEGIN + b"".join([memo[w] for w in words]) + END)
        sizes.append(len(words) + 2)
    return np.frombuffer(b"".join(parts), "<u8"), np.concatenate(([0], np.cumsum(sizes)))


def pairs_of(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and words of all pairs inside texts."""
    inside = np.ones(len(flat) - 1, bool) if len(flat) else np.ones(0, bool)
    begin = np.uint64(int.from_bytes(BEGIN, "little"))
    inside &= flat[1:] != begin
    return flat[:-1][inside], flat[1:][inside]


def distinct_pairs(v: np.ndarray, w: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs and their counts."""
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(v))) if n is None else np.add.reduceat(n[order], at) if len(at) else n[:0]
    return v[at], w[at], counts.astype(np.int64)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and where each starts."""
    at = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, int)
    return sorted_values[at], at


def shard_of(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs."""
    with np.errstate(over="ignore"):
        x = (v * np.uint64(0x9E3779B97F4A7C15)) ^ (w + (v >> np.uint64(29)))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(31))


def pair_shards(v: np.ndarray, w: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """The shard of each pair: its context's, or its own if the context is a hot one (hot: sorted)."""
    shard = shard_of(v, bits)
    if len(hot):
        many = np.isin(v, hot)
        shard[many] = shard_of(pair_keys(v[many], w[many]), bits)
    return shard


def _send(v: np.ndarray, w: np.ndarray, bits: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    v, w, n = distinct_pairs(v, w)
    shard = pair_shards(v, w, bits, hot)
    order = np.argsort(shard, kind="stable")
    v, w, n, shard = v[order], w[order], n[order], shard[order]
    cuts = np.searchsorted(shard, np.arange((1 << bits) + 1))
    rows: list[tuple] = []
    for s in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[s], cuts[s + 1]
        context, at = runs(v[a:b])
        sizes = np.diff(np.append(at, b - a))
        # counts of a batch are below 2^32
        rows.append((int(s), context.tobytes(), sizes.astype("<u4").tobytes(), w[a:b].tobytes(), n[a:b].astype("<u4").tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = [pa.int32(), *[pa.binary()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "context", "sizes", "word", "n"])


def _counter(bits: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held_v, held_w, held = Hashes(), [], [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                v, w = pairs_of(sentences(utf8(batch.column("text")), memo)[0])
                held_v.append(v)
                held_w.append(w)
                held += len(v)
                if held >= COUNT_WORDS:
                    yield from _send(np.concatenate(held_v), np.concatenate(held_w), bits, hot)
                    held_v, held_w, held = [], [], 0
        if held:
            yield from _send(np.concatenate(held_v), np.concatenate(held_w), bits, hot)

    return run


def save(path: str, array: np.ndarray) -> None:
    """Whole or not at all, so that a task may run twice."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, array)
    os.replace(own, path)


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _merge_pairs(folder: str, bits: int, hot: np.ndarray):
    """Of a shard of contexts: writes its pairs and contexts, sends continuation counts, sums, and its part of hot contexts."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        v = np.repeat(_joined(table.column("context"), "<u8"), _joined(table.column("sizes"), "<u4"))
        v, w, n = distinct_pairs(v, _joined(table.column("word"), "<u8"), _joined(table.column("n"), "<u4").astype(np.int64))
        keys = pair_keys(v, w)
        order = np.argsort(keys)
        save(f"{folder}/pair-{shard}.npy", keys[order])
        save(f"{folder}/pair-n-{shard}.npy", np.minimum(n[order], 65535).astype("<u2"))
        big = order[n[order] > 65534]
        save(f"{folder}/pair-big-{shard}.npy", np.stack((keys[big], n[big].astype("<u8"))))
        context, at = runs(v)
        total = np.add.reduceat(n, at)
        by = [np.add.reduceat(x.astype(np.int64), at) for x in (n == 1, n == 2, n >= 3)]
        sums_of = np.stack((total, *by))
        part = np.isin(context, hot)
        hot_context, hot_sums = context[part], sums_of[:, part]
        context, own_sums = context[~part], sums_of[:, ~part]
        save(f"{folder}/context-{shard}.npy", context)
        save(f"{folder}/context-n-{shard}.npy", own_sums.astype("<u4" if own_sums.max(initial=0) < 2**32 else "<u8"))
        w = np.sort(w)
        word, at = runs(w)
        kinds = np.diff(np.append(at, len(w))).astype("<u4")
        owner = shard_of(word, bits)
        cuts = np.searchsorted(owner, np.arange((1 << bits) + 1))
        full = np.flatnonzero(np.diff(cuts))
        sums = {f"n{i}": int((n == i).sum()) for i in range(1, 5)} | {"pairs": len(n), "tokens": int(total.sum()), "types": len(context)}
        rows = len(full)
        return pa.table(
            {
                "shard": pa.array(full, pa.int32()),
                "word": pa.array([word[cuts[s] : cuts[s + 1]].tobytes() for s in full], pa.binary()),
                "n": pa.array([kinds[cuts[s] : cuts[s + 1]].tobytes() for s in full], pa.binary()),
                "hot": pa.array([hot_context.tobytes()] + [b""] * (rows - 1), pa.binary()),
                "hot_sums": pa.array([hot_sums.astype("<i8").tobytes()] + [b""] * (rows - 1), pa.binary()),
                **{k: pa.array([x] + [0] * (rows - 1), pa.int64()) for k, x in sums.items()},
            }
        )

    return run


def _merge_words(folder: str):
    """Of a shard of words: writes continuation counts, sends sums."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        word, kinds = _joined(table.column("word"), "<u8"), _joined(table.column("n"), "<u4").astype(np.int64)
        order = np.argsort(word, kind="stable")
        word, at = runs(word[order])
        kinds = np.add.reduceat(kinds[order], at)
        save(f"{folder}/word-{shard}.npy", word)
        save(f"{folder}/word-n-{shard}.npy", kinds.astype("<u4"))
        return pa.table({f"n{i}": pa.array([int((kinds == i).sum())], pa.int64()) for i in range(1, 5)} | {"more": pa.array([int((kinds >= 3).sum())], pa.int64())})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float, float]:
    """Discounts for counts 0, 1, 2 and 3 or more; 0 to the count, also where counts of counts are missing."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    d = [i - (i + 1) * y * more / have if have else i * 0.5 for i, have, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return (0.0, *(min(max(x, 0.0), float(i)) for i, x in enumerate(d, 1)))


class Model:
    """Looks pairs up in the mapped arrays of a folder. spec: bits and the model's sums."""

    def __init__(self, folder: str, spec: dict):
        self.folder, self.spec, self.open = folder, spec, {}

    def array(self, name: str) -> np.ndarray | None:
        if name not in self.open:
            path = f"{self.folder}/{name}.npy"
            self.open[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.open[name]

    def find(self, kind: str, shard: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
        """Rows of counts of keys, zero where there is none. kind: the arrays' name."""
        out = np.zeros((width, len(keys)), np.int64)
        order = np.lexsort((keys, shard))
        at = np.searchsorted(shard[order], np.arange((1 << self.spec["bits"]) + 1))
        for s in np.flatnonzero(np.diff(at)):
            own = order[at[s] : at[s + 1]]
            have = self.array(f"{kind}-{s}")
            if have is None or not len(have):
                continue
            wanted = keys[own]
            place = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
            hit = have[place] == wanted
            counts = np.atleast_2d(self.array(f"{kind}-n-{s}"))
            out[:, own[hit]] = counts[:, place[hit]]
            if kind == "pair":
                big, total = self.array(f"pair-big-{s}")
                if len(big):
                    by = np.argsort(big)
                    p = np.minimum(np.searchsorted(big, wanted, sorter=by), len(big) - 1)
                    same = big[by[p]] == wanted
                    out[0, own[same]] = total[by[p[same]]]
        return out

    def score(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known tokens, base score, log10 probability."""
        spec, bits = self.spec, self.spec["bits"]
        types, back = np.unique(flat, return_inverse=True)
        kind = shard_of(types, bits)
        context = self.find("context", kind, types, 4)
        hot = self.array("hot")
        if len(hot):
            place = np.minimum(np.searchsorted(hot, types), len(hot) - 1)
            hit = hot[place] == types
            context[:, hit] = self.array("hot-n")[:, place[hit]]
        follows = self.find("word", kind, types, 1)[0]
        end, begin = (int.from_bytes(x, "little") for x in (END, BEGIN))
        count = context[0].copy()
        count[types == np.uint64(end)] = spec["texts"]
        count[types == np.uint64(begin)] = 0
        d = np.array(spec["d_words"])
        spare = (d[1] * spec["w1"] + d[2] * spec["w2"] + d[3] * spec["w3"]) / spec["pairs"] if spec["pairs"] else 1.0
        lower = np.maximum(follows - d[np.minimum(follows, 3)], 0) / max(spec["pairs"], 1) + spare / (spec["types"] + 1)
        i = np.flatnonzero(np.concatenate(([False], flat[1:] != np.uint64(begin)))) if len(flat) else np.zeros(0, int)
        v, w = back[i - 1], back[i]
        seen = self.find("pair", pair_shards(types[v], types[w], bits, hot), pair_keys(types[v], types[w]), 1)[0]
        d = np.array(spec["d_pairs"])
        total = context[0][v]
        spare = d[1] * context[1][v] + d[2] * context[2][v] + d[3] * context[3][v]
        p = np.where(total > 0, (np.maximum(seen - d[np.minimum(seen, 3)], 0) + spare * lower[w]) / np.maximum(total, 1), lower[w])
        base = np.log10((count[w] + 0.5) / (spec["tokens"] + 0.5 * (spec["types"] + 1)))
        text = np.searchsorted(starts, i, "right") - 1
        sums = [np.bincount(text, x, len(starts) - 1) for x in ((count[w] > 0), base, np.log10(np.maximum(p, 1e-300)))]
        return np.diff(starts) - 1, sums[0].astype(np.int64), sums[1], sums[2]


@lru_cache(maxsize=2)
def opened(folder: str, spec: tuple) -> Model:
    return Model(folder, dict(spec))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Hashes()
    for whole in batches:
        for batch in slices(whole, "text"):
            word, n = np.unique(sentences(utf8(batch.column("text")), memo)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view("<i8")), pa.array(n, pa.int64())], names=["word", "n"])


def hot_contexts(texts: DataFrame, rows: int, shards: int, hot_shards: float = HOT_SHARDS) -> np.ndarray:
    """Hashes, sorted, of the words (and marks) that are more than hot_shards shards' share of a sample of the texts."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    chosen = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    counts = cut(chosen.mapInArrow(_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "sample-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") > total * hot_shards / shards).select("word").toArrow()  # shards / hot_shards at most
    return np.sort(found.column("word").to_numpy().astype("<i8").view("<u8"))


def train(docs: DataFrame, text_col: str = "text", hot_shards: float = HOT_SHARDS) -> tuple[str, dict]:
    """Counts docs; the model's folder (in the shared one) and its sums. Null and empty texts are a begin and an end."""
    spark = docs.sparkSession
    where = urlparse(shared_dir(spark))
    if where.scheme not in ("", "file"):
        raise ValueError("the model's arrays are memory-mapped: spark.checkpoint.dir must be a mounted file system")
    folder = f"{where.path}/lm-{uuid.uuid4().hex}"
    texts = docs.select(docs[text_col].alias("text"))
    size = texts.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    bits = max(4, int(np.ceil(np.log2(max(1, size["bytes"] / SHARD_BYTES)))))
    os.makedirs(folder, exist_ok=True)
    hot = hot_contexts(texts, size["texts"], 1 << bits, hot_shards)
    counted = texts.mapInArrow(_counter(bits, hot), "shard int, context binary, sizes binary, word binary, n binary")
    sums = "n1 long, n2 long, n3 long, n4 long, pairs long, tokens long, types long"
    merged = counted.groupBy("shard").applyInArrow(_merge_pairs(folder, bits, hot), f"shard int, word binary, n binary, hot binary, hot_sums binary, {sums}")
    shards = cut(merged, "continuations")
    hot_types = _save_hot(shards, folder)
    total = shards.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "pairs", "tokens", "types")]).first().asDict()
    total["types"] += hot_types
    words = shards.select("shard", "word", "n").groupBy("shard").applyInArrow(_merge_words(folder), "n1 long, n2 long, n3 long, n4 long, more long")
    own = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "more")]).first()
    spec = {
        "bits": bits, "texts": size["texts"], "tokens": total["tokens"], "types": total["types"], "pairs": total["pairs"],
        "d_pairs": discounts(*(total[f"n{i}"] for i in range(1, 5))), "d_words": discounts(*(own[f"n{i}"] for i in range(1, 5))),
        "w1": own["n1"], "w2": own["n2"], "w3": own["more"],
    }
    return folder, spec


def _save_hot(shards: DataFrame, folder: str) -> int:
    """Adds up the parts of hot contexts and writes them; their number."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for context, sums in zip(batch.column("hot").to_pylist(), batch.column("hot_sums").to_pylist(), strict=True):
                own = np.frombuffer(context, "<i8")
                parts = np.frombuffer(sums, "<i8").reshape(4, -1) if len(own) else np.zeros((4, 0), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, *parts)], names=["context", "s0", "s1", "s2", "s3"])

    parts = shards.select("hot", "hot_sums").mapInArrow(run, "context long, s0 long, s1 long, s2 long, s3 long")
    found = parts.groupBy("context").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(4)]).toArrow()  # a row for each hot context
    context = found.column("context").to_numpy().astype("<i8").view("<u8")
    order = np.argsort(context)
    save(f"{folder}/hot.npy", context[order])
    save(f"{folder}/hot-n.npy", np.stack([found.column(f"s{i}").to_numpy().astype("<i8") for i in range(4)])[:, order])
    return len(context)


def score(docs: DataFrame, model: tuple[str, dict], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id and text with n_tokens, n_known, train_tokens, base_score, score; narrow. A null text is its end alone."""
    folder, spec = model
    frozen = tuple(spec.items())
    kept = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    fields = [("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")]
    schema = T.StructType([kept.schema["id"], *[T.StructField(n, T.LongType() if t == "long" else T.DoubleType()) for n, t in fields]])

    def run(batches):
        memo = Hashes()
        for whole in batches:
            for batch in slices(whole, "text"):
                n, known, base, full = opened(folder, frozen).score(*sentences(utf8(batch.column("text")), memo))
                tokens = pa.array(np.full(len(n), spec["tokens"]), pa.int64())
                arrays = [batch.column("id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), tokens, pa.array(base), pa.array(full)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return kept.mapInArrow(run, schema)


def fold(id_col: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def lm_report(docs: DataFrame) -> DataFrame:
    """Scores of all docs by the model of those whose fold is not 1.

    Null texts count as empty; repeated rows are counted and scored each; an empty table gives an empty result; other columns
    are ignored.
    """
    pairs = docs.select("doc_id", "text")
    model = train(pairs.where(fold(F.col("doc_id")) != 1))
    return score(pairs, model).select(F.col("id").alias("doc_id"), (fold(F.col("id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
