"""String similarities without a built-in: Jaro-Winkler over whole Arrow batches, and the matching-blocks ratio."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DoubleType

#: Fixed values of the Winkler bonus: what a letter in common at the start is worth, and how many count.
SCALE, PREFIX = 0.1, 4


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of texts as a matrix of code points, zero behind the end of each, and the lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), max(1, int(sizes.max(initial=0)))), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), "<i4")
    return out, sizes


def _in_order(codes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen characters of each row moved to its start."""
    row, column = np.nonzero(chosen)
    out = np.zeros_like(codes)
    out[row, (np.cumsum(chosen, axis=1) - 1)[row, column]] = codes[row, column]
    return out


def jaro_batch(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro similarity of each pair: all pairs advance together, a character of the left texts at a time."""
    (a, n), (b, m) = _codes(left), _codes(right)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)[:, None]
    column = np.arange(b.shape[1])
    free = column < m[:, None]
    met = np.zeros(a.shape, bool)
    rows = np.arange(len(left))
    for i in range(a.shape[1]):
        fits = free & (b == a[:, i : i + 1]) & (np.abs(column - i) <= reach) & (n > i)[:, None]
        at = fits.argmax(axis=1)
        met[:, i] = fits[rows, at]
        free[rows[met[:, i]], at[met[:, i]]] = False
    count = met.sum(axis=1)
    x, y = _in_order(a, met), _in_order(b, (column < m[:, None]) & ~free)
    width = min(x.shape[1], y.shape[1])  # no pair has more characters in common
    halves = (x[:, :width] != y[:, :width]).sum(axis=1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (count / n + count / m + (count - halves) / count) / 3
    return np.where((n == 0) & (m == 0), 1.0, np.where(count == 0, 0.0, score))


def jaro_winkler_batch(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro-Winkler of pairs, trimmed and in lower case; null is empty. Texts of similar length are scored together."""
    left, right = ([(t or "").strip().lower() for t in texts] for texts in (left, right))
    out = np.zeros(len(left))
    size = np.array([max(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64)
    order = np.argsort(size, kind="stable")
    start = 0
    while start < len(order):  # bounded cells of a matrix
        end = start + 1
        while end < len(order) and (end - start + 1) * (int(size[order[end]]) + 1) <= 1 << 20 and end - start < 1 << 14:
            end += 1
        part = order[start:end]
        x, y = [left[i] for i in part], [right[i] for i in part]
        base = jaro_batch(x, y)
        heads = [_codes([t[:PREFIX].ljust(PREFIX, fill) for t in texts])[0] for texts, fill in ((x, "\0"), (y, "\1"))]
        shared = np.cumprod(heads[0] == heads[1], axis=1).sum(axis=1)
        out[part] = base + shared * SCALE * (1 - base)
        start = end
    return out


class JaroTable:
    """Jaro-Winkler of texts of one list with those of another, as jaro_winkler_batch has it: the places of a letter in a text are the
    bits of a word. Texts that are empty or longer than WORD are compared one by one."""

    WORD = 64

    def __init__(self, left: list[str], right: list[str]):
        self.left, self.right = ([(t or "").strip().lower() for t in texts] for texts in (left, right))
        fits = lambda texts: np.array([0 < len(t) <= self.WORD for t in texts], bool)
        self.short = fits(self.left), fits(self.right)
        (self.a, self.n), (self.b, self.m) = (_codes([t if ok else "" for t, ok in zip(texts, short, strict=True)]) for texts, short in zip((self.left, self.right), self.short, strict=True))
        # what all texts begin with is met in its place
        self.start = len(commonprefix([t for texts, short in zip((self.left, self.right), self.short, strict=True) for t, ok in zip(texts, short, strict=True) if ok]))
        self.word = np.uint32 if max(self.a.shape[1], self.b.shape[1]) - self.start <= 32 else np.uint64
        a, b = self.a[:, self.start :], self.b[:, self.start :]
        letters = np.unique(b)
        self.masks = np.zeros((len(letters) + 1, len(b)), self.word)  # the last one for letters that right has not
        at, every = np.searchsorted(letters, b), np.arange(len(b))
        for i in range(b.shape[1]):
            here = self.m > i + self.start
            self.masks[at[here, i], every[here]] |= self.word(1 << i)
        place = np.minimum(np.searchsorted(letters, a), max(0, len(letters) - 1))
        inside = np.arange(self.start, self.a.shape[1]) < self.n[:, None]
        self.place = np.where(inside & (letters[place] == a if len(letters) else False), place, len(letters))

    def _met(self, n, m, rounds: int, places: Callable, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which letters of the left texts are met, the places of the right texts that are, letters in common) of texts of lengths n and m.
        places: (i, out) puts those of the left texts' letter i in the right texts into out."""
        bits, ones = np.iinfo(self.word).bits, self.word(np.iinfo(self.word).max)
        reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
        whole = np.where(m > self.start, ones >> np.clip(bits - (m - self.start), 0, bits - 1).astype(self.word), self.word(0))
        free, here, low = np.empty(shape, self.word), np.empty(shape, self.word), np.empty(shape, self.word)
        free[...] = whole
        met = np.empty((rounds, *shape), bool)
        for i in range(rounds):
            window = ones >> (bits - 1 - np.minimum(i + reach, bits - 1)).astype(self.word)
            if (i > reach).any():
                window = window & (ones << np.maximum(i - reach, 0).astype(self.word))
            places(i, here)
            here &= free
            here &= window
            np.negative(here, out=low)
            low &= here  # the first free place
            free ^= low
            np.not_equal(low, 0, out=met[i])
        return met, free ^ whole, met.sum(axis=0, dtype=np.uint8).astype(float) + self.start

    def _halves(self, met: np.ndarray, free: np.ndarray, count: np.ndarray, places: Callable) -> np.ndarray:
        """Half the number of letters in common that stand in another order. met, free, count: see _met; free is used up."""
        here, low, same = np.empty_like(free), np.empty_like(free), np.empty(met.shape, bool)
        for i in range(len(met)):
            np.negative(free, out=low)
            low &= free  # the next place that was met
            low *= met[i]
            free ^= low
            places(i, here)
            here &= low
            np.not_equal(here, 0, out=same[i])
        return (count - self.start - same.sum(axis=0, dtype=np.uint8)) / 2

    @staticmethod
    def _score(count: np.ndarray, halves, n, m) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(count == 0, 0.0, (count / n + count / m + (count - halves) / count) / 3)

    def _with_prefix(self, base: np.ndarray, head, n, other, m) -> np.ndarray:
        """base and the bonus of letters in common at the start. head, other: functions of a place."""
        alike, shared = np.ones(base.shape, bool), np.zeros(base.shape)
        for c in range(min(PREFIX, self.a.shape[1], self.b.shape[1])):
            alike &= (head(c) == other(c)) & (n > c) & (m > c)
            shared += alike
        return base + shared * SCALE * (1 - base)

    def of_pairs(self, i: np.ndarray, j: np.ndarray, least: float = 0.0) -> np.ndarray:
        """The similarity of each pair of a left position of i and a right one of j; 0 where too few letters are in common for least."""
        out, plain = np.zeros(len(i)), ~(self.short[0][i] & self.short[1][j])
        if plain.any():
            out[plain] = jaro_winkler_batch([self.left[k] for k in i[plain]], [self.right[k] for k in j[plain]])
        rest = np.flatnonzero(~plain)
        for k in range(0, len(rest), 1 << 13):
            part = rest[k : k + (1 << 13)]
            x, y = i[part], j[part]
            n, m, rows = self.n[x], self.m[y], np.ascontiguousarray(self.place[x].T) * len(self.m) + y

            def places(c, here):
                np.take(self.masks, rows[c], out=here, mode="clip")

            met, free, count = self._met(n, m, max(0, int(n.max()) - self.start), places, part.shape)
            full = lambda halves: self._with_prefix(self._score(count, halves, n, m), lambda c: self.a[x, c], n, lambda c: self.b[y, c], m)  # noqa: B023, E731
            if least > 0:
                can = full(0.0) >= least
                part, x, y, n, m, rows, met, free, count = part[can], x[can], y[can], n[can], m[can], rows[:, can], met[:, can], free[can], count[can]
            out[part] = full(self._halves(met, free, count, places))
        return out

    def whole(self) -> np.ndarray:
        """The similarity of each left text with each right one."""
        out = np.zeros((len(self.left), len(self.right)))
        i, j = np.nonzero(~(self.short[0][:, None] & self.short[1]))
        if len(i):
            out[i, j] = self.of_pairs(i, j)
        columns = np.flatnonzero(self.short[1])
        step, m, masks = max(1, (1 << 15) // max(1, len(columns))), self.m[columns], self.masks[:, columns]
        for size in np.unique(self.n[self.short[0]]) if len(columns) else ():
            rows = np.flatnonzero(self.short[0] & (self.n == size))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                codes = self.place[part].T

                def places(c, here):
                    np.take(masks, codes[c], axis=0, out=here, mode="clip")

                met, free, count = self._met(int(size), m, int(size) - self.start, places, (len(part), len(columns)))
                base = self._score(count, self._halves(met, free, count, places), size, m)
                out[np.ix_(part, columns)] = self._with_prefix(base, lambda c: self.a[part, c, None], size, lambda c: self.b[None, columns, c], m)
        return out


def _distinct(score, a: pd.Series, b: pd.Series) -> pd.Series:
    """score of a batch's different pairs, each computed once."""
    pairs = pd.DataFrame({"a": a, "b": b})
    different = pairs.drop_duplicates()
    found = different.assign(score=score(different["a"].tolist(), different["b"].tolist()))
    return pairs.merge(found, how="left", on=["a", "b"])["score"].astype("float64")


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return _distinct(jaro_winkler_batch, a, b)


def ratio(a: str | None, b: str | None) -> float:
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _distinct(lambda x, y: [ratio(*p) for p in zip(x, y, strict=True)], a, b)


def best_batch(a: list, b: list) -> np.ndarray:
    """The best Jaro-Winkler of any string of the one array with any of the other; 0 where one is empty or null."""
    pairs = [(i, x, y) for i, (xs, ys) in enumerate(zip(a, b, strict=True)) for x in ([] if xs is None else xs) for y in ([] if ys is None else ys)]
    out = np.zeros(len(a))
    if pairs:
        row, x, y = zip(*pairs, strict=True)
        np.maximum.at(out, np.array(row), jaro_winkler_batch(list(x), list(y)))
    return out


@F.pandas_udf(DoubleType())
def best_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(best_batch(a, b))


def ratio_batch(left: list[str], right: list[str]) -> list[float]:
    """The ratio of each pair; of equal pairs it is computed once."""
    found = {pair: ratio(*pair) for pair in set(zip(left, right, strict=True))}
    return [found[pair] for pair in zip(left, right, strict=True)]


def at_least(pairs: DataFrame, left: str, right: str, score, threshold: float, digits: int | None = None) -> DataFrame:
    """The rows of pairs for which score (of lists of strings) is the threshold or more, with it as `score`, rounded to digits.

    Unlike a filter by a function, it isn't moved below what makes pairs distinct, and scores each once.
    """
    schema = T.StructType([*pairs.schema.fields, T.StructField("score", T.DoubleType())])
    at = pairs.columns.index(left), pairs.columns.index(right)

    def run(batches):
        for batch in batches:
            found = np.array(score(*(batch.column(i).to_pylist() for i in at)), float)
            found = found if digits is None else np.round(found, digits)
            kept = pa.array(np.flatnonzero(found >= threshold))
            yield pa.RecordBatch.from_arrays([*[c.take(kept) for c in batch.columns], pa.array(found[found >= threshold])], names=schema.names)

    return pairs.mapInArrow(run, schema)


def register(spark: SparkSession) -> None:
    """The similarities for SQL; stable_id and normalize_value are registered as SQL functions."""
    spark.udf.register("jaro_winkler", jaro_winkler)
    spark.udf.register("seq_ratio", sequence_ratio)
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION normalize_value(v STRING) RETURNS STRING
        RETURN regexp_replace(regexp_replace(trim(lower(v)), '\\s+', ' '), '[^a-z0-9 ._:/-]', '')""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION stable_id(parts ARRAY<STRING>) RETURNS STRING
        RETURN substring(sha1(array_join(filter(parts, p -> p <> ''), '|')), 1, 24)""")
