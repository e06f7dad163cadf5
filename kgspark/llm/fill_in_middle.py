"""Fill-in-middle transformation: a text is cut at two unit boundaries and its parts are written in another order.

Boundaries are found in the UTF-8 bytes of a whole Arrow batch as 64-bit words: arithmetic on a word marks the bytes that end a
unit, a popcount for each word and their running sum lead to the word that holds the wanted end, and a select within the word
gives the byte. Texts are never decoded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.text import free_names, slices

#: Sentinels before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts those that stay plain, and of a hundred others those that are written suffix first.
PLAIN, SUFFIX_FIRST = 10, 20

_ONES, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_LOW7, _NEWLINES = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x0A0A0A0A0A0A0A0A)


def _shift(n: int) -> np.uint64:
    return np.uint64(n)


def code_point_ends(words: np.ndarray) -> np.ndarray:
    """A 1 in each byte that ends a code point: the byte after it is no continuation byte (10xxxxxx)."""
    starts = (~(words >> _shift(7)) | words >> _shift(6)) & _ONES
    after = np.append(starts[1:], np.uint64(1))
    return starts >> _shift(8) | after << _shift(56)


def line_ends(words: np.ndarray) -> np.ndarray:
    """A 1 in each byte that is a line feed: no bit is left of it after an exclusive or, found without a carry between bytes."""
    rest = words ^ _NEWLINES
    return ~((rest & _LOW7) + _LOW7 | rest) >> _shift(7) & _ONES


UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"char": code_point_ends, "line": line_ends}


class UnitIndex:
    """Rank and select of unit ends over the bytes of a batch of texts, laid end to end. The end of a text ends a unit."""

    def __init__(self, texts: pa.Array, unit: str = "char"):
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = pc.fill_null(texts, b"")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        self.offsets = offsets - first
        padded = np.zeros((last - first + 7) // 8 * 8 + 8, np.uint8)  # a word more, so that every offset lies in a word
        if last > first:
            padded[: last - first] = np.frombuffer(data, np.uint8)[first:last]
        self.bytes = padded
        marks = UNITS[unit](padded.view("<u8")).view(np.uint8)
        marks[last - first :] = 0
        marks[self.offsets[1:][np.diff(self.offsets) > 0] - 1] = 1
        self.marks = marks.view("<u8")
        self.upto = np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)  # ends in all words up to each one

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ends in the bytes before each offset."""
        word, within = at >> 3, (at & 7).astype(np.uint64)
        mask = (np.uint64(1) << within * _shift(8)) - np.uint64(1)
        own = self.marks[word]
        return self.upto[word] - np.bitwise_count(own) + np.bitwise_count(own & mask)

    def select(self, n: np.ndarray) -> np.ndarray:
        """The offset behind the n-th end, n from 1."""
        word = np.searchsorted(self.upto, n, "left")
        own = self.marks[word]
        wanted = (n - (self.upto[word] - np.bitwise_count(own))).astype(np.uint64)
        sums = own * _ONES  # each byte: the ends in the word up to it, 8 at most
        less = ~((sums | _HIGH) - wanted * _ONES) & _HIGH  # bytes with fewer ends than wanted
        return (word << 3) + np.bitwise_count(less) + 1

    def counts(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(self.rank(self.offsets))

    def cut(self, units: np.ndarray) -> np.ndarray:
        """For each text the offset behind its first units[i] units."""
        starts = self.offsets[:-1]
        out = starts.copy()
        some = units > 0
        out[some] = self.select(self.rank(starts[some]) + units[some])
        return out


def _draws(df: DataFrame, key: Column, seed: int, names: list[str]) -> DataFrame:
    """Four numbers below 2^32 of the key: the first groups of eight digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return df.withColumns({c: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i, c in enumerate(names)})


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1,
    plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """docs with n (units of the text), form (plain, psm or spm), prefix_units, middle_units (null if plain) and output.

    unit: "char" for code points, "line" for lines with their line feeds. The cuts and the form follow from a hash of seed and
    id, so that a run gives the same again: `plain` of a hundred texts stay as they are, as do empty ones and those that hold a
    sentinel; `suffix_first` of a hundred others are spm. A null text counts as empty, a null id as one without digits; repeated
    rows are written each; an empty table stays empty; columns of docs pass through, and where one has a name of these, the new
    column gets a `_` more. Narrow: no shuffle, and a worker holds some megabytes of text or one text at a time.
    """
    if len(set(sentinels)) != 3 or not all(len(s) > 1 and s[0] not in s[1:] for s in sentinels) or len({s[0] for s in sentinels}) > 1:
        raise ValueError("three different sentinels are needed that begin with one character, which they have nowhere else")
    if any(a != b and b.startswith(a) for a in sentinels for b in sentinels):
        raise ValueError("no sentinel may begin another one")
    draws = free_names(docs, "h1", "h2", "h3", "h4")
    names = free_names(docs, "n", "form", "prefix_units", "middle_units", "output")
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)])
    before, after, between = (s.encode() for s in sentinels)
    at_text, held = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                h = [batch.column(held + i).to_numpy() for i in range(4)]
                index = UnitIndex(batch.column(at_text), unit)
                n = index.counts()
                cuts = np.sort([h[0] % (n + 1), h[1] % (n + 1)], axis=0)
                a, b = index.cut(cuts[0]).tolist(), index.cut(cuts[1]).tolist()
                ends, raw = index.offsets.tolist(), memoryview(index.bytes)
                stays, spm = (h[2] % 100 >= 100 - plain).tolist(), (h[3] % 100 < suffix_first).tolist()
                forms, outputs = [], []
                for i in range(batch.num_rows):
                    text = bytes(raw[ends[i] : ends[i + 1]])
                    if stays[i] or not text or before in text or after in text or between in text:
                        forms.append("plain")
                        outputs.append(text)
                        continue
                    forms.append("spm" if spm[i] else "psm")
                    head, middle, tail = raw[ends[i] : a[i]], raw[a[i] : b[i]], raw[b[i] : ends[i + 1]]
                    parts = (after, tail, before, head) if spm[i] else (before, head, after, tail)
                    outputs.append(b"".join((*parts, between, middle)))
                form = pa.array(forms, pa.string())
                moved = pc.not_equal(form, "plain")
                units = [pc.if_else(moved, pa.array(x, pa.int64()), pa.scalar(None, pa.int64())) for x in (cuts[0], cuts[1] - cuts[0])]
                output = pa.array(outputs, pa.binary()).cast(pa.string(), safe=False)
                yield pa.RecordBatch.from_arrays([*batch.columns[:held], pa.array(n, pa.int64()), form, *units, output], names=schema.names)

    return _draws(docs, docs[id_col], seed, draws).mapInArrow(run, schema)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text of an output and its form. No text that was cut holds a sentinel, so that its parts are what stands between them."""
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1)  # in the order of output, from 1
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fim_report(docs: DataFrame) -> DataFrame:
    """By doc_id: n, form, prefix_chars, middle_chars, and the digests of output and of the text restored from it."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"),
    )
