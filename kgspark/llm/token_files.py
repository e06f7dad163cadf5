"""Token ids as Parquet files: one row for each document in the order of ids, made for reading parts of them.

Ids are a list column with a dictionary, i.e. bit-packed indexes; positions and counts are delta-encoded. Row groups and pages are
small enough that the column and offset indexes, which the writer leaves in every file, lead from a range of ids to a few pages.
Spark's own writer and reader do it, so that any store serves and lost tasks leave no part of a file behind.
"""

from __future__ import annotations

import json
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.text import slices
from kgspark.shared import shared_dir

#: Chunks of text that a worker remembers, and the longest one in bytes.
MAX_CHUNKS, MAX_CHUNK = 600_000, 64
#: Bytes of a row group, of a page and of a dictionary, and documents of a page.
ROW_GROUP, PAGE, DICTIONARY, PAGE_ROWS = 32 << 20, 256 << 10, 1 << 20, 256
#: White space beyond ASCII by its UTF-8 bytes (the Unicode property White_Space, a fixed list).
_WIDE_SPACE = [c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))]


#: Classes of ASCII bytes: white space, letters, digits, the apostrophe, other characters. Bytes beyond have none.
_SPACE, _LETTER, _DIGIT, _APOSTROPHE, _MARK = range(1, 6)
_CLASS = np.array([0 if c > 127 else _SPACE if c in (9, 10, 11, 12, 13, 32) else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _APOSTROPHE if c == 39 else _MARK for c in range(256)], np.uint8)
#: Pairs of classes between which a pre-token always ends: between letters, digits and others, but not behind an apostrophe, which
#: may begin a contraction; and white space behind anything but white space.
_ENDS = np.zeros((6, 6), bool)
_ENDS[:, _SPACE] = [True, False, True, True, True, True]
_ENDS[_LETTER, [_DIGIT, _APOSTROPHE, _MARK]] = _ENDS[_DIGIT, [_LETTER, _APOSTROPHE, _MARK]] = _ENDS[_MARK, [_LETTER, _DIGIT]] = True


def chunk_starts(data: np.ndarray, offsets: np.ndarray, whole: list[bytes]) -> np.ndarray:
    """Where chunks of texts laid end to end start: at each text's start, and where a byte-level tokenizer's pre-tokens always end,
    so that the ids of a text are those of its chunks. White space behind white space opens no chunk, as a run of it may be one
    pre-token. Where one of whole (added tokens) is in data, chunks start at white space only, which these have none of.
    """
    kind = _CLASS[data]
    begin = np.zeros(len(data) + 1, bool)
    raw = data.tobytes() if whole else b""
    if any(w in raw for w in whole):
        begin[1:-1] = (kind[1:] == _SPACE) & (kind[:-1] != _SPACE)
    else:
        begin[1:-1] = _ENDS.ravel()[kind[:-1] * np.uint8(6) + kind[1:]]
    doubtful = np.flatnonzero(begin[:-1])
    doubtful = doubtful[data[doubtful - 1] >= 0x80]
    for wide in _WIDE_SPACE:
        k = len(wide)
        at = doubtful[doubtful >= k]
        for i, byte in enumerate(wide):
            at = at[data[at - k + i] == byte]
        begin[at] = False
    begin[offsets] = True
    return np.flatnonzero(begin[:-1])


class ChunkTokenizer:
    """Ids of a byte-level tokenizer, remembered by chunk as little-endian bytes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"] or {}
        if kind.get("type") != "ByteLevel" or not kind["use_regex"] or kind["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain and without white space")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, bytes] = {}
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        # an id's bytes: a character of the vocabulary stands for one, but added tokens stand for themselves
        self.sizes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        for t in spec["added_tokens"]:
            self.sizes[t["id"]] = len(t["content"].encode())

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text starts in them; at last, where all end."""
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = pc.fill_null(texts, b"")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        starts = chunk_starts(data, offsets, self.added)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        found = self.lookup(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, codes = np.frombuffer(b"".join(found), "<u4"), coded.indices.to_numpy()
        many = sizes[codes]
        ends = np.cumsum(many)
        at = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - many), many) + np.arange(int(ends[-1]))
        first = np.searchsorted(starts, offsets, "left")  # the first chunk of each text
        return pool[at], np.concatenate(([0], ends))[first]

    def lookup(self, chunks: list[bytes]) -> list[bytes]:
        if len(self.memo) > MAX_CHUNKS:
            self.memo = {}
        found = list(map(self.memo.get, chunks))
        new = [i for i, x in enumerate(found) if x is None]
        together, alone = [], []
        for i in new:
            c = chunks[i]
            (together if c[0] in b" \t\n" and c[-1] < 128 and c[-1:].strip() else alone).append(i)
        for group, encode in ((together, self.joined), (alone, self.each)):
            for a in range(0, len(group), 2000):
                part = [chunks[i] for i in group[a : a + 2000]]
                for i, c, ids in zip(group[a : a + 2000], part, encode(part), strict=True):
                    found[i] = ids
                    if len(c) <= MAX_CHUNK:
                        self.memo[c] = ids
        return found

    def each(self, chunks: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def joined(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks that begin with white space and end with an ASCII character that is none, encoded as one text, in
        which they are chunks as well, and parted by the bytes that ids stand for."""
        ids = np.array(self.tokenizer.encode_batch_fast([b"".join(chunks).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(self.sizes[ids])
        wanted = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        at = np.searchsorted(ends, wanted)
        if len(ends) == 0 or ends[-1] != wanted[-1] or (ends[at] != wanted).any():
            return self.each(chunks)
        cuts, raw = [0, *(4 * (at + 1)).tolist()], ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One for each Python worker, kept over tasks."""
    return ChunkTokenizer(path)


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) dealt to tasks by ranges of id, in order within each. Rows of one id are ordered by a hash of their text, and
    those of one text by where they stand, so that an id that very many rows have is dealt to several tasks as well."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    order = [F.col("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("order"), F.monotonically_increasing_id().alias("row")]
    keyed = rows.select("text", *order)
    return keyed.repartitionByRange("id", "order", "row").sortWithinPartitions("id", "order", "row").select("id", "text")


def write_token_ids(
    docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text",
    row_group: int = ROW_GROUP, page: int = PAGE, page_rows: int = PAGE_ROWS,
) -> None:
    """Write the ids of all texts to path: `ids` (id, part, place, n_tokens, ids), one file for each part, and `parts` (part, base,
    first_id, last_id, n_docs, n_tokens).

    Parts, and rows within a part, ascend by id. place counts the ids of the part before the document, base those of the parts before.
    A text is its ids without added special tokens, then end_id if there is one; a null text counts as empty; null ids come
    first; repeated rows are written each; other columns are ignored; an empty table gives empty folders. There are
    as many parts as shuffle partitions at most.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ])
    ended = end_id is not None

    def run(batches):
        own, part, place = chunk_tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, starts = own.flat(batch.column("text"))
                sizes = np.diff(starts)
                if ended:
                    rows = np.arange(len(sizes))
                    longer = np.full(len(flat) + len(rows), end_id, "<u4")
                    longer[np.arange(len(flat)) + np.repeat(rows, sizes)] = flat
                    flat, sizes = longer, sizes + 1
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat.view("<i4"), pa.int32()))
                lists = lists.cast(pa.list_(pa.field("element", pa.int32(), False)))
                numbers = [pa.array(place + ends - sizes, pa.int64()), pa.array(sizes, pa.int64())]
                place += int(ends[-1]) if len(ends) else 0
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.full(len(sizes), part), pa.int32()), *numbers, lists], names=schema.names)

    writer = _ordered(docs, id_col, text_col).mapInArrow(run, schema).write.option("compression", "zstd").option("parquet.writer.version", "v2")
    writer = writer.option("parquet.block.size", row_group).option("parquet.page.size", page).option("parquet.page.row.count.limit", page_rows)
    writer = writer.option("parquet.dictionary.page.size", DICTIONARY)
    for column in ("id", "place", "n_tokens"):  # delta-encoded, as version 2 has it for numbers without a dictionary
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(f"{path}/ids")
    spark = docs.sparkSession
    parts = spark.read.schema(schema).parquet(f"{path}/ids").groupBy("part")
    parts = parts.agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row for each part
    parts.withColumn("base", F.coalesce(before, F.lit(0)).cast("long")).coalesce(1).write.parquet(f"{path}/parts")


def read_token_ids(spark: SparkSession, path: str, where: Column | None = None, columns: tuple[str, ...] = ("id", "start", "n_tokens", "ids")) -> DataFrame:
    """Of the files at path the documents that `where` (a condition on id, n_tokens or place) admits, with start: the ids of all
    documents before it. The condition reaches the page index, and columns that aren't asked for aren't read."""
    found = spark.read.parquet(f"{path}/ids")
    if where is not None:
        found = found.where(where)
    if "start" in columns:
        bases = spark.read.parquet(f"{path}/parts").select("part", "base")
        found = found.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("place"))  # as many rows as parts
    return found.select(*columns)


def read_span(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(id, offset, ids) of what the documents have of the ids first to last - 1 of all files laid end to end; only pages of
    parts and documents that lie there are read."""
    bases = spark.read.parquet(f"{path}/parts").where((F.col("base") < last) & (F.col("base") + F.col("n_tokens") > first)).select("part", "base")
    reach = bases.agg(F.min("part"), F.max("part")).first()
    if reach[0] is None:
        reach = (-1, -1)
    ids = spark.read.parquet(f"{path}/ids").where(F.col("part").between(*reach))
    start = F.col("base") + F.col("place")
    held = ids.join(F.broadcast(bases), "part").where((start < last) & (start + F.col("n_tokens") > first))
    begin, end = F.greatest(F.lit(first) - start, F.lit(0)), F.least(F.lit(last) - start, F.col("n_tokens"))
    return held.select("id", (start + begin).alias("offset"), F.slice("ids", (begin + 1).cast("int"), (end - begin).cast("int")).alias("ids"))


def with_checksum(tokens: DataFrame, column: str = "ids", out_col: str = "ids_crc32") -> DataFrame:
    """tokens with the unsigned CRC-32 of a list of ids as little-endian unsigned 32-bit integers in place of the list."""
    kept = [c for c in tokens.columns if c != column]
    schema = T.StructType([*[tokens.schema[c] for c in kept], T.StructField(out_col, T.LongType())])

    def run(batches):
        for batch in batches:
            lists = batch.column(len(kept))
            ends = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sums, pa.int64())], names=schema.names)

    return tokens.select(*kept, column).mapInArrow(run, schema)


def token_file_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """By doc_id: start, n_tokens and ids_crc32, as read back from files written to the shared folder."""
    path = f"{shared_dir(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write_token_ids(docs, path, vocabulary)
    tokens = read_token_ids(docs.sparkSession, path)
    return with_checksum(tokens.withColumnRenamed("id", "doc_id"))
