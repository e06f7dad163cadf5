"""Exact deduplication by an extendible-hash index on shared files.

Each task normalises its texts and keeps one entry for each different one it meets, so that of a text with very many copies
only few entries leave it. A directory of 2^depth slots maps the leading bits of a 64-bit hash to buckets; a bucket with too
many entries or bytes is split, doubling the directory when its local depth has reached the global one. Entries are dealt out
to the owners of the buckets in the order of their hashes. An owner walks along its key range with the texts of one hash in
memory: an entry whose bytes equal a text of that chain joins it, any other is chained as a text of its own. The index is
written as one folder of files for each bucket, and rows find their chain in it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.text import ASCII_LOWER, ASCII_UPPER, LOWER, free_names, slices, utf8
from kgspark.shared import cut, discard

#: Entries and bytes of text that a bucket may hold before it is split; a small index has at least this many buckets for each
#: shuffle partition, so that all owners have work.
BUCKET_ROWS, BUCKET_BYTES, BUCKETS = 200_000, 64 << 20, 2
#: Bytes of different texts that a task remembers at once.
HELD_BYTES = 64 << 20
#: Bits of a hash; fewer make collisions, for tests.
HASH_BITS = 64


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def split_directory(histogram: dict[int, int], bits: int, capacity: int) -> tuple[int, list[int]]:
    """(global depth, bucket of each slot). histogram: load by the hash's leading `bits` bits."""
    depth, directory, local = 0, [0], {0: 0}
    counts = {0: sum(histogram.values())}
    members = {0: dict(histogram)}
    queue = [0]
    while queue:
        bucket = queue.pop()
        if counts[bucket] <= capacity or local[bucket] >= bits:
            continue
        if local[bucket] == depth:  # doubling: every slot becomes two
            directory = [b for b in directory for _ in (0, 1)]
            depth += 1
        local[bucket] += 1
        new = len(local)
        local[new] = local[bucket]
        shift = bits - local[bucket]
        right = {k: v for k, v in members[bucket].items() if k >> shift & 1}
        members[new], members[bucket] = right, {k: v for k, v in members[bucket].items() if not k >> shift & 1}
        counts[new], counts[bucket] = sum(right.values()), sum(members[bucket].values())
        # the bucket's slots are next to each other; the upper half of them goes to the new one
        first = directory.index(bucket)
        span = 1 << (depth - local[bucket] + 1)
        directory[first + span // 2 : first + span] = [new] * (span // 2)
        queue += [bucket, new]
    return depth, directory


def entries(docs: DataFrame, id_col: str, text_col: str, hash_bits: int, held_bytes: int) -> DataFrame:
    """(row, id, entry, hash, nbytes, norm) of every row: norm is there in the row that made the entry, else null."""
    kind = docs.schema[id_col].dataType
    fields = [("row", T.LongType()), ("id", kind), ("entry", T.LongType()), ("hash", T.LongType()), ("nbytes", T.LongType()), ("norm", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]):
        base, row, size = TaskContext.get().partitionId() << 33, 0, 0
        seen: dict[bytes, int] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t.translate(LOWER) for t in utf8(batch.column("text"))]
                own, norm = [], []
                for i, t in enumerate(texts):
                    entry = seen.get(t)
                    if entry is None:
                        if size > held_bytes:
                            seen, size = {}, 0
                        entry = seen[t] = base + row + i
                        size += len(t) + 100
                        norm.append(t)
                    else:
                        norm.append(None)
                    own.append(entry)
                hashes = np.array([xxhash.xxh64_intdigest(t) >> (64 - hash_bits) << (64 - hash_bits) for t in texts], "<u8").view("<i8")
                numbers = [np.arange(base + row, base + row + len(texts)), own, hashes, list(map(len, texts))]
                rows, own, hashes, sizes = (pa.array(x, pa.int64()) for x in numbers)
                yield pa.RecordBatch.from_arrays([rows, batch.column("id"), own, hashes, sizes, pa.array(norm, pa.binary()).cast(pa.string())], names=schema.names)
                row += len(texts)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries in the order of bucket and hash: the chain of each, named by its first entry, and the text's SHA-256."""
    key: tuple[int, int] | None = None
    chain: dict[bytes, tuple[int, str]] = {}
    for whole in batches:
        for batch in slices(whole, "norm"):
            out = []
            columns = [batch.column(c).to_pylist() for c in ("bucket", "hash", "entry")]
            for bucket, own, entry, text in zip(*columns, utf8(batch.column("norm")), strict=True):
                if (bucket, own) != key:
                    key, chain = (bucket, own), {}
                found = chain.get(text)  # equal hashes of the dictionary are told apart byte by byte
                if found is None:
                    found = chain[text] = (entry, hashlib.sha256(text).hexdigest())
                out.append(found)
            arrays = [batch.column(c) for c in ("bucket", "hash", "entry")]
            arrays += [pa.array([c for c, _ in out], pa.int64()), pa.array([s for _, s in out], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "hash", "entry", "chain", "sha256"])


def build_index(
    rows: DataFrame, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """The written index (hash, entry, chain, sha256, bucket) of entries()."""
    spark = rows.sparkSession
    made = rows.where("norm is not null").select("hash", "entry", "nbytes", "norm")
    # load in units of bytes, an entry counting at least its share of the rows
    load = F.greatest(F.col("nbytes"), F.lit(bucket_bytes // bucket_rows))
    total = made.agg(F.coalesce(F.sum(load), F.lit(0))).first()[0]
    capacity = max(1, min(bucket_bytes, total // (BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    bits = max(1, math.ceil(math.log2(max(1, total / capacity))) + 2)
    slot = F.shiftrightunsigned("hash", 64 - bits)
    # 4 to 8 slots for each bucket
    loads = made.groupBy(slot.alias("slot")).agg(F.sum(load).alias("n")).toArrow()
    histogram = dict(zip(loads.column("slot").to_pylist(), loads.column("n").to_pylist(), strict=True))
    depth, directory = split_directory(histogram, bits, capacity)
    at = F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0).cast("long")
    owner = spark.createDataFrame(list(enumerate(directory)), "slot long, bucket long")
    if len(directory) <= 1 << 16:
        made = made.withColumn("slot", at).join(F.broadcast(owner), "slot")
    else:
        made = made.withColumn("slot", at).hint("merge").join(owner, "slot")
    # an owner works along the key ranges of its buckets
    dealt = made.select("bucket", "hash", "entry", "norm").repartition("bucket").sortWithinPartitions("bucket", "hash")
    chained = dealt.mapInArrow(_chained, "bucket long, hash long, entry long, chain long, sha256 string")
    return cut(chained.select("hash", "entry", "chain", "sha256", "bucket"), "index", partition_by="bucket")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES,
    hash_bits: int = HASH_BITS, held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """One row for each row of docs: id, row, keep_id, group_size, kept, text_sha256, bucket.

    Texts are equal if identical after lower-casing A-Z. The row with the largest id stays; of repeated rows with that id,
    exactly one. A null text is the empty text; a null id is the smallest. An empty table gives an empty result; other
    columns are ignored. Texts are told apart by their bytes: hashes only bring them together.
    """
    rows = cut(entries(docs, id_col, text_col, hash_bits, held_bytes), "entries")
    index = build_index(rows, bucket_rows, bucket_bytes)
    marked = rows.select("row", "id", "entry").hint("merge").join(index.select("entry", "chain", "sha256", "bucket"), "entry")
    marked = cut(marked.drop("entry"), "marked")
    discard(rows)
    top = marked.groupBy("chain").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("top"))
    top = cut(top.select("chain", "group_size", F.col("top.id").alias("keep_id"), F.col("top.row").alias("keep_row")), "chains")
    out = marked.hint("merge").join(top, "chain")
    return out.select("id", "row", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha256").alias("text_sha256"), "bucket")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops, with the columns of docs, whatever their names.

    Repeated rows (same id and same text) leave one row. Nulls and empty tables as there.
    """
    marked = cut(exact_groups(docs, id_col, text_col), "marked")
    stay = marked.where("kept").select(F.col("id").alias("own"), F.col("text_sha256").alias("own_sha"))
    again = marked.where(F.col("id").eqNullSafe(F.col("keep_id")) & ~F.col("kept"))
    (sha,) = free_names(docs, "sha")
    keyed = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    out = keyed.hint("merge").join(stay, keyed[id_col].eqNullSafe(stay["own"]) & (keyed[sha] == stay["own_sha"]), "left_semi")
    if not again.isEmpty():
        out = out.dropDuplicates([id_col, sha])
    return out.select(*docs.columns)
