"""Near-duplicate documents: MinHash signatures of word shingles, banded candidates, verified by their Jaccard similarity."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.functions.scalars import DEDUP_TOKEN, completeness, timestamp_sort_value
from kgspark.operators.components import connected_components
from kgspark.shared import cut

#: Words of a shingle.
WIDTH = 5
#: Documents that are compared up to which their ids are broadcast to the tasks that read texts.
HELD_IDS = 1_000_000


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle, one without tokens has none."""
    tokens = re.findall(DEDUP_TOKEN, text.lower())
    if not tokens:
        return np.zeros(0, "<u8")
    runs = {" ".join(tokens[i : i + width]) for i in range(max(1, len(tokens) - width + 1))}
    return np.sort(np.array([xxhash.xxh64_intdigest(r) for r in runs], "<u8"))


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of n permutations of 64-bit hashes."""
    rng = np.random.default_rng(1)
    draw = lambda: rng.integers(0, 2**63, n, np.int64).view("<u8") * np.uint64(2) + np.uint64(1)
    return draw(), draw()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = 25, rows: int = 5, grams: bool = True) -> DataFrame:
    """(id, s1, s2, grams: sorted distinct shingle hashes, bands: a hash of each band of the MinHash signature).

    s1 and s2 are hashes of the set. Texts without tokens are left out. grams: False leaves out that column, the largest by far.
    """
    with_grams = grams
    fields = [("s1", T.LongType()), ("s2", T.LongType()), ("grams", T.ArrayType(T.LongType())), ("bands", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(n, t) for n, t in fields if grams or n != "grams"]])
    factor, summand = permutations(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep, names, grams, keys = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = shingle_hashes(text or "")
                if not len(own):
                    continue
                least = np.full(bands * rows, 2**64 - 1, "<u8")
                for k in range(0, len(own), 4096):  # bounded memory for very long texts
                    least = np.minimum(least, (own[k : k + 4096, None] * factor + summand).min(axis=0))
                raw = own.tobytes()
                keep.append(i)
                names.append((xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)))
                grams.append(own.view("<i8") if with_grams else None)
                keys.append(np.array([xxhash.xxh64_intdigest(least[j * rows : (j + 1) * rows].tobytes(), j) for j in range(bands)], "<u8").view("<i8"))
            pair = np.array(names, "<u8").view("<i8").reshape(-1, 2)
            arrays = [batch.column("id").take(pa.array(keep, pa.int64())), pa.array(pair[:, 0]), pa.array(pair[:, 1])]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in ((grams, keys) if with_grams else (keys,))]
            yield pa.RecordBatch.from_arrays([*arrays, *lists], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, few: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, s1, s2, grams) of the documents whose id is among few (id, distinct; a written table), as signatures has them."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [shingle_hashes(text or "") for text in batch.column("text").to_pylist()]
            keep = [i for i, own in enumerate(found) if len(own)]
            names = np.array([(xxhash.xxh64_intdigest(found[i].tobytes(), 1), xxhash.xxh64_intdigest(found[i].tobytes(), 2)) for i in keep], "<u8").view("<i8").reshape(-1, 2)
            arrays = [batch.column("id").take(pa.array(keep, pa.int64())), pa.array(names[:, 0]), pa.array(names[:, 1])]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([found[i].view("<i8") for i in keep], pa.list_(pa.int64()))], names=schema.names)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # few ids are sent to all tasks that read texts, so that no other text is shuffled
    held = few.limit(HELD_IDS + 1).count() <= HELD_IDS
    chosen = texts.join(F.broadcast(few), "id", "left_semi") if held else texts.hint("merge").join(few, "id", "left_semi")
    return chosen.mapInArrow(run, schema)


def near_duplicate_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 25, rows: int = 5) -> DataFrame:
    """(a, b, similarity), a < b, between distinct shingle sets; equal sets are one class, paired with its smallest id.

    Pairs that share no band are not found: at a similarity of 0.8 one in 20,000.
    """
    signed = cut(signatures(docs, id_col, text_col, bands, rows, grams=False), "signed")
    classes = cut(signed.groupBy("s1", "s2").agg(F.min("id").alias("a")), "sets")
    same = signed.select("s1", "s2", F.col("id").alias("b")).hint("merge").join(classes, ["s1", "s2"]).where("a <> b").select("a", "b", F.lit(1.0).alias("similarity"))
    heads = signed.hint("merge").join(classes.select(F.col("a").alias("id")), "id", "left_semi")
    heads = heads.groupBy("id").agg(F.min(F.struct("s1", "s2", "bands")).alias("own"))  # of several texts under one id the least
    banded = cut(heads.select("id", F.explode("own.bands").alias("band")), "banded")
    shared = cut(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "shared")
    banded = cut(banded.hint("merge").join(shared, "band", "left_semi"), "met")
    pairs = banded.withColumnRenamed("id", "a").hint("merge").join(banded.withColumnRenamed("id", "b"), "band").where("a < b").select("a", "b").distinct()
    pairs = cut(pairs, "pairs")
    few = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "few")
    # sets are made anew from the texts of those that are compared, and are never written for others
    own = cut(signed.hint("merge").join(few, "id", "left_semi").groupBy("id").agg(F.min(F.struct("s1", "s2")).alias("own")).select("id", "own.*"), "own")
    sets = shingle_sets(docs, few, id_col, text_col).hint("merge").join(own, ["id", "s1", "s2"], "left_semi")
    sets = cut(sets.groupBy("id").agg(F.first("grams").alias("grams")), "grams")
    left, right = (sets.select(F.col("id").alias(c), F.col("grams").alias(g)) for c, g in (("a", "x"), ("b", "y")))
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    scored = both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("similarity")).where(F.col("similarity") >= threshold)
    return scored.unionByName(same)


def near_duplicate_clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id, cluster) of documents in clusters of more than one; cluster is the smallest id."""
    pairs = near_duplicate_pairs(docs, id_col, text_col, threshold)
    return connected_components(pairs, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def document_completeness(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """How many fields of a document are filled, its id apart."""
    return completeness(*[f"`{c}`" for c in docs.columns if c != id_col])


def mark_duplicates(docs: DataFrame, clusters: DataFrame, id_col: str = "doc_id", text_col: str = "text", time_col: str | None = None) -> DataFrame:
    """id, cluster, is_canonical, near_duplicate_of: of a cluster the most complete document stays, of equals the one with the
    latest time, then the longest text, then the smallest id."""
    when = F.coalesce(timestamp_sort_value(F.col(time_col)), F.lit(0)) if time_col else F.lit(0)
    order = F.struct((-document_completeness(docs, id_col)).alias("c"), (-when).alias("t"), (-F.length(F.coalesce(text_col, F.lit("")))).alias("l"))
    ranked = docs.select(F.col(id_col).alias("id"), order.alias("order")).hint("merge").join(clusters, "id")
    best = ranked.groupBy("cluster").agg(F.min_by("id", F.struct("order", "id")).alias("canonical"))
    out = ranked.hint("merge").join(best, "cluster")
    return out.select("id", "cluster", (F.col("id") == F.col("canonical")).alias("is_canonical"), F.when(F.col("id") != F.col("canonical"), F.col("canonical")).alias("near_duplicate_of"))


def duplicate_summary(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """One row: documents, clusters, marked (documents that are not canonical)."""
    return docs.agg(F.count("*").alias("documents")).crossJoin(marks.agg(F.count_distinct("cluster").alias("clusters"), F.count_if(~F.col("is_canonical")).alias("marked")))


def keep_latest(old: DataFrame, new: DataFrame, key: str = "id", order: str = "version") -> DataFrame:
    """The upsert: of all rows of a key the one with the largest `order`; new rows win ties."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order), F.desc("is_new")))
    return both.withColumn("place_of_row", rank).where("place_of_row = 1").drop("place_of_row", "is_new")
