"""Near-duplicate documents in batches: signatures, bands and clusters kept as files that each batch probes and adds to.

A batch is signed once. Its shingle sets that the index has are members of known classes; new ones meet those that share a band,
of the batch or of before. Where many share a band they are compared with one of them first, then across clusters only and the
largest cluster of a band with those outside it only, so that a band of near copies takes work in proportion. Clusters grow by
pointers from old labels to new ones, so that batches in any order leave the same clusters.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.components import connected_components
from kgspark.operators.near_duplicates import shingle_sets, signatures
from kgspark.operators.resolution_index import _get, _labels, _put
from kgspark.shared import cut, discard, shared_dir


@dataclass(frozen=True)
class NearIndex:
    """What is known after some batches: the tables at path that belong to it. An index never changes; a batch makes a new one."""

    path: str
    tables: dict[str, tuple[str, ...]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    buckets: int = 64
    threshold: float = 0.8
    bands: int = 25
    rows: int = 5


def new_near_index(spark: SparkSession, threshold: float = 0.8, buckets: int = 64, bands: int = 25, rows: int = 5) -> NearIndex:
    return NearIndex(f"{shared_dir(spark)}/near-{uuid.uuid4().hex}", buckets=buckets, threshold=threshold, bands=bands, rows=rows)


def save_near_index(index: NearIndex, spark: SparkSession, path: str) -> None:
    """Write what names the index's tables to a folder, for open_near_index."""
    state = {k: getattr(index, k) for k in ("path", "tables", "schemas", "buckets", "threshold", "bands", "rows")}
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def open_near_index(spark: SparkSession, path: str) -> NearIndex:
    state = json.loads(spark.read.text(path).first()["value"])
    return NearIndex(**{**state, "tables": {k: tuple(v) for k, v in state["tables"].items()}})


def _name(s1: str, s2: str) -> Column:
    """A set's name: both of its hashes."""
    return F.concat_ws("-", F.hex(s1), F.hex(s2))


def _without(rows: DataFrame, known: DataFrame | None, key: str) -> DataFrame:
    return rows if known is None else rows.hint("merge").join(known.select(key).distinct(), key, "left_anti")


def _alike(index: NearIndex, pairs: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, la, b, lb) of sets those that reach the threshold: (la, lb). The index has the batch's own sets already."""
    pairs = cut(pairs.groupBy("a", "b").agg(F.first("la").alias("la"), F.first("lb").alias("lb")), "pairs")
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    found = _get(index, pairs.sparkSession, "sets", "node", nodes)
    if found is None:  # no set was ever added
        return pairs.select("la", "lb").limit(0)
    sets = cut(found, "grams")
    left, right = (sets.select(F.col("node").alias(c), F.col("grams").alias(g)) for c, g in (("a", "x"), ("b", "y")))
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    out = cut(both.where(common / (F.size("x") + F.size("y") - common) >= threshold).select("la", "lb").distinct(), "links")
    for used in (pairs, nodes, sets):
        discard(used)
    return out


def _relabelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    moved = rows.hint("merge").join(found.select(F.col("node").alias("label"), "component"), "label", "left")
    return moved.withColumn("label", F.coalesce("component", "label")).drop("component")


def _links(index: NearIndex, met: DataFrame) -> DataFrame:
    """(la, lb): links between the labels of sets that share a band. met: band, node, is_new, label."""
    first = F.min(F.struct("is_new", "node", "label")).alias("first")  # of before, if there is one
    pivots = met.groupBy("band").agg(first).select("band", F.col("first.node").alias("b"), F.col("first.label").alias("lb"))
    new = met.where("is_new").select("band", F.col("node").alias("a"), F.col("label").alias("la"))
    near = _alike(index, new.hint("merge").join(pivots, "band").where("la <> lb").select("a", "la", "b", "lb"), index.threshold)
    rows = _relabelled(met, connected_components(near, "la", "lb"))
    sizes = rows.groupBy("band", "label").agg(F.count("*").alias("rows"))
    sizes = sizes.groupBy("band").agg(F.max(F.struct("rows", "label")).getField("label").alias("main"), F.count("*").alias("parts"))
    rows = rows.hint("merge").join(sizes.where("parts > 1").select("band", "main"), "band")
    rows = cut(rows.withColumn("outside", F.col("label") != F.col("main")), "apart")
    left = rows.where("is_new").select("band", F.col("node").alias("a"), F.col("label").alias("la"), F.col("outside").alias("o"))
    right = rows.select(F.col("band").alias("band_b"), F.col("node").alias("b"), F.col("label").alias("lb"), F.col("outside").alias("p"), F.col("is_new").alias("q"))
    once = (F.col("band") == F.col("band_b")) & (F.col("la") != F.col("lb")) & (~F.col("q") | (F.col("a") < F.col("b")))
    parts = [left.where(o).hint("merge").join(right.where(p), once).select("a", "la", "b", "lb") for o, p in (("o", "true"), ("not o", "p"))]
    return near.union(_alike(index, parts[0].union(parts[1]), index.threshold))


def add_documents(index: NearIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> NearIndex:
    """The index with a batch of documents.

    Documents whose id is known are left as they are, and so are those with a null id; of several texts under one id in a batch one
    is taken, by hash. Null texts and those without tokens are in no cluster. An empty batch changes nothing. All batches must
    have ids of one type.
    """
    spark = docs.sparkSession
    signed = cut(signatures(docs, id_col, text_col, index.bands, index.rows, grams=False).where("id is not null").withColumn("node", _name("s1", "s2")), "signed")
    members = cut(signed.groupBy("id").agg(F.min("node").alias("node")), "members")
    known = _get(index, spark, "members", "id", members)
    if known is not None:
        members = cut(_without(members, known, "id"), "members")
    nodes = cut(members.select("node").distinct(), "nodes")
    heads = signed.hint("merge").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    fresh = cut(_without(heads, _get(index, spark, "sets", "node", nodes), "node"), "fresh")
    # a set's shingles are made once, from the text of one document, and go to the index's files
    ids = cut(fresh.select("id").distinct(), "ids")
    sets = shingle_sets(docs, ids, id_col, text_col).withColumn("node", _name("s1", "s2"))
    sets = sets.select("id", "node", "grams").hint("merge").join(fresh.select("id", "node"), ["id", "node"], "left_semi").select("node", "grams")
    index = _put(index, "sets", sets.dropDuplicates(["node"]), "node", fresh.isEmpty())
    banded = cut(fresh.select("node", F.explode("bands").alias("band")).distinct(), "banded")
    met = banded.withColumn("is_new", F.lit(True)).withColumn("label", F.col("node"))
    older = _get(index, spark, "bands", "band", banded)
    if older is not None:
        older = cut(older, "older")
        labels = _labels(index, older.select(F.col("node").alias("id")).distinct()).withColumnRenamed("id", "node")
        met = met.unionByName(older.withColumn("is_new", F.lit(False)).hint("merge").join(labels, "node").select(*met.columns))
    met = cut(met, "met")
    shared = met.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    met = cut(met.hint("merge").join(shared, "band", "left_semi"), "met")
    found = cut(connected_components(_links(index, met), "la", "lb"), "found")
    grown = _put(_put(index, "members", members, "id"), "bands", banded, "band")
    grown = _put(grown, "pointers", cut(found.where("node <> component"), "pointers"), "node")
    own = members.hint("merge").join(_labels(grown, nodes.select(F.col("node").alias("id"))).withColumnRenamed("id", "node"), "node")
    own = cut(own.select("label", F.col("id").alias("least"), F.lit(1).cast("long").alias("n")), "own")
    before = _get(index, spark, "clusters", "label", cut(own.select("label").union(found.select("node")).distinct(), "touched"))
    if before is not None:
        # a cluster's row is written anew whenever it grows
        before = before.groupBy("label").agg(F.min("least").alias("least"), F.max("n").alias("n"))
        own = own.unionByName(_relabelled(before, found).select(*own.columns))
    now = own.groupBy("label").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    return _put(grown, "clusters", cut(now, "clusters"), "label")


def clusters_of(index: NearIndex, ids: DataFrame) -> DataFrame:
    """(id, cluster) of those of ids (id) that are in clusters of more than one; cluster is the smallest id of all members."""
    spark, ids = ids.sparkSession, cut(ids.select("id").distinct(), "ids")
    members = _get(index, spark, "members", "id", ids)
    if members is None:
        return ids.select("id", F.col("id").alias("cluster")).limit(0)
    members = cut(members, "members")
    labels = _labels(index, members.select(F.col("node").alias("id")).distinct()).withColumnRenamed("id", "node")
    held = cut(members.hint("merge").join(labels, "node").select("id", "label"), "held")
    sizes = _get(index, spark, "clusters", "label", held).groupBy("label").agg(F.min("least").alias("cluster"), F.max("n").alias("n"))
    return held.hint("merge").join(sizes.where("n > 1"), "label").select("id", "cluster")


def clusters_in(index: NearIndex, spark: SparkSession) -> DataFrame | None:
    """(id, cluster) of all documents in clusters of more than one; None where no document was ever added."""
    members = _get(index, spark, "members")
    return None if members is None else clusters_of(index, members.select("id"))
