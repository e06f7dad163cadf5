"""Vector search through cells: an inverted file index with a bound that tells when the k nearest are certain.

Vectors are dealt to the cell of their nearest center, in files by cell, with the largest angle between a cell's center and its
vectors (its reach). By the triangle inequality of angles no vector of a cell is nearer to a question than the angle to the
center less the reach. A search reads the cells nearest to each question first; in exact mode it then reads the cells whose
bound can still reach the k-th score, and no others.

Centers come from a sample of SAMPLE vectors a cell, at most; all vectors are indexed. Centers are at most MAX_CELLS vectors,
which is what a task and the driver hold of the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kgspark.shared import cut

#: Cells of an index, at most, and vectors of the sample that centers are fitted on, for each cell.
MAX_CELLS, SAMPLE = 4096, 64
#: Cells that are read first for each question.
PROBES = 4
#: What a bound may be wrong by: scores are rounded to six digits, angles near zero are known to about 10^-8.
SLACK = 1e-6
#: Scores that a task computes at once.
NUMBERS = 500_000


@dataclass(frozen=True)
class VectorIndex:
    """path: folder of centers, rows by batch and cell, and reach by batch. filters: the columns that a search may ask for."""

    path: str
    size: int
    filters: tuple[str, ...]
    id_type: T.DataType
    centers: np.ndarray
    reach: np.ndarray
    rows: np.ndarray


def unit_rows(vectors: pa.Array, size: int) -> np.ndarray:
    """Vectors of so many components, each of length 1; zero ones stay zero."""
    rows = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    top = np.abs(rows).max(axis=1, keepdims=True, initial=0.0)
    rows = np.divide(rows, top, out=np.zeros_like(rows), where=top > 0)  # so that squares neither overflow nor vanish
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=rows, where=norm > 0)


def _usable(size: int) -> Column:
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size("vector") == size) & finite & F.exists("vector", lambda x: x != 0)


def _prepared(docs: DataFrame, filters: tuple[str, ...], size: int) -> DataFrame:
    values = [docs[c].cast("string").alias(f"v{i}") for i, c in enumerate(filters)]
    rows = docs.select(docs["doc_id"], docs["vector"].cast("array<double>").alias("vector"), *values)
    return rows.where(F.col("doc_id").isNotNull() & _usable(size))


def _centers(rows: DataFrame, cells: int | None, size: int) -> np.ndarray:
    n = rows.count()
    cells = min(cells or int(np.ceil(np.sqrt(n))), MAX_CELLS)
    if not n:
        return np.zeros((0, size))
    bound = SAMPLE * cells
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(2**53)) < min(1.0, bound / n)
    top = F.array_max(F.transform("vector", F.abs))
    scaled = F.transform("vector", lambda x: x / top)
    sample = cut(rows.where(drawn).limit(2 * bound).select(array_to_vector(scaled).alias("features")), "sample")
    if cells == 1 or sample.count() < 2:
        first = sample if not sample.isEmpty() else rows.limit(1).select(array_to_vector(scaled).alias("features"))
        return _normal(first.first()["features"].toArray().reshape(1, -1))
    fitted = KMeans(k=cells, seed=1, maxIter=10, distanceMeasure="cosine").fit(sample)
    return _normal(np.array(fitted.clusterCenters()))


def _normal(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose products with so many vectors have at most about NUMBERS numbers."""
    rows = max(1, NUMBERS // max(width, 1))
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def build_vectors(docs: DataFrame, path: str, filters: list[str] | None = None, size: int | None = None, cells: int | None = None) -> VectorIndex:
    """Write an index of docs (doc_id, vector and the filter columns) under path. cells: their number, else the root of the rows'.

    size: components of a vector, else the most that a row has. Rows without an id, and vectors that are null, zero, of another
    size or not finite, are like nothing and left out. Repeated ids are rows of their own. An empty table gives an empty index.
    """
    spark, filters = docs.sparkSession, tuple(filters or ())
    size = size or docs.select(F.max(F.size("vector"))).first()[0] or 1
    size = max(size, 1)
    centers = _centers(_prepared(docs, filters, size), cells, size)
    held = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>")
    held.coalesce(1).write.parquet(f"{path}/centers")
    spark.createDataFrame([], "cell int, reach double, n long").write.parquet(f"{path}/reach/batch=-1")
    empty = VectorIndex(path, size, filters, docs.schema["doc_id"].dataType, centers, np.full(len(centers), -1.0), np.zeros(len(centers), np.int64))
    return add_vectors(empty, docs, 0)


def add_vectors(index: VectorIndex, docs: DataFrame, batch: int) -> VectorIndex:
    """The index with docs as one more batch, which costs its own size only. A batch of the same number is replaced.

    Where the index has no centers yet, because it was built of no vectors, adding some is an error.
    """
    spark, size, count = docs.sparkSession, index.size, len(index.filters)
    rows = _prepared(docs, index.filters, size)
    if not len(index.centers):
        if not rows.isEmpty():
            raise ValueError("an index without centers can't take vectors: build it anew")
        return index
    held = spark.sparkContext.broadcast(index.centers)
    values = [T.StructField(f"v{i}", T.StringType()) for i in range(count)]
    fields = [T.StructField("doc_id", index.id_type), T.StructField("unit", T.ArrayType(T.DoubleType())), *values]
    schema = T.StructType([*fields, T.StructField("angle", T.DoubleType()), T.StructField("cell", T.IntegerType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, len(held.value)):
            unit = unit_rows(part.column("vector"), size)
            cosines = unit @ held.value.T
            cell = cosines.argmax(axis=1)
            angle = _angles(cosines[np.arange(len(cell)), cell])
            lists = pa.ListArray.from_arrays(np.arange(len(unit) + 1, dtype=np.int32) * size, unit.ravel())
            kept = [part.column(f"v{i}") for i in range(count)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, *kept, pa.array(angle), pa.array(cell.astype(np.int32))], names=schema.names)

    dealt = rows.mapInArrow(deal, schema)
    # ranges of (cell, hash): a file holds one cell, and a cell with a third of all rows is several tasks' work
    ranged = dealt.repartitionByRange("cell", F.xxhash64("doc_id")).sortWithinPartitions("cell")
    ranged.write.mode("overwrite").option("compression", "zstd").partitionBy("cell").parquet(f"{index.path}/rows/batch={batch}")
    written = spark.read.schema(schema).option("basePath", f"{index.path}/rows/batch={batch}").parquet(f"{index.path}/rows/batch={batch}")
    written.groupBy("cell").agg(F.max("angle").alias("reach"), F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/reach/batch={batch}")
    return open_vectors(spark, index.path, index.size, index.filters, index.id_type)


def open_vectors(spark: SparkSession, path: str, size: int, filters: tuple[str, ...], id_type: T.DataType) -> VectorIndex:
    """The index under path, with all its batches."""
    found = spark.read.schema("cell int, center array<double>").parquet(f"{path}/centers").orderBy("cell").collect()  # MAX_CELLS rows
    centers = np.array([r["center"] for r in found], float).reshape(len(found), size)
    reach, rows = np.full(len(found), -1.0), np.zeros(len(found), np.int64)
    every = spark.read.schema("cell int, reach double, n long").parquet(f"{path}/reach").groupBy("cell").agg(F.max("reach").alias("reach"), F.sum("n").alias("n"))
    for r in every.collect():
        reach[r["cell"]], rows[r["cell"]] = r["reach"], r["n"]
    return VectorIndex(path, size, filters, id_type, centers, reach, rows)


def cell_bounds(index: VectorIndex, questions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each question (a unit vector) and cell: the angle to its center, and the most that a cosine with its vectors can be."""
    angles = _angles(questions @ index.centers.T)
    most = np.cos(np.maximum(angles - index.reach, 0.0))
    return angles, np.where(index.rows > 0, most, -2.0)


def search_cells(index: VectorIndex, questions: DataFrame, k: int = 5, probes: int = PROBES, exact: bool = True, dots: int = 5_000_000) -> DataFrame:
    """(question_id, doc_id, score, rank) of the k indexed vectors nearest by cosine to each question (question_id, unique; vector; and
    filters, a map of wanted values, if there is one) among those with the values that it wants.

    exact: all of the k nearest, however many cells that takes; else those of the nearest probes cells. Scores are rounded to
    six digits and ties go to the smaller id. Questions are a query set, taken in blocks of about dots numbers; a task passes
    on its best k only. A question whose vector is null, zero, not finite or of another size finds nothing; a wanted value that
    is null stands for any, one of a column that isn't in the index is an error.
    """
    return _search(index, questions, k, probes, exact, dots).drop("cell")


def probes_for(index: VectorIndex, questions: DataFrame, k: int = 5, recall: float = 0.95, dots: int = 5_000_000) -> int:
    """How many of the nearest cells hold this share of the k nearest of the questions, which stand for those to come.

    The k nearest are searched exactly; what counts is at which place their cells stand in each question's order of centers. The
    questions should be a bounded sample: their vectors come to the driver. No questions, or none that find anything: all cells.
    """
    found = _search(index, questions, k, PROBES, True, dots).select("question_id", "cell").collect()
    asked = _asked(index, questions).select("question_id", "vector").collect()
    if not found:
        return len(index.centers)
    matrix = unit_rows(pa.array([r["vector"] for r in asked], pa.list_(pa.float64())), index.size)
    angles = np.where(index.rows > 0, cell_bounds(index, matrix)[0], np.inf)
    place = np.argsort(np.argsort(angles, axis=1, kind="stable"), axis=1)
    at = {r["question_id"]: q for q, r in enumerate(asked)}
    needed = np.sort([place[at[r["question_id"]], r["cell"]] + 1 for r in found])
    return int(needed[int(np.ceil(recall * len(needed))) - 1])


def _asked(index: VectorIndex, questions: DataFrame) -> DataFrame:
    wanted = questions["filters"] if "filters" in questions.columns else F.lit(None).cast("map<string,string>")
    return questions.select("question_id", F.col("vector").cast("array<double>").alias("vector"), wanted.alias("filters")).where(_usable(index.size))


def _search(index: VectorIndex, questions: DataFrame, k: int, probes: int, exact: bool, dots: int) -> DataFrame:
    spark, asked = questions.sparkSession, cut(_asked(index, questions), "asked")
    kind = asked.schema["question_id"].dataType
    out, a_block = None, max(1, dots // max(index.size, len(index.centers), 1))
    blocks = max(1, -(-asked.count() // a_block))
    for i in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i)
        found = _search_block(spark, index, part.collect(), kind, k, probes, exact)  # a block
        out = found if out is None else out.union(found)
    return out


def _search_block(spark: SparkSession, index: VectorIndex, rows: list, kind: T.DataType, k: int, probes: int, exact: bool) -> DataFrame:
    names, wants = [r["question_id"] for r in rows], [dict(r["filters"] or {}) for r in rows]
    unknown = {c for w in wants for c, v in w.items() if v is not None} - set(index.filters)
    if unknown:
        raise ValueError(f"the index has no column {sorted(unknown)}")
    wants = [{index.filters.index(c): v for c, v in w.items() if v is not None} for w in wants]
    matrix = unit_rows(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), index.size) if rows else np.zeros((0, index.size))
    angles, most = cell_bounds(index, matrix)
    first = np.zeros(angles.shape, bool)
    if angles.size:
        nearest = np.argsort(np.where(index.rows > 0, angles, np.inf), axis=1, kind="stable")[:, :probes]
        np.put_along_axis(first, nearest, True, axis=1)
        first &= most >= -1.0
    found = _ranked(_probe(spark, index, names, wants, matrix, kind, first, k), k)
    if not exact:
        return found
    found = cut(found, "probed")
    floor = np.full(len(names), -2.0)
    at = {name: q for q, name in enumerate(names)}
    for r in found.where(F.col("rank") == k).collect():  # one row for each question of the block
        floor[at[r["question_id"]]] = r["score"]
    rest = ~first & (most >= np.maximum(floor, -1.0)[:, None] - SLACK) & (index.rows > 0)
    if not rest.any():
        return found
    return _ranked(found.drop("rank").union(_probe(spark, index, names, wants, matrix, kind, rest, k)), k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _probe(spark: SparkSession, index: VectorIndex, names: list, wants: list[dict], matrix: np.ndarray, kind: T.DataType, pairs: np.ndarray, k: int) -> DataFrame:
    """(question_id, doc_id, score, cell): the best k of each task for each question, among the cells that pairs (question, cell) marks."""
    schema = T.StructType([T.StructField("question_id", kind), T.StructField("doc_id", index.id_type), T.StructField("score", T.DoubleType()), T.StructField("cell", T.IntegerType())])
    of = {int(c): np.flatnonzero(pairs[:, c]) for c in np.flatnonzero(pairs.any(axis=0))}
    if not of:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast((names, wants, matrix, of))
    arrow, size, count = [to_arrow_type(t.dataType) for t in schema], index.size, len(index.filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wants, matrix, of = held.value
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("doc_id")))  # so that a stable order of scores leaves ties by id
            cells = batch.column("cell").to_numpy()
            for cell, part in [(c, p) for c in np.unique(cells).tolist() for p in _slices([batch.filter(pa.array(cells == c))], len(of[c]))]:
                unit, ids = unit_rows(part.column("unit"), size), part.column("doc_id")
                have = [np.array(part.column(f"v{i}").to_pylist(), object) for i in range(count)]
                scores = np.round(matrix[of[cell]] @ unit.T, 6)
                for q, own in zip(of[cell].tolist(), scores, strict=True):
                    for i, value in wants[q].items():
                        own[have[i] != value] = -2.0
                    before = best.get(q, [])
                    if len(before) == k and own.max() < -before[-1][0]:
                        continue
                    top = np.argsort(-own, kind="stable")[:k]
                    new = [(-float(own[j]), ids[j].as_py(), cell) for j in top.tolist() if own[j] >= -1.5]
                    best[q] = sorted(before + new)[:k]
        found = [(names[q], x, -s, cell) for q, rows in best.items() for s, x, cell in rows]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=schema.names)

    values = [f"v{i}" for i in range(count)]
    fields = T.StructType([T.StructField("doc_id", index.id_type), T.StructField("unit", T.ArrayType(T.DoubleType()))])
    for v in values:
        fields.add(v, "string")
    stored = spark.read.schema(fields.add("batch", "integer").add("cell", "integer")).parquet(f"{index.path}/rows")
    return stored.where(F.col("cell").isin(list(of))).select("doc_id", "unit", "cell", *values).mapInArrow(run, schema)
