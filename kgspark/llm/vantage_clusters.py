"""Clusters around centroids in exact integer arithmetic, with a vantage-point tree over the centroids.

Vectors are floored to integers and written once. In each round the driver builds the tree of the current centroids (k of
them, whatever the corpus) and broadcasts it; tasks look up each vector's nearest centroid by best-first branch and bound
and pass on the sums of their vectors by centroid only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.shared import cut

#: Largest absolute component after flooring: squared distances of up to 512 components then fit 64 bits.
LIMIT = 1 << 26
#: Centroids of a leaf, candidates that are tried as a vantage point, and cells of the bounds that a search holds at once.
LEAF, TRIED, CELLS = 8, 8, 1 << 21


def _squared(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64 rows and points, a row of the result for each of rows.

    By the scalar product in doubles where all intermediate sums stay whole numbers below 2^53, else by differences.
    """
    most = int(max(np.abs(rows).max(initial=0), np.abs(points).max(initial=0)))
    if 4 * most * most * max(1, rows.shape[1]) < 1 << 53:
        x, y = rows.astype(np.float64), points.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((rows - p) ** 2).sum(axis=1) for p in points], axis=1) if len(points) else np.zeros((len(rows), 0), np.int64)


@dataclass
class VantageTree:
    """Nodes by number, the root first. A leaf holds up to LEAF centroids. An inner node holds its vantage point, and for each of its two
    children the least and the largest distance of the child's centroids from it."""

    points: np.ndarray
    members: list[np.ndarray]
    children: np.ndarray
    reach: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> VantageTree:
        members: list[np.ndarray] = []
        children: list[tuple[int, int]] = []
        reach: list[tuple[tuple[float, float], tuple[float, float]]] = []
        leaf, todo = max(2, leaf), [(np.arange(len(points)), -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            node = len(members)
            if parent >= 0:
                children[parent] = (node, children[parent][1]) if side == 0 else (children[parent][0], node)
            children.append((-1, -1))
            reach.append(((0.0, 0.0), (0.0, 0.0)))
            if len(own) <= leaf:
                members.append(own)
                continue
            tried = own[np.linspace(0, len(own) - 1, min(TRIED, len(own))).astype(int)]
            away = np.sqrt(_squared(points[tried], points[own]).astype(np.float64))
            vantage = int(tried[away.var(axis=1).argmax()])  # the one that tells most
            members.append(np.array([vantage]))
            rest = own[own != vantage]
            away = np.sqrt(_squared(points[[vantage]], points[rest])[0].astype(np.float64))
            order = np.argsort(away, kind="stable")
            halves = order[: len(rest) // 2], order[len(rest) // 2 :]
            reach[node] = tuple((float(away[h].min()), float(away[h].max())) for h in halves)
            todo += [(np.sort(rest[halves[1]]), node, 1), (np.sort(rest[halves[0]]), node, 0)]
        return cls(points, members, np.array(children).reshape(-1, 2), np.array(reach).reshape(-1, 2, 2))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of its nearest point, of equally near ones the smallest, and the squared distance."""
        step = max(1, CELLS // max(1, len(self.members)))
        found = [self._search(rows[i : i + step]) for i in range(0, len(rows), step)]
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(2))

    def _search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every row has a queue of its own: the bounds of the nodes that wait. In a step each row takes the node with the
        least bound from its queue; rows that take the same node are handled together."""
        n = len(rows)
        bound = np.full((n, len(self.members)), np.inf)
        bound[:, 0] = 0.0
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        live = np.arange(n)
        while len(live):
            taken = bound[live].argmin(axis=1)
            least = bound[live, taken]
            # a node as far as the best so far may hold a point that is as near and has a smaller number
            going = least <= np.where(number[live] < 0, np.inf, np.sqrt(best[live].astype(np.float64)))
            going &= np.isfinite(least)
            live, taken = live[going], taken[going]
            bound[live, taken] = np.inf
            order = np.argsort(taken, kind="stable")
            cuts = np.flatnonzero(np.diff(taken[order])) + 1
            for group in np.split(order, cuts) if len(order) else ():
                node, own = int(taken[group[0]]), live[group]
                points = self.members[node]
                away = _squared(rows[own], self.points[points])
                at = away.argmin(axis=1)  # the first of equals: members ascend
                near, which = away[np.arange(len(own)), at], points[at]
                better = (near < best[own]) | (near == best[own]) & (which < number[own])
                best[own[better]], number[own[better]] = near[better], which[better]
                if self.children[node, 0] >= 0:
                    far = np.sqrt(away[:, 0].astype(np.float64))
                    for side in range(2):
                        low, high = self.reach[node, side]
                        # less by more than rounding can add, so that no node is passed over that is just as far
                        least = np.maximum(far - high, low - far) - 1e-12 * (far + high)
                        bound[own, self.children[node, side]] = np.maximum(least, 0.0)
        return number, best


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the vectors with exactly dims components, none null or non-finite: each floored after multiplication by scale."""
    x = F.col(vector_col).cast("array<double>")
    fits = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(F.coalesce(fits, F.lit(False)))
    floored = F.transform(F.col("v"), lambda v: F.floor(v * scale))
    large = F.exists(F.col("v"), lambda v: F.abs(v * scale) >= float(LIMIT))
    text = F.lit(f"a component beyond {LIMIT // scale}: its distances don't fit 64 bits")
    kept = kept.select(F.col(id_col).alias("id"), x.alias("v"))
    return kept.select("id", F.when(large, F.raise_error(text).cast("array<long>")).otherwise(floored).cast("array<int>").alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _assigned(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of all vectors."""
    dims = centroids.shape[1]
    held = whole.sparkSession.sparkContext.broadcast(VantageTree.build(centroids))
    schema = T.StructType([whole.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches):
        for batch in batches:
            number, away = held.value.nearest(_matrix(batch.column("x"), dims))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number, pa.int32()), pa.array(away, pa.int64())], names=schema.names)

    return whole.mapInArrow(run, schema)


def _moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the exact mean of their vectors; one without vectors stays.

    A task passes on one row of sums for each centroid it has met; k rows of dims sums reach the driver.
    """
    k, dims = centroids.shape
    held = whole.sparkSession.sparkContext.broadcast(VantageTree.build(centroids))

    def run(batches):
        sums, many = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            number, _ = held.value.nearest(x)
            np.add.at(sums, number, x)
            many += np.bincount(number, minlength=k)
        met = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array(many[met], pa.int64()), pa.array(list(sums[met]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
        )

    parts = whole.select("x").mapInArrow(run, "cluster int, n long, sums array<long>")
    wide = [F.sum(F.get("sums", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():  # k rows
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return out


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of all usable vectors, and the k final centroids.

    Usable: exactly dims components, none null, NaN or infinite; components count as floor(scale * x). Centroids begin as the k
    vectors with the smallest SHA-256 of `seed:id`, in that order (ties: the smaller vector); with fewer vectors there are as many
    centroids as those. In each round every vector goes to its nearest centroid by squared distance, of equally near ones to that
    with the smaller number, and centroids move to the floor of their mean. A null id stands for no digits; repeated rows
    count each; other columns are ignored; an empty table gives an empty result and no centroids. A component beyond 2^26 /
    scale is an error, as its distances don't fit a long.
    """
    whole = cut(whole_vectors(vectors, dims, scale, id_col, vector_col), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = whole.select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()  # k rows
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, dims)
    if not len(centroids):
        schema = T.StructType([whole.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
        return vectors.sparkSession.createDataFrame([], schema), centroids
    for _ in range(rounds):
        centroids = _moved(whole, centroids)
    return cut(_assigned(whole, centroids), "assigned"), centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_report(vectors: DataFrame, k: int = 16, rounds: int = 3) -> DataFrame:
    """By vec_id: cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    found, centroids = cluster_vectors(vectors.select("vec_id", "embedding"), k, rounds)
    sums = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # k rows
    rows = [(i, sums.get(i, 0), sum(sums.values()), centroid_digest(c)) for i, c in enumerate(centroids)]
    about = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(about), "cluster")  # k rows
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
