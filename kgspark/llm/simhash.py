"""SimHash near-duplicates: fingerprints of word shingles, linked by the generalised pigeonhole principle.

The 64 bits are grouped into partitions of correlated bits. If two fingerprints differ in at most k bits, then for any
integer thresholds t_i with sum(t_i) = k - m + 1 some partition i differs in at most t_i bits. The thresholds are chosen by
dynamic programming over candidate counts estimated from all fingerprints; each fingerprint probes the keys within t_i of
its own, and candidates are verified on all 64 bits. Keys that very many fingerprints probe are left to an exact linear
method: two fingerprints within two bits share a fingerprint within one bit of both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.text import LOWER, slices, utf8
from kgspark.operators.components import connected_components
from kgspark.shared import cut

BITS = 64
#: Fingerprints of a partition's key above which those that probe it are linked by neighbours in common instead. A
#: fingerprint has 65 such neighbours, so that from there on this is also less work.
HOT_KEY = 64


def fingerprint(text: bytes, width: int = 3) -> int:
    """The signed 64-bit SimHash of the XXH64 (seed 42) of a text's word shingles, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    n = max(1, len(words) - width + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    ends = ends[-n:].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):  # bounded memory for very long texts
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)], strict=True)], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) of every row: null, empty and blank texts have fingerprint 0."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found = pa.array([fingerprint(x, width) for x in utf8(batch.column("text"))], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id"), found], names=["id", "fp"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and of those with bits i and j set, over all of them (4,096 sums)."""

    def run(batches: Iterator[pa.RecordBatch]):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            words = np.asarray(batch.column("fp")).astype("<i8")
            bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(words)
        sums = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(len(sums)), "n": sums})

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(BITS * BITS + 1)
    for r in rows:
        sums[r["cell"]] = r["n"]
    return int(sums[-1]), sums[:-1].reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about equal size, each grown by the bit most correlated with it."""
    p, total = np.diag(both) / max(n, 1), len(both)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(deviation, deviation))
    np.fill_diagonal(r, 0)
    free, groups = np.ones(total, bool), []
    for k in range(m):
        size = total // m + (k < total % m)
        score, group = r[:, free].sum(axis=1), []
        for i in range(size):
            bit = int(np.argmax(np.where(free, score, -1.0)))
            free[bit] = False
            score = r[:, bit].copy() if i == 0 else score + r[:, bit]
            group.append(bit)
        groups.append(sorted(group))
    return groups


def mask_of(group: list[int]) -> int:
    value = sum(1 << b for b in group)
    return value - (1 << 64) if value >> 63 else value


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one for each partition, with the given sum and the least cost. costs[i]: cost by threshold."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t, own in cost.items():
                if used + t not in grown or c + own < grown[used + t][0]:
                    grown[used + t] = (c + own, [*chosen, t])
        best = grown
    return best[total]


def choose_partitions(fps: DataFrame, k: int) -> list[tuple[int, int]]:
    """(mask, threshold) of each partition in use, by estimated candidates plus probes over all fingerprints."""
    n, both = bit_statistics(fps)
    p = np.diag(both) / max(n, 1)
    agree = np.clip(p * p + (1 - p) ** 2, 0.05, 1)
    plans = {m: correlated_groups(n, both, m) for m in range(2, k + 3)}
    cells = [(m, i) for m, groups in plans.items() for i in range(len(groups))]
    keys = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(mask_of(plans[m][i]))).alias("key")) for c, (m, i) in enumerate(cells)])
    counts = fps.select(F.inline(keys)).groupBy("c", "key").agg(F.count("*").alias("n"))
    pairs = {r["c"]: float(r["pairs"] or 0) for r in counts.groupBy("c").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect()}
    best: tuple[float, list[tuple[int, int]]] | None = None
    for m, groups in plans.items():
        costs = []
        for i, group in enumerate(groups):
            same = pairs.get(cells.index((m, i)), 0.0)
            near = same * float(sum((1 - agree[b]) / agree[b] for b in group)) + n
            costs.append({-1: 0.0, 0: same + 2.0 * n, 1: same + near + n * (2.0 + len(group))})
        cost, chosen = allocate(costs, k - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [(mask_of(g), t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def _ball(fp: Column, mask: int, threshold: int) -> Column:
    """Keys of a partition within threshold (0 or 1) bits of that of fp."""
    key = fp.bitwiseAND(F.lit(mask))
    flips = [mask_of([b]) for b in range(BITS) if mask >> b & 1] if threshold else []
    return F.array(key, *[key.bitwiseXOR(F.lit(x)) for x in flips])


def _tagged(part: int) -> Callable[[Column], Column]:
    return lambda key: F.struct(F.lit(part).alias("part"), key.alias("key"))


def link_fingerprints(fps: DataFrame, k: int = 2, hot_key: int = HOT_KEY) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints (column fp) whose components are those of all pairs within k = 2 bits."""
    if k != 2:
        raise ValueError("the exact way for hot keys is for two bits")
    parts = choose_partitions(fps, k)
    index = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, (m, _) in enumerate(parts)])
    probe = F.concat(*[F.transform(_ball(F.col("fp"), m, t), _tagged(i)) for i, (m, t) in enumerate(parts)])
    index = fps.select("fp", F.inline(index))
    probe = fps.select("fp", F.inline(probe))
    hot = cut(index.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot_key).select("part", "key"), "hot")
    hub = None
    if not hot.isEmpty():
        met = probe.hint("merge").join(hot, ["part", "key"]).select("fp").distinct()
        hub = cut(met, "hub")
        index = index.hint("merge").join(hot, ["part", "key"], "left_anti")
    other = probe.select("part", "key", F.col("fp").alias("dst"))
    pairs = index.withColumnRenamed("fp", "src").hint("shuffle_hash").join(other, ["part", "key"])
    pairs = pairs.where((F.col("src") != F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= k))
    edges = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    if hub is not None:
        edges = edges.union(_links_by_neighbours(hub))
    return edges


def _links_by_neighbours(fps: DataFrame) -> DataFrame:
    """A star for each fingerprint value within one bit of several of fps: at most 65 of them, all within two bits."""
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(mask_of([b]))) for b in range(BITS)])
    stars = fps.select("fp", F.explode(near).alias("z")).groupBy("z").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    stars = stars.select(F.array_min("members").alias("src"), F.explode("members").alias("dst"))
    return stars.where("src <> dst").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, k: int = 2) -> DataFrame:
    """One row for each row of docs: id, fp, component_id (the smallest id among all fingerprints reachable).

    Fingerprints within k bits are linked and links are transitive. Texts without words share fingerprint 0, which links
    like any other. A null id never names a component unless all ids in it are null; repeated rows give repeated results;
    an empty table gives an empty result; other columns are ignored.
    """
    marked = cut(fingerprints(docs, id_col, text_col, width), "fps")
    nodes = cut(marked.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    components = connected_components(link_fingerprints(nodes.select("fp")))
    named = nodes.hint("merge").join(components.withColumnRenamed("node", "fp"), "fp", "left")
    named = cut(named.select("fp", "least", F.coalesce("component", "fp").alias("root")), "roots")
    least = cut(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = cut(named.hint("merge").join(least, "root").select("fp", "component_id"), "named")
    return marked.hint("merge").join(named, "fp").select("id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """near_duplicates by doc_id with the fingerprint as 16 hex digits; nulls, repeats, empty tables and other columns as there."""
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
