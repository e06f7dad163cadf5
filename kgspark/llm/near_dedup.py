"""SimHash near-dedup at a similarity of 0.8: wide fingerprints of five-word shingle sets, probed by the generalised pigeonhole
principle and verified on the sets themselves.

Two sets with Jaccard similarity s differ in about a share arccos(2s / (1 + s)) / pi of their SimHash bits: 15 % at 0.8. With
64 bits no partition of such a pair would be alike, so fingerprints have BITS bits. They are grouped into partitions of
correlated bits; integer thresholds with sum(t_i) = RADIUS - m + 1 are allocated to the m partitions by dynamic programming on
estimated candidate counts. All pairs within RADIUS bits share a key within t_i bits of some partition; of pairs beyond it most
do (estimated_recall). Candidates whose fingerprints are too far apart are left, and the others are verified exactly.

Links serve to find components. So of all sets that meet under a key one is the pivot: each set is verified with the nearest pivot of
its own keys alone, then with pivots of other components only, and then with other sets of other components: a group of near
copies of any size takes work in proportion, and few pairs a set. Where many sets of several components share a
key, those that have a rare shingle in common are compared: two sets with similarity s have one among the first x - sx + 1 of
each, x being its size, in any one order of all shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.simhash import allocate, correlated_groups
from kgspark.llm.text import LOWER, free_names, slices, utf8
from kgspark.operators.components import connected_components
from kgspark.shared import cut, discard, release

#: Words of a shingle and least similarity of near duplicates.
WIDTH, THRESHOLD = 5, 0.8
#: Bits of a fingerprint, and bits within which all pairs are candidates.
BITS, RADIUS = 256, 24
#: Numbers of partitions that the dynamic program chooses from.
PARTITIONS = (8, 10, 12, 14, 16)
#: Most bits in which the first 128 of a candidate pair differ, and all of them: pairs with a similarity of 0.8 exceed the one with
#: odds of 1 in 1,500 and the other of 1 in 10,000, more similar ones hardly ever.
SKETCH, FAR = 33, 62
#: Sets that share a key above which they are joined by their rarest shingles instead of each with each; 16 times as many as a
#: key has on average if that is more.
HOT_KEY = 8
#: Tasks that add up the statistics of bits, at most: each reads fingerprints only, and one task adds up theirs.
STATISTICS_TASKS = 64
#: Against rounding of 0.8 times a whole number.
SLACK = 1e-9
_WORDS = [f"f{i}" for i in range(BITS // 64)]


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the text's word shingles; a text of fewer words is one, one without words none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    n = max(1, len(words) - width + 1)
    starts = np.append(0, ends[: n - 1] + 1)
    ends = ends[-n:]
    digest, parts = xxhash.xxh64_intdigest, []
    for k in range(0, n, 1 << 16):
        part = zip(starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist(), strict=True)
        parts.append(np.array([digest(joined[a:b], 42) for a, b in part], "<u8"))
    return np.unique(np.concatenate(parts))


def mixed(x: np.ndarray, word: int) -> np.ndarray:
    """Further hashes of hashes; word 0 is x itself."""
    if not word:
        return x
    with np.errstate(over="ignore"):
        x = x + np.uint64(word) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def wide_fingerprint(grams: np.ndarray) -> np.ndarray:
    """BITS // 64 words: a bit is 1 if set in over half of the shingles' hashes. No shingles: all zero."""
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(grams), 1 << 14):
        part = grams[k : k + (1 << 14)]
        hashes = np.stack([mixed(part, w) for w in range(BITS // 64)], axis=1)
        total += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * total > len(grams), bitorder="little").view("<i8")


def bits_of(words: np.ndarray) -> np.ndarray:
    """(n, BITS) of 0 and 1 from (n, BITS // 64) words."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")


def names_of(grams: np.ndarray) -> tuple[int, int]:
    raw = grams.tobytes()
    return xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)


def mark(docs: DataFrame, width: int) -> DataFrame:
    """(id, t1, t2, c1, c2, f0...) of docs (id, text): hashes of the text and of its shingle set, and the fingerprint."""
    fields = ["t1", "t2", "c1", "c2", *_WORDS]
    schema = T.StructType([docs.schema["id"], *[T.StructField(n, T.LongType()) for n in fields]])

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = np.zeros((batch.num_rows, len(fields) - 2), "<i8")
                for i, text in enumerate(utf8(batch.column("text"))):
                    grams = shingle_set(text, width)
                    rows[i, :2] = np.array(names_of(grams), "<u8").view("<i8")
                    rows[i, 2:] = wide_fingerprint(grams)
                arrays = [batch.column("id"), batch.column("t1"), batch.column("t2"), *[pa.array(np.ascontiguousarray(c)) for c in rows.T]]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select("id", *text_hashes("text"), "text").mapInArrow(run, schema)


def text_hashes(text: str) -> list[Column]:
    return [F.xxhash64(F.lit(i), F.coalesce(text, F.lit(""))).alias(f"t{i}") for i in (1, 2)]


def bit_statistics(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and of those with bits i and j set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = bits_of(_matrix(batch)).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        sums = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"part": pa.array([0]), "sums": pa.array([sums.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("sums").to_pylist())
        return pa.table({"part": table.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    found = classes.select(*_WORDS).coalesce(STATISTICS_TASKS).mapInArrow(run, "part long, sums binary")  # half a megabyte from each task
    found = found.groupBy("part").applyInArrow(add, "part long, sums binary").first()
    if found is None:
        return 0, np.zeros((BITS, BITS))
    sums = np.frombuffer(found["sums"], np.int64)
    return int(sums[-1]), sums[:-1].reshape(BITS, BITS).astype(float)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in _WORDS], axis=1)


def key_of(bits: np.ndarray, part: int, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64)) | part << 56


def flips(size: int, threshold: int) -> list[tuple[int, ...]]:
    """Positions that are flipped to reach the other keys within threshold bits, the highest first."""
    return [x[::-1] for t in range(1, threshold + 1) for x in combinations(range(size), t)]


def estimated_recall(parts: list[tuple[list[int], int]], threshold: float = THRESHOLD) -> float:
    """Odds that two sets of that similarity share a key of some partition, bits taken as independent."""
    p = math.acos(2 * threshold / (1 + threshold)) / math.pi
    miss = 1.0
    for group, t in parts:
        miss *= 1 - sum(math.comb(len(group), d) * p**d * (1 - p) ** (len(group) - d) for d in range(t + 1))
    return 1 - miss


def choose_partitions(classes: DataFrame, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use: the cheapest allocation by candidates and probes over all fingerprints."""
    n, both = bit_statistics(classes)
    p = np.diag(both) / max(n, 1)
    agree = np.clip(p * p + (1 - p) ** 2, 0.05, 1)
    plans = {m: correlated_groups(n, both, m) for m in PARTITIONS}
    cells = [(m, i) for m, groups in plans.items() for i in range(len(groups))]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            bits = bits_of(_matrix(batch))
            for c, (m, i) in enumerate(cells):
                key, many = np.unique(key_of(bits, c, plans[m][i]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(many)], names=["key", "n"])

    counts = classes.select(*_WORDS).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = counts.groupBy(F.shiftright("key", 56).alias("c")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    pairs = {r["c"]: float(r["pairs"] or 0) for r in pairs.collect()}  # a row for each partition of a plan
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m, groups in plans.items():
        costs = []
        for i, group in enumerate(groups):
            same = pairs.get(cells.index((m, i)), 0.0)
            odds = np.array([(1 - agree[b]) / agree[b] for b in group])
            cost, near = {-1: 0.0}, np.zeros(5)
            near[0] = same
            for x in odds:  # pairs that differ in 0 to 4 bits of the partition
                near[1:] += near[:-1] * x
            for t in range(5):
                probes = 1 + sum(math.comb(len(group), d) for d in range(1, t + 1)) / 2
                cost[t] = float(near[: t + 1].sum()) * 0.05 + n * probes  # a comparison is that much of a row's work
            costs.append(cost)
        found = allocate(costs, radius - m + 1)
        if best is None or found[0] < best[0]:
            best = (found[0], [(g, t) for g, t in zip(groups, found[1], strict=True) if t >= 0])
    return best[1]


def keyed(classes: DataFrame, parts: list[tuple[list[int], int]], own: bool) -> DataFrame:
    """(key, n, component, f0...) rows: of each partition the key itself (own), or the keys within its threshold.

    Of two keys that differ, the one that has the highest differing bit set probes the other.
    """
    names = ["key", "n", "component", *_WORDS]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            bits, rows = bits_of(_matrix(batch)), [batch.column(c).to_numpy() for c in ("n", "component", *_WORDS)]
            for part, (group, threshold) in enumerate(parts):
                key = key_of(bits, part, group)
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, *rows)], names=names)
                    continue
                for flip in flips(len(group), threshold):
                    at = np.flatnonzero(bits[:, group[flip[0]]])
                    other = key[at] ^ np.int64(sum(1 << b for b in flip))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (other, *(r[at] for r in rows))], names=names)

    return classes.select("n", "component", *_WORDS).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, Column, Column]:
    """Both with their columns' names ended by _a and _b; the number of bits in which a pair differs, and whether it is a candidate."""
    sides = [rows.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("n", "component", *_WORDS)]) for rows, x in ((left, "a"), (right, "b"))]
    apart = [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _WORDS]
    bits = sum(apart[1:], apart[0])
    return *sides, bits, (apart[0] + apart[1] <= SKETCH) & (bits <= FAR)


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components under one key with near fingerprints."""
    left, right, _, near = _sides(left, right)
    met = left.hint("merge").join(right, "key").where((F.col("component_a") != F.col("component_b")) & near)
    return met.select(F.least("n_a", "n_b").alias("a"), F.greatest("n_a", "n_b").alias("b"))


def _pivots(own: DataFrame) -> DataFrame:
    """One row of own for each key: of its sets the one with the least hash."""
    rest = ["n", "component", *_WORDS]
    first = F.min(F.struct(F.xxhash64("n").alias("h"), *rest)).alias("p")
    return own.groupBy("key").agg(first).select("key", *[f"p.{c}" for c in rest])


def _nearest_pivots(pivots: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs (a, b): each set with one other, of the pivots of its keys the one with the nearest fingerprint."""
    left, right, bits, near = _sides(pivots, own)
    met = left.hint("merge").join(right, "key").where((F.col("n_a") != F.col("n_b")) & near)
    best = met.groupBy("n_b").agg(F.min(F.struct(bits.alias("bits"), "n_a")).getField("n_a").alias("n_a"))
    return best.select(F.least("n_a", "n_b").alias("a"), F.greatest("n_a", "n_b").alias("b"))


def _grouped(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, component, f0...) of classes by edges."""
    components = cut(connected_components(edges).select(F.col("node").alias("own_n"), "component"), "components")
    grouped = classes.hint("merge").join(components, F.col("n") == F.col("own_n"), "left").withColumn("component", F.coalesce("component", "n"))
    grouped = cut(grouped.select("n", "component", *_WORDS), "grouped")
    release(classes.sparkSession)
    return grouped


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, threshold: float) -> DataFrame:
    """(src, dst): those of pairs whose sets are similar."""
    near = cut(pairs.distinct(), "near")
    release(docs.sparkSession)
    few = cut(near.select(F.explode(F.array("a", "b")).alias("n")).distinct(), "few")
    sets = cut(sets_of(docs, classes, few, width), "sets")
    release(docs.sparkSession)
    links = cut(similar(near, sets, threshold), "links")
    discard(sets)
    release(docs.sparkSession)
    return links


def sets_of(docs: DataFrame, classes: DataFrame, few: DataFrame, width: int) -> DataFrame:
    """(n, grams) of some classes, from the text of one document of each. docs: id, text."""
    chosen = classes.hint("merge").join(few, "n", "left_semi").select("n", "c1", "c2", "least")
    chosen = cut(chosen, "chosen")
    ids = chosen.select("least").distinct()
    texts = docs.hint("merge").join(ids, docs["id"].eqNullSafe(ids["least"]), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [shingle_set(x, width) for x in utf8(batch.column("text"))]
                names = np.array([names_of(x) for x in found], "<u8").view("<i8").reshape(-1, 2)
                arrays = [*[pa.array(np.ascontiguousarray(c)) for c in names.T], pa.array([x.view("<i8") for x in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["c1", "c2", "grams"])

    grams = texts.mapInArrow(run, "c1 long, c2 long, grams array<long>")
    return chosen.select("n", "c1", "c2").hint("merge").join(grams, ["c1", "c2"]).groupBy("n").agg(F.first("grams").alias("grams"))


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(src, dst): those of pairs (a, b) of classes whose sets have at least that similarity."""
    left, right = (sets.select(F.col("n").alias(c), F.col("grams").alias(g)) for c, g in (("a", "x"), ("b", "y")))
    common = F.size(F.array_intersect("x", "y"))
    smaller, larger = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    alike = (smaller >= F.lit(threshold) * larger - SLACK) & (common >= F.lit(threshold) * (smaller + larger - common) - SLACK)
    return pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").where(alike).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def link_sets(
    docs: DataFrame, classes: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, radius: int = RADIUS, hot_key: int = HOT_KEY
) -> DataFrame:
    """Edges (src, dst) between classes (n, c1, c2, least, f0...) with similar sets."""
    parts = choose_partitions(classes, radius)
    own = keyed(classes.withColumn("component", F.col("n")), parts, own=True)
    edges = _verified(_nearest_pivots(_pivots(own), own), docs, classes, width, threshold)
    grouped = _grouped(classes, edges)
    own, near = keyed(grouped, parts, own=True), keyed(grouped, parts, own=False)
    edges = edges.union(_verified(_meet(_pivots(own), own.union(near)), docs, classes, width, threshold))
    grouped = _grouped(classes, edges)
    own, near = keyed(grouped, parts, own=True), keyed(grouped, parts, own=False)
    hot_key = max(hot_key, 16 * classes.count() >> min(len(g) for g, _ in parts))
    hot = cut(own.groupBy("key").agg(F.count("*").alias("sets")).where(F.col("sets") > hot_key).select("key"), "hot")
    if hot.isEmpty():
        return edges.union(_verified(_meet(own, own.union(near)), docs, classes, width, threshold))
    plain = own.hint("merge").join(hot, "key", "left_anti")
    links = edges.union(_verified(_meet(plain, own.union(near)), docs, classes, width, threshold))
    every = own.union(near).hint("merge").join(hot, "key", "left_semi")
    mixed_keys = every.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    every = every.hint("merge").join(cut(mixed_keys, "mixed"), "key", "left_semi")
    return links.union(_rare_links(docs, classes, cut(every.select("n", "component").distinct(), "unsettled"), width, threshold))


def _rare_links(docs: DataFrame, classes: DataFrame, few: DataFrame, width: int, threshold: float) -> DataFrame:
    """(src, dst): the similar pairs of different components among few (n, component), by a join on their rarest shingles.

    Sets travel with their rare shingles, so that the join verifies and only similar pairs leave it.
    """
    sets = cut(sets_of(docs, classes, few.select("n"), width).hint("merge").join(few, "n"), "sets")
    release(docs.sparkSession)
    grams = sets.select("n", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    counts = cut(grams.groupBy("gram").agg(F.count("*").alias("sets")), "counts")
    ranked = grams.hint("merge").join(counts, "gram").groupBy("n", "size").agg(F.array_sort(F.collect_list(F.struct("sets", "gram"))).alias("ranked"))
    length = (F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - SLACK) + 1).cast("int")
    prefix = F.transform(F.slice("ranked", 1, length), lambda r, i: F.struct(i.alias("at"), r["gram"].alias("gram"), r["sets"].alias("sets")))
    shared = F.filter(prefix, lambda r: r["sets"] > 1)
    rows = ranked.select("n", "size", F.explode(shared).alias("r"))
    rows = cut(rows.select("n", "size", "r.at", "r.gram").hint("merge").join(few, "n"), "rare")
    # only shingles that several components have among their rare ones bring pairs together
    met = rows.groupBy("gram").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("gram")
    rows = cut(rows.drop("component").hint("merge").join(cut(met, "met"), "gram", "left_semi"), "rare").hint("merge").join(sets, "n")
    release(docs.sparkSession)
    sides = [rows.select(F.col("gram").alias(f"gram_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "size", "at", "component", "grams")]) for x in ("a", "b")]
    least = F.lit(threshold / (1 + threshold)) * (F.col("size_a") + F.col("size_b")) - SLACK
    fits = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= least  # true where the first shingle in common stands
    fits &= F.least("size_a", "size_b") >= F.lit(threshold) * F.greatest("size_a", "size_b") - SLACK
    apart = (F.col("gram_a") == F.col("gram_b")) & (F.col("n_a") < F.col("n_b")) & (F.col("component_a") != F.col("component_b"))
    alike = F.size(F.array_intersect("grams_a", "grams_b")) >= least
    links = sides[0].hint("merge").join(sides[1], apart & fits & alike)
    return cut(links.select(F.col("n_a").alias("src"), F.col("n_b").alias("dst")).distinct(), "links")


def _named(
    docs: DataFrame, width: int, threshold: float, radius: int, hot_key: int
) -> DataFrame:
    """(id, t1, t2, component) of docs (id, text)."""
    marked = cut(mark(docs, width), "marked")
    firsts = [F.first(c).alias(c) for c in _WORDS]
    classes = marked.groupBy("c1", "c2").agg(F.min("id").alias("least"), *firsts).withColumn("n", F.monotonically_increasing_id())
    classes = cut(classes, "set-classes")
    release(docs.sparkSession)
    components = connected_components(link_sets(docs, classes, width, threshold, radius, hot_key))
    of = classes.select("n", "c1", "c2").hint("merge").join(components.withColumnRenamed("node", "n"), "n", "left")
    of = cut(of.select("c1", "c2", F.coalesce("component", "n").alias("component")), "of")
    return cut(marked.select("id", "t1", "t2", "c1", "c2").hint("merge").join(of, ["c1", "c2"]).select("id", "t1", "t2", "component"), "documents")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, radius: int = RADIUS,
    hot_key: int = HOT_KEY,
) -> DataFrame:
    """One row for each row of docs: id, component_id (the smallest id among all texts reachable).

    Texts found whose shingle sets have a Jaccard similarity of at least threshold (above 0) are linked and links are
    transitive. Texts without words are like each other. A null id never names a component unless all ids in it are null;
    repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    named = _named(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), width, threshold, radius, hot_key)
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    return named.hint("merge").join(least, "component").select("id", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group, with the columns of docs.

    The row with the least id stays (nulls last); of several texts with that id the one with the least hash, and of repeated
    rows (same id and same text) one. Null, empty and blank texts are one group. An empty table stays empty. Other columns
    pass through, whatever their names.
    """
    named = _named(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), WIDTH, THRESHOLD, RADIUS, HOT_KEY)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")
    stay = cut(named.groupBy("component").agg(F.min(order).alias("row")).select("row.id", "row.t1", "row.t2"), "stay")
    release(docs.sparkSession)
    t1, t2 = free_names(docs, "t1", "t2")
    keyed_docs = docs.withColumns(dict(zip((t1, t2), text_hashes(text_col), strict=True)))
    match = keyed_docs[id_col].eqNullSafe(stay["id"]) & (keyed_docs[t1] == stay["t1"]) & (keyed_docs[t2] == stay["t2"])
    out = keyed_docs.hint("merge").join(stay, match, "left_semi")
    if named.hint("merge").join(stay, named["id"].eqNullSafe(stay["id"]) & (named["t1"] == stay["t1"]) & (named["t2"] == stay["t2"]), "left_semi").count() > stay.count():
        out = out.dropDuplicates([id_col, t1, t2])
    return out.select(*[out[c] for c in docs.columns])
