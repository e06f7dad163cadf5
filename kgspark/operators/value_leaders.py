"""Leaders among similar strings, as a walk in order would choose them, found in parallel.

A string leads unless an earlier leader is similar to it (the matching-blocks ratio): leaders are the lexicographically first
maximal independent set of the graph of similar pairs. Pairs come from an index: a ratio of t needs a common subsequence of
t (n + m) / 2 characters, so that short strings are keyed by what is left of them without the few others, and long
ones by the rarest of their q-grams that a partner can't all lack. Then strings are settled in rounds, all groups at once: one whose
earlier neighbours are all followers leads, and what a leader is similar to follows.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.functions.similarity import at_least, ratio_batch
from kgspark.operators.components import connected_components
from kgspark.operators.name_search import BUCKETS, _choices, _hash
from kgspark.shared import cut

#: Ways to leave characters out, up to which a pair of lengths is keyed by what is left; length from which grams have three characters.
WAYS, LONG = 400, 15
#: Rounds after which components of the graph with up to SETTLED edges are walked through, each in a task.
ROUNDS, SETTLED = 8, 100_000
#: Values of a group up to which all its pairs are compared: fewer than the keys of a value would be.
FEW = 100
#: Frequencies of grams that tasks hold; others count as rarer.
RANKS = 20_000
_FACTORS = np.random.default_rng(7).integers(0, 2**63, 4096, np.int64).view("<u8") * np.uint64(2) + np.uint64(1)


def _least_common(threshold: float, n: int, m: int) -> int:
    return math.ceil(threshold * (n + m) / 2 - 1e-9)


@lru_cache(maxsize=1 << 16)
def _by_rest(threshold: float, n: int, m: int) -> bool:
    least = _least_common(threshold, n, m)
    return max(math.comb(n, n - least), math.comb(m, m - least)) <= WAYS


@lru_cache(maxsize=1 << 16)
def _partners(threshold: float, n: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(partner lengths that are keyed by the rest, [(bucket of other lengths, characters of a gram, grams that are looked at)])."""
    low, high = math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)
    rest, grams = [], {}
    own = BUCKETS[bisect_right(BUCKETS, n) - 1]
    for m in range(max(1, low), high + 1):
        if _by_rest(threshold, n, m):
            rest.append(m)
            continue
        bucket = bisect_right(BUCKETS, m) - 1
        q = 3 if threshold >= 0.9 and min(own, BUCKETS[bucket]) >= LONG else 1
        least = _least_common(threshold, n, m)
        lost = q * (n - least) + (q - 1) * (m - least)
        grams[bucket, q] = max(grams.get((bucket, q), 0), lost + 1)
    return rest, [(b, q, first) for (b, q), first in grams.items()]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _grams(text: str, q: int, ranks: dict[str, int]) -> np.ndarray:
    """Hashes of the q-grams with their occurrences, the rarest first."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(text) - q + 1):
        gram = text[i : i + q]
        seen[gram] = nth = seen.get(gram, 0) + 1
        out.append((-ranks.get(gram, RANKS), gram, nth))
    return np.array([_hash(gram, nth) for _, gram, nth in sorted(out)], np.uint64)


def value_keys(value: str, threshold: float, ranks: dict[str, int]) -> np.ndarray:
    """The keys of a string: two strings whose ratio is the threshold or more have one in common."""
    n, out = len(value), []
    own = bisect_right(BUCKETS, n) - 1
    rest, buckets = _partners(threshold, n)
    codes = _codes(value)
    for m in rest:
        least = _least_common(threshold, n, m)
        kept = codes[_choices(n, least)] + np.uint64(1)
        factors = _FACTORS[:least] if least <= len(_FACTORS) else np.resize(_FACTORS, least)
        out.append(np.unique((kept * factors).sum(axis=1, dtype=np.uint64)) ^ _hash("rest", min(n, m), max(n, m)))
    found: dict[int, np.ndarray] = {}
    for bucket, q, first in buckets:
        if q not in found:
            found[q] = _grams(value, q, ranks)
        out.append(found[q][:first] ^ _hash("grams", q, min(own, bucket), max(own, bucket)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _gram_ranks(values: DataFrame, column: str) -> dict[str, int]:
    """The most frequent grams of three characters (those of one have no ranks), the most frequent with the smallest number."""
    x = F.col(column)
    at = F.sequence(F.lit(1), F.char_length(x) - 2)
    grams = values.where(F.char_length(x) >= LONG).select(F.explode(F.transform(at, lambda i: F.substr(x, i, F.lit(3)))).alias("gram"))
    top = grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(RANKS).collect()
    return {r["gram"]: i for i, r in enumerate(top)}


def similar_pairs(values: DataFrame, threshold: float) -> DataFrame:
    """(a, b, leader): nodes whose strings' ratio is the threshold or more, a before b in its group, and a's string.

    values: node, group (a string), value, first (what orders a group). Values are dealt out by key, so that a group of any size is
    split; a key that very many have is an ordinary join key, whose partition adaptive execution splits. The values of a group of
    FEW at most all meet, without keys.
    """
    sizes = cut(values.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > 1), "group-sizes")
    of = lambda fits: values.hint("merge").join(sizes.where(fits).select("group"), "group", "left_semi")
    small = of(F.col("n") <= FEW).select("group", "node", "first", "value", F.char_length("value").alias("size"))
    sides = [small.select("group", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "first", "value", "size")]) for x in ("a", "b")]
    near = 2 * F.least("size_a", "size_b") >= (threshold - 1e-9) * (F.col("size_a") + F.col("size_b"))
    met = sides[0].hint("merge").join(sides[1], "group").where((F.col("first_a") < F.col("first_b")) & near)
    few = met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "first_a", F.col("value_a").alias("leader"), F.col("value_b").alias("follower"))
    few = at_least(few, "follower", "leader", ratio_batch, threshold).select("a", "b", "first_a", "leader")
    large = sizes.where(F.col("n") > FEW)
    if large.isEmpty():
        return few
    return few.unionByName(_pairs_by_key(cut(of(F.col("n") > FEW), "large"), threshold))


def _pairs_by_key(values: DataFrame, threshold: float) -> DataFrame:
    """similar_pairs by the index of value_keys."""
    held = values.sparkSession.sparkContext.broadcast(_gram_ranks(values, "value"))
    kept = values.select("node", "first", "value", "group")
    schema = T.StructType([*kept.schema.fields[:3], T.StructField("key", T.LongType())])

    def run(batches):
        for batch in batches:
            keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, (value, group) in enumerate(zip(batch.column("value").to_pylist(), batch.column("group").to_pylist(), strict=True)):
                own = value_keys(value, threshold, held.value) ^ _hash("group", group)
                keys.append(own)
                rows.append(np.full(len(own), i))
            row = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*[c.take(row) for c in batch.columns[:3]], pa.array(np.concatenate(keys).view(np.int64))], names=schema.names)

    keyed = cut(kept.mapInArrow(run, schema), "value-keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = cut(keyed.hint("merge").join(shared, "key", "left_semi"), "value-met")
    left = met.select("key", F.col("node").alias("a"), F.col("first").alias("first_a"), F.col("value").alias("leader"))
    right = met.select("key", F.col("node").alias("b"), F.col("first").alias("first_b"), F.col("value").alias("follower"))
    pairs = left.hint("merge").join(right, "key").where(F.col("first_a") < F.col("first_b"))
    pairs = pairs.select("a", "b", "first_a", "leader", "follower")
    # by number, so that few bytes but much work to do are not put together in one task
    pairs = pairs.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b").distinct()
    return at_least(pairs, "follower", "leader", ratio_batch, threshold).select("a", "b", "first_a", "leader")


def _walked(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(followers of the components that are small enough to be walked through, edges of the others)."""
    parts = connected_components(live.select("a", "b"), "a", "b")
    tagged = cut(live.hint("merge").join(parts.select(F.col("node").alias("a"), "component"), "a"), "tagged")
    small = cut(tagged.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= SETTLED).select("component"), "small")

    def walk(table: pa.Table) -> pa.Table:
        earlier: dict[int, list[int]] = {}
        rows = table.select(["a", "b", "first_a"]).to_pylist()
        order = {r["a"]: tuple((x is not None, x) for x in r["first_a"].values()) for r in rows}
        for r in rows:
            earlier.setdefault(r["b"], []).append(r["a"])
        follows: set[int] = set()
        ends = [b for b in earlier if b not in order]  # those before nobody come last
        for node in [*sorted(order, key=order.__getitem__), *ends]:
            if any(a not in follows for a in earlier.get(node, ())):
                follows.add(node)
        return pa.table({"node": pa.array(sorted(follows), pa.int64())})

    found = tagged.hint("merge").join(small, "component", "left_semi").groupBy("component").applyInArrow(walk, "node long")
    return cut(found, "walked"), cut(tagged.hint("merge").join(small, "component", "left_anti").drop("component"), "live")


def followers(edges: DataFrame) -> DataFrame:
    """(node) of the strings that follow a leader. edges: as similar_pairs, written."""
    live, gone, rounds = edges.select("a", "b", "first_a"), None, 0
    while not live.isEmpty():
        if rounds and rounds % ROUNDS == 0:
            covered, live = _walked(live)
            gone = covered if gone is None else gone.unionByName(covered)
        rounds += 1
        heads = live.select(F.col("a")).distinct().hint("merge").join(live.select(F.col("b").alias("a")), "a", "left_anti")
        covered = cut(live.hint("merge").join(heads, "a", "left_semi").select(F.col("b").alias("node")).distinct(), "covered")
        gone = covered if gone is None else gone.unionByName(covered)
        for side in ("a", "b"):
            live = live.hint("merge").join(covered.select(F.col("node").alias(side)), side, "left_anti")
        live = cut(live, "live")
    return cut(gone, "followers") if gone is not None else edges.select(F.col("a").alias("node")).limit(0)


def lead(values: DataFrame, threshold: float) -> DataFrame:
    """(node, leader): for each follower the string of the first leader of its group that it is similar to. values: as similar_pairs."""
    edges = cut(similar_pairs(values, threshold), "similar")
    follow = followers(edges)
    led = edges.hint("merge").join(follow.select(F.col("node").alias("a")), "a", "left_anti")
    return led.groupBy(F.col("b").alias("node")).agg(F.min_by("leader", "first_a").alias("leader"))
