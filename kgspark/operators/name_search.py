"""Join of names by Jaro-Winkler similarity through an inverted index, so that names that can't be near are never compared.

A pair with a common prefix of k letters (0 to 4) has a similarity of t only if its Jaro similarity is (t - k/10) / (1 - k/10), and
that only if it has at least (3 Jaro - 1) n m / (n + m) letters in common, n and m being the lengths. So of the letters of a
name, each with the number of its occurrence and rarest first, it is enough to look at the first few (the prefix filter): two
names must share some of them. Keys are combinations of such letters under the common prefix and both lengths' buckets; the
more letters in common are needed, the more go into a key. All pairs at or above the threshold share a key.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.functions.similarity import PREFIX, SCALE, JaroTable, at_least, jaro_winkler_batch
from kgspark.shared import cut

#: Where buckets of lengths begin: each length to 8, then about a fifth more each time.
BUCKETS = [*range(1, 9), *sorted({int(8 * 1.19**i) for i in range(1, 90)} - {8})]
#: Keys of a name for a bucket of partners, if fewer letters in a key would not do, and letters in a key.
CHOICES, LETTERS = 64, 4
#: Letters whose frequencies are held by tasks; others count as rarer. Keys of the asked names that are held by tasks, if they are no more.
RANKS, HELD = 4096, 4_000_000
#: Bits for a letter of a name in near_in_tile.
DEEP = 16
#: Thresholds at which nearest_names looks for a name before it takes the lowest one.
RUNGS = (0.95, 0.92, 0.88, 0.84, 0.8, 0.75)


def _up(x: float) -> int:
    """The least whole number that x allows, whatever rounding has added to x."""
    return math.ceil(x - 1e-9)


def _common(jaro: float, n: int, m: int) -> float:
    return (3 * jaro - 1) * n * m / (n + m)


def _nearest_need(jaro: float, n: int, other: int) -> int | None:
    """The least number of common letters of a name of n letters and one whose length is in bucket other; None: none can be near."""
    share = 3 * jaro - 2  # of the longer length, which the shorter one must have at least
    low, high = max(BUCKETS[other], _up(n * share)), BUCKETS[other + 1] - 1
    return None if low > high or low * share > n + 1e-9 else _up(_common(jaro, n, low))


@lru_cache(maxsize=None)
def _rule(threshold: float, k: int, own: int, other: int) -> tuple[float, int] | None:
    """(Jaro similarity, letters in a key) of pairs with k letters at the start and lengths in two buckets, in either order; None: no
    such pair."""
    jaro = (threshold - SCALE * k) / (1 - SCALE * k)
    share, needs, spare, letters = 3 * jaro - 2, [], 0, 0
    for x, y in ((own, other), (other, own)):
        low = max(BUCKETS[x], _up(BUCKETS[y] * share))
        high = BUCKETS[x + 1] - 1 if share <= 0 else min(BUCKETS[x + 1] - 1, math.floor((BUCKETS[y + 1] - 1) / share + 1e-9))
        if low > high:
            return None
        needs.append(_up(_common(jaro, low, max(BUCKETS[y], low * share))))  # longer names need more
        spare = max(spare, *(n - (_nearest_need(jaro, n, y) or n) for n in (low, high)))
    fewest = min(needs) - k
    while letters < min(fewest, LETTERS):
        more = letters + 1
        if more > 1 and math.comb(max(spare + more, more), more) > CHOICES:
            break
        letters = more
    return jaro, letters


@lru_cache(maxsize=4096)
def _choices(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int32).reshape(-1, k)


@lru_cache(maxsize=1 << 20)
def _hash(*parts) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def _rarest_first(text: str, ranks: dict[tuple[str, int], int]) -> np.ndarray:
    """Hashes of the letters with their occurrences, the rarest letter first."""
    seen: dict[str, int] = {}
    letters = []
    for c in text:
        seen[c] = nth = seen.get(c, 0) + 1
        letters.append((-ranks.get((c, nth), RANKS), c, nth))
    return np.array([_hash(c, nth) for _, c, nth in sorted(letters)], np.uint64)


def name_keys(name: str, threshold: float, ranks: dict[tuple[str, int], int], buckets: list[int], asked: bool | None = None) -> np.ndarray:
    """The keys of a name (trimmed, in lower case) for partners whose lengths are in buckets. asked: the side of the pair, None where
    names of one table are to meet."""
    n = len(name)
    if not n:
        return np.array([_hash("empty")], np.uint64)
    own = bisect_right(BUCKETS, n) - 1
    out = []
    for k in range(min(PREFIX, n) + 1):
        letters = None
        for other in buckets:
            rule = _rule(threshold, k, min(own, other), max(own, other))
            if rule is None:
                continue
            jaro, many = rule
            if _nearest_need(jaro, n, other) is None:
                continue
            salt = _hash(k, (own, other) if asked or asked is None and own <= other else (other, own), name[:k])
            if not many:
                out.append(np.array([salt], np.uint64))
                continue
            need = _nearest_need(jaro, n, other) - k
            if need > n - k:
                continue
            letters = _rarest_first(name[k:], ranks) if letters is None else letters
            first = letters[: n - k - need + many]
            out.append(first[_choices(len(first), many)].sum(axis=1, dtype=np.uint64) ^ salt)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _bucket(name: Column) -> Column:
    """As name_keys has it, but for white space that only Python strips, which may make a name shorter by some buckets."""
    return F.greatest(F.size(F.filter(F.array(*map(F.lit, BUCKETS)), lambda b: b <= F.char_length(name))) - 1, F.lit(0))


def _held_buckets(names: DataFrame, column: str) -> list[int]:
    return sorted(r[0] for r in names.select(_bucket(F.col(column))).distinct().collect())  # as many as BUCKETS at most


def letter_ranks(names: DataFrame, column: str) -> dict[tuple[str, int], int]:
    """The RANKS most frequent letters by occurrence, the most frequent with the smallest number."""
    chars = F.split(F.col(column), "")
    nth = F.transform(chars, lambda c, i: F.struct(c.alias("c"), F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)).alias("nth")))
    counted = names.select(F.inline(nth)).groupBy("c", "nth").agg(F.count("*").alias("n"))
    return {(r["c"], r["nth"]): i for i, r in enumerate(counted.orderBy(F.desc("n"), "c", "nth").limit(RANKS).collect())}


def _keyed(names: DataFrame, column: str, group: str | None, threshold: float, ranks, buckets: list[int], asked: bool, only: np.ndarray | None = None) -> DataFrame:
    """names with a column key, a row for each; with a group, keys of different groups differ. only: sorted keys, others are left out."""
    names = names.withColumn("_group", F.col(group).cast("string") if group else F.lit(""))
    spark = names.sparkSession
    held = spark.sparkContext.broadcast((ranks, only))
    at, last = names.columns.index(column), len(names.columns) - 1
    schema = T.StructType([*names.schema.fields[:last], T.StructField("key", T.LongType())])

    def run(batches):
        ranks, only = held.value
        for batch in batches:
            keys, rows = [], []
            for i, (name, own) in enumerate(zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True)):
                found = name_keys(name.strip().lower(), threshold, ranks, buckets, asked)
                found = found ^ _hash("group", own) if own else found
                if only is not None and len(found):
                    place = np.minimum(np.searchsorted(only, found), len(only) - 1)
                    found = found[only[place] == found] if len(only) else found[:0]
                keys.append(found)
                rows.append(np.full(len(found), i))
            if keys:
                row, key = pa.array(np.concatenate(rows).astype(np.int64)), pa.array(np.concatenate(keys).view(np.int64))
                yield pa.RecordBatch.from_arrays([*[c.take(row) for c in batch.columns[:last]], key], names=schema.names)

    return names.mapInArrow(run, schema)


def near_names(asked: DataFrame, names: DataFrame, threshold: float, group: str | None = None, ranks: dict | None = None) -> DataFrame:
    """All pairs of a row of asked (column m and others) and one of names (column alias and others) whose Jaro-Winkler similarity is the
    threshold or more, with score. group: a column that both have, under which alone pairs are sought.

    Names are trimmed and in lower case; equal rows come once. Where the asked names' keys are few, tasks drop all others before anything is shuffled; else both sides are. A key that very many names
    have is an ordinary join key, whose partition adaptive execution splits. Null names have no pairs.
    """
    asked, names = asked.where("m is not null"), names.where("alias is not null")
    ranks = letter_ranks(names, "alias") if ranks is None else ranks
    white = [F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "") for c in ("m", "alias")]  # lengths as name_keys sees them
    buckets = [_held_buckets(df.select(w.alias("x")), "x") for df, w in ((asked, white[0]), (names, white[1]))]
    left = cut(_keyed(asked, "m", group, threshold, ranks, buckets[1], True), "asked-keys")
    only = None
    if left.limit(HELD + 1).count() <= HELD:
        only = np.unique(left.select("key").toArrow().column(0).to_numpy().view(np.uint64))  # HELD at most
    right = _keyed(names, "alias", group, threshold, ranks, buckets[0], False, only)
    if group:
        right = right.drop(group)
    pairs = right.hint("merge").join(left, "key").drop("key")
    # by number, so that few bytes but much work to do are not put together in one task
    pairs = pairs.repartition(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), "m", "alias").distinct()
    return at_least(pairs, "m", "alias", jaro_winkler_batch, threshold, 9)


def nearest_names(asked: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """(m, entity_id, score) of the nearest of names (alias, entity_id) to each of asked (m), if it is as near as the threshold;
    ties go to the smaller id. Scores have nine digits.

    High thresholds are tried first: few pairs share their keys, and what is found there has no nearer name. Only what is
    left goes on to a lower one.
    """
    ranks = letter_ranks(names, "alias")
    rest, found = cut(asked.select("m").distinct(), "rest"), None
    for rung in [*[r for r in RUNGS if r > threshold], threshold]:
        if rest.isEmpty():
            break
        best = near_names(rest, names, rung, ranks=ranks).groupBy("m").agg(F.min(F.struct((-F.col("score")).alias("worse"), "entity_id")).alias("best"))
        best = cut(best.select("m", "best.entity_id", (-F.col("best.worse")).alias("score")), "nearest")
        found = best if found is None else found.unionByName(best)
        if rung > threshold:
            rest = cut(rest.hint("merge").join(best, "m", "left_anti"), "rest")
    if found is None:
        found = asked.sparkSession.createDataFrame([], f"m string, entity_id {names.schema['entity_id'].dataType.simpleString()}, score double")
    return found


def _letters(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each name how often it has each letter (letters are put together by 64 at most), its first letters, and its length."""
    size = np.array([len(x) for x in names], np.int64)
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(np.repeat(np.arange(len(names)), size) * 64 + codes % 64, minlength=64 * len(names)).reshape(-1, 64)
    heads = np.array([[ord(c) for c in x[:PREFIX]] + [-1] * (PREFIX - len(x[:PREFIX])) for x in names], np.int64).reshape(-1, PREFIX)
    return counts, heads, size


def _in_bits(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of x, words of y, over of x, over of y): bits of numbers of letters, as many as the number, DEEP at most, and what is over that.
    Of two names no more letters are in common than bits, and what both are over."""
    deep = np.minimum(np.minimum(x.max(axis=0, initial=0), y.max(axis=0, initial=0)), DEEP)
    letter, least = np.repeat(np.arange(64), deep), np.concatenate([np.arange(d) for d in deep])
    unused = -len(letter) % 64 if len(letter) else 64
    words = [np.ascontiguousarray(np.packbits(np.pad(z[:, letter] > least, ((0, 0), (0, unused))), axis=1)).view(np.uint64) for z in (x, y)]
    return *words, *(np.maximum(z[:, deep == DEEP] - DEEP, 0).sum(axis=1) for z in (x, y))


def near_in_tile(left: list[str], right: list[str], threshold: float, same: bool = False, either: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of left and right with a Jaro-Winkler similarity of threshold and more. same: left is right, pairs come once.
    either: also those that have it the other way round, as the first name's letters choose theirs one after another.

    Names with too few letters in common, wherever these stand, are never scored.
    """
    (x, head, n), (y, other, m) = _letters(left), _letters(right)
    scores, turned = JaroTable(left, right), JaroTable(right, left) if either else None
    x, y, over, more = _in_bits(x, y)
    columns, kind = np.ascontiguousarray(y.T), np.uint8 if 64 * y.shape[1] < 256 and not (over.any() and more.any()) else np.int64
    (sizes, own), (lengths, of) = (np.unique(size, return_inverse=True) for size in (n, m))
    most = sizes[:, None].astype(float) + 0 * lengths  # letters that must be in common for lengths, if all of PREFIX are at the start
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (threshold - 1e-9 - SCALE * PREFIX) / (1 - SCALE * PREFIX)
        most = np.ceil((3 * jaro - 1) / (1 / most + 1 / lengths) - 1e-6)
    need = np.clip(np.where(np.isfinite(most), most, 0), 0, 255 if kind is np.uint8 else None)[:, of].astype(kind)
    step, waiting, held = max(1, (1 << 16) // max(1, len(right))), [], 0
    for start in range(0, len(left), step):
        part = slice(start, start + step)
        common = np.zeros((len(n[part]), len(m)), kind)
        for c in range(len(columns)):
            common += np.bitwise_count(x[part, c, None] & columns[c])
        if kind is not np.uint8:
            common += np.minimum(over[part, None], more)
        at = np.flatnonzero(common >= need[own[part]])
        a, b = np.divmod(at, len(m)) if len(m) else (at, at)
        kept = slice(None) if not same else a + start < b
        waiting.append((a[kept] + start, b[kept], common.ravel()[at[kept]]))
        held += len(waiting[-1][0])
        if held < 1 << 15 and start + step < len(left):
            continue
        i, j, count = (np.concatenate(w) for w in zip(*waiting, strict=True))
        waiting, held, count, size, length = [], 0, count.astype(float), n[i], m[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(count > 0, (count / size + count / length + 1) / 3, 0.0)
        jaro[(size == 0) & (length == 0)] = 1.0
        shared = np.cumprod((head[i] == other[j]) & (head[i] >= 0), axis=1).sum(axis=1)
        can = jaro + SCALE * shared * (1 - jaro) >= threshold - 1e-9
        i, j = i[can], j[can]
        found = scores.of_pairs(i, j, threshold - 1e-9)
        if either:  # letters in common are as many the other way round, but may stand in another order
            met = found > 0
            found[met] = np.maximum(found[met], turned.of_pairs(j[met], i[met]))
        kept = found >= threshold - 1e-9
        yield i[kept], j[kept]


def near_in_pieces(names: DataFrame, threshold: float) -> DataFrame:
    """(block, a, b): all pairs of names (block, id: the name in lower case, trimmed; piece, pieces) of one block with that similarity.

    Each piece of a block meets each other one in a tile of its own: a task holds the names of one tile at a time.
    """
    rows = cut(names.groupBy("block", "piece", "pieces").agg(F.collect_list("id").alias("held")), "pieces")
    left = rows.select("block", F.col("piece").alias("i"), F.explode(F.sequence("piece", F.col("pieces") - 1)).alias("j"), F.col("held").alias("x"))
    tiles = left.hint("merge").join(rows.select("block", F.col("piece").alias("j"), F.col("held").alias("y")), ["block", "j"])
    # by number, as tiles are few bytes but much work
    tiles = tiles.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "i", "j").select("block", "i", "j", "x", "y")
    schema = "block string, a string, b string"

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block, i, j, x, y = (batch.column(c)[k].as_py() for c in range(5))
                for a, b in near_in_tile(x, y, threshold, i == j, True):
                    found = [pa.array([block] * len(a)), pa.array([x[q] for q in a]), pa.array([y[q] for q in b])]
                    yield pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in found], names=["block", "a", "b"])

    return tiles.mapInArrow(run, schema)
