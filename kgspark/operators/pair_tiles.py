"""Scores of the pairs of a block where its members lie: a task holds one or two pieces of a block with their names.

No pair travels with its names: what leaves a task are the pairs that are asked for, or for merges so many of them as hold
together what they link. Names, signatures and identifiers that many members have in common are compared once for SLICE pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.functions.similarity import JaroTable, best_batch
from kgspark.shared import cut

#: Pairs that a task scores at once.
SLICE = 1 << 18


def tiles(members: DataFrame, whole: bool) -> DataFrame:
    """(x, y): members of two pieces of a cell that are compared with each other, by id; y is null where a piece is with itself.

    members: id, cell, piece, pieces (all of a cell are compared), before (earlier cells of the id), names, signature,
    identifiers. whole: every cell is one piece.
    """
    keys = ["cell"] if whole else ["cell", "piece"]
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as tiles are few bytes but much work
    held = F.sort_array(F.collect_list(F.struct("id", "before", "names", "signature", "identifiers")))
    rows = members.repartition(parts, *keys).groupBy(*keys).agg(held.alias("x"), F.max("pieces").alias("pieces"))
    if whole:
        return rows.sortWithinPartitions("cell").select("x", F.lit(None).cast(rows.schema["x"].dataType).alias("y"))
    rows = cut(rows, "pieces")
    left = rows.select("cell", F.col("piece").alias("i"), F.explode(F.sequence("piece", F.col("pieces") - 1)).alias("j"), "x")
    met = left.hint("merge").join(rows.select("cell", F.col("piece").alias("j"), F.col("x").alias("y")), ["cell", "j"])
    met = met.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return met.select("x", F.when(F.col("i") < F.col("j"), F.col("y")).alias("y"))


def combined_score(name, overlap, exact, when: Callable, least: Callable):
    """0.65 name + 0.35 evidence, with an identifier in common 0.85 + 0.15 name; of columns or arrays."""
    return least(1.0, when(exact, 0.85 + 0.15 * name, 0.65 * name + 0.35 * overlap))


def combined_column(name: Column, overlap: Column, exact: Column) -> Column:
    return combined_score(name, overlap, exact, lambda c, x, y: F.when(c, x).otherwise(y), lambda x, y: F.least(F.lit(x), y))


def _hashable(value):
    if isinstance(value, dict):
        return tuple(map(_hashable, value.values()))
    return tuple(map(_hashable, value)) if isinstance(value, list) else value


def _shared(pair) -> float:
    """The Jaccard similarity of two sets, 0 for null or without elements."""
    a, b = pair
    if not a or not b:
        return 0.0
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def _score(left: list, right: list, least: float) -> np.ndarray:
    """Combined scores of pairs of (names, signature, identifiers), or what they have without names where these aren't needed to reach least or can't help to."""
    overlap = np.array([_shared((a[1], b[1])) for a, b in zip(left, right, strict=True)], float)
    exact = np.array([not a[2].isdisjoint(b[2]) for a, b in zip(left, right, strict=True)], bool)
    score = lambda name: combined_score(name, overlap, exact, np.where, np.minimum)
    name = np.zeros(len(left))
    open_ = (score(1.0) >= least) & (score(0.0) < least)
    at = np.flatnonzero(open_)
    name[at] = best_batch([left[i][0] for i in at], [right[i][0] for i in at])
    return score(name)


def heads(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of n positions that each is linked with, along the links (a, b)."""
    head = np.arange(n)
    while True:
        x, y = head[a], head[b]
        apart = x != y
        if not apart.any():
            return head
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(head, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(head, up := head[head]):
            head = up


class _Slice:
    """Some pairs of members, by their positions in one list of all of them."""

    def __init__(self):
        self.ids, self.kinds, self.known = [], [], {}
        self.a, self.b, self.size = [], [], 0

    def place(self, members: list[dict]) -> tuple[int, list]:
        """(position of the first of members, their earlier cells)."""
        start = len(self.ids)
        for m in members:
            self.ids.append(m["id"])
            kind = tuple(None if m[k] is None else _hashable(m[k]) for k in ("names", "signature", "identifiers"))
            self.kinds.append(self.known.setdefault(kind, len(self.known)))
        return start, [frozenset(_hashable(m["before"])) for m in members]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.a), np.concatenate(self.b)

    def reaching(self, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs (a, b) that reach least."""
        kind = np.array(self.kinds, np.int64)
        met, which = np.unique(kind[a] * len(self.known) + kind[b], return_inverse=True)
        known = [(n or (), frozenset(s or ()), frozenset(i or ()) - {None}) for n, s, i in self.known]
        left, right = ([known[k] for k in side] for side in np.divmod(met, len(known)))
        kept = (_score(left, right, least) >= least)[which]
        return a[kept], b[kept]


def _slices(batch: pa.RecordBatch) -> Iterator[_Slice]:
    """The pairs of different ids of a batch of tiles, each in the first cell that both are in."""
    own = _Slice()
    for k in range(batch.num_rows):
        x, y = (batch.column(c)[k].as_py() for c in (0, 1))
        width = len(x if y is None else y)
        step = max(1, SLICE // max(1, width))
        for start in range(0, len(x), step):
            i, seen = own.place(x if y is None else x[start : start + step])
            if y is None:
                p, q = np.nonzero(np.arange(start, min(start + step, len(x)))[:, None] < np.arange(width))
                p, j, other = p + start, i, seen
            else:
                j, other = own.place(y)
                p, q = (c.ravel() for c in np.indices((min(step, len(x) - start), width)))
            if any(seen) and any(other):
                both = np.array([seen[u].isdisjoint(other[v]) for u, v in zip(p, q, strict=True)], bool)
                p, q = p[both], q[both]
            own.a.append(p + i)
            own.b.append(q + j)
            own.size += len(p)
            if own.size >= SLICE:
                yield own
                own = _Slice()
    if own.size:
        yield own


def linked(own: _Slice, least: float) -> np.ndarray:
    """heads of the pairs that reach least. An eighth of the pairs comes first: what these link needs no other pair."""
    a, b = own.pairs()
    x, y = own.reaching(a[::8], b[::8], least)
    head = heads(x, y, len(own.ids))
    rest = head[a] != head[b]
    rest[::8] = False
    u, v = own.reaching(a[rest], b[rest], least)
    return heads(np.concatenate([x, u]), np.concatenate([y, v]), len(own.ids))


def _apart(own: _Slice, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs are of different ids."""
    number: dict = {}
    code = np.array([number.setdefault(i, len(number)) for i in own.ids], np.int64)
    return code[a] != code[b]


def _id_type(tiled: DataFrame) -> T.DataType:
    return tiled.schema["x"].dataType.elementType["id"].dataType


def links(tiled: DataFrame, least: float) -> DataFrame:
    """(a, b): links of tiles that join whatever pairs with a combined score of least and more join, at most one for each id and slice."""
    schema = T.StructType([T.StructField(x, _id_type(tiled)) for x in "ab"])

    def run(batches):
        for batch in batches:
            kind = batch.schema.field("x").type.value_type.field("id").type
            for own in _slices(batch):
                head = linked(own, least)
                far = np.flatnonzero(head != np.arange(len(head)))
                far = far[_apart(own, far, head[far])]
                yield pa.RecordBatch.from_arrays([pa.array([own.ids[i] for i in side], kind) for side in (head[far], far)], names=["a", "b"])

    return tiled.mapInArrow(run, schema)


def _common(left: list[frozenset], right: list[frozenset]) -> np.ndarray:
    """How many elements each of left has in common with each of right."""
    out, places = np.zeros((len(left), len(right)), np.int32), {}
    for i, held in enumerate(left):
        for x in held:
            places.setdefault(x, ([], []))[0].append(i)
    for j, held in enumerate(right):
        for x in held & places.keys():
            places[x][1].append(j)
    for i, j in places.values():
        if len(i) == len(left) and len(j) == len(right):
            out += 1
        elif j:
            out[np.ix_(i, j)] += 1
    return out


def _ranked(texts: list[list[str]]) -> tuple[list[str], list[np.ndarray]]:
    """(different texts; for the first, second and so on of each list its place among them, -1 where a list has no more)."""
    known: dict[str, int] = {}
    numbers = [[known.setdefault(x, len(known)) for x in held] for held in texts]
    deep = max(map(len, numbers), default=0)
    return list(known), [np.array([held[k] if k < len(held) else -1 for held in numbers], np.int64) for k in range(deep)]


def _best_table(left: list[list[str]], right: list[list[str]], wanted: np.ndarray) -> np.ndarray:
    """The best similarity of any name of each of left with any of each of right, at least where wanted; 0 where one has none."""
    out = np.zeros(wanted.shape)
    if wanted.sum() * 16 < wanted.size:
        a, b = np.nonzero(wanted)
        out[a, b] = best_batch([left[i] for i in a], [right[j] for j in b])
        return out
    (rows, of_left), (columns, of_right) = _ranked(left), _ranked(right)
    table = JaroTable(rows, columns).whole()
    if len(of_left) == len(of_right) == 1 and table.shape == out.shape and all((x[0] == np.arange(len(x[0]))).all() for x in (of_left, of_right)):
        return table
    table = np.pad(table, (0, 1))  # the last ones are for -1
    for i in of_left:
        for j in of_right:
            np.maximum(out, table[np.ix_(i, j)], out=out)
    return out


class _Members:
    """Members of a tile: ids, and as sets or lists what is compared."""

    def __init__(self, members: list[dict]):
        self.ids = [m["id"] for m in members]
        self.before, self.signature = ([frozenset(_hashable(m[k] or [])) for m in members] for k in ("before", "signature"))
        self.identifiers = [frozenset(_hashable(m["identifiers"] or [])) - {None} for m in members]
        self.names = [[(x or "").strip().lower() for x in m["names"] or ()] for m in members]

    def __getitem__(self, part: slice) -> _Members:
        out = object.__new__(_Members)
        out.__dict__ = {k: v[part] for k, v in self.__dict__.items()}
        return out


def _scored(x: _Members, y: _Members, fresh: np.ndarray, least: float, below: float) -> tuple[np.ndarray, ...]:
    """(positions in x, in y, name_similarity, exact_id_match, overlap, combined) of the fresh pairs with a combined score from least to under below."""
    if any(x.before) and any(y.before):
        fresh &= _common(x.before, y.before) == 0
    if set(x.ids) & set(y.ids):
        fresh &= _common([frozenset([i]) for i in x.ids], [frozenset([i]) for i in y.ids]) == 0
    if fresh.any():
        common = _common(x.signature, y.signature)
        whole = np.array([len(s) for s in x.signature])[:, None] + np.array([len(s) for s in y.signature]) - common
        overlap = np.divide(common, whole, out=np.zeros(common.shape), where=common > 0)
        exact = _common(x.identifiers, y.identifiers) > 0
        score = lambda name: combined_score(name, overlap, exact, np.where, np.minimum)
        if exact.any() or combined_score(1.0, overlap.min(), False, np.where, np.minimum) < least or combined_score(0.0, overlap.max(), False, np.where, np.minimum) >= below:
            fresh &= (score(1.0) >= least) & (score(0.0) < below)
    if not fresh.any():
        none = np.zeros(0, np.int64)
        return none, none, none.astype(float), none.astype(bool), none.astype(float), none.astype(float)
    name = _best_table(x.names, y.names, fresh)
    combined = score(name)
    kept = np.flatnonzero(fresh & (combined >= least) & (combined < below))
    return *np.divmod(kept, len(y.ids)), *(s.ravel()[kept] for s in (name, exact, overlap, combined))


def pairs(tiled: DataFrame, least: float, below: float) -> DataFrame:
    """(a, b, name_similarity, exact_id_match, overlap, combined) of the pairs of tiles with a combined score from least to under below.

    Strips of a tile, of SLICE pairs at most or one member with those of a piece, are scored as tables.
    """
    doubles = [T.StructField(n, T.BooleanType() if n == "exact_id_match" else T.DoubleType()) for n in ("name_similarity", "exact_id_match", "overlap", "combined")]
    schema = T.StructType([*(T.StructField(x, _id_type(tiled)) for x in "ab"), *doubles])

    def run(batches):
        for batch in batches:
            kind = batch.schema.field("x").type.value_type.field("id").type
            for k in range(batch.num_rows):
                x, y = (None if (held := batch.column(c)[k].as_py()) is None else _Members(held) for c in (0, 1))
                other = x if y is None else y
                step, ids = max(1, SLICE // max(1, len(other.ids))), pa.array(other.ids, kind)
                for start in range(0, len(x.ids), step):
                    part = x[start : start + step]
                    first = np.arange(start, start + len(part.ids))[:, None]
                    fresh = first < np.arange(len(other.ids)) if y is None else np.ones((len(part.ids), len(other.ids)), bool)
                    a, b, *scores = _scored(part, other, fresh, least, below)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(part.ids, kind).take(pa.array(a)), ids.take(pa.array(b)), *map(pa.array, scores)], names=schema.names)

    return tiled.mapInArrow(run, schema)
