"""Names over few letters: blocks are compared in tiles, without pairs that can't be near, to the pairs of plain comparison."""

import hashlib
import random
from itertools import combinations

from kgspark.functions.similarity import jaro_winkler_batch
from kgspark.operators import resolution, resolution_index
from kgspark.operators.name_search import near_in_tile

SHAPE = "id long, name string, source_doc_id string, doc_source_type string, identifiers array<string>, signature array<string>"


def test_a_tile_has_the_pairs_of_plain_comparison():
    draw = random.Random(2)
    names = ["", "a", "ab", "ä𝄞", "x" * 300, "x" * 299 + "y", "ann " + "0" * 40] + ["".join(draw.choice("abcé𝄞") for _ in range(draw.randrange(12))) for _ in range(150)]
    for threshold in (0.75, 0.92, 1.0):
        pairs = list(combinations(range(len(names)), 2))
        scores = jaro_winkler_batch([names[i] for i, _ in pairs], [names[j] for _, j in pairs])
        want = {p for p, s in zip(pairs, scores, strict=True) if s >= threshold - 1e-9}
        assert {(int(i), int(j)) for a, b in near_in_tile(names, names, threshold, True) for i, j in zip(a, b, strict=True)} == want
        both = {(int(i), int(j)) for a, b in near_in_tile(names[:90], names[90:], threshold) for i, j in zip(a, b, strict=True)}
        assert both == {(i, j - 90) for i, j in want if i < 90 <= j}


def test_names_of_hexadecimal_digits_meet_few(spark, monkeypatch):
    monkeypatch.setattr(resolution, "PIECE", 90)  # several pieces and tiles
    draw = random.Random(4)
    rows = []
    for i in range(400):
        name = "ann " + hashlib.md5(str(i // 2).encode()).hexdigest()
        rows.append((i, name[: draw.randrange(30, 37)], None, "x", ["one"] * (i % 90 == 0), ["s"] * (i % 7 == 0) + [f"t{i // 9}"] * (i % 5 == 0)))
    people = spark.createDataFrame(rows, SHAPE)
    pairs = [tuple(r) for r in resolution_index.exact_pairs(people).collect()]
    assert len(pairs) == len(set(pairs)) < 0.1 * 400 * 399 / 2  # 72,325 pairs share a key of names
    merges, pending = resolution_index.resolve_all(people)
    want, waiting = resolution.resolve_entities(people, max_block=10**6)
    assert sorted(map(tuple, merges.collect())) == sorted(map(tuple, want.collect()))
    scores = lambda df: sorted((r["a"], r["b"], round(r["combined"], 9)) for r in df.collect())
    assert scores(pending) == scores(waiting) and pending.columns == waiting.columns
