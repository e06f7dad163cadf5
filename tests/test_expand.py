"""Expansion reads the neighbours of its frontier only."""

import random

import pytest

from kgspark.operators import graph


@pytest.mark.parametrize("held", [10**6, 0])
def test_only_the_frontier_has_neighbours(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "HELD_NODES", held)
    draw = random.Random(6)
    pairs = [(draw.randrange(200), draw.randrange(200)) for _ in range(500)] + [(3, 3)]
    tables, inner = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name="t": tables.append((name, inner(df, name))) or tables[-1][1])
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = {tuple(r) for r in graph.expand(spark.createDataFrame([(1, 3), (1, 5), (2, 7)], "question_id long, node long"), edges, limit=4).collect()}
    around = {x: sorted({b for a, b in pairs + [(b, a) for a, b in pairs] if a == x != b})[:4] for x in range(200)}
    seen = {(1, 3): 0, (1, 5): 0, (2, 7): 0}
    for hop in (1, 2):
        for (q, x), h in list(seen.items()):
            for y in around[x] if h == hop - 1 else ():
                seen.setdefault((q, y), hop)
    assert got == {(q, x, h) for (q, x), h in seen.items()}
    assert {r["src"] for r in next(df for name, df in tables if name == "near").select("src").distinct().collect()} <= {3, 5, 7}
