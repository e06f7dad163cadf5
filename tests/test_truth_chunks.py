"""Rounds over claims of few and of many sources, in chunks, give the values of the join by source."""

import pytest
from pyspark.sql import functions as F

from kgspark.operators import conflicts


@pytest.mark.parametrize("chunk", [2, 64])
def test_rounds_by_chunks_are_those_by_joins(spark, monkeypatch, chunk):
    rows = [(f"c{i % 5}", f"s{i * i % 23}") for i in range(200)] + [("hot", f"s{i}") for i in range(23)] + [(None, "s1"), ("c1", None)]
    claims = spark.createDataFrame(rows, "claim string, source string").groupBy("claim", "source").agg(F.count("*").alias("n"))
    got, gathered, inner = {}, [], conflicts.cut
    monkeypatch.setattr(conflicts, "CHUNK", chunk)
    monkeypatch.setattr(conflicts, "cut", lambda df, name="t": (gathered.append(name), inner(df, name))[1])
    for few in (0, 100_000):
        monkeypatch.setattr(conflicts, "FEW_SOURCES", few)
        got[few] = {(r["round"], r["source"]): r["reliability"] for r in conflicts.truth_rounds(claims, rounds=3, delta=0.0).collect()}
    assert len(got[0]) == 4 * 23 and got[100_000] == {k: pytest.approx(x) for k, x in got[0].items()}
    assert gathered.count("chunks") == 1
