"""Pairs of blocks scored where their members lie: as all pairs with their names are, and without a table of pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.operators import components, pair_tiles, resolution

SHAPE = "id string, name string, aliases array<string>, source_doc_id string, doc_source_type string, identifiers array<string>, domains array<string>, signature array<string>"


def _people(spark):
    draw = random.Random(8)
    rows = []
    for i in range(260):
        name = draw.choice(["ann ", "Ann ", "bo "]) + "".join(draw.choice("abcé𝄞") for _ in range(draw.randrange(9)))
        signature = [None, [], ["s", None], [draw.choice("stu")], [draw.choice("stu"), draw.choice("stuv"), "w"]][draw.randrange(5)]
        ids = [None, [], [None, "q"], [None], [f"x{draw.randrange(40)}"]][draw.randrange(5)]
        aliases = [None, [], [name], [name, None], [name, " AN " + name]][draw.randrange(5)]
        rows.append((f"e{draw.randrange(240):03d}", draw.choice([name, name, None]), aliases, draw.choice([None, f"d{i // 9}"]), draw.choice(["x", "y", None]), ids, draw.choice([None, ["m.co"], ["m.co", "n.co"]]), signature))
    return spark.createDataFrame(rows, SHAPE)


@pytest.mark.parametrize(("max_block", "across", "piece"), [(30, False, 1000), (30, True, 1000), (30, True, 60), (10**6, False, 25), (10**6, False, 1000), (50, True, 40)])
def test_scores_are_those_of_all_pairs_with_their_names(spark, monkeypatch, max_block, across, piece):
    monkeypatch.setattr(resolution, "PIECE", piece)
    monkeypatch.setattr(pair_tiles, "SLICE", 700)
    people = _people(spark)
    scored = resolution.score_pairs(people, resolution.candidate_pairs(people, max_block, across)).collect()
    got, waiting = resolution.resolve_entities(people, max_block=max_block, across=across)
    fields = ("a", "b", "name_similarity", "exact_id_match", "overlap", "combined")
    want = sorted(tuple(r[f] for f in fields) for r in scored if 0.6 <= r["combined"] < 0.85)
    assert sorted(tuple(r[f] for f in fields) for r in waiting.collect()) == want and want
    linked = spark.createDataFrame([r for r in scored if r["combined"] >= 0.85], "a string, b string, name_similarity double, exact_id_match boolean, overlap double, combined double")
    merges = sorted(map(tuple, resolution.merges_of_scored(people, linked).collect()))
    assert sorted(map(tuple, got.collect())) == merges and merges


def test_merges_write_no_table_of_pairs(spark, monkeypatch):
    """400 entities in four chunks have 19,800 pairs that all merge; nothing written has more rows than a few for each entity."""
    written, plain = [], resolution.cut

    def counted(df, *args, **kwargs):
        out = plain(df, *args, **kwargs)
        written.append(out.count())
        return out

    for module in (resolution, components, pair_tiles):
        monkeypatch.setattr(module, "cut", counted)
    people = spark.range(400).select("id", F.concat(F.lit("ann lee "), F.col("id") % 3).alias("name"), F.lit("").alias("source_doc_id"), F.lit("x").alias("doc_source_type"), F.array(F.lit("s")).alias("signature"), F.array().cast("array<string>").alias("identifiers"))
    merges, _ = resolution.resolve_entities(people)
    assert sorted(map(tuple, merges.collect())) == [(i, i // 100 * 100) for i in range(400) if i % 100]
    assert max(written) <= 800


def test_heads_of_links():
    draw = np.random.default_rng(3)
    for n, m in ((1, 0), (50, 20), (300, 260), (300, 2000)):
        a, b = draw.integers(0, n, (2, m))
        want = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                want[x] = want[y] = min(want[x], want[y])
        assert pair_tiles.heads(a, b, n).tolist() == want
    chain = np.arange(5000)
    assert not pair_tiles.heads(chain[:-1], chain[1:], 5000).any()
