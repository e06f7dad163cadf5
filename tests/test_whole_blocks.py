"""Resolution over whole blocks: no chunk, no stricter key and no cap parts two entities of a block."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.functions.similarity import JaroTable, jaro_winkler_batch
from kgspark.operators import pair_tiles, resolution, resolution_index
from kgspark.plans import catalog

SHAPE = "id string, name string, aliases array<string>, source_doc_id string, doc_source_type string, identifiers array<string>, domains array<string>, signature array<string>"


def _people(spark, n=150):
    draw = random.Random(11)
    rows = []
    for i in range(n):
        name = draw.choice(["ann ", "Ann ", "bo "]) + "".join(draw.choice("abé𝄞") for _ in range(draw.randrange(4)))
        signature = [None, [], ["s", None], [draw.choice("stu")], [draw.choice("stu"), "w"]][draw.randrange(5)]
        ids = [None, [], [None, "q"], [None], [f"x{draw.randrange(40)}"]][draw.randrange(5)]
        aliases = [None, [], [name], [name, None], [name, " AN " + name]][draw.randrange(5)]
        rows.append((f"e{i:03d}", draw.choice([name, name, None]), aliases, draw.choice([None, f"d{i // 9}"]), draw.choice(["x", "y", None]), ids, draw.choice([None, ["m.co"]]), signature))
    return spark.createDataFrame(rows, SHAPE)


def test_the_query_merges_whole_blocks(spark, tmp_path):
    """230 and 110 parts of one name and two types: chunks of 100 left five clusters where there are two."""
    parts = spark.range(340).select(F.col("id").alias("p_partkey"), F.lit("red nut").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.when(F.col("id") < 230, "LARGE").otherwise("SMALL").alias("p_type"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    merges = sorted(map(tuple, catalog.p03_entity_resolution(spark, str(tmp_path)).collect()))
    assert merges == [(i, 0 if i < 230 else 230) for i in range(340) if i not in (0, 230)]


@pytest.mark.parametrize(("auto", "piece"), [(0.85, 7), (0.62, 1000)])
def test_merges_are_those_of_all_pairs(spark, monkeypatch, auto, piece):
    monkeypatch.setattr(resolution, "PIECE", piece)
    people = _people(spark)
    want, _ = resolution.resolve_entities(people, auto=auto, max_block=10**6)
    merges = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, resolution_index.merge_blocks(people, auto=auto).collect())) == merges and merges


def test_merges_by_facts(spark):
    people, draw = _people(spark).drop("signature"), random.Random(12)
    seen = [(f"e{draw.randrange(150):03d}", draw.choice(["p", "q", None, ""]), draw.choice([None, "", "d1", "d2"])) for _ in range(260)]
    facts = spark.createDataFrame(seen, "subject_id string, predicate string, source_doc_id string")
    want, _ = resolution.resolve_entities(people, facts=facts, max_block=10**6)
    merges = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, resolution_index.merge_blocks(people, facts).collect())) == merges and merges


@pytest.mark.parametrize("facts", [False, True])
def test_pending_pairs_are_scored_in_their_tiles(spark, monkeypatch, facts):
    """1,770 pairs share evidence: no table that is written has a row for each of them, and the scores are those of all pairs."""
    written, plain = [], resolution.cut

    def counted(df, *args, **kwargs):
        out = plain(df, *args, **kwargs)
        written.append(out.count())
        return out

    for module in (resolution, resolution_index, pair_tiles):
        monkeypatch.setattr(module, "cut", counted)
    monkeypatch.setattr(resolution, "PIECE", 25)
    rows = [(f"e{i:03d}", "ann " + hashlib.md5(str(i).encode()).hexdigest()[: 9 + i % 4], None, None, "x", ["one"] * (i % 20 == 0), None, ["s", f"t{i // 3}"]) for i in range(60)]
    people = spark.createDataFrame(rows, SHAPE)
    seen = spark.createDataFrame([(r[0], p, "") for r in rows for p in r[7]], "subject_id string, predicate string, source_doc_id string") if facts else None
    got = resolution_index.pending_blocks(people.drop("aliases", "signature") if facts else people.drop("aliases"), seen)
    assert max(written) < 700
    _, want = resolution.resolve_entities(people.drop("aliases"), max_block=10**6)
    pairs = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, got.collect())) == pairs and len(pairs) > 700 and got.columns == want.columns


def test_tables_of_names_have_the_similarities_of_plain_comparison():
    draw = random.Random(6)
    for start, most in (("", 12), ("ann ", 28), ("ann ", 36), ("x", 70)):  # words of 32 and 64 bits, and longer texts
        names = ["", " A b ", None, *[start + "".join(draw.choice("abc01é𝄞") for _ in range(draw.randrange(most))) for _ in range(60)]]
        names = names if not start else names[3:]
        table = JaroTable(names, names[::-1])
        plain = np.array([jaro_winkler_batch([x] * len(names), names[::-1]) for x in names])
        assert np.array_equal(table.whole(), plain)
        i, j = (c.ravel() for c in np.indices(plain.shape))
        assert np.array_equal(table.of_pairs(i, j), plain.ravel())
        some = table.of_pairs(i, j, 0.9)
        assert np.array_equal(some >= 0.9, plain.ravel() >= 0.9) and set(some) <= {0.0, *plain.ravel()}
