"""Lines that share a segment and are unlike make no rows: only true links leave the joins that compare them."""

import random

from kgspark.llm import line_dedup as L


def test_unlike_lines_of_one_segment_make_few_rows(spark, monkeypatch):
    rnd = random.Random(5)
    start = "the same beginning of every line, "
    lines = [start + "".join(rnd.choices("abcdefghij", k=2 * len(start))) for _ in range(30)]
    rows, inner = {}, L.cut

    def cut(df, name="t", **more):
        out = inner(df, name, **more)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(L, "cut", cut)
    df = spark.createDataFrame(list(enumerate(lines)), "n long, line string")
    assert L.segment_links(df).count() == 0
    assert max(rows.values()) < 5 * len(lines), rows  # pairs would be 30 * 29


def test_dense_groups_of_one_segment_are_settled_by_pivots(spark):
    start = "the same beginning of every line, "
    lines = [start + x * len(start) + f"{i:02d}" + y * len(start) for x, y in ("ab", "cd", "ef") for i in range(60)]
    df = spark.createDataFrame(list(enumerate(lines)), "n long, line string")
    links = L.segment_links(df)
    got = {r["node"]: r["component"] for r in L.connected_components(links).collect()}
    assert [got[i] for i in range(180)] == [i // 60 * 60 for i in range(180)]
    assert links.count() < 10 * len(lines)  # pairs within groups are 3 * 60 * 59 / 2
