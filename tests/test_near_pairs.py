"""Near-duplicate pairs: shingle sets are made for documents that are compared only."""

from kgspark.operators import near_duplicates as N
from kgspark.operators import near_index


def test_sets_are_written_for_compared_documents_only(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(60))) for i in range(200)]
    rows += [(300, " ".join(base)), (301, " ".join([*base, "end"])), (302, " ".join(base)), (303, None), (304, "...")]
    written, inner = {}, N.cut
    monkeypatch.setattr(N, "cut", lambda df, name="t": written.setdefault(name, inner(df, name)))
    pairs = N.near_duplicate_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["a"], r["b"], round(r["similarity"], 6)) for r in pairs.collect()) == [(300, 301, round(56 / 57, 6)), (300, 302, 1.0)]
    assert [name for name, df in written.items() if "grams" in df.columns] == ["grams"] and written["grams"].count() == 2


def test_an_index_writes_sets_to_its_files_only(spark, monkeypatch):
    written, inner = [], near_index.cut
    monkeypatch.setattr(near_index, "cut", lambda df, name="t": written.append((name, df.columns)) or inner(df, name))
    rows = [(i, " ".join(f"u{i // 2}x{j}" for j in range(40)) + " end" * (i % 2)) for i in range(10)]
    index = near_index.add_documents(near_index.new_near_index(spark, buckets=4), spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["id"]: r["cluster"] for r in near_index.clusters_in(index, spark).collect()} == {i: i // 2 * 2 for i in range(10)}
    assert {name for name, columns in written if "grams" in columns} == {"grams"}  # of compared sets
