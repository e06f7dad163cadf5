"""Sets that meet under a key are candidates by their whole fingerprints before they leave the join of keys."""

from kgspark.llm import near_dedup as N


def test_far_fingerprints_never_leave_the_join_of_keys(spark):
    names = "key long, n long, component long, " + ", ".join(f"{c} long" for c in N._WORDS)
    own = spark.createDataFrame([(1, n, n, 0, 0, -1 if n % 2 else 0, -1 if n % 2 else 0) for n in range(40)], names)
    pairs = N._meet(own, own).distinct()
    assert {(r["a"] - r["b"]) % 2 for r in pairs.collect()} == {0}
    assert pairs.count() == 2 * 20 * 19 // 2
    assert {(r["a"], r["b"]) for r in N._nearest_pivots(own.where("n < 2"), own).collect()} == {(n % 2, n) for n in range(2, 40)}
