"""Suffix statistics of the URL filter: all suffixes have them, however many there are."""

import random
from collections import Counter, defaultdict
from math import log1p

import pytest

from kgspark.llm import url_filter
from kgspark.shared import table


def test_every_suffix_has_statistics_without_its_own_label(spark):
    rnd = random.Random(2)
    rows = [(f"site{i}.com", rnd.choice(("block", "allow", None))) for i in range(1500) for _ in range(1 + i % 2)] + [("big.org", "allow")] * 400 + [("", None)] * 3
    rows = [(s, v, rnd.randrange(url_filter.FOLDS)) for s, v in rows]
    n = Counter(s for s, _, _ in rows)
    urls = spark.createDataFrame(rows, "suffix string, verdict string, fold int")
    by = defaultdict(list)
    for s, v, fold in rows:
        if v is not None and fold:
            by[s].append((v, fold))
    for suffixes in (url_filter.SUFFIXES, 10, 1_000_000):
        got = url_filter.with_suffix_statistics(urls, suffixes).collect()
        assert Counter((r["suffix"], r["verdict"], r["fold"]) for r in got) == Counter(rows)
        for r in got:
            seen = [v for v, fold in by[r["suffix"]] if r["verdict"] is None or fold != r["fold"]]
            assert r["suffix_share"] == pytest.approx(log1p(n[r["suffix"]] / len(rows) * 1000))
            assert r["suffix_blocked"] == pytest.approx((seen.count("block") + 1) / (len(seen) + 2))


def test_held_out_accuracy(spark):
    """The trees' verdicts on rule-labelled URLs that neither they nor the statistics have learned from."""
    got = url_filter.url_report(table(spark, "/root/testdata/sf0.1", "pages")).where("held_out and rule is not null").collect()
    hits = [(r["probability"] >= 0.5) == (r["verdict"] == "block") for r in got]
    print(f"held-out accuracy {sum(hits) / len(hits):.4f} on {len(hits)}")
    assert len(hits) > 50 and sum(hits) / len(hits) > 0.95
