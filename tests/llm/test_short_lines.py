"""Classes of lines of every length, hot segments included, and the whole report, against brute force."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kgspark.llm import line_dedup
from kgspark.operators.components import connected_components
from kgspark.shared import table


def distance(a, b, most=2):
    """Edit distance, or most + 1 if it is more."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        if min(new) > most:
            return most + 1
        row = new
    return min(row[-1], most + 1)


def classes_of(lines):
    """The smallest position of each line's class, by all pairs."""
    up = list(range(len(lines)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in combinations(enumerate(lines), 2):
        if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
            x, y = find(i), find(j)
            up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(lines))]


def words(rnd, n):
    return " ".join("".join(rnd.choices("abcdeé", k=rnd.randint(1, 9))) for _ in range(n))


def changed(rnd, line, n):
    x = list(line)
    for _ in range(n):
        at = rnd.randrange(len(x) + 1)
        x[at : at + rnd.randint(0, 1)] = rnd.choices("xyzé", k=rnd.randint(0, 1))
    return "".join(x).strip()


@pytest.mark.parametrize("hot_key", [64, 2])
def test_lines_of_all_lengths_have_their_class(spark, hot_key):
    rnd = random.Random(9)
    lines = {"".join(rnd.choices("abcdeé", k=rnd.randint(1, 14))) for _ in range(200)} | {"a", "b", "é", "ab", "Item 1", "Item 23", "INFO", "WARN"}
    for base in [words(rnd, 12) for _ in range(6)]:  # groups of near copies, some farther than two edits from each other
        lines |= {changed(rnd, base, rnd.randint(0, 6)) for _ in range(25)}
    lines |= {f"a line of one template, number {rnd.randrange(10**6)}, and its end" for _ in range(80)}
    lines = sorted(lines - {""})
    df = spark.createDataFrame(list(enumerate(lines)), "n long, line string")
    links = line_dedup.edit_links(df, hot_key=hot_key)
    pairs = [tuple(r) for r in links.collect()]
    assert pairs and all(distance(lines[a], lines[b]) <= 2 for a, b in pairs)
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert [got.get(i, i) for i in range(len(lines))] == classes_of(lines)


def test_report_of_whole_tables(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    odd = spark.createDataFrame(
        [(1, "Item 1\nno", "x"), (2, "Item 2\nquite another line\r\n \n", "x"), (3, "x", "x"), (3, "x", "y"), (3, "other text of the same id", "z"), (4, None, ""), (5, "", ""), (None, "Item 3", ""), (6, "y" * 200_000, "")],
        "doc_id long, text string, h1 string",
    )
    for df in (docs, odd, odd.where("doc_id > 99")):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        cut = [(i, t, [(at, x) for at, line in enumerate((t or "").split("\n")) if (x := line.strip(line_dedup.BLANKS))]) for i, t in rows]
        lines = sorted({x for _, _, xs in cut for _, x in xs})
        short = [x for x in lines if len(x) < 50_000]
        own = dict(zip(short, classes_of(short), strict=True))
        hashes = {(r["doc_id"], r["text"]): r["h"] for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
        first = {}
        for i, t, xs in cut:
            for at, x in xs:
                key, place = own.get(x, x), ((i is not None, i or 0), hashes[i, t], at)
                first[key] = min(first.get(key, place), place)
        want = defaultdict(list)
        for i, t, xs in cut:
            keys = [own.get(x, x) for _, x in xs]
            kept = [(at, x) for (at, x), key in zip(xs, keys, strict=True) if first[key] == ((i is not None, i or 0), hashes[i, t], at)]
            want[i, len(xs), len(kept), len(set(keys)), tuple(at for at, _ in kept)].append([x for _, x in kept])
        got = defaultdict(list)
        for r in line_dedup.dedup_lines(df).collect():
            got[r["id"], r["n_lines"], r["n_kept"], len(set(r["classes"])), tuple(r["places"])].append(r["kept"])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
        assert line_dedup.line_report(df).count() == len(rows)
