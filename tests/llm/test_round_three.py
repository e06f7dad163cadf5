"""Clusters, fill-in-middle and token files against brute force."""

import hashlib
import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kgspark.llm import fill_in_middle as M
from kgspark.llm import token_files as K
from kgspark.llm import vantage_clusters as V
from kgspark.llm.queries import QUERIES, vocabulary
from kgspark.shared import shared_dir, table

SF = "/root/testdata/sf0.001"
BYTES = "byte_bpe_50k.json"
TEXTS = [
    None, "", " ", "a", "é", "😀", "\n\n", "line one\nline two\nrest", "x" * 30_000, "é€😀" * 5000, "has <P> inside", "<S><M>", "<M", "P><", "<<P",
    "tail <", "same", "same", "a  b   c \n d\n\n e \t", "　 wide　 a\xa0 b   c", "it's <|endoftext|> end 'll՘'ll", "é İẞ", "\x00 nul \x00",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null id, a repeated row, and columns with names of the operators' own."""
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)] + [(None, "same", "y", 1, 2), (6, "\n\n", "x", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n int, h1 int")


def brute_fim(key, text):
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, odd):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    more = table(spark, SF, "documents").select("doc_id", "text")
    many = more.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"), "text").select((F.col("doc_id") + 1000 * F.col("i")).alias("doc_id"), "text")
    for df in (odd, many):
        rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        got = [tuple(r) for r in M.fim_report(df).collect()]
        want = [(k, *brute_fim(k, t)[:4], sha(brute_fim(k, t)[4]), sha(t)) for k, t in rows]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    made = M.fill_in_middle(odd)
    assert made.columns == [*odd.columns, "n_", "form", "prefix_units", "middle_units", "output"] and made.count() == odd.count()
    assert {r["form"] for r in M.fim_report(many).collect()} == {"plain", "psm", "spm"}
    assert M.fim_report(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.fill_in_middle(odd, sentinels=("<P>", "<P", "<M>"))
    assert QUERIES["op12_fill_in_middle"](spark, SF).count() == more.count()


def test_lines_are_units(spark):
    rows = [(i, t) for i, t in enumerate(["", "one", "one\n", "one\ntwo", "\n\n\n", "a\nbb\nccc\n" * 50])] * 3
    rows = [(100 * j + i, t) for j, (i, t) in enumerate(rows)]
    made = M.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit="line", plain=0)
    text = dict(rows)
    seen = 0
    for r in made.withColumn("back", M.restore(F.col("output"), F.col("form"))).collect():
        lines = text[r["doc_id"]].splitlines(keepends=True)
        assert r["back"] == text[r["doc_id"]] and r["n"] == len(lines)
        if r["form"] != "plain":
            seen += 1
            a, b = r["prefix_units"], r["prefix_units"] + r["middle_units"]
            assert r["output"].endswith("<M>" + "".join(lines[a:b])) and "<P>" + "".join(lines[:a]) in r["output"]
    assert seen > 10


def test_rank_and_select_on_random_bytes():
    draw = random.Random(3)
    texts = ["".join(draw.choice("aé€😀\n") for _ in range(draw.randrange(40))) for _ in range(300)]
    whole = pa.array(["left out", *texts, None], pa.string()).slice(1)
    index = M.UnitIndex(whole)
    assert index.counts().tolist() == [len(t) for t in texts] + [0]
    for _ in range(20):
        units = np.array([draw.randint(0, len(t)) for t in texts] + [0])
        got = index.cut(units) - index.offsets[:-1]
        assert got.tolist() == [len(t[:u].encode()) for t, u in zip([*texts, ""], units.tolist(), strict=True)]


def brute_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = {}
    for _, j, d in found:
        sums[j] = sums.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, sums[j], sum(sums.values()), digest[j]) for i, j, d in found]


def test_clusters(spark):
    base = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    v = base[0][1]
    odd = [(1000, None), (1001, []), (1002, v[:63]), (1003, [*v, 0.0]), (1004, [*v[:63], None]), (1005, [*v[:63], float("nan")]), (1006, [*v[:63], float("-inf")]), (None, v), (base[0][0], v), base[1]]
    coarse = [(i, [float(round(x * 3)) / 16 for x in w]) for i, w in base]  # many ties
    wide = [(i, [x * 30_000 for x in w]) for i, w in base[:60]]
    huge = [(i, [x * 1_000_000 for x in w]) for i, w in base[:60]]  # beyond exact doubles
    for rows in (base + odd, coarse, wide, huge, base[:5], [(1, v)] * 40, odd[:7], []):
        df = spark.createDataFrame([(i, w, 1, "x") for i, w in rows], "vec_id long, embedding array<double>, cluster int, id string")
        got = [tuple(r) for r in V.cluster_report(df).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute_clusters(rows)))
    with pytest.raises(Exception, match="fit 64 bits"):
        V.cluster_report(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


def test_vantage_tree():
    draw = np.random.default_rng(5)
    for k, dims, spread in ((1, 4, 9), (2, 4, 2), (300, 3, 40), (300, 3, 3), (500, 16, 8)):
        points, rows = draw.integers(-spread, spread, (k, dims)), draw.integers(-spread, spread, (700, dims))
        away = ((rows[:, None, :] - points[None]) ** 2).sum(axis=2)
        for leaf in (2, 8):
            tree = V.VantageTree.build(points, leaf)
            number, best = tree.nearest(rows)
            assert (number == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()
    assert len(tree.members) > 50


def brute_ids(texts):
    own = Tokenizer.from_file(vocabulary(BYTES))
    return [[*e.ids, 2] for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_chunks_have_the_ids_of_texts():
    draw = random.Random(7)
    bits = [*" \n\t\r\x85\xa0 　'éßa1.,-_", "  ", "word", "don't", " the", "<|endoftext|>", "<|end", "՘", "😀", "नमस्ते", "\x1c", "\x00"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(40))) for _ in range(4000)]
    own = K.ChunkTokenizer(vocabulary(BYTES))
    for _ in range(2):  # the second time from the memo
        flat, starts = own.flat(pa.array(texts, pa.string()))
        got = [flat[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        assert got == [ids[:-1] for ids in brute_ids(texts)]


def test_token_files(spark, odd):
    docs = table(spark, SF, "documents")
    for df in (odd, docs, docs.union(docs.limit(20)), docs.withColumn("doc_id", F.lit(3).cast("long"))):
        rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["text"] or "") for r in df.collect())
        ids = brute_ids([t for _, t in rows])
        crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
        got = sorted(K.token_file_report(df, vocabulary(BYTES)).collect(), key=lambda r: r["start"])
        assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == [k for k, _ in rows]
        ends = np.cumsum([r["n_tokens"] for r in got])
        assert [r["start"] for r in got] == [0, *ends[:-1].tolist()]
        assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((repr(k[1] if k[0] else None), len(x), c) for (k, _), x, c in zip(rows, ids, crc, strict=True))
    assert K.token_file_report(odd.limit(0), vocabulary(BYTES)).count() == 0


def test_layout_and_selective_reads(spark):
    docs = table(spark, SF, "documents")
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    K.write_token_ids(docs, path, vocabulary(BYTES), row_group=1 << 16, page_rows=8)
    files = sorted(spark.read.parquet(f"{path}/ids").inputFiles())
    groups = 0
    for f in files:
        about = pq.ParquetFile(f.removeprefix("file://")).metadata
        groups += about.num_row_groups
        for g in range(about.num_row_groups):
            columns = {about.row_group(g).column(i).path_in_schema: about.row_group(g).column(i) for i in range(about.num_columns)}
            assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
            assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("id", "place", "n_tokens"))
            assert all(c.has_offset_index for c in columns.values()) and columns["id"].has_column_index
    assert groups > len(files)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    ids = brute_ids([t for _, t in rows])
    some = K.read_token_ids(spark, path, F.col("id").between(17, 19))
    assert [r["ids"] for r in some.orderBy("id").collect()] == [x for (k, _), x in zip(rows, ids, strict=True) if 17 <= k <= 19]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,17)" in plan
    about = K.read_token_ids(spark, path, columns=("id", "n_tokens"))
    assert "ids" not in about._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    flat = [x for own in ids for x in own]
    for a, b in ((0, 5), (700, 9000), (len(flat) - 3, len(flat) + 9), (len(flat) + 1, len(flat) + 2)):
        span = K.read_span(spark, path, a, b).orderBy("offset").collect()
        assert [x for r in span for x in r["ids"]] == flat[a:b]
