"""The training-data operators against brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kgspark.llm import decontaminate as D
from kgspark.llm import ngram_lm, packing, simhash, token_counts, toxicity, url_filter
from kgspark.llm.exact_dedup import exact_dedup, exact_groups, split_directory
from kgspark.llm.licenses import BASE, parse_expression, postfix_of, scan_licenses
from kgspark.shared import table

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n ", "Same text", "SAME text", "a b c", "same text", "É words, more.\n\nlines", "x" * 9000, "The MIT License and CC BY-NC 4.0"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with the operators' own names."""
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "Same text", "x", 1), (6, "same text", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, score int")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def collect(df):
    return [r.asDict() for r in df.collect()]


def test_exact(spark, odd, docs):
    for df in (odd, docs):
        groups = defaultdict(list)
        for r in df.collect():
            groups["".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")].append(-1 if r["doc_id"] is None else r["doc_id"])
        want = sorted((i, max(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
        # whole, then with hashes of two bits, so that different texts are chained, small buckets, and tasks that forget early
        for more in ({}, {"hash_bits": 2, "bucket_rows": 20, "bucket_bytes": 2000, "held_bytes": 300}):
            got = collect(exact_groups(df, **more))
            assert sorted((-1 if r["id"] is None else r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
            assert sum(r["kept"] for r in got) == len(groups) and len({r["bucket"] for r in got}) > 1
        assert exact_dedup(df).count() == len(groups) and exact_dedup(df).columns == df.columns
    assert exact_groups(odd.limit(0)).count() == 0
    clashing = odd.withColumnRenamed("id", "sha").withColumnRenamed("score", "own")
    assert exact_dedup(clashing).columns == clashing.columns and {r["sha"] for r in exact_dedup(clashing).collect()} == {"x"}
    depth, directory = split_directory(Counter({i: 10 for i in range(16)}), 4, 25)
    assert depth == 3 and len(set(directory)) == 8


def test_simhash(spark, odd, docs):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << x for x in rnd.sample(range(64), rnd.choice((0, 1, 2, 3)))) for b in base for _ in range(12)} | {0, 1, 3, 7}
    fps |= {base[0] ^ 1 << a ^ 1 << b for a, b in combinations(range(16), 2)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(signed, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for hot in (64, 4):
        edges = simhash.link_fingerprints(df, hot_key=hot)
        found = {r["node"]: r["component"] for r in simhash.connected_components(edges).collect()}
        assert {x: found.get(x, x) for x in signed} == {x: find(x) for x in signed}
    text = "one two two three four"
    words = text.split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert simhash.fingerprint(text.upper().encode()) % (1 << 64) == want
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(odd.limit(0)).count() == 0


def test_packing(spark, odd, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for df, capacity in ((odd, 64), (docs, 2048)):
        got = collect(packing.pack(df, path, capacity))
        want = []
        for r in df.collect():
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
            for k in range(0, len(ids), capacity):
                part = ids[k : k + capacity]
                want.append((str(r["doc_id"]), k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        assert sorted((str(r["id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
        sequences = defaultdict(list)
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        least = -(-sum(r["length"] for r in got) // capacity)
        assert len(sequences) <= least * 1.02 + 1
    assert packing.pack(odd.limit(0), path).count() == 0


def hits_of(text, items, width=10):
    """Places and items by every window at every place."""
    words, hit, ids = (text or "").encode().translate(D.ALNUM).split(), set(), set()
    for item, own in items:
        own = (own or "").encode().translate(D.ALNUM).split()
        for x in range(max(1, len(own) - width + 1) if own else 0):
            w = own[x : x + width]
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    ids.add(str(item))
    return len(words), len(hit), len(ids), D.items_digest(ids)


def test_decontamination(spark, odd):
    rnd = random.Random(4)
    draw = lambda n: " ".join(rnd.choices("abc", k=n))
    items = [(1, "the mit license"), (2, "b c"), (3, None), (4, "one two three four five six seven eight nine ten eleven"), (5, "words more"), (6, "")]
    items += [(10 + i, draw(rnd.randint(1, 40))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["0 two three four FIVE six-seven eight nine ten eleven 12", *[draw(rnd.randint(0, 300)) for _ in range(40)], items[30][1] * 3]
    both = odd.union(spark.createDataFrame([(50 + i, t, "x", 1) for i, t in enumerate(texts)], odd.schema))
    want = {(str(r["doc_id"]), r["text"]): hits_of(r["text"], items) for r in both.collect()}
    for block in (1 << 18, 100):
        found = D.find_contamination(both, bench, block_bytes=block)
        got = {(str(r["doc_id"]), r["text"]): (r["n_words"], sum(b - a for a, b in r["spans"]), len(r["items"]), D.items_digest(r["items"])) for r in found.collect()}
        assert got == want
    assert want["50", texts[0]][1] == 10
    a, b = D.byte_offsets("É words, more.", (1, 3))
    assert "É words, more.".encode()[a:b] == b"words, more"
    clashing = both.withColumnRenamed("id", "spans").withColumnRenamed("score", "N_words")
    kept = D.decontaminate(clashing, bench)
    assert kept.columns == clashing.columns and Counter(str(r["doc_id"]) for r in kept.collect()) == Counter(str(r["doc_id"]) for r in both.collect() if not want[str(r["doc_id"]), r["text"]][1])
    assert D.decontaminate(both, bench.limit(0)).count() == both.count() and D.decontaminate(both.limit(0), bench).count() == 0


def test_a_large_benchmark_is_one_automaton(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choices(words, k=400))) for i in range(1000)]
    assert len(list(D.blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", D.BLOCK_BYTES))) == 1
    index = D.Index([(str(i), t) for i, t in items], 10)
    for item, text in rnd.sample(items, 20):
        own = text.split()
        at = rnd.randrange(380)
        assert index.scan(" ".join(["x", *own[at : at + 13], "y"]).encode()) == (15, [(1, 14, str(item))])
        assert index.scan(" ".join(["x", *own[at : at + 9], "y"]).encode()) == (11, [])


def test_licenses(odd):
    assert parse_expression("MIT OR (Apache-2.0 AND BSD-3-Clause) rest") == (["mit", "apache-2.0", "bsd-3-clause"], "mit OR (apache-2.0 AND bsd-3-clause)")
    assert parse_expression("GPL-2.0 WITH Classpath-exception-2.0 AND MIT")[0] == ["gpl-2.0 with classpath-exception-2.0", "mit"]
    assert postfix_of("A or b AND c with D")[0] == ["a", "b", "c", "d", "with", "and", "or"]
    for wrong in ("MIT OR", "(MIT", "", "AND MIT", "(a or b) with c", "mit or )"):
        assert parse_expression(wrong) is None
    assert parse_expression("MIT) or b")[0] == ["mit"] and parse_expression("MIT, b")[0] == ["mit"]
    many = [f"licenseref-number-{i}" for i in range(5000)]
    assert parse_expression(" OR ".join(many))[0] == many
    assert len(parse_expression(" AND ".join(f"(a{i} OR b{i})" for i in range(2000)))[0]) == 4000
    got = {r["doc_id"]: r for r in collect(scan_licenses(odd)) if r["doc_id"] is not None}
    assert got[9]["base_labels"] == "cc-by,mit" and (got[9]["n_base"], got[9]["first_word"], got[9]["last_word"]) == (2, 1, 4)
    assert "cc-by-nc-4.0" in got[9]["labels"] and got[0]["n_words"] == 0 and got[0]["labels"] == "" and got[8]["score"] == 0
    clash = scan_licenses(odd, keep=("doc_id", "score"))
    assert clash.columns[1] == "score" and "score_" in clash.columns and clash.count() == odd.count() and scan_licenses(odd.limit(0)).count() == 0


def test_base_places_of_whole_tables(spark, odd, docs):
    for df in (odd, docs):
        for r in scan_licenses(df.select("doc_id", "text"), keep=("doc_id", "text")).collect():
            words = (r["text"] or "").encode().translate(D.ALNUM).split()
            places = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
            at = [i for i, _ in places]
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(at, default=None), max(at, default=None))
            assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
            assert 0 <= r["score"] <= 1


def test_token_counts(odd, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for df in (odd, docs):
        got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.count_tokens(df.select("doc_id", "text"), path).collect())
        assert got == sorted((str(r["doc_id"]), len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in df.collect())
    own, rnd = token_counts.TokenCounter(path), random.Random(1)
    alphabet = [*" \n\t\xa0\x1c\x85ab'sdrevl1299é漢字!.", "<|endoftext|>", "  ", "the", " of", "🎉", "́"]
    for _ in range(1500):
        text = "".join(rnd.choices(alphabet, k=rnd.randint(0, 40)))
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (own.count(text), own.count(text, rnd.randint(1, 9))) == (n, n)


def test_language_model(spark, odd, docs):
    sentence = lambda t: ["<s>", *(t or "").encode().translate(ngram_lm.LOWER).split(), "</s>"]
    train = [sentence(r["text"]) for r in docs.where(ngram_lm.fold(F.col("doc_id")) != 1).collect()]
    pairs = Counter(p for s in train for p in zip(s, s[1:], strict=False))
    total, kinds, before = Counter(), defaultdict(Counter), Counter()
    for (v, w), n in pairs.items():
        total[v] += n
        kinds[v][min(n, 3)] += 1
        before[w] += 1
    d2 = ngram_lm.discounts(*(sum(n == i for n in pairs.values()) for i in range(1, 5)))
    d1 = ngram_lm.discounts(*(sum(n == i for n in before.values()) for i in range(1, 5)))
    spare = sum(d1[min(n, 3)] for n in before.values()) / len(pairs)

    def p(v, w):
        low = max(before[w] - d1[min(before[w], 3)], 0) / len(pairs) + spare / (len(total) + 1)
        if not total[v]:
            return low
        n = pairs[v, w]
        return (max(n - d2[min(n, 3)], 0) + sum(d2[i] * k for i, k in kinds[v].items()) * low) / total[v]

    words = Counter(w for s in train for w in s[1:])
    n_all = sum(words.values())
    base = lambda s: sum(np.log10((words[w] + 0.5) / (n_all + 0.5 * (len(words) + 1))) for w in s[1:])
    assert abs(sum(p(train[0][0], w) for w in before) + p(train[0][0], "no such word") - 1) < 1e-9
    got = {r["doc_id"]: r for r in collect(ngram_lm.lm_report(docs))}
    # the same with every frequent context dealt over all shards
    pairs_of = docs.select("doc_id", "text")
    model = ngram_lm.train(pairs_of.where(ngram_lm.fold(F.col("doc_id")) != 1), hot_shards=0.05)
    assert len(np.load(f"{model[0]}/hot.npy")) > 5
    spread = {r["id"]: r for r in ngram_lm.score(pairs_of, model).collect()}
    for r in docs.collect():
        s, own = sentence(r["text"]), got[r["doc_id"]]
        if r["doc_id"] % 5 == 0:
            assert own["score"] == pytest.approx(sum(np.log10(p(a, b)) for a, b in zip(s, s[1:], strict=False)), rel=1e-9)
        assert (own["n_tokens"], own["n_known"], own["train_tokens"]) == (len(s) - 1, sum(words[w] > 0 for w in s[1:]), n_all)
        assert own["base_score"] == pytest.approx(base(s), rel=1e-9)
        assert all(spread[r["doc_id"]][c] == pytest.approx(own[c], rel=1e-12) for c in ("n_known", "train_tokens", "base_score", "score"))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert ngram_lm.lm_report(odd).count() == odd.count() and ngram_lm.lm_report(odd.limit(0)).count() == 0


def test_toxicity(spark, odd):
    sf = "/root/testdata/sf0.1"
    scored = toxicity.toxicity_report(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    hits = sum(r["predicted"] == r["toxic"] for r in scored) / len(scored)
    recall = np.mean([r["predicted"] for r in scored if r["toxic"]])
    assert hits > 0.97 and recall > 0.8
    machine, lexicon = toxicity.compose(toxicity.GRAMMAR), toxicity.Lexicon({"fool": 2.0})
    score = lambda t: toxicity.score_text(t, lexicon, machine)[1]
    assert score("you fool") > score("a fool") > score("he said a fool") > 0 and score("not a fool") < score("a fool") and score("nothing") == 0
    assert score("kill you") == score("you kill") > score("not kill you") > 0 == score("kill time") and score("he said kill you") < score("kill you")
    for _ in range(200):  # the composed machine does what the transducers do one after the other
        symbols = random.Random(_).choices(range(6), k=9)
        states, state, want = [s[0] for s, _ in toxicity.GRAMMAR], 0, []
        for c in symbols:
            out = c
            for i, (_, step) in enumerate(toxicity.GRAMMAR):
                states[i], out = step(states[i], out)
            assert (machine[1][state][c], machine[2][state][c]) == toxicity.weight_of(out)
            state = machine[0][state][c]
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 1), (5, None, 0)], "doc_id long, toxic int, quality int")
    clashing = odd.withColumnRenamed("id", "held_out").withColumnRenamed("score", "total")
    assert toxicity.drop_toxic(clashing, labels).columns == clashing.columns and toxicity.toxicity_report(odd, labels).count() == odd.count()
    assert toxicity.toxicity_report(odd.limit(0), labels.limit(0)).count() == 0


def test_urls(spark):
    urls = [None, "no scheme", "http://A.example.NET/en/x?y=1", "http://x.net", "http://x.net/a", "https://example.com/de/1", "http://w.org/fr/", "http://w.org/", "http://other.com/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["id"]: r for r in collect(url_filter.classify_urls(pages))}
    assert [got[i]["rule"] for i in range(9)] == [None, None, "example.net/en/", None, "net/", "example.com/de/", "org/fr/", None, None]
    assert (got[2]["host"], got[2]["path"], got[2]["verdict"]) == ("a.example.net", "/en/x", "allow") and got[1]["host"] == ""
    odd_pages = pages.withColumn("fold", F.lit(1)).withColumn("verdict", F.lit("x"))
    assert url_filter.classify_urls(odd_pages.union(odd_pages)).count() == 18
    assert url_filter.classify_urls(pages.limit(0)).count() == 0
