"""URL filters: host and path rules first, then gradient-boosted trees on lexical features.

The trees learn from URLs that a rule labels, but for one fold of them, which is held out. Features see the URL's shape only:
lengths, depth, digit ratio, entropy, parameter counts and statistics of its host suffix, alone and with the path's first
directory. What a suffix's labels say is taken out of fold: a labelled URL sees the labels of the other folds, so that no feature holds its own.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.text import ASCII_LOWER, ASCII_UPPER
from kgspark.shared import cut

#: (host, path prefix, verdict) of the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Labelled URLs to fit on, at most; taken by hash.
FIT_ROWS = 20_000
#: Folds of labelled URLs; that of number 0 is never fitted on.
FOLDS = 5
#: Host suffixes whose statistics are broadcast, at most: those with more than one in so many URLs. The others are joined by shuffle.
SUFFIXES = 1_000
FEATURES = ["length", "host_length", "depth", "digit_ratio", "entropy", "n_params", "hyphens", "suffix_share", "suffix_blocked", "section_blocked", "has_www", "secure"]


def parse_url(url: Column) -> dict[str, Column]:
    """host and path columns; both empty for null and for a url without `://`."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER)
    return {"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. Of rules of equal length the first in the alphabet wins."""
    out: Column | None = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features that need no corpus; url, host and path must be there."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    letters = F.split(url, "")
    share = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / size)
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))
    count = lambda pattern: F.regexp_count(url, F.lit(pattern)).cast("double")
    return df.withColumns(
        {
            "length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"),
            "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"), "digit_ratio": count("[0-9]") / size,
            "entropy": entropy, "n_params": count("[?&][^=&#]*="), "hyphens": count("-"),
            "has_www": F.col("host").startswith("www.").cast("double"), "secure": url.startswith("https").cast("double"),
            "suffix": F.regexp_extract("host", r"([^.]+(?:\.[^.]+)?)$", 1),
            "section": F.concat(F.regexp_extract("host", r"([^.]+(?:\.[^.]+)?)$", 1), F.regexp_extract("path", r"^/[^/]*/", 0)),
        }
    )


def with_suffix_statistics(urls: DataFrame, suffixes: int = SUFFIXES, key: str = "suffix") -> DataFrame:
    """urls with suffix_share and suffix_blocked of their suffix, or those of another key; verdict, fold and it (not null) must be there.

    suffix_blocked is the share of block verdicts among the suffix's judged URLs of other folds, fold 0 never counting. All
    suffixes have statistics: those of the frequent ones are broadcast, the others joined by shuffle.
    """
    label = (F.col("verdict") == "block").cast("long")
    tests = [F.col("fold") == i for i in range(1, FOLDS)]
    stats = urls.groupBy(key).agg(
        F.count("*").alias("n"), *[F.count(F.when(t, F.col("verdict"))).alias(f"judged{i}") for i, t in enumerate(tests, 1)],
        *[F.coalesce(F.sum(F.when(t, label)), F.lit(0)).alias(f"blocked{i}") for i, t in enumerate(tests, 1)],
    )
    total = float(max(1, urls.count()))
    every = lambda what: F.array(F.lit(0).cast("long"), *[F.col(f"{what}{i}") for i in range(1, FOLDS)])
    stats = cut(
        stats.select(
            key, (F.col("n") > total / suffixes).alias("hot"), F.log1p((F.col("n") / F.lit(total)) * 1000).alias(f"{key}_share"),
            every("judged").alias("judged"), every("blocked").alias("blocked"),
        ),
        "suffixes",
    )
    hot, cold = stats.where("hot").drop("hot"), stats.where("not hot").drop("hot")
    featured = urls.join(F.broadcast(hot), key)
    if not cold.isEmpty():
        rest = urls.join(F.broadcast(hot.select(key)), key, "left_anti")
        featured = featured.unionByName(rest.hint("merge").join(cold, key))
    sum_of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    own = F.when(F.col("verdict").isNotNull(), F.col("fold"))
    other = lambda c: sum_of(c) - F.coalesce(F.get(c, own), F.lit(0))
    return featured.withColumn(f"{key}_blocked", (other("blocked") + 1) / (other("judged") + 2)).drop("judged", "blocked")


def classify_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id", url_col: str = "url",
    fit_rows: int = FIT_ROWS, suffixes: int = SUFFIXES,
) -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict, probability (of block, by the trees), held_out (whether the
    URL is of the fold that neither trees nor statistics learn from; its own labels measure the trees).

    verdict is that of the longest fitting rule, else block where the trees' probability is at least 0.5. If the rules label
    no URL outside that fold, or only with one verdict, that verdict (allow if none) holds for the others and probability is null. Null and
    malformed URLs have empty host and path, fit no rule and are judged by the trees. Repeated rows are judged each; other
    columns are ignored; an empty table gives an empty result.
    """
    rules = RULES if rules is None else rules
    urls = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"))
    urls = urls.withColumns(parse_url(F.col("url"))).withColumn("hit", match_rule(F.col("host"), F.col("path"), rules))
    fold = F.pmod(F.xxhash64(F.lit(7), F.coalesce("url", F.lit(""))), F.lit(FOLDS)).cast("int")
    urls = lexical(urls.select("id", "url", "host", "path", "hit.*", fold.alias("fold")))
    urls = cut(urls, "urls")
    label = (F.col("verdict") == "block").cast("double")
    featured = with_suffix_statistics(with_suffix_statistics(urls, suffixes), suffixes, "section")
    featured = cut(featured.drop("section", "section_share"), "featured")
    held = (F.col("fold") == 0).alias("held_out")
    learned = F.col("verdict").isNotNull() & (F.col("fold") != 0)
    labelled = urls.where(learned).groupBy("verdict").agg(F.count("*").alias("n")).collect()
    counts = {r["verdict"]: r["n"] for r in labelled}
    columns = ["id", "host", "path", "rule"]
    if len(counts) < 2:
        other = F.lit(next(iter(counts), "allow"))
        return featured.select(*columns, F.coalesce("verdict", other).alias("verdict"), F.lit(None).cast("double").alias("probability"), held)
    share = min(1.0, fit_rows / sum(counts.values()))
    chosen = featured.where(learned).where(F.pmod(F.xxhash64("url", "id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    chosen = cut(chosen.select(label.alias("label"), *FEATURES), "fit")
    trees = GBTClassifier(labelCol="label", maxIter=10, maxDepth=4, maxBins=32, seed=1, stepSize=0.3)
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), trees]).fit(chosen)
    scored = model.transform(featured).withColumn("probability", vector_to_array("probability")[1])
    verdict = F.coalesce("verdict", F.when(F.col("probability") >= 0.5, "block").otherwise("allow"))
    return scored.select(*columns, verdict.alias("verdict"), "probability", held)


def url_report(pages: DataFrame) -> DataFrame:
    """classify_urls by page_id with the contract's rules; nulls, repeats, empty tables and other columns as there."""
    return classify_urls(pages).withColumnRenamed("id", "page_id")
