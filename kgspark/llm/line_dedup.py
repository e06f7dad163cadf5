"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Two lines within k edits: if the one is cut into k + 1 segments, some segment stands unchanged in the other, near its place.
Segments are indexed by length of line, number and hash; each line probes the index with those of its substrings that the
multi-match-aware rule leaves (12 for k = 2). Candidates are verified with Spark's thresholded edit distance, which computes
a band of 2k + 1 diagonals. Lines of up to k characters have no k + 1 segments: they are all within k edits of each other, and
longer lines within k edits of them leave a common string if up to k characters of each are deleted.

Links serve to find classes, so that not all pairs of a dense group are needed: lines that share a segment are compared with a
few pivots of it first, in rounds, and then only lines of different classes with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators.components import connected_components
from kgspark.shared import cut, discard, release

#: Edits up to which lines are linked.
EDITS = 2
#: Lines of each segment that the others are compared with at once; how often others are taken at most, and of segments that more
#: indexed lines share than HOT_KEY only.
PIVOTS, ROUNDS, HOT_KEY = 2, 4, 32
#: Characters, up to 64: whether each stands in a line an odd number of times is compared first. An edit changes that of two at most.
COUNTED = " etaoinsrhldcumpbfgvwy0123456789.,éèäüóñ"
#: What is trimmed from both ends of a line.
BLANKS = " \t\r"


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, at, line, h1, h2): the lines of each text, trimmed; blank ones are left out. A null text has none.

    h1 and h2 are 64-bit hashes of the line, together its identity: among 10^12 different lines two share both with odds
    of about 10^-15.
    """
    parts = F.posexplode(F.split(F.col("text"), "\n"))
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null")
    out = out.select("id", F.xxhash64("text").alias("text_hash"), parts.alias("at", "raw"))
    out = out.withColumn("line", F.btrim("raw", F.lit(BLANKS))).where("line <> ''")
    return out.select("id", "text_hash", "at", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def segment(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i (from 0) of k + 1: the last ones are one longer if the length needs it."""
    rest = F.pmod(length, F.lit(k + 1))
    base = F.floor(length / (k + 1)).cast("int")
    longer = F.greatest(F.lit(0), F.lit(i) - (F.lit(k + 1) - rest))
    return F.lit(i) * base + longer, base + (F.lit(i) >= F.lit(k + 1) - rest).cast("int")


def _key(line: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substring(line, start + 1, size))


def index_keys(line: Column, length: Column, k: int) -> list[Column]:
    return [_key(line, length, i, *segment(length, i, k)) for i in range(k + 1)]


def probe_keys(line: Column, length: Column, k: int) -> list[Column]:
    """Keys of the substrings that can equal a segment of a line of the same length or up to k shorter.

    They are cut from windows of the line that hold all candidates for one segment: short to cut again.
    """
    keys = []
    for i in range(k + 1):
        start, size = segment(length, i, k)
        low_at = F.greatest(start - 2 * k - 1, F.lit(0))
        window = F.substring(line, low_at + 1, size + 4 * k + 4)
        for shorter in range(k + 1):
            other = length - shorter
            start, size = segment(other, i, k)
            low, high = max(-i, shorter - (k - i)), min(i, shorter + (k - i))
            keys += [_key(window, other, i, start + move - low_at, size) for move in range(low, high + 1)]
    return keys


def odd_counts(line: Column) -> Column:
    """A bit for each of COUNTED: set if it stands in the line an odd number of times."""
    many = [F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in COUNTED]
    return sum((F.shiftleft(n.cast("long").bitwiseAND(F.lit(1).cast("long")), i) for i, n in enumerate(many)), F.lit(0).cast("long"))


def _side(rows: DataFrame, n: str, line: str, *more: Column | str) -> DataFrame:
    """rows for a comparison: key, n, line and odd under the names of this side."""
    return rows.select(*[F.col(c).alias(f"{c}_{n}") for c in ("key", "odd")], F.col("n").alias(n), F.col("line").alias(line), *more)


def _compared(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(src, dst): pairs of a and b of different components (c and d) under one key that are within k edits; only they leave the join."""
    apart = (F.col("key_a") == F.col("key_b")) & (F.col("c") != F.col("d"))
    alike = F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= 2 * k
    return left.hint("merge").join(right, apart & alike & (F.levenshtein("x", "y", k) >= 0)).select(*_ordered())


def _exploded(lines: DataFrame, name: str, keys: list[Column]) -> DataFrame:
    """(name, key) rows. The keys are columns of their own first, which Spark compiles to much faster code than one array of them."""
    wide = lines.select(F.col("n").alias(name), *[x.alias(f"k{i}") for i, x in enumerate(keys)])
    return wide.select(name, F.explode(F.array(*[f"k{i}" for i in range(len(keys))])).alias("key"))


def remainders(line: Column, k: int) -> Column:
    """What is left of a line of up to 2k characters if up to k of them are deleted."""
    every = F.array(line)
    for _ in range(k):
        shorter = F.flatten(F.transform(every, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda p: F.concat(F.substring(x, F.lit(1), p - 1), F.substring(x, p + 1, F.length(x))))))
        every = F.array_distinct(F.concat(every, shorter))
    return every


def _ordered(a: str = "a", b: str = "b") -> tuple[Column, Column]:
    return F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")


def short_links(lines: DataFrame, k: int = EDITS) -> DataFrame:
    """(src, dst) of the pairs within k edits of a line of up to k characters and a longer one."""
    near = lines.where(F.length("line") <= 2 * k).select("n", "line", F.explode(remainders(F.col("line"), k)).alias("rest"))
    tiny = near.where(F.length("line") <= k).select(F.col("n").alias("a"), F.col("line").alias("x"), "rest")
    other = near.where(F.length("line") > k).select(F.col("n").alias("b"), F.col("line").alias("y"), "rest")
    return tiny.hint("shuffle_hash").join(other, "rest").where(F.levenshtein("x", "y", k) >= 0).select(*_ordered()).distinct()


def tiny_star(lines: DataFrame, k: int = EDITS) -> DataFrame:
    """(src, dst) that link all lines of up to k characters, which are within k edits of each other, to the first of them."""
    tiny = lines.where(F.length("line") <= k).select("n")
    least = tiny.agg(F.min("n")).first()[0]
    return tiny.where(F.col("n") != least).select(F.lit(least).cast("long").alias("src"), F.col("n").alias("dst"))


def edit_links(lines: DataFrame, k: int = EDITS, hot_key: int = HOT_KEY) -> DataFrame:
    """(src, dst): pairs of different lines within k edits whose components are those of all such pairs.

    lines: n (unique), line (distinct, none empty).
    """
    return segment_links(lines, k, hot_key).union(short_links(lines, k)).union(tiny_star(lines, k))


def segment_links(lines: DataFrame, k: int = EDITS, hot_key: int = HOT_KEY) -> DataFrame:
    """edit_links of the lines over k characters.

    The join of keys has one row for each indexed key, so that a probe passes at most once, however many lines share it. Only
    what passes is compared, with its text, under its key.
    """
    spark = lines.sparkSession
    longer = lines.where(F.length("line") > k).withColumn("length", F.length("line"))
    indexed = _exploded(longer, "a", index_keys(F.col("line"), F.col("length"), k))
    probes = _exploded(longer, "b", probe_keys(F.col("line"), F.col("length"), k))  # a line's own keys are among them
    ends = indexed.groupBy("key").agg(F.min("a").alias("least"), F.max("a").alias("most"))
    met = ends.hint("shuffle_hash").join(probes, "key").where("least <> b or most <> b")
    met = cut(met.select("key", F.col("b").alias("n"), F.when(F.col("least") == F.col("most"), F.col("least")).alias("only")), "met")
    release(spark)
    rows = cut(met.select("key", "n").union(met.where("only is not null").select("key", "only")).distinct(), "rows")
    own = F.array_contains(F.array(*index_keys(F.col("line"), F.length("line"), k)), F.col("key"))
    # the texts of lines that are compared leave the table once
    rows = lines.select("n", "line").join(rows.hint("shuffle_hash"), "n")
    rows = cut(rows.select("key", "n", "line", own.alias("own"), odd_counts(F.col("line")).alias("odd")), "texts")
    release(spark)
    return _links_by_key(rows, k, hot_key)


def _links_by_key(rows: DataFrame, k: int, hot_key: int) -> DataFrame:
    """Links within keys. rows: key, n, line, own (whether the line is indexed under the key, or probes it).

    Every line is compared with PIVOTS indexed ones of each of its keys. Where a key still holds several components and more than
    hot_key indexed lines, the next pivots are taken outside its largest component. After ROUNDS of them what is left is compared
    across components only, and lines of a key's largest component only with those outside it.
    """
    rows = rows.withColumns({"component": F.col("n"), "outside": F.lit(True), "tried": F.lit(False), "left": F.lit(hot_key + 1)})
    found = None
    for _ in range(ROUNDS):
        rank, live = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("n"), "n")), rows.where(F.col("left") > hot_key)
        pivots = live.where("own and outside and not tried").withColumn("rank", rank).where(F.col("rank") <= PIVOTS)
        pivots = cut(_side(pivots, "a", "x", F.col("component").alias("c")), "pivots")
        near = cut(_compared(pivots, _side(live, "b", "y", F.col("component").alias("d")), k), "pivot-links")
        found = near if found is None else found.union(near)
        rows = cut(_open_rows(rows, pivots, found), "open-rows")
        release(rows.sparkSession)
        # where a pivot has hardly any line near it, no dense groups are left
        if near.count() <= pivots.count() or rows.where(F.col("left") > hot_key).isEmpty():
            break
    return found.union(_links_across(rows, k))


def _open_rows(rows: DataFrame, pivots: DataFrame, links: DataFrame) -> DataFrame:
    """rows with their components by links, of those keys that have lines of several components and any that was no pivot."""
    components = connected_components(links).select(F.col("node").alias("n"), F.col("component").alias("now"))
    tried = pivots.select(F.col("key_a").alias("key"), F.col("a").alias("n"), F.lit(True).alias("pivot"))
    rows = rows.drop("component", "outside", "left").hint("merge").join(components, "n", "left").hint("merge").join(tried, ["key", "n"], "left")
    rows = cut(rows.withColumns({"tried": F.coalesce("pivot", "tried"), "component": F.coalesce("now", "n")}).drop("pivot", "now"), "grouped")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("rows"), F.count_if(F.col("own") & ~F.col("tried")).alias("left"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("rows", "component")).getField("component").alias("main"), F.count("*").alias("parts"), F.sum("left").alias("left"))
    few = sizes.where("parts > 1 and left > 0").select("key", "main", "left")
    return rows.hint("merge").join(few, "key").withColumn("outside", F.col("component") != F.col("main")).drop("main")


def _links_across(rows: DataFrame, k: int) -> DataFrame:
    """Links between lines of different components of a key, where neither has been a pivot."""
    rows = rows.where("not tried")
    left = _side(rows.where("own"), "a", "x", F.col("component").alias("c"), F.col("outside").alias("o"))
    right = _side(rows, "b", "y", F.col("component").alias("d"), F.col("outside").alias("p"))
    return _compared(left.where("o"), right, k).union(_compared(left.where("not o"), right.where("p"), k))


def line_classes(lines: DataFrame, k: int = EDITS, hot_key: int = HOT_KEY) -> DataFrame:
    """(h1, h2, class_id) of the lines that have links. lines: n, line, h1, h2; one row for each different line.

    class_id names the least (h1, h2) of the lines reachable by links, as 32 hex digits.
    """
    links = cut(edit_links(lines, k, hot_key), "links")
    components = cut(connected_components(links), "components")
    release(lines.sparkSession)
    members = lines.select("n", "h1", "h2").hint("merge").join(components.select(F.col("node").alias("n"), "component"), "n")
    members = cut(members, "members")
    least = members.groupBy("component").agg(F.min(F.struct("h1", "h2")).alias("least"))
    named = members.hint("merge").join(least, "component").select("h1", "h2", class_name("least.h1", "least.h2").alias("class_id"))
    return cut(named, "classes")


def class_name(h1: str, h2: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (h1, h2)]))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = EDITS, hot_key: int = HOT_KEY) -> DataFrame:
    """One row for each row of docs: id, n_lines, n_kept, classes (of its lines in order, with copies), places (of the lines
    that stay, from 0), kept (those lines).

    Equal lines, and lines linked by chains of at most k edits, are one class. A line stays if it is the first of its class:
    least id, then least place. Rows of equal id and equal text are one document and share its result; of other texts with an
    equal id the one with the least hash comes first. Blank lines are left out, null and empty texts have no lines. A null id
    comes first. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    lines = lines_of(docs, id_col, text_col)  # texts are split twice, which takes less than to write all lines and read them twice
    distinct = cut(lines.select("h1", "h2", "line").distinct().withColumn("n", F.monotonically_increasing_id()), "distinct")
    at = cut(lines.select("id", "text_hash", "at", "h1", "h2"), "at")
    release(spark)
    classes = line_classes(distinct, k, hot_key)
    discard(distinct)
    marked = at.join(classes.hint("shuffle_hash"), ["h1", "h2"], "left")
    marked = cut(marked.select("id", "text_hash", "at", F.coalesce("class_id", class_name("h1", "h2")).alias("class_id")), "marked")
    release(spark)
    first = marked.groupBy("class_id").agg(F.min(F.struct("id", "text_hash", "at")).alias("first")).select("first.*")
    every = marked.withColumn("stays", F.lit(False)).unionByName(first.withColumn("class_id", F.lit(None).cast("string")).withColumn("stays", F.lit(True)))
    of = every.groupBy("id", "text_hash").agg(
        F.array_sort(F.collect_set(F.when(~F.col("stays"), F.struct("at", "class_id")))).alias("all"),
        F.array_sort(F.collect_set(F.when(F.col("stays"), F.col("at")))).alias("places"),
    )
    of = of.select(F.col("id").alias("own_id"), F.col("text_hash").alias("own_hash"), F.col("all.class_id").alias("classes"), "places")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("text_hash", F.xxhash64("text"))
    out = rows.hint("merge").join(of, rows["id"].eqNullSafe(of["own_id"]) & (rows["text_hash"] == of["own_hash"]), "left")
    none, nobody = F.array().cast("array<int>"), F.array().cast("array<string>")
    places, classes = F.coalesce("places", none), F.coalesce("classes", nobody)
    pieces = F.split(F.coalesce("text", F.lit("")), "\n")
    return out.select(
        "id", F.size(classes).cast("long").alias("n_lines"), F.size(places).cast("long").alias("n_kept"), classes.alias("classes"),
        places.alias("places"), F.transform(places, lambda p: F.btrim(F.get(pieces, p), F.lit(BLANKS))).alias("kept"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """dedup_lines by doc_id: the number of lines, of those that stay and of different classes, the places of the kept lines
    and the classes of all lines, comma-joined. Nulls, ties, repeats, empty tables and other columns as there."""
    found = dedup_lines(docs)
    return found.select(
        F.col("id").alias("doc_id"), "n_lines", "n_kept", F.size(F.array_distinct("classes")).cast("long").alias("n_classes"),
        F.array_join("places", ",").alias("kept_lines"), F.array_join("classes", ",").alias("classes"),
    )
