"""Entity resolution: blocking, pair scores, merges and their redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.scalars import completeness, first_token, stable_id
from kgspark.functions.similarity import best_similarity
from kgspark.operators import pair_tiles
from kgspark.operators.components import connected_components
from kgspark.shared import cut

#: Merge and pending thresholds, members of a block.
AUTO_MERGE, PENDING, MAX_BLOCK = 0.85, 0.60, 100
#: Members of a piece of a block that a task compares with another piece.
PIECE = 1000


def _placed(rows: DataFrame) -> DataFrame:
    """rows (block, id) with place: the number of the id within its block, from 0, by id. A block of any size is dealt to
    several tasks: the rows are sorted as a whole and numbered by range."""
    ranged = cut(rows.repartitionByRange("block", "id").withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("block", "part").agg(F.count("*").alias("n"))  # a few rows for each block
    before = F.coalesce(F.sum("n").over(W.partitionBy("block").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = cut(counts.select("block", "part", before.alias("base")), "bases")
    own = F.row_number().over(W.partitionBy("block", "part").orderBy("id")) - 1
    return ranged.withColumn("own", own).hint("merge").join(bases, ["block", "part"]).withColumn("place", F.col("base") + F.col("own")).drop("part", "own", "base")


def block_columns(entities: DataFrame) -> tuple[Column, Column]:
    """(blocks, strict) of entities, as columns: see block_keys."""
    token = first_token(F.col("name"))
    domains = F.col("domains") if "domains" in entities.columns else F.array().cast("array<string>")
    named = F.when(token != "", F.concat(F.lit("name:"), token))
    by_mail = F.transform(F.coalesce(domains, F.array().cast("array<string>")), lambda d: F.concat(F.lit("email_domain:"), F.lower(d)))
    source = F.nullif(F.col("source_doc_id").cast("string"), F.lit(""))
    keys = F.array_distinct(F.array_compact(F.concat(F.array(named, F.concat(F.lit("source_doc_id:"), source)), by_mail)))
    return keys, F.concat_ws("|", token, F.lower(F.coalesce(F.col("doc_source_type"), F.lit(""))))


def block_keys(entities: DataFrame) -> DataFrame:
    """(id, block, strict): entities (id, name, source_doc_id, doc_source_type and, if there, domains) by first name token, e-mail
    domain and source document. strict: what an oversize block is keyed by besides."""
    keys, strict = block_columns(entities)
    return entities.select("id", strict.alias("strict"), F.explode(keys).alias("block"))


def blocks(entities: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """(id, block, chunk, chunks): entities by block. A block of more than max_block members is keyed anew by first token and source
    type besides, and cut into chunks of max_block ids in order; other blocks are one chunk."""
    keyed = cut(block_keys(entities), "keys")
    large = cut(keyed.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > max_block).select("block"), "large")
    one = [F.lit(0).cast("long").alias("chunk"), F.lit(1).cast("long").alias("chunks")]
    if large.isEmpty():
        return keyed.select("id", "block", *one)
    small = keyed.hint("merge").join(large, "block", "left_anti").select("id", "block", *one)
    strict = keyed.hint("merge").join(large, "block", "left_semi").select("id", F.concat_ws("|", "block", "strict").alias("block"))
    placed = cut(_placed(strict), "placed")
    sizes = placed.groupBy("block").agg(F.ceil(F.count("*") / max_block).alias("chunks"))
    chunk = F.floor(F.col("place") / max_block)
    return small.unionByName(placed.hint("merge").join(sizes, "block").select("id", "block", chunk.alias("chunk"), "chunks"))


def candidate_pairs(entities: DataFrame, max_block: int = MAX_BLOCK, across: bool = False) -> DataFrame:
    """Distinct (a, b), a < b, of entities that share a chunk of a block: at most max_block - 1 partners in each.

    across: the chunks of a block are compared with each other too, so that no pair of an oversize block is lost; those pairs
    grow with the square of the block. A pair comes from the first of the blocks (or chunks) that both are in, the largest
    first, so that pairs are never shuffled. A block is dealt to tasks in pieces of PIECE, or max_block where that is more.
    """
    of = _block_cells(entities, max_block, across)
    return _pairs_of_cells(of, _cells_by_id(of), across)


def _block_cells(entities: DataFrame, max_block: int, across: bool) -> DataFrame:
    """(id, cell, piece, pieces) of candidate_pairs: a cell is a chunk of a block, or a block in pieces where they are compared across."""
    of = blocks(entities, max_block)
    each = max(1, PIECE // max_block) if across else 1  # chunks in a piece
    cell = F.struct((-F.col("chunks")).alias("size"), "block", (F.lit(0).cast("long") if across else F.col("chunk")).alias("part"))
    return cut(of.select("id", cell.alias("cell"), F.floor(F.col("chunk") / each).alias("piece"), F.ceil(F.col("chunks") / each).alias("pieces")), "blocks")


def _cells_by_id(of: DataFrame) -> DataFrame:
    """(id, cells): the cells of each id in order; as many as an entity's names, domains and documents, or its keys."""
    return of.groupBy("id").agg(F.array_sort(F.collect_set("cell")).alias("cells"))


def _with_earlier(of: DataFrame, held: DataFrame) -> DataFrame:
    """of (id, cell, piece, pieces) once, where an id has several rows, with before: the cells of the id that come before. held: _cells_by_id of it."""
    before = F.filter("cells", lambda c: c < F.col("cell"))
    of = of.groupBy("id", "cell").agg(F.min("piece").alias("piece"), F.max("pieces").alias("pieces"))
    return cut(of.hint("merge").join(held, "id").select("id", "cell", "piece", "pieces", before.alias("before")), "cells")


def _pairs_of_cells(of: DataFrame, held: DataFrame, across: bool) -> DataFrame:
    """Distinct (a, b), a < b, of ids that share a cell. of: id, cell, piece, pieces (of the cell); held: _cells_by_id of it."""
    of = _with_earlier(of, held)
    left = of.select(F.col("id").alias("a"), "cell", F.col("before").alias("x"), F.col("piece").alias("i"), F.explode(F.sequence("piece", F.col("pieces") - 1) if across else F.array("piece")).alias("j"))
    right = of.select(F.col("id").alias("b"), "cell", F.col("before").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), "piece") if across else F.array("piece")).alias("i"), F.col("piece").alias("j"))
    pairs = left.hint("merge").join(right, ["cell", "i", "j"]).where((F.col("a") < F.col("b")) | ((F.col("i") < F.col("j")) & (F.col("a") != F.col("b"))))
    return pairs.where(~F.arrays_overlap("x", "y")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def in_pieces(rows: DataFrame, times: int = 1) -> DataFrame:
    """rows (block, id) with piece and pieces: a block's ids in order, times PIECE in each piece."""
    placed = cut(_placed(rows), "placed")
    sizes = cut(placed.groupBy("block").agg(F.ceil(F.count("*") / (times * PIECE)).alias("pieces")), "sizes")
    return placed.withColumn("piece", F.floor(F.col("place") / (times * PIECE))).drop("place").hint("merge").join(sizes, "block")


def pairs_of_keys(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct (a, b), a < b, of ids that share a key; (id, cells): pairs that share a cell are among them). keys: id, key, distinct.

    A key of any size is dealt to tasks in pieces, and a pair comes from the first key that both have, so that pairs are never shuffled.
    """
    of, held = _cells_of_keys(keys)
    return _pairs_of_cells(of, held, True), held


def tiles_of_keys(keys: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the ids of pairs_of_keys as tiles of pair_tiles, (id, cells) as there). held: id, names, signature, identifiers."""
    of, cells = _cells_of_keys(keys)
    members = _with_earlier(of, cells).hint("merge").join(held.select("id", "names", "signature", "identifiers"), "id")
    return pair_tiles.tiles(members, whole=False), cells


def _cells_of_keys(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, cell, piece, pieces) of the keys that several ids have, and _cells_by_id of it."""
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    met = in_pieces(keys.hint("merge").join(shared, "key", "left_semi").select("id", F.col("key").alias("block")))
    of = cut(met.select("id", F.struct((-F.col("pieces")).alias("size"), "block").alias("cell"), "piece", "pieces"), "of")
    return of, cut(_cells_by_id(of), "held")


def evidence_overlap(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b, overlap) of pairs that have facts in common: the Jaccard similarity of their subjects' (predicate, source_doc_id).

    Facts without either are no evidence. Only joins and counts: a subject with very many facts is never gathered.
    """
    empty = F.lit("")
    seen = facts.select("subject_id", F.coalesce("predicate", empty).alias("p"), F.coalesce(F.col("source_doc_id").cast("string"), empty).alias("d")).where("p <> '' or d <> ''").distinct()
    seen = cut(seen, "evidence")
    sizes = cut(seen.groupBy("subject_id").agg(F.count("*").alias("n")), "evidence-sizes")
    left = pairs.select("a", "b").hint("merge").join(seen.withColumnRenamed("subject_id", "a"), "a")
    common = left.hint("merge").join(seen.withColumnRenamed("subject_id", "b"), ["b", "p", "d"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    for x in ("a", "b"):
        common = common.hint("merge").join(sizes.select(F.col("subject_id").alias(x), F.col("n").alias(f"n_{x}")), x)
    return common.select("a", "b", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("overlap"))


def _compared(entities: DataFrame) -> tuple[Column, Column]:
    """(names, signature) of entities, as columns: see score_pairs."""
    names = F.col("aliases") if "aliases" in entities.columns else F.array("name")
    return names, F.col("signature") if "signature" in entities.columns else F.array().cast("array<string>")


def _tiles(entities: DataFrame, max_block: int, across: bool) -> DataFrame:
    """The entities of candidate_pairs as pair_tiles takes them: PIECE at most in each piece."""
    of = _block_cells(entities, max_block, across)
    of = _with_earlier(of, _cells_by_id(of))
    if max_block > PIECE:
        of = in_pieces(of.select("id", F.col("cell").alias("block"), "before")).withColumnRenamed("block", "cell")
    names, signature = _compared(entities)
    members = of.hint("merge").join(entities.select("id", names.alias("names"), signature.alias("signature"), "identifiers"), "id")
    return pair_tiles.tiles(members, whole=not across and max_block <= PIECE)


def score_pairs(entities: DataFrame, pairs: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(a, b, name_similarity, exact_id_match, overlap, combined): 0.65 name + 0.35 evidence.

    The name's part is the best similarity of any alias (array aliases, else the name) with any of the other. Evidence is
    that of facts, or the Jaccard similarity of arrays `signature` where there are none. An identifier in common (arrays
    identifiers) gives 0.85 + 0.15 name instead.
    """
    names, signature = _compared(entities)
    side = lambda x: entities.select(F.col("id").alias(x), names.alias(f"n{x}"), signature.alias(f"s{x}"), F.col("identifiers").alias(f"i{x}"))
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").withColumn("name_similarity", best_similarity("na", "nb"))
    if facts is None:
        union = F.size(F.array_union("sa", "sb"))
        both = both.withColumn("overlap", F.when(union > 0, F.size(F.array_intersect("sa", "sb")) / union).otherwise(0.0))
    else:
        both = both.hint("merge").join(evidence_overlap(pairs, facts), ["a", "b"], "left").fillna(0.0, ["overlap"])
    exact = F.coalesce(F.arrays_overlap("ia", "ib"), F.lit(False))
    combined = pair_tiles.combined_column(F.col("name_similarity"), F.col("overlap"), exact)
    return both.select("a", "b", "name_similarity", exact.alias("exact_id_match"), "overlap", combined.alias("combined"))


def entity_completeness(entities: DataFrame) -> Column:
    """Filled columns, plus one for each alias and two for each identifier."""
    plain = [c for c in entities.columns if c not in ("id", "aliases", "identifiers", "signature", "domains")]
    sizes = [F.coalesce(F.size(F.array_distinct(c)), F.lit(0)) * n for c, n in (("aliases", 1), ("identifiers", 2)) if c in entities.columns]
    return sum(sizes, completeness(*plain))


def resolve_entities(
    entities: DataFrame, auto: float = AUTO_MERGE, pending: float = PENDING, facts: DataFrame | None = None, max_block: int = MAX_BLOCK, across: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(merges: id, merged_into; pending: the scored pairs between the thresholds, with merge_id).

    Of a cluster the most complete member survives, of equally complete ones that with the smallest id. Without facts pairs are
    scored where a chunk's members lie, for the merges and, when they are read, for the pending ones. Pairs of an oversize block in
    different chunks or of different source types are not compared: resolution_index.resolve_all compares whole blocks.
    """
    if facts is None:
        tiles = _tiles(entities, max_block, across)
        return merges_of_links(entities, cut(pair_tiles.links(tiles, auto), "links")), with_merge_id(pair_tiles.pairs(tiles, pending, auto))
    scored = cut(score_pairs(entities, candidate_pairs(entities, max_block, across), facts), "pairs")
    waiting = scored.where((F.col("combined") >= pending) & (F.col("combined") < auto))
    return merges_of_scored(entities, scored, auto), with_merge_id(waiting)


def merges_of_scored(entities: DataFrame, scored: DataFrame, auto: float = AUTO_MERGE) -> DataFrame:
    """(id, merged_into) by the pairs (a, b, combined) that reach auto."""
    return merges_of_links(entities, scored.where(F.col("combined") >= auto))


def merges_of_links(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(id, merged_into) by links (a, b) of entities that are the same."""
    return merges_of_clusters(entities, cut(connected_components(links, "a", "b"), "clusters"))


def merges_of_clusters(entities: DataFrame, merged: DataFrame) -> DataFrame:
    """(id, merged_into) by clusters (node, component) of entities that are the same."""
    filled = entities.groupBy(F.col("id").alias("node")).agg(F.max(entity_completeness(entities)).alias("filled"))
    members = cut(merged.hint("merge").join(filled, "node"), "members")
    survivors = members.groupBy("component").agg(F.min_by("node", F.struct(-F.col("filled"), F.col("node"))).alias("merged_into"))
    return members.hint("merge").join(survivors, "component").where("node <> merged_into").select(F.col("node").alias("id"), "merged_into")


def with_merge_id(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("merge_id", F.concat(F.lit("candidate-merge-"), stable_id("a", "b")))


def repoint_facts(facts: DataFrame, merges: DataFrame) -> DataFrame:
    """facts with the survivor as subject where theirs was merged."""
    return redirect(facts, merges, "subject_id")


def score_histogram(scored: DataFrame) -> DataFrame:
    """(bin, n) of pair scores: five bins, empty ones too."""
    edges = [(0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.85), (0.85, 1.0)]
    counts = [F.count_if((F.col("combined") >= low) & ((F.col("combined") < high) if high < 1 else (F.col("combined") <= high))).alias(f"b{i}") for i, (low, high) in enumerate(edges)]
    bins = F.array(*[F.struct(F.lit(f"{low:g}-{high:g}").alias("bin"), F.col(f"b{i}").alias("n")) for i, (low, high) in enumerate(edges)])
    return scored.agg(*counts).select(F.inline(bins))


def best_pairs(scored: DataFrame, k: int = 5) -> DataFrame:
    return scored.orderBy(F.desc("combined"), "a", "b").limit(k)


def resolution_summary(entities: DataFrame, merges: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: entities, auto_merges, pending_merges."""
    return entities.agg(F.count("*").alias("entities")).crossJoin(merges.agg(F.count("*").alias("auto_merges"))).crossJoin(pending.agg(F.count("*").alias("pending_merges")))


def redirect(links: DataFrame, merges: DataFrame, column: str = "entity_id") -> DataFrame:
    """links with column followed along merges to the survivor; a cycle ends at its smallest id."""
    ends = cut(connected_components(merges.select(F.col("id").alias("src"), F.col("merged_into").alias("dst"))), "ends")
    roots = merges.select(F.col("merged_into").alias("node")).distinct().hint("merge").join(merges.select(F.col("id").alias("node")), "node", "left_anti")
    named = ends.hint("merge").join(roots, "node").groupBy("component").agg(F.min("node").alias("survivor"))
    target = ends.hint("merge").join(named, "component", "left").select(F.col("node").alias("redirect_from"), F.coalesce("survivor", "component").alias("redirect_to"))
    out = links.hint("merge").join(target, links[column] == target["redirect_from"], "left")
    return out.withColumn(column, F.coalesce("redirect_to", links[column])).select(*links.columns)
