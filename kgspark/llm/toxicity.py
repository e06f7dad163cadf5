"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps words to symbols (insult, threat, target, negation, report, other) with weights; insults and stems
of insults are learned from labels. Its output is read by a negation transducer, which marks insults and threats in its reach
as negated; that one's output by a transducer of reported speech, which marks them as reported; and that one's by one of
targets, which marks insults as aimed, holds threats back until their target is there, and weighs what comes out. The four are
composed into one machine, whose path over a clause gives the clause's score. A logistic model turns the clause scores of a
text into a probability.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.text import free_names, slices
from kgspark.shared import cut

#: Labelled texts to learn from, at most; taken by hash of their id and text.
FIT_ROWS = 20_000
#: Of words and stems in the learned lexicon: least log-odds, and least variety of words before them (of 64 classes).
MIN_ODDS, MIN_CONTEXTS = 2.0, 8
STEMS = (4, 5, 6)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Closed-class words of the grammar in the four languages of the tables.
WORDS = {
    TARGET: "you your yours u they them he she him her du dich dir ihr euch sie tu te toi vous votre eux tú ti usted ustedes vosotros ellos",
    NEGATION: "not no never neither nor nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún tampoco",
    REPORT: "said says wrote claimed reported quoted alleged sagte sagt schrieb behauptete dit écrit affirme dijo dice escribió afirmó",
    THREAT: "kill hurt destroy attack burn shoot töten schlagen vernichten tuer frapper détruire matar golpear destruir",
}
THREAT_WEIGHT = 1.5

_CLAUSE = {ord(c) for c in ".!?;\n"}
_TABLE = bytes(46 if c in _CLAUSE else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

#: Marks that transducers put on the symbols INSULT and THREAT.
NEGATED, REPORTED, AIMED = 8, 16, 32

#: A transducer: its states and its step from (state, symbol) to (state, symbol).
Transducer = tuple[list, Callable[[object, int], tuple[object, int]]]


def _marked(symbol: int, mark: int, when: bool) -> int:
    return symbol | mark if when and symbol & 7 in (INSULT, THREAT) else symbol


#: A negation reaches three words.
NEGATIONS: Transducer = ([0, 1, 2, 3], lambda s, c: (3 if c == NEGATION else max(0, s - 1), _marked(c, NEGATED, s > 0)))
REPORTS: Transducer = ([False, True], lambda s, c: (s or c == REPORT, _marked(c, REPORTED, s)))


def _aim(state: tuple[bool, int], symbol: int) -> tuple[tuple[bool, int], int]:
    """state: whether a target has been met, and the threat that waits for one (0 if none)."""
    met, waiting = state
    if symbol == TARGET:
        return (True, 0), waiting | AIMED if waiting else symbol
    if symbol & 7 == THREAT and not met:
        return (met, symbol), OTHER
    return state, _marked(symbol, AIMED, met)


TARGETS: Transducer = ([(met, w) for met in (False, True) for w in (0, *(THREAT | n | r for n in (0, NEGATED) for r in (0, REPORTED)))], _aim)


def weight_of(symbol: int) -> tuple[float, float]:
    """What a symbol that comes out adds to the score: a factor of the word's weight, and a weight of its own."""
    factor = (0.6 if symbol & NEGATED else 1.0) * (0.7 if symbol & REPORTED else 1.0)
    if symbol & 7 == INSULT:
        return factor * (1.3 if symbol & AIMED else 1.0), 0.0
    if symbol & 7 == THREAT and symbol & AIMED:
        return 0.0, factor * THREAT_WEIGHT
    return 0.0, 0.0


def compose(chain: list[Transducer]) -> tuple[list[list[int]], list[list[float]], list[list[float]]]:
    """The machine in which each transducer reads what the one before it puts out, determinised over its reachable states.

    Next state, factor and weight by [state][class]; state 0 is the start.
    """
    start = tuple(states[0] for states, _ in chain)
    number, todo = {start: 0}, [start]
    follow: list[list[int]] = []
    factor: list[list[float]] = []
    extra: list[list[float]] = []
    for state in todo:
        rows: tuple[list, list, list] = ([], [], [])
        for symbol in range(6):
            out, after = symbol, []
            for own, (_, step) in zip(state, chain, strict=True):
                new, out = step(own, out)
                after.append(new)
            target = tuple(after)
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            for row, x in zip(rows, (number[target], *weight_of(out)), strict=True):
                row.append(x)
        for table, row in zip((follow, factor, extra), rows, strict=True):
            table.append(row)
    return follow, factor, extra


GRAMMAR = [NEGATIONS, REPORTS, TARGETS]


class Lexicon(dict):
    """Word -> (class, weight), with stems; words met are remembered up to a bound."""

    def __init__(self, learned: dict[str, float], bound: int = 300_000):
        super().__init__()
        self.learned, self.bound = learned, bound
        self.closed = {w: c for c, words in WORDS.items() for w in words.split()}

    def __missing__(self, word: str) -> tuple[int, float]:
        weight = max(self.learned.get(word, 0.0), *(self.learned.get(word[:n] + "*", 0.0) for n in STEMS if len(word) >= n), 0.0)
        if weight:
            found = (INSULT, weight)
        else:
            kind = self.closed.get(word, OTHER)
            found = (kind, 0.0)
        if len(self) >= self.bound:
            self.clear()
        self[word] = found
        return found


def clauses(text: str) -> list[list[str]]:
    plain = text.lower().encode("utf-8", "replace").translate(_TABLE).decode("utf-8", "replace")
    return [words for c in plain.split(".") if (words := c.split())]


def score_text(text: str, lexicon: Lexicon, machine: tuple[list[list[int]], list[list[float]], list[list[float]]]) -> tuple[float, float, float]:
    """log(1 + sum), maximum, and sum for each 100 words, of the clause scores of a text."""
    follow, factor, extra = machine
    total = best = 0.0
    n = 0
    for words in clauses(text):
        n += len(words)
        coded = [lexicon[w] for w in words]
        if not any(kind in (INSULT, THREAT) for kind, _ in coded):
            continue
        state, score = 0, 0.0
        for kind, weight in coded:
            score += weight * factor[state][kind] + extra[state][kind]
            state = follow[state][kind]
        total += score
        best = max(best, score)
    return math.log1p(total), best, 100 * total / max(n, 1)


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic: dict[str, int] = {}
    clean: dict[str, int] = {}
    context: dict[str, int] = {}
    for whole in batches:
        for batch in slices(whole, "text"):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                seen: set[str] = set()
                for words in clauses(text or ""):
                    before = ""
                    for w in words:
                        own = [w, *(w[:n] + "*" for n in STEMS if len(w) >= n)]
                        seen.update(own)
                        if label:
                            bit = 1 << zlib.crc32(before.encode()) % 63
                            for f in own:
                                context[f] = context.get(f, 0) | bit
                        before = w
                into = toxic if label else clean
                for f in seen:
                    into[f] = into.get(f, 0) + 1
    names = [*toxic, *(f for f in clean if f not in toxic)]
    for k in range(0, len(names), 100_000):
        part = names[k : k + 100_000]
        counts = [[d.get(f, 0) for f in part] for d in (toxic, clean, context)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=["feature", "toxic", "clean", "context"])


def learn_lexicon(examples: DataFrame) -> dict[str, float]:
    """Words and stems (`stem*`) with their log-odds. examples: text, label 0/1; bounded by the caller.

    A word counts once for each text. It must follow many different words, so that texts copied many times don't make
    their own words into insults.
    """
    found = examples.mapInArrow(_feature_counts, "feature string, toxic long, clean long, context long").groupBy("feature")
    found = found.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("context").alias("context"))
    n = examples.groupBy("label").agg(F.count("*").alias("n")).collect()
    n = {int(r["label"]): r["n"] for r in n}
    odds = F.log((F.col("toxic") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (n.get(0, 0) + 1))
    kept = found.withColumn("odds", odds).where((F.col("odds") >= MIN_ODDS) & (F.bit_count("context") >= MIN_CONTEXTS))
    return {r["feature"]: r["odds"] for r in kept.select("feature", "odds").collect()}  # words of at most FIT_ROWS texts


FEATURES = ["total", "best", "rate"]


def clause_scores(df: DataFrame, lexicon: dict[str, float], text_col: str, names: list[str]) -> DataFrame:
    """df with the three scores of each text, so named."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])
    held = df.sparkSession.sparkContext.broadcast(lexicon)  # words of the bounded sample

    def run(batches):
        own, machine = Lexicon(held.value), compose(GRAMMAR)
        for whole in batches:
            for batch in slices(whole, text_col):
                rows = [score_text(t or "", own, machine) for t in batch.column(text_col).to_pylist()]
                arrays = [pa.array([r[i] for r in rows], pa.float64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=schema.names)

    return df.mapInArrow(run, schema)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    held_out_modulus: int = 5, fit_rows: int = FIT_ROWS, names: tuple[str, str] = ("score", "held_out"),
) -> DataFrame:
    """docs with a score (probability that the label is 1) and held_out (crc32 of the id as text mod 5 is 0; null id: empty).

    Learns only from labelled rows that aren't held out, each text once; rows with a null label are not used. Of several
    labels of an id, or of rows with the same text, the largest holds. With no labels, or only one kind, every score is the
    share of label 1 (0 if there is none). Null texts count as empty. All columns of docs pass through; names must be free
    (free_names makes such). Repeated rows are scored each; an empty table stays empty.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(held_out_modulus))
    marks = labels.select(F.col(id_col).alias("own"), F.col(label_col).cast("int").alias("label")).where("label is not null")
    marks = marks.groupBy("own").agg(F.max("label").alias("label"))
    known = docs.select(F.col(id_col).alias("own"), F.coalesce(text_col, F.lit("")).alias("text"), fold.alias("fold")).where("fold <> 0").drop("fold")
    labelled = marks.count()
    share = min(1.0, fit_rows / max(1, labelled))
    marks = marks.where(F.pmod(F.xxhash64("own"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    examples = known.hint("merge").join(marks, "own").groupBy("text").agg(F.max("label").alias("label"))
    examples = cut(examples, "examples")
    seen = {int(r["label"]): r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    held = (fold == 0).alias(names[1])
    if len(seen) < 2:
        only = float(next(iter(seen), 0))
        return docs.select("*", F.lit(only).alias(names[0]), held)
    lexicon = learn_lexicon(examples)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    fitted = cut(clause_scores(examples, lexicon, "text", FEATURES).select("label", *FEATURES), "fit")
    model = LogisticRegression(featuresCol="features", labelCol="label", regParam=1e-3, maxIter=50).fit(assembler.transform(fitted))
    own = free_names(docs, *FEATURES)
    scored = clause_scores(docs, lexicon, text_col, own)
    logit = F.lit(float(model.intercept))
    for c, w in zip(own, model.coefficients.toArray(), strict=True):
        logit = logit + F.col(c) * float(w)
    return scored.select(*docs.columns, (1 / (1 + F.exp(-logit))).alias(names[0]), held)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score_toxicity by doc_id, and predicted: 1 from 0.5 on. Nulls, ties, repeats and empty tables as there."""
    scored = score_toxicity(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score under 0.5, with the columns of docs, whatever their names.

    Null and empty texts are scored as empty; repeated rows share their fate; without labels of both kinds the share of label 1
    is every row's score; an empty table stays empty.
    """
    names = tuple(free_names(docs, "score", "held_out"))
    return score_toxicity(docs, labels, names=names).where(F.col(names[0]) < 0.5).select(*docs.columns)
