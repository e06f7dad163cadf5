"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases; a shunting-yard parser evaluates
and/or/with expressions that follow a tag."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kgspark.llm.text import ALNUM, free_names, slices, utf8

#: Phrases of the contract and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Further notice phrases: (words, label, weight as evidence). Words are those of the normalised text.
NOTICES = [
    ("gnu general public license version 2", "gpl-2.0", 0.9),
    ("gnu general public license version 3", "gpl-3.0", 0.9),
    ("gnu lesser general public license", "lgpl", 0.9),
    ("gnu affero general public license", "agpl", 0.9),
    ("gnu free documentation license", "gfdl", 0.9),
    ("apache license version 2 0", "apache-2.0", 0.9),
    ("mozilla public license", "mpl", 0.8),
    ("eclipse public license", "epl", 0.8),
    ("bsd license", "bsd", 0.7),
    ("redistribution and use in source and binary forms", "bsd", 0.9),
    ("boost software license", "bsl", 0.8),
    ("isc license", "isc", 0.7),
    ("permission is hereby granted free of charge", "mit", 0.8),
    ("released into the public domain", "public-domain", 0.7),
    ("all rights reserved", "proprietary", 0.5),
    ("creative commons attribution", "cc-by", 0.8),
    ("cc by sa", "cc-by-sa", 0.9),
    ("cc by nc", "cc-by-nc", 0.9),
    ("cc by nd", "cc-by-nd", 0.9),
    ("cc by nc sa", "cc-by-nc-sa", 0.9),
    ("cc by nc nd", "cc-by-nc-nd", 0.9),
    ("cc by 4 0", "cc-by-4.0", 0.9),
    ("cc by nc 4 0", "cc-by-nc-4.0", 0.9),
    ("cc by sa 4 0", "cc-by-sa-4.0", 0.9),
    ("cc0 1 0", "cc0-1.0", 0.9),
]
#: The tag whose expression is parsed; its words in the normalised text.
TAG = "spdx license identifier"
BASE_WEIGHT, TAG_WEIGHT = 0.7, 0.95

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9.+:-]+)")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def postfix_of(text: str) -> tuple[list[str], str] | None:
    """An expression that text starts with, as postfix and as it stands; None if it is malformed.

    Shunting-yard with precedence with > and > or, left-associative, parentheses. The expression ends where a token can't
    continue it: at a word that follows a license without an operator, at another sign, or at the end.
    """
    output: list[str] = []
    operators: list[str] = []
    seen: list[str] = []
    opened, at, operand = 0, 0, True  # operand: what may come next
    while found := _TOKEN.match(text, at):
        token, at = found[1], found.end()
        low = token.lower()
        if low in _PRECEDENCE:
            if operand:
                return None
            while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= _PRECEDENCE[low]:
                output.append(operators.pop())
            operators.append(low)
            operand = True
            low = low.upper()
        elif token == "(":
            if not operand:
                break
            operators.append(token)
            opened += 1
        elif token == ")":
            if operand:
                return None
            if not opened:  # closes something before the expression
                break
            while operators[-1] != "(":
                output.append(operators.pop())
            operators.pop()
            opened -= 1
        elif operand:
            low = low.rstrip(".:")
            output.append(low)
            operand = False
        else:
            break
        seen.append(low)
    if operand or opened:
        return None
    return output + operators[::-1], " ".join(seen).replace("( ", "(").replace(" )", ")")


def evaluate(postfix: list[str]) -> list[str] | None:
    """The licenses of an expression in order; `x with e` is one. None if `with` does not stand between two names."""
    stack: list[tuple[int, bool]] = []  # where an operand's names start, and whether it is one plain name
    names: list[str] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            stack.append((len(names), True))
            names.append(token)
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            if not (left[1] and right[1]):
                return None
            exception = names.pop()
            names[-1] += f" with {exception}"
        stack.append((left[0], False))
    return list(dict.fromkeys(names))


def parse_expression(text: str) -> tuple[list[str], str] | None:
    """The licenses of the expression that text starts with, and the expression; None if it is malformed. Linear in its length."""
    found = postfix_of(text)
    names = evaluate(found[0]) if found else None
    return (names, found[1]) if names else None


def build_automaton(base: dict[str, str] | None = None) -> ahocorasick.Automaton:
    base = BASE if base is None else base
    found = ahocorasick.Automaton()
    patterns = {p: [("base", label, BASE_WEIGHT)] for p, label in base.items()}
    for phrase, label, weight in NOTICES:
        patterns.setdefault(phrase, []).append(("notice", label, weight))
    patterns[TAG] = [("tag", "", TAG_WEIGHT)]
    for phrase, what in patterns.items():
        found.add_word(f" {phrase} ", (len(phrase), what))
    found.make_automaton()
    return found


def scan_text(raw: bytes, found: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score, expressions of one text."""
    words = raw.translate(ALNUM).split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    matches = list(found.iter(joined))
    if not matches:
        return len(words), 0, None, None, "", "", 0.0, []
    spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
    places, base, labels, expressions, miss = [], set(), set(), [], 1.0
    ends = None
    for end, (n, what) in matches:
        at = int(np.searchsorted(spaces, end - n - 1))
        for kind, label, weight in what:
            if kind == "base":
                places.append(at)
                base.add(label)
            if kind == "tag":
                if ends is None:
                    ends = [m.end() for m in _WORD.finditer(raw.lower())]
                start = ends[at + TAG.count(" ")]
                line_end = raw.find(b"\n", start)
                rest = raw[start : line_end if line_end >= 0 else len(raw)].lstrip(b" \t:=").decode("utf-8", "replace")
                parsed = parse_expression(rest)
                if parsed is None:
                    continue
                expressions.append(parsed[1])
                labels.update(parsed[0])
            else:
                labels.add(label)
            miss *= 1 - weight
    labels |= base
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - miss, expressions


SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("expressions", T.ArrayType(T.StringType())),
    ]
)


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs and what scan_text finds in each whole text. An expression ends with its line at the latest.

    Null and empty texts have no words, no labels and score 0. Places count repeats and overlaps. score is one minus the
    product of (1 - weight) over all evidence: 0 without any, near 1 with much. A malformed expression adds no label.
    Rows are independent: repeated rows give repeated results; an empty table gives an empty one; columns not in `keep`
    are ignored, and one in `keep` that has the name of a result keeps it, the result getting a `_` more. Narrow: no shuffle.
    """
    kept = [f for f in docs.schema.fields if f.name in keep]
    (own,) = free_names(docs, "text")
    chosen = docs.select(*[f.name for f in kept])
    names = free_names(chosen, *SCHEMA.fieldNames())
    schema = T.StructType([*kept, *[T.StructField(n, f.dataType) for n, f in zip(names, SCHEMA.fields, strict=True)]])

    def run(batches):
        found = build_automaton()
        arrow = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
        for whole in batches:
            for batch in slices(whole, own):
                rows = [scan_text(x, found) for x in utf8(batch.column(own))]
                new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    return docs.select(*[f.name for f in kept], docs[text_col].alias(own)).mapInArrow(run, schema)
