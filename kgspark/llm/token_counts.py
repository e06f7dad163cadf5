"""Token counts by a compiled finite-state tokenizer.

Bytes of a pre-token drive a deterministic transducer whose transitions are annotated with the change in the number of
emitted tokens. States are determinised on demand: the last token after a further byte is the one suffix token that the
token before it accepts, two tokens being compatible if the merges leave them as they are. A text is cut into blocks; each block gives a map from
the state before it to the state after it and the tokens between, and the maps of a text compose by a parallel prefix scan.
"""

from __future__ import annotations

import json
from functools import lru_cache
from unicodedata import category

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.text import free_names, slices

#: White space of the tokenizers' patterns (the Unicode property).
_WS = "\t-\r \x85\xa0  -     　"
#: Chunks: a run of white space and the word after it. A pre-token never reaches over the start of such a run.
_CHUNK = regex.compile(f"[{_WS}]*+[^{_WS}]++|[{_WS}]++")
_PRETOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
)
#: Characters of a block, states of a transducer, chunks in the memo and characters of one. Beyond, tables are dropped and built anew.
BLOCK_CHARS, MAX_STATES, MAX_CHUNKS, MAX_CHUNK = 1 << 16, 300_000, 500_000, 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in vocabularies of byte-level tokenizers."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


class Transducer:
    """A deterministic transducer over the bytes of a pre-token, built as far as texts need it.

    A state is (suffix, history): the longest suffix of the bytes read that begins some token, and for each position in it
    where a token may begin, the last token before that position and how many tokens fewer the encoding had there. Prefixes
    that agree in this share the state, so that states follow the vocabulary and not the number of words.
    """

    def __init__(self, ranks: dict[tuple[bytes, bytes], int], tokens: set[bytes], max_states: int = MAX_STATES):
        self.ranks, self.tokens, self.max_states = ranks, {t: t for t in tokens}, max_states
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for (a, b), rank in ranks.items():
            self.made.setdefault(self.tokens.get(a + b, a + b), (rank, a, b))
        self.begins = {t[:i] for t in tokens for i in range(1, len(t) + 1)} | {b""}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = (b"", ((0, b"", 0),))
        self.number: dict[tuple, int] = {start: 0}
        self.states: list[tuple] = [start]
        self.next: dict[int, int] = {}  # state * 256 + byte: next state * 65536 + change + 32768

    def compatible(self, left: bytes, right: bytes) -> bool:
        """Whether no merge joins the two tokens: the merges at the seam are undone, the later one of the two first."""
        found = self.pairs.get((left, right))
        if found is not None:
            return found
        if len(self.pairs) >= self.max_states:
            self.pairs.clear()
        rank, made = self.ranks, self.made
        x, y, bound, found = left, right, 1 << 60, True
        while True:
            if rank.get((x, y), 1 << 60) < bound:
                found = False
                break
            at_x, at_y = made.get(x), made.get(y)
            if at_x is None and at_y is None:
                break
            if at_y is None or at_x is not None and at_x[0] > at_y[0]:
                bound, x = at_x[0], at_x[2]  # merges up to this one's own rank have been tried with the right part
            else:
                bound, y = at_y[0] + 1, at_y[1]
        self.pairs[left, right] = found
        return found

    def determinise(self, state: int, byte: int) -> int:
        """Adds the transition of state on byte: the next state and the change of the number of tokens."""
        suffix, history = self.states[state]
        grown = suffix + bytes((byte,))
        for at, last, fewer in history:  # the longest candidate first
            token = self.tokens.get(grown[at:])
            if token is not None and (not last or self.compatible(last, token)):
                delta = 1 - fewer
                break
        else:
            raise ValueError(f"no token ends {grown!r}")
        kept = [(at, last, fewer + delta) for at, last, fewer in history if grown[at:] in self.begins]
        first = kept[0][0] if kept else len(grown)
        key = (grown[first:], (*((at - first, last, fewer) for at, last, fewer in kept), (len(grown) - first, token, 0)))
        target = self.number.setdefault(key, len(self.states))
        if target == len(self.states):
            self.states.append(key)
        step = self.next[state << 8 | byte] = (target << 16) + delta + 32768
        return step

    def run(self, text: bytes) -> int:
        """Tokens of a pre-token: the sum of the annotations on its path."""
        if len(self.states) > self.max_states:
            self.reset()
        state = total = 0
        follow = self.next
        for byte in text:
            step = follow.get(state << 8 | byte) or self.determinise(state, byte)
            state = step >> 16
            total += step & 65535
        return total - 32768 * len(text)


class TokenCounter:
    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        tokens = {raw(t) for t in spec["model"]["vocab"] if t not in self.special}
        self.transducer = Transducer(ranks, tokens)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.memo: dict[str, int] = {}
        self.vocabulary, self.library = vocabulary, None
        self.classes: dict[str, str] = {}

    def pretoken(self, text: str) -> int:
        found = self.memo.get(text)
        if found is None:
            found = self.transducer.run(text.encode())
            if len(text) <= MAX_CHUNK:
                self.memo[text] = found
        return found

    def chunk(self, text: str) -> int:
        """Tokens of text that starts and ends where chunks do."""
        body = text[1:] if text[0] == " " else text
        if body.isalpha():
            return self.transducer.run(text.encode())
        if body[:-1].isalpha() and body[-1] in ".,;:!?":
            return self.pretoken(text[:-1]) + self.pretoken(text[-1])
        if text[0] == "\n" and body[1:].isalpha():
            return self.pretoken("\n") + self.pretoken(text[1:])
        parts, extra = [text], 0
        if self.cut and any(s in text for s in self.special):
            parts = self.cut.split(text)
            extra = len(parts) - 1
        return extra + sum(self.transducer.run(p.encode()) for part in parts for p in self.pretokens(part))

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of text. Versions of Unicode differ in the characters they know, and the library's decides: one that
        this Python doesn't know is looked for as a letter, digit or mark of the library's class."""
        if text.isascii() or not any(category(c) == "Cn" for c in set(text)):
            return _PRETOKEN.findall(text)
        like = "".join(self.stand_in(c) if category(c) == "Cn" else c for c in text)
        return [text[m.start() : m.end()] for m in _PRETOKEN.finditer(like)]

    def stand_in(self, char: str) -> str:
        found = self.classes.get(char)
        if found is None:
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.vocabulary).pre_tokenizer
            joins = lambda c: len(self.library.pre_tokenize_str(c + char)) == 1
            found = self.classes[char] = "a" if joins("a") else "1" if joins("1") else "!"
        return found

    def chunks(self, texts: list[str]) -> int:
        memo = self.memo
        try:
            return sum(map(memo.__getitem__, texts))
        except KeyError:
            if len(memo) > MAX_CHUNKS:
                memo.clear()
            total = 0
            for t in texts:
                n = memo.get(t)
                if n is None:
                    n = self.chunk(t)
                    if len(t) <= MAX_CHUNK:
                        memo[t] = n
                total += n
            return total

    def block_map(self, block: str) -> tuple:
        """(head, tokens, tail): head ends the chunk that is open before the block, tail opens the one after it.

        tokens None: the block lies inside one chunk, which head holds.
        """
        found = _CHUNK.findall(block)
        if len(found) < 2:
            # white space at either end may belong to the neighbour's chunk
            return (block, None, "")
        return (found[0], self.chunks(found[1:-1]), found[-1])

    def compose(self, left: tuple, right: tuple) -> tuple:
        """The map of two adjacent blocks; associative."""
        if left[1] is None and right[1] is None:
            return self.block_map(left[0] + right[0])
        if left[1] is None:
            inner = self.block_map(left[0] + right[0])
            if inner[1] is None:
                return (inner[0], right[1], right[2])
            return (inner[0], inner[1] + self.chunks([inner[2]]) + right[1], right[2])
        if right[1] is None:
            inner = self.block_map(left[2] + right[0])
            if inner[1] is None:
                return (left[0], left[1], inner[0])
            return (left[0], left[1] + self.chunks([inner[0]]) + inner[1], inner[2])
        seam = _CHUNK.findall(left[2] + right[0])
        return (left[0], left[1] + self.chunks(seam) + right[1], right[2])

    def count(self, text: str, block_chars: int = BLOCK_CHARS) -> int:
        if len(text) <= block_chars:
            return self.chunks(_CHUNK.findall(text))
        maps = [self.block_map(text[i : i + block_chars]) for i in range(0, len(text), block_chars)]
        while len(maps) > 1:  # neighbours compose pairwise, as in the up-sweep of a scan
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, tokens, tail = maps[0]
        return self.chunks(_CHUNK.findall(head)) + (tokens or 0) + self.chunks(_CHUNK.findall(tail))


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> TokenCounter:
    """One for each Python worker, kept over tasks."""
    return TokenCounter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """docs with out_col: the tokens of each whole text; a null text has none.

    Columns of docs pass through; if out_col is among them, the count's name gets a `_` more; repeated rows are counted each;
    an empty table stays empty. Narrow: no shuffle. vocabulary: path of a byte-level vocabulary file that all executors have.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(free_names(docs, out_col)[0], T.LongType())])

    def run(batches):
        own = counter(vocabulary)
        for whole in batches:
            for batch in slices(whole, text_col):
                n = [own.count(x) if x else 0 for x in batch.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def token_report(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """count_tokens by doc_id, with the bytes of the text; a null text counts as empty, repeats are counted each, an empty
    table gives an empty result, other columns are ignored."""
    counted = count_tokens(docs.select("doc_id", "text"), vocabulary)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
