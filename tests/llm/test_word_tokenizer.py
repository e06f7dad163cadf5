"""The word memo of packing and the token counter against the tokenizers themselves."""

import random
import string

import numpy as np
from tokenizers import Tokenizer

from kgspark.llm.packing import WordTokenizer
from kgspark.llm.queries import vocabulary
from kgspark.llm.token_counts import TokenCounter


def test_ids_equal_the_library():
    own, draw = WordTokenizer(vocabulary("word_bpe_49k.json")), random.Random(1)
    bits = [*string.printable, *"éßİΣςǅ'’ﬁ¶—́  ", "<|endoftext|>", "<|EndOfText|>", "'s", "'S", "don't", "!!", "...", "abc", "ABC", "K"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(60))) for _ in range(5000)] + ["", " ", "Plain words only and Plain again"]
    want = [np.array(e.ids, "<u4").tobytes() for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert own.ids(texts) == want
    assert own.ids(texts) == want  # from the memo
    words = ["নয়,", "বড়.", "गढ़,", "שיּ.", "é.", "ÉCOLE,"]
    assert own.ids(words) == [np.array(e.ids, "<u4").tobytes() for e in own.tokenizer.encode_batch(words, add_special_tokens=False)]


def test_ids_of_every_character():
    """Each code point alone, before a full stop, after a letter and before a contraction."""
    own = WordTokenizer(vocabulary("word_bpe_49k.json"))
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xD7A0 <= c < 0x20000 or c % 61 == 0)]
    for forms in (("{}",), ("{}.", "a{},"), ("{}'ll x", "{}'s")):
        texts = [f.format(c) for c in points for f in forms]
        for i in range(0, len(texts), 20_000):
            part = texts[i : i + 20_000]
            want = [np.array(e.ids, "<u4").tobytes() for e in own.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            assert own.ids(part) == want


def test_counts_of_every_character():
    own, library = TokenCounter(vocabulary("byte_bpe_50k.json")), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xD7A0 <= c < 0x20000 or c % 61 == 0 or 0x2A6D0 <= c < 0x32400 and c % 7 == 0)]
    for form in ("{0}", "{0}.", "a{0}1'll", "{0}'s {0}"):
        texts = [form.format(c) for c in points]
        for i in range(0, len(texts), 20_000):
            part = texts[i : i + 20_000]
            assert [own.count(t) for t in part] == [len(e.ids) for e in library.encode_batch_fast(part, add_special_tokens=False)]
    words = ["নয়,", "বড়.", "गढ़,", "שיּ.", "\u0558'll", "\U0003e94d'll"]
    assert [own.count(t) for t in words] == [len(e.ids) for e in library.encode_batch(words, add_special_tokens=False)]
