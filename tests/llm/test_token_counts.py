import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from docquarry.llm import bpe, token_counts

PATH = P.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "\n", "a \n b", "a\n b", "a\n\n  b", "x  ", "x \n", "don't we'll 'r", "'ll 're '", "a<|endoftext|>b", "a <|endoftext|><|endoftext|> <|endof", "éè  ñ  ü", "日本語 テスト。", "\x1c \x1d a", "a" * 300, "=" * 90 + " " * 70 + "z", "3.14 100,000 x1y2", "🙂🙃 👍🏽", "　 b  c", "\r\n\r\n d\t\te"]


def library():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x, add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(7)
    letters = [*"abcst'  \n\té1,.<|", " ", "'s", "'re", " th", "<|endoftext|>", "\x1c", "語"]
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(400)]


def test_ids_equal_the_library():
    encode, v = library(), bpe.from_json(PATH, P.PATTERN)
    for text in odd_texts():
        assert memoryview(v.packed_ids(text)).cast("B").tobytes() == b"".join(i.to_bytes(4, "little") for i in encode(text)), repr(text)


def test_every_prefix_equals_the_library():
    encode, counter = library(), token_counts.counter(PATH, P.PATTERN)
    for text in odd_texts():
        counts = counter.counts(text)
        assert [len(encode(text[: i + 1])) for i in range(len(text))] == counts.tolist(), repr(text)
        stored = token_counts.store(counts)
        assert token_counts.load(stored).tolist() == counts.tolist()
        for k in (0, 1, len(text) // 2, len(text) + 5):
            assert token_counts.tokens_in(stored, k) == len(encode(text[:k]))


def test_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (None, "", "y"), (3, "word " * 600, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit, r.chars_in_limit) for r in token_counts.count_tokens(df, PATH, P.PATTERN).collect()))
    n = len(library()("word " * 600))
    assert got == [(0, 0, 0, False, 0), (1, 5, 3, False, 5), (1, 5, 3, False, 5), (2, 0, 0, False, 0), (3, 3000, n, True, len("word " * 512) - 1)]
    assert token_counts.count_tokens(df.limit(0), PATH, P.PATTERN).count() == 0
