import hashlib

import public_tokenizers as P
import regex
import tiktoken

from docquarry.llm import bpe, bpe_fold
from tests.llm.test_token_counts import odd_texts

PATH = P.path("byte_bpe_50k.tiktoken")


def test_fold_equals_the_library(spark):
    texts = [None, *odd_texts(), "x" * 70, "ab" * 5000, "the the the " * 3000, " ".join(f"w{i}" for i in range(5000)) * 3]
    ranks = bpe.from_ranks(PATH, P.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "y"), (3, texts[3], "z")], "doc_id long, text string, ids string")
    rows = bpe_fold.encode(df, PATH, P.PATTERN).collect()
    assert len(rows) == len(texts) + 2 and sum(r.doc_id is None for r in rows) == 1
    for r in rows:
        text = (texts[r.doc_id] if r.doc_id is not None else "a b") or ""
        ids = library.encode_ordinary(text)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, bytes(r.ids), bytes(r.decoded)) == (len(ids), packed, text.encode()), repr(text)
        assert (r.ids_sha256, r.decoded_sha256) == (hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe_fold.encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_every_pair_has_its_slot():
    slots = bpe_fold.rank_slots(PATH, P.PATTERN)
    assert (slots >= 0).sum() == len(bpe_fold.pair_ranks(bpe.from_ranks(PATH, P.PATTERN).ranks))


def test_letters_after_a_blank_are_one_piece():
    assert P.PATTERN.startswith(bpe_fold.LETTERS)
    for word in ["a", "Word", "s", "re", "ll", "t", "d", "x" * 300]:
        assert regex.findall(P.PATTERN, f" {word}") == [f" {word}"]


def test_folded_words_of_all_lengths(spark):
    """Words that come three times, so that they are folded, up to the longest: runs whose merges tie, letters beyond ASCII, stops and commas."""
    words = [w[:n] for n in (1, 2, 7, 31, 63) for w in ("a" * 64, "ab" * 32, "the" * 22, "aab" * 22, "zqx" * 22)] + ["größe", "AIÉ", "ñandú", "word,", "größe.", "x,.", ",", ".", "営収", "営収,", "a1,", "it's."]
    text = " ".join(words * 3) + " end."
    ranks = bpe.from_ranks(PATH, P.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    row = bpe_fold.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, P.PATTERN).first()
    assert bytes(row.ids) == b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(text)) and bytes(row.decoded) == text.encode()
    assert "array_position" not in bpe_fold.fold_sql()


def test_letters_are_those_of_the_pattern():
    letter = regex.compile(r"\p{L}")
    for c in map(chr, range(ord(bpe_fold._SAME_LETTERS))):
        assert c.isalpha() == bool(letter.match(c)), repr(c)
        if c.isalpha():
            assert regex.findall(P.PATTERN, f" {c}{c},") == [f" {c}{c}", ","] and regex.findall(P.PATTERN, f" a{c}.") == [f" a{c}", "."]
