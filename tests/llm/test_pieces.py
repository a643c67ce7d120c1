import hashlib
import random

import public_tokenizers as P
import sentencepiece

from docquarry.llm import pieces
from tests.llm.test_token_counts import odd_texts

PATH = P.path("piece_bpe_32k.model")


def texts():
    rnd = random.Random(7)
    bits = ["a", "b", " ", "  ", "the", "\n", "é", "日", "ing", "x", "!", "▁", "    ", "1", "<s>", "\t", "👍🏽"]
    mixed = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(50))) for _ in range(800)]
    letters = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)) for _ in range(3)]
    blanks = [" " * n + end for n in (1, 2, 15, 16, 17, 18, 31, 33, 50, 20_000) for end in ("", "the", "日", "\n x")]
    return [*odd_texts(), *mixed, *letters, *blanks, "▁", "a▁b", "</s><unk>", "<0x0A>", "x" * 70_000, "ab" * 9_000, "　ｆｕｌｌ ﬁ", "word " * 5_000]


def test_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    own = [None, *texts()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(own)] + [(None, "a b", "y"), (3, own[3], "z")], "doc_id long, text string, ids string")
    encoded = pieces.encode(df, PATH)
    rows = encoded.collect()
    assert len(rows) == len(own) + 2 and sum(r.doc_id is None for r in rows) == 1
    for r in rows:
        ids = library.encode((own[r.doc_id] if r.doc_id is not None else "a b") or "")
        text = library.decode(ids)
        assert (r.n_tokens, list(r.ids), r.decoded) == (len(ids), ids, text), repr(own[r.doc_id or 0])[:80]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sorted(r.decoded for r in pieces.decode(encoded, PATH).collect()) == sorted(r.decoded for r in rows)
    assert pieces.encode(df.limit(0), PATH).count() == 0


def test_a_full_memo_is_emptied(monkeypatch):
    own = pieces.Pieces(PATH)
    own.room = 10
    own.learn({" some", " words"})
    own.forget()
    assert not own.ids_of and own.room > 10


def test_a_round_stops_where_a_new_pair_comes_first():
    """Runs of blanks merge one by one from the left, not all pairs at once."""
    own = pieces.from_model(PATH)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for n in range(2, 60):
        flat, _ = own.encode_words([" " * n])
        assert flat.tolist() == library.encode("▁" * (n - 1))


def test_places_of_numbers():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 2**50, 20_000))
    places = pieces.Places(keys)
    at, hit = places.find(keys)
    assert hit.all() and (keys[at] == keys).all()
    assert not places.find(keys + 2**51)[1].any()
    assert not pieces.Places(np.zeros(0, np.int64)).find(keys)[1].any()
