import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docquarry.llm import packing

PATH = P.path("byte_bpe_50k.json")


def best_fit_decreasing(lengths, capacity):
    """Gaps after each document has gone to the tightest one that holds it."""
    gaps, sequences = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(gaps, n)
        if at < len(gaps):
            insort(gaps, gaps.pop(at) - n)
        else:
            insort(gaps, capacity - n)
            sequences += 1
    assert sequences == len(gaps)
    return gaps


def used(counts, capacity):
    """Checks that each rank has one place and places do not overlap; the room left by sequence, sorted."""
    ranks, places = defaultdict(list), []
    for length, first, count, sequence, offset in packing.plan(counts, capacity):
        ranks[length].append((first, count))
        places += [(sequence + k, offset, length) for k in range(count)]
    for n, c in counts.items():
        at = 0
        for first, count in sorted(ranks.pop(n, [])):
            assert first == at and count > 0
            at += count
        assert at == c
    ends = {}
    for sequence, offset, length in sorted(places):
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length
    assert not ranks and set(ends) == set(range(len(ends))) and max(ends.values(), default=0) <= capacity
    return sorted(capacity - x for x in ends.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_equals_best_fit_decreasing(lengths):
    assert used(Counter(lengths), 64) == best_fit_decreasing(lengths, 64)


@pytest.mark.parametrize("low, high", [(200, 400), (300, 600), (1, 1024), (1, 60)])
def test_plan_equals_best_fit_decreasing_on_many(low, high):
    lengths = np.random.default_rng(low).integers(low, high + 1, 40_000).tolist()
    assert used(Counter(lengths), 1024) == best_fit_decreasing(lengths, 1024)


def test_pieces_and_places(spark):
    texts = ["a b c", "a b c", None, "", "word " * 5000, "the cat " * 400, *(f"text {i} " * (i % 90) for i in range(300))]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, "x", 0), (0, "a b c", 0)], "doc_id long, text string, offset int")
    encode = Tokenizer.from_file(PATH)
    rows = packing.pack(packing.token_pieces(df, PATH, P.PATTERN)).collect()
    want = defaultdict(list)
    for i, t in [*enumerate(texts), (None, "x"), (0, "a b c")]:
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for piece, start in enumerate([0, *range(first, len(ids), 1024)] if len(ids) > 1024 else [0]):
            own = ids[start : (first if piece == 0 else start + 1024) if len(ids) > 1024 else None]
            want[i, piece].append((start, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece].append((r.start, r.length, r.ids_crc32))
    assert got == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(by) <= -(-sum(r.length for r in rows) // 1024) + 2
    assert packing.pack(packing.token_pieces(df.limit(0), PATH, P.PATTERN)).count() == 0
