"""Longest common subsequences of many pairs of strings at once, by bit rows in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of the table of places of a batch.
TABLE = 1 << 24


def common_lengths(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The length of the longest common subsequence of each pair.

    A pair's state is a row of bits over the longer string, a zero for each
    length reached; the letters of the shorter strings are taken in step.
    """
    out = np.zeros(len(pairs), np.int64)
    ordered = sorted(range(len(pairs)), key=lambda k: (max(map(len, pairs[k])), min(map(len, pairs[k]))))
    for batch in _batches(pairs, ordered):
        out[batch] = _batch([sorted(pairs[k], key=len) for k in batch])
    return out


def _batches(pairs: list[tuple[str, str]], ordered: list[int]) -> Iterator[list[int]]:
    """Runs of pairs of like size whose tables fit."""
    batch: list[int] = []
    letters: set[str] = set()
    for k in ordered:
        more = letters.union(*pairs[k])
        if batch and (len(batch) + 1) * (len(more) + 2) * (max(map(len, pairs[k])) + 64) > TABLE:
            yield batch
            batch, more = [], set().union(*pairs[k])
        batch.append(k)
        letters = more
    if batch:
        yield batch


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after another, and the texts' lengths."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), np.array([len(t) for t in texts])


def _padded(codes: np.ndarray, sizes: np.ndarray, width: int, filling: int) -> np.ndarray:
    out = np.full((len(sizes), width), filling, np.int32)
    out[np.arange(width) < sizes[:, None]] = codes
    return out


def _batch(pairs: list[list[str]]) -> np.ndarray:
    (shorts, short_sizes), (longs, long_sizes) = (_letters([p[k] for p in pairs]) for k in (0, 1))
    known, codes = np.unique(longs, return_inverse=True)
    none = len(known)
    at_known = np.minimum(np.searchsorted(known, shorts), max(none - 1, 0))
    short_codes = np.where(known[at_known] == shorts, at_known, none) if none else np.zeros(0, np.int64)
    n, words = len(pairs), -(-int(long_sizes.max()) // 64) or 1
    where = np.zeros((n, none + 1, words * 64), bool)  # the last: letters that the longer string lacks, and filling
    where[np.arange(n)[:, None], _padded(codes, long_sizes, words * 64, none), np.arange(words * 64)] = True
    where[:, none] = False
    table = np.packbits(where, axis=2, bitorder="little").view(np.uint64).transpose(2, 0, 1).reshape(words, -1).copy()
    places = _padded(short_codes, short_sizes, int(short_sizes.max()), none).T + np.arange(n, dtype=np.int64) * (none + 1)
    row = np.full((words, n), ~np.uint64(0))
    for place in places:
        met = row & table.take(place, axis=1)
        carry = np.zeros(n, bool)
        for own, some in zip(row, met):
            total = own + some
            over = total < own
            total += carry
            over |= total < carry
            own ^= some  # without the bits that a letter met
            own |= total
            carry = over
    return words * 64 - np.bitwise_count(row).sum(0, dtype=np.int64)
