"""Exact token counts of every prefix, by dynamic programming.

For each place in a piece, the last token of the prefix that ends there is the
one token that may follow the last token of the prefix before it, and the count
is one more than there. Pieces repeat, so their counts are kept; a text's
counts are those of its parts, shifted. The counts are stored as differences,
and answer truncation and budget questions without encoding again.
"""

from __future__ import annotations

import operator
import re
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docquarry.llm import bpe, shared

LIMIT = 512
#: Bytes that a worker keeps of words' counts, and as many of pieces', about: counting a word again takes a hundred times as long as finding it.
MEMO_BYTES = 220_000_000
#: Pairs of tokens of which a worker keeps whether one may follow the other; some 200 bytes each.
FOLLOWS = 500_000
_SPACE_BEFORE = re.compile(r"\s(?= \S)")


class PrefixCounts:
    """Counts for each code-point prefix of texts, as the library counts each prefix by itself."""

    def __init__(self, vocabulary: bpe.Vocabulary):
        self.v = vocabulary
        self.encode_piece = vocabulary.core._core_bpe.encode_single_piece
        self.names = vocabulary.names
        self.longest = max(map(len, vocabulary.ranks))
        self.follows: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.room = MEMO_BYTES
        self.words = bpe.Words(self._steps, MEMO_BYTES)

    def _steps(self, part: str) -> bytes | None:
        """Differences of a part's counts, one byte each; None where one needs more."""
        counts = self.segment(part)
        try:
            return array("b", map(operator.sub, counts, [0, *counts])).tobytes()
        except OverflowError:
            return None

    def _fits(self, last: int, token: int) -> bool:
        """Whether the encoding of both tokens' bytes is these tokens; last is -1 at the start."""
        known = self.follows.get((last, token))
        if known is None:
            known = self.encode_piece(self.names.get(last, b"") + self.names[token]) == ([token] if last < 0 else [last, token])
            if len(self.follows) < FOLLOWS:
                self.follows[last, token] = known
        return known

    def piece(self, piece: str) -> list[int]:
        """Counts after each character of a string that the pattern keeps whole."""
        found = self.pieces.get(piece)
        if found is None:
            raw, ranks = piece.encode(), self.v.ranks
            last, count = [-1], [0]
            follows, longest = self.follows, self.longest
            for stop in range(1, len(raw) + 1):
                for start in range(stop - 1, stop - longest - 1 if stop > longest else -1, -1):
                    token = ranks.get(raw[start:stop])
                    if token is not None:
                        fits = follows.get((last[start], token))
                        if fits is None:
                            fits = self._fits(last[start], token)
                        if fits:
                            last.append(token)
                            count.append(count[start] + 1)
                            break
            ends = np.cumsum([len(c.encode()) for c in piece]) if len(raw) != len(piece) else range(1, len(raw) + 1)
            found = [count[e] for e in ends]
            if self.room > 0 and len(piece) <= bpe.MEMO_LONGEST:
                self.pieces[piece] = found
                self.room -= bpe.ENTRY_BYTES + 9 * len(piece)
        return found

    def segment(self, text: str) -> list[int]:
        """Counts after each character of an ordinary string."""
        out: list[int] = []
        base, run, before = 0, "", 0
        for piece in self.v.pattern.findall(text):
            if regex_space(piece):
                run, before = run + piece, before if run else base
                out += [before + n for n in self.piece(run)[len(run) - len(piece) :]]
                base += self.piece(piece)[-1]
                continue
            if run and piece[0] == " ":
                out.append(before + self.piece(run + " ")[-1])
                out += [base + n for n in self.piece(piece)[1:]]
            elif piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():
                out += [base + 1, base + 1 + self.piece(piece[1])[-1], base + self.piece(piece)[-1]]
            else:
                out += [base + n for n in self.piece(piece)]
            base += self.piece(piece)[-1]
            run = ""
        return out

    def ordinary(self, text: str) -> np.ndarray:
        """Counts after each character of a string without special strings."""
        parts = bpe.parts_of(text)
        rows = list(map(self.words.__getitem__, parts[1:]))
        if None in rows:
            steps = [np.diff(self.segment(x), prepend=0) for x in (parts[0], *(" " + p for p in parts[1:])) if x]
            out = np.cumsum(np.concatenate(steps), dtype=np.int64)
        else:
            out = np.cumsum(np.frombuffer(b"".join(rows), np.int8), dtype=np.int64)
            if parts[0]:
                first = np.array(self.segment(parts[0]), np.int64)
                out = np.concatenate([first, first[-1] + out])
        for m in _SPACE_BEFORE.finditer(text):  # a space that ends a longer run of white space, seen as a prefix's end
            at = m.end()
            first = at
            while first and regex_space(text[first - 1]):
                first -= 1
            run = text[first : at + 1]
            out[at] = (out[first - 1] if first else 0) + self.piece(run)[-1]
        return out

    def counts(self, text: str) -> np.ndarray:
        """Counts after each character of any text, special strings as one token each."""
        segments = self.v.segments(text)
        if len(segments) == 1:
            return self.ordinary(text)
        out, base = [], 0
        for k, segment in enumerate(segments):
            if k % 2:
                before = segments[k - 1]
                partial = [self.ordinary(before + segment[:j])[-1] for j in range(1, len(segment))]
                start = base - (int(self.ordinary(before)[-1]) if before else 0)
                out.append(np.array([*(start + int(n) for n in partial), base + 1], dtype=np.int64))
            elif segment:
                out.append(base + self.ordinary(segment))
            base = int(out[-1][-1]) if out else 0
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def regex_space(text: str) -> bool:
    """White space in the pattern's sense, which leaves out four control characters that str.isspace takes in."""
    return text.isspace() and not any("\x1c" <= c <= "\x1f" for c in text)


@cache
def counter(path: str, pattern: str) -> PrefixCounts:
    return PrefixCounts(bpe.from_json(path, pattern))


def store(counts: np.ndarray) -> bytes:
    """Differences of the counts, deflated; the first byte is the width of one difference."""
    steps = np.diff(counts, prepend=0)
    width = next(w for w in (1, 2, 4) if not steps.size or max(steps.max(), -steps.min()) < 1 << (8 * w - 1))
    return bytes([width]) + zlib.compress(steps.astype(f"<i{width}").tobytes(), 1)


def load(stored: bytes) -> np.ndarray:
    """The counts that ``store`` kept."""
    return np.cumsum(np.frombuffer(zlib.decompress(stored[1:]), f"<i{stored[0]}"), dtype=np.int64)


def tokens_in(stored: bytes, chars: int) -> int:
    """Exact token count of the first ``chars`` characters."""
    counts = load(stored)
    return int(counts[min(chars, counts.size) - 1]) if chars > 0 and counts.size else 0


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    fitting = np.flatnonzero(counts <= budget)
    return int(fitting[-1]) + 1 if fitting.size else 0


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, limit: int = LIMIT, keep_prefixes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, chars_in_limit and the stored prefix counts.

    Null text counts as empty: no bytes, no tokens. Repeated rows and null ids
    are kept as they are; other columns are ignored. Whole texts count, however long, each in one task;
    an empty table gives no rows.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_in_limit long" + ", prefix_counts binary" * keep_prefixes
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("chars_in_limit", pa.int64())] + [("prefix_counts", pa.binary())] * keep_prefixes)

    def count(doc_ids: list, texts: list) -> dict:
        own = counter(tokenizer, pattern)
        all_counts = [own.counts(t or "") for t in texts]
        totals = [int(c[-1]) if c.size else 0 for c in all_counts]
        out = {"doc_id": doc_ids, "n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": totals, "over_limit": [n > limit for n in totals], "chars_in_limit": [longest_within(c, limit) for c in all_counts]}
        return out | ({"prefix_counts": [store(c) for c in all_counts]} if keep_prefixes else {})

    return shared.map_texts(docs, count, schema, arrow)
