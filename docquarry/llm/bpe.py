"""Byte-level BPE on the driver's side of Arrow: a vocabulary, its merges and a memo of words.

A text is cut at every space that a visible character follows. No piece of the
splitting pattern crosses such a place, so the encodings of the parts, taken by
themselves, join to the encoding of the text; parts repeat a lot and are kept.
"""

from __future__ import annotations

import base64
import json
import re
from functools import cache

import numpy as np
import regex
import tiktoken

#: Bytes of a worker's memo of words, about; later ones are encoded each time they come. Words over MEMO_LONGEST characters are not kept.
MEMO_BYTES, MEMO_LONGEST = 64_000_000, 200
#: Bytes that an entry takes besides its key and its value: two objects and a place in a table.
ENTRY_BYTES = 200
_BOUNDARY = re.compile(r" (?=\S)")
_UNSAFE = re.compile(r" (?=\s)")
_ASCII_UNSAFE = (" \n", " \t", " \r", " \x0b", " \x0c")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 for itself, the rest from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def parts_of(text: str) -> list[str]:
    """The text cut before each space that a visible character follows; these spaces are left out."""
    parts = text.split(" ")
    if "" in parts[1:] or any(x in text for x in _ASCII_UNSAFE) or not text.isascii() and _UNSAFE.search(text):
        return _BOUNDARY.split(text)
    return parts


class Words(dict):
    """A memo from a part (without its space) to what ``make`` gives for it, bounded by ``most`` bytes."""

    def __init__(self, make, most: int = MEMO_BYTES):
        super().__init__()
        self.make, self.most, self.room = make, most, most

    def __missing__(self, part: str):
        made = self.make(" " + part)
        if self.room > 0 and len(part) <= MEMO_LONGEST:
            self[part] = made
            self.room -= ENTRY_BYTES + len(part) + len(made or b"")
        return made

    def clear(self) -> None:
        super().clear()
        self.room = self.most


class Vocabulary:
    """Ranks of byte strings, special strings and the splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, specials: dict[str, int]):
        self.ranks, self.pattern, self.specials = ranks, regex.compile(pattern), specials
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.words = Words(self._packed)
        self.names = {i: token for token, i in ranks.items()}

    def ids(self, text: str) -> list[int]:
        return self.core.encode_ordinary(text)

    def _packed(self, text: str) -> bytes:
        return np.array(self.core.encode_ordinary(text), dtype="<u4").tobytes()

    def segments(self, text: str) -> list[str]:
        """Ordinary strings at even places, special strings at odd ones."""
        return self.special_cut.split(text) if self.special_cut and any(s in text for s in self.specials) else [text]

    def packed_ids(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        out = []
        for k, segment in enumerate(self.segments(text)):
            if k % 2:
                out.append(np.array([self.specials[segment]], dtype="<u4").tobytes())
            elif segment:
                parts = parts_of(segment)
                out.append(self._packed(parts[0]))
                out.extend(map(self.words.__getitem__, parts[1:]))
        return b"".join(out)


@cache
def from_json(path: str, pattern: str) -> Vocabulary:
    """A tokenizers file of the byte-level kind; its merges must be in the order of their ids, as rank files have them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    specials = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in specials}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    order = [spec["model"]["vocab"][m] for m in merged]
    if order != sorted(order):
        raise ValueError(f"{path}: merges are not in the order of ids")
    return Vocabulary(ranks, pattern, specials)


@cache
def from_ranks(path: str, pattern: str) -> Vocabulary:
    """A rank file: one base64 byte string and its rank a line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return Vocabulary(ranks, pattern, {})
