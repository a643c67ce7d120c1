"""SentencePiece encoding (BPE models) by vectorised merge rounds, and decoding.

All new words of a slice of texts lie one after another in flat numpy arrays, a
symbol a place. A round finds the lowest rank among the pairs of each word by a
segmented minimum, merges every place that has it, from the left and without
overlap, and closes the gaps; words without a ranked pair left are set aside.
The library merges one place at a time, so a round stops in a word behind the
first merge that makes a pair of no higher rank: such a pair would come next.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import bpe, shared

#: The letter that stands for a space in pieces.
SPACE = "▁"
_NONE = np.int32(2**31 - 1)


class Places:
    """Places of whole numbers in an array of distinct ones, by tables of their hashes; those that share a slot go to the next table."""

    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables = keys, []
        left = np.arange(len(keys))
        while len(left):
            bits = max(8, int(16 * len(left)).bit_length())
            slots = self._slots(keys[left], bits)
            table = np.zeros(1 << bits, np.int32)
            table[slots] = left
            self.tables.append((bits, table))
            left = left[table[slots] != left]

    def _slots(self, keys: np.ndarray, bits: int) -> np.ndarray:
        shift = np.uint64(64 - bits)
        return (((keys.astype(np.uint64) + np.uint64(bits)) * self._MIX) >> shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each number, and whether it is there."""
        at, hit = np.zeros(len(wanted), np.int32), np.zeros(len(wanted), bool)
        rest = np.arange(len(wanted))
        for bits, table in self.tables:
            place = table[self._slots(wanted[rest], bits)]
            found = self.keys[place] == wanted[rest]
            at[rest[found]], hit[rest[found]] = place[found], True
            rest = rest[~found]
        return at, hit


class Pieces:
    """Pieces, ranks of pairs and places to cut of a model file."""

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        ids = {names[i]: i for i in plain}
        byte_ids = {int(names[i][3:-1], 16): i for i in range(size) if library.is_byte(i)}
        if len(byte_ids) < 256:
            raise ValueError(f"{path}: no piece for each byte")
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int32)
        self.raw = [names[i].replace(SPACE, " ").encode() for i in range(size)]
        for b, i in byte_ids.items():
            self.raw[i] = bytes([b])
        self.decimal = [b",%d" % i for i in range(size)]
        self.raw_sizes, self.decimal_sizes = (np.array([len(x) for x in names], np.int64) for names in (self.raw, self.decimal))
        # letters without a piece of their own may still be parts of one; they get numbers above the pieces
        letters = sorted({c for name in ids for c in name} - ids.keys())
        self.size, symbols = size, ids | {c: size + k for k, c in enumerate(letters)}
        self.unknown = size + len(letters)
        self.letters = np.full(0x110000, self.unknown, np.int32)
        for symbol, i in symbols.items():
            if len(symbol) == 1:
                self.letters[ord(symbol)] = i
        self.letters[ord(" ")] = self.letters[ord(SPACE)]
        scores = sorted({library.get_score(i) for i in plain}, reverse=True)
        rank_of = {score: k for k, score in enumerate(scores)}
        halves = sorted((symbols[n[:k]] * (self.unknown + 1) + symbols[n[k:]], rank_of[library.get_score(i)], i) for n, i in ids.items() for k in range(1, len(n)) if n[:k] in symbols and n[k:] in symbols)
        self.pairs = Places(np.array([h[0] for h in halves], np.int64))
        self.ranks = np.array([h[1] for h in halves] or [_NONE], np.int32)
        self.made = np.array([h[2] for h in halves] or [0], np.int32)
        # two letters that stand side by side in no piece are never merged across
        self.neighbours = Places(np.unique(np.array([int(self.letters[ord(a)]) * (self.unknown + 1) + int(self.letters[ord(b)]) for n in ids for a, b in zip(n, n[1:])], np.int64)))
        # a word starts at a blank or line end; only models without pieces across these places are cut there
        inside = any(re.search(rf"[^{SPACE}]{SPACE}", n) for n in ids)
        line = "" if any("\n" in n for n in ids) else r"\n[^ \n]*|"
        rest = f"{line} +[^ \\n]*" if line else " +[^ ]*"
        self.word = re.compile("(?s).+" if inside else rest)
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}
        self.room = bpe.MEMO_BYTES
        # a run of blanks longer than the longest piece of blanks: cut from the left, where that piece comes off first
        most = max((len(n) for n in ids if not n.strip(SPACE)), default=0)
        flat, ends = self.encode_words([" " * n for n in range(1, 3 * most + 1)])
        runs = np.split(flat, ends[:-1])
        comes_off = all(runs[n - 1].tolist() == [ids[SPACE * most], *runs[n - 1 - most].tolist()] for n in range(most + 1, 3 * most + 1))
        if most > 1 and not inside and comes_off and not any(n.startswith(SPACE * 2) for n in ids if n.strip(SPACE)):
            self.word = re.compile(f" {{{most}}}(?= )|{rest}")

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, or _NONE, and the piece that it makes."""
        at, hit = self.pairs.find(a.astype(np.int64) * (self.unknown + 1) + b)
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def words_of(self, text: str) -> list[str]:
        """The text, with the space put before it, cut where no piece reaches across; none for an empty text."""
        return self.word.findall(" " + text.replace(SPACE, " ")) if text else []

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and where those of each word end."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(w) for w in words])
        done = np.full(len(letters), -1, np.int32)
        symbol, place = self.letters[letters], np.arange(len(letters))
        first = np.zeros(len(letters), bool)
        first[np.concatenate([[0], ends[:-1]])] = True
        pairs = symbol[:-1].astype(np.int64) * (self.unknown + 1) + symbol[1:]
        first[1:] |= ~self.neighbours.find(pairs)[1]
        rank, made = self._ranked(symbol, first, np.arange(len(symbol)))
        while len(symbol):
            starts = np.flatnonzero(first)
            lengths = np.diff(np.append(starts, len(symbol)))
            best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            if (over := best == _NONE).any():
                done[place[over]] = symbol[over]
                symbol, place, first, rank, made, best = (x[~over] for x in (symbol, place, first, rank, made, best))
                continue
            taken = self._leftmost(symbol, first, rank, made, best)
            symbol[taken] = made[taken]
            stay = np.ones(len(symbol), bool)
            stay[taken + 1] = False
            changed = np.zeros(len(symbol), bool)
            changed[taken] = True
            symbol, place, first, rank, made, changed = (x[stay] for x in (symbol, place, first, rank, made, changed))
            changed[:-1] |= changed[1:]  # the pair that ends in a merged symbol
            at = np.flatnonzero(changed)
            rank[at], made[at] = self._ranked(symbol, first, at)
        return self._spelt(done, letters, ends)

    def _ranked(self, symbol: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pairs that begin at these places; none at the end of a word."""
        after = np.minimum(at + 1, len(symbol) - 1)
        rank, made = self._look_up(symbol[at], symbol[after])
        rank[(at == after) | first[after]] = _NONE
        return rank, made

    def _leftmost(self, symbol, first, rank, made, best) -> np.ndarray:
        """The places that a round merges."""
        at = np.flatnonzero(rank == best)
        new_run = np.concatenate([[True], np.diff(at) != 1])
        run_start = at[new_run][np.cumsum(new_run) - 1]
        at = at[(at - run_start) % 2 == 0]
        # pairs that a merge makes, with its right neighbour as it is and its left one merged before
        joined = np.concatenate([[False], np.diff(at) == 2]) & ~first[at]
        left = np.where(joined, made[np.maximum(at - 2, 0)], symbol[np.maximum(at - 1, 0)])
        left_rank = np.where(first[at], _NONE, self._look_up(left, made[at])[0])
        beyond = np.minimum(at + 2, len(symbol) - 1)
        right_rank = np.where((at + 2 >= len(symbol)) | first[beyond], _NONE, self._look_up(made[at], symbol[beyond])[0])
        comes_next = np.minimum(left_rank, right_rank) <= best[at]
        if not comes_next.any():
            return at
        word = np.cumsum(first)[at]
        seen = np.cumsum(comes_next) - comes_next
        opens = np.concatenate([[True], np.diff(word) != 0])
        return at[seen == seen[opens][np.cumsum(opens) - 1]]

    def _spelt(self, done: np.ndarray, letters: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids that are left, letters without a piece as their bytes, and the ends of the words."""
        left = np.flatnonzero(done >= 0)
        ids = done[left]
        behind = np.searchsorted(left, ends)
        odd = np.flatnonzero(ids >= self.size)
        if len(odd):
            spelled = [self.byte_ids[list(chr(c).encode())] for c in letters[left[odd]].tolist()]
            counts = np.ones(len(ids), np.int64)
            counts[odd] = [len(own) for own in spelled]
            stops = np.concatenate([[0], np.cumsum(counts)])
            ids, behind = np.repeat(ids, counts), stops[behind]
            ids[np.repeat(counts > 1, counts) | (ids >= self.size)] = np.concatenate(spelled)
        return ids, behind

    def learn(self, words: set[str]) -> None:
        """Memo of the ids of these words, as decimals with a comma before each, and of those texts that come back changed."""
        new = [w for w in words if w not in self.ids_of]
        ids, ends = self.encode_words(new)
        packed, raw = (b"".join(map(names.__getitem__, ids.tolist())) for names in (self.decimal, self.raw))
        stops = [np.concatenate([[0], np.cumsum(sizes[ids])])[ends].tolist() for sizes in (self.decimal_sizes, self.raw_sizes)]
        start = start_raw = 0
        for word, stop, stop_raw in zip(new, *stops):
            self.ids_of[word] = packed[start:stop]
            if (text := raw[start_raw:stop_raw].decode()) != word:
                self.text_of[word] = text
            start, start_raw = stop, stop_raw
        self.room -= len(packed) + len(raw) + bpe.ENTRY_BYTES * len(new)

    def text(self, words: list[str]) -> str:
        """What the ids of the words decode to: the words, but for those that come back changed."""
        return "".join([self.text_of.get(w, w) for w in words] if self.text_of else words)

    def forget(self, all_words: bool = False) -> None:
        """Empty the memo once it is full."""
        if all_words or self.room < 0:
            self.ids_of.clear()
            self.text_of.clear()
            self.room = bpe.MEMO_BYTES


@cache
def from_model(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model_path: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; with keep also ids (array) and decoded (text).

    The ids are the library's, without begin or end ids; ids_sha256 is of the
    decimals joined by commas. Null and empty texts have no ids. Whole texts
    are encoded, however long; a text stays in one task. Names of control
    pieces in a text are ordinary letters. Repeated rows and null ids stay,
    other columns are ignored, an empty table gives no rows.
    """

    def run(doc_ids: list, texts: list) -> dict[str, list]:
        own = from_model(model_path)
        words = [own.words_of(t or "") for t in texts]
        own.learn({w for row in words for w in row})
        out: dict[str, list] = {name: [] for name in arrow.names}
        for doc_id, row in zip(doc_ids, words):
            packed = b"".join(map(own.ids_of.__getitem__, row))[1:]
            text = own.text(row)[1:]  # without the space put before it
            made = [doc_id, packed.count(b",") + bool(packed), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
            made += [list(map(int, packed.split(b","))) if packed else [], text] * keep
            for column, value in zip(out.values(), made):
                column.append(value)
        own.forget()
        return out

    fields = [("doc_id", "long", pa.int64()), ("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())] + [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())] * keep
    arrow = pa.schema([(n, t) for n, _, t in fields])
    return shared.map_texts(docs, run, ", ".join(f"{n} {t}" for n, t, _ in fields), arrow, done=lambda: from_model(model_path).forget(True))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows with ``decoded``, the text of their ``ids``, as the library's decode gives it; null ids give null."""

    def run(batches):
        library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            texts = [None if ids is None else library.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    kept = encoded.drop("decoded")
    at = kept.columns.index("ids")
    return kept.mapInArrow(run, kept.withColumn("decoded", F.lit(None).cast("string")).schema)
