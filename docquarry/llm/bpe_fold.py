"""Byte-level BPE as a fold of higher-order functions over distinct words.

A worker splits the texts of a slice into pieces and keeps each distinct one as
an array of its bytes. Spark's higher-order functions fold the ranked merges
over these arrays: as long as some neighbours have a rank, the first of the
lowest merges. The rank map is one constant array of slots, addressed by two
hashes of a pair. Decoding concatenates the byte strings of the ids of each
distinct word. A second worker puts the words of each document together. A
slice's words travel in blocks, one a row, and its documents in a last row.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import bpe, shared

#: Pieces with more bytes are left to the library's merges: the fold takes time with the square of a piece's length.
FOLD_BYTES = 64
#: So are pieces that a slice has less often, as a fold costs some thirty times a call of the library (README).
FOLD_COUNT = 3
#: Bytes of text whose distinct pieces are folded once.
SLICE_BYTES = 6_000_000
#: Words of a row that is folded; long rows need arrays for which the JVM's heap has to grow.
BLOCK_WORDS = 2_048
#: The beginning of a splitting pattern by which a blank and the letters after it are one piece, and a stop or comma behind them another.
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"
#: Below this, Python's letters are those of the pattern, whatever the Unicode version of either.
_SAME_LETTERS = "\u0250"
_BITS = 17
_NO_RANK = (1 << _BITS) - 1
_PLACE_BITS = FOLD_BYTES.bit_length()
_SLOTS = 131_101
_HASHES = ((40_503, 2_654_435), (3_141_592, 27_183))


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(id, id) of each two tokens whose bytes together are a token, and that token's rank."""
    halves = ((ranks.get(t[:i]), ranks.get(t[i:]), r) for t, r in ranks.items() for i in range(1, len(t)))
    return {(a, b): r for a, b, r in halves if a is not None and b is not None}


@cache
def rank_slots(path: str, pattern: str) -> np.ndarray:
    """The rank map of a rank file: pair and rank in one number, in one of two slots (cuckoo hashing)."""
    ranks = bpe.from_ranks(path, pattern).ranks
    if max(ranks.values()) >= _NO_RANK:
        raise ValueError("ranks need more bits than the slots have")
    slots = np.full(2 * _SLOTS, -1, np.int64).tolist()
    for (a, b), rank in pair_ranks(ranks).items():
        entry, half = ((a << _BITS | b) << _BITS) | rank, 0
        for _ in range(500):
            key = entry >> _BITS
            p, q = _HASHES[half]
            at = half * _SLOTS + ((key >> _BITS) * p + (key & _NO_RANK) * q) % _SLOTS
            entry, slots[at] = slots[at], entry
            if entry < 0:
                break
            half = 1 - half
        else:
            raise ValueError("no place for a pair; take more slots")
    return np.array(slots, np.int64)


def _rank(a: str, b: str) -> str:
    """SQL for the rank of a pair of ids, or _NO_RANK."""
    (p1, q1), (p2, q2) = _HASHES
    one = f"get(slots, cast(({a} * {p1} + {b} * {q1}) % {_SLOTS} AS int))"
    two = f"get(slots, cast({_SLOTS} + ({a} * {p2} + {b} * {q2}) % {_SLOTS} AS int))"
    key = f"({a} * {1 << _BITS} + {b})"
    return f"(CASE WHEN shiftright({one}, {_BITS}) = {key} THEN {one} & {_NO_RANK} WHEN shiftright({two}, {_BITS}) = {key} THEN {two} & {_NO_RANK} ELSE {_NO_RANK}L END)"


def fold_sql() -> str:
    """SQL for the ids of each word of ``words``, arrays of the ids of single bytes; ``slots`` is the rank map.

    A symbol is one number: the rank of it and its right neighbour, the place of its first byte, its id. So the
    least number is the first of the lowest merges, and the fold carries one array. Its index is counted, as
    array_position leaves its loop by an exception, which took most of the fold's time.
    """
    own, place, unranked = (1 << _BITS) - 1, ((1 << _PLACE_BITS) - 1) << _BITS, _NO_RANK << _BITS + _PLACE_BITS
    up = f"* {1 << _BITS + _PLACE_BITS}L"
    merged = f"""concat(
        slice(s, 1, greatest(k - 2, 0)),
        if(k > 1, array({_rank(f'(get(s, k - 2) & {own})', 'new')} {up} + (get(s, k - 2) & {place | own})), cast(array() AS array<bigint>)),
        array({_rank('new', f'(get(s, k + 1) & {own})')} {up} + (m & {place}) + new),
        slice(s, k + 2, size(s)))"""
    bound = f"get(transform(array(shiftright(m, {_BITS + _PLACE_BITS})), new -> get(transform(array(1 + size(filter(s, x -> (x & {place}) < (m & {place})))), k -> {merged}), 0)), 0)"
    step = f"get(transform(array(array_min(s)), m -> if(m >= {unranked}L, s, {bound})), 0)"
    start = f"transform(w, (a, i) -> {_rank('a', 'get(w, i + 1)')} {up} + i * {1 << _BITS}L + a)"
    turns = "if(size(w) < 2, cast(array() AS array<int>), sequence(2, size(w)))"
    return f"transform(words, w -> aggregate({turns}, {start}, (s, i) -> {step}, s -> transform(s, x -> x & {own})))"


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; with keep also the ids (little-endian, 32 bits) and decoded bytes.

    Null text counts as empty and has no tokens. Strings of special tokens are
    ordinary text. Repeated rows and null ids stay; other columns are ignored.
    Whole texts count, however long, each in one task; an empty table gives no rows.
    """
    spark = docs.sparkSession
    layout = "doc_ids array<long>, words array<array<long>>, rest_ids array<binary>, sizes array<int>, codes binary"
    small = pa.schema([("doc_ids", pa.list_(pa.int64())), ("words", pa.list_(pa.list_(pa.int64()))), ("rest_ids", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary())])

    def row_of(doc_ids: list, words: pa.Array, rest: list[bytes], sizes: list[int] | None, codes: bytes | None = None) -> pa.RecordBatch:
        words = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        columns = [pa.array([doc_ids], small.types[0]), words, pa.array([rest], small.types[2]), pa.array([sizes], small.types[3]), pa.array([codes], small.types[4])]
        return pa.RecordBatch.from_arrays(columns, schema=small)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.from_ranks(ranks_path, pattern)
        byte_ids = np.array([own.ranks[bytes([b])] for b in range(256)], np.int64)
        plain = pattern.startswith(LETTERS)
        for doc_ids, texts in shared.slices(batches, most=SLICE_BYTES):
            places: dict[str, int] = {}

            def code(text: str) -> bytes:
                # a blank and letters are one piece, and so is a stop or comma behind them, without the pattern
                if plain and text[:1] == " " and (text.isascii() or max(text) < _SAME_LETTERS):
                    if text[1:].isalpha():
                        return places.setdefault(text, len(places)).to_bytes(4, "little")
                    if text[-1] in ".," and text[1:-1].isalpha():
                        return places.setdefault(text[:-1], len(places)).to_bytes(4, "little") + places.setdefault(text[-1], len(places)).to_bytes(4, "little")
                return array("i", [places.setdefault(piece, len(places)) for piece in own.pattern.findall(text)]).tobytes()

            memo = bpe.Words(code)
            rows = []
            for text in texts:
                parts = bpe.parts_of(text or "")
                rows.append(b"".join([code(parts[0]), *map(memo.__getitem__, parts[1:])]))
            codes = np.frombuffer(b"".join(rows), "<i4")
            words = [w.encode() for w in places]
            often = (np.bincount(codes, minlength=len(words)) >= FOLD_COUNT) & (np.fromiter(map(len, words), np.int64, len(words)) <= FOLD_BYTES)
            # places of folded words count up from 0, those of the rest down from -1
            moved = np.where(often, np.cumsum(often) - 1, -np.cumsum(~often)).astype("<i4")
            folded = [w for w, k in zip(words, often.tolist()) if k]
            rest = [array("I", own.core._core_bpe.encode_single_piece(w)).tobytes() for w, k in zip(words, often.tolist()) if not k]
            ends = np.cumsum([0, *map(len, folded)])
            letters = byte_ids[np.frombuffer(b"".join(folded), np.uint8)]
            for first in range(0, len(folded), BLOCK_WORDS):
                block = ends[first : first + BLOCK_WORDS + 1]
                yield row_of([], pa.ListArray.from_arrays(pa.array(block - block[0], pa.int32()), pa.array(letters[block[0] : block[-1]])), [], None)
            yield row_of(doc_ids, pa.array([], pa.list_(pa.int64())), rest, [len(r) // 4 for r in rows], moved[codes].tobytes())
            del texts, doc_ids, rows, codes, moved, memo, places, words, folded, rest, letters
        shared.give_back()

    out_fields = [("doc_id", "long", pa.int64()), ("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())] + [("ids", "binary", pa.binary()), ("decoded", "binary", pa.binary())] * keep
    arrow = pa.schema([(n, t) for n, _, t in out_fields])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.from_ranks(ranks_path, pattern)
        id_list: list[bytes] = []
        text_list: list[bytes] = []
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, rest_ids, sizes, codes, ids, decoded = (batch.column(k)[row] for k in range(6))
                flat, ends = ids.values.flatten().to_numpy().astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(ids.values.value_lengths().to_numpy(zero_copy_only=False))]) * 4
                id_list += [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                text_list += decoded.as_py()
                if not codes.is_valid:
                    continue  # a block of words; the slice's documents follow
                rest = rest_ids.as_py()
                id_list += rest[::-1]
                text_list += [b"".join(map(own.names.__getitem__, memoryview(r).cast("I"))) for r in rest][::-1]
                places = np.frombuffer(codes.as_py(), "<i4")
                out: list[list] = [[] for _ in out_fields]
                start = 0
                for doc_id, size in zip(doc_ids.as_py(), sizes.as_py()):
                    at = places[start : start + size].tolist()
                    start += size
                    packed, text = b"".join(map(id_list.__getitem__, at)), b"".join(map(text_list.__getitem__, at))
                    made = (doc_id, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text).hexdigest(), packed, text)
                    for column, v in zip(out, made):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow.types)], schema=arrow)
                id_list, text_list = [], []
        shared.give_back()

    names = bpe.from_ranks(ranks_path, pattern).ranks
    token_bytes: list = [b""] * (max(names.values()) + 1)
    for token, i in names.items():
        token_bytes[i] = bytearray(token)
    constants = spark.createDataFrame([(rank_slots(ranks_path, pattern).tolist(), token_bytes)], "slots array<long>, token_bytes array<binary>")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sliced = texts.mapInArrow(split, layout)
    # one expression names each map once and binds it inside, so that the projections collapse: as a column it would be copied into every row
    names_of = "transform(ids, w -> aggregate(w, X'', (t, i) -> concat(t, get(token_bytes, cast(i AS int)))))"
    both = f"transform(array({fold_sql()}), ids -> named_struct('ids', ids, 'decoded', {names_of}))"
    bound = f"get(get(transform(array(slots), slots -> transform(array(token_bytes), token_bytes -> get({both}, 0))), 0), 0)"
    maps = (constants.select(name).scalar().alias(name) for name in constants.columns)
    decoded = sliced.select("*", *maps).select("doc_ids", "rest_ids", "sizes", "codes", F.expr(bound).alias("both")).select("*", "both.*")
    return decoded.select("doc_ids", "rest_ids", "sizes", "codes", "ids", "decoded").mapInArrow(join, ", ".join(f"{n} {t}" for n, t, _ in out_fields))
