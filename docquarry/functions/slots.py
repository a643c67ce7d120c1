"""Model slots with deterministic offline defaults.

A deployment registers functions of its own; the defaults need no network.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
_SEGMENT = re.compile(r"[㐀-鿿]|[^\W㐀-鿿]+|\s+|[^\w\s]+|.", re.S)
#: The same tokens without white space.
_VISIBLE = re.compile(r"[㐀-鿿]|[^\W㐀-鿿]+|[^\w\s]+")
#: Words whose places a worker keeps, and their longest; others are hashed each time they come.
_PLACES_MOST, _PLACES_LONGEST = 200_000, 64
_SLOTS: dict[str, Callable] = {}


def register(name: str, function: Callable) -> None:
    """Put a function of one's own into a slot: embed, rerank, complete, segment, triples, rewrite or ocr."""
    _SLOTS[name] = function


def slot(name: str) -> Callable:
    return _SLOTS.get(name) or _DEFAULTS[name]


def segment(text: str) -> list[str]:
    """Tokens that join to the text: CJK characters, words, white space and runs of signs."""
    return _SEGMENT.findall(text)


class _Places(dict):
    """A bounded memo from a word without white space to a byte for each of its tokens: its dimension, with DIMENSIONS added where its sign is negative."""

    def __missing__(self, word: str) -> bytes:
        hashes = (hashlib.blake2b(token.encode(), digest_size=4).digest() for token in _VISIBLE.findall(word))
        places = bytes(int.from_bytes(h[:2], "little") % DIMENSIONS + (0 if h[2] & 1 else DIMENSIONS) for h in hashes)
        if len(self) < _PLACES_MOST and len(word) <= _PLACES_LONGEST:
            self[word] = places
        return places


_places = _Places()


def embed(texts: list[str]) -> np.ndarray:
    """Signed hashing of lower-case tokens, of length one; blank texts give zeros. One row for each text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts):
        places = b"".join(map(_places.__getitem__, (text or "").lower().split()))
        counts = np.bincount(np.frombuffer(places, np.uint8), minlength=2 * DIMENSIONS)
        row[:] = counts[:DIMENSIONS] - counts[DIMENSIONS:]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def complete(prompts: list[str]) -> list[str]:
    """The first three sentences of the prompt's last block."""
    def short(prompt: str) -> str:
        block = (prompt or "").strip().split("\n\n")[-1]
        return " ".join(re.split(r"(?<=[.!?。！？])\s*", block)[:3]).strip()

    return [short(p) for p in prompts]


def rewrite(queries: list[str]) -> list[str]:
    return list(queries)


def triples(texts: list[str], most: int = 6) -> list[list[tuple[str, str, str]]]:
    """``A verb B`` patterns of capitalised names, at most ``most`` a text."""
    pattern = re.compile(r"([A-Z]\w+) (owns|reports|produces|operates in|is part of) ([A-Z]\w+)")
    return [[(a, v.replace(" ", "_").upper(), b) for a, v, b in pattern.findall(t or "")][:most] for t in texts]


def ocr(_: list[bytes]) -> list[str | None]:
    """No recogniser is built in."""
    raise NotImplementedError("register a recogniser in the slot 'ocr'")


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    short, long = sorted((a, b), key=len)
    at: dict[str, int] = {}
    for i, x in enumerate(long):
        at[x] = at.get(x, 0) | 1 << i
    full = row = (1 << len(long)) - 1  # bits of a row of the table of lengths; 0 where the length grows
    for y in short:
        met = row & at.get(y, 0)
        row = (row + met | row - met) & full
    return 200.0 * (len(long) - row.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared tokens alone and with the rest of either side."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s - (x & y)))])) for s in (x, y))
    if both and (not x - y or not y - x):
        return 100.0
    best = max(200.0 * len(both) / (len(both) + len(side)) for side in (left, right)) if both else 0.0  # either side begins with what both share
    if not left and not right or 200.0 * min(len(left), len(right)) / (len(left) + len(right)) > best:
        best = max(best, indel_ratio(left, right))
    return best


def token_sets_alike(x: set[str], y: set[str], sizes: tuple[int, int], least: float) -> bool:
    """Whether token_set_ratio is at least ``least``; sizes are the lengths of the joined tokens. Bounds by length come first."""
    same = x & y
    if same and (len(same) == len(x) or len(same) == len(y)):
        return least <= 100
    short, long = min(sizes), max(sizes)
    both = sum(map(len, same)) + len(same) - 1 if same else 0
    if both and 200.0 * both / (both + short) >= least:
        return True
    if long and 200.0 * short / (short + long) < least:
        return False
    start = sorted(same)
    return indel_ratio(" ".join(start + sorted(x - same)), " ".join(start + sorted(y - same))) >= least


_DIGIT = {c: i for i, c in enumerate("零一二三四五六七八九")} | {c: i for i, c in enumerate("〇壹貳參肆伍陸柒捌玖")} | {str(i): i for i in range(10)} | {"兩": 2}
_UNIT = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
_MYRIAD = {"萬": 10**4, "億": 10**8, "兆": 10**12}


def numeral(text: str) -> int | None:
    """The value of a numeral in CJK characters or digits; null for anything else."""
    if not text or any(c not in _DIGIT and c not in _UNIT and c not in _MYRIAD for c in text):
        return None
    if all(c in _DIGIT for c in text):
        return int("".join(str(_DIGIT[c]) for c in text))
    total = section = 0
    digit: int | None = None
    for c in text:
        if c in _DIGIT:
            digit = _DIGIT[c] if digit is None else digit * 10 + _DIGIT[c]
        elif c in _UNIT:
            section += (1 if digit is None else digit) * _UNIT[c]
            digit = None
        else:
            total = (total + section + (digit or 0)) * _MYRIAD[c] if total + section + (digit or 0) else _MYRIAD[c]
            section, digit = 0, None
    return total + section + (digit or 0)


_DEFAULTS = {"embed": embed, "complete": complete, "segment": segment, "triples": triples, "rewrite": rewrite, "ocr": ocr}


#: Texts of a call to a model; tries of a single text.
CALL, TRIES = 200, 3


def salvaged(function: Callable[[list], list], items: list, tries: int = TRIES) -> list[tuple[object, str | None]]:
    """(result, error) of each item: a call that fails is split in halves down to the item, which has ``tries`` calls."""
    if not items:
        return []
    error = ""
    for _ in range(tries if len(items) == 1 else 1):
        try:
            found = list(function(items))
            if len(found) != len(items):
                raise ValueError(f"{len(found)} results for {len(items)} texts")
            return [(x, None) for x in found]
        except Exception as e:  # whatever a model raises concerns its own texts only
            error = f"{type(e).__name__}: {e}"
    if len(items) == 1:
        return [(None, error)]
    half = len(items) // 2
    return salvaged(function, items[:half], tries) + salvaged(function, items[half:], tries)


def called(rows: DataFrame, name: str, column: str, kind: str, out: str = "value", error: str = "error", shape: Callable = lambda x: x) -> DataFrame:
    """The rows with what the slot ``name`` gives for a text column and, where it fails for one, the error instead.

    A worker calls with CALL texts at a time; kind is the SQL type of a shaped result.
    """
    function = slot(name)

    @F.pandas_udf(f"struct<value:{kind},error:string>")
    def results(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            own = texts.fillna("").tolist()
            found = [r for i in range(0, len(own), CALL) for r in salvaged(function, own[i : i + CALL])]
            yield pd.DataFrame({"value": pd.Series([None if e else shape(x) for x, e in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    made = f"__{name}"
    return rows.withColumn(made, results(F.col(column))).withColumns({out: F.col(f"{made}.value"), error: F.col(f"{made}.error")}).drop(made)


def registered() -> set[str]:
    """Names of slots that hold functions of one's own."""
    return set(_SLOTS)


def reranking(query: Column, text: Column) -> Column:
    """Scores of the slot ``rerank``: lists of queries and of texts to a list of numbers."""
    function = slot("rerank")

    @F.pandas_udf("double")
    def scores(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(function(queries.fillna("").tolist(), texts.fillna("").tolist()), dtype=float)

    return scores(query, text)


def embedded(rows: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
    """The rows with the vector of a text column."""
    function = slot("embed")

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(function(texts.fillna("").tolist())))

    return rows.withColumn(out, vectors(F.col(text)))


def completed(rows: DataFrame, prompt: str = "prompt", out: str = "answer") -> DataFrame:
    """The rows with a model's answer to a prompt column."""
    function = slot("complete")

    @F.pandas_udf("string")
    def answers(prompts: pd.Series) -> pd.Series:
        return pd.Series(function(prompts.fillna("").tolist()))

    return rows.withColumn(out, answers(F.col(prompt)))


def extracted_triples(rows: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, src, rel, dst) of (doc_id, text)."""
    function = slot("triples")

    @F.pandas_udf("array<struct<src:string,rel:string,dst:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"src": a, "rel": r, "dst": b} for a, r, b in t] for t in function(texts.fillna("").tolist())])

    return rows.select("doc_id", F.inline(found(F.col(text))))
