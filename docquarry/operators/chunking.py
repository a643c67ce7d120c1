"""Chunkers: token packing with overlap, character windows and greedy row packing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import ids, slots

MAX_TOKENS, OVERLAP, FINANCIAL_FACTOR = 300, 80, 1.5
_SENTENCE = re.compile(r"(?<=[。！？；…])")
_BLANK = re.compile(r"\n\s*\n")


def limits(financial: bool = False) -> tuple[int, int]:
    """Tokens of a chunk and of its overlap."""
    factor = FINANCIAL_FACTOR if financial else 1
    return int(MAX_TOKENS * factor), int(OVERLAP * factor)


def packed(text: str, most: int = MAX_TOKENS, overlap: int = OVERLAP, segment: Callable[[str], list[str]] = slots.segment) -> list[str]:
    """Chunks of whole sentences, at most ``most`` tokens before the overlap.

    No chunk spans a blank line. A chunk starts with the last ``overlap``
    tokens of the one before it in its paragraph. A longer sentence stays whole,
    so a chunk has at most ``overlap`` tokens and the larger of ``most`` and one sentence.
    """
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be smaller than a chunk")
    out = []
    for part in filter(str.strip, _BLANK.split(text or "")):
        sentences = list(filter(str.strip, _SENTENCE.split(part.strip())))
        if len(sentences) == 1 and segment is slots.segment:
            out.append(sentences[0].strip())  # its tokens join to it
            continue
        held: list[str] = []
        fresh = False
        for sentence in sentences:
            tokens = segment(sentence.strip())
            if fresh and len(held) + len(tokens) > most:
                out.append("".join(held))
                held = held[-overlap:] if overlap else []
            held, fresh = held + tokens, True
        if fresh:
            out.append("".join(held))
    return out


def token_chunks(docs: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_idx, text) of (doc_id, text)."""
    segment = slots.slot("segment")

    @F.pandas_udf("array<string>")
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: packed(t, most, overlap, segment))

    return docs.select("doc_id", F.posexplode(chunks(F.col("text"))).alias("chunk_idx", "text"))


def char_windows(docs: DataFrame, size: int, overlap: int, until_end: bool = True) -> DataFrame:
    """(doc_id, win, text) windows of ``size`` characters that share ``overlap``.

    With until_end the first window that reaches the end is the last; without,
    windows start as long as there is text.
    """
    step = size - min(overlap, size - 1)
    n = F.length("text")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step).cast("int")) if until_end else F.floor((n - 1) / step).cast("int")
    starts = docs.where(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("win"))
    return starts.select("doc_id", "win", F.substring("text", F.col("win") * step + 1, F.lit(size)).alias("text"))


def unseen_windows(windows: DataFrame, emitted: DataFrame) -> DataFrame:
    """Windows whose text, apart from white space, is not that of any row of ``emitted`` (text)."""
    return windows.withColumn("hash", ids.text_hash(F.col("text"))).join(emitted.select(ids.text_hash(F.col("text")).alias("hash")), "hash", "left_anti")


def packed_rows(rows: DataFrame, most_rows: int = 15, most_chars: int = 1500) -> DataFrame:
    """(doc_id, table_id, first_row, last_row, n, text) groups of consecutive rows (doc_id, table_id, row_idx, text).

    A group has at most ``most_rows`` rows and ``most_chars`` characters with
    line ends; a longer row is a group of its own. A table is folded in one
    task, which a table's size allows; tables are spread over tasks.
    """

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, held, size = [], [], 0
        for i, t in sorted(zip(pdf["row_idx"], pdf["text"].fillna(""))):
            if held and (len(held) >= most_rows or size + 1 + len(t) > most_chars):
                out.append((*key, held[0][0], held[-1][0], len(held), "\n".join(x for _, x in held)))
                held, size = [], 0
            size += len(t) + (1 if held else 0)
            held.append((i, t))
        if held:
            out.append((*key, held[0][0], held[-1][0], len(held), "\n".join(x for _, x in held)))
        return pd.DataFrame(out, columns=["doc_id", "table_id", "first_row", "last_row", "n", "text"])

    return rows.groupBy("doc_id", "table_id").applyInPandas(fold, "doc_id string, table_id string, first_row long, last_row long, n long, text string")
