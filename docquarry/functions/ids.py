"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _shown(value: Column) -> Column:
    """As text; null is written out."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def uuid_form(digest: Column) -> Column:
    """32 hex digits in groups of 8, 4, 4, 4 and 12."""
    return F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def chunk_id(doc_id: Column, page: Column, kind: Column, chunk_idx: Column, text: Column) -> Column:
    return uuid_form(F.md5(F.concat_ws("|", *map(_shown, (doc_id, page, kind, chunk_idx)), F.substring(text, 1, 64)).cast("binary")))


def temp_chunk_id(doc_id: Column, page: Column, kind: Column, text: Column) -> Column:
    return F.concat(F.lit("temp_"), F.md5(F.concat_ws("|", *map(_shown, (doc_id, page, kind)), F.substring(text, 1, 64)).cast("binary")))


def observation_hash(doc_id: Column, table_id: Column, row: Column, col: Column, header: Column, value: Column) -> Column:
    return F.md5(F.concat_ws("|", *map(_shown, (doc_id, table_id, row, col, header, value))).cast("binary"))


def parts_hash(*parts: Column) -> Column:
    """16 hex digits of SHA-1 over parts that each end in a record separator."""
    return F.substring(F.sha1(F.concat(*(F.concat(_shown(p), F.lit("\x1e")) for p in parts)).cast("binary")), 1, 16)


def text_hash(text: Column) -> Column:
    """12 hex digits of SHA-1 over the text with white space collapsed."""
    return F.substring(F.sha1(F.trim(F.regexp_replace(text, r"\s+", " ")).cast("binary")), 1, 12)
