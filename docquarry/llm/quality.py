"""Quality rules: base counts and divergence from language references.

A document's histogram over character classes and its histogram over the common
words of its language are held against the same histograms of all documents of
that language by Jensen-Shannon distance. References are gathered over every
document that passes the base rules; short documents have no verdict from the
distances.
"""

from __future__ import annotations

import base64
import json
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm import shared

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Documents with fewer words have no verdict from the distances: their histograms are too thin.
GUARD_WORDS = 60
#: Chosen on the labelled rows whose crc32(doc_id as text) mod 3 is not 1 (README has the figures).
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.31, 0.38
#: Words of a language's reference; the most frequent.
COMMON_WORDS = 40
#: A reference of fewer words has no say; one whose listed words hold a smaller share of its text has none about words.
MIN_REFERENCE_WORDS = 1_000
MIN_COMMON_SHARE = 0.1
#: Counts that a task holds before it hands them on.
HELD_COUNTS = 200_000
#: References that a worker keeps ready.
HELD_REFERENCES = 256
#: Bytes of all references that are sent to all executors; more of them are joined by shuffle.
BROADCAST_BYTES = 16_000_000
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
PUNCTUATION = b".,;:!?'\"()-"
_CONTINUATION = 9
_CLASSES = 9


def byte_classes() -> np.ndarray:
    """Class of each UTF-8 byte: lower, upper, digit, space, line end, sentence mark, symbol, other ASCII, start of a longer code point."""
    out = np.full(256, 7, np.int64)
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 0, 1, 2
    out[list(SPACES)], out[ord("\n")], out[list(PUNCTUATION)], out[list(SYMBOLS)] = 3, 4, 5, 6
    out[0xC0:], out[0x80:0xC0] = 8, _CONTINUATION
    return out


_CLASS_OF = byte_classes()


def class_histogram(bytes_histogram: np.ndarray) -> np.ndarray:
    return np.bincount(_CLASS_OF, weights=bytes_histogram, minlength=_CLASSES + 1)[:_CLASSES]


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, all of them counted."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def base_counts(raw: bytes) -> tuple[dict, list[bytes], np.ndarray]:
    """The contract's counts, the words and the histogram of character classes of a UTF-8 text."""
    words = raw.split()
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by_class = class_histogram(by_byte)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, repeated = len(words), repeat_words(words)
    counts = {
        "n_words": n,
        "word_chars": int(by_class.sum() - by_class[3] - by_class[4]),
        "n_symbols": int(by_class[6]),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated,
        "base_failed": n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n,
    }
    return counts, words, by_class


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, from 0 to 1, of two histograms; 0 where one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    terms = [np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])) for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(terms) / 2)))


def references(docs: DataFrame) -> DataFrame:
    """(lang, ref): for each language its class counts, number of words and commonest words, as JSON.

    Over all documents that pass the base rules; a null language is one of its
    own, named by the empty string. Words of every length count; of equally
    common ones the first in the order of bytes is taken.
    """
    schema = "lang string, kind string, key binary, n long"
    arrow = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("key", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for texts, langs in shared.slices(batches, 0):
            for text, lang in zip(texts, langs):
                if text is None:
                    continue
                raw = text.encode()
                counts, words, by_class = base_counts(raw)
                if counts["base_failed"]:
                    continue
                found[lang, "words", b""] += len(words)
                for k, n in enumerate(by_class):
                    found[lang, "class", bytes([k])] += int(n)
                found.update((lang, "word", w) for w in raw.lower().split())
                if len(found) >= HELD_COUNTS:
                    yield handed_on(found)
                    found = Counter()
        if found:
            yield handed_on(found)
        del found
        shared.give_back()

    def handed_on(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(arrow.names, [*zip(*found), found.values()])), schema=arrow)

    picked = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    counted = shared.cut_lineage(picked.mapInArrow(count, schema).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    common = counted.where("kind = 'word'").withColumn("at", best).where(F.col("at") <= COMMON_WORDS).drop("at")  # each task hands on COMMON_WORDS a language
    rows = counted.where("kind <> 'word'").unionByName(common)
    listed = F.array_sort(F.collect_list(F.struct("kind", F.base64("key").alias("key"), "n")))  # COMMON_WORDS + classes + 1 entries
    return shared.cut_lineage(rows.groupBy("lang").agg(F.to_json(listed).alias("ref")))


def parsed(ref: str) -> tuple[np.ndarray, list[bytes], np.ndarray, int]:
    """Class counts, common words, their counts and that of all other words, number of words."""
    classes, words, counts, total = np.zeros(_CLASSES), [], [], 0
    for entry in json.loads(ref):
        key = base64.b64decode(entry.get("key", ""))
        if entry["kind"] == "class":
            classes[key[0]] = entry["n"]
        elif entry["kind"] == "word":
            words.append(key)
            counts.append(entry["n"])
        else:
            total = entry["n"]
    return classes, words, np.array([*counts, total - sum(counts)], float), total


def judged_by() -> Callable[[str | None, str | None], dict]:
    """The function from a text and its language's reference (null: none) to counts, distances and verdict."""
    known: dict[str, tuple] = {}

    def verdict(text: str | None, ref: str | None) -> dict:
        raw = (text or "").encode()
        counts, words, by_class = base_counts(raw)
        chars = common = None
        if ref is not None and counts["n_words"] >= GUARD_WORDS:
            if ref not in known:
                if len(known) == HELD_REFERENCES:
                    known.clear()
                known[ref] = parsed(ref)
            classes, listed, q, total = known[ref]
            if total >= MIN_REFERENCE_WORDS:
                chars = distance(by_class, classes)
                if q[:-1].sum() >= MIN_COMMON_SHARE * total:
                    found = Counter(raw.lower().split())
                    own = np.array([found[w] for w in listed], float)
                    common = distance(np.append(own, len(words) - own.sum()), q)
        bad = chars is not None and chars > MAX_CHAR_DISTANCE or common is not None and common > MAX_WORD_DISTANCE
        return {**counts, "char_distance": chars, "word_distance": common, "kept": not counts["base_failed"] and not bad}

    return verdict


def with_references(docs: DataFrame, refs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with their language's reference (null: none) in a new column, and the name of that column."""
    name, lang = shared.new_name(docs, "ref"), shared.new_name(docs, "lang")
    size = refs.agg(F.sum(F.octet_length("lang") + F.octet_length("ref"))).first()[0] or 0
    own = refs.select(F.col("lang").alias(lang), F.col("ref").alias(name))
    joined = docs.join(F.broadcast(own) if size <= BROADCAST_BYTES else own, F.coalesce(docs["lang"].cast("string"), F.lit("")) == F.col(lang), "left")
    return joined.drop(lang), name


def accepted(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, whatever these are called; repeated rows and null ids stay or go as any others."""
    verdict = judged_by()
    joined, name = with_references(docs, refs)
    return shared.filter_texts(joined, lambda texts, own: [verdict(*x)["kept"] for x in zip(texts, own)], [name]).drop(name)


def judge(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, char_distance, word_distance and kept.

    Null text has no words and fails the base rules. Distances are null below
    GUARD_WORDS words and where the reference of the document's language is
    missing or has fewer than MIN_REFERENCE_WORDS words, word_distance also
    where the listed words hold less than MIN_COMMON_SHARE of it (as with
    unspaced scripts); then the other rules decide. A null language is one of
    its own. A distance at its bound is accepted. Repeated rows and null ids
    are kept as they are; other columns are ignored. Texts of any length are
    judged whole.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, char_distance double, word_distance double, kept boolean"
    arrow = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base_failed", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64()), ("kept", pa.bool_())])
    verdict = judged_by()

    def verdicts(doc_ids: list, texts: list, own: list) -> dict:
        out = defaultdict(list)
        for doc_id, text, ref in zip(doc_ids, texts, own):
            for k, v in ({"doc_id": doc_id} | verdict(text, ref)).items():
                out[k].append(v)
        return out

    joined, name = with_references(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), refs)
    return shared.map_texts(joined, verdicts, schema, arrow, [F.col(c) for c in ("doc_id", "text", name)])
