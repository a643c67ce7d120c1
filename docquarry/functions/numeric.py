"""Column functions over numbers: guarded parsing, decay, vectors, weights and sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_WIDTH, ASCII = "０１２３４５６７８９％．，", "0123456789%.,"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
HALF_LIFE_DAYS = 3.0
#: What each relation adds to a path's bonus, and what any other adds.
RELATION_WEIGHTS = {
    "ANSWERS": 0.3, "REPORTED": 0.3, "FOR_PERIOD": 0.3, "SUBSIDIARY_OF": 0.2, "OPERATES_IN": 0.2, "IN_CATEGORY": 0.2,
    "BELONGS_TO": 0.2, "CONTAINS": 0.1, "HAS_CHUNK": 0.05, "HAS_DOCUMENT": 0.05,
}
OTHER_WEIGHT = 0.1


def bare_number(cell: Column) -> Column:
    """A cell's text without thousands separators, spaces and unit signs at its end."""
    plain = F.regexp_replace(F.translate(cell, FULL_WIDTH, ASCII), r"[,\s]", "")
    return F.regexp_replace(plain, "[%元萬億千]+$", "")


def is_number(cell: Column) -> Column:
    return F.coalesce(bare_number(cell).rlike(NUMBER), F.lit(False))


def to_number(cell: Column) -> Column:
    """The number of a cell, its unit left out without scaling; null for anything else."""
    return F.when(is_number(cell), bare_number(cell).cast("double"))


def strict_number(cell: Column) -> Column:
    """Only numbers with groups of three digits: ``1,234.5`` but not ``1234``."""
    return F.when(cell.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})*(\.[0-9]+)?$"), F.regexp_replace(cell, ",", "").cast("double"))


def looks_numeric(cell: Column) -> Column:
    """Has a digit and nothing but digits, signs, separators, percent signs and brackets."""
    return F.coalesce(F.translate(cell, FULL_WIDTH, ASCII).rlike(r"^[\s()+\-0-9.,%]*[0-9][\s()+\-0-9.,%]*$"), F.lit(False))


def pure_number(cell: Column) -> Column:
    return F.coalesce(cell.rlike(r"^[0-9,.%]+$"), F.lit(False))


def time_decay(when: Column, as_of: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Halves every ``half_life`` days before ``as_of``; 0.1 where there is no time."""
    days = (F.unix_micros(as_of) - F.unix_micros(when)) / 86_400e6
    return F.coalesce(F.exp(-days * math.log(2) / half_life), F.lit(0.1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, summed in doubles; 0 if one has no length."""
    wide = [F.transform(x, lambda v: v.cast("double")) for x in (a, b)]
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(wide[0], wide[0])) * F.sqrt(dot(wide[1], wide[1]))
    return F.when(norm > 0, dot(*wide) / norm).otherwise(0.0)


def repaired_vector(vector: Column, width: int) -> Column:
    """Cut or filled with zeros to ``width``; null gives zeros."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    return F.slice(F.concat(F.coalesce(vector, F.array().cast("array<float>")), zero), 1, width)


def relation_weight(relation: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, weight in RELATION_WEIGHTS.items():
        out = F.when(relation == name, weight).otherwise(out)
    return out


def flipped_box(y0: Column, y1: Column, height: Column) -> tuple[Column, Column]:
    """Top and bottom of a box, from coordinates that count from the page's other edge."""
    return height - y1, height - y0


def summary_guard(chars: Column, most: int = 60_000) -> Column:
    """Estimated minutes of a summary that is refused for its size; null if it is not."""
    return F.when(chars > most, F.floor(chars / 1800) * 0.075)


def summary_strategy(chars: Column, most_tokens: int = 6000) -> Column:
    return F.when(F.floor(chars / 4) > most_tokens, "chunked").otherwise("direct")


def file_strategy(size: Column) -> Column:
    return F.when(size > 5 * 1024 * 1024, "large").when(size > 1024 * 1024, "medium").otherwise("small")
