"""Known ids that questions name, by joins: ids that stand in a question by their rarest gram, ids like a word by shared pairs of letters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import slots, subsequences

#: Letters of a gram; words shorter than this are like nothing.
GRAM, SHORTEST = 3, 5
#: Words of more letters are not held against ids by what is left without a letter, which takes the square of their length.
FEW_LETTERS = 64


def _grams(text: Column, size: int) -> Column:
    """All runs of ``size`` letters, in order."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def contained(queries: DataFrame, ids: DataFrame) -> DataFrame:
    """(query_id, doc_id): ids that a question (query_id, query) contains, in whatever case.

    An id meets only the questions that have its gram that the fewest ids have.
    """
    low = ids.withColumn("low", F.lower("doc_id")).where("low <> ''")
    # an id shorter than a gram is one
    own = F.when(F.length("low") < GRAM, F.array("low")).otherwise(F.array_distinct(_grams(F.col("low"), GRAM)))
    each = low.select("doc_id", "low", F.explode(own).alias("gram"))
    counts = each.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = each.join(counts, "gram").groupBy("doc_id", "low").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    asked = queries.select("query_id", F.lower("query").alias("q"))
    grams = F.array_distinct(F.concat(*(_grams(F.col("q"), k) for k in range(1, GRAM + 1))))
    near = asked.select("query_id", F.explode(grams).alias("gram")).join(rarest, "gram").select("query_id", "doc_id", "low")
    return near.join(asked, "query_id").where(F.contains("q", "low")).select("query_id", "doc_id").distinct()


def _items(text: Column) -> Column:
    """Pairs of neighbouring letters, each with how often it came before, so that shared ones count as often as both have them."""
    pairs = _grams(text, 2)
    return F.transform(pairs, lambda x, i: F.concat(x, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda y: y == x)).cast("string")))


def _prefixes(texts: DataFrame, name: str, counts: DataFrame) -> DataFrame:
    """(name, item): those of a text's items that the fewest ids have, so many that two texts alike share one.

    A ratio over 80 leaves less than a fifth of both lengths over; a letter left
    over breaks two pairs of its own text and one of the other. So texts of
    lengths a and b share more than (a + b) / 5 - 1 pairs, which is a third of
    a's length at least, as b is at least two thirds of a.
    """
    each = texts.select(name, F.explode(_items(F.col(name))).alias("item")).join(counts, "item", "left")
    place = F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("n", F.lit(0)), "item"))
    return each.withColumn("place", place).where(F.col("place") <= F.length(name) - F.floor(F.length(name) / 3)).select(name, "item")


def _without(text: Column, start: Column) -> Column:
    """The texts that lack one letter of ``text``, from place ``start`` on; places count from 1."""
    n = F.length(text)
    cut = lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1, n))
    return F.when(n >= start, F.transform(F.sequence(start, n), cut)).otherwise(F.array().cast("array<string>"))


def _close(words: DataFrame, ids: DataFrame) -> DataFrame:
    """(word, doc_id): those that are equal once each has lost a letter at most, or the id two.

    For words of four letters or more every other id has a lower ratio than
    these: they are 1 - 1 / a alike at least, for a word of a letters, and the
    next ones, that lack two letters of it or differ in three, are less.
    """
    one = lambda c: F.explode(F.array_distinct(F.concat(F.array(c), _without(F.col(c), F.lit(1))))).alias("left")
    near = words.select("word", one("word")).join(ids.select("doc_id", one("doc_id")), "left").select("word", "doc_id")
    longer = ids.join(words.select((F.length("word") + 2).alias("n")).distinct(), F.length("doc_id") == F.col("n"), "left_semi")
    two = F.flatten(F.transform(F.sequence(F.lit(1), F.length("doc_id")), lambda i: _without(F.concat(F.substr("doc_id", F.lit(1), i - 1), F.substr("doc_id", i + 1, F.length("doc_id"))), i)))
    return near.unionByName(longer.select("doc_id", F.explode(F.array_distinct(two)).alias("word")).join(words, "word").select("word", "doc_id")).distinct()


def most_like(words: DataFrame, ids: DataFrame, least: float = 80) -> DataFrame:
    """(word, doc_id): for each word the id with the greatest ratio over ``least``, which is 80 or more; of equal ones the smallest.

    Words that differ from an id in a letter have their answer among such ids,
    which a join by equality finds, however alike all ids are; only the others
    meet every id that shares one of their rarer pairs of letters.
    """
    if least < 80:
        raise ValueError("the bounds hold for ratios over 80")
    longest = ids.agg(F.max(F.length("doc_id"))).first()[0] or 0
    own = words.where((F.length("word") <= 1.5 * longest) & (F.length("word") >= SHORTEST)).distinct()
    known = ids.where(F.length("doc_id") * 1.5 >= SHORTEST)
    near = _close(own.where(F.length("word") <= FEW_LETTERS), known.where(F.length("doc_id") <= FEW_LETTERS + 2))
    far = own.join(near.select("word").distinct(), "word", "left_anti")
    counts = known.select(F.explode(_items(F.col("doc_id"))).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    pairs = near.unionByName(_prefixes(far, "word", counts).join(_prefixes(known, "doc_id", counts), "item").select("word", "doc_id").distinct())
    a, b = F.length("word"), F.length("doc_id")

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        common = subsequences.common_lengths(list(zip(left, right)))
        return pd.Series(200.0 * common / (left.str.len() + right.str.len()).to_numpy(), dtype=float)

    width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rated = pairs.repartition(width).where(200.0 * F.least(a, b) > least * (a + b)).withColumn("ratio", ratio("word", "doc_id")).where(F.col("ratio") > least)
    best = rated.groupBy("word").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "doc_id"))["doc_id"].alias("doc_id"))
    return best


def named(queries: DataFrame, known: DataFrame, common: tuple[str, ...], least: float = 80) -> DataFrame:
    """(query_id, doc_id): ids (doc_id) that a question (query_id, query) contains; without one, those most like one of its words.

    Null and empty ids, null questions and the words in ``common`` name nothing.
    """
    segment = slots.slot("segment")
    ids = known.select(F.col("doc_id").cast("string").alias("doc_id")).where("doc_id <> ''").distinct()
    exact = contained(queries, ids)

    @F.pandas_udf("array<string>")
    def words(questions: pd.Series) -> pd.Series:
        return questions.map(lambda t: list(dict.fromkeys(w for w in segment(t or "") if len(w) >= SHORTEST and w.lower() not in common)))

    rest = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    each = rest.select("query_id", F.explode(words("query")).alias("word"))
    near = each.join(most_like(each.select("word"), ids, least), "word").select("query_id", "doc_id").distinct()
    return exact.unionByName(near)
