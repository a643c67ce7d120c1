"""Page layout: repeated margin lines, masked regions and page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPEAT_SHARE, LEAST_REPEATS, MARGIN = 0.7, 2, 60.0


def margin_lines(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, page, line_no, text, x0, y0, x1, y1, page_height) in the top or bottom margin."""
    return spans.where((F.col("y0") < MARGIN) | (F.col("y1") > F.col("page_height") - MARGIN))


def repeated_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, text, n) of margin lines found on at least 70 % of the document's pages, and twice; ``pages`` has (doc_id, page)."""
    size = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    counted = lines.where(F.trim("text") != "").groupBy("doc_id", F.trim("text").alias("text")).agg(F.count("*").alias("n"))
    return counted.join(size, "doc_id").where(F.col("n") >= F.greatest(F.lit(LEAST_REPEATS), F.floor(REPEAT_SHARE * F.col("pages")))).drop("pages")


def without_lines(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """Lines that are not repeated ones of their document."""
    gone = repeated.select(F.col("doc_id").alias("__d"), F.col("text").alias("__t"))
    return lines.join(gone, (F.col("doc_id") == F.col("__d")) & (F.trim("text") == F.col("__t")), "left_anti")


def overlaps(a: list[Column], b: list[Column]) -> Column:
    """Whether two boxes (x0, y0, x1, y1) meet; touching counts."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def outside_boxes(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """Spans that meet none of their page's boxes (doc_id, page, bx0, by0, bx1, by1)."""
    named = boxes.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), "bx0", "by0", "bx1", "by1")
    meets = overlaps([F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(c) for c in ("bx0", "by0", "bx1", "by1")])
    return spans.join(named, (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & meets, "left_anti")


def page_texts(lines: DataFrame) -> DataFrame:
    """(doc_id, page, text): a page's lines in order, white space collapsed."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    joined = F.trim(F.regexp_replace(F.array_join(ordered, " "), r"\s+", " "))
    return lines.groupBy("doc_id", "page").agg(joined.alias("text"))
