"""Quality of answers by heuristics, summaries and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Categories and their keywords.
CATEGORIES = {
    "總經理": ["總經理", "經理", "執行長", "CEO"],
    "酬金": ["酬金", "薪資", "報酬", "薪資報酬"],
    "董事": ["董事", "董事會", "獨立董事"],
    "稅後純益": ["稅後純益", "淨利", "純益", "稅後"],
    "比例": ["比例", "百分比", "%", "占比"],
    "年度": ["年度", "年", "113年", "112年"],
    "會議": ["會議", "開會", "召開"],
    "出席": ["出席", "出席率", "委託"],
    "委員會": ["委員會", "薪資報酬委員會", "審計委員會", "提名委員會"],
    "政策": ["政策", "規定", "法規"],
    "員工酬勞": ["員工酬勞", "股票", "現金"],
    "揭露": ["揭露", "公開", "資訊"],
    "證券交易法": ["證券交易法", "第14條", "第14條之3"],
}
#: Words that show a failed answer.
ERROR_WORDS = "error|抱歉|無法"
CJK_DIGITS = "[一二三四五六七八九十百千萬億]"


def quality(answers: DataFrame, categories: dict[str, list[str]] = CATEGORIES) -> DataFrame:
    """(id, quality and its parts) of (id, question, response)."""
    q, r = F.lower("question"), F.lower(F.coalesce("response", F.lit("")))
    asked = {c: F.exists(F.array(*map(F.lit, words)), lambda w: q.contains(w)) for c, words in categories.items()}
    met = {c: F.exists(F.array(*map(F.lit, words)), lambda w: r.contains(w)) for c, words in categories.items()}
    own = answers.withColumns({
        "response_length": F.length(F.coalesce("response", F.lit(""))),
        "total_keywords": sum(asked[c].cast("int") for c in categories),
        "matched_keywords": sum((asked[c] & met[c]).cast("int") for c in categories),
        "has_error": r.rlike(ERROR_WORDS),
        "has_numbers": r.rlike("[0-9]"),
        "has_percentage": r.contains("%"),
        "has_cjk_digits": r.rlike(CJK_DIGITS),
    })
    own = own.withColumn("relevance", F.round(F.col("matched_keywords") / F.greatest(F.col("total_keywords"), F.lit(1)), 6))
    length = F.when(F.col("response_length").between(50, 1000), 2).when(F.col("response_length") > 1000, 1).otherwise(0)
    score = F.when(F.col("has_error"), 0).otherwise(3) + length + 3 * F.col("relevance") + (F.col("has_numbers") | F.col("has_percentage")).cast("int") + 0.5 * F.col("has_cjk_digits").cast("int")
    return own.withColumn("quality", F.round(F.least(score, F.lit(10.0)), 6))


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Totals, means and extremes of (quality, seconds, has_error, response_length, relevance), by group if asked."""
    r6 = lambda c: F.round(c, 6)
    return results.groupBy(*by).agg(
        F.count("*").alias("total"), r6(F.avg("quality")).alias("avg_quality"), F.min("quality").alias("min_quality"), F.max("quality").alias("max_quality"),
        r6(F.avg("seconds")).alias("avg_seconds"), r6(100 * F.avg((~F.col("has_error")).cast("double"))).alias("success_percent"),
        r6(F.avg("response_length")).alias("avg_length"), r6(F.avg("relevance")).alias("avg_relevance"),
    )


def extremes(results: DataFrame, k: int = 5) -> DataFrame:
    """(kind, place, id): best and worst by quality, fastest and slowest, k each."""
    out = None
    for kind, order in (("best", F.desc("quality")), ("worst", F.asc("quality")), ("fastest", F.asc("seconds")), ("slowest", F.desc("seconds"))):
        top = results.orderBy(order, "id").limit(k)
        own = top.select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(order, "id")).alias("place"), "id")
        out = own if out is None else out.unionByName(own)
    return out


def page_pairs(pages: DataFrame) -> DataFrame:
    """Neighbouring lines of a document (doc_id, page, text) as positive pairs; pairs grow with the lines, not with their square."""
    after = F.lead("text").over(Window.partitionBy("doc_id").orderBy("page"))
    return pages.where(F.length(F.trim("text")) > 0).select("doc_id", "page", F.col("text").alias("text1"), after.alias("text2")).where("text2 IS NOT NULL").withColumn("label", F.lit(0.9))


def negative_pairs(texts: DataFrame, most: int = 100) -> DataFrame:
    """Texts (id, text) paired with the next in the order of a hash, at most ``most`` and half of them, as negatives."""
    order = [F.md5(F.col("id").cast("string").cast("binary")), F.col("id")]
    count = texts.count()
    n = min(most, count // 2)
    at = F.row_number().over(Window.orderBy("h", "id"))
    first = texts.select("id", order[0].alias("h")).orderBy("h", "id").limit(2 * n).withColumn("n", at)
    return first.where("n % 2 = 1").select("n", F.col("id").alias("id1")).join(first.where("n % 2 = 0").select((F.col("n") - 1).alias("n"), F.col("id").alias("id2")), "n").select("id1", "id2", F.lit(0.1).alias("label"))


def split_80_20(rows: DataFrame, key: str) -> DataFrame:
    """part ``train`` or ``valid`` by the first digits of a hash of the key."""
    digit = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 4), 16, 10).cast("int")
    return rows.withColumn("part", F.when(digit % 10 < 8, "train").otherwise("valid"))
