"""URL filtering by association rules, in DataFrame and SQL operations only.

URLs that a listed (host, path) rule judges are the labelled ones. FP-growth
mines which combinations of URL tokens go with ``block``; rules below the
bounds of support and confidence go, and those that hold another rule's tokens,
which judge nothing more. An inverted index, with each rule under one of its
tokens, finds for each other URL the rules whose tokens it has.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm import shared

#: (verdict, host, path); the longest that fits decides.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Labelled URLs that FP-growth sees, about; more are thinned by a hash of the URL and page_id.
MINED_ROWS = 200_000
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
#: Blocked rows that a rule needs at least, and how many times the odds of ``block`` among all labelled rows its odds must be.
MIN_ROWS, MIN_ODDS = 20, 3.0
_BLOCK = "=block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def listed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest listed rule that fits, as host and path in one string, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for said, own_host, own_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        rule, verdict = F.when(fits, own_host + own_path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: parts of the host by place, path segments, keys of the query and the scheme."""
    parts = F.filter(F.split(host, r"\."), lambda x: x != "")
    names = F.transform(parts, lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.filter(F.split(F.lower(path), "[/.]"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^[^=]*", 0)))
    scheme = F.array(F.concat(F.lit("s:"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1))))
    return F.array_distinct(F.concat(names, segments, keys, scheme))


def mine(labelled: DataFrame) -> DataFrame:
    """antecedent and confidence of rules for ``block`` from (tokens, verdict); no antecedent holds another rule's tokens.

    A rule's tokens stand in MIN_SUPPORT of the rows and MIN_ROWS blocked ones;
    its confidence is MIN_CONFIDENCE and MIN_ODDS times the odds of ``block``
    among all rows, or more. Where all rows are blocked there is nothing to tell
    them by, and no rule.
    """
    blocked, rows = labelled.agg(F.sum((F.col("verdict") == "block").cast("int")), F.count("*")).first()
    if not blocked or blocked == rows:
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, confidence double")
    odds = MIN_ODDS * blocked / (rows - blocked)
    support, confidence = min(1.0, max(MIN_SUPPORT, MIN_ROWS / rows)), max(MIN_CONFIDENCE, odds / (1 + odds))
    items = F.when(F.col("verdict") == "block", F.concat("tokens", F.array(F.lit(_BLOCK)))).otherwise(F.col("tokens"))
    fitted = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(labelled.select(items.alias("items")))
    found = fitted.associationRules.where(F.array_contains("consequent", _BLOCK)).select(F.array_sort("antecedent").alias("antecedent"), "confidence")
    ordered = F.array_sort(F.collect_list(F.struct(F.size("antecedent").alias("n"), "antecedent", "confidence")))
    fewest = F.expr("aggregate(ordered, slice(ordered, 1, 0), (kept, r) -> if(exists(kept, k -> size(array_except(k.antecedent, r.antecedent)) = 0), kept, array_append(kept, r)))")
    return found.agg(ordered.alias("ordered")).select(F.explode(fewest).alias("r")).select("r.antecedent", "r.confidence")


def inverted_index(rules: DataFrame) -> DataFrame:
    """One row: ``index``, from a token to the antecedents kept under it; each is under that of its tokens that the fewest rules hold."""
    tokens = rules.select("antecedent", F.explode("antecedent").alias("token"))
    held = tokens.withColumn("n", F.count("*").over(Window.partitionBy("token")))
    under = held.groupBy("antecedent").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    by_token = under.groupBy("token").agg(F.array_sort(F.collect_list("antecedent")).alias("rules"))
    return by_token.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "rules")))).alias("index"))


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and by_rules (the mined rules that fit, for URLs without a listed rule).

    Null URLs, and those without ``://``, have an empty host and path, and no
    rule; no tokens but an empty scheme, so they are allowed unless that
    scheme is mined. Repeated rows and null ids stay; other columns are
    ignored. Without labelled URLs everything else is allowed. Whole URLs count,
    however long; an empty table gives no rows.
    """
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"))
    parsed = parsed.withColumns({"rule": rule, "listed": verdict, "tokens": url_tokens(F.col("url"), F.col("host"), F.col("path"))})
    labelled = parsed.where("listed is not null").select("page_id", "url", "tokens", F.col("listed").alias("verdict"))
    rows = labelled.count()
    if rows > MINED_ROWS:
        labelled = labelled.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1_000_000)) < int(1_000_000 * MINED_ROWS / rows))
    if not rows:
        return parsed.select("page_id", "host", "path", "rule", F.coalesce("listed", F.lit("allow")).alias("verdict"), F.lit(0).alias("by_rules"))
    index = inverted_index(shared.cut_lineage(mine(labelled)))
    with_index = parsed.select("*", index.scalar().alias("index"))
    near = "flatten(transform(tokens, t -> coalesce(try_element_at(index, t), cast(array() as array<array<string>>))))"
    full = F.expr(f"size(filter({near}, r -> forall(r, x -> array_contains(tokens, x))))")
    matched = with_index.withColumn("by_rules", F.when(F.col("listed").isNull(), full).otherwise(F.lit(0)))
    said = F.coalesce("listed", F.when(F.col("by_rules") > 0, "block").otherwise("allow"))
    return matched.select("page_id", "host", "path", "rule", said.alias("verdict"), "by_rules")
