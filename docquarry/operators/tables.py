"""Table operators on cells in long form: (doc_id, table_id, row_idx, col_idx, col, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import ids, numeric, text

TABLE = ["doc_id", "table_id"]
ROW = [*TABLE, "row_idx"]
#: Fixed value: words that mark a row of totals.
AGGREGATE = r"(?i)(總計|合計|平均|小計|Total|Average)"
QUANT_SHARE, MOST_ROWS = 0.3, 200


def header_rows(cells: DataFrame) -> DataFrame:
    """Cells with is_header: rows before the first that has a pure number, by table."""
    numeric_row = cells.groupBy(*ROW).agg(F.max(numeric.pure_number(F.col("val")).cast("int")).alias("has"))
    before = F.sum("has").over(Window.partitionBy(*TABLE).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0))
    return cells.join(numeric_row.withColumn("is_header", before == 0).drop("has"), ROW)


def filled_headers(headers: DataFrame) -> DataFrame:
    """Headers (table_id, col_idx, header) with blanks taken from the left; a second column of one name gets ``_2``."""
    own = headers.withColumn("header", F.coalesce(F.last(F.nullif(F.trim("header"), F.lit("")), ignorenulls=True).over(Window.partitionBy("table_id").orderBy("col_idx")), F.lit("")))
    n = F.row_number().over(Window.partitionBy("table_id", "header").orderBy("col_idx"))
    return own.withColumn("name", F.when(n > 1, F.concat_ws("_", "header", n.cast("string"))).otherwise(F.col("header")))


def collapsed_headers(headers: DataFrame) -> DataFrame:
    """Header rows (table_id, row_idx, col_idx, header) as one name a column, without repeats of the row above."""
    above = F.lag("header").over(Window.partitionBy("table_id", "col_idx").orderBy("row_idx"))
    kept = headers.withColumn("above", above).where("header <> '' AND (above IS NULL OR above <> header)")
    parts = F.sort_array(F.collect_list(F.struct("row_idx", "header")))
    return kept.groupBy("table_id", "col_idx").agg(F.array_join(F.transform(parts, lambda x: x["header"]), " ").alias("header"))


def split_notes(cells: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Cells with is_note: rows whose only cell that is not blank is the first one."""
    shape = cells.groupBy(*ROW).agg(F.count_if(F.trim(F.coalesce("val", F.lit(""))) != "").alias("filled"), F.max(F.when(F.col("col_idx") == 0, F.col("val"))).alias("first"))
    return cells.join(shape.withColumn("is_note", (F.col("filled") == 1) & (F.trim(F.coalesce("first", F.lit(""))) != "")).drop("filled", "first"), ROW)


def constant_columns(cells: DataFrame) -> DataFrame:
    """Cells with blanks of a column filled where it has one value only."""
    own = F.nullif(F.trim("val"), F.lit(""))
    one = cells.groupBy(*TABLE, "col_idx").agg(F.countDistinct(own).alias("n"), F.max(own).alias("only")).where("n = 1").drop("n")
    return cells.join(one, [*TABLE, "col_idx"], "left").withColumn("val", F.coalesce(own, "only", "val")).drop("only")


def modal_first_column(cells: DataFrame) -> DataFrame:
    """The most frequent value of the first column by table; of equal ones the first seen."""
    counted = cells.where("col_idx = 0 AND trim(val) <> ''").groupBy(*TABLE, "val").agg(F.count("*").alias("n"), F.min("row_idx").alias("first"))
    return counted.groupBy(*TABLE).agg(F.max_by("val", F.struct("n", -F.col("first"))).alias("label"))


def numeric_density(cells: DataFrame) -> DataFrame:
    """Share of numbers among cells that are not blank, and the kind of table it speaks for."""
    own = cells.where("trim(val) <> ''").groupBy(*TABLE).agg(F.round(F.avg(numeric.is_number(F.col("val")).cast("double")), 6).alias("density"))
    quant = F.col("density") > QUANT_SHARE
    return own.withColumns({"kind": F.when(quant, "fact_quant").otherwise("generic"), "confidence": F.when(quant, 0.8).otherwise(0.6)})


def observations(cells: DataFrame, flag_aggregates: bool = False) -> DataFrame:
    """One row for each cell that is not blank; the row's cells that are no numbers are its dimensions."""
    shown = cells.where("val IS NOT NULL AND trim(val) <> ''").dropna(subset=ROW).withColumn("num", numeric.to_number(F.col("val")))
    # a row's cells come together once: joined to themselves, one side could be broadcast by the size of its file.
    # Sorted so that of equal keys the last one wins, as a later cell overwrites an earlier one
    rows = shown.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("col_idx", "col", "val", "num"))).alias("cells"))
    joined = rows.select(*ROW, F.filter("cells", lambda x: x["num"].isNull()).alias("labels"), F.inline("cells"))
    others = F.filter("labels", lambda x: x["col_idx"] != F.col("col_idx"))
    last = F.filter(others, lambda x: F.size(F.filter(others, lambda y: (y["col"] == x["col"]) & (y["col_idx"] > x["col_idx"]))) == 0)
    dims = F.map_from_entries(F.transform(last, lambda x: F.struct(x["col"], x["val"])))
    panel = text.panel_name(F.coalesce(F.get(F.transform("labels", lambda x: x["val"]), 0), F.lit("")))
    found = F.exists(F.transform("labels", lambda x: x["val"]), lambda v: v.rlike(AGGREGATE)) if flag_aggregates else F.lit(False)
    own = {"metric_leaf": F.col("col"), "dimensions": dims, "value_raw": F.col("val"), "value_num": F.col("num"), "panel": panel, "aggregate": found}
    own["source_hash"] = ids.observation_hash(*(F.col(c) for c in ("doc_id", "table_id", "row_idx", "col_idx", "col", "val")))
    return joined.select(*ROW, "col_idx", *(v.alias(k) for k, v in own.items()))


def kg_summary(obs: DataFrame) -> DataFrame:
    """Counts by table: observations, numbers, panels, metrics and dimension keys."""
    keys = obs.select(*TABLE, F.explode_outer(F.map_keys("dimensions")).alias("k")).groupBy(*TABLE).agg(F.countDistinct("k").alias("dimension_keys"))
    own = obs.groupBy(*TABLE).agg(F.count("*").alias("observations"), F.count("value_num").alias("numbers"), F.countDistinct("panel").alias("panels"), F.countDistinct("metric_leaf").alias("metrics"))
    return own.join(keys, TABLE)


def row_texts(cells: DataFrame) -> DataFrame:
    """``key: value`` lines of rows, in column order, and their number of values."""
    entries = F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "col", "val"))), lambda x: F.struct(x["col"].alias("key"), x["val"].alias("value")))
    own = cells.groupBy(*ROW).agg(entries.alias("e"), F.count_if(F.trim(F.coalesce("val", F.lit(""))) != "").alias("value_count"))
    return own.select(*ROW, text.pairs_line(F.col("e"), " | ").alias("text"), "value_count")


def _first_names(obs: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, table_id, at, name): the distinct names of each table in order; no more of them than ``most`` characters can show, as a name comes with two."""
    named = obs.select(*TABLE, F.col(column).alias("name")).where("name is not null").distinct()
    at = F.row_number().over(Window.partitionBy(*TABLE).orderBy("name"))
    return named.select(*TABLE, at.alias("at"), "name").where(F.col("at") <= most // 2 + 1)


def table_texts(obs: DataFrame, most: int = 400) -> DataFrame:
    """A text for each table: its panels, metrics and first three values, cut to ``most`` characters."""
    at = F.row_number().over(Window.partitionBy(*TABLE).orderBy("row_idx", "col_idx"))
    top = obs.select(*TABLE, at.alias("at"), F.col("value_raw").alias("name")).where("at <= 3")  # each task hands on three a table
    # the few names of a table meet by one grouping and by no join, whose side could be sent to the driver
    each = _first_names(obs, "panel", most).withColumn("part", F.lit(0)).unionByName(_first_names(obs, "metric_leaf", most).withColumn("part", F.lit(1))).unionByName(top.withColumn("part", F.lit(2)))
    few = each.groupBy(*TABLE).agg(F.sort_array(F.collect_list(F.struct("part", "at", "name"))).alias("few"))
    shown = lambda part: F.array_join(F.transform(F.filter("few", lambda x: x["part"] == part), lambda x: x["name"]), ", ")
    return few.select(*TABLE, F.substring(F.concat_ws(" | ", *map(shown, range(3))), 1, most).alias("text"))


def capped_rows(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Rows (doc_id, table_id, row_idx, aggregate): at most ``most`` a table, rows of totals first and never left out."""
    at = F.row_number().over(Window.partitionBy(*TABLE).orderBy(F.desc("aggregate"), "row_idx"))
    return rows.withColumn("at", at).where((F.col("at") <= most) | F.col("aggregate")).drop("at")


def column_texts(cells: DataFrame, shown: int = 10) -> DataFrame:
    """A sentence for each column with its first values and how many more there are."""
    own = cells.where("trim(val) <> ''")
    at = F.row_number().over(Window.partitionBy(*TABLE, "col").orderBy("row_idx", "val"))
    top = own.select(*TABLE, "col", "val", at.alias("at")).where(F.col("at") <= shown)  # each task hands on that many a column
    first = top.groupBy(*TABLE, "col").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "val"))), lambda x: x["val"]).alias("v"))
    sized = own.groupBy(*TABLE, "col").agg(F.count("*").alias("n")).join(first, [*TABLE, "col"])
    return sized.select(*TABLE, "col", text.column_sentence(F.col("col"), F.col("v"), F.col("n")).alias("text"))


def summaries(cells: DataFrame) -> DataFrame:
    """The offline summary of a table: its id, first columns and number of rows."""
    columns = F.transform(F.array_sort(F.collect_set(F.struct("col_idx", "col"))), lambda x: x["col"])
    own = cells.groupBy(*TABLE).agg(columns.alias("c"), F.countDistinct("row_idx").alias("n"))
    listed = F.concat(F.lit("，包含 "), F.size("c").cast("string"), F.lit(" 欄位: "), F.array_join(F.slice("c", 1, 5), ", "), F.when(F.size("c") > 5, "等").otherwise(""))
    return own.select(*TABLE, F.concat(F.lit("表格 "), F.col("table_id"), listed, F.lit("，共 "), F.col("n").cast("string"), F.lit(" 筆記錄。")).alias("text"))


def nodes(cells: DataFrame, records: int = 10) -> DataFrame:
    """Nodes of tables: one summary, the first ``records`` rows and every column."""
    first = F.dense_rank().over(Window.partitionBy(*TABLE).orderBy("row_idx"))
    rows = row_texts(cells).withColumn("at", first).where(F.col("at") <= records)
    none = F.lit(None)
    return (
        summaries(cells).select(*TABLE, F.lit("table_summary").alias("type"), none.cast("long").alias("row_idx"), none.cast("string").alias("column_name"), "text")
        .unionByName(rows.select(*TABLE, F.lit("table_record").alias("type"), "row_idx", none.cast("string").alias("column_name"), "text"))
        .unionByName(column_texts(cells).select(*TABLE, F.lit("table_column").alias("type"), none.cast("long").alias("row_idx"), F.col("col").alias("column_name"), "text"))
    )


def grid_of_text(raw: DataFrame) -> DataFrame:
    """Cells (id, row_idx, col_idx, val) of delimited texts (id, text); the delimiter is the first of tab, bar, comma and semicolon in line one."""
    first = F.substring_index("text", "\n", 1)
    delimiter = F.coalesce(*(F.when(first.contains(d), d) for d in ("\t", "|", ",", ";")), F.lit("\t"))
    lines = raw.select("id", delimiter.alias("d"), F.posexplode(F.split("text", "\n")).alias("row_idx", "line")).where("trim(line) <> ''")
    pattern = F.concat(F.lit("\\Q"), F.col("d"), F.lit("\\E"))
    return lines.select("id", "row_idx", F.posexplode(F.split("line", pattern)).alias("col_idx", "val")).withColumn("val", F.trim("val"))


def dense_grid(cells: DataFrame) -> DataFrame:
    """Every (row, column) of each grid (id, row_idx, col_idx, val), empty where there is no cell."""
    size = cells.groupBy("id").agg(F.max("row_idx").alias("r"), F.max("col_idx").alias("c"))
    every = size.select("id", F.explode(F.sequence(F.lit(0), "r")).alias("row_idx"), "c").select("id", "row_idx", F.explode(F.sequence(F.lit(0), "c")).alias("col_idx"))
    return every.join(cells, ["id", "row_idx", "col_idx"], "left").withColumn("val", F.coalesce("val", F.lit("")))


def largest_candidate(candidates: DataFrame) -> DataFrame:
    """Of each table's candidates (key, candidate, rows) the one with most rows; of equal ones the first."""
    at = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("rows"), "candidate"))
    return candidates.withColumn("at", at).where("at = 1").drop("at")


def detections(found: DataFrame, least: float = 50.0) -> DataFrame:
    """Detected tables of enough accuracy, numbered by page and order."""
    return found.where(F.col("accuracy") >= least).withColumn("table_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "ord")))


def is_aggregate(label: Column) -> Column:
    return label.rlike(AGGREGATE)
