"""Clean-up of recognised text: noise, text rows, merging of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import geometry as g
from quillgrid.functions import text as t
from quillgrid.operators.folds import first_fit_rows

def with_median_height(items: DataFrame, default: float = 24.0) -> DataFrame:
    """Adds median_height: the page's exact median of positive heights."""
    h = F.col("y2") - F.col("y1")
    return items.withColumn("median_height", F.coalesce(F.median(F.when(h > 0, h)).over(Window.partitionBy("page_id")), F.lit(default)))


def drop_noise(items: DataFrame) -> DataFrame:
    """Without items of low confidence that are short, full of symbols or flat. A null confidence counts as sure."""
    conf, text = F.coalesce("confidence", F.lit(1.0)), F.col("text")
    low = (conf < 0.15) & ((F.length(text) <= 8) | (t.symbol_ratio(text) >= 0.2))
    lone = (conf < 0.35) & (t.alnum_count(text) <= 2)
    flat = (conf < 0.40) & (F.col("y2") - F.col("y1") < F.greatest(F.col("median_height") * 0.45, F.lit(8.0)))
    return with_median_height(items).filter(~(low | lone | flat))


def text_rows(items: DataFrame, factor: float = 0.65, default: float = 24.0) -> DataFrame:
    """First-fit rows of a page; the tolerance is `factor` of the median height, 8 at least."""
    sized = items if "median_height" in items.columns else with_median_height(items, default)
    return first_fit_rows(sized.withColumn("tolerance", F.greatest(F.lit(8.0), F.col("median_height") * factor)))


def token_runs(rows: DataFrame) -> DataFrame:
    """Adds run_idx: neighbours of a row belong together if the gap is small and they overlap vertically."""
    w = Window.partitionBy("page_id", "row_idx").orderBy("x1", "item_idx")
    gap = F.col("x1") - F.lag("x2").over(w)
    shared = g.vertical_overlap((F.col("x1"), F.lag("y1").over(w), F.col("x1"), F.lag("y2").over(w)), g.box())
    joins = (gap >= 0) & (gap <= F.greatest(F.lit(42.0), F.col("median_height") * 1.8)) & (shared >= 0.45)
    return rows.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("run_idx", F.sum("_new").over(w) - 1).drop("_new")


def merge_tokens(items: DataFrame) -> DataFrame:
    """Noise dropped and tokens of a line joined: page_id, row_idx, run_idx, text, box, confidence (mean of the known), source_item_count, tokens."""
    runs = token_runs(text_rows(drop_noise(items)))
    parts = F.array_sort(F.collect_list(F.struct("x1", "item_idx", "text")))
    merged = runs.groupBy("page_id", "row_idx", "run_idx").agg(
        parts.alias("parts"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), g.round_to(F.avg("confidence"), 4).alias("confidence"), F.sum("source_item_count").alias("source_item_count"), F.count("*").alias("tokens")
    )
    joined = t.strip(F.regexp_replace(t.glue(F.transform("parts", lambda p: p["text"])), r"\s+", " "))
    return merged.withColumn("text", joined).drop("parts")


def quality_summary(items: DataFrame) -> DataFrame:
    """One row per page: counts, medians, confidences and rows of its items."""
    rows = text_rows(items, factor=0.70, default=18.0)
    per_row = rows.groupBy("page_id", "row_idx").agg(F.count("*").alias("n")).groupBy("page_id").agg(F.count("*").alias("row_count"), F.count_if(F.col("n") > 1).alias("rows_with_multiple_items"))
    merged = F.when(F.col("source_item_count") > 1, F.col("source_item_count"))
    summary = items.groupBy("page_id").agg(
        F.count("*").alias("item_count"),
        g.round_to(g.positive_median(F.col("y2") - F.col("y1"), 0.0), 2).alias("median_height"),
        g.round_to(g.positive_median(F.col("x2") - F.col("x1"), 0.0), 2).alias("median_width"),
        g.round_to(F.avg("confidence"), 4).alias("mean_confidence"),
        F.count_if(F.col("confidence") < 0.35).alias("low_confidence_count"),
        F.count(merged).alias("merged_item_count"),
        F.coalesce(F.sum(merged), F.lit(0)).alias("source_items_merged"),
    )
    return summary.join(per_row, "page_id")
