"""Page relations read from stored tables: recognised items, ruled lines, regions and mappings.

Every reader takes the newest delivery of a row, drops rows that no operator
could place (no whole box, no text) and derives the box columns once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import geometry as g
from quillgrid.functions.text import strip
from quillgrid.session import read


def newest(rows: DataFrame, key: str) -> DataFrame:
    """One row per key, of the greatest loaded_at; rows with a null key are dropped."""
    rest = [c for c in rows.columns if c != key]
    ordered = F.struct("loaded_at", *[c for c in rest if c != "loaded_at"])
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(ordered).alias("r")).select(key, "r.*")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, item_idx, text, confidence (NaN is null), source_item_count, box x1..y2 and polygon centre cx, cy."""
    rows = read(spark, sf_dir, "result_rows").select("row_id", "page_id", "item_idx", "text", "bbox", "confidence", "source_item_count", "loaded_at")
    once = newest(rows.withColumn("text", strip("text")).filter((F.col("text") != "") & g.valid_polygon(F.col("bbox"))), "row_id")
    x1, y1, x2, y2 = g.polygon_bounds(F.col("bbox"))
    cx, cy = g.polygon_center(F.col("bbox"))
    return once.select("page_id", "item_idx", "text", F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"), F.coalesce("source_item_count", F.lit(1)).alias("source_item_count"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), cx.alias("cx"), cy.alias("cy"))


def line_columns() -> list[Column]:
    sx, sy, ex, ey = (F.col(c).cast("double") for c in ("sx", "sy", "ex", "ey"))
    return [
        F.least(sx, ex).alias("x1"),
        F.least(sy, ey).alias("y1"),
        F.greatest(sx, ex).alias("x2"),
        F.greatest(sy, ey).alias("y2"),
        ((sx + ex) / 2).alias("cx"),
        ((sy + ey) / 2).alias("cy"),
        g.distance(sx, sy, ex, ey).alias("length"),
    ]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, line_idx, sx, sy, ex, ey, field_type (null is `line`), box, centre and length."""
    rows = read(spark, sf_dir, "field_lines").select("line_id", "page_id", "line_idx", "sx", "sy", "ex", "ey", "field_type", "loaded_at")
    once = newest(rows.dropna(subset=["page_id", "sx", "sy", "ex", "ey"]), "line_id")
    return once.select("page_id", "line_idx", "sx", "sy", "ex", "ey", F.coalesce("field_type", F.lit("line")).alias("field_type"), *line_columns())


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in contours, 0 to 3 a page: page_id, region_idx, x, y, width, height, ink, rectangularity, vertices, h_rules, v_rules."""
    pages = read(spark, sf_dir, "runs").filter("stage = 'loaded'").select("page_id")
    p, k = F.col("page_id"), F.col("region_idx")
    each = pages.filter("page_id % 4 > 0").select("page_id", F.explode(F.sequence(F.lit(0), (F.col("page_id") % 4 - 1).cast("int"))).alias("region_idx"))
    return each.select(
        "page_id",
        "region_idx",
        (F.lit(20) + (p * 37 + k * 211) % 500).cast("int").alias("x"),
        (F.lit(30) + (p * 53 + k * 301) % 700).cast("int").alias("y"),
        (F.lit(18) + (p * 29 + k * 97) % 12 * ((p + k) % 5 * 6 + 1)).cast("int").alias("width"),
        (F.lit(14) + (p * 31 + k * 61) % 10 * ((p + k * 2) % 4 * 5 + 1)).cast("int").alias("height"),
        ((p * 17 + k * 29) % 60 / 100.0).alias("ink"),
        ((p * 13 + k * 7) % 100 / 100.0).alias("rectangularity"),
        ((p * 3 + k * 5) % 6 + 2).cast("int").alias("vertices"),
        ((p * 11 + k * 3) % 5).cast("int").alias("h_rules"),
        ((p * 7 + k * 5) % 4).cast("int").alias("v_rules"),
    )


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of both schemas: the older singular field_line becomes a list; NaN numbers become null."""
    rows = read(spark, sf_dir, "mappings")
    keep = ["mapping_id", "page_id", "label", "field_line", "field_lines", "field_type", "state", "distance", "candidate_score", "confidence_class", "region_support", "multiline_group_size", "loaded_at"]
    once = newest(rows.select(*keep), "mapping_id")
    old = F.when(F.col("field_line").isNotNull(), F.array(F.struct(F.col("field_line.start").alias("start"), F.col("field_line.end").alias("end"), F.lit("line").alias("field_type"))))
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return once.select("mapping_id", "page_id", strip("label").alias("label"), F.coalesce("field_lines", old).alias("field_lines"), "field_type", "state", number("distance"), number("candidate_score"), "confidence_class", "region_support", F.coalesce("multiline_group_size", F.lit(1)).alias("multiline_group_size"))
