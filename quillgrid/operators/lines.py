"""Ruled lines: duplicates, the field-line filter and table rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.config import DEFAULT, Config
from quillgrid.functions import geometry as g
from quillgrid.sources.tables import line_columns


def deduplicate(lines: DataFrame) -> DataFrame:
    """First line of each cell of left end, right end and height, by start height, start and line_idx."""
    key = [g.half_even_key(F.col("x1"), 12), g.half_even_key(F.col("x2"), 12), g.half_even_key(F.col("cy"), 6)]
    w = Window.partitionBy("page_id", *key).orderBy("sy", "sx", "line_idx")
    return lines.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def is_field_like(c: Config = DEFAULT) -> Column:
    """Level, long enough and on the right side."""
    return (F.abs(F.col("sy") - F.col("ey")) < 5) & (F.col("length") > c.min_line_length) & (F.col("cx") > c.right_of)


def near_text(lines: DataFrame, items: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Lines with some text's centre near in height and not too far to the left."""
    i = items.select(F.col("page_id").alias("_p"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"))
    near = (F.col("_cx") <= F.col("x2") + 80) & (F.col("x1") <= F.col("_cx") + 900) & (F.abs(F.col("_cy") - F.col("cy")) < c.near_text)
    return lines.join(i, (F.col("page_id") == F.col("_p")) & near, "left_semi")


def off_text(lines: DataFrame, items: DataFrame, padding: float = 2.0) -> DataFrame:
    """Lines that don't run through a text's interior."""
    i = items.select(F.col("page_id").alias("_p"), *[F.col(k).alias(f"_{k}") for k in ("x1", "y1", "x2", "y2")])
    height = F.greatest(F.col("_y2") - F.col("_y1"), F.lit(1.0))
    level = F.col("cy").between(F.col("_y1") + F.greatest(F.lit(2.0), height * 0.15) - padding, F.col("_y2") - F.greatest(F.lit(2.0), height * 0.10) + padding)
    over = F.least(F.col("x2"), F.col("_x2") + padding) - F.greatest(F.col("x1"), F.col("_x1") - padding)
    enough = F.least(F.greatest(F.col("_x2") - F.col("_x1"), F.lit(1.0)) * 0.35, F.greatest(F.col("x2") - F.col("x1"), F.lit(1.0)) * 0.55)
    return lines.join(i, (F.col("page_id") == F.col("_p")) & level & (over > 0) & ((over >= enough) | (over >= 24.0)), "left_anti")


def outside_regions(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines whose centre lies in none of the regions (bounds included)."""
    r = regions.select(F.col("page_id").alias("_p"), "x", "y", "width", "height")
    inside = g.inside(F.col("cx"), F.col("cy"), (F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height")))
    return lines.join(r, (F.col("page_id") == F.col("_p")) & inside, "left_anti")


def field_lines(lines: DataFrame, items: DataFrame, excluded: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """The field-line filter; cheap tests come before the joins."""
    return deduplicate(off_text(near_text(outside_regions(lines.filter(is_field_like(c)), excluded), items, c), items))


def _islands(lines: DataFrame, by: str, gap: float) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy(by, "line_idx")
    start = F.when(F.abs(F.col(by) - F.lag(by).over(w)) < gap, 0).otherwise(1)
    return lines.withColumn("_start", start).withColumn("group_idx", F.sum("_start").over(w) - 1).drop("_start").withColumn("group_lines", F.count("*").over(Window.partitionBy("page_id", "group_idx")))


def table_groups(lines: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Lines of dense runs that look like a table: page_id, line_idx, group_idx, group_lines."""
    return _islands(lines, "sy", c.table_gap).filter(F.col("group_lines") >= c.table_lines)


def without_rules(lines: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Lines without clusters at nearly one height, which are table borders."""
    return _islands(lines, "cy", c.rule_gap).filter(F.col("group_lines") < c.rule_lines).drop("group_idx", "group_lines")


def fallback_lines(items: DataFrame, page_width: Column, min_width: float = 120.0) -> DataFrame:
    """A field line to the right of each text left of three quarters of the page, if it is long enough."""
    sx = (F.col("x2") + 24).cast("int")
    ex = F.least((page_width - 40).cast("int"), sx + 320)
    y = (F.col("y2") + 4).cast("int")
    made = items.filter(F.col("cx") <= page_width * 0.75).select("page_id", F.col("item_idx").alias("line_idx"), sx.alias("sx"), y.alias("sy"), ex.alias("ex"), y.alias("ey"), F.lit("fallback_text_region").alias("field_type"))
    return made.filter(F.col("ex") - F.col("sx") >= min_width).select("*", *line_columns())


def box_bottoms(contours: DataFrame, sizes: DataFrame) -> DataFrame:
    """The lower edges of contours that look like input boxes, as lines of type `box`; line_idx is the region's."""
    r = contours.join(sizes, "page_id")
    fits = (F.col("width") >= 80) & F.col("height").between(12, 90) & (F.col("width") <= F.col("image_width") * 0.95) & (F.col("height") <= F.col("image_height") * 0.25) & (F.col("rectangularity") >= 0.35)
    low = F.col("y") + F.col("height")
    made = r.filter(fits).select("page_id", F.col("region_idx").alias("line_idx"), F.col("x").alias("sx"), low.alias("sy"), (F.col("x") + F.col("width")).alias("ex"), low.alias("ey"), F.lit("box").alias("field_type"))
    return made.select("*", *line_columns())


def weak_lines(strokes: DataFrame) -> DataFrame:
    """Strokes that are nearly level (8 pixels), as lines of type `weak_line`."""
    return strokes.filter(F.abs(F.col("sy") - F.col("ey")) <= 8).withColumn("field_type", F.lit("weak_line"))


def union_candidates(*sources: DataFrame) -> DataFrame:
    """All line sources together, without duplicates; line_idx is renumbered by source, then line_idx."""
    out = None
    for k, s in enumerate(sources):
        one = s.select("page_id", "sx", "sy", "ex", "ey", "field_type", F.lit(k).alias("_source"), "line_idx")
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("page_id").orderBy("_source", "line_idx")
    numbered = out.withColumn("line_idx", F.row_number().over(w) - 1).drop("_source")
    return deduplicate(numbered.select("*", *line_columns()))
