"""Enclosed regions: what lies inside them and what they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import geometry as g


def _counted(regions: DataFrame, points: DataFrame, pad: float, out: str) -> DataFrame:
    p = points.select(F.col("page_id").alias("_p"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"))
    bounds = (F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height"))
    hit = (F.col("page_id") == F.col("_p")) & g.inside(F.col("_cx"), F.col("_cy"), bounds, pad)
    counts = regions.join(p, hit).groupBy("page_id", "region_idx").agg(F.count("*").alias(out))
    return regions.join(counts, ["page_id", "region_idx"], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def with_counts(regions: DataFrame, items: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds ocr_count (box centres within 4) and line_count (line centres inside)."""
    boxes = items.select("page_id", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    return _counted(_counted(regions, boxes, 4.0, "ocr_count"), lines, 0.0, "line_count")


#: Contours that are too ragged to be boxes fill less of them.
RAGGED = 0.18


def boxes(regions: DataFrame) -> DataFrame:
    """page_id, x, y, width, height of the regions that classify() keeps, but on any page, without what lies in them."""
    return regions.filter(F.col("rectangularity") >= RAGGED).select("page_id", "x", "y", "width", "height")


def classify(regions: DataFrame, items: DataFrame, lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """page_id, region_idx, x, y, width, height, type, confidence, reason and features; regions too ragged to be boxes are left out.

    `sizes` has page_id, image_width and image_height. The first rule that fits
    decides; `reason` names it. Features have 4 decimals.
    """
    h, w = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    text = items.groupBy("page_id").agg(g.positive_median(h, 18.0).alias("th"), g.positive_median(w, 72.0).alias("tw"))
    r = with_counts(regions, items, lines).join(sizes, "page_id").join(text, "page_id", "left").withColumns({"th": F.coalesce("th", F.lit(18.0)), "tw": F.coalesce("tw", F.lit(72.0)), "aspect": F.col("width") / F.greatest("height", F.lit(1))})
    width, height, th, tw, k, o, n, a = (F.col(c) for c in ("width", "height", "th", "tw", "ink", "ocr_count", "line_count", "aspect"))
    area = width * height / F.greatest(F.col("image_width") * F.col("image_height"), F.lit(1.0))
    rules = [
        ("checkbox_region", 0.90, "square_sparse_enclosed_region", a.between(0.75, 1.35) & (width <= F.greatest(th * 3.4, F.col("image_width") * 0.07)) & (height <= F.greatest(th * 3.4, F.col("image_height") * 0.07)) & (k < 0.55) & (o <= 1)),
        ("table_like_region", 0.84, "repeated_row_alignment", (n >= 3) | ((n >= 2) & (o >= 3) & (a >= 1.2)) | ((area >= 0.01) & (n >= 2) & (k >= 0.08))),
        ("multiline_text_region", 0.78, "aligned_repeated_field_lines", (a >= 1.8) & (height >= th * 2) & (o >= 2) & (k >= 0.02)),
        ("signature_area", 0.81, "wide_sparse_enclosed_region", (a >= 2) & (width >= tw * 2.8) & (height >= th * 1.6) & (o <= 2) & (n <= 1) & (k < 0.22)),
        ("photo_region", 0.86, "large_sparse_enclosure", a.between(0.7, 1.5) & (area >= 0.01) & (width >= th * 4) & (height >= th * 4) & (o <= 2) & (n == 0) & (k < 0.18)),
        ("non_text_sparse_region", 0.86, "large_enclosed_sparse_region", (area >= 0.012) & (height >= th * 3.5) & (o <= 3) & (n <= 2) & (k < 0.18)),
        ("non_text_candidate", 0.68, "tall_low_text_enclosed_region", (height > th * 3) & (width >= tw * 1.2) & (o <= 1)),
    ]
    kind, sure, why = F.lit("standard_input"), F.lit(0.58), F.lit("standard_field_geometry")
    for name, confidence, reason, rule in reversed(rules):
        kind, sure, why = (F.when(rule, F.lit(v)).otherwise(else_) for v, else_ in ((name, kind), (confidence, sure), (reason, why)))
    features = [g.round_to(v, 4).alias(n) for n, v in (("aspect_ratio", a), ("page_area_ratio", area), ("ink_density", k), ("box_fill", F.col("rectangularity")))]
    return r.filter(F.col("rectangularity") >= RAGGED).select("page_id", "region_idx", "x", "y", "width", "height", kind.alias("type"), sure.alias("confidence"), "ocr_count", "line_count", why.alias("reason"), *features)


def large_enough(contours: DataFrame, items: DataFrame, sizes: DataFrame) -> DataFrame:
    """Contours that can be regions at all: wide and high enough for the page's text, and smaller than the page."""
    text = items.groupBy("page_id").agg(g.positive_median(F.col("y2") - F.col("y1"), 18.0).alias("_th"))
    r = contours.join(sizes, "page_id").join(text, "page_id", "left").withColumn("_th", F.coalesce("_th", F.lit(18.0)))
    fits = (F.col("width") >= F.greatest(F.lit(44.0), F.col("image_width") * 0.025)) & (F.col("height") >= F.greatest(F.lit(14.0), F.col("_th") * 0.85)) & (F.col("width") <= F.col("image_width") * 0.985) & (F.col("height") <= F.col("image_height") * 0.9)
    return r.filter(fits).select(*contours.columns)


def ruled_tables(contours: DataFrame, sizes: DataFrame) -> DataFrame:
    """Contours of crossing rules that make a table: large, smaller than the page, two rules (`h_rules`, `v_rules`) or more each way."""
    r = contours.join(sizes, "page_id")
    return r.filter((F.col("width") >= 120) & (F.col("height") >= 60) & (F.col("width") <= F.col("image_width") * 0.98) & (F.col("height") <= F.col("image_height") * 0.75) & (F.col("h_rules") >= 2) & (F.col("v_rules") >= 2)).select(*contours.columns)


def checkboxes(contours: DataFrame, items: DataFrame) -> DataFrame:
    """Small squares of four to six corners, off the text, the first of each cell of 4 pixels, with the nearest label: page_id, region_idx, box, item_idx, label.

    Contours have x, y, width, height, rectangularity and vertices. Squares
    without a label near them are left out.
    """
    aspect = F.col("width") / F.col("height")
    small = contours.filter(F.col("width").between(10, 32) & F.col("height").between(10, 32) & aspect.between(0.85, 1.18) & F.col("rectangularity").between(0.18, 0.95) & F.col("vertices").between(4, 6))
    free = checkboxes_off_text(small, items)
    cell = Window.partitionBy("page_id", *[g.half_even_key(F.col(c), 4) for c in ("x", "y", "width", "height")]).orderBy("region_idx")
    once = free.withColumn("_rn", F.row_number().over(cell)).filter("_rn = 1").drop("_rn")
    return once.select("page_id", "region_idx", "x", "y", "width", "height").join(nearest_label(once, items).select("page_id", "region_idx", "item_idx", "label"), ["page_id", "region_idx"])


def of_types(regions: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return regions.filter(F.col("type").isin(*types))


def checkboxes_off_text(boxes: DataFrame, items: DataFrame, pad: float = 2.0) -> DataFrame:
    """Boxes (x, y, width, height) that touch no text within the padding."""
    i = items.select(F.col("page_id").alias("_p"), *[F.col(k).alias(f"_{k}") for k in ("x1", "y1", "x2", "y2")])
    touch = (F.col("x") <= F.col("_x2") + pad) & (F.col("x") + F.col("width") >= F.col("_x1") - pad) & (F.col("y") <= F.col("_y2") + pad) & (F.col("y") + F.col("height") >= F.col("_y1") - pad)
    return boxes.join(i, (F.col("page_id") == F.col("_p")) & touch, "left_anti")


def nearest_label(boxes: DataFrame, items: DataFrame, max_dy: float = 35.0, max_score: float = 260.0) -> DataFrame:
    """page_id, region_idx, item_idx, label, score: the text of least |dx| + 2 |dy| of each box, if near enough; first of equals."""
    bx, by = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    dx, dy = F.abs(F.col("cx") - bx), F.abs(F.col("cy") - by)
    pairs = boxes.select("page_id", "region_idx", "x", "y", "width", "height").join(items.select("page_id", "item_idx", "text", "cx", "cy"), "page_id").filter((dy <= max_dy) & (dx + dy * 2 <= max_score))
    best = pairs.groupBy("page_id", "region_idx").agg(F.min(F.struct((dx + dy * 2).alias("score"), "item_idx", F.col("text").alias("label"))).alias("b"))
    return best.select("page_id", "region_idx", "b.item_idx", "b.label", "b.score")
