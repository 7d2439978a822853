"""What leaves the engine: field boxes, form geometry, draw lists, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.text import field_name

#: Letter paper in points.
PAPER = (612.0, 792.0)


def field_boxes(mappings: DataFrame) -> DataFrame:
    """One row per mapped line: mapping_id, page_id, label, box_idx, x, y, width, height, field_type.

    Mappings without lines, and lines whose ends aren't two numbers, give none.
    """
    each = mappings.select("mapping_id", "page_id", "label", F.posexplode("field_lines").alias("box_idx", "l"))
    x1, y1, x2, y2 = F.col("l.start")[0], F.col("l.start")[1], F.col("l.end")[0], F.col("l.end")[1]
    boxes = each.select("mapping_id", "page_id", "label", "box_idx", F.least(x1, x2).alias("x"), F.greatest(F.lit(0), F.least(y1, y2) - 4).alias("y"), F.abs(x2 - x1).alias("width"), F.lit(18).alias("height"), F.coalesce(F.col("l.field_type"), F.lit("line")).alias("field_type"), (x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()).alias("_ok"))
    return boxes.filter("_ok").drop("_ok")


def all_boxes(mappings: DataFrame, explicit: DataFrame) -> DataFrame:
    """field_boxes() of the mappings, but the given boxes for those that have some: explicit has mapping_id, page_id, label, box_idx, x, y, width, height, field_type."""
    own = explicit.select("mapping_id", "page_id", "label", "box_idx", "x", "y", "width", "height", "field_type")
    lined = field_boxes(mappings).join(own.select("mapping_id").distinct(), "mapping_id", "left_anti")
    return own.unionByName(lined)


def mappings_url(preview: Column) -> Column:
    """The address of a run's mappings from that of its preview picture."""
    return F.regexp_replace(preview, r"(?i)mapping\.png(?:\?.*)?$", "mappings.json")


def form_fields(boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Fields of a fillable page, in points from the lower left: name, kind, x, y, width, height. Boxes without extent are left out.

    `sizes` has page_id, image_width, image_height (both above 0).
    """
    sx, sy = F.lit(PAPER[0]) / F.col("image_width"), F.lit(PAPER[1]) / F.col("image_height")
    b = boxes.filter("width > 0 and height > 0").join(sizes.filter("image_width > 0 and image_height > 0"), "page_id")
    height = F.greatest(F.lit(12.0), F.col("height") * sy)
    check = F.col("field_type") == "checkbox"
    side = F.greatest(F.lit(10.0), F.least(F.col("width") * sx, height))
    name = field_name(F.concat(F.coalesce("label", F.lit("field")), F.lit("_"), (F.col("box_idx") + 1).cast("string")), F.col("mapping_id"))
    return b.select("page_id", "mapping_id", "box_idx", name.alias("name"), F.when(check, "checkbox").otherwise("text").alias("kind"), (F.col("x") * sx + 5).alias("x"), (F.lit(PAPER[1]) - (F.col("y") + F.col("height")) * sy).alias("y"), F.when(check, side).otherwise(F.greatest(F.lit(10.0), F.col("width") * sx - 10)).alias("width"), F.when(check, side).otherwise(height).alias("height"))


def percent_boxes(boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Boxes in percent of the page: left, top, width, height."""
    pct = lambda c, of: F.col(c) / F.col(of) * 100
    return boxes.join(sizes.filter("image_width > 0 and image_height > 0"), "page_id").select("page_id", "mapping_id", "box_idx", pct("x", "image_width").alias("left"), pct("y", "image_height").alias("top"), pct("width", "image_width").alias("width"), pct("height", "image_height").alias("height"))


def draw_list(entities: DataFrame) -> DataFrame:
    """What an overlay draws: page_id, id, box, colour class and caption (80 characters)."""
    caption: Column = F.substring(F.coalesce("text", "entity_type", F.lit("")), 1, 80)
    colour = F.when(F.col("kind") == "ocr", F.when(F.col("confidence") < 0.35, "low").otherwise("text")).when(F.col("kind") == "field_line", "line").otherwise("region")
    return entities.select("page_id", "id", "x1", "y1", "x2", "y2", colour.alias("colour"), caption.alias("caption"))


def absolute_url(url: Column, base: str) -> Column:
    """Relative addresses under the base; absolute ones as they are; null and blank are null."""
    return F.when(url.rlike("^https?://"), url).when(url.startswith("/"), F.concat(F.lit(base.rstrip("/")), url)).when(url != "", F.concat(F.lit(base.rstrip("/") + "/"), url))


def write_json(df: DataFrame, path: str) -> int:
    """Writes JSON lines and returns the rows read back; raises if nothing was written."""
    df.write.mode("errorifexists").json(path)
    n = df.sparkSession.read.schema(df.schema).json(path).count()
    if not n:
        raise RuntimeError(f"{path} is empty")
    return n


def valid_number(value: Column) -> Column:
    """Whether a value can be read as a number and is one."""
    number = value.try_cast("double")
    return F.coalesce(number.isNotNull() & ~F.isnan(number), F.lit(False))


def rooted_path(path: Column, root: str) -> Column:
    """Absolute paths as they are, others under the root."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
