"""Page layout: metrics, entities, bands, columns, zones, ownership and the property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.config import LAYOUT_EXCLUDED
from quillgrid.functions import geometry as g
from quillgrid.operators.folds import running_mean_groups
from quillgrid.session import store


def metrics(items: DataFrame, lines: DataFrame, regions: DataFrame) -> DataFrame:
    """One row per page that has any row: extents, medians, tolerances, density and counts."""
    null = F.lit(None).cast("double")
    parts = items.select("page_id", "x2", "y2", (F.col("y2") - F.col("y1")).alias("h"), (F.col("x2") - F.col("x1")).alias("w"), null.alias("l"), F.lit("i").alias("k"))
    parts = parts.unionByName(lines.select("page_id", "x2", "y2", null.alias("h"), null.alias("w"), F.col("length").alias("l"), F.lit("l").alias("k")))
    parts = parts.unionByName(regions.select("page_id", (F.col("x") + F.col("width")).cast("double").alias("x2"), (F.col("y") + F.col("height")).cast("double").alias("y2"), null.alias("h"), null.alias("w"), null.alias("l"), F.lit("r").alias("k")))
    m = parts.groupBy("page_id").agg(
        F.greatest(F.max("x2"), F.lit(1.0)).alias("_pw"), F.greatest(F.max("y2"), F.lit(1.0)).alias("_ph"), g.positive_median(F.col("h"), 18.0).alias("_th"), g.positive_median(F.col("w"), 80.0).alias("_tw"), g.positive_median(F.col("l"), 220.0).alias("_ll"),
        F.count_if(F.col("k") == "i").alias("ocr_count"), F.count_if(F.col("k") == "l").alias("field_line_count"), F.count_if(F.col("k") == "r").alias("semantic_region_count"),
    )
    w, h, th, tw, ll = (F.col(c) for c in ("_pw", "_ph", "_th", "_tw", "_ll"))

    def most(*v: Column | float) -> Column:
        return g.round_to(F.greatest(*[x if isinstance(x, Column) else F.lit(float(x)) for x in v]), 2)

    return m.select(
        "page_id", most(w, 0).alias("page_width"), most(h, 0).alias("page_height"), g.round_to(w * h, 2).alias("page_area"), g.round_to(w / h, 4).alias("page_aspect_ratio"), g.round_to(w / 2, 2).alias("page_mid_x"), g.round_to(h / 2, 2).alias("page_mid_y"),
        g.round_to(th, 2).alias("avg_text_height"), g.round_to(tw, 2).alias("avg_text_width"), g.round_to(ll, 2).alias("avg_line_length"),
        most(18, th * 1.5, h * 0.008).alias("row_tolerance"), most(28, th * 2.3, h * 0.015).alias("band_tolerance"), most(28, tw * 0.8, w * 0.04).alias("column_tolerance"), most(34, th * 2.6, h * 0.03).alias("multiline_band_gap"),
        most(42, th * 3, w * 0.04).alias("indent_tolerance"), most(24, th * 1.9).alias("region_gap"), most(420, ll * 3.2, w * 0.55).alias("distance_limit"),
        g.round_to(F.col("ocr_count") / F.greatest(w * h / 100000.0, F.lit(1.0)), 4).alias("ocr_density"), "ocr_count", "field_line_count", "semantic_region_count",
    )


def entities(items: DataFrame, lines: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Items, lines and, if given, regions as one relation: page_id, kind, idx, id, text, entity_type, confidence, length, box, cx, cy (2 decimals)."""

    def one(kind: str, prefix: str, df: DataFrame, idx: str, text: Column, etype: Column, confidence: Column, length: Column, b: tuple[Column, ...]) -> DataFrame:
        cx, cy = g.center(b)
        return df.select("page_id", F.lit(kind).alias("kind"), F.col(idx).cast("int").alias("idx"), F.concat(F.lit(prefix), F.col(idx).cast("string")).alias("id"), text.cast("string").alias("text"), etype.cast("string").alias("entity_type"), confidence.cast("double").alias("confidence"), length.cast("double").alias("length"), *[g.round_to(v, 2).alias(n) for v, n in zip((*b, cx, cy), ("x1", "y1", "x2", "y2", "cx", "cy"))])

    none = F.lit(None)
    out = one("ocr", "ocr-", items, "item_idx", F.col("text"), none, F.coalesce("confidence", F.lit(0.0)), none, g.box()).unionByName(one("field_line", "field-", lines, "line_idx", none, F.col("field_type"), none, g.round_to(F.col("length"), 2), g.box()))
    if regions is None:
        return out
    r = (F.col("x").cast("double"), F.col("y").cast("double"), (F.col("x") + F.col("width")).cast("double"), (F.col("y") + F.col("height")).cast("double"))
    return out.unionByName(one("semantic_region", "region-", regions, "region_idx", none, F.col("type"), F.coalesce("confidence", F.lit(0.0)), none, r))


def banded(ents: DataFrame, m: DataFrame) -> DataFrame:
    """Items and lines with their band: adds band_idx and center_y (the band's mean height)."""
    rows = ents.filter("kind <> 'semantic_region'").join(m.select("page_id", "band_tolerance"), "page_id")
    return running_mean_groups(rows, ["page_id"], "cy", "band_tolerance", "band_idx").withColumnRenamed("band_idx_mean", "center_y").drop("band_tolerance")


def bands(members: DataFrame, m: DataFrame) -> DataFrame:
    """One row per band: page_id, band_idx, type, center_y, box, label_count, field_count, confidence, repetition_score."""
    labels, fields = F.count_if(F.col("kind") == "ocr"), F.count_if(F.col("kind") == "field_line")
    b = members.groupBy("page_id", "band_idx").agg(g.round_to(F.first("center_y"), 2).alias("center_y"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), labels.alias("label_count"), fields.alias("field_count"), F.count("*").alias("item_count")).join(m.select("page_id", "multiline_band_gap"), "page_id")
    kind = (
        F.when((F.col("y2") - F.col("y1") >= F.col("multiline_band_gap")) & (F.col("label_count") > 1), "multiline_band")
        .when(F.col("field_count") >= 4, "repeated_field_band")
        .when((F.col("label_count") >= 2) & (F.col("field_count") >= 1), "section_band")
        .when(F.col("field_count") >= 2, "field_band")
        .otherwise("label_band")
    )
    return b.select("page_id", "band_idx", kind.alias("type"), "center_y", "x1", "y1", "x2", "y2", "label_count", "field_count", "item_count", F.lit(0.8).alias("confidence"), g.round_to(F.col("field_count") / F.col("item_count"), 4).alias("repetition_score"))


def columned(ents: DataFrame, m: DataFrame, column_type: str | None = None) -> DataFrame:
    """Label items (left of 1.12 times the page's middle), lines, or each of both, with their column: adds column_idx and center_x."""
    kinds = {"label": ["ocr"], "field": ["field_line"], None: ["ocr", "field_line"]}[column_type]
    rows = ents.filter(F.col("kind").isin(kinds)).join(m.select("page_id", "column_tolerance", "page_mid_x"), "page_id")
    if "ocr" in kinds:
        rows = rows.filter((F.col("kind") != "ocr") | (F.col("cx") <= F.col("page_mid_x") * 1.12))
    return running_mean_groups(rows.drop("page_mid_x"), ["page_id"] if column_type else ["page_id", "kind"], "cx", "column_tolerance", "column_idx").withColumnRenamed("column_idx_mean", "center_x").drop("column_tolerance")


def columns(members: DataFrame, m: DataFrame, column_type: str) -> DataFrame:
    """One row per column: page_id, column_type, column_idx, center_x, box, item_count, support, average_item_width, confidence, lean, is_primary."""
    c = members.groupBy("page_id", "column_idx").agg(F.first("center_x").alias("_c"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("item_count"), g.round_to(F.avg(F.col("x2") - F.col("x1")), 2).alias("average_item_width"))
    clusters = F.count("*").over(Window.partitionBy("page_id"))
    first = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("item_count"), "column_idx")) == 1
    share = F.col("_c") / F.greatest(F.col("page_width"), F.lit(1.0))
    lean = g.clamp01(share if column_type == "field" else 1 - share)
    return c.join(m.select("page_id", "page_width"), "page_id").select(
        "page_id", F.lit(column_type).alias("column_type"), "column_idx", g.round_to(F.col("_c"), 2).alias("center_x"), "x1", "y1", "x2", "y2", "item_count", g.round_to(g.clamp01(F.col("item_count") / clusters), 4).alias("support"),
        "average_item_width", g.round_to(g.clamp01(0.55 + 0.25 * F.col("item_count") / clusters), 4).alias("confidence"), g.round_to(lean, 4).alias("lean"), first.alias("is_primary"),
    )


def zones(band_members: DataFrame, column_members: DataFrame, band_rows: DataFrame, zone_type: str | None = None) -> DataFrame:
    """Band by column, of one type or, from columns of both kinds, of each: page_id, zone_type, zone_idx, band_idx, column_idx, box (the band's), item_count, support, confidence, line_count, text_count, band_type, multiline."""
    if zone_type:
        b = band_members.filter(F.col("kind") == ("ocr" if zone_type == "label" else "field_line")).select("page_id", "idx", "band_idx")
        z = b.join(column_members.select("page_id", "idx", "column_idx"), ["page_id", "idx"]).groupBy("page_id", "band_idx", "column_idx").agg(F.count("*").alias("item_count"))
        of_type, within, field = F.lit(zone_type), ["page_id"], F.lit(zone_type == "field")
    else:
        b = band_members.select("page_id", "kind", "idx", "band_idx")
        z = b.join(column_members.select("page_id", "kind", "idx", "column_idx"), ["page_id", "kind", "idx"]).groupBy("page_id", "kind", "band_idx", "column_idx").agg(F.count("*").alias("item_count"))
        of_type, within, field = F.when(F.col("kind") == "ocr", "label").otherwise("field"), ["page_id", "kind"], F.col("kind") == "field_line"
    r = z.join(band_rows.select("page_id", "band_idx", "x1", "y1", "x2", "y2", F.col("type").alias("band_type"), F.col("confidence").alias("_bc"), F.col("item_count").alias("_n")), ["page_id", "band_idx"])
    support = g.clamp01(F.col("item_count") / F.col("_n"))
    number = F.row_number().over(Window.partitionBy(*within).orderBy("band_idx", "column_idx")) - 1
    none = F.lit(0).cast("long")
    return r.select(
        "page_id", of_type.alias("zone_type"), number.alias("zone_idx"), "band_idx", "column_idx", "x1", "y1", "x2", "y2", "item_count", g.round_to(support, 4).alias("support"), g.round_to(g.clamp01(0.45 + 0.35 * support + 0.10 * F.col("_bc")), 4).alias("confidence"),
        F.when(field, F.col("item_count")).otherwise(none).alias("line_count"), F.when(field, none).otherwise(F.col("item_count")).alias("text_count"), "band_type",
        (field & ((F.col("band_type") == "multiline_band") | (F.col("item_count") > 2))).alias("multiline"),
    )


def ownership(label_zones: DataFrame, field_zones: DataFrame, band_rows: DataFrame, m: DataFrame) -> DataFrame:
    """The best field zone of each label zone, of its own band or, failing that, of bands nearby.

    page_id, label_zone, field_zone, band_idx, type, box, confidence, coverage, multiline.
    """
    centers = band_rows.select("page_id", "band_idx", F.col("center_y"))
    lz = label_zones.join(centers, ["page_id", "band_idx"]).join(m.select("page_id", "band_tolerance"), "page_id")
    lz = lz.select("page_id", "band_tolerance", *[F.col(c).alias(f"l_{c}") for c in ("zone_idx", "band_idx", "x1", "y1", "x2", "y2", "support", "confidence", "text_count", "band_type", "center_y")])
    fz = field_zones.join(centers, ["page_id", "band_idx"]).select("page_id", *[F.col(c).alias(f"f_{c}") for c in ("zone_idx", "band_idx", "x1", "y1", "x2", "y2", "support", "confidence", "multiline", "center_y")])
    same = F.col("l_band_idx") == F.col("f_band_idx")
    pairs = lz.join(fz, "page_id").filter(same | (F.abs(F.col("f_center_y") - F.col("l_center_y")) <= F.col("band_tolerance") * 1.5))
    lb, fb = g.box("l_"), g.box("f_")
    (_, lcy), (fcx, fcy) = g.center(lb), g.center(fb)
    level = 1 - F.least(F.abs(fcy - lcy) / F.greatest(fb[3] - fb[1], F.lit(1.0)), F.lit(1.0))
    score = g.overlap_ratio(lb, fb) * 0.55 + F.col("f_confidence") * 0.2 + F.col("f_support") * 0.15 + level * 0.1 + F.when(fcx >= F.col("l_x2"), 0.15).otherwise(-0.1)
    w = Window.partitionBy("page_id", "l_zone_idx").orderBy(F.desc(same), F.desc(g.round_to(score, 9)), "f_zone_idx")
    best = pairs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    multi = (F.col("l_text_count") > 1) | F.col("f_multiline") | (F.col("l_band_type") == "multiline_band")
    sure = g.clamp01(0.34 + 0.28 * F.col("l_confidence") + 0.28 * F.col("f_confidence") + 0.10 * 0.8)
    return best.select(
        "page_id", F.col("l_zone_idx").alias("label_zone"), F.col("f_zone_idx").alias("field_zone"), F.col("l_band_idx").alias("band_idx"), F.when(multi, "multiline_ownership_region").otherwise("ownership_region").alias("type"),
        F.least(lb[0], fb[0]).alias("x1"), F.least(lb[1], fb[1]).alias("y1"), F.greatest(lb[2], fb[2]).alias("x2"), F.greatest(lb[3], fb[3]).alias("y2"),
        g.round_to(sure, 4).alias("confidence"), g.round_to(g.clamp01(F.col("l_support") + F.col("f_support")), 4).alias("coverage"), multi.alias("multiline"),
    )


def excluded_regions(regions: DataFrame, field_zones: DataFrame, band_rows: DataFrame, m: DataFrame) -> DataFrame:
    """Regions of excluded types and field zones that look like photos or empty frames: page_id, source, idx, type, box, confidence."""
    seen = regions.filter(F.col("type").isin(*LAYOUT_EXCLUDED)).select("page_id", F.lit("region").alias("source"), F.col("region_idx").cast("int").alias("idx"), "type", F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), (F.col("x") + F.col("width")).cast("double").alias("x2"), (F.col("y") + F.col("height")).cast("double").alias("y2"), F.col("confidence"))
    z = field_zones.join(band_rows.select("page_id", "band_idx", "label_count", "field_count"), ["page_id", "band_idx"]).join(m.select("page_id", "avg_text_height", "avg_text_width"), "page_id")
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sparse = (F.col("text_count") == 0) & (F.col("line_count") >= 1) & (F.col("support") < 0.55) & ~((F.col("label_count") > 0) & (F.col("field_count") > 0))
    large = (height >= F.col("avg_text_height") * 2) & (width * height >= F.greatest(F.col("avg_text_height") * F.col("avg_text_width") * 0.5, F.lit(1200.0)))
    square = (width / F.greatest(height, F.lit(1.0))).between(0.7, 1.4) & (width * height >= 700)
    made = z.filter(sparse & (large | square)).select("page_id", F.lit("zone").alias("source"), F.col("zone_idx").alias("idx"), F.when(square, "photo_region").otherwise("non_text_sparse_region").alias("type"), "x1", "y1", "x2", "y2", g.round_to(g.clamp01(0.62 + F.col("support") * 0.2), 4).alias("confidence"))
    return seen.unionByName(made)


def best_zone(things: DataFrame, key: str, zone_rows: DataFrame, zone_key: str, out: str, more: dict[str, str] | None = None) -> DataFrame:
    """Adds `out` (null if none) and `<out>_support`, `<out>_confidence`: the zone or band that holds each thing best; first of equals.

    A zone qualifies if the boxes overlap or the thing's centre is within 6 of
    it. `more`: further columns of the zone, by the name that they get.
    """
    more = more or {}
    support = F.col("support") if "support" in zone_rows.columns else F.lit(0.0)
    z = zone_rows.select("page_id", F.col(zone_key).alias("_z"), support.alias("_s"), F.col("confidence").alias("_c"), *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")], *[F.col(c).alias(f"_m_{n}") for n, c in more.items()])
    over = g.overlap_ratio(g.box(), g.box("_"))
    cx, cy = g.center(g.box())
    pairs = things.select("page_id", key, "x1", "y1", "x2", "y2").join(z, "page_id").filter((over > 0) | g.inside(cx, cy, g.box("_"), 6.0))
    score = g.round_to(over * 0.7 + F.col("_c") * 0.2 + F.col("_s") * 0.1, 9)
    best = pairs.groupBy("page_id", key).agg(F.max(F.struct(score.alias("s"), (-F.col("_z")).alias("z"), "_s", "_c", *[f"_m_{n}" for n in more])).alias("b"))
    return things.join(best.select("page_id", key, (-F.col("b.z")).alias(out), F.col("b._s").alias(f"{out}_support"), F.col("b._c").alias(f"{out}_confidence"), *[F.col(f"b._m_{n}").alias(n) for n in more]), ["page_id", key], "left")


def excluded_flag(things: DataFrame, key: str, excluded: DataFrame) -> DataFrame:
    """Adds excluded (0 or 1): the box overlaps an excluded region or its centre is within 2 of one."""
    e = excluded.select("page_id", *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    cx, cy = g.center(g.box())
    hit = things.select("page_id", key, "x1", "y1", "x2", "y2").join(e, "page_id").filter((g.overlap_ratio(g.box(), g.box("_")) > 0) | g.inside(cx, cy, g.box("_"), 2.0)).select("page_id", key).distinct()
    return things.join(hit.withColumn("excluded", F.lit(1.0)), ["page_id", key], "left").withColumn("excluded", F.coalesce("excluded", F.lit(0.0)))


def text_rows(ents: DataFrame, m: DataFrame) -> DataFrame:
    """page_id, row_idx, center_y, item_count, texts (joined by ' | ')."""
    rows = running_mean_groups(ents.filter("kind = 'ocr'").join(m.select("page_id", "row_tolerance"), "page_id"), ["page_id"], "cy", "row_tolerance", "row_idx")
    parts = F.array_sort(F.collect_list(F.struct("cy", "idx", "text")))
    return rows.groupBy("page_id", "row_idx").agg(g.round_to(F.first("row_idx_mean"), 2).alias("center_y"), F.count("*").alias("item_count"), F.array_join(F.transform(parts, lambda p: p["text"]), " | ").alias("texts"))


def field_clusters(ents: DataFrame, m: DataFrame) -> DataFrame:
    """Rows of lines: page_id, row_idx, center_y, line_count, extents of centres, avg_line_length, type."""
    rows = running_mean_groups(ents.filter("kind = 'field_line'").join(m.select("page_id", "row_tolerance"), "page_id"), ["page_id"], "cy", "row_tolerance", "row_idx")
    c = rows.groupBy("page_id", "row_idx").agg(g.round_to(F.first("row_idx_mean"), 2).alias("center_y"), F.count("*").alias("line_count"), F.min("cx").alias("min_x"), F.max("cx").alias("max_x"), F.min("cy").alias("min_y"), F.max("cy").alias("max_y"), F.median(F.when(F.col("length") > 0, F.col("length"))).alias("_l"))
    return c.join(m.select("page_id", "avg_line_length"), "page_id").select("page_id", "row_idx", "center_y", "line_count", "min_x", "max_x", "min_y", "max_y", g.round_to(F.coalesce("_l", "avg_line_length"), 2).alias("avg_line_length"), F.when(F.col("line_count") >= 3, "repeated_row").otherwise("field_row").alias("type"))


def label_groups(ents: DataFrame, m: DataFrame) -> DataFrame:
    """Runs of labels in the left 45 % of the page: page_id, group_idx, item_count, box, group_type."""
    w = Window.partitionBy("page_id").orderBy("cy", "cx", "idx")
    left = ents.filter("kind = 'ocr'").join(m.select("page_id", "page_width", "row_tolerance", F.greatest(F.lit(28.0), F.col("avg_text_width") * 0.8).alias("_ct")), "page_id").filter(F.col("cx") <= F.col("page_width") * 0.45)
    near = (F.col("cy") - F.lag("cy").over(w) <= F.col("row_tolerance") * 1.3) & (F.abs(F.col("cx") - F.lag("cx").over(w)) <= F.col("_ct") * 1.4)
    runs = left.withColumn("_new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("group_idx", F.sum("_new").over(w) - 1)
    return runs.groupBy("page_id", "group_idx").agg(F.count("*").alias("item_count"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.when(F.count("*") > 1, "multiline_label").otherwise("single_label").alias("group_type"))


def theta_edges(ents: DataFrame, m: DataFrame) -> DataFrame:
    """Edges of the simple graph: page_id, source, target, relationship, score. Up to five per label and line, enclosures by region."""
    pick = lambda kind, p: ents.filter(F.col("kind") == kind).select("page_id", *[F.col(c).alias(f"{p}{c}") for c in ("id", "x1", "y1", "x2", "y2", "cx", "cy", "confidence")])
    labels, fields, areas = pick("ocr", "a_"), pick("field_line", "b_"), pick("semantic_region", "b_")
    limits = m.select("page_id", "row_tolerance", F.greatest(F.lit(28.0), F.col("avg_text_width") * 0.8).alias("ct"), "multiline_band_gap", "distance_limit")
    dx, dy = F.col("b_cx") - F.col("a_cx"), F.col("b_cy") - F.col("a_cy")
    far = F.sqrt(dx * dx + dy * dy)
    over = g.overlap_ratio(g.box("a_"), g.box("b_"))

    def edge(keep: Column, name: str, score: Column) -> Column:
        return F.when(keep, F.struct(F.lit(name).alias("relationship"), g.round_to(g.clamp01(score), 4).alias("score")))

    made = F.array(
        edge(F.abs(dy) <= F.col("row_tolerance"), "same_row", F.when(dx >= 0, 0.85).otherwise(0.55)),
        edge(F.abs(dx) <= F.col("ct"), "same_column", F.lit(0.64)),
        edge(over > 0, "spatial_overlap", over),
        edge((dy > 0) & (dy <= F.col("multiline_band_gap")), "vertical_continuation", 1 - dy / F.col("multiline_band_gap")),
        edge(far <= F.col("distance_limit"), "proximity", 1 - far / F.col("distance_limit")),
    )
    pairs = labels.join(fields, "page_id").join(limits, "page_id").select("page_id", F.col("a_id").alias("source"), F.col("b_id").alias("target"), F.explode(F.array_compact(made)).alias("e")).select("page_id", "source", "target", "e.*")

    def within(a: DataFrame, name: str) -> DataFrame:
        return a.join(areas, "page_id").filter(over > 0).select("page_id", F.col("a_id").alias("source"), F.col("b_id").alias("target"), F.lit(name).alias("relationship"), g.round_to(g.clamp01(F.col("b_confidence")), 4).alias("score"))

    return pairs.unionByName(within(labels, "enclosure")).unionByName(within(pick("field_line", "a_"), "enclosed_in"))


def membership_edges(ents: DataFrame, band_rows: DataFrame, label_zones: DataFrame, field_zones: DataFrame, label_columns: DataFrame, field_columns: DataFrame, excluded: DataFrame, owned: DataFrame) -> DataFrame:
    """Edges of the layout graph: page_id, source, target, relationship, score.

    What boxes in common decide is stored kind by kind, as one plan of all kinds grows large on the driver.
    """
    flat = ents.filter("kind <> 'semantic_region'")

    def named(df: DataFrame, source: Column, target: Column, relation: Column, score: Column) -> DataFrame:
        return df.select("page_id", source.alias("source"), target.alias("target"), relation.alias("relationship"), g.round_to(score, 4).alias("score"))

    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    held = best_zone(flat, "id", band_rows.drop("support"), "band_idx", "band").filter("band is not null")
    out = store(named(held, F.col("id"), text("band-", "band"), F.concat("kind", F.lit("_band_membership")), F.col("band_confidence")), "edges")
    for kind, zone_type, rows in (("ocr", "label", label_zones), ("field_line", "field", field_zones)):
        z = rows.select("page_id", "zone_idx", F.col("confidence").alias("_c"), *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
        hit = flat.filter(F.col("kind") == kind).join(z, "page_id").filter(g.overlap_ratio(g.box(), g.box("_")) > 0)
        out = out.unionByName(store(named(hit, F.col("id"), text(f"{zone_type}-zone-", "zone_idx"), F.lit(f"{kind}_zone_membership"), F.col("_c")), "edges"))
    e = excluded.select("page_id", F.concat_ws("-", F.lit("excluded"), "source", F.col("idx").cast("string")).alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    out = out.unionByName(store(named(flat.join(e, "page_id").filter(g.overlap_ratio(g.box(), g.box("_")) > 0), F.col("id"), F.col("_id"), F.lit("excluded_region"), F.lit(1.0)), "edges"))
    for zone_type, rows, cols in (("label", label_zones, label_columns), ("field", field_zones, field_columns)):
        c = cols.select("page_id", "column_idx", F.col("confidence").alias("_c"))
        out = out.unionByName(named(rows.join(c, ["page_id", "column_idx"]), text(f"{zone_type}-zone-", "zone_idx"), text(f"{zone_type}-column-", "column_idx"), F.lit("structural_alignment"), F.col("_c")))
        out = out.unionByName(named(rows, text(f"{zone_type}-zone-", "zone_idx"), text("band-", "band_idx"), F.lit("band_membership"), F.lit(0.8)))
    out = out.unionByName(named(owned, text("label-zone-", "label_zone"), text("field-zone-", "field_zone"), F.lit("ownership"), F.col("confidence")))
    return out.unionByName(named(owned, text("region-", "label_zone"), text("band-", "band_idx"), F.lit("structural_band"), F.col("confidence")))


def adjacency(edges: DataFrame) -> DataFrame:
    """page_id, source, degree, targets (sorted, joined by commas)."""
    return edges.groupBy("page_id", "source").agg(F.count("*").alias("degree"), F.array_join(F.array_sort(F.collect_list("target")), ",").alias("targets"))


def simple_metrics(m: DataFrame) -> DataFrame:
    """The older metrics: no band tolerance, a column tolerance from text width alone."""
    return m.select("page_id", "page_width", "page_height", "avg_line_length", "row_tolerance", g.round_to(F.greatest(F.lit(28.0), F.col("avg_text_width") * 0.8), 2).alias("column_tolerance"), F.col("multiline_band_gap").alias("multiline_y_gap"), "indent_tolerance", "distance_limit")


def simple_pair_features(items: DataFrame, lines: DataFrame, regions: DataFrame, groups: DataFrame, m: DataFrame) -> DataFrame:
    """The older features of every item with every line of its page, without zones.

    Ownership is raised to .42 where the item meets a label group from above or
    at its level, to .55 if that group has several items; region support is the
    best confidence of a text-bearing region that both boxes overlap.
    """
    a = items.select("page_id", "item_idx", *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    b = lines.select("page_id", "line_idx", *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2", "cx", "cy")])
    limits = m.select("page_id", "avg_line_length", "row_tolerance", F.greatest(F.lit(28.0), F.col("avg_text_width") * 0.8).alias("_ct"), F.col("multiline_band_gap").alias("_gap"))
    ab, bb = g.box("a_"), g.box("b_")
    (acx, acy) = g.center(ab)
    lw, lh, fw = (F.greatest(v, F.lit(1.0)) for v in (ab[2] - ab[0], ab[3] - ab[1], bb[2] - bb[0]))
    row, gap, col = F.greatest("row_tolerance", lh * 1.25), F.greatest("_gap", lh * 2.4), F.greatest(g.round_to(F.col("_ct"), 2), lw * 0.8)
    r = groups.select(F.col("page_id"), "item_count", *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    tall = F.greatest(F.col("row_tolerance"), F.greatest(F.col("a_y2") - F.col("a_y1"), F.lit(1.0)) * 1.25)
    met = a.join(r, "page_id").join(limits.select("page_id", "row_tolerance"), "page_id").filter((F.col("a_x1") < F.col("g_x2")) & (F.col("a_x2") > F.col("g_x1")) & (F.col("a_y1") >= F.col("g_y1") - tall))
    raised = met.groupBy("page_id", "item_idx").agg(F.max(F.when(F.col("item_count") > 1, 0.55).otherwise(0.42)).alias("_raised"))
    z = regions.filter(F.col("type").isin("multiline_text_region", "standard_input", "table_like_region")).select("page_id", "region_idx", "confidence", F.col("x").alias("z_x1"), F.col("y").alias("z_y1"), (F.col("x") + F.col("width")).alias("z_x2"), (F.col("y") + F.col("height")).alias("z_y2"))
    in_a = a.join(z, "page_id").filter(g.overlap_ratio(ab, g.box("z_")) > 0).select("page_id", "item_idx", "region_idx", "confidence")
    in_b = b.join(z, "page_id").filter(g.overlap_ratio(bb, g.box("z_")) > 0).select("page_id", "line_idx", "region_idx")
    support = in_a.join(in_b, ["page_id", "region_idx"]).groupBy("page_id", "item_idx", "line_idx").agg(F.max("confidence").alias("_support"))
    dy, dx = F.col("b_cy") - acy, F.col("b_cx") - acx
    near = lambda d, tol: g.clamp01(1 - d / F.greatest(tol, F.lit(1.0)))
    p = a.join(b, "page_id").join(limits, "page_id").withColumns({"_row": near(F.abs(dy), row), "_col": near(F.abs(dx), col), "_cont": F.when(dy >= 0, near(dy, gap)).otherwise(F.lit(0.0)), "_space": near(F.abs(dy), gap)})
    p = p.withColumn("_align", g.clamp01(F.col("_row") * 0.35 + F.col("_col") * 0.2 + F.col("_cont") * 0.25 + F.col("_space") * 0.2))
    p = p.join(raised, ["page_id", "item_idx"], "left").join(support, ["page_id", "item_idx", "line_idx"], "left")
    strength = F.greatest(g.clamp01(F.col("_row") * 0.32 + F.col("_cont") * 0.44 + F.col("_align") * 0.24), F.coalesce("_raised", F.lit(0.0)))
    size = g.clamp01(1 - F.abs(fw - F.col("avg_line_length")) / F.greatest(F.col("avg_line_length") * 1.4, F.lit(1.0)))
    out = {"same_row": F.col("_row"), "same_column": F.col("_col"), "vertical_continuation": F.col("_cont"), "x_overlap_ratio": g.x_overlap(ab, bb), "spacing_similarity": F.col("_space"), "size_consistency": size, "ownership_strength": strength, "region_support": F.coalesce("_support", F.lit(0.0)), "alignment_score": F.col("_align")}
    return p.select("page_id", "item_idx", "line_idx", *[g.round_to(v, 4).alias(k) for k, v in out.items()])


def page_priors(bands_: DataFrame, label_columns: DataFrame, field_columns: DataFrame, label_zones: DataFrame, field_zones: DataFrame, excluded: DataFrame) -> DataFrame:
    """page_id, band_count, column and zone counts, excluded_count and the primary columns (null if none)."""
    out = bands_.groupBy("page_id").agg(F.count("*").alias("band_count"))
    for name, cols in (("label", label_columns), ("field", field_columns)):
        out = out.join(cols.groupBy("page_id").agg(F.count("*").alias(f"{name}_column_count"), F.max(F.when(F.col("is_primary"), F.col("column_idx"))).alias(f"primary_{name}_column")), "page_id", "left")
    z = label_zones.select("page_id").unionAll(field_zones.select("page_id")).groupBy("page_id").agg(F.count("*").alias("zone_count"))
    e = excluded.groupBy("page_id").agg(F.count("*").alias("excluded_count"))
    return out.join(z, "page_id", "left").join(e, "page_id", "left").fillna(0, ["label_column_count", "field_column_count", "zone_count", "excluded_count"])
