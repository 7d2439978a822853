"""Matching labels to field lines: candidates, scores, classes and the greedy assignment."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.config import DEFAULT, SUPPORT_EXCLUDED, Config
from quillgrid.functions import geometry as g
from quillgrid.functions import text as t
from quillgrid.operators import structure as s
from quillgrid.session import store_joined


def column_split(items: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """page_id, column_split: the middle of the widest gap between text centres (the first of equals), or the fallback."""
    w = Window.partitionBy("page_id").orderBy("cx", "item_idx")
    gaps = items.select("page_id", "cx", F.lead("cx").over(w).alias("nx"), F.row_number().over(w).alias("rn"))
    best = gaps.groupBy("page_id").agg(F.max(F.when(F.col("nx") > F.col("cx"), F.struct((F.col("nx") - F.col("cx")).alias("gap"), (-F.col("rn")).alias("k"), ((F.col("cx") + F.col("nx")) / 2).alias("mid")))).alias("b"))
    mid = F.col("b.mid")
    return best.select("page_id", F.when(mid.isNull() | (mid < c.fallback_split * 0.75), F.lit(c.fallback_split)).otherwise(mid).alias("column_split"))


def local_metrics(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Medians and tolerances of the matcher itself, unrounded: page_id, lh, lw, relaxed, multiline_gap, pages with items only."""
    i = items.groupBy("page_id").agg(g.positive_median(F.col("y2") - F.col("y1"), 18.0).alias("lh"))
    ll = lines.groupBy("page_id").agg(g.positive_median(F.col("length"), 220.0).alias("lw"))
    return i.join(ll, "page_id", "left").select("page_id", "lh", F.coalesce("lw", F.lit(220.0)).alias("lw"), F.greatest(F.lit(42.0), F.col("lh") * 3.4).alias("relaxed"), F.greatest(F.lit(34.0), F.col("lh") * 2.6).alias("multiline_gap"))


def labels(items: DataFrame, m: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Items left of the column split that may label a field, with column_split."""
    left = items.join(column_split(items, c), "page_id").join(m.select("page_id", "page_height"), "page_id").filter(F.col("cx") < F.col("column_split"))
    return left.filter(t.mappable_label(F.col("text"), F.col("cy"), F.col("page_height"))).drop("page_height")


class Layout:
    """The layout relations of all pages, each built when it is first asked for.

    What several later relations start from is stored once in the shared
    folder, so that no plan grows without bound and no fold runs twice.
    """

    #: Stored relations in the order in which they need each other; those of one step don't.
    STEPS = (("items", "lines"), ("regions",), ("metrics",), ("band_members", "label_members", "field_members"), ("bands",), ("label_zones", "field_zones"), ("owned", "label_columns", "field_columns", "excluded"), ("placed_labels", "placed_lines"))

    def __init__(self, items: DataFrame, lines: DataFrame, regions: DataFrame | Callable[[DataFrame, DataFrame], DataFrame], boxes: Callable[[], DataFrame] | None = None):
        """`regions`: the relation, or what makes it from the stored items and lines; `boxes` makes no more of it than the pages' extents need, of any pages."""
        self._source = items, lines, regions
        self._boxes = boxes

    def prepare(self, steps: int = len(STEPS)) -> "Layout":
        """Builds the relations of the first steps, those of one step at once: each is small work with much waiting."""
        for names in self.STEPS[:steps]:
            missing = [n for n in names if n not in self.__dict__]
            if missing:
                with ThreadPoolExecutor(len(missing)) as pool:
                    list(pool.map(lambda n: getattr(self, n), missing))
        return self

    @cached_property
    def items(self) -> DataFrame:
        return store_joined(self._source[0], "items")

    @cached_property
    def lines(self) -> DataFrame:
        return store_joined(self._source[1], "lines")

    @cached_property
    def regions(self) -> DataFrame:
        made = self._source[2]
        return store_joined(made if isinstance(made, DataFrame) else made(self.items, self.lines), "regions")

    @cached_property
    def metrics(self) -> DataFrame:
        if self._boxes is None or "regions" in self.__dict__:
            return store_joined(s.metrics(self.items, self.lines, self.regions), "metrics")
        return store_joined(s.metrics(self.items, self.lines, self._boxes()).filter("ocr_count + field_line_count > 0"), "metrics")

    @cached_property
    def entities(self) -> DataFrame:
        return s.entities(self.items, self.lines, self.regions)

    @cached_property
    def band_members(self) -> DataFrame:
        return store_joined(s.banded(s.entities(self.items, self.lines), self.metrics), "bands")

    @cached_property
    def bands(self) -> DataFrame:
        return store_joined(s.bands(self.band_members, self.metrics), "bands")

    @cached_property
    def label_members(self) -> DataFrame:
        return store_joined(s.columned(s.entities(self.items, self.lines), self.metrics, "label"), "columns")

    @cached_property
    def field_members(self) -> DataFrame:
        return store_joined(s.columned(s.entities(self.items, self.lines), self.metrics, "field"), "columns")

    @cached_property
    def label_columns(self) -> DataFrame:
        return store_joined(s.columns(self.label_members, self.metrics, "label"), "columns")

    @cached_property
    def field_columns(self) -> DataFrame:
        return store_joined(s.columns(self.field_members, self.metrics, "field"), "columns")

    @cached_property
    def label_zones(self) -> DataFrame:
        return store_joined(s.zones(self.band_members, self.label_members, self.bands, "label"), "zones")

    @cached_property
    def field_zones(self) -> DataFrame:
        return store_joined(s.zones(self.band_members, self.field_members, self.bands, "field"), "zones")

    @cached_property
    def owned(self) -> DataFrame:
        return store_joined(s.ownership(self.label_zones, self.field_zones, self.bands, self.metrics), "owned")

    @cached_property
    def excluded(self) -> DataFrame:
        return store_joined(s.excluded_regions(self.regions, self.field_zones, self.bands, self.metrics), "excluded")

    @cached_property
    def placed_labels(self) -> DataFrame:
        return store_joined(self._placed("label"), "placed")

    @cached_property
    def placed_lines(self) -> DataFrame:
        return store_joined(self._placed("line"), "placed")

    def owned_alone(self) -> DataFrame:
        """`owned` from few stages, one relation after the other and without the regions' types.

        A stage costs the driver a block of broadcast, a scan another: many of
        them, of several plans at once, have its heap grow to the limit.
        """
        columns = s.columned(s.entities(self.items, self.lines), self.metrics)
        zones = store_joined(s.zones(self.band_members, columns, self.bands), "zones")
        label_zones, field_zones = (zones.filter(F.col("zone_type") == k) for k in ("label", "field"))
        return store_joined(s.ownership(label_zones, field_zones, self.bands, self.metrics), "owned")

    def _placed(self, kind: str) -> DataFrame:
        """Items or lines with zone, band and column, and for lines the excluded flag: one row per thing."""
        source, key = (self.items, "item_idx") if kind == "label" else (self.lines, "line_idx")
        zone_rows, cols = (self.label_zones, self.label_columns) if kind == "label" else (self.field_zones, self.field_columns)
        zone_rows = zone_rows.join(cols.select("page_id", "column_idx", "center_x", "is_primary"), ["page_id", "column_idx"], "left")
        p = s.best_zone(source.select("page_id", key, "x1", "y1", "x2", "y2"), key, zone_rows, "zone_idx", "zone", {"column_idx": "column_idx", "zone_x2": "x2", "center_x": "center_x", "is_primary": "is_primary"})
        p = s.best_zone(p, key, self.bands.drop("support"), "band_idx", "band", {"center_y": "center_y"})
        if kind == "line":
            p = s.excluded_flag(p, key, self.excluded)
        return p.drop("x1", "y1", "x2", "y2")


def candidate_region(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """page_id, line_idx, region_type: the first region with area in common that isn't of a skipped type."""
    r = regions.filter(~F.col("type").isin(*SUPPORT_EXCLUDED)).select("page_id", "region_idx", "type", "x", "y", "width", "height")
    ox, oy = g.overlaps(g.box(), (F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height")))
    hit = lines.select("page_id", "line_idx", "x1", "y1", "x2", "y2").join(r, "page_id").filter((ox > 0) & (oy > 0))
    return hit.groupBy("page_id", "line_idx").agg(F.min(F.struct("region_idx", "type")).alias("r")).select("page_id", "line_idx", F.col("r.type").alias("region_type"))


def pair_features(lay: Layout, label_rows: DataFrame, pool: DataFrame | None = None, by_page: DataFrame | None = None, by_line: DataFrame | None = None) -> DataFrame:
    """Every label with every line of its page, or with those of its pool, with geometric and structural features (4 decimals).

    `by_page` (of all pages with labels) and `by_line` (of some lines) give
    further columns. All that depends on the label or the line alone is joined
    and stored before they are paired: no join carries the pairs, and no plan
    grows so large that it fills the driver.
    """
    lay.prepare()
    m = lay.metrics.select("page_id", "page_width", "row_tolerance", "multiline_band_gap", "column_tolerance", "avg_line_length", "band_tolerance")
    a = label_rows.select("page_id", "item_idx", "text", "confidence", "column_split", *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2", "cx", "cy")])
    ap = lay.placed_labels.select("page_id", "item_idx", *[F.col(c).alias(f"a_{c}") for c in ("zone", "band", "zone_support", "band_confidence", "center_x", "center_y", "zone_x2")])
    b = lay.lines.select("page_id", "line_idx", "sx", "sy", "ex", "ey", "field_type", "length", *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2", "cx", "cy")])
    bp = lay.placed_lines.select("page_id", "line_idx", "excluded", *[F.col(c).alias(f"b_{c}") for c in ("zone", "band", "zone_support", "band_confidence", "center_x", "center_y", "is_primary")])
    o = lay.owned.select("page_id", "label_zone", "field_zone", F.col("confidence").alias("_oc"))
    # the ownership of a pair of zones is unique, of a label zone too; a missing side is a wildcard
    by_label = o.select("page_id", F.col("label_zone").alias("a_zone"), F.col("field_zone").alias("_of"), F.col("_oc").alias("_o1"))
    by_field = o.groupBy("page_id", F.col("field_zone").alias("b_zone")).agg(F.max("_oc").alias("_o2"))
    any_zone = o.groupBy("page_id").agg(F.max("_oc").alias("_o3"))
    pages = m.join(any_zone, "page_id", "left")
    left = a.join(ap, ["page_id", "item_idx"]).join(by_label, ["page_id", "a_zone"], "left").join(pages if by_page is None else pages.join(by_page, "page_id"), "page_id")
    right = b.join(bp, ["page_id", "line_idx"]).join(by_field, ["page_id", "b_zone"], "left")
    if by_line is not None:
        right = right.join(by_line, ["page_id", "line_idx"], "left")
    left, right = store_joined(left, "left"), store_joined(right, "right")
    pairs = left.join(right, "page_id") if pool is None else store_joined(pool, "pool").join(left, ["page_id", "item_idx"]).join(right, ["page_id", "line_idx"])
    stated = F.coalesce(
        F.when(F.col("a_zone").isNotNull() & F.col("b_zone").isNotNull(), F.when(F.col("_of") == F.col("b_zone"), F.col("_o1")))
        .when(F.col("a_zone").isNotNull(), F.col("_o1"))
        .when(F.col("b_zone").isNotNull(), F.col("_o2"))
        .otherwise(F.col("_o3")),
        F.lit(0.0),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ab, bb = g.box("a_"), g.box("b_")
    (acx, acy), (bcx, bcy) = g.center(ab), g.center(bb)
    lw, lh, fw = (F.greatest(v, F.lit(1.0)) for v in (ab[2] - ab[0], ab[3] - ab[1], bb[2] - bb[0]))
    row, gap, col = F.greatest("row_tolerance", lh * 1.25), F.greatest("multiline_band_gap", lh * 2.4), F.greatest("column_tolerance", lw * 0.8)
    dy, dx = bcy - acy, bcx - acx
    near = lambda d, tol: g.clamp01(1 - d / F.greatest(tol, F.lit(1.0)))
    f = pairs.withColumns({"_same_row": near(F.abs(dy), row), "_same_col": near(F.abs(dx), col), "_cont": F.when(dy >= 0, near(dy, gap)).otherwise(F.lit(0.0)), "_space": near(F.abs(dy), gap), "_xo": g.x_overlap(ab, bb), "_size": g.clamp01(1 - F.abs(fw - F.col("avg_line_length")) / F.greatest(F.col("avg_line_length") * 1.4, F.lit(1.0))), "_stated": stated})
    f = f.withColumns({
        "_align": g.clamp01(F.col("_same_row") * 0.35 + F.col("_same_col") * 0.2 + F.col("_cont") * 0.25 + F.col("_space") * 0.2),
        "_ls": zero(F.col("a_zone_support")), "_fs": zero(F.col("b_zone_support")),
        "_bs": F.coalesce("b_band_confidence", "a_band_confidence", F.lit(0.0)),
        "_same_band": F.when(F.col("a_band") == F.col("b_band"), 1.0).otherwise(0.0),
        "_band_align": F.when(F.col("a_band").isNotNull() & F.col("b_band").isNotNull(), g.clamp01(1 - F.abs(F.col("b_center_y") - F.col("a_center_y")) / F.greatest(F.col("band_tolerance") * 2.2, F.lit(1.0)))).otherwise(0.0),
    })
    both = g.clamp01(F.when(F.col("b_center_x") >= F.col("a_center_x"), 0.6).otherwise(0.15) + 0.25 * g.clamp01(F.abs(F.col("b_center_x") - F.col("a_center_x")) / F.greatest(F.col("page_width") * 0.35, F.lit(1.0))) + F.when(F.col("b_is_primary"), 0.15).otherwise(0.0))
    f = f.withColumns({
        "_own": F.when(F.col("_stated") == 0, g.clamp01(F.col("_ls") * 0.35 + F.col("_fs") * 0.35 + F.col("_bs") * 0.3)).otherwise(F.col("_stated")),
        "_colc": F.when(F.col("a_center_x").isNotNull() & F.col("b_center_x").isNotNull(), both).when(F.col("b_center_x").isNotNull(), F.when(F.col("b_is_primary"), 0.55).otherwise(0.35)).otherwise(0.0),
    })
    structure = g.clamp01(F.col("_same_band") * 0.22 + F.col("_band_align") * 0.18 + F.col("_colc") * 0.32 + F.col("_own") * 0.26 + F.col("_fs") * 0.10 + F.col("_ls") * 0.06 + F.greatest("_same_band", "_bs") * 0.04 - F.col("excluded") * 0.55)
    strength = g.clamp01(F.col("_same_row") * 0.24 + F.col("_cont") * 0.30 + F.col("_align") * 0.18 + g.round_to(F.col("_own"), 4) * 0.28)
    out = {"same_row": F.col("_same_row"), "same_column": F.col("_same_col"), "vertical_continuation": F.col("_cont"), "x_overlap_ratio": F.col("_xo"), "spacing_similarity": F.col("_space"), "size_consistency": F.col("_size"), "ownership_strength": strength, "region_support": F.greatest(g.round_to(F.col("_fs"), 4), g.round_to(F.col("_ls"), 4)), "alignment_score": F.col("_align"), "column_consistency": F.col("_colc"), "ownership_confidence": F.col("_own"), "global_structure_score": structure, "band_alignment": F.col("_band_align")}
    more = [c for d in (by_page, by_line) if d is not None for c in d.columns if c not in ("page_id", "line_idx")]
    keep = ["page_id", "item_idx", "line_idx", "text", "confidence", "column_split", "row_tolerance", "column_tolerance", *more, "field_type", "length", "sx", "sy", "ex", "ey", "excluded", "a_zone", "a_band", "a_zone_x2", "a_center_y", "b_zone", *[f"{p}_{c}" for p in "ab" for c in ("x1", "y1", "x2", "y2", "cx", "cy")]]
    return f.select(*keep, *[g.round_to(v, 4).alias(k) for k, v in out.items()])


def candidate_scores(lay: Layout, label_rows: DataFrame, c: Config = DEFAULT, pool: DataFrame | None = None, explain: bool = False) -> DataFrame:
    """Scores of all pairs, or of those in the labels' pools, before any line is assigned: local, global and candidate score, flags of rejection and the parts they need.

    With `explain` also reasons and rejection_reasons (in order, joined by
    commas) and the parts of the score with 4 decimals.
    """
    from quillgrid.operators.lines import table_groups

    lay.prepare()
    by_page = local_metrics(lay.items, lay.lines).join(lay.metrics.select("page_id", "avg_text_width"), "page_id")
    by_line = table_groups(lay.lines, c).select("page_id", "line_idx").withColumn("_table", F.lit(True))
    if explain:
        by_line = by_line.join(candidate_region(lay.lines, lay.regions), ["page_id", "line_idx"], "full")
    f = pair_features(lay, label_rows, pool, by_page, by_line)
    dx, dy = F.col("b_cx") - F.col("a_cx"), F.col("b_cy") - F.col("a_cy")
    horizontal = g.clamp01(1 - F.abs(dx) / F.greatest(F.col("avg_text_width") * 2, F.lit(100.0)))
    vertical = g.clamp01(1 - F.abs(dy) / F.greatest(F.col("row_tolerance") * 1.6, F.lit(1.0)))
    beside = F.col("b_cy").between(F.col("a_y1"), F.col("a_y2") + F.col("lh") * 0.8)
    row = F.when(beside, 1.0).otherwise(g.clamp01(1 - F.least(F.abs(F.col("b_cy") - F.col("a_y1")), F.abs(F.col("b_cy") - F.col("a_y2"))) / F.greatest("relaxed", F.lit(1.0))))
    semantic = 0.55 + F.when(F.col("field_type").isin("box", "weak_line", "fallback_text_region"), 0.06).otherwise(0.0) + F.when(F.col("length") <= 260, 0.04).otherwise(0.0)
    sure = F.when(F.col("confidence").isNotNull(), g.clamp01(F.col("confidence"))).otherwise(0.75)
    local = horizontal * 0.12 + vertical * 0.12 + row * 0.12 + F.col("alignment_score") * 0.18 + F.col("vertical_continuation") * 0.10 + F.col("x_overlap_ratio") * 0.07 + F.col("spacing_similarity") * 0.07 + F.col("size_consistency") * 0.08 + semantic * 0.06 + sure * 0.05
    wide = F.col("global_structure_score") * 0.60 + F.col("column_consistency") * 0.16 + F.col("ownership_confidence") * 0.16 + F.col("ownership_strength") * 0.04 + F.col("region_support") * 0.04
    left_of = F.col("b_cx") <= F.col("a_x2") - F.col("column_tolerance") * 0.25
    rejected = left_of | F.coalesce("_table", F.lit(False)) | (vertical < 0.38) | (F.col("excluded") > 0.5)
    both = local * 0.45 + wide * 0.55
    keep = ["page_id", "item_idx", "line_idx", "text", "field_type", "length", "sx", "sy", "ex", "ey", "column_split", "a_cx", "a_cy", "b_cx", "b_cy", "lh", "multiline_gap", "excluded"]
    if explain:
        size = g.clamp01(1 - F.abs(F.col("length") - F.col("lw")) / F.greatest(F.col("lw") * 1.6, F.lit(1.0)))
        near = 1 - F.least(F.abs(F.col("b_cy") - F.col("a_y1")), F.abs(F.col("b_cy") - F.col("a_y2"))) / F.greatest("relaxed", F.lit(1.0))
        when = lambda cond, name: F.when(cond, F.lit(name))
        reasons = [
            when(dx > 0, "right_of_label").otherwise("left_of_label"), when(vertical >= 0.72, "strong_vertical_alignment").when(vertical >= 0.38, "weak_vertical_alignment"),
            when(beside, "row_overlap").when(near >= 0.45, "row_nearby").otherwise("row_separated"), when(size >= 0.6, "field_size_consistent").otherwise("field_size_outlier"),
            F.when(F.col("field_type").isin("box", "weak_line", "fallback_text_region"), F.concat(F.lit("field_source_"), "field_type")), when(F.col("length") <= 260, "compact_field_candidate"),
            when(sure < 0.55, "low_ocr_confidence"), F.concat(F.lit("region_"), "region_type"),
        ]
        against = [when(left_of, "not_right_of_label"), when(F.coalesce("_table", F.lit(False)), "inside_table_region"), when(vertical < 0.38, "poor_vertical_alignment"), when(F.col("excluded") > 0.5, "inside_excluded_region")]
        listed = lambda parts: F.array_join(F.array_compact(F.array(*parts)), ",")
        parts = {"horizontal_alignment": horizontal, "vertical_alignment": vertical, "row_overlap": row, "semantic_hints": semantic, "ocr_confidence": sure}
        f = f.withColumns({n: g.round_to(v, 4) for n, v in parts.items()} | {"reasons": listed(reasons), "rejection_reasons": listed(against)})
        keep += ["reasons", "rejection_reasons", *parts, *BREAKDOWN]
    return f.select(*keep, g.round_to(local, 4).alias("local_score"), "global_structure_score", "column_consistency", "ownership_confidence", rejected.alias("rejected"), g.round_to(F.when(rejected, both * 0.3).otherwise(both), 4).alias("candidate_score"), g.round_to(both * 0.3, 4).alias("penalised_score"), g.round_to(F.sqrt(dx * dx + dy * dy), 2).alias("distance"))


#: The parts of a score that are features of the pair.
BREAKDOWN = ("alignment_score", "vertical_continuation", "x_overlap_ratio", "spacing_similarity", "size_consistency", "ownership_strength", "region_support")


def candidate_pool(lay: Layout, label_rows: DataFrame) -> DataFrame:
    """page_id, item_idx, line_idx of the lines that each label is compared with.

    Field zones of the label's band, else of bands nearby, else all; of these the
    ones right of the label's zone, if any. A line counts if it lies in such a
    zone or starts far enough to the right; excluded lines never do, unless
    nothing else is left, then all lines of the page that aren't excluded, then all.
    """
    lay.prepare()
    m = lay.metrics.select("page_id", "band_tolerance", "column_tolerance")
    a = label_rows.select("page_id", "item_idx").join(lay.placed_labels.select("page_id", "item_idx", "zone", "band", "center_y", "zone_x2"), ["page_id", "item_idx"]).join(m, "page_id")
    z = lay.field_zones.join(lay.bands.select("page_id", "band_idx", F.col("center_y").alias("_zy")), ["page_id", "band_idx"]).select("page_id", "band_idx", "zone_idx", "_zy", *[F.col(c).alias(f"z_{c}") for c in ("x1", "y1", "x2", "y2")])
    level = F.when(F.col("band_idx") == F.col("band"), 0).when(F.abs(F.col("_zy") - F.col("center_y")) <= F.col("band_tolerance") * 1.5, 1).otherwise(2)
    right = F.col("zone").isNotNull() & (F.col("z_x1") >= F.col("zone_x2") - F.col("column_tolerance") * 0.2)
    by_label = Window.partitionBy("page_id", "item_idx")
    zoned = a.join(z, "page_id").withColumn("_level", level).withColumn("_least", F.min("_level").over(by_label)).filter("_level = _least").withColumn("_right", right).withColumn("_any", F.max("_right").over(by_label)).filter(F.col("_right") | ~F.col("_any"))
    free = lay.lines.select("page_id", "line_idx", "cx", "cy").join(lay.placed_lines.select("page_id", "line_idx", "excluded"), ["page_id", "line_idx"])
    inside = zoned.join(free.filter("excluded = 0"), "page_id").filter(g.inside(F.col("cx"), F.col("cy"), g.box("z_"), 4.0)).select("page_id", "item_idx", "line_idx")
    beside = a.filter("zone is not null").join(free.filter("excluded = 0"), "page_id").filter(F.col("cx") >= F.col("zone_x2") - F.col("column_tolerance")).join(lay.field_zones.select("page_id").distinct(), "page_id", "left_semi").select("page_id", "item_idx", "line_idx")
    chosen = inside.unionByName(beside).distinct()
    every = a.select("page_id", "item_idx").join(free.select("page_id", "line_idx", "excluded"), "page_id").join(chosen.withColumn("_in", F.lit(0)), ["page_id", "item_idx", "line_idx"], "left")
    rank = F.coalesce("_in", F.when(F.col("excluded") == 0, 1).otherwise(2))
    return every.withColumn("_rank", rank).withColumn("_least", F.min("_rank").over(by_label)).filter("_rank = _least").select("page_id", "item_idx", "line_idx")


def ranked(scores: DataFrame) -> DataFrame:
    """Adds rank and runner_up: candidates of each label by score, then height and position of the line."""
    w = Window.partitionBy("page_id", "item_idx").orderBy(F.desc("candidate_score"), "b_cy", "b_cx", "line_idx")
    return scores.withColumn("rank", F.row_number().over(w)).withColumn("runner_up", F.lead("candidate_score").over(w))


def match_class(score: Column, runner_up: Column, rejected: Column) -> Column:
    """unresolved, ambiguous, weak_match or strong_match; the first rule that fits decides."""
    margin = g.round_to(score - F.coalesce(runner_up, F.lit(0.0)), 6)
    return F.when(score.isNull() | (score < 0.42), "unresolved").when(runner_up.isNotNull() & (margin < 0.08), "ambiguous").when(rejected, "weak_match").when((score >= 0.66) & (margin >= 0.1), "strong_match").otherwise("weak_match")


def match_notes(score: Column, runner_up: Column, rejected: Column) -> Column:
    """Why a match isn't sure: a score too low, a close second, or rejections of the selected one."""
    margin = g.round_to(score - F.coalesce(runner_up, F.lit(0.0)), 6)
    return F.when(score.isNull(), "no_candidate").when(score < 0.42, "candidate_score_below_threshold").when(runner_up.isNotNull() & (margin < 0.08), "close_second_candidate").when(rejected, "selected_candidate_has_rejections").otherwise("")


def classes(scores: DataFrame) -> DataFrame:
    """The best candidate of each label with its class, assignment aside."""
    return ranked(scores).filter("rank = 1").withColumn("confidence_class", match_class(F.col("candidate_score"), F.col("runner_up"), F.col("rejected")))


_ASSIGNED = pa.schema([("page_id", pa.int64()), ("item_idx", pa.int32()), ("label", pa.string()), ("line_idx", pa.int32()), ("group_lines", pa.string()), ("group_size", pa.int32()), ("candidate_score", pa.float64()), ("confidence_class", pa.string()), ("distance", pa.float64()), ("candidate_count", pa.int32())])


def _class_of(score: float, second: float | None, rejected: bool) -> str:
    """match_class() for one label."""
    margin = round(score - (second or 0.0), 6)
    if score < 0.42:
        return "unresolved"
    if second is not None and margin < 0.08:
        return "ambiguous"
    if rejected:
        return "weak_match"
    return "strong_match" if score >= 0.66 and margin >= 0.1 else "weak_match"


class _Page:
    """One page: its pooled pairs, sorted by item, as columns; its lines in order of height, its labels' centres and its blocks."""

    def __init__(self, columns: dict[str, np.ndarray], lines: list[dict], texts: list[dict], blocks: list[dict] | None, c: Config):
        self.c, self.col = c, columns
        self.lines = {x["line_idx"]: (x["cy"], x["cx"], float(x["sx"]), float(x["sy"]), x["length"]) for x in sorted(lines, key=lambda x: (x["cy"], x["cx"], x["line_idx"]))}
        self.starts = np.flatnonzero(np.r_[True, columns["item_idx"][1:] != columns["item_idx"][:-1]])
        self.texts = [(x["cx"], x["cy"]) for x in texts]
        self.blocks = [(b["x"], b["y"], b["x"] + b["width"], b["y"] + b["height"]) for b in blocks or ()]
        self.taken: set[int] = set()

    def blocked(self, now_y: float, line: tuple, split: float, h: float) -> bool:
        y, _, sx, _, _ = line
        upper, lower = min(now_y, y) + h * 0.35, max(now_y, y) - h * 0.35
        for tx, ty in self.texts:
            if tx < split and (upper < lower and upper <= ty <= lower or abs(ty - y) <= h * 1.15):
                return True
        return any(x1 <= sx <= x2 and y1 <= y <= y2 for x1, y1, x2, y2 in self.blocks)

    def expand(self, seed: int, split: float, h: float, gap: float, indent: float) -> list[int]:
        """The seed's multiline group: lines below that start alike, level by level, in order of their start."""
        group, queue = [seed], [(seed, 0)]
        size = self.lines[seed][4]
        while queue and len(group) < self.c.group_cap:
            now, depth = queue.pop(0)
            if depth >= self.c.depth_cap:
                continue
            ny, nx, nsx, _, _ = self.lines[now]
            for k, line in self.lines.items():
                if k in group or k in self.taken:
                    continue
                fits = abs(line[2] - nsx) < indent and 0 < line[0] - ny <= gap and abs(line[4] - size) <= max(size * 0.45, 80)
                if not fits and len(group) < self.c.group_cap:
                    continue  # whether it is blocked matters only to a full group
                if abs(line[1] - nx) > indent * 1.2 or self.blocked(ny, line, split, h):
                    if len(group) >= self.c.group_cap:
                        break
                elif fits:
                    group.append(k)
                    queue.append((k, depth + 1))
        return sorted(group, key=lambda k: (self.lines[k][3], group.index(k)))

    def assign(self) -> Iterator[tuple]:
        col = self.col
        for a, b in zip(self.starts, np.r_[self.starts[1:], len(col["item_idx"])]):
            rows = np.arange(a, b)
            line = col["line_idx"][rows]
            hit = np.array([int(k) in self.taken for k in line])
            score = np.where(hit, col["penalised_score"][rows], col["candidate_score"][rows])
            order = np.lexsort((line, col["b_cx"][rows], col["b_cy"][rows], -score))
            best, k = order[0], rows[order[0]]
            kind = _class_of(float(score[best]), float(score[order[1]]) if len(order) > 1 else None, bool(hit[best] or col["rejected"][k]))
            if kind == "unresolved":
                continue
            group = self.expand(int(line[best]), *(float(col[n][k]) for n in ("column_split", "lh", "multiline_gap", "indent_tolerance")))
            self.taken.update(group)
            yield int(col["item_idx"][k]), k, int(line[best]), ",".join(map(str, group)), len(group), float(score[best]), kind, float(col["distance"][k]), len(rows)


_NUMBERS = ["item_idx", "line_idx", "column_split", "b_cx", "b_cy", "lh", "multiline_gap", "indent_tolerance", "rejected", "candidate_score", "penalised_score", "distance"]


def _assign_pages(c: Config):
    def pages(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        page = table.column("page_id").to_numpy()
        cuts = np.flatnonzero(np.r_[True, page[1:] != page[:-1], True])
        heads = cuts[:-1]  # a page's first row holds what all its labels share, the rest are pairs
        columns = {n: table.column(n).to_numpy() for n in _NUMBERS}
        text = table.column("text")
        out = []
        for a, b in zip(heads, cuts[1:]):
            if b == a + 1:
                continue
            head = [table.column(n)[int(a)].as_py() for n in ("lines", "texts", "blocks")]
            for item, k, *rest in _Page({n: v[a + 1 : b] for n, v in columns.items()}, *head, c).assign():
                out.append((int(page[a]), item, text[int(a + 1 + k)].as_py(), *rest))
        rows = list(zip(*out)) if out else [[]] * len(_ASSIGNED)
        return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(rows, _ASSIGNED)], schema=_ASSIGNED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by page and item; the last page waits for its rest."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            page = batch.column("page_id").to_numpy()
            if page[0] == page[-1] and (len(waiting) == 1 or waiting[0].column("page_id")[-1].as_py() == page[-1]):
                continue
            table = pa.Table.from_batches(waiting)
            cut = table.num_rows - int((table.column("page_id").to_numpy() == page[-1]).sum())
            if cut:
                yield pages(table.slice(0, cut))
            waiting = table.slice(cut).to_batches()
        if waiting:
            yield pages(pa.Table.from_batches(waiting))

    return run


def assignments(lay: Layout, label_rows: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """The greedy assignment of a page's labels in order: taken lines count 0.3, the chosen line grows to its multiline group.

    The scores are computed as columns; only this step, whose state is the set
    of taken lines, runs page by page. Unresolved labels give no row.
    """
    label_rows = store_joined(label_rows, "labels")
    scores = candidate_scores(lay, label_rows, c, candidate_pool(lay, label_rows)).join(lay.metrics.select("page_id", "indent_tolerance"), "page_id")
    kept = lay.regions.filter(~F.col("type").isin("multiline_text_region", "standard_input")).groupBy("page_id").agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("blocks"))
    lines = lay.lines.groupBy("page_id").agg(F.collect_list(F.struct("line_idx", "cx", "cy", "sx", "sy", "length")).alias("lines"))
    texts = label_rows.groupBy("page_id").agg(F.collect_list(F.struct("cx", "cy")).alias("texts"))
    heads = lines.join(texts, "page_id").join(kept, "page_id", "left").withColumn("item_idx", F.lit(-1))
    rows = scores.select("page_id", "text", *_NUMBERS).unionByName(heads, allowMissingColumns=True)
    # a head's numbers aren't read; without nulls they stay plain arrays
    rows = rows.select("page_id", "text", *[F.coalesce(F.col(n), F.lit(False) if n == "rejected" else F.lit(0)).alias(n) for n in _NUMBERS], "lines", "texts", "blocks")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by a hash of the page: a repartition by the joins' own key is dropped, and skew joins would then part a page
    dealt = rows.repartition(tasks, F.xxhash64("page_id")).sortWithinPartitions("page_id", F.col("lines").isNull(), "item_idx")
    return dealt.mapInArrow(_assign_pages(c), "page_id long, item_idx int, label string, line_idx int, group_lines string, group_size int, candidate_score double, confidence_class string, distance double, candidate_count int")
