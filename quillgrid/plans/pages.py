"""Queries of the page operators over the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.config import PIPELINE_EXCLUDED
from quillgrid.functions import geometry as g
from quillgrid.functions import text as t
from quillgrid.operators import evaluate as ev
from quillgrid.operators import export as ex
from quillgrid.operators import folds, lines as ln, mapping as mp, ocr, regions as rg, rows as rw, structure as st
from quillgrid.plans.pages_sql import ORACLES
from quillgrid.plans.process import Processed, process
from quillgrid.session import read, store_joined
from quillgrid.sources import tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    _QUERIES[f.__name__] = f
    return f


def _sizes(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Extents of items and lines stand in for image sizes."""
    ends = items.select("page_id", "x2", "y2").unionByName(lines.select("page_id", "x2", "y2"))
    return ends.groupBy("page_id").agg(F.max("x2").alias("image_width"), F.max("y2").alias("image_height"))


class _Pages:
    """The relations that queries start from, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @property
    def items(self) -> DataFrame:
        return tables.items(self.spark, self.dir)

    @property
    def lines(self) -> DataFrame:
        return tables.lines(self.spark, self.dir)

    @property
    def contours(self) -> DataFrame:
        return tables.regions(self.spark, self.dir)

    @property
    def mappings(self) -> DataFrame:
        return tables.mappings(self.spark, self.dir)

    @property
    def sizes(self) -> DataFrame:
        return _sizes(self.items, self.lines)

    @property
    def regions(self) -> DataFrame:
        return rg.classify(self.contours, self.items, self.lines, self.sizes)

    @property
    def layout(self) -> mp.Layout:
        return mp.Layout(self.items, self.lines, lambda items, lines: rg.classify(self.contours, items, lines, _sizes(items, lines)), lambda: rg.boxes(self.contours))


def _label_rows(p: _Pages, lay: mp.Layout) -> DataFrame:
    return mp.labels(lay.items, lay.metrics)


@query
def flagship_label_field_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappable labels with their nearest line below or beside, summed up by page."""
    lay = _Pages(spark, sf_dir).layout
    named = lay.items.join(lay.metrics.select("page_id", "page_height"), "page_id").filter(t.mappable_label(F.col("text"), F.col("cy"), F.col("page_height")))
    found = rw.nearest_lines(named.select("page_id", F.col("item_idx").alias("row_idx"), "text", F.col("y2").alias("bottom_y"), F.least("x2", F.lit(620.0)).alias("right_x")), lay.lines)
    per_page = found.groupBy("page_id").agg(F.count("*").alias("matched"), F.count_distinct("line_idx").alias("lines_used"), g.round_to(F.avg("vertical_distance"), 4).alias("mean_distance"))
    return named.groupBy("page_id").agg(F.count("*").alias("labels")).join(per_page, "page_id", "left").select("page_id", "labels", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("lines_used", F.lit(0)).alias("lines_used"), "mean_distance")


@query
def geom_bounds(spark, sf_dir):
    return tables.items(spark, sf_dir).select("page_id", "item_idx", "x1", "y1", "x2", "y2", "cx", "cy")


@query
def geom_center_length(spark, sf_dir):
    return tables.lines(spark, sf_dir).select("page_id", "line_idx", "x1", "y1", "x2", "y2", "cx", "cy", g.round_to(F.col("length"), 6).alias("length"))


def _pairs(p: _Pages) -> DataFrame:
    a = p.items.select("page_id", "item_idx", *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    return a.join(p.lines.select("page_id", "line_idx", *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")]), "page_id")


@query
def overlap_ratio_pairs(spark, sf_dir):
    a, b = g.box("a_"), g.box("b_")
    return _pairs(_Pages(spark, sf_dir)).select("page_id", "item_idx", "line_idx", g.round_to(g.overlap_ratio(a, b), 6).alias("overlap"), g.round_to(g.x_overlap(a, b), 6).alias("x_overlap"))


@query
def vertical_overlap_pairs(spark, sf_dir):
    """Pairs of items on a page that share 45 % of the lower one's height."""
    i = tables.items(spark, sf_dir)
    a = i.select("page_id", F.col("item_idx").alias("a_idx"), *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    b = i.select("page_id", F.col("item_idx").alias("b_idx"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    ratio = g.vertical_overlap(g.box("a_"), g.box("b_"))
    return a.join(b, "page_id").filter((F.col("a_idx") < F.col("b_idx")) & (ratio >= 0.45)).select("page_id", "a_idx", "b_idx", g.round_to(ratio, 6).alias("ratio"))


@query
def layout_metrics(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return st.metrics(p.items, p.lines, p.regions)


@query
def ocr_noise_filter(spark, sf_dir):
    return ocr.drop_noise(tables.items(spark, sf_dir)).select("page_id", "item_idx", "text", "median_height")


@query
def ocr_first_fit_rows(spark, sf_dir):
    return ocr.text_rows(ocr.drop_noise(tables.items(spark, sf_dir))).select("page_id", "item_idx", "row_idx")


@query
def ocr_merge_tokens(spark, sf_dir):
    return ocr.merge_tokens(tables.items(spark, sf_dir)).select("page_id", "row_idx", "run_idx", "text", "x1", "y1", "x2", "y2", "confidence", "source_item_count", "tokens")


@query
def line_dedup_buckets(spark, sf_dir):
    return ln.deduplicate(tables.lines(spark, sf_dir)).select("page_id", "line_idx")


@query
def line_near_text_semi(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return ln.near_text(p.lines, p.items).select("page_id", "line_idx")


@query
def line_over_text_anti(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return ln.off_text(p.lines, p.items).select("page_id", "line_idx")


@query
def line_outside_region_anti(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return ln.outside_regions(p.lines, rg.of_types(p.regions, PIPELINE_EXCLUDED)).select("page_id", "line_idx")


@query
def field_line_filter(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return ln.field_lines(p.lines, p.items, rg.of_types(p.regions, PIPELINE_EXCLUDED)).select("page_id", "line_idx", "sx", "sy", "ex", "ey", "field_type")


@query
def region_counts(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return rg.with_counts(p.contours, p.items, p.lines).select("page_id", "region_idx", "ocr_count", "line_count")


@query
def region_classify(spark, sf_dir):
    return _Pages(spark, sf_dir).regions.select("page_id", "region_idx", "type", "confidence", "ocr_count", "line_count")


@query
def excluded_regions(spark, sf_dir):
    return _Pages(spark, sf_dir).layout.excluded


@query
def row_groups_gap(spark, sf_dir):
    return rw.gap_rows(tables.items(spark, sf_dir)).select("page_id", "item_idx", "row_idx")


@query
def table_line_groups(spark, sf_dir):
    return ln.table_groups(tables.lines(spark, sf_dir)).select("page_id", "line_idx", "group_idx", "group_lines")


@query
def table_rules_removed(spark, sf_dir):
    return ln.without_rules(tables.lines(spark, sf_dir)).select("page_id", "line_idx")


@query
def label_run_groups(spark, sf_dir):
    lay = _Pages(spark, sf_dir).layout
    return st.label_groups(lay.entities, lay.metrics)


@query
def row_merge_pairs(spark, sf_dir):
    rows = rw.row_records(rw.gap_rows(tables.items(spark, sf_dir)))
    return rw.merge_pairs(rows).select("page_id", "row_idx", "role", "merged_idx")


@query
def row_geometry(spark, sf_dir):
    return rw.row_records(rw.gap_rows(tables.items(spark, sf_dir))).select("page_id", "row_idx", "text", "item_count", "bottom_y", "top_y", "center_y", "right_x", "raw_right_x", "left_x")


@query
def column_split_gap(spark, sf_dir):
    return mp.column_split(tables.items(spark, sf_dir))


@query
def axis_clusters_y(spark, sf_dir):
    lay = _Pages(spark, sf_dir).layout
    return lay.band_members.select("page_id", "kind", "idx", "band_idx", g.round_to(F.col("center_y"), 2).alias("center"))


@query
def axis_clusters_x(spark, sf_dir):
    lay = _Pages(spark, sf_dir).layout
    both = lay.label_members.unionByName(lay.field_members)
    return both.select("page_id", "kind", "idx", "column_idx", g.round_to(F.col("center_x"), 2).alias("center"))


@query
def bands(spark, sf_dir):
    return _Pages(spark, sf_dir).layout.prepare(5).bands


@query
def columns_primary(spark, sf_dir):
    lay = _Pages(spark, sf_dir).layout
    return lay.label_columns.unionByName(lay.field_columns)


@query
def zones(spark, sf_dir):
    lay = _Pages(spark, sf_dir).layout.prepare(6)
    return lay.label_zones.unionByName(lay.field_zones)


@query
def text_rows(spark, sf_dir):
    lay = _Pages(spark, sf_dir).layout
    return st.text_rows(lay.entities, lay.metrics)


@query
def field_row_clusters(spark, sf_dir):
    lay = _Pages(spark, sf_dir).layout
    return st.field_clusters(lay.entities, lay.metrics)


@query
def ownership_best_zone(spark, sf_dir):
    return _Pages(spark, sf_dir).layout.owned_alone()


@query
def best_zone_for_item(spark, sf_dir):
    lay = _Pages(spark, sf_dir).layout
    a = lay.placed_labels.select("page_id", F.lit("label").alias("kind"), F.col("item_idx").alias("idx"), "zone", "band")
    return a.unionByName(lay.placed_lines.select("page_id", F.lit("line").alias("kind"), F.col("line_idx").alias("idx"), "zone", "band"))


@query
def excluded_flag(spark, sf_dir):
    return _Pages(spark, sf_dir).layout.placed_lines.select("page_id", "line_idx", "excluded")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = _Pages(spark, sf_dir).layout.prepare(6)
    return st.membership_edges(lay.entities, lay.bands, lay.label_zones, lay.field_zones, lay.label_columns, lay.field_columns, lay.excluded, lay.owned)


@query
def graph_edges_theta(spark, sf_dir):
    lay = _Pages(spark, sf_dir).layout
    return st.theta_edges(lay.entities, lay.metrics)


@query
def graph_membership_edges(spark, sf_dir):
    return _graph(spark, sf_dir)


@query
def graph_adjacency(spark, sf_dir):
    return st.adjacency(_graph(spark, sf_dir))


@query
def pair_features(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    lay = p.layout
    names = ["same_row", "same_column", "vertical_continuation", "x_overlap_ratio", "spacing_similarity", "size_consistency", "ownership_strength", "region_support", "alignment_score", "column_consistency", "ownership_confidence", "global_structure_score", "band_alignment"]
    return mp.pair_features(lay, _label_rows(p, lay)).select("page_id", "item_idx", "line_idx", *names)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Pages(spark, sf_dir)
    lay = p.layout
    return mp.candidate_scores(lay, _label_rows(p, lay))


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the lines in each label's candidate pool."""
    p = _Pages(spark, sf_dir)
    lay = p.layout
    found = store_joined(_label_rows(p, lay), "labels")
    return mp.candidate_scores(lay, found, pool=mp.candidate_pool(lay, found))


@query
def candidate_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("page_id", "item_idx", "line_idx", "local_score", "global_structure_score", "candidate_score", "rejected", "distance")


@query
def candidate_top5(spark, sf_dir):
    return mp.ranked(_pooled(spark, sf_dir)).filter("rank <= 5").select("page_id", "item_idx", "rank", "line_idx", "candidate_score")


@query
def candidate_class(spark, sf_dir):
    return mp.classes(_pooled(spark, sf_dir)).select("page_id", "item_idx", "line_idx", "candidate_score", "confidence_class")


@query
def candidate_pool(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    lay = p.layout
    return mp.candidate_pool(lay, _label_rows(p, lay))


@query
def assigned_mappings(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    lay = p.layout
    return mp.assignments(lay, _label_rows(p, lay))


@query
def multiline_groups(spark, sf_dir):
    return assigned_mappings(spark, sf_dir).filter("group_size > 1").select("page_id", "item_idx", "line_idx", "group_lines", "group_size")


@query
def line_nms(spark, sf_dir):
    return folds.suppress_near_lines(tables.lines(spark, sf_dir)).select("page_id", "line_idx")


@query
def multiline_closure(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return rw.closure(rw.steps(p.lines, rw.row_records(rw.gap_rows(p.items))))


@query
def row_line_match(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return rw.nearest_lines(rw.row_records(rw.gap_rows(p.items)), p.lines)


@query
def row_assignments(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return rw.map_rows(rw.row_records(rw.gap_rows(p.items)), p.lines)


@query
def checkbox_not_on_text(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return rg.checkboxes_off_text(p.contours, p.items).select("page_id", "region_idx")


@query
def checkbox_nearest_label(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return rg.nearest_label(p.contours, p.items)


@query
def fallback_lines(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    sized = p.items.join(p.sizes, "page_id")
    return ln.fallback_lines(sized, F.col("image_width")).select("page_id", "line_idx", "sx", "sy", "ex", "ey", "field_type")


@query
def union_candidates(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    made = ln.fallback_lines(p.items.join(p.sizes, "page_id"), F.col("image_width"))
    return ln.union_candidates(p.lines, made).select("page_id", "line_idx", "sx", "sy", "ex", "ey", "field_type")


@query
def entities_union(spark, sf_dir):
    return _Pages(spark, sf_dir).layout.entities.drop("idx")


@query
def label_keyword_filter(spark, sf_dir):
    lay = _Pages(spark, sf_dir).layout
    return mp.labels(lay.items, lay.metrics).select("page_id", "item_idx", "text", "column_split")


@query
def text_case_ratio(spark, sf_dir):
    text = F.col("text")
    return tables.items(spark, sf_dir).select("page_id", "item_idx", g.round_to(t.upper_ratio(text), 6).alias("upper_ratio"), g.round_to(t.symbol_ratio(text), 6).alias("symbol_ratio"), t.alnum_count(text).alias("alnum"), t.is_prompt(text).alias("prompt"))


@query
def field_name_sanitize(spark, sf_dir):
    return tables.mappings(spark, sf_dir).select("mapping_id", t.field_name(F.col("label"), F.col("mapping_id")).alias("name"))


@query
def class_histogram(spark, sf_dir):
    return ev.class_histogram(tables.mappings(spark, sf_dir))


@query
def region_histogram(spark, sf_dir):
    return ev.region_histogram(tables.mappings(spark, sf_dir))


@query
def mapping_summary(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return ev.mapping_summary(p.items, p.mappings)


@query
def summary_delta(spark, sf_dir):
    """Mappings of the current schema against those of the older one, by page."""
    p = _Pages(spark, sf_dir)
    older = p.mappings.filter("state is null")
    return ev.summary_delta(ev.mapping_summary(p.items, older), ev.mapping_summary(p.items, p.mappings.filter("state is not null")))


@query
def api_stats(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return ev.service_stats(p.mappings, p.lines)


@query
def unmatched_labels_except(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return ev.unmatched_labels(p.items, p.mappings)


@query
def unresolved_labels_anti(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return ev.unresolved_labels(p.items, p.mappings).select("page_id", "item_idx", "text")


@query
def top_band_unresolved_semi(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    lay = p.layout
    return ev.top_band_unresolved(lay.items, p.mappings, lay.metrics).select("page_id", "item_idx", "text")


@query
def ocr_quality_summary(spark, sf_dir):
    return ocr.quality_summary(tables.items(spark, sf_dir))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the items as they came and of those that pass the noise filter."""
    i = tables.items(spark, sf_dir)
    return ev.row_table(ocr.text_rows(i, 0.70, 18.0)), ev.row_table(ocr.text_rows(ocr.drop_noise(i), 0.70, 18.0))


@query
def row_compare_nearest(spark, sf_dir):
    return ev.compare_rows(*_versions(spark, sf_dir))


@query
def row_text_similarity(spark, sf_dir):
    both = ev.compare_rows(*_versions(spark, sf_dir))
    return both.select("page_id", "status", "baseline_row", "current_row", ev.text_similarity("baseline_text", "current_text").alias("text_similarity"))


def _proxies(p: _Pages) -> DataFrame:
    return ev.quality_proxies(ev.mapping_summary(p.items, p.mappings), p.items)


@query
def quality_proxies(spark, sf_dir):
    return _proxies(_Pages(spark, sf_dir)).select("page_id", "mapping_count", "ocr_item_count", "precision_proxy", "recall_proxy", "false_positive_proxy")


def _category_inputs(p: _Pages) -> DataFrame:
    lay = p.layout
    top = ev.top_band_unresolved(lay.items, p.mappings, lay.metrics).groupBy("page_id").agg(F.count_if(F.length("text") <= 24).alias("short_top_count"))
    open_ = ev.unresolved_labels(lay.items, p.mappings).groupBy("page_id").agg(F.count("*").alias("unresolved_count"))
    found = lay.lines.groupBy("page_id").agg(F.count("*").alias("field_candidate_count"))
    r = lay.regions.groupBy("page_id").agg(F.bool_or(F.col("type").contains("multiline")).alias("has_multiline"), F.bool_or(F.col("type").isin("table_like_region", "checkbox_region")).alias("has_table"), F.count_if(F.col("type").isin(*PIPELINE_EXCLUDED)).alias("excluded_count"))
    d = _proxies(p)
    for part in (top, open_, found, r):
        d = d.join(part, "page_id", "left")
    return d.fillna(0, ["short_top_count", "unresolved_count", "field_candidate_count", "excluded_count"]).fillna(False, ["has_multiline", "has_table"])


def _categories(p: _Pages) -> DataFrame:
    return ev.failure_categories(_category_inputs(p))


@query
def failure_categories(spark, sf_dir):
    return _categories(_Pages(spark, sf_dir))


@query
def corpus_rollup(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return ev.corpus_rollup(_proxies(p), _categories(p))


@query
def baseline_sequence(spark, sf_dir):
    """Pages of a station in order, the first one of mode `ml` as the baseline."""
    runs = read(spark, sf_dir, "runs").filter("station is not null").select(F.col("station").alias("group_id"), "page_id", "mode")
    return ev.baseline_sequence(runs, "page_id", F.col("mode") == "ml").select("group_id", "page_id", "compared")


@query
def field_boxes(spark, sf_dir):
    return ex.field_boxes(tables.mappings(spark, sf_dir)).drop("label")


@query
def pdf_field_geometry(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    f = ex.form_fields(ex.field_boxes(p.mappings), p.sizes)
    return f.select("page_id", "mapping_id", "box_idx", "name", "kind", *[g.round_to(F.col(c), 4).alias(c) for c in ("x", "y", "width", "height")])


@query
def overlay_percent_boxes(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    b = ex.percent_boxes(ex.field_boxes(p.mappings), p.sizes)
    return b.select("page_id", "mapping_id", "box_idx", *[g.round_to(F.col(c), 4).alias(c) for c in ("left", "top", "width", "height")])


@query
def overlay_draw_list(spark, sf_dir):
    return ex.draw_list(_Pages(spark, sf_dir).layout.entities)


@query
def layout_metrics_older(spark, sf_dir):
    return st.simple_metrics(_Pages(spark, sf_dir).layout.metrics)


@query
def pair_features_older(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    lay = p.layout
    return st.simple_pair_features(lay.items, lay.lines, lay.regions, st.label_groups(lay.entities, lay.metrics), lay.metrics)


@query
def page_priors(spark, sf_dir):
    lay = _Pages(spark, sf_dir).layout
    return st.page_priors(lay.bands, lay.label_columns, lay.field_columns, lay.label_zones, lay.field_zones, lay.excluded)


@query
def row_window_counts(spark, sf_dir):
    """Lines within the row tolerance of each label's height."""
    lay = _Pages(spark, sf_dir).layout
    a = lay.items.join(lay.metrics.select("page_id", "row_tolerance"), "page_id").select("page_id", "item_idx", F.col("cy").alias("_cy"), "row_tolerance")
    hit = a.join(lay.lines.select("page_id", "cy"), "page_id").filter(F.abs(F.col("cy") - F.col("_cy")) <= F.col("row_tolerance")).groupBy("page_id", "item_idx").agg(F.count("*").alias("n"))
    return a.join(hit, ["page_id", "item_idx"], "left").select("page_id", "item_idx", F.coalesce("n", F.lit(0)).alias("row_window_candidates"))


@query
def first_labels(spark, sf_dir):
    return ev.first_labels(tables.items(spark, sf_dir))


@query
def region_type_list(spark, sf_dir):
    lay = _Pages(spark, sf_dir).layout
    return ev.region_types(lay.regions, st.field_clusters(lay.entities, lay.metrics), lay.bands, lay.owned)


@query
def box_bottom_lines(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return ln.box_bottoms(p.contours, p.sizes).select("page_id", "line_idx", "sx", "sy", "ex", "ey", "field_type")


@query
def weak_lines(spark, sf_dir):
    return ln.weak_lines(tables.lines(spark, sf_dir)).select("page_id", "line_idx", "sx", "sy", "ex", "ey", "field_type")


@query
def additional_candidates(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return ln.union_candidates(ln.box_bottoms(p.contours, p.sizes), ln.weak_lines(p.lines)).select("page_id", "line_idx", "sx", "sy", "ex", "ey", "field_type")


@query
def region_size_gate(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return rg.large_enough(p.contours, p.items, p.sizes).select("page_id", "region_idx")


@query
def region_reasons(spark, sf_dir):
    return _Pages(spark, sf_dir).regions.select("page_id", "region_idx", "type", "reason", "aspect_ratio", "page_area_ratio", "ink_density", "box_fill")


@query
def ruled_tables(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return rg.ruled_tables(p.contours, p.sizes).select("page_id", "region_idx", "x", "y", "width", "height")


@query
def lines_outside_tables(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return ln.outside_regions(p.lines, rg.ruled_tables(p.contours, p.sizes)).select("page_id", "line_idx")


@query
def checkbox_mappings(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return rg.checkboxes(p.contours, p.items)


@query
def candidate_region(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    return mp.candidate_region(p.lines, p.regions)


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Pages(spark, sf_dir)
    lay = p.layout
    found = store_joined(_label_rows(p, lay), "labels")
    return mp.ranked(mp.candidate_scores(lay, found, pool=mp.candidate_pool(lay, found), explain=True))


@query
def candidate_reasons(spark, sf_dir):
    """Why each candidate of a label scores as it does."""
    return _explained(spark, sf_dir).select("page_id", "item_idx", "line_idx", "reasons", "rejection_reasons")


@query
def score_breakdown(spark, sf_dir):
    """The parts of the best candidate's score."""
    parts = ["local_score", "global_structure_score", "column_consistency", "ownership_confidence", "horizontal_alignment", "vertical_alignment", "row_overlap", "semantic_hints", "ocr_confidence", *mp.BREAKDOWN]
    return _explained(spark, sf_dir).filter("rank = 1").select("page_id", "item_idx", "line_idx", *parts)


@query
def rejected_candidates(spark, sf_dir):
    """The other four of a label's best five, with what speaks against them."""
    return _explained(spark, sf_dir).filter("rank between 2 and 5").select("page_id", "item_idx", "rank", "line_idx", "candidate_score", "rejection_reasons")


@query
def ambiguity_notes(spark, sf_dir):
    best = mp.ranked(_pooled(spark, sf_dir)).filter("rank = 1")
    return best.select("page_id", "item_idx", mp.match_notes(F.col("candidate_score"), F.col("runner_up"), F.col("rejected")).alias("note"))


@query
def api_class_map(spark, sf_dir):
    return ev.class_map(tables.mappings(spark, sf_dir)).select("page_id", ev.map_text(F.col("confidence_classes")).alias("classes"))


@query
def merged_counters(spark, sf_dir):
    """Counters of the summary for pages that have unmatched labels, of the class map for the others."""
    p = _Pages(spark, sf_dir)
    stored = ev.mapping_summary(p.items, p.mappings).filter("unmatched_label_count > 0").select("page_id", "strong_match_count", "weak_match_count")
    return ev.merged_counters(stored, p.mappings, {"strong_match_count": "strong_match", "weak_match_count": "weak_match"})


@query
def page_diagnostics(spark, sf_dir):
    p = _Pages(spark, sf_dir)
    lay = p.layout.prepare(3)
    return ev.diagnostics(lay.items, p.mappings, lay.lines, lay.regions, rg.of_types(lay.regions, PIPELINE_EXCLUDED))


@query
def field_type_counts(spark, sf_dir):
    m = tables.mappings(spark, sf_dir)
    return m.groupBy("page_id").agg(F.count("*").alias("mapping_count"), F.count_if(F.col("field_type") == "checkbox").alias("checkbox_count"), F.count_if(F.col("field_type") == "multi_line").alias("multi_line_count"))


@query
def category_order(spark, sf_dir):
    return ev.category_order(_categories(_Pages(spark, sf_dir)))


@query
def failure_categories_vs_baseline(spark, sf_dir):
    """With the first page of mode `ml` of each station as the baseline of its pages."""
    p = _Pages(spark, sf_dir)
    runs = read(spark, sf_dir, "runs").filter("station is not null").select("station", "page_id", "mode")
    first = runs.filter("mode = 'ml'").groupBy("station").agg(F.min("page_id").alias("page_id"))
    shares = _proxies(p).select("page_id", F.col("precision_proxy").alias("baseline_precision"), F.col("recall_proxy").alias("baseline_recall"))
    base = runs.select("station", "page_id").join(first.join(shares, "page_id").drop("page_id"), "station").drop("station")
    return ev.failure_categories(_category_inputs(p).join(base, "page_id", "left"))


@query
def bounds_polygons(spark, sf_dir):
    corners = g.bounds_polygon(g.box())
    return tables.items(spark, sf_dir).select("page_id", "item_idx", F.array_join(F.transform(F.flatten(corners), lambda v: F.round(v * 10).cast("long").cast("string")), ",").alias("corners"))


@query
def item_extents(spark, sf_dir):
    """Boxes as four numbers for rows merged from several, as polygons for the others, centres where a row has no box."""
    rows = read(spark, sf_dir, "result_rows").filter("row_id is not null").dropDuplicates(["row_id"])
    polygon = F.when(g.valid_polygon(F.col("bbox")), F.col("bbox"))
    x1, y1, x2, y2 = g.polygon_bounds(polygon)
    flat = F.when((F.col("source_item_count") > 1) & polygon.isNotNull(), F.array(x1, y1, x2 - x1, y2 - y1))
    bottom, right, left = g.extent(flat, polygon, F.col("center"))
    return rows.select("row_id", g.round_to(bottom, 4).alias("bottom"), g.round_to(right, 4).alias("right"), g.round_to(left, 4).alias("left"))


@query
def explicit_boxes(spark, sf_dir):
    """Checkbox fields keep their own boxes, other mappings get theirs from their lines."""
    p = _Pages(spark, sf_dir)
    boxed = rg.checkboxes(p.contours, p.items).select((-(F.col("page_id") * 10 + F.col("region_idx")) - 1).alias("mapping_id"), "page_id", "label", F.lit(0).alias("box_idx"), "x", "y", "width", "height", F.lit("checkbox").alias("field_type"))
    return ex.all_boxes(p.mappings, boxed).drop("label")


@query
def valid_numbers(spark, sf_dir):
    m = read(spark, sf_dir, "mappings").filter("mapping_id is not null").groupBy("mapping_id").agg(F.max_by("distance", F.struct("loaded_at", "distance")).alias("distance"))
    return m.select("mapping_id", ex.valid_number(F.col("distance")).alias("valid"))


@query
def run_addresses(spark, sf_dir):
    """Addresses and paths of each run's picture, and the address of its mappings."""
    r = read(spark, sf_dir, "runs")
    preview = F.concat(F.lit("/runs/"), "run_id", F.when(F.col("mode") == "ml", "/mapping.png").otherwise("/Mapping.PNG?v=2"))
    return r.select("run_id", ex.absolute_url(F.col("source_image"), "http://host/").alias("url"), ex.rooted_path(F.col("source_image"), "/data").alias("path"), ex.mappings_url(preview).alias("mappings"))


@query
def row_flags(spark, sf_dir):
    """Useful and noise rows, and whether the lines at a row's height make it a table row."""
    p = _Pages(spark, sf_dir)
    rows = rw.row_records(rw.gap_rows(p.items))
    at = rows.select("page_id", "row_idx", "top_y", "bottom_y").join(p.lines.select("page_id", "cy"), "page_id").filter(F.col("cy").between(F.col("top_y") - 10, F.col("bottom_y") + 10)).groupBy("page_id", "row_idx").agg(F.count("*").alias("n"))
    flagged = rows.join(rw.useful_rows(rows).select("page_id", "row_idx", F.lit(True).alias("useful")), ["page_id", "row_idx"], "left").join(at, ["page_id", "row_idx"], "left")
    return flagged.select("page_id", "row_idx", F.coalesce("useful", F.lit(False)).alias("useful"), rw.is_noise(F.col("text")).alias("noise"), rw.is_table_row(F.coalesce("n", F.lit(0)), 2).alias("table_row"))


def _processed(spark: SparkSession, sf_dir: str) -> Processed:
    p = _Pages(spark, sf_dir)
    return process(p.items, p.lines, p.contours, p.sizes)


@query
def processed_field_lines(spark, sf_dir):
    """The field lines of a whole run: all sources of candidates, then the filter."""
    return _processed(spark, sf_dir).field_lines.select("page_id", "line_idx", "sx", "sy", "ex", "ey", "field_type")


@query
def processed_mappings(spark, sf_dir):
    return _processed(spark, sf_dir).mappings


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in _QUERIES}
