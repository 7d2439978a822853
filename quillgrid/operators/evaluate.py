"""Quality summaries and comparison reports of mappings and recognised text."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillgrid.config import DEFAULT, Config
from quillgrid.functions import geometry as g

# The categories of failed pages, in the order of their rules.
CATEGORIES = ("token fragmentation", "multiline splitting", "confidence-threshold issues", "false field-line detection", "graph segmentation weakness", "header/title contamination", "over-aggressive filtering", "sparse-band exclusion error", "precision/recall trade-off regression")


def class_histogram(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy(F.coalesce("confidence_class", F.lit("unknown")).alias("confidence_class")).agg(F.count("*").alias("n"))


def region_type() -> Column:
    """Supporting region, else field type, else unknown; blank counts as missing."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.coalesce(blank("region_support"), blank("field_type"), F.lit("unknown"))


def region_histogram(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy(region_type().alias("region_type")).agg(F.count("*").alias("n"))


def unmatched_labels(items: DataFrame, mappings: DataFrame) -> DataFrame:
    """page_id, text: distinct texts of a page that no mapping of it names."""
    return items.filter("text <> ''").select("page_id", "text").subtract(mappings.filter("label <> ''").select("page_id", F.col("label").alias("text")))


def unresolved_labels(items: DataFrame, mappings: DataFrame) -> DataFrame:
    """Items whose text no mapping of the page names; repeated texts stay."""
    named = mappings.filter("label is not null").select("page_id", F.col("label").alias("text")).distinct()
    return items.join(named, ["page_id", "text"], "left_anti")


def top_band_unresolved(items: DataFrame, mappings: DataFrame, m: DataFrame) -> DataFrame:
    """Unresolved items in the top 30 % of their page."""
    return unresolved_labels(items, mappings).join(m.select("page_id", "page_height"), "page_id").filter(F.col("cy") <= F.col("page_height") * 0.3).drop("page_height")


def mapping_summary(items: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row per page with mappings: counts by class, mean score (0 if none is known), multiline and unmatched counts."""
    of = lambda c: F.count_if(F.col("confidence_class") == c)
    s = mappings.groupBy("page_id").agg(
        F.count("*").alias("mapping_count"), F.coalesce(g.round_to(F.avg("candidate_score"), 4), F.lit(0.0)).alias("average_candidate_score"), F.count_if(F.col("multiline_group_size") > 1).alias("multiline_mapping_count"),
        of("ambiguous").alias("ambiguous_mapping_count"), of("unresolved").alias("unresolved_mapping_count"), of("strong_match").alias("strong_match_count"), of("weak_match").alias("weak_match_count"),
    )
    u = unmatched_labels(items, mappings).groupBy("page_id").agg(F.count("*").alias("unmatched_label_count"))
    return s.join(u, "page_id", "left").withColumn("unmatched_label_count", F.coalesce("unmatched_label_count", F.lit(0)))


#: Deltas of two summaries: name -> column.
DELTAS = {"mapping_count_delta": "mapping_count", "average_candidate_score_delta": "average_candidate_score", "unmatched_label_delta": "unmatched_label_count", "strong_match_delta": "strong_match_count", "weak_match_delta": "weak_match_count", "ambiguous_delta": "ambiguous_mapping_count", "unresolved_delta": "unresolved_mapping_count"}


def summary_delta(baseline: DataFrame, candidate: DataFrame, key: str = "page_id") -> DataFrame:
    """Candidate minus baseline by key; a key that one side lacks counts 0 there."""
    a = baseline.select(key, *[F.col(c).alias(f"_{c}") for c in DELTAS.values()])
    both = a.join(candidate.select(key, *DELTAS.values()), key, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(key, *[(g.round_to(zero(c) - zero(f"_{c}"), 4) if "score" in c else zero(c) - zero(f"_{c}")).alias(n) for n, c in DELTAS.items()])


def service_stats(mappings: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per page: mapping_count, line_count (mapped lines), field_candidate_count, multiline_count, average_candidate_score."""
    a = mappings.groupBy("page_id").agg(F.count("*").alias("mapping_count"), F.sum(F.coalesce(F.size("field_lines"), F.lit(0))).alias("line_count"), F.count_if(F.size("field_lines") > 1).alias("multiline_count"), F.coalesce(g.round_to(F.avg("candidate_score"), 4), F.lit(0.0)).alias("average_candidate_score"))
    b = lines.groupBy("page_id").agg(F.count("*").alias("field_candidate_count"))
    return a.join(b, "page_id", "left").withColumn("field_candidate_count", F.coalesce("field_candidate_count", F.lit(0)))


def row_table(rows: DataFrame) -> DataFrame:
    """page_id, row_idx, center_y, item_count, text of first-fit rows."""
    parts = F.array_sort(F.collect_list(F.struct("x1", "item_idx", "text")))
    return rows.groupBy("page_id", "row_idx").agg(g.round_to(F.sum((F.col("y1") + F.col("y2")) / 2) / F.count("*"), 2).alias("center_y"), F.count("*").alias("item_count"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def compare_rows(baseline: DataFrame, current: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Each baseline row with the nearest current row within reach, else missing; current rows that none came near are extra.

    page_id, status, baseline_row, current_row, y_delta, baseline_text, current_text. Not one to one.
    """
    a = baseline.select("page_id", F.col("row_idx").alias("baseline_row"), F.col("center_y").alias("_ay"), F.col("text").alias("baseline_text"))
    b = current.select("page_id", F.col("row_idx").alias("current_row"), F.col("center_y").alias("_by"), F.col("text").alias("current_text"))
    near = a.join(b, "page_id").withColumn("y_delta", F.abs(F.col("_ay") - F.col("_by"))).groupBy("page_id", "baseline_row").agg(F.min(F.struct("y_delta", "current_row", "current_text")).alias("n"))
    best = near.filter(F.col("n.y_delta") <= c.compare_distance).select("page_id", "baseline_row", "n.*")
    left = a.join(best, ["page_id", "baseline_row"], "left").select("page_id", F.when(F.col("current_row").isNull(), "missing_current_row").otherwise("matched").alias("status"), "baseline_row", "current_row", g.round_to(F.col("y_delta"), 2).alias("y_delta"), "baseline_text", "current_text")
    extra = b.join(best.select("page_id", "current_row").distinct(), ["page_id", "current_row"], "left_anti").select("page_id", F.lit("extra_current_row").alias("status"), F.lit(None).cast("int").alias("baseline_row"), "current_row", F.lit(None).cast("double").alias("y_delta"), F.lit(None).cast("string").alias("baseline_text"), "current_text")
    return left.unionByName(extra)


@F.pandas_udf(DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of the lower-cased texts; 0 if one is missing."""
    return pd.Series([round(difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio(), 4) if isinstance(x, str) and isinstance(y, str) else 0.0 for x, y in zip(a, b)])


def quality_proxies(summary: DataFrame, items: DataFrame) -> DataFrame:
    """summary with ocr_item_count, precision_proxy (strong over mapped), recall_proxy (mapped over items) and false_positive_proxy."""
    n = items.groupBy("page_id").agg(F.count("*").alias("ocr_item_count"), F.count_if(F.col("source_item_count") > 1).alias("merged_ocr_count"), F.coalesce(F.sum(F.when(F.col("source_item_count") > 1, F.col("source_item_count"))), F.lit(0)).alias("source_items_merged"))
    share = lambda a, b: F.when(F.col(b) > 0, g.round_to(F.col(a) / F.col(b), 4)).otherwise(0.0)
    s = summary.join(n, "page_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ocr_item_count", "merged_ocr_count", "source_items_merged")})
    return s.withColumns({"precision_proxy": share("strong_match_count", "mapping_count"), "recall_proxy": share("mapping_count", "ocr_item_count"), "false_positive_proxy": F.col("ambiguous_mapping_count") + F.col("weak_match_count")})


def failure_categories(p: DataFrame, baseline: tuple[float, float] | None = None) -> DataFrame:
    """page_id, category of every rule that a page meets, each once.

    Needs the proxies and field_candidate_count, excluded_count, unresolved_count,
    short_top_count (unresolved texts of up to 24 characters in the top band),
    has_multiline and has_table. A baseline is a precision and a recall, given
    or in the columns baseline_precision and baseline_recall (null: none).
    """
    c = F.col
    rules = [
        (c("merged_ocr_count") > 0) & (c("source_items_merged") >= F.greatest(c("merged_ocr_count") * 2, F.lit(4))),
        (c("multiline_mapping_count") == 0) & c("has_multiline"),
        (c("average_candidate_score") < 0.5) | ((c("ambiguous_mapping_count") >= F.greatest(F.lit(1), c("strong_match_count") * 2)) & (c("precision_proxy") < 0.35)),
        (c("field_candidate_count") >= 70) & (c("mapping_count") < F.greatest(c("ocr_item_count"), F.lit(1))) & (c("false_positive_proxy") >= c("weak_match_count")),
        c("has_table") & (c("ambiguous_mapping_count") >= F.greatest(F.lit(3), F.floor(c("mapping_count") / 2))),
        c("short_top_count") > 0,
        (c("unresolved_count") > 0) & (c("precision_proxy") < 0.4) & (c("recall_proxy") < 0.85),
        (c("excluded_count") > 0) & (c("field_candidate_count") > 0) & (c("mapping_count") < c("field_candidate_count") * 0.35),
        F.lit(False),
    ]
    if baseline or "baseline_recall" in p.columns:
        precision, recall = map(F.lit, baseline) if baseline else (c("baseline_precision"), c("baseline_recall"))
        rules[6] = rules[6] | F.coalesce(c("recall_proxy") + 0.08 < recall, F.lit(False))
        rules[8] = F.coalesce((c("precision_proxy") + 0.05 < precision) & (c("ambiguous_mapping_count") > 0), F.lit(False))
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in zip(CATEGORIES, rules)]))
    return p.select("page_id", F.explode(found).alias("category"))


def corpus_rollup(p: DataFrame, categories: DataFrame) -> DataFrame:
    """Means over all pages and the count of each category: metric, value."""
    means = p.agg(F.count("*").cast("double").alias("sample_count"), g.round_to(F.avg("average_candidate_score"), 4).alias("average_mapping_confidence"), g.round_to(F.avg("recall_proxy"), 4).alias("average_recall_proxy"), g.round_to(F.avg("precision_proxy"), 4).alias("average_precision_proxy"))
    flat = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in means.columns])).alias("m")).select("m.*")
    return flat.unionByName(categories.groupBy(F.concat(F.lit("category: "), "category").alias("metric")).agg(F.count("*").cast("double").alias("value")))


def baseline_sequence(samples: DataFrame, order: str, is_baseline: Column) -> DataFrame:
    """Adds compared: samples after the first baseline compare in the first pass, those before it in the second, itself never."""
    w = Window.partitionBy("group_id").orderBy(order)
    all_rows = Window.partitionBy("group_id")
    first = F.min(F.when(is_baseline, F.col("_rn"))).over(all_rows)
    numbered = samples.withColumn("_rn", F.row_number().over(w)).withColumn("_first", F.coalesce(first, F.lit(1)))
    return numbered.withColumn("compared", F.when(F.col("_rn") == F.col("_first"), "baseline").when(F.col("_rn") > F.col("_first"), "first pass").otherwise("second pass")).drop("_rn", "_first")


def markdown(report: DataFrame, most_rows: int = 1000) -> str:
    """A small report as a Markdown table; raises above `most_rows` rows."""
    rows = report.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"the report has more than {most_rows} rows")
    head = "| " + " | ".join(report.columns) + " |\n|" + " --- |" * len(report.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"


def first_labels(items: DataFrame, limit: int = 8) -> DataFrame:
    """page_id, labels: the first texts of each page in order, joined by ' | '."""
    w = Window.partitionBy("page_id").orderBy("item_idx")
    top = items.filter("text <> ''").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    return top.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "text"))), lambda p: p["text"]), " | ").alias("labels"))


def region_types(regions: DataFrame, clusters: DataFrame, bands: DataFrame, owned: DataFrame) -> DataFrame:
    """page_id, types (distinct, in order of first appearance, joined by commas), multiline: whether one of them is."""
    parts = [(0, regions, "region_idx"), (1, clusters, "row_idx"), (2, bands, "band_idx"), (3, owned, "label_zone")]
    all_ = None
    for k, df, idx in parts:
        one = df.select("page_id", F.lit(k).alias("k"), F.col(idx).cast("long").alias("i"), "type")
        all_ = one if all_ is None else all_.unionByName(one)
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "i", "type"))), lambda p: p["type"]))
    return all_.groupBy("page_id").agg(F.array_join(ordered, ",").alias("types"), F.bool_or(F.col("type").contains("multiline")).alias("multiline"))


def class_map(mappings: DataFrame) -> DataFrame:
    """page_id, confidence_classes: a map from class to count."""
    n = mappings.groupBy("page_id", F.coalesce("confidence_class", F.lit("unknown")).alias("k")).agg(F.count("*").alias("n"))
    return n.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("confidence_classes"))


def map_text(m: Column) -> Column:
    """A map's entries by key as `key=value`, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def merged_counters(stored: DataFrame, mappings: DataFrame, names: dict[str, str]) -> DataFrame:
    """For each page with mappings the stored counter of each name, else the class's count, else 0. `names`: counter -> class."""
    m = mappings.select("page_id").distinct().join(class_map(mappings), "page_id", "left").join(stored, "page_id", "left")
    return m.select("page_id", *[F.coalesce(F.col(n).cast("long"), F.try_element_at("confidence_classes", F.lit(k)), F.lit(0)).alias(n) for n, k in names.items()])


def diagnostics(items: DataFrame, mappings: DataFrame, lines: DataFrame, regions: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row per page with items: labels, mappings, merged items and their sources, field candidates, regions, excluded regions."""
    out = items.groupBy("page_id").agg(F.count("*").alias("labels_processed"), F.count_if(F.col("source_item_count") > 1).alias("merged_item_count"), F.sum(F.greatest("source_item_count", F.lit(1))).alias("source_items_merged"))
    for df, n in ((mappings, "mappings_selected"), (lines, "field_candidate_count"), (regions, "semantic_region_count"), (excluded, "excluded_region_count")):
        out = out.join(df.groupBy("page_id").agg(F.count("*").alias(n)), "page_id", "left").withColumn(n, F.coalesce(n, F.lit(0)))
    return out


def category_order(categories: DataFrame) -> DataFrame:
    """category, n, place: the most frequent first, equals by name. Categories are few, so one task numbers them."""
    n = categories.groupBy("category").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "category")))
