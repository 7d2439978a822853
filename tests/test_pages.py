"""Micro-cases of the page operators: ties, flat lines, half-way keys, nulls, empty tables, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import geometry as g
from quillgrid.functions import text as t
from quillgrid.operators import evaluate as ev
from quillgrid.operators import export as ex
from quillgrid.operators import folds, lines as ln, mapping as mp, ocr, regions as rg, rows as rw
from quillgrid.sources.tables import line_columns

ITEM = "page_id long, item_idx int, text string, confidence double, source_item_count int, x1 double, y1 double, x2 double, y2 double, cx double, cy double"


def items(spark, *rows, extra=False):
    full = [(p, k, text, conf, 1, *map(float, (x, y, x + w, y + h, x + w / 2, y + h / 2))) for p, k, text, conf, x, y, w, h in rows]
    df = spark.createDataFrame(full, ITEM)
    return df.withColumns({"_new": F.lit(1), "tolerance_": F.lit("x")}) if extra else df


def lines(spark, *rows):
    df = spark.createDataFrame([(p, k, sx, sy, exx, ey, kind) for p, k, sx, sy, exx, ey, kind in rows], "page_id long, line_idx int, sx int, sy int, ex int, ey int, field_type string")
    return df.select("*", *line_columns())


def test_flat_line_has_no_overlap(spark):
    df = spark.createDataFrame([(0.0, 5.0, 10.0, 5.0, 0.0, 0.0, 10.0, 10.0)], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")
    assert df.select(g.overlap_ratio(g.box("a"), g.box("b"))).first()[0] == 0.0
    assert df.select(g.overlap_ratio(g.box("b"), g.box("a"))).first()[0] == 0.0


def test_half_even_keys_and_rounding(spark):
    df = spark.createDataFrame([(6.0,), (18.0,), (30.0,)], "v double")
    assert [r[0] for r in df.select(g.half_even_key(F.col("v"), 12)).collect()] == [0, 2, 2]
    assert spark.range(1).select(g.round_to(F.lit(0.12345), 4), g.round_to(F.lit(-0.00005), 4)).first()[:] == (0.1235, 0.0)


def test_skewed_polygon_centre_and_bad_polygons(spark):
    df = spark.createDataFrame([([[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]],), ([[0.0, 0.0]],), (None,), ([[0.0, None], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0]],)], "bbox array<array<double>>")
    out = df.withColumn("ok", g.valid_polygon(F.col("bbox"))).collect()
    assert [r.ok for r in out] == [True, False, False, False]
    assert df.limit(1).select(*g.polygon_center(F.col("bbox"))).first()[:] == (2.0, 1.0)


def test_noise_filter_defaults(spark):
    df = items(spark, (1, 0, "ab", None, 0, 0, 10, 20), (1, 1, "ab", 0.3, 0, 30, 10, 20), (1, 2, "long enough text", 0.3, 0, 60, 10, 20), (1, 3, "long enough text", 0.39, 0, 90, 10, 2))
    assert sorted(r.item_idx for r in ocr.drop_noise(df).collect()) == [0, 2]


def _running(values, tol):
    out, s, n, k = [], 0.0, 0, -1
    for v in sorted(values):
        if n == 0 or abs(s / n - v) > tol:
            s, n, k = v, 1, k + 1
        else:
            s, n = s + v, n + 1
        out.append(k)
    return out


def test_running_means_match_a_plain_loop(spark):
    rng = random.Random(5)
    values = [float(rng.randrange(0, 400)) for _ in range(120)] + [7.0] * 3
    df = spark.createDataFrame([(1, k, v, 28.0) for k, v in enumerate(values)], "page_id long, idx int, v double, tol double")
    got = sorted((r.v, r.idx, r.grp) for r in folds.running_mean_groups(df, ["page_id"], "v", "tol").collect())
    assert [x[2] for x in got] == _running(values, 28.0)


def test_first_fit_is_first_not_nearest(spark):
    df = items(spark, (1, 0, "a", 1.0, 0, 0, 10, 20), (1, 1, "b", 1.0, 20, 12, 10, 20), (1, 2, "c", 1.0, 40, 13, 10, 6))
    got = {r.item_idx: r.row_idx for r in folds.first_fit_rows(df.withColumn("tolerance", F.lit(8.0))).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_near_duplicate_lines_do_not_chain(spark):
    df = lines(spark, (1, 0, 0, 0, 100, 0, "line"), (1, 1, 0, 5, 100, 5, "line"), (1, 2, 0, 10, 100, 10, "line"))
    assert sorted(r.line_idx for r in folds.suppress_near_lines(df).collect()) == [0, 2]


def test_line_dedup_takes_the_first_of_a_cell(spark):
    df = lines(spark, (1, 0, 401, 8, 500, 8, "line"), (1, 1, 400, 7, 500, 7, "box"), (1, 2, 400, 7, 500, 7, "line"))
    assert [r.line_idx for r in ln.deduplicate(df).collect()] == [1]


def test_table_groups_and_rules(spark):
    dense = [(1, k, 0, 10 * k, 100, 10 * k, "line") for k in range(6)] + [(1, 9, 0, 500, 100, 500, "line")]
    df = lines(spark, *dense)
    assert {(r.line_idx, r.group_lines) for r in ln.table_groups(df).collect()} == {(k, 6) for k in range(6)}
    assert [r.line_idx for r in ln.without_rules(df).collect()] == [9]


def test_row_merge_pairs_use_up_rows(spark):
    rows = spark.createDataFrame([(1, k, "short", 10.0 * k) for k in range(5)], "page_id long, row_idx int, text string, mean_y double")
    assert [(r.role, r.merged_idx) for r in rw.merge_pairs(rows).orderBy("row_idx").collect()] == [("first", 0), ("second", 0), ("first", 1), ("second", 1), ("single", 2)]


def test_column_split_ties_and_fallback(spark):
    df = items(spark, (1, 0, "a", 1.0, 0, 0, 0, 9), (1, 1, "b", 1.0, 400, 0, 0, 9), (1, 2, "c", 1.0, 800, 0, 0, 9), (2, 0, "a", 1.0, 5, 0, 0, 9))
    assert {r.page_id: r.column_split for r in mp.column_split(df).collect()} == {1: 300.0, 2: 300.0}


def test_closure_equals_recursive_sql(spark):
    rng = random.Random(3)
    df = lines(spark, *[(p, k, rng.randrange(0, 300), rng.randrange(0, 300), 400, rng.randrange(0, 300), "line") for p in (1, 2) for k in range(12)])
    none = spark.createDataFrame([], "page_id long, bottom_y double")
    edges = rw.steps(df, none).cache()
    assert {tuple(r) for r in rw.closure(edges).collect()} == {tuple(r) for r in rw.reachable(spark, edges).collect()}


def test_greedy_rows_do_not_share_lines(spark):
    rows = rw.row_records(rw.gap_rows(items(spark, (1, 0, "first label", 1.0, 0, 0, 100, 20), (1, 1, "second label", 1.0, 0, 30, 100, 20))))
    df = lines(spark, (1, 0, 300, 40, 500, 40, "line"))
    assert [(r.label, r.line_idx) for r in rw.map_rows(rows, df).collect()] == [("first label", 0)]


def test_assignment_penalises_taken_lines(spark):
    i = items(spark, (1, 0, "Name:", 1.0, 0, 100, 80, 20), (1, 1, "Date:", 1.0, 0, 110, 80, 20), (1, 2, "x", 1.0, 700, 100, 10, 20))
    df = lines(spark, (1, 0, 320, 118, 560, 118, "line"))
    empty = spark.createDataFrame([], "page_id long, region_idx int, x int, y int, width int, height int, type string, confidence double")
    lay = mp.Layout(i, df, empty)
    got = mp.assignments(lay, mp.labels(i, lay.metrics)).collect()
    assert len(got) == 1 and got[0].item_idx == 0 and got[0].line_idx == 0


def test_label_predicates(spark):
    cases = {"Name": True, "3) anything": True, "Who?": True, "APPLICATION FORM": False, "lonely": False, "two words": True}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", t.mappable_label(F.col("s"), F.lit(10.0), F.lit(1000.0)).alias("ok"))
    assert {r.s: r.ok for r in df.collect()} == cases


def test_glue_and_names(spark):
    df = spark.createDataFrame([(["Date", ":", "of", "(", "birth", ")"],)], "w array<string>")
    assert df.select(t.glue(F.col("w"))).first()[0] == "Date:of (birth)"
    names = spark.createDataFrame([("  A b/c ", 1), ("", 2), (None, 3)], "l string, i int").select(t.field_name(F.col("l"), F.col("i"))).collect()
    assert [r[0] for r in names] == ["A_b_c_1", "field_2", "field_3"]


def test_unmatched_collapses_and_unresolved_keeps(spark):
    i = items(spark, (1, 0, "a", 1.0, 0, 0, 1, 1), (1, 1, "a", 1.0, 0, 9, 1, 1), (1, 2, "b", 1.0, 0, 20, 1, 1))
    m = spark.createDataFrame([(1, "b"), (1, None)], "page_id long, label string")
    assert [tuple(r) for r in ev.unmatched_labels(i, m).collect()] == [(1, "a")]
    assert sorted(r.item_idx for r in ev.unresolved_labels(i, m).collect()) == [0, 1]


def test_similarity_and_absolute_urls(spark):
    df = spark.createDataFrame([("Name", "name"), (None, "x"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(ev.text_similarity("a", "b")).collect()] == [1.0, 0.0, 1.0]
    urls = spark.createDataFrame([("/x",), ("http://a/b",), ("y",), ("",), (None,)], "u string").select(ex.absolute_url(F.col("u"), "http://h/")).collect()
    assert [r[0] for r in urls] == ["http://h/x", "http://a/b", "http://h/y", None, None]


@pytest.mark.parametrize("operator", [ocr.drop_noise, ocr.merge_tokens, ocr.quality_summary, rw.gap_rows, mp.column_split])
def test_empty_items_and_extra_columns(spark, operator):
    assert operator(items(spark)).count() == 0
    row = (1, 0, "Some text", 0.9, 0, 0, 50, 20)
    assert operator(items(spark, row, extra=True)).count() == operator(items(spark, row)).count()


def test_empty_lines_and_regions(spark):
    no_lines, no_items = lines(spark), items(spark)
    regions = spark.createDataFrame([], "page_id long, region_idx int, x int, y int, width int, height int, ink double, rectangularity double")
    assert ln.field_lines(no_lines, no_items, regions).count() == 0
    assert rg.nearest_label(regions, no_items).count() == 0
    assert folds.suppress_near_lines(no_lines).count() == 0


def test_pages_are_independent_and_order_free(spark):
    rows = [(p, k, f"w{k}", 0.9, 30 * (k % 4), 13 * k, 25, 12) for p in (1, 2) for k in range(20)]
    both = {tuple(r) for r in ocr.merge_tokens(items(spark, *rows)).collect()}
    one = {tuple(r) for p in (1, 2) for r in ocr.merge_tokens(items(spark, *[r for r in reversed(rows) if r[0] == p])).collect()}
    assert both == one


@pytest.fixture
def region_below(spark, monkeypatch):
    """A page whose items and lines end at 800 and whose region ends at 1000: the top band is 300 high, not 240."""
    from quillgrid.plans import pages

    i = items(spark, (1, 0, "lonely", 1.0, 0, 240, 80, 20), (1, 1, "Name:", 1.0, 0, 500, 80, 20), (1, 2, "far right", 1.0, 700, 780, 80, 20))
    df = lines(spark, (1, 0, 0, 280, 200, 280, "line"), (1, 1, 0, 540, 200, 540, "line"))
    r = spark.createDataFrame([(1, 0, 20, 950, 60, 50, 0.1, 0.9)], "page_id long, region_idx int, x int, y int, width int, height int, ink double, rectangularity double")
    m = spark.createDataFrame([(1, "Name:"), (1, "far right")], "page_id long, label string")
    for name, table in {"items": i, "lines": df, "regions": r, "mappings": m}.items():
        monkeypatch.setattr(pages.tables, name, lambda spark, sf_dir, table=table: table)
    return pages.queries()


def test_label_filter_counts_regions_into_the_page_height(spark, region_below):
    assert [r.item_idx for r in region_below["label_keyword_filter"](spark, "").collect()] == [1]


def test_top_band_counts_regions_into_the_page_height(spark, region_below):
    assert [tuple(r) for r in region_below["top_band_unresolved_semi"](spark, "").select("item_idx", "text").collect()] == [(0, "lonely")]
    assert [r.labels for r in region_below["flagship_label_field_match"](spark, "").collect()] == [2]


def test_ranks_and_classes_stay_inside_the_candidate_pool(spark, monkeypatch):
    from quillgrid.plans import pages

    scores = spark.createDataFrame([(1, 0, 0, 0.90, 5.0, 5.0, False), (1, 0, 1, 0.88, 6.0, 5.0, False)], "page_id long, item_idx int, line_idx int, candidate_score double, b_cy double, b_cx double, rejected boolean")
    pool = spark.createDataFrame([(1, 0, 1)], "page_id long, item_idx int, line_idx int")
    monkeypatch.setattr(pages._Pages, "layout", None)
    monkeypatch.setattr(pages, "_label_rows", lambda p, lay: scores.select("page_id", "item_idx").distinct())
    monkeypatch.setattr(pages.mp, "candidate_scores", lambda lay, found, pool: scores.join(pool, ["page_id", "item_idx", "line_idx"]))
    monkeypatch.setattr(pages.mp, "candidate_pool", lambda lay, found: pool)
    assert [tuple(r) for r in pages.queries()["candidate_top5"](spark, "").collect()] == [(1, 0, 1, 1, 0.88)]
    assert [(r.line_idx, r.confidence_class) for r in pages.queries()["candidate_class"](spark, "").collect()] == [(1, "strong_match")]


def test_process_gives_every_artifact(spark, tmp_path):
    from quillgrid.plans.process import process, write_artifacts

    i = items(spark, (1, 0, "Name:", 1.0, 0, 100, 80, 20), (1, 1, "Date:", 1.0, 0, 140, 80, 20), (1, 2, "x", 1.0, 900, 100, 10, 20))
    df = lines(spark, (1, 0, 320, 118, 560, 118, "line"), (1, 1, 320, 158, 560, 158, "line"))
    contours = spark.createDataFrame([(1, 0, 300, 300, 200, 40, 0.1, 0.9, 4, 0, 0)], "page_id long, region_idx int, x int, y int, width int, height int, ink double, rectangularity double, vertices int, h_rules int, v_rules int")
    sizes = spark.createDataFrame([(1, 1000.0, 1400.0)], "page_id long, image_width double, image_height double")
    done = process(i, df, contours, sizes, "ml")
    assert {(r.label, r.sx) for r in done.mappings.join(done.field_lines, ["page_id", "line_idx"]).collect()} == {("Name:", 320), ("Date:", 320)}
    assert done.diagnostics.first().labels_processed == 3 and done.mappings.first().mode == "ml"
    written = write_artifacts(done, str(tmp_path / "run"))
    assert set(written) == set(done.artifacts()) and spark.read.json(written["mappings"]).count() == 2
    assert process(i.limit(0), df, contours, sizes).mappings.count() == 0
    with pytest.raises(ValueError):
        process(i, df, contours, sizes, "other")
