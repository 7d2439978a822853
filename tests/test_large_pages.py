"""What depends on the size of tables or on how Spark cuts them up."""

from quillgrid import session
from quillgrid.operators import mapping as mp
from quillgrid.operators import regions as rg
from quillgrid.plans import pages, registry


def test_pages_are_dealt_after_the_joins(spark, sf_dir):
    """Skew joins may part a page, so the assignment needs a shuffle of its own behind them, and one that Spark can't drop."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins as large tables have them
    try:
        plan = registry.queries()["assigned_mappings"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "REPARTITION_BY_NUM" in plan


def test_large_stored_relations_are_merged(spark, sf_dir, monkeypatch):
    """A stored relation of the layout that is past the size isn't broadcast, whatever few columns a join takes of it."""
    plan = lambda lay: lay.lines.join(lay.items.select("page_id", "item_idx"), "page_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(pages._Pages(spark, sf_dir).layout.prepare(1))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    assert "SortMergeJoin" in plan(pages._Pages(spark, sf_dir).layout.prepare(1))


def _joins(spark, sf_dir, name: str) -> int:
    """In the plan that is left once the stored relations are there."""
    return registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_pairs_are_carried_through_no_join(spark, sf_dir):
    """What a label or a line has alone is joined and stored before the two are paired."""
    assert _joins(spark, sf_dir, "pair_features") == 1
    assert _joins(spark, sf_dir, "candidate_scores") == 1


def test_edges_are_stored_kind_by_kind(spark, sf_dir):
    """Two joins are left, of zones with their columns."""
    assert _joins(spark, sf_dir, "graph_membership_edges") == 2


def _stored(spark, build) -> int:
    """Tables that are stored meanwhile."""
    session.shared_dir(spark)
    before = len(session._written)
    build()
    return len(session._written) - before


def test_ownership_stores_few_relations(spark, sf_dir):
    """Each is some stages, whose broadcasts fill the driver: items, lines, metrics, band members, bands, zones and the result."""
    assert _stored(spark, lambda: registry.queries()["ownership_best_zone"](spark, sf_dir)) == 7


def test_metrics_from_boxes_alone(spark, sf_dir):
    """Regions count on pages with items or lines only, whether they are classified or not; so does ownership either way."""
    p = pages._Pages(spark, sf_dir)
    some = lambda df: df.filter("page_id % 3 = 0")
    whole = mp.Layout(some(p.items), some(p.lines), p.layout._source[2])
    alone = mp.Layout(some(p.items), some(p.lines), p.layout._source[2], lambda: rg.boxes(p.contours))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(alone.metrics) == rows(whole.metrics) and "regions" not in alone.__dict__
    assert rows(alone.owned_alone()) == rows(whole.owned)
