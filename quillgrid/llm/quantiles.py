"""Percentiles of very large numeric columns by cumulative frequencies.

Values are reduced to counts per group and grid value (a summary that can be
stored by day or partition and added up), range-sorted, summed up with window
running sums inside each range, shifted by the sums of the ranges before, and
the first value that reaches a target rank is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.session import store


def grid_value(value: Column, rel_error: float) -> Column:
    """The value's representative: at most rel_error away, relative to it. 0 stays 0; rel_error 0 keeps values."""
    if rel_error <= 0:
        return value
    step = math.log1p(rel_error) * 2
    size = F.exp((F.floor(F.log(F.abs(value)) / step) + F.lit(0.5)) * step)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * size)


def value_counts(rows: DataFrame, groups: list[str], value_col: str, rel_error: float = 0.001) -> DataFrame:
    """The mergeable summary: groups, value (on the grid), n.

    Null, NaN and infinite values don't count. Groups may be null. The number
    of rows per group is bounded by the grid, however many values there are.
    """
    value = F.col(value_col).cast("double")
    kept = rows.filter(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    return kept.groupBy(*groups, (grid_value(value, rel_error) + F.lit(0.0)).alias("value")).agg(F.count("*").alias("n"))


def merge_counts(*summaries: DataFrame) -> DataFrame:
    """Adds up summaries of separate days or partitions."""
    out = summaries[0]
    for s in summaries[1:]:
        out = out.unionByName(s)
    return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, groups: list[str], pcts: list[int], ranges: int = 0) -> DataFrame:
    """groups, pct, value, n_values: the value of rank ceil(pct / 100 * n) of each group.

    `counts` is a summary. Ties share a value, so they can't be split. A group
    may reach over any number of ranges; an empty summary gives no rows. Null
    groups are groups of their own.
    """
    spark = counts.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_g{k}" for k in range(len(groups))]
    # stored first: the range sort draws its bounds from a run of its own
    keyed = store(counts.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], "value", "n"), "counts")
    # the range of each row is stored with it: bounds are sampled, so they must not be drawn twice
    ranged = store(keyed.repartitionByRange(ranges, *keys, "value").withColumn("range", F.spark_partition_id()), "ranges")
    per_range = ranged.groupBy(*keys, "range").agg(F.sum("n").alias("in_range"))
    by_group = Window.partitionBy(*keys)
    before = by_group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(*keys, "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("offset"), F.sum("in_range").over(by_group).alias("total"))
    inside = Window.partitionBy(*keys, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("inside", F.sum("n").over(inside))
    same = [running[k].eqNullSafe(offsets[k]) for k in [*keys, "range"]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    ranked = running.join(offsets, condition).select(*[running[k] for k in keys], "value", "n", "total", (F.col("inside") + F.col("offset")).alias("rank"))
    targets = F.explode(F.array(*[F.lit(int(p)) for p in pcts])).alias("pct")
    target = F.greatest(F.lit(1), F.floor((F.col("pct") * F.col("total") + 99) / 100))
    reached = ranked.select("*", targets).filter((F.col("rank") >= target) & (F.col("rank") - F.col("n") < target))
    return reached.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], "pct", "value", F.col("total").alias("n_values"))


def latest(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key, that of the latest loaded_at; null keys are dropped. Equal re-deliveries collapse before the shuffle."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("loaded_at", *columns)).alias("r")).select(key, *[f"r.{c}" for c in columns])
