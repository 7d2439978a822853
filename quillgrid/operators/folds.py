"""Order-dependent scans over the rows of a page, as higher-order folds inside the JVM.

A page's rows are sorted into one array and folded once. State is a few
numbers (running means) or the open rows of the page, so a fold suits pages of
up to some thousands of rows; pages are what is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_mean_groups(rows: DataFrame, keys: list[str], value: str, tolerance: str, out: str = "grp") -> DataFrame:
    """Clusters along an axis: a row joins the last group while it is within the tolerance of the group's mean.

    Rows go by `value`; `tolerance` is a column that is constant per key. Adds
    `out` (from 0) and `<out>_mean`, the group's final mean. Rows with a null
    value are left out. Equal values always share a group, so the fold runs
    over distinct values with their counts: its array grows with a page's
    extent, not with its rows.
    """
    kept = rows.filter(F.col(value).isNotNull())
    distinct = kept.groupBy(*keys, value).agg(F.max(tolerance).alias("_tol"), F.count("*").alias("_n"))
    packed = distinct.groupBy(*keys).agg(F.max("_tol").alias("_tol"), F.array_sort(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), F.col("_n").cast("int").alias("n")))).alias("_all"))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(-1).alias("g"), F.expr("array()").cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fresh = (a["n"] == 0) | (F.abs(a["s"] / a["n"] - x["v"]) > F.col("_tol"))
        g = F.when(fresh, a["g"] + 1).otherwise(a["g"])
        more = x["v"] * x["n"]
        return F.struct(F.when(fresh, more).otherwise(a["s"] + more).alias("s"), F.when(fresh, x["n"]).otherwise(a["n"] + x["n"]).alias("n"), g.alias("g"), F.concat(a["out"], F.array(g)).alias("out"))

    flat = packed.withColumn("_g", F.aggregate("_all", start, step)["out"]).select(*keys, F.explode(F.arrays_zip("_all", "_g")).alias("_z"))
    w = Window.partitionBy(*keys, out)
    groups = flat.select(*keys, F.col("_z._all.v").alias(value), F.col("_z._all.n").alias("_n"), F.col("_z._g").alias(out)).withColumn(f"{out}_mean", F.sum(F.col(value) * F.col("_n")).over(w) / F.sum("_n").over(w)).drop("_n")
    return kept.withColumn(value, F.col(value).cast("double")).join(groups, [*keys, value])


def first_fit_rows(items: DataFrame, tolerance: str = "tolerance") -> DataFrame:
    """Text rows: by top and left edge, an item joins the first open row whose mean centre is near enough, else opens one.

    Needs page_id, item_idx, y1, x1, y2 and the tolerance; adds row_idx in
    order of creation. Rows of equal position go by item_idx.
    """
    rest = [c for c in items.columns if c not in ("page_id", tolerance)]
    packed = items.groupBy("page_id").agg(F.max(tolerance).alias(tolerance), F.array_sort(F.collect_list(F.struct("y1", "x1", "item_idx", ((F.col("y1") + F.col("y2")) / 2).alias("_cy"), F.struct(*rest).alias("_rest")))).alias("_all"))
    rows_type = "array<struct<s:double,n:int>>"
    start = F.struct(F.expr("array()").cast(rows_type).alias("rows"), F.expr("array()").cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        near = F.transform(a["rows"], lambda r: F.abs(x["_cy"] - r["s"] / r["n"]) <= F.col(tolerance))
        at = F.array_position(near, True).cast("int")
        one = lambda s, n: F.struct(s.alias("s"), n.cast("int").alias("n"))
        joined = F.transform(a["rows"], lambda r, i: F.when(i + 1 == at, one(r["s"] + x["_cy"], r["n"] + 1)).otherwise(one(r["s"], r["n"])))
        opened = F.concat(a["rows"], F.array(one(x["_cy"], F.lit(1))))
        return F.struct(F.when(at > 0, joined).otherwise(opened).cast(rows_type).alias("rows"), F.concat(a["out"], F.array(F.when(at > 0, at - 1).otherwise(F.size(a["rows"])))).alias("out"))

    folded = packed.withColumn("_r", F.aggregate("_all", start, step)["out"])
    return folded.select("page_id", tolerance, F.explode(F.arrays_zip("_all", "_r")).alias("_z")).select("page_id", tolerance, F.col("_z._r").alias("row_idx"), *[F.col(f"_z._all._rest.{c}").alias(c) for c in rest])


def suppress_near_lines(lines: DataFrame, y_tol: float = 6.0, x_tol: float = 20.0) -> DataFrame:
    """Of strokes found twice only the topmost: a kept line suppresses later ones near in height, left edge and width.

    Suppressed lines suppress nothing. Lines go by centre height, then line_idx.
    """
    rest = [c for c in lines.columns if c != "page_id"]
    packed = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("cy", "line_idx", "x1", (F.col("x2") - F.col("x1")).alias("w"), F.struct(*rest).alias("_rest")))).alias("_all"))
    kind = packed.schema["_all"].dataType.simpleString()

    def step(kept: Column, x: Column) -> Column:
        hit = F.exists(kept, lambda k: (F.abs(x["cy"] - k["cy"]) <= y_tol) & (F.abs(x["x1"] - k["x1"]) < x_tol) & (F.abs(x["w"] - k["w"]) < x_tol))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(x)))

    return packed.select("page_id", F.explode(F.aggregate("_all", F.expr("array()").cast(kind), step)).alias("_k")).select("page_id", *[F.col(f"_k._rest.{c}").alias(c) for c in rest])
