"""The row mapper: text rows by gaps, rows merged, rows matched to lines."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.config import DEFAULT, NOISE_WORDS, Config
from quillgrid.functions import text as t
from quillgrid.operators.folds import suppress_near_lines
from quillgrid.operators.lines import without_rules


def gap_rows(items: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Adds row_idx: a new row begins where the centre height steps by the gap or more from the item before."""
    w = Window.partitionBy("page_id").orderBy("cy", "item_idx")
    start = F.when(F.abs(F.col("cy") - F.lag("cy").over(w)) < c.row_gap, 0).otherwise(1)
    return items.withColumn("_s", start).withColumn("row_idx", F.sum("_s").over(w) - 1).drop("_s")


def row_records(rows: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """One row per text row: text, item_count, mean_y and geometry (bottom_y, top_y and center_y of the items' bottoms, right_x capped)."""
    parts = F.array_sort(F.collect_list(F.struct("cy", "item_idx", "text")))
    r = rows.groupBy("page_id", "row_idx").agg(t.strip(F.array_join(F.transform(parts, lambda p: p["text"]), " ")).alias("text"), F.count("*").alias("item_count"), (F.sum("cy") / F.count("*")).alias("mean_y"), F.max("y2").alias("bottom_y"), F.min("y2").alias("top_y"), F.max("x2").alias("raw_right_x"), F.min("x1").alias("left_x"))
    return r.withColumns({"center_y": (F.col("top_y") + F.col("bottom_y")) / 2, "right_x": F.least("raw_right_x", F.lit(c.column_cap))})


def merge_pairs(rows: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Adds merged_idx and role: a row is merged with the next if that is near and carries it on; both are then used up.

    Rows of an island of mergeable neighbours pair off from its first row.
    """
    w = Window.partitionBy("page_id").orderBy("row_idx")
    flag = F.coalesce((F.abs(F.lead("mean_y").over(w) - F.col("mean_y")) < c.merge_gap) & t.continues(F.lead("text").over(w)), F.lit(False))
    r = rows.withColumn("_flag", flag).withColumn("_before", F.coalesce(F.lag("_flag").over(w), F.lit(False)))
    r = r.withColumn("_island", F.sum(F.when(F.col("_flag") & ~F.col("_before"), 1).otherwise(0)).over(w))
    place = F.row_number().over(Window.partitionBy("page_id", "_island", "_flag").orderBy("row_idx"))
    r = r.withColumn("_head", F.col("_flag") & (place % 2 == 1))
    r = r.withColumn("_tail", F.coalesce(F.lag("_head").over(w), F.lit(False)))
    role = F.when(F.col("_head"), "first").when(F.col("_tail"), "second").otherwise("single")
    return r.withColumn("role", role).withColumn("merged_idx", F.sum(F.when(F.col("_tail"), 0).otherwise(1)).over(w) - 1).drop("_flag", "_before", "_island", "_head", "_tail")


def is_noise(text: Column) -> Column:
    hit = F.lit(False)
    for w in NOISE_WORDS:
        hit = hit | F.lower(text).contains(w)
    return hit


def nearest_lines(rows: DataFrame, lines: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """The nearest line of each row, assignment aside: in the window below its bottom and right of it; ties go to the wider, then the first."""
    r = rows.select("page_id", "row_idx", "text", "bottom_y", "right_x")
    j = r.join(lines.select("page_id", "line_idx", "cy", "x1", "x2"), "page_id").filter(F.col("cy").between(F.col("bottom_y") - c.above, F.col("bottom_y") + c.below) & (F.col("x1") >= F.col("right_x") - 40))
    w = Window.partitionBy("page_id", "row_idx").orderBy(F.abs(F.col("cy") - F.col("bottom_y")), F.desc(F.col("x2") - F.col("x1")), "line_idx")
    return j.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("page_id", "row_idx", "text", "line_idx", F.abs(F.col("cy") - F.col("bottom_y")).alias("vertical_distance"))


def clean_lines(lines: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Without strokes found twice and table rules."""
    return without_rules(suppress_near_lines(lines), c)


def steps(lines: DataFrame, rows: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Edges from a line to those below it in the same column, with no row's bottom between: page_id, a, b."""
    a = lines.select("page_id", F.col("line_idx").alias("a"), F.col("cx").alias("_ax"), F.col("cy").alias("_ay"))
    b = lines.select("page_id", F.col("line_idx").alias("b"), F.col("cx").alias("_bx"), F.col("cy").alias("_by"))
    e = a.join(b, "page_id").filter((F.abs(F.col("_bx") - F.col("_ax")) < 120) & (F.col("_by") > F.col("_ay")) & (F.col("_by") - F.col("_ay") < c.below))
    bottoms = rows.select(F.col("page_id").alias("_p"), "bottom_y")
    return e.join(bottoms, (F.col("page_id") == F.col("_p")) & (F.col("bottom_y") > F.col("_ay")) & (F.col("bottom_y") < F.col("_by")), "left_anti").select("page_id", "a", "b")


def reachable(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """All pairs (a, b) that a chain of steps joins; steps go down, so there are no cycles and chains are as long as a page is high."""
    edges.createOrReplaceTempView("quillgrid_steps")
    return spark.sql(
        """with recursive reach(page_id, a, b) max recursion level 1000 as (
             select page_id, a, b from quillgrid_steps
             union all
             select r.page_id, r.a, s.b from reach r join quillgrid_steps s on r.page_id = s.page_id and r.b = s.a)
           select distinct page_id, a, b from reach"""
    )


def _closure_page(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
    below: dict[int, set[int]] = {}
    for a, b in zip(edges["a"], edges["b"]):
        below.setdefault(a, set()).add(b)
    done: dict[int, set[int]] = {}
    for a in below:
        seen, todo = set(), list(below[a])
        while todo:
            x = todo.pop()
            if x in seen:
                continue
            seen.add(x)
            todo += below.get(x, ())
        done[a] = seen
    return pd.DataFrame([(key[0], a, b) for a, found in done.items() for b in sorted(found)], columns=["page_id", "a", "b"])


def closure(edges: DataFrame) -> DataFrame:
    """reachable() page by page, for any number of pages and paths: page_id, a, b."""
    return edges.groupBy("page_id").applyInPandas(_closure_page, "page_id long, a int, b int")


_MAPPED = pa.schema([("page_id", pa.int64()), ("row_idx", pa.int64()), ("label", pa.string()), ("line_idx", pa.int32()), ("group_lines", pa.string()), ("group_size", pa.int32()), ("vertical_distance", pa.float64())])


def _below(start: int, lines: list[tuple], bottoms: list[float], reach: float) -> set[int]:
    """The places of all lines that steps reach from one line; `lines` (index, cx, cy, ...) go down, `bottoms` too."""
    heights = [x[2] for x in lines]
    seen: set[int] = set()
    todo = [start]
    while todo:
        _, cx, cy, *_ = lines[todo.pop()]
        at = bisect_right(bottoms, cy)  # a step goes no further than the next row's bottom
        end = min(cy + reach, bottoms[at] if at < len(bottoms) else math.inf)
        for k in range(bisect_right(heights, cy), len(lines)):
            if lines[k][2] > end or lines[k][2] >= cy + reach:
                break
            if k not in seen and abs(lines[k][1] - cx) < 120:
                seen.add(k)
                todo.append(k)
    return seen


def _map_page(rows: list[dict], lines: list[dict], c: Config) -> list[tuple]:
    """Greedy assignment of one page's rows; a row's lines go with all that steps reach from the chosen one."""
    down = sorted((tuple(x.values()) for x in lines), key=lambda x: (x[2], x[0]))
    heights = [x[2] for x in down]
    bottoms = sorted(r["bottom_y"] for r in rows)
    taken: set[int] = set()
    out = []
    for r in sorted(rows, key=lambda r: r["row_idx"]):
        bottom = r["bottom_y"]
        best = None
        for k in range(bisect_left(heights, bottom - c.above), bisect_right(heights, bottom + c.below)):
            line_idx, _, cy, x1, x2 = down[k]
            if line_idx not in taken and x1 >= r["right_x"] - 40:
                best = min(best or (math.inf,), (abs(cy - bottom), x1 - x2, line_idx, k))
        if best is None:
            continue
        group = [best[2], *(down[k][0] for k in _below(best[3], down, bottoms, c.below))]
        taken.update(group)
        out.append((r["row_idx"], r["text"], best[2], ",".join(map(str, sorted(group))), len(group), best[0]))
    return out


def _map_pages(c: Config):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, rows, lines in zip(*(x.to_pylist() for x in batch.columns)):
                out += [(page, *r) for r in _map_page(rows, lines, c)]
            columns = list(zip(*out)) if out else [[]] * len(_MAPPED)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, _MAPPED)], schema=_MAPPED)

    return run


def map_rows(rows: DataFrame, lines: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Rows in order take the nearest line that no earlier row took, with all lines that steps reach from it.

    A page's rows and lines come together once; steps are followed from the
    chosen lines only. Pages without rows or without lines give nothing.
    """
    valid = rows.filter(~is_noise(F.col("text"))).groupBy("page_id").agg(F.collect_list(F.struct("row_idx", "text", "bottom_y", "right_x")).alias("rows"))
    clean = clean_lines(lines, c).groupBy("page_id").agg(F.collect_list(F.struct("line_idx", "cx", "cy", "x1", "x2")).alias("lines"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt by a hash: the plain key would be merged with the join's shuffle and coalesced by its few bytes
    pages = valid.join(clean, "page_id").select("page_id", "rows", "lines").repartition(tasks, F.xxhash64("page_id"))
    return pages.mapInArrow(_map_pages(c), "page_id long, row_idx long, label string, line_idx int, group_lines string, group_size int, vertical_distance double")


def useful_rows(rows: DataFrame) -> DataFrame:
    """Rows with any text that isn't blank."""
    return rows.filter(F.col("text").rlike(r"\S"))


def is_table_row(line_count: Column, threshold: int = 10) -> Column:
    """Whether so many lines in a row make a table row."""
    return line_count >= threshold
