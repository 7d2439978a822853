"""Queries of the operators on stored files: consolidation and schema drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators.schemadrift import changes, consistent_table, top_level_changes
from quillgrid.operators.smallfiles import consolidate
from quillgrid.session import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate(read(spark, sf_dir, "artifact_files")).table.select("run_id", "artifact", "item_idx")


def p1_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate(read(spark, sf_dir, "artifact_files")).table.select("run_id", "artifact", "item_idx", "name", "body", "file_id")


def p5_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(read(spark, sf_dir, "result_exports")).drop("nested_before", "nested_after")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_level_changes(changes(read(spark, sf_dir, "result_exports"))).select("export_id", "field_before", "field_after", "change")


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_table(read(spark, sf_dir, "result_exports")).select("export_id", "feed_id", "row_no", F.to_json("fields").alias("fields"), "confidence")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_store, p5_found, p5_changes, p5_table)}


def oracle_sql() -> dict[str, str]:
    return {}
