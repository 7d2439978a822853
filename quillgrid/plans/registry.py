"""All queries of the core by name, with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgrid.plans import corpus, pages

_PARTS = (pages, corpus)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_label_field_match"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracle_sql().items()}
