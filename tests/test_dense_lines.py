"""Queries on pages whose lines stand as close as table rows, which the test tables lack."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgrid.plans import registry
from tests.compare import check


@pytest.fixture(scope="module")
def dense(spark, sf_dir, tmp_path_factory):
    """The smallest tables with the lines of every page ten pixels apart."""
    out = tmp_path_factory.mktemp("dense")
    for f in os.listdir(sf_dir):
        if f != "field_lines.parquet":
            os.symlink(f"{sf_dir}/{f}", out / f)
    low = 150 + F.col("line_idx") * 10
    lines = spark.read.parquet(f"{sf_dir}/field_lines.parquet")
    lines.withColumn("ey", F.when(F.col("ey").isNotNull(), low)).withColumn("sy", F.when(F.col("sy").isNotNull(), low)).coalesce(1).write.parquet(str(out / "lines"))
    part = next(f for f in os.listdir(out / "lines") if f.endswith(".parquet"))
    os.symlink(out / "lines" / part, out / "field_lines.parquet")
    con = duckdb.connect()
    for f in os.listdir(out):
        if f.endswith(".parquet"):
            con.execute(f"create view {f.split('.')[0]} as select * from '{out}/{f}'")
    return str(out), con


@pytest.mark.parametrize("name", ["table_line_groups", "candidate_scores", "candidate_reasons", "row_assignments"])
def test_dense_lines_make_tables(spark, dense, name):
    folder, con = dense
    check(spark, con, registry.queries()[name], registry.oracle_sql()[name], folder)
    if name == "table_line_groups":
        assert registry.queries()[name](spark, folder).count() > 0
    if name == "candidate_reasons":
        assert registry.queries()[name](spark, folder).filter("rejection_reasons like '%inside_table_region%'").count() > 0
