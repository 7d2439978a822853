"""JSON artifacts of single runs, of the current and the older schema; image sources plug in as functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "text string, bbox array<array<double>>, center array<double>, confidence double, source_item_count int"
MAPPING = "label string, label_pos array<double>, field_line struct<start:array<int>,end:array<int>>, field_lines array<struct<start:array<int>,end:array<int>,field_type:string>>, field_type string, state string, distance double, column_split double, candidate_score double, confidence double, local_score double, global_structure_score double, column_consistency double, ownership_confidence double, final_confidence double, confidence_class string, reasons array<string>, region_support string, candidate_count int, ambiguity_notes array<string>, multiline_group_size int"
MANIFEST = "name string, description string, baseline_sample_id string, samples array<struct<id:string,artifact_dir:string,source_image:string,notes:string>>"

# What uploads may be.
EXTENSIONS = ("png", "jpg", "jpeg", "pdf")
MODES = ("rule", "ml")
MAX_BYTES = 20 * 1024 * 1024
# Names of default inputs, images before documents.
DEFAULT_INPUTS = ("form.png", "image.png", "image_2.png", "imange.png", "form.pdf", "image_2.pdf")


def json_array(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """Objects of JSON arrays, one array a file; other elements are dropped. A file that holds no array gives no rows, or raises if strict."""
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("a"), F.rlike("value", F.lit(r"^\s*\[")).alias("is_array"))
    if strict:
        wrong = F.raise_error(F.lit("a file does not hold a JSON array")).cast("array<string>")
        files = files.withColumn("a", F.when(F.col("is_array") & F.col("a").isNotNull(), F.col("a")).otherwise(wrong))
    each = files.filter("is_array").select(F.explode("a").alias("e")) if not strict else files.select(F.explode("a").alias("e"))
    return each.filter(F.col("e").startswith("{")).select(F.from_json("e", schema).alias("r")).filter("r is not null").select("r.*")


def upgraded_mappings(df: DataFrame) -> DataFrame:
    """Older mappings in the current schema: the single field_line as a list, group size 1."""
    old = F.when(F.col("field_line").isNotNull(), F.array(F.struct(F.col("field_line.start").alias("start"), F.col("field_line.end").alias("end"), F.lit("line").alias("field_type"))))
    return df.withColumn("field_lines", F.coalesce("field_lines", old)).withColumn("multiline_group_size", F.coalesce("multiline_group_size", F.lit(1))).drop("field_line")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a corpus manifest that have an id and a folder: corpus, baseline_sample_id, sample_idx, id, artifact_dir, source_image, notes."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    each = m.select(F.col("name").alias("corpus"), "baseline_sample_id", F.posexplode("samples").alias("sample_idx", "s")).select("corpus", "baseline_sample_id", "sample_idx", "s.*")
    return each.filter("id <> '' and artifact_dir <> ''")


def accepted(path: Column, length: Column, mode: Column) -> Column:
    """Whether an upload may be processed: known extension, not empty, not too large, known mode."""
    return F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1)).isin(*EXTENSIONS) & length.between(1, MAX_BYTES) & mode.isin(*MODES)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder that pass the checks of an upload: path, length, content."""
    return spark.read.format("binaryFile").load(path).filter(accepted(F.col("path"), F.col("length"), F.lit("rule"))).select("path", "length", "content")


def first_input(names: Iterable[str]) -> str | None:
    """The first default input that is there."""
    there = set(names)
    return next((n for n in DEFAULT_INPUTS if n in there), None)


def first_existing(spark: SparkSession, *paths: str | None) -> str | None:
    """The first of the paths that is there."""
    for path in paths:
        if path:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
                return path
    return None


def source_image(spark: SparkSession, folder: str, explicit: str | None = None) -> str:
    """A run's picture: the given one if it is there, else the first converted page by name, else the preview; raises if there is none."""
    found = first_existing(spark, explicit)
    if not found:
        jvm = spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        converted = sorted(s.getPath().toString() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/converted_*.png")) or ())
        found = converted[0] if converted else first_existing(spark, f"{folder}/mapping.png")
    if not found:
        raise FileNotFoundError(f"no picture in {folder}")
    return found


def first_pages(files: DataFrame, converter: Callable[[bytes], bytes]) -> DataFrame:
    """path, length, content, with the first page's picture (from the converter) in place of each PDF; what can't be converted gives no row."""
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    picture = converter(content)
                except Exception:  # a damaged document is left out
                    continue
                if picture:
                    rows.append((path, len(picture), picture))
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    is_pdf = F.lower("path").endswith(".pdf")
    made = files.filter(is_pdf).select("path", "content").mapInArrow(run, "path string, length long, content binary")
    return files.filter(~is_pdf).select("path", "length", "content").unionByName(made)


def recognise(files: DataFrame, engine: Callable[[bytes], list[tuple[list[list[float]], str, float | None]]] | None = None, load: Callable[[], Callable] | None = None) -> DataFrame:
    """Runs a text recogniser (polygon, text, confidence per item) over binary files: path, item_idx, text, bbox, confidence.

    Give the engine itself, or `load`, which makes it where it runs, once a task.
    Malformed items and files without text give no rows.
    """
    schema = pa.schema([("path", pa.string()), ("item_idx", pa.int32()), ("text", pa.string()), ("bbox", pa.list_(pa.list_(pa.float64()))), ("confidence", pa.float64())])

    def run(batches):
        read = engine or load()
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for k, (polygon, text, confidence) in enumerate(read(content) or ()):
                    if text and text.strip() and len(polygon) == 4:
                        rows.append((path, k, text.strip(), [[float(x), float(y)] for x, y in polygon], confidence))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, item_idx int, text string, bbox array<array<double>>, confidence double")
