"""Consolidating very many tiny files: Hilbert-curve clustering into few well-sized ones.

Records are read whole from every stored layout, the newest version of each is
kept, and a Hilbert code over the quantiles of time, run and text places
similar records side by side. Running sums over the exact histogram of the
codes cut the curve into files of equal size; what was written is compared with
its source by row digests.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.session import note, shared_dir, store

_decode = json.JSONDecoder().raw_decode


def complete_records(payload: str | None) -> Iterator[dict]:
    """Every object with an item_idx that is whole in the payload, whatever stands around it.

    Arrays, lines, single objects, wrappers, byte-order marks, white space and
    cut-off ends are all read; an object that is cut off gives nothing, but
    whole ones inside a cut-off wrapper or after a damaged place count.
    """
    at = payload.find("{") if payload else -1
    while at >= 0:
        try:
            value, end = _decode(payload, at)
        except (ValueError, RecursionError):
            at = payload.find("{", at + 1)
            continue
        yield from _with_index(value)
        at = payload.find("{", end)


def _with_index(value) -> Iterator[dict]:
    if isinstance(value, dict):
        if "item_idx" in value:
            yield value
        else:
            for x in value.values():
                yield from _with_index(x)
    elif isinstance(value, list):
        for x in value:
            yield from _with_index(x)


_RECORDS = pa.schema([("run_id", pa.string()), ("artifact", pa.string()), ("item_idx", pa.int32()), ("name", pa.string()), ("body", pa.string()), ("written_at", pa.timestamp("us")), ("file_id", pa.int64())])


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs, artifacts, times, files = (batch.column(k) for k in ("run_id", "artifact", "written_at", "file_id"))
        source: list[int] = []
        index: list[int] = []
        name: list[str | None] = []
        body: list[str] = []
        for k, payload in enumerate(batch.column("payload").to_pylist()):
            for record in complete_records(payload):
                i = record["item_idx"]
                if isinstance(i, bool) or not isinstance(i, (int, float)) or i != i or i != int(i) or not -(2**31) <= i < 2**31:
                    continue
                said = record.get("text", record.get("label"))
                source.append(k)
                index.append(int(i))
                name.append(said if isinstance(said, str) else None)
                body.append(json.dumps(record, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode("utf-8", "replace").decode())
        take = pa.array(source, pa.int64())
        name = [None if x is None else x.encode("utf-8", "replace").decode() for x in name]
        yield pa.RecordBatch.from_arrays([runs.take(take).cast(pa.string()), artifacts.take(take).cast(pa.string()), pa.array(index, pa.int32()), pa.array(name, pa.string()), pa.array(body, pa.string()), times.take(take).cast(pa.timestamp("us")), files.take(take).cast(pa.int64())], schema=_RECORDS)


def newest_records(files: DataFrame) -> DataFrame:
    """One row per run_id, artifact and item_idx, from the file written last (then of the greatest file_id).

    Null run or artifact, records without a whole item_idx, and empty, null or
    damaged payloads give nothing; a null written_at counts as the oldest.
    """
    rows = files.select("run_id", "artifact", F.col("written_at").cast("timestamp_ntz").alias("written_at"), F.col("file_id").cast("long").alias("file_id"), "payload").filter("run_id is not null and artifact is not null")
    parsed = rows.mapInArrow(_parse, "run_id string, artifact string, item_idx int, name string, body string, written_at timestamp_ntz, file_id long")
    newest = F.max_by(F.struct("name", "body", "written_at", "file_id"), F.struct("written_at", "file_id", "body")).alias("r")
    return parsed.groupBy("run_id", "artifact", "item_idx").agg(newest).select("run_id", "artifact", "item_idx", "r.*")


def hilbert_codes(axes: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of `axes` (n x dims, unsigned, `bits` bits each), by Skilling's transpose form."""
    x = [axes[:, k].astype(np.uint64).copy() for k in range(axes.shape[1])]
    dims, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        p = q - one
        for k in range(dims):
            on = (x[k] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[k]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[k] = x[k] ^ swap
        q >>= one
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    t = np.zeros(len(axes), np.uint64)
    q = one << np.uint64(bits - 1)
    while q > one:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    code = np.zeros(len(axes), np.uint64)
    for b in range(bits - 1, -1, -1):
        for k in range(dims):
            code = (code << one) | (((x[k] ^ t) >> np.uint64(b)) & one)
    return code.astype(np.int64)


@dataclass
class Consolidated:
    """The written store: the table, its path, its number of files, its rows and the digest that both sides share."""

    table: DataFrame
    path: str
    files: int
    rows: int
    digest: int


def _digest(table: DataFrame) -> list[Column]:
    row = F.xxhash64(*[F.col(c) for c in ("run_id", "artifact", "item_idx", "body")])
    return [F.count("*").alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("digest"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("xor")]


def _axes(low: int) -> list[Column]:
    """What the curve runs over, as longs: time, run, and the beginning of the text."""
    time = F.coalesce(F.unix_micros(F.col("written_at").cast("timestamp")), F.lit(low))
    text = F.conv(F.substring(F.hex(F.rpad(F.lower(F.trim(F.coalesce("name", F.lit("")))), 7, " ")), 1, 14), 16, 10).cast("long")
    return [time.cast("long").alias("time"), F.xxhash64("run_id").alias("run"), text.alias("text")]


def _codes(frame: pd.DataFrame, cuts: list[np.ndarray], bits: int) -> np.ndarray:
    """Hilbert codes of rows whose axes are replaced by their place among the cuts."""
    ranks = np.stack([np.searchsorted(c, frame.iloc[:, k].to_numpy(np.int64), side="right") for k, c in enumerate(cuts)], axis=1)
    return hilbert_codes(np.minimum(ranks, (1 << bits) - 1).astype(np.int64), bits)


@dataclass
class Cuts:
    """Where files begin on the curve, and the codes that alone fill more than a file; at most two entries a file."""

    starts: np.ndarray  # the first code of each file that begins with one
    files: np.ndarray
    hot: np.ndarray  # sorted codes
    before: np.ndarray  # bytes before them
    size: np.ndarray
    file_bytes: int

    def file_of(self, codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The file of each row: that in which its code begins; a hot code's rows go over its stretch by their hash."""
        out = self.files[np.searchsorted(self.starts, codes, side="right") - 1].copy()
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, codes), len(self.hot) - 1)
            rows = np.flatnonzero(self.hot[at] == codes)
            k = at[rows]
            share = (hashes[rows].astype(np.uint64) >> np.uint64(44)).astype(np.float64) / (1 << 20)
            out[rows] = (self.before[k] + (share * self.size[k]).astype(np.int64)) // self.file_bytes
        return out


def cut_curve(histogram: DataFrame, file_bytes: int, ranges: int) -> tuple[Cuts, int]:
    """Cuts and the number of files for (code, bytes): code by code in order, a file begins where the bytes before pass a multiple of file_bytes.

    The driver sees the ranges' totals and the codes that begin a file or are hot.
    """
    ranged = store(histogram.repartitionByRange(ranges, "code").withColumn("range", F.spark_partition_id()), "histogram")
    offsets, total = [], 0
    for range_, n in sorted(ranged.groupBy("range").agg(F.sum("bytes")).collect()):
        offsets.append((range_, total))
        total += n
    if not total:
        return Cuts(*[np.zeros(k, np.int64) for k in (1, 1, 0, 0, 0)], file_bytes), 1
    inside = Window.partitionBy("range").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    table = ranged.sparkSession.createDataFrame(offsets, "range int, offset long")
    placed = ranged.join(F.broadcast(table), "range").withColumn("before", F.col("offset") + F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    placed = placed.withColumn("file", F.floor(F.col("before") / file_bytes).cast("long"))
    first = placed.groupBy("file").agg(F.min("code").alias("code")).select("code", "file", F.lit(-1).cast("long").alias("before"), F.lit(0).cast("long").alias("bytes"))
    hot = placed.filter(F.col("bytes") > file_bytes).select("code", "file", "before", "bytes")
    rows = sorted(tuple(r) for r in first.unionByName(hot).collect())
    starts, heavy = [r for r in rows if r[2] < 0], [r for r in rows if r[2] >= 0]
    column = lambda part, k: np.array([r[k] for r in part], np.int64)
    return Cuts(column(starts, 0), column(starts, 1), column(heavy, 0), column(heavy, 2), column(heavy, 3), file_bytes), (total - 1) // file_bytes + 1


def consolidate(files: DataFrame, path: str | None = None, file_bytes: int = 128 << 20, bits: int = 10) -> Consolidated:
    """Writes the newest version of every whole record into few Parquet files of about `file_bytes` of text each.

    Columns of the store: run_id, artifact, item_idx, name (result.text or
    mappings.label), body (the record), written_at, file_id, code. Files follow
    each other on the curve and share at most one code, a code is parted only if
    it alone fills more than a file. Raises if the digests of source and store
    differ. An empty table gives an empty store. Without a path the store lies in
    the shared folder and is removed with the other intermediate tables.
    """
    spark = files.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = store(newest_records(files), "records")
    low = records.agg(F.min(F.unix_micros(F.col("written_at").cast("timestamp")))).first()[0] or 0
    axes = _axes(low)
    steps = F.array(*[F.lit(k / (1 << bits)) for k in range(1, 1 << bits)])
    cuts = [np.array(c or [], np.int64) for c in records.select(*axes).agg(*[F.percentile_approx(n, steps, F.lit(10 << bits)).alias(n) for n in ("time", "run", "text")]).first()]

    @F.pandas_udf("long")
    def code(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(_codes(frame, cuts, bits))

    coded = records.withColumn("code", code(F.struct(*axes)))
    place, n_files = cut_curve(coded.groupBy("code").agg(F.sum(F.length("body") + F.lit(64)).cast("long").alias("bytes")), file_bytes, tasks)
    place_b = spark.sparkContext.broadcast(place)

    @F.pandas_udf("int")
    def file_of(codes: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(place_b.value.file_of(codes.to_numpy(np.int64), hashes.to_numpy(np.int64)).astype(np.int32))

    if not path:
        path = f"{shared_dir(spark)}/quillgrid/consolidated-{uuid.uuid4().hex}"
        note(spark, path)
    placed = coded.withColumn("_file", file_of("code", F.xxhash64("run_id", "artifact", "item_idx")))
    placed.repartitionById(n_files, "_file").sortWithinPartitions("code", "run_id", "artifact", "item_idx").drop("_file").write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(coded.schema).parquet(path)
    source, written = records.agg(*_digest(records)).first(), table.agg(*_digest(table)).first()
    if tuple(source) != tuple(written):
        raise RuntimeError(f"the store differs from its source: {tuple(source)} and {tuple(written)}")
    return Consolidated(table, path, n_files, source["rows"], source["xor"])
