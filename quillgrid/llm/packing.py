"""Filling fixed-capacity containers with documents (hierarchical residual packing).

Each partition measures its documents in tokens and packs them best-fit,
largest first. Nearly full bins are closed; underfull bins become items of a
next round, in which half as many tasks pack them again, down to one.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.session import store

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of the byte-level BPE vocabulary above.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def encoder(path: str, content: bytes | None = None):
    """The tokenizer of a worker process, made once from the vocabulary's content (on the driver, from the file)."""
    if path not in _encoders:
        import base64

        import tiktoken

        if content is None:
            with open(path, "rb") as f:
                content = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
        _encoders[path] = tiktoken.Encoding("packing", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Best-fit decreasing: the bin of each item and the fill of each bin. Ties go by position, so the result is fixed."""
    room: list[tuple[int, int]] = []
    fill: list[int] = []
    where = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            b, left = len(fill), capacity
            fill.append(0)
        else:
            left, b = room.pop(at)
        where[i] = b
        fill[b] += sizes[i]
        if left > sizes[i]:
            insort(room, (left - sizes[i], b))
        elif sizes[i] == 0:
            insort(room, (0, b))
    return where, fill


_PIECES = pa.schema([("kind", pa.string()), ("item", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("tokens", pa.int64()), ("bin", pa.int64())])


def _bin_id(round_: int, partition: int, n: int) -> int:
    return (round_ << 56) | (partition << 32) | n


def _rows(kind: str, item, piece, pieces, tokens, bins) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(item)), pa.array(item, pa.int64()), pa.array(piece, pa.int32()), pa.array(pieces, pa.int32()), pa.array(tokens, pa.int64()), pa.array(bins, pa.int64())], schema=_PIECES)


def _pack_documents(capacity: int, vocabulary: str, content_b):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sizes: list[int] = []
        encode = None
        for batch in batches:
            encode = encode or encoder(vocabulary, content_b.value).encode_ordinary
            ids += batch.column(0).to_pylist()
            sizes += [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
        partition, n = TaskContext.get().partitionId(), 0
        item, piece, pieces, tokens, bins = [], [], [], [], []
        rest: list[int] = []
        closed: list[tuple[int, int]] = []
        for i, size in zip(ids, sizes):
            parts = max(1, math.ceil(size / capacity))
            for k in range(parts):
                here = min(capacity, size - k * capacity)
                item.append(i), piece.append(k), pieces.append(parts), tokens.append(here)
                if here == capacity:
                    bins.append(_bin_id(0, partition, n))
                    closed.append((_bin_id(0, partition, n), capacity))
                    n += 1
                else:
                    rest.append(len(bins))
                    bins.append(-1)
        where, fill = best_fit([tokens[k] for k in rest], capacity)
        for k, b in zip(rest, where):
            bins[k] = _bin_id(0, partition, n + b)
        made = closed + [(_bin_id(0, partition, n + b), f) for b, f in enumerate(fill)]
        for a in range(0, len(item), 50_000):
            z = slice(a, a + 50_000)
            yield _rows("piece", item[z], piece[z], pieces[z], tokens[z], bins[z])
        if made:
            yield _rows("bin", [b for b, _ in made], [0] * len(made), [0] * len(made), [f for _, f in made], [b for b, _ in made])

    return run


def _pack_bins(capacity: int, round_: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((b, f) for batch in batches for b, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        if not got:
            return
        where, fill = best_fit([f for _, f in got], capacity)
        partition = TaskContext.get().partitionId()
        new = [_bin_id(round_, partition, b) for b in where]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.int64()), pa.array(new, pa.int64()), pa.array([fill[b] for b in where], pa.int64())], names=["old", "bin", "tokens"])

    return run


def pack(docs: DataFrame, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, nearly_full: float = 0.98, items_per_task: int = 100_000, most_items: int = 2_000_000) -> DataFrame:
    """Packs documents into containers of `capacity` tokens.

    One row per piece: doc_id, piece (from 0), pieces, tokens, container,
    container_tokens. Only a document above the capacity has several pieces:
    full containers of its own and a rest that is packed like an item.
    A null or empty text has 0 tokens and shares some container. Rows with
    equal ids or texts are items of their own; a null id is kept. Other columns
    are ignored. An empty table gives no rows.

    Underfull bins are packed by about `items_per_task` to a task, then by half
    as many tasks, and so on down to one. Where one task would get more than
    `most_items` (bins that nothing fits in stay as they are), tasks stop
    halving, rounds end when nothing merges any more, and a last one brings
    together what is at most half full, which best-fit leaves one of in a task:
    in the end one container at most is.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        content_b = spark.sparkContext.broadcast(f.read())
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = store(source.mapInArrow(_pack_documents(capacity, vocabulary, content_b), "kind string, item long, piece int, pieces int, tokens long, bin long"), "pack")
    pieces = out.filter("kind = 'piece'").select(F.col("item").alias("doc_id"), "piece", "pieces", "tokens", "bin")
    room = F.col("fill") < int(nearly_full * capacity)
    open_bins = out.filter("kind = 'bin'").select("bin", F.col("tokens").alias("fill")).filter(room)
    chain: DataFrame | None = None

    def merge(round_: int, bins: DataFrame, tasks: int) -> tuple[DataFrame, int]:
        """One round over the bins: the moves so far with it, and how many bins it saved."""
        dealt = bins.repartition(tasks, F.xxhash64("bin", F.lit(round_))) if tasks > 1 else bins.coalesce(1)
        moved = store(dealt.mapInArrow(_pack_bins(capacity, round_), "old long, bin long, tokens long"), "pack")
        rows, made = moved.agg(F.count("*"), F.count_distinct("bin")).first()
        return moved, rows - made

    n, round_ = open_bins.count(), 0
    tasks = max(1, math.ceil(n / items_per_task))
    while n > 1:
        round_ += 1
        moved, saved = merge(round_, open_bins, tasks)
        chain = _followed(chain, moved)
        open_bins = moved.groupBy("bin").agg(F.first("tokens").alias("fill")).filter(room)
        n = open_bins.count()
        if tasks == 1:
            break
        fewer = max(1, tasks // 2, math.ceil(n / most_items))
        if fewer >= tasks and not saved:
            chain = _followed(chain, merge(round_ + 1, open_bins.filter(F.col("fill") <= capacity // 2), 1)[0])
            break
        tasks = min(tasks, fewer)
    placed = pieces.withColumnRenamed("bin", "at")
    if chain is not None:
        placed = placed.join(chain.select(F.col("old").alias("at"), F.col("bin").alias("to")), "at", "left").withColumn("at", F.coalesce("to", "at"))
    return placed.select("doc_id", "piece", "pieces", "tokens", F.col("at").alias("container"), F.sum("tokens").over(Window.partitionBy("at")).alias("container_tokens"))


def _followed(chain: DataFrame | None, moved: DataFrame) -> DataFrame:
    """old, bin: where each underfull bin is after one more round."""
    step = moved.select(F.col("old").alias("_from"), F.col("bin").alias("_to"))
    if chain is None:
        return moved.select("old", "bin")
    return store(chain.join(step, chain["bin"] == step["_from"], "left").select("old", F.coalesce("_to", "bin").alias("bin")), "pack")


def fill_report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: containers, tokens, the fewest containers that could hold them, and the share of the containers' room that is used."""
    total = packed.agg(F.count_distinct("container").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return total.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("fewest"), F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)).alias("fill"))


def split_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the packing had to split."""
    options.setdefault("capacity", 4096)
    source = docs.select(F.col(options.pop("id_col", "doc_id")).cast("long").alias("doc_id"), F.col(options.pop("text_col", "text")).alias("text"))
    return pack(source, **options).filter("pieces > 1").select("doc_id").distinct()
