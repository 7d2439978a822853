"""Frequencies of every term by a distributed suffix array.

Every token starts a suffix. Suffixes are range-sorted by (first token,
record), so that a frequent token may reach over many tasks, but never one
record's occurrences of it. Each task sorts its suffixes, takes the
common-prefix lengths of neighbours and reads every n-gram's interval off
them; what one record's neighbouring suffixes share is counted twice within
it, so records = occurrences - duplicate adjacencies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.session import store


def tokens(text: Column) -> Column:
    """Maximal runs of Unicode letters or digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}]+)"), 1)


def whole(text: Column) -> Column:
    """The whole value as one token: lower-cased, trimmed, inner white space as one space."""
    return F.array(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " "), r"^ | $", ""))


def suffixes(records: DataFrame, longest: int | None) -> DataFrame:
    """src, record, head (first token), tail (the next longest - 1 tokens, or all) from src, record, tokens."""
    at = records.select("src", "record", "tokens", F.posexplode("tokens").alias("pos", "head"))
    n = F.size("tokens") if longest is None else F.lit(longest - 1)
    return at.select("src", "record", "head", F.slice("tokens", F.col("pos") + 2, n).alias("tail"))


_COUNTS = pa.schema([("src", pa.string()), ("term", pa.string()), ("n", pa.int32()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _intervals(longest: int | None, deepest: int | None, most_cells: int):
    """Batches come sorted by src, head, record; suffixes are counted in pieces of about most_cells tokens that part no record's suffixes of one head."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        cells = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            width = 1 + (pc.max(pc.list_value_length(batch.column("tail"))).as_py() or 0)
            cells += batch.num_rows * width
            if cells < most_cells:
                continue
            table = pa.Table.from_batches(waiting).combine_chunks()
            same = pc.equal(table.column("record"), table.column("record")[-1])
            for c in ("src", "head"):
                same = pc.and_(same, pc.equal(table.column(c), table.column(c)[-1]))
            cut = table.num_rows - (pc.sum(same).as_py() or 0)
            if cut:
                yield from count_suffixes(table.slice(0, cut), deepest)
            waiting = table.slice(cut).combine_chunks().to_batches()
            cells = (table.num_rows - cut) * width
        if waiting:
            yield from count_suffixes(pa.Table.from_batches(waiting), deepest)

    return run


def _matrix(head: pa.Array, tail: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Suffix x token numbers, -1 after the end, and the tokens by number."""
    rows = len(head)
    sizes = pc.list_value_length(tail).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pa.concat_arrays([head.cast(pa.string()), pc.list_flatten(tail).cast(pa.string())]).dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    out = np.full((rows, 1 + int(sizes.max(initial=0))), -1, np.int32)
    out[:, 0] = numbers[:rows]
    row = np.repeat(np.arange(rows), sizes)
    out[row, 1 + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = numbers[rows:]
    return out, coded.dictionary


def least_between(values: np.ndarray, after: np.ndarray, to: np.ndarray) -> np.ndarray:
    """min(values[after + 1 .. to]) for each pair, by a table of minima over powers of two."""
    if not len(after):
        return np.empty(0, values.dtype)
    levels = np.frexp(to - after)[1] - 1
    out = np.empty(len(after), values.dtype)
    table = values
    for level in range(int(levels.max()) + 1):
        if level:
            half = 1 << (level - 1)
            table = np.minimum(table[:-half], table[half:])
        mine = levels == level
        out[mine] = np.minimum(table[after[mine] + 1], table[to[mine] - (1 << level) + 1])
    return out


def count_suffixes(table: pa.Table, deepest: int | None) -> Iterator[pa.RecordBatch]:
    """Occurrences and records of every n-gram (n up to `deepest`) of the suffixes, from their sorted array.

    Neighbours' common prefixes cut the array, at each depth n, into the
    intervals of the n-grams. For each suffix the one before it of the same
    record shares the least common prefix between the two; where that reaches n
    the pair is a duplicate within the record, which is subtracted.
    """
    table = table.combine_chunks()
    one = lambda c: (lambda a: a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a)(table.column(c))
    src = one("src").cast(pa.string()).dictionary_encode()
    source = src.indices.to_numpy(zero_copy_only=False)
    record = one("record").to_numpy(zero_copy_only=False)
    tokens_, names = _matrix(one("head"), one("tail"))
    order = np.lexsort((record, *tokens_.T[::-1], source))
    array, source, record = tokens_[order], source[order], record[order]
    rows, width = array.shape
    # common prefix with the suffix before it
    common = np.zeros(rows, np.int32)
    live = np.flatnonzero(source[1:] == source[:-1]) + 1
    for n in range(width):
        live = live[(array[live, n] >= 0) & (array[live, n] == array[live - 1, n])]
        common[live] += 1
    # the suffix before it of the same record, and what the two share
    by_record = np.lexsort((np.arange(rows), record, source))
    pair = np.flatnonzero((record[by_record[1:]] == record[by_record[:-1]]) & (source[by_record[1:]] == source[by_record[:-1]]))
    shared = np.zeros(rows, np.int32)
    shared[by_record[pair + 1]] = least_between(common, by_record[pair], by_record[pair + 1])
    text: pa.Array | None = None
    at = np.arange(rows)
    for n in range(1, min(width, deepest or width) + 1):
        at = at[array[at, n - 1] >= 0]  # the suffixes that are n long
        if not len(at):
            return
        # a suffix cut away stands before its longer neighbours, so the first of an interval has a shorter common prefix
        begins = np.flatnonzero(common[at] < n)
        occurrences = np.diff(np.append(begins, len(at)))
        duplicates = np.add.reduceat((shared[at] >= n).astype(np.int64), begins)
        first = at[begins]
        text = names.take(pa.array(array[first, 0]))
        if n > 1:
            text = pc.binary_join_element_wise(text, *[names.take(pa.array(array[first, k])) for k in range(1, n)], " ")
        yield pa.RecordBatch.from_arrays([src.dictionary.take(pa.array(source[first])), text, pa.array(np.full(len(first), n, np.int32)), pa.array(occurrences.astype(np.int64)), pa.array((occurrences - duplicates).astype(np.int64))], schema=_COUNTS)


def term_counts(records: DataFrame, longest: int | None = None, deepest: int | None = None, most_cells: int = 2_000_000) -> DataFrame:
    """src, term, n, occurrences, records of every n-gram.

    Suffixes are sorted by their first `longest` tokens (None: by all of them,
    which takes the square of a record's tokens); n-grams of up to `deepest`
    tokens are given (None: all that the suffixes hold). `records` has src,
    record (a unique long within src) and tokens. Null tokens arrays or null
    records count nothing; an empty table gives no rows. A term's counts from
    several pieces are added up: no record's suffixes of one first token are
    ever parted, so neither are its occurrences of an n-gram.
    """
    spark = records.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = store(records.filter("record is not null and tokens is not null").select("src", "record", "tokens"), "tokens")
    array = suffixes(kept, longest).repartitionByRange(tasks, "src", "head", "record").sortWithinPartitions("src", "head", "record")
    partial = array.mapInArrow(_intervals(longest, deepest, most_cells), "src string, term string, n int, occurrences long, records long")
    return partial.groupBy("src", "term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(records: DataFrame, rare_below: int = 3, common_above: float = 0.01, longest: int | None = None, deepest: int | None = None) -> DataFrame:
    """term_counts with mark: `rare` in fewer than `rare_below` records, `common` in more than that share of the source's records, else null."""
    totals = records.filter("record is not null").groupBy("src").agg(F.count("*").alias("total"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * F.col("total"), "common")
    return term_counts(records, longest, deepest).join(totals, "src").withColumn("mark", mark).drop("total")


def text_records(rows: DataFrame, key: str, text_col: str, src: str, split: bool) -> DataFrame:
    """src, record, tokens of the non-blank values; each key counts once (of unequal re-deliveries the latest)."""
    once = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(text_col, F.struct("loaded_at", text_col)).alias("text"))
    text = F.col("text")
    return once.filter(text.rlike(r"[^\s\p{Z}]")).select(F.lit(src).alias("src"), F.col(key).cast("long").alias("record"), (tokens(text) if split else whole(text)).alias("tokens"))
