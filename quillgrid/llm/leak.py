"""Evaluation items leaking into documents: a prefix-filtered set join with exact checks.

Every window of an item's own text is a set of word shingles. Shingles are
ordered by rarity over all documents; of each window only the rarest, as many
as a leaked passage can't all lack, are looked up. Documents that hold enough
of them on near diagonals are aligned exactly over item-sized windows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.session import store

#: Stands for what was left out of an item; no text holds it.
BREAK = "\0"
WORD = re.compile(r"[^\W_]+")
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{4}|[nrtbf\"'\\/])")
_DIFF = re.compile(r"^diff --(?:git|cc|combined) ", re.M)
_CHARS = {"n": "\n", "r": "\r", "t": "\t", "b": " ", "f": " "}


def _unescape(m: re.Match) -> str:
    x = m.group()
    return chr(int(x[2:], 16)) if x[1] == "u" else _CHARS.get(x[1], x[1])


def plain(text: str) -> str:
    """Text with backslash and entity escapes resolved."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    return text


def words(text: str) -> list[str]:
    return WORD.findall(plain(text).lower())


def sides(text: str) -> list[str]:
    """The message and, if there is a diff, its new and its old side. File headers and hunk marks belong to neither."""
    m = _DIFF.search(text)
    if not m:
        return [text]
    new: list[str] = []
    old: list[str] = []
    for line in text[m.start() :].splitlines():
        mark = line[:1]
        if mark == "+":
            if not line.startswith("+++ "):
                new.append(line[1:])
        elif mark == "-":
            if not line.startswith("--- "):
                old.append(line[1:])
        elif mark == " ":
            new.append(line[1:])
            old.append(line[1:])
    return [text[: m.start()], "\n".join(new), "\n".join(old)]


_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n word ids from each position on; 64-bit multiply and add."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ (h >> np.uint64(29))) * _P + x[k : k + len(h)] + np.uint64(1)
    return h


def _own_words(n: int, shared_run: int):
    """Words of each item without the openings it shares with other items."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[str]] = []
            for text, shared in zip(batch.column("text").to_pylist(), batch.column("shared").to_pylist()):
                w = words(text)
                common = np.zeros(len(w), bool)
                for p in shared or ():
                    common[p : p + n] = True
                own: list[str] = []
                run_: list[str] = []
                for k in range(len(w) + 1):
                    if k < len(w) and common[k]:
                        run_.append(w[k])
                        continue
                    own += run_ if len(run_) < shared_run else [BREAK]
                    run_ = []
                    own += w[k : k + 1]
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(out, pa.list_(pa.string()))], names=["item_id", "own"])

    return run


def _item_shingles(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, body, pos, shingle = [], [], [], []
            for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                w = words(text)
                for p in range(len(w) - n + 1):
                    item.append(i), body.append(" ".join(w)), pos.append(p), shingle.append(" ".join(w[p : p + n]))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(body, pa.string()), pa.array(pos, pa.int32()), pa.array(shingle, pa.string())], names=["item_id", "body", "pos", "shingle"])

    return run


def own_text(items: DataFrame, n: int = 5, shared_run: int = 10) -> DataFrame:
    """item_id, own: the item's words without runs of `shared_run` or more words that items of another text hold too."""
    base = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").dropDuplicates()
    grams = base.mapInArrow(_item_shingles(n), "item_id long, body string, pos int, shingle string")
    shared = grams.groupBy("shingle").agg(F.count_distinct("body").alias("c")).filter("c > 1").select("shingle")
    at = grams.join(shared, "shingle").groupBy("item_id", "body").agg(F.collect_set("pos").alias("shared"))
    return base.join(at.groupBy("item_id").agg(F.first("shared").alias("shared")), "item_id", "left").select("item_id", "text", "shared").mapInArrow(_own_words(n, shared_run), "item_id long, own array<string>")


class Index:
    """Items of one block: word ids by a dictionary, and each item's shingles as sorted hashes with their positions."""

    def __init__(self, block: list[tuple[int, list[str]]], n: int):
        self.n = n
        self.items = [i for i, _ in block]
        self.ids: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        for _, own in block:
            ids = np.array([-1 if w == BREAK else self.ids.setdefault(w, len(self.ids) + 1) for w in own], np.int64)
            h = shingle_hashes(ids, n)
            bad = np.concatenate([[0], np.cumsum(ids < 0)])
            p = np.flatnonzero(bad[n : len(h) + n] == bad[: len(h)])
            order = np.argsort(h[p], kind="stable")
            self.words.append(ids)
            self.hashes.append(h[p][order])
            self.places.append(p[order])
        self.known = [(known, np.append(first, len(h))) for h in self.hashes for known, first in (np.unique(h, return_index=True),)]
        self.distinct = np.unique(np.concatenate(self.hashes)) if block else np.empty(0, np.uint64)


class Prefixes:
    """Postings of the necessary shingles: hash -> (item's index, position)."""

    def __init__(self, chosen: list[tuple[int, int, int]]):
        h = np.array([c[0] for c in chosen], np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, first = np.unique(h[order], return_index=True)
        self.bounds = np.append(first, len(order))
        self.item = np.array([c[1] for c in chosen], np.int64)[order]
        self.place = np.array([c[2] for c in chosen], np.int64)[order]


def necessary(index: Index, frequency: np.ndarray, passage: int, edits: int, required: int, hits: int) -> list[tuple[int, int, int]]:
    """(shingle, item's index, position) of prefixes that no leaked passage can miss.

    A passage lies within `passage` + `edits` words of its item and shares at
    least `required` of their shingles. Of each such window all but
    required - hits shingles are taken, the rarest first, so that at least
    `hits` of those shared are among them. What an earlier window of the item
    took counts for the later ones; of equally rare shingles (to a factor of
    two) the last are taken, as more of the windows to come hold them.
    """
    out = []
    for k, (hashes, places) in enumerate(zip(index.hashes, index.places)):
        rarity = np.ceil(np.log2(frequency[np.searchsorted(index.distinct, hashes)] + 1.0))
        order = np.lexsort((-places, rarity))
        rank = {int(p): r for r, p in enumerate(places[order])}
        hash_at = dict(zip(places.tolist(), hashes.tolist()))
        size = passage + edits - index.n + 1
        taken: set[int] = set()
        for a in range(max(1, len(index.words[k]) - passage - edits + 1)):
            window = [p for p in range(a, a + size) if p in rank]
            spare = sorted((p for p in window if p not in taken), key=rank.__getitem__)
            if len(window) >= required:
                taken.update(spare[: max(0, len(spare) - (required - hits))])
        out += [(hash_at[p], k, p) for p in sorted(taken)]
    return out


def _parts(batches: Iterable[pa.RecordBatch], get, most_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Word ids of many texts after another, each side followed by a 0; where each side starts; its document. Unknown words are 0."""
    ids: list[int] = []
    starts: list[int] = []
    docs: list[int] = []
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if doc is None or not text:
                continue
            for part in sides(text):
                starts.append(len(ids))
                docs.append(doc)
                ids.extend([get(w, 0) for w in words(part)])
                ids.append(0)
            if len(ids) > most_words:
                yield np.array(ids, np.int64), np.array(starts), docs
                ids, starts, docs = [], [], []
    if ids:
        yield np.array(ids, np.int64), np.array(starts), docs


def _found(ids: np.ndarray, n: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, place in `known`) of the shingles that are known and hold no unknown word."""
    h = shingle_hashes(ids, n)
    if not len(h) or not len(known):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    p = np.flatnonzero(known[at] == h)
    bad = np.concatenate([[0], np.cumsum(ids == 0)])
    p = p[bad[p + n] == bad[p]]
    return p, at[p]


def _count_shingles(index_b, most_words: int):
    """In how many texts' sides each shingle of the items stands; one row per shingle and task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = index_b.value
        total = np.zeros(len(index.distinct), np.int64)
        for ids, starts, _ in _parts(batches, index.ids.get, most_words):
            p, at = _found(ids, index.n, index.distinct)
            side = np.searchsorted(starts, p, side="right") - 1
            pairs = np.unique(side * np.int64(len(index.distinct)) + at)
            total += np.bincount(pairs % len(index.distinct), minlength=len(total)) if len(pairs) else 0
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["shingle", "n"])

    return run


def _expand(bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group number in `at` all places in its bounds: (index into at, place)."""
    size = bounds[at + 1] - bounds[at]
    source = np.repeat(np.arange(len(at)), size)
    return source, np.arange(len(source)) - np.repeat(np.cumsum(size) - size, size) + bounds[at][source]


def _near(side: np.ndarray, item: np.ndarray, diagonal: np.ndarray, place: np.ndarray, edits: int, hits: int) -> set[tuple[int, int]]:
    """(side, item) with at least `hits` different places within `edits` diagonals of each other.

    Cells of 2 (edits + 1) diagonals in two grids that overlap by half: what lies within `edits` shares a cell of one.
    """
    out: set[tuple[int, int]] = set()
    width = edits + 1
    for shift in (0, width):
        cell = (diagonal + shift) // (2 * width)
        order = np.lexsort((place, cell, item, side))
        s, i, c, p = side[order], item[order], cell[order], place[order]
        if not len(s):
            continue
        fresh = np.ones(len(s), bool)
        fresh[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (c[1:] != c[:-1])
        other = fresh.copy()
        other[1:] |= p[1:] != p[:-1]
        first = np.flatnonzero(fresh)
        enough = np.add.reduceat(other.astype(np.int64), first) >= hits
        out.update(zip(s[first][enough].tolist(), i[first][enough].tolist()))
    return out


def stretch(item: np.ndarray, part: np.ndarray, edits: int) -> int:
    """Most words of the item that stand in a stretch of the text in the item's order, with at most `edits` words changed, added or dropped between them."""
    m, n = len(item), len(part)
    if not m or not n:
        return 0
    last = np.zeros((edits + 1, n + 1), np.int32)
    best = 0
    for x in item:
        row = np.zeros_like(last)
        row[0, 1:] = np.where(part == x, last[0, :-1] + 1, 0)
        row[1:, 1:] = np.where(part == x, last[1:, :-1] + 1, last[:-1, :-1])
        np.maximum(row[1:], last[:-1], out=row[1:])
        for e in range(1, edits + 1):
            np.maximum(row[e, 1:], row[e - 1, :-1], out=row[e, 1:])
        best = max(best, int(row[edits].max()))
        last = row
    return best


def _holds(part: np.ndarray, index: Index, k: int, passage: int, edits: int, required: int) -> int:
    """Most words that one stretch of the part shares with item k; 0 where length and positions rule a passage out."""
    n, places = index.n, index.places[k]
    known, bounds = index.known[k]
    p, at = _found(part, n, known)
    source, hit = _expand(bounds, at)
    pos, place = p[source], places[hit]
    reach, width = passage + 2 * edits + n, edits + 1
    regions: list[tuple[int, int]] = []
    for shift in (0, width):
        cell = (pos - place + shift) // (2 * width)
        order = np.lexsort((place, cell))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(cell[order])) + 1, [len(order)]])
        for g in np.flatnonzero(np.diff(edges) >= required):
            group = order[edges[g] : edges[g + 1]]
            u = np.unique(place[group])
            if len(u) >= required and (u[required - 1 :] - u[: len(u) - required + 1] < passage + edits - n + 1).any():
                regions.append((max(0, int(pos[group].min()) - reach), int(pos[group].max()) + reach))
    best, end = 0, -1
    for low, high in sorted(regions):  # regions of both grids overlap; each stretch of the part is aligned once
        if high > end:
            best = max(best, stretch(index.words[k], part[low:high], edits))
            end = high
    return best


def _search(index_b, prefixes_b, passage: int, edits: int, required: int, hits: int, most_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = index_b.value
        prefixes: Prefixes = prefixes_b.value
        for ids, starts, docs in _parts(batches, index.ids.get, most_words):
            p, at = _found(ids, index.n, prefixes.hash)
            side = np.searchsorted(starts, p, side="right") - 1
            source, hit = _expand(prefixes.bounds, at)
            place = prefixes.place[hit]
            asked = sorted(_near(side[source], prefixes.item[hit], p[source] - place, place, edits, hits))
            ends = np.append(starts[1:], len(ids))
            doc, item, matched = [], [], []
            for s, k in asked:
                got = _holds(ids[starts[s] : ends[s]], index, k, passage, edits, required)
                if got >= passage:
                    doc.append(docs[s]), item.append(index.items[k]), matched.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(matched, pa.int32())], names=["doc_id", "item_id", "matched_words"])

    return run


def leaks(docs: DataFrame, items: DataFrame, passage: int = 20, edits: int = 4, shingle: int = 2, prefix_hits: int = 2, block_chars: int = 4_000_000, most_words: int = 2_000_000) -> DataFrame:
    """Documents that hold `passage` or more words of an item's own text, in its order.

    One row per document and item: doc_id, item_id, matched_words (the most in
    one stretch). A passage lies in the message or on one side of the diff; it
    counts if at most `edits` single words are changed, added or dropped among
    `passage` matching ones. Null or empty texts and null ids match nothing;
    repeated rows count once; items of equal text are each reported; an item
    that is all shared instruction matches nothing. Extra columns are ignored.

    Such a passage shares passage - (shingle - 1) * (edits + 1) shingles with
    its item, on diagonals within `edits` of each other, so no step below loses
    one: shingles are counted over all documents, the rarest necessary ones of
    each window are looked up, items hit `prefix_hits` times on near diagonals
    are counted in full, and what is left is aligned exactly. All of it happens
    where the document is read; no text is shuffled.

    The items are a query set, broadcast in blocks of at most `block_chars`
    characters (a longer item is a block of its own); each block reads the
    documents twice. `most_words` words of text are searched at a time.
    """
    spark = docs.sparkSession
    required = passage - (shingle - 1) * (edits + 1)
    if not 1 <= prefix_hits <= required:
        raise ValueError("a passage need not share that many shingles: fewer edits, a shorter shingle or fewer prefix hits")
    own = store(own_text(items), "items")
    total = own.agg(F.sum(F.aggregate("own", F.lit(0).cast("long"), lambda a, w: a + F.length(w) + 1))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    found = []
    for b in range(blocks):
        index = Index(sorted((r[0], list(r[1])) for r in own.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()), shingle)
        index_b = spark.sparkContext.broadcast(index)
        frequency = np.zeros(len(index.distinct), np.int64)  # one number per shingle of the block
        for at, n in source.mapInArrow(_count_shingles(index_b, most_words), "shingle long, n long").groupBy("shingle").agg(F.sum("n")).collect():
            frequency[at] = n
        prefixes = Prefixes(necessary(index, frequency, passage, edits, required, prefix_hits))
        found.append(source.mapInArrow(_search(index_b, spark.sparkContext.broadcast(prefixes), passage, edits, required, prefix_hits, most_words), "doc_id long, item_id long, matched_words int"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc_id", "item_id").agg(F.max("matched_words").alias("matched_words"))
