"""Mapping freely entered values to a reference list: a trie searched with a Levenshtein automaton.

The trie holds the squashed form of every entry, its aliases and other orders
of its words; inner nodes that lead to one entry only also stand for cut-off
forms. The automaton (with transpositions) keeps one bit per character of the
value and one word per number of errors, so a batch of values walks the trie
together and leaves a branch when its bits are gone.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.session import store

# Characters that scans confuse, by the one that stands for them.
LOOKALIKES = str.maketrans({"0": "a", "o": "a", "1": "i", "l": "i", "5": "s", "6": "b", "h": "b", "8": "b", "9": "g", "q": "g", "c": "e", "v": "u", "f": "t", "7": "t", "2": "z"})
# Groups that scans take for one letter.
LIGATURES = (("rri", "m"), ("rn", "m"), ("ri", "n"), ("rl", "n"), ("cl", "d"), ("vv", "w"))
_GROUPS = {one: tuple(g for g, o in LIGATURES if o == one) for _, one in LIGATURES}
_NUMBERING = re.compile(r"^\s*(?:\(?(?:\d{1,3}|[ivxl]{1,5}|[a-z])[.)]\s*)+(?=\S)", re.I)
_TAIL = re.compile(r"[\s.:;,_*?\-–—=]+$")
_PARENTHESES = re.compile(r"(?<=\S)\s*[\(\[][^()\[\]]*[\)\]]")
_GAPS = re.compile(r"[\s\-–—]+")
_SIGNS = ((re.compile(r"%\s*age\b", re.I), " percentage "), (re.compile(r"%"), " percent "), (re.compile(r"#"), " no "))


def squash(text: str) -> str:
    """Letters and digits only, without case and accents."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return "".join(filter(str.isalnum, text.lower()))


def fold(squashed: str) -> str:
    """The squashed form with look-alikes as one character."""
    for a, b in LIGATURES:
        squashed = squashed.replace(a, b)
    return squashed.translate(LOOKALIKES)


def fold_words(text: str) -> str:
    """fold() word by word, so that no pair is made over a gap."""
    return "".join(fold(squash(w)) for w in text.split())


def plain_fold(text: str) -> str:
    """Look-alike characters only, groups of letters as they are."""
    return squash(text).translate(LOOKALIKES)


def _close(a: str, b: str, most: int) -> bool:
    """Whether two short strings are within `most` edits."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


def _by_length(phrases: tuple[str, ...]) -> list[tuple[int, list[str]]]:
    """(number of words, folded phrases), the longest first."""
    lengths = sorted({len(x.split()) for x in phrases}, reverse=True)
    return [(n, [fold(squash(x)) for x in phrases if len(x.split()) == n]) for n in lengths]


@dataclass(frozen=True)
class Wording:
    """What is known of the way in which values are worded; all of it is optional.

    leads, trails: phrases around a value that don't name it. short_forms: other
    forms of words of the reference list. reorder: whether an entry's words may
    also stand in the orders of `_variants`.
    """

    leads: tuple[str, ...] = ()
    trails: tuple[str, ...] = ()
    short_forms: tuple[tuple[str, tuple[str, ...]], ...] = ()
    reorder: bool = False


def _is_phrase(said: str, phrase: str) -> bool:
    """Equal, or for longer phrases the same letters or one edit away, with the first or last letter kept."""
    if said == phrase or len(phrase) > 5 and said[:1] == phrase[:1] and sorted(said) == sorted(phrase):
        return True
    return len(phrase) > 5 and abs(len(said) - len(phrase)) <= 1 and bool(said) and (said[0] == phrase[0] or said[-1] == phrase[-1]) and _close(said, phrase, 1)


def _strip_ends(words: list[str], leads: list, trails: list) -> list[str]:
    """Without the phrases around a label, however many."""
    changed = True
    while changed:
        changed = False
        for n, phrases in leads:
            if len(words) > n and any(_is_phrase(said, x) for said in (fold(squash("".join(words[:n]))),) for x in phrases):
                words, changed = words[n:], True
                break
        for n, phrases in trails:
            if len(words) > n and any(_is_phrase(said, x) for said in (fold(squash("".join(words[-n:]))),) for x in phrases):
                words, changed = words[:-n], True
                break
    return words


def readings(label: str, leads: list = (), trails: list = ()) -> list[str]:
    """Readings under which a printed label may name an entry, words kept apart, the plainest first."""
    text = unicodedata.normalize("NFKD", label)
    for sign, word in _SIGNS:
        text = sign.sub(word, text)
    out: dict[str, str] = {}

    def add(x: str) -> None:
        if s := squash(x):
            out.setdefault(s, " ".join(x.split()))
            if 3 < len(s) <= 5 and (once := re.sub(r"(.)\1+", r"\1", s)) != s:  # short names with a letter doubled
                out.setdefault(once, once)

    bare = _TAIL.sub("", text)
    forms = [bare, _NUMBERING.sub("", bare)]
    for form in list(forms):
        if (cut := _PARENTHESES.sub(" ", form)) != form:
            forms.append(_TAIL.sub("", cut))
    for form in dict.fromkeys(forms):
        add(form)
        ends = _strip_ends([w for w in _GAPS.split(form) if w], leads, trails)
        add(" ".join(ends))
    return list(out.values())


@dataclass
class _Node:
    next: dict[str, int] = field(default_factory=dict)
    ends: list[tuple[int, int]] = field(default_factory=list)  # label_id, rank of the path's kind


def _variants(canonical: str, wording: Wording) -> list[str]:
    """Other ways in which an entry may be written: word order, cut possessive, short forms."""
    short_forms = dict(wording.short_forms)
    out = []
    shorts = [[w, *short_forms.get(w.lower(), ())] for w in canonical.split()]
    if sum(len(x) > 1 for x in shorts) <= 4:
        out += [" ".join(x) for x in itertools.product(*shorts) if list(x) != canonical.split()]
    if not wording.reorder:
        return out
    m = re.fullmatch(r"(\w+)['’]s (.+)", canonical)
    if m:
        who, what = m.groups()
        out += [f"{what} of {who}", f"{what} of the {who}", f"{what} {who}", f"{who} {what}", f"{who}s, {what}"]
    if " of " in canonical:
        a, b = canonical.split(" of ", 1)
        out += [f"{b}, {a} of", f"{b} {a}"]
    words = canonical.split()
    if len(words) == 2 and not m:
        out.append(f"{words[1]}, {words[0]}")
    if len(words) == 3 and not m and words[1] not in ("of", "or", "and", "in", "for", "with", "by", "to"):
        out += [f"{words[2]}, {words[0]} {words[1]}", f"{words[1]} {words[2]}, {words[0]}"]
    return out


def _ways(canonical: str | None, aliases: list[str] | None, wording: Wording) -> Iterator[tuple[int, str, str]]:
    """(kind, path, folded path) of everything that names an entry outright."""
    for kind, path in [(0, canonical)] + [(1, a) for a in aliases or () if a] + [(2, v) for v in _variants(canonical or "", wording)]:
        for sign, word in _SIGNS:
            path = sign.sub(word, path or "")
        for folded in dict.fromkeys((fold_words(path), plain_fold(path))):
            if folded:
                yield kind, path, folded


def known_prefixes(entries: list[tuple[int, str, list[str]]], wording: Wording = Wording()) -> dict[str, int]:
    """The entry of each beginning of a folded path, -1 where several entries share it."""
    out: dict[str, int] = {}
    for label_id, canonical, aliases in entries:
        for _, _, folded in _ways(canonical, aliases, wording):
            for n in range(1, len(folded) + 1):
                if out.setdefault(folded[:n], label_id) != label_id:
                    out[folded[:n]] = -1
    return out


class Trie:
    """Folded paths of the reference list."""

    def __init__(self, entries: list[tuple[int, str, list[str]]], prefixes: dict[str, int] | None = None, wording: Wording = Wording()):
        self.nodes = [_Node()]
        self.leads, self.trails = _by_length(wording.leads), _by_length(wording.trails)
        self.depth = 0
        self.paths: dict[tuple[int, int, int], list[str]] = {}  # by label_id, kind and folded length, with words kept apart
        prefixes = known_prefixes(entries, wording) if prefixes is None else prefixes
        seen: set[tuple[int, str]] = set()
        for label_id, canonical, aliases in entries:
            for kind, path, folded in _ways(canonical, aliases, wording):
                if (label_id, folded) not in seen:
                    seen.add((label_id, folded))
                    self._add(folded, label_id, kind)
                    self.paths.setdefault((label_id, kind, len(folded)), []).append(path)
        for label_id, canonical, _ in entries:
            self._add_cuts(canonical or "", label_id, prefixes)

    def _add(self, path: str, label_id: int, kind: int) -> None:
        at = 0
        for c in path:
            if c not in self.nodes[at].next:
                self.nodes[at].next[c] = len(self.nodes)
                self.nodes.append(_Node())
            at = self.nodes[at].next[c]
        self.depth = max(self.depth, len(path))
        if (label_id, kind) not in self.nodes[at].ends:
            self.nodes[at].ends.append((label_id, kind))

    def _add_cuts(self, canonical: str, label_id: int, prefixes: dict[str, int]) -> None:
        """Cut-off forms: from 60 % of the name and seven letters on, where no other entry goes the same way."""
        whole = len(squash(canonical))
        for n in range(1, len(canonical)):
            cut = canonical[:n]
            letters = len(squash(cut))
            if canonical[n - 1].isalnum() and max(7, 0.6 * whole) <= letters < whole:
                for folded in dict.fromkeys((fold_words(cut), plain_fold(cut))):
                    if prefixes.get(folded, label_id) == label_id:
                        self._add(folded, label_id, 3)
                        self.paths.setdefault((label_id, 3, len(folded)), []).append(cut)


def allowed(length: int) -> int:
    """Errors allowed on a path of this length."""
    return 0 if length <= 3 else 1 if length <= 6 else 2 if length <= 9 else 3 if length <= 13 else 4 if length <= 17 else 5


def search(trie: Trie, values: list[str], most: int = 5) -> Iterator[tuple[int, int, int, int, int]]:
    """(value's index, label_id, kind, errors, path length) of all paths within the allowed distance.

    Values of up to 62 characters walk the trie together, longer ones alone;
    those that are longer than every path by more than `most` are out of reach.
    """
    for k, v in enumerate(values):
        if 62 < len(v) <= trie.depth + most:
            yield from ((k, *hit) for hit in _search_long(trie, v, most))
    keep = [k for k, v in enumerate(values) if 0 < len(v) <= 62]
    if not keep:
        return
    index = np.array(keep)
    length = np.array([len(values[k]) for k in keep])
    letters = sorted({c for node in trie.nodes for c in node.next})
    code = {c: k for k, c in enumerate(letters)}
    one = np.uint64(1)
    masks = np.zeros((len(letters), len(keep)), np.uint64)
    for row, k in enumerate(keep):
        for p, c in enumerate(values[k]):
            if c in code:
                masks[code[c], row] |= one << np.uint64(p + 1)
    end = one << length.astype(np.uint64)
    full = (end << one) - one
    # start: r errors reach the first r characters by leaving them out
    start = [np.full(len(keep), (1 << (r + 1)) - 1, np.uint64) & full for r in range(most + 1)]
    none = [np.zeros(len(keep), np.uint64)] * (most + 1)
    stack = [(0, 0, np.arange(len(keep)), start, none, None)]
    two = np.uint64(2)
    while stack:
        node, depth, rows, bits, turned, came = stack.pop()
        for kind_end in trie.nodes[node].ends:
            bound = min(most, allowed(depth))
            done = np.zeros(len(rows), bool)
            for e in range(bound + 1):
                hit = ~done & ((bits[e] & end[rows]) != 0)
                done |= hit
                for k in np.flatnonzero(hit):
                    yield int(index[rows[k]]), kind_end[0], kind_end[1], e, depth
        for c, child in trie.nodes[node].next.items():
            m = masks[code[c]][rows]
            new, turn = [], []
            for e in range(most + 1):
                x = (bits[e] << one) & m
                if e:
                    x |= bits[e - 1] | (bits[e - 1] << one) | (new[e - 1] << one) | (turned[e - 1] & (m << one))
                x &= full[rows]
                new.append(x)
                turn.append((bits[e] << two) & m)
            alive = new[most] != 0
            if not alive.all():
                pick = np.flatnonzero(alive)
                if not len(pick):
                    continue
                stack.append((child, depth + 1, rows[pick], [x[pick] for x in new], [x[pick] for x in turn], None))
            else:
                stack.append((child, depth + 1, rows, new, turn, None))


def _search_long(trie: Trie, value: str, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(label_id, kind, errors, path length) for one value of any length: the same automaton with its bits in one long integer."""
    masks: dict[str, int] = {}
    for p, c in enumerate(value):
        masks[c] = masks.get(c, 0) | 1 << (p + 1)
    end = 1 << len(value)
    full = (end << 1) - 1
    stack = [(0, 0, [((1 << (r + 1)) - 1) & full for r in range(most + 1)], [0] * (most + 1))]
    while stack:
        node, depth, bits, turned = stack.pop()
        for label_id, kind in trie.nodes[node].ends:
            errors = next((e for e in range(min(most, allowed(depth)) + 1) if bits[e] & end), None)
            if errors is not None:
                yield label_id, kind, errors, depth
        for c, child in trie.nodes[node].next.items():
            m = masks.get(c, 0)
            new: list[int] = []
            for e in range(most + 1):
                x = (bits[e] << 1) & m
                if e:
                    x |= bits[e - 1] | (bits[e - 1] << 1) | (new[e - 1] << 1) | (turned[e - 1] & (m << 1))
                new.append(x & full)
            if new[most]:
                stack.append((child, depth + 1, new, [(x << 2) & m for x in bits]))


def word_costs(value: str, path: str) -> list[tuple[int, float]]:
    """(length, cost) of each word of the path in the cheapest alignment of the squashed value with it.

    A look-alike costs half an edit, a swap of neighbours one.
    """
    a = squash(value)
    b, word = "", []
    sizes = [len(x) for x in map(squash, path.split()) if x]
    for k, x in enumerate(x for x in map(squash, path.split()) if x):
        b += x
        word += [k] * len(x)
    m, n = len(a), len(b)
    like_a, like_b = a.translate(LOOKALIKES), b.translate(LOOKALIKES)
    table = [[float(j) for j in range(n + 1)]] + [[float(i)] + [0.0] * n for i in range(1, m + 1)]
    for i in range(1, m + 1):
        x, u, row, up = a[i - 1], like_a[i - 1], table[i], table[i - 1]
        for j in range(1, n + 1):
            y = b[j - 1]
            best = up[j - 1] + (0 if x == y else 0.5 if u == like_b[j - 1] else 1)
            if up[j] + 1 < best:
                best = up[j] + 1
            if row[j - 1] + 1 < best:
                best = row[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and table[i - 2][j - 2] + 1 < best:
                best = table[i - 2][j - 2] + 1
            for group in _GROUPS.get(y, ()):
                g = len(group)
                if i >= g and a[i - g : i] == group:
                    best = min(best, table[i - g][j - 1] + 0.5)
            for group in _GROUPS.get(x, ()):
                g = len(group)
                if j >= g and b[j - g : j] == group:
                    best = min(best, up[j - g] + 0.5)
            row[j] = best
    cost = [0.0] * len(sizes)
    i, j = m, n
    while i or j:
        here = table[i][j]
        if i and j and table[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else 0.5 if like_a[i - 1] == like_b[j - 1] else 1) == here:
            cost[word[j - 1]] += here - table[i - 1][j - 1]  # the first of equal moves
            i, j = i - 1, j - 1
            continue
        moves = [(di, dj) for di, dj in ((1, 1), (2, 2), (2, 1), (1, 2), (3, 1), (1, 3), (1, 0), (0, 1)) if i >= di and j >= dj]
        di, dj = min(moves, key=lambda d: (table[i - d[0]][j - d[1]] + _move(a, b, i, j, *d), d[0] + d[1] < 2))
        cost[word[max(j - 1, 0)]] += here - table[i - di][j - dj]
        i, j = i - di, j - dj
    return list(zip(sizes, cost))


def _move(a: str, b: str, i: int, j: int, di: int, dj: int) -> float:
    x, y = a[i - di : i], b[j - dj : j]
    if (di, dj) == (1, 1):
        return 0 if x == y else 0.5 if x.translate(LOOKALIKES) == y.translate(LOOKALIKES) else 1
    if (di, dj) == (2, 2):
        return 1 if x == y[::-1] else 99
    if di + dj > 2:
        return 0.5 if (x, y) in LIGATURES or (y, x) in LIGATURES else 99
    return 1


def plausible(costs: list[tuple[int, float]]) -> bool:
    """No word of the path may be as good as replaced: at most 45 % of its letters, two edits for the shortest."""
    return all(cost <= max(2.0, 0.45 * size) for size, cost in costs)


#: A path within distance: number of the value's reading, label_id, kind, length, errors, and the path's forms with words kept apart.
Hit = tuple[int, int, int, int, int, list[str]]


def find_hits(trie: Trie, labels: list[str]) -> list[list[Hit]]:
    """For each label all paths of the trie within distance of one of its readings, the fewest errors of each."""
    forms: dict[str, int] = {}
    of: list[list[int]] = []
    raw: list[str] = []
    for label in labels:
        mine = []
        for s in readings(label, trie.leads, trie.trails):
            if s not in forms:
                forms[s] = len(raw)
                raw.append(s)
            mine.append(forms[s])
        of.append(mine)
    found: list[dict[tuple[int, int, int], int]] = [{} for _ in raw]
    ways = [fold(squash(s)) for s in raw] + [fold_words(s) for s in raw] + [plain_fold(s) for s in raw]
    distinct = list(dict.fromkeys(ways))
    users: dict[str, list[int]] = {}
    for k, way in enumerate(ways):
        users.setdefault(way, []).append(k % len(raw))
    for v, label_id, kind, errors, depth in search(trie, distinct):
        key = (label_id, kind, depth)
        for k in users[distinct[v]]:
            found[k][key] = min(errors, found[k].get(key, 99))
    return [[(rank, *key, errors, trie.paths[key[0], key[1], key[2]]) for rank, k in enumerate(mine) for key, errors in found[k].items()] for mine in of]


def choose(label: str, hits: list[Hit], leads: list = (), trails: list = ()) -> list[tuple[int, int, int, float | None]]:
    """The entries of all hits as (label_id, errors, kind of path, cost): those that the label may name, the best first, then the rest without a cost.

    Kinds: 0 the name, 1 an alias, 2 another order or short form, 3 cut off.
    """
    if not hits:
        return []
    raw = readings(label, leads, trails)
    best: dict[int, tuple] = {}
    least = min(h[4] for h in hits)
    for rank in sorted({h[0] for h in hits}):
        mine = [h for h in hits if h[0] == rank]
        several = len({h[1] for h in mine}) > 1
        settled: set[int] = set()
        for _, label_id, kind, depth, errors, paths in sorted(mine, key=lambda h: (h[4] + 0.5 * (h[2] == 3), h[2], -h[3], h[1])):
            if label_id in settled or errors > least + 2 and best:
                continue
            exact = float(errors)
            if errors >= 2 or errors and several:
                costs = min((word_costs(raw[rank], p) for p in paths), key=lambda c: sum(x for _, x in c))
                if not plausible(costs):
                    continue
                exact = sum(x for _, x in costs)
            settled.add(label_id)
            score = (exact + 0.5 * (kind == 3), kind, rank, -depth, errors)
            if label_id not in best or score < best[label_id]:
                best[label_id] = score
    named = [(label_id, score[4], score[1], score[0]) for label_id, score in sorted(best.items(), key=lambda x: (x[1], x[0]))]
    rest: dict[int, tuple[int, int]] = {}
    for _, label_id, kind, _, errors, _ in hits:
        if label_id not in best:
            rest[label_id] = min(rest.get(label_id, (99, 99)), (errors, kind))
    return named + [(label_id, errors, kind, None) for label_id, (errors, kind) in sorted(rest.items(), key=lambda x: (x[1], x[0]))]


def match_labels(trie: Trie, labels: list[str]) -> list[list[tuple[int, int, int, float | None]]]:
    """choose() for each label over all hits of one trie."""
    return [choose(label, hits, trie.leads, trie.trails) for label, hits in zip(labels, find_hits(trie, labels))]


_MATCHES = pa.schema([("value", pa.string()), ("label_id", pa.int64()), ("errors", pa.int32()), ("cost", pa.float64()), ("candidates", pa.list_(pa.int64()))])
_HITS_TYPE = pa.list_(pa.struct([("reading", pa.int32()), ("label_id", pa.int64()), ("kind", pa.int32()), ("depth", pa.int32()), ("errors", pa.int32()), ("paths", pa.list_(pa.string()))]))
_HITS_SQL = "array<struct<reading int, label_id long, kind int, depth int, errors int, paths array<string>>>"


def _answer(chosen: list[tuple[int, int, int, float | None]]) -> tuple:
    """label_id, errors, cost, candidates; without an entry that the value may name label_id and errors are -1."""
    first = chosen[0] if chosen and chosen[0][3] is not None else (-1, -1, 0, None)
    return first[0], first[1], first[3], [c[0] for c in chosen]


_MATCHES_SQL = "value string, label_id long, errors int, cost double, candidates array<long>"


def _batched(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    waiting: list[tuple] = []
    for b in batches:
        waiting += zip(*(c.to_pylist() for c in b.columns))
        if len(waiting) >= size:
            yield waiting
            waiting = []
    if waiting:
        yield waiting


def _map_values(trie_b, batch: int):
    """Chooses at once: for a reference list of one block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_b.value
        for rows in _batched(batches, batch):
            values = [v for v, in rows]
            columns = list(zip(*((v, *_answer(got)) for v, got in zip(values, match_labels(trie, values)))))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _MATCHES)], schema=_MATCHES)

    return run


def _hit_values(trie_b, batch: int):
    """The hits of one block's entries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_b.value
        names = ("reading", "label_id", "kind", "depth", "errors", "paths")
        for rows in _batched(batches, batch):
            values = [v for v, in rows]
            kept = [(v, hits) for v, hits in zip(values, find_hits(trie, values)) if hits]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in kept], pa.string()), pa.array([[dict(zip(names, h)) for h in hits] for _, hits in kept], _HITS_TYPE)], names=["value", "hits"])

    return run


def _choose_values(leads: list, trails: list):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batched(batches, 10_000):
            columns = list(zip(*((v, *_answer(choose(v, [tuple(h.values()) for part in parts for h in part], leads, trails))) for v, parts in rows)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _MATCHES)], schema=_MATCHES)

    return run


def map_to_entries(values: DataFrame, reference: DataFrame, id_col: str = "mapping_id", value_col: str = "label", wording: Wording = Wording(), most_entries: int = 100_000, block: int = 2_000, batch: int = 20_000) -> DataFrame:
    """id, label_id (-1: none), errors (-1: none), cost (null: none) and candidates of each value.

    `candidates` are all entries within distance: first those that the value may
    name, the best first, then those ruled out because a word of theirs would be
    as good as replaced. label_id is the first, if it isn't ruled out.

    Null and blank values give no row; each id counts once (re-delivered rows
    are equal; of unequal ones the alphabetically first value stands); a null id
    is dropped. Values may be of any length. Entries with a null id or a null or
    blank name are ignored, null aliases too; of equally near entries the
    smallest label_id comes first.

    The driver reads the reference list, `most_entries` at most (else it
    raises), and broadcasts a trie of `block` entries at a time; hits of several
    blocks are brought together before one is chosen, so blocks change nothing.
    """
    spark = values.sparkSession
    entries = sorted(((r[0], r[1], list(r[2] or ())) for r in reference.filter("label_id is not null and trim(canonical) <> ''").select("label_id", "canonical", "aliases").distinct().limit(most_entries + 1).collect()), key=lambda e: (e[0], e[1]))
    if len(entries) > most_entries:
        raise ValueError(f"the reference list has more than {most_entries} entries")
    source = values.select(F.col(id_col).cast("long").alias("id"), F.col(value_col).alias("value")).filter(F.col("id").isNotNull() & F.col("value").rlike(r"[^\s\p{Z}]"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = store(source.groupBy("id").agg(F.min("value").alias("value")), "values")
    # each value is matched once, however many rows have it; dealt explicitly (by a hash, as the plain key would be
    # merged with the shuffle before it and then coalesced), as that takes far more time than its few bytes suggest
    distinct = once.select("value").distinct().repartition(tasks, F.xxhash64("value"))
    prefixes = known_prefixes(entries, wording)
    tries = [Trie(entries[k : k + block], prefixes, wording) for k in range(0, max(1, len(entries)), block)]
    if len(tries) == 1:
        chosen = distinct.mapInArrow(_map_values(spark.sparkContext.broadcast(tries[0]), batch), _MATCHES_SQL)
    else:
        distinct = store(distinct, "values")
        every = None
        for trie in tries:
            part = distinct.mapInArrow(_hit_values(spark.sparkContext.broadcast(trie), batch), f"value string, hits {_HITS_SQL}")
            every = part if every is None else every.unionByName(part)
        together = every.groupBy("value").agg(F.collect_list("hits").alias("hits"))  # as many as there are blocks with hits
        chosen = together.mapInArrow(_choose_values(tries[0].leads, tries[0].trails), _MATCHES_SQL)
    named = once.join(chosen.filter("label_id >= 0 or size(candidates) > 0"), "value", "left")
    return named.select("id", F.coalesce("label_id", F.lit(-1)).alias("label_id"), F.coalesce("errors", F.lit(-1)).alias("errors"), "cost", F.coalesce("candidates", F.array().cast("array<long>")).alias("candidates"))


def unmatched_values(values: DataFrame, reference: DataFrame, **options) -> DataFrame:
    """The report of values without an entry: value, records."""
    value_col = options.get("value_col", "label")
    id_col = options.get("id_col", "mapping_id")
    none = map_to_entries(values, reference, **options).filter("label_id = -1").select(F.col("id").alias("_id"))
    return values.select(F.col(id_col).alias("_id"), F.col(value_col).alias("value")).groupBy("_id").agg(F.min("value").alias("value")).join(none, "_id", "left_semi").groupBy("value").agg(F.count("*").alias("records"))
