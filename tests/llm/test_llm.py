"""Operators of the llm subpackage against brute force, exact round trips and held-out labels."""

import collections
import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import canonical as ca
from quillgrid.llm import leak as lk
from quillgrid.llm import packing as pk
from quillgrid.llm import quantiles as qu
from quillgrid.llm import queries as q
from quillgrid.llm import reading as rd
from quillgrid.llm import terms as te
from tests.compare import check

T = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    check(spark, duck, q.queries()[name], q.oracle_sql()[name], sf_dir)


# packing


def test_best_fit_never_overfills_and_is_fixed():
    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.randrange(0, 101) for _ in range(rng.randrange(0, 60))]
        where, fill = pk.best_fit(sizes, 100)
        sums = collections.Counter()
        for s, b in zip(sizes, where):
            sums[b] += s
        assert all(sums[b] == f <= 100 for b, f in enumerate(fill))
        assert len(fill) <= max(1, math.ceil(sum(sizes) / 100) * 11 // 9 + 1)
        assert (where, fill) == pk.best_fit(list(sizes), 100)


def test_packing_places_every_token_once(spark):
    rng = random.Random(7)
    texts = ["word " * rng.randrange(0, 60) for _ in range(300)] + ["word " * 1000, "", None, "x" * 5000]
    df = spark.createDataFrame([(k, s, "t", 1) for k, s in enumerate(texts)], "doc_id long, text string, tokens string, bin int").repartition(5)
    got = pk.pack(df, capacity=64, items_per_task=40).collect()
    encode = pk.encoder(pk.VOCABULARY).encode_ordinary
    want = {k: len(encode(s)) if s else 0 for k, s in enumerate(texts)}
    have, fill = collections.Counter(), collections.Counter()
    for r in got:
        have[r.doc_id] += r.tokens
        fill[r.container] += r.tokens
    assert {r.doc_id for r in got} == set(want) and all(have[k] == n for k, n in want.items())
    assert all(f <= 64 for f in fill.values()) and all(fill[r.container] == r.container_tokens for r in got)
    assert {r.doc_id for r in got if r.pieces > 1} == {k for k, n in want.items() if n > 64}
    assert len(fill) <= sum(fill.values()) / 64 * 1.05 + 2


def test_packing_of_nothing_and_of_unmergeable_items(spark):
    assert pk.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(k, "word " * 40) for k in range(50)], "doc_id long, text string").repartition(5)
    got = pk.pack(df, capacity=64).collect()
    assert len({r.container for r in got}) == 50


@pytest.mark.parametrize("options", [{}, {"items_per_task": 7}, {"items_per_task": 5, "most_items": 9}])
def test_packing_merges_down_to_one_half_full_container(spark, options):
    rng = random.Random(13)
    df = spark.createDataFrame([(k, "word " * rng.choice([3, 9, 20, 33, 40])) for k in range(400)], "doc_id long, text string").repartition(12)
    got = pk.pack(df, capacity=64, **options)
    fill = {r.container: r.container_tokens for r in got.collect()}
    assert sum(r.tokens for r in got.collect()) == sum(fill.values()) and max(fill.values()) <= 64
    assert sum(f <= 32 for f in fill.values()) <= 1
    report = pk.fill_report(got, 64).first()
    assert report.containers == len(fill) and report.fewest == -(-sum(fill.values()) // 64) and 0.7 < report.fill <= 1


def test_test_tables_are_packed_tightly(spark):
    report = q.p6_fill(spark, "/root/testdata/sf0.01").first()
    assert report.fill > 0.99 and report.containers <= report.fewest + 3


# leaks

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "pa", "re", "si") for b in ("d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v")]


def _prose(rng, n):
    return [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]


def _ids(text):
    return np.array([ord(c) for c in text])


def _most(item, part, edits):
    """stretch() by plain recursion over (item, part, edits left) from every start."""
    memo = {}

    def go(i, j, e):
        if i == len(item) or j == len(part):
            return 0
        if (i, j, e) not in memo:
            best = 0
            if item[i] == part[j]:
                best = 1 + go(i + 1, j + 1, e)
            if e:
                best = max(best, go(i + 1, j + 1, e - 1), go(i + 1, j, e - 1), go(i, j + 1, e - 1))
            memo[i, j, e] = best
        return memo[i, j, e]

    return max((go(i, j, edits) for i in range(len(item)) for j in range(len(part))), default=0)


def test_stretch_equals_recursion():
    rng = random.Random(4)
    for _ in range(150):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        for edits in (0, 1, 3):
            assert lk.stretch(_ids(a), _ids(b), edits) == _most(a, b, edits)


def _noisy(rng, passage, edits, evenly):
    """20 words of an item with so many edits between them."""
    out = list(passage)
    for at in sorted(([4, 8, 12, 16] if evenly else sorted(rng.sample(range(1, 20), edits)))[:edits], reverse=True):
        kind = rng.randrange(3) if not evenly else 0
        out[at:at] = ["zz"] if kind < 2 else ["zz", "yy"][: 1]
    return out


def test_no_leak_is_lost_against_brute_force(spark):
    rng = random.Random(5)
    words_ = [f"w{k}" for k in range(60)]
    items = [(i, "s", " ".join(rng.choice(words_) for _ in range(rng.choice([20, 24, 40, 70])))) for i in range(12)]
    docs = []
    for d in range(150):
        own = items[d % 12][2].split()
        a = rng.randrange(0, len(own) - 19)
        take = own[a : a + 20 + (d % 5)]
        body = _noisy(rng, take, d % 6, d % 3 == 0)
        if d % 7 == 0 and len(body) > 12:
            body[10] = "xx"
        around = [rng.choice(words_) for _ in range(30)]
        docs.append((d, " ".join(around[:15] + body + around[15:])))
    wanted = set()
    for d, text in docs:
        t = text.split()
        for i, _, body in items:
            ids = {}
            x, y = (np.array([ids.setdefault(w, len(ids)) for w in u]) for u in (body.split(), t))
            if lk.stretch(x, y, 4) >= 20:
                wanted.add((d, i))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, suite string, text string")
    for options in ({}, {"prefix_hits": 1}, {"shingle": 3}, {"block_chars": 400, "most_words": 300}):
        assert {(r.doc_id, r.item_id) for r in lk.leaks(df, it, **options).collect()} == wanted
    assert len(wanted) > 80
    with pytest.raises(ValueError):
        lk.leaks(df, it, shingle=5)


def test_an_edit_after_every_fourth_word_is_found(spark):
    rng = random.Random(7)
    items = [(i, "s", " ".join(_prose(rng, 60))) for i in range(10)]
    docs = [(i, " ".join(_prose(rng, 30) + _noisy(rng, t.split()[8:28], 4, True) + _prose(rng, 30))) for i, _, t in items]
    got = lk.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, suite string, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} >= {(i, i) for i in range(10)}


def test_prefixes_are_well_under_half(sf_dir):
    rng = random.Random(9)
    block = [(i, _prose(rng, 100)) for i in range(40)]
    index = lk.Index(block, 2)
    gen = np.random.default_rng(2)
    chosen = lk.necessary(index, gen.zipf(1.6, len(index.distinct)), 20, 4, 15, 2)
    assert len(chosen) < 0.48 * sum(len(h) for h in index.hashes)
    places = {}
    for _, k, p in chosen:
        places.setdefault(k, set()).add(p)
    for k, p in enumerate(index.places):
        for a in range(len(index.words[k]) - 23):
            window = [x for x in p if a <= x < a + 23]
            assert sum(x not in places[k] for x in window) <= 13


def test_leaks_are_found_whatever_the_layout(spark):
    rng = random.Random(11)
    shared = _prose(rng, 15)
    items, own = [], {}
    for i in range(6):
        own[i] = _prose(rng, 60)
        items.append((i, "s", " ".join(shared) + "\n\n" + " ".join(own[i])))
    items += [(7, "s", items[0][2]), (8, None, None), (9, None, ""), (10, None, " ".join(shared))]

    def wrap(words, mark):
        return "\n".join(mark + " ".join(words[k : k + 8]) for k in range(0, len(words), 8))

    noisy = list(own[2][5:40])
    noisy[8], noisy[20] = "changed", "changed"
    del noisy[30]
    head = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n"
    docs = [
        (1, "subject\n\n" + " ".join(_prose(rng, 40)) + "\n> " + " ".join(own[0][:25]).upper()),
        (2, "s\n\n" + head + wrap(own[1][10:35], "+").replace("\n", "\n- " + " ".join(_prose(rng, 4)) + "\n")),
        (3, "s\n\n" + head + '+  "prompt": "' + "\\n".join(" ".join(noisy[k : k + 5]) for k in range(0, len(noisy), 5)) + '"'),
        (4, " ".join(own[3][:12]) + " " + " ".join(_prose(rng, 30)) + " " + " ".join(own[3][30:42])),  # two short pieces
        (5, " ".join(shared) + " " + " ".join(_prose(rng, 30))),  # the instruction only
        (6, " ".join(_prose(rng, 200)) + " " + " ".join(own[4][:21]) + " " + " ".join(_prose(rng, 50)) + " " + " ".join(own[5][20:45])),
        (7, None),
        (8, ""),
    ]
    df = spark.createDataFrame([(d, s, 1) for d, s in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame(items, "item_id long, suite string, text string")
    got = {(r.doc_id, r.item_id) for r in lk.leaks(df.unionAll(df), it).collect()}
    assert got == {(1, 0), (1, 7), (2, 1), (3, 2), (6, 4), (6, 5)}
    assert {(r.doc_id, r.item_id) for r in lk.leaks(df, it, block_chars=900).collect()} == got
    assert lk.leaks(df.limit(0), it).count() == 0 and lk.leaks(df, it.limit(0)).count() == 0


# reading level


@pytest.mark.parametrize(
    "message",
    [
        "commit 0123456789abcdef\nAuthor: A B <a@b>\n\n    the subject\n\n    One line here\n    goes on.\n\n    - A point.\n\n    > quoted text\n\n    ```\n    x = 1\n    ```\n\n        at f (g:1)\n\n    Signed-off-by: A <a@b>\n",
        "From 0123456789abcdef Mon Sep 17 00:00:00 2001\r\nFrom: A <a@b>\r\nSubject: [PATCH] the\r\n subject\r\n\r\nOne line here\r\ngoes on.\r\n\r\n- A point.\r\n\r\nFixes: #1\r\n---\r\nnot this\r\n",
        "the subject\n\nOne line here\ngoes on.\n\n* A point.\n\nTraceback (most recent call last):\n# Conflicts:\n#\tx.py\nChanged files: 2\n",
    ],
)
def test_prose_of_each_layout(message):
    assert rd.prose(message) == ["One line here goes on.", "A point."]


def test_prose_edges():
    assert rd.prose("") == rd.prose("subject only") == rd.prose("\n") == []
    assert rd.syllables("table") == 2 and rd.syllables("make") == 1 and rd.syllables("the") == 1 and rd.syllables("xyz") == 1


def _document(level, rng):
    short, long_ = "cat dog map list tree bug run fix page".split(), "configuration availability serialization reproducibility".split()
    out = []
    while sum(len(s.split()) for s in out) < 60:
        n = {1: 5, 2: 16, 3: 12, 4: 24}[level]
        body = [rng.choice(long_ if level == 4 and rng.random() < 0.25 or level == 3 and rng.random() < 0.2 else short) for _ in range(n - 2)]
        out.append("the " + " ".join(body) + " was.")
    return "subject\n\n" + " ".join(out)


def test_levels_follow_the_scale_and_survive_bad_labels(spark):
    rng = random.Random(6)
    docs = [(k, _document(k % 4 + 1, rng), "en") for k in range(120)] + [(900, None, None), (901, "", None), (902, "s\n\ntoo short.", None), (903, "s\n\n" + "der Hund und die Katze ist nicht hier. " * 12, "de"), (None, _document(1, rng), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, words string")
    none = spark.createDataFrame([], "doc_id long, reader string, reading_level int")
    plain = {r.doc_id: r for r in rd.reading_levels(df, none).collect()}
    assert set(plain) == set(range(120)) and len({r.reading_level for r in plain.values()}) == 4
    assert all(r.reading_level == sum(r.level > b for b in rd.BOUNDS) + 1 for r in plain.values())
    clear = {k for k, r in plain.items() if all(abs(r.level - b) > 1 for b in rd.BOUNDS)}
    # every tenth rating errs, some can't be used
    labels = [(k, f"r{r}", min(4, plain[k].reading_level + (rng.random() < 0.1))) for k in sorted(clear) if k < 60 for r in range(2)] + [(1, "r9", None), (2, "r9", 77), (5555, "r1", 2)]
    got = {r.doc_id: r.reading_level for r in rd.reading_levels(df, spark.createDataFrame(labels, none.schema)).collect()}
    assert set(got) == set(plain) and all(got[k] == plain[k].reading_level for k in clear)
    assert rd.reading_levels(df.limit(0), none).count() == 0


def test_held_out_ratings_agree(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "reading_labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = rd.reading_levels(docs, labels.filter(~held)).join(labels.filter(held).withColumnRenamed("reading_level", "said"), "doc_id").filter("said is not null").select("said", "reading_level").collect()
    assert len(got) > 20 and sum(a == b for a, b in got) >= 0.85 * len(got)


def test_steps_reach_the_greatest_likelihood():
    gen = np.random.default_rng(3)
    difficulty, ease = gen.normal(size=30), gen.normal(size=30)
    at = lambda t: np.exp(ease + difficulty * t)
    spread = np.log(np.array([at(t).sum() for t in rd.GRID]))
    true = np.linspace(-2, 2, 400)
    counts = np.array([gen.multinomial(80, at(t) / at(t).sum()) for t in true])
    found = rd.solve_levels(counts @ difficulty, np.full(400, 80.0), np.zeros(400), np.stack([spread, spread]))
    fine = np.linspace(-6, 6, 2401)
    best = [fine[np.argmax(c @ difficulty * fine - 80 * np.interp(fine, rd.GRID, spread) - fine**2 / 2)] for c in counts]
    assert np.abs(found - best).max() < 0.03 and np.corrcoef(found, true)[0, 1] > 0.97
    exposure = np.log(np.array([80.0 * np.exp(-s) * (np.abs(true - t) <= 0.025).sum() + 1e-9 for t, s in zip(rd.GRID, spread)]))
    _, b = rd.solve_difficulties(counts.sum(0).astype(float), true @ counts, np.tile(exposure, (30, 1)), np.zeros(30), 5.0)
    assert np.abs(b - difficulty).max() < 0.25


def test_ratings_turn_the_scale_round(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(k, _document(k % 4 + 1, rng), None) for k in range(120)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, reader string, reading_level int")
    plain = {r.doc_id: r.reading_level for r in rd.reading_levels(df, none).collect()}
    flipped = spark.createDataFrame([(k, "r", 5 - v) for k, v in plain.items() if k < 80], none.schema)
    got = {r.doc_id: r.reading_level for r in rd.reading_levels(df, flipped).collect()}
    assert sum(got[k] == 5 - v for k, v in plain.items()) >= 0.9 * len(plain)


# mapping to a list


def test_automaton_equals_dynamic_programming():
    rng = random.Random(9)
    paths = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 14))) for _ in range(25)]
    trie = ca.Trie([])
    for k, p in enumerate(paths):
        trie._add(p, k, 0)
    values = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 15))) for _ in range(60)] + paths[:3] + ["a" * 63, ""]

    def osa(a, b):
        d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    got = {(v, k): e for v, k, _, e, _ in ca.search(trie, values)}
    want = {(v, k): osa(values[v], p) for v in range(len(values)) for k, p in enumerate(paths) if 0 < len(values[v]) <= 62 and osa(values[v], p) <= ca.allowed(len(p))}
    assert got == want


REFERENCE = [(1, "Father's Name", []), (2, "Mother's Name", []), (3, "Roll Number", ["Roll no"]), (4, "Place of Signing", ["Signed at"]), (5, "Percentage of Marks", ["Marks %", None]), (6, "Bank Account Number", ["Bank a/c no"]), (7, None, ["x"]), (8, "", None)]


@pytest.mark.parametrize(
    "label, entry",
    [
        ("Father's Name", 1), ("3) FATHER'S NAME ......", 1), ("fotber's narne :", 1), ("Name of Father", 1), ("Name (Mother)", 2), ("ROLL #", 3), ("Rol1 Nunber *", 3), ("R O L L N U M B E R", 3), ("%age of marks", 5),
        ("Please state Roll Number", 3), ("Bank Acct No.", 6), ("Bank Account Num", 6), ("Place of Landing", -1), ("Bank of River", -1), ("12/04/1999", -1), ("Osked Olmonter", -1), ("--", -1), ("x" * 5000, -1), ("Rôll Nümber", 3),
    ],
)
def test_labels_name_entries(label, entry):
    trie = ca.Trie([(i, c, a or []) for i, c, a in REFERENCE if c], wording=q.FORMS)
    assert ca._answer(ca.match_labels(trie, [label])[0])[0] == entry


def test_wording_is_optional():
    entries = [(i, c, a or []) for i, c, a in REFERENCE if c]
    plain, worded = ca.Trie(entries), ca.Trie(entries, wording=q.FORMS)
    first = lambda trie, label: ca._answer(ca.match_labels(trie, [label])[0])[0]
    assert first(plain, "fotber's narne :") == 1 and first(plain, "Name of Father") == -1 and first(worded, "Name of Father") == 1


def test_long_values_are_searched_like_short_ones(spark):
    rng = random.Random(2)
    paths = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 14))) for _ in range(25)]
    trie = ca.Trie([])
    for k, p in enumerate(paths):
        trie._add(p, k, 0)
    for v in ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 15))) for _ in range(40)]:
        assert sorted(h[1:] for h in ca.search(trie, [v])) == sorted(ca._search_long(trie, v, 5))
    name = " ".join("".join(rng.choice("defgkmnprstuw") for _ in range(9)) for _ in range(11))
    near = name[:50] + ("x" if name[50] != "x" else "y") + name[51:]
    ref = spark.createDataFrame([(1, name, None), (2, "Roll Number", None)], "label_id long, canonical string, aliases array<string>")
    df = spark.createDataFrame([(1, name), (2, near), (3, name + " and quite some more of it")], "mapping_id long, label string")
    assert {(r.id, r.label_id, r.errors) for r in ca.map_to_entries(df, ref).collect()} == {(1, 1, 0), (2, 1, 1), (3, -1, -1)}


def test_candidates_are_all_entries_within_distance_whatever_the_blocks(spark):
    rng = random.Random(12)
    names = sorted({" ".join(rng.choice(["roll", "rolls", "poll", "tall", "note", "notes", "name", "names"]) for _ in range(2)) for _ in range(60)})
    entries = [(i, n, []) for i, n in enumerate(names)]
    values = [(i, "".join(c for c in rng.choice(names) if rng.random() > 0.1)) for i in range(80)]
    trie = ca.Trie(entries)
    for _, v in values:
        reach = {hit[1] for hits in ca.find_hits(trie, [v]) for hit in hits}
        assert {c[0] for c in ca.match_labels(trie, [v])[0]} == reach
    ref = spark.createDataFrame([(i, n, None) for i, n, _ in entries], "label_id long, canonical string, aliases array<string>")
    df = spark.createDataFrame(values, "mapping_id long, label string")
    whole = {tuple(map(str, r)) for r in ca.map_to_entries(df, ref).collect()}
    assert len(whole) == 80 and {tuple(map(str, r)) for r in ca.map_to_entries(df, ref, block=7).collect()} == whole


def test_mapping_edges(spark):
    ref = spark.createDataFrame([(*r, "s") for r in REFERENCE], "label_id long, canonical string, aliases array<string>, section string")
    rows = [(1, "Roll no", 9), (1, "Roll no", 9), (2, None, 9), (3, "  \t", 9), (4, "what else", 9), (None, "Roll no", 9)]
    df = spark.createDataFrame(rows, "mapping_id long, label string, label_id int")
    assert {(r.id, r.label_id) for r in ca.map_to_entries(df, ref).collect()} == {(1, 3), (4, -1)}
    assert {(r.id, r.label_id) for r in ca.map_to_entries(df, ref, block=2).collect()} == {(1, 3), (4, -1)}
    assert [tuple(r) for r in ca.unmatched_values(df, ref).collect()] == [("what else", 1)]
    assert ca.map_to_entries(df.limit(0), ref).count() == 0 and {r.label_id for r in ca.map_to_entries(df, ref.limit(0)).collect()} == {-1}
    with pytest.raises(ValueError):
        ca.map_to_entries(df, ref, most_entries=2)


# percentiles


@pytest.mark.parametrize("ranges", [1, 4])
def test_percentiles_equal_sorting(spark, ranges):
    rng = random.Random(8)
    rows = [("hot" if k % 3 else None, float(rng.randrange(50)) if k % 5 else None, 1) for k in range(900)] + [("one", -2.5, 1), ("hot", float("nan"), 1), ("hot", float("inf"), 1), ("none", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    half = [df.filter(F.pmod(F.xxhash64("v"), F.lit(2)) == k) for k in (0, 1)]
    counts = qu.merge_counts(*[qu.value_counts(h, ["g"], "v", 0) for h in half])
    got = {(r.g, r.pct): r.value for r in qu.percentiles(counts, ["g"], [0, 50, 99, 100], ranges).collect()}
    groups = collections.defaultdict(list)
    for g, v, _ in rows:
        if v is not None and math.isfinite(v):
            groups[g].append(v)
    want = {(g, p): sorted(v)[max(1, -(-p * len(v) // 100)) - 1] for g, v in groups.items() for p in (0, 50, 99, 100)}
    assert got == want


def test_grid_error_is_bounded(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1e-9, 0.37, 1.0, 12345.678, -4.2)], "v double").withColumn("g", qu.grid_value(F.col("v"), 0.001))
    assert all(abs(r.g - r.v) <= 0.00101 * abs(r.v) for r in df.collect())


def test_no_values_no_percentiles(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert qu.percentiles(qu.value_counts(df, ["g"], "v"), ["g"], [50]).count() == 0


# terms


@pytest.mark.parametrize("longest, deepest, most_cells", [(3, None, 2_000_000), (3, 1, 50), (None, None, 40), (1, None, 10)])
def test_ngrams_equal_counting(spark, longest, deepest, most_cells):
    rng = random.Random(10)
    rows = [("s", k, [rng.choice("abc") for _ in range(rng.randrange(0, 9))]) for k in range(150)] + [("t", 1, ["a"] * 60), ("t", 2, None), ("t", None, ["a"]), ("t", 3, []), ("t", 4, ["a", "", "b c"])]
    df = spark.createDataFrame(rows, "src string, record long, tokens array<string>")
    got = {(r.src, r.term, r.n): (r.occurrences, r.records) for r in te.term_counts(df, longest, deepest, most_cells).collect()}
    occ, rec = collections.Counter(), collections.defaultdict(set)
    for src, record, tokens in rows:
        for n in range(1, min(longest or 99, deepest or 99) + 1):
            for k in range(len(tokens or ()) - n + 1) if record is not None else ():
                key = (src, " ".join(tokens[k : k + n]), n)
                occ[key] += 1
                rec[key].add(record)
    assert got == {k: (c, len(rec[k])) for k, c in occ.items()}
    assert te.marked_terms(df.limit(0)).count() == 0


def test_least_between():
    rng = random.Random(3)
    v = np.array([rng.randrange(9) for _ in range(70)], np.int32)
    pairs = [(a, b) for a in range(69) for b in range(a + 1, 70)]
    got = te.least_between(v, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [v[a + 1 : b + 1].min() for a, b in pairs]


def test_text_records_take_the_latest_and_skip_blanks(spark):
    df = spark.createDataFrame([(1, "Old Text", T), (1, "New  TEXT-2 é", T + dt.timedelta(days=1)), (2, "  \t", T), (3, None, T), (None, "x", T)], "row_id long, text string, loaded_at timestamp_ntz")
    assert [(r.record, r.tokens) for r in te.text_records(df, "row_id", "text", "s", True).collect()] == [(1, ["new", "text", "2", "é"])]
    assert [r.tokens for r in te.text_records(df, "row_id", "text", "s", False).collect()] == [["new text-2 é"]]


@pytest.mark.parametrize("name", ["p4_found", "p4_phrases"])
def test_terms_sort_whole_suffixes(spark, sf_dir, monkeypatch, name):
    from quillgrid.llm import queries, terms

    seen, cut = [], terms.suffixes
    monkeypatch.setattr(terms, "suffixes", lambda records, longest: seen.append(longest) or cut(records, longest))
    queries.queries()[name](spark, sf_dir)
    assert seen == [None]
