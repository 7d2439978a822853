"""Consolidation, schema drift, JSON sources and streaming."""

import datetime as dt
import itertools
import json
import random

import numpy as np
import pytest

from quillgrid.operators import schemadrift as sd
from quillgrid.operators import smallfiles as sm
from quillgrid.sources import artifacts
from quillgrid.streaming.pages import each_batch, station_counts

T = dt.datetime(2024, 1, 1)
FILES = "file_id long, path string, run_id string, artifact string, attempt int, written_at timestamp_ntz, n_bytes long, payload string"


@pytest.mark.parametrize(
    "payload, found",
    [
        ('[{"item_idx": 0, "text": "a"}, {"item_idx": 1, "text": "b"', [0]),
        ('﻿{"item_idx": 3}\n{"item_idx": 4}\r\n', [3, 4]),
        ('{"records": [{"item_idx": 5, "o": {"p": 1}}, {"item_idx": 6, "o": {"p":', [5]),
        ('{"item_idx": 1, "text": "{\\"item_idx\\": 9}"}', [1]),
        ("null", []), ("", []), (None, []), ("[]", []), ('{"item_idx":', []), ('[[{"item_idx": 2}]]', [2]), ('{"item_idx": 0} garbage } {"item_idx": 1}', [0, 1]),
    ],
)
def test_complete_records(payload, found):
    assert [r["item_idx"] for r in sm.complete_records(payload)] == found


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    axes = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    codes = sm.hilbert_codes(axes, bits)
    assert sorted(codes) == list(range(len(axes)))
    along = axes[np.argsort(codes)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("ranges", [1, 3])
def test_cut_curve_parts_only_hot_codes(spark, ranges):
    sizes = {0: 10, 1: 85, 7: 250, 8: 5, 9: 60, 12: 60}
    cuts, n = sm.cut_curve(spark.createDataFrame(list(sizes.items()), "code long, bytes long"), 100, ranges)
    assert n == 5
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 4000)
    files = {c: sorted(set(cuts.file_of(np.full(4000, c), hashes).tolist())) for c in sizes}
    assert files == {0: [0], 1: [0], 7: [0, 1, 2, 3], 8: [3], 9: [3], 12: [4]}
    assert np.bincount(cuts.file_of(np.full(4000, 7), hashes))[[1, 2]] == pytest.approx(1600, rel=0.15)
    assert sm.cut_curve(spark.createDataFrame([], "code long, bytes long"), 100, ranges)[1] == 1


@pytest.mark.parametrize("same", [0.0, 0.9])
def test_files_share_at_most_one_code(spark, same):
    rng = random.Random(4)
    rows = []
    for k in range(1500):
        hot = rng.random() < same
        text = "same words" if hot else f"{rng.choice('abcdefghij')}{rng.random()}"
        at = T if hot else T + dt.timedelta(minutes=rng.randrange(5000))
        rows.append((k, "p", "run0" if hot else f"run{rng.randrange(40)}", "result", 1, at, 0, json.dumps([{"item_idx": k, "text": text}])))
    done = sm.consolidate(spark.createDataFrame(rows, FILES), file_bytes=8_000)
    got = [tuple(r) for r in done.table.selectExpr("input_file_name()", "code", "length(body) + 64").collect()]
    files, sizes = {}, {}
    for f, c, n in got:
        files.setdefault(f, set()).add(c)
        sizes[f] = sizes.get(f, 0) + n
    spans = sorted((min(c), max(c)) for c in files.values())
    assert len(got) == 1500 and len(spans) > 10
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert max(sizes.values()) < 1.6 * 8_000


def test_consolidation_keeps_every_record_once(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for k in range(200):
        run, idx = f"run{rng.randrange(9)}", rng.randrange(12)
        whole = rng.random() < 0.8
        body = json.dumps([{"item_idx": idx, "text": f"v{k}"}])
        at = T + dt.timedelta(minutes=rng.randrange(500))
        rows.append((k, "p", run, "result", 1, at, len(body), body if whole else body[:-4]))
        if whole and ((run, idx) not in want or (at, k) > want[run, idx][:2]):
            want[run, idx] = (at, k, f"v{k}")
    rows.append((999, "p", None, "result", 1, T, 0, '{"item_idx": 1}'))
    rows.append((998, "p", "run1", "mappings", 1, None, 0, '{"item_idx": 1, "label": null}'))
    df = spark.createDataFrame(rows, FILES)
    done = sm.consolidate(df, file_bytes=1000)
    got = done.table.collect()
    assert {(r.run_id, r.item_idx): r.name for r in got if r.artifact == "result"} == {k: v[2] for k, v in want.items()}
    assert len(got) == len(want) + 1 == done.rows and done.files > 3
    assert sm.consolidate(df.unionAll(df), file_bytes=1000).digest == done.digest


def test_consolidation_of_nothing(spark):
    assert sm.consolidate(spark.createDataFrame([], FILES)).rows == 0


def test_assignment_is_minimal():
    rng = random.Random(2)
    for _ in range(20):
        n = rng.randrange(1, 6)
        cost = [[rng.random() for _ in range(n)] for _ in range(n)]
        best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert sum(cost[i][j] for i, j in enumerate(sd.assign(cost))) == pytest.approx(best)


def _script(before, after):
    p = {}
    for rows in (before, after):
        for name, x in sd.profile(rows).items():
            p[name] = sd.merge_profiles(p[name], x) if name in p else x
    return set(sd.edit_script(sd.layout(before), sd.layout(after), p)[1])


def test_edit_scripts():
    old = [{"text": "a b", "confidence": 0.91, "center": [1.5, 2.5], "n_pages": 2}, {"text": "c", "confidence": 0.5, "center": [3.5, 2.5], "n_pages": 1}]
    assert _script(old, [{"value": "a b", "certainty": "91,5%", "center": {"x": 1.5, "y": 2.5}, "n_pages": 2}]) == {("text", "value", "renamed"), ("confidence", "certainty", "renamed"), ("confidence", "certainty", "retyped"), ("center", "center", "retyped")}
    assert _script(old, [{"text": "a", "confidence": 0.91, "center": [1.5, 2.5], "merged": 3}]) == {("n_pages", "", "removed"), ("", "merged", "added")}
    assert _script(old, [{"center": [9, 1], "n_pages": 7, "confidence": 0.3, "text": "z"}]) == set()
    assert _script([{"a": {"x": 1, "deep": "words here"}}], [{"a": {"x": 1}, "deep": "words here"}]) == {("a.deep", "deep", "moved")}


EXPORT = "export_id long, feed_id long, station string, exported_at timestamp_ntz, n_rows int, payload string"


def _exports(spark, *payloads, feed=1):
    return spark.createDataFrame([(100 - k, feed, "s", T + dt.timedelta(days=k), 1, p) for k, p in enumerate(payloads)], EXPORT)


def test_null_only_fields_keep_their_type_and_redelivery_counts_once(spark):
    df = _exports(spark, '[{"confidence": 0.5}]', '[{"confidence": null}]', '[{"confidence": 0.7}]', '[{"confidence": "0.7"}]', "broken", '[{"confidence": "0.9", "text": "x y"}]', None, "[]")
    df = df.unionAll(df.filter("export_id = 97"))
    for ranges in (1, 3):
        got = {tuple(r)[1:5] for r in sd.changes(df, ranges).collect()}
        assert got == {(97, "confidence", "confidence", "retyped"), (95, "", "text", "added")}
    assert sd.changes(_exports(spark)).count() == 0


def test_consistent_table(spark):
    df = _exports(spark, '[{"confidence": 0.5, "text": "a b"}]', '[{"conf": "60%", "text": "a b"}]', '[{"conf": {"value": 0.7}, "text": null}]', '[{"conf": "0,8"}]')
    assert [r.confidence for r in sd.consistent_table(df).orderBy("exported_at").collect()] == [0.5, 0.6, 0.7, 0.8]


def _least_cost(before, after, profiles):
    """The cost of the best matching by trying all, for one level of fields."""
    x, y = sd.nodes(before), sd.nodes(after)
    kept = {p for p in x if p in y and not sd._retyped(x[p], y[p])}
    gone, new = sorted(x.keys() - kept), sorted(y.keys() - kept)
    best = 1e9
    for r in range(min(len(gone), len(new)) + 1):
        for left in itertools.combinations(gone, r):
            for right in itertools.permutations(new, r):
                cost = sd.REMOVE * (len(gone) - r) + sd.ADD * (len(new) - r)
                for a, b in zip(left, right):
                    far = sd.value_distance(profiles.get(a[0]), profiles.get(b[0]))
                    c = 0.0 if a == b else 0.6 * far + 0.4 * sd.name_distance(a[0], b[0]) + 0.01
                    cost += (c if c < sd.RENAMED_BELOW else 99) + sd.RETYPE * sd._retyped(x[a], y[b])
                best = min(best, cost)
    return best


def test_scripts_are_of_least_cost():
    rng = random.Random(3)
    values = [0.5, 7, "a b", "x-1", [1, 2], [[1, 2], [3, 4]], True]
    for _ in range(60):
        before, after = ([{rng.choice(["conf", "confidence", "text", "label", "box", "n"]): rng.choice(values) for _ in range(3)} for _ in range(2)] for _ in range(2))
        p = {}
        for rows in (before, after):
            for name, x in sd.profile(rows).items():
                p[name] = sd.merge_profiles(p[name], x) if name in p else x
        x, y = sd.layout(before), sd.layout(after)
        assert sd.edit_script(x, y, p)[0] == pytest.approx(_least_cost(x, y, p))


def test_moves_and_nested_renames():
    assert _script([{"confidence": 0.5, "t": "a b"}], [{"ocr": {"confidence": 0.7}, "t": "a b"}]) == {("confidence", "ocr.confidence", "moved"), ("", "ocr", "added")}
    assert _script([{"a": {"score": 0.5, "n": 3}}], [{"a": {"certainty": 0.7, "n": 3}}]) == {("a.score", "a.certainty", "renamed")}
    assert _script([{"a": {"score": 0.5}}], [{"a": {"score": "0.5"}}]) == {("a.score", "a.score", "retyped")}
    assert _script([{"a.b": 0.5}], [{"a.b": "x y"}]) == {("a.b", "a.b", "retyped")}


def test_top_level_side_of_a_move_counts(spark):
    df = _exports(spark, '[{"confidence": 0.5, "t": "a b"}]', '[{"ocr": {"confidence": 0.7}, "t": "a b"}]', '[{"confidence": 0.7, "ocr": {"n": "z z"}, "t": "a b"}]')
    got = {tuple(r)[1:] for r in sd.top_level_changes(sd.changes(df)).collect()}
    assert got == {(99, "confidence", "", "removed"), (99, "", "ocr", "added"), (98, "", "confidence", "added")}


@pytest.mark.parametrize("ranges", [1, 3])
def test_every_readable_record_is_in_the_table(spark, ranges):
    df = _exports(spark, '[{"confidence": 0.5}, {}]', '﻿[{"conf": 0.6}]', '{"conf": 0.7}', '[{"conf": 0.8}, 7, null]', "broken", None, "[]", '[{"conf": 0.9, "confidence": "new words"}]')
    got = sd.consistent_table(df.unionAll(df), ranges=ranges).orderBy("exported_at", "row_no").collect()
    assert [r.confidence for r in got] == [0.5, None, 0.6, 0.7, 0.8, 0.9] and len(got) == sum(len(sd._records(r.payload)) for r in df.collect())
    # a field that takes the name which another one left is a quantity of its own
    assert got[-1].fields == {"confidence": "0.9", "confidence#2": "new words"} or got[-1].fields == {"conf": "0.9", "confidence": "new words"}


@pytest.mark.parametrize("ranges", [1, 4])
def test_values_follow_moves(spark, ranges):
    df = _exports(spark, '[{"confidence": 0.5, "t": "a b"}]', '[{"ocr": {"confidence": 0.7}, "t": "a b"}]', '[{"ocr": {"confidence": "80%"}, "t": null}]', '[{"certainty": {"value": 0.9}, "t": "c d"}]')
    got = sd.consistent_table(df, ranges=ranges).orderBy("exported_at").collect()
    assert [r.confidence for r in got][:3] == [0.5, 0.7, 0.8]
    assert [r.fields["t"] for r in got] == ["a b", "a b", None, "c d"]
    assert sd.consistent_table(df.limit(0)).count() == 0


def test_json_sources(spark, tmp_path):
    (tmp_path / "mappings.json").write_text('[{"label": "a", "field_line": {"start": [1, 2], "end": [3, 2]}, "distance": 4.5}, 7]')
    got = artifacts.upgraded_mappings(artifacts.json_array(spark, str(tmp_path / "mappings.json"), artifacts.MAPPING)).collect()
    assert len(got) == 1 and got[0].field_lines[0].end == [3, 2] and got[0].multiline_group_size == 1
    (tmp_path / "odd.json").write_text('{"label": "a"}')
    assert artifacts.json_array(spark, str(tmp_path / "odd.json"), artifacts.MAPPING).count() == 0
    with pytest.raises(Exception, match="JSON array"):
        artifacts.json_array(spark, str(tmp_path / "odd.json"), artifacts.MAPPING, strict=True).collect()
    (tmp_path / "manifest.json").write_text('{"name": "c", "baseline_sample_id": "s1", "samples": [{"id": "s1", "artifact_dir": "d"}, {"id": "", "artifact_dir": "e"}, {"id": "s3"}]}')
    assert [r.id for r in artifacts.manifest(spark, str(tmp_path / "manifest.json")).collect()] == ["s1"]
    assert artifacts.first_input(["image_2.pdf", "form.pdf"]) == "form.pdf" and artifacts.first_input([]) is None


def test_pluggable_recogniser(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"data")
    (tmp_path / "b.txt").write_bytes(b"data")
    square = [[0, 0], [1, 0], [1, 1], [0, 1]]
    got = artifacts.recognise(artifacts.uploads(spark, str(tmp_path)), lambda content: [(square, " hi ", 0.5), (square, "", None)]).collect()
    assert [(r.text, r.item_idx) for r in got] == [("hi", 0)]


def test_recogniser_is_loaded_where_it_runs(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"data")
    (tmp_path / "b.pdf").write_bytes(b"pages")
    (tmp_path / "c.pdf").write_bytes(b"broken")
    square = [[0, 0], [1, 0], [1, 1], [0, 1]]

    def convert(content):
        if content == b"broken":
            raise ValueError
        return b"first " + content

    files = artifacts.first_pages(artifacts.uploads(spark, str(tmp_path)), convert)
    got = artifacts.recognise(files, load=lambda: lambda content: [(square, content.decode(), 0.5)]).collect()
    assert sorted(r.text for r in got) == ["data", "first pages"]


def test_source_image_falls_back(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        artifacts.source_image(spark, str(tmp_path))
    for name in ("mapping.png", "converted_2.png", "converted_1.png", "given.png"):
        (tmp_path / name).write_bytes(b"x")
        want = {"mapping.png": "mapping.png", "converted_2.png": "converted_2.png"}.get(name, "converted_1.png")
        assert artifacts.source_image(spark, str(tmp_path)).endswith(want)
    assert artifacts.source_image(spark, str(tmp_path), str(tmp_path / "given.png")).endswith("given.png")
    assert artifacts.first_existing(spark, None, str(tmp_path / "none"), str(tmp_path / "given.png")).endswith("given.png")


def test_streaming_pages(spark, tmp_path, sf_dir):
    source = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/result_rows.parquet").repartition(3).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    each_batch(stream, lambda b: b.groupBy("station").count(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    total = spark.read.parquet(str(tmp_path / "out")).agg({"count": "sum"}).first()[0]
    assert total == spark.read.parquet(str(source)).count()
    q = station_counts(stream, late="3000 days").writeStream.format("memory").queryName("stations_seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from stations_seen").first()[0] == spark.read.parquet(str(source)).select("row_id").distinct().count()
