"""Schemas that drift between files: tree edit scripts between record layouts, compiled into projections.

Each file's layout is a small tree (fields, their types, the keys of nested
objects). Against the file before it in its feed a minimum-cost edit script is
found: fields of both trees are matched by least total cost, from the shape and
range of their values over the feed, their names, types and places; what stays
unmatched is removed or added. Followed through a feed, the scripts tell which
quantity each field of each file holds; that is the file's projection.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.session import store

#: Costs of one edit; a rename must cost less than a removal and an addition. Edits inside objects weigh NESTED.
REMOVE, ADD, RETYPE, MOVE, RENAMED_BELOW, NESTED, NEVER = 0.4, 0.4, 0.05, 0.2, 0.7, 0.1, 99.0
#: Between the keys of a nested field's path.
STEP = "\x1f"

_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_]+")
_NUMBER = re.compile(r"^\s*([-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?)\s*(%?)\s*$")
_CODE = re.compile(r"^[a-z]+[-_.]?\d*$")


def type_name(value) -> str | None:
    """JSON type, with arrays of numbers and of arrays apart; null has none."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    return "array of arrays" if any(isinstance(x, list) for x in value) else "array of numbers"


def numeric(value) -> float | None:
    """The number that a scalar, a formatted string or an object with a value stands for."""
    if isinstance(value, dict):
        return numeric(value.get("value"))
    if isinstance(value, bool) or value is None or isinstance(value, list):
        return None
    if isinstance(value, str):
        m = _NUMBER.match(value)
        if not m:
            return None
        x = float(m[1].replace(",", "."))
        return x / 100 if m[2] else x
    return float(value) if math.isfinite(value) else None


def shape(value) -> str | None:
    """What kind of quantity a value is, whatever its JSON type."""
    if value is None:
        return None
    if isinstance(value, list):
        return str(len(value))
    if isinstance(value, dict):
        if numeric(value) is not None:
            return "scalar"
        numbers = [x for x in value.values() if isinstance(x, (int, float))]
        return str(len(numbers)) if len(numbers) == len(value) and numbers else "object"
    if isinstance(value, bool):
        return "boolean"
    return "scalar" if numeric(value) is not None else "text"


def layout(records: list) -> dict:
    """Field name -> [type or None, nested layout]; the most frequent type stands, ties by name."""
    seen: dict[str, list] = {}
    for record in records:
        if isinstance(record, dict):
            for name, value in record.items():
                seen.setdefault(name, []).append(value)
    out = {}
    for name, values in sorted(seen.items()):
        types: dict[str, int] = {}
        for v in values:
            if (t := type_name(v)) is not None:
                types[t] = types.get(t, 0) + 1
        kind = min(types, key=lambda t: (-types[t], t)) if types else None
        out[name] = [kind, layout([v for v in values if isinstance(v, dict)]) if kind == "object" else {}]
    return out


def profile(records: list, at: str = "", out: dict[str, dict] | None = None) -> dict[str, dict]:
    """Per field, nested ones by their path: counts of shapes, range and whole numbers, code-like strings. Sums up over files."""
    out = {} if out is None else out
    for record in records:
        if not isinstance(record, dict):
            continue
        for key, value in record.items():
            name = at + key
            if isinstance(value, dict):
                profile([value], name + STEP, out)
            s = shape(value)
            if s is None:
                continue
            p = out.setdefault(name, {"shapes": {}, "low": math.inf, "high": -math.inf, "numbers": 0, "whole": 0, "codes": 0})
            p["shapes"][s] = p["shapes"].get(s, 0) + 1
            x = numeric(value)
            if x is not None:
                p["low"], p["high"] = min(p["low"], x), max(p["high"], x)
                p["numbers"] += 1
                p["whole"] += x == int(x)
            elif isinstance(value, str):
                p["codes"] += bool(_CODE.match(value))
    return out


def merge_profiles(a: dict, b: dict) -> dict:
    shapes = dict(a["shapes"])
    for k, v in b["shapes"].items():
        shapes[k] = shapes.get(k, 0) + v
    return {"shapes": shapes, "low": min(a["low"], b["low"]), "high": max(a["high"], b["high"]), **{k: a[k] + b[k] for k in ("numbers", "whole", "codes")}}


def name_distance(a: str, b: str) -> float:
    """0 for the same words, 1 for none in common; words match if equal or one begins the other or nearly so."""
    x, y = ([w.lower() for w in _CAMEL.findall(n)] or [n] for n in (a, b))

    def like(u: str, v: str) -> bool:
        short = min(len(u), len(v))
        return u == v or short >= 3 and (u.startswith(v) or v.startswith(u)) or short >= 5 and sorted(u) == sorted(v)

    hits = sum(any(like(u, v) for v in y) for u in x)
    return 1 - min(1.0, hits / min(len(x), len(y)))


def value_distance(a: dict | None, b: dict | None) -> float:
    """How unlike two fields' values are; 0.5 if one never had a value, high for small whole numbers, which prove little."""
    if not a or not b or not a["shapes"] or not b["shapes"]:
        return 0.5
    s, t = (max(p["shapes"], key=lambda k: (p["shapes"][k], k)) for p in (a, b))
    if s != t:
        return 1.0
    if s == "scalar":
        if not a["numbers"] or not b["numbers"]:
            return 0.5
        whole = [p["whole"] >= 0.95 * p["numbers"] for p in (a, b)]
        if all(whole):
            return 0.8
        if any(whole):
            return 0.9
        unit = [p["low"] >= 0 and p["high"] <= 1 for p in (a, b)]
        return 0.0 if unit[0] == unit[1] else 0.7
    if s == "text":
        n = [p["codes"] / p["shapes"]["text"] for p in (a, b)]
        return 0.0 if (n[0] > 0.9) == (n[1] > 0.9) else 0.8
    return 0.0


def assign(cost: list[list[float]]) -> list[int]:
    """Minimum-cost assignment of a square matrix (shortest augmenting paths): the column of each row."""
    n = len(cost)
    u, v, row = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row[0], j0 = i, 0
        least, way, used = [math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = row[j0], math.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[row[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if row[j0] == 0:
                break
        while j0:
            row[j0], j0 = row[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[row[j] - 1] = j - 1
    return out


Path = tuple[str, ...]


def nodes(tree: dict, at: Path = ()) -> dict[Path, str | None]:
    """Every field of a layout by its path, with its type."""
    out: dict[Path, str | None] = {}
    for name, (kind, inner) in tree.items():
        out[(*at, name)] = kind
        out |= nodes(inner, (*at, name))
    return out


def _weight(*paths: Path) -> float:
    return NESTED if all(len(p) > 1 for p in paths) else 1.0


def _retyped(a: str | None, b: str | None) -> bool:
    return a is not None and b is not None and a != b


def pairing(before: dict[Path, str | None], after: dict[Path, str | None], profiles: dict[str, dict]) -> tuple[float, dict[Path, Path]]:
    """The matching of least cost between two layouts' fields, and its cost.

    A field of the same path and type costs nothing and stays. All others may be
    matched across names, types and parents. A pair costs a move if the parents
    aren't matched with each other; as that depends on the matching, it is
    repeated with the parents' last matches until they stand.
    """
    kept = {p: p for p in before if p in after and not _retyped(before[p], after[p])}
    gone, new = sorted(before.keys() - kept.keys()), sorted(after.keys() - kept.keys())
    n, m = len(gone), len(new)
    if not n and not m:
        return 0.0, kept
    like: dict[tuple[int, int], float] = {}
    for i, a in enumerate(gone):
        for j, b in enumerate(new):
            if a == b:
                like[i, j] = 0.0
                continue
            far = value_distance(profiles.get(STEP.join(a)), profiles.get(STEP.join(b)))
            c = 0.2 * far if a[-1] == b[-1] else 0.6 * far + 0.4 * name_distance(a[-1], b[-1]) + 0.01
            if c < RENAMED_BELOW:
                like[i, j] = c
    image = {(): ()} | kept | {p: p for p in gone if p in after}
    for _ in range(4):
        table = [[NEVER] * (n + m) for _ in range(n + m)]
        for (i, j), c in like.items():
            a, b = gone[i], new[j]
            table[i][j] = _weight(a, b) * (c + RETYPE * _retyped(before[a], after[b]) + MOVE * (image.get(a[:-1]) != b[:-1]))
        for i, a in enumerate(gone):  # a removal stands in the row's own extra column, an addition in the column's own extra row
            table[i][m + i] = REMOVE * _weight(a)
        for j, b in enumerate(new):
            table[n + j][j] = ADD * _weight(b)
            table[n + j][m:] = [0.0] * n
        columns = assign(table)
        pairs = kept | {gone[i]: new[columns[i]] for i in range(n) if columns[i] < m}
        cost = sum(table[i][columns[i]] for i in range(n + m))
        if image == (now := {(): ()} | pairs):
            break
        image = now
    return cost, pairs


def script(before: dict[Path, str | None], after: dict[Path, str | None], pairs: dict[Path, Path]) -> list[tuple[Path, Path, str]]:
    """The edits of a matching: (path before, path after, change), () where there is none.

    What an added or removed object holds goes with it, and so do the keys of an
    object that another type turned into.
    """
    image = {(): ()} | pairs
    objects = {()} | {a for a, b in pairs.items() if before[a] == after[b] == "object"}
    back = {b: a for a, b in image.items()}
    out: list[tuple[Path, Path, str]] = []
    for a in sorted(before):
        b = pairs.get(a)
        if b is None:
            if a[:-1] in objects:
                out.append((a, (), "removed"))
            continue
        if image.get(a[:-1]) != b[:-1]:
            out.append((a, b, "moved"))
        elif a[-1] != b[-1]:
            out.append((a, b, "renamed"))
        if _retyped(before[a], after[b]):
            out.append((a, b, "retyped"))
    found = set(pairs.values())
    out += [((), b, "added") for b in sorted(after) if b not in found and back.get(b[:-1]) in objects]
    return out


def edit_script(before: dict, after: dict, profiles: dict[str, dict]) -> tuple[float, list[tuple[str, str, str]]]:
    """Cost and edits (before, after, change) between two layouts; nested fields have dotted paths."""
    x, y = nodes(before), nodes(after)
    cost, pairs = pairing(x, y, profiles)
    return cost, [(".".join(a), ".".join(b), c) for a, b, c in script(x, y, pairs)]


def _records(payload: str | None) -> list[dict]:
    """The records of a payload: the objects of its array, or the one object that it is."""
    try:
        value = json.loads(payload.lstrip("﻿")) if payload else []
    except (ValueError, RecursionError):
        return []
    return [r for r in (value if isinstance(value, list) else [value]) if isinstance(r, dict)]


_LAYOUTS = pa.schema([("export_id", pa.int64()), ("feed_id", pa.int64()), ("exported_at", pa.timestamp("us")), ("layout", pa.string()), ("profile", pa.string())])


def _read_layouts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees, stats = [], []
        for payload in batch.column("payload").to_pylist():
            records = [r for r in _records(payload) if r]
            trees.append(json.dumps(layout(records)) if records else None)
            stats.append(json.dumps(profile(records)) if records else None)
        yield pa.RecordBatch.from_arrays([batch.column("export_id").cast(pa.int64()), batch.column("feed_id").cast(pa.int64()), batch.column("exported_at").cast(pa.timestamp("us")), pa.array(trees, pa.string()), pa.array(stats, pa.string())], schema=_LAYOUTS)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _merged(profiles: Iterable[str]) -> dict[str, dict]:
    out: dict[str, dict] = {}
    for text in profiles:
        for name, p in json.loads(text).items():
            out[name] = merge_profiles(out[name], p) if name in out else p
    return out


def _range_states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What later ranges need of a feed's files in one range: the last layout, the last types, the values' profile."""
    out = []
    for (feed, range_), rows in groupby(_rows(batches), key=lambda r: r[:2]):
        types: dict[str, list] = {}
        last, profiles = None, []
        for r in rows:
            last = _with_types(json.loads(r[4]), types)
            profiles.append(r[5])
        out.append((feed, range_, json.dumps(last), json.dumps(types), json.dumps(_merged(profiles))))
    yield _batch(out, _STATES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


_STATES = pa.schema([("feed_id", pa.int64()), ("range", pa.int32()), ("last", pa.string()), ("types", pa.string()), ("profile", pa.string())])
_EDIT = pa.struct([("before", pa.string()), ("after", pa.string()), ("change", pa.string()), ("nested_before", pa.bool_()), ("nested_after", pa.bool_())])
_FILES = pa.schema([("feed_id", pa.int64()), ("range", pa.int32()), ("export_id", pa.int64()), ("edits", pa.list_(_EDIT)), ("fields", pa.string())])
_FILES_SQL = "feed_id long, range int, export_id long, edits array<struct<before string, after string, change string, nested_before boolean, nested_after boolean>>, fields string"


def _with_types(tree: dict, types: dict[str, list]) -> dict:
    """The layout with null-only fields in their earlier type; updates the types known so far."""
    for name, node in tree.items():
        if node[0] is None and name in types:
            tree[name] = types[name]
        elif node[0] is not None:
            types[name] = node
    return tree


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and quantities of each file of a feed and range; the first row of a group is the state that it starts from.

    A quantity is named by the file in which it came up and its path there, or by
    its path in the last file before the range (a name that starts with STEP).
    """
    for (feed, range_), rows in groupby(_rows(batches), key=lambda r: r[:2]):
        out, types = [], {}
        last: dict[Path, str | None] | None = None
        profiles: dict[str, dict] = {}
        held: dict[Path, str] = {}
        for _, _, _, export_id, text, before, earlier, stats in rows:
            if export_id is None:
                if before:
                    last = nodes(json.loads(before))
                    held = {p: STEP + STEP.join(p) for p in last}
                for known in earlier or ():
                    types.update(json.loads(known))
                profiles = json.loads(stats)
                continue
            now = nodes(_with_types(json.loads(text), types))
            pairs, edits = {}, []
            if last is not None:
                pairs = pairing(last, now, profiles)[1]
                edits = [(".".join(a), ".".join(b), c, len(a) > 1, len(b) > 1) for a, b, c in script(last, now, pairs)]
            back = {b: a for a, b in pairs.items()}
            held = {b: held[back[b]] if b in back else f"{export_id}{STEP}{STEP.join(b)}" for b in now}
            last = now
            out.append((feed, range_, export_id, [dict(zip(("before", "after", "change", "nested_before", "nested_after"), e)) for e in edits], json.dumps([[STEP.join(p), q] for p, q in held.items()])))
        yield _batch(out, _FILES)


def read_layouts(exports: DataFrame) -> DataFrame:
    """One row per export with records: export_id, feed_id, exported_at, layout, profile (JSON). Null keys and unreadable payloads are left out."""
    columns = exports.select(F.col("export_id").cast("long").alias("export_id"), F.col("feed_id").cast("long").alias("feed_id"), F.col("exported_at").cast("timestamp_ntz").alias("exported_at"), "payload").dropna(subset=["export_id", "feed_id", "exported_at"])
    parsed = columns.mapInArrow(_read_layouts, "export_id long, feed_id long, exported_at timestamp_ntz, layout string, profile string").filter("layout is not null")
    return parsed.groupBy("export_id").agg(F.max(F.struct("exported_at", "feed_id", "layout", "profile")).alias("r")).select("export_id", "r.*")


def scan_feeds(exports: DataFrame, ranges: int = 0) -> DataFrame:
    """feed_id, range, export_id, edits and fields (JSON pairs of path and quantity) of every file with records.

    A large feed is cut into time ranges, each scanned by a task of its own from
    the state that the ranges before it leave.
    """
    spark = exports.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = store(store(read_layouts(exports), "layouts").repartitionByRange(ranges, "feed_id", "exported_at", "export_id").withColumn("range", F.spark_partition_id()), "layouts")
    # dealt explicitly: scanning takes far more time than the few bytes of the layouts suggest
    dealt = lambda df: df.repartition(ranges, "feed_id", "range").sortWithinPartitions("feed_id", "range", "exported_at", "export_id")
    states = store(dealt(ranged).select("feed_id", "range", "exported_at", "export_id", "layout", "profile").mapInArrow(_range_states, "feed_id long, range int, last string, types string, profile string"), "states")
    before = Window.partitionBy("feed_id").orderBy("range")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    none = lambda kind: F.lit(None).cast(kind)
    whole = states.select("feed_id", "range", "profile").repartition(ranges, "feed_id").sortWithinPartitions("feed_id", "range").mapInArrow(_feed_profiles, "feed_id long, profile string")
    starts = states.select("feed_id", "range", F.lag("last").over(before).alias("before"), F.collect_list("types").over(earlier).alias("earlier")).join(whole, "feed_id").select("feed_id", "range", none("timestamp_ntz").alias("exported_at"), none("long").alias("export_id"), none("string").alias("layout"), "before", "earlier", "profile")
    files = ranged.select("feed_id", "range", "exported_at", "export_id", "layout", none("string").alias("before"), none("array<string>").alias("earlier"), none("string").alias("profile"))
    return dealt(starts.unionByName(files)).mapInArrow(_scan, _FILES_SQL)


def _feed_profiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The profile of each feed, its ranges' added up."""
    out = [(feed, json.dumps(_merged(r[2] for r in rows))) for feed, rows in groupby(_rows(batches), key=lambda r: r[0])]
    yield _batch(out, pa.schema([("feed_id", pa.int64()), ("profile", pa.string())]))


def changes(exports: DataFrame, ranges: int = 0) -> DataFrame:
    """Every change of layout: feed_id, export_id, field_before, field_after, change, nested_before, nested_after.

    Changes are added, removed, renamed, retyped and moved (to another parent);
    nested fields have dotted paths and are marked. A re-delivered export counts
    once, a file without readable records not at all. Files of a feed follow
    each other by exported_at, then export_id. A field whose values are all null
    keeps its earlier type.
    """
    e = scan_feeds(exports, ranges).select("feed_id", "export_id", F.explode("edits").alias("e"))
    return e.select("feed_id", "export_id", F.col("e.before").alias("field_before"), F.col("e.after").alias("field_after"), F.col("e.change").alias("change"), "e.nested_before", "e.nested_after")


def top_level_changes(found: DataFrame) -> DataFrame:
    """The changes of records' own fields: a move into an object removes one, a move out of an object adds one."""
    moved = F.col("change") == "moved"
    own = found.filter(F.when(moved, ~(F.col("nested_before") & F.col("nested_after"))).otherwise(~F.col("nested_before") & ~F.col("nested_after")))
    before = F.when(moved & F.col("nested_before"), "").otherwise(F.col("field_before"))
    after = F.when(moved & F.col("nested_after"), "").otherwise(F.col("field_after"))
    change = F.when(moved, F.when(F.col("nested_before"), "added").otherwise("removed")).otherwise(F.col("change"))
    return own.select("feed_id", "export_id", before.alias("field_before"), after.alias("field_after"), change.alias("change")).distinct()


def _starts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range of a feed what its first quantities' names stand for: those of the ranges before it."""
    out = []
    for feed, rows in groupby(_rows(batches), key=lambda r: r[0]):
        known: dict[str, str] = {}
        for _, range_, fields in rows:
            out.append((feed, range_, json.dumps(known)))
            known = {p: known[q[1:]] if q.startswith(STEP) else q for p, q in json.loads(fields)}
    yield _batch(out, pa.schema([("feed_id", pa.int64()), ("range", pa.int32()), ("start", pa.string())]))


_PLACES = pa.schema([("feed_id", pa.int64()), ("export_id", pa.int64()), ("path", pa.string()), ("leaf", pa.string()), ("depth", pa.int32()), ("quantity", pa.string())])


def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for feed, export_id, fields, start in _rows([batch]):
            known = json.loads(start)
            for p, q in json.loads(fields):
                keys = p.split(STEP)
                out.append((feed, export_id, p, keys[-1], len(keys), known[q[1:]] if q.startswith(STEP) else q))
        yield _batch(out, _PLACES)


def projections(scanned: DataFrame, number: str) -> DataFrame:
    """export_id, projection: for each file the paths to read, the name of the quantity there and whether it is `number`.

    A quantity keeps one name within its feed: of all that it had, the one of
    the most feeds, then the first alphabetically; a later quantity of the same
    name gets `#2` and so on. Nested fields are read on their own if their
    quantity was ever a record's own field. A quantity is `number` if it ever had
    that name, or a name that mostly such quantities have.
    """
    tasks = int(scanned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = scanned.groupBy("feed_id", "range").agg(F.max_by("fields", F.col("place")).alias("fields"))
    starts = last.repartition(tasks, "feed_id").sortWithinPartitions("feed_id", "range").mapInArrow(_starts, "feed_id long, range int, start string")
    places = store(scanned.join(starts, ["feed_id", "range"]).select("feed_id", "export_id", "fields", "start").mapInArrow(_places, "feed_id long, export_id long, path string, leaf string, depth int, quantity string"), "places")
    names = store(places.groupBy("feed_id", "quantity", "leaf").agg(F.min("depth").alias("depth"), F.min("export_id").alias("first")), "names")
    uses = names.groupBy("leaf").agg(F.count_distinct("feed_id").alias("uses"))
    with_number = names.withColumn("is", F.max((F.col("leaf") == number).cast("int")).over(Window.partitionBy("feed_id", "quantity")))
    alias = with_number.groupBy("leaf").agg((F.avg("is") >= 0.5).alias("alias"))
    of = with_number.join(uses, "leaf").join(alias, "leaf").groupBy("feed_id", "quantity").agg(F.min(F.struct(-F.col("uses"), "leaf"))["leaf"].alias("name"), F.min("depth").alias("depth"), F.min("first").alias("first"), F.max(F.col("alias") | (F.col("is") == 1)).alias("is_number")).filter("depth = 1")
    k = F.row_number().over(Window.partitionBy("feed_id", "name").orderBy("first", "quantity"))
    named = of.withColumn("k", k).select("feed_id", "quantity", F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat("name", F.lit("#"), "k")).alias("name"), "is_number")
    return places.join(named, ["feed_id", "quantity"]).groupBy("export_id").agg(F.sort_array(F.collect_list(F.struct("path", "name", "is_number"))).alias("projection"))


_TABLE = pa.schema([("export_id", pa.int64()), ("feed_id", pa.int64()), ("exported_at", pa.timestamp("us")), ("row_no", pa.int32()), ("fields", pa.map_(pa.string(), pa.string())), ("number", pa.float64())])


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        out = value
    else:
        out = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return None if out is None else out.encode("utf-8", "replace").decode()


def _project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for export_id, feed, at, payload, projection in _rows([batch]):
            paths = [(x["path"].split(STEP), x["name"], x["is_number"]) for x in projection or ()]
            for row, record in enumerate(_records(payload)):
                fields, value = {}, None
                for path, name, is_number in paths:
                    x = record
                    for key in path[:-1]:
                        x = x.get(key) if isinstance(x, dict) else None
                    if isinstance(x, dict) and path[-1] in x:
                        fields[_text(name)] = _text(x[path[-1]])
                        if is_number and value is None:
                            value = numeric(x[path[-1]])
                out.append((export_id, feed, at, row, list(fields.items()), value))
        yield _batch(out, _TABLE)


def consistent_table(exports: DataFrame, number: str = "confidence", ranges: int = 0) -> DataFrame:
    """All records in one table: export_id, feed_id, exported_at, row_no, fields (map of quantity name to text) and `number` as a double.

    Each file is read by its own projection, which the scripts of its feed up to
    it give: fields go to their quantity's name; formatted numbers, percentages
    and objects with a value become that number. Every object of a readable file
    is a row, empty ones too; unreadable files give none. Null keys are dropped,
    a re-delivered export counts once.
    """
    columns = exports.select(F.col("export_id").cast("long").alias("export_id"), F.col("feed_id").cast("long").alias("feed_id"), F.col("exported_at").cast("timestamp_ntz").alias("exported_at"), "payload").dropna(subset=["export_id", "feed_id", "exported_at"])
    once = columns.groupBy("export_id").agg(F.max(F.struct("exported_at", "feed_id", "payload")).alias("r")).select("export_id", "r.*")
    when = columns.groupBy("export_id").agg(F.max("exported_at").alias("exported_at"))
    scanned = store(scan_feeds(exports, ranges).select("feed_id", "range", "export_id", "fields").join(when, "export_id").withColumn("place", F.struct("exported_at", "export_id")), "scanned")
    tasks = int(exports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = once.join(projections(scanned, number), "export_id", "left").select("export_id", "feed_id", "exported_at", "payload", "projection").repartition(tasks, F.xxhash64("export_id"))
    return read.mapInArrow(_project, "export_id long, feed_id long, exported_at timestamp_ntz, row_no int, fields map<string,string>, number double").withColumnRenamed("number", number)
