"""DuckDB SQL for the page queries, put together from common table expressions.

Written from the semantics, not from the Spark plans: folds are recursive
queries over numbered rows, best matches are QUALIFY clauses.
"""

from __future__ import annotations


def r(x: str, digits: int) -> str:
    """Half up, with what lies within 1e-9 of a half going up."""
    return f"(floor(({x}) * 1e{digits} + 0.500000001) / 1e{digits})"


def clamp(x: str) -> str:
    return f"(case when ({x}) < 0 then 0.0 when ({x}) > 1 then 1.0 else ({x}) end)"


def overlap(a: str, b: str) -> str:
    """Common area over the area of a, boxes given by column prefixes."""
    ox, oy = (f"(least({a}{k}2, {b}{k}2) - greatest({a}{k}1, {b}{k}1))" for k in "xy")
    return f"(case when {ox} <= 0 or {oy} <= 0 then 0.0 else {ox} * {oy} / greatest(({a}x2 - {a}x1) * ({a}y2 - {a}y1), 1.0) end)"


def inside(x: str, y: str, b: str, pad: float = 0) -> str:
    return f"({x} between {b}x1 - {pad} and {b}x2 + {pad} and {y} between {b}y1 - {pad} and {b}y2 + {pad})"


CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql, needs)


def chain(name: str, source: str, value: str, order: str, tolerance: str) -> None:
    """Running-mean clusters as a recursion over numbered rows: adds g (from 0) and mean."""
    cte(f"{name}_n", f"select *, row_number() over (partition by page_id order by {value}, {order}) as k from {source}", source)
    fresh = f"abs(p.s / p.n - c.{value}) > c.{tolerance}"
    cte(
        f"{name}_r",
        f"select page_id, k, cast({value} as double) as s, 1 as n, 0 as g from {name}_n where k = 1 union all select c.page_id, c.k, case when {fresh} then c.{value} else p.s + c.{value} end, case when {fresh} then 1 else p.n + 1 end, case when {fresh} then p.g + 1 else p.g end from {name}_r p join {name}_n c on c.page_id = p.page_id and c.k = p.k + 1",
        f"{name}_n",
    )
    cte(name, f"select x.*, y.g, sum(x.{value}) over (partition by x.page_id, y.g) / count(*) over (partition by x.page_id, y.g) as mean from {name}_n x join {name}_r y on x.page_id = y.page_id and x.k = y.k", f"{name}_r")


def build(select: str, *needs: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for d in CTES[n][1]:
            add(d)
        if n not in order:
            order.append(n)

    for n in needs:
        add(n)
    return "with recursive " + ", ".join(f"{n} as ({CTES[n][0]})" for n in order) + " " + select


S = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"
cte("items", f"select page_id, item_idx, {S % 'text'} as text, case when not isnan(confidence) then confidence end as confidence, coalesce(source_item_count, 1) as source_item_count, list_min([p[1] for p in bbox]) as x1, list_min([p[2] for p in bbox]) as y1, list_max([p[1] for p in bbox]) as x2, list_max([p[2] for p in bbox]) as y2, list_sum([p[1] for p in bbox]) / 4 as cx, list_sum([p[2] for p in bbox]) / 4 as cy from result_rows where row_id is not null and len(bbox) = 4 and {S % 'text'} <> '' qualify row_number() over (partition by row_id order by loaded_at desc) = 1")
cte("lines", "select page_id, line_idx, sx, sy, ex, ey, coalesce(field_type, 'line') as field_type, cast(least(sx, ex) as double) as x1, cast(least(sy, ey) as double) as y1, cast(greatest(sx, ex) as double) as x2, cast(greatest(sy, ey) as double) as y2, (sx + ex) / 2.0 as cx, (sy + ey) / 2.0 as cy, sqrt(cast((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy) as double)) as length from field_lines where line_id is not null and page_id is not null and sx is not null and sy is not null and ex is not null and ey is not null qualify row_number() over (partition by line_id order by loaded_at desc) = 1")
cte("contours", "select page_id, k as region_idx, 20 + (page_id * 37 + k * 211) % 500 as x, 30 + (page_id * 53 + k * 301) % 700 as y, 18 + (page_id * 29 + k * 97) % 12 * ((page_id + k) % 5 * 6 + 1) as width, 14 + (page_id * 31 + k * 61) % 10 * ((page_id + k * 2) % 4 * 5 + 1) as height, (page_id * 17 + k * 29) % 60 / 100.0 as ink, (page_id * 13 + k * 7) % 100 / 100.0 as rectangularity, (page_id * 3 + k * 5) % 6 + 2 as vertices, (page_id * 11 + k * 3) % 5 as h_rules, (page_id * 7 + k * 5) % 4 as v_rules from runs, range(3) t(k) where stage = 'loaded' and k < page_id % 4")
cte("maps", f"select mapping_id, page_id, {S % 'label'} as label, coalesce([{{'start': f.start, 'end': f.\"end\", 'field_type': f.field_type}} for f in field_lines], case when field_line is not null then [{{'start': field_line.start, 'end': field_line.\"end\", 'field_type': 'line'}}] end) as field_lines, field_type, state, case when not isnan(candidate_score) then candidate_score end as candidate_score, confidence_class, region_support, coalesce(multiline_group_size, 1) as multiline_group_size from mappings where mapping_id is not null qualify row_number() over (partition by mapping_id order by loaded_at desc) = 1")
cte("sizes", "select page_id, max(x2) as image_width, max(y2) as image_height from (select page_id, x2, y2 from items union all select page_id, x2, y2 from lines) group by page_id", "items", "lines")
cte("counts", f"select c.*, (select count(*) from items i where i.page_id = c.page_id and {inside('(i.x1 + i.x2) / 2', '(i.y1 + i.y2) / 2', 'b.', 4).replace('b.x1', 'c.x').replace('b.y1', 'c.y').replace('b.x2', '(c.x + c.width)').replace('b.y2', '(c.y + c.height)')}) as ocr_count, (select count(*) from lines l where l.page_id = c.page_id and l.cx between c.x and c.x + c.width and l.cy between c.y and c.y + c.height) as line_count from contours c", "contours", "items", "lines")
cte("textsize", "select page_id, coalesce(median(y2 - y1) filter (where y2 > y1), 18) as th, coalesce(median(x2 - x1) filter (where x2 > x1), 72) as tw from items group by page_id", "items")
cte("raw_regions", "select c.*, image_width as iw, image_height as ih, coalesce(th, 18) as th, coalesce(tw, 72) as tw, c.width / greatest(c.height, 1) as a, c.width * c.height / greatest(image_width * image_height, 1.0) as area from counts c join sizes using (page_id) left join textsize using (page_id) where rectangularity >= 0.18", "counts", "sizes", "textsize")
_RULES = [
    ("checkbox_region", 0.90, "a between 0.75 and 1.35 and width <= greatest(th * 3.4, iw * 0.07) and height <= greatest(th * 3.4, ih * 0.07) and ink < 0.55 and ocr_count <= 1"),
    ("table_like_region", 0.84, "line_count >= 3 or (line_count >= 2 and ocr_count >= 3 and a >= 1.2) or (area >= 0.01 and line_count >= 2 and ink >= 0.08)"),
    ("multiline_text_region", 0.78, "a >= 1.8 and height >= th * 2 and ocr_count >= 2 and ink >= 0.02"),
    ("signature_area", 0.81, "a >= 2 and width >= tw * 2.8 and height >= th * 1.6 and ocr_count <= 2 and line_count <= 1 and ink < 0.22"),
    ("photo_region", 0.86, "a between 0.7 and 1.5 and area >= 0.01 and width >= th * 4 and height >= th * 4 and ocr_count <= 2 and line_count = 0 and ink < 0.18"),
    ("non_text_sparse_region", 0.86, "area >= 0.012 and height >= th * 3.5 and ocr_count <= 3 and line_count <= 2 and ink < 0.18"),
    ("non_text_candidate", 0.68, "height > th * 3 and width >= tw * 1.2 and ocr_count <= 1"),
]
cte("regions", "select page_id, region_idx, x, y, width, height, case " + " ".join(f"when {c} then '{n}'" for n, _, c in _RULES) + " else 'standard_input' end as type, (case " + " ".join(f"when {c} then {v}" for _, v, c in _RULES) + " else 0.58 end) :: double as confidence, ocr_count, line_count from raw_regions", "raw_regions")
_TYPES = "('photo_region', 'signature_area', 'stamp_area', 'logo_region', 'decorative_box', 'non_text_sparse_region')"
cte("page_regions", f"select * from regions where type in {_TYPES}", "regions")

# layout
cte("extent", "select page_id, greatest(max(x2), 1.0) as w, greatest(max(y2), 1.0) as h from (select page_id, x2, y2 from items union all select page_id, x2, y2 from lines union all select page_id, x + width, y + height from regions) group by page_id", "items", "lines", "regions")
cte("medians", "select e.page_id, w, h, coalesce((select median(y2 - y1) from items i where i.page_id = e.page_id and y2 > y1), 18) as th, coalesce((select median(x2 - x1) from items i where i.page_id = e.page_id and x2 > x1), 80) as tw, coalesce((select median(length) from lines l where l.page_id = e.page_id and length > 0), 220) as ll, (select count(*) from items i where i.page_id = e.page_id) as n, (select count(*) from lines l where l.page_id = e.page_id) as nl, (select count(*) from regions g where g.page_id = e.page_id) as nr from extent e", "extent", "items", "lines", "regions")
_M = {"page_width": r("w", 2), "page_height": r("h", 2), "page_area": r("w * h", 2), "page_aspect_ratio": r("w / h", 4), "page_mid_x": r("w / 2", 2), "page_mid_y": r("h / 2", 2), "avg_text_height": r("th", 2), "avg_text_width": r("tw", 2), "avg_line_length": r("ll", 2), "row_tolerance": r("greatest(18, th * 1.5, h * 0.008)", 2), "band_tolerance": r("greatest(28, th * 2.3, h * 0.015)", 2), "column_tolerance": r("greatest(28, tw * 0.8, w * 0.04)", 2), "multiline_band_gap": r("greatest(34, th * 2.6, h * 0.03)", 2), "indent_tolerance": r("greatest(42, th * 3, w * 0.04)", 2), "region_gap": r("greatest(24, th * 1.9)", 2), "distance_limit": r("greatest(420, ll * 3.2, w * 0.55)", 2), "ocr_density": r("n / greatest(w * h / 100000.0, 1.0)", 4), "ocr_count": "n", "field_line_count": "nl", "semantic_region_count": "nr"}
cte("m", "select page_id, " + ", ".join(f"{v} as {k}" for k, v in _M.items()) + " from medians", "medians")
_B = ", ".join(f"{r(v, 2)} as {k}" for k, v in {"x1": "x1", "y1": "y1", "x2": "x2", "y2": "y2", "cx": "(x1 + x2) / 2", "cy": "(y1 + y2) / 2"}.items())
cte("ents", f"select page_id, 'ocr' as kind, 0 as ko, item_idx as idx, 'ocr-' || item_idx as id, text, null as entity_type, coalesce(confidence, 0.0) as confidence, null as length, {_B} from items union all select page_id, 'field_line', 1, line_idx, 'field-' || line_idx, null, field_type, null, {r('length', 2)}, {_B} from lines union all select page_id, 'semantic_region', 2, region_idx, 'region-' || region_idx, null, type, confidence, null, {_B} from (select *, x as x1, y as y1, x + width as x2, y + height as y2 from regions)", "items", "lines", "regions")
cte("ents_b", "select e.*, band_tolerance from ents e join m using (page_id) where kind <> 'semantic_region'", "ents", "m")
chain("bm", "ents_b", "cy", "ko, idx", "band_tolerance")
cte("band0", f"select page_id, g as band_idx, {r('any_value(mean)', 2)} as center_y, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, count(*) filter (where kind = 'ocr') as label_count, count(*) filter (where kind = 'field_line') as field_count, count(*) as item_count from bm group by page_id, g", "bm")
cte("band", f"select page_id, band_idx, case when y2 - y1 >= multiline_band_gap and label_count > 1 then 'multiline_band' when field_count >= 4 then 'repeated_field_band' when label_count >= 2 and field_count >= 1 then 'section_band' when field_count >= 2 then 'field_band' else 'label_band' end as type, center_y, x1, y1, x2, y2, label_count, field_count, item_count, cast(0.8 as double) as confidence, {r('field_count / item_count', 4)} as repetition_score from band0 join m using (page_id)", "band0", "m")
cte("ents_l", "select e.*, column_tolerance from ents e join m using (page_id) where kind = 'ocr' and cx <= page_mid_x * 1.12", "ents", "m")
cte("ents_f", "select e.*, column_tolerance from ents e join m using (page_id) where kind = 'field_line'", "ents", "m")
chain("lm", "ents_l", "cx", "idx", "column_tolerance")
chain("fm", "ents_f", "cx", "idx", "column_tolerance")


def _columns(source: str, kind: str) -> str:
    share = "c / greatest(page_width, 1.0)"
    lean = share if kind == "field" else f"1 - {share}"
    return f"select page_id, '{kind}' as column_type, column_idx, {r('c', 2)} as center_x, x1, y1, x2, y2, item_count, {r(clamp('item_count / cast(k as double)'), 4)} as support, {r('wide', 2)} as average_item_width, {r(clamp('0.55 + 0.25 * item_count / k'), 4)} as confidence, {r(clamp(lean), 4)} as lean, rn = 1 as is_primary from (select *, count(*) over (partition by page_id) as k, row_number() over (partition by page_id order by item_count desc, column_idx) as rn from (select page_id, g as column_idx, any_value(mean) as c, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, count(*) as item_count, avg(x2 - x1) as wide from {source} group by page_id, g)) join m using (page_id)"


cte("lcol", _columns("lm", "label"), "lm", "m")
cte("fcol", _columns("fm", "field"), "fm", "m")


def _zones(kind: str, members: str) -> str:
    ent = "ocr" if kind == "label" else "field_line"
    n = ("0", "item_count") if kind == "label" else ("item_count", "0")
    multi = "false" if kind == "label" else "band_type = 'multiline_band' or item_count > 2"
    return f"select page_id, '{kind}' as zone_type, row_number() over (partition by page_id order by band_idx, column_idx) - 1 as zone_idx, band_idx, column_idx, x1, y1, x2, y2, item_count, {r('item_count / cast(total as double)', 4)} as support, {r(clamp('0.45 + 0.35 * item_count / total + 0.10 * 0.8'), 4)} as confidence, {n[0]} as line_count, {n[1]} as text_count, band_type, {multi} as multiline from (select b.page_id, b.g as band_idx, c.g as column_idx, count(*) as item_count from bm b join {members} c on b.page_id = c.page_id and b.kind = c.kind and b.idx = c.idx where b.kind = '{ent}' group by all) z join (select page_id, band_idx, type as band_type, item_count as total, x1, y1, x2, y2 from band) using (page_id, band_idx)"


cte("lz", _zones("label", "lm"), "bm", "lm", "band")
cte("fz", _zones("field", "fm"), "bm", "fm", "band")
_LEVEL = "1 - least(abs((f.y1 + f.y2) / 2 - (l.y1 + l.y2) / 2) / greatest(f.y2 - f.y1, 1.0), 1.0)"
_SCORE = f"{overlap('l.', 'f.')} * 0.55 + f.confidence * 0.2 + f.support * 0.15 + ({_LEVEL}) * 0.1 + case when (f.x1 + f.x2) / 2 >= l.x2 then 0.15 else -0.1 end"
_SURE = clamp("0.34 + 0.28 * l.confidence + 0.28 * f.confidence + 0.10 * 0.8")
cte("own", f"select l.page_id, l.zone_idx as label_zone, f.zone_idx as field_zone, l.band_idx, case when l.text_count > 1 or f.multiline or l.band_type = 'multiline_band' then 'multiline_ownership_region' else 'ownership_region' end as type, least(l.x1, f.x1) as x1, least(l.y1, f.y1) as y1, greatest(l.x2, f.x2) as x2, greatest(l.y2, f.y2) as y2, {r(_SURE, 4)} as confidence, {r(clamp('l.support + f.support'), 4)} as coverage, (l.text_count > 1 or f.multiline or l.band_type = 'multiline_band') as multiline from lz l join band lb on l.page_id = lb.page_id and l.band_idx = lb.band_idx join fz f on f.page_id = l.page_id join band fb on f.page_id = fb.page_id and f.band_idx = fb.band_idx join m on m.page_id = l.page_id where l.band_idx = f.band_idx or abs(fb.center_y - lb.center_y) <= band_tolerance * 1.5 qualify row_number() over (partition by l.page_id, l.zone_idx order by (l.band_idx = f.band_idx) desc, {r(_SCORE, 9)} desc, f.zone_idx) = 1", "lz", "fz", "band", "m")
_EXCLUDED = "('photo_region', 'signature_area', 'stamp_area', 'logo_region', 'decorative_box', 'non_text_sparse_region', 'non_text_candidate', 'table_like_region', 'checkbox_region')"
_SQ = "(z.x2 - z.x1) / greatest(z.y2 - z.y1, 1.0) between 0.7 and 1.4 and (z.x2 - z.x1) * (z.y2 - z.y1) >= 700"
cte("excl", f"select page_id, 'region' as source, region_idx as idx, type, cast(x as double) as x1, cast(y as double) as y1, cast(x + width as double) as x2, cast(y + height as double) as y2, confidence from regions where type in {_EXCLUDED} union all select z.page_id, 'zone', z.zone_idx, case when {_SQ} then 'photo_region' else 'non_text_sparse_region' end, z.x1, z.y1, z.x2, z.y2, {r(clamp('0.62 + z.support * 0.2'), 4)} from fz z join band b on b.page_id = z.page_id and b.band_idx = z.band_idx join m on m.page_id = z.page_id where z.support < 0.55 and not (label_count > 0 and field_count > 0) and (({_SQ}) or (z.y2 - z.y1 >= avg_text_height * 2 and (z.x2 - z.x1) * (z.y2 - z.y1) >= greatest(avg_text_height * avg_text_width * 0.5, 1200.0)))", "regions", "fz", "band", "m")


def _best(things: str, key: str, zones: str, zkey: str, support: str) -> str:
    hold = f"{overlap('t.', 'z.')} > 0 or {inside('(t.x1 + t.x2) / 2', '(t.y1 + t.y2) / 2', 'z.', 6)}"
    score = f"{overlap('t.', 'z.')} * 0.7 + z.confidence * 0.2 + {support} * 0.1"
    return f"select t.page_id, t.{key}, z.{zkey} as best, {support} as support from {things} t join {zones} z on t.page_id = z.page_id and ({hold}) qualify row_number() over (partition by t.page_id, t.{key} order by {r(score, 9)} desc, z.{zkey}) = 1"


cte("i_zone", _best("items", "item_idx", "lz", "zone_idx", "z.support"), "items", "lz")
cte("i_band", _best("items", "item_idx", "band", "band_idx", "0.0"), "items", "band")
cte("l_zone", _best("lines", "line_idx", "fz", "zone_idx", "z.support"), "lines", "fz")
cte("l_band", _best("lines", "line_idx", "band", "band_idx", "0.0"), "lines", "band")
cte("l_excl", f"select l.page_id, l.line_idx, (case when exists (select 1 from excl e where e.page_id = l.page_id and ({overlap('l.', 'e.')} > 0 or {inside('(l.x1 + l.x2) / 2', '(l.y1 + l.y2) / 2', 'e.', 2)})) then 1.0 else 0.0 end) :: double as excluded from lines l", "lines", "excl")

# matching
_T = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_WORDS = "['address','advertisement','age','applied','birth','candidate','category','code','contact','date','email','father','gender','husband','letter','mail','mobile','name','nationality','number','obc','passport','phone','pin','post','pwd','sc','sex','signature','st','year']"
PROMPT = rf"(list_has_any({_T}, {_WORDS}) or regexp_matches(text, '^\s*\d+[\s.):-]') or contains(text, ':') or contains(text, '?'))"
UPPER = r"(case when length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0 then length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) / length(regexp_replace(text, '[^\p{L}]', '', 'g')) else 0.0 end)"


def mappable(height: str) -> str:
    return f"({PROMPT} or not ({height} > 0 and cy < {height} * 0.3 and ({UPPER} >= 0.72 or len(list_distinct({_T})) <= 1)))"


cte("gaps", "select page_id, cx, row_number() over w as rn, lead(cx) over w as nx from items window w as (partition by page_id order by cx, item_idx)", "items")
cte("split0", "select page_id, (cx + nx) / 2 as mid from gaps where nx > cx qualify row_number() over (partition by page_id order by nx - cx desc, rn) = 1", "gaps")
cte("split", "select page_id, case when mid is null or mid < 225 then 300.0 else mid end as column_split from (select distinct page_id from items) left join split0 using (page_id)", "items", "split0")
cte("labels", f"select i.*, column_split from items i join split using (page_id) join m using (page_id) where cx < column_split and {mappable('page_height')}", "items", "split", "m")
_FEATURES = {
    "same_row": "clamp1(1 - abs(dy) / greatest(greatest(row_tolerance, lh * 1.25), 1.0))",
    "same_column": "clamp1(1 - abs(dx) / greatest(greatest(column_tolerance, lw * 0.8), 1.0))",
    "vertical_continuation": "case when dy >= 0 then clamp1(1 - dy / greatest(greatest(multiline_band_gap, lh * 2.4), 1.0)) else 0.0 end",
    "spacing_similarity": "clamp1(1 - abs(dy) / greatest(greatest(multiline_band_gap, lh * 2.4), 1.0))",
    "x_overlap_ratio": "clamp1(greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) / greatest(least(lw, fw), 1.0))",
    "size_consistency": "clamp1(1 - abs(fw - avg_line_length) / greatest(avg_line_length * 1.4, 1.0))",
}


def _clamped(x: str) -> str:
    """clamp1(...) spelled out."""
    while "clamp1(" in x:
        a = x.index("clamp1(")
        depth, b = 0, a + 6
        for b in range(a + 6, len(x)):
            depth += (x[b] == "(") - (x[b] == ")")
            if not depth:
                break
        x = f"{x[:a]}least(1.0, greatest(0.0, {x[a + 7 : b]})){x[b + 1 :]}"
    return x


cte("pair0", "select a.page_id, a.item_idx, b.line_idx, a.text, a.confidence, a.x1 as ax1, a.y1 as ay1, a.x2 as ax2, a.y2 as ay2, a.cx as acx, a.cy as acy, b.x1 as bx1, b.x2 as bx2, b.cx as bcx, b.cy as bcy, b.field_type, b.length, (b.y1 + b.y2) / 2 - (a.y1 + a.y2) / 2 as dy, (b.x1 + b.x2) / 2 - (a.x1 + a.x2) / 2 as dx, greatest(a.x2 - a.x1, 1.0) as lw, greatest(a.y2 - a.y1, 1.0) as lh, greatest(b.x2 - b.x1, 1.0) as fw from labels a join lines b using (page_id)", "labels", "lines")
cte("pair1", "select p.*, m.row_tolerance, m.column_tolerance, m.multiline_band_gap, m.avg_line_length, m.avg_text_width, iz.best as az, iz.support as asup, ib.best as ab, lz2.best as bz, lz2.support as bsup, lb.best as bb, e.excluded, lc.center_x as acol, fc.center_x as bcol, fc.is_primary, ba.center_y as ay, bbn.center_y as by_, m.band_tolerance, m.page_width from pair0 p join m using (page_id) left join i_zone iz using (page_id, item_idx) left join i_band ib using (page_id, item_idx) left join l_zone lz2 using (page_id, line_idx) left join l_band lb using (page_id, line_idx) left join l_excl e using (page_id, line_idx) left join lz za on za.page_id = p.page_id and za.zone_idx = iz.best left join lcol lc on lc.page_id = p.page_id and lc.column_idx = za.column_idx left join fz zb on zb.page_id = p.page_id and zb.zone_idx = lz2.best left join fcol fc on fc.page_id = p.page_id and fc.column_idx = zb.column_idx left join band ba on ba.page_id = p.page_id and ba.band_idx = ib.best left join band bbn on bbn.page_id = p.page_id and bbn.band_idx = lb.best", "pair0", "m", "i_zone", "i_band", "l_zone", "l_band", "l_excl", "lz", "fz", "lcol", "fcol", "band")
cte("pair2", "select p.*, " + ", ".join(f"{_clamped(v)} as {k}" for k, v in _FEATURES.items()) + ", coalesce(asup, 0.0) as ls, coalesce(bsup, 0.0) as fs, case when bb is not null or ab is not null then 0.8 else 0.0 end as bs, case when ab = bb then 1.0 else 0.0 end as same_band, case when ab is not null and bb is not null then " + _clamped("clamp1(1 - abs(by_ - ay) / greatest(band_tolerance * 2.2, 1.0))") + " else 0.0 end as band_align, coalesce((select max(o.confidence) from own o where o.page_id = p.page_id and (p.az is null or o.label_zone = p.az) and (p.bz is null or o.field_zone = p.bz)), 0.0) as stated, " + _clamped("case when acol is not null and bcol is not null then clamp1(case when bcol >= acol then 0.6 else 0.15 end + 0.25 * clamp1(abs(bcol - acol) / greatest(page_width * 0.35, 1.0)) + case when is_primary then 0.15 else 0.0 end) when bcol is not null then case when is_primary then 0.55 else 0.35 end else 0.0 end") + " as colc from pair1 p", "pair1", "own")
cte("pair3", "select *, " + _clamped("clamp1(same_row * 0.35 + same_column * 0.2 + vertical_continuation * 0.25 + spacing_similarity * 0.2)") + " as align, case when stated = 0 then " + _clamped("clamp1(ls * 0.35 + fs * 0.35 + bs * 0.3)") + " else stated end as own_c from pair2", "pair2")
_OUT = {k: k for k in _FEATURES} | {"ownership_strength": _clamped(f"clamp1(same_row * 0.24 + vertical_continuation * 0.30 + align * 0.18 + {r('own_c', 4)} * 0.28)"), "region_support": f"greatest({r('fs', 4)}, {r('ls', 4)})", "alignment_score": "align", "column_consistency": "colc", "ownership_confidence": "own_c", "global_structure_score": _clamped("clamp1(same_band * 0.22 + band_align * 0.18 + colc * 0.32 + own_c * 0.26 + fs * 0.10 + ls * 0.06 + greatest(same_band, bs) * 0.04 - excluded * 0.55)"), "band_alignment": "band_align"}
cte("feat", "select page_id, item_idx, line_idx, text, confidence, field_type, length, excluded, ax1, ay1, ax2, ay2, acx, acy, bcx, bcy, avg_text_width, row_tolerance as rt, column_tolerance as ct, " + ", ".join(f"{r(v, 4)} as {k}" for k, v in _OUT.items()) + " from pair3", "pair3")
cte("islands", "select *, sum(case when abs(sy - psy) < 15 then 0 else 1 end) over (partition by page_id order by sy, line_idx) - 1 as group_idx from (select *, lag(sy) over (partition by page_id order by sy, line_idx) as psy from lines)", "lines")
cte("tables_", "select page_id, line_idx, group_idx, count(*) over (partition by page_id, group_idx) as group_lines from islands qualify count(*) over (partition by page_id, group_idx) >= 5", "islands")
cte("lmet", "select page_id, coalesce(median(y2 - y1) filter (where y2 > y1), 18) as mh from items group by page_id", "items")
_SC = {
    "ho": "clamp1(1 - abs(bcx - acx) / greatest(avg_text_width * 2, 100.0))",
    "ve": "clamp1(1 - abs(bcy - acy) / greatest(rt * 1.6, 1.0))",
    "ro": "case when bcy between ay1 and ay2 + mh * 0.8 then 1.0 else clamp1(1 - least(abs(bcy - ay1), abs(bcy - ay2)) / greatest(greatest(42.0, mh * 3.4), 1.0)) end",
    "se": "0.55 + case when field_type in ('box', 'weak_line', 'fallback_text_region') then 0.06 else 0.0 end + case when length <= 260 then 0.04 else 0.0 end",
    "su": "coalesce(case when confidence is not null then clamp1(confidence) end, 0.75)",
}
cte("score0", "select f.*, group_idx is not null as in_table, " + ", ".join(f"{_clamped(v)} as {k}" for k, v in _SC.items()) + " from feat f join lmet using (page_id) left join tables_ using (page_id, line_idx)", "feat", "lmet", "tables_")
_LOCAL = "ho * 0.12 + ve * 0.12 + ro * 0.12 + alignment_score * 0.18 + vertical_continuation * 0.10 + x_overlap_ratio * 0.07 + spacing_similarity * 0.07 + size_consistency * 0.08 + se * 0.06 + su * 0.05"
_WIDE = "global_structure_score * 0.60 + column_consistency * 0.16 + ownership_confidence * 0.16 + ownership_strength * 0.04 + region_support * 0.04"
cte("score1", f"select *, {_LOCAL} as local, {_WIDE} as wide, (bcx <= ax2 - ct * 0.25 or in_table or ve < 0.38 or excluded > 0.5) as rejected from score0", "score0")
_BOTH = "local * 0.45 + wide * 0.55"
cte("scores", f"select page_id, item_idx, line_idx, bcx, bcy, {r('local', 4)} as local_score, global_structure_score, {r(f'case when rejected then ({_BOTH}) * 0.3 else {_BOTH} end', 4)} as candidate_score, rejected, {r('sqrt((bcx - acx) * (bcx - acx) + (bcy - acy) * (bcy - acy))', 2)} as distance from score1", "score1")
# candidate pools
cte("pool_a", "select a.page_id, a.item_idx, iz.best as zone, ib.best as band, b.center_y, z.x2 as zx2, band_tolerance, column_tolerance from labels a join m using (page_id) left join i_zone iz using (page_id, item_idx) left join i_band ib using (page_id, item_idx) left join lz z on z.page_id = a.page_id and z.zone_idx = iz.best left join band b on b.page_id = a.page_id and b.band_idx = ib.best", "labels", "m", "i_zone", "i_band", "lz", "band")
cte("pool_z", "select a.*, f.x1, f.y1, f.x2, f.y2, case when f.band_idx = a.band then 0 when abs(fb.center_y - a.center_y) <= band_tolerance * 1.5 then 1 else 2 end as lev, coalesce(f.x1 >= a.zx2 - column_tolerance * 0.2, false) as rt from pool_a a join fz f on f.page_id = a.page_id join band fb on fb.page_id = f.page_id and fb.band_idx = f.band_idx", "pool_a", "fz", "band")
cte("pool_n", "select * from pool_z qualify lev = min(lev) over (partition by page_id, item_idx)", "pool_z")
cte("pool_r", "select * from pool_n qualify rt or not bool_or(rt) over (partition by page_id, item_idx)", "pool_n")
cte("free", "select page_id, line_idx, cx, cy, excluded from lines join l_excl using (page_id, line_idx)", "lines", "l_excl")
cte("pool_in", f"select z.page_id, z.item_idx, l.line_idx from pool_r z join free l on l.page_id = z.page_id and l.excluded = 0 and {inside('l.cx', 'l.cy', 'z.', 4)} union select a.page_id, a.item_idx, l.line_idx from pool_a a join free l on l.page_id = a.page_id and l.excluded = 0 and l.cx >= a.zx2 - a.column_tolerance where exists (select 1 from fz where fz.page_id = a.page_id)", "pool_r", "pool_a", "free", "fz")
cte("pool", "select page_id, item_idx, line_idx from (select a.page_id, a.item_idx, l.line_idx, case when p.line_idx is not null then 0 when l.excluded = 0 then 1 else 2 end as rk from pool_a a join free l on l.page_id = a.page_id left join pool_in p on p.page_id = a.page_id and p.item_idx = a.item_idx and p.line_idx = l.line_idx) qualify rk = min(rk) over (partition by page_id, item_idx)", "pool_a", "free", "pool_in")
cte("ranked", "select *, row_number() over w as rank, lead(candidate_score) over w as second from scores join pool using (page_id, item_idx, line_idx) window w as (partition by page_id, item_idx order by candidate_score desc, bcy, bcx, line_idx)", "scores", "pool")

# text rows
cte("noise", r"select * from (select *, coalesce(median(y2 - y1) filter (where y2 > y1) over (partition by page_id), 24) as median_height, coalesce(confidence, 1.0) as cf from items) where not ((cf < 0.15 and (length(text) <= 8 or length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) / greatest(length(text), 1) >= 0.2)) or (cf < 0.35 and length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) <= 2) or (cf < 0.40 and y2 - y1 < greatest(median_height * 0.45, 8.0)))", "items")
cte("raw_sized", "select *, coalesce(median(y2 - y1) filter (where y2 > y1) over (partition by page_id), 18) as median_height from items", "items")
cte("noise_sized", "select * from noise", "noise")


def first_fit(name: str, source: str, factor: float) -> None:
    """Open rows as lists of sums and counts, carried along the numbered items."""
    cte(f"{name}_n", f"select *, (y1 + y2) / 2 as cyb, greatest(8.0, median_height * {factor}) as tol, row_number() over (partition by page_id order by y1, x1, item_idx) as k from {source}", source)
    hit = "list_position([abs(c.cyb - z[1] / z[2]) <= c.tol for z in list_zip(p.s, p.n)], true)"
    cte(
        f"{name}_r",
        f"select page_id, k, [cyb] as s, [1] as n, 0 as row_idx from {name}_n where k = 1 union all "
        f"select page_id, k, case when slot is null then list_append(s, cyb) else [case when i = slot then s[i] + cyb else s[i] end for i in range(1, len(s) + 1)] end, case when slot is null then list_append(n, 1) else [case when i = slot then n[i] + 1 else n[i] end for i in range(1, len(n) + 1)] end, case when slot is null then len(s) else slot - 1 end "
        f"from (select c.page_id, c.k, c.cyb, p.s, p.n, nullif({hit}, 0) as slot from {name}_r p join {name}_n c on c.page_id = p.page_id and c.k = p.k + 1)",
        f"{name}_n",
    )
    cte(name, f"select x.*, y.row_idx from {name}_n x join {name}_r y on x.page_id = y.page_id and x.k = y.k", f"{name}_r")


first_fit("ff", "noise_sized", 0.65)
first_fit("ff_raw", "raw_sized", 0.70)
first_fit("ff_clean", "noise_sized", 0.70)
cte("tok0", "select *, x1 - lag(x2) over w as gap, greatest(0.0, least(y2, lag(y2) over w) - greatest(y1, lag(y1) over w)) / greatest(least(y2 - y1, lag(y2) over w - lag(y1) over w), 1.0) as vo from ff window w as (partition by page_id, row_idx order by x1, item_idx)", "ff")
cte("tok", "select *, sum(case when coalesce(gap >= 0 and gap <= greatest(42.0, median_height * 1.8) and vo >= 0.45, false) then 0 else 1 end) over (partition by page_id, row_idx order by x1, item_idx) - 1 as run_idx from tok0", "tok0")
cte("parts", "select page_id, row_idx, run_idx, list(text order by x1, item_idx) as ts, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, avg(confidence) as cf, sum(source_item_count) as source_item_count, count(*) as tokens from tok group by all", "tok")
_GLUE = "list_reduce(ts, lambda a, t: case when length(a) = 0 or right(a, 1) in ('/', '-', '(', ':') or t in (':', '.', ',', ';', ')', '/', '-') then a || t else a || ' ' || t end)"
_SPACED = "regexp_replace(" + _GLUE + r", '\s+', ' ', 'g')"
cte("row_raw", f"select page_id, row_idx, {r('sum((y1 + y2) / 2) / count(*)', 2)} as center_y, string_agg(text, ' ' order by x1, item_idx) as text from ff_raw group by page_id, row_idx", "ff_raw")
cte("row_clean", f"select page_id, row_idx, {r('sum((y1 + y2) / 2) / count(*)', 2)} as center_y, string_agg(text, ' ' order by x1, item_idx) as text from ff_clean group by page_id, row_idx", "ff_clean")
cte("near_rows", "select a.page_id, a.row_idx as baseline_row, b.row_idx as current_row, abs(a.center_y - b.center_y) as y_delta, b.text as current_text from row_raw a join row_clean b using (page_id) qualify row_number() over (partition by a.page_id, a.row_idx order by abs(a.center_y - b.center_y), b.row_idx) = 1", "row_raw", "row_clean")
cte("gap0", "select *, sum(case when abs(cy - pcy) < 20 then 0 else 1 end) over (partition by page_id order by cy, item_idx) - 1 as row_idx from (select *, lag(cy) over (partition by page_id order by cy, item_idx) as pcy from items)", "items")
cte("grow", f"select page_id, row_idx, {S % 'string_agg(text, chr(32) order by cy, item_idx)'} as text, count(*) as item_count, sum(cy) / count(*) as mean_y, max(y2) as bottom_y, min(y2) as top_y, (min(y2) + max(y2)) / 2 as center_y, least(max(x2), 620.0) as right_x, max(x2) as raw_right_x, min(x1) as left_x from gap0 group by page_id, row_idx", "gap0")
cte("mflag", "select *, coalesce(abs(lead(mean_y) over w - mean_y) < 40 and (length(lead(text) over w) < 25 or lead(text) over w like '%:' or regexp_matches(lower(lead(text) over w), 'letters|years|months|days|man')), false) as flag from grow window w as (partition by page_id order by row_idx)", "grow")
cte("merge_r", "select page_id, row_idx, flag, 'first' as state, case when flag then 'first' else 'single' end as role, 0 as merged_idx from mflag where row_idx = 0 union all select c.page_id, c.row_idx, c.flag, 'x', case when p.role = 'first' then 'second' when c.flag then 'first' else 'single' end, case when p.role = 'first' then p.merged_idx else p.merged_idx + 1 end from merge_r p join mflag c on c.page_id = p.page_id and c.row_idx = p.row_idx + 1", "mflag")

# evaluation
cte("unmatched", "select distinct page_id, text from items except select page_id, label from maps where label <> ''", "items", "maps")
cte("unresolved", "select i.* from items i where not exists (select 1 from maps where maps.page_id = i.page_id and maps.label = i.text)", "items", "maps")
cte("heights", "select page_id, page_height as ph from m", "m")
cte("topband", "select u.* from unresolved u join heights using (page_id) where cy <= ph * 0.3", "unresolved", "heights")


def summary(where: str = "true") -> str:
    n = lambda c: f"count(*) filter (where confidence_class = '{c}')"
    return f"select s.*, coalesce(u.n, 0) as unmatched_label_count from (select page_id, count(*) as mapping_count, coalesce({r('avg(candidate_score)', 4)}, 0.0) as average_candidate_score, count(*) filter (where multiline_group_size > 1) as multiline_mapping_count, {n('ambiguous')} as ambiguous_mapping_count, {n('unresolved')} as unresolved_mapping_count, {n('strong_match')} as strong_match_count, {n('weak_match')} as weak_match_count from maps where {where} group by page_id) s left join (select page_id, count(*) as n from (select distinct page_id, text from items except select page_id, label from maps where label <> '' and {where}) group by page_id) u using (page_id)"


cte("summary", summary(), "maps", "items")
cte("sum_old", summary("state is null"), "maps", "items")
cte("sum_new", summary("state is not null"), "maps", "items")
cte("prox", f"select s.*, coalesce(n, 0) as ocr_item_count, coalesce(mi, 0) as merged_ocr_count, coalesce(ms, 0) as source_items_merged, case when mapping_count > 0 then {r('strong_match_count / mapping_count', 4)} else 0.0 end as precision_proxy, case when coalesce(n, 0) > 0 then {r('mapping_count / n', 4)} else 0.0 end as recall_proxy, ambiguous_mapping_count + weak_match_count as false_positive_proxy from summary s left join (select page_id, count(*) as n, count(*) filter (where source_item_count > 1) as mi, sum(source_item_count) filter (where source_item_count > 1) as ms from items group by page_id) using (page_id)", "summary", "items")
cte("cat0", f"select p.*, coalesce(st, 0) as st, coalesce(un, 0) as un, coalesce(fl, 0) as fl, coalesce(hm, false) as hm, coalesce(ht, false) as ht, coalesce(ec, 0) as ec from prox p left join (select page_id, count(*) filter (where length(text) <= 24) as st from topband group by page_id) using (page_id) left join (select page_id, count(*) as un from unresolved group by page_id) using (page_id) left join (select page_id, count(*) as fl from lines group by page_id) using (page_id) left join (select page_id, bool_or(contains(type, 'multiline')) as hm, bool_or(type in ('table_like_region', 'checkbox_region')) as ht, count(*) filter (where type in {_TYPES}) as ec from regions group by page_id) using (page_id)", "prox", "topband", "unresolved", "lines", "regions")
_CATS = [
    ("token fragmentation", "merged_ocr_count > 0 and source_items_merged >= greatest(merged_ocr_count * 2, 4)"),
    ("multiline splitting", "multiline_mapping_count = 0 and hm"),
    ("confidence-threshold issues", "average_candidate_score < 0.5 or (ambiguous_mapping_count >= greatest(1, strong_match_count * 2) and precision_proxy < 0.35)"),
    ("false field-line detection", "fl >= 70 and mapping_count < greatest(ocr_item_count, 1) and false_positive_proxy >= weak_match_count"),
    ("graph segmentation weakness", "ht and ambiguous_mapping_count >= greatest(3, mapping_count // 2)"),
    ("header/title contamination", "st > 0"),
    ("over-aggressive filtering", "un > 0 and precision_proxy < 0.4 and recall_proxy < 0.85"),
    ("sparse-band exclusion error", "ec > 0 and fl > 0 and mapping_count < fl * 0.35"),
]
cte("cats", " union all ".join(f"select page_id, '{n}' as category from cat0 where {c}" for n, c in _CATS), "cat0")
cte("boxes", "select mapping_id, page_id, label, i - 1 as box_idx, least(l.start[1], l.\"end\"[1]) as x, greatest(0, least(l.start[2], l.\"end\"[2]) - 4) as y, abs(l.\"end\"[1] - l.start[1]) as width, 18 as height, coalesce(l.field_type, 'line') as field_type from (select mapping_id, page_id, label, unnest(field_lines) as l, unnest(range(1, len(field_lines) + 1)) as i from maps where field_lines is not null) where l.start[1] is not null and l.start[2] is not null and l.\"end\"[1] is not null and l.\"end\"[2] is not null", "maps")
cte("fallback", "select page_id, item_idx as line_idx, cast(floor(x2 + 24) as integer) as sx, cast(floor(y2 + 4) as integer) as sy, cast(least(floor(image_width - 40), floor(x2 + 24) + 320) as integer) as ex, cast(floor(y2 + 4) as integer) as ey, 'fallback_text_region' as field_type from items join sizes using (page_id) where cx <= image_width * 0.75 and least(floor(image_width - 40), floor(x2 + 24) + 320) - floor(x2 + 24) >= 120", "items", "sizes")
DEDUP = "qualify row_number() over (partition by page_id, round_even(least(sx, ex) / 12.0, 0), round_even(greatest(sx, ex) / 12.0, 0), round_even((sy + ey) / 2.0 / 6, 0) order by sy, sx, line_idx) = 1"
_NEAR = "exists (select 1 from items i where i.page_id = l.page_id and i.cx <= l.x2 + 80 and l.x1 <= i.cx + 900 and abs(i.cy - l.cy) < 30)"
_OVER = "least(l.x2, i.x2 + 2) - greatest(l.x1, i.x1 - 2)"
_HT = "greatest(i.y2 - i.y1, 1.0)"
_TEXT = f"exists (select 1 from items i where i.page_id = l.page_id and l.cy between i.y1 + greatest(2.0, {_HT} * 0.15) - 2 and i.y2 - greatest(2.0, {_HT} * 0.10) + 2 and {_OVER} > 0 and ({_OVER} >= 24 or {_OVER} >= least(greatest(i.x2 - i.x1, 1.0) * 0.35, greatest(l.x2 - l.x1, 1.0) * 0.55)))"
_IN = "exists (select 1 from page_regions g where g.page_id = l.page_id and l.cx between g.x and g.x + g.width and l.cy between g.y and g.y + g.height)"
cte("ents_t", "select e.*, row_tolerance from ents e join m using (page_id) where kind = 'ocr'", "ents", "m")
cte("ents_r", "select e.*, row_tolerance from ents e join m using (page_id) where kind = 'field_line'", "ents", "m")
chain("tr", "ents_t", "cy", "idx", "row_tolerance")
chain("fr", "ents_r", "cy", "idx", "row_tolerance")
cte("edges", f"""
    select e.page_id, e.id as source, 'band-' || x.best as target, e.kind || '_band_membership' as relationship, cast(0.8 as double) as score from ents e join (select page_id, 'ocr' as kind, idx, best from e_band_i union all select page_id, 'field_line', idx, best from e_band_l) x on x.page_id = e.page_id and x.kind = e.kind and x.idx = e.idx
    union all select e.page_id, e.id, 'label-zone-' || z.zone_idx, 'ocr_zone_membership', {r('z.confidence', 4)} from ents e join lz z on z.page_id = e.page_id where e.kind = 'ocr' and {overlap('e.', 'z.')} > 0
    union all select e.page_id, e.id, 'field-zone-' || z.zone_idx, 'field_line_zone_membership', {r('z.confidence', 4)} from ents e join fz z on z.page_id = e.page_id where e.kind = 'field_line' and {overlap('e.', 'z.')} > 0
    union all select e.page_id, e.id, 'excluded-' || z.source || '-' || z.idx, 'excluded_region', 1.0 from ents e join excl z on z.page_id = e.page_id where e.kind <> 'semantic_region' and {overlap('e.', 'z.')} > 0
    union all select z.page_id, 'label-zone-' || zone_idx, 'label-column-' || column_idx, 'structural_alignment', {r('c.confidence', 4)} from lz z join lcol c using (page_id, column_idx)
    union all select z.page_id, 'field-zone-' || zone_idx, 'field-column-' || column_idx, 'structural_alignment', {r('c.confidence', 4)} from fz z join fcol c using (page_id, column_idx)
    union all select page_id, 'label-zone-' || zone_idx, 'band-' || band_idx, 'band_membership', 0.8 from lz
    union all select page_id, 'field-zone-' || zone_idx, 'band-' || band_idx, 'band_membership', 0.8 from fz
    union all select page_id, 'label-zone-' || label_zone, 'field-zone-' || field_zone, 'ownership', confidence from own
    union all select page_id, 'region-' || label_zone, 'band-' || band_idx, 'structural_band', confidence from own""", "ents", "e_band_i", "e_band_l", "lz", "fz", "lcol", "fcol", "excl", "own")
cte("ents_i", "select * from ents where kind = 'ocr'", "ents")
cte("ents_n", "select * from ents where kind = 'field_line'", "ents")
cte("e_band_i", _best("ents_i", "idx", "band", "band_idx", "0.0"), "ents_i", "band")
cte("e_band_l", _best("ents_n", "idx", "band", "band_idx", "0.0"), "ents_n", "band")
cte("tedge", "select a.page_id, a.id as source, b.id as target, b.cx - a.cx as dx, b.cy - a.cy as dy, " + overlap("a.", "b.") + " as ov, row_tolerance as rt, greatest(28.0, avg_text_width * 0.8) as ct, multiline_band_gap as mg, distance_limit as dl from ents_i a join ents_n b on a.page_id = b.page_id join m on m.page_id = a.page_id", "ents_i", "ents_n", "m")
cte("lg0", "select e.*, row_tolerance as rt, greatest(28.0, avg_text_width * 0.8) as ct, e.cy - lag(e.cy) over w as dy, abs(e.cx - lag(e.cx) over w) as dx from ents_i e join m using (page_id) where e.cx <= page_width * 0.45 window w as (partition by e.page_id order by e.cy, e.cx, e.idx)", "ents_i", "m")
cte("lg", "select *, sum(case when coalesce(dy <= rt * 1.3 and dx <= ct * 1.4, false) then 0 else 1 end) over (partition by page_id order by cy, cx, idx) - 1 as group_idx from lg0", "lg0")
cte("rowstep", "select a.page_id, a.line_idx as a, b.line_idx as b from lines a join lines b on a.page_id = b.page_id and abs(b.cx - a.cx) < 120 and b.cy > a.cy and b.cy - a.cy < 75 where not exists (select 1 from grow r where r.page_id = a.page_id and r.bottom_y > a.cy and r.bottom_y < b.cy)", "lines", "grow")
cte("reach", "select page_id, a, b from rowstep union select r.page_id, r.a, s.b from reach r join rowstep s on r.page_id = s.page_id and r.b = s.a", "rowstep")
cte("nm", "select *, row_number() over (partition by page_id order by cy, line_idx) as k, x2 - x1 as w from lines", "lines")
cte("nms", "select page_id, k, [{'cy': cy, 'x': x1, 'w': w}] as kept, line_idx, true as keep from nm where k = 1 union all select page_id, k, case when hit then kept else list_append(kept, {'cy': cy, 'x': x1, 'w': w}) end, line_idx, not hit from (select c.page_id, c.k, c.line_idx, c.cy, c.x1, c.w, p.kept, coalesce(list_bool_or([abs(c.cy - q.cy) <= 6 and abs(c.x1 - q.x) < 20 and abs(c.w - q.w) < 20 for q in p.kept]), false) as hit from nms p join nm c on c.page_id = p.page_id and c.k = p.k + 1)", "nm")
cte("flag_i", f"select i.* from items i join heights using (page_id) where {mappable('ph')}", "items", "heights")
cte("flag_m", "select i.page_id, i.item_idx, l.line_idx, abs(l.cy - i.y2) as d from flag_i i join lines l on l.page_id = i.page_id and l.cy between i.y2 - 10 and i.y2 + 75 and l.x1 >= least(i.x2, 620.0) - 40 qualify row_number() over (partition by i.page_id, i.item_idx order by abs(l.cy - i.y2), l.x2 - l.x1 desc, l.line_idx) = 1", "flag_i", "lines")
_NAME = r"regexp_replace(%s, '[^A-Za-z0-9_]+', '_', 'g')"


def _safe(label: str) -> str:
    base = _NAME % (S % f"coalesce({label}, '')")
    return f"(case when {base} = '' then 'field' else {base} end)"


_DELTA = {"mapping_count_delta": "mapping_count", "unmatched_label_delta": "unmatched_label_count", "strong_match_delta": "strong_match_count", "weak_match_delta": "weak_match_count", "ambiguous_delta": "ambiguous_mapping_count", "unresolved_delta": "unresolved_mapping_count"}

cte("lgroup", "select page_id, group_idx, count(*) as n, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from lg group by page_id, group_idx", "lg")
cte("old0", f"select a.page_id, a.item_idx, b.line_idx, a.x1 as ax1, a.y1 as ay1, a.x2 as ax2, a.y2 as ay2, b.x1 as bx1, b.x2 as bx2, b.cy - (a.y1 + a.y2) / 2 as dy, b.cx - (a.x1 + a.x2) / 2 as dx, greatest(a.x2 - a.x1, 1.0) as lw, greatest(a.y2 - a.y1, 1.0) as lh, greatest(b.x2 - b.x1, 1.0) as fw, row_tolerance, multiline_band_gap, {r('greatest(28.0, avg_text_width * 0.8)', 2)} as column_tolerance, avg_line_length, coalesce((select max(case when q.n > 1 then 0.55 else 0.42 end) from lgroup q where q.page_id = a.page_id and a.x1 < q.x2 and a.x2 > q.x1 and a.y1 >= q.y1 - greatest(row_tolerance, greatest(a.y2 - a.y1, 1.0) * 1.25)), 0.0) as raised, coalesce((select max(z.confidence) from textual z where z.page_id = a.page_id and {overlap('a.', 'z.')} > 0 and {overlap('b.', 'z.')} > 0), 0.0) as region_support from items a join lines b on a.page_id = b.page_id join m on m.page_id = a.page_id", "items", "lines", "m", "lgroup", "textual")
cte("textual", "select page_id, x as x1, y as y1, x + width as x2, y + height as y2, confidence from regions where type in ('multiline_text_region', 'standard_input', 'table_like_region')", "regions")
cte("old1", "select *, " + ", ".join(f"{_clamped(v)} as {k}" for k, v in _FEATURES.items()) + " from old0", "old0")
cte("old2", "select *, " + _clamped("clamp1(same_row * 0.35 + same_column * 0.2 + vertical_continuation * 0.25 + spacing_similarity * 0.2)") + " as alignment_score from old1", "old1")
SYMBOLS = r"length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) / greatest(length(text), 1)"
ALNUM = r"length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))"

_REASONS = ["square_sparse_enclosed_region", "repeated_row_alignment", "aligned_repeated_field_lines", "wide_sparse_enclosed_region", "large_sparse_enclosure", "large_enclosed_sparse_region", "tall_low_text_enclosed_region"]
cte("bottoms", "select page_id, region_idx as line_idx, cast(x as integer) as sx, cast(y + height as integer) as sy, cast(x + width as integer) as ex, cast(y + height as integer) as ey, 'box' as field_type from contours join sizes using (page_id) where width >= 80 and height between 12 and 90 and width <= image_width * 0.95 and height <= image_height * 0.25 and rectangularity >= 0.35", "contours", "sizes")
cte("weak", "select page_id, line_idx, sx, sy, ex, ey, 'weak_line' as field_type from lines where abs(sy - ey) <= 8", "lines")
cte("extra", "select page_id, row_number() over (partition by page_id order by src, line_idx) - 1 as line_idx, sx, sy, ex, ey, field_type from (select 0 as src, * from bottoms union all select 1, * from weak)", "bottoms", "weak")
cte("ruled", "select c.* from contours c join sizes using (page_id) where width >= 120 and height >= 60 and width <= image_width * 0.98 and height <= image_height * 0.75 and h_rules >= 2 and v_rules >= 2", "contours", "sizes")
cte("squares", "select c.* from contours c where width between 10 and 32 and height between 10 and 32 and width / height between 0.85 and 1.18 and rectangularity between 0.18 and 0.95 and vertices between 4 and 6 and not exists (select 1 from items i where i.page_id = c.page_id and c.x <= i.x2 + 2 and c.x + c.width >= i.x1 - 2 and c.y <= i.y2 + 2 and c.y + c.height >= i.y1 - 2)", "contours", "items")
cte("squares1", "select * from squares qualify row_number() over (partition by page_id, round_even(x / 4.0, 0), round_even(y / 4.0, 0), round_even(width / 4.0, 0), round_even(height / 4.0, 0) order by region_idx) = 1", "squares")
cte("ticks", "select b.page_id, region_idx, cast(x as integer) as x, cast(y as integer) as y, cast(width as integer) as width, cast(height as integer) as height, item_idx, text as label from squares1 b join items i on i.page_id = b.page_id and abs(i.cy - (y + height / 2)) <= 35 and abs(i.cx - (x + width / 2)) + abs(i.cy - (y + height / 2)) * 2 <= 260 qualify row_number() over (partition by b.page_id, region_idx order by abs(i.cx - (x + width / 2)) + abs(i.cy - (y + height / 2)) * 2, item_idx) = 1", "squares1", "items")
_SKIPPED = "('photo_region', 'signature_area', 'checkbox_region', 'table_like_region', 'stamp_area', 'logo_region', 'decorative_box')"
cte("l_region", f"select l.page_id, l.line_idx, g.type as region_type from lines l join regions g on g.page_id = l.page_id and g.type not in {_SKIPPED} and least(l.x2, g.x + g.width) > greatest(l.x1, g.x) and least(l.y2, g.y + g.height) > greatest(l.y1, g.y) qualify row_number() over (partition by l.page_id, l.line_idx order by g.region_idx) = 1", "lines", "regions")
cte("l_wide", "select page_id, coalesce(median(length) filter (where length > 0), 220) as lwm from lines group by page_id", "lines")
cte("why0", "select c.*, mh, lwm, region_type, 1 - least(abs(c.bcy - ay1), abs(c.bcy - ay2)) / greatest(greatest(42.0, mh * 3.4), 1.0) as near, s.local_score, s.candidate_score, s.distance, row_number() over w as rank, lead(s.candidate_score) over w as second from score1 c join pool using (page_id, item_idx, line_idx) join scores s using (page_id, item_idx, line_idx) join l_wide using (page_id) join lmet using (page_id) left join l_region using (page_id, line_idx) window w as (partition by page_id, item_idx order by s.candidate_score desc, s.bcy, s.bcx, line_idx)", "score1", "pool", "scores", "l_wide", "lmet", "l_region")
_FOR = ["case when bcx - acx > 0 then 'right_of_label' else 'left_of_label' end", "case when ve >= 0.72 then 'strong_vertical_alignment' when ve >= 0.38 then 'weak_vertical_alignment' end", "case when bcy between ay1 and ay2 + mh * 0.8 then 'row_overlap' when near >= 0.45 then 'row_nearby' else 'row_separated' end", "case when " + _clamped("clamp1(1 - abs(length - lwm) / greatest(lwm * 1.6, 1.0))") + " >= 0.6 then 'field_size_consistent' else 'field_size_outlier' end", "case when field_type in ('box', 'weak_line', 'fallback_text_region') then 'field_source_' || field_type end", "case when length <= 260 then 'compact_field_candidate' end", "case when su < 0.55 then 'low_ocr_confidence' end", "'region_' || region_type"]
_AGAINST = ["case when bcx <= ax2 - ct * 0.25 then 'not_right_of_label' end", "case when in_table then 'inside_table_region' end", "case when ve < 0.38 then 'poor_vertical_alignment' end", "case when excluded > 0.5 then 'inside_excluded_region' end"]


def _listed(parts: list[str]) -> str:
    return f"concat_ws(',', {', '.join(parts)})"


cte("why", f"select *, {_listed(_FOR)} as reasons, {_listed(_AGAINST)} as rejection_reasons from why0", "why0")
cte("classes_", "select page_id, coalesce(confidence_class, 'unknown') as k, count(*) as n from maps group by 1, 2", "maps")
cte("first_ml", "select station, min(page_id) as page_id from runs where station is not null and mode = 'ml' group by station")
cte("cat1", "select c.*, b.bp, b.br from cat0 c left join (select r.page_id, p.precision_proxy as bp, p.recall_proxy as br from runs r join first_ml f on f.station = r.station join prox p on p.page_id = f.page_id) b using (page_id)", "cat0", "first_ml", "prox")
_AGAINST_BASE = [(n, f"({c}) or coalesce(recall_proxy + 0.08 < br, false)" if n == "over-aggressive filtering" else c) for n, c in _CATS] + [("precision/recall trade-off regression", "precision_proxy + 0.05 < bp and ambiguous_mapping_count > 0")]
cte("raw_items", "select row_id, any_value(bbox) as bbox, any_value(center) as center, any_value(source_item_count) as sic, len(any_value(bbox)) = 4 as boxed from result_rows where row_id is not null group by row_id")
_ENDS = {"bottom": ("list_max([p[2] for p in bbox])", "center[2]"), "right": ("list_max([p[1] for p in bbox])", "center[1]"), "left": ("list_min([p[1] for p in bbox])", "center[1]")}
cte("vrow", "select * from grow where not regexp_matches(lower(text), 'snb|jspcb|affix|contd')", "grow")
cte("kept_l", "select l.* from lines l join nms using (page_id, line_idx) where nms.keep", "lines", "nms")
cte("clean_l", "select * from (select *, sum(case when abs(cy - pc) < 14 then 0 else 1 end) over (partition by page_id order by cy, line_idx) as gi from (select *, lag(cy) over (partition by page_id order by cy, line_idx) as pc from kept_l)) qualify count(*) over (partition by page_id, gi) < 4", "kept_l")
cte("cstep", "select a.page_id, a.line_idx as a, b.line_idx as b from clean_l a join clean_l b on a.page_id = b.page_id and abs(b.cx - a.cx) < 120 and b.cy > a.cy and b.cy - a.cy < 75 where not exists (select 1 from vrow r where r.page_id = a.page_id and r.bottom_y > a.cy and r.bottom_y < b.cy)", "clean_l", "vrow")
cte("creach", "select page_id, a, b from cstep union select r.page_id, r.a, s.b from creach r join cstep s on r.page_id = s.page_id and r.b = s.a", "cstep")
cte("cbelow", "select page_id, a, list(b) as bs from creach group by page_id, a", "creach")
cte("rcand", "select page_id, row_idx, any_value(text) as text, list({'line': line_idx, 'd': d, 'g': list_prepend(line_idx, coalesce(bs, []))} order by d, w desc, line_idx) as cs, row_number() over (partition by page_id order by row_idx) as k from (select r.page_id, r.row_idx, r.text, l.line_idx, abs(l.cy - r.bottom_y) as d, l.x2 - l.x1 as w, bs from vrow r join clean_l l on l.page_id = r.page_id and l.cy between r.bottom_y - 10 and r.bottom_y + 75 and l.x1 >= r.right_x - 40 left join cbelow c on c.page_id = l.page_id and c.a = l.line_idx) group by page_id, row_idx", "vrow", "clean_l", "cbelow")
cte("rtake", "select page_id, k, row_idx, text, cs[1] as best, cs[1].g as taken from rcand where k = 1 union all select page_id, k, row_idx, text, best, case when best is null then taken else list_concat(taken, best.g) end from (select c.page_id, c.k, c.row_idx, c.text, p.taken, list_filter(c.cs, lambda x: not list_contains(p.taken, x.line))[1] as best from rtake p join rcand c on c.page_id = p.page_id and c.k = p.k + 1)", "rcand")

cte("extra1", f"select *, least(sx, ex) :: double as x1, least(sy, ey) :: double as y1, greatest(sx, ex) :: double as x2, greatest(sy, ey) :: double as y2, (sx + ex) / 2.0 as cx, (sy + ey) / 2.0 as cy, sqrt(((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) :: double) as length from extra {DEDUP}", "extra")
cte("every0", "select page_id, row_number() over (partition by page_id order by src, line_idx) - 1 as line_idx, sx, sy, ex, ey, field_type from (select 0 as src, page_id, line_idx, sx, sy, ex, ey, field_type from lines union all select 1, page_id, line_idx, sx, sy, ex, ey, field_type from extra1)", "lines", "extra1")
cte("every1", f"select *, least(sx, ex) :: double as x1, least(sy, ey) :: double as y1, greatest(sx, ex) :: double as x2, greatest(sy, ey) :: double as y2, (sx + ex) / 2.0 as cx, (sy + ey) / 2.0 as cy, sqrt(((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) :: double) as length from every0 {DEDUP}", "every0")
cte("every_counts", "select c.*, (select count(*) from every1 l where l.page_id = c.page_id and l.cx between c.x and c.x + c.width and l.cy between c.y and c.y + c.height) as every_lines from counts c", "counts", "every1")
cte("run_raw", "select c.* exclude (line_count, every_lines), every_lines as line_count, image_width as iw, image_height as ih, coalesce(th, 18) as th, coalesce(tw, 72) as tw, c.width / greatest(c.height, 1) as a, c.width * c.height / greatest(image_width * image_height, 1.0) as area from every_counts c join sizes using (page_id) left join textsize using (page_id) where rectangularity >= 0.18", "every_counts", "sizes", "textsize")
cte("run_out", "select page_id, x as x1, y as y1, x + width as x2, y + height as y2 from (select *, case " + " ".join(f"when {c} then '{n}'" for n, _, c in _RULES) + " else 'standard_input' end as type from run_raw) where type in ('non_text_sparse_region', 'non_text_candidate', 'photo_region', 'signature_area', 'table_like_region', 'checkbox_region')", "run_raw")

ORACLES: dict[str, str] = {
    "processed_field_lines": build(f"select page_id, line_idx, sx, sy, ex, ey, field_type from every1 l where abs(sy - ey) < 5 and length > 100 and cx > 300 and {_NEAR} and not {_TEXT} and not exists (select 1 from run_out g where g.page_id = l.page_id and l.cx between g.x1 and g.x2 and l.cy between g.y1 and g.y2) {DEDUP}", "every1", "items", "run_out"),
    "box_bottom_lines": build("select * from bottoms", "bottoms"),
    "weak_lines": build("select * from weak", "weak"),
    "additional_candidates": build(f"select page_id, line_idx, sx, sy, ex, ey, field_type from extra {DEDUP}", "extra"),
    "region_size_gate": build("select page_id, region_idx from contours join sizes using (page_id) left join textsize using (page_id) where width >= greatest(44, image_width * 0.025) and height >= greatest(14, coalesce(th, 18) * 0.85) and width <= image_width * 0.985 and height <= image_height * 0.9", "contours", "sizes", "textsize"),
    "region_reasons": build("select page_id, region_idx, type, reason, " + f"{r('a', 4)} as aspect_ratio, {r('area', 4)} as page_area_ratio, {r('ink', 4)} as ink_density, {r('rectangularity', 4)} as box_fill" + " from (select *, case " + " ".join(f"when {c} then '{n}'" for n, _, c in _RULES) + " else 'standard_input' end as type, case " + " ".join(f"when {c} then '{w}'" for (_, _, c), w in zip(_RULES, _REASONS)) + " else 'standard_field_geometry' end as reason from raw_regions)", "raw_regions"),
    "ruled_tables": build("select page_id, region_idx, cast(x as integer) as x, cast(y as integer) as y, cast(width as integer) as width, cast(height as integer) as height from ruled", "ruled"),
    "lines_outside_tables": build("select page_id, line_idx from lines l where not exists (select 1 from ruled t where t.page_id = l.page_id and l.cx between t.x and t.x + t.width and l.cy between t.y and t.y + t.height)", "lines", "ruled"),
    "checkbox_mappings": build("select * from ticks", "ticks"),
    "candidate_region": build("select * from l_region", "l_region"),
    "candidate_reasons": build("select page_id, item_idx, line_idx, reasons, rejection_reasons from why", "why"),
    "score_breakdown": build(f"select page_id, item_idx, line_idx, local_score, global_structure_score, column_consistency, ownership_confidence, {r('ho', 4)} as horizontal_alignment, {r('ve', 4)} as vertical_alignment, {r('ro', 4)} as row_overlap, {r('se', 4)} as semantic_hints, {r('su', 4)} as ocr_confidence, alignment_score, vertical_continuation, x_overlap_ratio, spacing_similarity, size_consistency, ownership_strength, region_support from why where rank = 1", "why"),
    "rejected_candidates": build("select page_id, item_idx, rank, line_idx, candidate_score, rejection_reasons from why where rank between 2 and 5", "why"),
    "ambiguity_notes": build(f"select page_id, item_idx, case when candidate_score < 0.42 then 'candidate_score_below_threshold' when second is not null and {r('candidate_score - second', 6)} < 0.08 then 'close_second_candidate' when rejected then 'selected_candidate_has_rejections' else '' end as note from ranked where rank = 1", "ranked"),
    "api_class_map": build("select page_id, string_agg(k || '=' || n, ',' order by k) as classes from classes_ group by page_id", "classes_"),
    "merged_counters": build("select page_id, " + ", ".join(f"coalesce(s.{c}, (select n from classes_ q where q.page_id = m.page_id and q.k = '{k}'), 0) as {c}" for c, k in (("strong_match_count", "strong_match"), ("weak_match_count", "weak_match"))) + " from (select distinct page_id from maps) m left join (select * from summary where unmatched_label_count > 0) s using (page_id)", "maps", "summary", "classes_"),
    "page_diagnostics": build(f"select page_id, labels_processed, merged_item_count, source_items_merged, coalesce(a.n, 0) as mappings_selected, coalesce(b.n, 0) as field_candidate_count, coalesce(c.n, 0) as semantic_region_count, coalesce(d.n, 0) as excluded_region_count from (select page_id, count(*) as labels_processed, count(*) filter (where source_item_count > 1) as merged_item_count, cast(sum(greatest(source_item_count, 1)) as bigint) as source_items_merged from items group by page_id) left join (select page_id, count(*) as n from maps group by page_id) a using (page_id) left join (select page_id, count(*) as n from lines group by page_id) b using (page_id) left join (select page_id, count(*) as n from regions group by page_id) c using (page_id) left join (select page_id, count(*) as n from regions where type in {_TYPES} group by page_id) d using (page_id)", "items", "maps", "lines", "regions"),
    "field_type_counts": build("select page_id, count(*) as mapping_count, count(*) filter (where field_type = 'checkbox') as checkbox_count, count(*) filter (where field_type = 'multi_line') as multi_line_count from maps group by page_id", "maps"),
    "category_order": build("select category, n, row_number() over (order by n desc, category) as place from (select category, count(*) as n from cats group by category)", "cats"),
    "failure_categories_vs_baseline": build(" union all ".join(f"select page_id, '{n}' as category from cat1 where {c}" for n, c in _AGAINST_BASE), "cat1"),
    "bounds_polygons": build("select page_id, item_idx, array_to_string([cast(floor(v * 10 + 0.5) as bigint) for v in [x1, y1, x2, y1, x2, y2, x1, y2]], ',') as corners from items", "items"),
    "item_extents": build("select row_id, " + ", ".join(f"{r(f'case when boxed then {a} else coalesce({b}, 0.0) end', 4)} as \"{n}\"" for n, (a, b) in _ENDS.items()) + " from raw_items", "raw_items"),
    "explicit_boxes": build("select mapping_id, page_id, box_idx, x, y, width, height, field_type from boxes union all select -(page_id * 10 + region_idx) - 1, page_id, 0, x, y, width, height, 'checkbox' from ticks", "boxes", "ticks"),
    "valid_numbers": ("select mapping_id, coalesce(not isnan(d), false) as valid from (select mapping_id, arg_max(distance, loaded_at) as d from mappings where mapping_id is not null group by mapping_id)"),
    "run_addresses": ("select run_id, case when regexp_matches(source_image, '^https?://') then source_image when source_image like '/%' then 'http://host' || source_image when source_image <> '' then 'http://host/' || source_image end as url, case when source_image like '/%' then source_image else '/data/' || source_image end as path, '/runs/' || run_id || '/mappings.json' as mappings from runs"),
    "row_flags": build("select page_id, row_idx, text <> '' as useful, regexp_matches(lower(text), 'snb|jspcb|affix|contd') as noise, (select count(*) from lines l where l.page_id = g.page_id and l.cy between g.top_y - 10 and g.bottom_y + 10) >= 2 as table_row from grow g", "grow", "lines"),
    "row_assignments": build("select page_id, row_idx, text as label, best.line as line_idx, array_to_string(list_sort(best.g), ',') as group_lines, len(best.g) as group_size, best.d as vertical_distance from rtake where best is not null", "rtake"),
    "flagship_label_field_match": build(f"select page_id, labels, coalesce(matched, 0) as matched, coalesce(lines_used, 0) as lines_used, mean_distance from (select page_id, count(*) as labels from flag_i group by page_id) left join (select page_id, count(*) as matched, count(distinct line_idx) as lines_used, {r('avg(d)', 4)} as mean_distance from flag_m group by page_id) using (page_id)", "flag_i", "flag_m"),
    "geom_bounds": build("select page_id, item_idx, x1, y1, x2, y2, cx, cy from items", "items"),
    "geom_center_length": build(f"select page_id, line_idx, x1, y1, x2, y2, cx, cy, {r('length', 6)} as length from lines", "lines"),
    "overlap_ratio_pairs": build(f"select a.page_id, item_idx, line_idx, {r(overlap('a.', 'b.'), 6)} as overlap, {r('least(1.0, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / greatest(least(greatest(a.x2 - a.x1, 1.0), greatest(b.x2 - b.x1, 1.0)), 1.0))', 6)} as x_overlap from items a join lines b on a.page_id = b.page_id", "items", "lines"),
    "vertical_overlap_pairs": build(f"select page_id, a_idx, b_idx, {r('ratio', 6)} as ratio from (select a.page_id, a.item_idx as a_idx, b.item_idx as b_idx, greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / greatest(least(a.y2 - a.y1, b.y2 - b.y1), 1.0) as ratio from items a join items b on a.page_id = b.page_id and a.item_idx < b.item_idx) where ratio >= 0.45", "items"),
    "layout_metrics": build("select * from m", "m"),
    "ocr_noise_filter": build("select page_id, item_idx, text, median_height from noise", "noise"),
    "ocr_first_fit_rows": build("select page_id, item_idx, row_idx from ff", "ff"),
    "ocr_merge_tokens": build(f"select page_id, row_idx, run_idx, {S % _SPACED} as text, x1, y1, x2, y2, {r('cf', 4)} as confidence, source_item_count, tokens from parts", "parts"),
    "line_dedup_buckets": build(f"select page_id, line_idx from lines {DEDUP}", "lines"),
    "line_near_text_semi": build(f"select page_id, line_idx from lines l where {_NEAR}", "lines", "items"),
    "line_over_text_anti": build(f"select page_id, line_idx from lines l where not {_TEXT}", "lines", "items"),
    "line_outside_region_anti": build(f"select page_id, line_idx from lines l where not {_IN}", "lines", "page_regions"),
    "field_line_filter": build(f"select page_id, line_idx, sx, sy, ex, ey, field_type from lines l where abs(sy - ey) < 5 and length > 100 and cx > 300 and {_NEAR} and not {_TEXT} and not {_IN} {DEDUP}", "lines", "items", "page_regions"),
    "region_counts": build("select page_id, region_idx, ocr_count, line_count from counts", "counts"),
    "region_classify": build("select page_id, region_idx, type, confidence, ocr_count, line_count from regions", "regions"),
    "excluded_regions": build("select * from excl", "excl"),
    "row_groups_gap": build("select page_id, item_idx, row_idx from gap0", "gap0"),
    "table_line_groups": build("select * from tables_", "tables_"),
    "table_rules_removed": build("select page_id, line_idx from (select *, sum(case when abs(cy - pc) < 14 then 0 else 1 end) over (partition by page_id order by cy, line_idx) as gi from (select *, lag(cy) over (partition by page_id order by cy, line_idx) as pc from lines)) qualify count(*) over (partition by page_id, gi) < 4", "lines"),
    "label_run_groups": build("select page_id, group_idx, count(*) as item_count, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, case when count(*) > 1 then 'multiline_label' else 'single_label' end as group_type from lg group by page_id, group_idx", "lg"),
    "row_merge_pairs": build("select page_id, row_idx, role, merged_idx from merge_r", "merge_r"),
    "row_geometry": build("select page_id, row_idx, text, item_count, bottom_y, top_y, center_y, right_x, raw_right_x, left_x from grow", "grow"),
    "column_split_gap": build("select * from split", "split"),
    "axis_clusters_y": build(f"select page_id, kind, idx, g as band_idx, {r('mean', 2)} as center from bm", "bm"),
    "axis_clusters_x": build(f"select page_id, kind, idx, g as column_idx, {r('mean', 2)} as center from lm union all select page_id, kind, idx, g, {r('mean', 2)} from fm", "lm", "fm"),
    "bands": build("select * from band", "band"),
    "columns_primary": build("select * from lcol union all select * from fcol", "lcol", "fcol"),
    "zones": build("select * from lz union all select * from fz", "lz", "fz"),
    "text_rows": build(f"select page_id, g as row_idx, {r('any_value(mean)', 2)} as center_y, count(*) as item_count, string_agg(text, ' | ' order by cy, idx) as texts from tr group by page_id, g", "tr"),
    "field_row_clusters": build(f"select page_id, g as row_idx, {r('any_value(mean)', 2)} as center_y, count(*) as line_count, min(cx) as min_x, max(cx) as max_x, min(cy) as min_y, max(cy) as max_y, {r('coalesce(median(length) filter (where length > 0), any_value(avg_line_length))', 2)} as avg_line_length, case when count(*) >= 3 then 'repeated_row' else 'field_row' end as type from fr join m using (page_id) group by page_id, g", "fr", "m"),
    "ownership_best_zone": build("select * from own", "own"),
    "best_zone_for_item": build("select i.page_id, 'label' as kind, i.item_idx as idx, z.best as zone, b.best as band from items i left join i_zone z using (page_id, item_idx) left join i_band b using (page_id, item_idx) union all select l.page_id, 'line', l.line_idx, z.best, b.best from lines l left join l_zone z using (page_id, line_idx) left join l_band b using (page_id, line_idx)", "i_zone", "i_band", "l_zone", "l_band"),
    "excluded_flag": build("select * from l_excl", "l_excl"),
    "graph_edges_theta": build(
        f"select page_id, source, target, 'same_row' as relationship, (case when dx >= 0 then 0.85 else 0.55 end) :: double as score from tedge where abs(dy) <= rt union all select page_id, source, target, 'same_column', cast(0.64 as double) from tedge where abs(dx) <= ct union all select page_id, source, target, 'spatial_overlap', {r(clamp('ov'), 4)} from tedge where ov > 0 union all select page_id, source, target, 'vertical_continuation', {r(clamp('1 - dy / mg'), 4)} from tedge where dy > 0 and dy <= mg union all select page_id, source, target, 'proximity', {r(clamp('1 - sqrt(dx * dx + dy * dy) / dl'), 4)} from tedge where sqrt(dx * dx + dy * dy) <= dl union all select a.page_id, a.id, b.id, case when a.kind = 'ocr' then 'enclosure' else 'enclosed_in' end, {r('b.confidence', 4)} from ents a join ents b on a.page_id = b.page_id and b.kind = 'semantic_region' and a.kind <> 'semantic_region' where {overlap('a.', 'b.')} > 0",
        "tedge", "ents",
    ),
    "graph_membership_edges": build("select * from edges", "edges"),
    "graph_adjacency": build("select page_id, source, count(*) as degree, string_agg(target, ',' order by target) as targets from edges group by page_id, source", "edges"),
    "pair_features": build("select page_id, item_idx, line_idx, " + ", ".join(_OUT) + " from feat", "feat"),
    "candidate_scores": build("select page_id, item_idx, line_idx, local_score, global_structure_score, candidate_score, rejected, distance from scores", "scores"),
    "candidate_top5": build("select page_id, item_idx, rank, line_idx, candidate_score from ranked where rank <= 5", "ranked"),
    "candidate_class": build(f"select page_id, item_idx, line_idx, candidate_score, case when candidate_score < 0.42 then 'unresolved' when second is not null and {r('candidate_score - second', 6)} < 0.08 then 'ambiguous' when rejected then 'weak_match' when candidate_score >= 0.66 and {r('candidate_score - coalesce(second, 0)', 6)} >= 0.1 then 'strong_match' else 'weak_match' end as confidence_class from ranked where rank = 1", "ranked"),
    "line_nms": build("select page_id, line_idx from nms where keep", "nms"),
    "multiline_closure": build("select distinct page_id, a, b from reach", "reach"),
    "row_line_match": build("select r.page_id, r.row_idx, r.text, l.line_idx, abs(l.cy - r.bottom_y) as vertical_distance from grow r join lines l on l.page_id = r.page_id and l.cy between r.bottom_y - 10 and r.bottom_y + 75 and l.x1 >= r.right_x - 40 qualify row_number() over (partition by r.page_id, r.row_idx order by abs(l.cy - r.bottom_y), l.x2 - l.x1 desc, l.line_idx) = 1", "grow", "lines"),
    "checkbox_not_on_text": build("select page_id, region_idx from contours c where not exists (select 1 from items i where i.page_id = c.page_id and c.x <= i.x2 + 2 and c.x + c.width >= i.x1 - 2 and c.y <= i.y2 + 2 and c.y + c.height >= i.y1 - 2)", "contours", "items"),
    "checkbox_nearest_label": build("select page_id, region_idx, item_idx, text as label, score from (select c.page_id, c.region_idx, i.item_idx, i.text, abs(i.cx - (c.x + c.width / 2)) + abs(i.cy - (c.y + c.height / 2)) * 2 as score from contours c join items i on i.page_id = c.page_id where abs(i.cy - (c.y + c.height / 2)) <= 35) where score <= 260 qualify row_number() over (partition by page_id, region_idx order by score, item_idx) = 1", "contours", "items"),
    "fallback_lines": build("select page_id, line_idx, sx, sy, ex, ey, field_type from fallback", "fallback"),
    "union_candidates": build(f"select page_id, line_idx, sx, sy, ex, ey, field_type from (select page_id, sx, sy, ex, ey, field_type, row_number() over (partition by page_id order by s, line_idx) - 1 as line_idx from (select 0 as s, page_id, line_idx, sx, sy, ex, ey, field_type from lines union all select 1, page_id, line_idx, sx, sy, ex, ey, field_type from fallback)) {DEDUP}", "lines", "fallback"),
    "entities_union": build("select page_id, kind, id, text, entity_type, confidence, length, x1, y1, x2, y2, cx, cy from ents", "ents"),
    "label_keyword_filter": build("select page_id, item_idx, text, column_split from labels", "labels"),
    "candidate_pool": build("select page_id, item_idx, line_idx from pool", "pool"),
    "text_case_ratio": build(f"select page_id, item_idx, {r(UPPER, 6)} as upper_ratio, {r(SYMBOLS, 6)} as symbol_ratio, {ALNUM} as alnum, {PROMPT} as prompt from items", "items"),
    "field_name_sanitize": build(f"select mapping_id, {_safe('label')} || '_' || mapping_id as name from maps", "maps"),
    "class_histogram": build("select coalesce(confidence_class, 'unknown') as confidence_class, count(*) as n from maps group by 1", "maps"),
    "region_histogram": build("select coalesce(nullif(region_support, ''), nullif(field_type, ''), 'unknown') as region_type, count(*) as n from maps group by 1", "maps"),
    "mapping_summary": build("select * from summary", "summary"),
    "summary_delta": build("select page_id, " + ", ".join(f"coalesce(b.{c}, 0) - coalesce(a.{c}, 0) as {n}" for n, c in _DELTA.items()) + f", {r('coalesce(b.average_candidate_score, 0) - coalesce(a.average_candidate_score, 0)', 4)} as average_candidate_score_delta from sum_old a full join sum_new b using (page_id)", "sum_old", "sum_new"),
    "api_stats": build(f"select a.*, coalesce(n, 0) as field_candidate_count from (select page_id, count(*) as mapping_count, sum(coalesce(len(field_lines), 0)) as line_count, count(*) filter (where len(field_lines) > 1) as multiline_count, coalesce({r('avg(candidate_score)', 4)}, 0.0) as average_candidate_score from maps group by page_id) a left join (select page_id, count(*) as n from lines group by page_id) using (page_id)", "maps", "lines"),
    "unmatched_labels_except": build("select * from unmatched", "unmatched"),
    "unresolved_labels_anti": build("select page_id, item_idx, text from unresolved", "unresolved"),
    "top_band_unresolved_semi": build("select page_id, item_idx, text from topband", "topband"),
    "ocr_quality_summary": build(f"select i.*, row_count, rows_with_multiple_items from (select page_id, count(*) as item_count, {r('coalesce(median(y2 - y1) filter (where y2 > y1), 0)', 2)} as median_height, {r('coalesce(median(x2 - x1) filter (where x2 > x1), 0)', 2)} as median_width, {r('avg(confidence)', 4)} as mean_confidence, count(*) filter (where confidence < 0.35) as low_confidence_count, count(*) filter (where source_item_count > 1) as merged_item_count, coalesce(sum(source_item_count) filter (where source_item_count > 1), 0) as source_items_merged from items group by page_id) i join (select page_id, count(*) as row_count, count(*) filter (where n > 1) as rows_with_multiple_items from (select page_id, row_idx, count(*) as n from ff_raw group by all) group by page_id) using (page_id)", "items", "ff_raw"),
    "row_compare_nearest": build(f"select a.page_id, case when n.current_row is null then 'missing_current_row' else 'matched' end as status, a.row_idx as baseline_row, n.current_row, {r('n.y_delta', 2)} as y_delta, a.text as baseline_text, n.current_text from row_raw a left join (select * from near_rows where y_delta <= 36) n on n.page_id = a.page_id and n.baseline_row = a.row_idx union all select page_id, 'extra_current_row', null, row_idx, null, null, text from row_clean b where not exists (select 1 from near_rows n where n.y_delta <= 36 and n.page_id = b.page_id and n.current_row = b.row_idx)", "row_raw", "row_clean", "near_rows"),
    "quality_proxies": build("select page_id, mapping_count, ocr_item_count, precision_proxy, recall_proxy, false_positive_proxy from prox", "prox"),
    "failure_categories": build("select * from cats", "cats"),
    "corpus_rollup": build(f"select 'sample_count' as metric, cast(count(*) as double) as value from prox union all select 'average_mapping_confidence', {r('avg(average_candidate_score)', 4)} from prox union all select 'average_recall_proxy', {r('avg(recall_proxy)', 4)} from prox union all select 'average_precision_proxy', {r('avg(precision_proxy)', 4)} from prox union all select 'category: ' || category, cast(count(*) as double) from cats group by 1", "prox", "cats"),
    "baseline_sequence": "select group_id, page_id, case when page_id = b then 'baseline' when page_id > b then 'first pass' else 'second pass' end as compared from (select station as group_id, page_id, coalesce(min(page_id) filter (where mode = 'ml') over (partition by station), min(page_id) over (partition by station)) as b from runs where station is not null)",
    "field_boxes": build("select mapping_id, page_id, box_idx, x, y, width, height, field_type from boxes", "boxes"),
    "pdf_field_geometry": build(f"select page_id, mapping_id, box_idx, {_safe(chr(40) + 'coalesce(label, ' + chr(39) + 'field' + chr(39) + ') || ' + chr(39) + '_' + chr(39) + ' || (box_idx + 1)' + chr(41))} || '_' || mapping_id as name, case when field_type = 'checkbox' then 'checkbox' else 'text' end as kind, {r('x * 612.0 / image_width + 5', 4)} as x, {r('792 - (y + height) * (792.0 / image_height)', 4)} as y, {r('case when field_type = ' + chr(39) + 'checkbox' + chr(39) + ' then greatest(10.0, least(width * (612.0 / image_width), greatest(12.0, height * (792.0 / image_height)))) else greatest(10.0, width * (612.0 / image_width) - 10) end', 4)} as width, {r('case when field_type = ' + chr(39) + 'checkbox' + chr(39) + ' then greatest(10.0, least(width * (612.0 / image_width), greatest(12.0, height * (792.0 / image_height)))) else greatest(12.0, height * (792.0 / image_height)) end', 4)} as height from boxes join sizes using (page_id) where width > 0 and height > 0 and image_width > 0 and image_height > 0", "boxes", "sizes"),
    "overlay_percent_boxes": build(f"select page_id, mapping_id, box_idx, {r('x / image_width * 100', 4)} as \"left\", {r('y / image_height * 100', 4)} as top, {r('width / image_width * 100', 4)} as width, {r('height / image_height * 100', 4)} as height from boxes join sizes using (page_id) where image_width > 0 and image_height > 0", "boxes", "sizes"),
    "layout_metrics_older": build(f"select page_id, page_width, page_height, avg_line_length, row_tolerance, {r('greatest(28.0, avg_text_width * 0.8)', 2)} as column_tolerance, multiline_band_gap as multiline_y_gap, indent_tolerance, distance_limit from m", "m"),
    "pair_features_older": build("select page_id, item_idx, line_idx, " + ", ".join(f"{r(k, 4)} as {k}" for k in _FEATURES) + f", {r('greatest(' + _clamped('clamp1(same_row * 0.32 + vertical_continuation * 0.44 + alignment_score * 0.24)') + ', raised)', 4)} as ownership_strength, {r('region_support', 4)} as region_support, {r('alignment_score', 4)} as alignment_score from old2", "old2"),
    "page_priors": build("select b.page_id, band_count, coalesce(lc, 0) as label_column_count, lp as primary_label_column, coalesce(fc, 0) as field_column_count, fp as primary_field_column, coalesce(zc, 0) as zone_count, coalesce(ec, 0) as excluded_count from (select page_id, count(*) as band_count from band group by page_id) b left join (select page_id, count(*) as lc, max(column_idx) filter (where is_primary) as lp from lcol group by page_id) using (page_id) left join (select page_id, count(*) as fc, max(column_idx) filter (where is_primary) as fp from fcol group by page_id) using (page_id) left join (select page_id, count(*) as zc from (select page_id from lz union all select page_id from fz) group by page_id) using (page_id) left join (select page_id, count(*) as ec from excl group by page_id) using (page_id)", "band", "lcol", "fcol", "lz", "fz", "excl"),
    "row_window_counts": build("select i.page_id, i.item_idx, (select count(*) from lines l where l.page_id = i.page_id and abs(l.cy - i.cy) <= row_tolerance) as row_window_candidates from items i join m using (page_id)", "items", "m", "lines"),
    "first_labels": build("select page_id, string_agg(text, ' | ' order by item_idx) as labels from (select * from items qualify row_number() over (partition by page_id order by item_idx) <= 8) group by page_id", "items"),
    "region_type_list": build("select page_id, string_agg(type, ',' order by k, i) as types, bool_or(contains(type, 'multiline')) as multiline from (select page_id, type, k, i from (select page_id, type, 0 as k, region_idx as i from regions union all select page_id, case when count(*) >= 3 then 'repeated_row' else 'field_row' end, 1, g from fr group by page_id, g union all select page_id, type, 2, band_idx from band union all select page_id, type, 3, label_zone from own) qualify row_number() over (partition by page_id, type order by k, i) = 1) group by page_id", "regions", "fr", "band", "own"),
    "overlay_draw_list": build("select page_id, id, x1, y1, x2, y2, case when kind = 'ocr' then case when confidence < 0.35 then 'low' else 'text' end when kind = 'field_line' then 'line' else 'region' end as colour, substr(coalesce(text, entity_type, ''), 1, 80) as caption from ents", "ents"),
}
