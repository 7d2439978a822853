"""Scalar geometry as column expressions; all stay inside code generation.

A box is four double columns with a common prefix: <p>x1, <p>y1, <p>x2, <p>y2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(v: Column) -> Column:
    """v limited to [0, 1], evaluated once; v must not be null (null would give 1)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def polygon_bounds(bbox: Column) -> tuple[Column, Column, Column, Column]:
    """x1, y1, x2, y2 of an array of [x, y] points."""
    xs, ys = F.transform(bbox, lambda p: p[0]), F.transform(bbox, lambda p: p[1])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def polygon_center(bbox: Column) -> tuple[Column, Column]:
    """Mean of the vertices, which for a skewed polygon isn't the centre of its box."""
    n = F.size(bbox)
    return F.aggregate(bbox, F.lit(0.0), lambda a, p: a + p[0]) / n, F.aggregate(bbox, F.lit(0.0), lambda a, p: a + p[1]) / n


def bounds_polygon(b: tuple[Column, ...]) -> Column:
    """The four corners of a box, from the upper left clockwise."""
    return F.array(*[F.array(b[i], b[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))])


def extent(flat: Column, polygon: Column, centre: Column) -> tuple[Column, Column, Column]:
    """bottom, right, left of an item in any of its forms: four numbers (x, y, width, height), a polygon of points, or its centre alone (0, 0 if that is missing)."""
    is_flat, is_polygon = F.coalesce(F.size(flat) == 4, F.lit(False)), F.coalesce((F.size(polygon) > 0) & F.forall(polygon, lambda p: F.size(p) >= 2), F.lit(False))
    has_centre = F.coalesce(F.size(centre) >= 2, F.lit(False))
    x1, _, x2, y2 = polygon_bounds(polygon)
    cx, cy = (F.when(has_centre, F.try_element_at(centre, F.lit(k))).otherwise(0.0) for k in (1, 2))
    pick = lambda a, b, c: F.when(is_flat, a).when(is_polygon, b).otherwise(c)
    at = lambda k: F.try_element_at(flat, F.lit(k))
    return pick(at(2) + at(4), y2, cy), pick(at(1) + at(3), x2, cx), pick(at(1), x1, cx)


def valid_polygon(bbox: Column) -> Column:
    """Four points of two finite numbers each."""
    return F.coalesce((F.size(bbox) == 4) & F.forall(bbox, lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull() & ~F.isnan(p[0]) & ~F.isnan(p[1])), F.lit(False))


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def center(b: tuple[Column, ...]) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def overlaps(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column]:
    """Lengths of the common x and y spans, 0 if none."""
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])), F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def overlap_ratio(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Common area over the area of a (1 at least): not symmetric; a flat line has none."""
    ox, oy = overlaps(a, b)
    return ox * oy / F.greatest((a[2] - a[0]) * (a[3] - a[1]), F.lit(1.0))


def vertical_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Common height over the lower height (1 at least)."""
    return overlaps(a, b)[1] / F.greatest(F.least(a[3] - a[1], b[3] - b[1]), F.lit(1.0))


def x_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Common width over the smaller width (1 at least)."""
    narrow = F.least(F.greatest(a[2] - a[0], F.lit(1.0)), F.greatest(b[2] - b[0], F.lit(1.0)))
    return clamp01(overlaps(a, b)[0] / narrow)


def inside(x: Column, y: Column, b: tuple[Column, ...], pad: float = 0.0) -> Column:
    """Point in box, bounds included."""
    return x.between(b[0] - pad, b[2] + pad) & y.between(b[1] - pad, b[3] + pad)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def positive_median(v: Column, default: float) -> Column:
    """Exact median of the values above 0, the default if there are none."""
    return F.coalesce(F.median(F.when(v > 0, v)), F.lit(default))


def half_even_key(v: Column, step: int) -> Column:
    """The nearest multiple's number, halves to even."""
    return F.bround(v / step, 0).cast("long")


def round_to(v: Column, digits: int) -> Column:
    """Rounded half up on the decimal value: what lies within 1e-9 of a half goes up, so float noise decides nothing."""
    scale = float(10**digits)
    return F.floor(v * scale + (0.5 + 1e-9)) / scale
