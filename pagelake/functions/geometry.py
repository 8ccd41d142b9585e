"""Column builders for boxes, quads and polygons.

A quad is eight columns x1,y1..x4,y4, clockwise from the top left; a polygon is an array of
structs (x, y); an axis box is xmin,ymin,xmax,ymax.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

QUAD = ("x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4")
BOX = ("xmin", "ymin", "xmax", "ymax")

Num = Column | str | int | float


def _c(value: Num) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def points_of(coords: Sequence[Num]) -> list[tuple[Column, Column]]:
    cols = [_c(v) for v in coords]
    return list(zip(cols[0::2], cols[1::2]))


# ---- conversions -------------------------------------------------------------------------


def bbox_to_quad(left: Num, top: Num, width: Num, height: Num, prefix: str = "") -> list[Column]:
    """[left, top, width, height] to eight corner columns rounded to one decimal."""
    x0, y0, x1, y1 = _c(left), _c(top), _c(left) + _c(width), _c(top) + _c(height)
    corners = (x0, y0, x1, y0, x1, y1, x0, y1)
    return [F.bround(v.cast("double"), 1).alias(prefix + n) for n, v in zip(QUAD, corners)]


def ltrb_to_quad(left: Num, top: Num, right: Num, bottom: Num, prefix: str = "") -> list[Column]:
    x0, y0, x1, y1 = (_c(v) for v in (left, top, right, bottom))
    return [v.alias(prefix + n) for n, v in zip(QUAD, (x0, y0, x1, y0, x1, y1, x0, y1))]


def quad_bounds(coords: Sequence[Num] = QUAD) -> list[Column]:
    """Axis box around a quad; coordinates are truncated to whole numbers first."""
    whole = [_c(v).cast("long") for v in coords]
    xs, ys = whole[0::2], whole[1::2]
    return [
        F.least(*xs).alias("xmin"),
        F.least(*ys).alias("ymin"),
        F.greatest(*xs).alias("xmax"),
        F.greatest(*ys).alias("ymax"),
    ]


def quad_centre(coords: Sequence[Num] = QUAD) -> tuple[Column, Column]:
    pts = points_of(coords)
    return (
        (pts[0][0] + pts[1][0] + pts[2][0] + pts[3][0]) / F.lit(4.0),
        (pts[0][1] + pts[1][1] + pts[2][1] + pts[3][1]) / F.lit(4.0),
    )


def polygon_of(coords: Sequence[Num] = QUAD) -> Column:
    return F.array(
        *[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points_of(coords)]
    )


# ---- polygons ----------------------------------------------------------------------------


def _edges(polygon: Column) -> Column:
    """Each vertex next to its successor; the ring is closed."""
    return F.arrays_zip(
        polygon.alias("a"),
        F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1)).alias("b"),
    )


def _sum(array: Column, term) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, e: acc + term(e))


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def polygon_area(polygon: Column) -> Column:
    """Signed area by the shoelace sum."""
    return _sum(_edges(polygon), _cross) / F.lit(2.0)


def once(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once, however often ``fn`` reads it."""
    return F.get(F.transform(F.array(value), fn), 0)


def _centroid(polygon: Column) -> Column:
    """Struct (x, y) of the area-weighted centre, from one walk along the edges; null coordinates for a polygon without area."""
    names = ("doubled", "x", "y")

    def add(acc: Column, e: Column) -> Column:
        cross = _cross(e)
        terms = (cross, (e["a"]["x"] + e["b"]["x"]) * cross, (e["a"]["y"] + e["b"]["y"]) * cross)
        return F.struct(*[(acc[n] + term).alias(n) for n, term in zip(names, terms)])

    def centre(sums: Column) -> Column:
        area6 = sums["doubled"] / F.lit(2.0) * F.lit(6.0)
        return F.struct(*[F.try_divide(sums[n], area6).alias(n) for n in "xy"])

    zero = F.struct(*[F.lit(0.0).alias(n) for n in names])
    return once(once(polygon, lambda ring: F.aggregate(_edges(ring), zero, add)), centre)


def polygon_centroid(polygon: Column) -> tuple[Column, Column]:
    """Area-weighted centre; null for a polygon without area."""
    centre = _centroid(polygon)
    return centre["x"], centre["y"]


def quad_area(coords: Sequence[Num] = QUAD) -> Column:
    """Signed area of a quad: the terms of ``polygon_area`` in the same order, without an array."""
    return sum(_quad_crosses(coords), F.lit(0.0)) / F.lit(2.0)


def quad_centroid(coords: Sequence[Num] = QUAD) -> tuple[Column, Column]:
    """Area-weighted centre of a quad, as ``polygon_centroid`` has it; null for a quad without area."""
    p, crosses = _corners(coords), _quad_crosses(coords)
    area6 = sum(crosses, F.lit(0.0)) / F.lit(2.0) * F.lit(6.0)
    return tuple(F.try_divide(sum(((a[k] + b[k]) * c for a, b, c in zip(p, p[1:] + p[:1], crosses)), F.lit(0.0)), area6) for k in (0, 1))


def _corners(coords: Sequence[Num]) -> list[tuple[Column, Column]]:
    return [(x.cast("double"), y.cast("double")) for x, y in points_of(coords)]


def _quad_crosses(coords: Sequence[Num]) -> list[Column]:
    p = _corners(coords)
    return [a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])]


def dist(x0: Num, y0: Num, x1: Num, y1: Num) -> Column:
    dx, dy = _c(x1) - _c(x0), _c(y1) - _c(y0)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def _side(e: Column) -> Column:
    return dist(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])


def perimeter(polygon: Column) -> Column:
    return _sum(_edges(polygon), _side)


def min_side(polygon: Column) -> Column:
    return F.array_min(F.transform(_edges(polygon), _side))


def scale_polygon(polygon: Column, offset: Num) -> Column:
    """Each coordinate moves away from the centroid by ``offset``."""
    step = _c(offset)

    def moved(centre: Column) -> Column:
        return F.transform(
            polygon,
            lambda p: F.struct(
                F.when(p["x"] > centre["x"], p["x"] + step).otherwise(p["x"] - step).alias("x"),
                F.when(p["y"] > centre["y"], p["y"] + step).otherwise(p["y"] - step).alias("y"),
            ),
        )

    return once(_centroid(polygon), moved)


def start_corner(polygon: Column) -> Column:
    """Rotate the ring so that it starts at its (first) corner of smallest x + y."""
    sums = F.transform(polygon, lambda p: p["x"] + p["y"])
    first = F.array_position(sums, F.array_min(sums)).cast("int")
    n = F.size(polygon)
    return F.concat(F.slice(polygon, first, n), F.slice(polygon, F.lit(1), first - 1))


def rescale_polygon(polygon: Column, ratio_x: Num, ratio_y: Num, net: float = 2.0) -> Column:
    """Score-map coordinates back to image coordinates."""
    return F.transform(
        polygon,
        lambda p: F.struct((p["x"] * _c(ratio_x) * net).alias("x"), (p["y"] * _c(ratio_y) * net).alias("y")),
    )


# ---- quads -------------------------------------------------------------------------------


def closest_corner(px: Num, py: Num, coords: Sequence[Num]) -> Column:
    """Struct (d, i, x, y) of the corner nearest to a point; the first one wins a tie."""
    return F.array_min(
        F.array(
            *[
                F.struct(
                    dist(px, py, x, y).alias("d"),
                    F.lit(i).alias("i"),
                    x.cast("double").alias("x"),
                    y.cast("double").alias("y"),
                )
                for i, (x, y) in enumerate(points_of(coords))
            ]
        )
    )


def mean_diagonal(coords: Sequence[Num] = QUAD) -> Column:
    p = points_of(coords)
    return (dist(*p[0], *p[2]) + dist(*p[1], *p[3])) / F.lit(2.0)


def midpoint(x0: Num, y0: Num, x1: Num, y1: Num) -> tuple[Column, Column]:
    return (_c(x0) + _c(x1)) / F.lit(2.0), (_c(y0) + _c(y1)) / F.lit(2.0)


def angle_3pt(ax: Num, ay: Num, bx: Num, by: Num, cx: Num, cy: Num) -> Column:
    """Turn from a to c around b, in degrees from 0 to 360."""
    turn = F.degrees(F.atan2(_c(cy) - _c(by), _c(cx) - _c(bx)) - F.atan2(_c(ay) - _c(by), _c(ax) - _c(bx)))
    return F.when(turn < 0, turn + 360.0).otherwise(turn)


def orient_vertical(coords: Sequence[Num] = QUAD, ratio: float = 1.5) -> list[Column]:
    """Corner order turned by one for quads much taller than wide."""
    cols = [_c(v) for v in coords]
    xs, ys = cols[0::2], cols[1::2]
    tall = F.greatest(*ys) - F.least(*ys) > (F.greatest(*xs) - F.least(*xs)) * ratio
    turned = cols[6:8] + cols[0:6]
    return [F.when(tall, t).otherwise(c).alias(n) for n, t, c in zip(QUAD, turned, cols)]


def pseudo_char_centres(n: Num, coords: Sequence[Num] = QUAD) -> Column:
    """``n`` evenly spaced points on the line from the left-side to the right-side midpoint."""
    p = points_of(coords)
    ax, ay = midpoint(*p[0], *p[3])
    bx, by = midpoint(*p[1], *p[2])
    count = _c(n).cast("int")

    def at(i: Column) -> Column:
        share = (i.cast("double") + 0.5) / count
        return F.struct((ax + (bx - ax) * share).alias("x"), (ay + (by - ay) * share).alias("y"))

    empty = F.array().cast("array<struct<x:double,y:double>>")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(empty)


def point_in_quad(px: Num, py: Num, coords: Sequence[Num] = QUAD) -> Column:
    """Inside or on the border of a convex quad, in either winding."""
    p = points_of(coords)
    sides = []
    for i in range(4):
        (x0, y0), (x1, y1) = p[i], p[(i + 1) % 4]
        sides.append((x1 - x0) * (_c(py) - y0) - (y1 - y0) * (_c(px) - x0))
    return (F.least(*sides) >= 0) | (F.greatest(*sides) <= 0)


def box_intersection_area(a: Sequence[Num], b: Sequence[Num]) -> Column:
    """Overlap of two axis boxes, coordinates truncated to whole numbers."""
    ax0, ay0, ax1, ay1 = (_c(v).cast("long") for v in a)
    bx0, by0, bx1, by1 = (_c(v).cast("long") for v in b)
    zero = F.lit(0)
    return F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), zero) * F.greatest(
        F.least(ay1, by1) - F.greatest(ay0, by0), zero
    )


# ---- sizes -------------------------------------------------------------------------------


def resize_plan(width: Num, height: Num, size: Num, mode: str = "max") -> tuple[Column, Column, Column]:
    """(ratio, target width, target height) that bring the longer or shorter side to ``size``."""
    if mode not in ("max", "min"):
        raise ValueError(f"unknown mode {mode}")
    side = (F.greatest if mode == "max" else F.least)(_c(width), _c(height))
    ratio = _c(size).cast("double") / side
    return ratio, F.floor(_c(width) * ratio).cast("long"), F.floor(_c(height) * ratio).cast("long")


def recog_width_plan(width: Num, height: Num, img_h: int = 32, img_w: int = 254) -> tuple[Column, Column]:
    """(resized width, right padding) of a crop scaled to ``img_h`` rows."""
    resized = F.least(
        F.ceil(F.lit(img_h) * (_c(width) / _c(height).cast("double"))), F.lit(img_w)
    ).cast("long")
    return resized, (F.lit(img_w) - resized).cast("long")


# ---- seeded randomness -------------------------------------------------------------------


def hash_uniform(seed: int, *ids: Num) -> Column:
    """Uniform in [0, 1) from the row's own ids: the same on any cluster and after any retry."""
    return F.pmod(F.xxhash64(*[_c(i) for i in ids], F.lit(seed)), F.lit(1 << 31)) / F.lit(float(1 << 31))


def hash_int(seed: int, low: Num, high: Num, *ids: Num) -> Column:
    """Whole number from ``low`` to ``high``, both included."""
    span = _c(high).cast("long") - _c(low).cast("long") + 1
    return _c(low).cast("long") + F.floor(hash_uniform(seed, *ids) * span)


def jitter_quad(frac: float, draw, coords: Sequence[Num] = QUAD) -> list[Column]:
    """Grow a quad: the two leftmost x move left and the two rightmost right, same in y.

    The step is ``draw(k, limit)``, a whole number from 0 to ``limit`` = int(frac times the
    smallest distance between two corners), drawn apart for each corner rank k of each axis.
    """
    p = points_of(coords)
    gaps = [dist(*p[i], *p[j]) for i in range(4) for j in range(i + 1, 4)]
    limit = F.floor(F.lit(frac) * F.least(*gaps)).cast("long")
    out = []
    for axis in (0, 1):
        order = F.array_sort(
            F.array(*[F.struct(pt[axis].cast("double").alias("v"), F.lit(i).alias("i")) for i, pt in enumerate(p)])
        )
        moves = F.array(*[draw(axis * 4 + k, limit) * (-1 if k < 2 else 1) for k in range(4)])
        ranks = F.transform(order, lambda s: s["i"])
        out.append(
            [pt[axis] + F.get(moves, (F.array_position(ranks, F.lit(i)) - 1).cast("int")) for i, pt in enumerate(p)]
        )
    return [out[k % 2][k // 2].alias(QUAD[k]) for k in range(8)]


def jitter_corners(threshold: float, draw, coords: Sequence[Num] = QUAD) -> list[Column]:
    """Move each corner by up to threshold * perimeter, inward in x and outward in y.

    The limit becomes floor(shortest side / 2) where it would reach half that side.
    ``draw(k)`` is a uniform value in [0, 1) for coordinate k.
    """
    ring = polygon_of(coords)
    reach, half = perimeter(ring) * F.lit(threshold), min_side(ring) / F.lit(2.0)
    limit = F.when(reach >= half, F.floor(half).cast("double")).otherwise(reach)
    signs = (1, -1, -1, -1, -1, 1, 1, 1)
    return [(_c(v) + draw(k) * limit * signs[k]).alias(QUAD[k]) for k, v in enumerate(coords)]


# ---- affine moves ------------------------------------------------------------------------

Matrix = tuple[Column, Column, Column, Column, Column, Column]


def _then(first: Matrix, second: Matrix) -> Matrix:
    a, b, c, d, e, f = second
    g, h, i, j, k, m = first
    return (a * g + b * j, a * h + b * k, a * i + b * m + c, d * g + e * j, d * h + e * k, d * i + e * m + f)


def _about(cx: Column, cy: Column, a: Column, b: Column, d: Column, e: Column) -> Matrix:
    return (a, b, cx - a * cx - b * cy, d, e, cy - d * cx - e * cy)


def affine_matrix(ops: dict, draw, width: Num, height: Num) -> Matrix:
    """One 2x3 matrix from options ``{name: {"p": probability, "v": range}}``.

    Known names, in this order: shear (degrees, per axis), rotate (degrees), translate (share of
    the size, per axis), scale (factor, per axis). ``draw(k)`` gives uniform values in [0, 1).
    Shearing shifts the sheared page back to start at 0, 0; the others turn around the centre.
    """
    one, zero = F.lit(1.0), F.lit(0.0)
    w, h = _c(width).cast("double"), _c(height).cast("double")
    cx, cy = w / 2.0, h / 2.0
    matrix: Matrix = (one, zero, zero, zero, one, zero)

    def pick(name: str, axis: str | None, k: int, neutral: float) -> Column:
        option = ops.get(name)
        if option is None:
            return F.lit(neutral)
        span = option["v"]
        low, high = span[axis] if isinstance(span, dict) else span
        used = draw(100 + 10 * list(_AFFINE).index(name)) < F.lit(float(option["p"]))
        return F.when(used, F.lit(float(low)) + draw(k) * F.lit(float(high) - float(low))).otherwise(F.lit(neutral))

    if "shear" in ops:
        sx, sy = F.tan(F.radians(pick("shear", "x", 0, 0.0))), F.tan(F.radians(pick("shear", "y", 1, 0.0)))
        left, top = F.least(zero, sx * h), F.least(zero, sy * w)
        matrix = _then(matrix, (one, sx, -left, sy, one, -top))
        w, h = w + F.abs(sx) * h, h + F.abs(sy) * w
        cx, cy = w / 2.0, h / 2.0
    if "rotate" in ops:
        turn = F.radians(pick("rotate", None, 2, 0.0))
        matrix = _then(matrix, _about(cx, cy, F.cos(turn), -F.sin(turn), F.sin(turn), F.cos(turn)))
    if "translate" in ops:
        matrix = _then(
            matrix, (one, zero, pick("translate", "x", 3, 0.0) * w, zero, one, pick("translate", "y", 4, 0.0) * h)
        )
    if "scale" in ops:
        matrix = _then(matrix, _about(cx, cy, pick("scale", "x", 5, 1.0), zero, zero, pick("scale", "y", 6, 1.0)))
    return matrix


_AFFINE = ("shear", "rotate", "translate", "scale")


def apply_affine(matrix: Matrix, coords: Sequence[Num] = QUAD) -> list[Column]:
    """Moved corners, truncated to whole numbers."""
    a, b, c, d, e, f = matrix
    out = []
    for x, y in points_of(coords):
        out += [(a * x + b * y + c).cast("long"), (d * x + e * y + f).cast("long")]
    return [v.alias(n) for n, v in zip(QUAD, out)]


def affinity_quad(first: Sequence[Num], second: Sequence[Num]) -> list[Column]:
    """Quad between two neighbouring characters, from their edge corners and centres."""
    out = []
    for coords, a, b in ((first, 0, 1), (second, 0, 1), (second, 2, 3), (first, 2, 3)):
        p, (mx, my) = points_of(coords), quad_centre(coords)
        out += [(p[a][0] + p[b][0] + mx) / F.lit(3.0), (p[a][1] + p[b][1] + my) / F.lit(3.0)]
    return [v.alias(n) for n, v in zip(QUAD, out)]
