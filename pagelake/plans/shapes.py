"""Queries on box, quad and polygon functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import geometry as G
from pagelake.operators import pages as L
from pagelake.plans import fixtures as fx
from pagelake.plans.oracle import cte
from pagelake.plans.registry import query

# Slanted quads from the word boxes, in both engines.
cte("quads", """
  SELECT image_id, word_idx, length(text) AS n, CAST(xmin AS DOUBLE) AS x1, CAST(ymin + image_id % 5 AS DOUBLE) AS y1,
         CAST(xmax - word_idx % 3 AS DOUBLE) AS x2, CAST(ymin AS DOUBLE) AS y2, CAST(xmax AS DOUBLE) AS x3, CAST(ymax AS DOUBLE) AS y3,
         CAST(xmin + word_idx % 4 AS DOUBLE) AS x4, CAST(ymax + image_id % 3 AS DOUBLE) AS y4, xmin, ymin, xmax, ymax
  FROM gt_words""", ("gt_words",))


def _quads(spark, sf_dir):
    x0, y0, x1, y1 = (F.col(c) for c in G.BOX)
    i, w = F.col("image_id"), F.col("word_idx")
    corners = (x0, y0 + i % 5, x1 - w % 3, y0, x1, y1, x0 + w % 4, y1 + i % 3)
    return fx.gt_words(spark, sf_dir).select(
        "image_id", "word_idx", F.length("text").cast("long").alias("n"),
        *[v.cast("double").alias(c) for c, v in zip(G.QUAD, corners)], *G.BOX,
    )


def _r(col, name: str, digits: int = 6):
    return F.round(col, digits).alias(name)


_RING = "[x1, x2, x3, x4]"


def _corners(polygon: str, prefix: str = "") -> list:
    """All coordinates of a ring of four corners."""
    return [F.get(polygon, i)[v].alias(f"{prefix}{v}{i + 1}") for i in range(4) for v in "xy"]


@query("bbox_to_quad", ("gt_words",), """
  SELECT image_id, word_idx, round(xmin / 4.0, 1) AS x1, round(ymin / 4.0, 1) AS y1, round((xmin + xmax) / 4.0, 1) AS x3,
         round((ymin + ymax) / 4.0, 1) AS y3 FROM (SELECT image_id, word_idx, xmin * 4.0 AS xmin, ymin * 4.0 AS ymin, xmax * 4.0 AS xmax, ymax * 4.0 AS ymax FROM gt_words)""")
def bbox_to_quad(spark, sf_dir):
    quads = G.bbox_to_quad("xmin", "ymin", "xmax", "ymax")
    return fx.gt_words(spark, sf_dir).select("image_id", "word_idx", *[quads[i] for i in (0, 1, 4, 5)])


@query("quad_bounds", ("quads",), """
  SELECT image_id, word_idx, CAST(trunc(least(x1, x2, x3, x4)) AS BIGINT) AS xmin, CAST(trunc(least(y1, y2, y3, y4)) AS BIGINT) AS ymin,
         CAST(trunc(greatest(x1, x2, x3, x4)) AS BIGINT) AS xmax, CAST(trunc(greatest(y1, y2, y3, y4)) AS BIGINT) AS ymax FROM quads""")
def quad_bounds(spark, sf_dir):
    return _quads(spark, sf_dir).select("image_id", "word_idx", *G.quad_bounds())


@query("quad_measures", ("quads",), """
  SELECT image_id, word_idx, (x1 + x2 + x3 + x4) / 4 AS cx, (y1 + y2 + y3 + y4) / 4 AS cy,
         round(a, 6) AS area,
         round(((x1 + x2) * (x1 * y2 - x2 * y1) + (x2 + x3) * (x2 * y3 - x3 * y2) + (x3 + x4) * (x3 * y4 - x4 * y3) + (x4 + x1) * (x4 * y1 - x1 * y4)) / (6 * a), 6) AS gx,
         round(((y1 + y2) * (x1 * y2 - x2 * y1) + (y2 + y3) * (x2 * y3 - x3 * y2) + (y3 + y4) * (x3 * y4 - x4 * y3) + (y4 + y1) * (x4 * y1 - x1 * y4)) / (6 * a), 6) AS gy,
         round(sqrt((x2-x1)**2 + (y2-y1)**2) + sqrt((x3-x2)**2 + (y3-y2)**2) + sqrt((x4-x3)**2 + (y4-y3)**2) + sqrt((x1-x4)**2 + (y1-y4)**2), 6) AS perimeter,
         round(least(sqrt((x2-x1)**2 + (y2-y1)**2), sqrt((x3-x2)**2 + (y3-y2)**2), sqrt((x4-x3)**2 + (y4-y3)**2), sqrt((x1-x4)**2 + (y1-y4)**2)), 6) AS min_side,
         round((sqrt((x3-x1)**2 + (y3-y1)**2) + sqrt((x4-x2)**2 + (y4-y2)**2)) / 2, 6) AS diagonal
  FROM (SELECT *, ((x1 * y2 - x2 * y1) + (x2 * y3 - x3 * y2) + (x3 * y4 - x4 * y3) + (x4 * y1 - x1 * y4)) / 2 AS a FROM quads)""")
def quad_measures(spark, sf_dir):
    ring = G.polygon_of()
    cx, cy = G.quad_centre()
    return _quads(spark, sf_dir).select(
        "image_id", "word_idx", cx.alias("cx"), cy.alias("cy"), _r(G.polygon_area(ring), "area"),
        _r(G.polygon_centroid(ring)[0], "gx"), _r(G.polygon_centroid(ring)[1], "gy"), _r(G.perimeter(ring), "perimeter"), _r(G.min_side(ring), "min_side"),
        _r(G.mean_diagonal(), "diagonal"),
    )


@query("scale_polygon", ("quads",), f"""
  SELECT image_id, word_idx, {", ".join(f"CASE WHEN {v}{i} > g{v} THEN {v}{i} + 3 ELSE {v}{i} - 3 END AS s{v}{i}" for i in range(1, 5) for v in "xy")}
  FROM (SELECT *, {", ".join(f"(({v}1 + {v}2) * (x1 * y2 - x2 * y1) + ({v}2 + {v}3) * (x2 * y3 - x3 * y2) + ({v}3 + {v}4) * (x3 * y4 - x4 * y3) + ({v}4 + {v}1) * (x4 * y1 - x1 * y4)) / (6 * a) AS g{v}" for v in "xy")}
        FROM (SELECT *, ((x1 * y2 - x2 * y1) + (x2 * y3 - x3 * y2) + (x3 * y4 - x4 * y3) + (x4 * y1 - x1 * y4)) / 2 AS a FROM quads))""")
def scale_polygon(spark, sf_dir):
    out = _quads(spark, sf_dir).select("image_id", "word_idx", G.scale_polygon(G.polygon_of(), 3.0).alias("p"))
    return out.select("image_id", "word_idx", *_corners("p", "s"))


@query("start_corner", ("quads",), f"""
  SELECT image_id, word_idx, {", ".join(f"{v}s[(first + {i - 2}) % 4 + 1] AS {v}{i}" for i in range(1, 5) for v in "xy")}
  FROM (SELECT *, list_position(s, list_min(s)) AS first FROM (
    SELECT image_id, word_idx, [x3 + y3, x2 + y2, x1 + y1, x4 + y4] AS s, [x3, x2, x1, x4] AS xs, [y3, y2, y1, y4] AS ys FROM quads))""")
def start_corner(spark, sf_dir):
    """A ring listed from its third corner backwards, turned to its start corner."""
    ring = G.polygon_of(("x3", "y3", "x2", "y2", "x1", "y1", "x4", "y4"))
    out = _quads(spark, sf_dir).select("image_id", "word_idx", G.start_corner(ring).alias("p"))
    return out.select("image_id", "word_idx", *_corners("p"))


@query("rescale_polygon", ("quads",), f"""
  SELECT image_id, word_idx, {", ".join(f"x{i} * 3.0 AS rx{i}, y{i} * 5.0 AS ry{i}" for i in range(1, 5))} FROM quads""")
def rescale_polygon(spark, sf_dir):
    out = _quads(spark, sf_dir).select("image_id", "word_idx", G.rescale_polygon(G.polygon_of(), 1.5, 2.5).alias("p"))
    return out.select("image_id", "word_idx", *_corners("p", "r"))


@query("closest_corner", ("quads",), """
  SELECT image_id, word_idx, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS corner, round(list_min(d), 6) AS distance FROM (
    SELECT image_id, word_idx, [sqrt((x1-px)**2 + (y1-py)**2), sqrt((x2-px)**2 + (y2-py)**2), sqrt((x3-px)**2 + (y3-py)**2), sqrt((x4-px)**2 + (y4-py)**2)] AS d
    FROM (SELECT *, CAST(image_id % 1100 AS DOUBLE) AS px, 350.0::DOUBLE AS py FROM quads))""")
def closest_corner(spark, sf_dir):
    near = G.closest_corner((F.col("image_id") % 1100).cast("double"), F.lit(350.0), G.QUAD)
    return _quads(spark, sf_dir).select("image_id", "word_idx", near["i"].alias("corner"), _r(near["d"], "distance"))


@query("angle_3pt", ("quads",), """
  SELECT image_id, word_idx, round(CASE WHEN t < 0 THEN t + 360 ELSE t END, 6) AS angle FROM (
    SELECT image_id, word_idx, degrees(atan2(y3 - y2, x3 - x2) - atan2(y1 - y2, x1 - x2)) AS t FROM quads)""")
def angle_3pt(spark, sf_dir):
    return _quads(spark, sf_dir).select("image_id", "word_idx", _r(G.angle_3pt("x1", "y1", "x2", "y2", "x3", "y3"), "angle"))


@query("pseudo_char_centres", ("quads",), """
  SELECT image_id, word_idx, i AS char_idx, round((x1 + x4) / 2 + ((x2 + x3) - (x1 + x4)) / 2 * (i + 0.5) / n, 6) AS x,
         round((y1 + y4) / 2 + ((y2 + y3) - (y1 + y4)) / 2 * (i + 0.5) / n, 6) AS y
  FROM (SELECT *, unnest(range(0, n)) AS i FROM quads)""")
def pseudo_char_centres(spark, sf_dir):
    out = _quads(spark, sf_dir).select("image_id", "word_idx", F.posexplode(G.pseudo_char_centres("n")).alias("char_idx", "p"))
    return out.select("image_id", "word_idx", F.col("char_idx").cast("long").alias("char_idx"), _r("p.x", "x"), _r("p.y", "y"))


@query("orient_vertical", ("quads",), f"""
  SELECT image_id, word_idx, {", ".join(f"CASE WHEN tall THEN {v}{(i + 2) % 4 + 1} ELSE {v}{i} END AS {v}{i}" for i in range(1, 5) for v in "xy")} FROM (
    SELECT *, greatest(y1, y2, y3, y4) - least(y1, y2, y3, y4) > 0.4 * (greatest(x1, x2, x3, x4) - least(x1, x2, x3, x4)) AS tall FROM quads)""")
def orient_vertical(spark, sf_dir):
    turned = G.orient_vertical(ratio=0.4)
    return _quads(spark, sf_dir).select("image_id", "word_idx", *[v.alias(n) for v, n in zip(turned, G.QUAD)])


@query("point_in_quad", ("quads",), """
  SELECT image_id, word_idx, (a >= 0 AND b >= 0 AND c >= 0 AND d >= 0) OR (a <= 0 AND b <= 0 AND c <= 0 AND d <= 0) AS inside FROM (
    SELECT image_id, word_idx, (x2-x1)*(py-y1) - (y2-y1)*(px-x1) AS a, (x3-x2)*(py-y2) - (y3-y2)*(px-x2) AS b,
           (x4-x3)*(py-y3) - (y4-y3)*(px-x3) AS c, (x1-x4)*(py-y4) - (y1-y4)*(px-x4) AS d
    FROM (SELECT *, x1 + image_id % 60 AS px, y1 + image_id % 20 AS py FROM quads))""")
def point_in_quad(spark, sf_dir):
    px, py = F.col("x1") + F.col("image_id") % 60, F.col("y1") + F.col("image_id") % 20
    return _quads(spark, sf_dir).select("image_id", "word_idx", G.point_in_quad(px, py).alias("inside"))


@query("box_intersection_area", ("gt_words",), """
  SELECT image_id, word_idx, greatest(least(xmax, 600) - greatest(xmin, 200), 0) * greatest(least(ymax, 500) - greatest(ymin, 100), 0) AS area FROM gt_words""")
def box_intersection_area(spark, sf_dir):
    area = G.box_intersection_area(G.BOX, (200, 100, 600, 500))
    return fx.gt_words(spark, sf_dir).select("image_id", "word_idx", area.alias("area"))


@query("resize_plan", ("quads",), """
  SELECT image_id, word_idx, CAST(floor(w * (768.0::DOUBLE / greatest(w, h))) AS BIGINT) AS max_w, CAST(floor(h * (768.0::DOUBLE / least(w, h))) AS BIGINT) AS min_h
  FROM (SELECT image_id, word_idx, xmax - xmin AS w, ymax - ymin AS h FROM quads)""")
def resize_plan(spark, sf_dir):
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    return _quads(spark, sf_dir).select(
        "image_id", "word_idx", G.resize_plan(w, h, 768)[1].alias("max_w"), G.resize_plan(w, h, 768, "min")[2].alias("min_h")
    )


@query("recog_width_plan", ("quads",), """
  SELECT image_id, word_idx, r AS resized, 254 - r AS pad FROM (
    SELECT image_id, word_idx, CAST(least(ceil(32 * ((xmax - xmin) / CAST(ymax - ymin AS DOUBLE))), 254) AS BIGINT) AS r FROM quads)""")
def recog_width_plan(spark, sf_dir):
    w, pad = G.recog_width_plan(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return _quads(spark, sf_dir).select("image_id", "word_idx", w.alias("resized"), pad.alias("pad"))


@query("crop_plan", ("quads",), """
  SELECT image_id, word_idx, CAST(trunc(sqrt((x2-x1)**2 + (y2-y1)**2)) AS BIGINT) AS crop_w, CAST(trunc(sqrt((x4-x1)**2 + (y4-y1)**2)) AS BIGINT) AS crop_h FROM quads""")
def crop_plan(spark, sf_dir):
    return L.crop_plan(_quads(spark, sf_dir)).select("image_id", "word_idx", "crop_w", "crop_h")


@query("jitter_quad", ("quads",), """
  WITH l AS (SELECT *, CAST(floor(0.1 * least(sqrt((x2-x1)**2 + (y2-y1)**2), sqrt((x3-x1)**2 + (y3-y1)**2), sqrt((x4-x1)**2 + (y4-y1)**2),
      sqrt((x3-x2)**2 + (y3-y2)**2), sqrt((x4-x2)**2 + (y4-y2)**2), sqrt((x4-x3)**2 + (y4-y3)**2))) AS BIGINT) AS lim FROM quads),
  c AS (SELECT image_id, word_idx, lim, unnest([x1, x2, x3, x4]) AS x, unnest([y1, y2, y3, y4]) AS y, unnest([0, 1, 2, 3]) AS i FROM l),
  r AS (SELECT *, row_number() OVER (PARTITION BY image_id, word_idx ORDER BY x, i) - 1 AS kx, row_number() OVER (PARTITION BY image_id, word_idx ORDER BY y, i) - 1 AS ky FROM c)
  SELECT image_id, word_idx, i AS corner, x + CASE WHEN kx < 2 THEN -1 ELSE 1 END * ((image_id + kx) % (lim + 1)) AS x,
         y + CASE WHEN ky < 2 THEN -1 ELSE 1 END * ((image_id + 4 + ky) % (lim + 1)) AS y FROM r""")
def jitter_quad(spark, sf_dir):
    moved = G.jitter_quad(0.1, lambda k, limit: (F.col("image_id") + k) % (limit + 1))
    out = _quads(spark, sf_dir).select("image_id", "word_idx", *moved)
    corners = F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in range(1, 5)])
    return out.select("image_id", "word_idx", F.posexplode(corners).alias("corner", "p")).select("image_id", "word_idx", "corner", "p.x", "p.y")


@query("jitter_corners", ("quads",), """
  SELECT image_id, word_idx, round(x1 + u * lim, 6) AS x1, round(y1 - u * lim, 6) AS y1, round(x2 - u * lim, 6) AS x2, round(y2 - u * lim, 6) AS y2,
         round(x3 - u * lim, 6) AS x3, round(y3 + u * lim, 6) AS y3, round(x4 + u * lim, 6) AS x4, round(y4 + u * lim, 6) AS y4 FROM (
    SELECT *, (image_id % 10) / 10.0::DOUBLE AS u, CASE WHEN 0.05 * p >= s / 2 THEN floor(s / 2) ELSE 0.05 * p END AS lim FROM (
      SELECT *, sqrt((x2-x1)**2 + (y2-y1)**2) + sqrt((x3-x2)**2 + (y3-y2)**2) + sqrt((x4-x3)**2 + (y4-y3)**2) + sqrt((x1-x4)**2 + (y1-y4)**2) AS p,
        least(sqrt((x2-x1)**2 + (y2-y1)**2), sqrt((x3-x2)**2 + (y3-y2)**2), sqrt((x4-x3)**2 + (y4-y3)**2), sqrt((x1-x4)**2 + (y1-y4)**2)) AS s FROM quads))""")
def jitter_corners(spark, sf_dir):
    moved = G.jitter_corners(0.05, lambda k: (F.col("image_id") % 10) / F.lit(10.0))
    out = _quads(spark, sf_dir).select("image_id", "word_idx", *moved)
    return out.select("image_id", "word_idx", *[_r(c, c) for c in G.QUAD])


@query("affine_quads", ("quads",), f"""
  SELECT image_id, word_idx, {", ".join(f"CAST(trunc(round(c * (x{i} - 640) - s * (y{i} - 400) + 640 + 64, 9)) AS BIGINT) AS x{i}, CAST(trunc(round(s * (x{i} - 640) + c * (y{i} - 400) + 400, 9)) AS BIGINT) AS y{i}" for i in range(1, 5))}
  FROM (SELECT *, cos(radians(a)) AS c, sin(radians(a)) AS s FROM (SELECT *, -45 + 90 * ((image_id % 7) / 7.0::DOUBLE) AS a FROM quads))""")
def affine_quads(spark, sf_dir):
    """Rotation by the image's own angle, then a shift of a twentieth of the width."""
    ops = {"rotate": {"p": 1.0, "v": (-45, 45)}, "translate": {"p": 1.0, "v": {"x": (0.05, 0.05), "y": (0.0, 0.0)}}}
    draw = lambda k: (F.col("image_id") % 7) / F.lit(7.0)
    a, b, c, d, e, f = G.affine_matrix(ops, draw, F.lit(1280), F.lit(800))
    moved = []
    for x, y in zip(G.QUAD[::2], G.QUAD[1::2]):
        moved += [F.round(a * F.col(x) + b * F.col(y) + c, 9).cast("long").alias(x), F.round(d * F.col(x) + e * F.col(y) + f, 9).cast("long").alias(y)]
    return _quads(spark, sf_dir).select("image_id", "word_idx", *moved)


@query("affine_quads_seeded")
def affine_quads_seeded(spark, sf_dir):
    """All four moves with seeded hash draws, one matrix per image."""
    ops = {
        "shear": {"p": 0.8, "v": {"x": (-15, 15), "y": (-15, 15)}}, "rotate": {"p": 0.8, "v": (-45, 45)},
        "translate": {"p": 0.8, "v": {"x": (-0.2, 0.2), "y": (-0.2, 0.2)}}, "scale": {"p": 0.8, "v": {"x": (0.8, 1.2), "y": (0.8, 1.2)}},
    }
    matrix = G.affine_matrix(ops, lambda k: G.hash_uniform(7 + k, "image_id"), F.lit(1280), F.lit(800))
    return _quads(spark, sf_dir).select("image_id", "word_idx", *G.apply_affine(matrix))
