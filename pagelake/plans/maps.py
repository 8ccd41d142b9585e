"""Queries on pages, tiles and score maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.operators import grid as H
from pagelake.operators import pages as L
from pagelake.operators.joins import CELL
from pagelake.plans import fixtures as fx
from pagelake.plans.oracle import cte
from pagelake.plans.registry import query

LOW, LINK, TEXT = 0.05, 0.1, 0.02
_BOXES = "SELECT image_id, word_idx AS box_idx, xmin, ymin, xmax, ymax FROM gt_words"


def _boxes(spark, sf_dir):
    return fx.gt_words(spark, sf_dir).select("image_id", F.col("word_idx").alias("box_idx"), "xmin", "ymin", "xmax", "ymax")


@query("reading_order", ("gt_words",), f"""
  WITH b AS ({_BOXES}),
  f AS (SELECT *, max(ymax) OVER (PARTITION BY image_id ORDER BY ymin, xmin, box_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM b),
  l AS (SELECT *, CAST(sum(CASE WHEN below IS NULL OR below <= ymin THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY ymin, xmin, box_idx ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS line FROM f)
  SELECT image_id, box_idx, line, row_number() OVER (PARTITION BY image_id ORDER BY line, xmin, ymin, xmax, ymax, box_idx) - 1 AS position FROM l""")
def reading_order(spark, sf_dir):
    return L.reading_order(_boxes(spark, sf_dir)).select("image_id", "box_idx", "line", "position")


_PAGES = "SELECT image_id, 900 + image_id % 4000 AS width, 600 + image_id % 2500 AS height FROM imgs"


def _pages(spark, sf_dir):
    i = F.col("image_id")
    return fx.imgs(fx.gt_words(spark, sf_dir)).select("image_id", (i % 4000 + 900).alias("width"), (i % 2500 + 600).alias("height"))


_TILES = """
  SELECT image_id, i, j, n_x, n_y, 1230 * j AS x_off, 780 * i AS y_off, greatest(least(1280, width - 1230 * j), 0) AS w, greatest(least(800, height - 780 * i), 0) AS h
  FROM (SELECT *, unnest(range(0, n_x)) AS j FROM (SELECT *, unnest(range(0, n_y)) AS i FROM (
    SELECT *, {nx} AS n_x, {ny} AS n_y FROM (%s))))""" % _PAGES
_PLAIN = {"nx": "CAST(floor(width / 1255.0) + 1 AS INTEGER)", "ny": "CAST(floor(height / 790.0) + 1 AS INTEGER)"}
_COVER = {
    "nx": f"greatest({_PLAIN['nx']}, CAST(ceil((width - 50) / 1230.0) AS INTEGER))",
    "ny": f"greatest({_PLAIN['ny']}, CAST(ceil((height - 20) / 780.0) AS INTEGER))",
}
_TILE_COLUMNS = ("image_id", "i", "j", "x_off", "y_off", "w", "h")


def _tile_query(name: str, cover: bool, sizes: dict[str, str]):
    @query(name, ("imgs",), f"SELECT {', '.join(_TILE_COLUMNS)} FROM ({_TILES.format(**sizes)})")
    def run(spark, sf_dir):
        return L.plan_tiles(_pages(spark, sf_dir), cover=cover).select(*_TILE_COLUMNS)

    return run


_tile_query("plan_tiles", False, _PLAIN)
_tile_query("plan_tiles_cover", True, _COVER)

cte("tile_dets", f"""
  SELECT t.image_id, t.i, t.j, t.n_x, t.n_y, t.x_off, t.y_off, w.word_idx AS det_idx, w.xmin, w.ymin, w.xmax, w.ymax,
         (w.xmin + w.xmax) / 2.0 AS cx, (w.ymin + w.ymax) / 2.0 + 60 AS cy
  FROM ({_TILES.format(**_PLAIN)}) t JOIN gt_words w ON w.image_id = t.image_id""", ("imgs", "gt_words"))


def _tile_dets(spark, sf_dir):
    """Each word's box as a detection of every tile of its page."""
    tiles = L.plan_tiles(_pages(spark, sf_dir))
    words = fx.gt_words(spark, sf_dir).select(
        "image_id", F.col("word_idx").alias("det_idx"), "xmin", "ymin", "xmax", "ymax",
        ((F.col("xmin") + F.col("xmax")) / 2.0).alias("cx"), ((F.col("ymin") + F.col("ymax")) / 2.0 + 60).alias("cy"),
    )
    return tiles, words.join(tiles.select("image_id", "i", "j", "n_x", "n_y"), "image_id")


_BORDER = "cx < 25 OR cx > 1255 OR cy < 10 OR cy > 790"


@query("keep_owned", ("tile_dets",), """
  SELECT image_id, i, j, det_idx FROM tile_dets WHERE NOT ((cx < 25 AND j > 0) OR (cx > 1255 AND j < n_x - 1) OR (cy < 10 AND i > 0) OR (cy > 790 AND i < n_y - 1))""")
def keep_owned(spark, sf_dir):
    return L.keep_owned(_tile_dets(spark, sf_dir)[1]).select("image_id", "i", "j", "det_idx")


@query("keep_owned_faithful", ("tile_dets",), f"""
  SELECT image_id, i, j, det_idx FROM tile_dets WHERE NOT ({_BORDER}) OR (i = 0 AND cy < 10) OR (i = n_y - 1 AND cy > 790) OR (j = 0 AND cx < 25)""")
def keep_owned_faithful(spark, sf_dir):
    return L.keep_owned(_tile_dets(spark, sf_dir)[1], faithful=True).select("image_id", "i", "j", "det_idx")


@query("untile_detections", ("tile_dets",), """
  SELECT image_id, i, j, det_idx, xmin + x_off AS xmin, ymin + y_off AS ymin, xmax + x_off AS xmax, ymax + y_off AS ymax FROM tile_dets""")
def untile_detections(spark, sf_dir):
    tiles, dets = _tile_dets(spark, sf_dir)
    return L.untile_detections(dets, tiles).select("image_id", "i", "j", "det_idx", "xmin", "ymin", "xmax", "ymax")


@query("box_heat", ("score_grid",), """
  SELECT b.image_id, b.det_idx, count(*) AS pixels, round(avg(CAST(text AS DOUBLE)), 6) AS mean_text, max(text) AS max_text
  FROM (SELECT image_id, y AS det_idx, y AS xmin, 0 AS ymin, 8 AS xmax, y + 1 AS ymax FROM score_grid WHERE x = 0) b
  JOIN score_grid g ON g.image_id = b.image_id AND g.x >= xmin AND g.x < xmax AND g.y >= ymin AND g.y < ymax GROUP BY ALL""")
def box_heat(spark, sf_dir):
    grid = fx.score_grid(spark, sf_dir)
    boxes = grid.where("x = 0").select(
        "image_id", F.col("y").alias("det_idx"), F.col("y").alias("xmin"), F.lit(0).alias("ymin"), F.lit(8).alias("xmax"), (F.col("y") + 1).alias("ymax")
    )
    return L.box_heat(boxes, grid, cell=4).withColumn("mean_text", F.round("mean_text", 6))


cte("on_pixels", f"SELECT image_id, x, y, text FROM score_grid WHERE text > CAST({LOW} AS DOUBLE) OR link > CAST({LINK} AS DOUBLE)", ("score_grid",))
cte("near", """
  SELECT a.image_id, a.y * 8 + a.x AS u, b.y * 8 + b.x AS v FROM on_pixels a JOIN on_pixels b
    ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) <= 1""", ("on_pixels",))
_REACH = """
  WITH reach AS (SELECT image_id, u, v FROM near UNION SELECT r.image_id, r.u, n.v FROM reach r JOIN near n ON n.image_id = r.image_id AND n.u = r.v),
  labels AS (SELECT image_id, u, min(v) AS root FROM reach GROUP BY ALL),
  stats AS (SELECT p.image_id, root, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, max(text) AS max_text
            FROM on_pixels p JOIN labels l ON l.image_id = p.image_id AND l.u = p.y * 8 + p.x GROUP BY ALL)
"""


@query("grid_components", ("near", "on_pixels"), _REACH + "SELECT image_id, x, y, w, h, area, max_text, root FROM stats", recursive=True)
def grid_components(spark, sf_dir):
    _, stats = H.grid_components(fx.score_grid(spark, sf_dir), LOW, LINK)
    place = F.floor(F.col("label") / (1 << 31)) * 8 + F.col("label") % (1 << 31)
    return stats.select("image_id", "x", "y", "w", "h", "area", "max_text", place.alias("root"))


@query("filter_components", ("near", "on_pixels"), _REACH + f"SELECT image_id, x, y, area FROM stats WHERE area >= 10 AND max_text >= CAST({TEXT} AS DOUBLE)", recursive=True)
def filter_components(spark, sf_dir):
    _, stats = H.grid_components(fx.score_grid(spark, sf_dir), LOW, LINK)
    return H.filter_components(stats, text=TEXT).select("image_id", "x", "y", "area")


def _sizes(spark, sf_dir):
    return fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"))


@query("component_boxes")
def component_boxes(spark, sf_dir):
    return H.component_boxes(fx.score_grid(spark, sf_dir), _sizes(spark, sf_dir), LOW, LINK, TEXT)


@query("component_boxes_axis")
def component_boxes_axis(spark, sf_dir):
    return H.component_boxes(fx.score_grid(spark, sf_dir), _sizes(spark, sf_dir), LOW, LINK, TEXT, axis_only=True)


@query("adjacent_runs", ("on_pixels",), """
  WITH runs AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1 FROM (
    SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS isle FROM on_pixels) GROUP BY image_id, y, isle)
  SELECT a.image_id, CAST(a.y AS BIGINT) * 2147483648 + a.x0 AS u, CAST(b.y AS BIGINT) * 2147483648 + b.x0 AS v
  FROM runs a JOIN runs b ON a.image_id = b.image_id AND b.y = a.y + 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1""")
def adjacent_runs(spark, sf_dir):
    grid = fx.score_grid(spark, sf_dir)
    return H.adjacent_runs(H.pixel_runs(grid.where((F.col("text") > LOW) | (F.col("link") > LINK))))


@query("split_elements", ("gt_words",), """
  WITH w AS (SELECT image_id // 16 AS page, image_id * 1000 + word_idx AS element, xmin AS x, ymin AS y, CASE WHEN image_id // 16 % 3 = 0 THEN (ymax - ymin) // 3 ELSE ymax - ymin END AS h FROM gt_words),
  e AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x, y, element) - 1 AS pos, CAST(lead(h) OVER (PARTITION BY page ORDER BY x, y, element) AS DOUBLE) AS ahead FROM w),
  r(page, pos, run, len, height) AS (
    SELECT page, pos, 0, 1, CAST(h AS DOUBLE) FROM e WHERE pos = 0
    UNION ALL
    SELECT e.page, e.pos, run + CASE WHEN breaks THEN 1 ELSE 0 END, CASE WHEN breaks THEN 1 ELSE len + 1 END,
           CASE WHEN breaks THEN h WHEN small THEN ((len + 1) * height + h) / (len + 2) ELSE height END
    FROM (SELECT e.*, run, len, height, ahead IS NOT NULL AND height < 15 AND h < 15 AS small,
                 ahead IS NOT NULL AND NOT (height < 15 AND h < 15) AND ((h > height * 1.5 AND len > 1) OR (height > h * 1.5 AND height > ahead * 1.5)) AS breaks
          FROM r JOIN e ON e.page = r.page AND e.pos = r.pos + 1) e)
  SELECT page AS image_id, CAST(pos AS INTEGER) AS pos, element, run,
         CAST(CASE WHEN count(*) OVER (PARTITION BY page, run) > 10 THEN (row_number() OVER (PARTITION BY page, run ORDER BY pos) - 1) // 5 ELSE 0 END AS INTEGER) AS part
  FROM r JOIN e USING (page, pos)""", recursive=True)
def split_elements(spark, sf_dir):
    """Runs and parts of every element; sixteen images make a page of one component, a third of the pages in small type."""
    page = F.floor(F.col("image_id") / 16)
    height = F.col("ymax") - F.col("ymin")
    words = fx.gt_words(spark, sf_dir).select(
        page.alias("image_id"), F.lit(0).cast("long").alias("label"), (F.col("image_id") * 1000 + F.col("word_idx")).alias("element"),
        F.col("xmin").alias("x"), F.col("ymin").alias("y"), (F.col("xmax") - F.col("xmin")).alias("w"),
        F.when(page % 3 == 0, F.floor(height / 3)).otherwise(height).alias("h"),
    )
    return H.split_elements(words).select("image_id", "pos", "element", "run", "part")


@query("chunk_elements", ("gt_words",), """
  SELECT image_id, pos, CAST(CASE WHEN count(*) OVER (PARTITION BY image_id) > 5 THEN (row_number() OVER (PARTITION BY image_id ORDER BY pos) - 1) // 3 ELSE 0 END AS INTEGER) AS part
  FROM (SELECT image_id, word_idx AS pos FROM gt_words)""")
def chunk_elements(spark, sf_dir):
    rows = fx.gt_words(spark, sf_dir).select("image_id", F.lit(0).alias("label"), F.lit(0).alias("run"), F.col("word_idx").alias("pos"))
    return H.chunk_elements(rows, 5, 3).select("image_id", "pos", "part")


cte("profile", """
  SELECT vec_id // 4 AS image_id, (vec_id % 4) * 64 + pos AS x, CAST(greatest(floor(v * 1000), 0) * (CASE WHEN pos % 64 BETWEEN 10 AND 50 THEN 0 ELSE 1 END) AS BIGINT) AS ink
  FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)""")


@query("compact_gaps", ("profile",), """
  WITH g AS (SELECT *, ink < 200 OR sum(ink) OVER (PARTITION BY image_id ORDER BY x ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) <= 7 AS gap FROM profile),
  i AS (SELECT *, count(*) FILTER (NOT gap) OVER (PARTITION BY image_id ORDER BY x) AS isle FROM g),
  p AS (SELECT *, row_number() OVER (PARTITION BY image_id, isle, gap ORDER BY x) - 1 AS pos, count(*) OVER (PARTITION BY image_id, isle, gap) AS len,
               isle < max(isle) OVER (PARTITION BY image_id) AS closed FROM i),
  k AS (SELECT *, NOT (gap AND closed AND len > 20 AND pos >= 10 AND pos < len - 10) AS keep FROM p)
  SELECT image_id, x, keep, CASE WHEN keep THEN count(*) FILTER (keep) OVER (PARTITION BY image_id ORDER BY x) - 1 END AS new_x FROM k""")
def compact_gaps(spark, sf_dir):
    cells = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    ink = F.greatest(F.floor(F.col("v").cast("double") * 1000), F.lit(0)) * F.when(F.col("pos").between(10, 50), 0).otherwise(1)
    profile = cells.select(F.floor(F.col("vec_id") / 4).alias("image_id"), (F.col("vec_id") % 4 * 64 + F.col("pos")).alias("x"), ink.alias("ink"))
    return H.compact_gaps(profile).select("image_id", "x", "keep", "new_x")


@query("training_window_plan", ("imgs", "gt_words"), """
  WITH w AS (SELECT image_id, min((((word_idx * 37 + image_id) % 101) / 101.0::DOUBLE, word_idx, xmin, ymin, xmax, ymax)) AS b FROM gt_words GROUP BY image_id),
  p AS (SELECT i.image_id, CAST(width AS BIGINT) AS w, CAST(height AS BIGINT) AS h, (image_id * 31 % 97) / 97.0::DOUBLE AS u, b[3] AS x0, b[4] AS y0, b[5] AS x1, b[6] AS y1
        FROM imgs i JOIN w USING (image_id)),
  q AS (SELECT *, greatest(x1 - 512, 0) AS lo_x, greatest(y1 - 512, 0) AS lo_y, least(x0, w - 512) AS hi_x, least(y0, h - 512) AS hi_y FROM p),
  r AS (SELECT *, hi_y < lo_y OR hi_x < lo_x AS tight FROM q),
  s AS (SELECT *, u > 0.6 AS word, CASE WHEN tight THEN CAST(floor(u * (h - 512 + 1)) AS BIGINT) ELSE lo_y + CAST(floor(u * (hi_y - lo_y + 1)) AS BIGINT) END AS i,
          CASE WHEN tight THEN CAST(floor(u * (w - 512 + 1)) AS BIGINT) ELSE lo_x + CAST(floor(u * (hi_x - lo_x + 1)) AS BIGINT) END AS j FROM r)
  SELECT image_id, CASE WHEN word THEN i ELSE 0 END AS top, CASE WHEN word THEN j ELSE 0 END AS "left",
         CASE WHEN word THEN CASE WHEN x1 - j > 512 THEN x1 ELSE 512 END ELSE w + 1 END AS crop_w,
         CASE WHEN word THEN CASE WHEN y1 - i > 512 THEN y1 ELSE 512 END ELSE h + 1 END AS crop_h FROM s""")
def training_window_plan(spark, sf_dir):
    words = fx.gt_words(spark, sf_dir)

    def draw(kind: str, k: int):
        if kind == "word":
            return (F.col("word_idx") * 37 + F.col("image_id")) % 101 / F.lit(101.0)
        return F.col("image_id") * 31 % 97 / F.lit(97.0)

    return L.training_window_plan(fx.imgs(words), words, 512, draw)
