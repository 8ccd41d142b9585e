"""Queries on detection and recognition scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import geometry as G
from pagelake.functions import text as X
from pagelake.operators import detection as D
from pagelake.operators import filters as P
from pagelake.operators import joins as J
from pagelake.operators import quads as Q
from pagelake.operators import recognition as R
from pagelake.plans import fixtures as fx
from pagelake.plans.oracle import CTES, cte
from pagelake.plans.registry import query
from pagelake.session import materialise

LETTERS = "abcdefghijklmnopqrstuvwxyz"


_sides = fx.scoring_sides


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# ---- recognition -----------------------------------------------------------------------------

_SIM = """CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0.0
  ELSE 1.0 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)) END"""


@query("recognition_eval", ("recog_pairs",), f"""
  SELECT grp, count(*) AS n, round(100.0 * count(*) FILTER (a = b) / count(*), 6) AS accuracy,
         round(avg({_SIM}), 6) AS norm_ed
  FROM (SELECT grp, regexp_replace(lower(gt), '[^a-z]', '', 'g') AS a,
               regexp_replace(lower(pred), '[^a-z]', '', 'g') AS b FROM recog_pairs) GROUP BY grp""")
def recognition_eval(spark, sf_dir):
    pairs = fx.recog_pairs(fx.gt_words(spark, sf_dir))
    out = R.recognition_eval(pairs, ["grp"], sensitive=False, vocab=LETTERS)
    return out.select("grp", "n", _r("accuracy"), _r("norm_ed"))


@query("recognition_eval_rollup", ("recog_pairs",), f"""
  SELECT grp, count(*) AS n, round(100.0 * count(*) FILTER (a = b) / count(*), 6) AS accuracy,
         round(avg({_SIM}), 6) AS norm_ed
  FROM (SELECT grp, gt AS a, pred AS b FROM recog_pairs) GROUP BY ROLLUP (grp)""")
def recognition_eval_rollup(spark, sf_dir):
    out = R.recognition_eval(fx.recog_pairs(fx.gt_words(spark, sf_dir)), ["grp"], rollup=True)
    return out.select("grp", "n", _r("accuracy"), _r("norm_ed"))


@query("recognition_report", ("recog_pairs",), """
  SELECT sample_id, gt, pred, gt = pred AS correct FROM recog_pairs ORDER BY sample_id LIMIT 5""")
def recognition_report(spark, sf_dir):
    scored = R.score_pairs(fx.recog_pairs(fx.gt_words(spark, sf_dir)))
    return R.recognition_report(scored, ["sample_id"]).select("sample_id", "gt", "pred", "correct")


@query("worst_pairs", ("recog_pairs",), f"""
  SELECT sample_id, a AS gt, b AS pred, round({_SIM}, 6) AS similarity
  FROM (SELECT sample_id, gt AS a, pred AS b FROM recog_pairs) ORDER BY {_SIM}, sample_id LIMIT 20""")
def worst_pairs(spark, sf_dir):
    scored = R.score_pairs(fx.recog_pairs(fx.gt_words(spark, sf_dir)))
    return R.worst_pairs(scored, 20, ["sample_id"]).select("sample_id", "gt", "pred", _r("similarity"))


@query("edit_similarity", ("recog_pairs",), f"""
  SELECT sample_id, round({_SIM}, 6) AS similarity FROM (SELECT sample_id, gt AS a, pred AS b FROM recog_pairs)""")
def edit_similarity(spark, sf_dir):
    pairs = fx.recog_pairs(fx.gt_words(spark, sf_dir))
    return pairs.select("sample_id", F.round(X.edit_similarity("gt", "pred"), 6).alias("similarity"))


@query("pair_gt_pred", ("recog_pairs",), """
  SELECT g.sample_id, g.gt, coalesce(p.pred, '') AS pred FROM recog_pairs g
  LEFT JOIN (SELECT sample_id, pred FROM recog_pairs WHERE pred <> '') p ON g.sample_id = p.sample_id""")
def pair_gt_pred(spark, sf_dir):
    pairs = fx.recog_pairs(fx.gt_words(spark, sf_dir))
    made = pairs.where(F.col("pred") != "").select("sample_id", "pred")
    return J.pair_gt_pred(pairs.select("sample_id", "gt"), made)


@query("normalise_label", ("recog_pairs",), """
  SELECT sample_id, CASE WHEN length(s) <= 9 THEN s END AS label FROM (
    SELECT sample_id, regexp_replace(lower(pred), '[^a-m ]', '?', 'g') AS s FROM recog_pairs)""")
def normalise_label(spark, sf_dir):
    pairs = fx.recog_pairs(fx.gt_words(spark, sf_dir))
    label = X.normalise_label("pred", "abcdefghijklm", sensitive=False, max_len=9)
    return pairs.select("sample_id", label.alias("label"))


@query("filter_chars", ("recog_pairs",), """
  SELECT sample_id, regexp_replace(pred, '[^a-z]', '', 'g') AS kept, regexp_replace(pred, '[?]+', '', 'g') AS known
  FROM recog_pairs""")
def filter_chars(spark, sf_dir):
    pairs = fx.recog_pairs(fx.gt_words(spark, sf_dir))
    return pairs.select(
        "sample_id", X.filter_chars("pred", LETTERS).alias("kept"), X.strip_unknown("pred").alias("known")
    )


# ---- detection -------------------------------------------------------------------------------

cte("dc_gt", "SELECT image_id, word_idx AS dc_idx, xmin, ymin, xmax, ymax FROM gt_eval WHERE text = '###'", ("gt_eval",))
cte("care_gt", """SELECT image_id, word_idx, length(text) AS n_chars, xmin, ymin, xmax, ymax,
  (xmax - xmin) * (ymax - ymin) AS area FROM gt_eval WHERE text <> '###'""", ("gt_eval",))
# Regions cut into the cells of all their breakpoints; a cell counts if a plus box and no minus box covers it.
cte("rg_dc_hit", """
  SELECT d.image_id, d.det_idx, g.dc_idx, greatest(d.xmin, g.xmin) AS x0, greatest(d.ymin, g.ymin) AS y0,
         least(d.xmax, g.xmax) AS x1, least(d.ymax, g.ymax) AS y1
  FROM det_boxes d JOIN dc_gt g ON d.image_id = g.image_id AND least(d.xmax, g.xmax) > greatest(d.xmin, g.xmin)
    AND least(d.ymax, g.ymax) > greatest(d.ymin, g.ymin)""", ("det_boxes", "dc_gt"))
cte("rg_boxes", """
  SELECT image_id, -1 AS a, dc_idx AS b, xmin AS x0, ymin AS y0, xmax AS x1, ymax AS y1, 1 AS plus FROM dc_gt
  UNION ALL
  SELECT g.image_id, -1, g.dc_idx, greatest(g.xmin, c.xmin), greatest(g.ymin, c.ymin), least(g.xmax, c.xmax),
         least(g.ymax, c.ymax), 0
  FROM dc_gt g JOIN care_gt c ON g.image_id = c.image_id AND least(g.xmax, c.xmax) > greatest(g.xmin, c.xmin)
    AND least(g.ymax, c.ymax) > greatest(g.ymin, c.ymin)
  UNION ALL
  SELECT h.image_id, h.det_idx, k.b, h.x0, h.y0, h.x1, h.y1, 1
  FROM rg_dc_hit h, LATERAL (SELECT unnest([h.dc_idx, -1]) AS b) k
  UNION ALL
  SELECT h.image_id, h.det_idx, k.b, greatest(h.x0, c.xmin), greatest(h.y0, c.ymin), least(h.x1, c.xmax),
         least(h.y1, c.ymax), 0
  FROM rg_dc_hit h JOIN care_gt c ON h.image_id = c.image_id AND least(h.x1, c.xmax) > greatest(h.x0, c.xmin)
    AND least(h.y1, c.ymax) > greatest(h.y0, c.ymin), LATERAL (SELECT unnest([h.dc_idx, -1]) AS b) k""",
    ("rg_dc_hit", "care_gt"))
cte("rg_xs", """SELECT image_id, a, b, x AS xa, lead(x) OVER (PARTITION BY image_id, a, b ORDER BY x) AS xb FROM (
  SELECT image_id, a, b, x0 AS x FROM rg_boxes UNION SELECT image_id, a, b, x1 FROM rg_boxes)""", ("rg_boxes",))
cte("rg_ys", """SELECT image_id, a, b, y AS ya, lead(y) OVER (PARTITION BY image_id, a, b ORDER BY y) AS yb FROM (
  SELECT image_id, a, b, y0 AS y FROM rg_boxes UNION SELECT image_id, a, b, y1 FROM rg_boxes)""", ("rg_boxes",))
cte("rg_cells", """
  SELECT x.image_id, x.a, x.b, xa, xb, ya, yb
  FROM rg_xs x JOIN rg_ys y ON x.image_id = y.image_id AND x.a = y.a AND x.b = y.b
  JOIN rg_boxes r ON r.image_id = x.image_id AND r.a = x.a AND r.b = x.b
    AND r.x0 <= xa AND r.x1 >= xb AND r.y0 <= ya AND r.y1 >= yb
  WHERE xb IS NOT NULL AND yb IS NOT NULL
  GROUP BY ALL HAVING max(plus) = 1 AND min(plus) = 1""", ("rg_xs", "rg_ys"))
cte("rg_areas", """
  SELECT image_id, a, b, CAST(sum((xb - xa) * (yb - ya)) AS BIGINT) AS area,
         CAST(sum((xb - xa) * (yb - ya) * (xa + xb)) AS BIGINT) AS twice_mx,
         CAST(sum((xb - xa) * (yb - ya) * (ya + yb)) AS BIGINT) AS twice_my
  FROM rg_cells GROUP BY image_id, a, b""", ("rg_cells",))
cte("dc_pairs", """
  SELECT p.image_id, p.a AS det_idx, p.b AS word_idx, p.area AS inter, d.area AS dc_area
  FROM rg_areas p JOIN rg_areas d ON p.image_id = d.image_id AND d.a = -1 AND d.b = p.b
  WHERE p.a >= 0 AND p.b >= 0""", ("rg_areas",))
cte("dets", """
  SELECT d.image_id, d.det_idx, d.xmin, d.ymin, d.xmax, d.ymax,
         (d.xmax - d.xmin) * (d.ymax - d.ymin) AS det_area,
         coalesce(CAST(f.many AS DOUBLE) / nullif((d.xmax - d.xmin) * (d.ymax - d.ymin), 0) >= 0.4, false)
           OR coalesce(CAST(f.best AS DOUBLE) / nullif((d.xmax - d.xmin) * (d.ymax - d.ymin), 0) > 0.4, false) AS det_dc,
         (d.xmax - d.xmin) * (d.ymax - d.ymin) - coalesce(l.area, 0) AS left_area,
         coalesce(CAST((d.xmax - d.xmin) * (d.ymax - d.ymin) * (d.xmin + d.xmax) - coalesce(l.twice_mx, 0) AS DOUBLE)
           / nullif(2 * ((d.xmax - d.xmin) * (d.ymax - d.ymin) - coalesce(l.area, 0)), 0), (d.xmin + d.xmax) / 2.0) AS left_cx,
         coalesce(CAST((d.xmax - d.xmin) * (d.ymax - d.ymin) * (d.ymin + d.ymax) - coalesce(l.twice_my, 0) AS DOUBLE)
           / nullif(2 * ((d.xmax - d.xmin) * (d.ymax - d.ymin) - coalesce(l.area, 0)), 0), (d.ymin + d.ymax) / 2.0) AS left_cy
  FROM det_boxes d
  LEFT JOIN (SELECT image_id, det_idx, sum(CASE WHEN CAST(inter AS DOUBLE) / nullif(dc_area, 0) > 0.4 THEN inter ELSE 0 END) AS many,
                    max(inter) AS best FROM dc_pairs GROUP BY 1, 2) f
    ON d.image_id = f.image_id AND d.det_idx = f.det_idx
  LEFT JOIN rg_areas l ON l.image_id = d.image_id AND l.a = d.det_idx AND l.b = -1""", ("det_boxes", "dc_pairs"))
cte("ev_pairs", """
  SELECT *, CAST(inter AS DOUBLE) / nullif(g_area, 0) >= 0.4 AS hit_r,
         coalesce(CAST(inter AS DOUBLE) / nullif(left_area, 0), 0) >= 0.4 AS hit_p
  FROM (
    SELECT g.image_id, g.word_idx, d.det_idx, g.n_chars, g.area AS g_area, d.left_area, d.det_dc, d.left_cx, d.left_cy,
           g.xmin AS gx0, g.ymin AS gy0, g.xmax AS gx1, g.ymax AS gy1,
           d.xmin AS dx0, d.ymin AS dy0, d.xmax AS dx1, d.ymax AS dy1,
           (least(g.xmax, d.xmax) - greatest(g.xmin, d.xmin)) * (least(g.ymax, d.ymax) - greatest(g.ymin, d.ymin)) AS inter
    FROM care_gt g JOIN dets d ON g.image_id = d.image_id AND least(g.xmax, d.xmax) > greatest(g.xmin, d.xmin)
      AND least(g.ymax, d.ymax) > greatest(g.ymin, d.ymin))""", ("care_gt", "dets"))
cte("ev_bent_gt", """
  SELECT DISTINCT i.image_id, i.word_idx FROM ev_pairs i JOIN ev_pairs k
    ON i.image_id = k.image_id AND i.word_idx = k.word_idx AND i.det_idx <> k.det_idx,
    LATERAL (SELECT (i.dx0 + i.dx1 - k.dx0 - k.dx1) / 2.0 AS vx0, (i.dy0 + i.dy1 - k.dy0 - k.dy1) / 2.0 AS vy,
             i.dy1 - (k.dy0 + k.dy1) / 2.0 AS uy) d,
    LATERAL (SELECT CASE WHEN vx0 = 0 AND vy = 0 THEN 1 ELSE vx0 END AS vx,
             CASE WHEN vx0 = 0 AND uy = 0 THEN 1 ELSE vx0 END AS ux) e
  WHERE i.hit_p AND NOT i.det_dc AND k.hit_p AND NOT k.det_dc
    AND abs(ux * vy - uy * vx) >= abs(ux * vx + uy * vy)""", ("ev_pairs",))
cte("ev_bent_det", """
  SELECT DISTINCT i.image_id, i.det_idx FROM ev_pairs i JOIN ev_pairs k
    ON i.image_id = k.image_id AND i.det_idx = k.det_idx AND i.word_idx <> k.word_idx,
    LATERAL (SELECT (i.gx0 + i.gx1 - k.gx0 - k.gx1) / 2.0 AS vx0, (i.gy0 + i.gy1 - k.gy0 - k.gy1) / 2.0 AS vy,
             i.gx0 - (k.gx0 + k.gx1) / 2.0 AS ux0) d,
    LATERAL (SELECT CASE WHEN vx0 = 0 AND vy = 0 THEN 1 ELSE vx0 END AS vx,
             CASE WHEN ux0 = 0 AND vy = 0 THEN 1 ELSE ux0 END AS ux) e
  WHERE i.hit_r AND NOT i.det_dc AND k.hit_r AND NOT k.det_dc
    AND abs(ux * vy - vy * vx) >= abs(ux * vx + vy * vy)""", ("ev_pairs",))
cte("matches", """
  SELECT * FROM (
    SELECT p.image_id, p.word_idx, p.det_idx, p.n_chars, gx0, gy0, gx1, gy1, dx0, dy0, dx1, dy1,
           hit_r AND hit_p AND NOT det_dc AND g_hits = 1 AND d_hits = 1
             AND 2.0 * sqrt(pow((gx0 + gx1) / 2.0 - left_cx, 2) + pow((gy0 + gy1) / 2.0 - left_cy, 2))
                 / (sqrt(pow(gx1 - gx0, 2) + pow(gy1 - gy0, 2)) + sqrt(pow(dx1 - dx0, 2) + pow(dy1 - dy0, 2))) < 1
             AS one_to_one,
           hit_p AND NOT det_dc AND g_many >= 2 AND CAST(g_inter AS DOUBLE) / g_area >= 0.4
             AND bg.word_idx IS NULL AS one_to_many,
           hit_r AND NOT det_dc AND d_many >= 2 AND CAST(d_inter AS DOUBLE) / left_area >= 0.4
             AND bd.det_idx IS NULL AS many_to_one
    FROM ev_pairs p
    JOIN (SELECT image_id, word_idx, count(*) FILTER (hit_r AND hit_p) AS g_hits, count(*) FILTER (hit_p AND NOT det_dc) AS g_many,
                 sum(inter) FILTER (hit_p AND NOT det_dc) AS g_inter FROM ev_pairs GROUP BY 1, 2) g
      ON g.image_id = p.image_id AND g.word_idx = p.word_idx
    JOIN (SELECT image_id, det_idx, count(*) FILTER (hit_r AND hit_p) AS d_hits, count(*) FILTER (hit_r AND NOT det_dc) AS d_many,
                 sum(inter) FILTER (hit_r AND NOT det_dc) AS d_inter FROM ev_pairs GROUP BY 1, 2) d
      ON d.image_id = p.image_id AND d.det_idx = p.det_idx
    LEFT JOIN ev_bent_gt bg ON bg.image_id = p.image_id AND bg.word_idx = p.word_idx
    LEFT JOIN ev_bent_det bd ON bd.image_id = p.image_id AND bd.det_idx = p.det_idx)
  WHERE one_to_one OR one_to_many OR many_to_one""", ("ev_bent_gt", "ev_bent_det"))
cte("match_chars", """
  SELECT image_id, word_idx, det_idx, n_chars, c, x >= dx0 AND x <= dx1 AND y >= dy0 AND y <= dy1 AS inside FROM (
    SELECT m.*, c, CASE WHEN gy1 - gy0 > 1.5 * (gx1 - gx0) THEN (gx0 + gx1) / 2.0
                     ELSE gx0 + (gx1 - gx0) * ((c + 0.5) / n_chars) END AS x,
           CASE WHEN gy1 - gy0 > 1.5 * (gx1 - gx0) THEN gy1 - (gy1 - gy0) * ((c + 0.5) / n_chars)
                ELSE (gy0 + gy1) / 2.0 END AS y
    FROM (SELECT *, unnest(range(0, n_chars)) AS c FROM matches) m)""", ("matches",))
cte("per_image", """
  SELECT c.image_id, n_gt, n_det, coalesce(recall_sum, 0) AS recall_sum, coalesce(precision_sum, 0) AS precision_sum
  FROM (SELECT image_id, CAST(sum(g) AS BIGINT) AS n_gt, CAST(sum(d) AS BIGINT) AS n_det FROM (
          SELECT image_id, CASE WHEN text <> '###' THEN 1 ELSE 0 END AS g, 0 AS d FROM gt_eval
          UNION ALL SELECT image_id, 0, CASE WHEN det_dc THEN 0 ELSE 1 END FROM dets) GROUP BY image_id) c
  LEFT JOIN (SELECT image_id, sum(CAST(once AS DOUBLE) / n_chars) AS recall_sum FROM (
               SELECT image_id, word_idx, n_chars, count(*) FILTER (k = 1) AS once FROM (
                 SELECT image_id, word_idx, n_chars, c, count(*) FILTER (inside) AS k FROM match_chars GROUP BY ALL)
               GROUP BY ALL) GROUP BY image_id) r ON r.image_id = c.image_id
  LEFT JOIN (SELECT image_id, sum(CAST(held AS DOUBLE) / total) AS precision_sum FROM (
               SELECT image_id, det_idx, count(*) FILTER (inside) AS held, count(*) AS total FROM match_chars GROUP BY ALL)
             GROUP BY image_id) p ON p.image_id = c.image_id""", ("match_chars", "gt_eval", "dets"))

_RATES = """
  SELECT image_id, n_gt, n_det, recall_sum, precision_sum, recall, precision,
         CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS hmean
  FROM (SELECT *, {recall} AS recall, {precision} AS precision FROM per_image)"""
_ZERO = {"recall": "coalesce(recall_sum / nullif(n_gt, 0), 0)", "precision": "coalesce(precision_sum / nullif(n_det, 0), 0)"}
_ONE = {
    "recall": f"CASE WHEN n_gt = 0 THEN 1.0 ELSE {_ZERO['recall']} END",
    "precision": f"CASE WHEN n_gt = 0 THEN CASE WHEN n_det > 0 THEN 0.0 ELSE 1.0 END ELSE {_ZERO['precision']} END",
}


@query("overlap_pairs", ("gt_eval", "det_boxes"), """
  SELECT image_id, word_idx, det_idx, inter, gt_area, det_area, round(CAST(inter AS DOUBLE) / gt_area, 6) AS recall,
         round(CAST(inter AS DOUBLE) / det_area, 6) AS precision FROM (
    SELECT g.image_id, word_idx, det_idx, (g.xmax - g.xmin) * (g.ymax - g.ymin) AS gt_area,
           (d.xmax - d.xmin) * (d.ymax - d.ymin) AS det_area,
           (least(g.xmax, d.xmax) - greatest(g.xmin, d.xmin)) * (least(g.ymax, d.ymax) - greatest(g.ymin, d.ymin)) AS inter
    FROM gt_eval g JOIN det_boxes d ON g.image_id = d.image_id AND least(g.xmax, d.xmax) > greatest(g.xmin, d.xmin)
      AND least(g.ymax, d.ymax) > greatest(g.ymin, d.ymin))""")
def overlap_pairs(spark, sf_dir):
    out = D.overlap_pairs(*_sides(spark, sf_dir))
    return out.withColumn("recall", F.round("recall", 6)).withColumn("precision", F.round("precision", 6))


@query("subtract_dont_care", ("rg_areas",), """
  SELECT image_id, a AS det_idx, area, twice_mx, twice_my FROM rg_areas WHERE a >= 0 AND b = -1""")
def subtract_dont_care(spark, sf_dir):
    return D.subtract_dont_care(*_sides(spark, sf_dir))[1]


@query("dont_care_pairs", ("dc_pairs",), "SELECT image_id, det_idx, word_idx, inter, dc_area FROM dc_pairs")
def dont_care_pairs(spark, sf_dir):
    return D.subtract_dont_care(*_sides(spark, sf_dir))[0].select("image_id", "det_idx", "word_idx", "inter", "dc_area")


@query("mark_det_dont_care", ("dets",), "SELECT image_id, det_idx, det_area, det_dc FROM dets")
def mark_det_dont_care(spark, sf_dir):
    gt, det = _sides(spark, sf_dir)
    return D.mark_det_dont_care(det, D.subtract_dont_care(gt, det)[0]).select("image_id", "det_idx", "det_area", "det_dc")


def _match_query(kind: str):
    @query(f"match_{kind}", ("matches",), f"SELECT image_id, word_idx, det_idx FROM matches WHERE {kind}")
    def run(spark, sf_dir):
        return D.detection_matches(*_sides(spark, sf_dir))[0].where(kind).select("image_id", "word_idx", "det_idx")

    return run


for _kind in ("one_to_one", "one_to_many", "many_to_one"):
    _match_query(_kind)


@query("chars_in_detections", ("match_chars",), """
  SELECT image_id, word_idx, det_idx, count(*) FILTER (inside) AS held, count(*) AS total FROM match_chars GROUP BY ALL""")
def chars_in_detections(spark, sf_dir):
    held = D.chars_in_detections(D.detection_matches(*_sides(spark, sf_dir))[0])
    return held.select(
        "image_id", "word_idx", "det_idx", F.size("inside").cast("long").alias("held"),
        F.col("n_chars").cast("long").alias("total"),
    )


@query("detection_eval_per_image", ("per_image",), f"""
  SELECT image_id, n_gt, n_det, round(recall, 6) AS recall, round(precision, 6) AS precision, round(hmean, 6) AS hmean
  FROM ({_RATES.format(**_ONE)})""")
def detection_eval_per_image(spark, sf_dir):
    out = D.detection_eval_per_image(*_sides(spark, sf_dir))
    return out.select("image_id", "n_gt", "n_det", _r("recall"), _r("precision"), _r("hmean"))


@query("detection_eval_macro", ("per_image",), f"""
  SELECT count(*) AS images, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision,
         round(avg(hmean), 6) AS hmean FROM ({_RATES.format(**_ZERO)})""")
def detection_eval_macro(spark, sf_dir):
    out = D.detection_eval_macro(D.detection_eval_per_image(*_sides(spark, sf_dir), empty="zero"))
    return out.select("images", _r("recall"), _r("precision"), _r("hmean"))


@query("detection_eval_micro", ("per_image",), """
  SELECT round(recall, 6) AS recall, round(precision, 6) AS precision,
         round(CASE WHEN recall + precision = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END, 6) AS hmean
  FROM (SELECT coalesce(sum(recall_sum) / nullif(sum(n_gt), 0), 0) AS recall,
               coalesce(sum(precision_sum) / nullif(sum(n_det), 0), 0) AS precision FROM per_image)""")
def detection_eval_micro(spark, sf_dir):
    out = D.detection_eval_micro(D.detection_eval_per_image(*_sides(spark, sf_dir)))
    return out.select(_r("recall"), _r("precision"), _r("hmean"))


@query("rank_detections", ("det_boxes",), """
  SELECT image_id, det_idx, conf, row_number() OVER (ORDER BY conf DESC, image_id, det_idx) AS rank FROM det_boxes""")
def rank_detections(spark, sf_dir):
    det = materialise(_sides(spark, sf_dir)[1].select("image_id", "det_idx", "conf"), "ranked")  # read by count, sample and slices
    return D.rank_detections(det, ["image_id", "det_idx"])


@query("average_precision", ("gt_eval", "det_boxes"), """
  WITH hits AS (
    SELECT DISTINCT d.image_id, d.det_idx FROM gt_eval g JOIN det_boxes d ON g.image_id = d.image_id
      AND least(g.xmax, d.xmax) > greatest(g.xmin, d.xmin) AND least(g.ymax, d.ymax) > greatest(g.ymin, d.ymin)
    WHERE 2 * (least(g.xmax, d.xmax) - greatest(g.xmin, d.xmin)) * (least(g.ymax, d.ymax) - greatest(g.ymin, d.ymin))
          >= (d.xmax - d.xmin) * (d.ymax - d.ymin)),
  ranked AS (
    SELECT h.det_idx IS NOT NULL AS hit, row_number() OVER (ORDER BY conf DESC, d.image_id, d.det_idx) AS rk
    FROM det_boxes d LEFT JOIN hits h ON h.image_id = d.image_id AND h.det_idx = d.det_idx),
  summed AS (SELECT hit, rk, sum(CAST(hit AS INTEGER)) OVER (ORDER BY rk) AS correct FROM ranked)
  SELECT round(sum(CAST(correct AS DOUBLE) / rk) FILTER (hit) / (SELECT count(*) FROM gt_eval), 6) AS average_precision
  FROM summed""")
def average_precision(spark, sf_dir):
    gt, det = _sides(spark, sf_dir)
    hits = D.overlap_pairs(gt, det).where(F.col("precision") >= 0.5).select("image_id", "det_idx").distinct()
    flagged = det.join(hits.withColumn("match", F.lit(True)), ["image_id", "det_idx"], "left").select(
        "image_id", "det_idx", "conf", F.coalesce("match", F.lit(False)).alias("match")
    )
    n_gt = gt.agg(F.count(F.lit(1)).alias("n_gt"))
    return D.average_precision(flagged, n_gt, ["image_id", "det_idx"]).select(_r("average_precision"))


@query("split_dont_care", ("gt_words",), "SELECT image_id, word_idx, text <> '###' AS care FROM gt_words")
def split_dont_care(spark, sf_dir):
    return P.split_dont_care(fx.gt_words(spark, sf_dir)).select("image_id", "word_idx", "care")


@query("quad_overlap_pairs", ("gt_eval", "det_boxes"), """
  SELECT image_id, word_idx, det_idx, round(CAST(inter AS DOUBLE), 3) AS inter FROM (
    SELECT g.image_id, word_idx, det_idx,
           (least(g.xmax, d.xmax) - greatest(g.xmin, d.xmin)) * (least(g.ymax, d.ymax) - greatest(g.ymin, d.ymin)) AS inter
    FROM gt_eval g JOIN det_boxes d ON g.image_id = d.image_id AND least(g.xmax, d.xmax) > greatest(g.xmin, d.xmin)
      AND least(g.ymax, d.ymax) > greatest(g.ymin, d.ymin))""")
def quad_overlap_pairs(spark, sf_dir):
    """Both sides turned by the same angle per image: shared areas stay those of the upright boxes."""
    from pagelake.functions.polygons import quad_overlap_pairs as pairs

    turn = (F.col("image_id") % 17) * 0.1

    def turned(df, idx):
        x0, y0, x1, y1 = (F.col(c) for c in G.BOX)
        cols = []
        for k, (x, y) in enumerate(((x0, y0), (x1, y0), (x1, y1), (x0, y1)), 1):
            cols += [(x * F.cos(turn) - y * F.sin(turn)).alias(f"x{k}"), (x * F.sin(turn) + y * F.cos(turn)).alias(f"y{k}")]
        return df.select("image_id", idx, *cols)

    gt, det = _sides(spark, sf_dir)
    out = pairs(turned(gt, "word_idx"), turned(det, "det_idx"), truncate=False).where("inter > 0.001")
    return out.select("image_id", "word_idx", "det_idx", _r("inter", 3))


# ---- slanted text ----------------------------------------------------------------------------

# Both sides turned and stretched by the triangle 3, 4, 5, so that corners stay whole numbers: areas grow by 25, lengths by 5, and rates
# stay those of the upright boxes. No turned word counts as tall, so its characters run along its first side.
# A vector of length zero points along the turned page's x axis, which is (3, -4) on the upright one.
_TURNED_BENDS = """
  SELECT DISTINCT i.image_id, i.{key} FROM ev_pairs i JOIN ev_pairs k ON i.image_id = k.image_id AND i.{key} = k.{key} AND i.{member} <> k.{member},
    LATERAL (SELECT {vx} AS vx0, {vy} AS vy0, {ux} AS ux0, {uy} AS uy0) d,
    LATERAL (SELECT CASE WHEN vx0 = 0 AND vy0 = 0 THEN 3 ELSE vx0 END AS vx, CASE WHEN vx0 = 0 AND vy0 = 0 THEN -4 ELSE vy0 END AS vy,
             CASE WHEN ux0 = 0 AND uy0 = 0 THEN 3 ELSE ux0 END AS ux, CASE WHEN ux0 = 0 AND uy0 = 0 THEN -4 ELSE uy0 END AS uy) e
  WHERE i.{hit} AND NOT i.det_dc AND k.{hit} AND NOT k.det_dc AND abs(ux * vy - uy * vx) >= abs(ux * vx + uy * vy)"""
cte("turned_bent_gt", _TURNED_BENDS.format(
    key="word_idx", member="det_idx", hit="hit_p", vx="(i.dx0 + i.dx1 - k.dx0 - k.dx1) / 2.0", vy="(i.dy0 + i.dy1 - k.dy0 - k.dy1) / 2.0",
    ux="(i.dx0 + i.dx1 - k.dx0 - k.dx1) / 2.0", uy="i.dy1 - (k.dy0 + k.dy1) / 2.0"), ("ev_pairs",))
cte("turned_bent_det", _TURNED_BENDS.format(
    key="det_idx", member="word_idx", hit="hit_r", vx="(i.gx0 + i.gx1 - k.gx0 - k.gx1) / 2.0", vy="(i.gy0 + i.gy1 - k.gy0 - k.gy1) / 2.0",
    ux="i.gx0 - (k.gx0 + k.gx1) / 2.0", uy="(i.gy0 + i.gy1 - k.gy0 - k.gy1) / 2.0"), ("ev_pairs",))
cte("turned_matches", CTES["matches"][1].replace("ev_bent_", "turned_bent_"), ("turned_bent_gt", "turned_bent_det"))
cte("turned_chars", """
  SELECT image_id, word_idx, det_idx, n_chars, c, x >= dx0 AND x <= dx1 AND y >= dy0 AND y <= dy1 AS inside FROM (
    SELECT m.*, c, gx0 + (gx1 - gx0) * ((c + 0.5) / n_chars) AS x, (gy0 + gy1) / 2.0 AS y
    FROM (SELECT *, unnest(range(0, n_chars)) AS c FROM turned_matches) m)""", ("turned_matches",))
cte("turned_image", """
  SELECT c.image_id, n_gt, n_det, coalesce(recall_sum, 0) AS recall_sum, coalesce(precision_sum, 0) AS precision_sum
  FROM (SELECT image_id, CAST(sum(g) AS BIGINT) AS n_gt, CAST(sum(d) AS BIGINT) AS n_det FROM (
          SELECT image_id, CASE WHEN text <> '###' THEN 1 ELSE 0 END AS g, 0 AS d FROM gt_eval
          UNION ALL SELECT image_id, 0, CASE WHEN det_dc THEN 0 ELSE 1 END FROM dets) GROUP BY image_id) c
  LEFT JOIN (SELECT image_id, sum(CAST(once AS DOUBLE) / n_chars) AS recall_sum FROM (
               SELECT image_id, word_idx, n_chars, count(*) FILTER (k = 1) AS once FROM (
                 SELECT image_id, word_idx, n_chars, c, count(*) FILTER (inside) AS k FROM turned_chars GROUP BY ALL)
               GROUP BY ALL) GROUP BY image_id) r ON r.image_id = c.image_id
  LEFT JOIN (SELECT image_id, sum(CAST(held AS DOUBLE) / total) AS precision_sum FROM (
               SELECT image_id, det_idx, count(*) FILTER (inside) AS held, count(*) AS total FROM turned_chars GROUP BY ALL)
             GROUP BY image_id) p ON p.image_id = c.image_id""", ("turned_chars", "gt_eval", "dets"))
_TURNED_CELL = 1024


def _turned(df, *others: str, corners: str):
    """Quads of turned boxes; ``corners`` names the order, b for low and t for high values of x and y."""
    ends = {"x": {"b": F.col("xmin"), "t": F.col("xmax")}, "y": {"b": F.col("ymin"), "t": F.col("ymax")}}
    cols = []
    for k, (x, y) in enumerate(((ends["x"][c[0]], ends["y"][c[1]]) for c in corners.split()), 1):
        cols += [(3 * x - 4 * y).alias(f"x{k}"), (4 * x + 3 * y).alias(f"y{k}")]
    return df.select("image_id", *others, *cols)


def _turned_sides(spark, sf_dir):
    gt, det = _sides(spark, sf_dir)
    # The pivot of a detection lies on the side between its first and last corner: the lower one, as in the upright scoring.
    return materialise(_turned(gt, "word_idx", "text", corners="bb tb tt bt"), "turned_gt"), materialise(_turned(det, "det_idx", corners="bt bb tb tt"), "turned_det")


@query("detection_eval_quads_per_image", ("turned_image",), f"""
  SELECT image_id, n_gt, n_det, round(recall, 6) AS recall, round(precision, 6) AS precision, round(hmean, 6) AS hmean
  FROM ({_RATES.format(**_ONE).replace("FROM per_image", "FROM turned_image")})""")
def detection_eval_quads_per_image(spark, sf_dir):
    out = Q.detection_eval_quads_per_image(*_turned_sides(spark, sf_dir), cell=_TURNED_CELL)
    return out.select("image_id", "n_gt", "n_det", _r("recall"), _r("precision"), _r("hmean"))


@query("detection_eval_quads_micro", ("turned_image",), """
  SELECT round(recall, 6) AS recall, round(precision, 6) AS precision,
         round(CASE WHEN recall + precision = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END, 6) AS hmean
  FROM (SELECT coalesce(sum(recall_sum) / nullif(sum(n_gt), 0), 0) AS recall,
               coalesce(sum(precision_sum) / nullif(sum(n_det), 0), 0) AS precision FROM turned_image)""")
def detection_eval_quads_micro(spark, sf_dir):
    out = D.detection_eval_micro(Q.detection_eval_quads_per_image(*_turned_sides(spark, sf_dir), cell=_TURNED_CELL))
    return out.select(_r("recall"), _r("precision"), _r("hmean"))


@query("match_quads", ("turned_matches",), "SELECT image_id, word_idx, det_idx, one_to_one, one_to_many, many_to_one FROM turned_matches")
def match_quads(spark, sf_dir):
    matches = Q.detection_matches_quads(*_turned_sides(spark, sf_dir), cell=_TURNED_CELL)[0]
    return matches.select("image_id", "word_idx", "det_idx", "one_to_one", "one_to_many", "many_to_one")


@query("chars_in_quads", ("turned_chars",), """
  SELECT image_id, word_idx, det_idx, array_to_string(list(c ORDER BY c) FILTER (inside), ',') AS places, count(*) AS total FROM turned_chars GROUP BY ALL""")
def chars_in_quads(spark, sf_dir):
    held = Q.detection_matches_quads(*_turned_sides(spark, sf_dir), cell=_TURNED_CELL)[0]
    places = F.when(F.size("inside") > 0, F.array_join(F.col("inside").cast("array<string>"), ","))
    return held.select("image_id", "word_idx", "det_idx", places.alias("places"), F.col("n_chars").cast("long").alias("total"))


@query("subtract_dont_care_quads", ("rg_areas",), """
  SELECT image_id, a AS det_idx, 25 * area AS area, 25 * (3 * twice_mx - 4 * twice_my) AS twice_mx, 25 * (4 * twice_mx + 3 * twice_my) AS twice_my
  FROM rg_areas WHERE a >= 0 AND b = -1""")
def subtract_dont_care_quads(spark, sf_dir):
    lost = Q.subtract_dont_care_quads(*_turned_sides(spark, sf_dir), cell=_TURNED_CELL)[1]
    return lost.select("image_id", "det_idx", F.rint("area").cast("long").alias("area"), F.rint(F.col("mx") * 2).cast("long").alias("twice_mx"), F.rint(F.col("my") * 2).cast("long").alias("twice_my"))


@query("dont_care_pairs_quads", ("dc_pairs",), "SELECT image_id, det_idx, word_idx, 25 * inter AS inter, 25 * dc_area AS dc_area FROM dc_pairs")
def dont_care_pairs_quads(spark, sf_dir):
    pairs = Q.subtract_dont_care_quads(*_turned_sides(spark, sf_dir), cell=_TURNED_CELL)[0]
    return pairs.select("image_id", "det_idx", "word_idx", F.rint("inter").cast("long").alias("inter"), F.rint("dc_area").cast("long").alias("dc_area"))
