"""Queries on metric logs, histograms and training signals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagelake.operators import metrics as M
from pagelake.plans import fixtures as fx
from pagelake.plans.registry import query
from pagelake.session import ensure_checkpoint_dir


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


_LAST = "SELECT *, row_number() OVER (PARTITION BY name ORDER BY iteration DESC) AS rn FROM metric_events"


@query("smooth_metrics", ("metric_events",), """
  SELECT name, iteration, round(CASE WHEN smooth THEN median(value) OVER (PARTITION BY name ORDER BY iteration
    ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) ELSE value END, 6) AS smoothed FROM metric_events""")
def smooth_metrics(spark, sf_dir):
    return M.smooth_metrics(fx.metric_events(spark, sf_dir)).select("name", "iteration", _r("smoothed"))


@query("latest_metrics", ("metric_events",), f"SELECT name, value, iteration FROM ({_LAST}) WHERE rn = 1")
def latest_metrics(spark, sf_dir):
    return M.latest_metrics(fx.metric_events(spark, sf_dir))


@query("latest_smoothed", ("metric_events",), f"""
  SELECT name, max(iteration) AS iteration, round(CASE WHEN bool_and(smooth) THEN median(value) ELSE max_by(value, iteration) END, 6) AS value
  FROM ({_LAST}) WHERE rn <= 20 GROUP BY name""")
def latest_smoothed(spark, sf_dir):
    return M.latest_smoothed(fx.metric_events(spark, sf_dir)).select("name", "iteration", _r("value"))


@query("metric_global_avg", ("metric_events",), "SELECT name, round(avg(value), 6) AS value FROM metric_events GROUP BY name")
def metric_global_avg(spark, sf_dir):
    return M.metric_global_avg(fx.metric_events(spark, sf_dir)).select("name", _r("value"))


@query("metric_avg", ("metric_events",), f"SELECT name, round(avg(value), 6) AS value FROM ({_LAST}) WHERE rn <= 20 GROUP BY name")
def metric_avg(spark, sf_dir):
    return M.metric_avg(fx.metric_events(spark, sf_dir), 20).select("name", _r("value"))


@query("metric_median", ("metric_events",), f"SELECT name, round(median(value), 6) AS value FROM ({_LAST}) WHERE rn <= 1000 GROUP BY name")
def metric_median(spark, sf_dir):
    return M.metric_median(fx.metric_events(spark, sf_dir), 1000).select("name", _r("value"))


@query("eta", ("metric_events",), f"""
  SELECT name, max(iteration) AS iteration, round(median(value) * (100000000 - max(iteration) - 1), 3) AS eta_seconds
  FROM ({_LAST}) WHERE rn <= 1000 GROUP BY name""")
def eta(spark, sf_dir):
    return M.eta(fx.metric_events(spark, sf_dir), 100_000_000).select("name", "iteration", _r("eta_seconds", 3))


@query("eta_from_times", ("metric_events",), f"""
  SELECT name, max(iteration) AS iteration, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / (max(iteration) - min(iteration))
    * (1000000 - max(iteration) - 1), 1) AS eta_seconds FROM ({_LAST}) WHERE rn <= 2 GROUP BY name""")
def eta_from_times(spark, sf_dir):
    return M.eta_from_times(fx.metric_events(spark, sf_dir), 1_000_000).select("name", "iteration", _r("eta_seconds", 1))


@query("new_since", ("metric_events",), "SELECT name, iteration, value FROM metric_events WHERE iteration > 1500")
def new_since(spark, sf_dir):
    return M.new_since(fx.metric_events(spark, sf_dir), 1500).select("name", "iteration", "value")


@query("scope_names", ("metric_events",), "SELECT concat('train/', name) AS name, count(*) AS n FROM metric_events GROUP BY name")
def scope_names(spark, sf_dir):
    return M.scope_names(fx.metric_events(spark, sf_dir), "train/").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("weighted_average", (), """
  SELECT l_returnflag AS grp, round(coalesce(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 0), 6) AS value FROM lineitem GROUP BY 1""")
def weighted_average(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_extendedprice", "l_quantity")
    return M.weighted_average(rows, "l_extendedprice", "l_quantity", ["grp"]).select("grp", _r("value"))


@query("metrics_jsonl", ("metric_events",), "SELECT iteration, name, value FROM metric_events WHERE iteration > 500")
def metrics_jsonl(spark, sf_dir):
    """The JSON lines after iteration 500, written, read and flattened again."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/pagelake-{spark.sparkContext.applicationId}/jsonl-{uuid.uuid4().hex}"
    M.write_metrics_jsonl(fx.metric_events(spark, sf_dir).select("name", "iteration", "value"), path, 500)
    lines = spark.read.text(path).select(F.from_json("value", "map<string,double>").alias("m"))
    flat = lines.select(F.col("m")["iteration"].cast("long").alias("iteration"), F.explode("m").alias("name", "value"))
    return flat.where("name <> 'iteration'")


@query("fixed_histogram", ("metric_events",), """
  WITH s AS (SELECT name, min(value) AS mn, max(value) AS mx, count(*) AS num, round(sum(value), 4) AS sum, round(sum(value * value), 4) AS sum_squares
             FROM metric_events GROUP BY name),
  b AS (SELECT e.name, CAST(least(floor((value - mn) / (mx - mn) * 50), 49) AS INTEGER) AS bin, count(*) AS n
        FROM metric_events e JOIN s ON e.name = s.name GROUP BY ALL)
  SELECT s.name, mn AS min, mx AS max, num, sum, sum_squares, i AS bin, round(mn + (mx - mn) / 50 * (i + 1), 6) AS right_edge, coalesce(n, 0) AS n
  FROM s CROSS JOIN range(0, 50) r(i) LEFT JOIN b ON b.name = s.name AND b.bin = i""")
def fixed_histogram(spark, sf_dir):
    out = M.fixed_histogram(fx.metric_events(spark, sf_dir), "value", ["name"], 50)
    flat = out.select(
        "name", "min", "max", "num", F.round("sum", 4).alias("sum"), F.round("sum_squares", 4).alias("sum_squares"),
        F.posexplode(F.arrays_zip("bucket_limits", "bucket_counts")).alias("bin", "z"),
    )
    return flat.select(
        "name", "min", "max", "num", "sum", "sum_squares", F.col("bin").cast("long").alias("bin"),
        F.round("z.bucket_limits", 6).alias("right_edge"), F.col("z.bucket_counts").alias("n"),
    )


_GREY = "CAST(floor(greatest(least((CAST(text AS DOUBLE) + 0.6) * 200, 255), 0)) AS BIGINT)"


@query("otsu_threshold", ("score_grid",), f"""
  WITH p AS (SELECT image_id % 50 AS crop, {_GREY} AS level FROM score_grid),
  c AS (SELECT crop, level, count(*) AS n FROM p GROUP BY ALL),
  r AS (SELECT crop, level, sum(n) OVER w AS n0, sum(level * n) OVER w AS s0, sum(n) OVER (PARTITION BY crop) AS n, sum(level * n) OVER (PARTITION BY crop) AS s
        FROM c WINDOW w AS (PARTITION BY crop ORDER BY level))
  SELECT crop, first(level ORDER BY round(v, 9) DESC, level) AS threshold FROM (
    SELECT crop, level, coalesce(CAST(n0 AS DOUBLE) / n * (CAST(n - n0 AS DOUBLE) / n) * pow(CAST(s0 AS DOUBLE) / n0 - CAST(s - s0 AS DOUBLE) / nullif(n - n0, 0), 2), 0) AS v FROM r)
  GROUP BY crop""")
def otsu_threshold(spark, sf_dir):
    return M.otsu_threshold(_grey(spark, sf_dir), "level", ["crop"])


def _grey(spark, sf_dir):
    level = F.floor(F.greatest(F.least((F.col("text").cast("double") + 0.6) * 200, F.lit(255.0)), F.lit(0.0)))
    return fx.score_grid(spark, sf_dir).select((F.col("image_id") % 50).alias("crop"), level.alias("level"))


@query("binarise", ("score_grid",), f"""
  WITH p AS (SELECT image_id % 50 AS crop, {_GREY} AS level FROM score_grid)
  SELECT crop, count(*) FILTER (level > 120) AS white, count(*) FILTER (level <= 120) AS black FROM p GROUP BY crop""")
def binarise(spark, sf_dir):
    grey = _grey(spark, sf_dir)
    fixed = grey.select("crop").distinct().withColumn("threshold", F.lit(120))
    out = M.binarise(grey, fixed, "level", ["crop"])
    return out.groupBy("crop").agg(F.count_if(F.col("level") == 255).alias("white"), F.count_if(F.col("level") == 0).alias("black"))


@query("early_stop", ("metric_events",), """
  WITH a AS (SELECT name AS exp, iteration AS step, value, max(value) OVER w AS prev, row_number() OVER (PARTITION BY name ORDER BY iteration) AS pos
             FROM metric_events WINDOW w AS (PARTITION BY name ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  b AS (SELECT *, prev IS NULL OR value > prev AS improved FROM a),
  c AS (SELECT *, pos - max(CASE WHEN improved THEN pos END) OVER (PARTITION BY exp ORDER BY step) AS since FROM b)
  SELECT exp, step, improved, greatest(value, coalesce(prev, value)) AS best, since,
         since > 300 AND coalesce(count(*) FILTER (since > 300) OVER (PARTITION BY exp ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS stop
  FROM c""")
def early_stop(spark, sf_dir):
    rows = fx.metric_events(spark, sf_dir).select(F.col("name").alias("exp"), F.col("iteration").alias("step"), "value")
    return M.early_stop(rows, 300).select("exp", "step", "improved", "best", "since", "stop")


@query("hard_negative_mean", ("score_grid",), """
  WITH p AS (SELECT image_id, y * 8 + x AS cell, CAST(abs(text) AS DOUBLE) AS loss, text >= 0.2 AS pos FROM score_grid),
  c AS (SELECT image_id, count(*) FILTER (pos) AS n_pos, avg(loss) FILTER (pos) AS pos_mean FROM p GROUP BY image_id),
  r AS (SELECT p.image_id, loss, row_number() OVER (PARTITION BY p.image_id ORDER BY loss DESC, cell) AS rk FROM p WHERE NOT pos)
  SELECT c.image_id, n_pos, round(CASE WHEN n_pos > 0 THEN pos_mean + avg(loss) ELSE avg(loss) END, 6) AS loss
  FROM c LEFT JOIN r ON r.image_id = c.image_id AND rk <= CASE WHEN n_pos > 0 THEN 3 * n_pos ELSE 500 END
  GROUP BY c.image_id, n_pos, pos_mean""")
def hard_negative_mean(spark, sf_dir):
    rows = fx.score_grid(spark, sf_dir).select(
        "image_id", (F.col("y") * 8 + F.col("x")).alias("cell"), F.abs("text").cast("double").alias("loss"),
        (F.col("text") >= F.lit(0.2).cast("float")).cast("double").alias("label"),
    )
    return M.hard_negative_mean(rows).select("image_id", "n_pos", _r("loss"))


@query("masked_mse", ("score_grid",), """
  SELECT image_id, round(avg(pow(CAST(text AS DOUBLE) - CAST(link AS DOUBLE), 2) * ((x + y) % 2)), 9) AS loss FROM score_grid GROUP BY image_id""")
def masked_mse(spark, sf_dir):
    rows = fx.score_grid(spark, sf_dir).withColumn("mask", (F.col("x") + F.col("y")) % 2)
    return M.masked_mse(rows, ["image_id"], "text", "link", "mask").select("image_id", _r("loss", 9))
