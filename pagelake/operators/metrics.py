"""Metric logs: ``metrics(name, iteration, value, smooth)``, histograms and stopping rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.operators.ordered import number_rows, running, sliding, split_points

SMOOTH_WINDOW = 20
ETA_WINDOW = 1000


def smooth_metrics(
    df: DataFrame, w: int = SMOOTH_WINDOW, by: Sequence[str] = ("name",), points=None, block: int | None = None
) -> DataFrame:
    """Add ``smoothed``: median of the last ``w`` values where the metric is noisy, else the value."""

    def median(window) -> Column:
        return F.percentile("value", F.lit(0.5)).over(window.rowsBetween(-(w - 1), Window.currentRow))

    out = sliding(df, ["iteration"], {"__median": median}, by, before=w - 1, points=points, block=block)
    return out.withColumn("smoothed", F.when(F.col("smooth"), F.col("__median")).otherwise(F.col("value"))).drop("__median")


def last_values(df: DataFrame, w: int, by: Sequence[str] = ("name",)) -> DataFrame:
    """The last ``w`` rows of each metric; Spark keeps only ``w`` per group before the shuffle."""
    newest = Window.partitionBy(*by).orderBy(F.col("iteration").desc())
    return df.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= w).drop("__rn")


def latest_metrics(df: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    newest = F.max_by(F.struct("value", "iteration"), "iteration").alias("m")
    return df.groupBy(*by).agg(newest).select(*by, "m.value", "m.iteration")


def latest_smoothed(df: DataFrame, w: int = SMOOTH_WINDOW, by: Sequence[str] = ("name",)) -> DataFrame:
    """Latest value per metric, or the median of its last ``w`` values where it is noisy."""
    tail = last_values(df, w, by).groupBy(*by).agg(
        F.max("iteration").alias("iteration"),
        F.percentile("value", F.lit(0.5)).alias("median"),
        F.max_by("value", "iteration").alias("last"),
        F.max_by("smooth", "iteration").alias("smooth"),
    )
    return tail.select(*by, "iteration", F.when(F.col("smooth"), F.col("median")).otherwise(F.col("last")).alias("value"))


def metric_global_avg(df: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("value").alias("value"))


def metric_avg(df: DataFrame, w: int, by: Sequence[str] = ("name",)) -> DataFrame:
    return last_values(df, w, by).groupBy(*by).agg(F.avg("value").alias("value"))


def metric_median(df: DataFrame, w: int, by: Sequence[str] = ("name",)) -> DataFrame:
    return last_values(df, w, by).groupBy(*by).agg(F.percentile("value", F.lit(0.5)).alias("value"))


def eta(df: DataFrame, max_iter: int, w: int = ETA_WINDOW, by: Sequence[str] = ("name",)) -> DataFrame:
    """Seconds left: median step time of the last ``w`` steps x steps still to do."""
    tail = last_values(df, w, by).groupBy(*by).agg(
        F.percentile("value", F.lit(0.5)).alias("step"), F.max("iteration").alias("iteration")
    )
    return tail.select(*by, "iteration", (F.col("step") * (F.lit(max_iter) - F.col("iteration") - 1)).alias("eta_seconds"))


def eta_from_times(df: DataFrame, max_iter: int, by: Sequence[str] = ("name",), ts: str = "ts") -> DataFrame:
    """The noisier estimate from the last two time stamps, for logs without step times."""
    tail = last_values(df, 2, by).groupBy(*by).agg(
        F.max(ts).alias("t1"), F.min(ts).alias("t0"),
        F.max("iteration").alias("iteration"), F.min("iteration").alias("i0"),
    )
    seconds = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 1e6
    step = F.try_divide(seconds, F.col("iteration") - F.col("i0"))
    return tail.select(*by, "iteration", (step * (F.lit(max_iter) - F.col("iteration") - 1)).alias("eta_seconds"))


def new_since(df: DataFrame, last_write: int) -> DataFrame:
    return df.where(F.col("iteration") > last_write)


def scope_names(df: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    return df.withColumn(name, F.concat(F.lit(prefix.rstrip("/") + "/"), F.col(name)))


def weighted_average(df: DataFrame, total: str, count: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of totals over sum of counts; 0 when there is nothing."""
    share = F.coalesce(F.try_divide(F.sum(total), F.sum(count).cast("double")), F.lit(0.0))
    return df.groupBy(*by).agg(share.alias("value"))


def metric_lines(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One JSON object per iteration with sorted keys, as column ``line``.

    A line lists each metric name once, so its size is bounded by the number of names.
    """
    body = F.array_sort(
        F.concat(
            F.collect_list(F.struct(F.col("name").alias("key"), F.to_json(F.struct(F.col("value").alias("v"))).alias("v"))),
            F.array(F.struct(F.lit("iteration").alias("key"), F.format_string('{"v":%d}', F.col("iteration")).alias("v"))),
        )
    )
    # to_json of a one-field struct is {"v":<number>}; the number sits between the colon and the brace.
    pairs = F.transform(
        body,
        lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), F.regexp_extract(e["v"], r':(.*)\}$', 1)),
    )
    line = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    return df.groupBy(*by, "iteration").agg(line.alias("line"))


def write_metrics_jsonl(df: DataFrame, path: str, last_write: int = -1, mode: str = "append") -> None:
    """Append one JSON line per iteration after ``last_write``."""
    metric_lines(new_since(df, last_write)).orderBy("iteration").select("line").write.mode(mode).text(path)


def fixed_histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 1000) -> DataFrame:
    """Equal-width bins from the smallest to the largest value of each group.

    Gives min, max, num, sum, sum_squares and arrays of right edges and counts. The largest value
    falls in the last bin; a constant group falls in the middle bin of a range of 1 around it.
    Rows are counted per bin before anything is put together, so a list has ``bins`` entries.
    """
    v = F.col(value).cast("double")
    base = df.select(*by, v.alias("v")).withColumn("__all", F.lit(1))
    keys = [*by, "__all"]
    stats = base.groupBy(*keys).agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("num"),
        F.sum("v").alias("sum"), F.sum(F.col("v") * F.col("v")).alias("sum_squares"),
    )
    same = F.col("min") == F.col("max")
    low = F.when(same, F.col("min") - 1).otherwise(F.col("min"))
    span = F.when(same, F.lit(2.0)).otherwise(F.col("max") - F.col("min"))
    place = F.least(F.floor((F.col("v") - low) / span * bins), F.lit(bins - 1)).cast("int")
    edges = base.join(stats.select(*keys, "min", "max"), keys).where(F.col("v").isNotNull())
    counted = edges.groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    lists = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("__n"))
    index = F.sequence(F.lit(0), F.lit(bins - 1))
    width = (F.col("max") - F.col("min")) / bins
    return (
        stats.join(lists, keys)
        .withColumn("bucket_limits", F.transform(index, lambda i: F.col("min") + width * (i + 1)))
        .withColumn(
            "bucket_counts", F.transform(index, lambda i: F.coalesce(F.try_element_at("__n", i), F.lit(0).cast("long")))
        )
        .drop("__n", "__all")
    )


def otsu_threshold(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Level with the largest between-class variance, per group of whole-number levels.

    Rows are counted per level first; the running sums then go over the levels of a group (256
    for image data), not over its rows.
    """
    levels = df.groupBy(*by, F.col(value).cast("long").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    group = [F.col(c) for c in by] or [F.lit(0)]
    upto = Window.partitionBy(*group).orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    weight = F.col("level") * F.col("n")
    sums = levels.select(
        *by, "level", F.sum("n").over(upto).alias("n0"), F.sum(weight).over(upto).alias("s0"),
        F.sum("n").over(whole).alias("n"), F.sum(weight).over(whole).alias("s"),
    )
    n0, s0, n1, s1 = F.col("n0"), F.col("s0"), F.col("n") - F.col("n0"), F.col("s") - F.col("s0")
    gap = F.try_divide(s0, n0) - F.try_divide(s1, n1)
    between = F.coalesce(
        F.try_divide(n0.cast("double"), F.col("n")) * F.try_divide(n1.cast("double"), F.col("n")) * gap * gap, F.lit(0.0)
    )
    best = F.max_by("level", F.struct("between", (-F.col("level")).alias("neg")))
    return sums.withColumn("between", between).groupBy(*by).agg(best.alias("threshold"))


def binarise(df: DataFrame, thresholds: DataFrame, value: str, by: Sequence[str], maxval: int = 255) -> DataFrame:
    """Values above their group's threshold become ``maxval``, others 0."""
    joined = df.join(thresholds, list(by))
    return joined.withColumn(value, F.when(F.col(value) > F.col("threshold"), F.lit(maxval)).otherwise(0)).drop("threshold")


def early_stop(
    df: DataFrame, patience: int, by: Sequence[str] = ("exp",), order: str = "step", value: str = "value", points=None
) -> DataFrame:
    """Add best so far, evaluations since it improved, and ``stop``: the first one past patience.

    Only a strict improvement resets the count.
    """
    keys = [*by, order]
    if points is None:
        points = split_points(df, keys)
    seen = running(df, [order], {"__prev": ("max", F.col(value))}, by, exclusive=True, points=points)
    better = F.col("__prev").isNull() | (F.col(value) > F.col("__prev"))
    marked = seen.withColumn("improved", better).withColumn("best", F.greatest(F.col(value), F.col("__prev")))
    counted = running(marked, [order], {"__pos": ("count", F.lit(1))}, by, points=points)
    at = F.when(F.col("improved"), F.col("__pos"))
    held = running(counted, [order], {"__at": ("max", at)}, by, points=points)
    since = held.withColumn("since", F.col("__pos") - F.col("__at")).drop("__prev", "__pos", "__at")
    over = F.col("since") > patience
    first = running(since, [order], {"__over": ("count", F.when(over, F.lit(1)))}, by, exclusive=True, points=points)
    return first.withColumn("stop", over & (F.coalesce("__over", F.lit(0)) == 0)).drop("__over")


def hard_negative_mean(
    df: DataFrame, by: Sequence[str] = ("image_id",), loss: str = "loss", label: str = "label",
    ids: Sequence[str] = ("cell",), positive: float = 0.1, ratio: int = 3, without: int = 500, points=None,
) -> DataFrame:
    """Mean loss of positives plus mean of the ``ratio`` x positives hardest negatives, per group.

    A group without positives gives the mean of its ``without`` hardest rows; one without
    negatives gives null. Rank and counts are distributed, so a group may be any size.
    """
    marked = df.select(*by, *ids, F.col(loss).alias("l"), (F.col(label) >= positive).alias("pos"), (-F.col(loss)).alias("neg_l"))
    counts = marked.groupBy(*by).agg(
        F.count_if("pos").alias("n_pos"), F.avg(F.when(F.col("pos"), F.col("l"))).alias("pos_mean")
    )
    ranked = number_rows(marked.where(~F.col("pos")), ["neg_l", *ids], by, name="rk", points=points)
    wanted = F.when(F.col("n_pos") > 0, F.col("n_pos") * ratio).otherwise(F.lit(without))
    hard = (
        ranked.join(counts.select(*by, "n_pos"), list(by))
        .where(F.col("rk") <= wanted)
        .groupBy(*by).agg(F.avg("l").alias("neg_mean"))
    )
    total = F.when(F.col("n_pos") > 0, F.col("pos_mean") + F.col("neg_mean")).otherwise(F.col("neg_mean"))
    return counts.join(hard, list(by), "left").select(*by, "n_pos", total.alias("loss"))


def masked_mse(df: DataFrame, by: Sequence[str], a: str, b: str, mask: str) -> DataFrame:
    """Mean over each group of squared error x mask."""
    gap = F.col(a).cast("double") - F.col(b).cast("double")
    return df.groupBy(*by).agg(F.avg(gap * gap * F.col(mask)).alias("loss"))


def select_checkpoint(files: DataFrame, kind: str = "best", by: Sequence[str] = ("exp",), name: str = "file_name") -> DataFrame:
    """Best file if asked for and present, else the one of the largest iteration.

    An experiment without any numbered file has no checkpoint, even with a best file.
    """
    stem = F.replace(F.replace(F.col(name), F.lit(".pth")), F.lit("iter_"))
    number = F.when((F.col(name) != "best_accuracy.pth") & stem.rlike("^[0-9]+$"), stem.cast("long"))
    found = files.where(F.col(name).endswith(".pth")).groupBy(*by).agg(
        F.max(number).alias("max_iter"), F.bool_or(F.col(name) == "best_accuracy.pth").alias("has_best")
    )
    latest = F.concat(F.lit("iter_"), F.col("max_iter").cast("string"), F.lit(".pth"))
    pick = F.when(F.col("has_best"), F.lit("best_accuracy.pth")).otherwise(latest) if kind == "best" else latest
    return found.select(
        *by, F.when(F.col("max_iter").isNotNull(), pick).alias("checkpoint"), F.coalesce("max_iter", F.lit(0)).alias("max_iter")
    )


def newest_by_digits(files: DataFrame, by: Sequence[str] = ("exp",), name: str = "file_name") -> DataFrame:
    """File whose name has the largest number once all but its digits are removed (none counts 0)."""
    digits = F.regexp_replace(F.col(name), "[^0-9]", "")
    number = F.coalesce(F.try_to_number(digits, F.lit("999999999999999999")).cast("long"), F.lit(0))
    keyed = files.where(F.col(name).endswith(".pth")).withColumn("__n", number)
    return keyed.groupBy(*by).agg(F.max_by(name, F.struct("__n", name)).alias("checkpoint"))
