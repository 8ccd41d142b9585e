"""Joins between annotation, image, result and vocabulary tables.

No side is broadcast by hand: the optimiser and adaptive execution broadcast a side only when
its measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 256


def file_stem(path: Column | str) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def join_image_annotation(images: DataFrame, annotations: DataFrame, on: str = "stem") -> DataFrame:
    return images.join(annotations, on, "inner")


def missing_side(left: DataFrame, right: DataFrame, on: str = "stem") -> DataFrame:
    """Rows of the left side that a pairing skips."""
    return left.join(right.select(on), on, "left_anti")


def anns_of_images(imgs: DataFrame, anns: DataFrame) -> DataFrame:
    return imgs.join(anns, "image_id")


def ids_semi(df: DataFrame, ids: DataFrame, on: Sequence[str] = ("image_id",)) -> DataFrame:
    return df.join(ids.select(*on), list(on), "left_semi")


def ids_minus(df: DataFrame, ids: DataFrame, on: Sequence[str] = ("image_id",)) -> DataFrame:
    return df.join(ids.select(*on), list(on), "left_anti")


def load_results(results: DataFrame, imgs: DataFrame) -> DataFrame:
    """Results of known images with their area. ``results`` carries its input position in ``id``."""
    return ids_semi(results, imgs).withColumn("area", F.col("bw") * F.col("bh"))


def count_skipped_images(results: DataFrame, imgs: DataFrame) -> DataFrame:
    return ids_minus(results, imgs).agg(F.countDistinct("image_id").alias("skipped_images"))


def pair_gt_pred(gt: DataFrame, pred: DataFrame, on: str = "sample_id", text: str = "pred") -> DataFrame:
    """Truth with the prediction of the same sample; a missing prediction is an empty text."""
    return gt.join(pred, on, "left").withColumn(text, F.coalesce(text, F.lit("")))


def arity_check(df: DataFrame, words: str, boxes: str) -> DataFrame:
    return df.where(F.size(words) == F.size(boxes))


def vocab_lookup(df: DataFrame, vocab: DataFrame, ch: str = "ch") -> DataFrame:
    """Index of each character row; null where the vocabulary lacks it."""
    return df.join(vocab, ch, "left")


def oov_report(df: DataFrame, vocab: DataFrame, ch: str = "ch") -> DataFrame:
    """Characters without an index, with their number of uses (counted before the join)."""
    uses = df.groupBy(ch).agg(F.count(F.lit(1)).alias("uses"))
    return uses.join(vocab.select(ch), ch, "left_anti")


def in_cells(df: DataFrame, cell: int, prefix: str = "", where: str | None = None) -> DataFrame:
    """One row per grid cell that the box touches, as columns cell_x, cell_y. Rows without the flag ``where`` all go to cell 0, 0."""

    def cells(low: str, high: str) -> Column:
        a, b = F.floor(F.col(prefix + low) / cell), F.floor(F.col(prefix + high) / cell)
        every = F.sequence(a, F.greatest(a, b))
        if where is not None:
            every = F.when(F.col(where), every).when(a.isNotNull(), F.array(F.lit(0).cast("long")))
        return F.explode(every)

    return df.withColumn("cell_x", cells("xmin", "xmax")).withColumn("cell_y", cells("ymin", "ymax"))


def overlapping(
    left: DataFrame, right: DataFrame, on: Sequence[str] = ("image_id",), cell: int = CELL
) -> DataFrame:
    """Pairs of boxes that share some area. Box columns come out as l_xmin.. and r_xmin...

    Boxes meet only inside the grid cells both touch, so a page with very many boxes spreads
    over many join keys; the pair is kept in the cell that holds its overlap's first corner.
    """
    boxes = ("xmin", "ymin", "xmax", "ymax")
    a, b = left, right
    for name in boxes:
        a, b = a.withColumnRenamed(name, f"l_{name}"), b.withColumnRenamed(name, f"r_{name}")
    keys = [*on, "cell_x", "cell_y"]
    pairs = in_cells(a, cell, "l_").join(in_cells(b, cell, "r_"), keys)
    first_x, first_y = F.greatest("l_xmin", "r_xmin"), F.greatest("l_ymin", "r_ymin")
    return pairs.where(
        (F.least("l_xmax", "r_xmax") > first_x)
        & (F.least("l_ymax", "r_ymax") > first_y)
        & (F.floor(first_x / cell) == F.col("cell_x"))
        & (F.floor(first_y / cell) == F.col("cell_y"))
    ).drop("cell_x", "cell_y")


def overlapping_in_pages(left: DataFrame, right: DataFrame, on: Sequence[str] = ("image_id",)) -> DataFrame:
    """The rows of ``overlapping``, without a grid: for pages of bounded numbers of boxes, which come out dealt by page."""
    a, b = left, right
    for name in ("xmin", "ymin", "xmax", "ymax"):
        a, b = a.withColumnRenamed(name, f"l_{name}"), b.withColumnRenamed(name, f"r_{name}")
    return a.join(b, list(on)).where(
        (F.least("l_xmax", "r_xmax") > F.greatest("l_xmin", "r_xmin")) & (F.least("l_ymax", "r_ymax") > F.greatest("l_ymin", "r_ymin"))
    )


def overlap_area() -> Column:
    """Shared area of a row from ``overlapping``."""
    return (F.least("l_xmax", "r_xmax") - F.greatest("l_xmin", "r_xmin")) * (
        F.least("l_ymax", "r_ymax") - F.greatest("l_ymin", "r_ymin")
    )


def attach_chars(words: DataFrame, chars: DataFrame, keys: Sequence[str] = ("file", "word_idx")) -> DataFrame:
    """Give each word the list of its first length(text) characters, in order.

    The list of one word is bounded by the length of its text.
    """
    sized = chars.join(words.select(*keys, F.length("text").alias("__len")), list(keys))
    fields = [c for c in chars.columns if c not in (*keys, "char_idx")]
    lists = (
        sized.where(F.col("char_idx") < F.col("__len"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("char_idx", *fields))).alias("__chars"))
    )
    joined = words.drop("chars").join(lists, list(keys), "left")
    bare = F.transform("__chars", lambda c: F.struct(*[c[f].alias(f) for f in fields]))
    kind = chars.select(F.struct(*fields).alias("c")).schema["c"].dataType.simpleString()
    return joined.withColumn("chars", F.coalesce(bare, F.array().cast(f"array<{kind}>"))).drop("__chars")
