"""Recognition scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.text import edit_similarity, filter_chars


def score_pairs(
    pairs: DataFrame,
    gt: str = "gt",
    pred: str = "pred",
    sensitive: bool = True,
    vocab: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``correct`` and ``similarity`` after optional lower-casing and vocabulary filtering."""
    left, right = F.col(gt), F.col(pred)
    if not sensitive:
        left, right = F.lower(left), F.lower(right)
    if vocab is not None:
        left, right = filter_chars(left, vocab), filter_chars(right, vocab)
    return pairs.withColumn("correct", left == right).withColumn("similarity", edit_similarity(left, right))


def recognition_eval(
    pairs: DataFrame,
    by: Sequence[str | Column] = (),
    gt: str = "gt",
    pred: str = "pred",
    sensitive: bool = True,
    vocab: Sequence[str] | None = None,
    rollup: bool = False,
) -> DataFrame:
    """Exact-match percentage and mean edit similarity, per group or with subtotals."""
    scored = score_pairs(pairs, gt, pred, sensitive, vocab)
    grouped = scored.rollup(*by) if rollup else scored.groupBy(*by)
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if("correct") * 100.0 / F.count(F.lit(1))).alias("accuracy"),
        F.avg("similarity").alias("norm_ed"),
    )


def recognition_report(scored: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows of (truth, prediction, equal)."""
    return scored.orderBy(*order_by).limit(n)


def worst_pairs(scored: DataFrame, k: int, ids: Sequence[str]) -> DataFrame:
    """The ``k`` pairs of lowest similarity."""
    return scored.orderBy("similarity", *ids).limit(k)
