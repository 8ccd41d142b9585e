"""Decoding tables: class scores by step, language-model scores and beams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import decode as X


def decode_steps(logits: DataFrame, by: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Best class and its probability per step, put together per sequence.

    Scores are reduced to two numbers before the shuffle; a sequence has as many entries as the
    decoder has steps.
    """
    best = logits.select(*by, "step", X.argmax("scores").alias("idx"), X.max_prob("scores").alias("p"))
    listed = best.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("step", "idx", "p"))).alias("s"))
    return listed.select(
        *by, F.transform("s", lambda s: s["idx"]).alias("indices"), F.transform("s", lambda s: s["p"]).alias("probs")
    )


def restrict_vocab(logits: DataFrame, allowed: Sequence[int], by: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Shift scores by the sequence's smallest score, then zero every class that is not allowed."""
    lowest = logits.groupBy(*by).agg(F.min(F.array_min("scores")).alias("__low"))
    kept = F.array(*[F.lit(int(i)) for i in sorted(allowed)])
    shifted = F.transform(
        "scores", lambda v, i: F.when(F.array_contains(kept, i), v.cast("double") - F.col("__low")).otherwise(F.lit(0.0))
    )
    return logits.join(lowest, list(by)).withColumn("scores", shifted).drop("__low")


def bigram_score(
    df: DataFrame, weights: DataFrame, bigram: DataFrame, unigram: DataFrame, by: Sequence[str] = ("id",), text: str = "text"
) -> DataFrame:
    """Sum of ln(weight * P(pair) + (1 - weight) * P(second)); an impossible pair gives -infinity.

    Pairs are counted per text, and each distinct pair is priced once, before the texts join.
    """
    spots = df.where(F.length(text) > 1).select(
        *by, F.explode(F.sequence(F.lit(1), F.length(text) - 1)).alias("i"), F.col(text).alias("t")
    )
    pairs = spots.select(*by, F.substring("t", F.col("i"), F.lit(2)).alias("pair")).groupBy(*by, "pair").agg(
        F.count(F.lit(1)).alias("n")
    )
    kinds = pairs.select("pair").distinct()
    priced = (
        kinds.withColumn("ch", F.substring("pair", 1, 1)).join(weights, "ch", "left").drop("ch")
        .join(bigram.withColumnRenamed("p", "p2"), "pair", "left")
        .withColumn("ch", F.substring("pair", 2, 1)).join(unigram.withColumnRenamed("p", "p1"), "ch", "left")
    )
    w, p2, p1 = (F.coalesce(c, F.lit(0.0)) for c in ("weight", "p2", "p1"))
    chance = w * p2 + (F.lit(1.0) - w) * p1
    log = F.when(chance > 0, F.ln(chance)).otherwise(F.lit(float("-inf")))
    scored = pairs.join(priced.select("pair", log.alias("log")), "pair").groupBy(*by).agg(
        F.sum(F.col("n") * F.col("log")).alias("score")
    )
    return df.join(scored, list(by), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def beam_rerank(
    df: DataFrame, by: Sequence[str] = ("seq_id",), lm: str = "lm_score", beam: str = "beam_score", text: str = "text"
) -> DataFrame:
    """Best text of each sample by softmax(softmax(lm) + softmax(beam)), cut at its end mark.

    Maxima and sums are aggregated per sample and joined back, so no sample is listed.
    """
    keys = list(by)
    tops = df.groupBy(*keys).agg(F.max(lm).alias("__l"), F.max(beam).alias("__b"))
    powered = df.join(tops, keys).withColumns(
        {"__el": F.exp(F.col(lm) - F.col("__l")), "__eb": F.exp(F.col(beam) - F.col("__b"))}
    )
    sums = powered.groupBy(*keys).agg(F.sum("__el").alias("__sl"), F.sum("__eb").alias("__sb"))
    mixed = powered.join(sums, keys).withColumn("mix", F.col("__el") / F.col("__sl") + F.col("__eb") / F.col("__sb"))
    best = mixed.groupBy(*keys).agg(
        F.max_by(F.struct(text, "mix"), F.struct("mix", (-F.col("beam")).alias("b"))).alias("m"),
        F.sum(F.exp("mix")).alias("total"),
    )
    return best.select(
        *keys, X.prune_eos(F.col(f"m.{text}")).alias("text"), (F.exp(F.col("m.mix")) / F.col("total")).alias("confidence")
    )
