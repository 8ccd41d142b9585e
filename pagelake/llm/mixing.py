"""Mixing sources to target weights along a curriculum, by Column expressions and small tables alone.

Each source has a weight schedule: knots (time, weight) over training time 0 to 1, linear in between. The schedule's
integral is the source's weight in the mix; targets share the whole demand by weight, and none is above ``most_epochs``
times what its source holds (the excess goes to the others by weight). A source's documents stand in a hashed order and
are taken pass by pass until their running total meets the target. A document's place in that running total, as a
part of the target, is the source's cumulative demand; the inverse of the schedule's integral turns it into a training
position between 0 and 1, and the mix is range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.places import order_number, running_total
from pagelake.session import materialise

Knots = tuple[tuple[float, float], ...]

# Weights 5, 2, 1 by the order of sources, repeating: a fading, a constant and a growing schedule with these integrals.
SCHEDULES: tuple[Knots, ...] = (
    ((0.0, 7.5), (1.0, 2.5)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
SHARE = (3, 2)  # of all words, as a fraction
MOST_EPOCHS = 2
_ORDER_SEED = 8


def integral(knots: Knots) -> float:
    """The area under a schedule."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def check_schedule(knots: Knots) -> None:
    """Knots must run from 0 to 1 without going back, with weights not below zero and some area."""
    times = [t for t, _ in knots]
    if times[0] != 0 or times[-1] != 1 or times != sorted(set(times)) or any(w < 0 for _, w in knots) or integral(knots) <= 0:
        raise ValueError(f"not a schedule: {knots}")


def _segments(knots: Knots):
    """The pieces of a schedule with the part of its area that lies before and in each."""
    area, before, out = integral(knots), 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        part = (t1 - t0) * (w0 + w1) / 2 / area
        piece = {"t0": t0, "length": t1 - t0, "w0": w0, "w1": w1, "before": before, "part": part}
        out.append(F.struct(*(F.lit(float(v)).alias(k) for k, v in piece.items())))
        before += part
    return F.array(*out)


def source_targets(sized: DataFrame, source_col: str, schedules: tuple[Knots, ...] = SCHEDULES, share: tuple[int, int] = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """One row a source: source_size, weight, target and its schedule's segments.

    Sources stand by code point, null last, and take the schedules in turn. A source whose cap is below its share keeps the
    cap; the level of the others follows from the sorted ratios of cap to weight, which is where repeated resharing ends.
    Its windows see one row a source. A source without words has target 0.
    """
    for knots in schedules:
        check_schedule(knots)
    totals = sized.groupBy(F.col(source_col).alias("src")).agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    kind = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(schedules)))
    weight = F.element_at(F.array(*(F.lit(integral(k)) for k in schedules)), kind + 1)
    ranked = totals.select("src", "source_size", kind.alias("kind"), weight.alias("weight"))
    cap = F.lit(most_epochs) * F.col("source_size")
    by_ratio = Window.orderBy("ratio", F.col("src").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.col("demand") - F.col("caps_before")) / (F.col("weights") - F.col("weights_before"))
    # The first source, by ratio, that its share does not fill sets the level; if all are filled there is none.
    return (
        ranked.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("demand", F.sum("source_size").over(everything) * F.lit(share[0]) / F.lit(share[1])).withColumn("weights", F.sum("weight").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("own_level", level)
        .withColumn("level", F.min(F.when(F.col("own_level") <= F.col("ratio"), F.struct("ratio", "own_level"))).over(everything)["own_level"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))))
        .withColumn("segments", F.element_at(F.array(*(_segments(k) for k in schedules)), F.col("kind") + 1))
        .select("src", "source_size", "weight", "target", "segments")
    )


def _position(demand, segments):
    """The time at which the given part (0 to 1) of a schedule's area is used up."""
    piece = F.get(F.filter(segments, lambda s: (demand <= s["before"] + s["part"]) | (s["before"] + s["part"] >= 1 - 1e-12)), F.lit(0))
    inside = F.when(piece["part"] > 0, (demand - piece["before"]) / piece["part"]).otherwise(F.lit(0.0))
    w0, w1 = piece["w0"], piece["w1"]
    # (w0 x + (w1 - w0) x^2 / 2) / ((w0 + w1) / 2) = inside, solved for x without a cancelling difference.
    mean = inside * (w0 + w1)
    root = w0 + F.sqrt(F.greatest(w0 * w0 + (w1 - w0) * mean, F.lit(0.0)))
    x = F.when(root > 0, mean / root).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), piece["t0"] + piece["length"] * x))


def mix(docs: DataFrame, rows: int, key_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target, passes, taken and positions, one row a document.

    ``size`` is the number of words (null text: 0), ``passes`` how often the mix takes the document, ``taken`` that many
    times its size, ``positions`` the training position of every pass. Input columns of those names are replaced; names that
    begin with two underscores are the operator's own, all others pass through.
    A pass takes a document if the middle of its words lies within what is left of the target, so a source ends within
    half a document of its target. Documents without words are taken by the same rule. Equal keys are ordered by size;
    rows equal in both may change places. A hot source is dealt to buckets, never sorted as a whole. ``rows`` sets the
    number of buckets, not the result.
    """
    added = ("size", "source_size", "target", "passes", "taken", "positions")
    clean = docs.withColumns({"__key": F.col(key_col), "__src": F.col(source_col), "__body": F.col(text_col)}).drop(*(c for c in added if c in docs.columns))
    sized = clean.withColumn("size", F.coalesce(F.regexp_count("__body", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")).drop("__body")
    sized = sized.withColumn("__order", order_number(F.col("__key"), _ORDER_SEED))
    # Written, so that its size is measured and the join is chosen by it.
    targets = materialise(source_targets(sized, "__src", **how).select(F.col("src").alias("__name"), "source_size", "target", F.col("segments").alias("__segments")), "targets")
    placed = running_total(sized, "__src", ["__order", "__key", "size"], F.col("size"), "__before", rows)
    joined = placed.join(targets, F.col("__src").eqNullSafe(F.col("__name")), "left")
    middle = 2 * F.col("__before") + F.col("size")
    starts = F.sequence(F.lit(0), F.lit(how.get("most_epochs", MOST_EPOCHS) - 1))
    within = lambda p: (2 * p * F.col("source_size") + middle) <= 2 * F.col("target")
    taken = F.filter(starts, lambda p: within(p) & (p * F.col("source_size") < F.col("target")))
    demand = lambda p: (p * F.col("source_size") + F.col("__before") + F.col("size") / 2) / F.nullif(F.col("target"), F.lit(0.0))
    return (
        joined.withColumn("__taken", taken).withColumn("passes", F.size("__taken"))
        .withColumn("taken", F.col("passes") * F.col("size"))
        .withColumn("positions", F.transform("__taken", lambda p: _position(demand(p), F.col("__segments"))))
        .drop("__key", "__src", "__order", "__before", "__taken", "__name", "__segments")
    )


def order_by_position(mixed: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """One row for every time a document is taken, with its ``position``, range-sorted by position over all partitions."""
    taken = mixed.withColumn("position", F.explode("positions")).drop("positions")
    return taken.orderBy("position", key_col)


def curriculum(docs: DataFrame, rows: int, key_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as training reads it: the columns of ``docs`` alone, a row for every time a document is taken, in order of position."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text, source = (names[docs.columns.index(c)] for c in (key_col, text_col, source_col))
    return order_by_position(mix(docs.toDF(*names), rows, key, text, source, **how), key).select(*names).toDF(*docs.columns)
