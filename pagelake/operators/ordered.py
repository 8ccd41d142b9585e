"""Numbering, running totals and sliding frames that never put a whole group in one task.

A plain ``Window.partitionBy(group).orderBy(key)`` sorts each group in a single task. Here a
table with a group above ``ROWS_PER_SLICE`` rows (``WIDE_ROWS_PER_SLICE`` with texts or lists) is cut into slices of consecutive ``(group, key)`` values,
each slice is worked on alone, and a small table with one row per (group, slice) carries the
count, sum or maximum of the earlier slices over. Slice membership depends on the row's own
values and on literal split points only, so any retry of a task gives the same slices, and
split points of any quality give exact results; they only decide the balance.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SLICE = 4_000_000
WIDE_ROWS_PER_SLICE = 200_000
MAX_SLICES = 4096
SAMPLES_PER_SLICE = 40

_MERGE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": F.greatest,
    "min": F.least,
}
_AGG = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_CARRY = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def _slice_rows(df: DataFrame) -> int:
    """Fewer rows per task where rows carry texts, bytes or lists of unknown length."""
    wide = any(f.dataType.typeName() in ("string", "binary", "array", "map", "struct") for f in df.schema.fields)
    return WIDE_ROWS_PER_SLICE if wide else ROWS_PER_SLICE


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group, by one distributed count of the group columns alone."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    return counts.agg(F.coalesce(F.max("__n"), F.lit(0)).alias("__n")).first()[0]


def split_points(
    df: DataFrame,
    keys: Sequence[str],
    rows_per_slice: int | None = None,
    max_slices: int | None = None,
    total: int | None = None,
    by: Sequence[str] = (),
) -> list[tuple]:
    """Evenly spaced values of the key tuple, from one count and one bounded sample.

    Empty for a table of at most ``rows_per_slice`` rows, or where no ``by`` group has more: plain windows over the groups do then. The driver sees at most about
    ``SAMPLES_PER_SLICE * max_slices`` key tuples, whatever the table size. A known bound of the
    row count in ``total`` saves the counting pass.
    """
    rows_per_slice = rows_per_slice or _slice_rows(df)
    table = df.select(*keys)
    total = table.count() if total is None else total
    slices = min(total // rows_per_slice, max_slices or MAX_SLICES)
    if slices < 1 or by and largest_group(table, by) <= rows_per_slice:
        return []
    fraction = min(1.0, SAMPLES_PER_SLICE * (slices + 1) / total)
    sample = table.sample(fraction=fraction, seed=11).distinct().orderBy(*keys).collect()
    step = max(1, len(sample) // (slices + 1))
    return [tuple(row) for row in sample[step::step]][:slices]


def slice_of(df: DataFrame, keys: Sequence[str], points: Sequence[tuple]) -> Column:
    """Number of split points below the row's key tuple, by binary search over a literal array."""
    if not points:
        return F.lit(0)
    types = {f.name: f.dataType for f in df.schema.fields}
    table = F.array(
        *[F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, point)]) for point in points]
    )
    probe = F.struct(*[F.col(k) for k in keys])
    steps, size = [], 1
    while size <= len(points):
        steps.append(size)
        size *= 2
    halving = F.array(*[F.lit(s) for s in reversed(steps)])

    def advance(low: Column, step: Column) -> Column:
        inside = low + step <= F.lit(len(points))
        index = F.least(low + step, F.lit(len(points))) - 1
        return F.when(inside & (F.get(table, index) < probe), low + step).otherwise(low)

    return F.aggregate(halving, F.lit(0), advance)


def _sliced(df: DataFrame, by: Sequence[str], keys: Sequence[str], points: Sequence[tuple]) -> DataFrame:
    """Add ``__slice``, a struct of the group columns and the slice number.

    The struct itself is never null and equals itself where a group column is null, so one plain
    key serves the join with the carried values and the window after it: one shuffle for both.
    """
    number = slice_of(df, keys, points).alias("number")
    return df.withColumn("__slice", F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], number))


def _before(by: Sequence[str]):
    """Earlier slices of the same group, in a table with one row per slice."""
    groups = [F.col(f"__slice.g{i}") for i in range(len(by))] or [F.lit(0)]
    return Window.partitionBy(*groups).orderBy("__slice.number").rowsBetween(Window.unboundedPreceding, -1)


def _window(by: Sequence[str], order_by: Sequence[str], sliced: bool):
    parts = [F.col("__slice")] if sliced else [F.col(c) for c in by] or [F.lit(0)]
    return Window.partitionBy(*parts).orderBy(*order_by)


def number_rows(
    df: DataFrame,
    order_by: Sequence[str],
    by: Sequence[str] = (),
    name: str = "row_num",
    start: int = 1,
    points: Sequence[tuple] | None = None,
    total: int | None = None,
) -> DataFrame:
    """Consecutive numbers in ``order_by`` order inside each ``by`` group."""
    keys = [*by, *order_by]
    if points is None:
        points = split_points(df, keys, total=total, by=by)
    if not points:
        return df.withColumn(name, (F.row_number().over(_window(by, order_by, False)) + (start - 1)).cast("long"))
    sliced = _sliced(df, by, keys, points)
    totals = sliced.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    offsets = totals.select("__slice", F.coalesce(F.sum("__n").over(_before(by)), F.lit(0)).alias("__offset"))
    return (
        sliced.join(offsets, "__slice")
        .withColumn(
            name,
            (F.row_number().over(_window(by, order_by, True)) + F.col("__offset") + (start - 1)).cast("long"),
        )
        .drop("__slice", "__offset")
    )


def running(
    df: DataFrame,
    order_by: Sequence[str],
    aggs: Mapping[str, tuple[str, Column]],
    by: Sequence[str] = (),
    exclusive: bool = False,
    points: Sequence[tuple] | None = None,
) -> DataFrame:
    """Running ``sum``/``count``/``max``/``min`` per group, with or without the current row.

    ``aggs`` maps a new column to ``(kind, expression)``.
    """
    keys = [*by, *order_by]
    if points is None:
        points = split_points(df, keys, by=by)
    last = -1 if exclusive else Window.currentRow
    if not points:
        frame = _window(by, order_by, False).rowsBetween(Window.unboundedPreceding, last)
        return df.withColumns({n: _AGG[kind](expr).over(frame) for n, (kind, expr) in aggs.items()})
    sliced = _sliced(df, by, keys, points)
    parts = sliced.groupBy("__slice").agg(
        *[_AGG[kind](expr).alias(f"__part_{n}") for n, (kind, expr) in aggs.items()]
    )
    carried = parts.select(
        "__slice",
        *[_CARRY[kind](f"__part_{n}").over(_before(by)).alias(f"__carry_{n}") for n, (kind, _) in aggs.items()],
    )
    frame = _window(by, order_by, True).rowsBetween(Window.unboundedPreceding, last)
    out = sliced.join(carried, "__slice")
    out = out.withColumns({n: _AGG[kind](expr).over(frame) for n, (kind, expr) in aggs.items()})
    out = out.withColumns({n: _MERGE[kind](F.col(n), F.col(f"__carry_{n}")) for n, (kind, _) in aggs.items()})
    return out.drop("__slice", *[f"__carry_{n}" for n in aggs])


def sliding(
    df: DataFrame,
    order_by: Sequence[str],
    exprs: Mapping[str, Callable],
    by: Sequence[str] = (),
    before: int = 0,
    after: int = 0,
    points: Sequence[tuple] | None = None,
    block: int | None = None,
) -> DataFrame:
    """Expressions over a frame of ``before`` rows back to ``after`` rows ahead.

    ``exprs`` maps a new column to a function from the ordered window to a Column; the function
    adds its own ``rowsBetween``. Large tables are cut into blocks of consecutive row numbers and
    the few rows at a block edge are sent to the neighbour block as well.
    """
    keys = [*by, *order_by]
    if points is None:
        points = split_points(df, keys, by=by)
    if not points:
        window = _window(by, order_by, False)
        return df.withColumns({n: make(window) for n, make in exprs.items()})
    size = max(block or ROWS_PER_SLICE, before, after, 1)
    ranked = number_rows(df, order_by, by, name="__rank", start=0, points=points)
    own = F.floor(F.col("__rank") / size)
    place = F.col("__rank") % size
    homes = F.array(
        F.struct(own.alias("slice"), F.lit(True).alias("home")),
        F.struct(F.when(place >= size - before, own + 1).alias("slice"), F.lit(False).alias("home")),
        F.struct(F.when(place < after, own - 1).alias("slice"), F.lit(False).alias("home")),
    )
    spread = ranked.withColumn("__home", F.explode(F.filter(homes, lambda h: h["slice"].isNotNull())))
    block_key = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], F.col("__home.slice").alias("number"))
    spread = spread.withColumn("__slice", block_key).withColumn("__own", F.col("__home.home"))
    window = _window(by, ["__rank"], True)
    out = spread.withColumns({n: make(window) for n, make in exprs.items()})
    return out.where("__own").drop("__home", "__slice", "__own", "__rank")


def shuffle_rows(df: DataFrame, ids: Sequence[str], seed: int = 0, key: Column | None = None) -> DataFrame:
    """A reproducible shuffle: global order by a seeded hash of the ids (``key`` replaces the hash)."""
    key = F.xxhash64(*[F.col(c) for c in ids], F.lit(seed)) if key is None else key
    return df.withColumn("__key", key).orderBy("__key", *ids).drop("__key")


def batch_ids(
    df: DataFrame, ids: Sequence[str], size: int, seed: int = 0, key: Column | None = None,
    points: Sequence[tuple] | None = None,
) -> DataFrame:
    """Batch number of each row after a seeded shuffle; every batch but the last has ``size`` rows."""
    key = F.xxhash64(*[F.col(c) for c in ids], F.lit(seed)) if key is None else key
    keyed = number_rows(df.withColumn("__key", key), ["__key", *ids], name="__pos", start=0, points=points)
    return keyed.withColumn("batch_id", F.floor(F.col("__pos") / size)).drop("__key", "__pos")


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows, as they come."""
    return df.limit(n)
