"""Sample stores, shards, training mixes and seeded text generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.functions.geometry import hash_int, hash_uniform
from pagelake.functions.text import chars, format_key
from pagelake.operators.ordered import number_rows
from pagelake.session import materialise

SHARD_ROWS = 100_000
MOST_COPIES = 1024


def assign_shard(df: DataFrame, order_by: Sequence[str], n: int = SHARD_ROWS, points=None) -> DataFrame:
    """Shard number from 1, a new shard every ``n`` rows."""
    numbered = number_rows(df, order_by, name="__rn", start=0, points=points)
    return numbered.withColumn("shard", (F.floor(F.col("__rn") / n) + 1).cast("long")).drop("__rn")


def count_samples(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    return df.groupBy(dataset).agg(F.count(F.lit(1)).alias("num_samples"))


def length_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("num_samples").alias("length"))


def key_samples(df: DataFrame, order_by: Sequence[str], dataset: str = "dataset", points=None) -> DataFrame:
    """1-based number inside the dataset and its zero-padded keys."""
    out = number_rows(df, order_by, [dataset], name="sample_id", points=points)
    return out.withColumn("image_key", format_key("sample_id")).withColumn("label_key", format_key("sample_id", "label"))


def merge_stores(stores: Sequence[DataFrame], order_by: Sequence[str], points=None) -> DataFrame:
    """All samples of the stores, in store order, re-keyed from 0 with keys as wide as the count."""
    merged = None
    for place, store in enumerate(stores):
        part = store.withColumn("__store", F.lit(place))
        merged = part if merged is None else merged.unionByName(part)
    numbered = number_rows(merged, ["__store", *order_by], name="new_id", start=0, points=points)
    total = merged.agg(F.count(F.lit(1)).alias("total")).withColumn("one", F.lit(1))
    out = numbered.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one", "__store")  # one row
    width = F.length(F.col("total").cast("string"))
    return out.withColumn("key", F.concat(F.lit("image-"), F.lpad(F.col("new_id").cast("string"), width, F.lit("0")))).drop("total")


def split_store(
    df: DataFrame, order_by: Sequence[str], size: int, max_shards: int | None = None, drop_partial: bool = False,
    name: str = "store", points=None,
) -> DataFrame:
    """Fixed-size shards ``name_0000``.. with keys from 0 inside each.

    All rows are kept unless asked otherwise: ``drop_partial`` leaves out an incomplete last shard,
    ``max_shards`` all shards beyond that number.
    """
    numbered = number_rows(df, order_by, name="__rn", start=0, points=points)
    place = F.floor(F.col("__rn") / size)
    out = numbered.withColumn("shard_no", place).withColumn("shard_pos", F.col("__rn") % size).drop("__rn")
    if max_shards is not None:
        out = out.where(F.col("shard_no") < max_shards)
    if drop_partial:
        full = out.groupBy("shard_no").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == size)
        out = out.join(full.select("shard_no"), "shard_no", "left_semi")
    return out.withColumn("shard", F.concat(F.lit(name + "_"), F.lpad(F.col("shard_no").cast("string"), 4, "0"))).withColumn(
        "key", F.concat(F.lit("image-"), F.lpad(F.col("shard_pos").cast("string"), len(str(size)), "0"))
    )


def split_layout(df: DataFrame, test_shards: Sequence[int] = (9,)) -> DataFrame:
    """Add ``split``: the named shards are for test, the others for training."""
    return df.withColumn("split", F.when(F.col("shard").isin(*test_shards), "test").otherwise("train"))


def export_split_layout(df: DataFrame, path: str, test_shards: Sequence[int] = (9,), mode: str = "overwrite") -> None:
    """Write ``dataset=/split=`` folders; large folders are cut into several files, small rows merged."""
    out = split_layout(df, test_shards).hint("rebalance", "dataset", "split")
    out.write.mode(mode).partitionBy("dataset", "split").parquet(path)


def mix_datasets(
    samples: DataFrame, ratios: dict[str, int], order_by: Sequence[str], cycles: int | None = None,
    dataset: str = "dataset", points=None,
) -> DataFrame:
    """Add ``cycle``, ``slot`` and ``position`` of an endless feed that takes ``ratio`` rows of each dataset in turn.

    A dataset that runs out starts again. Without ``cycles`` the feed ends when every dataset has
    been read at least once. Datasets without rows are left out, and so is their share. No row is
    multiplied by more than ``MOST_COPIES`` in one task.
    """
    wanted = samples.where(F.col(dataset).isin(*ratios))
    ranked = number_rows(wanted, order_by, [dataset], name="__n", start=0, points=points)
    # One row per dataset, at most as many as there are ratios.
    names = list(ratios)
    ratio_of = F.create_map(*[v for k in names for v in (F.lit(k), F.lit(int(ratios[k])))])
    place_of = F.create_map(*[v for i, k in enumerate(names) for v in (F.lit(k), F.lit(i))])
    sizes = wanted.groupBy(dataset).agg(F.count(F.lit(1)).alias("__size"))
    sizes = sizes.withColumn("__ratio", F.element_at(ratio_of, F.col(dataset))).withColumn(
        "__place", F.element_at(place_of, F.col(dataset))
    )
    everyone = Window.partitionBy(F.lit(0))
    earlier = everyone.orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    plan = sizes.select(
        dataset, "__size", "__ratio",
        F.coalesce(F.sum("__ratio").over(earlier), F.lit(0)).alias("__offset"),
        F.sum("__ratio").over(everyone).alias("__width"),
        (F.lit(cycles) if cycles is not None else F.max(F.ceil(F.col("__size") / F.col("__ratio"))).over(everyone)).alias("__cycles"),
    )
    plan = materialise(plan, "mix-plan")
    joined = ranked.join(F.broadcast(plan), dataset)  # at most one row per ratio
    joined = joined.where(F.col("__n") < F.col("__cycles") * F.col("__ratio"))
    turns = F.floor((F.col("__cycles") * F.col("__ratio") - 1 - F.col("__n")) / F.col("__size"))
    most = plan.agg(F.max(F.ceil(F.col("__cycles") * F.col("__ratio") / F.col("__size")))).first()[0] or 1
    span = 1
    while span * MOST_COPIES < most:
        span *= MOST_COPIES
    # A row of a small dataset becomes blocks of turns first, dealt out again, and each block its turns.
    repeated = joined.withColumn("__turn", F.lit(0).cast("long"))
    while True:
        blocks = F.least(F.floor((turns - F.col("__turn")) / span), F.lit(MOST_COPIES - 1))
        repeated = repeated.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), blocks)))
        repeated = repeated.withColumn("__turn", F.col("__turn") + F.col("__block") * span).drop("__block")
        if span == 1:
            break
        repeated = repeated.repartition(dataset, "__n", "__turn")
        span //= MOST_COPIES
    at = F.col("__n") + F.col("__turn") * F.col("__size")
    out = repeated.withColumn("cycle", F.floor(at / F.col("__ratio"))).withColumn(
        "slot", (F.col("__offset") + at % F.col("__ratio")).cast("long")
    )
    out = out.withColumn("position", F.col("cycle") * F.col("__width") + F.col("slot"))
    return out.drop("__n", "__turn", "__size", "__ratio", "__offset", "__width", "__cycles")


def collect_charset(df: DataFrame, text: str = "label") -> DataFrame:
    """Distinct characters of all labels, one row each."""
    return df.select(F.explode(F.array_distinct(chars(text))).alias("ch")).distinct()


def build_vocabulary(df: DataFrame, tokens: Column, order_by: str, points=None) -> DataFrame:
    """Distinct tokens with counts, numbered in first-seen order of the whole-number column ``order_by``.

    The place of a token (row, then place in the row) is one decimal number, so counting stays a
    hash aggregation with partial results before the shuffle, and texts are never sorted.
    """
    row = F.col(order_by).cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)")
    seen = df.select(row.alias("__row"), F.posexplode(tokens).alias("__pos", "token"))
    place = F.col("__row") + F.col("__pos").cast("decimal(10,0)")
    counted = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("__first"))
    return number_rows(counted, ["__first"], name="idx", start=0, points=points).select("idx", "token", "n")


def sample_text(
    spark: SparkSession, corpus: DataFrame, n: int, order_by: Sequence[str], min_len: int = 1, max_len: int = 15,
    seed: int = 0, tries: int = 8, text: str = "line", lines: int | None = None,
) -> DataFrame:
    """``n`` random texts of about min..max characters out of a corpus of lines.

    Lines that are blank or shorter than ``min_len`` are never drawn. A longer line gives a random
    slice (four times out of five at most half of ``max_len``, if that is at least ``min_len``); a
    blank slice is drawn again. Every row draws ``tries`` lines by hash and takes the first that
    fits, so no row waits for another. If none fits, the first line's slice moves on to the next
    character that isn't blank, or to the line's first one (or ends with the line, if that is nearer).
    """
    fits = corpus.where((F.length(text) >= min_len) & (F.length(F.replace(text, F.lit(" "))) > 0))
    lines = fits.count() if lines is None else lines
    numbered = number_rows(fits, order_by, name="line_no", start=0, total=lines).select("line_no", F.col(text).alias("line"))
    want = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))
    want = want.withColumn("line_no", F.floor(hash_uniform(seed, "id", "try") * lines))
    drawn = want.join(numbered, "line_no")
    size = F.length("line")
    start = hash_int(seed + 1, 0, F.greatest(size - max_len, F.lit(0)), "id", "try")
    short = (hash_uniform(seed + 2, "id", "try") <= 0.8) & F.lit(max_len / 2 >= min_len)
    top = F.when(short, F.lit(max(max_len // 2, min_len))).otherwise(F.lit(max_len))
    long = hash_int(seed + 3, min_len, top, "id", "try").cast("int")
    part = F.substring("line", (start + 1).cast("int"), long)
    rest = F.ltrim(F.substring("line", (start + 1).cast("int"), size))
    inked = size - F.when(F.length(rest) > 0, F.length(rest)).otherwise(F.length(F.ltrim("line")))
    moved = F.substring("line", (F.least(inked, size - long) + 1).cast("int"), long)
    cut = drawn.withColumn("text", F.when(size > max_len, part).otherwise(F.col("line"))).withColumn("moved", moved)
    # Tries that fit come before those that were moved.
    blank = F.length(F.replace("text", F.lit(" "))) == 0
    ranked = cut.select("id", F.when(blank, F.col("moved")).otherwise(F.col("text")).alias("text"), F.struct(blank.alias("blank"), "try").alias("rank"))
    return ranked.groupBy("id").agg(F.min_by("text", "rank").alias("text"))


def sample_numbers(
    spark: SparkSession, n: int, low: int, high: int, int_frac: float, dec: int = 0, seed: int = 0
) -> DataFrame:
    """``n`` numbers from low up to high: whole with probability ``int_frac``, else with ``dec`` decimals."""
    scale = 10**dec
    whole = hash_int(seed + 1, low, high - 1, "id").cast("double")
    fine = hash_int(seed + 2, low * scale, high * scale - 1, "id") / float(scale)
    value = F.when(hash_uniform(seed, "id") < int_frac, whole).otherwise(fine)
    return spark.range(n).select("id", value.alias("value"))
