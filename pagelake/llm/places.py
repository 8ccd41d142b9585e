"""Running totals inside groups of any size, without a window over a whole group.

Rows of a group are dealt to buckets by the leading bits of their order number, totals of the buckets are added up in a
small table, and only the rows of one (group, bucket) are sorted together. The result does not depend on the number of
buckets, which follows the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 20_000
LEAST_BUCKETS = 64
ORDER_BITS = 60


def order_number(key: Column, seed: int) -> Column:
    """A repeatable draw of ``ORDER_BITS`` bits for a key, from md5 as other engines have it; null keys have one, too."""
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, ORDER_BITS // 4), 16, 10).cast("long")


def bucket_bits(rows: int) -> int:
    """log2 of the number of buckets for so many rows."""
    return max(LEAST_BUCKETS, -(-rows // ROWS_PER_BUCKET) - 1).bit_length()


def running_total(df: DataFrame, group: str, order: list[str], value: Column, name: str, rows: int) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same group that come before, in the order of ``order``.

    ``order[0]`` must be an ``order_number``; the others break its ties, and rows equal in all of them may be placed
    either way. Null groups are a group. Two shuffles: counted buckets, and the rows by (group, bucket).
    """
    # Null groups have a name of their own, so that the join and the window deal the rows out by the same plain keys.
    named = {"__group": F.coalesce(F.col(group).cast("string"), F.lit("")), "__none": F.col(group).isNull()}
    bucketed = df.withColumns(named).withColumn("__bucket", F.shiftright(F.col(order[0]), ORDER_BITS - bucket_bits(rows))).withColumn("__value", value)
    keys = ["__group", "__none", "__bucket"]
    totals = bucketed.groupBy(*keys).agg(F.sum("__value").alias("__sum"))
    upto = Window.partitionBy("__group", "__none").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.join(offsets, keys, "left")
    placed = placed.withColumn(name, F.col("__offset") + F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return placed.drop(*keys, "__value", "__offset")
