"""The sample store: Parquet partitioned by dataset, instead of a keyed file store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators.feed import key_samples

ROWS_PER_FILE = 1_000_000


def write_samples(df: DataFrame, path: str, order_by: Sequence[str], mode: str = "overwrite", points=None) -> None:
    """Number the samples of each dataset and write them under ``dataset=``.

    The rebalance hint lets Spark cut a very large dataset into several tasks and merge small ones.
    """
    keyed = key_samples(df, order_by, points=points).hint("rebalance", "dataset")
    keyed.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("dataset").parquet(path)


def read_samples(spark: SparkSession, root: str, selected: Sequence[str] | None = None) -> DataFrame:
    """Samples of the selected datasets; only their folders are read. An unreadable file is an error, whatever the session's settings."""
    rows = spark.read.option("ignoreCorruptFiles", False).option("ignoreMissingFiles", False).parquet(root)
    return rows if selected is None else rows.where(F.col("dataset").isin(*selected))
