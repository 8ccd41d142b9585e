"""Queries on training feeds and seeded generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.operators import feed as E
from pagelake.operators import ordered as O
from pagelake.plans import fixtures as fx
from pagelake.plans.registry import query


@query("mix_datasets", ("samples",), """
  WITH r(dataset, ratio, place) AS (VALUES ('src0', 3, 0), ('src1', 1, 1), ('src2', 2, 2)),
  n AS (SELECT s.dataset, sample_id, ratio, row_number() OVER (PARTITION BY s.dataset ORDER BY sample_id) - 1 AS n, count(*) OVER (PARTITION BY s.dataset) AS size
        FROM samples s JOIN r ON r.dataset = s.dataset),
  o AS (SELECT dataset, coalesce(sum(ratio) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, 6 AS width FROM r),
  t AS (SELECT n.*, off, width, (SELECT max(CAST(ceil(CAST(size AS DOUBLE) / ratio) AS BIGINT)) FROM n) AS cycles FROM n JOIN o ON o.dataset = n.dataset),
  e AS (SELECT *, unnest(range(0, (cycles * ratio - 1 - n) // size + 1)) AS turn FROM t WHERE n < cycles * ratio)
  SELECT dataset, sample_id, (n + turn * size) // ratio AS cycle, CAST(off + (n + turn * size) % ratio AS BIGINT) AS slot,
         CAST((n + turn * size) // ratio * width + off + (n + turn * size) % ratio AS BIGINT) AS position FROM e""")
def mix_datasets(spark, sf_dir):
    rows = fx.samples(spark, sf_dir).select("dataset", "sample_id")
    out = E.mix_datasets(rows, {"src0": 3, "src1": 1, "src2": 2}, ["sample_id"])
    return out.select("dataset", "sample_id", "cycle", "slot", "position")


@query("mix_datasets_whole", ("samples",), """
  WITH r AS (SELECT dataset, row_number() OVER (ORDER BY dataset) - 1 AS place, (row_number() OVER (ORDER BY dataset) - 1) % 3 + 1 AS ratio FROM (SELECT DISTINCT dataset FROM samples)),
  n AS (SELECT s.dataset, sample_id, ratio, row_number() OVER (PARTITION BY s.dataset ORDER BY sample_id) - 1 AS n, count(*) OVER (PARTITION BY s.dataset) AS size
        FROM samples s JOIN r ON r.dataset = s.dataset),
  o AS (SELECT dataset, coalesce(sum(ratio) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, sum(ratio) OVER () AS width FROM r),
  t AS (SELECT n.*, off, width, (SELECT max(CAST(ceil(CAST(size AS DOUBLE) / ratio) AS BIGINT)) FROM n) AS cycles FROM n JOIN o ON o.dataset = n.dataset),
  e AS (SELECT *, unnest(range(0, CAST((cycles * ratio - 1 - n) // size + 1 AS BIGINT))) AS turn FROM t WHERE n < cycles * ratio)
  SELECT dataset, sample_id, CAST((n + turn * size) // ratio AS BIGINT) AS cycle, CAST(off + (n + turn * size) % ratio AS BIGINT) AS slot,
         CAST((n + turn * size) // ratio * width + off + (n + turn * size) % ratio AS BIGINT) AS position FROM e""")
def mix_datasets_whole(spark, sf_dir):
    """All datasets, with ratios 1, 2, 3, 1, ... in the order of their names."""
    rows = fx.samples(spark, sf_dir).select("dataset", "sample_id")
    names = sorted(r.dataset for r in fx.table(spark, sf_dir, "documents").select(F.col("source").alias("dataset")).distinct().collect())
    out = E.mix_datasets(rows, {name: place % 3 + 1 for place, name in enumerate(names)}, ["sample_id"])
    return out.select("dataset", "sample_id", "cycle", "slot", "position")


@query("batch_ids", ("samples",), """
  SELECT dataset, sample_id, (row_number() OVER (ORDER BY (doc_id * 7919) % 100003, doc_id) - 1) // 64 AS batch_id FROM samples""")
def batch_ids(spark, sf_dir):
    rows = fx.samples(spark, sf_dir).select("dataset", "sample_id", "doc_id")
    return O.batch_ids(rows, ["doc_id"], 64, key=F.col("doc_id") * 7919 % 100003).select("dataset", "sample_id", "batch_id")


@query("shuffle_rows", ("samples",), "SELECT doc_id, dataset FROM samples ORDER BY (doc_id * 7919) % 100003, doc_id")
def shuffle_rows(spark, sf_dir):
    rows = fx.samples(spark, sf_dir).select("doc_id", "dataset")
    return O.shuffle_rows(rows, ["doc_id"], key=F.col("doc_id") * 7919 % 100003)


@query("shuffle_rows_hashed")
def shuffle_rows_hashed(spark, sf_dir):
    return O.shuffle_rows(fx.samples(spark, sf_dir).select("doc_id", "dataset"), ["doc_id"], seed=5)


@query("sample_text")
def sample_text(spark, sf_dir):
    """As many random texts as there are documents, out of the lines of all of them."""
    docs = fx.table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return E.sample_text(spark, lines, docs.count(), ["doc_id", "pos"], seed=3)


@query("sample_numbers")
def sample_numbers(spark, sf_dir):
    """One number per label row."""
    return E.sample_numbers(spark, fx.table(spark, sf_dir, "labels").count(), 0, 1000, 0.5, 2, seed=9)
