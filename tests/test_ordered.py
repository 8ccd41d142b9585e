"""Sliced operators give what one plain window gives, whatever the split points."""

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagelake.operators import ordered as O


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    # One group holds most of the rows.
    data = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randint(-50, 50)) for i in range(600)]
    data += [(None, 600 + i, i) for i in range(5)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "g string, k int, v int").repartition(5).cache()


def points(table, by):
    found = O.split_points(table, [*by, "k"], rows_per_slice=40)
    assert len(found) > 5
    return found


@pytest.mark.parametrize("by", [["g"], []])
def test_number_rows(table, by):
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("k")
    want = table.withColumn("n", F.row_number().over(w).cast("long"))
    assert rows(O.number_rows(table, ["k"], by, "n", points=points(table, by))) == rows(want)


def test_small_tables_need_no_slices(table):
    assert O.split_points(table, ["g", "k"]) == []


@pytest.mark.parametrize("exclusive", [False, True])
def test_running(table, exclusive):
    last = -1 if exclusive else Window.currentRow
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, last)
    want = table.select(
        "*", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"), F.count("v").over(w).alias("c"), F.min("v").over(w).alias("l")
    )
    aggs = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "c": ("count", F.col("v")), "l": ("min", F.col("v"))}
    got = O.running(table, ["k"], aggs, ["g"], exclusive, points=points(table, ["g"]))
    zero = lambda rs: [tuple(0 if v is None and i in (3, 5) else v for i, v in enumerate(r)) for r in rs]
    assert zero(rows(got, "k")) == zero(rows(want, "k"))


def test_sliding(table):
    w = Window.partitionBy("g").orderBy("k")
    exprs = {
        "p": lambda win: F.percentile("v", F.lit(0.5)).over(win.rowsBetween(-6, 0)),
        "a": lambda win: F.sum("v").over(win.rowsBetween(0, 4)),
        "nx": lambda win: F.lead("k").over(win),
    }
    want = table.withColumns({n: make(w) for n, make in exprs.items()})
    got = O.sliding(table, ["k"], exprs, ["g"], before=6, after=4, points=points(table, ["g"]), block=10)
    assert rows(got, "k") == rows(want, "k")


def test_batches_have_equal_size(table):
    out = O.batch_ids(table, ["k"], 50, seed=3, points=None)
    sizes = sorted(r["count"] for r in out.groupBy("batch_id").count().collect())
    assert sizes[1:] == [50] * (len(sizes) - 1) and sum(sizes) == 605


def test_partitioning_does_not_matter(table):
    a = O.number_rows(table.repartition(1), ["k"], ["g"], "n", points=points(table, ["g"]))
    b = O.number_rows(table.repartition(9), ["k"], ["g"], "n", points=points(table, ["g"])[::3])
    assert rows(a, "k") == rows(b, "k")


def test_small_groups_need_no_slices(spark, monkeypatch):
    """A table above the limit with small groups: plain windows, one reading of the table and no join."""
    monkeypatch.setattr(O, "ROWS_PER_SLICE", 100)
    pages = spark.range(1000).select((F.col("id") % 90).alias("g"), ((F.col("id") * 37) % 1000).alias("k"))
    pages = pages.unionByName(spark.range(20).select(F.lit(None).cast("long").alias("g"), F.col("id").alias("k")))
    assert O.split_points(pages, ["g", "k"], by=["g"]) == [] and O.split_points(pages, ["k"])
    out = O.number_rows(pages, ["k"], ["g"])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    plain = pages.withColumn("row_num", F.row_number().over(Window.partitionBy("g").orderBy("k")).cast("long"))
    assert rows(out) == rows(plain)
    # A group above the limit keeps its slices, null or not.
    hot = pages.withColumn("g", F.when(F.col("k") % 10 == 0, F.col("g")))
    assert O.largest_group(hot, ["g"]) > 100 and O.split_points(hot, ["g", "k"], by=["g"])
    numbers = O.number_rows(hot.dropDuplicates(["g", "k"]), ["k"], ["g"])
    whole = hot.dropDuplicates(["g", "k"]).withColumn("row_num", F.row_number().over(Window.partitionBy("g").orderBy("k")).cast("long"))
    assert rows(numbers) == rows(whole)


def test_detections_are_numbered_without_slices(spark, tmp_path, monkeypatch):
    """Lines of many small orders: neither side of the scoring is read more than once for its numbers."""
    from pagelake.plans import fixtures as fx

    lines = spark.range(900).selectExpr(
        "id div 4 AS l_orderkey", "id % 30 AS l_partkey", "id % 7 AS l_suppkey", "cast(id % 4 + 1 as int) AS l_linenumber", "cast(id % 50 as double) AS l_quantity",
        "cast(id as double) AS l_extendedprice", "0.1D AS l_discount", "0.1D AS l_tax", "date'1995-01-01' AS l_shipdate", "'A' AS l_returnflag", "'F' AS l_linestatus")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(30).selectExpr("id AS p_partkey", "concat('brand', id % 3) AS p_brand", "concat('part ', id) AS p_name").write.parquet(str(tmp_path / "part.parquet"))
    whole = [rows(df) for df in fx.scoring_sides(spark, str(tmp_path))]
    for module in (O, fx):
        monkeypatch.setattr(module, "ROWS_PER_SLICE", 100)
    sides = fx.scoring_sides(spark, str(tmp_path))
    assert [rows(df) for df in sides] == whole and len(whole[1]) > 800
    assert sides[1]._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
