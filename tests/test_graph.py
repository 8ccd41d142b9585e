"""Connected components and written tables."""

import time

from conftest import rows
from pyspark.sql import functions as F

from pagelake.operators.graph import connected_components
from pagelake.session import materialise


def test_edges_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    data = [(1, 2), (3, 2), (2, 3), (5, 5), (7, 6), (6, 7), (7, 6), (None, 8), (9, None)]
    edges = spark.createDataFrame(data, "a long, b long").coalesce(1).mapInArrow(counted, "a long, b long")
    assert rows(connected_components(edges)) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 6), (7, 6)]
    assert seen.value == len(data)


def test_shuffle_files_go_with_the_write(spark):
    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(i).getName() for i in range(held.size()) if held.apply(i).getName().startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(name)
    written = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(name) == setting
    assert written.count() == 7
