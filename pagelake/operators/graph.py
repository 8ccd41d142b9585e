"""Connected components of edge tables of any shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.session import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): every node of an edge and the least node it is connected with.

    Every round ties each node's larger neighbours to its least neighbour, and then each node and its smaller neighbours to
    the least of them, until nothing changes. Stars form in about log2(n) rounds on paths, combs and trees alike; there is no
    limit on rounds. Each round is written to the shared checkpoint folder, so lineage stays short. Minima are combined
    before the shuffle and a hub is met by a join, which adaptive execution can split. Loops, repeated and reversed edges
    change nothing; edges with a null end are left out.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    # Written with its loops, so that the edges are worked out once for the rounds and for the list of nodes.
    links = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    stars = links.where("u <> v")
    seen = _digest(stars)
    while seen[0]:
        stars = materialise(_small_star(_large_star(stars)), "stars")
        now = _digest(stars)
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _digest(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0))).first())


def _large_star(stars: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the least of the node and its neighbours. Here u > v in every row."""
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    # Row (u, v) with u > v: for its smaller end v, u is a larger neighbour; v's least neighbour, or v itself, is m.
    return stars.join(least.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the least of these."""
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    tied = stars.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
