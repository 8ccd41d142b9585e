"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A key waits for every shard a time that is exponential with the shard's weight as its rate, and goes where it waits least. These times
are never drawn shard by shard; they are drawn from the top down. The least of a subtree is exponential with the subtree's whole weight, so
a full region draws one time, one more hash names the rack that it belongs to, and one more that rack's shard: regions + 2 hashes a row.
Waiting has no memory, so a sibling of the named child waits for its parent's time and a draw of its own on top. That is
needed only in a subtree with missing or light shards: a shard below the ceiling keeps its time with the chance weight / ceiling, and
waits on by its weight otherwise.

A shard's time depends on its own weight alone and falls as the weight grows. So rows move only into a shard that was added or made
heavier, and only out of one that was removed or made lighter; whatever does not contain it stays as it is.
Everything is Column expressions; the assignment needs no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.places import order_number, running_total

SHARDS_PER_RACK = 4
RACKS_PER_REGION = 3
_SLOT_SEED = 7


def _unit(key: Column, what: str, node: Column) -> Column:
    """A hashed number above 0 and up to 1, for a key and a node of the tree."""
    named = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(what), node.cast("string"))
    return (F.shiftrightunsigned(F.xxhash64(named), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _first(key: Column, what: str, parent: Column, fanout: int) -> Column:
    """The child that its parent's time belongs to; children of one level can hold the same weight, so each has the same chance."""
    return parent * fanout + F.least(F.floor(_unit(key, f"first {what}", parent) * fanout), F.lit(fanout - 1)).cast("int")


class _Tree:
    """Times of nodes as Columns. Nodes of a level are numbered through: the children of node i are i * fanout and those after it."""

    def __init__(self, key: Column, weights: list[float], ceiling: float) -> None:
        per_region = SHARDS_PER_RACK * RACKS_PER_REGION
        self.regions = -(-len(weights) // per_region)
        filled = [max(w, 0.0) / ceiling for w in weights] + [0.0] * (self.regions * per_region - len(weights))
        whole = lambda size: [min(filled[i : i + size]) >= 1 for i in range(0, len(filled), size)]
        self.key, self.ceiling = key, ceiling
        self.filled, self.whole_racks, self.whole_regions = (F.lit(x) for x in (filled, whole(SHARDS_PER_RACK), whole(per_region)))

    def _wait(self, what: str, node: Column, rate: Column | float) -> Column:
        return -F.log(_unit(self.key, what, node)) / rate

    def _after(self, what: str, node: Column, parent: Column, fanout: int, time: Column, rate: float) -> Column:
        return F.when(node == _first(self.key, what, parent, fanout), time).otherwise(time + self._wait(what, node, rate))

    def _full_region(self, region: Column) -> Column:
        return self._wait("region", region, self.ceiling * SHARDS_PER_RACK * RACKS_PER_REGION)

    def _full_rack(self, rack: Column, region: Column) -> Column:
        return self._after("rack", rack, region, RACKS_PER_REGION, self._full_region(region), self.ceiling * SHARDS_PER_RACK)

    def _shard_time(self, shard: Column, rack: Column, region: Column) -> Column:
        time = self._after("shard", shard, rack, SHARDS_PER_RACK, self._full_rack(rack, region), self.ceiling)
        share = F.get(self.filled, shard)
        later = F.when(share > 0, time + self._wait("later", shard, share * self.ceiling)).otherwise(F.lit(float("inf")))
        return F.when((share >= 1) | (_unit(self.key, "mark", shard) < share), time).otherwise(later)

    def _rack_time(self, rack: Column, region: Column) -> Column:
        shards = F.transform(_children(rack, SHARDS_PER_RACK), lambda s: self._shard_time(s, rack, region))
        return F.when(F.get(self.whole_racks, rack), self._full_rack(rack, region)).otherwise(F.array_min(shards))

    def _region_time(self, region: Column) -> Column:
        racks = F.transform(_children(region, RACKS_PER_REGION), lambda k: self._rack_time(k, region))
        return F.when(F.get(self.whole_regions, region), self._full_region(region)).otherwise(F.array_min(racks))

    def region(self) -> Column:
        return _earliest(F.sequence(F.lit(0), F.lit(self.regions - 1)), self._region_time)

    def rack(self, region: Column) -> Column:
        drawn = _earliest(_children(region, RACKS_PER_REGION), lambda k: self._rack_time(k, region))
        return F.when(F.get(self.whole_regions, region), _first(self.key, "rack", region, RACKS_PER_REGION)).otherwise(drawn)

    def shard(self, rack: Column, region: Column) -> Column:
        drawn = _earliest(_children(rack, SHARDS_PER_RACK), lambda s: self._shard_time(s, rack, region))
        return F.when(F.get(self.whole_racks, rack), _first(self.key, "shard", rack, SHARDS_PER_RACK)).otherwise(drawn)


def _children(node: Column, fanout: int) -> Column:
    return F.sequence(node * fanout, node * fanout + (fanout - 1))


def _earliest(nodes: Column, time: Callable[[Column], Column]) -> Column:
    return F.array_min(F.transform(nodes, lambda i: F.struct(time(i).alias("time"), i.alias("node"))))["node"]


def assign(
    docs: DataFrame, key_col: str, n_shards: int, weights: list[float] | None = None, names: tuple[str, str, str] = ("region", "rack", "shard"),
    ceiling: float | None = None,
) -> DataFrame:
    """Add region, rack (within the region) and shard, named by ``names``, to every row; input columns of those names are replaced.

    Law ``key``: the key, the number of shards and the weights decide alone, so equal keys, repeated rows among them,
    share a shard; null keys do, too. ``ceiling`` is the weight that any shard may come to hold; another ceiling moves rows everywhere. It is the
    least power of two that no weight passes, if it isn't given. All weights zero is an error, and so is a weight above the ceiling.
    Columns whose names begin with two underscores may be replaced or dropped.
    """
    weights = [1.0] * n_shards if weights is None else list(weights)
    if len(weights) != n_shards or n_shards < 1 or not any(w > 0 for w in weights):
        raise ValueError("one weight for each shard, and one above zero, are needed")
    ceiling = 2.0 ** math.ceil(math.log2(max(weights))) if ceiling is None else ceiling
    if max(weights) > ceiling:
        raise ValueError("a weight is above the ceiling")
    own = _Tree(F.col("__key"), weights, ceiling)
    df = docs.withColumn("__key", F.col(key_col)).drop(*(n for n in names if n != key_col))
    df = df.withColumn("__region", own.region())
    df = df.withColumn("__rack", own.rack(F.col("__region")))
    df = df.withColumn("__shard", own.shard(F.col("__rack"), F.col("__region")))
    region, rack, shard = names
    df = df.withColumns({region: F.col("__region"), rack: F.col("__rack") % RACKS_PER_REGION, shard: F.col("__shard")})
    return df.drop("__key", "__region", "__rack", "__shard")


def with_slots(sharded: DataFrame, key_col: str, tie_cols: list[str], rows: int, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Add a gapless number within the shard, from 0, in a hashed order of the keys and ties.

    A shard is never sorted as a whole (see ``places``). Rows of one key are dealt out by ``tie_cols``, too, so a key that many rows
    share fills no bucket; rows equal there, too, may be placed either way. ``rows`` sets only the number of buckets, not the result.
    """
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (key_col, *tie_cols)))
    tied = sharded.drop(slot_col).withColumn("__order", order_number(named, _SLOT_SEED))
    return running_total(tied, shard_col, ["__order", key_col, *tie_cols], F.lit(1).cast("long"), slot_col, rows).drop("__order")


def shard_documents(docs: DataFrame, n_shards: int, rows: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with size, text_crc32, law, region, rack, shard, slot and grown_shard (one shard more).

    Input columns of those names are replaced. Size is the text's UTF-8 bytes plus 8; a null text is sized and summed up
    like an empty one.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sized = docs.withColumns({"size": F.octet_length(body).cast("long") + 8, "text_crc32": F.crc32(body), "law": F.lit("key")})
    grown = assign(sized, key_col, n_shards + 1, names=("__r", "__k", "grown_shard")).drop("__r", "__k")
    return with_slots(assign(grown, key_col, n_shards), key_col, ["text_crc32", "size"], rows)
