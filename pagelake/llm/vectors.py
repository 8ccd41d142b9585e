"""Near-duplicate vectors of one label by sorted projection passes.

In each pass vectors get a number of concatenated random hashes, the signs of random projections, and are sorted by it; every vector
is compared with the ``WINDOW`` that follow, and pairs of enough cosine are united over all passes. A pass is one range shuffle: inside
a partition rows are compared as a stream, and the first and last rows of the partitions meet in a second, small step. How many passes
there are follows from the number of vectors and the wanted recall; equal vectors are one vector with a multiplicity.

A pass gives out a forest of each block, not its pairs, so a large group costs a row a vector. All linked pairs lie in one component,
so links are counted there afterwards, in full: small components as a whole; in large ones the vectors within half the angle of the
mean are all linked with each other by the triangle inequality and need no comparison, and the others meet the rest tile by tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.operators.graph import connected_components
from pagelake.session import materialise

COSINE = 0.93
WINDOW = 64
RECALL = 0.995
HASH_BITS = 32
SEED = 20
_PASSES_AT_ONCE = 8
_ROWS_PER_PARTITION = 100_000
_BLOCK = 8192
_TILE = 1024
_STEP = 256


def passes_for(rows: int, window: int = WINDOW, cosine: float = COSINE, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has met with probability ``recall``.

    Two vectors meet in a pass if they share about log2(rows / window) + 1 bits; each bit is equal with probability 1 - angle / pi.
    """
    bits = max(0.0, math.log2(max(rows, 1) / window)) + 1
    met = (1 - math.acos(cosine) / math.pi) ** bits
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Unit vectors of equal length as doubles; scaled first, so that no square overflows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _pieces(keys: list[pa.Array]) -> list[int]:
    """Where stretches of rows with equal keys begin, and the end."""
    n = len(keys[0])
    new = np.zeros(n + 1, bool)
    new[[0, n]] = True
    for key in keys:
        values = key.to_numpy(zero_copy_only=False)
        new[1:n] |= values[1:] != values[:-1]
    return np.flatnonzero(new).tolist()


def signed(classes: DataFrame, passes: int, seed: int = SEED) -> DataFrame:
    """Adds ``signs``: for every pass the signs of ``HASH_BITS`` random projections as one number."""
    kind = classes.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(HASH_BITS, dtype=np.int64)[::-1]
        for batch in batches:
            sizes = batch["vec"].value_lengths().to_numpy()
            order = np.argsort(sizes, kind="stable")
            batch, sizes = batch.take(pa.array(order)), sizes[order]
            edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                part, size = batch.slice(a, b - a), int(sizes[a])
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, passes * HASH_BITS))
                signs = (_matrix(part["vec"]) @ planes[size] > 0).reshape(b - a, passes, HASH_BITS) @ weights
                offsets = pa.array(np.arange(b - a + 1, dtype=np.int32) * passes)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(signs.ravel()))], [*part.schema.names, "signs"])

    return classes.mapInArrow(run, f"node long, grp string, vec {kind}, signs array<long>")


def _forest(rows: np.ndarray, new: int, window: int, cosine: float) -> np.ndarray:
    """For each row the least row it is connected with; rows from ``new`` on are compared with the ``window`` before them."""
    n, near = len(rows), []
    for a in range(0, n, _STEP):
        b = min(n, a + _STEP)
        last = min(n, b + window)
        if last <= new:
            continue
        i, j = np.nonzero(rows[a:b] @ rows[a:last].T >= cosine)
        i, j = i + a, j + a
        fits = (j > i) & (j - i <= window) & (j >= new)
        near.append((i[fits], j[fits]))
    roots = np.arange(n)
    if not near:
        return roots
    i, j = (np.concatenate(x) for x in zip(*near))
    while True:
        least = np.minimum(roots[i], roots[j])
        before = roots.copy()
        np.minimum.at(roots, i, least)
        np.minimum.at(roots, j, least)
        np.minimum.at(roots, before, roots)
        roots = roots[roots]
        if (roots == before).all():
            return roots


def _linked(nodes: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = np.flatnonzero(roots != np.arange(len(roots)))
    return nodes[own], nodes[roots[own]]


def compared(sorted_rows: DataFrame, window: int, cosine: float) -> DataFrame:
    """Links (a, b) inside each partition, the first and last ``window`` rows of partitions, and their numbers of rows.

    ``sorted_rows``: (turn, grp, node, vec), dealt by range and sorted.
    """
    kind = sorted_rows.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seen = TaskContext.get().partitionId(), 0
        held: pa.Table | None = None  # rows of one turn and group
        fresh = 0  # how many of them have been compared already
        last: list[pa.RecordBatch] = []
        schema = None

        def out(what: str, n: int, a=None, b=None, pos=None, rows: pa.RecordBatch | None = None) -> pa.RecordBatch:
            empty = lambda t: pa.nulls(n, t)
            edge = [empty(pa.int32()), empty(pa.string()), empty(schema.field("vec").type)] if rows is None else [rows["turn"], rows["grp"], rows["vec"]]
            return pa.RecordBatch.from_arrays(
                [pa.array([what] * n, pa.string()), empty(pa.int64()) if a is None else pa.array(a, pa.int64()), empty(pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array([pid] * n, pa.int32()), empty(pa.int64()) if pos is None else pa.array(pos, pa.int64()), *edge],
                ["what", "a", "b", "pid", "pos", "turn", "grp", "vec"],
            )

        def links() -> pa.RecordBatch:
            nodes = held["node"].to_numpy()
            a, b = _linked(nodes, _forest(_matrix(held["vec"].combine_chunks()), fresh, window, cosine))
            return out("link", len(a), a, b)

        for batch in batches:
            schema = batch.schema
            if seen < window and batch.num_rows:
                head = batch.slice(0, window - seen)
                yield out("head", head.num_rows, head["node"].to_numpy(), pos=np.arange(seen, seen + head.num_rows), rows=head)
            seen += batch.num_rows
            last.append(batch.slice(max(0, batch.num_rows - window)))
            while sum(x.num_rows for x in last[1:]) >= window:
                last.pop(0)
            edges = _pieces([batch["turn"], batch["grp"]]) if batch.num_rows else []
            for x, y in zip(edges[:-1], edges[1:]):
                piece = pa.Table.from_batches([batch.slice(x, y - x)])
                if held is not None and (held["turn"][0], held["grp"][0]) != (piece["turn"][0], piece["grp"][0]):
                    yield links()
                    held, fresh = None, 0
                held = piece if held is None else pa.concat_tables([held, piece])
                if held.num_rows >= _BLOCK:
                    yield links()
                    held = held.slice(held.num_rows - window)
                    fresh = held.num_rows
        if held is not None:
            yield links()
            tail = pa.Table.from_batches(last).combine_chunks()
            tail = tail.slice(max(0, tail.num_rows - window)).to_batches()[0]
            yield out("tail", tail.num_rows, tail["node"].to_numpy(), pos=np.arange(seen - tail.num_rows, seen), rows=tail)
            yield out("size", 1, pos=[seen])

    return sorted_rows.mapInArrow(run, f"what string, a long, b long, pid int, pos long, turn int, grp string, vec {kind}")


def _across(found: DataFrame, window: int, cosine: float) -> DataFrame | None:
    """Links (a, b) between the last rows of a partition and the first rows of those that follow."""
    spark = found.sparkSession
    sizes = {r.pid: r.pos for r in found.where("what = 'size'").select("pid", "pos").collect()}  # a number for each partition
    order, meets = sorted(sizes), []
    for k, pid in enumerate(order):
        between = 0
        for other in order[k + 1 :]:
            meets.append((pid, other))
            between += sizes[other]
            if between >= window:
                break
    if not meets:
        return None
    pairs = spark.createDataFrame(meets, "border int, pid int")
    heads = found.where("what = 'head'").join(F.broadcast(pairs), "pid").select("border", F.lit(1).alias("side"), "pid", "pos", "turn", "grp", F.col("a").alias("node"), "vec")
    tails = found.where("what = 'tail'").select(F.col("pid").alias("border"), F.lit(0).alias("side"), "pid", "pos", "turn", "grp", F.col("a").alias("node"), "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["border"]):
            edges = _pieces([group["turn"].combine_chunks(), group["grp"].combine_chunks()])
            for x, y in zip(edges[:-1], edges[1:]):
                piece = group.slice(x, y - x)
                old = int((piece["side"].to_numpy() == 0).sum())
                if 0 < old < y - x:
                    a, b = _linked(piece["node"].to_numpy(), _forest(_matrix(piece["vec"].combine_chunks()), old, window, cosine))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return tails.unionByName(heads).repartition("border").sortWithinPartitions("border", "side", "pid", "pos").mapInArrow(run, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Stretches of rows with equal keys, put together over the edges of batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = _pieces([batch[k] for k in keys])
        for x, y in zip(edges[:-1], edges[1:]):
            if held and any(held[-1][k][0] != batch[k][x] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _counted(members: DataFrame, cosine: float) -> DataFrame:
    """Rows (node, links): for every class the vectors linked with it, itself included.

    ``members``: (root, node, vec, times) of components with two classes or more.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("members")).withColumn("tiles", F.ceil(F.col("members") / F.lit(_TILE)).cast("int"))
    dealt = materialise(members.join(sizes, "root"), "members")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["root"]):
            rows = _matrix(group["vec"].combine_chunks())
            links = (rows @ rows.T >= cosine) @ group["times"].to_numpy()
            yield pa.RecordBatch.from_arrays([group["node"].combine_chunks(), pa.array(links, pa.int64())], ["node", "links"])

    small = dealt.where("tiles = 1").select("root", "node", "vec", "times").repartition("root").sortWithinPartitions("root")
    counted = small.mapInArrow(whole, "node long, links long")
    large = dealt.where("tiles > 1").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    if large.isEmpty():
        return counted

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["root", "salt"]):
            yield pa.RecordBatch.from_arrays([group["root"].slice(0, 1).combine_chunks(), pa.array([_matrix(group["vec"].combine_chunks()).sum(axis=0).tolist()], pa.list_(pa.float64()))], ["root", "total"])

    parts = large.select("root", "salt", "vec").repartition("root", "salt").sortWithinPartitions("root", "salt").mapInArrow(sums, "root long, total array<double>")
    total = parts.select("root", F.posexplode("total")).groupBy("root", "pos").agg(F.sum("col").alias("x"))
    means = total.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).x.alias("mean"))
    means = sizes.join(means, "root").select("root", "mean", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("salt"))
    half = math.acos(cosine) / 2 - 1e-9

    def sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = _pieces([batch["root"]]) if batch.num_rows else []
            for x, y in zip(edges[:-1], edges[1:]):
                part = batch.slice(x, y - x)
                mean = np.array(part["mean"][0].as_py())
                length = np.sqrt((mean * mean).sum())
                with np.errstate(invalid="ignore", divide="ignore"):
                    core = np.arccos(np.clip(_matrix(part["vec"]) @ (mean / length), -1, 1)) <= half
                yield pa.RecordBatch.from_arrays([part["root"], part["node"], part["vec"], part["times"], pa.array(core)], ["root", "node", "vec", "times", "core"])

    kind = members.schema["vec"].dataType.simpleString()
    placed = large.join(means, ["root", "salt"]).select("root", "node", "vec", "times", "mean").mapInArrow(sided, f"root long, node long, vec {kind}, times long, core boolean")
    placed = materialise(placed, "placed")
    about = placed.groupBy("root").agg(
        F.sum(F.when(F.col("core"), F.col("times")).otherwise(0)).alias("core_times"), F.sum(F.col("core").cast("long")).alias("cores"), F.sum((~F.col("core")).cast("long")).alias("others"),
    ).withColumns({"core_tiles": F.ceil(F.col("cores") / F.lit(_TILE)).cast("int"), "other_tiles": F.ceil(F.col("others") / F.lit(_TILE)).cast("int")})
    known = placed.join(about, "root")
    inside = known.select("node", F.when(F.col("core"), F.col("core_times")).otherwise(F.lit(0)).cast("long").alias("links"))
    open_ones = known.where("others > 0").withColumn("tile", F.pmod(F.xxhash64("node"), F.when(F.col("core"), F.col("core_tiles")).otherwise(F.col("other_tiles"))).cast("int"))
    # A block is a tile of others and any tile: of core members, or of others from its own on.
    each = F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)).alias("meets")
    shape = ["root", "node", "vec", "times"]
    cores = open_ones.where("core").select(*shape, "tile", each).select(*shape, F.col("meets").alias("left"), F.col("tile").alias("right"), F.lit("core").alias("side"), F.lit("core").alias("kind"))
    rest = open_ones.where("NOT core")
    with_cores = rest.where("core_tiles > 0").select(*shape, "tile", F.explode(F.sequence(F.lit(0), F.col("core_tiles") - 1)).alias("meets")).select(
        *shape, F.col("tile").alias("left"), F.col("meets").alias("right"), F.lit("other").alias("side"), F.lit("core").alias("kind"))
    among = rest.select(*shape, "tile", each).select(
        *shape, F.least("tile", "meets").alias("left"), F.greatest("tile", "meets").alias("right"), F.when(F.col("tile") <= F.col("meets"), "left").otherwise("right").alias("side"), F.lit("other").alias("kind"))
    blocks = cores.unionByName(with_cores).unionByName(among).withColumn("block", F.xxhash64("root", "kind", "left", "right"))

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["root", "kind", "left", "right"]):
            rows, times, nodes = _matrix(group["vec"].combine_chunks()), group["times"].to_numpy(), group["node"].to_numpy()
            sides = group["side"].to_numpy()
            own = group["kind"][0].as_py() == "other" and group["left"][0] == group["right"][0]
            first = np.ones(len(rows), bool) if own else sides == sides[0]
            met = rows[first] @ rows[first if own else ~first].T >= cosine
            found = [(nodes[first], met @ times[first if own else ~first])]
            if not own:
                found.append((nodes[~first], met.T @ times[first]))
            for a, n in found:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n, pa.int64())], ["node", "links"])

    keys = ["block", "root", "kind", "left", "right"]
    met = blocks.repartition("block").sortWithinPartitions(*keys).mapInArrow(tiled, "node long, links long")
    return counted.unionByName(inside.unionByName(met).groupBy("node").agg(F.sum("links").alias("links")))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, window: int = WINDOW, passes: int | None = None, seed: int = SEED,
) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for each vector.

    Vectors are linked if their labels are equal and not null, they are equally long, and their cosine in double precision is at
    least ``cosine``. ``n_links`` counts the other rows linked directly; ``component_id`` is the least id reachable by links, the own
    one included; ``kept`` marks the row whose id it is. Vectors that are null, empty or zero, or hold a null or a number that is not
    finite, have no links. Repeated rows are rows of their own, linked with each other. Null ids are passed over in the least; a component of null ids
    alone has a null one, and its rows are kept. Vectors are named by a 64-bit hash. Other columns are not read. ``passes`` defaults to
    ``passes_for`` of the number of different vectors.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "double" if element not in ("float", "double") else element
    # Adding zero makes -0.0 and 0.0 one.
    vec = F.transform(F.col(vector_col).cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast(kind))) & F.exists("vec", lambda x: x != 0)
    grp = F.when(F.col("label").isNotNull() & F.col("vec").isNotNull() & fine, F.concat_ws(":", "label", F.size("vec").cast("string")))
    rows = rows.withColumn("grp", grp).withColumn("node", F.when(F.col("grp").isNotNull(), F.xxhash64("grp", "vec")))
    usable = rows.where("node IS NOT NULL")
    classes = materialise(usable.groupBy("node").agg(F.first("grp").alias("grp"), F.first("vec").alias("vec"), F.count("*").alias("times"), F.min("id").alias("least")), "classes")
    count = classes.count()
    passes = passes or passes_for(count, window, cosine)
    hashed = materialise(signed(classes.select("node", "grp", "vec"), passes, seed), "signs")

    parts, links = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), count * min(passes, _PASSES_AT_ONCE) // _ROWS_PER_PARTITION), None
    for start in range(0, passes, _PASSES_AT_ONCE):
        some = hashed.select("node", "grp", "vec", F.posexplode(F.slice("signs", start + 1, _PASSES_AT_ONCE)).alias("turn", "sign"))
        keys = ["turn", "grp", "sign", "node"]
        dealt = some.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("turn", "grp", "node", "vec")
        found = materialise(compared(dealt, window, cosine), "compared")
        borders = _across(found, window, cosine)
        new = found.where("what = 'link'").select("a", "b")
        new = materialise((new if borders is None else new.unionByName(borders)).distinct(), "links")
        links = new if links is None else links.unionByName(new)

    connected = materialise(connected_components(links), "roots")
    members = connected.join(classes, "node").select("root", "node", "vec", "times")
    counted = _counted(members, cosine)
    least = connected.join(classes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    about = connected.join(least, "root").join(counted, "node").select("node", "component", "links")
    named = classes.select("node", "least", "times").join(about, "node", "left").select("node", F.when(F.col("links").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"), (F.coalesce("links", "times") - 1).alias("n_links"))
    whole = rows.select("id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return whole.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
