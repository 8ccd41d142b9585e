"""Set similarity join on word shingles by prefixes of tokens and of token combinations.

Tokens are the hashes of a document's shingles, in one global order from rare to frequent. A document of n tokens may miss
at most e = n - ceil(t n) of them in a partner, so two partners share a signature in their prefixes:

* rare tokens are signatures by themselves, each worth one miss;
* frequent tokens are dealt to small classes by their hash, and pairs of prefix tokens of one class are signatures; a class with
  p prefix tokens is worth p - 1 misses. The prefix is extended until it is worth e + 1. The number of classes depends on
  the size band of the smaller partner, so a document writes pairs for each band it can meet partners in.

Which tokens are frequent comes from counters over all documents, a table of fixed size whatever the input; they bound a
token's frequency from above, so a rare token's group has a bounded size. The counters steer the work alone: any values give
the same result. Signatures only propose; every link is verified on the whole sets.

Links are looked for in rounds. First each signature proposes a star around one member, then, for members that are not yet
connected, a star around another one, and then members in different components against each other, where a comparison of
bitmaps leaves few pairs. Of these a block of members proposes a forest only: pairs that would connect what is not yet connected. The next
round goes on with the signatures that held pairs back and still have members in different components, until there are none: what is
held back is either inside a component by then, or proposed. Pairs inside a component need no check, so copies by the thousand cost a few
checks each, and no component can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.phrases import bitmap
from pagelake.llm.text import LOWER, WordHasher, mix, rolling
from pagelake.operators.graph import connected_components
from pagelake.session import materialise

SHINGLE = 5
THRESHOLD = 80  # per cent
COUNTER_BITS = 22
PARITY_BITS = 1024
_PARTS = 64
_SEEN_BITS = 18  # a task's memory of the sets it has given out
_NODE_BITS = 27  # a bitmap of the nodes that are looked for
_LEAST_BAND = 5  # sets below 2^5 tokens take single tokens throughout
_TOKENS_PER_HUB = 2_000_000
_SALTS = 1024
_TILE = 2048


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's words; the whole sequence if it is shorter; none without words."""
    if not len(hashes):
        return hashes
    own = min(width, len(hashes))
    ranked = np.sort(rolling(hashes, own) + np.uint64(width - own))
    return ranked[np.concatenate(([True], ranked[1:] != ranked[:-1]))]


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets have one name."""
    total = mix(tokens + np.arange(len(tokens), dtype=np.uint64)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total ^ np.uint64(len(tokens))).view(np.int64)[0])


def parities(tokens: np.ndarray) -> np.ndarray:
    """``PARITY_BITS`` bits: whether a set has an odd number of the tokens that fall on a bit.

    Two sets differ by at least as many tokens as their parities differ by bits.
    """
    counts = np.bincount((tokens % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


class _Seen:
    """The last nodes of a task, one for each value of some bits: tells most repetitions, in fixed memory."""

    def __init__(self):
        self.nodes = np.zeros(1 << _SEEN_BITS, np.int64)

    def again(self, node: int) -> bool:
        place = node & ((1 << _SEEN_BITS) - 1)
        if self.nodes[place] == node:
            return True
        self.nodes[place] = node
        return False


def least_overlap(n: int, threshold: int) -> int:
    """The least number of own tokens that any partner must share."""
    return -(-n * threshold // 100)


def signatures(tokens: np.ndarray, counts: np.ndarray, limit: int, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set from its rare tokens, and from its frequent ones (those counted above ``limit``)."""
    n = len(tokens)
    misses = n - least_overlap(n, threshold) + 1
    rare = counts <= limit
    singles = tokens[rare]
    if len(singles) >= misses:
        order = np.lexsort((singles, counts[rare]))[:misses]
        return singles[order], np.empty(0, np.uint64)
    frequent = tokens[~rare]
    frequent = frequent[np.lexsort((frequent, counts[~rare]))]
    need, hot = misses - len(singles), []
    for band in range(least_overlap(n, threshold).bit_length() - 1, n.bit_length()):
        if band < _LEAST_BAND:
            hot.append(frequent[:need])
            continue
        classes = (mix(frequent) % np.uint64(1 << (band - 3))).astype(np.int64)
        first = np.zeros(len(frequent), bool)
        first[np.unique(classes, return_index=True)[1]] = True
        worth = np.cumsum(~first)
        prefix = int(np.searchsorted(worth, need)) + 1
        own, kind = frequent[:prefix], classes[:prefix]
        order = np.lexsort((own, kind))
        own, kind = own[order], kind[order]
        for step in range(1, len(own)):
            same = kind[step:] == kind[:-step]
            if not same.any():
                break
            hot.append(mix(mix(own[:-step][same] + np.uint64(band)) + own[step:][same]))
    return singles, np.unique(np.concatenate(hot))


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(3).compress(values.astype(np.uint32).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint32)


def describe(docs: DataFrame, id_col: str, text_col: str, counter_bits: int = COUNTER_BITS) -> DataFrame:
    """One pass over the texts: rows (id, node, n) for the documents, and rows (part, counts) of each task's token counters."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    key = chosen.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts, kind = WordHasher(LOWER), np.zeros(1 << counter_bits, np.uint32), None
        for batch in batches:
            kind, found = batch["id"].type, []
            for hashes in hasher.each(batch["text"].to_pylist()):
                tokens = shingles(hashes)
                counts[(tokens >> np.uint64(64 - counter_bits)).astype(np.int64)] += 1
                found.append((node_of(tokens), len(tokens), parities(tokens)) if len(tokens) else (None, 0, None))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.int64())), pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.binary())],
                ["id", "node", "n", "parity", "part", "counts"],
            )
        if kind is not None:
            parts = np.split(counts, min(_PARTS, 1 << counter_bits))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(parts), kind), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.list_(pa.int64())), pa.array(range(len(parts)), pa.int32()), pa.array([_pack(p) for p in parts], pa.binary())],
                ["id", "node", "n", "parity", "part", "counts"],
            )

    return chosen.mapInArrow(run, f"id {key}, node long, n long, parity array<long>, part int, counts binary")


def token_counters(described: DataFrame) -> np.ndarray:
    """The tasks' counters added up: one array of fixed size, part by part on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        for batch in batches:
            for at, data in zip(batch["part"].to_pylist(), batch["counts"].to_pylist()):
                if at != part:
                    if total is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_pack(total)], pa.binary())], ["part", "counts"])
                    part, total = at, np.zeros(len(_unpack(data)), np.uint64)
                total += _unpack(data)
                total = np.minimum(total, np.uint64(2**32 - 1))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_pack(total)], pa.binary())], ["part", "counts"])

    blobs = described.where("part IS NOT NULL").select("part", "counts").repartition("part").sortWithinPartitions("part")
    rows = sorted((r.part, bytes(r.counts)) for r in blobs.mapInArrow(run, "part int, counts binary").collect())
    return np.concatenate([_unpack(data) for _, data in rows]) if rows else np.zeros(1, np.uint32)


def frequent_above(counters: np.ndarray) -> int:
    """Tokens counted above this are frequent: well beyond what chance meetings of rare tokens explain."""
    mean = float(counters.mean())
    return int(mean + 6 * mean**0.5 + 16)


def signature_rows(docs: DataFrame, text_col: str, shared: Broadcast, threshold: int) -> DataFrame:
    """Rows (sig, node, hot), about once for each set and task; ``shared`` holds the counters. ``hot`` signatures may have groups of any size, others not."""
    shift, limit = np.uint64(65 - len(shared.value).bit_length()), frequent_above(shared.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, counted = WordHasher(LOWER), _Seen(), shared.value
        for batch in batches:
            sigs, nodes, hot, size = [], [], [], 0
            for hashes in hasher.each(batch["text"].to_pylist()):
                tokens = shingles(hashes)
                node = node_of(tokens)
                if not len(tokens) or seen.again(node):
                    continue
                for kind, own in enumerate(signatures(tokens, counted[(tokens >> shift).astype(np.int64)], limit, threshold)):
                    sigs.append(own)
                    nodes.append(np.full(len(own), node, np.int64))
                    hot.append(np.full(len(own), bool(kind)))
                    size += len(own)
                if size > 500_000:
                    yield _signature_batch(sigs, nodes, hot)
                    sigs, nodes, hot, size = [], [], [], 0
            if sigs:
                yield _signature_batch(sigs, nodes, hot)

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "sig long, node long, hot boolean")


def _signature_batch(sigs: list, nodes: list, hot: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(hot))], ["sig", "node", "hot"])


def shared_signatures(rows: DataFrame) -> DataFrame:
    """The rows of signatures that two sets or more have.

    One shuffle brings a signature's rows together: rare tokens have groups of bounded size, hot signatures are salted by
    their nodes. Hot ones then meet in minima and maxima, which are combined before the shuffle, and are rejoined.
    """
    salted = rows.withColumn("salt", F.when(F.col("hot"), F.pmod("node", F.lit(_SALTS))).otherwise(F.lit(0)))
    group = Window.partitionBy("sig", "salt")
    met = salted.withColumns({"lo": F.min("node").over(group), "hi": F.max("node").over(group)}).where("hot OR lo < hi").select("sig", "node", "hot")
    met = materialise(met.distinct(), "met")
    hot = met.where("hot").select("sig", "node")
    ends = hot.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("sig")
    return met.where("NOT hot").select("sig", "node").unionByName(hot.join(ends, "sig"))


def token_sets(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """Rows (node, tokens) of the wanted nodes, each once.

    A bitmap of fixed size over the wanted nodes ends most other texts in their task; a semi join does the rest.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.col("node").alias("hash")), _NODE_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, bits = WordHasher(LOWER), _Seen(), shared.value
        for batch in batches:
            nodes, sets, size = [], [], 0
            for hashes in hasher.each(batch["text"].to_pylist()):
                tokens = shingles(hashes)
                node = node_of(tokens)
                place = (node & (2**64 - 1)) >> (64 - _NODE_BITS)
                if not len(tokens) or not int(bits[place >> 6]) >> (place & 63) & 1 or seen.again(node):
                    continue
                nodes.append(node)
                sets.append(tokens.view(np.int64))
                size += len(tokens)
                if size > 500_000:
                    yield _set_batch(nodes, sets)
                    nodes, sets, size = [], [], 0
            if nodes:
                yield _set_batch(nodes, sets)

    sets = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "node long, tokens array<long>")
    found = materialise(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    shared.destroy()
    return found


def _set_batch(nodes: list, sets: list) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["node", "tokens"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. A node of many pairs is dealt to chunks of bounded size."""
    degree = pairs.groupBy("a").agg(F.count("*").alias("pairs"))
    hubs = degree.join(sets.withColumnRenamed("node", "a"), "a").withColumn("chunks", F.ceil(F.col("pairs") * F.size("tokens") / F.lit(_TOKENS_PER_HUB)).cast("int"))
    dealt = pairs.join(hubs.select("a", "chunks"), "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"))
    left = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("tokens").alias("ours"))
    right = dealt.select("a", "chunk", "b").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("theirs")), "b")
    both = right.join(left, ["a", "chunk"]).withColumn("common", F.size(F.array_intersect("ours", "theirs")).cast("long"))
    union = F.size("ours") + F.size("theirs") - F.col("common")
    return both.where(100 * F.col("common") >= threshold * union).select("a", "b")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Rows (id, node, n) of all documents, and rows (node, root) of the sets that have a similar one.

    ``node`` names a document's shingle set, so exact copies share it, and is null without words: such a document has no
    partner. ``n`` is the size of the set, ``root`` names the component of sets linked directly or over others. Null texts
    have no words; null ids and repeated rows stay rows of their own; other columns are not read. Sets are compared by
    64-bit hashes of their shingles.
    """
    described = materialise(describe(docs, id_col, text_col), "described")
    about = described.where("part IS NULL").select("id", "node", "n")
    counters = docs.sparkSession.sparkContext.broadcast(token_counters(described))
    shared = materialise(shared_signatures(signature_rows(docs, text_col, counters, threshold)), "found")
    counters.destroy()
    sized = described.where("node IS NOT NULL").join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.max("n").alias("n"), F.first("parity").alias("parity"))
    nodes = materialise(sized, "nodes")

    def proposals(pairs: DataFrame) -> DataFrame:
        """Distinct pairs that may be similar by their sizes and by their parities; both bounds are exact."""
        few = materialise(pairs.where(f"100 * least(n, m) >= {threshold} * greatest(n, m)").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "proposed")
        sides = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")) for x in "ab"]
        differ = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        # |A and B| is at most (|A| + |B| - differ) / 2, and similarity wants (100 + t) |A and B| >= t (|A| + |B|).
        fits = (100 + threshold) * (F.col("na") + F.col("nb") - differ) >= 2 * threshold * (F.col("na") + F.col("nb"))
        return few.join(sides[0], "a").join(sides[1], "b").where(fits).select("a", "b")

    # Signatures of the same members ask the same questions: one of them stays.
    members = shared.groupBy("sig").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    kept = members.groupBy("members", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    shared = materialise(shared.join(kept, "sig", "left_semi").join(nodes.select("node", "n"), "node"), "shared")
    roots, sets, tested, turn, last = nodes.select("node", F.col("node").alias("root")), None, None, 0, False
    while True:
        placed = shared.join(roots, "node")
        if turn < 2:
            pick = (F.min, F.max)[turn]
            hubs = placed.groupBy("sig").agg(pick(F.struct("node", "n", "root")).alias("hub")).select("sig", "hub.*")
            hubs = hubs.select("sig", F.col("node").alias("other"), F.col("n").alias("m"), F.col("root").alias("its"))
            pairs = proposals(placed.join(hubs, "sig").where("root <> its"))
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
        else:
            # What is still open: members of one signature in different components, against each other.
            mixed = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("sig", "members")
            refused = tested.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("refused"))
            members = placed.join(mixed, "sig").join(nodes.select("node", "parity"), "node").join(refused, "node", "left")
            found = materialise(close_in_blocks(members, threshold, 4 ** (turn - 2) - 1), "blocks")
            pairs = found.where("a IS NOT NULL").select("a", "b").distinct()
            held = found.where("a IS NULL").select("sig").distinct()
            last = held.isEmpty()
            shared = shared.join(held, "sig", "left_semi")
        pairs = materialise(pairs, "pairs")
        if not pairs.isEmpty():
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            if sets is not None:
                wanted = wanted.join(sets.select("node"), "node", "left_anti")
            more = token_sets(docs, text_col, materialise(wanted, "wanted"))
            sets = more if sets is None else sets.unionByName(more)
            links = verified(pairs, sets, threshold)
            tested = pairs if tested is None else tested.unionByName(pairs)
            # Components of components: the new links between their roots.
            ends = [roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab"]
            joined = connected_components(links.join(ends[0], "a").join(ends[1], "b"), "root_a", "root_b")
            joined = joined.select(F.col("node").alias("root"), F.col("root").alias("above"))
            roots = materialise(roots.join(joined, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
        elif turn >= 2:
            return about, roots
        if last:
            return about, roots
        if tested is None:
            tested = materialise(pairs, "tested")
        turn += 1


def close_in_blocks(members: DataFrame, threshold: int, extra: int) -> DataFrame:
    """Pairs (a, b) of members of one signature and of different components whose sizes and parities allow a link; a row of nulls and the
    signature (sig) for a block that holds such pairs back.

    ``members``: rows (sig, members, node, n, root, parity, refused). Members are dealt to tiles of bounded size and compared tile by tile,
    bit by bit in numpy. A block gives out the pairs that connect components it has not connected yet, and ``extra`` more a member;
    ``refused`` lists partners with greater names that were tried before.
    """
    tiles = F.ceil(F.col("members") / F.lit(_TILE)).cast("int")
    dealt = members.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # Tile i meets every tile j; the lower one of the two comes first in the block's name.
    blocks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    blocks = blocks.withColumn("block", F.xxhash64("sig", F.least("tile", "other"), F.greatest("tile", "other")))
    blocks = blocks.select("block", "sig", "node", "n", "root", "parity", "refused")

    def compared(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows).combine_chunks()
        nodes, n, roots = (whole[c].to_numpy() for c in ("node", "n", "root"))
        bits = whole["parity"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(nodes), -1)
        tried = {int(a): set(b) for a, b in zip(nodes, whole["refused"].to_pylist()) if b}
        joined = np.unique(roots, return_inverse=True)[1]
        found, held = [], False
        for i in range(len(nodes) - 1):
            open_ones = np.flatnonzero(roots[i + 1 :] != roots[i]) + i + 1
            both, least = n[open_ones] + n[i], np.minimum(n[open_ones], n[i])
            open_ones = open_ones[100 * least >= threshold * (both - least)]
            if not len(open_ones):
                continue
            both = n[open_ones] + n[i]
            differ = np.bitwise_count(bits[open_ones] ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = open_ones[(100 + threshold) * (both - differ) >= 2 * threshold * both]
            if int(nodes[i]) in tried:
                near = near[[int(nodes[j]) not in tried[int(nodes[i])] for j in near]]
            left = extra
            for j in near.tolist():
                if joined[j] != joined[i]:
                    joined[joined == joined[j]] = joined[i]
                elif left:
                    left -= 1
                else:
                    held = True
                    if (joined[near] == joined[i]).all():
                        break
                    continue
                found.append((int(nodes[i]), int(nodes[j])))
        sig = whole["sig"][0].as_py()
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in found] + [None] * held, pa.int64()), pa.array([x[1] for x in found] + [None] * held, pa.int64()), pa.array([sig] * (len(found) + held), pa.int64())], ["a", "b", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting = None, []
        for batch in batches:
            edges = [0, *(np.flatnonzero(np.diff(batch["block"].to_numpy())) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                block = batch["block"][a].as_py()
                if waiting and block != at:
                    yield compared(waiting)
                    waiting = []
                at = block
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield compared(waiting)

    # In order of names, so that blocks of the same members propose the same pairs.
    return blocks.repartition("block").sortWithinPartitions("block", "node").mapInArrow(run, "a long, b long, sig long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """Rows (id, n_shingles, component_id), one a document; the component's least id, the document's own if it is alone.

    Null ids are passed over in the least; a component of null ids alone has a null one.
    """
    about, roots = similar_sets(docs, id_col, text_col, threshold)
    least = about.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"))
    named = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(whole, "root").select("node", "component_id")
    return about.join(classes, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row of every component, with its own columns: the one with the least id (a null id counts as greater than all).

    Of rows with one id and one set of shingles, any one stays. Documents without words all stay.
    """
    about, roots = similar_sets(docs, id_col, text_col, threshold)
    least = about.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"))
    named = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min_by("node", F.struct(F.col("least").isNull(), "least", "node")).alias("node"), F.min("least").alias("least")).select("node", "least")

    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, text, key = docs.toDF(*names), names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields)), "node long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(LOWER)
        for batch in batches:
            sets = [shingles(h) for h in hasher.each(batch[text].cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], [*names, "node"])

    wordless = F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    tagged = plain.where(~wordless).mapInArrow(run, schema)
    chosen = tagged.join(first.withColumnRenamed("node", "its"), F.col("node") == F.col("its")).where(F.col(key).eqNullSafe(F.col("least"))).dropDuplicates(["node"])
    return chosen.select(*names).unionByName(plain.where(wordless)).toDF(*docs.columns)
