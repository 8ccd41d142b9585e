"""Katz backoff language model, fitted and evaluated over partitioned tables.

P(w | h) is c*(h, w) / c(h) for pairs seen in training and alpha(h) P1(w) for others; P1(w) is c*(w) / N, and what that leaves
belongs to one unknown word. c* is the Good-Turing discounted count: Katz's form for counts up to ``MOST_DISCOUNTED``, and
a constant off greater ones, so every context keeps something for unseen words. alpha(h) makes each context's probabilities
sum to exactly one: what the discounts of h left, over what P1 gives to the words unseen after h.

Neither the vocabulary nor the pairs are ever in one place. The work runs over three tables in the shared checkpoint folder:

1. ``encode``: the texts once, as batches of bounded size with a dictionary of their own;
2. ``count_words``: the words of all batches by ranges of their hashes, counted over the training texts, with an answer (id and
   count) to every batch that asked;
3. ``count_pairs``: each batch's pairs, once a text, dealt to partitions by their context. A partition counts its pairs and answers
   with a sum a text of all that the discounts do not touch, and with counts for the rest: a text's pairs seen 1 to k times, and, for
   its unseen pairs, how many words were seen 1 to k times, and more often, after the context. Counts of counts are added up over all
   partitions; the one table of discounts made of them turns these counts into the rest of the sums. A context of very many tokens
   is split over partitions by the next word; its parts' counts are added up before its alpha is known.

Words and contexts are named by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.text import LOWER, WordHasher, mix
from pagelake.session import materialise

MOST_DISCOUNTED = 5
TAIL_DISCOUNT = 0.5
BATCH_TOKENS = 3_000_000
BATCH_PIECES = 1 << 18
WORDS_PER_PARTITION = 1_000_000
PAIRS_PER_PARTITION = 1_500_000
LEAST_PARTITIONS = 48
TOKENS_PER_CONTEXT_PART = 750_000
# Not hashes of words: the end of a text, a token; and what stands before its first one, a context alone.
END, START = np.uint64(xxhash.xxh64_intdigest(b"end", 2)), np.uint64(xxhash.xxh64_intdigest(b"start", 2))


def pack(values: np.ndarray) -> bytes:
    """A numpy array of whole numbers or doubles, byte planes apart, compressed."""
    values = np.ascontiguousarray(values)
    if values.dtype.kind != "f":
        top = int(values.max()) if len(values) else 0
        values = values.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max))
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return values.dtype.str.encode() + zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    kind, body = np.dtype(data[:3].decode()), data[3:]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def discounted(counts_of_counts: np.ndarray) -> np.ndarray:
    """c* for the counts 1 to k, from n_1 to n_(k+1). Where Good-Turing gives nothing between 0 and r, a constant is taken off."""
    k = len(counts_of_counts) - 1
    n = counts_of_counts.astype(float)
    r = np.arange(1, k + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        common = (k + 1) * n[k] / n[0]
        star = r * ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
    return np.where((star > 0) & (star < r), star, r - TAIL_DISCOUNT)


def apply_discount(star: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """c* of each count above zero."""
    low = star[np.minimum(counts, len(star)) - 1]
    return np.where(counts <= len(star), low, counts - TAIL_DISCOUNT)


def tallies(counts: np.ndarray) -> np.ndarray:
    """n_1 to n_(k+1)."""
    return np.bincount(np.minimum(counts, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)[1 : MOST_DISCOUNTED + 2]


def in_training(key: str, modulus: int, held: int) -> bool:
    """Whether a key's text is learnt from."""
    return zlib.crc32(key.encode()) % modulus != held


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """The rows of a stream sorted by ``key``, a group at a time."""
    at, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != at:
                yield at, rows
                rows = []
            at = row[key]
            rows.append(row)
    if rows:
        yield at, rows


def encode(docs: DataFrame, id_col: str, text_col: str, learns: Callable[[object], bool], batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Batches of whole texts, or of pieces of very long ones, as codes of the batch's own words in the order of their hashes."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    key = chosen.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, kind = WordHasher(LOWER), None
        tokens: list[np.ndarray] = []
        pieces: list[dict] = []
        size = 0

        def flush() -> pa.RecordBatch:
            before = np.array([p["before"] for p in pieces], np.uint64)
            words, places = np.unique(np.concatenate([*tokens, before, [START]]), return_inverse=True)
            flat, contexts, start = places[:size], places[size:-1], int(places[-1])
            lengths = np.array([p["tokens"] for p in pieces])
            learnt = np.array([p["learnt"] for p in pieces], bool)
            counts = np.bincount(flat[np.repeat(learnt, lengths)], minlength=len(words))
            counts[start] = sum(p["learnt"] and p["first"] for p in pieces)
            row = {
                "batch": uuid.uuid4().int >> 65, "words": pack(words), "n_words": len(words), "counts": pack(counts), "codes": pack(flat), "lengths": pack(lengths),
                "learnt": pack(learnt), "before": pack(contexts), "n_tokens": size, "rows": [p["row"] for p in pieces], "ids": [p["id"] for p in pieces],
            }
            types = {"batch": pa.int64(), "n_words": pa.int64(), "n_tokens": pa.int64(), "rows": pa.list_(pa.int64()), "ids": pa.list_(kind)}
            return pa.RecordBatch.from_arrays([pa.array([v], types.get(k, pa.binary())) for k, v in row.items()], list(row))

        for batch in batches:
            kind = batch["id"].type
            for doc_id, words in zip(batch["id"].to_pylist(), hasher.each(batch["text"].to_pylist())):
                learnt, row, at, before = learns(doc_id), uuid.uuid4().int >> 65, 0, START
                whole = np.append(words, END)
                while at < len(whole):
                    own = whole[at : at + batch_tokens - size]
                    tokens.append(own)
                    pieces.append({"row": row, "id": doc_id, "learnt": learnt, "tokens": len(own), "first": at == 0, "before": before})
                    at, before, size = at + len(own), own[-1], size + len(own)
                    if size >= batch_tokens or len(pieces) >= BATCH_PIECES:
                        yield flush()
                        tokens, pieces, size = [], [], 0
        if pieces:
            yield flush()

    return chosen.mapInArrow(run, (
        "batch long, words binary, n_words long, counts binary, codes binary, lengths binary, learnt binary, before binary, "
        f"n_tokens long, rows array<long>, ids array<{key}>"))


def count_words(batches: DataFrame, partitions: int) -> DataFrame:
    """By ranges of word hashes: a row of the word table (batch null), and a row with ids and counts for each batch.

    Ids are unique and small for frequent words. Words never seen in training have count 0 and share id 0.
    """
    def ask(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in batch.to_pylist():
                hashes, counts = unpack(row["words"]).astype(np.uint64), unpack(row["counts"])
                parts = (((hashes >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32)).astype(np.int64)
                edges = np.searchsorted(parts, np.arange(partitions + 1))
                for part in range(partitions):
                    a, b = edges[part], edges[part + 1]
                    if a < b:
                        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([row["batch"]]), pa.array([pack(np.diff(hashes[a:b], prepend=hashes[a : a + 1]))]), pa.array([int(hashes[a]) >> 1]), pa.array([int(hashes[a]) & 1]), pa.array([pack(counts[a:b])])], ["part", "batch", "steps", "first", "odd", "counts"])

    def answer(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in grouped(stream, "part"):
            own = []
            for row in rows:
                steps = unpack(row["steps"]).astype(np.uint64)
                steps[0] = np.uint64(row["first"] * 2 + row["odd"])
                own.append(np.cumsum(steps, dtype=np.uint64))
            words, place = np.unique(np.concatenate(own), return_inverse=True)
            counts = np.bincount(place, np.concatenate([unpack(r["counts"]) for r in rows]).astype(float), len(words)).astype(np.int64)
            ids, known = np.zeros(len(words), np.int64), np.flatnonzero(counts)
            ids[known[np.argsort(-counts[known], kind="stable")]] = np.arange(len(known)) * partitions + part + 1
            token = known[words[known] != START]
            out = [{"part": part, "batch": None, "ids": pack(words[known]), "counts": pack(counts[known]), "types": len(token), "tokens": int(counts[token].sum()), "tallies": tallies(counts[token]).tolist(), "spare": int((counts[token] > MOST_DISCOUNTED).sum())}]
            at = 0
            for row, hashes in zip(rows, own):
                mine = place[at : at + len(hashes)]
                at += len(hashes)
                out.append({"part": part, "batch": row["batch"], "ids": pack(ids[mine]), "counts": pack(counts[mine])})
            for row in out:
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]], pa.int32()), pa.array([row["batch"]], pa.int64()), pa.array([row["ids"]], pa.binary()), pa.array([row["counts"]], pa.binary()),
                    pa.array([row.get("types")], pa.int64()), pa.array([row.get("tokens")], pa.int64()), pa.array([row.get("tallies")], pa.list_(pa.int64())), pa.array([row.get("spare")], pa.int64()),
                ], ["part", "batch", "ids", "counts", "types", "tokens", "tallies", "spare"])

    asked = batches.select("batch", "words", "counts").mapInArrow(ask, "part long, batch long, steps binary, first long, odd long, counts binary")
    dealt = asked.repartition(max(partitions, 1), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(answer, "part int, batch long, ids binary, counts binary, types long, tokens long, tallies array<long>, spare long")


class Unigram:
    """What every task needs of the word level: N, V, the discounts, and the probability of a count (0: the unknown word)."""

    def __init__(self, tokens: int, types: int, counts_of_counts: np.ndarray, above: int):
        self.tokens, self.types = tokens, types
        self.star = discounted(counts_of_counts)
        r = np.arange(1, MOST_DISCOUNTED + 1)
        left = float((counts_of_counts[:-1] * (r - self.star)).sum() + TAIL_DISCOUNT * above)
        self.unknown = left / tokens if tokens else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, apply_discount(self.star, np.maximum(counts, 1)) / self.tokens, self.unknown)

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))


def discounts(star: np.ndarray) -> np.ndarray:
    """What is taken off a pair seen once, twice, up to k times, and more often."""
    return np.append(np.arange(1, len(star) + 1) - star, TAIL_DISCOUNT)


def _pair_rows(row: dict, ids: np.ndarray, counts: np.ndarray, unigram: Unigram, partitions: int, context_tokens: int) -> Iterator[dict]:
    """Of one batch: sums a piece that need no pairs, then the pairs by partition."""
    codes, lengths = unpack(row["codes"]).astype(np.int64), unpack(row["lengths"]).astype(np.int64)
    learnt, before = unpack(row["learnt"]).astype(bool), unpack(row["before"]).astype(np.int64)
    n, starts = len(lengths), np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    piece = np.repeat(np.arange(n), lengths)
    context = np.empty_like(codes)
    context[1:] = codes[:-1]
    filled = lengths > 0
    context[starts[filled]] = before[filled]
    sums = lambda values: np.bincount(piece, values, n)
    heads = counts[context] > 0
    direct = np.where(heads, -np.log10(np.maximum(counts, 1))[context], np.log10(unigram.probability(counts))[codes])
    yield {
        "kind": 0, "part": -1, "batch": row["batch"], "a": pack(lengths), "b": pack(sums((counts > 0)[codes]).astype(np.int64)), "c": pack(sums(unigram.log_base(counts)[codes])),
        "d": pack(sums(direct)), "e": row["learnt"], "rows": row["rows"], "ids": row["ids"],
    }
    del direct
    asks = np.flatnonzero(heads)
    if not len(asks):
        return
    size = np.int64(len(ids) + 1)
    # All words unseen in training are one here.
    pairs = (context[asks] * size + np.where(counts > 0, np.arange(len(counts)), size - 1)[codes[asks]]) * n + piece[asks]
    del codes, context, piece, heads, asks
    pairs, repeats = np.unique(pairs, return_counts=True)
    own, pairs = pairs % n, pairs // n
    context, word = pairs // size, pairs % size
    del pairs
    word_ids, word_counts = np.append(ids, 0)[word], np.append(counts, 0)[word]
    context_ids, shares = ids[context], -(-counts[context] // context_tokens)
    share = np.where(shares > 1, (mix(word_ids.astype(np.uint64)) % shares.astype(np.uint64)).astype(np.int64), 0)
    part = (mix(mix(context_ids.astype(np.uint64)) + share.astype(np.uint64)) % np.uint64(partitions)).astype(np.int64)
    del context, word, share
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(partitions + 1))
    for p in range(partitions):
        at = order[edges[p] : edges[p + 1]]
        if len(at):
            heads = np.flatnonzero(np.diff(context_ids[at], prepend=-1))
            words, place = np.unique(word_ids[at], return_inverse=True)
            kind = np.zeros(len(words), np.int64)
            kind[place] = word_counts[at]
            yield {
                "kind": 1, "part": p, "batch": row["batch"], "a": pack(context_ids[at][heads]), "b": pack(np.diff(heads, append=len(at))), "c": pack(np.diff(words, prepend=0)), "d": pack(kind),
                "e": pack(place), "f": pack(own[at]), "g": pack(repeats[at] * 2 + learnt[own[at]]), "h": pack((shares[at][heads] > 1)), "n": n,
            }


def _score_partition(part: int, rows: list[dict], unigram: Unigram) -> Iterator[dict]:
    """Of one partition: the table of its pairs with their counts of counts, sums and counts a piece for each batch, and what its split contexts still need."""
    contexts, words, counts, pieces, repeats, split, sizes = [], [], [], [], [], [], []
    for row in rows:
        runs, place = unpack(row["b"]).astype(np.int64), unpack(row["e"]).astype(np.int64)
        contexts.append(np.repeat(unpack(row["a"]).astype(np.int64), runs))
        split.append(np.repeat(unpack(row["h"]).astype(bool), runs))
        words.append(np.cumsum(unpack(row["c"]).astype(np.int64))[place])
        counts.append(unpack(row["d"]).astype(np.int64)[place])
        pieces.append(unpack(row["f"]).astype(np.int64))
        repeats.append(unpack(row["g"]).astype(np.int64))
        sizes.append(len(place))
    context_ids, context = np.unique(np.concatenate(contexts), return_inverse=True)
    word_ids, word = np.unique(np.concatenate(words), return_inverse=True)
    del contexts, words
    repeat = np.concatenate(repeats)
    pair_ids, pair = np.unique(context * len(word_ids) + word, return_inverse=True)
    del context, word
    seen = np.bincount(pair, np.where(repeat & 1, repeat >> 1, 0), len(pair_ids)).astype(np.int64)
    word_count = np.zeros(len(word_ids), np.int64)
    is_split = np.zeros(len(context_ids), bool)
    pair_context, pair_word = pair_ids // len(word_ids), pair_ids % len(word_ids)
    word_count[pair_word[pair]] = np.concatenate(counts)
    is_split[pair_context[pair]] = np.concatenate(split)
    del counts, split
    p1 = unigram.probability(word_count)
    known, k = np.flatnonzero(seen), MOST_DISCOUNTED
    level = np.minimum(seen, k + 1).astype(np.int8) - 1
    # Of each context, the words seen after it once, twice, up to k times, and more often.
    spread = np.bincount(pair_context[known] * (k + 1) + level[known], minlength=len(context_ids) * (k + 1)).reshape(-1, k + 1)
    used = np.bincount(pair_context[known], p1[pair_word[known]], len(context_ids))
    # What is known of a pair's value before the discounts are.
    with np.errstate(divide="ignore"):
        value = np.log10(p1)[pair_word] - np.where(is_split, 0.0, np.log10(1 - used))[pair_context]
    value[known] = np.where(level[known] == k, np.log10(seen[known] - TAIL_DISCOUNT), 0.0)
    yield {"kind": 2, "part": part, "a": pack(context_ids[pair_context[known]]), "b": pack(word_ids[pair_word[known]]), "c": pack(seen[known]), "e": pack(context_ids), "f": pack(used), "h": pack(is_split), "tallies": tallies(seen[known]).tolist()}
    for h in np.flatnonzero(is_split):
        yield {"kind": 3, "part": part, "context": int(context_ids[h]), "tallies": spread[h].tolist(), "used": float(used[h])}
    backs_off = np.unique(pair_context[seen == 0])
    spreads, of = np.unique(spread[backs_off], axis=0, return_inverse=True)
    spread_of = np.zeros(len(context_ids), np.int64)
    spread_of[backs_off] = of.reshape(-1)
    ends = np.cumsum(sizes)
    for row, a, b, own in zip(rows, ends - sizes, ends, pieces):
        mine, times = pair[a:b], repeat[a:b] >> 1
        low = np.flatnonzero((level[mine] >= 0) & (level[mine] < k))
        places, at = np.unique(own[low] * k + level[mine[low]], return_inverse=True)
        out = {"kind": 4, "part": part, "batch": row["batch"], "c": pack(np.bincount(own, value[mine] * times, row["n"]))}
        out |= {"a": pack(np.diff(places, prepend=0)), "b": pack(np.bincount(at, times[low], len(places)).astype(np.int64))}
        unseen, late = seen[mine] == 0, is_split[pair_context[mine]]
        back = np.flatnonzero(unseen & ~late)
        kinds, kind = np.unique(spread_of[pair_context[mine[back]]], return_inverse=True)
        asks, at = np.unique(own[back] * max(len(kinds), 1) + kind, return_inverse=True)
        out |= {"d": pack(spreads[kinds].reshape(-1)), "e": pack(np.diff(asks, prepend=0)), "f": pack(np.bincount(at, times[back], len(asks)).astype(np.int64))}
        yield out
        waits = np.flatnonzero(unseen & late)
        if len(waits):
            yield {"kind": 5, "part": part, "batch": row["batch"], "contexts": context_ids[pair_context[mine[waits]]], "pieces": own[waits], "times": times[waits]}


def _discounted_sums(row: dict, star: np.ndarray, n: int) -> np.ndarray:
    """A sum a piece from a row of kind 4: what was known before the discounts, and what waited for them."""
    value, k = unpack(row["c"]).copy(), len(star)
    places, times = np.cumsum(unpack(row["a"]).astype(np.int64)), unpack(row["b"]).astype(np.int64)
    value += np.bincount(places // k, np.log10(star)[places % k] * times, n)
    spreads = unpack(row["d"]).astype(np.int64).reshape(-1, k + 1)
    if len(spreads):
        asks, times = np.cumsum(unpack(row["e"]).astype(np.int64)), unpack(row["f"]).astype(np.int64)
        left = np.log10((spreads * discounts(star)).sum(axis=1))
        value += np.bincount(asks // len(spreads), left[asks % len(spreads)] * times, n)
    return value


def count_pairs(batches: DataFrame, answers: DataFrame, unigram: Unigram, partitions: int, id_kind: str, context_tokens: int) -> DataFrame:
    """The rows of ``_pair_rows`` (kind 0 alone) and ``_score_partition`` for all partitions."""
    shape = f"kind int, part int, batch long, n long, a binary, b binary, c binary, d binary, e binary, f binary, g binary, h binary, rows array<long>, ids array<{id_kind}>"
    fields = [x.split(" ")[0] for x in shape.split(", ")]
    # A pass-through row keeps its place in the stream; others are told apart by kind.
    out_shape = shape + ", context long, used double, tallies array<long>, contexts array<long>, pieces array<long>, times array<long>"
    out_fields = [x.split(" ")[0] for x in out_shape.split(", ")]
    kinds = {"kind": pa.int32(), "part": pa.int32(), "batch": pa.int64(), "n": pa.int64(), "rows": pa.list_(pa.int64()), "context": pa.int64(), "used": pa.float64(), **dict.fromkeys(("tallies", "contexts", "pieces", "times"), pa.list_(pa.int64()))}

    def as_batch(row: dict, names: list[str], ids: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row.get(x)], ids if x == "ids" else kinds.get(x, pa.binary())) for x in names], names)

    def pairs(own: pa.Table, told: pa.Table) -> pa.Table:
        replies = sorted(told.to_pylist(), key=lambda r: r["part"])
        ids = np.concatenate([unpack(r["ids"]) for r in replies]).astype(np.int64)
        counts = np.concatenate([unpack(r["counts"]) for r in replies]).astype(np.int64)
        kind = own.schema.field("ids").type
        return pa.Table.from_batches([as_batch(out, fields, kind) for row in own.to_pylist() for out in _pair_rows(row, ids, counts, unigram, partitions, context_tokens)])

    def score(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {}

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in stream:
                kind["ids"] = batch.schema.field("ids").type
                yield batch

        for part, rows in grouped(watched(), "part"):
            for out in rows if part < 0 else _score_partition(part, rows, unigram):
                yield as_batch(out, out_fields, kind["ids"])

    wanted = batches.select("batch", "codes", "lengths", "learnt", "before", "rows", "ids")
    replies = answers.where("batch IS NOT NULL").select("batch", "part", "ids", "counts")
    asked = wanted.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(pairs, shape)
    # Sums that wait for no partition are spread by their batch.
    dealt = asked.repartition(partitions, F.when(F.col("part") < 0, -1 - F.abs(F.col("batch") % 1024)).otherwise(F.col("part"))).sortWithinPartitions("part")
    return dealt.mapInArrow(score, out_shape)


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2,
    batch_tokens: int = BATCH_TOKENS, words_per_partition: int = WORDS_PER_PARTITION, pairs_per_partition: int = PAIRS_PER_PARTITION, least_partitions: int = LEAST_PARTITIONS,
    context_tokens: int | None = None,
) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score), one a row of ``docs``.

    A text is held out if crc32 of its id as text leaves ``held`` modulo ``modulus``; a null id counts as the text "null".
    A null text is an empty one: its end is its only token. Repeated rows are learnt from and scored each for itself.
    ``base_score`` adds one to every count, ``score`` is the model's. Without any training text all probability is the
    unknown word's, and both scores are 0. No columns but the two named are read. Contexts of more than ``context_tokens`` tokens
    are split; neither that nor any number of partitions changes a score.
    """
    def learns(doc_id: object) -> bool:
        return in_training("null" if doc_id is None else str(doc_id), modulus, held)

    kind = docs.schema[id_col].dataType.simpleString()
    batches = materialise(encode(docs, id_col, text_col, learns, batch_tokens), "lm-batches")
    sizes = batches.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    word_partitions = max(least_partitions, -(-sizes[0] // words_per_partition))
    answers = materialise(count_words(batches, word_partitions), "lm-words")
    totals = answers.where("batch IS NULL").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("spare"), F.lit(0)),
        *(F.coalesce(F.sum(F.col("tallies")[i]), F.lit(0)) for i in range(MOST_DISCOUNTED + 1)),
    ).first()
    unigram = Unigram(totals[0], totals[1], np.array(totals[3:], np.int64), totals[2])
    pair_partitions = max(least_partitions, -(-sizes[1] // pairs_per_partition))
    found = materialise(count_pairs(batches, answers, unigram, pair_partitions, kind, context_tokens or TOKENS_PER_CONTEXT_PART), "lm-pairs")

    # One row a partition: the counts of counts of the corpus.
    star = discounted(np.array(found.where("kind = 2").agg(*(F.coalesce(F.sum(F.col("tallies")[i]), F.lit(0)) for i in range(MOST_DISCOUNTED + 1))).first(), np.int64))
    # Contexts that were split: their parts' counts together give alpha(h) c(h).
    parts = found.where("kind = 3").groupBy("context")
    whole = parts.agg(F.sum("used").alias("used"), *(F.sum(F.col("tallies")[i]).alias(f"n{i}") for i in range(MOST_DISCOUNTED + 1)))
    left = sum((F.col(f"n{i}") * F.lit(float(d)) for i, d in enumerate(discounts(star))), F.lit(0.0))
    backs = whole.select("context", F.log10(left / (1 - F.col("used"))).alias("back"))
    waits = found.where("kind = 5").select("batch", F.inline(F.arrays_zip(F.col("contexts").alias("context"), F.col("pieces").alias("piece"), F.col("times").alias("times"))))
    late = waits.groupBy("context", "batch", "piece").agg(F.sum("times").alias("times")).join(backs, "context")
    late = late.groupBy("batch", "piece").agg(F.sum(F.col("times") * F.col("back")).alias("late"))
    late = late.groupBy("batch").agg(F.collect_list(F.struct("piece", "late")).alias("late"))

    sums = found.where("kind IN (0, 4)").select("kind", "part", "batch", *"abcdef", "rows", "ids").withColumn("late", F.expr("CAST(NULL AS array<struct<piece:bigint,late:double>>)"))
    more = late.select(F.lit(6).alias("kind"), F.lit(-1).alias("part"), "batch", *(F.lit(None).cast("binary").alias(c) for c in "abcdef"), F.lit(None).cast("array<long>").alias("rows"), F.lit(None).cast(f"array<{kind}>").alias("ids"), "late")

    def total(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {}

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in stream:
                types["id"] = batch.schema.field("ids").type.value_type
                yield batch

        for _, rows in grouped(watched(), "batch"):
            first = next(r for r in rows if r["kind"] == 0)
            value = unpack(first["d"]).copy()
            for row in rows:
                if row["kind"] == 4:
                    value += _discounted_sums(row, star, len(value))
                elif row["kind"] == 6:
                    np.add.at(value, [x["piece"] for x in row["late"]], [x["late"] for x in row["late"]])
            columns = [
                pa.array(first["rows"], pa.int64()), pa.array(first["ids"], types["id"]), pa.array(~unpack(first["e"]).astype(bool)), pa.array(unpack(first["a"]).astype(np.int64)),
                pa.array(unpack(first["b"]).astype(np.int64)), pa.array(unpack(first["c"])), pa.array(value),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    # The order of the sums of a batch is fixed, so reruns over the same tables agree to the last bit.
    by_piece = sums.unionByName(more).repartition("batch").sortWithinPartitions("batch", "kind", "part").mapInArrow(
        total, f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return by_piece.groupBy("row").agg(
        F.first("id").alias(id_col), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(unigram.tokens).cast("long").alias("train_tokens"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
    ).drop("row")
