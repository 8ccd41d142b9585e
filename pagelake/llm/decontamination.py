"""Benchmark decontamination: a broadcast set of benchmark n-grams, a scan of all training windows, exact checks.

The benchmark's windows go to the tasks in blocks of at most ``block_windows``, so what is broadcast has a fixed bound
however large the benchmark is; the usual benchmark is one block. Each block is one map over the documents and there is
no shuffle at all. A document's windows are hashed with numpy, looked up in a table of bits, then in the sorted hashes
of the block, and at last compared word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.text import ALNUM, WordHasher, alnum_words, rolling
from pagelake.session import materialise

N = 13
BLOCK_WINDOWS = 100_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BITS = 20


def benchmark_windows(benchmark: DataFrame, n: int = N, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item, words): every run of ``n`` words of an item, or all of a shorter item's words; words joined by blanks.

    Items without a word give nothing. Equal windows of one item come once.
    """
    chosen = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, windows = [], []
            for item, data in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
                words = alnum_words(data or b"")
                own = {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} - {b""}
                items += [item] * len(own)
                windows += sorted(own)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.binary())], ["item", "words"])

    return chosen.mapInArrow(run, "item string, words binary")


class Block:
    """One block of windows as a task uses it: bits, sorted hashes by length, and the words behind each hash."""

    def __init__(self, rows: list[tuple[str | None, bytes]]):
        hasher = WordHasher(ALNUM)
        found: dict[int, dict[int, list[tuple[list[bytes], str | None]]]] = defaultdict(lambda: defaultdict(list))
        for item, joined in rows:
            words = joined.split(b" ")
            found[len(words)][int(rolling(hasher.of(words), len(words))[0])].append((words, item))
        self.behind = {length: dict(by_hash) for length, by_hash in found.items()}
        self.sorted = {length: np.sort(np.array(list(by_hash), np.uint64)) for length, by_hash in found.items()}
        self.bits = {}
        for length, values in self.sorted.items():
            bits = np.zeros(1 << _BITS, bool)
            bits[(values >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.bits[length] = bits

    def hits(self, data: bytes, hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words [start, end) that equal a window, and the items they belong to. Words are cut only if a hash is met."""
        spans, items, words = [], set(), None
        for length, values in self.sorted.items():
            windows = rolling(hashes, length)
            at = np.flatnonzero(self.bits[length][(windows >> np.uint64(64 - _BITS)).astype(np.int64)])
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(values, windows[at]), len(values) - 1)
            at = at[values[place] == windows[at]]
            for start in at.tolist():
                words = alnum_words(data) if words is None else words
                same = [item for own, item in self.behind[length][int(windows[start])] if own == words[start : start + length]]
                if same:
                    spans.append((start, start + length))
                    items.update(x for x in same if x is not None)
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without overlaps, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def without_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(data)]
    parts, since = [], 0
    for start, end in spans:
        parts.append(data[since : at[start][0]])
        since = at[end - 1][1]
    return b"".join([*parts, data[since:]])


def scan(
    docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text", keep: list[str] | None = None,
    item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The columns ``keep`` of every document (all, if None) and what was found in it.

    Added: ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``n_items``, ``items`` (their ids as strings,
    sorted), ``hit_spans`` (merged runs of words, [start, end)), ``contaminated`` (20 * n_hit >= n_words, and a hit).
    Columns of ``docs`` with such a name are replaced. A null text has no words. A window of an item with a null id hits
    words but adds no id. Without benchmark windows nothing is hit. Repeated rows are judged each for itself.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, n, item_col, item_text_col)
    windows = materialise(windows, "windows")
    count = windows.count()
    blocks = max(1, -(-count // block_windows))
    numbered = windows.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))

    added = ("n_words", "n_hit", "n_items", "items", "hit_spans", "contaminated")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    fields = [docs.schema[c] for c in kept]
    inner = [f"c{i}" for i in range(len(kept))]
    state = docs.select(
        *(F.col(c).alias(i) for c, i in zip(kept, inner)), F.col(text_col).cast("binary").alias("body"), F.lit(0).cast("long").alias("n_words"),
        *(F.expr("CAST(array() AS array<int>)").alias(c) for c in ("start", "end")), F.expr("CAST(array() AS array<string>)").alias("items"),
    )
    schema = T.StructType([
        *(T.StructField(i, f.dataType) for i, f in zip(inner, fields)), T.StructField("body", T.BinaryType()),
        T.StructField("n_words", T.LongType()), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("start", "end")), T.StructField("items", T.ArrayType(T.StringType())),
    ])

    def scan_block(state: DataFrame, number: int, last: bool) -> DataFrame:
        rows = [(r.item, bytes(r.words)) for r in numbered.where(F.col("block") == number).select("item", "words").collect()]
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, hasher = Block(shared.value), WordHasher(ALNUM)
            for batch in batches:
                counts, spans, items = [], [], []
                texts = batch["body"].to_pylist()
                for data, hashes, starts, ends, ids in zip(texts, hasher.each(texts), *(batch[c].to_pylist() for c in ("start", "end", "items"))):
                    new, own = block.hits(data, hashes)
                    whole = merged([*zip(starts, ends), *new])
                    counts.append(len(hashes))
                    spans.append(whole)
                    items.append(sorted(own.union(ids)))
                # The text goes on only to a further block.
                body = pa.nulls(len(counts), pa.binary()) if last else batch["body"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[i] for i in inner), body, pa.array(counts, pa.int64()),
                     *(pa.array([[s[i] for s in own] for own in spans], pa.list_(pa.int32())) for i in (0, 1)), pa.array(items, pa.list_(pa.string()))],
                    [*inner, "body", "n_words", "start", "end", "items"],
                )

        return state.mapInArrow(run, schema)

    for number in range(blocks):
        state = scan_block(state, number, number == blocks - 1)
        if number < blocks - 1:
            state = materialise(state, "scanned")
    out = state.withColumn("hit_spans", F.arrays_zip("start", "end"))
    out = out.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))
    hit = F.col("n_hit") > 0
    return out.select(
        *(F.col(i).alias(f.name) for i, f in zip(inner, fields)), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "hit_spans",
        (hit & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents that are not contaminated, whole and with their own columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = scan(docs.toDF(*names), benchmark, text_col=names[docs.columns.index(text_col)], **how)
    return found.where(~F.col("contaminated")).select(*names).toDF(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """All documents, the words that were hit cut out of their texts; other texts stay byte for byte."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    found = scan(docs.toDF(*names), benchmark, text_col=text, **how).select(*names, "hit_spans")
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for data, spans in zip(batch[text].cast(pa.binary()).to_pylist(), batch["hit_spans"].to_pylist()):
                texts.append(without_spans(data, [(s["start"], s["end"]) for s in spans]) if spans else data)
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([new if n == text else batch[n] for n in names], names)

    return found.mapInArrow(run, schema).toDF(*docs.columns)


def items_digest(items: list[str]) -> str:
    """The digest that the query gives of a list of ids; here for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
