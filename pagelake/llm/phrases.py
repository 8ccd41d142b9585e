"""Collocations: frequent phrases scored by how much oftener their words stand together than apart, counted in quotient filters.

Words are numbered by hashes of language and word, cut to as many bits as keep all words of the corpus apart (which is checked). Phrases
of two words are counted first, then longer ones; a phrase enters a count only if its two halves that are one word shorter may be
frequent, as told by a bitmap of fixed size over the frequent phrases of the step before. The bitmap may say yes too often, which costs
work and changes nothing. Every task counts what it reads in counting quotient filters (``quotient.py``); their rows are shuffled by
quotient and merged, so every phrase is counted exactly, wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.quotient import SCHEMA, Layout, fold
from pagelake.llm.text import WordHasher, mix, pieces
from pagelake.session import materialise

LONGEST, LEAST, TOP = 5, 100, 2000
STOPS = b".,;:!?\x0a\x0b\x0c\x0d"  # what parts a text into pieces; blanks and tabs part words
FILTER_BITS = 27
QUOTIENT_BITS = 14  # a filter is at most so many rows, whatever the corpus: rows grow with the input alone
_LOWER = bytes(0x0A if b in STOPS else b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
_IS_STOP = np.array([b in STOPS for b in range(256)], np.int64)
_CHUNK = 1 << 20
_KEYS = 1 << 20  # grams in one filter
_WORDS = 1 << 18  # words in the table of a task, before it is given out
_SALTS = 64


def _joined(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Stretches of bytes that are worked on together: many short texts as one, or a long one cut at blanks."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        if held and size + len(text) > _CHUNK:
            yield [b"\n".join(held)]
            held, size = [], 0
        if len(text) > _CHUNK:
            yield list(pieces(text))
        else:
            held.append(text)
            size += len(text) + 1
    if held:
        yield [b"\n".join(held)]


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The stretches of a batch, language by language."""
    langs = batch["lang"].to_pylist()
    rows: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        rows.setdefault(lang, []).append(i)
    texts = batch["text"]
    for lang, own in rows.items():
        for stretch in _joined(texts[i].as_py() for i in own):
            yield lang, stretch


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang, 7))


def _chosen(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def count_words(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Rows (lang, word, id, f): every word of every language, its 64-bit number and how often it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = WordHasher(_LOWER), {}

        def rows() -> pa.RecordBatch:
            keys = list(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()).cast(pa.string()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())],
                ["lang", "word", "id", "f"],
            )

        for batch in batches:
            for lang, stretches in _by_language(batch):
                for data in stretches:
                    hashes, starts, ends = hasher.spans(data)
                    ids, first, times = np.unique(mix(hashes ^ _salt(lang)), return_index=True, return_counts=True)
                    lower = data.translate(_LOWER)
                    for i, start, end, n in zip(ids.view(np.int64).tolist(), starts[first].tolist(), ends[first].tolist(), times.tolist()):
                        entry = counts.setdefault((lang, lower[start:end]), [i, 0])
                        entry[1] += n
                    if len(counts) > _WORDS:
                        yield rows()
                        counts.clear()
        if counts:
            yield rows()

    found = _chosen(docs, lang_col, text_col).mapInArrow(run, "lang string, word string, id long, f long")
    return found.groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))


def number_bits(words: DataFrame) -> int:
    """The least number of bits, in whole bytes, by which the leading bits of all words' numbers differ."""
    bits = min(64, -(-(2 * words.count().bit_length() + 3) // 8) * 8)
    while not words.groupBy(F.shiftrightunsigned("id", 64 - bits)).count().where("count > 1").isEmpty():
        bits += 8
        if bits > 64:
            raise ValueError("two words have one 64-bit number")
    return bits


def _keyed(columns: list[np.ndarray], counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows (key, f, hash): the words' numbers as bytes one after another."""
    width = bits // 8
    data = np.hstack([c.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :] for c in columns])
    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width * len(columns)), len(counts), [None, pa.py_buffer(np.ascontiguousarray(data))])
    return pa.RecordBatch.from_arrays([keys.cast(pa.binary()), pa.array(counts, pa.int64()), pa.array(fold(columns).view(np.int64))], ["key", "f", "hash"])


def frequent_words(words: DataFrame, bits: int, least: int) -> DataFrame:
    """Rows (key, f, hash) of the words that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _keyed([batch["id"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)], batch["f"].to_numpy(), bits)

    return words.where(F.col("f") >= least).select("id", "f").mapInArrow(run, "key binary, f long, hash long")


def bitmap(grams: DataFrame, filter_bits: int) -> np.ndarray:
    """One bit for every value of the leading bits of a gram's hash; its size does not depend on the number of grams."""
    place = F.shiftrightunsigned("hash", 64 - filter_bits)
    cells = grams.groupBy(F.shiftright(place, 6).cast("int").alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - filter_bits}) & 63 as int))")).alias("bits"))
    table = cells.toArrow()
    whole = np.zeros(1 << (filter_bits - 6), np.int64)
    whole[table["cell"].to_numpy()] = table["bits"].to_numpy()
    return whole.view(np.uint64)


def count_grams(docs: DataFrame, lang_col: str, text_col: str, size: int, bits: int, quotient_bits: int, shared: Broadcast, least: int, filter_bits: int) -> DataFrame:
    """Rows (key, f, hash) of the phrases of ``size`` words that occur at least ``least`` times inside pieces.

    ``shared``: the bitmap of the frequent phrases one word shorter.
    """
    layout = Layout(size, bits, quotient_bits)

    def known(hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - filter_bits)
        return (shared.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, waiting = WordHasher(_LOWER), [], 0
        for batch in batches:
            for lang, stretches in _by_language(batch):
                ids, piece, before = [], [], 0
                for data in stretches:
                    hashes, starts, _ = hasher.spans(data)
                    stops = np.cumsum(_IS_STOP[np.frombuffer(data, np.uint8)]) + before
                    ids.append(mix(hashes ^ _salt(lang)) >> np.uint64(64 - bits))
                    piece.append(stops[starts])
                    before = int(stops[-1]) if len(stops) else before
                own, piece = np.concatenate(ids), np.concatenate(piece)
                n = len(own) - size + 1
                if n <= 0:
                    continue
                shorter = known(fold([own[i : i + n + 1] for i in range(size - 1)]))
                at = np.flatnonzero(shorter[:-1] & shorter[1:] & (piece[:n] == piece[size - 1 :]))
                held.append([own[at + i] for i in range(size)])
                waiting += len(at)
                if waiting >= _KEYS:
                    yield layout.count([np.concatenate(c) for c in zip(*held)])
                    held, waiting = [], 0
        if waiting:
            yield layout.count([np.concatenate(c) for c in zip(*held)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, counts in layout.merge(batches, least):
            if len(counts):
                yield _keyed(columns, counts, bits)

    filters = _chosen(docs, lang_col, text_col).mapInArrow(count, SCHEMA)
    return filters.repartition("quotient").sortWithinPartitions("quotient").mapInArrow(merge, "key binary, f long, hash long")


def _part(start: Column | int, length: Column | int, width: int) -> Column:
    """The key of some words of a key; ``start`` counts from 0."""
    first = start * width + 1
    return F.substring("key", first if isinstance(first, Column) else F.lit(first), length * width if isinstance(length, Column) else F.lit(length * width))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, filter_bits: int = FILTER_BITS, scale: int = 1) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of two to ``longest`` words of every language.

    Words and pieces are taken from whole texts; a null text is empty, a null language is ``und``. ``a`` counts the phrase's occurrences
    inside pieces, overlapping ones too; ``n`` all words of the language. Of all cuts into two parts, counted ``l`` and ``r``, the one with
    the least score floor(``scale`` a n / (l r)) stands for the phrase, of equal ones the first. A phrase that is part of a longer one which
    occurs as often is left out. Order: score, then a, both descending, then the phrase by its bytes, so there are no ties. Repeated rows
    count again; an empty table has no phrases; other columns are not read. ``filter_bits`` sizes the bitmaps and changes no result.
    """
    spark = docs.sparkSession
    words = materialise(count_words(docs, lang_col, text_col), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    bits = number_bits(words)
    width = bits // 8
    grams = [materialise(frequent_words(words, bits, least), "grams1")]
    for size in range(2, longest + 1):
        shared = spark.sparkContext.broadcast(bitmap(grams[-1], filter_bits))
        grams.append(materialise(count_grams(docs, lang_col, text_col, size, bits, min(QUOTIENT_BITS, bits - 8), shared, least, filter_bits), f"grams{size}"))
        shared.destroy()
    counted = grams[0].select("key", "f")
    for more in grams[1:]:
        counted = counted.unionByName(more.select("key", "f"))
    size = (F.length("key") / width).cast("int")

    longer = counted.where(F.length("key") > 2 * width).select("key", "f", size.alias("size"))
    inner = longer.select(F.explode(F.array(_part(0, F.col("size") - 1, width), _part(1, F.col("size") - 1, width))).alias("key"), "f")
    covered = inner.groupBy("key").agg(F.max("f").alias("covering"))
    phrases = counted.where(F.length("key") > width).join(covered, "key", "left").where("covering IS NULL OR covering < f")
    phrases = materialise(phrases.select("key", F.col("f").alias("a"), size.alias("size")), "phrases")

    named = words.where(F.col("f") >= least).select(F.unhex(F.lpad(F.hex(F.shiftrightunsigned("id", 64 - bits)), 2 * width, "0")).alias("own"), "lang", "word")
    spelled = phrases.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: _part(i, 1, width))).alias("place", "own")).join(named, "own")
    spelled = spelled.groupBy("key").agg(F.min("lang").alias("lang"), F.array_join(F.sort_array(F.collect_list(F.struct("place", "word"))).word, " ").alias("phrase"))

    cuts = phrases.select("key", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    cuts = cuts.select("key", "a", "k", _part(0, F.col("k"), width).alias("left"), _part(F.col("k"), F.col("size") - F.col("k"), width).alias("right"))
    cuts = cuts.join(counted.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(counted.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    parts = cuts.groupBy("key", "a").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts"))

    # Products of two counts may pass 64 bits.
    wide = lambda c: c.cast("decimal(18,0)")
    whole = parts.join(spelled, "key").join(totals, "lang").select("lang", "phrase", "a", "n", F.explode("cuts").alias("cut"))
    scored = whole.select("lang", "phrase", "a", "n", "cut", wide(F.col("a")).alias("wa"), wide(F.col("n")).alias("wn"), wide(F.col("cut.l")).alias("wl"), wide(F.col("cut.r")).alias("wr"))
    scored = scored.withColumn("score", F.expr(f"wa * wn * {scale} div (wl * wr)"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", F.col("cut.k").alias("k"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"))).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")

    # The first of each salt, then the first of those: no language is ranked as a whole in one task.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.drop("rank", "salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
