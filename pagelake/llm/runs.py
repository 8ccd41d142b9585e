"""Runs of repeated words (maximal repetitions) by string synchronising sets.

A run is a stretch of words with smallest period p, at least 2p long, that cannot be extended with that period. All runs of a text
are found in scales tau = 4, 8, 16, ...; scale tau looks for periods from 3 tau to below 6 tau, smaller ones are compared directly.

* A position is in the synchronising set of scale tau if, of the hashes of the tau + 1 windows of tau words that begin in it and after
  it, the first or the last is the least. Windows inside a highly periodic region (period at most tau / 3) do not take part; these
  regions are runs of smaller scales, so they are known. Whether a position is chosen depends on its next 2 tau words alone.
* In a run of period p some chosen position and the one p words later have equal contexts of 2 tau words. All pairs of equal context at
  a distance from 3 tau to below 6 tau propose their distance; contexts of one kind are more than tau / 3 apart, so a position is in a
  bounded number of such pairs.
* Where a run has no chosen position, both its copies of the period are highly periodic: it spans two neighbouring regions of one small
  period, which supply the periods that chosen positions omit, from the shift that lines up their roots.

A proposal is extended both ways by binary search over sums of word values and at last compared word by word, so hashes steer the work
and decide nothing. Everything happens inside one text: rows are independent, nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.text import mix

LEAST_LENGTH = 12
_BASE = 4
_WORDS = 1 << 16  # of short texts that are worked on together
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2**64 - 1)


class _Sums:
    """Equality of stretches of a sequence at a distance, by running sums of its values in 64-bit arithmetic."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.powers = np.ones(self.n + 1, np.uint64)
        np.cumprod(np.full(self.n, _MULTIPLIER, np.uint64), out=self.powers[1:])
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix(ids.view(np.uint64) + _MULTIPLIER) * self.powers[:-1], out=self.sums[1:])

    def equal(self, i: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches at i and i + shift are equal."""
        ours = self.sums[i + length] - self.sums[i]
        return ours * self.powers[shift] == self.sums[i + shift + length] - self.sums[i + shift]

    def reach(self, i: np.ndarray, shift: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """How many words before i, and from i on, are equal to those ``shift`` later; at most ``most``."""
        left, right = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for bit in reversed(range(most.bit_length())):
            more = right + (1 << bit)
            fits = i + shift + more <= self.n
            fits[fits] = self.equal(i[fits], shift[fits], more[fits])
            right[fits] = more[fits]
            more = left + (1 << bit)
            fits = more <= i
            fits[fits] = self.equal(i[fits] - more[fits], shift[fits], more[fits])
            left[fits] = more[fits]
        return left, right


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (start, end, period), one for each stretch: the one with its smallest period."""
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    return rows[:, new]


def _direct(ids: np.ndarray, period: int) -> np.ndarray:
    """Stretches of at least two periods, by comparing the sequence with itself."""
    equal = np.zeros(len(ids) - period + 2, np.int8)
    equal[1:-1] = ids[period:] == ids[:-period]
    turns = np.flatnonzero(equal[1:] != equal[:-1])
    starts, ends = turns[::2], turns[1::2] + period
    kept = ends - starts >= 2 * period
    return np.stack([starts[kept], ends[kept], np.full(kept.sum(), period, np.int64)])


def _chosen(hashes: np.ndarray, tau: int, runs: np.ndarray) -> np.ndarray:
    """The synchronising set: positions whose first or last window of tau + 1 has the least hash."""
    start, end, period = runs[:, (3 * runs[2] <= tau) & (runs[1] - runs[0] >= tau)]
    inside = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, end - tau + 1, -1)
    values = np.where(np.cumsum(inside[:-1]) > 0, _NONE, hashes)
    least, width = values, 1
    while width < tau:  # tau is a power of two
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:-1], values[tau:])
    return np.flatnonzero((least != _NONE) & ((values[: len(least)] == least) | (values[tau:] == least)))


def _equal_contexts(places: np.ndarray, contexts: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of chosen positions with equal contexts, as a place and a period."""
    order = np.argsort(contexts, kind="stable")
    places, contexts = places[order], contexts[order]
    for step in range(1, len(places)):
        apart = places[step:] - places[:-step]
        near = (contexts[step:] == contexts[:-step]) & (apart < 6 * tau)
        if not near.any():
            return
        near &= apart >= 3 * tau
        yield places[:-step][near], apart[near]


def _between_regions(sums: _Sums, runs: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods of runs across two neighbouring highly periodic regions of one small period."""
    regions = runs[:, (3 * runs[2] <= tau) & (runs[1] - runs[0] >= 3 * tau)]
    regions = regions[:, np.lexsort((regions[0], regions[2]))]
    for (a, r, own), (b, c, other) in zip(regions.T[:-1].tolist(), regions.T[1:].tolist()):
        if own != other or b > r:
            continue
        # Where in the second region the last root of the first one stands; regions of one period overlap by less than it.
        shifts = np.arange(b, b + own) - (r - own)
        met = shifts[sums.equal(np.full(own, r - own), shifts, np.full(own, own))]
        if not len(met):
            continue
        first = 3 * tau + (int(met[0]) - 3 * tau) % own
        periods = np.arange(first, 6 * tau, own)
        begin = np.maximum(a, b - periods)
        fits = begin < np.minimum(r, c - periods)
        yield begin[fits], periods[fits]


def runs_of(ids: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, smallest period) of all runs in a sequence of integers, by start and period.

    ``longest`` bounds the length of a run: several texts may be joined by numbers that occur once.
    """
    ids = np.ascontiguousarray(ids, np.int64)
    n, most = len(ids), longest // 2
    runs = _merged([np.empty((3, 0), np.int64), *(_direct(ids, p) for p in range(1, min(3 * _BASE, most + 1)))])
    sums = _Sums(ids) if 3 * _BASE <= most else None
    tau, hashes = 1, mix(ids.view(np.uint64) + _MULTIPLIER)
    while 3 * max(tau, _BASE) <= most:
        # Hashes of windows of 2 tau words from those of tau words.
        double = mix(hashes[:-tau] * _MULTIPLIER + hashes[tau:])
        if tau >= _BASE:
            places = _chosen(hashes, tau, runs)
            proposed = [*_equal_contexts(places, double[places], tau), *_between_regions(sums, runs, tau)]
            if proposed:
                at, period = (np.concatenate(x) for x in zip(*proposed))
                left, right = sums.reach(at, period, longest)
                kept = left + right >= period
                at, period, left, right = at[kept], period[kept], left[kept], right[kept]
                new = _merged([np.stack([at - left, at + period + right, period])])
                runs = _merged([runs, *(_checked(ids, *row) for row in new.T.tolist())])
        tau, hashes = 2 * tau, double
    return runs[:, np.lexsort((runs[2], runs[0]))]


def _checked(ids: np.ndarray, start: int, end: int, period: int) -> np.ndarray:
    """A proposed run compared word by word; what the sums got wrong is found directly."""
    if (
        np.array_equal(ids[start : end - period], ids[start + period : end])
        and (start == 0 or ids[start - 1] != ids[start - 1 + period])
        and (end == len(ids) or ids[end] != ids[end - period])
    ):
        return np.array([[start], [end], [period]], np.int64)
    return _direct(ids, period)


def _chunks(texts: Iterator[bytes]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        words = text.split()
        if held and size + len(words) > _WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words) + 1
    if held:
        yield held


def _solve(texts: list[list[bytes]], least: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """For each text: its number of words, its runs of at least ``least`` words, and what is left without repeated periods."""
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    ids = np.empty(begins[-1], np.int64)
    for k, (words, begin) in enumerate(zip(texts, begins.tolist())):
        ids[begin : begin + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        ids[begin + len(words)] = -1 - k
    runs = runs_of(ids, int(sizes.max()))
    runs = runs[:, runs[1] - runs[0] >= np.maximum(least, 2 * runs[2])]
    edges = np.searchsorted(runs[0], begins)
    for k, words in enumerate(texts):
        own = runs[:, edges[k] : edges[k + 1]] - np.array([[begins[k]], [begins[k]], [0]])
        if own.shape[1]:
            covered = np.zeros(len(words) + 1, np.int64)
            np.add.at(covered, own[0] + own[2], 1)
            np.add.at(covered, own[1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(covered[:-1]) == 0).tolist()]
        yield int(sizes[k]), own, b" ".join(words)


def find_runs(docs: DataFrame, keep: list[str], text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """The ``keep`` columns and n_words, runs (start, length, period; by start, then period) and collapsed, one row a document.

    Words are parted by ASCII blanks. ``runs`` lists every run of at least ``least`` words and two periods; ``collapsed`` is the text
    without words that some run contains after its first period, joined by single blanks. Null and empty texts have no words, no runs
    and an empty collapsed text. Null ids and repeated rows stay rows of their own; ties need no rule, since all runs are listed. Columns
    not named in ``keep`` are not read; a name in it that equals an added one is an error. Texts are taken whole: memory is about
    200 bytes for each word of the longest text of a task, or of ``_WORDS`` words.
    """
    if clash := {"n_words", "runs", "collapsed"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are added; rename them first")
    names = [f"c{i}" for i in range(len(keep))]
    plain = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    fields = [f"{n} {plain.schema[n].dataType.simpleString()}" for n in names]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, texts = 0, batch["text"]
            for chunk in _chunks(value.as_py() for value in texts):
                solved = list(_solve(chunk, least))
                parts = [x[1] for x in solved]
                whole = np.concatenate(parts, axis=1)
                offsets = pa.array(np.concatenate(([0], np.cumsum([p.shape[1] for p in parts]))).astype(np.int32))
                items = pa.StructArray.from_arrays([pa.array(whole[0]), pa.array(whole[1] - whole[0]), pa.array(whole[2])], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, len(chunk)) for c in batch.columns[:-1]), pa.array([x[0] for x in solved], pa.int64()),
                     pa.ListArray.from_arrays(offsets, items).cast(kind), pa.array([x[2] for x in solved], pa.binary()).cast(pa.string())],
                    [*names, "n_words", "runs", "collapsed"],
                )
                first += len(chunk)

    schema = ", ".join([*fields, "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"])
    return plain.mapInArrow(run, schema).toDF(*keep, "n_words", "runs", "collapsed")


def with_cycles(doc_id: Column, text: Column) -> Column:
    """The text, in about one of ten documents with a tail that repeats its first words.

    With h the crc32 of the id and g = h / 10: where h is a multiple of ten, every word from a = g mod n on becomes the word at
    a + (i - a) mod p, p = 1 + (n - a) / (3 + g mod 8), for n words.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    cycled = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(cycle, F.lit(1), n - a)), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), cycled).otherwise(text)
