"""A quality classifier without labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Each labeller looks at measurements of the whole text and says good, bad or nothing. The labellers overlap and disagree; how often
each is right is estimated from their votes alone (one kind of good text and several of bad, votes independent given the kind). Votes of a document
are one long, two bits a labeller, so the corpus is first counted by vote pattern: at most 3^labellers rows, whatever its size, and
the estimate runs on these counts of all rows. A pattern's posterior is then the soft label of its documents.

The scorer is logistic over ``DIMENSIONS`` hashed features: words, and the measurements by step. It is fitted on the soft labels of
at most about ``MOST_ROWS`` rows, chosen by a hash of id and text, and scores every row in one map without a shuffle. Labels of
people are used nowhere; they only measure the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.rules import repeat_words
from pagelake.llm.text import BLANKS, WordHasher

ABSTAIN, GOOD, BAD = 0, 1, 2
DIMENSIONS = 4096
MOST_ROWS = 8192
STEPS = 8  # of each measurement
_BLOCK = 1 << 22
_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B))
_SYMBOLS = b"#*$%&|<>{}[]=_~^\\"
_STOP = re.compile(rb"[.!?][\"')]*(?=[\x20\x09-\x0d]|\Z)")

# Shares, each a number from 0 to 1 (a few may pass 1): the columns of ``measure``, after the number of words.
SHARES = ("symbols", "repeated", "same_lines", "distinct", "commonest", "upper", "shouts", "ended_lines", "stops", "word_length")


def measure(data: bytes, hashes: np.ndarray) -> list[float]:
    """Number of words, then ``SHARES``; zeros for a text without words."""
    n = len(hashes)
    if not n:
        return [0.0] * (1 + len(SHARES))
    lines = [x.rstrip() for x in data.split(b"\n") if x.strip()]
    counts = np.unique(hashes, return_counts=True)[1]
    letters = len(data) - len(data.translate(None, _LETTERS))
    return [
        float(n),
        (len(data) - len(data.translate(None, _SYMBOLS))) / n,
        repeat_words(hashes) / n,
        1 - len(set(lines)) / len(lines),
        len(counts) / n,
        int(counts.max()) / n,
        (len(data) - len(data.translate(None, _UPPER))) / max(letters, 1),
        data.count(b"!") / n,
        sum(x[-1:] in b".!?\"')" for x in lines) / len(lines),
        len(_STOP.findall(data)) / n,
        len(data.translate(None, BLANKS)) / n / 16,
    ]


@dataclass(frozen=True)
class Labeller:
    """Bad where the share lies outside ``allowed``, good inside ``usual``, silent between them and below ``least`` words."""

    name: str
    share: str
    allowed: tuple[float, float]
    usual: tuple[float, float]
    least: int = 20

    def votes(self, words: np.ndarray, shares: np.ndarray) -> np.ndarray:
        value = shares[:, SHARES.index(self.share)]
        out = np.zeros(len(value), np.int64)
        out[(value >= self.usual[0]) & (value <= self.usual[1])] = GOOD
        out[(value < self.allowed[0]) | (value > self.allowed[1])] = BAD
        out[words < self.least] = ABSTAIN
        return out


LABELLERS = (
    Labeller("symbols", "symbols", (0, 0.1), (0, 0.02)),
    Labeller("repeated_words", "repeated", (0, 0.3), (0, 0.05), 40),
    Labeller("repeated_lines", "same_lines", (0, 0.4), (0, 0.1)),
    Labeller("few_distinct_words", "distinct", (0.3, 1), (0.6, 1), 40),
    Labeller("one_common_word", "commonest", (0, 0.2), (0, 0.1), 40),
    Labeller("upper_case", "upper", (0, 0.4), (0, 0.1)),
    Labeller("shouting", "shouts", (0, 0.3), (0, 0.1)),
    Labeller("line_ends", "ended_lines", (0.5, 1), (0.9, 1)),
    Labeller("sentences", "stops", (0.02, 0.4), (0.05, 0.2), 40),
    Labeller("word_length", "word_length", (0.15, 0.8), (0.2, 0.6)),
)
# One more labeller, in the last two bits: a text without words is bad. It does not guess, so its errors start next to none.
ERRORS = np.append(np.full(len(LABELLERS), 0.01), 1e-6)


def patterns(measured: np.ndarray) -> np.ndarray:
    """Votes of rows of measurements, two bits a labeller."""
    words, shares = measured[:, 0], measured[:, 1:]
    out = np.where(words == 0, BAD, ABSTAIN).astype(np.int64) << np.int64(2 * len(LABELLERS))
    for i, labeller in enumerate(LABELLERS):
        out |= labeller.votes(words, shares) << np.int64(2 * i)
    return out


def unpack(packed: np.ndarray, labellers: int = len(LABELLERS) + 1) -> np.ndarray:
    return (packed[:, None] >> (2 * np.arange(labellers))) & 3


@dataclass
class VoteModel:
    """Kind 0 is good text; kind k is text that labeller k - 1 is there to find. ``shares`` of the kinds, and for each kind and
    labeller the chance that it says bad if it says anything. Silence says nothing."""

    shares: np.ndarray
    bad: np.ndarray

    def kinds(self, packed: np.ndarray) -> np.ndarray:
        """Probability of each kind, given the votes."""
        votes = unpack(packed, self.bad.shape[1])
        odds = np.log(self.shares) + (votes == BAD) @ np.log(self.bad).T + (votes == GOOD) @ np.log(1 - self.bad).T
        odds = np.exp(odds - odds.max(1, keepdims=True))
        return odds / odds.sum(1, keepdims=True)

    def posterior(self, packed: np.ndarray) -> np.ndarray:
        """Probability of good."""
        return self.kinds(packed)[:, 0]

    def accuracies(self, packed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each labeller is right when it says anything; 1 for one that never does."""
        votes, good = unpack(packed, self.bad.shape[1]), self.posterior(packed)[:, None]
        right = (counts[:, None] * ((votes == GOOD) * good + (votes == BAD) * (1 - good))).sum(0)
        said = (counts[:, None] * (votes != ABSTAIN)).sum(0)
        return np.where(said > 0, right / np.maximum(said, 1), 1.0)


def fit_votes(packed: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS) + 1, rounds: int = 2000, belief: float = 20.0, errors: np.ndarray | float = 0.01) -> VoteModel:
    """Expectation-maximisation over counted patterns; every share and every chance is estimated.

    Bad texts come in kinds that few labellers see, so one class for all of them would settle on the labellers that agree most, and
    call the rest good. Each labeller therefore has a kind of its own, which starts as text on which it mostly says bad. The
    start is also a weak prior, which keeps every chance off 0 and 1: worth ``belief`` documents for ``errors`` on good text, one for the rest. Votes
    cannot tell a kind that one labeller alone sees from errors of that labeller; there the prior believes the labeller. Without rows the
    start is returned.
    """
    start = np.full((labellers + 1, labellers), 0.05)
    start[0] = errors
    own = np.arange(labellers)
    start[own + 1, own] = 0.98
    first = np.append(0.8, np.full(labellers, 0.2 / labellers))
    prior = np.append(belief, np.ones(labellers))[:, None]
    model, weights, votes = VoteModel(first, start), counts.astype(float), unpack(packed, labellers)
    said_bad, said = (votes == BAD).astype(float), (votes != ABSTAIN).astype(float)
    for _ in range(rounds if len(packed) else 0):
        mass = model.kinds(packed) * weights[:, None]
        bad = (mass.T @ said_bad + prior * start) / (mass.T @ said + prior)
        shares = (mass.sum(0) + first) / (weights.sum() + 1)
        moved = max(np.abs(shares - model.shares).max(), np.abs(bad - model.bad).max())
        model = VoteModel(shares, bad)
        if moved < 1e-9:
            break
    return model


_STEP_PLACES = np.array([[xxhash.xxh64_intdigest(f"{name} {i}".encode()) % DIMENSIONS for i in range(STEPS + 1)] for name in SHARES])


def features(hashes: np.ndarray, measured: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's hashed features. Words weigh 1 together, and the step of each measurement a half."""
    places, counts = np.unique((hashes % np.uint64(DIMENSIONS)).astype(np.int64), return_counts=True)
    values = np.log1p(counts)
    if len(values):
        values /= np.sqrt((values**2).sum())
    steps = np.ceil(np.clip(np.sqrt(measured[1:]), 0, 1) * STEPS).astype(np.int64)
    return np.concatenate([places, _STEP_PLACES[np.arange(len(SHARES)), steps]]), np.concatenate([values, np.full(len(SHARES), 0.5)])


@dataclass
class Scorer:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS))
    base: float = 0.0


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, ridge: float = 1e-4, rounds: int = 300) -> Scorer:
    """Logistic regression on soft targets by accelerated gradient steps; rows are visited in blocks of bounded size."""
    if not rows:
        return Scorer()
    blocks, since, held = [], 0, 0
    for i, (places, _) in enumerate(rows):
        held += len(places)
        if held >= _BLOCK or i + 1 == len(rows):
            chosen = rows[since : i + 1]
            lengths = np.array([len(p) for p, _ in chosen])
            blocks.append((np.concatenate([p for p, _ in chosen]), np.concatenate([v for _, v in chosen]), np.cumsum(lengths) - lengths, lengths, targets[since : i + 1]))
            since, held = i + 1, 0
    beta = ahead = np.zeros(DIMENSIONS + 1)
    # The curve is at most a quarter of the longest row, squared; halved once more for features that share a place.
    step, momentum = 2 / max(1 + float((v**2).sum()) for _, v in rows), 1.0
    for _ in range(rounds):
        slope = np.append(ridge * ahead[:-1], 0.0)
        for places, values, starts, lengths, wanted in blocks:
            error = 1 / (1 + np.exp(-np.clip(np.add.reduceat(ahead[places] * values, starts) + ahead[-1], -40, 40))) - wanted
            slope[:-1] += np.bincount(places, values * np.repeat(error, lengths), DIMENSIONS) / len(rows)
            slope[-1] += error.sum() / len(rows)
        fresh = ahead - step * slope
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = fresh + (momentum - 1) / later * (fresh - beta)
        beta, momentum = fresh, later
    return Scorer(beta[:-1], float(beta[-1]))


@dataclass
class Model:
    votes: VoteModel
    scorer: Scorer


def _id_hash(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary"))


def held_out(id_col: str = "doc_id", modulus: int = 3, held: int = 1) -> Column:
    """Rows that neither the estimate nor the scorer sees; a null id goes by the word null."""
    return F.pmod(_id_hash(id_col), F.lit(modulus)) == held


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> Model:
    """Both models from the rows that aren't held out: the vote counts from all of them, the scorer from a sample of ``most_rows``
    on average, where equal rows count once. Rows with one id are all held out or none. An empty table gives the starting model, which scores a half."""
    own = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            texts = batch["text"].to_pylist()
            rows = np.array([measure(t or b"", h) for t, h in zip(texts, hasher.each(texts))]).reshape(-1, 1 + len(SHARES))
            found, times = np.unique(patterns(rows), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64))], ["votes", "n"])

    counted = own.select("text").mapInArrow(count, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    votes = fit_votes(np.array([r.votes for r in counted], np.int64), np.array([r.n for r in counted], np.int64), errors=ERRORS)
    total = sum(r.n for r in counted)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            texts = batch["text"].to_pylist()
            places, values, found = [], [], []
            for text, hashes in zip(texts, hasher.each(texts)):
                measured = np.array(measure(text or b"", hashes))
                at, value = features(hashes, measured)
                places.append(at.astype(np.int16).tobytes())
                values.append(value.astype(np.float32).tobytes())
                found.append(measured)
            packed = patterns(np.array(found).reshape(-1, 1 + len(SHARES)))
            yield pa.RecordBatch.from_arrays([batch["order"], pa.array(packed), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["order", "votes", "places", "vals"])

    # Another hash than the one that holds rows out, so the sample is even.
    share = int(min(1.0, most_rows / max(total, 1)) * (1 << 30))
    # An id and text that many rows repeat come once, so the sample stays small whatever is repeated.
    order = F.xxhash64(F.col("id").cast("string"), F.col("text"))
    chosen = own.select(order.alias("order"), "text").where(F.pmod(F.col("order"), F.lit(1 << 30)) < share).groupBy("order").agg(F.first("text").alias("text"))
    sample = sorted((r.order, r.votes, bytes(r.places), bytes(r.vals)) for r in chosen.mapInArrow(take, "order long, votes long, places binary, vals binary").toLocalIterator())
    rows = [(np.frombuffer(p, np.int16).astype(np.int32), np.frombuffer(v, np.float32)) for _, _, p, v in sample]
    return Model(votes, fit_scorer(rows, votes.posterior(np.array([s[1] for s in sample], np.int64))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, votes, posterior, score), one a row of ``docs``, from the whole text alone; other columns stay behind.

    ``votes``: two bits a labeller; ``posterior``: what the votes say; ``score``: the hashed scorer's probability of good text.
    A null text is an empty one: it is bad by its own labeller, and its score follows from its measurements, all zeros.
    """
    # Plain arrays: a broadcast names classes by their module, which workers need not have.
    shared = docs.sparkSession.sparkContext.broadcast((model.votes.shares, model.votes.bad, model.scorer.weights, model.scorer.base))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, bad, weights, base = shared.value
        hasher, votes = WordHasher(), VoteModel(shares, bad)
        for batch in batches:
            texts = batch["text"].to_pylist()
            found, sums = [], []
            for text, hashes in zip(texts, hasher.each(texts)):
                measured = np.array(measure(text or b"", hashes))
                places, values = features(hashes, measured)
                found.append(measured)
                sums.append(float(weights[places] @ values) + base)
            rows = np.array(found).reshape(-1, 1 + len(SHARES))
            packed = patterns(rows)
            value = 1 / (1 + np.exp(-np.clip(np.array(sums, float), -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(rows[:, 0].astype(np.int64)), pa.array(packed), pa.array(votes.posterior(packed)), pa.array(value)],
                ["id", "n_words", "votes", "posterior", "score"],
            )

    return chosen.mapInArrow(run, f"id {kind}, n_words long, votes long, posterior double, score double").withColumnRenamed("id", id_col)
