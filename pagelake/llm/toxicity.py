"""Toxicity by a weighted lexicon, found with Aho-Corasick in folded texts.

Folding undoes disguise: case, accents, letters of other alphabets that look Latin, digits and signs that stand for letters.
The lexicon is learnt from labels: folded words and word beginnings that toxic texts have far more often than others, chosen
greedily, each for toxic texts that no earlier term explains, and weighted by their log odds. Exception phrases are pairs of words,
one of them a term, that stand in harmless texts alone; a term inside one does not count. A text's sum of weights, as it is and by
length, goes through a logistic function fitted on the same rows.

Learning uses at most ``MOST_ROWS`` labelled rows and ``MOST_TOXIC`` toxic ones among them, chosen by a hash of their ids; these
bounds keep its tables small, so labels may be broadcast. Scoring is one map over all texts, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.text import rolling
from pagelake.session import materialise

MOST_ROWS = 200_000
MOST_TOXIC = 10_000
MOST_CANDIDATES = 100_000
MOST_EXCEPTIONS = 5_000
LEAST_SUPPORT = 3  # toxic texts, or harmless ones for an exception, and
SUPPORT_PART = 200  # one in so many toxic texts
LEAST_WEIGHT = 3.0
STEMS = range(4, 9)  # lengths of word beginnings

# Letters that look like Latin ones (Cyrillic, Greek, Armenian, other), and what stands for letters.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһӏвкмнтгАЕОРСУХІЈЅВКМНТαβεηικμνορτυχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧօսոıłøđðℓ",
    "aeopcyxijsdhlbkmhtraeopcyxijsbkmhtabenikmvoptuxwabezhikmnoptyxouniloddl",
)
LETTERS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS_FOR = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}

_ASCII = bytes(
    ord(LETTERS_FOR[chr(b)]) if chr(b) in LETTERS_FOR else b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A else 0x20 for b in range(128)
) + b" " * 128
_FOREIGN = re.compile("[ıłøđðͰ-֏ℓ]")
_SIGN = re.compile(r"(?<=[A-Za-z0-9])[@$!|+](?=[A-Za-z0-9])")
_HIDDEN = re.compile("[­​-‏⁠﻿]")


def fold(text: str) -> str:
    """Words of a-z parted by single blanks, with a blank at either end; one blank for a text without any."""
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        if _FOREIGN.search(text):
            text = text.translate(LOOKALIKES)
        text = unicodedata.normalize("NFKD", text)
    if any(s in text for s in SIGNS_FOR):
        text = _SIGN.sub(lambda m: SIGNS_FOR[m.group()], text)
    words = text.encode("ascii", "ignore").translate(_ASCII).split()
    return f" {b' '.join(words).decode()} " if words else " "


@dataclass
class Model:
    """Patterns of folded text with weights: " word " whole, " stem" a beginning. ``coefficients``: intercept, sum, sum by length."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, float, float] = (-4.0, 0.0, 0.0)


class Matcher:
    """The automaton of a model, as a task uses it."""

    def __init__(self, model: Model):
        self.automaton = ahocorasick.Automaton()
        for pattern, weight in model.terms.items():
            self.automaton.add_word(pattern, (len(pattern), weight))
        for phrase in model.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        self.empty = not model.terms
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(start, weight) of every word that a term meets, the heaviest term of a word; words of exception phrases are left out."""
        if self.empty:
            return []
        found: dict[int, float] = {}
        spans = []
        for end, (length, weight) in self.automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                spans.append((start, end))
            else:
                found[start] = max(weight, found.get(start, 0.0))
        return [(s, w) for s, w in sorted(found.items()) if not any(a <= s < b for a, b in spans)]


def features(folded: str, matcher: Matcher) -> tuple[float, float]:
    """Logarithms of the sum of weights, and of the sum for a hundred words."""
    hits = matcher.hits(folded)
    if not hits:
        return 0.0, 0.0
    total = sum(w for _, w in hits)
    return float(np.log1p(total)), float(np.log1p(100 * total / (folded.count(" ") - 1)))


def _terms_of(word: str) -> list[str]:
    """All patterns that a word could give to a lexicon."""
    return [f" {word} ", *(f" {word[:n]}" for n in STEMS if n < len(word))]


def _terms(folded: str) -> set[str]:
    """The patterns of all words of a text."""
    return {t for word in set(folded.split()) for t in _terms_of(word)}


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, modulus: int, held: int) -> DataFrame:
    """Rows (row, folded, toxic) of the labelled texts to learn from, in bounded number.

    Labels that are null, or without a text, teach nothing. A hash of the ids chooses, so reruns agree.
    """
    usable = labels.select(F.col(id_col).alias("its"), F.col(label_col).cast("int").alias("toxic")).where("its IS NOT NULL AND toxic IS NOT NULL")
    usable = usable.where(F.pmod(F.crc32(F.col("its").cast("string").cast("binary")), F.lit(modulus)) != held)
    usable = usable.groupBy("its").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in usable.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    keep = [max(1, -(-sizes.get(1, 0) // MOST_TOXIC)), max(1, -(-sizes.get(0, 0) // (MOST_ROWS - MOST_TOXIC)))]
    usable = usable.where(F.pmod(F.xxhash64("its"), F.when(F.col("toxic") > 0, F.lit(keep[0])).otherwise(F.lit(keep[1]))) == 0)
    # At most MOST_ROWS rows by the count above.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(usable), F.col("id") == F.col("its")).select("id", "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = [fold(t or "") for t in batch["text"].to_pylist()]
            names = [_least_shingle(t) for t in folded]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(folded, pa.string()), pa.array([int(x > 0) for x in batch["toxic"].to_pylist()], pa.int32())], ["row", "folded", "toxic"])

    # A text that stands in the corpus many times, unchanged or nearly so, teaches once, as its longest form.
    folded = texts.mapInArrow(run, "row long, folded string, toxic int")
    chosen = folded.groupBy("row", "toxic").agg(F.max_by("folded", F.struct(F.length("folded"), "folded")).alias("folded"))
    return materialise(chosen.select("folded", "toxic"), "toxicity-rows")


def _least_shingle(folded: str) -> int:
    words = folded.encode().split()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    return int(rolling(hashes, min(5, len(words))).min().view(np.int64)) if words else 0


def _count_terms(rows: DataFrame, among: set[str] | None) -> DataFrame:
    """Rows (term, n): texts of ``rows`` that have the term, for all terms or those ``among``; combined in each task first."""
    shared = None if among is None else rows.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for folded in batch["folded"].to_pylist():
                terms = _terms(folded)
                for term in terms if shared is None else terms & shared.value:
                    counts[term] = counts.get(term, 0) + 1
                if len(counts) > 500_000:
                    yield batch_of()
                    counts = {}
        if counts:
            yield batch_of()

    return rows.select("folded").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def choose_lexicon(rows: DataFrame) -> dict[str, float]:
    """Terms and weights from bounded training rows.

    Candidates are terms of the most toxic texts, ``MOST_CANDIDATES`` at most; the choice itself sees pairs of a bounded number of
    toxic texts and candidates.
    """
    toxic, others = rows.where("toxic = 1"), rows.where("toxic = 0")
    n_toxic, n_others = toxic.count(), others.count()
    counted = _count_terms(toxic, None).where(F.col("n") >= LEAST_SUPPORT).orderBy(F.desc("n"), "term").limit(MOST_CANDIDATES).collect()
    have = {r.term: r.n for r in counted}
    if not have:
        return {}
    harmless = {r.term: r.n for r in _count_terms(others, set(have)).collect()}

    def weight(n: int, other: int) -> float:
        # A standard error below what was counted, so rare terms weigh less.
        return float(np.log((n - n**0.5 + 0.1) / (n_toxic + 1)) - np.log((other + 1) / (n_others + 1)))

    support = max(LEAST_SUPPORT, n_toxic // SUPPORT_PART)
    weights = {t: w for t, n in have.items() if n >= support and (w := weight(n, harmless.get(t, 0))) >= LEAST_WEIGHT}
    names = sorted(weights)
    place = rows.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for folded in batch["folded"].to_pylist():
                for word in set(folded.split()):
                    own = [place.value[t] for t in _terms_of(word) if t in place.value]
                    if own:
                        found.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["terms"])

    # One row a (text, word) that some candidate meets.
    units = [np.array(r.terms, np.int64) for r in toxic.select("folded").mapInArrow(run, "terms array<int>").toLocalIterator()]
    holders: list[list[int]] = [[] for _ in names]
    for i, own in enumerate(units):
        for t in own:
            holders[t].append(i)
    open_count = np.array([len(h) for h in holders])
    # Whole words go before beginnings, and long ones before short ones, where they meet as much.
    rank = np.array([(len(t) + (t[-1] == " ")) / 1000 for t in names])
    explained, chosen = np.zeros(len(units), bool), {}
    while len(open_count):
        best = int(np.argmax(open_count + rank))
        if open_count[best] < support:
            break
        chosen[names[best]] = weights[names[best]]
        for i in holders[best]:
            if not explained[i]:
                explained[i] = True
                open_count[units[i]] -= 1
    return chosen


def choose_exceptions(rows: DataFrame, terms: dict[str, float]) -> list[str]:
    """Pairs of neighbouring words with a term that three harmless texts or more have, and ten times as often as toxic ones."""
    matcher_of = rows.sparkSession.sparkContext.broadcast((terms, [], ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Model(*matcher_of.value))
        for batch in batches:
            phrases, kinds = [], []
            for folded, toxic in zip(batch["folded"].to_pylist(), batch["toxic"].to_pylist()):
                own = set()
                for start, _ in matcher.hits(folded):
                    end = folded.index(" ", start + 1)
                    before, after = folded.rfind(" ", 0, start) if start else -1, folded.find(" ", end + 1)
                    if before >= 0:
                        own.add(folded[before : end + 1])
                    if after > 0:
                        own.add(folded[start : after + 1])
                phrases += own
                kinds += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(kinds, pa.int32())], ["phrase", "toxic"])

    counted = rows.select("folded", "toxic").mapInArrow(run, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("harmless"))
    chosen = counted.where(f"harmless >= {LEAST_SUPPORT} AND harmless >= 10 * toxic").orderBy(F.desc("harmless"), "phrase").limit(MOST_EXCEPTIONS)
    return sorted(r.phrase for r in chosen.collect())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Newton's method on a few features; weighted so that both classes count alike would distort scores, so it isn't."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (y - p) - ridge * beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 3, held: int = 1) -> Model:
    """The lexicon, its exceptions and the coefficients. Without toxic training rows nothing is toxic."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, modulus, held)
    terms = choose_lexicon(rows)
    if not terms:
        return Model()
    model = Model(terms, choose_exceptions(rows, terms))
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.exceptions, model.coefficients))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Model(*shared.value))
        for batch in batches:
            found = [features(t, matcher) for t in batch["folded"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), batch["toxic"]], ["total", "dense", "toxic"])

    counted = rows.select("folded", "toxic").mapInArrow(run, "total double, dense double, toxic int")
    got = sorted((r.total, r.dense, r.toxic) for r in counted.toLocalIterator())
    data = np.array(got)
    model.coefficients = fit_logistic(data[:, :2], data[:, 2])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score), one a row of ``docs``: between 0 and 1, from the whole text alone. A null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.exceptions, model.coefficients))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, (base, by_sum, by_density) = Matcher(Model(*shared.value)), shared.value[2]
        for batch in batches:
            found = np.array([features(fold(t or ""), matcher) for t in batch["text"].to_pylist()]).reshape(-1, 2)
            value = 1 / (1 + np.exp(-np.clip(base + found @ np.array([by_sum, by_density]), -50, 50)))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(value)], ["id", "score"])

    return chosen.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
