"""Runs of repeated words against a brute-force search, and the query on cycled texts against a plain version of its contract."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import queries, runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(x):
    """Every maximal stretch of at least two periods, with its smallest period."""
    found = {}
    for period in range(1, len(x) // 2 + 1):
        i = 0
        while i + period < len(x):
            start = i
            while i + period < len(x) and x[i] == x[i + period]:
                i += 1
            if i - start >= period:
                found.setdefault((start, i + period), period)
            i = i if i > start else i + 1
    return sorted((start, period, end) for (start, end), period in found.items())


def sequences():
    rng = np.random.default_rng(5)
    for _ in range(12):
        n = int(rng.integers(1, 260))
        yield rng.integers(0, 2, n)
        yield rng.integers(0, 4, n)
        yield np.resize(rng.integers(0, 3, int(rng.integers(1, 60))), n)
        # Regions of one small period next to each other, whole and inside a longer period.
        root = np.resize(rng.integers(0, 2, int(rng.integers(1, 4))), int(rng.integers(10, 60)))
        yield np.concatenate([np.resize(root, int(rng.integers(5, 120))) for _ in range(4)])
        longer = np.concatenate([root, rng.integers(0, 3, int(rng.integers(0, 3)))])
        yield np.concatenate([rng.integers(0, 3, 20), np.resize(longer, int(rng.integers(60, 300))), rng.integers(0, 3, 20)])
    word, last = [0, 1], [0]
    while len(word) < 250:
        word, last = word + last, word
    yield np.array(word)
    word = [0]
    while len(word) < 256:
        word += [1 - v for v in word]
    yield np.array(word)


def test_all_runs_are_found():
    for x in sequences():
        got = [(start, period, end) for start, end, period in runs.runs_of(x, len(x)).T.tolist()]
        assert sorted(got) == brute(x.tolist())


def test_wrong_sums_are_found_out(monkeypatch):
    """Where sums of words claim too much, the comparison word by word still gives the right runs."""
    x = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13] * 3 + [5, 6, 7])
    honest = runs.runs_of(x, len(x))
    reach = runs._Sums.reach
    monkeypatch.setattr(runs._Sums, "reach", lambda self, i, shift, most: tuple(v + k for v, k in zip(reach(self, i, shift, most), (0, 1))))
    assert (runs.runs_of(x, len(x)) == honest).all()


def plain(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    own = [(s, e - s, p) for s, p, e in brute(words) if e - s >= max(12, 2 * p)]
    gone = {i for s, length, p in own for i in range(s + p, s + length)}
    top = max(own, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(own), *top, 1000 * top[1] // top[2] if own else None, sha("".join("%d,%d,%d\n" % r for r in own)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


SHAPE = "doc_id long, text string, runs string, start string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{v}" for v in rng.integers(0, k, n)) for k in (2, 3, 50) for n in (5, 30, 120, 300)]
    texts += [None, "", " \n\t ", "a " * 40, "ä\x0bä\x85 " * 30, "one two three " * 6, "x  y\r\n" * 9 + "x"]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][: len(texts)] + list(range(5000, 5000 + len(texts)))
    rows = [(i, t, "r", "s") for i, t in zip(ids, texts * 2)]
    return [*rows, rows[3], rows[3], (None, texts[3], None, None), (None, None, None, None)]


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, SHAPE).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert out.columns[:6] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    assert all(t == "bigint" for _, t in out.dtypes[:6])
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted((plain(i, t) for i, t, *_ in rows), key=key)


def test_operator_keeps_and_names(spark):
    docs = spark.createDataFrame([(1, "a b " * 10, "r", "s")], SHAPE)
    out = runs.find_runs(docs, ["start", "doc_id"]).first()
    assert (out.start, out.doc_id, out.n_words, [tuple(r) for r in out.runs], out.collapsed) == ("s", 1, 20, [(0, 20, 2)], "a b")
    assert runs.find_runs(docs.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(docs, ["runs"])


def test_very_long_text(spark):
    """A text of 400000 words with one long cycle, next to short ones, in one task."""
    cycle = [f"v{i}" for i in range(1500)]
    words = [f"u{i}" for i in range(150_000)] + [cycle[i % 1500] for i in range(250_000)]
    docs = spark.createDataFrame([(1, "a b"), (2, " ".join(words)), (3, "c c c")], "doc_id long, text string").coalesce(1)
    out = {r.doc_id: r for r in runs.find_runs(docs, ["doc_id"]).withColumn("left", F.size(F.split("collapsed", " "))).collect()}
    assert [tuple(r) for r in out[2].runs] == [(150_000, 250_000, 1500)] and out[2].left == 151_500 and not out[1].runs and not out[3].runs
