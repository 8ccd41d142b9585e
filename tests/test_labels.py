"""Label coding and text rules."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from pagelake.functions import decode as D
from pagelake.functions import text as X
from pagelake.operators import sequences as Q

CHARSET = list("abcd #")


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_ctc_round_trip(spark):
    assert one(spark, "abca", lambda v: D.ctc_decode(D.ctc_encode(v, CHARSET), CHARSET)) == "abca"
    assert one(spark, "abba", lambda v: D.ctc_decode(D.ctc_encode(v, CHARSET), CHARSET)) == "aba"
    assert one(spark, [0, 1, 1, 0, 1, 2], lambda v: D.ctc_decode(v, CHARSET), "array<int>") == "aab"
    assert one(spark, "axb", lambda v: D.ctc_encode(v, CHARSET)) is None
    assert one(spark, "axbx", lambda v: D.oov_chars(v, CHARSET)) == ["x"]


def test_attention_coding_drops_blanks_but_counts_them(spark):
    row = one(spark, "a b", lambda v: D.attn_encode(v, CHARSET, 5))
    assert row["indices"] == [0, 2, 3, 1, 0, 0, 0] and row["length"] == 4


def test_missing_end_mark_costs_the_last_character(spark):
    assert one(spark, "word", lambda v: D.prune_eos(v)) == "wor"
    assert one(spark, "word", lambda v: D.prune_eos(v, strict=False)) == "word"
    assert one(spark, "wo[s]rd[s]", lambda v: D.prune_eos(v)) == "wo"
    assert one(spark, "", lambda v: D.prune_eos(v)) == ""


def test_normalise_label(spark):
    vocab = list("abc-]^\\")
    assert one(spark, "A-x ]", lambda v: X.normalise_label(v, vocab, sensitive=False)) == "a-? ]"
    assert one(spark, "Abc", lambda v: X.normalise_label(v, vocab)) == "?bc"
    assert one(spark, "abcabc", lambda v: X.normalise_label(v, vocab, max_len=5)) is None
    assert one(spark, "axb😀c", lambda v: X.filter_chars(v, vocab)) == "abc"
    assert one(spark, "a??b?", lambda v: X.strip_unknown(v)) == "ab"


def test_edit_similarity(spark):
    sim = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(X.edit_similarity("a", "b")).first()[0]
    assert sim("", "") == 0 and sim("abc", "") == 0
    assert sim("schön", "schon") == pytest.approx(0.8) and sim("kitten", "sitting") == pytest.approx(1 - 3 / 7)


def test_japanese_sentences(spark):
    text = "一。二（三。四）五。\n「六。七」八。  \n\n九（十"
    assert one(spark, text, X.sentence_split_ja) == ["一。", "二（三。四）五。", "「六。七」八。", "九（十"]


def test_tokens(spark):
    assert one(spark, "Is it, 3.5 schön_x?", X.word_tokenize) == ["Is", "it", ",", "3", ".", "5", "schön_x", "?"]


def test_confidence(spark):
    conf = lambda n: one(spark, [0.5, 0.5, 0.25], lambda v: D.sequence_confidence(v, F.lit(n)), "array<double>")
    assert conf(0) == 0 and conf(2) == 0.25 and conf(3) == 0.0625


def test_beams_are_the_best_sequences(spark):
    rng = random.Random(1)
    steps = [[rng.random() for _ in range(4)] for _ in range(3)]
    got = one(spark, steps, lambda v: D.beam_topk(v, 5), "array<array<double>>")
    everything = sorted(
        ((sum(math.log(s[i] + 1e-9) for s, i in zip(steps, seq)), list(seq)) for seq in itertools.product(range(4), repeat=3)), reverse=True
    )
    for mine, (score, seq) in zip(got, everything[:5]):
        assert mine["seq"] == seq and mine["score"] == pytest.approx(score)


def test_bigram_score(spark):
    weights = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "ch string, weight double")
    bigram = spark.createDataFrame([("ab", 0.4), ("ba", 0.25)], "pair string, p double")
    unigram = spark.createDataFrame([("a", 0.6), ("b", 0.2)], "ch string, p double")
    rows = spark.createDataFrame([(1, "aba"), (2, "a"), (3, "bb")], "id int, text string")
    got = {r["id"]: r["score"] for r in Q.bigram_score(rows, weights, bigram, unigram).collect()}
    assert got[1] == pytest.approx(math.log(0.5 * 0.4 + 0.5 * 0.2) + math.log(0.25))
    assert got[2] == 0 and got[3] == float("-inf")


def test_restrict_vocab(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, -2.0, 3.0]), (1, 1, [0.0, 5.0, -4.0])], "seq_id int, step int, scores array<double>")
    got = {r["step"]: r["scores"] for r in Q.restrict_vocab(rows, [0, 2]).collect()}
    assert got == {0: [5.0, 0.0, 7.0], 1: [4.0, 0.0, 0.0]}


def test_group_swap(spark):
    pick = lambda v: X.swap_group_chars(v, {"a": ["a", "@"], "": ["x"]}, lambda i, n: i % n)
    assert one(spark, "aabba", pick) == "a@bba"


def test_ctc_lists_are_worked_out_once(spark):
    """Coding and decoding read a list at every place; each list stands in the plan once."""
    df = spark.createDataFrame([("abba",), ("axb",), (None,), ("",)], "v string")
    out = df.select(D.ctc_decode(D.ctc_encode("v", CHARSET), CHARSET).alias("t"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("instr(") == 1
    assert [r.t for r in out.collect()] == ["aba", None, None, ""]


def test_recogniser_sees_columns_as_they_are(spark):
    """A crop's whole numbers stay whole numbers beside fractions; a failing crop gives an empty text."""
    from pagelake.operators.hooks import apply_recogniser

    def load():
        return lambda crop: (str(crop["det_idx"]), 1 / crop["width"])

    crops = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.0), (2, 7, 4.0)], "image_id long, det_idx long, width double")
    assert sorted(map(tuple, apply_recogniser(crops, load).collect())) == [(1, 0, "0", 2.0), (1, 1, "", -1.0), (2, 7, "7", 0.25)]
