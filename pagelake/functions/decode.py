"""Column builders between label texts, class indices and class scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.geometry import once
from pagelake.functions.text import chars

# Fixed values of the label coding.
GO, EOS, BLANK = "[GO]", "[s]", "[blank]"
MAX_LABEL = 25
LOG_FLOOR = 1e-9


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ctc_table(charset: Sequence[str]) -> list[str]:
    return [BLANK, *charset]


def attn_table(charset: Sequence[str]) -> list[str]:
    return [GO, EOS, *charset]


def _place(c: Column, charset: Sequence[str]) -> Column:
    """1-based place of a character in the charset, 0 if absent."""
    return F.instr(F.lit("".join(charset)), c)


def oov_chars(text: Column | str, charset: Sequence[str]) -> Column:
    """Distinct characters without an index."""
    return F.array_distinct(F.filter(chars(text), lambda c: _place(c, charset) == 0))


def ctc_encode(text: Column | str, charset: Sequence[str]) -> Column:
    """Index + 1 of each character; null when a character is unknown (see ``oov_chars``)."""
    places = F.transform(chars(text), lambda c: _place(c, charset))
    return once(places, lambda places: F.when(~F.exists(places, lambda p: p == 0), places))


def ctc_decode(indices: Column | str, charset: Sequence[str]) -> Column:
    """Drop blanks and repeats of the previous index, then map to characters."""
    table = F.array(*[F.lit(c) for c in ctc_table(charset)])

    # Every place reads its neighbour, so the list is worked out once and not again for each place.
    def text(seq: Column) -> Column:
        kept = F.filter(
            seq, lambda v, i: (v != 0) & ((i == 0) | (F.get(seq, F.greatest(i - 1, F.lit(0))) != v))
        )
        return F.array_join(F.transform(kept, lambda v: F.get(table, v.cast("int"))), "")

    return once(_c(indices), text)


def attn_encode(text: Column | str, charset: Sequence[str], max_len: int = MAX_LABEL) -> Column:
    """Struct (indices, length): start, characters without blanks, end, padded to max_len + 2.

    The length counts blanks although they get no index.
    """
    letters = F.filter(chars(text), lambda c: c != " ")
    places = F.transform(letters, lambda c: _place(c, charset) + 1)
    body = F.concat(F.array(F.lit(0)), places, F.array(F.lit(1)), F.array_repeat(F.lit(0), max_len + 2))
    fits = ~F.exists(letters, lambda c: _place(c, charset) == 0) & (F.size(letters) <= max_len)
    return F.struct(
        F.when(fits, F.slice(body, 1, max_len + 2)).alias("indices"), (F.length(_c(text)) + 1).alias("length")
    )


def attn_decode(indices: Column | str, charset: Sequence[str]) -> Column:
    table = F.array(*[F.lit(c) for c in attn_table(charset)])
    return F.array_join(F.transform(_c(indices), lambda v: F.get(table, v.cast("int"))), "")


def prune_eos(text: Column | str, strict: bool = True) -> Column:
    """Cut at the first end mark. Without one, ``strict`` drops the last character."""
    col = _c(text)
    at = F.instr(col, F.lit(EOS))
    missing = F.substring(col, F.lit(1), F.greatest(F.length(col) - 1, F.lit(0))) if strict else col
    return F.when(at == 0, missing).otherwise(F.substring(col, F.lit(1), at - 1))


def argmax(scores: Column | str) -> Column:
    """Class of the highest score, the first on ties."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def softmax(scores: Column | str) -> Column:
    s = _c(scores)
    top = F.array_max(s).cast("double")
    parts = F.transform(s, lambda v: F.exp(v.cast("double") - top))
    total = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
    return F.transform(parts, lambda v: v / total)


def max_prob(scores: Column | str) -> Column:
    """Highest softmax probability, without building the whole softmax."""
    s = _c(scores)
    top = F.array_max(s).cast("double")
    return F.lit(1.0) / F.aggregate(s, F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - top))


def sequence_confidence(probs: Column | str, steps: Column | str) -> Column:
    """Product of the first ``steps`` probabilities, 0 for an empty prediction."""
    n = _c(steps).cast("int")
    product = F.aggregate(F.slice(_c(probs), 1, F.greatest(n, F.lit(0))), F.lit(1.0), lambda a, p: a * p)
    return F.when(n <= 0, F.lit(0.0)).otherwise(product)


def beam_topk(step_probs: Column | str, k: int) -> Column:
    """The ``k`` best index sequences of independent steps, as array of (score, seq).

    ``step_probs`` is array<array<double>>; a sequence scores the sum of ln(p + 1e-9).
    """
    kind = "array<struct<score:double,seq:array<int>>>"

    def top(probs: Column) -> Column:
        ranked = F.transform(
            probs, lambda p, i: F.struct((-p.cast("double")).alias("neg"), i.cast("int").alias("idx"))
        )
        return F.slice(F.array_sort(ranked), 1, k)

    def extend(beam: Column, probs: Column) -> Column:
        grown = F.flatten(
            F.transform(
                beam,
                lambda b: F.transform(
                    top(probs),
                    lambda t: F.struct(
                        (-(b["score"] + F.ln(F.lit(LOG_FLOOR) - t["neg"]))).alias("neg"),
                        F.concat(b["seq"], F.array(t["idx"])).alias("seq"),
                    ),
                ),
            )
        )
        best = F.slice(F.array_sort(grown), 1, k)
        return F.transform(best, lambda b: F.struct((-b["neg"]).alias("score"), b["seq"].alias("seq"))).cast(kind)

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("seq"))).cast(kind)
    return F.aggregate(_c(step_probs), start, extend)
