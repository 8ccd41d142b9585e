"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations only read the ledger.

``measure`` reads the texts once and keeps whole-number measurements. ``ledger`` turns them into one long of failure
bits a document, by Column expressions. A policy is a named, versioned set of rules; applying one is a bitwise AND, and
so is asking what would come back if a rule were left out. New policies need no second pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.text import BLANKS, WordHasher, rolling

WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B))

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_shouts",
)


@dataclass(frozen=True)
class Rule:
    """A rule: its bit in the ledger never changes, and ``fails`` is a SQL condition over the measurements."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of the decision: a document is kept if none of these rules fails."""

    name: str
    version: int
    rules: tuple[str, ...]


# All comparisons are of whole numbers, so no result depends on rounding.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "shouting", "n_words > 0 AND 5 * n_shouts > 2 * n_words"),
    Rule(7, "upper_case", "n_letters > 0 AND 100 * n_upper > 60 * n_letters"),
)

BASE_POLICY = Policy("base", 1, ("few_words", "repeated_words"))
PRODUCTION_POLICY = Policy("production", 2, tuple(r.name for r in RULES))


def repeat_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that stand in the text twice or more, the first one included."""
    windows = rolling(hashes, width)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    repeated = np.zeros(len(windows), np.int64)
    repeated[order[1:][same]] = 1
    repeated[order[:-1][same]] = 1
    before = np.concatenate(([0], np.cumsum(repeated)))
    at = np.arange(len(hashes))
    upto, since = np.minimum(at + 1, len(windows)), np.maximum(at - width + 1, 0)
    return int((before[upto] > before[since]).sum())


def _measured(data: bytes, hashes: np.ndarray) -> tuple[int, ...]:
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(hashes),
        len(data.translate(None, BLANKS + _CONTINUATION)),
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(hashes),
        len(data) - len(data.translate(None, _UPPER)),
        len(data) - len(data.translate(None, _LETTERS)),
        data.count(b"!"),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id and the measurements, all longs.

    A null text counts as an empty one: all zeros. Repeated rows give repeated rows, a null id stays null, further columns
    are left behind. Windows are compared by 64-bit hashes: two unlike ones in one text agree by chance about once in 10^11
    texts of 20 000 words. One text is in memory at a time beside its Arrow batch.
    """
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    key = chosen.schema["id"].dataType
    schema = T.StructType([T.StructField("id", key), *(T.StructField(m, T.LongType(), False) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            texts = batch["text"].to_pylist()
            rows = [_measured(t or b"", h) for t, h in zip(texts, hasher.each(texts))]
            values = np.array(rows, np.int64).reshape(len(rows), len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(values[:, i]) for i in range(len(MEASURES)))], ["id", *MEASURES])

    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``fail_bits``: bit ``rule.bit`` is set where the rule fails. A column of that name is replaced."""
    bits: Column = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    """The bits that a policy looks at; an unknown rule is an error."""
    by_name = {r.name: r.bit for r in rules}
    return sum(1 << by_name[name] for name in set(policy.rules))


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether no rule of the policy fails."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablations(kept: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a rule of the policy: documents that fail it, that fail it alone, and that stay if it is left out.

    The ledger is first counted by its bits (at most 2^rules rows), so the answer needs one pass over one column.
    An empty ledger gives zeros.
    """
    whole = mask(policy, rules)
    chosen = [r for r in rules if r.name in policy.rules]
    counted = kept.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))

    def docs_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    sums = []
    for r in chosen:
        own, rest = F.lit(1 << r.bit).cast("long"), F.lit(whole & ~(1 << r.bit)).cast("long")
        sums.append(F.struct(
            F.lit(r.name).alias("rule"),
            docs_where(F.col("bits").bitwiseAND(own) != 0).alias("fails"),
            docs_where(F.col("bits") == own).alias("fails_alone"),
            docs_where(F.col("bits").bitwiseAND(rest) == 0).alias("kept_without"),
        ))
    return counted.agg(F.array(*sums).alias("each")).select(F.inline("each"))


def keep_good(docs: DataFrame, policy: Policy = PRODUCTION_POLICY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the policy, with their own columns and in the same partitions (no shuffle).

    Null and empty texts have no words, so ``few_words`` rejects them; repeated rows share one fate.
    """
    fields = docs.schema.fields
    inner = [f"c{i}" for i in range(len(fields))]
    plain = docs.toDF(*inner)
    at = docs.columns.index(text_col)
    measured = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(inner, fields)), *(T.StructField(m, T.LongType(), False) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            rows = [_measured(t or b"", h) for t, h in zip(texts, hasher.each(texts))]
            values = np.array(rows, np.int64).reshape(len(rows), len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(values[:, i]) for i in range(len(MEASURES)))], [*inner, *MEASURES])

    judged = ledger(plain.mapInArrow(run, measured)).where(passes(policy))
    return judged.select(*(F.col(n).alias(f.name) for n, f in zip(inner, fields)))
