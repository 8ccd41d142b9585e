"""Column builders for labels, tokens and sentences."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BOM = "\ufeff"
DONT_CARE = "###"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def chars(text: Column | str) -> Column:
    """Array of the characters of a text; empty for an empty text."""
    return F.filter(F.split(_c(text), ""), lambda c: F.length(c) > 0)


def char_class(characters: Iterable[str], negate: bool = False) -> str:
    """Regex class of single characters, each escaped."""
    body = "".join("\\" + c if c in "\\[]^-&~" else c for c in characters)
    if not body:
        return "[\\s\\S]" if negate else "(?!)"
    return f"[^{body}]" if negate else f"[{body}]"


def clean_field(text: Column | str) -> Column:
    """Drop a byte order mark, then outer blanks, then outer double quotes."""
    bare = F.btrim(F.regexp_replace(_c(text), f"^{BOM}", ""), F.lit(" \t\r\n"))
    return F.btrim(bare, F.lit('"'))


def strip_bom(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), f"^{BOM}", "")


def normalise_label(
    text: Column | str,
    vocab: Sequence[str],
    sensitive: bool = True,
    unknown: str | None = "?",
    max_len: int | None = None,
) -> Column:
    """Lower case (optional), characters outside vocab and blanks to ``unknown``, null if too long."""
    label = _c(text) if sensitive else F.lower(_c(text))
    if unknown:
        label = F.regexp_replace(label, char_class([*vocab, " "], negate=True), unknown.replace("$", "\\$"))
    if max_len is None:
        return label
    return F.when(F.length(label) <= max_len, label)


def filter_chars(text: Column | str, vocab: Sequence[str]) -> Column:
    """Only the characters of the vocabulary."""
    return F.regexp_replace(_c(text), char_class(vocab, negate=True), "")


def strip_unknown(text: Column | str, unknown: str = "?") -> Column:
    return F.regexp_replace(_c(text), char_class(unknown) + "+", "")


def has_char_of(text: Column | str, characters: Sequence[str]) -> Column:
    """At least one character of the set occurs."""
    return _c(text).rlike(char_class(characters))


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """0 when either is empty, else 1 - edit distance / longer length."""
    left, right = _c(a), _c(b)
    longest = F.greatest(F.length(left), F.length(right))
    return F.when((F.length(left) == 0) | (F.length(right) == 0), F.lit(0.0)).otherwise(
        F.lit(1.0) - F.levenshtein(left, right) / longest
    )


def word_tokenize(text: Column | str) -> Column:
    """Runs of letters, digits and underscores, and every other non-blank character alone."""
    return F.regexp_extract_all(_c(text), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), 0)


_HELD = "\ue000"  # private-use character that stands for a protected full stop


def _hold_inside(line: Column, opening: str, closing: str) -> Column:
    """Hold back the full stops from each opening bracket to the next closing one."""

    def hold(piece: Column) -> Column:
        at = F.instr(piece, F.lit(opening))
        inside = F.replace(F.substring(piece, at, F.length(piece)), F.lit("。"), F.lit(_HELD))
        held = F.concat(F.substring(piece, F.lit(1), at - 1), inside)
        return F.when(piece.endswith(closing) & (at > 0), held).otherwise(piece)

    return F.array_join(F.transform(F.split(line, f"(?<={closing})"), hold), "")


def sentence_split_ja(text: Column | str) -> Column:
    """Sentences after each full stop or line break; full stops inside brackets do not split."""

    def sentences(line: Column) -> Column:
        held = _hold_inside(_hold_inside(line, "（", "）"), "「", "」")
        return F.split(F.replace(F.regexp_replace(held, "\\s+$", ""), F.lit("。"), F.lit("。\n")), "\n")

    parts = F.flatten(F.transform(F.split(_c(text), "\n"), sentences))
    return F.transform(
        F.filter(parts, lambda s: F.length(s) > 0), lambda s: F.replace(s, F.lit(_HELD), F.lit("。"))
    )


def swap_group_chars(text: Column | str, groups: dict[str, Sequence[str]], draw) -> Column:
    """Replace each grouped character by ``members[draw(position, n)]``; others stay."""
    keys = [k for k in groups if k]
    if not keys:
        return _c(text)
    table = F.create_map(*[v for k in keys for v in (F.lit(k), F.array(*[F.lit(m) for m in groups[k]]))])

    def swap(c: Column, i: Column) -> Column:
        members = F.try_element_at(table, c)
        pick = draw(i, F.size(members)).cast("int")
        return F.when(members.isNull(), c).otherwise(F.get(members, pick))

    return F.array_join(F.transform(chars(text), swap), "")


def format_key(number: Column | str, kind: str = "image") -> Column:
    return F.format_string(kind + "-%09d", _c(number).cast("long"))


def json_label(label: Column | str, schema) -> Column:
    return F.from_json(_c(label), schema)
