"""Chat transcripts from event logs, rendered with a loss mask and read back.

An event is (conversation, sequence number, turn, kind, role, text). ``open`` starts a turn with a role, ``delta`` adds
text to it, ``edit`` replaces its text, ``regenerate`` empties it and drops every later turn opened before, ``drop`` takes it out.
The log is partitioned by conversation and sorted by turn and sequence: the same fold as by sequence alone, with one message in
memory instead of a conversation. A conversation is written as segments, one a message, each with its own mask, so a conversation
of any length streams through its task and never becomes one cell.

Template: ``<turn role>\\n``, the text, ``</turn>\\n``. A backslash goes before every backslash, ``<`` and ``#`` of a text, so no
text can contain a mark of this template, or of templates with ``###`` headings, and taking it away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ESCAPE = re.compile(r"[\\<#]")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_OPEN = re.compile(r"<turn ((?:[^\\>\n]|\\[\\>nN])*)>\n")
_ROLE = {"\\": "\\\\", ">": "\\>", "\n": "\\n"}
_CLOSE = "</turn>\n"
_NO_ROLE = "\\N"
LOSS_ROLE = "assistant"
PIECES = 4


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m.group(1), text)


def render(role: str | None, text: str) -> tuple[str, int, int]:
    """A message's segment, and where its text starts and ends in it. A null role has a mark of its own."""
    name = _NO_ROLE if role is None else "".join(_ROLE.get(c, c) for c in role)
    head = f"<turn {name}>\n"
    body = escape(text)
    return f"{head}{body}{_CLOSE}", len(head), len(head) + len(body)


def parse(segment: str) -> tuple[str | None, str]:
    """Role and text of a segment; anything but one whole turn is an error."""
    head = _OPEN.match(segment)
    if not head or not segment.endswith(_CLOSE):
        raise ValueError("not a turn")
    body = segment[head.end() : -len(_CLOSE)]
    if re.search(r"[<#]", re.sub(r"\\.", "", body, flags=re.DOTALL)):
        raise ValueError("a bare mark inside a text")
    name = head.group(1)
    if name == _NO_ROLE:
        return None, unescape(body)
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), name), unescape(body)


def events_of_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A log with one ``open`` and one ``delta`` for each row of a table of whole turns.

    Rows of one turn number are turns of their own, in a repeatable order (by a digest of role and text); a null turn comes first.
    """
    base = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    both = F.array(
        F.struct(F.lit(0).cast("long").alias("seq"), F.lit("open").alias("kind"), F.lit("").alias("added")),
        F.struct(F.lit(1).cast("long").alias("seq"), F.lit("delta").alias("kind"), F.col("text").alias("added")),
    )
    # ``tie`` and the role order the rows of a repeated turn number; ``copy`` keeps the two events of each of several equal rows together.
    tied = base.withColumn("tie", F.sha2(F.concat_ws("\x00", F.coalesce("role", F.lit("")), "text").cast("binary"), 256)).withColumn("copy", F.monotonically_increasing_id())
    return tied.select("conv", "turn", "role", "tie", "copy", F.inline(both)).select("conv", "turn", "tie", "copy", "seq", "kind", "role", F.col("added").alias("text"))


def log_of_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A log as a chat service would have kept it while these turns came about, for ``segments`` to fold back into them.

    Every text is streamed in up to ``PIECES`` deltas. A ``LOSS_ROLE`` answer is a regenerated one: half of its text was streamed
    first, and somebody had already answered that draft. A user's message was edited after it was sent, and a further
    message after it was taken back. Turns stand by number, null first, then by role (null first) and text; rows of one number
    are turns of their own, equal rows too, and a null text is empty. Sequence numbers grow with the turns of a conversation; turn
    numbers in the log are even for turns that stay, odd for those that the fold must undo. Other columns are not read. An
    empty table gives no events.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), body.alias("text"))
    place = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "text")
    numbered = base.withColumn("n", F.row_number().over(place).cast("long"))
    width = F.greatest(F.ceil(F.length("text") / PIECES), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(F.col("text"), i * F.col("width") + 1, F.col("width")))

    def event(kind: str, text=None, role=None, after: int = 0) -> Column:
        """``after`` 1 is the turn behind this one."""
        none = F.lit(None).cast("string")
        return F.struct((2 * F.col("n") + after).alias("turn"), F.lit(kind).alias("kind"), (none if role is None else role).alias("role"), (none if text is None else text).alias("text"))

    streamed = F.transform("pieces", lambda piece: event("delta", piece))
    opened = F.array(event("open", role=F.col("role")))
    draft = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    redone = F.concat(opened, F.array(event("delta", draft), event("open", F.lit("to the draft"), F.lit("user"), 1), event("regenerate")), streamed)
    edited = F.concat(opened, F.array(event("delta", F.lit("as sent")), event("edit", F.lit(""))), streamed, F.array(event("open", F.lit("taken back"), F.lit("user"), 1), event("drop", after=1)))
    events = F.when(F.col("role") == LOSS_ROLE, redone).when(F.col("role") == "user", edited).otherwise(F.concat(opened, streamed))
    listed = numbered.withColumn("width", width).withColumn("pieces", F.filter(pieces, lambda piece: piece != "")).select("conv", "n", F.posexplode(events))
    return listed.select("conv", (F.col("n") * 16 + F.col("pos")).alias("seq"), "col.turn", "col.kind", "col.role", "col.text")


class _Fold:
    """One turn as its events arrive in order."""

    def __init__(self):
        self.role, self.parts, self.opened, self.live = None, [], None, False

    def apply(self, event: dict) -> None:
        kind, text = event["kind"], event["text"] or ""
        if kind == "open":
            self.role, self.parts, self.opened, self.live = event["role"], [text] if text else [], event["seq"], True
        elif kind == "delta":
            self.parts.append(text)
        elif kind == "edit":
            self.parts = [text]
        elif kind == "regenerate":
            self.parts = []
        elif kind == "drop":
            self.live = False
        else:
            raise ValueError(f"unknown event {kind!r}")


def segments(events: DataFrame, folds: bool = True) -> DataFrame:
    """Rows (conv, number, segment, start, end, masked), sorted by conversation and number within their partition.

    ``start`` and ``end`` bound the text in the segment, ``masked`` tells whether it counts for the loss. ``folds`` False means the
    log is made of whole turns, which may share a turn number (see ``events_of_turns``).
    """
    columns = ["conv", "turn", *([] if folds else ["tie", "role", "copy"]), "seq"]
    chosen = events.select(*dict.fromkeys([*columns, "kind", "role", "text"]))
    kind = chosen.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turn, fold, number, cut, latest = (), (), None, 0, None, None
        out, size, conv_type = [], 0, None

        def done() -> None:
            nonlocal number, size
            if fold is not None and fold.live and (cut is None or fold.opened > cut):
                segment, start, end = render(fold.role, "".join(fold.parts))
                out.append((conv[0], number, segment, start, end, fold.role == LOSS_ROLE))
                number, size = number + 1, size + len(segment)

        def batch_of() -> pa.RecordBatch:
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["conv", "number", "segment", "start", "end", "masked"])

        for batch in batches:
            conv_type = batch["conv"].type
            for event in batch.to_pylist():
                here = (event["conv"],)
                if here != conv:
                    done()
                    conv, turn, fold, number, cut, latest = here, (), None, 0, None, None
                # A whole turn's ``open`` starts a new message even under the same number.
                if (event["turn"],) != turn or (not folds and event["kind"] == "open"):
                    done()
                    turn, fold = (event["turn"],), _Fold()
                    cut = latest
                fold.apply(event)
                if event["kind"] == "regenerate":
                    latest = event["seq"] if latest is None else max(latest, event["seq"])
                if size > 4_000_000:
                    yield batch_of()
                    out, size = [], 0
        done()
        if out:
            yield batch_of()

    sorted_log = chosen.repartition("conv").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in columns))
    return sorted_log.mapInArrow(run, f"conv {kind}, number long, segment string, start long, end long, masked boolean")


def digests(rendered: DataFrame) -> DataFrame:
    """Rows (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the segments.

    ``rendered`` must come straight from ``segments``: digests run along its order, one segment in memory. A conversation all of
    whose turns were dropped has no row.
    """
    kind = rendered.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out, conv_type = (), None, [], None

        def batch_of() -> pa.RecordBatch:
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def done() -> None:
            if state:
                out.append((conv[0], state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

        for batch in batches:
            conv_type = batch["conv"].type
            for row in batch.to_pylist():
                if (row["conv"],) != conv:
                    done()
                    conv, state = (row["conv"],), {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                role, text = parse(row["segment"])
                state["turns"] += 1
                state["chars"] += len(row["segment"])
                state["all"].update(f"{role or ''}\n{text}\n".encode())
                if row["masked"]:
                    masked = unescape(row["segment"][row["start"] : row["end"]])
                    state["loss_chars"] += len(masked)
                    state["loss"].update(masked.encode())
            if len(out) >= 10_000:
                yield batch_of()
                out = []
        done()
        if out:
            yield batch_of()

    return rendered.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
