"""Chat formatting from an event log.

Events (conversation, sequence, message, kind, role, text) are folded per message: ``message``, ``edit``
and ``regenerate`` set the text, ``delta`` appends to it.  A conversation's messages follow each other by
their first sequence number, and are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and
texts every run of bars after ``<`` is one bar longer, so that no control string can occur in them; taking
the bar away restores them.  In roles, backslash and line feed are escaped as well.

Folding deals by (conversation, message), so a conversation that holds a third of all events is spread.
The output is one row per rendered turn with its place, from which a conversation is read in order.
A digest over a whole conversation is sequential; it streams through one task with bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
#: What identifies a message made from a table's row.
MESSAGE = ("content", "copy")


def fold_events(events: DataFrame, message: Sequence[str] = ("message",)) -> DataFrame:
    """(``conv``, ``seq``, ``message``, ``role``, ``text``) of the final messages.

    ``message`` names the columns that identify a message of a conversation.
    Events are ordered by sequence number (null first), then kind and text.  Identical events count once,
    as a log may deliver an event again.  Null texts are empty; a message's role is the first that is not
    null, else empty; deltas before any setting event build on an empty text.  Events whose kind is not
    one of the four are ignored.  Only the latest version's events reach the concatenation.
    """
    e = events.select("conv", "seq", *message, "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    e = e.filter(F.col("kind").isin("message", "edit", "regenerate", "delta"))
    order = F.struct(F.col("seq").alias("seq"), (F.col("kind") == "delta").alias("late"), F.col("text").alias("text"))
    whole = (
        e.groupBy("conv", *message)
        .agg(
            F.array_sort(F.collect_set(order)).alias("all"),
            F.max(F.when(F.col("kind") != "delta", F.struct(order.alias("o")))).alias("reset"),
            F.min("seq").alias("seq"), F.max(F.col("seq").isNull()).alias("unplaced"),
            F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        )
    )
    # array_sort puts nulls last inside structs; sort_array puts them first, as asked for.
    live = F.filter(
        F.sort_array("all"),
        lambda x: F.col("reset").isNull() | (x >= F.col("reset.o")) & (x["late"] | (x == F.col("reset.o"))),
    )
    return whole.select(
        "conv", F.when(~F.col("unplaced"), F.col("seq")).alias("seq"),
        (F.struct(*message) if len(message) > 1 else F.col(message[0])).alias("message"),
        F.coalesce("role.role", F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"),
    )


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\|+)", r"<$1|")


def render(messages: DataFrame, learned: str = LEARNED) -> DataFrame:
    """(``conv``, ``seq``, ``message``, ``piece``, ``mask_start``, ``mask_chars``) per turn.

    The concatenation of a conversation's pieces by (seq, message) is its formatted text; the mask covers
    the escaped text of each turn of the learned role, in code points of the piece, and nothing else.
    """
    role = F.replace(F.replace(F.col("role"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), _escaped(role), F.lit("\n"))
    body = _escaped(F.col("text"))
    return messages.select(
        "conv", "seq", "message", F.concat(head, body, F.lit(END + "\n")).alias("piece"),
        F.length(head).alias("mask_start"),
        F.when(F.col("role") == learned, F.length(body)).otherwise(0).alias("mask_chars"),
    )


_BARS = re.compile(r"<(\|+)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
_ROLE = re.compile(r"\\(.)")


def unescape(text: str) -> str:
    return _BARS.sub(r"<\1", text)


def parse_piece(piece: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    at, out = 0, []
    while at < len(piece):
        m = _TURN.match(piece, at)
        if m is None:
            raise ValueError("not a formatted turn")
        role = _ROLE.sub(lambda x: "\n" if x[1] == "n" else x[1], unescape(m[1]))
        out.append((role, unescape(m[2])))
        at = m.end()
    return out


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, piece: str, start: int, length: int) -> None:
        for role, text in parse_piece(piece):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        learned = unescape(piece[start:start + length])
        self.loss.update(learned.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(learned)
        self.chars += len(piece)

    def row(self) -> list:
        return [self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars]


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of every conversation, parsed from the formatted text and its mask.

    Conversations stream through sorted partitions; nothing but one piece and the running digests is held.
    """
    kind = pieces.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, keys, rows = None, None, [], []
        like = None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, like), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            like = b.column(0).type
            for conv, piece, start, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        keys.append(now)
                        rows.append(digest.row())
                    now, digest = conv, _Digest()
                digest.add(piece, start, length)
            if len(keys) > 5_000:
                yield flush()
                keys, rows = [], []
        if digest is not None:
            keys.append(now)
            rows.append(digest.row())
        if keys:
            yield flush()

    ordered = pieces.repartition("conv").sortWithinPartitions("conv", "seq", "message")
    return ordered.select("conv", "piece", "mask_start", "mask_chars").mapInArrow(
        run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Event log of a table of finished turns: a learned turn arrives as an opening and one delta.

    Every row is a message of its own, repeated rows too (``MESSAGE``: role, beginning of the text and turn,
    and a number in the order of the whole texts); rows with one turn number follow each other by role and text.  Numbering and folding share
    one exchange of the texts.
    """
    from pyspark.sql.window import Window

    base = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("seq"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.struct("role", F.substring("text", 1, 64).alias("head"), "seq")
    base = base.withColumn("content", key)
    base = base.withColumn("copy", F.row_number().over(Window.partitionBy("conv", "content").orderBy("text")))
    opening = F.struct(F.lit("message").alias("kind"), F.lit("").alias("text"))
    delta = F.struct(F.lit("delta").alias("kind"), F.col("text").alias("text"))
    whole = F.struct(F.lit("message").alias("kind"), F.col("text").alias("text"))
    events = F.when(F.col("role") == LEARNED, F.array(opening, delta)).otherwise(F.array(whole))
    return base.select("conv", "seq", *MESSAGE, "role", F.explode(events).alias("e")).select(
        "conv", "seq", *MESSAGE, "role", "e.kind", "e.text")
