r"""Chat formatting by prefix-target expansion (operator 3).

Each conversation becomes a formatted stream, one *piece* per turn::

    <|start|>role<|text|>text<|end|>\n

Inside roles and texts every ``<``, ``[``, ``|`` and ``\`` is followed by one more
``\``.  So no control string - this template's, ``</s>``, ``[INST]`` or any other
that begins with one of these - can appear in what a user wrote, and dropping that
``\`` gives the text back.

Every assistant turn is exploded into its own example: all preceding turns are its
context and only its reply is trainable.  An example is a range of its conversation's
stream - it begins at 0, ends with the assistant's piece, and its loss mask is the
reply's range - so that a conversation of n turns takes n pieces and not n squared;
``example_texts`` writes chosen examples out in full.

Pieces are made in a stream of turns sorted by conversation and turn, and read back in
a stream in which each example follows the piece that it ends with: its context must be
all that was read before, and its reply is read from its own loss range.  Memory holds
one piece and the running digests, however long a conversation is.

Defined cases: a null text or role is empty; a null conversation id is a conversation
of its own; null turns come last, and equal turns are ordered by role and text;
conversations without an assistant have pieces but no example; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>\n"
ASSISTANT = "assistant"
_UNSAFE = re.compile(r"[<\[|\\]")
_ESCAPED = re.compile(r"([<\[|\\])\\")
_PIECE = re.compile(r"<\|start\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.DOTALL)
PIECES = "seq long, piece string, start long, stop long, loss_start long, loss_stop long"


def escape(text: str) -> str:
    return _UNSAFE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns (id, role, text) in order -> pieces with their places in the stream."""
    now, seq, at = object(), 0, 0
    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if conv != now:
                now, seq, at = conv, 0, 0
            head = START + escape(role) + TEXT
            body = escape(text)
            lo, stop = at + len(head), at + len(head) + len(body) + len(END)
            loss = (lo, lo + len(body)) if role == ASSISTANT else (None, None)
            rows.append((seq, head + body + END, at, stop, *loss))
            seq, at = seq + 1, stop
        if rows:
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["conv_id", "seq", "piece", "start", "stop", "loss_start", "loss_stop"])


def _text(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def format_pieces(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``conv_id, seq, piece, start, stop, loss_start, loss_stop``: a row per turn;
    places are code points in the conversation's stream, and the loss range (null
    for others than assistants) is the example that this turn closes."""
    rows = conversations.select(F.col(id_col).alias("conv_id"), "turn", _text("role"), _text("text"))
    rows = rows.repartition(partitions(rows), "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "text")
    kind = conversations.schema[id_col].dataType.simpleString()
    return rows.select("conv_id", "role", "text").mapInArrow(_format, f"conv_id {kind}, {PIECES}")


def explode_examples(pieces: DataFrame) -> DataFrame:
    """A row per assistant turn: its context is the stream up to ``context_stop``
    (``context_turns`` pieces), the example ends at ``stop``, and only
    ``loss_start``..``loss_stop`` is trainable."""
    closing = pieces.where("loss_start is not null")
    return closing.select("conv_id", F.col("seq").alias("target"), F.col("seq").alias("context_turns"), F.col("start").alias("context_stop"), "stop", "loss_start", "loss_stop")


def example_texts(examples: DataFrame, pieces: DataFrame) -> DataFrame:
    """``examples`` with their whole ``text``: for chosen examples, since a
    conversation's examples together are as long as its turns are many times over."""
    parts = pieces.select("conv_id", "seq", "piece")
    joined = examples.join(parts, "conv_id").where(F.col("seq") <= F.col("target"))
    texts = joined.groupBy("conv_id", "target").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("held"))
    texts = texts.select("conv_id", "target", F.array_join(F.transform("held", lambda x: x["piece"]), "").alias("text"))
    return examples.join(texts, ["conv_id", "target"])


class _Stream:
    """One conversation's stream, read piece by piece and example by example."""

    def __init__(self, conv):
        self.conv, self.turns, self.at = conv, 0, 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()
        self.chars = self.examples = self.written = 0
        self.last = None  # the last piece, its place and its text's span

    def refuse(self, what: str) -> None:
        raise ValueError(f"conversation {self.conv}: {what}")

    def piece(self, piece: str, start: int, stop: int) -> None:
        found = _PIECE.fullmatch(piece)
        if not found or start != self.at or stop - start != len(piece):
            self.refuse(f"the stream breaks at {start}")
        role, text = unescape(found[1]), unescape(found[2])
        self.whole.update(f"{role}\n{text}\n".encode())
        self.last = piece, start, found.span(2), role
        self.turns, self.at = self.turns + 1, stop

    def example(self, target: int, context_turns: int, context_stop: int, stop: int, lo: int, hi: int) -> None:
        """An example that ends with the last piece: all before it is its context."""
        piece, start, span, role = self.last or ("", -1, None, None)
        if (target, context_turns) != (self.turns - 1, self.turns - 1) or (context_stop, stop) != (start, self.at) or role != ASSISTANT:
            self.refuse(f"the example of turn {target} has another context")
        if (lo - start, hi - start) != span:
            self.refuse(f"the loss mask at {lo} is not a reply")
        reply = unescape(piece[lo - start : hi - start])
        self.chars += len(reply)
        self.loss.update(reply.encode())
        self.examples, self.written = self.examples + 1, self.written + stop

    def row(self) -> tuple:
        return (self.conv, self.turns, self.whole.hexdigest(), self.chars, self.loss.hexdigest(), self.at, self.examples, self.written)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces and examples in order -> what each conversation's stream says."""
    state, rows, kind = None, [], None
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, piece, start, stop, *example in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if state is None or conv != state.conv:
                if state is not None:
                    rows.append(state.row())
                state = _Stream(conv)
            if piece is not None:
                state.piece(piece, start, stop)
            else:
                target, context_turns, lo, hi = example
                state.example(target, context_turns, start, stop, lo, hi)
        if len(rows) >= 1000:
            yield _read_out(rows, kind)
            rows = []
    if state is not None:
        rows.append(state.row())
    if rows:
        yield _read_out(rows, kind)


_READ = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "example_chars"]


def _read_out(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_READ)


def read_back(pieces: DataFrame, examples: DataFrame) -> DataFrame:
    """Per conversation: turns and their digest, the text under all its examples'
    loss masks, ``formatted_chars`` of its stream, and ``example_chars``, the length
    of its examples written out.  Refuses streams that break, and examples whose
    context is not all that comes before their reply."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    none = [F.lit(None).cast("long").alias(c) for c in ("target", "context_turns", "loss_start", "loss_stop")]
    rows = pieces.select("conv_id", "piece", "start", "stop", *none)
    rows = rows.union(examples.select("conv_id", F.lit(None).cast("string"), "context_stop", "stop", "target", "context_turns", "loss_start", "loss_stop"))
    # An example begins its reply's piece where that piece begins, and comes after it.
    rows = rows.repartition(partitions(rows), "conv_id").sortWithinPartitions("conv_id", "start", F.asc_nulls_first("target"))
    return rows.mapInArrow(_read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long")


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts are made of other templates' control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, ASSISTANT, text)], "conv_id long, turn long, role string, text string")
