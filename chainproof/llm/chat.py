r"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: all turns before it are context, and its reply
alone is trainable. A context is a prefix of the conversation's formatted text, so the examples
of one conversation share that text: ``expand`` returns a row for each turn with its formatted
``segment`` and, on assistant turns, the spans of the example in code points of the conversation's
text. The output stays in proportion to the input, however long a conversation is;
``render`` writes out whole examples where a trainer wants them.

Template: ``<|turn|>ROLE<|text|>TEXT<|end|>\n``. Control strings inside a role or a text (this
template's and those of other common ones) get a backslash after their first character, and those
that have backslashes there get one more, so that ``unescape`` gives the text back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chainproof.llm.common import sliced

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: What makes a control string after its first character, "<" or "[", and any backslashes.
_AFTER = r"\||/?s>|/?INST\]|</?SYS>>|/?SYS>>"
_ESCAPE = rf"([<\[])(\\*)({_AFTER})"
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_AFTER})")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPE, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def expand(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """A row for each turn: conv_id, turn, position (long, from 0), segment, start and end (code
    points of the conversation's formatted text), and for examples, else null, example (long,
    from 0), context_end, loss_start, loss_end: context is [0, context_end), the trainable reply,
    escaped, is [loss_start, loss_end).

    Null roles and texts count as empty. Turns with a null conversation form one conversation,
    null turn numbers come first, and rows that tie or repeat are turns each, in order of role
    and text. An empty table gives no rows. Other columns are ignored.
    """
    c = lambda n: F.col(f"`{n}`")
    rows = turns.select(c(conv).alias("conv_id"), c(turn).alias("turn"), F.coalesce(c(role), F.lit("")).alias("role"), F.coalesce(c(text), F.lit("")).alias("text"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = rows.withColumns({"head": F.length(head), "body": escape(F.col("text")), "reply": (F.col("role") == target).cast("long")})
    rows = rows.withColumn("segment", F.concat(head, "body", F.lit(END)))
    so_far = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)  # running sums: a row at a time
    rows = rows.withColumns({"position": F.count(F.lit(1)).over(so_far) - 1, "end": F.sum(F.length("segment").cast("long")).over(so_far), "replies": F.sum("reply").over(so_far)})
    start = F.col("end") - F.length("segment")
    mine = lambda x: F.when(F.col("reply") == 1, x)
    return rows.select(
        "conv_id", "turn", "position", "segment", start.alias("start"), "end",
        mine(F.col("replies") - 1).alias("example"), mine(start).alias("context_end"),
        mine(start + F.col("head")).alias("loss_start"), mine(start + F.col("head") + F.length("body")).alias("loss_end"),
    )


def render(expanded: DataFrame) -> DataFrame:
    """Whole examples of an ``expand`` result: conv_id, example, text, loss_start, loss_end. Long
    conversations repeat their prefix in each example, so render what is trained on now."""
    e = expanded.where("example is not null").select("conv_id", "example", "loss_start", "loss_end", F.col("position").alias("last"))
    parts = expanded.select(F.col("conv_id").alias("c"), "position", "segment")
    rows = e.join(parts, e["conv_id"].eqNullSafe(parts["c"]) & (F.col("position") <= F.col("last")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "segment"))), lambda x: x["segment"]), "")
    return rows.groupBy("conv_id", "example", "loss_start", "loss_end").agg(text.alias("text")).select("conv_id", "example", "text", "loss_start", "loss_end")


class _Reader:
    """Reads one conversation back from its examples: each has to come next, with all text before it,
    and nothing else, as its context; its reply is cut out by its spans."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.examples, self.chars = conv, 0, 0, 0
        self.all, self.loss, self.loss_chars = hashlib.sha256(), hashlib.sha256(), 0

    def take(self, segment: str, example: int | None, context_end: int | None, a: int | None, b: int | None) -> None:
        head, _, body = segment[len(TURN) :].partition(TEXT)
        self.turns += 1
        self.all.update(f"{unescape(head)}\n{unescape(body[: -len(END)])}\n".encode())
        if example is not None:
            if example != self.examples or context_end != self.chars:
                raise ValueError(f"example {example} of conversation {self.conv} has {context_end} characters of context, after {self.examples} examples and {self.chars} characters")
            reply = unescape(segment[a - context_end : b - context_end])
            self.examples += 1
            self.loss_chars += len(reply)
            self.loss.update(reply.encode())
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(expanded: DataFrame) -> DataFrame:
    """Reads the examples of each conversation again, a segment at a time, and checks that they are
    numbered without gaps and that each one's context is the whole text before it: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. Raises where they are not."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Reader | None = None
        for batch in sliced(batches, "segment"):
            done: list[tuple] = []
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "segment", "example", "context_end", "loss_start", "loss_end")]
            for conv, *turn in zip(*columns, strict=True):
                if own is None or own.conv != conv:
                    if own is not None:
                        done.append(own.row())
                    own = _Reader(conv)
                own.take(*turn)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=arrow)
        if own is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, own.row(), strict=True))], schema=arrow)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    arrow = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names])
    rows = expanded.select(F.col("conv_id").cast("long").alias("conv_id"), "position", "segment", "example", "context_end", "loss_start", "loss_end")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(read, schema)
