"""Operator 8, chat formatting with prefix-target expansion.

A turn is written <|role|>text</s>. In roles and texts "\\", "<", "[" and "|" are followed by an added backslash, so no
control string of the template (or of others: <s>, [INST]) can come from a text, and `unescape` restores it.
Each assistant turn is one example: its context is the formatted conversation up to the reply, its target the reply's
text, the only trainable span. Each example is written with its target and mask as a row, and with its whole context as
rows, one for each chunk of the conversation that the context reaches into, so that no row is as long as a conversation. Turns come in order of turn, then role and text. Null texts and roles are empty;
rows with a null conv_id are one conversation. Conversations are streamed turn by turn, a row holds at most TURNS turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, stored

TURNS = 64
END = "</s>"
FORMATTED = "conv_id long, chunk long, start long, formatted string, reply_starts array<long>, reply_ends array<long>, first long"
_PLAIN, _ESCAPED = re.compile(r"[\\<\[|]"), re.compile(r"([\\<\[|])\\")
_TURN = re.compile(r"<\|(.*?)\|>(.*?)</s>", re.S)


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _dealt(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition(shuffle_partitions(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Rows of FORMATTED from turns(conv_id, turn, role, text); offsets count code points from the conversation's start, `first` the replies before the chunk."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, chunk, start, parts, at, spans, first = None, 0, 0, [], 0, [], 0
        fresh = True

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([chunk], pa.int64()), pa.array([start], pa.int64()), pa.array(["".join(parts)], pa.string()), pa.array([[i for i, _ in spans]], pa.list_(pa.int64())), pa.array([[j for _, j in spans]], pa.list_(pa.int64())), pa.array([first], pa.int64())],
                ["conv_id", "chunk", "start", "formatted", "reply_starts", "reply_ends", "first"],
            )

        for batch in slices(batches):
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if not fresh and c != conv or len(parts) >= TURNS * 3:
                    yield closed()
                    chunk, start, parts, spans, first = (0, 0, [], [], 0) if c != conv else (chunk + 1, at, [], [], first + len(spans))
                    at = start
                conv, fresh = c, False
                head, body = f"<|{escape(role)}|>", escape(text)
                if role == "assistant":
                    spans.append((at + len(head), at + len(head) + len(body)))
                parts += [head, body, END]
                at += len(head) + len(body) + len(END)
        if parts:
            yield closed()

    return _dealt(rows, "turn", "role", "text").mapInArrow(run, FORMATTED)


def example_rows(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example, chunk, target (as formatted), train_start, train_end.

    The context is the conversation's formatted text up to train_start: all of the chunks before `chunk`, and that one
    up to there. The loss mask is the span from train_start to train_end.
    """
    spans = F.arrays_zip(F.col("reply_starts").alias("a"), F.col("reply_ends").alias("b"))
    rows = formatted.select("conv_id", "chunk", "start", "formatted", "first", F.posexplode(spans).alias("i", "s"))
    rows = rows.select("conv_id", (F.col("first") + F.col("i")).alias("example"), "chunk", "start", "formatted", F.col("s")["a"].alias("train_start"), F.col("s")["b"].alias("train_end"))
    return rows.select("conv_id", "example", "chunk", F.expr("substring(formatted, int(train_start - start) + 1, int(train_end - train_start))").alias("target"), "train_start", "train_end")


def write_examples(formatted: DataFrame) -> DataFrame:
    return stored(example_rows(formatted), "examples", "zstd")


def context_parts(formatted: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, example, part, text of rows as by example_rows: a context's parts in order, one for each chunk it reaches into."""
    chunks = formatted.select(F.col("conv_id").alias("conv"), F.col("chunk").alias("part"), "start", "formatted").hint("merge")  # never whole through the driver
    met = rows.join(chunks, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") <= F.col("chunk")))
    text = F.when(F.col("part") < F.col("chunk"), F.col("formatted")).otherwise(F.expr("substring(formatted, 1, int(train_start - start))"))
    return met.select("conv_id", "example", "part", text.alias("text"))


def write_contexts(formatted: DataFrame, rows: DataFrame) -> DataFrame:
    """`context_parts` of all examples, written: the prefix of every reply in full."""
    return stored(context_parts(formatted, rows), "contexts", "zstd")  # an example repeats the one before it


def context_chars(contexts: DataFrame) -> DataFrame:
    """Per conversation the code points of its examples' contexts, as read back."""
    return contexts.groupBy("conv_id").agg(F.sum(F.length("text").cast("long")).alias("context_chars"))


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example, context (all formatted text before the reply), target, trainable span.

    Contexts repeat earlier turns by definition; use example_rows and context_parts where that is too much for a row.
    """
    rows = example_rows(formatted)
    parts = context_parts(formatted, rows).groupBy("conv_id", "example").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("x"))
    whole = parts.select(F.col("conv_id").alias("conv"), F.col("example").alias("number"), F.array_join("x.text", "").alias("context"))
    met = rows.join(whole, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("example") == F.col("number")))
    return met.select("conv_id", "example", "context", "target", "train_start", "train_end")


def digests(formatted: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Per conversation n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples.

    Turns are read back from the formatted chunks that contexts refer to, what the loss covers from the written example rows.
    """
    rows = write_examples(formatted) if rows is None else rows
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, s, out = None, None, []

        def fresh() -> dict:
            return {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "chars": 0, "loss_chars": 0, "examples": 0}

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

        def closed() -> tuple:
            return conv, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["examples"]

        for batch in slices(batches, text="text"):
            for row in batch.to_pylist():
                if s is None or row["conv_id"] != conv:
                    if s is not None:
                        out.append(closed())
                    conv, s = row["conv_id"], fresh()
                if row["example"] is not None:
                    reply = unescape(row["text"])
                    s["loss"].update(reply.encode())
                    s["loss_chars"] += len(reply)
                    s["examples"] += 1
                    continue
                for role, body in _TURN.findall(row["text"]):
                    s["turns"].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                    s["n"] += 1
                s["chars"] += len(row["text"])
            if len(out) >= 1000:
                yield rows_of(out)
                out = []
        if s is not None:
            out.append(closed())
        if out:
            yield rows_of(out)

    chunks = formatted.select("conv_id", "chunk", F.lit(None).cast("long").alias("example"), F.col("formatted").alias("text"))
    both = chunks.unionByName(rows.select("conv_id", "chunk", "example", F.col("target").alias("text")))
    return _dealt(both, "chunk", "example").mapInArrow(run, schema)


def write_formatted(turns: DataFrame) -> DataFrame:
    return stored(format_conversations(turns), "chat", "zstd")
