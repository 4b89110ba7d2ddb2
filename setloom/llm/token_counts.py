"""Operator 7, token counts by prefix dynamic programming.

The table keeps, for every text, the exact token count of the prefix that ends at each boundary (a single space
between non-blank characters): the count at a boundary is the count at the one before plus the piece between, as no
match of the pattern crosses it. A prefix that ends inside a piece gets its count by the same recurrence over the
piece's own bytes (see bpe.PrefixCounts), so any prefix, truncation or budget is answered exactly without encoding
the text again: `count_at` and `longest_prefix` read one row and look into one piece. `every_prefix` gives the
dense list, and `write_prefixes` stores it for every text: one signed byte per code point, the change of the count from
one prefix to the next. `counts_of` reads counts and cuts back from that table. Null text counts as empty: 0 tokens. Texts with added tokens' strings or of other kinds of vocabulary
are one piece. Extra columns are not returned.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import slices, stored, texts_of


def boundary_counts(c: bpe.Bpe, text: str) -> tuple[list[int], list[int]]:
    """Ends of the prefixes at boundaries (code points; the last is the whole text) and their token counts."""
    if not text:
        return [], []
    if not c.exact_pattern or any(x in text for x in c.added):
        return [len(text)], [len(c.encode(text)) // c.dtype.itemsize]
    pieces = bpe.pieces_of(text)
    ends = [*accumulate(len(p) + 1 for p in pieces)]
    return [e - 1 for e in ends], [*accumulate(c.piece_counts(pieces))]


def _inside(c: bpe.Bpe, text: str, start: int, end: int) -> np.ndarray:
    """Token counts added by each code point of the piece text[start:end]."""
    changes = c.counts.changes(text) if not start else c.counts.plain(text[start:end])
    return np.cumsum(np.frombuffer(changes, "i1"), dtype="i8")


def count_at(c: bpe.Bpe, text: str, ends: list[int], counts: list[int], n: int) -> int:
    """Exact token count of text[:n]."""
    if n <= 0 or not ends:
        return 0
    i = bisect_right(ends, n) - 1
    if i >= 0 and (ends[i] == n or i == len(ends) - 1):
        return counts[i]
    start, base = (ends[i], counts[i]) if i >= 0 else (0, 0)
    return base + int(_inside(c, text, start, ends[i + 1])[n - start - 1])


def longest_prefix(c: bpe.Bpe, text: str, ends: list[int], counts: list[int], budget: int) -> int:
    """Most code points of a prefix with at most `budget` tokens, cut inside a piece if need be.

    Counts at boundaries never fall; within a piece they can, so the piece after the last fitting boundary is read whole.
    """
    if not ends or counts[-1] <= budget:
        return len(text)
    i = bisect_right(counts, budget) - 1
    start, base = (ends[i], counts[i]) if i >= 0 else (0, 0)
    inside = np.flatnonzero(base + _inside(c, text, start, ends[i + 1]) <= budget)
    return start + (int(inside[-1]) + 1 if len(inside) else 0)


def every_prefix(c: bpe.Bpe, text: str) -> np.ndarray:
    """Token counts of all code-point prefixes, from 1 character up."""
    return np.cumsum(np.frombuffer(c.counts.changes(text), "i1"), dtype="i8")


def count_tokens(docs: DataFrame, path: str, limit: int = 512, keep_table: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit, fit_chars (code points that fit the limit).

    keep_table adds `ends` and `counts`, the table of prefixes at boundaries.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, fit_chars long" + ", ends array<int>, counts array<int>" * keep_table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = bpe.load_json(path)
        for batch in slices(batches):
            texts = texts_of(batch)
            if c.exact_pattern:
                c.learn_counts(texts)
            tables = [boundary_counts(c, x) for x in texts]
            fit = [longest_prefix(c, x, *t, limit) if c.exact_pattern else -1 for x, t in zip(texts, tables)]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array([t[1][-1] if t[1] else 0 for t in tables], pa.int64()), pa.array(fit, pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens", "fit_chars"]
            if keep_table:
                columns += [pa.array([t[0] for t in tables], pa.list_(pa.int32())), pa.array([t[1] for t in tables], pa.list_(pa.int32()))]
                names += ["ends", "counts"]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.select("doc_id", "text").mapInArrow(run, schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def write_prefixes(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, changes of all documents, written to the shared folder: the running sum of changes (signed bytes)
    is the exact token count of each code-point prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = bpe.load_json(path)
        for batch in slices(batches, rows=4096):
            texts = texts_of(batch)
            if c.exact_pattern:
                c.counts.learn(texts)
                made = [c.counts.changes(x) for x in texts]
            else:  # other kinds of vocabulary: the library counts each prefix
                made = [np.diff([0, *(len(c.encode(x[:i])) // c.dtype.itemsize for i in range(1, len(x) + 1))]).astype("i1").tobytes() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "changes"])

    return stored(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, changes binary"), "prefixes")


def counts_of(prefixes: DataFrame, limit: int = 512) -> DataFrame:
    """Per document of a table of write_prefixes: doc_id, n_bytes, n_tokens, fit_chars (code points of the longest prefix that fits the limit), over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text="changes"):
            tokens, fit = [], []
            for raw in batch.column("changes").to_pylist():
                counts = np.cumsum(np.frombuffer(raw, "i1"), dtype="i8")
                inside = np.flatnonzero(counts <= limit)
                tokens.append(int(counts[-1]) if len(counts) else 0)
                fit.append(int(inside[-1]) + 1 if len(inside) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64()), pa.array(fit, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "fit_chars"])

    out = prefixes.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, fit_chars long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
