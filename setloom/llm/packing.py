"""Operator 10, lexical retrieval packing.

Documents become ids plus an end id. Document frequencies, document count and mean length cover the whole table.
Documents are ordered by their heaviest terms (three of a 16-bit vocabulary), so lexically close ones meet, and dealt into ranges; runs of
SHARD documents of a range are the shards of the BM25 inverted index, with the corpus-wide statistics. In a shard each
window is filled from a seed document on: BM25 returns the seed's unused neighbours, best first, and they fill the
window; the one that is cut continues the next window as its seed. What is left at a shard's end is cut into powers
of two, which need no padding. Every id lies in one piece.

Null and empty texts are the end id alone. Equal doc_ids are packed as separate documents, null doc_ids as well. Empty
tables give no rows. Of equal weights the smaller term counts, of equal scores the document that comes first in the
shard. A document longer than a window fills several. A shard ends at SHARD_IDS ids, so very long texts make shards of
few documents. Extra columns are not returned.
"""

from __future__ import annotations

import gc
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import forget, range_bounds, range_bucket, shuffle_partitions, slices, stored, texts_of

LENGTH = 1024
SHARD = 512
SHARD_IDS = 4 << 20
#: Pieces that a worker keeps while it encodes.
MEMO = 400_000
#: A term is kept densely if one document in DENSE of a shard has it.
DENSE = 16
K1, B = 1.2, 0.75
#: Bits of a document's place in the order that its doc_id gives; the others are its heaviest terms.
HASH = 15
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def release() -> None:
    """Drop the pieces that a worker keeps from encoding: the steps after it need none, and the memory is theirs."""
    if bpe.load_json.cache_info().currsize:
        bpe.load_json.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian); and, with a null `ids`, a row per task with its sums: df of each term, documents, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = bpe.load_json(tokenizer)
        c.memo = MEMO
        end = np.array([end_id], c.dtype).tobytes()
        size = c.tokenizer.get_vocab_size()
        df, n, total = np.zeros(size, "i8"), 0, 0
        for batch in slices(batches, rows=8192, size=3 << 20):
            made = [x + end for x in c.encode_many(texts_of(batch))]
            ids = [np.frombuffer(x, c.dtype) for x in made]
            df += np.bincount(term_counts(ids)[1], minlength=size)
            total += sum(map(len, ids))
            n += len(made)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(made, pa.binary()), pa.nulls(len(made), pa.binary())], ["doc_id", "ids", "sums"])
            pa.default_memory_pool().release_unused()
        if n:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.concatenate((df, [n, total])).tobytes()], pa.binary())], ["doc_id", "ids", "sums"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, sums binary")


def corpus_sums(table: DataFrame) -> np.ndarray | None:
    """Sum of the tasks' sums, as long as the vocabulary; added up in tasks, so the driver gets a few rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("sums").to_pylist():
                x = np.frombuffer(x, "i8")
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    rows = table.where(F.col("sums").isNotNull()).select("sums")
    n = rows.rdd.getNumPartitions()
    while n > 8:  # a tree: each level adds the square root of as many
        n = math.isqrt(n)
        rows = rows.repartition(n).mapInArrow(add, "sums binary")
    rows = rows.mapInArrow(add, "sums binary").collect()
    return sum(np.frombuffer(r["sums"], "i8") for r in rows) if rows else None


def term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document (its index), term and count of all terms of all documents, in order."""
    ids = np.concatenate(docs)
    both = np.sort(np.repeat(np.arange(len(docs), dtype="u8") << np.uint64(32), [len(d) for d in docs]) | ids.astype("u8"))
    at = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, "i8")
    return (both[at] >> np.uint64(32)).astype("i4"), both[at].astype("u4").astype(ids.dtype), np.diff(np.append(at, len(both)))


def order_keys(docs: list[np.ndarray], weights: np.ndarray, width: int, heaviest: int) -> np.ndarray:
    """For each document (none is empty) its terms of the greatest weights, `width` bits each; of equal weights the smaller term, of too few the last one again."""
    doc, terms, tf = term_counts(docs)
    w = weights[terms] * tf / (tf + K1)
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    key = term = np.zeros(len(docs), "i8")
    for _ in range(heaviest):
        most = np.maximum.reduceat(w, starts)
        at = np.flatnonzero(w == most[doc])
        at = at[np.concatenate(([True], doc[at][1:] != doc[at][:-1]))]
        term = np.where(most >= 0, terms[at], term)
        w[at] = -1
        key = key << width | term
    return key


class Shard:
    """BM25 inverted index of some documents, with the corpus-wide idf and mean length."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        doc, term, tf = term_counts(docs)
        self.terms, tf = np.split(term, np.searchsorted(doc, np.arange(1, len(docs)))), tf.astype("f4")
        norm = (K1 * (1 - B + B * np.array([len(d) for d in docs]) / mean)).astype("f4")
        order = np.argsort(term, kind="stable")
        self.doc = doc[order].astype("i8")
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc]))[order].astype("f8")
        held = np.bincount(term, minlength=len(idf))
        self.start = np.concatenate(([0], np.cumsum(held)))
        self.many = len(docs)
        # terms that many of the shard's documents have are rows of a dense table: one addition instead of postings
        common = np.flatnonzero(held >= max(2, len(docs) // DENSE))
        self.row = np.full(len(idf), -1, "i4")
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(docs)), "f8")
        kept = self.row[term]
        self.dense[kept[order][kept[order] >= 0], self.doc[kept[order] >= 0]] = self.weight[kept[order] >= 0]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the seed's terms."""
        terms = self.terms[seed]
        row = self.row[terms]
        total = self.dense[row[row >= 0]].sum(0)
        terms = terms[row < 0]
        low, n = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return total + np.bincount(self.doc[at], self.weight[at], self.many) if len(at) else total


def pack(docs: list[np.ndarray], idf: np.ndarray, mean: float, length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) of one shard; all but those of the last windows are full."""
    index = Shard(docs, idf, mean)
    unused = np.ones(len(docs), bool)
    out: list[list[tuple[int, int, int]]] = []
    window: list[tuple[int, int, int]] = []
    room, lowest = length, 0
    ranked: Iterator[int] = iter(())
    while True:
        doc = next((d for d in ranked if unused[d]), None)
        if doc is None:
            while lowest < len(docs) and not unused[lowest]:
                lowest += 1
            if lowest == len(docs):
                break
            doc = lowest
        unused[doc] = False
        fresh = not window
        at = 0
        while at < len(docs[doc]):
            n = min(room, len(docs[doc]) - at)
            window.append((doc, at, n))
            at, room = at + n, room - n
            if not room:
                out.append(window)
                window, room, fresh = [], length, True
        if fresh and window:  # this document opened the window: it is its seed
            order = np.argsort(-index.scores(doc), kind="stable")
            ranked = iter(order[unused[order]].tolist())
    if window:
        out += powers_of_two(window)
    return out


def powers_of_two(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A window's pieces cut into sequences whose lengths are powers of two, longest first."""
    left = sum(n for *_, n in window)
    pieces = window[::-1]
    out = []
    while left:
        room = 1 << left.bit_length() - 1
        left -= room
        sequence = []
        while room:
            doc, at, n = pieces.pop()
            take = min(n, room)
            sequence.append((doc, at, take))
            if take < n:
                pieces.append((doc, at + take, n - take))
            room -= take
        out.append(sequence)
    return out


def packed(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Rows of PIECES for docs(doc_id, text)."""
    spark = docs.sparkSession
    table = stored(encoded(docs, tokenizer, end_id), "ids")
    sums = corpus_sums(table)
    if sums is None:
        return spark.createDataFrame([], PIECES)
    df, n, total = sums[:-2], int(sums[-2]), int(sums[-1])
    idf = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)).astype("f4"))  # as long as the vocabulary
    mean = total / n
    kind = "<u2" if len(df) <= 1 << 16 else "<u4"
    width = max(1, (len(df) - 1).bit_length())
    heaviest = max(1, (63 - HASH) // width)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        release()
        for some in slices(batches, rows=2048, text="ids"):
            made = order_keys([np.frombuffer(x, kind) for x in some.column("ids").to_pylist()], weights, width, heaviest) << HASH
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("ids"), pa.array(made)], ["doc_id", "ids", "key"])

    # a hash of doc_id, the last bits of the order, splits groups of texts with the same heaviest terms
    keyed = table.where(F.col("ids").isNotNull()).select("doc_id", "ids").mapInArrow(keys, "doc_id long, ids binary, key long")
    keyed = stored(keyed.withColumn("key", F.col("key").bitwiseOR(F.xxhash64("doc_id").bitwiseAND((1 << HASH) - 1))), "keyed")
    forget(table)
    bounds = range_bounds(keyed.select("key"), "key", shuffle_partitions(spark))
    dealt = keyed.withColumn("part", range_bucket(F.col("key"), bounds)).repartitionById(max(1, len(bounds)), "part").sortWithinPartitions("part", "key", "doc_id", F.xxhash64("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        weights = idf.value
        part, made, ids, texts, held = None, 0, [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal made, ids, texts, held
            rows = []
            for sequence in pack(texts, weights, mean, length):
                offset = 0
                for d, at, size in sequence:
                    crc = zlib.crc32(texts[d][at : at + size].astype("<u4").tobytes())
                    rows.append((ids[d], at, size, crc, len(texts[d]), part << 36 | made, offset))
                    offset += size
                made += 1
            ids, texts, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], [x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for p, doc, raw in zip(*(batch.column(k).to_pylist() for k in ("part", "doc_id", "ids"))):
                if texts and (p != part or len(texts) >= shard or held >= SHARD_IDS):
                    yield closed()
                if p != part:
                    part, made = p, 0
                ids.append(doc)
                texts.append(np.frombuffer(raw, kind))
                held += len(texts[-1])
        if texts:
            yield closed()

    return dealt.mapInArrow(run, PIECES)
