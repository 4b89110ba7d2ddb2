"""Operator 1, token-ID / binary output: ids bit-packed at the vocabulary's minimum width, in blocks with offsets.

A file set is a Parquet table of blocks. A block holds whole documents, about BLOCK_IDS ids (a longer document has
a block of its own), in ascending doc_id order within its part, and parts follow each other in that order:

    part int        index of the range of doc_ids          first long   ids of the part before this block
    width int       bits per id                             n_ids long   ids in the block
    doc_ids         array of the block's doc_ids            lengths      array of their id counts
    payload binary  the ids, `width` bits each, least significant bit first

An id's place is arithmetic: id k of a block is at bit k * width. So `read_ids` unpacks a whole block with numpy, and
`read_span` any span of it, without the rest. Nulls: a null text is an empty text; every document gets the end id;
a null doc_id sorts first; equal doc_ids keep all their rows, ordered by text hash. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from .common import range_bounds, range_bucket, shuffle_partitions, slices, stored, texts_of

BLOCK_IDS = 1 << 16
BLOCKS = "part int, first long, width int, n_ids long, doc_ids array<long>, lengths array<int>, payload binary"


def width_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids at `width` bits each; whole bytes at the end are filled with zero bits."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype("u4")[:, None] >> np.arange(width, dtype="u4") & 1).astype("u1")
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def read_span(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """`count` ids from id `start` of a block on; only their bytes are touched."""
    low, high = start * width // 8, -(-(start + count) * width // 8)
    raw = np.frombuffer(payload, "u1", high - low, low)
    if width in (8, 16, 32):
        return raw.view(f"<u{width // 8}").astype("<u4")
    bits = np.unpackbits(raw, bitorder="little")[start * width - low * 8 :][: count * width].reshape(count, width)
    return (bits.astype("u4") << np.arange(width, dtype="u4")).sum(1, dtype="u4")


def read_ids(payload: bytes, width: int, count: int) -> np.ndarray:
    return read_span(payload, width, 0, count)


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int = 0, block_ids: int = BLOCK_IDS, name: str = "token-ids") -> DataFrame:
    """Encode docs(doc_id, text), write the blocks to the shared folder in ascending doc_id order, and return them as read back."""
    parts = shuffle_partitions(docs.sparkSession)
    bounds = range_bounds(docs, "doc_id", parts)
    dealt = docs.select("doc_id", "text", range_bucket(F.col("doc_id"), bounds).alias("_part")).repartitionById(max(1, len(bounds)), "_part")
    ordered = dealt.sortWithinPartitions("_part", "doc_id", F.xxhash64("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load_json(tokenizer)
        width = width_for(coder.tokenizer.get_vocab_size())
        end = np.array([end_id], coder.dtype).tobytes()
        state = {"part": None, "first": 0, "size": 0, "ids": [], "docs": []}

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(state["ids"]), coder.dtype)
            lengths = [len(x) // coder.dtype.itemsize for x in state["ids"]]
            out = pa.RecordBatch.from_arrays(
                [pa.array([state["part"]], pa.int32()), pa.array([state["first"]], pa.int64()), pa.array([width], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([state["docs"]], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([pack(ids, width)], pa.binary())],
                ["part", "first", "width", "n_ids", "doc_ids", "lengths", "payload"],
            )
            state.update(first=state["first"] + len(ids), size=0, ids=[], docs=[])
            return out

        for batch in slices(batches, rows=4096):
            encoded = coder.encode_many(texts_of(batch))
            for part, doc, raw in zip(batch.column("_part").to_pylist(), batch.column("doc_id").to_pylist(), encoded):
                n = len(raw) // coder.dtype.itemsize + 1
                if state["docs"] and (state["part"] != part or state["size"] + n > block_ids):
                    yield closed()
                if state["part"] != part:
                    state.update(part=part, first=0)
                state["ids"].append(raw + end)
                state["docs"].append(doc)
                state["size"] += n
        if state["docs"]:
            yield closed()

    return stored(ordered.mapInArrow(blocks, BLOCKS), name)


def read_documents(blocks: DataFrame) -> DataFrame:
    """Per document of a block table: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, width.

    Starts come from one sum per part, at most as many rows as there were partitions when writing.
    """
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = read_ids(row["payload"], row["width"], row["n_ids"])
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array([zlib.crc32(ids[i:j].tobytes()) for i, j in zip(starts, ends)], pa.int64()), pa.array([row["width"]] * n, pa.int32())],
                    ["part", "doc_id", "start", "n_tokens", "ids_crc32", "width"],
                )

    read = blocks.mapInArrow(documents, "part int, doc_id long, start long, n_tokens long, ids_crc32 long, width int")
    return read.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "width")
