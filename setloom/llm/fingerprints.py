"""Operator 2, document fingerprints by content-defined chunking.

A gear hash of the last WINDOW bytes decides where chunks end. Chunking is normalised: below the normal size a
boundary needs more zero bits than above it, so sizes gather around the normal one. As no boundary looks at bytes
before the chunk's own WINDOW-th byte, an insertion changes only the chunks around it. A fingerprint is the sorted
set of chunk digests, each 16 hex digits: 54 bits of the chunk's xxh64 and 10 bits of its length less one. Likeness
is containment: bytes in chunks of both sets over the bytes of the smaller set. Equal texts have equal fingerprints;
an empty or null text has the empty one, which is like itself (1) and like nothing else (0).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import range_bounds, range_bucket, shuffle_partitions, slices, texts_of

WINDOW = 32
LOWEST, NORMAL, HIGHEST = 32, 64, 256
STRICT, LOOSE = np.uint32(0b1111111 << 25), np.uint32(0b11111 << 27)
_GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype="u8").astype("u4")


def gear(raw: np.ndarray) -> np.ndarray:
    """Hash of the last 32 bytes at each byte: sum of the byte's random word shifted by its distance, by doubling."""
    h = _GEAR[raw]
    step = 1
    while step < WINDOW:
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
        step *= 2
    return h


def cut(starts: list[int], size: int, strict: list[int], loose: list[int]) -> Iterator[list[int]]:
    """Chunk ends of each text in a buffer of `size` bytes; texts begin at `starts`."""
    for start, end in zip(starts, [*starts[1:], size]):
        ends, at = [], start
        while at < end:
            low, normal, high = at + LOWEST - 1, min(at + NORMAL, end), min(at + HIGHEST, end)
            i = bisect_left(strict, low)
            if i < len(strict) and strict[i] < normal:
                at = strict[i] + 1
            else:
                i = bisect_left(loose, max(low, normal))
                at = loose[i] + 1 if i < len(loose) and loose[i] < high else high
            ends.append(at)
        yield ends


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct chunk words of each text."""
    from xxhash import xxh64_intdigest

    buffer = b"".join(texts)
    raw = np.frombuffer(buffer, "u1")
    h = gear(raw) if len(raw) else np.zeros(0, "u4")
    loose_at = np.flatnonzero((h & LOOSE) == 0)
    strict = loose_at[(h[loose_at] & STRICT) == 0].tolist()
    starts = np.concatenate(([0], np.cumsum([len(x) for x in texts])[:-1])).astype(int).tolist() if texts else []
    out = []
    for start, ends in zip(starts, cut(starts, len(buffer), strict, loose_at.tolist())):
        words = [(xxh64_intdigest(buffer[i:j]) & 0xFFFFFFFFFFFFFC00) | (j - i - 1) for i, j in zip([start, *ends], ends)]
        out.append(np.unique(np.array(words, "u8")))
    return out


def written(words: np.ndarray) -> str:
    return words.astype(">u8").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype("u8")


def weight(words: np.ndarray) -> int:
    return int(((words & np.uint64(1023)) + np.uint64(1)).sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smaller set's bytes that lie in chunks of both."""
    least = min(weight(a), weight(b))
    if not least:
        return float(len(a) == len(b))
    return weight(np.intersect1d(a, b, assume_unique=True)) / least


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """Per row of df(doc_id, text): doc_id, n_chars, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=text):
            texts = texts_of(batch, text)
            made = fingerprints([x.encode() for x in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([*map(written, made)], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return df.select("doc_id", text).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, the second half taken from the start of the next document.

    Documents are dealt into ranges of doc_id; the first one of each range is also sent to the range before it, that
    of the lowest to the last, so each document meets its successor with no global sort in one task. Equal doc_ids
    follow each other in order of text hash and text; null doc_ids come first.
    """
    bounds = range_bounds(docs, "doc_id", shuffle_partitions(docs.sparkSession))
    n = max(1, len(bounds))
    own = range_bucket(F.col("doc_id"), bounds)
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if docs.where(F.col("doc_id").isNull()).limit(1).count():  # such rows open the first range
        heads = F.col("doc_id").isNull() | (F.col("doc_id").isin(bounds[1:]) if n > 1 else F.lit(False))
    else:
        heads = F.col("doc_id").isin(bounds) if bounds else F.lit(True)
    sent = F.when(F.coalesce(heads, F.lit(True)), F.array(F.struct(own.alias("part"), F.lit(0).alias("ahead")), F.struct(F.pmod(own - 1, F.lit(n)).alias("part"), F.lit(1).alias("ahead")))).otherwise(F.array(F.struct(own.alias("part"), F.lit(0).alias("ahead"))))
    dealt = some.select("doc_id", "text", F.explode(sent).alias("at")).select("doc_id", "text", "at.part", "at.ahead").repartitionById(n, "part")
    ordered = dealt.sortWithinPartitions("part", "ahead", "doc_id", F.xxhash64("text"), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def made(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows of all texts but the last, which is only their successor."""
        edited = [(x[: len(x) - len(x) // 2] + y[: len(x) // 2]).encode() for x, y in zip(texts, texts[1:])]
        plain = fingerprints([x.encode() for x in texts])
        changed = fingerprints(edited)
        columns = [
            pa.array(ids[:-1], pa.int64()), pa.array([len(x) for x in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited]), pa.array([*map(written, plain[:-1])]), pa.array([*map(written, changed)]),
            pa.array([*map(likeness, plain, changed)], pa.float64()), pa.array([*map(likeness, plain, plain[1:])], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, over, ids, texts = None, False, [], []
        for batch in slices(batches):
            for p, ahead, doc, text in zip(*(batch.column(k).to_pylist() for k in ("part", "ahead", "doc_id", "text"))):
                if p != part:
                    part, over, ids, texts = p, False, [], []
                if over:
                    continue  # of equal heads only the first is a successor
                ids.append(doc)
                texts.append(text)
                if ahead:
                    over = True
                    if len(ids) > 1:
                        yield made(ids, texts)
                    ids, texts = [], []
            if len(ids) > 1:
                yield made(ids, texts)
                ids, texts = ids[-1:], texts[-1:]

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
