"""Operator 4, byte-level BPE encoding and decoding over Arrow batches.

`encode` maps text bytes to characters, lets the tokenizers library merge them, and returns ids with the byte offset
of each id. `decode` reverses the byte table; as an id can hold part of a character, bytes are joined before they
become text, and bytes that are no UTF-8 (ids cut from a longer list) become U+FFFD. Null or empty text: no ids,
empty bytes. Null ids: null text. Extra columns stay; columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import slices, texts_of


def coder(path: str) -> bpe.Bpe:
    """A .tiktoken rank file or a tokenizers .json file."""
    return bpe.load_ranks(path) if path.endswith(".tiktoken") else bpe.load_json(path)


def _schema(df: DataFrame, **new: T.DataType) -> T.StructType:
    return T.StructType([x for x in df.schema.fields if x.name.lower() not in new] + [T.StructField(k, v) for k, v in new.items()])


def _with(batch: pa.RecordBatch, schema: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([new[k] if k in new else batch.column(k) for k in schema], schema)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with `ids` array<int> and `offsets` array<int>: the byte at which each id starts in the text's UTF-8."""
    schema = _schema(df, ids=T.ArrayType(T.IntegerType()), offsets=T.ArrayType(T.IntegerType()))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in slices(batches, text=text):
            ids = [np.frombuffer(x, c.dtype) for x in c.encode_many(texts_of(batch, text))]
            new = {"ids": pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32())), "offsets": pa.array([c.offsets(x)[:-1].astype("i4") for x in ids], pa.list_(pa.int32()))}
            yield _with(batch, names, new)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with `decoded` string: the text that the ids stand for."""
    schema = _schema(df, decoded=T.StringType())
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out = [None if x is None else b"".join(map(c.token_bytes.__getitem__, x)).decode("utf-8", "replace") for x in part.column(ids).to_pylist()]
                yield _with(part, names, {"decoded": pa.array(out, pa.string())})

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes; ids are encoded and decoded within one batch and not moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        decimals = [*map(str, range(len(c.token_bytes)))]
        for batch in slices(batches, rows=4096):
            rows = []
            for raw in c.encode_many(texts_of(batch)):
                ids = np.frombuffer(raw, c.dtype).tolist()
                decoded = b"".join(map(c.token_bytes.__getitem__, ids))
                written = ",".join(map(decimals.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(decoded).hexdigest(), len(decoded)))
            n, ids_sha, decoded_sha, size = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha), pa.array(size, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")


def with_digest(df: DataFrame) -> DataFrame:
    """ids_sha256 of an `ids` column in the JVM, for tables made by encode()."""
    return df.withColumn("ids_sha256", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256))
