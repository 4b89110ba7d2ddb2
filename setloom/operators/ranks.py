"""How often each pair of a draw has been drawn up to it, without a row for each pair of a draw.

Draws are dealt into blocks of consecutive t, which are stored. What a block starts from are sums of earlier blocks, one
row per block and pair, counted in the block's row; within a block a pair's occurrences are numbered by one stable sort
of its codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.sources.storage import stored

#: Draws of a block, and more than any code.
BLOCK, CODES = 1 << 12, 3 << 12
#: Code of a component (kind, a, b); numbers are below 64.
CODE = "cast(case c.kind when 'main-main' then 0 when 'main-star' then 4096 else 8192 end + c.a * 64 + c.b as int)"


def ranked(sets: DataFrame, size: int = BLOCK) -> DataFrame:
    """game, t, ranks of sets(game, t, codes): of each code how often it came up to t, t included."""
    block = F.floor((F.col("t") - 1) / size).cast("long").alias("block")
    dealt = sets.select("game", "t", block, "codes")
    blocks = stored(dealt.groupBy("game", "block").agg(F.sort_array(F.collect_list(F.struct("t", "codes"))).alias("rows")), "blocks")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                code, n = np.unique(one.column("codes").flatten().flatten().to_numpy(zero_copy_only=False), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([one.column(c)[0].as_py()] * len(code), t) for c, t in (("game", pa.string()), ("block", pa.int64()))] + [pa.array(code.astype("i4")), pa.array(n.astype("i8"))], ["game", "block", "code", "n"])

    many = stored(blocks.select("game", "block", F.col("rows.codes").alias("codes")).mapInArrow(count, "game string, block long, code int, n long"), "counts")
    since = Window.partitionBy("game", "code").orderBy("block")
    # a block gets the sum that a code has after the last block with it, at every block from then to the code's next one
    ends = blocks.groupBy("game").agg(F.max("block").alias("end"))
    sums = many.withColumn("n", F.sum("n").over(since.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("block").over(since)).join(F.broadcast(ends), "game")
    until = F.coalesce("until", "end")
    base = sums.where(F.col("block") < until).select("game", F.explode(F.sequence(F.col("block") + 1, until)).alias("block"), "code", "n")
    base = base.groupBy("game", "block").agg(F.collect_list(F.struct("code", "n")).alias("base"))
    met = blocks.join(base, ["game", "block"], "left").select("game", F.col("rows.t").alias("t"), F.col("rows.codes").alias("codes"), F.col("base.code").alias("code"), F.col("base.n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                t, lists = one.column("t").flatten(), one.column("codes").flatten()
                codes = lists.flatten().to_numpy(zero_copy_only=False)
                counts = np.zeros(CODES, "i8")
                counts[one.column("code").flatten().to_numpy(zero_copy_only=False)] = one.column("n").flatten().to_numpy(zero_copy_only=False)
                order = np.argsort(codes, kind="stable")
                held = codes[order]
                first = np.flatnonzero(np.diff(held, prepend=-1))
                ranks = np.empty(len(codes), "i8")
                ranks[order] = np.arange(len(codes)) - np.repeat(first, np.diff(first, append=len(codes))) + 1
                ranks += counts[codes]
                starts = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
                made = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ranks))
                yield pa.RecordBatch.from_arrays([pa.array([one.column("game")[0].as_py()] * len(t), pa.string()), t, made], ["game", "t", "ranks"])

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, "game", "t").mapInArrow(run, "game string, t long, ranks array<long>")
