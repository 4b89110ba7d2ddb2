"""Operator 9, approximate nearest neighbours by collision-counting hashing (query-aware, virtual rehashing).

Vectors get one more coordinate so that all of a block have one length; then the nearest in distance has the largest
inner product with a query. A block's index is PROJECTIONS random projections, each a sorted array. A query opens a
window around its own projection in each array; a vector collides where it lies in the window. Windows widen step by
step (virtual rehashing: nothing is hashed anew) until enough vectors have collided in at least COLLISIONS of the
arrays; those are verified with exact inner products. The last window is unbounded, so no vector is out of reach.

How many are enough is fitted in each block: up to SAMPLE of its queries are compared with the whole block, and the
smallest of SHARES is taken with which these queries find RECALL of their nearest vectors. So data of other dimensions or
without clusters are verified more, up to the whole block, and easy data less.

Queries and candidates are dealt into blocks of bounded size and each query block meets each candidate block in a task
of its own; the best of each are merged. Vectors that are null, empty, zero or hold null or non-finite components take
no part; vectors of different lengths never meet. Ties go to the smaller vec_id. Rows that share a vec_id and a vector
are one; rows that share a vec_id and differ are queries and candidates each, and `query` tells their lists apart: a row
is no candidate of its own query only. An empty table gives no rows, a query with no other vector none. Extra columns are
not returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROJECTIONS = 64
#: Share of the projections in which a vector must collide.
COLLISIONS = 0.75
#: Queries of a block that its fit uses, shares of the block to verify that are tried, and mean recall that is asked.
SAMPLE, SHARES, RECALL = 32, (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.35, 0.45, 0.55, 0.65, 0.8), 0.96
#: Half widths of the windows, in lengths of the longest vector.
WIDTHS = (0.8, 0.95, 1.1, 1.25, 1.4, 1.6, 1.9, 2.3, np.inf)
BLOCK, QUERIES = 8192, 1024


def usable(vector: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


class Index:
    """Sorted projection arrays of one block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.x = ids[order], rows[order], np.ascontiguousarray(x[order])
        # by a power of two, so that nothing is rounded: squares and single precision would overflow for large components
        scaled = self.x * 2.0 ** -np.frexp(np.abs(self.x).max())[1]
        squares = np.einsum("ij,ij->i", scaled, scaled)
        self.longest = float(np.sqrt(squares.max()))
        rng = np.random.default_rng(x.shape[1])
        self.axes = rng.standard_normal((x.shape[1] + 1, PROJECTIONS))
        more = np.sqrt(np.maximum(self.longest**2 - squares, 0))
        at = (scaled @ self.axes[:-1] + more[:, None] * self.axes[-1]).T
        order = np.argsort(at, axis=1, kind="stable")
        self.sorted = np.take_along_axis(at, order, 1)
        self.place = np.empty(order.shape, "u4" if len(ids) > 1 << 16 else "u2")  # of each vector in each sorted array
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=self.place.dtype)[None, :], 1)
        self.rough = scaled.astype("f4")

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many arrays each vector's place lies in the window [low, high)."""
        kind = self.place.dtype
        inside = (self.place - low.astype(kind)[:, None]) < (high - low).astype(kind)[:, None]  # below low wraps round
        inside[high - low > np.iinfo(kind).max] = True
        return np.add.reduce(inside.view("u1"), axis=0, dtype="u1")  # at most 255 projections

    def fitted(self, query_rows: np.ndarray, q: np.ndarray, bounds: list[tuple[np.ndarray, np.ndarray]], need: int, k: int) -> int:
        """The number of vectors to verify with which a sample of the queries finds RECALL of its k nearest."""
        n = len(self.ids)
        levels = np.array([min(n, k + 1 + int(s * n)) for s in SHARES])
        kept, asked = np.zeros(len(levels)), 0
        for i in range(min(SAMPLE, len(q))):
            exact = np.where(self.rows == query_rows[i], -np.inf, self.x @ q[i])
            nearest = np.argpartition(-exact, min(k, n) - 1)[:k]
            nearest = nearest[self.rows[nearest] != query_rows[i]]
            hits = [self.collisions(low[i], high[i]) >= need for low, high in bounds]
            counts = np.maximum.accumulate([np.count_nonzero(h) for h in hits])
            found = np.array([np.count_nonzero(h[nearest]) for h in hits])
            kept += found[np.searchsorted(counts, levels)]
            asked += len(nearest)
        good = np.flatnonzero(kept >= RECALL * asked)
        return int(levels[good[0]]) if len(good) else n

    def search(self, query_rows: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query row, vec_id and exact inner product of the k best verified of each query, unordered."""
        need = int(np.ceil(COLLISIONS * PROJECTIONS))
        scaled = q * 2.0 ** -np.frexp(np.abs(q).max(axis=1, keepdims=True))[1].astype("f8")
        unit = scaled * (self.longest / np.sqrt(np.einsum("ij,ij->i", scaled, scaled)))[:, None]
        at = unit @ self.axes[:-1]
        bounds = []  # for each width: first and last place in each array, for all queries
        for w in WIDTHS:
            low = np.stack([np.searchsorted(self.sorted[j], at[:, j] - w * self.longest, "left") for j in range(PROJECTIONS)], 1)
            high = np.stack([np.searchsorted(self.sorted[j], at[:, j] + w * self.longest, "right") for j in range(PROJECTIONS)], 1)
            bounds.append((low, high))
        enough = self.fitted(query_rows, q, bounds, need, k)
        out: list[tuple] = []
        step = 0
        for i in range(len(q)):
            hit = lambda s: self.collisions(bounds[s][0][i], bounds[s][1][i]) >= need
            near = hit(step)  # the narrowest sufficient window, looked for from the last query's on
            if np.count_nonzero(near) >= enough:
                while step and np.count_nonzero(less := hit(step - 1)) >= enough:
                    step, near = step - 1, less
            else:
                while np.count_nonzero(near) < enough:
                    step += 1
                    near = hit(step)
            found = np.flatnonzero(near)
            found = found[self.rows[found] != query_rows[i]]
            rough = self.rough[found] @ scaled[i].astype("f4")
            if len(found) > k:
                least = np.partition(rough, len(found) - k)[len(found) - k]
                slack = 1e-5 * self.longest * float(np.sqrt((scaled[i] * scaled[i]).sum()))
                found = found[rough >= least - slack]
            exact = (self.x[found] * q[i]).sum(1)
            best = np.lexsort((self.ids[found], -exact))[:k]
            out.append((np.full(len(best), query_rows[i]), self.ids[found[best]], exact[best]))
        a, b, c = zip(*out)
        return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def search(vectors: DataFrame, is_query: Column, k: int = 20, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of vectors(vec_id, embedding) to each row where is_query holds."""
    good = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks"))
    good = good.withColumn("row", F.xxhash64("vec_id", "v"))
    if good.groupBy("vec_id").count().where("count > 1").limit(1).count():
        good = good.dropDuplicates(["row"])
    sizes = good.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    c, d = max(1, -(-sizes["n"] // block)), max(1, -(-sizes["q"] // queries))
    dealt = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    offered = good.select("vec_id", "row", "v", F.size("v").alias("dim"), F.lit(False).alias("asks"), dealt(c, "block").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("d"))
    asked = good.where("asks").select("vec_id", "row", "v", F.size("v").alias("dim"), "asks", F.explode(F.sequence(F.lit(0), F.lit(c - 1))).alias("c"), dealt(d, "query").alias("d"))

    def run(rows: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py()
        ids, own = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy()
        x = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        asks = rows.column("asks").to_numpy()
        schema = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not asks.any() or asks.all():
            return schema.empty_table()
        query, vec_id, score = Index(ids[~asks], x[~asks], own[~asks]).search(own[asks], x[asks], k)
        order = np.argsort(own[asks])
        query_id = ids[asks][order[np.searchsorted(own[asks][order], query)]]
        return pa.table([*map(pa.array, (query_id, query, vec_id, score))], schema=schema)

    near = offered.unionByName(asked).groupBy("dim", "c", "d").applyInArrow(run, "query_id long, query long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query")
