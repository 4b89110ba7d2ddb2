"""Operator 12, ranked lexical search: MaxScore with pair bounds over a sharded inverted index.

write_index() writes a table with a row per shard, of up to SHARD documents, in two passes. The first finds the terms
of whole texts and writes postings (term, document, occurrences). The second adds what needs the corpus' counts: for
the FREQUENT terms that most documents hold, the intersection list of each two of them, with the largest sum of both
impacts in any one document of the shard.

search() takes the queries in blocks of bounded size. In a shard a query's terms are added up from the one with the
largest impact on. What the terms not yet added can give together is bounded by the sum of their own maxima, lowered
for matched pairs of them to the pair's joint maximum (a document has both terms, and then at most the joint maximum,
or one of them). As soon as that is below the score of the k-th best document so far, documents that have not come up
yet are skipped, and only those that can still reach the k-th best get the rest. Skipping needs the bound to be
smaller, never equal, so ties are kept and the result is exact. Shards return k rows per query; the best k of all count.

Score: sum over a query's distinct terms of w * ((10**9 * tf) div (1000 * tf + 8 * m)), see `weight` and `lengths`.
Null and empty texts have no terms. A null doc_id sorts before others among equal scores; repeated rows are ranked
as separate documents, and repeated items are separate queries with equal item_ids. Without a term in any document
there are no rows. Terms are told apart by 64-bit fingerprints. Extra columns are ignored. A shard holds one text
longer than SHARD_WORDS words alone, with its distinct terms in memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import spans
from .common import forget, slices, stored

#: Documents and words of a shard.
SHARD, SHARD_WORDS = 4096, 4 << 20
#: Terms whose pairs have intersection lists: FREQUENT * (FREQUENT - 1) / 2 lists a shard.
FREQUENT = 24
#: Queries and bytes of query text of a block.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Bytes of terms: ASCII letters and digits, and all that is not ASCII.
TERM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
POSTINGS = "doc_ids array<long>, n binary, words long, held long, terms binary, start binary, doc binary, tf binary, common array<long>, common_df array<long>"
INDEX = POSTINGS.split(", common ")[0] + ", pairs binary, joint binary, pair_start binary, pair_doc binary"


def lengths(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """m of documents with n terms each: 10 and nine tenths of the length against the mean, in percent, rounded down."""
    return 100 - 90 + (90 * n.astype("i8") * documents) // words


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype("i8")
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class _Builder:
    """Postings of the shard at hand."""

    def __init__(self, size: int = SHARD) -> None:
        self.size = size
        self.doc_ids: list[int | None] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = np.zeros(size, "i8")
        self.words = 0

    def add(self, doc: np.ndarray, prints: np.ndarray, alone: bool) -> None:
        """Occurrences in chunk order; of a part of one long text the repeats are counted at once."""
        if not len(prints):
            return
        tf = np.ones(len(prints), "i8")
        self.n += np.bincount(doc, minlength=self.size)
        self.words += len(prints)
        if alone:
            prints, tf = np.unique(prints, return_counts=True)
            doc = np.full(len(prints), doc[0])
        self.parts.append((prints, doc.astype("i8"), tf.astype("i8")))

    def closed(self) -> pa.RecordBatch:
        if self.parts:
            prints, doc, tf = (np.concatenate(x) for x in zip(*self.parts))
        else:
            prints, doc, tf = np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "i8")
        terms, place = np.unique(prints, return_inverse=True)
        key = place.astype("i8") * self.size + doc
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        tf = np.add.reduceat(tf[order], first) if len(first) else tf
        key = key[first]
        held = np.bincount(key // self.size, minlength=len(terms))
        start = np.concatenate(([0], np.cumsum(held)))
        top = np.argsort(-held, kind="stable")[: 4 * FREQUENT]
        n = self.n[: len(self.doc_ids)]
        out = [
            pa.array([self.doc_ids], pa.list_(pa.int64())), pa.array([n.astype("<u4").tobytes()], pa.binary()), pa.array([int(n.sum())], pa.int64()), pa.array([int((n > 0).sum())], pa.int64()),
            pa.array([terms.astype("<u8").tobytes()], pa.binary()), pa.array([start.astype("<u4").tobytes()], pa.binary()), pa.array([(key % self.size).astype("<u2").tobytes()], pa.binary()), pa.array([tf.astype("<u4").tobytes()], pa.binary()),
            pa.array([terms[top].view("i8").tolist()], pa.list_(pa.int64())), pa.array([held[top].tolist()], pa.list_(pa.int64())),
        ]
        self.__init__(self.size)
        return pa.RecordBatch.from_arrays(out, [x.split()[0] for x in POSTINGS.split(", ")])


def postings_of(batches: Iterator[pa.RecordBatch], size: int = SHARD, chunk_bytes: int = spans.CHUNK) -> Iterator[pa.RecordBatch]:
    """Rows of POSTINGS from batches of doc_id and text, `size` documents each."""
    shard = _Builder(size)
    for batch in slices(batches, rows=size):
        done, ids = 0, batch.column("doc_id").to_pylist()  # rows whose doc_ids the shard has
        shift = len(shard.doc_ids)
        for chunk in spans.chunks(batch.column("text"), TERM, size=chunk_bytes):
            prints, rows = chunk.prints()[: chunk.own], chunk.rows[: chunk.own]
            at = 0
            while at < len(rows):
                room = size - len(shard.doc_ids) if shard.words < SHARD_WORDS else 0
                if rows[at] >= done and not room:
                    yield shard.closed()
                    shift = -done
                    room = size
                last = max(done, min(int(rows[-1]) + 1, done + room))  # rows up to here fit
                shard.doc_ids += ids[done:last]
                done = last
                stop = int(np.searchsorted(rows, done))
                shard.add(rows[at:stop] + shift, prints[at:stop], chunk.part)
                at = stop
        while done < len(ids):  # rows without terms at the end
            room = size - len(shard.doc_ids)
            if not room:
                yield shard.closed()
                room = size
            shard.doc_ids += ids[done : done + room]
            done = min(len(ids), done + room)
    if shard.doc_ids:
        yield shard.closed()


class Shard:
    """One row of the index, opened."""

    def __init__(self, row: dict, documents: int, words: int):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.doc_ids = row["doc_ids"]
        self.m = lengths(read("n", "<u4"), documents, words)
        self.terms, self.start, self.doc, self.tf = read("terms", "<u8"), read("start", "<u4").astype("i8"), read("doc", "<u2").astype("i8"), read("tf", "<u4")
        self.pairs: dict[tuple[int, int], int] = {}
        self.known: set[int] = set()
        if row.get("pairs"):
            self.pairs = {(a, b): i for i, (a, b) in enumerate(read("pairs", "<u8").reshape(-1, 2).tolist())}
            self.known = {t for pair in self.pairs for t in pair}
            self.joint, self.pair_start, self.pair_doc = read("joint", "<i8"), read("pair_start", "<u4").astype("i8"), read("pair_doc", "<u2")

    def place(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term in the shard, -1 where no document has it."""
        at = np.searchsorted(self.terms, terms)
        return np.where((at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms), at, -1) if len(self.terms) else np.full(len(terms), -1)

    def impacts(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a term, and its saturations there."""
        low, high = self.start[place], self.start[place + 1]
        doc = self.doc[low:high]
        return doc, saturation(self.tf[low:high], self.m[doc])

    def df(self, terms: np.ndarray) -> np.ndarray:
        at = self.place(terms)
        return np.where(at >= 0, np.diff(self.start)[np.maximum(at, 0)], 0) if len(self.terms) else np.zeros(len(terms), "i8")

    def pair_lists(self, terms: np.ndarray, weights: np.ndarray) -> dict[str, bytes]:
        """Intersection list of each two terms that share a document, and the largest sum of their impacts."""
        at = self.place(terms)
        have = [(int(t), *self.impacts(p), int(w)) for t, p, w in zip(terms, at, weights) if p >= 0]
        pairs, joint, docs = [], [], []
        for i, (a, doc_a, g_a, w_a) in enumerate(have):
            for b, doc_b, g_b, w_b in have[i + 1 :]:
                both, x, y = np.intersect1d(doc_a, doc_b, assume_unique=True, return_indices=True)
                pairs.append((a, b))
                docs.append(both)
                joint.append(int((w_a * g_a[x] + w_b * g_b[y]).max()) if len(both) else 0)
        ends = np.cumsum([0, *map(len, docs)])
        flat = np.concatenate(docs) if docs else np.zeros(0, "i8")
        return {"pairs": np.array(pairs, "<u8").tobytes(), "joint": np.array(joint, "<i8").tobytes(), "pair_start": ends.astype("<u4").tobytes(), "pair_doc": flat.astype("<u2").tobytes()}

    def matched(self, terms: list[int], most: list[int]) -> dict[int, tuple[int, int, int]]:
        """Disjoint pairs of terms, those that lower a bound most first: earlier term -> later term, pair, joint maximum."""
        at = [i for i, t in enumerate(terms) if t in self.known]
        saved = []
        for x, i in enumerate(at):
            for j in at[x + 1 :]:
                pair = self.pairs.get((terms[i], terms[j]), self.pairs.get((terms[j], terms[i])))
                if pair is not None:
                    least = max(int(self.joint[pair]), most[i], most[j])
                    saved.append((most[i] + most[j] - least, i, j, pair, least))
        out, used = {}, set()
        for gain, i, j, pair, least in sorted(saved, reverse=True):
            if gain > 0 and i not in used and j not in used:
                out[i] = (j, pair, least)
                used |= {i, j}
        return out

    @staticmethod
    def bounds(most: list[int], matched: dict[int, tuple[int, int, int]]) -> list[int]:
        """For each i a bound of what terms i and later can give together; the terms are ordered by falling maxima."""
        out = [0] * (len(most) + 1)
        for i in reversed(range(len(most))):
            # with the earlier term of a pair both are among them, and its partner's own maximum is counted already
            out[i] = out[i + 1] + (matched[i][2] - most[matched[i][0]] if i in matched else most[i])
        return out

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the k best documents and all that tie with the last; and the postings that were read."""
        at = self.place(terms)
        lists = []
        for t, p, w in zip(terms, at, weights):
            if p >= 0 and w > 0:
                doc, g = self.impacts(p)
                lists.append((int(w) * int(g.max()), int(t), doc, int(w) * g))
        lists.sort(key=lambda x: (-x[0], x[1]))
        most = [x[0] for x in lists]
        matched = self.matched([x[1] for x in lists], most)
        bound = self.bounds(most, matched)
        acc = np.zeros(len(self.m), "i8")
        read, i, least = 0, 0, 1
        while i < len(lists):
            _, _, doc, given = lists[i]
            acc[doc] += given
            read += len(doc)
            i += 1
            if i < len(lists) and bound[i] < acc.max():
                least = max(least, _kth(acc, k))
                if bound[i] < least:
                    break
        left = np.flatnonzero(acc > 0)
        score = acc[left]
        if i < len(lists):
            left = left[score + bound[i] >= least]
            can = acc[left] + bound[i]
            for a, (b, pair, joint) in matched.items():
                if a >= i:  # outside the pair's list a document has one of both terms at most
                    both = np.zeros(len(acc), bool)
                    both[self.pair_doc[self.pair_start[pair] : self.pair_start[pair + 1]]] = True
                    can -= np.where(both[left], 0, joint - max(most[a], most[b]))
            left = left[can >= least]
            score = acc[left]
        for j in range(i, len(lists)):
            if len(left) >= k:
                least = max(least, _kth(score, k))
            keep = score + bound[j] >= least
            left, score = left[keep], score[keep]
            _, _, doc, given = lists[j]
            where = np.minimum(np.searchsorted(doc, left), len(doc) - 1)
            hit = doc[where] == left
            score = score + np.where(hit, given[where], 0)
            read += len(left)
        if len(left) > k:
            keep = score >= _kth(score, k)
            left, score = left[keep], score[keep]
        return left, score, read


def _kth(score: np.ndarray, k: int) -> int:
    """The k-th largest score; 0 where there are fewer."""
    return int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0


def write_index(docs: DataFrame, name: str = "lexical", shard: int = SHARD, chunk_bytes: int = spans.CHUNK) -> tuple[DataFrame, int, int]:
    """The index of docs(doc_id, text), the number of documents with terms and the number of all terms."""
    postings = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: postings_of(batches, shard, chunk_bytes), POSTINGS), f"{name}-postings")
    documents, words = postings.agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    counted = postings.select(F.explode(F.arrays_zip("common", "common_df")).alias("x")).groupBy("x.common").agg(F.sum("x.common_df").alias("n"))
    frequent = np.array([r["common"] for r in counted.orderBy(F.desc("n"), "common").limit(FREQUENT).collect()], "i8").view("u8")
    weights = np.array([weight(int(x), documents) for x in df_of(postings, frequent, documents, words)], "i8")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                made = Shard(one.to_pylist()[0], documents, words).pair_lists(frequent, weights)
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in one.schema.names if not c.startswith("common")), *(pa.array([x], pa.binary()) for x in made.values())], [x.split()[0] for x in INDEX.split(", ")])

    if not words:
        return postings.drop("common", "common_df"), documents, words
    index = stored(postings.mapInArrow(finished, INDEX), name)
    forget(postings)
    return index, documents, words


def df_of(index: DataFrame, terms: np.ndarray, documents: int, words: int) -> np.ndarray:
    """Documents that hold each term; one array per task and size of `terms` is added up."""
    sent = index.sparkSession.sparkContext.broadcast(terms)  # of a block of queries, or FREQUENT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), "i8")
        for batch in batches:
            for row in batch.to_pylist():
                total += Shard(row | {"n": b"", "doc": b"", "tf": b"", "doc_ids": []}, 1, 1).df(sent.value)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    out = np.zeros(len(terms), "i8")
    for r in index.select("terms", "start").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect() if words else []:
        out[r["at"]] = r["n"]
    return out


def query_terms(text: str | None) -> np.ndarray:
    found = [c.prints()[: c.own] for c in spans.chunks(pa.array([text or ""]), TERM)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, "u8")


def query_blocks(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items in blocks of at most BLOCK queries and about BLOCK_BYTES of text, one partition after the other."""
    block, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        if block and (len(block) >= BLOCK or size + len(r["text"] or "") > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((r["item_id"], query_terms(r["text"])))
        size += len(r["text"] or "")
    if block:
        yield block


FOUND = "query long, item_id long, doc_id long, score long"


def search(index: DataFrame, documents: int, words: int, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of items(item_id, text)."""
    spark: SparkSession = index.sparkSession
    found, first = [], 0
    for block in query_blocks(items):
        terms = np.unique(np.concatenate([t for _, t in block]))
        df = df_of(index, terms, documents, words)
        asked = [(first + i, item, t[df[np.searchsorted(terms, t)] > 0]) for i, (item, t) in enumerate(block)]
        asked = [(q, item, t, np.array([weight(int(x), documents) for x in df[np.searchsorted(terms, t)]], "i8")) for q, item, t in asked]
        sent = spark.sparkContext.broadcast(asked)  # a block of queries

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    shard, rows = Shard(row, documents, words), []
                    for q, item, t, w in sent.value:
                        left, score, _ = shard.top(t, w, k)
                        best = sorted(zip((-score).tolist(), ((shard.doc_ids[x] is not None, shard.doc_ids[x] or 0) for x in left)))[:k]
                        rows += [(q, item, d if known else None, -s) for s, (known, d) in best]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], [x.split()[0] for x in FOUND.split(", ")])

        found.append(stored(index.mapInArrow(run, FOUND), "lexical-found"))
        first += len(block)
    if not found or not words:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return reduce(DataFrame.unionByName, found).withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    index, documents, words = write_index(docs)
    return search(index, documents, words, items, k)
