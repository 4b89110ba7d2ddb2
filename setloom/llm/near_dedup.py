"""Operator 6, near-duplicate documents by ProbMinHash, banding and verification.

A text is a set of five-word shingles, each with weight 1, as the links are verified on sets. Each shingle is a Poisson process whose rate is
its weight: arrivals go to random registers, a register keeps the shingle that came first, and the process of a shingle
ends as soon as it is later than every register. Registers of two texts agree with the probability-Jaccard similarity
of their weighted sets, which at equal weights is the Jaccard similarity of the sets. REGISTERS make BANDS of ROWS; texts that agree in a band are candidates; a candidate pair is a
link if its sets of shingles have a Jaccard similarity of at least 0.8, computed from the whole texts.

Texts with the same words are one node. In a band's group each node is compared with the group's hub, the node with
most fellows over all its groups, and not with every other one; then the nodes of groups that still hold several components are compared across components, so no
candidate pair between different components is left out but those whose shingles cannot be similar enough, as a bitmap
of them proves, or whose registers show, by one bit each, that the similarity is below the limit (a pair at the limit is
taken for such with a chance of about one in a million). Classes are connected components of the links.

Every row of the input gives one row: doc_id, class_id (smallest doc_id of its class), n_shingles. Null, empty and
wordless texts are classes of their own. Texts of fewer than five words have one shingle. Ties and repeated rows share
their text's class; rows of one doc_id with several texts are classed text by text, as are rows with a null doc_id, whose
class_id is the smallest doc_id that is not null, or null. Texts of any length are taken whole. An empty table gives no
rows. Extra columns are not returned by near_duplicates, and kept by deduplicated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import forget, slices, stored, texts_of
from .graph import components

BANDS, ROWS = 30, 6
REGISTERS = BANDS * ROWS
SIMILARITY = 0.8
_STEP, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def registers(elements: np.ndarray, weights: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """The shingle of the first arrival at each register; elements are distinct hashes."""
    first, owner = np.full(count, np.inf), np.zeros(count, np.uint64)
    last = np.inf  # of the registers' first arrivals
    t, number = np.zeros(len(elements)), np.uint64(0)
    while len(elements):
        # arrivals of each element at once: mostly as many as all registers together wait for
        many = max(1, (6 if number == 0 else 2) * count // len(elements))
        numbers = number + np.arange(1, many + 1, dtype=np.uint64)
        random = words.mixed(elements[:, None] + numbers * _STEP)
        gaps = -np.log((random >> np.uint64(11)).astype("f8") * 2.0**-53 + 2.0**-54) / weights[:, None]
        times = t[:, None] + np.cumsum(gaps, 1)
        i, j = np.nonzero(times < last)
        if not len(i):
            break
        at = (words.mixed(random[i, j] ^ _OTHER) % np.uint64(count)).astype("i8")
        when = times[i, j]
        order = np.argsort(-when, kind="stable")  # earliest last: it stays
        new, by = np.full(count, np.inf), np.zeros(count, np.uint64)
        new[at[order]], by[at[order]] = when[order], elements[i[order]]
        earlier = new < first
        first[earlier], owner[earlier] = new[earlier], by[earlier]
        last = first.max()
        going = times[:, -1] < last  # the others have ended
        elements, weights, t, number = elements[going], weights[going], times[going, -1], number + np.uint64(many)
    return owner


def bands(owner: np.ndarray) -> np.ndarray:
    rows = owner.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = words.mixed(out * _STEP + rows[:, i])
    return out.view("i8")


#: Of REGISTERS bits, so many may differ in a pair that is compared: 5 standard deviations above the mean at 0.8.
DIFFERENT = int(REGISTERS * 0.1 + 5 * math.sqrt(REGISTERS * 0.09) + 1)


def sketch(owner: np.ndarray) -> np.ndarray:
    """One bit of each register's shingle, in 64-bit words."""
    bits = np.zeros(-(-REGISTERS // 64) * 64, "u1")
    bits[:REGISTERS] = words.mixed(owner ^ _OTHER) & np.uint64(1)
    return np.packbits(bits).view("i8")


#: Nodes of a band that meet those of another block in one group.
BLOCK = 512
#: 64-bit words of the bitmap of a text's shingles.
WORDS = 16


def bitmap(elements: np.ndarray) -> np.ndarray:
    """A set bit for each shingle; shingles may share bits."""
    bits = np.zeros(WORDS * 64, "u1")
    bits[elements % np.uint64(len(bits))] = 1
    return np.packbits(bits).view("i8")


def possible(x: str, y: str, similarity: float) -> F.Column:
    """Whether sets of x.n and y.n shingles can be similar enough, by their bitmaps and the numbers of bits x.filled, y.filled.

    A bit of x that y has not shows a shingle of x that y has not, so this bounds the common shingles from above.
    """
    either = sum((F.bit_count(F.col(f"{x}.bitmap")[i].bitwiseOR(F.col(f"{y}.bitmap")[i])) for i in range(WORDS)), F.lit(0))
    common = F.least(F.col(f"{x}.n") + F.col(f"{y}.filled"), F.col(f"{y}.n") + F.col(f"{x}.filled")) - either
    return common >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (similarity / (1 + similarity)) - 1e-9


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, copy (hash of the text), node (16-byte digest of the words; null without words), n (distinct shingles), bands, sketch, bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        memo = words.WordHashes()
        for batch in slices(batches):
            nodes, sizes, made, bits, maps = [], [], [], [], []
            for text in texts_of(batch):
                h = words.hashes(text, memo)
                if not len(h):
                    nodes.append(None)
                    sizes.append(0)
                    made.append(None)
                    bits.append(None)
                    maps.append(None)
                    continue
                elements = np.unique(words.shingles(h))
                nodes.append(xxh3_128_digest(h.tobytes()))
                sizes.append(len(elements))
                owner = registers(elements, np.ones(len(elements)))
                made.append(bands(owner))
                bits.append(sketch(owner))
                maps.append(bitmap(elements))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("copy"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(made, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64()))], ["doc_id", "copy", "node", "n", "bands", "sketch", "bitmap"])

    return docs.select("doc_id", F.xxhash64("text").alias("copy"), "text").mapInArrow(run, "doc_id long, copy long, node binary, n long, bands array<long>, sketch array<long>, bitmap array<long>")


def candidate_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the nodes in wanted(node, doc_id, copy): one row each, as rows with one doc_id are told apart by their texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    named = wanted.select("node", F.col("doc_id").alias("of"), "copy")
    met = rows.join(named, ["copy"]).where(F.col("doc_id").eqNullSafe(F.col("of")))
    return met.groupBy("node").agg(F.first("text").alias("text"))


def links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        memo, kept = words.WordHashes(), (None, None)

        def of(node: bytes, text: str) -> np.ndarray | None:
            h = words.hashes(text or "", memo)
            return np.unique(words.shingles(h)) if xxh3_128_digest(h.tobytes()) == node else None

        for batch in slices(batches, text="text_b"):
            out = []
            for a, b, text_a, text_b in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "text_a", "text_b"))):
                if kept[0] != (a, text_a):
                    kept = (a, text_a), of(a, text_a)
                x, y = kept[1], of(b, text_b)
                if x is not None and y is not None:
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if shared >= similarity * (len(x) + len(y) - shared) - 1e-12:
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out)], ["a", "b"])

    return both.mapInArrow(run, "a binary, b binary").distinct()


def _sized(x: str, y: str, similarity: float) -> F.Column:
    """Sets whose sizes differ more cannot be similar enough."""
    return F.least(x, y) >= F.greatest(x, y) * similarity - 1e-9


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    signed = stored(signatures(docs), "signatures")
    nodes = signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "copy", "n", "bands", "sketch", "bitmap")).alias("s")).select("node", "s.doc_id", "s.copy", "s.n", "s.bands", "s.sketch", "s.bitmap")
    nodes = stored(nodes, "nodes")
    members = nodes.select("node", "doc_id", "copy", "n", F.posexplode("bands").alias("place", "band"))
    groups = members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    grouped = stored(members.join(groups, "band"), "grouped")
    # the text that most others came from is in most of their groups: it is the hub there, and near copies link to it
    degrees = grouped.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = grouped.join(degrees, "node")
    hubs = ranked.groupBy("band").agg(F.max(F.struct("degree", "node", "n")).alias("hub"))
    shared = stored(grouped.join(hubs, "band").select("band", "place", "node", "n", "doc_id", "copy", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "members")
    forget(grouped)
    wanted = shared.select("node", "doc_id", "copy").distinct()
    texts = stored(candidate_texts(docs, wanted), "texts")
    stars = shared.where((F.col("node") != F.col("hub")) & _sized("n", "hub_n", similarity)).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    edges = stored(links(stars, texts, similarity), "links")
    labels = components(edges)

    placed = shared.join(labels, "node", "left").select("band", "place", "node", "n", "hub", F.coalesce("label", "node").alias("label"))
    split = placed.groupBy("band").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("band")
    # a pair is made where its first common band is; `before` has a node's bands up to there
    before, filled = F.slice("bands", 1, F.col("place")).alias("before"), F.aggregate("bitmap", F.lit(0), lambda a, b: a + F.bit_count(b)).alias("filled")
    rest = placed.join(split, "band").join(nodes.select("node", "bands", "sketch", "bitmap"), "node")
    rest = stored(rest.select("band", "node", "n", "hub", "label", "sketch", "bitmap", filled, before), "open")
    # a large band is dealt into blocks, and each block of x meets each block of y in a group of its own
    blocks = rest.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rest.join(blocks, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = dealt.alias("x"), dealt.alias("y")
    apart = sum((F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(-(-REGISTERS // 64))), F.lit(0))
    cheap = (F.col("x.band") == F.col("y.band")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own")) & (F.col("x.label") < F.col("y.label")) & (F.col("x.node") != F.col("y.hub")) & (F.col("x.hub") != F.col("y.node"))
    across = x.join(y, cheap & _sized("x.n", "y.n", similarity) & (apart <= DIFFERENT) & possible("x", "y", similarity) & ~F.arrays_overlap("x.before", "y.before"))
    across = stored(across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), "across")
    more = stored(links(across, texts, similarity), "links")
    if more.limit(1).count():
        forget(labels)
        labels = components(edges.unionByName(more))
    placed = nodes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    smallest = placed.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    classes = stored(placed.join(smallest, "label").select("node", "class_id"), "classes")
    forget(shared, texts, edges, rest, across, more, labels, nodes)
    return signed.select("doc_id", "node", "n").join(classes, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("n").alias("n_shingles"))


def similarity_of(a: str, b: str) -> float:
    """Exact Jaccard similarity of two texts' shingle sets, for tests."""
    memo = words.WordHashes()
    x, y = (set(words.shingles(words.hashes(t, memo)).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else math.nan


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the documents whose class has a smaller doc_id; repeated rows of one document become one.

    A doc_id names a document: rows with one doc_id and several texts stay or go together. Rows with a null doc_id stay.
    """
    rejected = near_duplicates(docs, similarity).where("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates() if repeated else kept
