"""Operator 13, phrase collocation mining by Rabin-Karp fingerprints.

Texts are read over their bytes: A-Z in lower case, pieces end at PIECE_ENDS, words are what stands between blanks.
Prefix polynomials over bytes give each word's fingerprint and polynomials over these each run's of up to LONGEST
words; the language is mixed in. Rounds:

1. Words are counted by fingerprint, with the words of each language.
2. Then runs of 2, 3, ... words, by fingerprint. A run is counted only if both runs of one word less in it may be
   frequent, which a filter of FILTER_BITS bits says: it never misses a frequent run, and what it lets through besides
   is dropped after the count.
3. Texts are read once more. The places of a frequent fingerprint point to its occurrences, which are compared by bytes,
   and runs are counted by (lang, text) with a pointer (the smallest doc_id), so that two phrases with one fingerprint
   come apart. Only these phrases are ever made into text. Phrases below the smallest count go.

Tasks add up what they have seen before it is shuffled. Scores are joins of phrases with their parts.

Null and empty texts have no words; a null lang is `und`. Null and repeated doc_ids make no difference to counts: each
row counts. Empty tables give no rows. A text longer than a chunk is read in parts that overlap by LONGEST - 1 words.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import spans
from .common import forget, slices, stored
from .words import mixed

PIECE_ENDS = ".,;:!?\n\v\f\r"
BLANKS = " \t"
LONGEST = 3
#: Bits of the filter of frequent fingerprints, and how many of them a task sends at once.
FILTER_BITS, FILTER_PART = 27, 21
#: Runs that a task holds before it adds them up.
HELD = 1 << 18
WORD = ~spans.byte_set(PIECE_ENDS + BLANKS)
ENDS = spans.byte_set(PIECE_ENDS)


def runs(chunk: spans.Chunk, tenant: np.ndarray, sizes: tuple[int, ...], bits: int = 64, words: np.ndarray | None = None) -> list[np.ndarray]:
    """For each k of `sizes` the fingerprint of the k words from each own word on; 0 where the piece ends before.

    `tenant` is a number for each row's language; `bits` below 64 makes collisions, for tests.
    """
    n = len(chunk.starts)
    prefix = spans.prefix_polynomial(chunk.prints() if words is None else words, spans.WORD_POWERS)
    # pieces: how many words before this one start a piece
    piece = np.zeros(n + 1, "i8")
    piece[np.searchsorted(chunk.starts, np.flatnonzero(np.take(ENDS, chunk.data)))] = 1
    piece[1:n][chunk.rows[1:] != chunk.rows[:-1]] = 1
    piece = np.cumsum(piece)
    out = []
    for k in sizes:
        made = np.zeros(chunk.own, "u8")
        m = min(chunk.own, n - k + 1)
        if m > 0:
            start = np.flatnonzero(piece[:m] == piece[k - 1 : k - 1 + m])
            found = mixed(spans.span_prints(prefix, start, start + k, spans.WORD_POWERS) ^ tenant[chunk.rows[start]])
            if bits < 64:
                found &= np.uint64((1 << bits) - 1)
            made[start] = np.maximum(found, np.uint64(1))
        out.append(made)
    return out


def tenants(langs: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Names of languages and a number for each."""
    from xxhash import xxh3_64_intdigest

    names = ["und" if x is None else x for x in langs]
    known = {x: xxh3_64_intdigest(x) for x in {*names}}
    return names, np.array([known[x] for x in names], "u8")


class Filter:
    """A bit for each value of the last bits of a fingerprint that is frequent."""

    def __init__(self, parts: dict[int, bytes], bits: int):
        self.bits = bits
        self.flags = np.zeros(1 << max(0, bits - 3), "u1")
        size = 1 << min(bits, FILTER_PART) - 3
        for i, raw in parts.items():
            self.flags[i * size : (i + 1) * size] = np.frombuffer(raw, "u1")

    def __call__(self, prints: np.ndarray) -> np.ndarray:
        low = (prints & np.uint64((1 << self.bits) - 1)).astype("i8")
        return (self.flags[low >> 3] >> (low & 7).astype("u1") & 1).astype(bool) & (prints != 0)


def filter_of(frequent: DataFrame, bits: int = FILTER_BITS) -> Filter:
    """The filter of a table's fingerprints (column print): 2**(bits - 3) bytes to the driver, however many there are."""
    part = min(bits, FILTER_PART)
    which = F.shiftright(F.col("print").bitwiseAND((1 << bits) - 1), part).cast("int")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            prints = batch.column("print").to_numpy().astype("i8") & ((1 << bits) - 1)
            for i in np.unique(prints >> part).tolist():
                flags = held.setdefault(i, np.zeros(1 << part, bool))
                flags[prints[prints >> part == i] & ((1 << part) - 1)] = True
        for i, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["part", "flags"])

    rows = frequent.select("print").repartitionById(1 << bits - part, which).mapInArrow(mark, "part int, flags binary").collect()
    return Filter({r["part"]: r["flags"] for r in rows}, bits)


COUNTS = "print long, n long, lang string"


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints once each, with the sums of their counts."""
    prints, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(prints)
    prints = prints[order]
    first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1]))[: len(prints)])
    return prints[first], np.add.reduceat(n[order], first) if len(first) else n


def count_runs(docs: DataFrame, k: int, may: Filter | None, bits: int = 64, chunk_bytes: int = spans.CHUNK) -> DataFrame:
    """Rows of COUNTS for runs of k words, added up by task; for k = 1 also a row without a fingerprint for each
    language, with its words."""
    sent = docs.sparkSession.sparkContext.broadcast(may)  # 2**(FILTER_BITS - 3) bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, fresh, size, parts, words = sent.value, [], 0, [], {}

        def out() -> pa.RecordBatch:
            prints, n = added(parts)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(prints.view("i8")), pa.array(n), pa.nulls(len(n), pa.string())], [x.split()[0] for x in COUNTS.split(", ")])

        def settle() -> None:
            nonlocal size
            if size:
                parts.append(np.unique(np.concatenate(fresh), return_counts=True))
            fresh.clear()
            size = 0

        for batch in slices(batches, rows=4096):
            names, tenant = tenants(batch.column("lang").to_pylist())
            for chunk in spans.chunks(batch.column("text"), WORD, LONGEST - 1, chunk_bytes):
                if k == 1:
                    (found,) = runs(chunk, tenant, (1,), bits)
                    for row, n in enumerate(np.bincount(chunk.rows[: chunk.own]).tolist()):
                        if n:
                            words[names[row]] = words.get(names[row], 0) + n
                else:
                    shorter, found = runs(chunk, tenant, (k - 1, k), bits)
                    fits = may(shorter)
                    later = np.ones(chunk.own, bool)  # after the last own word the next part goes on
                    later[:-1] = fits[1:]
                    found = found[(found != 0) & fits & later]
                fresh.append(found)
                size += len(found)
                if size >= HELD:
                    settle()
                    if sum(len(x) for x, _ in parts) >= 4 * HELD:
                        yield out()
        settle()
        if parts:
            yield out()
        if words:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(words.values(), pa.int64()), pa.array(words.keys(), pa.string())], [x.split()[0] for x in COUNTS.split(", ")])

    return docs.select("lang", "text").mapInArrow(run, COUNTS)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges [start, start + size), one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Words:
    """Numbers of words of a task, equal for equal words only: words with one fingerprint are compared by their bytes."""

    def __init__(self) -> None:
        self.prints, self.numbers = np.zeros(0, "u8"), np.zeros(0, "i8")  # by fingerprint
        self.bytes, self.ends = [np.zeros(0, "u1")], [np.zeros(0, "i8")]
        self.count = self.size = 0
        self.odd: dict[bytes, int] = {}  # words whose fingerprint another word had first

    def arena(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all words one after the other, and where each starts, and the last ends."""
        self.bytes, self.ends = [np.concatenate(self.bytes)], [np.concatenate(self.ends)]
        return self.bytes[0], np.concatenate((np.zeros(1, "i8"), self.ends[0]))

    def add(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        self.bytes.append(raw)
        self.ends.append(self.size + np.cumsum(sizes))
        self.size += len(raw)
        self.count += len(sizes)
        return np.arange(self.count - len(sizes), self.count)

    def number(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, prints: np.ndarray) -> np.ndarray:
        found, first, place = np.unique(prints, return_index=True, return_inverse=True)
        at = np.searchsorted(self.prints, found)
        known = self.prints[np.minimum(at, len(self.prints) - 1)] == found if len(self.prints) else np.zeros(len(found), bool)
        new = first[~known]
        fresh = self.add(data[ranges(starts[new], sizes[new])], sizes[new])
        numbers = np.zeros(len(found), "i8")
        numbers[known], numbers[~known] = self.numbers[at[known]], fresh
        self.prints, self.numbers = np.insert(self.prints, at[~known], found[~known]), np.insert(self.numbers, at[~known], fresh)
        out = numbers[place]
        arena, begins = self.arena()
        odd = begins[out + 1] - begins[out] != sizes
        same = np.flatnonzero(~odd)
        differs = data[ranges(starts[same], sizes[same])] != arena[ranges(begins[out[same]], sizes[same])]
        if differs.any():
            odd[same[np.add.reduceat(differs, np.cumsum(sizes[same]) - sizes[same]) > 0]] = True
        for i in np.flatnonzero(odd).tolist():
            word = data[starts[i] : starts[i] + sizes[i]].tobytes()
            if word not in self.odd:
                self.odd[word] = int(self.add(np.frombuffer(word, "u1"), sizes[i : i + 1])[0])
            out[i] = self.odd[word]
        return out

    def spelt(self, numbers: list[np.ndarray]) -> pa.Array:
        """Phrases of the words whose numbers stand at one place of each array, with a blank between words."""
        arena, begins = self.arena()
        sizes = [begins[x + 1] - begins[x] for x in numbers]
        ends = np.cumsum(sum(sizes) + len(numbers) - 1)
        out = np.full(int(ends[-1]), ord(" "), "u1")
        at = np.concatenate(([0], ends[:-1]))
        for x, n in zip(numbers, sizes):
            out[ranges(at, n)] = arena[ranges(begins[x], n)]
            at = at + n + 1
        offsets = np.concatenate(([0], ends)).astype("i4")
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def counted(columns: list[np.ndarray], n: np.ndarray, doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows that are equal in all columns once, with the sum of n and the smallest doc. The first column is sorted by;
    the others as well where they differ within one of its values."""
    order = np.argsort(columns[0])
    for _ in range(2):
        held = [x[order] for x in columns]
        step = held[0][1:] != held[0][:-1]
        new = step.copy()
        for x in held[1:]:
            new |= x[1:] != x[:-1]
        if (new == step).all():
            break
        order = np.lexsort(columns[::-1])
    first = np.flatnonzero(np.concatenate(([True], new)))
    return [x[first] for x in held], np.add.reduceat(n[order], first), np.minimum.reduceat(doc[order], first)


PHRASES = "lang string, words int, phrase binary, n long, doc_id long"
NONE = np.iinfo("i8").max


def spell_runs(docs: DataFrame, may: list[Filter], bits: int = 64, chunk_bytes: int = spans.CHUNK) -> DataFrame:
    """Rows of PHRASES by task: each run whose fingerprint may be frequent, counted by its text."""
    sent = docs.sparkSession.sparkContext.broadcast(may)  # LONGEST filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, langs = Words(), {}
        held: dict[int, list] = {k: [] for k in range(1, LONGEST + 1)}

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal table
            names = pa.array(list(langs), pa.string())
            for k, parts in held.items():
                if parts:
                    columns, n, doc = counted([np.concatenate(x) for x in zip(*(p[0] for p in parts))], *(np.concatenate(x) for x in zip(*(p[1:] for p in parts))))
                    for low in range(0, len(n), HELD):
                        high = low + HELD
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(columns[1][low:high])), pa.array(np.full(len(n[low:high]), k), pa.int32()), table.spelt([x[low:high] for x in columns[2:]]), pa.array(n[low:high]), pa.array(doc[low:high], mask=doc[low:high] == NONE)], [x.split()[0] for x in PHRASES.split(", ")])
                    parts.clear()
            table = Words()

        for batch in slices(batches, rows=4096):
            names, tenant = tenants(batch.column("lang").to_pylist())
            lang = np.array([langs.setdefault(x, len(langs)) for x in names], "i4")
            ids = batch.column("doc_id").fill_null(NONE).to_numpy()
            for chunk in spans.chunks(batch.column("text"), WORD, LONGEST - 1, chunk_bytes):
                if not chunk.own:
                    continue
                words = chunk.prints()
                all_runs = runs(chunk, tenant, tuple(range(1, LONGEST + 1)), bits, words)
                # a frequent run's words are frequent; those after the last own one may be
                asked = np.ones(len(words), bool)
                asked[: chunk.own] = may[0](all_runs[0])
                mine = np.flatnonzero(asked)
                number = np.full(len(words), -1, "i4")
                number[mine] = table.number(chunk.data, chunk.starts[mine], (chunk.ends - chunk.starts)[mine], words[mine] if bits == 64 else words[mine] & np.uint64((1 << bits) - 1))
                for k, found in enumerate(all_runs, 1):
                    at = np.flatnonzero(may[k - 1](found))
                    at = at[np.all([number[at + j] >= 0 for j in range(k)], axis=0)]
                    if len(at):
                        held[k].append(counted([found[at], lang[chunk.rows[at]], *(number[at + j] for j in range(k))], np.ones(len(at), "i8"), ids[chunk.rows[at]]))
            for k, parts in held.items():
                if sum(len(p[1]) for p in parts) > 4 * HELD:
                    held[k] = [counted([np.concatenate(x) for x in zip(*(p[0] for p in parts))], *(np.concatenate(x) for x in zip(*(p[1:] for p in parts))))]
            if sum(len(p[1]) for parts in held.values() for p in parts) > 8 * HELD:
                yield from out()
        yield from out()

    return docs.mapInArrow(run, PHRASES)


def frequent_phrases(docs: DataFrame, least: int = 10, bits: int = 64, filter_bits: int = FILTER_BITS, chunk_bytes: int = spans.CHUNK) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to LONGEST words with at least `least` occurrences in their lang (lang, words, phrase, n, doc_id:
    the smallest), and the words of each lang (lang, n), of docs(doc_id, lang, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "lang", "text")
    may: list[Filter] = []
    totals = None
    for k in range(1, LONGEST + 1):
        # tasks have added up their rows: they are dealt as they are, and a fingerprint's few sums meet in its partition
        dealt = count_runs(docs, k, may[-1] if may else None, bits, chunk_bytes).repartition("print", "lang")
        counted = stored(dealt.groupBy("print", "lang").agg(F.sum("n").alias("n")).where(F.col("print").isNull() | (F.col("n") >= least)), f"runs-{k}")
        if k == 1:
            totals = counted.where(F.col("print").isNull()).select("lang", "n")
            once = counted
        may.append(filter_of(counted.where(F.col("print").isNotNull()), filter_bits))
        if k > 1:
            forget(counted)
    spelt = spell_runs(docs, may, bits, 4 * chunk_bytes).repartition("lang", "words", "phrase").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id")).where(F.col("n") >= least)
    found = stored(spelt.select("lang", "words", F.col("phrase").cast("string").alias("phrase"), "n", "doc_id"), "phrases")
    totals = stored(totals, "words")
    forget(once)
    return found, totals


def collocations(docs: DataFrame, least: int = 10, inside: int = 50, k: int = 2000, bits: int = 64, filter_bits: int = FILTER_BITS, chunk_bytes: int = spans.CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, first_doc: each lang's k best phrases of two or more words.

    A phrase goes if a longer one holds it in at least `inside` percent of its occurrences. Arithmetic is in whole
    numbers of 38 digits.
    """
    found, totals = frequent_phrases(docs, least, bits, filter_bits, chunk_bytes)
    part = found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    cut = found.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    met = cut.join(part.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(part.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("cast((cast(n as decimal(18, 0)) * cast(n as decimal(18, 0)) * cast(1000000 as decimal(7, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0))) as bigint)")
    met = met.withColumn("score", score)
    best = met.groupBy("lang", "words", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("n").alias("a"), F.first("doc_id").alias("first_doc"))
    # what is one word longer is enough: a phrase inside one that is longer still is inside one of these, as often
    longer = found.where("words > 2").select("lang", F.col("n").alias("f"), F.explode(F.expr("array(substring_index(phrase, ' ', words - 1), substring_index(phrase, ' ', 1 - words))")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("f").isNull() | (100 * F.col("f") < inside * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score", "first_doc")
