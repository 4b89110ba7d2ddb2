"""Operator 5, toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts train a linear model on words and word beginnings. The risk is
pi * R+(positive) + max(0, R-(unlabelled) - pi * R-(positive)) with logistic loss, pi the class prior; where the
second part falls below zero its gradient is reversed, as the non-negative estimator prescribes. The model is fitted
with numpy on the driver from a bounded sample (POSITIVES and UNLABELLED rows at most, chosen by hash); class prior
and scores cover all rows. Texts are scored whole. Null and empty texts get the score of the intercept. With no
positive row every score is 0. Features come from the text alone. A doc_id with several labels is toxic if one says so;
rows that share a doc_id are scored each by its own text, equal texts alike. Rows with a null doc_id are scored and never
learned from. An empty table gives no rows. Extra columns are not returned by score, and kept by clean.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

#: Most rows of each kind that the fit uses.
POSITIVES, UNLABELLED = 6_000, 12_000
#: Documents of the positive sample that a feature must be in, and times its rate must exceed the unlabelled rate.
LEAST_DOCS, LEAST_LIFT = 4, 2.5
#: Pieces that a worker keeps: about 350 bytes each with their hashes.
_MEMO = 150_000


def features_of(piece: str) -> tuple[int, ...]:
    """Hashes of a blank-separated piece: the word without punctuation, and its first 4 to 6 letters."""
    word = piece.strip(".,;:!?\"'()[]{}<>*$%&#-_…«»“”„¿¡")
    if not word:
        return ()
    return tuple(dict.fromkeys(zlib.crc32(x.encode()) for x in (f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n))))


def features(text: str, memo: dict[str, tuple[int, ...]]) -> set[int]:
    if len(memo) > _MEMO:
        memo.clear()
    out: set[int] = set()
    for piece in set(text.lower().split()):
        found = memo.get(piece)
        if found is None:
            found = memo[piece] = features_of(piece)
        out.update(found)
    return out


def found_in(text: str, weights: dict[int, float], memo: dict[str, tuple[int, ...]]) -> set[int]:
    """Features of a text that have a weight."""
    if len(memo) > _MEMO:
        memo.clear()
    out: set[int] = set()
    for piece in set(text.lower().split()):
        some = memo.get(piece)
        if some is None:
            some = memo[piece] = tuple(f for f in features_of(piece) if f in weights)
        if some:
            out.update(some)
    return out


@dataclass
class Model:
    intercept: float
    weights: dict[int, float]
    prior: float

    def score(self, found: set[int]) -> float:
        if not self.prior:
            return 0.0
        z = self.intercept + sum(self.weights[f] for f in found)
        return float(1 / (1 + np.exp(-min(max(z, -500), 500))))


class Rows:
    """Feature hashes of many texts in one array, with the count of each text."""

    def __init__(self, lengths: np.ndarray, values: np.ndarray):
        self.lengths, self.values = lengths, values

    def __len__(self) -> int:
        return len(self.lengths)


def _flat(rows: list[list[int]] | Rows) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(rows, Rows):
        return np.repeat(np.arange(len(rows), dtype="i4"), rows.lengths), rows.values
    return np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.array([f for x in rows for f in x], "i8")


def fit(positive: list | Rows, unlabelled: list | Rows, prior: float, rounds: int = 400, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """nnPU on lists of feature hashes; full gradients with Adam."""
    if not len(positive) or not len(unlabelled) or prior <= 0:
        return Model(0.0, {}, 0.0)
    pos_row, pos = _flat(positive)
    unl_row, unl = _flat(unlabelled)
    names, counts = np.unique(pos, return_counts=True)
    kept, unl_counts = np.unique(unl, return_counts=True)
    at = np.searchsorted(kept, names)
    seen = np.where((at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == names), unl_counts[np.minimum(at, len(kept) - 1)], 0) if len(kept) else np.zeros(len(names), "i8")
    lift = (counts / len(positive)) / ((seen + 1) / len(unlabelled))
    names = names[(counts >= LEAST_DOCS) & (lift >= LEAST_LIFT)]

    def columns(row, f):
        i = np.searchsorted(names, f)
        ok = (i < len(names)) & (names[np.minimum(i, len(names) - 1)] == f) if len(names) else np.zeros(len(f), bool)
        return row[ok], i[ok]

    pr, pc = columns(pos_row, pos)
    ur, uc = columns(unl_row, unl)
    w, b = np.zeros(len(names)), np.log(prior / (1 - prior)) if prior < 1 else 5.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for t in range(1, rounds + 1):
        zp = b + np.bincount(pr, w[pc], len(positive))
        zu = b + np.bincount(ur, w[uc], len(unlabelled))
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp = prior * (sp - 1) / len(positive)  # of pi * R+
        np_, nu = -prior * sp / len(positive), su / len(unlabelled)  # of R-(u) - pi * R-(p)
        if negative < 0:
            gp, np_, nu = 0 * gp, -np_, -nu
        gp = gp + np_
        g = np.concatenate((np.bincount(pc, gp[pr], len(names)) + np.bincount(uc, nu[ur], len(names)) + decay * w, [gp.sum() + nu.sum()]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(float(b), dict(zip(names.tolist(), w.tolist())), prior)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from documents and labels(doc_id, toxic); rows of the held-out fold give no label and no text."""
    toxic = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = toxic.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    if not counts["pos"]:
        return Model(0.0, {}, 0.0)
    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text")
    total = texts.select("doc_id").count()

    def share(bound: int, count: int, *by: str) -> Column:
        return F.pmod(F.xxhash64(*by, F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, bound / max(count, 1)) * (1 << 30))

    def rows(df: DataFrame, bound: int, wanted: np.ndarray | None = None) -> Rows:
        """Features of the sampled texts, a twentieth more than `bound` at most, those in `wanted` only where given, as one array."""

        def among(f: np.ndarray) -> np.ndarray:
            if not len(wanted):
                return np.zeros(len(f), bool)
            return wanted[np.minimum(np.searchsorted(wanted, f), len(wanted) - 1)] == f

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo: dict = {}
            for batch in slices(batches):
                found = [np.fromiter(x := features(t, memo), "u4", len(x)) for t in texts_of(batch)]
                found = [np.sort(f if wanted is None else f[among(f)]).tobytes() for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["found"])

        made = [np.frombuffer(x.as_py(), "u4") for x in df.select("text").mapInArrow(run, "found binary").limit(bound + bound // 20).toArrow().column("found")]
        return Rows(np.array([len(x) for x in made], "i8"), np.concatenate([*made, np.zeros(0, "u4")]))

    positive = toxic.where((F.col("toxic") == 1) & share(POSITIVES, int(counts["pos"]), "doc_id")).select("doc_id")
    prior = counts["pos"] / counts["n"]
    # a share of the distinct positive ids by hash, about POSITIVES of them at any size, so they can be broadcast and no
    # text is shuffled; rows are counted too, so an id with very many of them brings no more to the driver
    known = rows(texts.join(F.broadcast(positive.limit(POSITIVES + POSITIVES // 20)), "doc_id", "left_semi"), POSITIVES)
    names, often = np.unique(known.values, return_counts=True)
    # features of fewer positive texts get no weight, so nothing is asked about them
    return fit(known, rows(texts.where(share(UNLABELLED, total, "doc_id", "text")), UNLABELLED, names[often >= LEAST_DOCS]), min(prior, 0.99))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. The model is as large as its feature list (bounded sample)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = shared.value, {}
        weights = model.weights
        for batch in slices(batches):
            out = []
            for text in texts_of(batch):
                out.append(model.score(found_in(text, weights, memo)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under the threshold, unchanged: one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = shared.value, {}
        for batch in slices(batches):
            keep = [model.score(found_in(text, model.weights, memo)) < threshold for text in texts_of(batch)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
