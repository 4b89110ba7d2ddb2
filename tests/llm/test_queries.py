"""Registered queries over the small tables against the libraries and plain loops, and pipeline stages on odd tables."""

import hashlib
import math
import zlib

import numpy as np
import pytest

import corpus_pipeline
from setloom.llm import fingerprints, queries, toxicity
from setloom.llm.common import table
from setloom.llm.queries import vocabulary


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    return {d: [*library.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_op1_against_the_library(spark, sf_dir, ids):
    start, wanted = 0, set()
    for d in sorted(ids):
        wanted.add((d, start, len(ids[d]), crc(ids[d])))
        start += len(ids[d])
    made = queries.QUERIES["op1_token_ids"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert len(made) == len(wanted) and {tuple(r) for r in made} == wanted


def test_op4_against_the_library(spark, sf_dir, texts):
    import sys

    sys.path.insert(0, "/opt/tokenizers")
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(vocabulary("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    made = {r.doc_id: r for r in queries.QUERIES["op4_byte_bpe"](spark, sf_dir).collect()}
    assert made.keys() == texts.keys()
    for d, t in texts.items():
        x = library.encode_ordinary(t)
        assert (made[d].n_tokens, made[d].ids_sha256, made[d].decoded_sha256) == (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op10_holds_each_id_once(spark, sf_dir, ids):
    made = queries.QUERIES["op10_packing"](spark, sf_dir).collect()
    pieces, sequences = {}, {}
    for r in made:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == ids.keys()
    for d, x in pieces.items():
        at = 0
        for r in sorted(x, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d]) and r.ids_crc32 == crc(ids[d][at : at + r.length])
            at += r.length
        assert at == len(ids[d])
    padded = 0
    for x in sequences.values():
        at = 0
        for r in sorted(x, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    assert padded <= 0.01 * sum(map(len, ids.values()))


def test_op3_and_op6_cover_every_document(spark, sf_dir, texts):
    for name in ("op3_substring_dedup", "op6_near_duplicates"):
        made = queries.QUERIES[name](spark, sf_dir)
        assert "doc_id" in made.columns and {r.doc_id for r in made.select("doc_id").collect()} <= texts.keys(), name


def plain_chunks(raw):
    """Chunk ends by one loop over the bytes, each with the hash of the 32 bytes up to it."""
    ends, begin, h = [], 0, 0
    for i, b in enumerate(raw):
        h = (h * 2 + int(fingerprints._GEAR[b])) % 2**32  # a byte leaves after 32 doublings
        n = i + 1 - begin
        zeros = 7 if n <= fingerprints.NORMAL else 5
        if n >= fingerprints.LOWEST and h >> 32 - zeros == 0 or n == fingerprints.HIGHEST or i + 1 == len(raw):
            ends.append(i + 1)
            begin = i + 1
    return ends


def test_op2_against_a_loop_over_bytes(spark, sf_dir, texts):
    from xxhash import xxh64_intdigest

    made = {r.doc_id: r for r in queries.QUERIES["op2_fingerprints"](spark, sf_dir).collect()}
    assert made.keys() == texts.keys()
    order = sorted(texts)

    def plain(text):
        raw, ends = text.encode(), plain_chunks(text.encode())
        return {xxh64_intdigest(raw[i:j]) >> 10 << 10 | j - i - 1 for i, j in zip([0, *ends], ends)}

    def like(a, b):
        size = lambda s: sum((w & 1023) + 1 for w in s)
        return size(a & b) / min(size(a), size(b)) if min(size(a), size(b)) else float(len(a) == len(b))

    for d, after in [*zip(order, [*order[1:], order[0]])][:60]:
        text, following = texts[d], texts[after]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = plain(text), plain(edited), plain(following)
        shown = lambda s: "".join(f"{w:016x}" for w in sorted(s))
        assert (made[d].n_chars, made[d].fingerprint, made[d].edited_fingerprint) == (len(text), shown(a), shown(b))
        assert made[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert made[d].near_edited == pytest.approx(like(a, b)) and made[d].near_next == pytest.approx(like(a, c))


def test_risk_against_differences():
    """The first step goes down the risk, written as plain sums, and the fit ends where no direction lowers it by much."""
    rng = np.random.default_rng(6)
    positive = [[1] * (rng.random() < 0.8) + [2] * (rng.random() < 0.5) + [3] * (rng.random() < 0.4) for _ in range(60)]
    unlabelled = [[1] * (rng.random() < 0.2) + [2] * (rng.random() < 0.15) + [3] * (rng.random() < 0.1) + [4] for _ in range(300)]
    prior, decay = 0.1, 1e-4

    def parts(b, w):
        z = lambda x: b + sum(w.get(f, 0.0) for f in x)
        soft = lambda v: math.log1p(math.exp(v))
        up = prior * sum(soft(-z(x)) for x in positive) / len(positive)
        down = sum(soft(z(x)) for x in unlabelled) / len(unlabelled) - prior * sum(soft(z(x)) for x in positive) / len(positive)
        return up, down, decay * sum(v * v for v in w.values()) / 2

    def risk(b, w):
        up, down, size = parts(b, w)
        return up + max(down, 0.0) + size

    begin, e = math.log(prior / (1 - prior)), 1e-6
    first = toxicity.fit(positive, unlabelled, prior, rounds=1, rate=0.01, decay=decay)
    assert parts(begin, {})[1] > 0 and set(first.weights) == {1, 2, 3}
    slopes = {f: risk(begin, {f: e}) - risk(begin, {f: -e}) for f in first.weights}
    assert {f: np.sign(v) for f, v in first.weights.items()} == {f: -np.sign(v) for f, v in slopes.items()}
    assert abs(risk(begin + e, {}) - risk(begin - e, {})) < 1e-12  # the prior's own intercept is level

    model = toxicity.fit(positive, unlabelled, prior, rounds=4000, rate=0.02, decay=decay)
    best = risk(model.intercept, model.weights)
    assert best < risk(begin, {}) and parts(model.intercept, model.weights)[1] > -0.01
    for step in (0.05, -0.05):
        assert risk(model.intercept + step, model.weights) > best - 1e-3
        for f in model.weights:
            assert risk(model.intercept, {**model.weights, f: model.weights[f] + step}) > best - 1e-3


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """documents with null ids, null and empty texts, repeated rows, a copy of a document and columns named as the stages' own."""
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents")
    some = docs.where("text is not null").orderBy("doc_id").limit(1)
    copy = some.withColumn("doc_id", F.lit(10**12).cast(docs.schema["doc_id"].dataType))
    nameless = some.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)).withColumn("text", F.lit("words of nobody that stand nowhere else"))
    blank = [copy.withColumn("doc_id", (F.lit(10**12) + i).cast(docs.schema["doc_id"].dataType)).withColumn("text", F.lit(t).cast("string")) for i, t in ((1, None), (2, ""))]
    made = docs.unionByName(some).unionByName(copy).unionByName(nameless)
    for b in blank:
        made = made.unionByName(b)
    return made.withColumns({c: F.lit(7) for c in ("score", "part", "key", "class_id", "ids")})


def test_stages_of_odd_rows(spark, sf_dir, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        left = after.collect()
        assert {r.part for r in left} == {7}, name
        assert sum(r.doc_id is None for r in left) == 1, name
        by_id = {r.doc_id: r.text for r in left}
        assert 10**12 + 1 in by_id or 10**12 + 2 in by_id, name
        if name == "near_dedup":
            assert len(by_id) == len(left) and 10**12 not in by_id
        docs = spark.createDataFrame(left, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_stages_of_nothing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name
