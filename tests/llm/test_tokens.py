import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from setloom.llm import bitpack, bpe, bytelevel, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "  ", "a  b", "a   b", "a \n b\n\n c ", "it's we'll 'll 're they've'd", "x<|endoftext|>y <|endoftext|>", "<|endoftext|", "日本語テキスト です", "a\xa0b 　c", "\x1c\x1d a\x1c b", "émile ça va?  \n", "!" * 100, "=" * 300, "😀😀 a😀", "'", "!'ll", "a\r\nb \r\n c", "word " * 50 + "\t\tz", "x" * 3000]


def odd_texts(n):
    rng = random.Random(5)
    alphabet = " \n\t'abdelmrstv.,!1<|é日😀\xa0\x1c　"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    texts = odd_texts(1000)
    assert [np.frombuffer(x, "<u2").tolist() for x in bpe.load_json(JSON).encode_many(texts)] == [ids_of(library, x) for x in texts]


def test_small_store_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 20)
    c = bpe.Bpe(Tokenizer.from_file(JSON), True)
    texts = odd_texts(100) + ["some words that recur and some that do not " * 3, "other words recur too"] * 3
    for i in range(0, len(texts), 7):
        part = texts[i : i + 7]
        assert [np.frombuffer(x, "<u2").tolist() for x in c.encode_many(part)] == [ids_of(library, x) for x in part]
        c.learn_counts(part)
        assert [(token_counts.boundary_counts(c, x)[1] or [0])[-1] for x in part] == [len(ids_of(library, x)) for x in part]


def test_words_of_a_batch_are_looked_up_by_columns(library, monkeypatch):
    c = bpe.Bpe(Tokenizer.from_file(JSON), True)
    rng = random.Random(3)
    words = ["".join(rng.choice("abdéstÀ") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    marks = ["", ",", "***", ".\n", "\n", "!?", "'", "'s", "-", "$%", ".\n\n", "\t", "²", "日"]
    texts = [" ".join(rng.choice(words) + rng.choice(marks) + rng.choice(["", "", rng.choice(words)]) for _ in range(60)) for _ in range(60)]
    exact = [ids_of(library, x) for x in texts]
    asked = []
    monkeypatch.setattr(c, "learn", lambda x, f=c.learn: (asked.extend(x), f(x)))
    assert [np.frombuffer(x, "<u2").tolist() for x in c.encode_many(texts)] == exact
    # words, and words with marks or after a line end, are not learned one by one
    assert asked and not [p for p in asked if p.rstrip(bpe._MARKS).removeprefix("\n").isalpha() and "日" not in p]
    monkeypatch.setattr(c, "memo", 100)
    for i in range(0, 60, 4):
        assert [np.frombuffer(x, "<u2").tolist() for x in c.encode_many(texts[i : i + 4])] == exact[i : i + 4]
        assert len(c.words) == len(c.word_ids) <= 400 * 4


def test_ranks_equal_tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.load_ranks(RANKS)
    for text in odd_texts(1000):
        assert c.ids(text).tolist() == exact.encode_ordinary(text)
        assert c.decode(c.ids(text)) == text.encode()


def test_prefix_counts_equal_brute_force(library):
    c = bpe.load_json(JSON)
    for text in (x for x in odd_texts(300) if len(x) < 400):
        exact = [len(ids_of(library, text[:i])) for i in range(len(text) + 1)]
        assert token_counts.every_prefix(c, text).tolist() == exact[1:]
        made = token_counts.boundary_counts(c, text)
        assert [token_counts.count_at(c, text, *made, i) for i in range(len(text) + 1)] == exact
        for budget in (0, 1, 3, 10):
            assert token_counts.longest_prefix(c, text, *made, budget) == max(i for i, n in enumerate(exact) if n <= budget)


def test_count_tokens(spark, library):
    texts = [*odd_texts(30), None]
    rows = token_counts.count_tokens(docs(spark, texts), JSON, keep_table=True).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        n = len(ids_of(library, text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)
    assert token_counts.count_tokens(docs(spark, []), JSON).count() == 0


def test_query_stores_the_count_of_every_prefix(spark, library, monkeypatch, tmp_path):
    from setloom.llm import queries

    texts = [*(x for x in odd_texts(60) if len(x) < 400), None, "many words and more " * 150]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    tables, write = [], token_counts.write_prefixes
    monkeypatch.setattr(token_counts, "write_prefixes", lambda *x: tables.append(write(*x)) or tables[-1])
    made = {r.doc_id: r for r in queries.op7_token_counts(spark, str(tmp_path)).collect()}
    kept = {r.doc_id: np.cumsum(np.frombuffer(r.changes, "i1"), dtype="i8").tolist() for r in tables[0].collect()}
    for i, text in enumerate(texts):
        text = text or ""
        exact = [len(ids_of(library, text[:n])) for n in range(len(text) + 1)]
        assert kept[i] == exact[1:]
        assert (made[i].n_bytes, made[i].n_tokens, made[i].over_limit) == (len(text.encode()), exact[-1], exact[-1] > 512)
        assert made[i].fit_chars == max(n for n, count in enumerate(exact) if count <= 512)
    small = {r.doc_id: r.fit_chars for r in token_counts.counts_of(tables[0], 3).collect()}
    assert all(small[i] == max([0, *(n + 1 for n, count in enumerate(x) if count <= 3)]) for i, x in kept.items())


def test_other_vocabulary_goes_to_the_library_whole(spark):
    path = P.path("word_bpe_49k.json")
    exact = Tokenizer.from_file(path)
    texts = ["Hello  World", "ÀB c", None]
    rows = token_counts.count_tokens(docs(spark, texts), path).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(exact.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_bit_packing_round_trip(width):
    ids = np.random.default_rng(1).integers(0, 2**width, 1000, dtype="u8").astype("u4")
    packed = bitpack.pack(ids, width)
    assert len(packed) == -(-1000 * width // 8)
    assert (bitpack.read_ids(packed, width, 1000) == ids).all()
    assert (bitpack.read_span(packed, width, 333, 77) == ids[333:410]).all()


@pytest.mark.parametrize("block", [1, 50, 1 << 16])
def test_written_ids_read_back(spark, library, block):
    texts = [*odd_texts(60), None]
    df = docs(spark, texts).repartition(5)
    rows = bitpack.read_documents(bitpack.write_blocks(df, JSON, block_ids=block)).orderBy("doc_id").collect()
    start = 0
    for r, text in zip(rows, texts, strict=True):
        ids = [*ids_of(library, text), 0]
        assert (r.start, r.n_tokens, r.width) == (start, len(ids), 16)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_written_ids_odd_tables(spark):
    assert bitpack.read_documents(bitpack.write_blocks(docs(spark, []), JSON)).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (1, None)], "doc_id long, text string")
    rows = bitpack.read_documents(bitpack.write_blocks(twice, JSON)).collect()
    assert sorted(r.start for r in rows) == sorted([0, *np.cumsum([r.n_tokens for r in sorted(rows, key=lambda r: r.start)])[:-1].tolist()])
    assert next(r for r in rows if r.doc_id is None).start == 0


def test_encode_and_decode_frames(spark):
    texts = [*odd_texts(20), None]
    made = bytelevel.with_digest(bytelevel.decode(bytelevel.encode(docs(spark, texts), RANKS), RANKS)).collect()
    digests = {r.doc_id: r for r in bytelevel.round_trip(docs(spark, texts), RANKS).collect()}
    for r in made:
        text = texts[r.doc_id] or ""
        assert r.decoded == text and digests[r.doc_id].ids_sha256 == r.ids_sha256
        assert digests[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        pieces = np.diff([*r.offsets, len(text.encode())])
        assert (pieces > 0).all() and len(r.ids) == len(r.offsets)
    cut = spark.createDataFrame([(1, made[13].ids[:1]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bytelevel.decode(cut, RANKS).collect()}[2] is None
