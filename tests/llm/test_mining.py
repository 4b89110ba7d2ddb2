"""Mixing, ranked search and phrase mining against plain versions; nulls, ties, repeats, long texts, empty tables."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from setloom.llm import lexical, mixing, phrases, queries, spans

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def text(rng, n, words=300):
    common = ["the", "Of", "and", "a", "É", "x1"]
    return "".join((rng.choice(common) if rng.random() < 0.5 else f"w{min(words, int(rng.expovariate(0.03)))}") + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(n))


@pytest.mark.parametrize("name", ["op11_mixing", "op12_ranked_search", "op13_collocations"])
def test_queries_equal_duckdb(spark, sf_dir, name):
    con = duckdb.connect(config={"memory_limit": "3GB", "threads": 4})
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    made = queries.QUERIES[name](spark, sf_dir)
    exact = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in exact.description]
    want = sorted(map(repr, exact.fetchall()))
    assert want and sorted(repr(tuple(r[c] for c in columns)) for r in made.collect()) == want


def test_spans_against_patterns():
    rng = random.Random(1)
    texts = [None, "", *("".join(rng.choice("aBc .,\té\n") for _ in range(rng.randrange(300))) for _ in range(200))]
    found = {}
    for chunk in spans.chunks(pa.array(texts).slice(1), phrases.WORD, 2, 100):
        prints, known = chunk.prints(), {}
        for i in range(len(chunk.starts)):
            assert known.setdefault(int(prints[i]), chunk.word(i)) == chunk.word(i)
            if i < chunk.own:
                found.setdefault(int(chunk.rows[i]), []).append((chunk.word(i), int(chunk.places[i])))
    for i, t in enumerate(texts[1:]):
        raw = (t or "").encode()
        assert found.get(i, []) == [(m.group().lower(), m.start()) for m in re.finditer(rb"[^ \t\n\v\f\r.,;:!?]+", raw)]


def plain_search(docs, items, k=10):
    terms = [[x.translate(LETTERS) for x in TERM.findall(t or "")] for _, t in docs]
    n, words = sum(map(bool, terms)), sum(map(len, terms))
    df, out = collections.Counter(x for t in terms for x in {*t}), []
    for item, asked in items:
        rows = []
        for (doc, _), held in zip(docs, terms):
            count, score = collections.Counter(held), 0
            for x in {x.translate(LETTERS) for x in TERM.findall(asked or "")} & {*count}:
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1)))
                score += weight * (10**9 * count[x] // (1000 * count[x] + 8 * (10 + 90 * len(held) * n // words)))
            if score > 0:
                rows.append((-score, doc is not None, doc or 0))
        out += [(item, r, doc if known else None, -s) for r, (s, known, doc) in enumerate(sorted(rows)[:k], 1)]
    return out


def test_search_against_all_scores(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(lexical, "FREQUENT", 8)
    monkeypatch.setattr(lexical, "BLOCK", 10)
    docs = [(i if i % 17 else None, text(rng, rng.randrange(60))) for i in range(500)] + [(5, None), (6, ""), (7, "The the OF. and w1"), (7, "The the OF. and w1"), (8, text(rng, 3000))]
    items = [(i, text(rng, rng.randrange(20))) for i in range(25)] + [(3, None), (4, "the of"), (4, "the of")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    index = lexical.write_index(frame, shard=64, chunk_bytes=200)
    assert index[0].count() > 8
    made = lexical.search(*index, asked)
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, plain_search(docs, items)))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert not lexical.ranked(empty, asked).collect() and not lexical.ranked(frame, asked.limit(0)).collect()
    assert not lexical.ranked(empty.union(spark.createDataFrame([(1, None)], "doc_id long, text string")), asked).collect()


def test_search_skips_and_pair_bounds_are_bounds():
    rng = np.random.default_rng(2)
    builder = lexical._Builder()
    terms = np.arange(1, 41, dtype="u8") * np.uint64(977)
    for doc in range(2000):
        builder.doc_ids.append(doc)
        held = terms[rng.random(40) < np.linspace(0.7, 0.003, 40)]
        builder.add(np.full(len(held), doc), held, False)
    row = builder.closed().to_pylist()[0]
    documents, words = row["held"], row["words"]
    plain = lexical.Shard(row, documents, words)
    weights = np.array([lexical.weight(int(x), documents) for x in plain.df(terms)])
    paired = lexical.Shard(row | plain.pair_lists(terms[:12], weights[:12]), documents, words)
    read = {True: 0, False: 0}
    for _ in range(40):
        mine = np.sort(rng.choice(40, 14, replace=False))
        one, two = (s.top(terms[mine], weights[mine], 5) for s in (plain, paired))
        whole = np.zeros(2000, "i8")
        for t, w in zip(terms[mine], weights[mine]):
            doc, g = plain.impacts(int(plain.place(np.array([t], "u8"))[0]))
            whole[doc] += w * g
        least = np.sort(whole)[-5]
        for left, score, _ in (one, two):
            assert {*zip(left.tolist(), score.tolist())} == {(int(i), int(whole[i])) for i in np.flatnonzero((whole >= least) & (whole > 0))}
        read[False] += one[2]
        read[True] += two[2]
    assert read[True] < read[False]  # joint maxima let more be skipped


def plain_phrases(docs, least, inside=50):
    total, f = collections.Counter(), collections.Counter()
    for _, lang, t in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (t or "").translate(LETTERS)):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    kept = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        longer = [n for (g, q), n in f.items() if g == lang and len(q) == 3 and len(p) == 2 and n >= least and p in (q[:2], q[1:])]
        if not any(100 * n >= inside * a for n in longer):
            kept.append((lang, " ".join(p), a, l, r, total[lang], score))
    out = []
    for lang in total:
        mine = sorted((x for x in kept if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], i, *x[1:]) for i, x in enumerate(mine[:2000], 1)]
    return out


@pytest.mark.parametrize("bits,filter_bits,chunk", [(64, 24, 1 << 20), (64, 12, 300), (9, 9, 500)])
def test_phrases_with_collisions_and_long_texts(spark, monkeypatch, bits, filter_bits, chunk):
    """Nine bits make most fingerprints collide: counts by text stay exact."""
    rng = random.Random(4)
    monkeypatch.setattr(phrases, "HELD", 3000)
    docs = [(i if i % 9 else None, rng.choice(["en", "de", None, "und"]), text(rng, rng.randrange(80), 40)) for i in range(150)]
    docs += [(1, "en", None), (1, "en", ""), (2, "en", "x y. x y"), (2, "en", "x y. x y"), (3, "fr", text(rng, 2000, 20))]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, lang string, text string, n int").repartition(3)
    made = phrases.collocations(frame, least=5, bits=bits, filter_bits=filter_bits, chunk_bytes=chunk)
    found = sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in made.collect())
    assert found and found == sorted(plain_phrases(docs, 5))


def test_phrases_of_nothing(spark):
    schema = "doc_id long, lang string, text string"
    assert not phrases.collocations(spark.createDataFrame([], schema)).collect()
    assert not phrases.collocations(spark.createDataFrame([(None, None, None)], schema)).collect()


def test_mix_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 4)
    monkeypatch.setattr(mixing, "COPIES", 8)
    rng = random.Random(5)
    docs = [(i, rng.choice(["hot", "hot", "b", "ß", None]), text(rng, rng.randrange(30))) for i in range(200)]
    docs += [(7, "hot", "a b c")] * 50 + [(None, "b", "d e"), (None, "b", "f"), (9, "empty", ""), (10, "empty", None)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, words int").repartition(5)
    rows = mixing.mix(frame).collect()
    again = mixing.mix(frame.repartition(2)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again)) and len(rows) == len(docs)
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((d or -1, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, _, t in docs)
    size = collections.Counter()
    for r in rows:
        size[r.source] += r.size
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left = {}, 1.5 * sum(size.values())
    while True:  # the excess is shared again until none is above
        free = [s for s in order if s not in target]
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2.0 * size[s] for s in over)
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    for s in order:
        mine = [r for r in rows if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] for r in mine)
        assert sum(r.taken for r in mine) == math.floor(mine[0].target)
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
        cut = {(r.doc_id, r.size, r.taken) for r in mine if r.taken % max(1, r.size)}
        assert len(cut) <= 1  # one document at most is cut
    assert not mixing.mix(frame.limit(0)).collect()
    assert all(r.taken == 2 * r.size for r in mixing.mix(frame, share=(2, 1)).collect())


@pytest.mark.parametrize("size", [1e25, 1e150, 1e-150])
def test_neighbours_of_very_large_and_small_vectors(spark, size):
    from pyspark.sql import functions as F

    from setloom.llm import neighbours

    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 16)) * size
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    made = neighbours.search(rows, F.col("vec_id") % 20 == 0, k=5).collect()
    found = {(r.query_id, r.vec_id): r.score for r in made}
    assert len(found) == 20 * 5 and all(abs(s - x[q] @ x[v]) <= 1e-12 * np.abs(x[q] @ x[v]) + 1e-14 * size * size for (q, v), s in found.items())
    best = {(q, int(v)) for q in range(0, 400, 20) for v in np.argsort(-np.where(np.arange(400) == q, -np.inf, x @ x[q]))[:5]}
    assert len(best & {*found}) >= 0.9 * len(best)
