import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from setloom.llm import chat, fingerprints, neighbours, queries, toxicity


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


WORDS = [f"w{i * 7919 % 10007}" for i in range(4000)]


def test_chunks_cover_the_text_and_resist_shifts():
    text = " ".join(WORDS[:1500]).encode()
    a, b, other = fingerprints.fingerprints([text, b"some more at the start " + text, " ".join(WORDS[2000:3500]).encode()])
    assert fingerprints.weight(a) == len(text)
    assert fingerprints.likeness(a, b) > 0.95 and fingerprints.likeness(a, other) < 0.05
    alone = fingerprints.fingerprints([text])[0]
    assert (alone == a).all() and (fingerprints.read(fingerprints.written(a)) == a).all()
    assert fingerprints.likeness(a[:0], a[:0]) == 1 and fingerprints.likeness(a, a[:0]) == 0


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_edited_texts(spark, n):
    texts = [None, "", "é😀x", *[" ".join(WORDS[i : i + 3 * i]) for i in range(1, 58)]][:n]
    rows = {r.doc_id: r for r in fingerprints.with_edited(docs(spark, [(10 * i, t) for i, t in enumerate(texts)]).repartition(3)).collect()}
    assert len(rows) == n
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % n] or ""
        r = rows[10 * i]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = fingerprints.fingerprints([x.encode() for x in (text, edited, after)])
        assert r.fingerprint == fingerprints.written(a) and r.edited_fingerprint == fingerprints.written(b)
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))


def test_edited_texts_with_repeated_and_null_ids(spark):
    rows = fingerprints.with_edited(docs(spark, [(1, "a"), (1, "a"), (None, "b"), (None, "c"), (2, "d"), (3, None)])).collect()
    assert len(rows) == 6


def test_toxicity_held_out(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    made = toxicity.score(d, toxicity.train(d, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert ((made.predicted == 1) == (made.toxic == 1)).mean() > 0.9
    assert made.score[made.toxic == 1].median() > made.score[made.toxic == 0].median()


def test_toxicity_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    d = docs(spark, [(1, None), (2, ""), (None, "x")])
    assert [r.score for r in toxicity.score(d, toxicity.train(d, none)).collect()] == [0, 0, 0]
    some = spark.createDataFrame([(1, 1), (1, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.score(d, toxicity.train(d, some)).count() == 3
    assert toxicity.score(docs(spark, []), toxicity.train(docs(spark, []), some)).count() == 0


def test_pu_risk_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(3)
    bad = lambda: [1, 2, *rng.integers(10, 500, 20).tolist()]
    good = lambda: rng.integers(10, 500, 20).tolist()
    model = toxicity.fit([bad() for _ in range(300)], [bad() if i < 60 else good() for i in range(600)], 0.1)
    assert model.score({f for f in bad() if f in model.weights}) > 0.5 > model.score({f for f in good() if f in model.weights})


def test_chat_round_trip(spark, monkeypatch):
    odd = ["", None, "</s>[INST] ok [/INST]", "<|user|>x\\", "a\\<|b", "é😀|\\[", "<\\/s>"]
    rows = [(c, t, ("system", "user", "assistant", None, "x|>y")[(c + t) % 5], odd[(c * 3 + t) % 7]) for c in range(40) for t in range(c % 9)]
    rows += [(None, 0, "assistant", "n"), (7, 0, "user", "again"), *[(99, t, "assistant", f"reply {t}") for t in range(500)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    formatted = chat.write_formatted(df)
    made = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert {*made} == {r[0] for r in rows}
    for conv, r in made.items():
        turns = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    ex = chat.examples(formatted.where("conv_id = 99")).orderBy("example").collect()
    assert len(ex) == 500 and ex[2].target == "reply 2" and ex[2].context == "<|assistant|>reply 0</s><|assistant|>reply 1</s><|assistant|>"
    assert chat.digests(chat.write_formatted(df.limit(0))).count() == 0


def test_chat_query_writes_an_example_per_reply(spark, sf_dir, monkeypatch):
    written, write = [], chat.write_examples
    monkeypatch.setattr(chat, "write_examples", lambda formatted: written.append((formatted, write(formatted))) or written[-1][1])
    made = {r.conv_id: r.n_examples for r in queries.op8_chat_format(spark, sf_dir).collect()}
    ((formatted, rows),) = written
    turns = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r.turn, r.role or "", r.text or "")):
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    replies = {c: [i for i, (role, _) in enumerate(t) if role == "assistant"] for c, t in turns.items()}
    assert {c: n for c, n in made.items() if c != -1} == {c: len(x) for c, x in replies.items()}
    parts = {}
    for r in chat.context_parts(formatted, rows).orderBy("part").collect():
        parts[r.conv_id, r.example] = parts.get((r.conv_id, r.example), "") + r.text
    shown = lambda t: "".join(f"<|{chat.escape(a)}|>{chat.escape(b)}</s>" for a, b in t)
    for r in rows.where("conv_id <> -1").collect():
        at = replies[r.conv_id][r.example]
        assert parts[r.conv_id, r.example] == shown(turns[r.conv_id][:at]) + "<|assistant|>"
        assert chat.unescape(r.target) == turns[r.conv_id][at][1] and r.train_end - r.train_start == len(r.target)
    assert rows.count() == sum(map(len, replies.values())) + 1


def brute(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = ids[order].tolist()
    return out


@pytest.mark.parametrize("block", [300, 8192])
def test_neighbours_recall(spark, sf_dir, block):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    p = df.toPandas()
    exact = brute(p.vec_id.to_numpy(), np.stack(p.embedding).astype("f8"), 20)
    made = neighbours.search(df, F.col("vec_id") % 20 == 0, block=block, queries=16).toPandas()
    hits = sum(len({*g.vec_id} & {*exact[q]}) for q, g in made.groupby("query_id"))
    assert hits >= 0.9 * sum(map(len, exact.values())) and {*made.query_id} == {*exact}


def test_neighbours_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [5.0, 1.0]), (7, [1.0]), (20, [1.0, 0.0]), (40, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = neighbours.search(df, F.col("vec_id") % 20 == 0, k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in made] == [(0, 1, 6, 5.0), (0, 2, 1, 1.0), (20, 1, 6, 5.0), (20, 2, 0, 1.0)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_queries_run(spark, sf_dir):
    for name in ("op2_fingerprints", "op8_chat_format", "op9_neighbours"):
        assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_neighbours_of_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (0, [0.0, 2.0]), (1, [1.0, 1.0]), (3, [0.5, 0.0])]
    made = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=2).collect()
    lists = {}
    for r in sorted(made, key=lambda r: r["rank"]):
        lists.setdefault(r["query"], []).append((r.vec_id, r.score))
    assert sorted(lists.values()) == [[(1, 1.0), (3, 0.5)], [(1, 2.0), (0, 0.0)]]


@pytest.mark.parametrize("dim", [16, 64, 256])
def test_neighbours_recall_without_clusters(dim):
    rng = np.random.default_rng(dim)
    x, ids = rng.standard_normal((2000, dim)), np.arange(2000)
    asks = ids % 20 == 0
    query, vec_id, _ = neighbours.Index(ids, x, ids).search(ids[asks], x[asks], 20)
    found = {*zip(query.tolist(), vec_id.tolist())}
    exact = x[asks] @ x.T
    exact[np.arange(100), ids[asks]] = -np.inf
    true = {(int(q), int(v)) for q, best in zip(ids[asks], np.argsort(-exact, axis=1)[:, :20]) for v in best}
    assert len(found) == 2000 and len(found & true) >= 0.9 * len(true)


def test_chat_query_writes_whole_contexts(spark, sf_dir, monkeypatch):
    """every reply's prefix is written in full, and the query reads it back."""
    written, write = [], chat.write_contexts
    monkeypatch.setattr(chat, "write_contexts", lambda *a: written.append(write(*a)) or written[-1])
    made = {r.conv_id: r.context_chars for r in queries.op8_chat_format(spark, sf_dir).collect()}
    turns, exact = {}, {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r.turn, r.role or "", r.text or "")):
        before = turns.setdefault(r.conv_id, [])
        if r.role == "assistant":
            exact.setdefault(r.conv_id, []).append("".join(before) + "<|assistant|>")
        before.append(f"<|{chat.escape(r.role or '')}|>{chat.escape(r.text or '')}</s>")
    found = {}
    for r in written[0].where("conv_id <> -1").orderBy("conv_id", "example", "part").collect():
        texts = found.setdefault(r.conv_id, {})
        texts[r.example] = texts.get(r.example, "") + r.text
    assert {c: [x[i] for i in sorted(x)] for c, x in found.items()} == exact
    assert {c: n for c, n in made.items() if c != -1} == {c: sum(map(len, exact.get(c, []))) for c in turns}
