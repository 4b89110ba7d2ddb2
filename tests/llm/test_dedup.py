import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from setloom.llm import near_dedup, packing, substring_dedup, words
from setloom.llm.graph import components

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]


def prose(n, r=rng):
    return [r.choice(VOCABULARY) for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(texts):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def edited(base, n):
    out = list(base)
    for i in rng.sample(range(len(out)), n):
        out[i] = rng.choice(VOCABULARY)
    return out


def corpus():
    """Texts with exact copies, a chain of near copies, pairs below the limit, short and empty texts."""
    texts = [" ".join(prose(rng.randrange(20, 300))) for _ in range(60)]
    base = prose(200)
    texts += [" ".join(edited(base, 2)) for _ in range(25)] + [" ".join(base)] * 10
    step = prose(150)
    for _ in range(12):  # neighbours are alike, the ends are not
        step = edited(step, 2)
        texts.append(" ".join(step))
    far = prose(100)
    texts += [" ".join(far), " ".join(edited(far, 10)), " ".join(far).upper() + "!"]
    texts += ["", None, "...", "one two", "One, two.", "one two three four five", "one two three four six", "x " * 500, "x " * 400]
    return texts


def classes_by_brute_force(texts):
    memo = words.WordHashes()
    sets = [set(words.shingles(words.hashes(t or "", memo)).tolist()) for t in texts]
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            label[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def test_classes_equal_brute_force(spark):
    texts = corpus()
    made = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs(spark, rows_of(texts)).repartition(5)).collect()}
    assert [made[i] for i in range(len(texts))] == classes_by_brute_force(texts)


def test_classes_of_repeated_blocks(spark):
    """A block that one text repeats and the other has once changes no set: such pairs are linked as well."""
    r, texts = random.Random(6), []
    while len(texts) < 80:
        single, block = prose(60, r), prose(30, r)
        other = list(single)
        other[20] = other[40] = "zzz"
        pair = [" ".join(single + block * 50), " ".join(other + block * 2)]
        assert near_dedup.similarity_of(*pair) >= 0.8
        texts += pair
    made = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs(spark, rows_of(texts))).collect()}
    assert [made[i] for i in range(len(texts))] == classes_by_brute_force(texts) == [i // 2 * 2 for i in range(len(texts))]


def test_classes_odd_tables(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    odd = [(1, "a b c d e f", None, None, 1), (1, "a b c d e f", None, None, 1), (None, "a b c d e f", None, None, 1), (2, None, None, None, 1), (3, "A b c d e f", None, None, 1)]
    made = near_dedup.near_duplicates(docs(spark, odd)).collect()
    assert sorted((r.doc_id or 0, r.class_id) for r in made) == [(0, 1), (1, 1), (1, 1), (2, 2), (3, 1)]
    kept = near_dedup.deduplicated(docs(spark, odd)).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 2]


def test_registers_estimate_weighted_similarity():
    g = np.random.default_rng(2)
    a = g.integers(0, 1 << 62, 400, dtype="u8")
    b = np.concatenate((a[:300], g.integers(0, 1 << 62, 100, dtype="u8")))
    wa, wb = g.uniform(1, 3, 400), np.concatenate((g.uniform(1, 3, 300), g.uniform(1, 3, 100)))
    wb[:300] = wa[:300]
    same = np.mean(near_dedup.registers(a, wa, 4000) == near_dedup.registers(b, wb, 4000))
    x, y = wa / wa.sum(), wb / wb.sum()  # probability Jaccard: sum over common of 1 / sum of max(x_j / x_i, y_j / y_i)
    xs, ys = np.concatenate((x, np.zeros(100))), np.concatenate((y[:300], np.zeros(100), y[300:]))
    exact = sum(1 / np.maximum(xs / xs[i], ys / ys[i]).sum() for i in range(300))
    assert abs(same - exact) < 0.04
    small = near_dedup.registers(a[:3], wa[:3], 180)
    assert set(small.tolist()) <= set(a[:3].tolist()) and (small == near_dedup.registers(a[:3][::-1], wa[:3][::-1], 180)).all()


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (5, 5)]
    made = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert made == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def windows_by_tree(h, width):
    """The Cartesian tree's nodes that span `width` or more, by recursion."""
    out, stack = set(), [(0, len(h) - 1)]
    while stack:
        low, high = stack.pop()
        if high - low + 1 < width:
            continue
        c = min(range(low, high + 1), key=lambda i: (h[i] >> 24, i))
        out.add((low, c, high))
        stack += [(low, c - 1), (c + 1, high)]
    return out


@pytest.mark.parametrize("n,width", [(1, 1), (7, 3), (200, 46), (45, 46), (500, 20)])
def test_compact_windows_are_the_tree(n, width):
    tokens = np.random.default_rng(n).integers(0, 60, n, dtype="u8")
    key, left, c, right = substring_dedup.compact_windows(tokens, 3, width)
    h = words.mixed(tokens ^ words.mixed(np.array([4], "u8"))[0]).tolist()
    assert set(zip(left.tolist(), c.tolist(), right.tolist())) == windows_by_tree(h, width) and key.tolist() == [h[i] for i in c]


def test_passages(spark):
    line, passage, near = prose(12), prose(60), prose(70)
    changed = near[:20] + ["zzz"] + near[21:45] + ["yyy"] + near[45:]
    texts = [" ".join(prose(120) + line + prose(50)) for _ in range(20)]
    texts += [" ".join(prose(80) + passage + line + prose(40)) for _ in range(20)]
    texts += [" ".join(prose(60) + near + prose(60)), " ".join(prose(10) + changed + prose(90)), "", None, "short text", " ".join(prose(49))]
    texts += ["Ünder, " + " ".join(passage).upper() + "; end"]
    made = {r.doc_id: r.passages for r in substring_dedup.repeated_passages(docs(spark, rows_of(texts)).repartition(4)).collect()}
    assert set(made) == {*range(21, 40), 41, 46}
    for i in range(21, 40):
        (p,) = made[i]
        assert p.source_id == 20 and texts[i][p.start : p.end] == " ".join(passage + line)
    (p,) = made[46]
    assert texts[46][p.start : p.end] == " ".join(passage).upper()
    assert sum(len(texts[41][p.start : p.end].split()) for p in made[41]) >= 45  # one of two changed words lies in it
    kept = {r.doc_id: r for r in substring_dedup.without_passages(docs(spark, rows_of(texts))).collect()}
    assert len(kept) == len(texts) and kept[20].text == texts[20] and kept[46].text == "Ünder, ; end"
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept.values())
    assert substring_dedup.repeated_passages(docs(spark, [])).count() == 0


def test_passage_hidden_behind_another_group(spark):
    """Documents that share one passage, and a part of it with an earlier document, are still found."""
    passage = prose(60)
    texts = [" ".join(prose(60) + passage[i : i + 20] + prose(60)) for i in range(0, 60, 4)] + [" ".join(prose(50) + passage + prose(50)) for _ in range(4)]
    made = {r.doc_id for r in substring_dedup.repeated_passages(docs(spark, rows_of(texts))).collect()}
    assert made == {16, 17, 18}


def test_passages_behind_many_unrelated_first_documents(spark):
    """A common line of 40 words in all documents: pairs that share it and ten words more are found however many stand before them."""
    r = random.Random(3)
    line, extra = prose(40, r), [prose(12, r) for _ in range(6)]
    texts = [" ".join(prose(60, r) + line + prose(60, r)) for _ in range(12)]
    first = len(texts)
    for i, more in enumerate(extra):
        for _ in range(2):  # words of their own on the other side
            texts.append(" ".join(prose(60, r) + (more + line if i % 2 else line + more) + prose(60, r)))
    made = {r.doc_id: r.passages for r in substring_dedup.repeated_passages(docs(spark, rows_of(texts)).repartition(4)).collect()}
    assert {d: [p.source_id for p in x] for d, x in made.items()} == {first + 2 * i + 1: [first + 2 * i] for i in range(len(extra))}


def test_passage_next_to_pieces_in_the_first_document(spark):
    """The first document has pieces of a passage at several places, with little of it on either side; one hash function must do."""
    r, texts, later = random.Random(4), [], set()
    for _ in range(60):
        passage = prose(54, r)
        texts.append(" ".join(w for i in range(0, 54, 6) for w in prose(25, r) + passage[i : i + 10] + prose(25, r)))
        texts += [" ".join(prose(60, r) + passage + prose(60, r)) for _ in range(2)]
        later.add(len(texts) - 1)
    made = {r.doc_id: {p.source_id for p in r.passages} for r in substring_dedup.repeated_passages(docs(spark, rows_of(texts)), hashes=1).collect()}
    assert made == {d: {d - 1} for d in later}


JSON = P.path("byte_bpe_50k.json")


def check_packing(spark, texts, **options):
    exact = Tokenizer.from_file(JSON)
    made = packing.packed(docs(spark, rows_of(texts)).repartition(3), JSON, **options).toPandas()
    sequences = made.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, g in sequences:
        assert g.offset.tolist() == np.concatenate(([0], np.cumsum(g.length)[:-1])).tolist()
    sizes = sequences.length.sum()
    assert (sizes <= 1024).all() and ((sizes == 1024) | (sizes & (sizes - 1) == 0)).all()
    for i, text in enumerate(texts):
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 0]
        g = made[made.doc_id == i].sort_values("start")
        assert g.start.tolist() == np.concatenate(([0], np.cumsum(g.length)[:-1])).tolist() and g.length.sum() == len(ids) and (g.doc_tokens == len(ids)).all()
        assert g.ids_crc32.tolist() == [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(g.start, g.length)]
    return made


@pytest.mark.parametrize("shard", [1, 7, 512])
def test_packing(spark, shard):
    texts = [" ".join(prose(rng.randrange(0, 400))) for _ in range(50)] + ["", None, "same text", "same text", " ".join(prose(9000))]
    check_packing(spark, texts, shard=shard)


def test_packing_takes_neighbours():
    ids = [np.array(x) for x in ([1, 2, 3] * 10, [7, 8, 9] * 10, [1, 2, 3, 4] * 8, [50] * 30)]
    idf = np.ones(60, "f4")
    order = [d for s in packing.pack(ids, idf, 30.0, 64) for d, *_ in s]
    assert order[:2] == [0, 2]
    scores = packing.Shard(ids, idf, 30.0).scores(0)
    tf, norm = 8, 1.2 * (0.25 + 0.75 * 32 / 30)
    assert abs(scores[2] - 3 * tf * 2.2 / (tf + norm)) < 1e-5 and scores[1] == scores[3] == 0


def test_packing_empty(spark):
    assert packing.packed(docs(spark, []), JSON).count() == 0


def test_bitmap_bound_keeps_every_similar_pair(spark):
    import numpy as np
    from setloom.llm import near_dedup

    rng, rows = np.random.default_rng(5), []
    for n in (1, 2, 5, 40, 300, 3000):
        for share in (0.5, 0.78, 0.8, 0.82, 1.0):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            y = np.concatenate((x[: round(len(x) * share)], rng.integers(0, 1 << 63, len(x) - round(len(x) * share)).astype(np.uint64)))
            maps = [near_dedup.bitmap(v) for v in (x, y)]
            both = len(np.intersect1d(x, y))
            side = [{"n": len(v), "bitmap": m.tolist(), "filled": sum(bin(int(w) & (1 << 64) - 1).count("1") for w in m)} for v, m in zip((x, y), maps)]
            rows.append((*side, both / (len(x) + len(y) - both)))
    kind = "struct<n long, bitmap array<long>, filled int>"
    made = spark.createDataFrame(rows, f"x {kind}, y {kind}, similarity double").select("similarity", near_dedup.possible("x", "y", 0.8).alias("possible")).collect()
    assert all(r.possible for r in made if r.similarity >= 0.8)
    assert not all(r.possible for r in made)


@pytest.mark.parametrize("m", [1, 2, 4, 6])
def test_passage_behind_its_pieces_in_many_documents(spark, m):
    """m copies of 20 earlier documents with up to 20 words of a passage of 60 words hide none of the later ones that hold it whole."""
    r = random.Random(8)
    passage = prose(60, r)
    texts = [" ".join(prose(40, r) + passage[3 * (i % 14) : 3 * (i % 14) + 20] + prose(40, r)) for i in range(20) for _ in range(m)]
    n = len(texts)
    texts += [" ".join(prose(50, r) + passage + prose(50, r)) for _ in range(3)]
    made = {r.doc_id: {p.source_id for p in r.passages} for r in substring_dedup.repeated_passages(docs(spark, rows_of(texts))).collect()}
    assert made == {n + 1: {n}, n + 2: {n}}


def passages_by_brute_force(texts):
    """Documents with LENGTH words that share SHARED shingles with some LENGTH words (give or take SHIFT) of an earlier one."""
    memo, out = words.WordHashes(), set()
    tokens = [words.shingles(words.hashes(t or "", memo)).tolist() for t in texts]
    wide = substring_dedup.TOKENS
    for j, y in enumerate(tokens):
        for x in tokens[:j]:
            for i in range(len(y) - wide + 1):
                part = y[i : i + wide]
                if len({*part} & {*x}) >= substring_dedup.SHARED and any(len({*part} & {*x[k : k + wide]}) >= substring_dedup.SHARED for k in range(len(x) - wide + 1)):
                    out.add(j)
    return out


def test_passages_equal_brute_force(spark):
    """Exact and edited passages of 45 to 70 words, of which others hold parts, in texts with words of their own."""
    r, texts = random.Random(12), []
    shared = [prose(r.randrange(45, 70), r) for _ in range(8)]
    for _ in range(70):
        body = []
        for _ in range(r.randrange(1, 3)):
            p = list(r.choice(shared))
            kind = r.randrange(4)
            if kind == 1:
                p[r.randrange(len(p))] = r.choice(VOCABULARY)
            elif kind == 2:
                p = p[r.randrange(20) :]
            elif kind == 3:
                p.insert(r.randrange(len(p)), "zzz")
            body += prose(r.randrange(10, 40), r) + p
        texts.append(" ".join(body + prose(10, r)))
    made = {r.doc_id for r in substring_dedup.repeated_passages(docs(spark, rows_of(texts)).repartition(4)).collect()}
    assert made == passages_by_brute_force(texts)


def test_passages_odd_tables(spark):
    """Repeated rows, rows that share a doc_id, null doc_ids and columns with clashing names: every row stays, once."""
    whole, other = " ".join(prose(80)), " ".join(prose(90))
    rows = [(1, whole), (2, whole), (2, whole), (2, other), (None, whole), (None, whole), (3, other), (4, None), (5, "")]
    frame = spark.createDataFrame([(*r, i, "c", "p") for i, r in enumerate(rows)], "doc_id long, text string, place long, copy string, ranges string")
    kept = {r.place: r for r in substring_dedup.without_passages(frame).collect()}
    assert [kept[i].text for i in range(len(rows))] == [whole, "", "", other, whole, whole, "", None, ""]
    assert all((r.copy, r.ranges) == ("c", "p") for r in kept.values()) and len(kept) == len(rows)
    assert {(r.doc_id, r.passages[0].source_id) for r in substring_dedup.repeated_passages(frame).collect()} == {(2, 1), (3, 2)}


def test_many_rows_with_a_null_id(spark):
    base = prose(60)
    rows = [(None, " ".join(edited(base, 1)) + f" n{i}", "en", "s", 0) for i in range(1500)]
    made = near_dedup.near_duplicates(docs(spark, rows + [(7, " ".join(base), "en", "s", 0)]))
    assert made.count() == 1501 and made.where("class_id = 7").count() > 1300


def test_registers_take_few_rounds(monkeypatch):
    calls, mixed = [], words.mixed
    monkeypatch.setattr(words, "mixed", lambda x: calls.append(len(x)) or mixed(x))
    rng = np.random.default_rng(5)
    for n in (20, 100, 300, 450):
        elements = mixed(rng.integers(0, 1 << 62, n).astype("u8"))
        calls.clear()
        owner = near_dedup.registers(elements, np.ones(n))
        assert np.isin(owner, elements).all() and len(calls) <= 12, (n, len(calls))


def test_windows_of_many_texts_at_once_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(6)
    passage = rng.integers(0, 1 << 32, 60).astype("<u4")
    texts = [rng.integers(0, 40 if i % 3 else 1 << 32, n).astype("<u4") for i, n in enumerate((50, 51, 400, 90, 75, 50))]
    texts += [np.concatenate((texts[2], passage)), np.concatenate((passage, texts[3])), np.tile(passage[:7], 12), np.tile(passage[:1], 80), np.tile(passage[:1], 80)]
    starts = np.cumsum([0, *map(len, texts)])
    keys, places = substring_dedup.joined_windows(**substring_dedup.parted(np.concatenate(texts), starts[1:-1]))
    of = np.searchsorted(starts, places, "right") - 1
    made = sorted(zip(of.tolist(), keys.tolist(), (places - starts[of]).tolist()))
    alone = [substring_dedup.joined_windows(words.shingles(h)) for h in texts]
    assert made == sorted((i, k, p) for i, (ks, ps) in enumerate(alone) for k, p in zip(ks.tolist(), ps.tolist()))
    calls, one = [], substring_dedup.joined_windows
    monkeypatch.setattr(substring_dedup, "joined_windows", lambda *a, **k: calls.append(1) or one(*a, **k))
    batch = pa.RecordBatch.from_pydict({"doc_id": [*range(11)], "copy": [0] * 11, "words": [x.tobytes() for x in texts]})

    class Texts:
        def mapInArrow(self, run, _):
            return [*run(iter([batch]))]

    (rows,) = substring_dedup.windows(Texts())
    assert len(calls) == 1 and rows.num_rows == len(made)
    assert sorted(zip(rows["doc_id"].to_pylist(), rows["key"].to_numpy().view("u8").tolist(), rows["place"].to_pylist())) == made


def test_order_keys_against_a_loop():
    rng = np.random.default_rng(7)
    docs = [rng.integers(0, 30, n).astype("<u2") for n in (1, 2, 5, 40, 200)]
    weights = np.round(rng.random(30) * 4).astype("f4")
    want = []
    for d in docs:
        terms, tf = np.unique(d, return_counts=True)
        best = sorted(zip(-(weights[terms] * tf / (tf + packing.K1)), terms.tolist()))[:3]
        found = [t for _, t in best]
        found += found[-1:] * (3 - len(found))
        want.append(found[0] << 10 | found[1] << 5 | found[2])
    assert packing.order_keys(docs, weights, 5, 3).tolist() == want


def test_steps_after_encoding_hold_no_pieces():
    from setloom.llm import bpe

    bpe.load_json(JSON).encode("some words that a worker keeps")
    packing.release()
    assert bpe.load_json.cache_info().currsize == 0


def test_alignments_too_few_for_a_passage_are_passed_over(monkeypatch):
    r = np.random.default_rng(1)
    line = r.integers(1, 1 << 32, 12)
    text = lambda: np.concatenate([x for _ in range(20) for x in (line, r.integers(1, 1 << 32, r.integers(40, 4000)))]).astype("<u4")
    asked, hits = [], substring_dedup.Source.hits
    monkeypatch.setattr(substring_dedup.Source, "hits", lambda *x: asked.append(1) or hits(*x))
    assert substring_dedup.passages(substring_dedup.Source(text()), text()) == []
    assert not asked  # twenty common lines on either side, none of which makes a passage
    periodic = np.tile(line, 6).astype("<u4")
    ((first, last),) = substring_dedup.passages(substring_dedup.Source(periodic), np.concatenate((r.integers(1, 1 << 32, 200), periodic)).astype("<u4"))
    assert first <= 200 and last == 272


def test_first_range_of_light_and_heavy_groups(spark, monkeypatch):
    rows = [(1, d, c, p, d > 4) for d in range(3, 9) for c, p in ((2, 5), (1, 9))] + [(2, 7, 0, 4, True), (2, 6, 0, 8, False), (3, 7, 0, 4, True), (4, 9, 0, 1, False), (4, 8, 0, 1, True)]
    found = []
    for heavy in (1e-9, 0.6, 2.0):  # all groups are heavy, the first one, none
        monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
        found.append(sorted(tuple(x) for x in substring_dedup.grouped(spark.createDataFrame(rows, "key long, doc_id long, copy long, place int, open boolean")).collect()))
    assert found[0] == found[1] == found[2]
    assert {(x[0], *x[5:]) for x in found[0]} == {(1, 3, 1, 9), (2, 6, 0, 8)} and len(found[0]) == 14


def test_packing_keeps_few_pieces_and_tables_are_written_in_small_batches(spark, monkeypatch):
    from setloom.llm import bpe
    from setloom.llm.common import stored

    c = bpe.load_json(P.path("byte_bpe_50k.json"))
    monkeypatch.setattr(c, "memo", 50)
    texts = [" ".join(prose(40)) for _ in range(20)]
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in texts:
        assert np.frombuffer(c.encode(t), c.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids
    assert len(c.known) <= 50 + 80  # one text's pieces more at most
    sizes = stored(spark.range(0, 9000, 1, 1).mapInArrow(lambda x: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in x), "n long"), "sizes")
    assert sizes.agg({"n": "max"}).first()[0] <= 2000 and sizes.agg({"n": "sum"}).first()[0] == 9000


def test_a_pair_is_verified_from_one_look_at_its_shingles(monkeypatch):
    """the passages, their ends and what is strange follow from what the source knows; words are not kept."""
    r = np.random.default_rng(6)
    a, b = (r.integers(1, 1 << 32, n).astype("<u4") for n in (300, 200))
    later = np.concatenate((b, a[100:180], b))
    source, y = substring_dedup.Source(a), words.shingles(later)
    value, there = source.known(y)
    assert there.tolist() == np.isin(y, source.values).tolist() and int(there.sum()) == 76
    whole = substring_dedup.passages(source, later)
    monkeypatch.setattr(words, "shingles", lambda h: pytest.fail("shingles are computed again"))
    found = substring_dedup.aligned(source, y, value, there)
    ((first, last),) = found
    assert found == whole and first <= 200 and last >= 280
    assert substring_dedup._trimmed(there, found) == [(200, 280)]
    lost = substring_dedup.strange(source, value, there, -100, 275)
    assert lost.tolist() == [*range(276, min(len(y), 275 + substring_dedup.TOKENS))]
    monkeypatch.undo()
    memo = words.WordHashes()
    assert words.hashes("One, two: ONE", memo).tolist() == words.hashes("one two one", words.WordHashes()).tolist() and not hasattr(memo, "__len__")
