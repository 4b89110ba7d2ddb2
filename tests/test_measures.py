import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from setloom.functions.tails import chi_square
from setloom.operators import measures


def test_tails_of_known_quantiles():
    for x, dof, p in ((3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (66.33864886296882, 49, 0.05), (21.665994333461924, 9, 0.01)):
        assert chi_square(x, dof) == pytest.approx(p, abs=1e-9)
    assert chi_square(0, 5) == 1 and chi_square(1e5, 9) == 0


def plain_metrics(rows):
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
    above = lambda v: [y for p, y in rows if p >= v]
    ap = sum(sum(above(v)) / len(above(v)) for v in pos) / len(pos) if pos else None
    return len(rows), len(pos), auc, ap


def test_metrics_with_ties_nulls_and_single_classes(spark):
    rng = random.Random(5)
    rows = {"hot": [(rng.randrange(1, 9) / 10, rng.randrange(2)) for _ in range(400)], "ones": [(0.5, 1)] * 3, "zeros": [(0.0, 0), (1.0, 0)], "mixed": [(0.1, 1), (0.9, 0)]}
    given = [(g, p, y) for g, x in rows.items() for p, y in x] + [("hot", None, 1), (None, 0.5, 1), ("hot", float("nan"), 0), ("hot", 0.2, None)]
    made = {r.g: r for r in measures.ranking_metrics(spark.createDataFrame(given, "g string, p double, y int")).collect()}
    assert made.keys() == rows.keys()
    for g, x in rows.items():
        n, positives, auc, ap = plain_metrics(x)
        r = made[g]
        assert (r.n, r.positives) == (n, positives) and r.auc == (None if auc is None else pytest.approx(auc)) and r.average_precision == (None if ap is None else pytest.approx(ap))
    assert made["ones"].log_loss == pytest.approx(math.log(2)) and math.isfinite(made["zeros"].log_loss)
    assert measures.ranking_metrics(spark.createDataFrame([], "g string, p double, y int")).count() == 0


def test_diagnostics_do_not_depend_on_blocks(spark):
    x = np.cumsum(np.random.default_rng(3).normal(size=150)) * 0.1 + np.random.default_rng(4).normal(size=150)
    rows = [("a", t + 1, float(v)) for t, v in enumerate(x)] + [("flat", t, 2.0) for t in range(1, 30)] + [("short", 1, 1.0), ("short", 2, 2.0)]
    series = spark.createDataFrame(rows, "game string, t long, x double")
    made = {r.game: r for r in measures.residual_diagnostics(series, size=17).collect()}
    z = (x - x.mean()) / x.std()
    for name, e in (("q", z), ("q_square", z**2 - 1)):
        r = [(e[k:] * e[:-k]).sum() / (e * e).sum() for k in range(1, 17)]
        for m in (4, 8, 16):
            q = 150 * 152 * sum(v * v / (150 - k) for k, v in enumerate(r[:m], 1))
            assert made["a"][f"{name}_{m}"] == pytest.approx(q) and made["a"][f"p{name[1:]}_{m}"] == pytest.approx(chi_square(q, m))
    assert made["flat"].q_4 is None and made["flat"].jarque_bera is None and made["short"].q_4 is None and made["short"].n == 2
    with pytest.raises(ValueError):
        measures.residual_diagnostics(series, size=16)


def test_mean_overlap_without_pairs_of_tickets(spark):
    rng = random.Random(8)
    books = {1: [rng.sample(range(1, 12), 5) for _ in range(40)], 2: [[1, 2, 3, 4, 5]] * 6, 3: [[9, 7, 5, 3, 1]]}
    made = {r.book: r for r in measures.coverage(spark.createDataFrame([(b, m) for b, x in books.items() for m in x], "book int, main array<int>")).collect()}
    for b, x in books.items():
        alike = [len({*p} & {*q}) / len({*p} | {*q}) for p, q in itertools.combinations(x, 2)]
        assert (made[b].tickets, made[b].n_distinct) == (len(x), len({tuple(sorted(m)) for m in x}))
        assert made[b].jaccard_gap == (pytest.approx(1 - sum(alike) / len(alike)) if alike else None)
        assert made[b].pair_coverage == pytest.approx(len({p for m in x for p in itertools.combinations(sorted(m), 2)}) / 1225)


def test_every_number_is_one_ticket(spark):
    made = measures.unranked(spark.range(-1, 57).withColumn("place", F.when(F.col("id") < 56, F.col("id"))), "place", 8, 3).orderBy("id").collect()
    assert [(r.u1, r.u2, r.u3) for r in made[1:57]] == [*itertools.combinations(range(1, 9), 3)]
    assert all(made[i].u1 is None for i in (0, -1))
    back = measures.unranked(spark.range(56), "id", 8, 3).select("id", measures.ticket_place([F.col("u1"), F.col("u2"), F.col("u3")], 8).alias("again"))
    assert back.where("id <> again").count() == 0


def test_small_universe_against_all_tickets(spark):
    rng = random.Random(2)
    n = {("main-main", a, b): rng.randrange(9) for a, b in itertools.combinations(range(1, 9), 2)}
    n |= {("main-star", a, b): rng.randrange(9) for a in range(1, 9) for b in range(1, 5)}
    n |= {("star-star", a, b): rng.randrange(9) for a, b in itertools.combinations(range(1, 5), 2)}
    counts = spark.createDataFrame([("g", *k, v) for k, v in n.items()], "game string, kind string, a int, b int, n long")
    made = {(r["first"], r.s1, r.s2): (r.tickets, r.total, r.best) for r in measures.universe(counts, (8, 3, 4, 2)).collect()}
    plain = {}
    for main in itertools.combinations(range(1, 9), 3):
        for star in itertools.combinations(range(1, 5), 2):
            g = sum(n["main-main", a, b] for a, b in itertools.combinations(main, 2)) + sum(n["main-star", a, s] for a in main for s in star) + n[("star-star", *star)]
            plain.setdefault((main[0], *star), []).append(g)
    assert made == {k: (len(v), sum(v), max(v)) for k, v in plain.items()}


def test_frequencies_of_a_constant_game(spark):
    history = spark.createDataFrame([("g", t, 1, 2, 3, 4, 5) for t in range(1, 61)], "game string, t long, b1 int, b2 int, b3 int, b4 int, b5 int")
    made = {(r.t, r.item): r for r in measures.frequency_windows(history, (2, 50)).collect()}
    assert len(made) == 3000 and made[1, 1].z_all == 0 == made[1, 9].z50
    assert made[60, 1].z_all == pytest.approx(3) and made[60, 1].z2 == pytest.approx(3) and made[60, 50].z50 == pytest.approx(-1 / 3)
