from itertools import combinations
from math import ceil

import numpy as np
import pytest

from setloom.operators import portfolio as P

SCHEMA = "ticket_id long, main array<int>, star array<int>, base double"


def candidates(n, seed, mains=50):
    rng = np.random.default_rng(seed)
    return [(i, sorted((rng.choice(mains, 5, replace=False) + 1).tolist()), sorted((rng.choice(12, 2, replace=False) + 1).tolist()), float(rng.integers(8)) / 10) for i in range(n)]


def plain(rows, budget, w, shared=2, by=lambda r: r[0]):
    """The whole pool looked at in each round."""
    chosen, cap, slack = [], ceil(budget * 2 / 12), 1
    while len(chosen) < min(budget, len(rows)):
        used = {i for r in chosen for i in r[1]}
        pairs, stars = {p for r in chosen for p in combinations(r[1], 2)}, {tuple(r[2]) for r in chosen}
        main_use, star_use = np.zeros(51, int), np.zeros(13, int)
        for r in chosen:
            main_use[r[1]] += 1
            star_use[r[2]] += 1
        best = None
        for r in rows:
            if any(r[0] == c[0] for c in chosen):
                continue
            if w.capped:
                after = star_use.copy()
                after[r[2]] += 1
                if len(chosen) + 1 < budget and any(len({*r[1]} & {*c[1]}) > shared for c in chosen):
                    continue
                if any(star_use[s] >= cap for s in r[2]) or np.ptp(after[1:]) > slack:
                    continue
            n = max(1, len(chosen))
            gain = r[3] + w.pair * len({*combinations(r[1], 2)} - pairs) / 10 + w.number * len({*r[1]} - used) / 5
            gain += w.balance * (1 - main_use[r[1]].mean() / n) + w.star_balance * (1 - star_use[r[2]].mean() / n) + w.star_pair * (tuple(r[2]) not in stars)
            key = (-round(gain, 9), by(r))
            if best is None or key < best[0]:
                best = (key, r)
        if best is None:
            shared += 1
            if shared >= 5:
                cap, slack = cap + 1, slack + 1
            continue
        chosen.append(best[1])
    return [r[0] for r in chosen]


@pytest.mark.parametrize("kept", [5, 60, 1000])
def test_greedy_against_the_whole_pool(spark, kept):
    rows = candidates(500, 1)
    pool = spark.createDataFrame(rows, SCHEMA)
    assert [r["ticket_id"] for r in P.greedy(pool, 12, P.GUARDED, ["ticket_id"], kept=kept)] == plain(rows, 12, P.GUARDED)


def test_greedy_raises_its_limits_to_meet_the_budget(spark):
    rows = candidates(30, 2, mains=8)  # few items: every two tickets overlap
    pool = spark.createDataFrame(rows, SCHEMA)
    made = [r["ticket_id"] for r in P.greedy(pool, 9, P.GUARDED, ["ticket_id"], kept=10)]
    assert made == plain(rows, 9, P.GUARDED) and len(made) == 9
    assert len(P.greedy(pool, 99, P.Weights(), ["ticket_id"])) == 30
    assert not P.greedy(pool.limit(0), 3, P.GUARDED, ["ticket_id"])


def history(spark, n, planted):
    rng = np.random.default_rng(13)
    rows = []
    for t in range(1, n + 1):
        main = {7, 9} if planted and t % 5 < 4 else set()
        while len(main) < 5:
            main.add(int(rng.integers(1, 51)))
        rows.append(("g", t, *sorted(main), *sorted((rng.choice(12, 2, replace=False) + 1).tolist())))
    return spark.createDataFrame(rows, "game string, t long, b1 int, b2 int, b3 int, b4 int, b5 int, s1 int, s2 int")


def test_evidence_and_ablation(spark):
    fair, planted = history(spark, 200, False), history(spark, 200, True)
    assert P.evidence(fair).where("value <> 0").count() == 0
    found = {(r.kind, r.a, r.b): r.value for r in P.evidence(planted).where("value > 0").collect()}
    assert {("main", 7, 0), ("main", 9, 0), ("main-main", 7, 9)} <= {*found}
    pool = spark.createDataFrame(candidates(300, 3), SCHEMA).drop("base")
    same = P.guarded_portfolio(pool, fair, 6)
    assert same.where("mode = 'guarded'").drop("mode").exceptAll(same.where("mode = 'ablation'").drop("mode")).count() == 0
    other = P.guarded_portfolio(pool, planted, 6)
    with_items = lambda mode: other.where(f"mode = '{mode}' and (array_contains(main, 7) or array_contains(main, 9))").count()
    assert with_items("guarded") > with_items("ablation")


def reach(tickets):
    return len({p for m, _ in tickets for p in combinations(m, 2)})


@pytest.mark.parametrize("weights", [(1.0, 1.0, 1.0), (5.0, 0.0, 1.0)])
def test_aggregate_against_a_loop_and_its_floor(spark, weights):
    rng = np.random.default_rng(4)
    tickets = candidates(150, 5)
    proposals = []
    for provider, mains in (("a", tickets[:80]), ("b", tickets[40:120]), ("wide", tickets[100:150])):
        order = rng.permutation(len(mains))
        proposals += [(provider, i + 1, mains[j][1], mains[j][2], float(len(mains) - i)) for i, j in enumerate(order)]
    frame = spark.createDataFrame(proposals, "provider string, place int, main array<int>, star array<int>, score double")
    made = P.aggregate(frame, 12, weights, floor=False, kept=20).orderBy("place").collect()
    votes = {}
    for name in ("a", "b", "wide"):
        mine = sorted((x for x in proposals if x[0] == name), key=lambda x: x[4])
        for i, x in enumerate(mine):
            key = (tuple(x[2]), tuple(x[3]))
            votes[key] = votes.get(key, 0) + i / (len(mine) - 1)
    crowd = lambda m: np.prod([1.3 if i <= 31 else 0.8 for i in m]) * (1.5 if max(m) - min(m) <= 9 else 1)
    pay = {k: (1 - np.exp(-crowd(k[0]) / 7)) / (crowd(k[0]) / 7) for k in votes}
    rows = [(k, list(k[0]), list(k[1]), weights[0] * votes[k] / max(votes.values()) + weights[2] * pay[k] / max(pay.values())) for k in votes]
    assert [(tuple(r.main), tuple(r.star)) for r in made] == plain(rows, 12, P.Weights(weights[1]))
    held = P.aggregate(frame, 12, weights).collect()
    single = [[(x[2], x[3]) for x in proposals if x[0] == p and x[1] <= 12] for p in ("a", "b", "wide")]
    assert len(held) == 12 and reach([(r.main, r.star) for r in held]) >= max(map(reach, single))
    assert not P.aggregate(frame.limit(0), 5).collect()
