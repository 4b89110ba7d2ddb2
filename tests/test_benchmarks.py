from itertools import combinations
from math import gcd

import numpy as np
import pytest
from pyspark.sql import functions as F

from setloom.operators import benchmarks, levels

SPEC = (9, 3, 4, 2)


def history(spark, n, seed=4):
    rng = np.random.default_rng(seed)
    rows = [("g", t, *sorted((rng.choice(9, 3, replace=False) + 1).tolist()), *sorted((rng.choice(4, 2, replace=False) + 1).tolist())) for t in range(1, n + 1)]
    return rows, spark.createDataFrame(rows, "game string, t long, b1 int, b2 int, b3 int, s1 int, s2 int")


def pairs(main, star):
    return [("main-main", *p) for p in combinations(main, 2)] + [("main-star", a, b) for a in main for b in star] + [("star-star", *p) for p in combinations(star, 2)]


def test_shortlists_and_steps_against_all_tickets(spark):
    rows, frame = history(spark, 40)
    sets = levels.drawn(frame, 3, 2)
    ends = spark.createDataFrame([("g", 40, 36, 0.0)], "game string, n long, start long, centre double")
    targets = {(t, m): v for t in range(36, 41) for m, v in (("a", 45 + t % 3), ("b", 10_000 if t == 38 else 52))}
    aims = spark.createDataFrame([("g", t, m, v) for (t, m), v in targets.items()], benchmarks.AIMS)
    listed = benchmarks.shortlists(benchmarks.counts_at(sets, ends), aims, 6, SPEC)
    prizes = spark.createDataFrame([(b, s, 10.0**b + s) for b in range(4) for s in range(3) if b + s > 1], "balls int, stars int, prize double")
    steps = {(r.t, r.method): r for r in benchmarks.judged(listed, sets, prizes, 2.0).collect()}
    made = listed.collect()
    chance = benchmarks.chances(SPEC)
    mine = {}
    for (t, method), target in targets.items():
        n = {}
        for r in rows[: t - 1]:
            for p in pairs(r[2:5], r[5:7]):
                n[p] = n.get(p, 0) + 1
        z = lambda p: (n.get(p, 0) - (t - 1) * chance[p[0]]) / np.sqrt((t - 1) * chance[p[0]] * (1 - chance[p[0]]))  # noqa: B023, E731
        every = []
        for m in combinations(range(1, 10), 3):
            for s in combinations(range(1, 5), 2):
                each = [z(p) for p in pairs(m, s)]
                every.append((abs(sum(n.get(p, 0) for p in pairs(m, s)) - target), -round(sum(each), 9), -round(min(each), 9), m, s))
        gap = min(e[0] for e in every)
        want = sorted(e for e in every if e[0] == gap)[:6]
        got = sorted((r for r in made if (r.t, r.method) == (t, method)), key=lambda r: r.place)
        assert [r.place for r in got] == list(range(1, len(want) + 1))
        assert [-r.z for r in got] == pytest.approx([e[1] for e in want]) and {r.gap for r in got} == {gap}
        assert [(tuple(r.main), tuple(r.star)) for r in got] == [e[3:] for e in want]
        mine[t, method] = [(tuple(r.main), tuple(r.star)) for r in got]
    for t in range(36, 41):
        size = min(len(mine[t, m]) for m in "ab")
        main, star = {*rows[t - 1][2:5]}, {*rows[t - 1][5:7]}
        for m in "ab":
            hits = [(len(main & {*a}), len(star & {*b}), -i) for i, (a, b) in enumerate(mine[t, m][:size], 1)]
            r = steps[t, m]
            assert (r.balls, r.stars, -r.best_place) == max(hits) and r.spent == 2.0 * size
            assert r.won == pytest.approx(sum(10.0**b + s for b, s, _ in hits if b + s > 1))
    table = {r.method: r for r in benchmarks.method_table(benchmarks.judged(listed, sets, prizes, 2.0)).collect()}
    for m in "ab":
        own = [steps[t, m] for t in range(36, 41)]
        assert table[m].roi == pytest.approx(sum(r.won for r in own) / sum(r.spent for r in own) - 1) and table[m].recall_at_5 == pytest.approx(np.mean([r.balls for r in own]) / 5)
    assert sum(r.best for r in table.values()) == 1


def test_reverse_growth_equals_refits(spark):
    rng = np.random.default_rng(1)
    poi = np.cumsum(rng.integers(0, 9, 80)) + 21
    frame = spark.createDataFrame([("g", t, int(v)) for t, v in enumerate(poi, 1)], "game string, t long, poi long")
    made = {r.t: r.target for r in benchmarks.reverse_growth(frame, benchmarks.span(frame, 10)).collect()}
    phi = np.array([sum(gcd(k, t) == 1 for k in range(1, t + 1)) for t in range(1, 81)], float)
    assert {*made} == {*range(71, 81)}
    for t, target in made.items():
        x = np.stack((np.ones(t), phi[:t], phi[:t] ** 2), axis=1)
        b = np.linalg.lstsq(x[:-1], poi[: t - 1], rcond=None)[0]
        assert target == int(np.rint(2 * x[-2] @ b - x[-1] @ b))


def test_nothing_to_judge(spark):
    _, frame = history(spark, 3)
    sets = levels.drawn(frame, 3, 2)
    listed = benchmarks.shortlists(spark.createDataFrame([], "game string, t long, pairs array<struct<kind:string,a:int,b:int,n:long>>"), spark.createDataFrame([], benchmarks.AIMS), 5, SPEC)
    assert not benchmarks.judged(listed, sets).collect()
    assert not benchmarks.method_table(benchmarks.judged(listed, sets)).where(F.col("steps") > 0).collect()


def test_variance_targets_equal_refits(spark):
    """The mean model refitted, and the filter run step by step, at each of five cut-offs."""
    from datetime import date, timedelta

    from setloom.operators import filters

    rng = np.random.default_rng(2)
    poi = (np.arange(60) * 1.5 + rng.normal(0, 8, 60) * (1 + np.arange(60) % 7 / 4)).round().astype(int) + 40
    days = [date(2020, 1, 3) + timedelta(days=(4 if t % 2 else 0) + 7 * (t // 2)) for t in range(60)]
    frame = spark.createDataFrame([("g", t, int(v), d) for t, (v, d) in enumerate(zip(poi, days), 1)], "game string, t long, poi long, draw_date date")
    params = filters.grid().iloc[::5].reset_index(drop=True)
    made = {r.t: r.target for r in benchmarks.variance_targets(frame, benchmarks.span(frame, 5), params).collect()}
    assert {*made} == {*range(56, 61)}
    for t, target in made.items():
        x = np.stack((np.ones(t), np.arange(1, t + 1), [d.weekday() == 4 for d in days[:t]]), axis=1).astype(float)
        b = np.linalg.lstsq(x[:-1], poi[: t - 1], rcond=None)[0]
        eps = poi[: t - 1] - x[:-1] @ b
        spread = np.mean(eps**2)
        season = [np.sin(2 * np.pi * d.timetuple().tm_yday / 365.25) for d in days]
        best = None
        for p in params.itertuples():
            omega = np.log(p.scale * (1 - p.alpha - p.beta * p.order) * spread)
            held = [spread]
            for i in range(1, t):
                level = np.exp(omega + p.gamma * (season[i] if i < t - 1 else 0.0)) + filters.FLOOR
                held.append(level + p.alpha * eps[i - 1] ** 2 + p.beta * sum(held[max(0, i - p.order) :][-p.order :]))
            ll = sum(filters.constant(p.nu) - 0.5 * np.log(v) - (p.nu + 1) / 2 * np.log1p(e * e / v / (p.nu - 2)) for e, v in list(zip(eps, held))[1:])
            one = (2 * (p.order + 4) - 2 * ll, p.id, held[-1], np.mean(eps[1:] / np.sqrt(held[1:-1])))
            best = min(best, one) if best else one
        assert abs(target - max(1, x[-1] @ b + np.sqrt(best[2]) * best[3])) <= 0.5 + 1e-6
