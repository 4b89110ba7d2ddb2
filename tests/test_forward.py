import numpy as np

from setloom.operators import forward
from setloom.plans.draws import draws


def test_panel_counts_earlier_draws_only(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(forward, "BLOCK", 16)
    rows = draws(spark, sf_dir)
    made = {(r.game, r.t, r.item): (r.y, r.seen, r.last) for r in forward.causal_panel(rows).collect()}
    seen, last = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.t):
        main = {r.b1, r.b2, r.b3, r.b4, r.b5}
        for item in range(1, 51):
            key = (r.game, item)
            assert made.pop((r.game, r.t, item)) == (int(item in main), seen.get(key, 0), last.get(key))
            if item in main:
                seen[key], last[key] = seen.get(key, 0) + 1, r.t
    assert not made


def test_low_overlap_against_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(i, sorted(rng.choice(12, 5, replace=False).tolist()), float(rng.integers(4))) for i in range(60)]
    made = forward.low_overlap(spark.createDataFrame(rows, "ticket_id long, main array<int>, score double"), 8, 2).collect()
    want = []
    for i, main, score in sorted(rows, key=lambda r: (-r[2], r[0])):
        if len(want) < 8 and all(len({*main} & {*m}) <= 2 for _, m in want):
            want.append((i, main))
    assert [(r.ticket_id, r.main) for r in sorted(made, key=lambda r: r.place)] == want
    assert not forward.low_overlap(spark.createDataFrame([], "ticket_id long, main array<int>, score double"), 8, 2).collect()


def test_calendar_models_against_plain_iterations(spark, sf_dir):
    data = np.array(forward.calendar_features(draws(spark, sf_dir)).collect(), float)
    y, x = data[:, 0], np.column_stack((np.ones(len(data)), data[:, 1:]))
    made = {}
    for r in forward.m3_calendar_glm(spark, sf_dir).collect():
        made.setdefault(r.family, []).append(r.coefficient)
    assert np.allclose(made["gaussian"], np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-4)
    for family in ("poisson", "gamma"):
        beta = np.linalg.lstsq(x, np.log(y), rcond=None)[0]
        for _ in range(60):
            mu = np.exp(x @ beta)
            w = mu if family == "poisson" else np.ones_like(mu)
            beta = np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (w * (x @ beta + (y - mu) / mu)))
        assert np.allclose(made[family], beta, atol=1e-3)


def test_logistic_folds_against_newton(spark, sf_dir):
    made = {(r.fold, r.c): r for r in forward.m1_logistic(spark, sf_dir).collect()}
    rows = np.array([(r.y, r.rate, r.gap, r.age) for r in forward.item_features(draws(spark, sf_dir)).collect()], float)
    y, x, age = rows[:, 0], rows[:, 1:3], rows[:, 3]
    w = np.where(y == 1, 5.0, 50 / 90)
    for fold, cut, end in ((1, 0.4, 0.6), (3, 0.8, 1.0)):
        a, b = age <= cut, (age > cut) & (age <= end)
        if (fold, 1.0) not in made:
            continue
        z = np.column_stack((np.ones(len(x)), x))
        mean = np.average(x[a], axis=0, weights=w[a])
        spread = np.sqrt(np.average((x[a] - mean) ** 2, axis=0, weights=w[a]))
        penalty = np.diag([0, *(spread**2 / w[a].sum())])
        beta = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z[a] @ beta))
            g = z[a].T @ (w[a] * (p - y[a])) / w[a].sum() + penalty @ beta
            h = z[a].T @ ((w[a] * p * (1 - p))[:, None] * z[a]) / w[a].sum() + penalty
            beta -= np.linalg.solve(h, g)
        p = 1 / (1 + np.exp(-z[b] @ beta))
        loss = -np.average(np.log(np.where(y[b] == 1, p, 1 - p)), weights=w[b])
        assert made[fold, 1.0].rows == b.sum()
        assert abs(made[fold, 1.0].log_loss - loss) < 1e-3


def test_all_models_share_few_passes(spark, sf_dir, monkeypatch):
    """a pass over the draws serves the models of all folds and strengths, and each ends where its slopes are 0."""
    passes, old = [], forward._sums
    monkeypatch.setattr(forward, "_sums", lambda blocks, asked: (passes.append(len(asked)), old(blocks, asked))[1])
    rows = draws(spark, sf_dir)
    sizes = rows.groupBy("game").count().withColumnRenamed("count", "draws")
    blocks = forward.causal_blocks(rows, 32).join(sizes, "game").cache()
    fits = forward.logistic_fits(blocks)
    assert fits and len(fits) % 3 == 0 and len(passes) <= 12
    cells = np.array([(r.y, r.rate, r.gap, r.age) for r in forward.item_features(rows).collect()], float)
    for (fold, c), beta in fits.items():
        y, *x = cells[cells[:, 3] <= forward.FOLDS[fold][0]][:, :3].T
        w, z = np.where(y == 1, 5.0, 50 / 90), np.column_stack((np.ones(len(y)), *x))
        mean = np.average(z, axis=0, weights=w)
        spread = (w[:, None] * (z - mean) ** 2).sum(0) / (w.sum() - (w * w).sum() / w.sum())
        p = 1 / (1 + np.exp(-z @ beta))
        assert np.abs(z.T @ (w * (p - y)) / w.sum() + spread * beta / (c * w.sum())).max() < 1e-9
    blocks.unpersist()
