import math

import numpy as np

from setloom.operators import filters


def test_variance_grid_against_a_loop(spark, sf_dir):
    """Small blocks and groups of three maps: the scan has several levels and equals a loop over a game's draws."""
    params = filters.grid()
    series = filters.residuals(spark, sf_dir)
    data = series.toPandas().sort_values(["game", "t"])
    made = {(r.game, r.id): r for r in filters.variance_fit(series, params, size=8, fan=3).collect()}
    path = {(r.game, r.t, r.id): r.variance for r in filters.variance_path(series, params, size=8, fan=3).collect()}
    assert len(made) == data.game.nunique() * len(params) and len(path) == len(data) * len(params)
    for game, rows in data.groupby("game"):
        eps, variance = rows.eps.to_numpy(), rows.variance.iloc[0]
        assert np.isclose(eps.mean(), 0, atol=1e-9) and np.isclose(eps.var(), variance)
        for p in params.itertuples():
            held, ll = [variance], 0.0
            omega = math.log(p.scale * (1 - p.alpha - p.beta * p.order) * variance)
            step = lambda e, season: math.exp(omega + p.gamma * season) + filters.FLOOR + p.alpha * e**2 + sum(p.beta * held[-j] for j in range(1, p.order + 1) if j <= len(held))
            for i in range(1, len(eps)):
                held.append(step(eps[i - 1], rows.season.iloc[i]))
                ll += filters.constant(p.nu) - 0.5 * math.log(held[-1]) - (p.nu + 1) / 2 * math.log(1 + eps[i] ** 2 / held[-1] / (p.nu - 2))
            r = made[game, p.id]
            assert r.steps == len(eps) - 1 and abs(r.aic - (2 * (4 + p.order) - 2 * ll)) < 1e-6
            assert abs(r.next_variance - step(eps[-1], 0.0)) < 1e-6
            assert all(abs(path[game, t, p.id] - h) < 1e-8 * h for t, h in zip(rows.t, held))


def test_regimes_against_a_forward_pass(spark, sf_dir):
    rows = filters.labelled(spark, sf_dir)
    made = {(r.game, r.t): r for r in filters.regime_posteriors(rows, size=8, fan=3).collect()}
    data = rows.toPandas().sort_values(["game", "t"])
    assert len(made) == len(data)
    for game, part in data.groupby("game"):
        x, label = part[["u", "v"]].to_numpy(), part.label.to_numpy()
        moves = np.ones((2, 2))
        for a, b in zip(label, label[1:]):
            moves[a, b] += 1
        trans = moves / moves.sum(axis=1, keepdims=True)
        density = np.zeros((len(x), 2))
        for s in (0, 1):
            mean, cov = x[label == s].mean(0), np.cov(x[label == s].T, bias=True) + 1e-3 * np.eye(2)
            far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            density[:, s] = np.linalg.det(cov) ** -0.5 * (1 + far / 5) ** -3.5
        alpha = np.array([0.5, 0.5]) * density[0]
        for i, t in enumerate(part.t):
            if i:
                alpha = (alpha @ trans) * density[i]
            alpha /= alpha.sum()
            assert abs(made[game, t].posterior - alpha[1]) < 1e-9
            assert abs(made[game, t].next - alpha @ trans[:, 1]) < 1e-9


def test_scans_of_nothing(spark, sf_dir):
    assert not filters.variance_fit(filters.residuals(spark, sf_dir).limit(0), filters.grid()).collect()
    assert not filters.regime_posteriors(filters.labelled(spark, sf_dir).limit(0)).collect()
