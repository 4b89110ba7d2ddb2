from math import gcd

import numpy as np
import pytest

from setloom.operators import branches


def history(spark, sizes, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(g, t, *sorted((rng.choice(50, 5, replace=False) + 1).tolist()), *sorted((rng.choice(12, 2, replace=False) + 1).tolist())) for g, n in sizes.items() for t in range(1, n + 1)]
    return rows, spark.createDataFrame(rows, "game string, t long, b1 int, b2 int, b3 int, b4 int, b5 int, s1 int, s2 int")


def plain_frame(rows):
    """poi, ratio, upper, prime and coprime of each draw of one game."""
    n, out = {}, []
    for r in rows:
        items = [*r[2:7], *(100 + s for s in r[7:9])]
        pairs = [(a, b) for i, a in enumerate(items) for b in items[i + 1 :]]
        for p in pairs:
            n[p] = n.get(p, 0) + 1
        poi = sum(n[p] for p in pairs)
        phi = sum(gcd(k, poi) == 1 for k in range(1, poi + 1))
        out.append((poi, phi / poi, phi / poi >= 0.5, phi == poi - 1, int(bool(out) and gcd(poi, out[-1][0]) == 1)))
    return out


def plain_fit(frame, mode, upper):
    """A refit of one branch: rows, targets and coefficients."""
    at = [i for i in range(2, len(frame)) if frame[i][2] == upper and not (mode == "pruned" and frame[i][3])]
    x = np.array([[1, frame[i - 1][0], frame[i - 1][1], frame[i - 1][4]] for i in at], float)
    y = np.array([frame[i][0] for i in at], float)
    return (x, y, np.linalg.lstsq(x, y, rcond=None)[0]) if len(at) >= 20 else None


def plain_forecast(frame, mode):
    fits = {u: plain_fit(frame, mode, u) for u in (False, True)}
    if None in fits.values():
        return None
    usable = [f for f in frame if mode == "classic" or not f[3]]
    upper = usable[-1][2] ^ (frame[-1][4] == 1)
    return upper, float(np.array([1, frame[-1][0], frame[-1][1], frame[-1][4]]) @ fits[upper][2])


@pytest.mark.parametrize("block", [256, 16])
def test_frame_against_a_loop(spark, block):
    rows, frame = history(spark, {"g": 70, "h": 3})
    made = {(r.game, r.t): r for r in branches.branch_frame(frame, size=block).collect()}
    for g in ("g", "h"):
        for t, want in enumerate(plain_frame([r for r in rows if r[0] == g]), 1):
            r = made[g, t]
            assert (r.poi, r.ratio, r.upper, r.prime, r.coprime) == (want[0], pytest.approx(want[1]), *want[2:])
    assert len(made) == 73 and made["g", 1].gcd is None and made["g", 1].changed == 0


def test_totients():
    n = np.arange(1, 400)
    assert branches.totients(n).tolist() == [sum(gcd(k, int(m)) == 1 for k in range(1, m + 1)) for m in n]
    assert branches.totients(np.array([1_000_000_007, 2**31, 999_983**2])).tolist() == [1_000_000_006, 2**30, 999_983 * 999_982]


def test_forecasts_equal_refits_at_every_cut_off(spark):
    rows, frame = history(spark, {"g": 160, "h": 60, "i": 26})
    table = branches.branch_frame(frame)
    steps = branches.validity_steps(table, 30).collect()
    assert len(steps) == 30 + 30 + 1
    errors = {}
    for r in steps:
        whole = plain_frame([x for x in rows if x[0] == r.game])
        assert r.actual == whole[r.t - 1][0]
        for mode in ("classic", "pruned"):
            want = plain_forecast(whole[: r.t - 1], mode)
            assert r[mode] == (None if want is None else max(1, round(want[1])))
            if want:
                assert r[f"{mode}_upper"] == want[0]
        if r.classic is not None and r.pruned is not None:
            errors.setdefault(r.game, []).append((r.classic - r.actual, r.pruned - r.actual))
            assert r.recommended in ("classic", "pruned")
    assert errors["g"]
    made = {(r.game, r["mode"]): r for r in branches.validity(branches.validity_steps(table, 30)).collect()}
    for g, e in errors.items():
        rmse = np.sqrt(np.mean(np.square(e), axis=0))
        for mode, want in zip(("classic", "pruned"), rmse):
            assert made[g, mode].rmse == pytest.approx(want) and made[g, mode].holdout == len(e)
            assert made[g, mode].recommended == (mode == ("pruned" if rmse[1] <= rmse[0] else "classic"))


def test_models_and_next_forecast(spark):
    rows, frame = history(spark, {"g": 150, "h": 12})
    table = branches.branch_frame(frame)
    models = branches.branch_models(table)
    made = {(r["mode"], r.upper): r for r in models.collect()}
    whole = plain_frame([r for r in rows if r[0] == "g"])
    assert {r.game for r in made.values()} == {"g"}
    for (mode, upper), r in made.items():
        x, y, b = plain_fit(whole, mode, upper)
        e = y - x @ b
        assert [r[c] for c in branches.TERMS] == pytest.approx(b.tolist(), rel=1e-6, abs=1e-6)
        scale = e.std()
        aic = 4 - 2 * (-0.5 * len(e) * np.log(2 * np.pi) - len(e) * np.log(scale) - 0.5 * np.sum(((e - e.mean()) / scale) ** 2))
        assert (r.rows, r.rmse, r.mae, r.scale, r.aic) == (len(e), pytest.approx(np.sqrt(np.mean(e**2))), pytest.approx(np.abs(e).mean()), pytest.approx(scale), pytest.approx(aic))
    for r in branches.next_forecast(table, models).collect():
        upper, centre = plain_forecast(whole, r["mode"])
        assert r.next_upper == upper and r.forecast == pytest.approx(centre, rel=1e-7) and r.score == max(1, round(centre))
        assert r.high_80 - r.low_80 == pytest.approx(2 * 1.2815515655 * r.scale)


def test_empty_history(spark):
    _, frame = history(spark, {"g": 30})
    table = branches.branch_frame(frame.limit(0))
    assert not table.collect() and not branches.validity_steps(table).collect() and not branches.branch_models(table).collect()
