import numpy as np
import pytest
from pyspark.sql import functions as F

from setloom.operators import builders as B
from setloom.plans.draws import draws


def plain_sweep(main, star, budget, shared=3, steps=B.STEPS):
    """Points one after the other, items by cumulative weights."""
    cuts = [np.cumsum(main), np.cumsum(star)]
    at, made = 0, []

    def fill(cut, k):
        nonlocal at
        picked = []
        while at < budget * steps and len(picked) < k:
            u = (B.PHASE + at * B.GOLDEN) % 1.0
            item = int(min(np.searchsorted(cut, u, side="right"), len(cut) - 1)) + 1
            at += 1
            if item not in picked:
                picked.append(item)
        return sorted(picked)

    while at < budget * steps:
        ticket = (fill(cuts[0], 5), fill(cuts[1], 2))
        if len(ticket[0]) == 5 and len(ticket[1]) == 2 and ticket not in made:
            made.append(ticket)
    kept = []
    for t in made:
        if len(kept) < budget and all(len({*t[0]} & {*k[0]}) <= shared for k in kept):
            kept.append(t)
    return kept + [t for t in made if t not in kept][: budget - len(kept)]


@pytest.mark.parametrize("orientation", ["affinity", "contrarian", "uniform"])
def test_sweep_against_a_loop(spark, orientation):
    rng = np.random.default_rng(8)
    n = {"main": rng.random(50) ** 3 + 0.01, "star": rng.random(12) + 0.1}
    rows = [("g", k, i + 1, float(w)) for k in n for i, w in enumerate(n[k])]
    weights = B.oriented(spark.createDataFrame(rows, "game string, kind string, item int, n double"), orientation)
    turned = {k: {"affinity": w, "contrarian": w.max() + w.min() - w, "uniform": np.ones(len(w))}[orientation] for k, w in n.items()}
    made = B.sweep(weights, 25).orderBy("place").collect()
    assert [(r.main, r.star) for r in made] == plain_sweep(turned["main"] / turned["main"].sum(), turned["star"] / turned["star"].sum(), 25)


def test_every_builder_keeps_the_rules(spark, sf_dir):
    """The other four differ from these by a weight or a mode."""
    history = draws(spark, sf_dir).where("game in ('1-URGENT', '5-LOW')")
    made = {name: B.propose(name, history, 6, 3) for name in ("frequency", "unpopularity", "level_set", "stationary_contrarian", "guarded_ablation")}
    for name, rows in made.items():
        assert rows.count() == 12 and B.refused(rows, history.select("game").distinct(), 6).count() == 0, name
    again = B.propose("frequency", history, 6, 3)
    assert again.exceptAll(made["frequency"]).count() == 0  # the same seed gives the same tickets
    assert B.propose("frequency", history, 6, 4).select("main", "star").exceptAll(made["frequency"].select("main", "star")).count() > 0
    assert {e.ablation_of for e in B.REGISTRY.values()} <= {None, *B.REGISTRY}


@pytest.mark.parametrize("rows", [
    [([1, 2, 3, 4, 5], [1, 2])],
    [([1, 2, 3, 4, 5], [1, 2])] * 2,
    [([1, 2, 3, 4, 5], [1, 2]), ([1, 2, 3, 4, 51], [1, 2])],
    [([1, 2, 3, 4, 5], [1, 2]), ([1, 2, 3, 5, 4], [1, 2])],
    [([1, 2, 3, 4, 5], [1, 2]), ([1, 2, 3, 4, 4], [1, 2])],
    [([1, 2, 3, 4, 5], [1, 2]), ([1, 2, 3, 4, 6], [2])],
    [([1, 2, 3, 4, 5], [1, 2]), (None, [1, 2])],
])
def test_illegal_results_are_refused(spark, monkeypatch, rows):
    frame = spark.createDataFrame([("g", i + 1, m, s, 0.0) for i, (m, s) in enumerate(rows)], B.PROPOSALS)
    monkeypatch.setitem(B.REGISTRY, "wrong", B.Builder(lambda history, budget, seed: frame, "short, repeated or illegal"))
    history = spark.createDataFrame([("g", 1)], "game string, t long")
    with pytest.raises(ValueError, match="wrong gave"):
        B.propose("wrong", history, 2)
    with pytest.raises(KeyError):
        B.propose("nobody", history, 2)


def test_stars_without_pairs_have_their_cross_marginal(spark, sf_dir):
    one = draws(spark, sf_dir).where("game = '1-URGENT'").withColumn("s2", F.col("s1"))
    found = {r.item: r.n for r in B.ranks(one).where("kind = 'star'").collect()}
    share = {r.s1: r["count"] for r in one.groupBy("s1").count().collect()}
    total = sum(share.values())
    assert all(abs(found[s] - share.get(s, 0) / total) < 1e-12 for s in range(1, 13))


def test_builders_of_one_history_share_what_they_count(spark, monkeypatch):
    from setloom.operators import builders

    made, count = [], builders.counted_items
    monkeypatch.setattr(builders, "counted_items", lambda history: made.append(history) or count(history))
    rows = [("g", t, *[(t * k) % 7 + 7 * k + 1 for k in range(5)], t % 12 + 1, (t + 5) % 12 + 1) for t in range(1, 30)]
    history = spark.createDataFrame(rows, "game string, t long, b1 int, b2 int, b3 int, b4 int, b5 int, s1 int, s2 int")
    for name in ("frequency", "uniform", "unpopularity"):
        assert builders.propose(name, history, 3, 1).count() == 3
    assert len(made) == 1
    other = history.where("t < 20")
    assert builders.item_weights(other).agg({"n": "sum"}).first()[0] == 19 * 7 + 62 and len(made) == 2
