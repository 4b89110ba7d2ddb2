import random

import pytest

from setloom.operators import budgets

DRAW = "game string, t long, b1 int, b2 int, b3 int, b4 int, b5 int, s1 int, s2 int"


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(4)
    rows = [("g", t, *sorted(rng.sample(range(1, 51), 5)), *sorted(rng.sample(range(1, 13), 2))) for t in range(1, 41)]
    return spark.createDataFrame(rows + [("short", t, 1, 2, 3, 4, 5, 1, 2) for t in range(1, 9)], DRAW)


def test_tickets_are_legal_and_taken_in_turn(history):
    made = {(r.t, r.method): r for r in budgets.portfolios(history, 4, 10).collect()}
    assert len(made) == 30 * 4 and {r.game for r in made.values()} == {"g"}
    for r in made.values():
        assert len(r.mains) == len(r.bought_stars) == 4
        assert all(len({*m}) == 5 and m == sorted(m) and 1 <= m[0] and m[-1] <= 50 for m in r.mains)
        assert all(len({*s}) == 2 and {*s} <= {*range(1, 13)} for s in r.bought_stars)
    for t in range(11, 41):
        singles = [made[t, m].mains for m in budgets.METHODS]
        assert made[t, "pooled"].mains == [singles[j % 3][j] for j in range(4)]
        assert len({str(made[t, m].bought_stars) for m in (*budgets.METHODS, "pooled")}) == 1


def test_only_earlier_draws_count(history, spark):
    changed = spark.createDataFrame([r if r.t < 40 else r.__class__(**{**r.asDict(), "b1": 46, "b2": 47, "b3": 48, "b4": 49, "b5": 50}) for r in history.where("game = 'g'").collect()], DRAW)
    one, two = ({(r.t, r.method): r.mains for r in budgets.portfolios(h, 3, 20).collect()} for h in (history, changed))
    assert one == two


def test_sums_against_the_tickets(history, spark):
    tiers = spark.createDataFrame([(b, s, 10.0 * b + s) for b in range(1, 6) for s in range(3)] + [(9, 9, 1e9)], "balls int, stars int, prize double")
    made = {r.method: r for r in budgets.equal_budget(history, tiers, 4, 2.0, 10).collect()}
    for method, r in made.items():
        hits, won, items = [], 0.0, []
        for x in budgets.portfolios(history, 4, 10).where(f"method = '{method}'").collect():
            items.append(len({i for m in x.mains for i in m}))
            for m, s in zip(x.mains, x.bought_stars):
                balls, stars = len({*m} & {*x.drawn}), len({*s} & {*x.stars})
                hits.append(balls)
                won += 10.0 * balls + stars if balls else 0
        assert (r.draws, r.tickets, r.hits, r.won, r.spent) == (30, 120, sum(hits), won, 240.0)
        assert r.number_coverage == pytest.approx(sum(items) / 30 / 50) and r.roi == pytest.approx((won - 240) / 240)
    assert sorted(r.place for r in made.values()) == [0, 1, 2, 3] and made["uniform"].lift == 0
    assert max(r.to_best for m, r in made.items() if m != "pooled") == 0


def test_no_draws(spark):
    tiers = spark.createDataFrame([], "balls int, stars int, prize double")
    assert budgets.equal_budget(spark.createDataFrame([], DRAW), tiers).count() == 0


def test_uniforms_are_those_of_single_digests():
    """digests of many texts at once, over one block or more, are hashlib's."""
    import hashlib

    from setloom.functions.digests import uniforms

    starts, ends = ["", "é:", "e1b:4-NOT SPECIFIED:99:", "e1b:4-NOT SPECIFIED:100:", *("x" * n for n in range(50, 58)), "y" * 130], ["", "1:1", "6:50", "zz"]
    exact = [[int(hashlib.md5((a + b).encode()).hexdigest()[:13], 16) / 2**52 for b in ends] for a in starts]
    assert uniforms(starts, ends).tolist() == exact


def test_no_ticket_leaves_its_block(history):
    """a row for each method and number of hits comes out of a block, not one for each draw, item or ticket."""
    made = budgets.settled(history, 4, 10).collect()
    assert len(made) <= 4 * 18 and sum(r.tickets for r in made) == 4 * 4 * 30 and sum(r.draws for r in made) == 4 * 30
    assert budgets.smallest(budgets.np.array([[2.0, 1.0, 1.0, 1.0]]), 2).tolist() == [[False, True, True, False]]
