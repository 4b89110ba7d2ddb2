"""What fails or grows too fast on larger tables only."""

import duckdb
import pytest
from pyspark.sql import functions as F

from setloom import catalog


def answers(sql, sf_dir, *names):
    con = duckdb.connect(config={"memory_limit": "3GB", "threads": 4})
    for name in names:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    found = con.execute(sql)
    return [c[0] for c in found.description], sorted(map(repr, (list(r) for r in found.fetchall())))


def test_digest_of_a_long_game(spark):
    """a sum of more than 4,096 hashes of 52 bits passes 63 bits."""
    big = "/root/testdata/sf0.1"
    columns, exact = answers(catalog.ORACLE_SQL["a25_dataset_digest"], big, "orders", "lineitem")
    found = catalog.QUERIES["a25_dataset_digest"](spark, big).collect()
    assert sorted(repr([r[c] for c in columns]) for r in found) == exact


def test_counts_whose_squares_pass_32_bits(spark):
    """an item's count of more than 46,340 squared is no 32-bit integer."""
    from setloom.operators.measures import frequency_windows

    history = spark.range(1, 46_400).select(F.lit("g").alias("game"), F.col("id").alias("t"), *(F.lit(i).alias(f"b{i}") for i in range(1, 6)))
    made = frequency_windows(history, (50,)).where("t = 46399 and item in (1, 50)").collect()
    # five items with one count and 45 without any: z is 3 and -1/3
    assert {r["item"]: (round(r["z_all"], 9), round(r["z50"], 9)) for r in made} == {1: (3.0, 3.0), 50: (-0.333333333, -0.333333333)}


@pytest.mark.parametrize("name", ["a14_leaderboard", "a15_sign_flip", "a18_pick_metrics", "a19_random_theory", "a24_method_ranking", "t3_equal_shortlists", "w13_centrality"])
def test_plans_by_row_equal_duckdb(spark, sf_dir, name):
    """hits and pairs counted in a draw's or ticket's row."""
    columns, exact = answers(catalog.ORACLE_SQL[name], sf_dir, "customer", "orders", "lineitem")
    found = catalog.QUERIES[name](spark, sf_dir).collect()
    assert found and sorted(repr([r[c] for c in columns]) for r in found) == exact


def test_ranks_across_blocks(spark):
    """ranks over blocks of three draws are those of a loop, holes and repeats of codes included."""
    import random

    from setloom.operators.ranks import ranked

    rng, rows, seen, exact = random.Random(3), [], {}, {}
    for t in [*range(1, 12), *range(20, 31)]:
        codes = sorted(rng.sample(range(1, 9), rng.randint(0, 5)))
        rows.append(("g", t, codes))
        for c in codes:
            seen[c] = seen.get(c, 0) + 1
        exact[t] = [seen[c] for c in codes]
    assert {r.t: r.ranks for r in ranked(spark.createDataFrame(rows, "game string, t long, codes array<int>"), 3).collect()} == exact


def test_guarded_pool_does_not_pass_the_driver(spark, monkeypatch):
    """the games are broadcast to the tickets, never the tickets to the games."""
    from setloom.operators import portfolio

    pool = spark.createDataFrame([(i, [i, i + 1, i + 2, i + 3, i + 4], [1, 2]) for i in range(1, 9)], "ticket_id long, main array<int>, star array<int>")
    history = spark.createDataFrame([("g", t, *range(1, 6), 1, 2) for t in range(1, 9)], "game string, t long, b1 int, b2 int, b3 int, b4 int, b5 int, s1 int, s2 int")
    seen = []
    cross = type(pool).crossJoin
    monkeypatch.setattr(type(pool), "crossJoin", lambda a, b: (seen.append((a.columns, b._jdf.queryExecution().analyzed().toString())), cross(a, b))[1])
    portfolio.guarded_portfolio(pool, history, 2, modes=("guarded",))
    assert any("ticket_id" in columns and "strategy=broadcast" in plan for columns, plan in seen)


def test_pairs_are_counted_in_a_blocks_row(spark, monkeypatch):
    from setloom.operators import ranks

    kept = {}
    old = ranks.stored
    monkeypatch.setattr(ranks, "stored", lambda df, name: kept.setdefault(name, old(df, name)))
    rows = [("g", t, [1, 2, 1 + t % 3]) for t in range(1, 10)] + [("h", 1, [])]
    ranks.ranked(spark.createDataFrame(rows, "game string, t long, codes array<int>"), 4).collect()
    assert kept["blocks"].count() == 4
    made = {(r.game, r.block, r.code): r.n for r in kept["counts"].collect()}
    assert made[("g", 0, 1)] == 5 and made[("g", 2, 2)] == 1 and sum(made.values()) == 27 and len(made) == kept["counts"].count()


def test_signals_are_added_within_a_tickets_row(spark):
    """no row for each component and no join with the pool; the sums are those of a loop."""
    from setloom.operators import portfolio as P

    found = P.domain(spark).select(F.explode(F.array(F.lit("g"), F.lit("h"))).alias("game"), "kind", "a", "b").withColumn("value", F.when(F.col("a") % 3 == 0, F.col("a") * 64.0 + F.col("b") + F.length("game") + F.when(F.col("game") == "h", 0.5).otherwise(0.0)).otherwise(0.0))
    rows = found.select("game", "kind", "a", "b", "value").collect()
    value, found = {(r.game, r.kind, r.a, r.b): r.value for r in rows}, spark.createDataFrame(rows, "game string, kind string, a int, b int, value double")
    pool = spark.createDataFrame([(1, [1, 2, 3, 4, 5], [1, 2]), (2, [3, 6, 9, 49, 50], [3, 12]), (3, [1, 2, 4, 5, 7], [11, 12]), (4, [6, 7, 8, 9, 10], [3, 3])], "ticket_id long, main array<int>, star array<int>")
    made = P.ticket_signals(pool, found)
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    parts = {r.ticket_id: r.parts for r in pool.select("ticket_id", P.components().alias("parts")).collect()}
    rows = made.collect()
    assert len(rows) == 8
    for r in rows:
        assert r.signal == pytest.approx(sum(value.get((r.game, c.kind, c.a, c.b), 0.0) for c in parts[r.ticket_id]))
