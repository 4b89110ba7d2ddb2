"""Ticket builders behind one checked interface.

A builder is a function of (history, budget, seed): draws of all games in, rows of PROPOSALS out. propose() runs one by
name and refuses a result with an illegal, repeated or missing ticket. An ablation names the builder it is measured
against. Builders make their tickets for all games at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.plans.dialect import Spark
from setloom.plans.draws import MAIN_K, MAIN_N, draws
from setloom.sources.storage import stored

from . import levels, portfolio
from .portfolio import STAR_K, STAR_N
from .ranking import stationary

PROPOSALS = "game string, place int, main array<int>, star array<int>, score double"
#: Step of the additive sequence that sweeps the weights: the golden ratio's fraction; and where it starts.
GOLDEN, PHASE = 0.6180339887498949, 0.5
#: Candidates for one ticket: of the weighted sampler, of the unpopular pool, of the guarded pool.
SPARE, UNPOPULAR_POOL, GUARDED_POOL = 4, 40, 60
#: Steps of the sweep for one ticket; a ticket takes about eight.
STEPS = 48


@dataclass(frozen=True)
class Builder:
    make: Callable[[DataFrame, int, int], DataFrame]
    summary: str
    ablation_of: str | None = None


REGISTRY: dict[str, Builder] = {}


def builder(name: str, ablation_of: str | None = None) -> Callable[[Callable[[DataFrame, int, int], DataFrame]], Callable[[DataFrame, int, int], DataFrame]]:
    def add(f: Callable[[DataFrame, int, int], DataFrame]) -> Callable[[DataFrame, int, int], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"two builders are called {name}")
        REGISTRY[name] = Builder(f, (f.__doc__ or "").strip().split("\n")[0], ablation_of)
        return f

    return add


def legal(items: str, n: int, k: int) -> Column:
    """k different items from 1 to n in rising order."""
    return (F.size(items) == k) & (F.size(F.array_distinct(items)) == k) & (F.array_sort(items) == F.col(items)) & F.forall(items, lambda i: (i >= 1) & (i <= n))


def refused(made: DataFrame, games: DataFrame, budget: int) -> DataFrame:
    """game, illegal, tickets, distinct of each game whose tickets are not `budget` different legal ones."""
    ok = legal("main", MAIN_N, MAIN_K) & legal("star", STAR_N, STAR_K)
    held = made.groupBy("game").agg(F.count_if(~ok | F.col("main").isNull() | F.col("star").isNull()).alias("illegal"), F.count("*").alias("tickets"), F.count_distinct("main", "star").alias("distinct"))
    met = games.join(held, "game", "left").fillna(0, ["illegal", "tickets", "distinct"])
    return met.where((F.col("illegal") > 0) | (F.col("tickets") != budget) | (F.col("distinct") != budget))


def propose(name: str, history: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """Rows of PROPOSALS by the builder `name`, stored; ValueError if they break the rules."""
    if name not in REGISTRY:
        raise KeyError(f"no builder is called {name}; there are {', '.join(REGISTRY)}")
    made = stored(REGISTRY[name].make(history, budget, seed).select("game", F.col("place").cast("int").alias("place"), F.col("main").cast("array<int>").alias("main"), F.col("star").cast("array<int>").alias("star"), F.col("score").cast("double").alias("score")), f"proposals-{name}")
    wrong = refused(made, history.select("game").distinct(), budget).first()
    if wrong is not None:
        raise ValueError(f"{name} gave {wrong['tickets']} tickets for {wrong['game']}, {wrong['distinct']} different, {wrong['illegal']} illegal; {budget} were asked for")
    return made


#: What several builders take from one history, by the history and a name; gone with the history.
_SHARED: WeakKeyDictionary[DataFrame, dict[str, DataFrame]] = WeakKeyDictionary()


def shared(history: DataFrame, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(history), stored once for all builders of this history."""
    held = _SHARED.setdefault(history, {})
    if name not in held:
        held[name] = stored(make(history), name)
    return held[name]


def item_weights(history: DataFrame) -> DataFrame:
    """`counted_items`, counted once for all builders."""
    return shared(history, "weights", counted_items)


def counted_items(history: DataFrame) -> DataFrame:
    """game, kind (main or star), item, n: draws with the item plus one; every item of the game has a row."""
    spark = history.sparkSession
    items = F.explode(F.concat(*(F.array(F.struct(F.lit(k).alias("kind"), F.col(c).cast("int").alias("item"))) for k, c in [*(("main", f"b{i}") for i in range(1, MAIN_K + 1)), *(("star", f"s{i}") for i in range(1, STAR_K + 1))])))
    counts = history.select("game", items.alias("x")).groupBy("game", "x.kind", "x.item").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([("main", i) for i in range(1, MAIN_N + 1)] + [("star", i) for i in range(1, STAR_N + 1)], "kind string, item int")
    return history.select("game").distinct().crossJoin(F.broadcast(every)).join(counts, ["game", "kind", "item"], "left").select("game", "kind", "item", (F.coalesce("n", F.lit(0)) + 1.0).alias("n"))  # a row per item of the game


def sampled(weights: DataFrame, budget: int, seed: int, spare: int) -> DataFrame:
    """game, try, main, star: budget * spare tickets drawn by weight without replacement within a ticket, from weights
    (game, kind, item, n), the first of equal tickets only. An item's key is -ln(u) / weight; the smallest keys are drawn."""
    tries = F.explode(F.sequence(F.lit(1), F.lit(budget * spare))).alias("try")
    u = F.expr(Spark().u(f"concat('{seed}:', game, ':', cast(try as varchar(20)), ':', kind, cast(item as varchar(9)))"))
    keys = weights.select("game", "kind", "item", "n", tries).withColumn("key", -F.log(u + 1e-15) / F.col("n"))
    k = {"main": MAIN_K, "star": STAR_K}
    drawn = keys.groupBy("game", "try").agg(*(F.array_sort(F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "item")))), 1, n).getField("item")).alias(kind) for kind, n in k.items()))
    first = F.row_number().over(Window.partitionBy("game", "main", "star").orderBy("try"))
    return drawn.withColumn("first", first).where("first = 1").drop("first")


def log_weight(tickets: DataFrame, weights: DataFrame) -> DataFrame:
    """tickets with `score`: the sum of the logarithms of their items' shares."""
    share = weights.withColumn("ln", F.log(F.col("n") / F.sum("n").over(Window.partitionBy("game", "kind"))))
    parts = F.expr("explode(concat(transform(main, i -> named_struct('kind', 'main', 'item', i)), transform(star, i -> named_struct('kind', 'star', 'item', i))))")
    return tickets.withColumn("x", parts).select(*tickets.columns, "x.*").join(F.broadcast(share.drop("n")), ["game", "kind", "item"]).groupBy(*tickets.columns).agg(F.sum("ln").alias("score"))  # a row per item of the game


def best(tickets: DataFrame, budget: int, *order: Column) -> DataFrame:
    return tickets.withColumn("place", F.row_number().over(Window.partitionBy("game").orderBy(*order))).where(F.col("place") <= budget)


@builder("frequency")
def frequency(history: DataFrame, budget: int, seed: int) -> DataFrame:
    """Tickets drawn by the items' smoothed frequency."""
    weights = item_weights(history)
    return best(log_weight(sampled(weights, budget, seed, SPARE), weights), budget, F.col("try"))


@builder("uniform", ablation_of="frequency")
def uniform(history: DataFrame, budget: int, seed: int) -> DataFrame:
    """The same sampler with equal weights."""
    weights = stored(item_weights(history).withColumn("n", F.lit(1.0)), "weights")
    return best(log_weight(sampled(weights, budget, seed, SPARE), weights), budget, F.col("try"))


@builder("unpopularity")
def unpopularity(history: DataFrame, budget: int, seed: int) -> DataFrame:
    """Of many tickets drawn against the crowd, those that pay most."""
    weights = item_weights(history).withColumn("n", F.when(F.col("kind") == "star", 1.0).otherwise(F.when(F.col("item") <= 31, 1 / 1.3).otherwise(1 / 0.8)))
    lam = portfolio.popularity() / 7.0
    pool = sampled(weights, budget, seed, UNPOPULAR_POOL).withColumn("score", (1 - F.exp(-lam)) / lam)
    return best(pool, budget, F.desc("score"), F.col("main"), F.col("star"))


@builder("level_set")
def level_set(history: DataFrame, budget: int, seed: int) -> DataFrame:
    """Tickets whose pair sum is nearest to the recent mean, of all tickets."""
    return levels.level_set_portfolio(history, budget)


def ranks(history: DataFrame) -> DataFrame:
    """game, kind, item, n: stationary rank of items and of stars over their pair counts; where no pair of stars was drawn
    the stars have the sum of their pairs with items instead."""
    counts = stored(levels.pair_table(levels.drawn(history)), "pairs")
    games = history.select("game").distinct()
    graph = F.struct("game", "kind").alias("game")  # the two graphs of a game in one run
    one = counts.where("kind <> 'main-star'").withColumn("kind", F.substring_index("kind", "-", 1))
    both = one.select(graph, F.col("a").alias("src"), F.col("b").alias("dst"), "n").unionByName(one.select(graph, F.col("b").alias("src"), F.col("a").alias("dst"), "n"))
    edges = both.select("game", "src", "dst", (F.col("n") / F.sum("n").over(Window.partitionBy("game", "src"))).alias("share"))
    sizes = F.expr(f"explode(array(named_struct('kind', 'main', 'size', {MAIN_N}), named_struct('kind', 'star', 'size', {STAR_N})))").alias("x")
    nodes = games.select("game", sizes).select(F.struct("game", "x.kind").alias("game"), F.explode(F.sequence(F.lit(1), F.col("x.size"))).alias("item"))
    made = stationary(edges, nodes).select("game.game", "game.kind", "item", F.col("rank").alias("n"))
    cross = counts.where("kind = 'main-star'").groupBy("game", F.col("b").alias("item")).agg(F.sum("n").alias("cross"))
    cross = cross.select("game", F.lit("star").alias("kind"), "item", (F.col("cross") / F.sum("cross").over(Window.partitionBy("game"))).alias("cross"))
    have = one.select("game", "kind").distinct().withColumn("pairs", F.lit(True))
    met = made.join(have, ["game", "kind"], "left").join(cross, ["game", "kind", "item"], "left")
    return met.select("game", "kind", "item", F.when(F.col("pairs") | (F.col("kind") == "main"), F.col("n")).otherwise(F.coalesce("cross", F.lit(0.0))).alias("n"))


def oriented(weights: DataFrame, orientation: str) -> DataFrame:
    """Weights that sum to 1 per game and kind: as they are, order turned around with the same range, or equal."""
    own = Window.partitionBy("game", "kind")
    value = {"affinity": F.col("n"), "contrarian": F.max("n").over(own) + F.min("n").over(own) - F.col("n"), "uniform": F.lit(1.0)}[orientation]
    made = weights.select("game", "kind", "item", value.alias("w"))
    return made.withColumn("w", F.col("w") / F.sum("w").over(own))


def sweep(weights: DataFrame, budget: int, shared: int = MAIN_K - 2, steps: int = STEPS) -> DataFrame:
    """game, place, main, star: tickets from consecutive points of the golden-ratio sequence.

    Each point falls on an item by a join with the ranges of cumulative weights. A ticket takes different items from one
    point on until it has all, then its stars; the next one goes on where it ended. Tickets that share more than `shared`
    items with an earlier one are passed over, unless too few are left.
    """
    spark = weights.sparkSession
    low = F.sum("w").over(Window.partitionBy("game", "kind").orderBy("item").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranges = weights.withColumn("high", low).withColumn("low", F.col("high") - F.col("w"))
    top = Window.partitionBy("game", "kind")
    ranges = ranges.withColumn("high", F.when(F.col("item") == F.max("item").over(top), 2.0).otherwise(F.col("high")))
    points = spark.range(budget * steps).select(F.col("id").alias("step"), F.expr(f"{PHASE}D + id * {GOLDEN!r}D - floor({PHASE}D + id * {GOLDEN!r}D)").alias("u"))
    hit = points.join(F.broadcast(ranges), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))  # a row per item and game
    path = hit.groupBy("game", "step").agg(F.max(F.when(F.col("kind") == "main", F.col("item"))).alias("m"), F.max(F.when(F.col("kind") == "star", F.col("item"))).alias("s"))

    def filled(frame: pd.DataFrame) -> pd.DataFrame:
        """One game's points, whose number the budget fixes."""
        frame = frame.sort_values("step")
        m, s, at = frame["m"].tolist(), frame["s"].tolist(), 0
        made: list[tuple[list[int], list[int]]] = []
        while at < len(m):
            main: list[int] = []
            star: list[int] = []
            while at < len(m) and len(main) < MAIN_K:
                main += [] if m[at] in main else [m[at]]
                at += 1
            while at < len(s) and len(star) < STAR_K:
                star += [] if s[at] in star else [s[at]]
                at += 1
            ticket = (sorted(main), sorted(star))
            if len(main) == MAIN_K and len(star) == STAR_K and ticket not in made:
                made.append(ticket)
        kept: list[int] = []
        for i, (main, _) in enumerate(made):
            if len(kept) < budget and all(len({*main} & {*made[j][0]}) <= shared for j in kept):
                kept.append(i)
        kept += [i for i in range(len(made)) if i not in kept][: max(0, budget - len(kept))]
        return pd.DataFrame({"game": frame["game"].iloc[0], "place": np.arange(1, len(kept) + 1, dtype="i4"), "main": [made[i][0] for i in kept], "star": [made[i][1] for i in kept]})

    return path.groupBy("game").applyInPandas(filled, "game string, place int, main array<int>, star array<int>")


def swept(history: DataFrame, budget: int, orientation: str) -> DataFrame:
    weights = stored(oriented(shared(history, "ranks", ranks), orientation), "oriented")
    return log_weight(sweep(weights, budget), weights.withColumnRenamed("w", "n"))


@builder("stationary_affinity")
def affinity(history: DataFrame, budget: int, seed: int) -> DataFrame:
    """A sweep that prefers items of high stationary rank."""
    return swept(history, budget, "affinity")


@builder("stationary_contrarian")
def contrarian(history: DataFrame, budget: int, seed: int) -> DataFrame:
    """A sweep that prefers items of low stationary rank."""
    return swept(history, budget, "contrarian")


@builder("stationary_uniform", ablation_of="stationary_affinity")
def equal(history: DataFrame, budget: int, seed: int) -> DataFrame:
    """The same sweep over equal weights."""
    return swept(history, budget, "uniform")


def _guarded(history: DataFrame, budget: int, seed: int, mode: str) -> DataFrame:
    weights = item_weights(history.select(F.lit("pool").alias("game"), *(c for c in history.columns if c != "game")).limit(1)).withColumn("n", F.when((F.col("kind") == "main") & (F.col("item") > 31), 1.6).otherwise(1.0))
    pool = stored(sampled(weights, budget, seed, GUARDED_POOL).select(F.col("try").cast("long").alias("ticket_id"), "main", "star"), "candidates")
    return portfolio.guarded_portfolio(pool, history, budget, modes=(mode,))


@builder("guarded")
def guarded(history: DataFrame, budget: int, seed: int) -> DataFrame:
    """Reach and balance first, with evidence that holds in two folds of the history."""
    return _guarded(history, budget, seed, "guarded")


@builder("guarded_ablation", ablation_of="guarded")
def guarded_ablation(history: DataFrame, budget: int, seed: int) -> DataFrame:
    """The same pool and aim without the evidence."""
    return _guarded(history, budget, seed, "ablation")


def b5_oriented_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty tickets of each game from the sweep over stationary ranks, in all three orientations."""
    history, out = draws(spark, sf_dir), None
    found = stored(ranks(history), "ranks")
    for name in ("affinity", "contrarian", "uniform"):
        weights = stored(oriented(found, name), "oriented")
        made = log_weight(sweep(weights, 20), weights.withColumnRenamed("w", "n")).withColumn("orientation", F.lit(name))
        out = made if out is None else out.unionByName(made)
    return out.select("game", "orientation", "place", levels.shown("main"), levels.shown("star"), F.round("score", 6).alias("score"))


def r1_builder_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten tickets of each game by every builder, checked, with the pairs that each builder's tickets cover."""
    history, out = draws(spark, sf_dir), None
    for name, entry in REGISTRY.items():
        made = propose(name, history, 10, 1).withColumn("provider", F.concat_ws("/", F.lit(name), "game"))
        row = made.select("game", "provider", "main", "star", "score").join(portfolio.pair_coverage(made), "provider")
        row = row.groupBy("game").agg(F.count("*").alias("tickets"), F.max("covered").alias("pairs"), F.round(F.avg("score"), 5).alias("mean_score"))
        row = row.select("game", F.lit(name).alias("builder"), F.lit(entry.ablation_of).cast("string").alias("ablation_of"), "tickets", "pairs", "mean_score")
        out = row if out is None else out.unionByName(row)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"b5_oriented_sweep": b5_oriented_sweep, "r1_builder_registry": r1_builder_registry}
