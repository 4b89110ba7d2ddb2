"""Measures of a history and of tickets: fairness, ranking metrics, residual diagnostics, coverage, frequencies in
windows, ticket numbers and the scored universe. No window or group is as long as a game or a class.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions.tails import chi_square_tail
from setloom.plans.dialect import Duck, Spark
from setloom.plans.draws import MAIN_K, MAIN_N, draws, table
from setloom.plans.views import COUNTS, DRAWS, LONG, PAIRS, domain, tickets, with_
from setloom.sources.jobs import ticket_sets
from setloom.sources.storage import stored

from .forward import causal_lists
from .levels import chosen, drawn, pair_table
from .portfolio import STAR_K, STAR_N

WINDOWS = (50, 200, 500)
LAGS = (4, 8, 16)
#: Draws of a block, to which the draws before it that its longest lag reaches are added.
BLOCK = 1 << 12


def fairness(history: DataFrame) -> DataFrame:
    """game, test, chi2, dof, p of the items, their last digits and the number of odd items in a draw.

    A cell that a fair game never fills is no cell; a cell without draws counts with 0. One aggregation of the draws.
    """
    spark = history.sparkSession
    main = F.array(*(f"b{i}" for i in range(1, MAIN_K + 1)))
    odd, total = (MAIN_N + 1) // 2, math.comb(MAIN_N, MAIN_K)
    chance = [("items", v, MAIN_K / MAIN_N) for v in range(1, MAIN_N + 1)]
    chance += [("last_digit", v, MAIN_K * len(range(v or 10, MAIN_N + 1, 10)) / MAIN_N) for v in range(10)]
    chance += [("parity", v, math.comb(odd, v) * math.comb(MAIN_N - odd, MAIN_K - v) / total) for v in range(MAIN_K + 1)]
    cell = lambda name, x: F.struct(F.lit(name).alias("test"), x.cast("int").alias("cell"))
    odds = F.size(F.filter(main, lambda b: b % 2 == 1))
    cells = F.concat(F.transform(main, lambda b: cell("items", b)), F.transform(main, lambda b: cell("last_digit", b % 10)), F.array(cell("parity", odds)))
    seen = history.select("game", F.explode(cells).alias("c")).groupBy("game", "c.test", "c.cell").count()
    games = history.groupBy("game").agg(F.count("*").alias("draws"))
    fair = spark.createDataFrame([c for c in chance if c[2] > 0], "test string, cell int, share double")
    met = games.crossJoin(F.broadcast(fair)).join(seen, ["game", "test", "cell"], "left")  # 66 cells for each game
    expected = F.col("draws") * F.col("share")
    gap = F.coalesce("count", F.lit(0)) - expected
    made = met.groupBy("game", "test").agg(F.sum(gap * gap / expected).alias("chi2"), (F.count("*") - 1).alias("dof"))
    return made.select("game", "test", "chi2", "dof", chi_square_tail("chi2", "dof").alias("p"))


def ranking_metrics(rows: DataFrame) -> DataFrame:
    """g, n, positives, log_loss, auc, average_precision of rows(g, p, y): a chance p of class 1 and the class y.

    Rows of equal p are one cell. Cells are dealt into ranges from the largest p down, each range adds up its own, and
    the sums of a class's earlier ranges are added, so that no class is one task. Rows with a null are left out; auc is
    null where a class is missing, average_precision without positives.
    """
    spark = rows.sparkSession
    known = rows.where("g is not null and p is not null and not isnan(p) and y in (0, 1)")
    cells = known.groupBy("g", (-F.col("p")).alias("k")).agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(cells.repartitionByRange(parts, "g", "k").withColumn("part", F.spark_partition_id()), "cells")
    sums = dealt.groupBy("g", "part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("pos", "neg")]
    whole = [F.sum(c).over(Window.partitionBy("g")).alias(f"{c}_all") for c in ("pos", "neg")]
    base = sums.select("g", "part", *before, *whole)  # a row per range, and one more for each class that begins within one
    within = Window.partitionBy("g", "part").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.withColumns({"tp": F.sum("pos").over(within), "fp": F.sum("neg").over(within)}).join(base, ["g", "part"])
    tp, fp = F.col("tp") + F.col("pos_before"), F.col("fp") + F.col("neg_before")
    p = F.greatest(F.lit(1e-15), F.least(-F.col("k"), F.lit(1 - 1e-15)))
    beaten = F.col("pos") * (F.col("neg_all") - fp + F.col("neg") / 2)
    n = F.sum(F.col("pos") + F.col("neg"))
    made = met.groupBy("g").agg(
        n.alias("n"), F.sum("pos").alias("positives"), (F.sum(-F.col("pos") * F.log(p) - F.col("neg") * F.log(1 - p)) / n).alias("log_loss"),
        F.sum(beaten).alias("beaten"), F.sum(F.col("pos") * tp / (tp + fp)).alias("precise"), F.sum("neg").alias("negatives"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    pos = F.col("positives")
    return made.select("g", "n", "positives", "log_loss", ratio(F.col("beaten"), pos * F.col("negatives")).alias("auc"), ratio(F.col("precise"), pos).alias("average_precision"))


def residual_diagnostics(series: DataFrame, lags: tuple[int, ...] = LAGS, size: int = BLOCK) -> DataFrame:
    """game, n, jarque_bera, jb_p, and q, p of Ljung and Box for each of `lags` (even) of z and of its square.

    z is the standardised x of series(game, t, x), t from 1 on without holes. A block of `size` steps gets the steps
    before it that the longest lag reaches. A constant series has nulls.
    """
    deep = max(lags)
    if any(m % 2 for m in lags) or deep >= size:
        raise ValueError("lags must be even and shorter than a block")
    stats = series.groupBy("game").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"), F.count("x").alias("n"))
    z = series.join(stats, "game").select("game", "t", "n", F.when(F.col("sd") > 0, (F.col("x") - F.col("mu")) / F.col("sd")).alias("z"))
    own = F.floor(F.col("t") / size)
    owners = F.when(F.col("t") % size >= size - deep, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = z.withColumn("own", own).withColumn("block", F.explode(owners))
    order = Window.partitionBy("game", "block").orderBy("t")
    late = dealt.select("game", "block", "own", "n", "z", *(F.lag("z", k).over(order).alias(f"z{k}") for k in range(1, deep + 1))).where("own = block")
    square = lambda c: F.col(c) * F.col(c) - 1  # noqa: E731 (the mean of z squared is 1)
    products = [F.sum(F.col("z") * F.col(f"z{k}")).alias(f"a{k}") for k in range(1, deep + 1)]
    products += [F.sum(square("z") * square(f"z{k}")).alias(f"b{k}") for k in range(1, deep + 1)]
    sums = late.groupBy("game").agg(F.max("n").alias("n"), F.sum(F.pow("z", F.lit(2))).alias("a0"), F.sum(F.pow(square("z"), F.lit(2))).alias("b0"), F.avg(F.pow("z", F.lit(3))).alias("skew"), F.avg(F.pow("z", F.lit(4))).alias("kurtosis"), *products)
    n = F.col("n")

    def q(kind: str, m: int) -> Column:
        terms = (F.coalesce(F.pow(F.col(f"{kind}{k}") / F.col(f"{kind}0"), F.lit(2)) / (n - k), F.lit(0.0)) for k in range(1, m + 1))
        return F.when((F.col(f"{kind}0") > 0) & (n > m), n * (n + 2) * sum(terms, F.lit(0.0)))

    tests = {f"{name}_{m}": q(kind, m) for kind, name in (("a", "q"), ("b", "q_square")) for m in lags}
    bera = (n / 6 * (F.pow("skew", F.lit(2)) + F.pow(F.col("kurtosis") - 3, F.lit(2)) / 4)).alias("jarque_bera")
    made = sums.select("game", "n", bera, *(v.alias(c) for c, v in tests.items()))

    def tail(x: str, m: int) -> Column:
        half = F.col(x) / 2
        return F.exp(-half) * sum((F.pow(half, F.lit(i)) / math.factorial(i) for i in range(m // 2)), F.lit(0.0))

    return made.select("*", tail("jarque_bera", 2).alias("jb_p"), *(tail(c, int(c.rsplit("_", 1)[1])).alias("p" + c[1:]) for c in tests))


def coverage(rows: DataFrame) -> DataFrame:
    """book, tickets, n_distinct, number_coverage, pair_coverage, entropy, jaccard_gap of rows(book, main).

    jaccard_gap is one less the mean Jaccard similarity of all pairs of tickets of a book. Pairs of tickets are never
    formed: the tickets that hold a set of j items give the number of pairs that share it, these sums over all sets of
    j items are the binomial moments of the overlap, and the moments give how many pairs share 0 to k items. Each
    ticket has 2**k - 1 sets. Null for a single ticket. A book's repeated tickets count each.
    """
    bits = [[i for i in range(MAIN_K) if m >> i & 1] for m in range(1, 1 << MAIN_K)]
    part = lambda at: F.struct(F.lit(len(at)).alias("j"), sum((F.col("main")[i].cast("long") * 64**n for n, i in enumerate(at)), F.lit(0).cast("long")).alias("s"))
    sorted_rows = rows.select("book", F.array_sort("main").alias("main"))
    sets = sorted_rows.select("book", F.explode(F.array(*map(part, bits))).alias("x")).groupBy("book", "x.j", "x.s").agg(F.count("*").alias("c"))
    shared = F.col("c") * (F.col("c") - 1) / 2
    at = lambda j, x: F.sum(F.when(F.col("j") == j, x).otherwise(0))
    moments = sets.groupBy("book").agg(
        *(at(j, shared).alias(f"m{j}") for j in range(1, MAIN_K + 1)), (at(1, F.col("c")) / MAIN_K).alias("tickets"),
        at(1, F.lit(1)).alias("items"), at(2, F.lit(1)).alias("pairs"), at(MAIN_K, F.lit(1)).alias("n_distinct"), at(1, F.col("c") * F.log("c")).alias("c_log_c"))
    n = F.col("tickets")
    all_pairs = n * (n - 1) / 2
    exactly = lambda o: sum(((-1) ** (j - o) * math.comb(j, o) * F.col(f"m{j}") for j in range(o, MAIN_K + 1)), F.lit(0.0))
    mean = sum((exactly(o) * (o / (2 * MAIN_K - o)) for o in range(1, MAIN_K + 1)), F.lit(0.0)) / all_pairs
    drawn_items = n * MAIN_K
    entropy = (F.log(drawn_items) - F.col("c_log_c") / drawn_items) / math.log(MAIN_N)
    return moments.select("book", n.cast("long").alias("tickets"), F.col("n_distinct").cast("long").alias("n_distinct"), (F.col("items") / MAIN_N).alias("number_coverage"), (F.col("pairs") / math.comb(MAIN_N, 2)).alias("pair_coverage"), entropy.alias("entropy"), F.when(n > 1, 1 - mean).alias("jaccard_gap"))


def frequency_windows(history: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """game, t, item, z_all and a z for each window: how often an item came in all and in the last draws before t,
    against the other items at t; 0 where all are equal.

    The counts of a draw are one array. A draw hands it on to the draws whose windows end there, so all windows cost one
    shuffle of arrays, and none of them is a frame of rows.
    """
    counts = stored(causal_lists(history).select("game", "t", "seen"), "seen")  # an array of 50 for each draw
    moved = counts.select("game", F.explode(F.array(*(F.struct((F.col("t") + w).alias("t"), F.lit(w).alias("w")) for w in (0, *windows)))).alias("m"), "seen").select("game", "m.t", "m.w", "seen")
    at = {w: F.max(F.when(F.col("w") == w, F.col("seen"))).alias(f"s{w}") for w in (0, *windows)}
    met = moved.groupBy("game", "t").agg(*at.values()).where("s0 is not null")
    names = {0: "z_all"} | {w: f"z{w}" for w in windows}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, out = batch.column("s0").flatten().to_numpy().reshape(-1, MAIN_N), []
            for w in names:
                earlier = np.zeros_like(whole)
                if w:
                    earlier[batch.column(f"s{w}").is_valid().to_numpy(zero_copy_only=False)] = batch.column(f"s{w}").flatten().to_numpy().reshape(-1, MAIN_N)
                seen = whole - earlier
                total = seen.sum(1, keepdims=True)
                spread = MAIN_N * (seen * seen).sum(1, keepdims=True) - total * total  # 64-bit integers: exact, and 0 if all are equal
                z = np.zeros(seen.shape)
                np.divide(MAIN_N * seen - total, np.sqrt(spread), out=z, where=spread > 0)
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, MAIN_N), pa.int32()), pa.array(z.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column("game"), batch.column("t"), *out], ["game", "t", *names.values()])

    scaled = met.mapInArrow(run, "game string, t long, " + ", ".join(f"{c} array<double>" for c in names.values()))
    each = scaled.select("game", "t", F.posexplode(F.arrays_zip(*names.values())).alias("at", "x"))
    return each.select("game", "t", (F.col("at") + 1).alias("item"), *(F.col("x")[c].alias(c) for c in names.values()))


def ticket_place(items: list[Column], n: int = MAIN_N) -> Column:
    """The number, from 0, of an ascending ticket among all tickets in lexicographic order."""
    k = len(items)
    after = lambda i, v: F.element_at(F.array(*(F.lit(math.comb(x, k - i)).cast("long") for x in range(n))), (n - v + 1).cast("int"))
    return F.lit(math.comb(n, k) - 1) - sum((after(i, v) for i, v in enumerate(items)), F.lit(0).cast("long"))


def unranked(rows: DataFrame, place: str, n: int = MAIN_N, k: int = MAIN_K) -> DataFrame:
    """rows with u1 to uk, the ticket with that number; nulls where the number is null or there is no such ticket.

    The complement of a number is a sum of one binomial coefficient per item, each the largest that fits."""
    total = math.comb(n, k)
    made = rows.withColumn("_left", F.when(F.col(place).between(0, total - 1), total - 1 - F.col(place).cast("long")))
    for i in range(1, k + 1):
        sizes = F.array(*(F.lit(math.comb(x, k - i + 1)).cast("long") for x in range(n)))
        fits = F.size(F.filter(sizes, lambda c: c <= F.col("_left")))
        made = made.withColumn("_x", F.when(F.col("_left").isNotNull(), fits)).withColumn(f"u{i}", n + 1 - F.col("_x")).withColumn("_left", F.col("_left") - F.element_at(sizes, F.col("_x")))
    return made.drop("_left", "_x")


UNIVERSE = "game string, first int, s1 int, s2 int, tickets long, total long, best long"


def universe(counts: DataFrame, spec: tuple[int, int, int, int] = (MAIN_N, MAIN_K, STAR_N, STAR_K)) -> DataFrame:
    """UNIVERSE: all tickets of each game, enumerated by game and first item, with the sum and maximum of their pair
    scores for each pair of stars (0, 0 without stars)."""
    main_n, main_k, star_n, star_k = spec
    pairs = counts.groupBy("game").agg(F.collect_list(F.struct("kind", "a", "b", "n")).alias("pairs"))  # as many as a game has pairs
    tasks = stored(pairs.select("game", "pairs", F.explode(F.sequence(F.lit(1), F.lit(main_n - main_k + 1))).alias("first")), "universe")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                held = {"main-main": np.zeros((main_n, main_n), "i8"), "main-star": np.zeros((main_n, star_n), "i8"), "star-star": np.zeros((star_n, star_n), "i8")}
                for p in row.pairs:
                    held[p["kind"]][p["a"] - 1, p["b"] - 1] = p["n"]
                rest = chosen(main_n - row.first, main_k - 1) + row.first
                items = np.concatenate((np.full((len(rest), 1), row.first - 1), rest), axis=1)
                own = sum(held["main-main"][items[:, i], items[:, j]] for i, j in combinations(range(main_k), 2))
                out = []
                if star_k:
                    stars = held["main-star"][items].sum(1)  # a ticket's pairs with each star
                    for s, u in combinations(range(star_n), 2):
                        g = own + stars[:, s] + stars[:, u] + held["star-star"][s, u]
                        out.append((row.game, row.first, s + 1, u + 1, len(g), int(g.sum()), int(g.max())))
                else:
                    out.append((row.game, row.first, 0, 0, len(own), int(own.sum()), int(own.max())))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in UNIVERSE.split(", ")])

    if star_k not in (0, 2):
        raise ValueError("two stars or none")
    return tasks.repartition(main_n, "game", "first").mapInPandas(run, UNIVERSE)


def a6_fairness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square tests of the items, last digits and parity of each game's draws."""
    return fairness(draws(spark, sf_dir)).select("game", "test", F.round("chi2", 5).alias("chi2"), "dof", F.round("p", 6).alias("p"))


def a7_coverage_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, entropy and mean overlap of 97 books of tickets."""
    made = coverage(ticket_sets(spark, sf_dir).select((F.col("ticket_id") % 97).alias("book"), "main"))
    return made.select("book", "tickets", "n_distinct", *(F.round(c, 8).alias(c) for c in ("number_coverage", "pair_coverage", "entropy", "jaccard_gap")))


def a22_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-loss, area under the curve and average precision of a balance's chance of one segment, by region."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("g"))
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    made = ranking_metrics(rows.select("g", (1 / (1 + F.exp(-F.col("c_acctbal") / 5000))).alias("p"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y")))
    return made.select("g", "n", "positives", *(F.round(c, 8).alias(c) for c in ("log_loss", "auc", "average_precision")))


def a28_ljung_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ljung-Box and Jarque-Bera tests of the sums of each game's draws."""
    x = sum((F.col(f"b{i}") for i in range(2, MAIN_K + 1)), F.col("b1")).cast("double").alias("x")
    made = residual_diagnostics(draws(spark, sf_dir).select("game", "t", x))
    return made.select("game", "n", *(F.round(c, 5).alias(c) for c in made.columns[2:]))


def w9_frequency_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's frequency before each draw, in all draws and the last 50, 200 and 500, as a z over the items."""
    made = frequency_windows(draws(spark, sf_dir))
    return made.select("game", "t", "item", *(F.round(c, 6).alias(c) for c in made.columns[3:]))


def h3_unranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticket number for each customer by hash, its ticket, and the number of that ticket again."""
    number = F.floor(F.expr(Spark().u("concat('place', cast(c_custkey as varchar(20)))")) * math.comb(MAIN_N, MAIN_K)).cast("long")
    made = unranked(table(spark, sf_dir, "customer").select("c_custkey", number.alias("place")), "place")
    return made.withColumn("again", ticket_place([F.col(f"u{i}") for i in range(1, MAIN_K + 1)]))


def j4_scored_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 2,118,760 tickets of each game's mains by first item: how many, their pair scores' sum and maximum."""
    counts = pair_table(drawn(draws(spark, sf_dir), star_k=0))
    return universe(counts, (MAIN_N, MAIN_K, STAR_N, 0)).select("game", "first", "tickets", "total", "best")


def j5_universe_with_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 139,838,160 tickets of each game by stars: how many and their pair scores' sum."""
    made = universe(stored(pair_table(drawn(draws(spark, sf_dir))), "pairs")).groupBy("game", "s1", "s2")
    return made.agg(F.sum("tickets").alias("tickets"), F.sum("total").alias("total"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (a6_fairness, a7_coverage_full, a22_ranking_metrics, a28_ljung_box, w9_frequency_windows, h3_unranked, j4_scored_universe, j5_universe_with_stars)}

_LAGGED = [(kind, k) for kind in ("z", "u") for k in range(1, max(LAGS) + 1)]
_Q = {f"q{'_square' if kind == 'u' else ''}_{m}": f"n * (n + 2) * ({' + '.join(f'power(r_{kind}{k}, 2) / (n - {k})' for k in range(1, m + 1))})" for kind in ("z", "u") for m in LAGS}
_TAIL = lambda x, m: f"exp(-({x}) / 2) * ({' + '.join(f'power(({x}) / 2, {i}) / {math.factorial(i)}' for i in range(m // 2))})"
_SPAN = ", ".join(f"coalesce(sum(y) over (partition by game, item order by t rows between {w} preceding and 1 preceding), 0) as n{w}" for w in WINDOWS)
_NAMES = ("n_all", *(f"n{w}" for w in WINDOWS))
ORACLE_SQL: dict[str, str] = {
    name: Duck().written(text)
    for name, text in {
        # the tail by Simpson's rule on the density of the root of a chi-square, which is smooth
        "a6_fairness": with_(DRAWS, LONG, domain(Duck()), domain(Duck(), "steps", 2000)) + """, games as (select game, count(*) as n from draws group by game),
fair as (select 'items' as test, item as cell, 0.1 as share from domain union all select 'last_digit', item % 10, sum(0.1) from domain group by item % 10
  union all select 'parity', c, s / 2118760.0 from (values (0, 53130), (1, 316250), (2, 690000), (3, 690000), (4, 316250), (5, 53130)) v(c, s)),
seen as (select game, 'items' as test, item as cell, count(*) as n from long group by game, item union all select game, 'last_digit', item % 10, count(*) from long group by game, item % 10
  union all select game, 'parity', b1 % 2 + b2 % 2 + b3 % 2 + b4 % 2 + b5 % 2, count(*) from draws group by all),
stat as (select g.game, f.test, sum(power(coalesce(s.n, 0) - g.n * share, 2) / (g.n * share)) as chi2, count(*) - 1 as dof from games g cross join fair f left join seen s on s.game = g.game and s.test = f.test and s.cell = f.cell group by g.game, f.test),
points as (select game, test, chi2, dof, sqrt(chi2) * i / 2000 as x, sqrt(chi2) / 2000 as h, case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end as w from stat cross join (select 0 as i union all select item from steps) s)
select game, test, round(any_value(chi2), 5) as chi2, cast(any_value(dof) as bigint) as dof, round(1 - sum(w * h / 3 * 2 * power(x, dof - 1) * exp(-x * x / 2 - dof / 2.0 * ln(2) - lgamma(dof / 2.0))), 6) as p from points group by game, test""",
        "a7_coverage_full": with_(tickets(Duck())) + """, rows as (select ticket_id % 97 as book, ticket_id, item from tickets), sets as (select book, ticket_id, list(item order by item) as main from rows group by all),
base as (select book, count(*) as tickets, count(distinct main) as n_distinct from sets group by book), freq as (select book, item, count(*) as c from rows group by book, item),
ent as (select book, count(*) / 50.0 as number_coverage, -sum(p * ln(p)) / ln(50) as entropy from (select book, c * 1.0 / sum(c) over (partition by book) as p from freq) x group by book),
pr as (select x.book, count(distinct x.item * 100 + y.item) / 1225.0 as pair_coverage from rows x join rows y on x.ticket_id = y.ticket_id and x.item < y.item group by x.book),
jac as (select x.book, avg(len(list_intersect(x.main, y.main)) * 1.0 / (10 - len(list_intersect(x.main, y.main)))) as jaccard from sets x join sets y on x.book = y.book and x.ticket_id < y.ticket_id group by x.book)
select b.book, tickets, n_distinct, round(number_coverage, 8) as number_coverage, round(pair_coverage, 8) as pair_coverage, round(entropy, 8) as entropy, round(1 - jaccard, 8) as jaccard_gap from base b join ent using (book) join pr using (book) left join jac using (book)""",
        "a22_ranking_metrics": """with s as (select n_regionkey as g, 1 / (1 + exp(-c_acctbal / 5000)) as p, case when c_mktsegment = 'BUILDING' then 1 else 0 end as y from customer join nation on n_nationkey = c_nationkey),
plain as (select g, count(*) as n, cast(sum(y) as bigint) as positives, avg(case when y = 1 then -ln(p) else -ln(1 - p) end) as log_loss from s group by g),
pairs as (select a.g, avg(case when a.p > b.p then 1.0 when a.p = b.p then 0.5 else 0.0 end) as auc from s a join s b on a.g = b.g and a.y = 1 and b.y = 0 group by a.g),
steps as (select g, y, avg(y) over (partition by g order by p desc range between unbounded preceding and current row) as precision from s)
select n.g, n, positives, round(log_loss, 8) as log_loss, round(auc, 8) as auc, round(ap, 8) as average_precision from plain n join pairs using (g) join (select g, avg(precision) as ap from steps where y = 1 group by g) a using (g)""",
        "a28_ljung_box": with_(DRAWS) + f""", x as (select game, t, cast(b1 + b2 + b3 + b4 + b5 as double) as x from draws), m as (select game, avg(x) as mu, stddev_pop(x) as sd, count(*) as n from x group by game),
z as (select x.game, t, n, (x - mu) / sd as z, power((x - mu) / sd, 2) - 1 as u from x join m on m.game = x.game), late as (select game, n, z, u, {', '.join(f'lag({kind}, {k}) over (partition by game order by t) as {kind}{k}' for kind, k in _LAGGED)} from z),
r as (select game, n, n / 6.0 * (power(avg(power(z, 3)), 2) + power(avg(power(z, 4)) - 3, 2) / 4) as jarque_bera, {', '.join(f'sum({kind} * {kind}{k}) / sum({kind} * {kind}) as r_{kind}{k}' for kind, k in _LAGGED)} from late group by game, n),
q as (select game, n, jarque_bera, {', '.join(f'{v} as {c}' for c, v in _Q.items())} from r)
select game, n, round(jarque_bera, 5) as jarque_bera, {', '.join(f'round({c}, 5) as {c}' for c in _Q)}, round({_TAIL('jarque_bera', 2)}, 5) as jb_p, {', '.join(f"round({_TAIL(c, int(c.rsplit('_', 1)[1]))}, 5) as p{c[1:]}" for c in _Q)} from q""",
        "w9_frequency_windows": with_(DRAWS, LONG, domain(Duck())) + f""", panel as (select x.game, x.t, m.item, case when l.item is null then 0 else 1 end as y from draws x cross join domain m left join long l on l.game = x.game and l.t = x.t and l.item = m.item),
f as (select game, t, item, coalesce(sum(y) over (partition by game, item order by t rows between unbounded preceding and 1 preceding), 0) as n_all, {_SPAN} from panel),
s as (select game, t, {', '.join(f'avg({n}) as m_{n}, stddev_pop({n}) as s_{n}' for n in _NAMES)} from f group by game, t)
select f.game, f.t, item, {', '.join(f"round(case when s_{n} > 1e-9 then ({n} - m_{n}) / s_{n} else 0 end, 6) as z{n[1:]}" for n in _NAMES)} from f join s on s.game = f.game and s.t = f.t""",
        "h3_unranked": with_(domain(Duck())) + f""", all_tickets as (select a.item as u1, b.item as u2, c.item as u3, d.item as u4, e.item as u5 from domain a join domain b on b.item > a.item join domain c on c.item > b.item join domain d on d.item > c.item join domain e on e.item > d.item),
placed as (select *, row_number() over (order by u1, u2, u3, u4, u5) - 1 as place from all_tickets), asked as (select c_custkey, cast(floor({Duck().u("concat('place', cast(c_custkey as varchar(20)))")} * 2118760) as bigint) as place from customer)
select c_custkey, a.place, u1, u2, u3, u4, u5, a.place as again from asked a join placed p on p.place = a.place""",
        "j4_scored_universe": with_(DRAWS, LONG, PAIRS, COUNTS, domain(Duck())) + """, games as (select distinct game from draws), w as materialized (select g.game, x.item as a, y.item as b, coalesce(n, 0) as n from games g join domain x on true join domain y on y.item > x.item left join counts c on c.game = g.game and c.a = x.item and c.b = y.item),
w3 as materialized (select x.game, x.a, x.b, y.b as c, x.n + y.n + z.n as n from w x join w y on y.game = x.game and y.a = x.b join w z on z.game = x.game and z.a = x.a and z.b = y.b),
w4 as materialized (select x.game, x.a, x.b, x.c, p.b as d, x.n + p.n + q.n + r.n as n from w3 x join w p on p.game = x.game and p.a = x.c join w q on q.game = x.game and q.a = x.a and q.b = p.b join w r on r.game = x.game and r.a = x.b and r.b = p.b)
select x.game, x.a as first, count(*) as tickets, cast(sum(x.n + p.n + q.n + r.n + s.n) as bigint) as total, cast(max(x.n + p.n + q.n + r.n + s.n) as bigint) as best from w4 x join w p on p.game = x.game and p.a = x.d join w q on q.game = x.game and q.a = x.a and q.b = p.b join w r on r.game = x.game and r.a = x.b and r.b = p.b join w s on s.game = x.game and s.a = x.c and s.b = p.b group by x.game, x.a""",
        # a pair of mains is in C(48, 3) tickets of each pair of stars, an item with a star in C(49, 4)
        "j5_universe_with_stars": with_(DRAWS, LONG, domain(Duck(), "stars", 12)) + """, n as (select game, count(*) as n from draws group by game), s as (select game, draw_id, least(s1, s2) as low, greatest(s1, s2) as high from draws),
single as (select game, s, count(*) as c from (select game, low as s from s union all select game, high from s) x group by game, s), met as (select game, low, high, count(*) as c from s group by game, low, high)
select n.game, a.item as s1, b.item as s2, cast(2118760 as bigint) as tickets, cast(10 * n * 17296 + 5 * (coalesce(x.c, 0) + coalesce(y.c, 0)) * 211876 + coalesce(p.c, 0) * 2118760 as bigint) as total
from n join stars a on true join stars b on b.item > a.item left join single x on x.game = n.game and x.s = a.item left join single y on y.game = n.game and y.s = b.item left join met p on p.game = n.game and p.low = a.item and p.high = b.item""",
    }.items()
}
