"""Forward-only benchmark of two target rules: the branch forecast and the reverse growth of a quadratic model on totients.

All cut-offs are keys of one job. For each cut-off draw a rule gives a target from earlier draws only; of all tickets of
the game those with exactly this pair sum (or, if there are none, the nearest sum) are ranked by the sum of their pairs'
z against fair draws, and the first `top` are judged by the cut-off's draw. Counts of a cut-off are one sum of the draws
before the holdout, and the holdout's own draws added to the cut-offs after them.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.plans.draws import MAIN_K, MAIN_N, draws, table
from setloom.sources.storage import stored

from . import filters
from .branches import WARM_UP, branch_frame, rounded, totient, validity_steps
from .levels import chosen, drawn
from .portfolio import STAR_K, STAR_N, components

HOLDOUT, TOP, PRICE = 8, 25, 2.5
SPEC = (MAIN_N, MAIN_K, STAR_N, STAR_K)
PARTS = [(i, j) for i in range(4) for j in range(i, 4)]
AIMS = "game string, t long, method string, target long"


def span(frame: DataFrame, holdout: int) -> DataFrame:
    """game, n, start, centre (the mean index): the draws of a game and the first of its cut-offs."""
    ends = frame.groupBy("game").agg(F.count("*").alias("n"), F.avg("poi").alias("centre"))
    return stored(ends.withColumn("start", F.col("n") - F.least(F.lit(holdout), F.greatest(F.col("n") - WARM_UP, F.lit(0))) + 1), "ends")


def reverse_growth(frame: DataFrame, ends: DataFrame) -> DataFrame:
    """AIMS of each cut-off: twice the fitted index of the last draw less the prediction for the next one, of least squares
    of the index on 1, f and f^2, where f is the totient of the draw's number. Products of all draws before the holdout are
    one sum a game; those of the holdout's draws are added one by one."""
    rows = stored(frame.select("game", "t", "poi").withColumn("f", totient("t")).join(F.broadcast(ends), "game"), "totients")  # a row per game
    f = F.col("f") / F.col("n")
    x = [F.lit(1.0), f, f * f, F.col("poi") - F.col("centre")]
    base = rows.where("t < start - 1").groupBy("game").agg(F.array(*(F.sum(x[i] * x[j]) for i, j in PARTS)).alias("base"))
    late = rows.where("t >= start - 1").groupBy("game", "n", "centre").agg(F.sort_array(F.collect_list(F.struct("t", "f", "poi"))).alias("late"))  # holdout + 1 rows

    def run(frames):
        for made in frames:
            out = []
            for g in made.itertuples():
                gram = np.zeros((4, 4))
                for (i, j), v in zip(PARTS, g.base if g.base is not None else [0.0] * len(PARTS)):
                    gram[i, j] = gram[j, i] = v
                before = None
                for r in g.late:
                    u = r["f"] / g.n
                    now = np.array([1.0, u, u * u])
                    if before is not None:
                        b = np.linalg.lstsq(gram[:3, :3], gram[:3, 3], rcond=1e-12)[0]
                        out.append((g.game, r["t"], "diagnostics", int(np.rint((2 * before - now) @ b + g.centre))))
                    y = np.append(now, r["poi"] - g.centre)
                    gram += np.outer(y, y)
                    before = now
            yield pd.DataFrame(out, columns=[c.split()[0] for c in AIMS.split(", ")])

    return late.join(base, "game", "left").mapInPandas(run, AIMS)


def branch_targets(frame: DataFrame, holdout: int, mode: str) -> DataFrame:
    """AIMS of the branch forecasts; a cut-off without models has none."""
    return validity_steps(frame, holdout).where(F.col(mode).isNotNull()).select("game", "t", F.lit(f"branch_{mode}").alias("method"), F.col(mode).cast("long").alias("target"))


def counts_at(sets: DataFrame, ends: DataFrame) -> DataFrame:
    """game, t, pairs: for each cut-off how often each pair was drawn before it."""
    pair = F.explode(F.filter(components(), lambda c: c.kind.contains("-"))).alias("c")
    cells = sets.join(F.broadcast(ends.select("game", "start", "n")), "game").select("game", "start", "n", F.greatest("start", F.col("t") + 1).alias("since"), pair)
    cells = cells.select("game", "start", "n", "since", "c.*").where("kind <> 'star-star' or a <> b")
    sums = cells.groupBy("game", "since", "n", "kind", "a", "b").agg(F.count("*").alias("many")).where("since <= n")
    each = sums.select("game", F.explode(F.sequence("since", "n")).alias("t"), "kind", "a", "b", "many").groupBy("game", "t", "kind", "a", "b").agg(F.sum("many").alias("n"))
    return each.groupBy("game", "t").agg(F.collect_list(F.struct("kind", "a", "b", "n")).alias("pairs"))  # as many as a game's pairs


def chances(spec: tuple[int, int, int, int]) -> dict[str, float]:
    main_n, main_k, star_n, star_k = spec
    return {"main-main": comb(main_k, 2) / comb(main_n, 2), "main-star": main_k * star_k / (main_n * star_n), "star-star": comb(star_k, 2) / comb(star_n, 2)}


LISTED = "game string, t long, method string, target long, main array<int>, star array<int>, gap long, z double, least double"


def shortlists(counts: DataFrame, aims: DataFrame, top: int = TOP, spec: tuple[int, int, int, int] = SPEC) -> DataFrame:
    """LISTED and place: for each of aims the first `top` of all tickets at the smallest distance to the target, by falling
    sum of pair z, then falling least pair z (both to nine digits), then main and star.

    A task scores the tickets of one cut-off with one first item, and keeps `top` for each method at its own smallest
    distance; those at the smallest of all tasks count.
    """
    main_n, main_k, star_n, star_k = spec
    p = chances(spec)
    wanted = aims.groupBy("game", "t").agg(F.sort_array(F.collect_list(F.struct("method", "target"))).alias("wanted"))  # a row per method
    first = F.explode(F.sequence(F.lit(1), F.lit(main_n - main_k + 1))).alias("first")
    tasks = stored(counts.join(wanted, ["game", "t"]).select("*", first), "shortlists").repartition(main_n, "game", "t", "first")

    def scored(frames):
        stars = chosen(star_n, star_k).astype("i8")
        for frame in frames:
            for row in frame.itertuples():
                shapes = {"main-main": (main_n, main_n), "main-star": (main_n, star_n), "star-star": (star_n, star_n)}
                n = {k: np.zeros(v, "i8") for k, v in shapes.items()}
                for x in row.pairs:
                    n[x["kind"]][x["a"] - 1, x["b"] - 1] = x["n"]
                    if x["kind"] != "main-star":
                        n[x["kind"]][x["b"] - 1, x["a"] - 1] = x["n"]
                many = row.t - 1
                z = {k: (v - many * p[k]) / np.sqrt(many * p[k] * (1 - p[k])) for k, v in n.items()}
                rest = chosen(main_n - row.first, main_k - 1).astype("i8") + row.first
                items = np.concatenate((np.full((len(rest), 1), row.first - 1), rest), axis=1)
                pairs = list(combinations(range(main_k), 2))
                own = sum((n["main-main"][items[:, i], items[:, j]] for i, j in pairs), np.zeros(len(items), "i8"))
                each = sum(n["main-star"][items[:, i]] for i in range(main_k)).T
                best = [np.iinfo("i8").max] * len(row.wanted)
                held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in row.wanted]
                for s, pair in enumerate(stars):
                    g = own + sum(each[x] for x in pair) + sum(n["star-star"][x, y] for x, y in combinations(pair, 2))
                    for k, aim in enumerate(row.wanted):
                        off = np.abs(g - aim["target"])
                        low = int(off.min())
                        if low < best[k]:
                            best[k], held[k] = low, []
                        if low == best[k]:
                            at = np.flatnonzero(off == low)
                            held[k].append((at, np.full(len(at), s)))
                for k, aim in enumerate(row.wanted):
                    at, s = (np.concatenate(c) for c in zip(*held[k]))
                    total, least = np.zeros(len(at)), np.full(len(at), np.inf)
                    values = [z["main-main"][items[at, i], items[at, j]] for i, j in pairs]
                    values += [z["main-star"][items[at, i], stars[s, j]] for i in range(main_k) for j in range(star_k)]
                    values += [z["star-star"][stars[s, i], stars[s, j]] for i, j in combinations(range(star_k), 2)]
                    for v in values:
                        total, least = total + v, np.minimum(least, v)
                    total, least = np.round(total, 9), np.round(least, 9)
                    order = np.lexsort((s, at, -least, -total))[:top]
                    at, s = at[order], s[order]
                    yield pd.DataFrame({"game": row.game, "t": row.t, "method": aim["method"], "target": aim["target"], "main": (items[at] + 1).tolist(), "star": (stars[s] + 1).tolist(), "gap": best[k], "z": total[order], "least": least[order]})

    key = Window.partitionBy("game", "t", "method")
    near = stored(tasks.mapInPandas(scored, LISTED), "listed").withColumn("nearest", F.min("gap").over(key)).where("gap = nearest").drop("nearest")
    return near.withColumn("place", F.row_number().over(key.orderBy(F.desc("z"), F.desc("least"), "main", "star"))).where(F.col("place") <= top)


def judged(listed: DataFrame, sets: DataFrame, prizes: DataFrame | None = None, price: float = PRICE) -> DataFrame:
    """For each cut-off and method its best ticket by (items, stars, smaller place) over equally long lists, and what the
    list cost and won by prizes(balls, stars, prize)."""
    sizes = listed.groupBy("game", "t", "method").agg(F.count("*").alias("size")).groupBy("game", "t").agg(F.min("size").alias("size"), F.count("*").alias("methods"))
    both = listed.join(sizes, ["game", "t"]).where("methods > 1 and place <= size")
    now = sets.select("game", "t", F.col("main").alias("drawn"), F.col("star").alias("drawn_star"))
    balls, stars = F.size(F.array_intersect("main", "drawn")), F.size(F.array_intersect("star", "drawn_star"))
    hits = both.join(now, ["game", "t"]).withColumn("balls", balls).withColumn("stars", stars)
    hits = hits.join(F.broadcast(prizes), ["balls", "stars"], "left") if prizes is not None else hits.withColumn("prize", F.lit(0.0))  # 18 tiers
    best = F.max(F.struct("balls", "stars", -F.col("place"))).alias("best")
    made = hits.groupBy("game", "t", "method", "target", "gap", "size").agg(best, F.sum(F.coalesce("prize", F.lit(0.0))).alias("won"), F.count_if(F.col("prize") > 0).alias("winning"), F.max(F.struct("balls", "stars", F.coalesce("prize", F.lit(0.0)))).alias("top"))
    place = (-F.col("best").getField("col3")).alias("best_place")
    return made.select("game", "t", "method", "target", "gap", "size", F.col("best.balls").alias("balls"), F.col("best.stars").alias("stars"), place, (F.col("size") * price).alias("spent"), "won", "winning", F.col("top.col3").alias("best_prize"))


def method_table(steps: DataFrame) -> DataFrame:
    """Rates of each method over all its steps; the one with the highest recall, then accuracy, then first name, is best."""
    rate = lambda c: F.avg(c.cast("int"))
    b, s = F.col("balls"), F.col("stars")
    made = steps.groupBy("method").agg(
        F.count("*").alias("steps"), F.sum("size").alias("tickets"), F.avg(b).alias("mean_balls"), F.avg(b / 5.0).alias("recall_at_5"), F.avg(s).alias("mean_stars"), F.avg(s / 2.0).alias("recall_at_2"),
        rate(b >= 1).alias("any_ball"), rate(b >= 2).alias("two_balls"), rate(b >= 3).alias("three_balls"), rate(s >= 1).alias("any_star"), rate(b == 5).alias("exact_main"), rate((b == 5) & (s == 2)).alias("exact"),
        F.avg("best_place").alias("mean_place"), F.sum("spent").alias("spent"), F.sum("won").alias("won"), (F.sum("won") / F.sum("spent") - 1).alias("roi"), F.stddev_samp(F.col("won") / F.col("spent") - 1).alias("roi_sd"),
    )
    order = Window.orderBy(F.desc("recall_at_5"), F.desc("exact"), "method")  # a row per method
    return made.withColumn("best", F.row_number().over(order) == 1)


def benchmark(history: DataFrame, holdout: int = HOLDOUT, top: int = TOP, mode: str = "pruned", prizes: DataFrame | None = None) -> DataFrame:
    """`judged` of both rules at each game's last `holdout` draws."""
    frame = branch_frame(history)
    ends = span(frame, holdout)
    aims = stored(branch_targets(frame, holdout, mode).unionByName(reverse_growth(frame, ends)), "aims")
    sets = drawn(history)
    return stored(judged(shortlists(stored(counts_at(sets, ends), "counts"), aims, top), sets, prizes), "judged")


def variance_series(frame: DataFrame, ends: DataFrame, held: int = WARM_UP) -> tuple[DataFrame, DataFrame]:
    """The draws before each cut-off as a series of its own, of least squares of the index on t and Friday: key
    `game` (game and cut-off), t, eps, before, season, variance; and the model's value `ahead` at each cut-off.
    A cut-off without `held` earlier draws has none. Each draw is there once for each cut-off of the holdout."""
    x = [F.lit(1.0), F.col("t") / F.col("n"), (F.dayofweek("draw_date") == 6).cast("double"), F.col("poi") - F.col("centre")]
    rows = frame.join(F.broadcast(ends), "game").select("game", "t", "n", "start", "poi", "centre", "draw_date")  # a row per game
    cut = F.explode(F.sequence(F.greatest("start", F.col("t") + 1), F.col("n"))).alias("cut")
    past = stored(rows.where("t < n").select("*", cut).select("game", "cut", "t", "poi", "centre", *(c.alias(f"x{i}") for i, c in enumerate(x)), F.dayofyear("draw_date").alias("day")), "past")
    sums = past.groupBy("game", "cut").agg(F.array(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in PARTS)).alias("sums"))

    def run(frames):
        for made in frames:
            out = []
            for r in made.itertuples():
                gram = np.zeros((4, 4))
                for (i, j), v in zip(PARTS, r.sums):
                    gram[i, j] = gram[j, i] = v
                if gram[0, 0] >= held:
                    b = np.linalg.lstsq(gram[:3, :3], gram[:3, 3], rcond=1e-12)[0]
                    out.append((r.game, r.cut, b.tolist(), max(float(np.append(-b, 1) @ gram @ np.append(-b, 1)) / gram[0, 0], 1e-12)))
            yield pd.DataFrame(out, columns=["game", "cut", "b", "variance"])

    fitted = stored(sums.mapInPandas(run, "game string, cut long, b array<double>, variance double"), "means")  # a row per cut-off
    mean = lambda c: sum(F.col("b")[i] * c[i] for i in range(3))
    key = F.concat_ws("|", "game", "cut").alias("game")
    eps = past.join(F.broadcast(fitted), ["game", "cut"]).select(key, "t", (F.col("x3") - mean([F.col(f"x{i}") for i in range(3)])).alias("eps"), F.sin(F.col("day") * (2 * np.pi / 365.25)).alias("season"), "variance")
    eps = stored(eps, "residuals")
    before = eps.select("game", (F.col("t") + 1).alias("t"), F.col("eps").alias("before"))
    series = eps.join(before, ["game", "t"], "left").fillna(0.0, ["before"])
    ahead = rows.withColumn("cut", F.col("t")).join(F.broadcast(fitted), ["game", "cut"])
    return series, ahead.select("game", "cut", key.alias("key"), (mean(x[:3]) + F.col("centre")).alias("ahead"))


def variance_targets(frame: DataFrame, ends: DataFrame, params: pd.DataFrame | None = None) -> DataFrame:
    """AIMS of each cut-off: the mean model's value plus the deviation of the variance filter with the smallest AIC times
    the mean of its standardised residuals, rounded, at least 1. `frame` has game, t, poi and draw_date."""
    params = filters.grid() if params is None else params
    series, ahead = variance_series(frame, ends)
    series = stored(series, "variance-series")
    best = stored(filters.variance_fit(series, params).groupBy("game").agg(F.min_by(F.struct("id", "next_variance"), F.struct("aic", "id")).alias("x")).select("game", "x.*"), "variance-best")
    shift = filters.variance_path(series, params).where("t > 1").join(F.broadcast(best), ["game", "id"]).groupBy("game", "next_variance").agg(F.avg("z").alias("location"))  # a row per cut-off
    value = F.col("ahead") + F.sqrt("next_variance") * F.coalesce("location", F.lit(0.0))
    return ahead.join(shift.withColumnRenamed("game", "key"), "key").select("game", F.col("cut").alias("t"), F.lit("variance").alias("method"), F.greatest(F.lit(1), F.rint(value).cast("long")).alias("target"))


def return_table(steps: DataFrame, index: DataFrame) -> DataFrame:
    """Cost, prizes and errors of each method over its steps, the best return first; ties go to the first name.
    `index` has game, t and poi, the index that a target is held against."""
    met = steps.join(index.select("game", "t", "poi"), ["game", "t"])
    profit = F.col("won") - F.col("spent")
    made = met.groupBy("method").agg(
        F.count("*").alias("steps"), F.sum("spent").alias("spent"), F.sum("won").alias("won"), F.sum(profit).alias("profit"), (F.sum(profit) / F.sum("spent")).alias("roi"), F.avg("won").alias("mean_won"), F.avg(profit).alias("mean_profit"),
        F.avg("balls").alias("mean_balls"), F.avg("stars").alias("mean_stars"), F.avg("best_prize").alias("mean_best_prize"), F.avg("winning").alias("mean_winning"), F.avg((F.col("won") > 0).cast("int")).alias("any_prize"), F.avg((profit >= 0).cast("int")).alias("break_even"),
        F.avg((F.col("balls") == 5).cast("int")).alias("exact_main"), F.avg(((F.col("balls") == 5) & (F.col("stars") == 2)).cast("int")).alias("exact"), F.avg("gap").alias("mean_gap"), F.avg(F.abs(F.col("target") - F.col("poi"))).alias("mean_error"), F.avg("size").alias("mean_size"),
    )
    return made.withColumn("place", F.row_number().over(Window.orderBy(F.desc("roi"), "method")))  # a row per method


def return_benchmark(history: DataFrame, prizes: DataFrame, holdout: int = HOLDOUT, top: int = TOP, mode: str = "pruned") -> DataFrame:
    """`return_table` of the variance filter's, the branches' and the reverse growth's targets at each game's last draws."""
    frame = branch_frame(history)
    ends = span(frame, holdout)
    dated = frame.select("game", "t", "poi").join(history.select("game", "t", "draw_date"), ["game", "t"])
    aims = stored(variance_targets(dated, ends).unionByName(branch_targets(frame, holdout, mode)).unionByName(reverse_growth(frame, ends)), "aims")
    sets = drawn(history)
    listed = shortlists(stored(counts_at(sets, ends), "counts"), aims, top)
    return return_table(stored(judged(listed, sets, prizes), "judged"), frame)


def prize_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """balls, stars, prize: the largest price of the parts of a tier."""
    return table(spark, sf_dir, "part").groupBy((F.col("p_size") % 6).cast("int").alias("balls"), (F.col("p_partkey") % 3).cast("int").alias("stars")).agg(F.max("p_retailprice").cast("double").alias("prize"))


def e4_branch_against_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rules' 25 tickets at the last four draws of each game: targets, best tickets, cost and prizes."""
    return rounded(benchmark(draws(spark, sf_dir), 4, prizes=prize_tiers(spark, sf_dir)))


def e5_return_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return of the three target rules' 25 tickets over the last four draws of each game."""
    return rounded(return_benchmark(draws(spark, sf_dir), prize_tiers(spark, sf_dir), 4))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (e4_branch_against_diagnostics, e5_return_benchmark)}
