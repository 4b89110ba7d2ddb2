"""Totient branches of the pair-occurrence index: frames, a linear model per branch, forecasts, and their validity.

The index of a draw counts how often its pairs (items and stars pooled) were drawn so far, this draw too. Its totient
ratio puts a draw on the upper or the lower branch; in mode `pruned` draws with a prime index leave the branches. Each
branch has a least-squares model of the index on the previous index, ratio and coprimality.

Models of all cut-offs come from running cross products: those of the draws before the first cut-off are one sum per
game, mode and branch, and the rows of the holdout, whose number is a parameter, are added one by one. Index and previous
index are taken less the game's mean, which changes no model and keeps the products small. A branch without MIN_ROWS rows
has no model, and its mode no forecast. Of coefficients that the rows leave open the smallest are taken.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from setloom.plans.dialect import Spark
from setloom.plans.draws import draws
from setloom.plans.views import DRAWS, with_
from setloom.sources.storage import stored

from . import ranks
from .levels import drawn
from .portfolio import components

#: Draws of a block in which earlier draws are counted by a window.
BLOCK = 256
THRESHOLD, HOLDOUT, WARM_UP, MIN_ROWS = 0.5, 100, 25, 20
MODES = ("classic", "pruned")
TERMS = ("intercept", "previous", "ratio", "coprime")
#: The products of constant, previous index, ratio, coprimality and target that a model needs.
PRODUCTS = [(i, j) for i in range(5) for j in range(i, 5)]


def inclusive_index(sets: DataFrame, size: int = BLOCK) -> DataFrame:
    """game, t, poi of sets(game, t, main, star): the sum of what `ranks` gives for a draw's pairs."""
    pairs = F.filter(components(), lambda c: c.kind.contains("-") & ((c.kind != "star-star") | (c.a != c.b)))
    coded = sets.select("game", F.col("t").cast("long").alias("t"), pairs.alias("pairs")).select("game", "t", F.expr(f"transform(pairs, c -> {ranks.CODE})").alias("codes"))
    return ranks.ranked(coded, size).select("game", "t", F.aggregate("ranks", F.lit(0).cast("long"), lambda s, x: s + x).alias("poi"))


def totients(n: np.ndarray) -> np.ndarray:
    """Euler's totient of positive integers by trial division of the distinct ones."""
    values, place = np.unique(np.asarray(n, "i8"), return_inverse=True)
    left, out, p = values.copy(), values.copy(), 2
    while len(left) and p * p <= left.max():
        at = np.flatnonzero(left % p == 0)
        out[at] -= out[at] // p
        while len(at):
            left[at] //= p
            at = at[left[at] % p == 0]
        p += 1 if p == 2 else 2
    at = left > 1
    out[at] -= out[at] // left[at]
    return out[place]


@F.pandas_udf(LongType())
def totient(n: pd.Series) -> pd.Series:
    return pd.Series(totients(n.to_numpy()))


def branch_frame(history: DataFrame, threshold: float = THRESHOLD, modulus: int | None = None, size: int = BLOCK) -> DataFrame:
    """game, t, poi, base, ratio, upper, prime, and against the draw before: gcd (null at first), coprime, changed.

    The ratio is totient(base) / base, where base is the index, or with a modulus its remainder from 1 to the modulus;
    then no draw counts as prime.
    """
    index = inclusive_index(drawn(history), size)
    base = F.col("poi") if modulus is None else F.pmod(F.col("poi") - 1, F.lit(modulus)) + 1
    made = index.withColumn("base", base).withColumn("phi", totient("base"))
    prime = (F.col("base") > 1) & (F.col("phi") == F.col("base") - 1) if modulus is None else F.lit(False)
    ratio = F.col("phi") / F.col("base")
    made = stored(made.select("game", "t", "poi", "base", ratio.alias("ratio"), (ratio >= threshold).alias("upper"), prime.alias("prime")), "branches")
    back = made.select("game", (F.col("t") + 1).alias("t"), F.col("poi").alias("p"), F.col("upper").alias("was"))
    met = made.join(back, ["game", "t"], "left")
    gcd = F.when(F.col("p").isNotNull(), F.expr(Spark().gcd("poi", "p")))
    return stored(met.select(*made.columns, gcd.alias("gcd"), F.coalesce((gcd == 1).cast("int"), F.lit(0)).alias("coprime"), F.coalesce((F.col("upper") != F.col("was")).cast("int"), F.lit(0)).alias("changed")), "branches")


def training(frame: DataFrame) -> DataFrame:
    """Each draw from the third on with the values of the draw before, and whether either was prime."""
    back = frame.select("game", (F.col("t") + 1).alias("t"), F.col("poi").alias("previous"), F.col("ratio").alias("previous_ratio"), F.col("coprime").alias("previous_coprime"), F.col("upper").alias("previous_upper"), F.col("prime").alias("previous_prime"))
    return frame.where("t >= 3").select("game", "t", "poi", "upper", "prime").join(back, ["game", "t"])


def by_mode(rows: DataFrame) -> DataFrame:
    """Training rows once for each mode in which they have a branch."""
    return rows.select("*", F.explode(F.when(F.col("prime"), F.array(F.lit("classic"))).otherwise(F.array(*map(F.lit, MODES)))).alias("mode"))


def products(rows: DataFrame, *keys: str) -> DataFrame:
    """The sums of PRODUCTS of rows with the game's mean `centre`."""
    x: list[Column] = [F.lit(1.0), F.col("previous") - F.col("centre"), F.col("previous_ratio"), F.col("previous_coprime").cast("double"), F.col("poi") - F.col("centre")]
    return rows.groupBy(*keys).agg(F.array(*(F.sum(x[i] * x[j]) for i, j in PRODUCTS)).alias("sums"))


def gram(sums: list[float] | None) -> np.ndarray:
    out = np.zeros((5, 5))
    for (i, j), v in zip(PRODUCTS, sums if sums is not None else [0.0] * len(PRODUCTS)):
        out[i, j] = out[j, i] = v
    return out


def solved(g: np.ndarray) -> np.ndarray | None:
    """Coefficients of TERMS from a product matrix, or None of too few rows."""
    if g[0, 0] < MIN_ROWS:
        return None
    scale = np.sqrt(np.where(np.diag(g)[:4] > 0, np.diag(g)[:4], 1.0))
    return np.linalg.lstsq(g[:4, :4] / np.outer(scale, scale), g[:4, 4] / scale, rcond=1e-11)[0] / scale


def with_ends(frame: DataFrame, holdout: int) -> DataFrame:
    """game, n, centre, start (the first cut-off) and usable (the branch of the last composite draw before it)."""
    ends = frame.groupBy("game").agg(F.count("*").alias("n"), F.avg("poi").alias("centre"))
    ends = ends.withColumn("start", F.col("n") - F.least(F.lit(holdout), F.greatest(F.col("n") - WARM_UP, F.lit(0))) + 1)
    usable = frame.join(F.broadcast(ends.select("game", "start")), "game").where("t < start and not prime").groupBy("game").agg(F.max_by("upper", "t").alias("usable"))
    return stored(ends.join(usable, "game", "left"), "ends")


STEPS = "game string, t long, actual long, classic double, pruned double, classic_upper boolean, pruned_upper boolean, recommended string"


def validity_steps(frame: DataFrame, holdout: int = HOLDOUT) -> DataFrame:
    """For each cut-off draw the forecasts of both modes (rounded, at least 1; null without models) from earlier draws only,
    the branches they come from, and the mode that fits earlier composite draws best."""
    ends = with_ends(frame, holdout)
    rows = stored(training(frame).join(F.broadcast(ends), "game"), "training")  # ends: a row per game
    base = products(by_mode(rows.where("t < start")), "game", "mode", "upper").groupBy("game").agg(F.collect_list(F.struct("mode", "upper", "sums")).alias("base"))
    late = rows.where("t >= start").groupBy("game", "centre", "usable").agg(F.sort_array(F.collect_list(F.struct("t", "poi", "upper", "prime", "previous", "previous_ratio", "previous_coprime", "previous_upper", "previous_prime"))).alias("late"))  # holdout rows a game

    def run(frames):
        for f in frames:
            for game in f.itertuples():
                grams = {(m, u): gram(None) for m in MODES for u in (False, True)}
                for b in game.base if game.base is not None else ():
                    grams[b["mode"], b["upper"]] = gram(b["sums"])
                usable, out = game.usable, []
                for r in game.late:
                    x = np.array([1.0, r["previous"] - game.centre, r["previous_ratio"], r["previous_coprime"]])
                    if not r["previous_prime"]:
                        usable = r["previous_upper"]
                    fitted = {k: solved(g) for k, g in grams.items()}
                    made = {}
                    for mode, now in zip(MODES, (r["previous_upper"], usable)):
                        after = None if now is None or pd.isna(now) else bool(now) ^ (r["previous_coprime"] == 1)
                        whole = after is not None and all(fitted[mode, u] is not None for u in (False, True))
                        made[mode] = (float(max(1.0, np.rint(x @ fitted[mode, after] + game.centre))) if whole else None, after)
                    errors = {}
                    for mode in MODES:
                        if all(fitted[mode, u] is not None for u in (False, True)):
                            errors[mode] = sum(float(b @ grams["pruned", u] @ b) for u in (False, True) for b in [np.append(-fitted[mode, u], 1.0)])
                    best = None if len(errors) < 2 else "pruned" if errors["pruned"] <= errors["classic"] * (1 + 1e-12) else "classic"
                    out.append((game.game, r["t"], r["poi"], made["classic"][0], made["pruned"][0], made["classic"][1], made["pruned"][1], best))
                    y = np.append(x, r["poi"] - game.centre)
                    for mode in MODES:
                        if mode == "classic" or not r["prime"]:
                            grams[mode, r["upper"]] += np.outer(y, y)
                made = pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")])
                yield made.astype({"classic": "float64", "pruned": "float64", "classic_upper": "object", "pruned_upper": "object"})

    made = late.join(base, "game", "left").mapInPandas(run, STEPS)
    return made.replace(float("nan"), None, ["classic", "pruned"])


def validity(steps: DataFrame) -> DataFrame:
    """Errors of each game and mode over the cut-offs where both modes have a forecast; the mode with less is recommended."""
    both = steps.where("classic is not null and pruned is not null")
    rows = both.select("game", "actual", "recommended", F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(m).alias("forecast")) for m in MODES))).alias("x")).select("game", "actual", "recommended", "x.*")
    off = F.abs(F.col("forecast") - F.col("actual"))
    made = rows.groupBy("game", "mode").agg(F.count("*").alias("holdout"), F.avg(off).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"), F.median(off).alias("median_abs_err"), F.avg((off <= 10).cast("int")).alias("within_10"), F.avg((off <= 20).cast("int")).alias("within_20"), F.count_if(F.col("recommended") == F.col("mode")).alias("fits_best"))
    first = F.row_number().over(Window.partitionBy("game").orderBy("rmse", F.desc("mode"))) == 1  # of equal errors the pruned mode
    return made.withColumn("recommended", first)


def branch_models(frame: DataFrame) -> DataFrame:
    """game, mode, upper, rows, coefficients of TERMS, rmse, mae, and the residuals' location, scale and normal AIC."""
    ends = frame.groupBy("game").agg(F.avg("poi").alias("centre"))
    rows = by_mode(training(frame).join(F.broadcast(ends), "game"))
    sums = products(rows, "game", "centre", "mode", "upper")

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                b = solved(gram(r.sums))
                if b is not None:
                    out.append((r.game, r.mode, r.upper, float(b[0] + r.centre - b[1] * r.centre), *map(float, b[1:])))
            yield pd.DataFrame(out, columns=["game", "mode", "upper", *TERMS])

    fitted = stored(sums.mapInPandas(run, "game string, mode string, upper boolean, " + ", ".join(f"{c} double" for c in TERMS)), "models")
    left = rows.join(F.broadcast(fitted.withColumnRenamed("coprime", "by_coprime").withColumnRenamed("previous", "by_previous").withColumnRenamed("ratio", "by_ratio")), ["game", "mode", "upper"])  # four models a game
    e = F.col("poi") - (F.col("intercept") + F.col("by_previous") * F.col("previous") + F.col("by_ratio") * F.col("previous_ratio") + F.col("by_coprime") * F.col("previous_coprime"))
    seen = left.groupBy("game", "mode", "upper").agg(F.count("*").alias("rows"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("location"), F.greatest(F.stddev_pop(e), F.lit(1e-6)).alias("scale"))
    aic = 4 + F.col("rows") * (math.log(2 * math.pi) + 2 * F.log("scale") + F.pow(F.col("rmse") / F.col("scale"), 2) - F.pow(F.col("location") / F.col("scale"), 2))
    return fitted.join(seen, ["game", "mode", "upper"]).withColumn("aic", aic)


def next_forecast(frame: DataFrame, models: DataFrame) -> DataFrame:
    """The next draw's branch, its forecast, score and normal intervals, for each game and mode: the branch of the last
    draw (in mode pruned of the last composite one) changes where the last draw is coprime to the one before it."""
    last = F.struct("poi", "ratio", "coprime", "upper")
    now = frame.groupBy("game").agg(F.max_by(last, "t").alias("x"), F.max_by(F.when(~F.col("prime"), F.col("upper")), F.when(~F.col("prime"), F.col("t"))).alias("usable"))
    modes = F.explode(F.array(F.struct(F.lit("classic").alias("mode"), F.col("x.upper").alias("current")), F.struct(F.lit("pruned").alias("mode"), F.col("usable").alias("current")))).alias("m")
    rows = now.select("game", "x.poi", F.col("x.ratio").alias("at_ratio"), F.col("x.coprime").alias("at_coprime"), modes).select("game", "poi", "at_ratio", "at_coprime", "m.*")
    rows = rows.withColumn("upper", F.col("current") != (F.col("at_coprime") == 1)).join(models, ["game", "mode", "upper"])
    mean = F.col("intercept") + F.col("previous") * F.col("poi") + F.col("ratio") * F.col("at_ratio") + F.col("coprime") * F.col("at_coprime") + F.col("location")
    made = rows.select("game", "mode", F.col("current").alias("current_upper"), F.col("upper").alias("next_upper"), mean.alias("forecast"), "scale")
    made = made.withColumn("score", F.greatest(F.lit(1), F.rint("forecast").cast("long")))
    for share in (80, 95):
        half = F.col("scale") * NormalDist().inv_cdf(0.5 + share / 200)
        made = made.withColumn(f"low_{share}", F.col("forecast") - half).withColumn(f"high_{share}", F.col("forecast") + half)
    return made


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in frame.dtypes))


def w7_branch_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch frame of all games: index, totient ratio, threshold and prime branches, gcd and change flags."""
    return rounded(branch_frame(draws(spark, sf_dir)), 8)


def w7_branch_frame_modular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the ratio of the index modulo 62, the number of items and stars."""
    return rounded(branch_frame(draws(spark, sf_dir), modulus=62), 8)


def w8_training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of composite draws from the third on with the previous index, ratio and coprimality."""
    return rounded(training(branch_frame(draws(spark, sf_dir))).where("not prime").select("game", "t", "poi", "upper", "previous", "previous_ratio", "previous_coprime"), 8)


def m2_branch_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A least-squares model for each game, mode and branch, with its residuals' fit."""
    return rounded(branch_models(branch_frame(draws(spark, sf_dir))))


def m7_branch_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch and forecast of each game's next draw, with 80 % and 95 % intervals."""
    frame = branch_frame(draws(spark, sf_dir))
    return rounded(next_forecast(frame, branch_models(frame)))


def e6_branch_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-step errors of both modes over each game's last 100 draws, each forecast from the draws before it."""
    return rounded(validity(validity_steps(branch_frame(draws(spark, sf_dir)))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (w7_branch_frame, w7_branch_frame_modular, w8_training_frame, m2_branch_models, m7_branch_forecast, e6_branch_validity)}

_SQL = with_(DRAWS) + """, seven as (select game, t, unnest([b1, b2, b3, b4, b5, 100 + least(s1, s2), 100 + greatest(s1, s2)]) as item from draws),
pairs as (select x.game, x.t, x.item as a, y.item as b from seven x join seven y on x.game = y.game and x.t = y.t and x.item < y.item),
seen as (select game, t, row_number() over (partition by game, a, b order by t) as k from pairs),
poi as (select game, t, cast(sum(k) as bigint) as poi from seen group by game, t),
bases as (select distinct BASE as base from poi),
phis as (select base, len(list_filter(range(1, base + 1), lambda x: gcd(x, base) = 1)) as phi from bases),
ratios as (select game, t, poi, f.base, phi * 1.0 / f.base as ratio, PRIME as prime from poi join phis f on f.base = BASE),
flags as (select *, ratio >= 0.5 as upper, lag(poi) over g as p, lag(ratio >= 0.5) over g as was from ratios window g as (partition by game order by t)),
frame as (select game, t, poi, base, round(ratio, 8) as ratio, upper, prime, gcd(poi, p) as gcd, case when gcd(poi, p) = 1 then 1 else 0 end as coprime, case when upper <> was then 1 else 0 end as changed from flags)
"""
_RAW = _SQL.replace("BASE", "poi").replace("PRIME", "f.base > 1 and phi = f.base - 1")
ORACLE_SQL: dict[str, str] = {
    "w7_branch_frame": _RAW + "select * from frame",
    "w7_branch_frame_modular": _SQL.replace("BASE", "(case when poi % 62 = 0 then 62 else poi % 62 end)").replace("PRIME", "false") + "select * from frame",
    "w8_training_frame": _RAW + "select * exclude (prime) from (select game, t, poi, upper, prime, lag(poi) over g as previous, lag(ratio) over g as previous_ratio, lag(coprime) over g as previous_coprime from frame window g as (partition by game order by t)) where t >= 3 and not prime",
}
