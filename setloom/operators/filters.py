"""Conditional-variance filter chosen over a parameter grid, and the regime filter of a two-state chain, as scans."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.plans.dialect import Spark
from setloom.plans.draws import MAIN_K, draws
from setloom.plans.views import DRAWS, with_
from setloom.sources.storage import stored

from . import scans

#: Smallest seasonal variance, so that a variance is never below it.
FLOOR = 1e-6
#: The grid: alpha; the sum of the betas, split evenly over the order's lags; the constant's share of what is left of
#: the series' variance; the seasonal coefficient of the first sine; degrees of freedom. alpha + betas stays below 0.999.
ORDERS, ALPHAS, BETAS, SCALES, SEASONS, FREEDOM = (1, 2), (0.02, 0.1), (0.6, 0.85), (0.8, 1.2), (0.0, 0.2), (5.0,)
WEEKS = 52


def grid() -> pd.DataFrame:
    """One row per parameter set: id, order, alpha, beta (of each lag), scale, gamma, nu."""
    rows = [(o, a, b / o, s, g, v) for o, a, b, s, g, v in product(ORDERS, ALPHAS, BETAS, SCALES, SEASONS, FREEDOM) if a + b < 0.999]
    return pd.DataFrame([(i, *r) for i, r in enumerate(rows)], columns=["id", "order", "alpha", "beta", "scale", "gamma", "nu"])


def constant(nu: float) -> float:
    """Logarithm of the standardised t density's constant."""
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))


def companion(params: pd.DataFrame, lags: int) -> np.ndarray:
    """For each parameter set the matrix that takes the last `lags` variances one step on."""
    out = np.zeros((len(params), lags, lags))
    out[:, 0, :] = np.where(np.arange(lags) < params["order"].to_numpy()[:, None], params["beta"].to_numpy()[:, None], 0)
    out[:, np.arange(1, lags), np.arange(lags - 1)] = 1
    return out


def drive(rows: pd.DataFrame, params: pd.DataFrame, variance: float) -> np.ndarray:
    """What a step adds besides the earlier variances: the seasonal constant and the last squared residual."""
    left = 1 - params["alpha"].to_numpy() - params["beta"].to_numpy() * params["order"].to_numpy()
    omega = np.log(params["scale"].to_numpy() * left * variance)
    return np.exp(omega + np.outer(rows["season"].to_numpy(), params["gamma"].to_numpy())) + FLOOR + np.outer(rows["before"].to_numpy() ** 2, params["alpha"].to_numpy())


def _steps(rows: pd.DataFrame, params: pd.DataFrame, variance: float, state: np.ndarray, seen: Callable[[int, np.ndarray], None] | None = None) -> np.ndarray:
    """Run a block's steps from a state (parameter sets x lags); the first draw of a game sets the variance itself."""
    step, added, first = companion(params, state.shape[1]), drive(rows, params, variance), rows["t"].to_numpy() == 1
    for i in range(len(rows)):
        if first[i]:
            state = np.zeros_like(state)
            state[:, 0] = max(variance, FLOOR)
        else:
            state = np.einsum("gij,gj->gi", step, state)
            state[:, 0] += added[i]
        if seen:
            seen(i, state[:, 0])
    return state


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, t, eps: a draw's sum of mains without the game's mean; before: the last draw's; season: a yearly sine; variance."""
    total = sum(F.col(f"b{i}") for i in range(1, MAIN_K + 1)).cast("double")
    week = F.floor(F.datediff("draw_date", F.lit("1970-01-01").cast("date")) / 7) % WEEKS + 1
    rows = draws(spark, sf_dir).select("game", "t", total.alias("x"), F.sin(2 * math.pi * week / WEEKS).alias("season"))
    levels = rows.groupBy("game").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))  # a row per game
    eps = rows.join(F.broadcast(levels), "game").select("game", "t", (F.col("x") - F.col("mean")).alias("eps"), "season", "variance")
    # the draw before by a join on t, as no window may hold a whole game
    last = eps.select("game", (F.col("t") + 1).alias("t"), F.col("eps").alias("before"))
    return eps.join(last, ["game", "t"], "left").fillna(0.0, ["before"])


def variance_starts(blocks: DataFrame, params: pd.DataFrame, fan: int = scans.FAN) -> DataFrame:
    """blocks with `map`: the state before each of them, lags by parameter set. A block's map is its length and what it
    gives from a zero state: the companion matrix to the power of the length applies to what came before."""
    lags = int(params["order"].max())
    step = companion(params, lags)
    size = len(params) * lags

    def summary(rows: pd.DataFrame, row: pd.Series) -> pd.DataFrame:
        state = _steps(rows, params, float(rows["variance"].iloc[0]), np.zeros((len(params), lags)))
        # from the first draw on nothing earlier counts: an infinite length, whose power is zero
        length = math.inf if rows["t"].iloc[0] == 1 else float(len(rows))
        return pd.DataFrame({"map": [[length, *state.ravel()]]})

    def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if math.isinf(b[0]):
            return b
        power = np.linalg.matrix_power(step, int(b[0]))
        return np.concatenate(([a[0] + b[0]], (np.einsum("gij,gj->gi", power, a[1:].reshape(-1, lags)) + b[1:].reshape(-1, lags)).ravel()))

    maps = stored(scans.each_block(blocks, summary, "map array<double>"), "variance-maps")
    return blocks.join(scans.earlier(maps, compose, np.zeros(1 + size), fan), ["game", "block"])


def variance_fit(series: DataFrame, params: pd.DataFrame, size: int = scans.BLOCK, fan: int = scans.FAN) -> DataFrame:
    """game, id, steps, aic, next_variance for every parameter set: t-likelihood of the draws after the first."""
    started = variance_starts(scans.blocked(series, size), params, fan)
    lags, constants = int(params["order"].max()), np.array([constant(v) for v in params["nu"]])
    nu = params["nu"].to_numpy()
    free = params["order"].to_numpy() + 4  # omega, alpha, the betas, gamma and nu

    def likelihood(rows: pd.DataFrame, row: pd.Series) -> pd.DataFrame:
        eps, t, total = rows["eps"].to_numpy(), rows["t"].to_numpy(), np.zeros(len(params))

        def seen(i: int, variance: np.ndarray) -> None:
            nonlocal total
            if t[i] > 1:
                total = total + constants - 0.5 * np.log(variance) - (nu + 1) / 2 * np.log1p(eps[i] ** 2 / variance / (nu - 2))

        state = _steps(rows, params, float(rows["variance"].iloc[0]), np.asarray(row["map"], float)[1:].reshape(-1, lags), seen)
        ahead = pd.DataFrame({"season": [0.0], "before": [eps[-1]]})
        after = np.einsum("gij,gj->gi", companion(params, lags), state)[:, 0] + drive(ahead, params, float(rows["variance"].iloc[0]))[0]
        return pd.DataFrame({"id": params["id"], "t": t[-1], "steps": len(rows) - int(t[0] == 1), "ll": total, "after": after})

    sums = scans.each_block(started, likelihood, "id int, t long, steps long, ll double, after double")
    out = sums.groupBy("game", "id").agg(F.sum("steps").alias("steps"), F.sum("ll").alias("ll"), F.max_by("after", "t").alias("next_variance"))
    sets = series.sparkSession.createDataFrame(params.assign(free=free), "id int, order int, alpha double, beta double, scale double, gamma double, nu double, free int")
    return out.join(F.broadcast(sets), "id").withColumn("aic", 2.0 * F.col("free") - 2.0 * F.col("ll"))


def variance_path(series: DataFrame, params: pd.DataFrame, size: int = scans.BLOCK, fan: int = scans.FAN) -> DataFrame:
    """game, t, id, variance, z of each draw under each parameter set."""
    started = variance_starts(scans.blocked(series, size), params, fan)
    lags = int(params["order"].max())

    def path(rows: pd.DataFrame, row: pd.Series) -> pd.DataFrame:
        held = np.zeros((len(rows), len(params)))
        _steps(rows, params, float(rows["variance"].iloc[0]), np.asarray(row["map"], float)[1:].reshape(-1, lags), lambda i, v: held.__setitem__(i, v))
        n = len(params)
        return pd.DataFrame({"t": np.repeat(rows["t"], n), "id": np.tile(params["id"], len(rows)), "variance": held.ravel(), "z": np.repeat(rows["eps"], n) / np.sqrt(held.ravel())})

    return scans.each_block(started, path, "t long, id int, variance double, z double").drop("block")


def m4_variance_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each game's parameter set with the smallest AIC, and the variance it gives for the next draw (season term 0)."""
    made = variance_fit(residuals(spark, sf_dir), grid())
    best = F.min_by(F.struct("order", "alpha", "beta", "scale", "gamma", "nu", "steps", "aic", "next_variance"), F.struct("aic", "id")).alias("x")
    return made.groupBy("game").agg(best).select("game", "x.order", "x.alpha", "x.beta", "x.scale", "x.gamma", "x.nu", "x.steps", F.round("x.aic", 4).alias("aic"), F.round("x.next_variance", 5).alias("next_variance"))


# Regime filter

#: Degrees of freedom of the states' t densities.
TAIL = 5.0
STATES = 2


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, t, u, v, label: a draw's sum of mains and its change, label 1 where the two sums have no common divisor."""
    total = sum(F.col(f"b{i}") for i in range(1, MAIN_K + 1)).cast("long")
    rows = draws(spark, sf_dir).select("game", "t", total.alias("x"))
    last = rows.select("game", (F.col("t") + 1).alias("t"), F.col("x").alias("y"))
    label = F.expr(f"case when {Spark().gcd('x', 'coalesce(y, x)')} = 1 then 1 else 0 end")
    return rows.join(last, ["game", "t"], "left").select("game", "t", F.col("x").cast("double").alias("u"), (F.col("x") - F.coalesce("y", "x")).cast("double").alias("v"), label.cast("int").alias("label"))


def chains(rows: DataFrame) -> DataFrame:
    """game, trans: Laplace-smoothed transitions p00, p01, p10, p11 of the labels; and each state's mean and covariance of
    (u, v): u0, v0, uu0, uv0, vv0 and the same for state 1. One row per game, from sums."""
    after = rows.select("game", (F.col("t") - 1).alias("t"), F.col("label").alias("next"))
    moves = rows.join(after, ["game", "t"])
    n = {(a, b): F.sum(((F.col("label") == a) & (F.col("next") == b)).cast("int")) + 1.0 for a in range(STATES) for b in range(STATES)}
    trans = moves.groupBy("game").agg(*((n[a, b] / (n[a, 0] + n[a, 1])).alias(f"p{a}{b}") for a in range(STATES) for b in range(STATES)))
    own = lambda c, s: F.when(F.col("label") == s, F.col(c))
    shape = []
    for s in range(STATES):
        shape += [F.avg(own("u", s)).alias(f"u{s}"), F.avg(own("v", s)).alias(f"v{s}"), F.var_pop(own("u", s)).alias(f"uu{s}"), F.covar_pop(own("u", s), own("v", s)).alias(f"uv{s}"), F.var_pop(own("v", s)).alias(f"vv{s}")]
    return rows.groupBy("game").agg(*shape).join(trans, "game", "left").fillna(0.5, [f"p{a}{b}" for a in range(STATES) for b in range(STATES)])


def emissions(rows: pd.DataFrame, ridge: float = 1e-3) -> np.ndarray:
    """Log density of (u, v) in each state (rows x states): a bivariate t with the state's mean and covariance; a state
    that has no rows, or one, is as likely as the other."""
    out = np.zeros((len(rows), STATES))
    for s in range(STATES):
        u, v = (rows[c].to_numpy() - rows[f"{c}{s}"].to_numpy() for c in ("u", "v"))
        uu, uv, vv = (rows[f"{c}{s}"].to_numpy() for c in ("uu", "uv", "vv"))
        uu, vv = uu + ridge, vv + ridge
        det = uu * vv - uv * uv
        far = (vv * u * u - 2 * uv * u * v + uu * v * v) / det
        out[:, s] = -0.5 * np.log(det) - (TAIL + 2) / 2 * np.log1p(far / TAIL)
    lost = np.isnan(out).any(axis=1)
    out[lost] = 0
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Matrices or vectors (first axis: which) divided by their largest entry."""
    return x / x.reshape(len(x), -1).max(axis=1).reshape(-1, *[1] * (x.ndim - 1))


def step_matrices(rows: pd.DataFrame) -> np.ndarray:
    """For each draw the matrix that takes weights of states one step on: transition, then density. The first draw of a
    game starts from equal weights whatever came before."""
    density = emissions(rows)
    density = np.exp(density - density.max(axis=1, keepdims=True))
    trans = rows[["p00", "p01", "p10", "p11"]].to_numpy().reshape(-1, 2, 2).copy()
    trans[rows["t"].to_numpy() == 1] = 0.5
    return trans * density[:, None, :]


def running_products(m: np.ndarray) -> np.ndarray:
    """Products m[0] ... m[i], each up to a factor, by doubling: log2(n) steps over the whole block."""
    out, gap = _scaled(m), 1
    while gap < len(out):
        out = np.concatenate((out[:gap], _scaled(out[:-gap] @ out[gap:])))
        gap *= 2
    return out


def regime_posteriors(rows: DataFrame, size: int = scans.BLOCK, fan: int = scans.FAN) -> DataFrame:
    """game, t, posterior (of state 1 given draws up to t), next (probability that the next draw is in state 1)."""
    blocks = scans.blocked(rows.join(F.broadcast(chains(rows)), "game"), size)

    def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _scaled((a.reshape(1, 2, 2) @ b.reshape(1, 2, 2)))[0].ravel()

    maps = stored(scans.each_block(blocks, lambda r, _: pd.DataFrame({"map": [running_products(step_matrices(r))[-1].ravel()]}), "map array<double>"), "regime-maps")

    def path(r: pd.DataFrame, row: pd.Series) -> pd.DataFrame:
        start = np.full(STATES, 0.5) @ np.asarray(row["map"], float).reshape(2, 2)
        weights = start @ running_products(step_matrices(r))
        weights = weights / weights.sum(axis=1, keepdims=True)
        return pd.DataFrame({"t": r["t"], "posterior": weights[:, 1], "next": weights[:, 0] * r["p01"] + weights[:, 1] * r["p11"]})

    started = blocks.join(scans.earlier(maps, compose, np.eye(2).ravel(), fan), ["game", "block"])
    return scans.each_block(started, path, "t long, posterior double, next double").drop("block")


def m5_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of the coprime regime at each draw, and the branch that the next draw is likelier to be in."""
    made = regime_posteriors(labelled(spark, sf_dir))
    return made.select("game", "t", F.round("posterior", 7).alias("posterior"), F.round("next", 7).alias("next"), F.when(F.col("next") > 0.5, "upper").otherwise("lower").alias("branch"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"m4_variance_grid": m4_variance_grid, "m5_regimes": m5_regimes}


def _recursive(*parts: str) -> str:
    return with_(*parts).replace("with ", "with recursive ", 1)


_VALUES = ", ".join(f"({r.id}, {r.order}, {r.alpha!r}::double, {r.beta!r}::double, {r.scale!r}::double, {r.gamma!r}::double, {r.nu!r}::double)" for r in grid().itertuples())
_CONSTANT = "lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * ln(pi() * (nu - 2))"
_DENSITY = "-0.5 * ln(d{s}) - 3.5 * ln(1 + (c{s} * (u - u{s}) * (u - u{s}) - 2 * b{s} * (u - u{s}) * (v - v{s}) + a{s} * (v - v{s}) * (v - v{s})) / d{s} / 5)"
ORACLE_SQL: dict[str, str] = {
    "m4_variance_grid": _recursive(DRAWS, f"""sets(id, "order", alpha, beta, scale, gamma, nu) as (values {_VALUES})""",
        f"""raw as (select game, t, (b1 + b2 + b3 + b4 + b5) * 1.0e0 as x, sin(2 * pi() * (date_diff('day', date '1970-01-01', draw_date) // 7 % {WEEKS} + 1) / {WEEKS}) as season from draws)""",
        "levels as (select game, avg(x) as mean, var_pop(x) as variance, max(t) as n from raw group by game)",
        "eps as materialized (select r.game, t, x - mean as e, season, variance, n from raw r join levels l on l.game = r.game)",
        f"""run as (select e.game, e.t, s.id, greatest(variance, {FLOOR}) as h, 0.0e0 as h2, e as before, 0.0e0 as ll from eps e cross join sets s where t = 1
  union all select game, t, id, h, h2, e, ll + {_CONSTANT} - 0.5 * ln(h) - (nu + 1) / 2 * ln(1 + e * e / h / (nu - 2)) from (
    select r.game, e.t, r.id, exp(ln(scale * (1 - alpha - beta * "order") * variance) + season * gamma) + {FLOOR} + alpha * before * before + beta * r.h + case when "order" = 2 then beta * r.h2 else 0 end as h, r.h as h2, e.e, ll, nu
    from run r join eps e on e.game = r.game and e.t = r.t + 1 join sets s on s.id = r.id) as x)""",
        """ends as (select r.game, s.*, l.n - 1 as steps, 2.0e0 * ("order" + 4) - 2 * ll as aic, scale * (1 - alpha - beta * "order") * variance + 1e-6 + alpha * before * before + beta * h + case when "order" = 2 then beta * h2 else 0 end as ahead
  from run r join levels l on l.game = r.game and l.n = r.t join sets s on s.id = r.id)""")
    + """select game, cast("order" as int) as "order", alpha, beta, scale, gamma, nu, steps, round(aic, 4) as aic, round(ahead, 5) as next_variance from ends qualify row_number() over (partition by game order by aic, id) = 1""",
    "m5_regimes": _recursive(DRAWS, "sums as (select game, t, b1 + b2 + b3 + b4 + b5 as x from draws)",
        "rows_ as materialized (select a.game, a.t, a.x * 1.0e0 as u, (a.x - coalesce(b.x, a.x)) * 1.0e0 as v, case when gcd(a.x, coalesce(b.x, a.x)) = 1 then 1 else 0 end as label from sums a left join sums b on b.game = a.game and b.t = a.t - 1)",
        "moves as (select a.game, a.label as s, b.label as n from rows_ a join rows_ b on b.game = a.game and b.t = a.t + 1)",
        "trans as (select game, " + ", ".join(f"(count(*) filter (where s = {a} and n = {b}) + 1.0e0) / (count(*) filter (where s = {a}) + 2.0e0) as p{a}{b}" for a in (0, 1) for b in (0, 1)) + " from moves group by game)",
        "shape as (select game, " + ", ".join(f"avg(u) filter (where label = {s}) as u{s}, avg(v) filter (where label = {s}) as v{s}, var_pop(u) filter (where label = {s}) + 1e-3 as a{s}, covar_pop(u, v) filter (where label = {s}) as b{s}, var_pop(v) filter (where label = {s}) + 1e-3 as c{s}" for s in (0, 1)) + " from rows_ group by game)",
        "dets as (select *, a0 * c0 - b0 * b0 as d0, a1 * c1 - b1 * b1 as d1 from shape)",
        f"seen as materialized (select r.game, t, p00, p01, p10, p11, {_DENSITY.format(s=0)} as l0, {_DENSITY.format(s=1)} as l1 from rows_ r join dets d on d.game = r.game join trans p on p.game = r.game)",
        "path as (select game, t, p01, p11, 1 / (1 + exp(l0 - l1)) as q from seen where t = 1 union all select s.game, s.t, s.p01, s.p11, 1 / (1 + ((1 - q) * s.p00 + q * s.p10) / ((1 - q) * s.p01 + q * s.p11) * exp(l0 - l1)) from path p join seen s on s.game = p.game and s.t = p.t + 1)")
    + "select game, t, round(q, 7) as posterior, round((1 - q) * p01 + q * p11, 7) as next, case when (1 - q) * p01 + q * p11 > 0.5 then 'upper' else 'lower' end as branch from path",
}
