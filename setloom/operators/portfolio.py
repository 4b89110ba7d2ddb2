"""Portfolios chosen greedily from a distributed pool: guarded evidence, guarded portfolio, equal-budget aggregation.

A gain changes with what was chosen before, so choosing is sequential; the pool is not collected for it. A scan gives the
KEPT tickets with the largest bound of their gain, and the bound of the next one. Gains fall below such a bound only, so
tickets are chosen among the kept ones as long as the best of them is above that bound; else the pool is scanned for the
best ticket itself. State that a scan carries is of the game's size: partner masks of items, usage counts, chosen masks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.plans.draws import MAIN_K, MAIN_N, draws, numbered
from setloom.plans.dialect import Duck
from setloom.plans.views import DRAWS, LONG, PAIRS, with_
from setloom.sources.jobs import ticket_sets
from setloom.sources.storage import stored

STAR_N, STAR_K = 12, 2
PAIRS_OF_TICKET = math.comb(MAIN_K, 2)
#: Tickets that come to the driver in a scan.
KEPT = 1024
ALPHA = 0.05

#: Families of components: values of a and b, chance in a fair draw.
FAMILIES = {
    "main": (MAIN_N, MAIN_K / MAIN_N),
    "main-main": (math.comb(MAIN_N, 2), MAIN_K * (MAIN_K - 1) / (MAIN_N * (MAIN_N - 1))),
    "main-star": (MAIN_N * STAR_N, MAIN_K / MAIN_N * STAR_K / STAR_N),
    "star": (STAR_N, STAR_K / STAR_N),
    "star-star": (math.comb(STAR_N, 2), STAR_K * (STAR_K - 1) / (STAR_N * (STAR_N - 1))),
}


def components(main: str = "main", star: str = "star") -> Column:
    """Array of (kind, a, b) of a ticket or draw: items, stars and their pairs; b is 0 for single ones."""
    pairs = "flatten(transform({x}, (p, i) -> transform(slice({x}, i + 2, size({x})), q -> named_struct('kind', '{k}', 'a', least(p, q), 'b', greatest(p, q)))))"
    single = "transform({x}, p -> named_struct('kind', '{k}', 'a', p, 'b', 0))"
    cross = f"flatten(transform({main}, p -> transform({star}, q -> named_struct('kind', 'main-star', 'a', p, 'b', q))))"
    return F.expr(f"concat({single.format(x=main, k='main')}, {pairs.format(x=main, k='main-main')}, {cross}, {single.format(x=star, k='star')}, {pairs.format(x=star, k='star-star')})")


def domain(spark: SparkSession) -> DataFrame:
    """All components of the game: kind, a, b, p (their chance), threshold (family-wise, of two sides)."""
    one = {"main": MAIN_N, "star": STAR_N}
    rows = []
    for kind, (tests, p) in FAMILIES.items():
        limit = NormalDist().inv_cdf(1 - ALPHA / (2 * tests))
        x, _, y = kind.partition("-")
        for a in range(1, one[x] + 1):
            rows += [(kind, a, b, p, limit) for b in (range(a + 1 if x == y else 1, one[y] + 1) if y else [0])]
    return spark.createDataFrame(rows, "kind string, a int, b int, p double, threshold double")


def evidence(history: DataFrame) -> DataFrame:
    """game, kind, a, b, z0, z1, value of every component: what is left over the threshold of the weaker of two folds
    (odd and even t), if both have one sign; 0 otherwise. One count over the draws."""
    drawn = history.select("game", "t", F.array(*(f"b{i}" for i in range(1, MAIN_K + 1))).alias("main"), F.array("s1", "s2").alias("star"))
    sizes = drawn.groupBy("game").agg(F.count_if(F.col("t") % 2 == 1).alias("n0"), F.count_if(F.col("t") % 2 == 0).alias("n1"))
    counts = drawn.select("game", "t", F.explode(components()).alias("c")).where("c.kind <> 'star-star' or c.a <> c.b").groupBy("game", "c.kind", "c.a", "c.b").agg(F.count_if(F.col("t") % 2 == 1).alias("k0"), F.count_if(F.col("t") % 2 == 0).alias("k1"))
    met = sizes.crossJoin(F.broadcast(domain(history.sparkSession))).join(counts, ["game", "kind", "a", "b"], "left").fillna(0, ["k0", "k1"])  # a row per component of the game, none of the data
    z = [((F.col(f"k{i}") - F.col(f"n{i}") * F.col("p")) / F.sqrt(F.col(f"n{i}") * F.col("p") * (1 - F.col("p")))) for i in (0, 1)]
    met = met.withColumn("z0", F.when(F.col("n0") > 0, z[0]).otherwise(0.0)).withColumn("z1", F.when(F.col("n1") > 0, z[1]).otherwise(0.0))
    left = F.least(F.abs("z0"), F.abs("z1")) - F.col("threshold")
    value = F.when((F.signum("z0") == F.signum("z1")) & (left > 0), F.signum("z0") * left).otherwise(0.0)
    return met.select("game", "kind", "a", "b", "z0", "z1", value.alias("value"))


#: A component's place in a game's array of values, by kind: none for what is no component of the game.
_PAIR = "case when {c}.a < {c}.b and {c}.b <= {n} then {at} + ({c}.a - 1) * {n} - {c}.a * ({c}.a - 1) div 2 + {c}.b - {c}.a - 1 end"
_STARS_AT = MAIN_N + math.comb(MAIN_N, 2) + MAIN_N * STAR_N


def place_of(c: str) -> str:
    """The place as an expression of a component struct, in Spark's spelling."""
    single = f"case when {c}.a <= {{n}} then {{at}} + {c}.a - 1 end"
    cross = f"case when {c}.a <= {MAIN_N} and {c}.b <= {STAR_N} then {MAIN_N + math.comb(MAIN_N, 2)} + ({c}.a - 1) * {STAR_N} + {c}.b - 1 end"
    kinds = {"main": single.format(n=MAIN_N, at=0), "main-main": _PAIR.format(c=c, n=MAIN_N, at=MAIN_N), "main-star": cross, "star": single.format(n=STAR_N, at=_STARS_AT), "star-star": _PAIR.format(c=c, n=STAR_N, at=_STARS_AT + STAR_N)}
    return "cast(case " + " ".join(f"when {c}.kind = '{k}' then {x}" for k, x in kinds.items()) + " end as int)"


def ticket_signals(pool: DataFrame, found: DataFrame) -> DataFrame:
    """pool once a game, with signal: the sum of the values of a ticket's components, added within its row.

    A game's values are one row (an array with a place for each component), so of tickets and values only these meet
    the driver, whatever the pool's size.
    """
    values = found.select("game", F.struct(F.expr(place_of("named_struct('kind', kind, 'a', a, 'b', b)")).alias("place"), "value").alias("x"))
    values = values.groupBy("game").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["value"]).alias("of_game"))
    parts = components().alias("parts")
    each = pool.select("*", parts).crossJoin(F.broadcast(values))  # each ticket once a game; of the two only the games may pass the driver
    signal = F.expr(f"aggregate(parts, 0.0D, (s, c) -> s + coalesce(get(of_game, {place_of('c')}), 0.0D))")
    return each.select(*pool.columns, "game", signal.alias("signal"))


def rank01(rows: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """rows with `out`: the place of `value` within its group from 0 to 1, equal values by ticket_id; 0 if all are equal."""
    ends = rows.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("many"))
    made = numbered(rows, group, value, "ticket_id").join(F.broadcast(ends), group)  # a row per game
    return made.withColumn(out, F.when((F.col("high") > F.col("low")) & (F.col("many") > 1), (F.col("t") - 1) / (F.col("many") - 1)).otherwise(0.0)).drop("t", "low", "high", "many")


@dataclass(frozen=True)
class Weights:
    """Of new pairs, new items, balance of items and stars, new star pairs; `capped`: overlap and star limits hold."""

    pair: float = 1.0
    number: float = 0.0
    balance: float = 0.0
    star_balance: float = 0.0
    star_pair: float = 0.0
    capped: bool = False


#: Of the guarded portfolio (fixed values), whose pool adds 0.85 of the crowd's rank and 0.90 of the signal's.
GUARDED, CROWD, SIGNAL = Weights(4.0, 2.0, 0.35, 0.75, 0.30, True), 0.85, 0.90


@dataclass
class _State:
    """What the chosen tickets use."""

    weights: Weights
    budget: int
    shared: int
    partners: list[int] = field(default_factory=lambda: [0] * (MAIN_N + 1))
    used: int = 0
    main_usage: list[int] = field(default_factory=lambda: [0] * (MAIN_N + 1))
    star_usage: list[int] = field(default_factory=lambda: [0] * (STAR_N + 1))
    star_pairs: set[tuple[int, ...]] = field(default_factory=set)
    masks: list[int] = field(default_factory=list)
    ids: set = field(default_factory=set)
    star_cap: int = 0
    slack: int = 1

    def __post_init__(self) -> None:
        self.star_cap = math.ceil(self.budget * STAR_K / STAR_N)

    def last(self) -> bool:
        return len(self.masks) + 1 == self.budget

    def take(self, row) -> None:  # noqa: ANN001
        for i in row["main"]:
            self.partners[i] |= row["mask"] & ~(1 << i)
            self.main_usage[i] += 1
        for s in row["star"]:
            self.star_usage[s] += 1
        self.used |= row["mask"]
        self.star_pairs.add(tuple(row["star"]))
        self.masks.append(row["mask"])
        self.ids.add(row["ticket_id"])

    def gain(self, row) -> float:  # noqa: ANN001
        w, n = self.weights, max(1, len(self.masks))
        seen = sum((self.partners[i] & row["mask"]).bit_count() for i in row["main"]) // 2
        out = row["base"] + w.pair * ((PAIRS_OF_TICKET - seen) / PAIRS_OF_TICKET) + w.number * ((MAIN_K - (self.used & row["mask"]).bit_count()) / MAIN_K)
        if w.balance:
            out += w.balance * (1 - sum(self.main_usage[i] for i in row["main"]) / MAIN_K / n)
        if row["star"] and w.star_balance:
            out += w.star_balance * (1 - sum(self.star_usage[s] for s in row["star"]) / len(row["star"]) / n) + w.star_pair * (tuple(row["star"]) not in self.star_pairs)
        elif w.star_balance:
            out += w.star_balance
        return round(out, 12)

    def allows(self, row) -> bool:  # noqa: ANN001
        if row["ticket_id"] in self.ids:
            return False
        if not self.weights.capped:
            return True
        if not self.last() and any((m & row["mask"]).bit_count() > self.shared for m in self.masks):
            return False
        if not row["star"]:
            return True
        usage = self.star_usage[:]
        for s in row["star"]:
            if usage[s] >= self.star_cap:
                return False
            usage[s] += 1
        return max(usage[1:]) - min(usage[1:]) <= self.slack

    # the same as columns

    def _longs(self, values: list[int]) -> Column:
        return F.from_json(F.lit(str([int(v) for v in values])), "array<bigint>")

    def columns(self) -> tuple[Column, Column, Column, Column]:
        """Bound of the gain from now on, the gain now, whether a ticket may be allowed from now on, and whether it is now.

        What overlaps or has a star at its cap stays out; what would unbalance the stars now may fit later.
        """
        w, n = self.weights, float(max(1, len(self.masks)))
        partners, usage, stars = self._longs(self.partners), self._longs(self.main_usage), self._longs(self.star_usage)
        zero = F.lit(0).cast("long")
        total = lambda xs, of: F.aggregate(xs, zero, lambda a, i: a + F.element_at(of, i + 1))
        seen = F.aggregate("main", zero, lambda a, i: a + F.bit_count(F.element_at(partners, i + 1).bitwiseAND(F.col("mask"))).cast("long")) / 2
        have = F.size("star") > 0
        used_pair = F.lit(False)
        if self.star_pairs:
            used_pair = F.concat_ws("-", F.col("star").cast("array<string>")).isin(["-".join(map(str, p)) for p in self.star_pairs])
        falls = F.col("base") + w.pair * ((PAIRS_OF_TICKET - seen) / PAIRS_OF_TICKET) + w.number * ((MAIN_K - F.bit_count(F.lit(self.used).bitwiseAND(F.col("mask")))) / MAIN_K)
        falls = falls + F.when(have & ~used_pair, w.star_pair).otherwise(0.0)
        balance = F.lit(0.0)
        if w.balance:
            balance = w.balance * (1 - total(F.col("main"), usage) / MAIN_K / n)
        if w.star_balance:
            balance = balance + w.star_balance * F.when(have, 1 - total(F.col("star"), stars) / F.size("star") / n).otherwise(1.0)
        fits = ~F.col("ticket_id").isin(sorted(self.ids)) if self.ids else F.lit(True)
        if w.capped:
            if not self.last() and self.masks:
                fits = fits & F.forall(self._longs(self.masks), lambda m: F.bit_count(m.bitwiseAND(F.col("mask"))) <= self.shared)
            after = F.transform(self._longs(self.star_usage[1:]), lambda x, i: x + F.array_contains("star", (i + 1).cast("int")).cast("long"))
            under = F.forall("star", lambda s: F.element_at(stars, s + 1) < self.star_cap)
            fits = fits & (~have | under)
            now = fits & (~have | (F.array_max(after) - F.array_min(after) <= self.slack))
        else:
            now = fits
        return F.round(falls + w.balance + w.star_balance, 12), F.round(falls + balance, 12), fits, now


def greedy(pool: DataFrame, budget: int, weights: Weights, ties: list[str], shared: int = MAIN_K - 3, kept: int = KEPT) -> list[dict]:
    """Up to `budget` tickets of pool(ticket_id, main, star, base) in order of choice, with their gains.

    Equal gains go to the smaller `ties`. If no ticket keeps the limits they are raised by one, until the budget is met.
    """
    mask = F.aggregate("main", F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    pool = stored(pool.select("ticket_id", "main", "star", F.col("base").cast("double"), mask.alias("mask")), "pool")
    budget = min(budget, pool.count())
    state, out = _State(weights, budget, shared), []
    rest: list[dict] = []
    beyond: float | None = None  # bound of the tickets that were not kept; None: all were
    fresh = False

    def order(row: dict) -> tuple:
        return (-row["gain"], *(row[t] for t in ties))

    while len(out) < budget:
        best = min(({**r, "gain": state.gain(r)} for r in rest if state.allows(r)), key=order, default=None)
        if best is None or (beyond is not None and best["gain"] <= beyond):
            bound, gain, fits, now = state.columns()
            if not fresh:
                rows = pool.where(fits).withColumn("bound", bound).orderBy(F.desc("bound"), *ties).limit(kept + 1).collect()
                rest = [r.asDict() for r in rows[:kept]]
                beyond = rows[kept]["bound"] if len(rows) > kept else None
                fresh = True
                if rows:
                    continue
            # the kept tickets do not decide: the best of all by one aggregation
            row = pool.where(now).agg(F.min_by(F.struct(*pool.columns), F.struct(-gain, *ties)).alias("x")).select("x.*").first()
            if row is None or row["ticket_id"] is None:
                state.shared += 1
                if state.shared >= MAIN_K:
                    state.star_cap += 1
                    state.slack += 1
                fresh = False
                rest = []
                continue
            best = {**row.asDict(), "gain": state.gain(row.asDict())}
        state.take(best)
        was = state.last()
        out.append(best)
        rest = [r for r in rest if r["ticket_id"] != best["ticket_id"]]
        fresh = False
        if weights.capped and was:
            rest, beyond = [], -math.inf  # the last ticket may overlap: tickets that were ruled out count again
    return out


CHOSEN = "place int, ticket_id long, main array<int>, star array<int>, score double"


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([(i, r["ticket_id"], r["main"], r["star"], r["gain"]) for i, r in enumerate(rows, 1)], CHOSEN)


def popularity(main: str = "main") -> Column:
    """How crowded a ticket is: low items and close ones are chosen more often."""
    return F.expr(f"aggregate({main}, 1.0D, (a, i) -> a * if(i <= 31, 1.3D, 0.8D)) * if(array_max({main}) - array_min({main}) <= 9, 1.5D, 1.0D)")


def guarded_portfolio(pool: DataFrame, history: DataFrame, budget: int, kept: int = KEPT, modes: tuple[str, ...] = ("ablation", "guarded")) -> DataFrame:
    """mode, game, place, ticket_id, main, star, score: for each game the portfolio of pool(ticket_id, main, star) by reach,
    balance, crowd and guarded evidence; and the ablation, which is the same without the evidence, so alike in all games."""
    spark = pool.sparkSession
    games = [r["game"] for r in history.select("game").distinct().orderBy("game").collect()]
    crowd = pool.select("ticket_id", "main", "star", (-F.log(popularity() + 1e-12)).alias("crowd"), F.lit(0).alias("all"))
    crowd = stored(rank01(crowd, "all", "crowd", "crowd_rank").drop("all", "crowd"), "crowd")

    def chosen(df: DataFrame, base: Column) -> list[dict]:
        return greedy(df.withColumn("base", base), budget, GUARDED, ["ticket_id"], kept=kept)

    out = []
    if "ablation" in modes:
        plain = chosen(crowd, CROWD * F.col("crowd_rank"))
        out += [("ablation", g, plain) for g in games]
    if "guarded" in modes:
        signals = stored(ticket_signals(crowd, stored(evidence(history), "evidence")), "signals")
        rows = stored(rank01(signals, "game", "signal", "signal_rank"), "ranked-signals")
        out += [("guarded", g, chosen(rows.where(F.col("game") == g), CROWD * F.col("crowd_rank") + SIGNAL * F.col("signal_rank"))) for g in games]
    made = [(mode, g, i, r["ticket_id"], r["main"], r["star"], r["gain"]) for mode, g, found in out for i, r in enumerate(found, 1)]
    return spark.createDataFrame(made, "mode string, game string, " + CHOSEN)


def b6_guarded_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten tickets of the customers' for each game, with and without the guarded evidence."""
    pool = stored(ticket_sets(spark, sf_dir).select("ticket_id", "main", "star"), "candidates")
    made = guarded_portfolio(pool, draws(spark, sf_dir), 10)
    return made.select("game", "mode", "place", "ticket_id", F.concat_ws(" ", F.col("main").cast("array<string>")).alias("main"), F.concat_ws(" ", F.col("star").cast("array<string>")).alias("star"), F.round("score", 9).alias("score"))


# Aggregation of several providers


def pair_coverage(tickets: DataFrame) -> DataFrame:
    """provider, covered, many: different pairs of main items in a provider's tickets, and the tickets."""
    pairs = F.explode(F.filter(components(), lambda c: c.kind == "main-main"))
    return tickets.select("provider", "main", pairs.alias("c")).groupBy("provider").agg(F.count_distinct("c.a", "c.b").alias("covered"), F.count_distinct("main").alias("mains"))


def aggregate(proposals: DataFrame, budget: int, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), floor: bool = True, kept: int = KEPT) -> DataFrame:
    """place, main, star, score, source: `budget` tickets from proposals(provider, place, main, star, score) of one game,
    by consensus, new pairs and payout. If a provider's own first `budget` tickets cover more pairs they are taken instead
    (the best covering one, of equal ones the first name), and `source` names it."""
    spark = proposals.sparkSession
    proposals = stored(proposals.withColumn("ticket_id", F.xxhash64("main", "star")), "proposals")
    ranked = rank01(proposals.withColumnRenamed("place", "own"), "provider", "score", "rank")
    single = proposals.groupBy("provider").count().where("count = 1").select("provider", F.lit(1.0).alias("only"))
    voted = ranked.join(single, "provider", "left").groupBy("main", "star").agg(F.sum(F.coalesce("only", "rank")).alias("consensus"))
    lam = popularity() / 7.0
    voted = stored(voted.withColumn("payout", (1 - F.exp(-lam)) / lam), "consensus")
    most = voted.agg(F.max("consensus").alias("c"), F.max("payout").alias("u")).first()
    if most["c"] is None:
        return spark.createDataFrame([], "place int, main array<int>, star array<int>, score double, source string")
    base = weights[0] * (F.col("consensus") / most["c"] if most["c"] > 0 else F.col("consensus")) + weights[2] * (F.col("payout") / most["u"])
    chosen = _frame(spark, greedy(voted.select(F.xxhash64("main", "star").alias("ticket_id"), "main", "star", base.alias("base")), budget, Weights(weights[1]), ["main", "star"], kept=kept))
    mine = chosen.select("place", "main", "star", "score", F.lit("aggregate").alias("source"))
    if not floor:
        return mine
    first = proposals.where(F.col("place") <= budget)
    many = min(budget, voted.count())
    able = [r["provider"] for r in first.groupBy("provider").count().where(F.col("count") >= many).collect()]
    single = {r["provider"]: r["covered"] for r in pair_coverage(first).collect() if r["provider"] in able}
    reach = pair_coverage(mine.withColumn("provider", F.col("source"))).first()["covered"]
    best = min(single, key=lambda p: (-single[p], p), default=None)
    if best is not None and reach < single[best]:
        return first.where(F.col("provider") == best).select("place", "main", "star", "score", F.col("provider").alias("source"))
    return mine


def customer_proposals(spark: SparkSession, sf_dir: str, each: int) -> DataFrame:
    """Three providers that rank the customers' tickets: by their items' frequency, against it, by a hash."""
    tickets = ticket_sets(spark, sf_dir).select("ticket_id", "main", "star").dropDuplicates(["main", "star"])
    long = draws(spark, sf_dir).select(F.explode(F.array(*(f"b{i}" for i in range(1, MAIN_K + 1)))).alias("item"))
    counts = long.groupBy("item").count()  # as many rows as items
    total = tickets.select("main", "star", F.explode("main").alias("item")).join(F.broadcast(counts), "item").groupBy("main", "star").agg(F.sum("count").cast("double").alias("n"))
    total = stored(total, "ranked-tickets")
    scores = {"frequency": F.col("n"), "contrarian": -popularity() * 1.0, "uniform": F.pmod(F.xxhash64("main", "star"), F.lit(1 << 20)).cast("double")}
    out = None
    for name, score in scores.items():
        top = total.select("main", "star", score.alias("score")).orderBy(F.desc("score"), "main", "star").limit(each)
        place = F.row_number().over(Window.orderBy(F.desc("score"), "main", "star"))
        made = top.select(F.lit(name).alias("provider"), place.alias("place"), "main", "star", "score")
        out = made if out is None else out.unionByName(made)
    return out


def b10_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 tickets from 200 proposals of each of three providers."""
    made = aggregate(customer_proposals(spark, sf_dir, 200), 25)
    return made.select("place", F.concat_ws(" ", F.col("main").cast("array<string>")).alias("main"), F.concat_ws(" ", F.col("star").cast("array<string>")).alias("star"), F.round("score", 9).alias("score"), "source")


def a5_evidence_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of every item, star and pair of them in each game, over five families."""
    made = evidence(draws(spark, sf_dir))
    return made.select("game", "kind", "a", "b", *(F.round(c, 6).alias(c) for c in ("z0", "z1", "value")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (a5_evidence_families, b6_guarded_portfolio, b10_aggregate)}

_LIMITS = ", ".join(f"('{k}', {p!r}::double, {NormalDist().inv_cdf(1 - ALPHA / (2 * tests))!r}::double)" for k, (tests, p) in FAMILIES.items())
ORACLE_SQL: dict[str, str] = {
    "a5_evidence_families": Duck().written(with_(DRAWS, LONG, PAIRS) + f""", stars as (select game, t, s1 as s from draws union all select game, t, s2 from draws),
found as (select game, t, 'main' as kind, item as a, 0 as b from long union all select game, t, 'main-main', a, b from pairs union all select game, t, 'star', s, 0 from stars
  union all select game, t, 'star-star', least(s1, s2), greatest(s1, s2) from draws where s1 <> s2 union all select l.game, l.t, 'main-star', item, s from long l join stars x on x.game = l.game and x.t = l.t),
folds as (select game, kind, a, b, count(*) filter (where t % 2 = 1) as k0, count(*) filter (where t % 2 = 0) as k1 from found group by game, kind, a, b),
sizes as (select game, count(*) filter (where t % 2 = 1) as n0, count(*) filter (where t % 2 = 0) as n1 from draws group by game),
limits(kind, p, low) as (values {_LIMITS}),
m as (select unnest(range(1, 51)) as i), s as (select unnest(range(1, 13)) as i),
every as (select 'main' as kind, i as a, 0 as b from m union all select 'star', i, 0 from s union all select 'main-main', x.i, y.i from m x join m y on y.i > x.i union all select 'star-star', x.i, y.i from s x join s y on y.i > x.i union all select 'main-star', x.i, y.i from m x cross join s y),
z as (select g.game, e.kind, e.a, e.b, low, (coalesce(k0, 0) - n0 * p) / sqrt(n0 * p * (1 - p)) as z0, (coalesce(k1, 0) - n1 * p) / sqrt(n1 * p * (1 - p)) as z1 from sizes g cross join every e join limits x on x.kind = e.kind left join folds f on f.game = g.game and f.kind = e.kind and f.a = e.a and f.b = e.b)
select game, kind, cast(a as int) as a, cast(b as int) as b, round(z0, 6) as z0, round(z1, 6) as z1, round(case when sign(z0) = sign(z1) and least(abs(z0), abs(z1)) > low then sign(z0) * (least(abs(z0), abs(z1)) - low) else 0.0 end, 6) as value from z"""),
}
