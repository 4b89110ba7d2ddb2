"""Forward-only comparison of ticket builders at an equal budget of tickets, with coverage and returns.

At each draw every method buys the same number of tickets from what earlier draws say. A ticket is a weighted sample
without repeats: each item gets an exponential key divided by its weight, and the smallest keys win. The methods share
the exponentials and the stars, so that they differ in their weights alone. `pooled` takes its tickets from the single
methods in turn, at the same budget, and is compared with the best of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions.digests import uniforms
from setloom.plans.dialect import Duck
from setloom.plans.draws import MAIN_K, MAIN_N, draws
from setloom.plans.views import DRAWS, LONG, domain, with_

from .benchmarks import prize_tiers
from .forward import METHODS, VARIANCE, WARM_UP, block_values, causal_blocks, causal_counts, each_row
from .portfolio import STAR_K, STAR_N

BUDGET, PRICE = 6, 2.5
#: Draws of a block whose tickets are made together.
HELD = 512


def smallest(values: np.ndarray, many: int) -> np.ndarray:
    """Which `many` of the last axis are smallest; equal ones: the first. The values are used up."""
    flat = values.reshape(-1, values.shape[-1])
    rows, chosen = np.arange(len(flat)), np.zeros(flat.shape, bool)
    for _ in range(many):
        at = flat.argmin(1)
        chosen[rows, at] = True
        flat[rows, at] = np.inf
    return chosen.reshape(values.shape)


class Tickets:
    """The `budget` tickets of each method at some draws: has and stars say which items and stars each of them has."""

    def __init__(self, game: str, t: np.ndarray, seen: np.ndarray, last: np.ndarray, budget: int):
        turns = range(1, budget + 1)
        chance = uniforms([f"e1b:{game}:{x}:" for x in t.tolist()], [f"{j}:{i}" for j in turns for i in range(1, MAIN_N + 1)])
        keys = -np.log(1.0 - chance).reshape(len(t), budget, MAIN_N)
        weights = {"frequency": seen + 1, "overdue": t[:, None] - last, "uniform": np.ones_like(seen)}
        self.has = {m: smallest(keys / weights[m][:, None, :], MAIN_K) for m in METHODS}
        self.has["pooled"] = np.stack([self.has[METHODS[j % len(METHODS)]][:, j] for j in range(budget)], 1)
        luck = uniforms([f"e1s:{game}:{x}:" for x in t.tolist()], [f"{j}:{s}" for j in turns for s in range(1, STAR_N + 1)])
        self.stars = smallest(luck.reshape(len(t), budget, STAR_N), STAR_K)

    def mains(self, method: str) -> np.ndarray:
        """The items of each draw's tickets in order."""
        has = self.has[method]
        return (np.nonzero(has.reshape(-1, MAIN_N))[1] + 1).reshape(*has.shape[:2], MAIN_K)


def bought(block: pa.RecordBatch, budget: int, warm_up: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, Tickets]]:
    """Game, t, drawn items and stars (whether a draw has them) and tickets of a block's draws after the warm-up, HELD at once."""
    game = block.column("game")[0].as_py()
    t, y, seen, last = causal_counts(block)
    stars = np.zeros((len(t), STAR_N + 1), bool)
    for c in ("s1", "s2"):
        s = block_values(block, c)
        known = np.flatnonzero((s >= 1) & (s <= STAR_N))
        stars[known, s[known]] = True
    kept = np.flatnonzero(t > warm_up)
    for at in range(0, len(kept), HELD):
        some = kept[at : at + HELD]
        yield game, t[some], y[some].astype(bool), stars[some, 1:], Tickets(game, t[some], seen[some], last[some], budget)


def _lists(values: np.ndarray) -> pa.Array:
    """An array of lists (of lists) from all but the first axis."""
    out = pa.array(values.ravel(), pa.int32())
    for axis in range(values.ndim - 1, 0, -1):
        many = int(np.prod(values.shape[:axis]))
        out = pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * values.shape[axis], pa.int32()), out)
    return out


def portfolios(history: DataFrame, budget: int, warm_up: int = WARM_UP) -> DataFrame:
    """game, t, drawn, stars, bought_stars, method, mains: the `budget` tickets of each method at each draw after the first `warm_up`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in each_row(batches):
            for game, t, _, _, tickets in bought(one, budget, warm_up):
                stars = _lists((np.nonzero(tickets.stars.reshape(-1, STAR_N))[1] + 1).reshape(len(t), budget, STAR_K))
                for method in tickets.has:
                    yield pa.RecordBatch.from_arrays([pa.array([game] * len(t), pa.string()), pa.array(t), stars, pa.array([method] * len(t)), _lists(tickets.mains(method))], ["game", "t", "bought_stars", "method", "mains"])

    made = causal_blocks(history, more=("s1", "s2")).mapInArrow(run, "game string, t long, bought_stars array<array<int>>, method string, mains array<array<int>>")
    main = F.array(*(f"b{i}" for i in range(1, MAIN_K + 1)))
    return made.join(history.select("game", "t", main.alias("drawn"), F.array("s1", "s2").alias("stars")), ["game", "t"]).select("game", "t", "drawn", "stars", "bought_stars", "method", "mains")


SETTLED = "game string, method string, balls int, stars int, tickets long, draws long, items long, pairs long"


def settled(history: DataFrame, budget: int, warm_up: int) -> DataFrame:
    """SETTLED: how many tickets of a method have so many of the drawn balls and stars; with one of a block's rows come
    its draws and the sums of different items and pairs that a draw's tickets have. No ticket leaves its block's task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in each_row(batches):
            for game, t, drawn, stars, tickets in bought(one, budget, warm_up):
                lucky = (tickets.stars & stars[:, None, :]).sum(2)
                rows = []
                for method, has in tickets.has.items():
                    cell = (has & drawn[:, None, :]).sum(2) * (STAR_K + 1) + lucky
                    many = np.bincount(cell.ravel(), minlength=(MAIN_K + 1) * (STAR_K + 1))
                    mains = tickets.mains(method)
                    first, second = np.triu_indices(MAIN_K, 1)
                    codes = np.sort((mains[:, :, first] * 64 + mains[:, :, second]).astype("i2").reshape(len(t), -1), axis=1)
                    sums = (len(t), int(has.any(1).sum()), len(t) + int(np.count_nonzero(np.diff(codes, axis=1))))
                    for at in np.flatnonzero(many).tolist():
                        rows.append((game, method, *divmod(at, STAR_K + 1), int(many[at]), *sums))
                        sums = (0, 0, 0)
                names = [c.split()[0] for c in SETTLED.split(", ")]
                kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]] for c in SETTLED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

    return causal_blocks(history, more=("s1", "s2")).mapInArrow(run, SETTLED)


def equal_budget(history: DataFrame, tiers: DataFrame, budget: int = BUDGET, price: float = PRICE, warm_up: int = WARM_UP) -> DataFrame:
    """A row per game and method: draws, tickets, hits, z, lift over `uniform`, coverage, spent, won, roi, best tier,
    place among the single methods (0 for `pooled`) and the gap in mean hits to the best single method.

    `tiers` has balls, stars, prize: a row per tier; a tier without one pays nothing. A draw of fewer than `warm_up`
    earlier draws is not played, and a game without others has no rows. A repeated ticket is paid and settled each time.
    """
    counts = settled(history, budget, warm_up).groupBy("game", "method", "balls", "stars").agg(*(F.sum(c).alias(c) for c in ("tickets", "draws", "items", "pairs")))
    paid = counts.join(F.broadcast(tiers.where(f"balls between 0 and {MAIN_K} and stars between 0 and {STAR_K}")), ["balls", "stars"], "left")  # 18 tiers
    sums = paid.groupBy("game", "method").agg(
        F.sum("draws").alias("draws"), F.sum("tickets").alias("tickets"), F.sum(F.col("balls") * F.col("tickets")).alias("hits"), (F.sum("items") / F.sum("draws")).alias("items"), (F.sum("pairs") / F.sum("draws")).alias("pairs"),
        F.sum(F.coalesce("prize", F.lit(0.0)) * F.col("tickets")).alias("won"), F.max(F.col("balls") * 10 + F.col("stars")).alias("top"))
    game = Window.partitionBy("game")  # four rows
    mean, spent = F.col("hits") / F.col("tickets"), F.col("tickets") * price
    single = F.col("method") != "pooled"
    control = F.max(F.when(F.col("method") == "uniform", mean)).over(game)
    place = F.when(single, F.row_number().over(game.orderBy(F.desc(F.when(single, F.col("hits"))), "method"))).otherwise(0)
    best = F.max(F.when(single, mean)).over(game)
    return sums.select(
        "game", "method", "draws", "tickets", "hits", mean.alias("mean_hits"), ((mean - MAIN_K * MAIN_K / MAIN_N) / F.sqrt(VARIANCE / F.col("tickets"))).alias("z"), (mean - control).alias("lift"),
        (F.col("items") / MAIN_N).alias("number_coverage"), (F.col("pairs") / math.comb(MAIN_N, 2)).alias("pair_coverage"), spent.alias("spent"), "won", ((F.col("won") - spent) / spent).alias("roi"),
        F.concat_ws("+", (F.col("top") / 10).cast("int").cast("string"), (F.col("top") % 10).cast("string")).alias("best_tier"), place.alias("place"), (mean - best).alias("to_best"))


def e1_equal_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tickets a draw from each of three methods and from all three in turn, over every draw of every game."""
    made = equal_budget(draws(spark, sf_dir), prize_tiers(spark, sf_dir))
    digits = {"mean_hits": 8, "z": 6, "lift": 8, "number_coverage": 8, "pair_coverage": 8, "won": 2, "roi": 6, "to_best": 8}
    return made.select(*(F.round(c, digits[c]).alias(c) if c in digits else c for c in made.columns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"e1_equal_budget": e1_equal_budget}

_ITEM = Duck().u("concat('e1b:', cast(game as varchar(40)), ':', cast(t as varchar(40)), ':', cast(j as varchar(40)), ':', cast(item as varchar(40)))")
_STAR = Duck().u("concat('e1s:', cast(game as varchar(40)), ':', cast(t as varchar(40)), ':', cast(j as varchar(40)), ':', cast(item as varchar(40)))")
ORACLE_SQL: dict[str, str] = {
    "e1_equal_budget": Duck().written(with_(DRAWS, LONG, domain(Duck()), domain(Duck(), "stars", STAR_N), domain(Duck(), "slots", BUDGET)) + f""", cells as (select s.game, s.t, o.item, case when l.item is null then 0 else 1 end as y from draws s cross join domain o left join long l on l.game = s.game and l.t = s.t and l.item = o.item),
history as (select game, t, item, y, coalesce(sum(y) over w, 0) as seen, coalesce(max(case when y = 1 then t end) over w, 0) as last from cells window w as (partition by game, item order by t rows between unbounded preceding and 1 preceding)),
keyed as (select game, t, j, item, y, seen, last, -ln(1.0 - {_ITEM}) as k from history cross join (select item as j from slots) s where t > {WARM_UP}),
bids as (select game, t, j, item, y, 'frequency' as method, k / (seen + 1) as k from keyed union all select game, t, j, item, y, 'overdue', k / (t - last) from keyed union all select game, t, j, item, y, 'uniform', k from keyed),
bought as materialized (select game, t, j, method, item, y from bids qualify row_number() over (partition by game, t, j, method order by k, item) <= 5),
every as (select * from bought union all select game, t, j, 'pooled', item, y from bought where method = case j % 3 when 1 then 'frequency' when 2 then 'overdue' else 'uniform' end),
luck as (select x.game, x.t, j, sum(case when item in (x.s1, x.s2) then 1 else 0 end) as stars from (select game, t, s1, s2, j, item from (select game, t, s1, s2, j, item from draws cross join (select item as j from slots) s cross join stars where t > {WARM_UP}) c
  qualify row_number() over (partition by game, t, j order by {_STAR}, item) <= 2) x group by x.game, x.t, j),
tiers as (select p_size % 6 as balls, p_partkey % 3 as stars, max(p_retailprice) as prize from part group by all),
won as (select e.game, e.t, e.method, e.j, cast(sum(y) as bigint) as balls, any_value(l.stars) as stars from every e join luck l on l.game = e.game and l.t = e.t and l.j = e.j group by e.game, e.t, e.method, e.j),
sums as (select w.game, w.method, count(distinct t) as draws, count(*) as tickets, cast(sum(w.balls) as bigint) as hits, sum(coalesce(prize, 0.0)) as won, max(w.balls * 10 + w.stars) as top from won w left join tiers p on p.balls = w.balls and p.stars = w.stars group by w.game, w.method),
spread as (select game, method, avg(items) as items from (select game, method, t, count(distinct item) as items from every group by all) x group by game, method),
twos as (select game, method, avg(pairs) as pairs from (select a.game, a.method, a.t, count(distinct a.item * 64 + b.item) as pairs from every a join every b on a.game = b.game and a.t = b.t and a.method = b.method and a.j = b.j and a.item < b.item group by all) x group by game, method),
best as (select game, max(hits * 1.0 / tickets) as best from sums where method <> 'pooled' group by game),
places as (select game, method, row_number() over (partition by game order by hits desc, method) as place from sums where method <> 'pooled')
select s.game, s.method, s.draws, s.tickets, s.hits, round(s.hits * 1.0 / s.tickets, 8) as mean_hits, round((s.hits * 1.0 / s.tickets - 0.5) / sqrt({VARIANCE} / s.tickets), 6) as z, round(s.hits * 1.0 / s.tickets - u.hits * 1.0 / u.tickets, 8) as lift,
round(items / 50.0, 8) as number_coverage, round(pairs / 1225.0, 8) as pair_coverage, s.tickets * 2.5 as spent, round(s.won, 2) as won, round((s.won - s.tickets * 2.5) / (s.tickets * 2.5), 6) as roi,
concat(cast(s.top // 10 as varchar), '+', cast(s.top % 10 as varchar)) as best_tier, cast(coalesce(p.place, 0) as int) as place, round(s.hits * 1.0 / s.tickets - best, 8) as to_best
from sums s join sums u on u.game = s.game and u.method = 'uniform' join spread i on i.game = s.game and i.method = s.method join twos o on o.game = s.game and o.method = s.method join best b on b.game = s.game left join places p on p.game = s.game and p.method = s.method"""),
}
