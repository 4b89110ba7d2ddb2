"""Forward-only comparison of ticket builders, low-overlap filtering, and models fitted on causal features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.plans.dialect import Duck, Spark
from setloom.plans.draws import MAIN_K, MAIN_N, draws
from setloom.plans.views import DRAWS, LONG, domain, tickets, with_
from setloom.sources.jobs import ticket_sets
from setloom.sources.storage import stored

#: Draws of a block, in which earlier draws are counted by running sums; earlier blocks are added as sums.
BLOCK = 1 << 11
#: Draws before the first cut-off.
WARM_UP = 50
METHODS = ("frequency", "overdue", "uniform")
VARIANCE = MAIN_K * (MAIN_K / MAIN_N) * (1 - MAIN_K / MAIN_N) * (MAIN_N - MAIN_K) / (MAIN_N - 1)


PANEL = "game string, t long, y array<int>, seen array<long>, last array<long>"


def causal_blocks(rows: DataFrame, size: int = BLOCK, more: tuple[str, ...] = ()) -> DataFrame:
    """A row per game and block of `size` consecutive t: game, arrays t, b1 to b5 and `more` of its draws in order, and
    n and latest of each item before the block. One shuffle of draws; blocks are dealt over the shuffle's partitions.

    The sums of earlier blocks are one row per block and item.
    """
    block = F.floor((F.col("t") - 1) / size).cast("long").alias("block")
    mains = [f"b{i}" for i in range(1, MAIN_K + 1)]
    names = ["t", *mains, *more]
    drawn = rows.select("game", "t", block, *(F.col(c).cast("long").alias(c) for c in names[1:]))
    blocks = drawn.groupBy("game", "block").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("rows"))
    one = drawn.select("game", "t", "block", F.explode(F.array_distinct(F.array(*mains))).alias("item")).where(F.col("item").between(1, MAIN_N))
    sums = one.groupBy("game", "block", "item").agg(F.count("*").alias("n"), F.max("t").alias("latest"))
    earlier = Window.partitionBy("game", "item").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    cells = drawn.select("game", "block").distinct().withColumn("item", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(MAIN_N).cast("long"))))
    before = cells.join(sums, ["game", "block", "item"], "left").select("game", "block", F.struct("item", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.coalesce(F.max("latest").over(earlier), F.lit(0)).alias("latest")).alias("x"))
    before = before.groupBy("game", "block").agg(F.array_sort(F.collect_list("x")).alias("x"))
    met = blocks.join(before, ["game", "block"]).select("game", *(F.col("rows")[c].alias(c) for c in names), F.col("x.n").alias("n"), F.col("x.latest").alias("latest"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number: what comes out is many times what goes in
    return met.repartition(parts, "game", "t")


def block_values(block: pa.RecordBatch, column: str) -> np.ndarray:
    """An array column of a block's row, nulls as 0."""
    return block.column(column).flatten().fill_null(0).to_numpy(zero_copy_only=False)


def causal_counts(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """t of a block's draws; y, seen and last (0: none) of each item at each of them, by running sums of a matrix."""
    t = block_values(block, "t")
    y = np.zeros((len(t), MAIN_N), "i4")
    for i in range(1, MAIN_K + 1):
        item = block_values(block, f"b{i}")
        known = np.flatnonzero((item >= 1) & (item <= MAIN_N))
        y[known, item[known] - 1] = 1
    seen = block_values(block, "n") + np.cumsum(y, axis=0, dtype="i8") - y
    last = np.maximum.accumulate(np.vstack((block_values(block, "latest"), np.where(y == 1, t[:, None], 0)[:-1])), axis=0)
    return t, y, seen, last


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1)


def causal_lists(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """PANEL: a row per draw; of each item in order y (drawn), seen and last (draws with it before t, and the latest or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in each_row(batches):
            t, y, seen, last = causal_counts(one)
            starts = pa.array(np.arange(0, y.size + 1, MAIN_N), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, x) for x in (pa.array(y.ravel()), pa.array(seen.ravel()), pa.array(last.ravel(), mask=last.ravel() == 0))]
            game = pa.array([one.column("game")[0].as_py()] * len(t), pa.string())
            yield pa.RecordBatch.from_arrays([game, pa.array(t), *lists], ["game", "t", "y", "seen", "last"])

    return causal_blocks(rows, size).mapInArrow(run, PANEL)


def causal_panel(rows: DataFrame) -> DataFrame:
    """game, t, item, y (drawn), seen and last (draws with the item before t, and the latest of them or null)."""
    made = causal_lists(rows).select("game", "t", F.posexplode(F.arrays_zip("y", "seen", "last")).alias("at", "x"))
    return made.select("game", "t", (F.col("at") + 1).alias("item"), "x.y", "x.seen", "x.last")


def e1_forward_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticket per draw and method, chosen from earlier draws only: hits, z against a fair draw, lift over the control.

    The headline is the method with the most hits; ties go to the first name.
    """
    panel = causal_lists(draws(spark, sf_dir)).where(F.col("t") > WARM_UP)
    chance = Spark().u("concat('e1:', game, ':', cast(t as varchar(20)), ':', cast(i + 1 as varchar(9)))")
    keys = {"frequency": "-seen[i]", "overdue": "coalesce(last[i], 0)", "uniform": chance}
    best5 = "aggregate(slice(array_sort(transform(sequence(0, {n} - 1), i -> named_struct('k', {k}, 'i', i))), 1, {m}), 0, (s, c) -> s + y[c.i])"
    hits = panel.select("game", *(F.expr(best5.format(n=MAIN_N, k=k, m=MAIN_K)).alias(m) for m, k in keys.items()))  # within a draw's row
    sums = hits.groupBy("game").agg(F.count("*").alias("draws"), *(F.sum(m).alias(m) for m in METHODS))
    rows = sums.select("game", "draws", F.col("uniform").alias("control"), F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("hits")) for m in METHODS))).alias("x")).select("game", "draws", "control", "x.*")
    best = F.row_number().over(Window.partitionBy("game").orderBy(F.desc("hits"), "method")) == 1
    mean = F.col("hits") / F.col("draws")
    return rows.select("game", "method", "draws", "hits", F.round(mean, 8).alias("mean_hits"), F.round((mean - MAIN_K * MAIN_K / MAIN_N) / F.sqrt(VARIANCE / F.col("draws")), 6).alias("z"), F.round((F.col("hits") - F.col("control")) / F.col("draws"), 8).alias("lift"), best.alias("headline"))


def low_overlap(pool: DataFrame, budget: int, shared: int) -> DataFrame:
    """Up to `budget` tickets of pool(ticket_id, main, score), best first, of which no two have more than `shared` items
    in common; ties go to the smaller ticket_id.

    Each round is one aggregation over the pool without what the chosen tickets rule out: no sort, one row to the driver.
    """
    spark = pool.sparkSession
    left, chosen = pool, []
    for place in range(1, budget + 1):
        row = left.agg(F.max_by(F.struct("ticket_id", "main", "score"), F.struct("score", -F.col("ticket_id"))).alias("x")).select("x.*").first()
        if row is None or row["ticket_id"] is None:
            break
        chosen.append((place, row["ticket_id"], row["main"], row["score"]))
        left = left.where(F.size(F.array_intersect("main", F.array(*map(F.lit, row["main"])))) <= shared)
    return spark.createDataFrame(chosen, "place int, ticket_id long, main array<int>, score double")


def b7_low_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten tickets with the most drawn items in the history that share at most one item with each other."""
    long = draws(spark, sf_dir).select(F.explode(F.array(*(f"b{i}" for i in range(1, MAIN_K + 1)))).alias("item"))
    counts = long.groupBy("item").count()  # as many rows as items
    one = ticket_sets(spark, sf_dir).select("ticket_id", "main", F.explode("main").alias("item"))
    pool = one.join(F.broadcast(counts), "item").groupBy("ticket_id", "main").agg(F.sum("count").cast("double").alias("score"))
    made = low_overlap(stored(pool, "pool"), 10, 1)
    return made.select("place", "ticket_id", F.concat_ws(" ", F.col("main").cast("array<string>")).alias("main"), "score")


def calendar_features(rows: DataFrame) -> DataFrame:
    """y (a draw's smallest item), and trend, weekday and yearly terms of its date."""
    year = 2 * 3.141592653589793 * F.dayofyear("draw_date") / 365.25
    days = F.datediff("draw_date", F.lit("1992-01-01").cast("date")) / 1000.0
    weekdays = [(F.dayofweek("draw_date") == d).cast("double").alias(f"day_{d}") for d in range(2, 8)]
    return rows.select(F.col("b1").cast("double").alias("y"), days.alias("trend"), *weekdays, F.sin(year).alias("sin_1"), F.cos(year).alias("cos_1"))


def m3_calendar_glm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of three generalised linear models of the smallest item on trend, weekday and season."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = calendar_features(draws(spark, sf_dir))
    names = rows.columns[1:]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("y", "features")
    out = []
    for family, link in (("poisson", "log"), ("gamma", "log"), ("gaussian", "identity")):
        model = GeneralizedLinearRegression(family=family, link=link, labelCol="y", maxIter=25, tol=1e-10).fit(data)
        out += [(family, link, n, float(c)) for n, c in zip(["intercept", *names], [model.intercept, *model.coefficients])]
    return spark.createDataFrame(out, "family string, link string, term string, coefficient double").withColumn("coefficient", F.round("coefficient", 6))


def item_features(rows: DataFrame) -> DataFrame:
    """Causal rate and gap of each item at each draw after the warm-up, with the share of the history that is past."""
    panel = causal_panel(rows).where(F.col("t") > WARM_UP)
    sizes = rows.groupBy("game").agg(F.count("*").alias("n"))
    gap = F.col("t") - F.coalesce("last", F.lit(0))
    return panel.join(F.broadcast(sizes), "game").select("game", "t", "item", "y", (F.col("seen") / (F.col("t") - 1) * 10.0).alias("rate"), F.log1p(gap.cast("double")).alias("gap"), (F.col("t") / F.col("n")).alias("age"))


#: Folds of m1: draws up to a share of the history are learned from, those up to the next one are judged.
FOLDS = ((0.4, 0.6), (0.6, 0.8), (0.8, 1.0))
STRENGTHS = (0.01, 0.1, 1.0)
#: Newton's method ends when a step, in standard deviations of the features, is below this: what is left is its square.
STEP, STEPS = 1e-7, 50


class Cells:
    """Features of a block's draws after the warm-up, a row per draw and a column per item."""

    def __init__(self, block: pa.RecordBatch):
        t, y, seen, last = causal_counts(block)
        kept = t > WARM_UP
        self.t, self.y = t[kept], y[kept]
        self.rate = seen[kept] / (self.t - 1)[:, None] * 10.0
        self.gap = np.log1p((self.t[:, None] - last[kept]).astype("f8"))
        self.age = self.t / block.column("draws")[0].as_py()
        self.w = np.where(self.y == 1, MAIN_N / (2.0 * MAIN_K), MAIN_N / (2.0 * (MAIN_N - MAIN_K)))

    def learned(self, fold: int) -> slice:
        """The rows (draws are in order) that a fold learns from."""
        return slice(0, int(np.count_nonzero(self.age <= FOLDS[fold][0])))

    def judged(self, fold: int) -> slice:
        return slice(*(int(np.count_nonzero(self.age <= x)) for x in FOLDS[fold]))

    def chance(self, rows: slice, beta: tuple[float, ...]) -> np.ndarray:
        return 1 / (1 + np.exp(-(beta[0] + beta[1] * self.rate[rows] + beta[2] * self.gap[rows])))

    def moments(self, fold: int) -> np.ndarray:
        """Sums of w, w * w, and w times the features and their squares."""
        rows = self.learned(fold)
        w, x = self.w[rows], (self.rate[rows], self.gap[rows])
        return np.array([w.sum(), (w * w).sum(), *((w * c).sum() for c in x), *((w * c * c).sum() for c in x)])

    def slopes(self, fold: int, beta: tuple[float, ...]) -> np.ndarray:
        """Sums of the loss, its gradient and the upper half of its second derivatives."""
        rows = self.learned(fold)
        w, y, x1, x2 = self.w[rows], self.y[rows], self.rate[rows], self.gap[rows]
        p = self.chance(rows, beta)
        loss = -(w * np.log(np.where(y == 1, p, 1 - p))).sum()
        r, h = w * (p - y), w * p * (1 - p)
        h1, h2 = h * x1, h * x2
        return np.array([loss, r.sum(), (r * x1).sum(), (r * x2).sum(), h.sum(), h1.sum(), h2.sum(), (h1 * x1).sum(), (h1 * x2).sum(), (h2 * x2).sum()])

    def judgement(self, fold: int, beta: tuple[float, ...]) -> np.ndarray:
        """Rows judged, sums of w and of the loss, and hits of the draws' five likeliest items (equal chances: the smaller item)."""
        rows = self.judged(fold)
        p, y, w = self.chance(rows, beta), self.y[rows], self.w[rows]
        left, at, hits = -np.rint(p * 1e9), np.arange(len(y)), 0
        for _ in range(MAIN_K):
            best = left.argmin(1)
            hits += int(y[at, best].sum())
            left[at, best] = np.inf
        return np.array([y.size, w.sum(), -(w * np.log(np.where(y == 1, p, 1 - p))).sum(), hits])


def _sums(blocks: DataFrame, asked: list[tuple[str, tuple]]) -> list[np.ndarray]:
    """For each (method of Cells, its arguments) the sum over all blocks; a row per task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for one in each_row(batches):
            cells = Cells(one)
            made = [getattr(cells, name)(*args) for name, args in asked]
            total = made if total is None else [a + b for a, b in zip(total, made)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x in total], pa.list_(pa.float64())), pa.array(range(len(total)), pa.int32())], ["x", "at"])

    rows = blocks.mapInArrow(run, "x array<double>, at int").collect()
    return [np.sum([r["x"] for r in rows if r["at"] == i], axis=0) for i in range(len(asked))] if rows else []


def logistic_fits(blocks: DataFrame) -> dict[tuple[int, float], tuple[float, ...]]:
    """Intercept and coefficients of rate and gap for each fold with rows and each C, by Newton's method.

    The penalty is on coefficients of standardised features and 1 / (C times the weights' sum). A pass over the blocks
    serves all models. The other strengths of a fold start from where its last one has ended, so they need few passes.
    """
    moments = _sums(blocks, [("moments", (f,)) for f in range(len(FOLDS))])
    folds = [f for f, m in enumerate(moments) if m[0] > 0]
    spread = {}
    for f in folds:
        w, squares, *x = moments[f]
        spare = w - squares / w
        spread[f] = np.maximum([x[2] - x[0] ** 2 / w, x[3] - x[1] ** 2 / w], 0.0) / spare if spare > 0 else np.zeros(2)
    lead = STRENGTHS[-1]
    at = {(f, lead): np.zeros(3) for f in folds}
    was: dict[tuple[int, float], tuple[float, np.ndarray]] = {}
    done: dict[tuple[int, float], tuple[float, ...]] = {}
    for _ in range(STEPS):
        if not at:
            break
        points = sorted({(f, tuple(beta.tolist())) for (f, _), beta in at.items()})
        slopes = dict(zip(points, _sums(blocks, [("slopes", x) for x in points])))
        for (f, c), beta in [*at.items()]:
            loss, *s = slopes[f, tuple(beta.tolist())] / moments[f][0]
            followers = [x for x in STRENGTHS if x != c] if c == lead else []
            for strength in (c, *followers):
                ridge = np.array([0.0, *(spread[f] / (strength * moments[f][0]))])
                total = loss + (ridge * beta**2).sum() / 2
                if strength == c:
                    if (f, c) in was and not total <= was[f, c][0] + 1e-12:
                        at[f, c] = (beta + was[f, c][1]) / 2  # the step was too long
                        break
                    was[f, c] = (total, beta)
                free = np.flatnonzero([True, *(spread[f] > 0)])  # a constant feature has no coefficient
                second = np.array([[s[3], s[4], s[5]], [s[4], s[6], s[7]], [s[5], s[7], s[8]]]) + np.diag(ridge)
                step = np.zeros(3)
                step[free] = np.linalg.solve(second[np.ix_(free, free)], (np.array(s[:3]) + ridge * beta)[free])
                small = np.abs(step * np.array([1.0, *np.sqrt(spread[f])])).max() < STEP
                if strength == c:
                    at[f, c] = beta - step
                    if not small:
                        break
                    done[f, c] = tuple(at.pop((f, c)).tolist())
                elif small:
                    done[f, strength] = tuple((beta - step).tolist())
                else:
                    at[f, strength] = beta - step
    return done | {k: tuple(beta.tolist()) for k, beta in at.items()}


def m1_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced logistic models of being drawn: log-loss and hits in the next fold, for each C and expanding fold."""
    rows = draws(spark, sf_dir)
    sizes = rows.groupBy("game").agg(F.count("*").alias("draws"))  # a row per game
    blocks = stored(causal_blocks(rows).join(F.broadcast(sizes), "game"), "item-blocks")
    fits = sorted(logistic_fits(blocks).items())
    out = []
    for ((fold, c), _), (many, weight, loss, hits) in zip(fits, _sums(blocks, [("judgement", (f, beta)) for (f, _), beta in fits])):
        out.append((fold + 1, c, int(many), float(loss / weight) if many else None, int(hits) if many else None))
    return spark.createDataFrame(out, "fold int, c double, rows long, log_loss double, hits long").withColumn("log_loss", F.round("log_loss", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (e1_forward_benchmark, b7_low_overlap, m3_calendar_glm, m1_logistic)}

_U = Duck().u("concat('e1:', p.game, ':', cast(t as varchar(20)), ':', cast(item as varchar(9)))")
ORACLE_SQL: dict[str, str] = {
    name: Duck().written(text)
    for name, text in {
        "e1_forward_benchmark": with_(DRAWS, LONG, domain(Duck())) + f""", cells as (select s.game, s.t, o.item, case when l.item is null then 0 else 1 end as y from draws s cross join domain o left join long l on l.game = s.game and l.t = s.t and l.item = o.item),
history as (select game, t, item, y, coalesce(sum(y) over w, 0) as seen, coalesce(max(case when y = 1 then t end) over w, 0) as last from cells window w as (partition by game, item order by t rows between unbounded preceding and 1 preceding)),
places as (select p.game, p.t, y, row_number() over (partition by p.game, p.t order by seen desc, item) as frequency, row_number() over (partition by p.game, p.t order by last, item) as overdue, row_number() over (partition by p.game, p.t order by {_U}, item) as uniform from history p where p.t > {WARM_UP}),
chosen as (select game, 'frequency' as method, t, y from places where frequency <= 5 union all select game, 'overdue', t, y from places where overdue <= 5 union all select game, 'uniform', t, y from places where uniform <= 5),
sums as (select game, method, count(distinct t) as draws, cast(sum(y) as bigint) as hits from chosen group by game, method)
select s.game, s.method, s.draws, s.hits, round(s.hits * 1.0 / s.draws, 8) as mean_hits, round((s.hits * 1.0 / s.draws - 0.5) / sqrt({VARIANCE} / s.draws), 6) as z, round((s.hits - c.hits) * 1.0 / s.draws, 8) as lift,
row_number() over (partition by s.game order by s.hits desc, s.method) = 1 as headline from sums s join sums c on c.game = s.game and c.method = 'uniform'""",
        "b7_low_overlap": with_(DRAWS, LONG, tickets(Duck())).replace("with ", "with recursive ", 1) + """, n as (select item, count(*) as n from long group by item),
pool as materialized (select ticket_id, list(k.item order by k.item) as main, cast(sum(n) as double) as score from tickets k join n on n.item = k.item group by ticket_id),
firsts as (select ticket_id, main, score from pool order by score desc, ticket_id limit 1),
picks as (select 1 as place, ticket_id, main, score, [main] as chosen from firsts union all
  select place + 1, x.ticket_id, x.main, x.score, list_append(chosen, x.main) from (select c.place, c.chosen, arg_max({'ticket_id': p.ticket_id, 'main': p.main, 'score': p.score}, {'s': p.score, 't': -p.ticket_id}) as x from picks c, pool p
    where c.place < 10 and list_max([len(list_intersect(m, p.main)) for m in c.chosen]) <= 1 group by c.place, c.chosen) as y)
select cast(place as int) as place, ticket_id, array_to_string(main, ' ') as main, score from picks""",
    }.items()
}
