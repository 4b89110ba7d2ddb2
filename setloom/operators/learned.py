"""Pick weights learned from item features: how often the crowd picks an item, as the mean of a ridge regression and
boosted trees, and tickets drawn by the inverse. The draw itself is never a target.

One row per game and item, so both models are fitted on games times items rows however long the history is; they are
shared by all games, whose histories differ in the frequency feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.plans.draws import MAIN_N, draws
from setloom.sources.jobs import ticket_sets
from setloom.sources.storage import stored

from . import levels
from .builders import SPARE, best, builder, item_weights, log_weight, sampled

FEATURES = ("calendar", "month", "seventh", "magnitude", "decade", "round", "frequency")
ALPHA, TREES, DEPTH, STEP = 1.0, 30, 3, 0.2


def features(history: DataFrame) -> DataFrame:
    """game, item and FEATURES of every main item of every game; frequency is its share of the drawn items."""
    counts = item_weights(history).where("kind = 'main'").withColumn("n", F.col("n") - 1)
    share = F.coalesce(F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("game")), F.lit(0.0)), F.lit(0.0))  # a row per item
    i = F.col("item")
    made = {"calendar": i <= 31, "month": i <= 12, "seventh": i % 7 == 0, "magnitude": (i - 1) / (MAIN_N - 1), "decade": F.floor((i - 1) / 10), "round": i % 10 == 0, "frequency": share}
    return counts.select("game", "item", *(made[c].cast("double").alias(c) for c in FEATURES))


def crowd(spark: SparkSession) -> DataFrame:
    """item, picks: how often the crowd is taken to pick an item where no picks are known; dates go first."""
    i = F.col("id")
    return spark.range(1, MAIN_N + 1).select(i.cast("int").alias("item"), (F.when(i <= 31, 1.3).otherwise(0.8) * F.when(i % 7 == 0, 1.25).otherwise(1.0)).alias("picks"))


def pick_weights(history: DataFrame, picks: DataFrame, alpha: float = ALPHA, trees: int = TREES) -> DataFrame:
    """game, item, ridge, boosted, n: both models' logarithm of the picks, and the inverse of their mean's exponential as a
    share of the game. picks(item, picks) may lack items; these count as half a pick."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    rows = features(history).join(picks.select("item", "picks"), "item", "left").withColumn("label", F.log(F.greatest(F.coalesce("picks", F.lit(0.0)), F.lit(0.5))))
    rows = stored(rows.drop("picks").repartition(1).sortWithinPartitions("game", "item"), "item-features")  # games x items rows, in one order for the trees
    n, spread = rows.agg(F.count("*"), F.stddev_pop("label")).first()
    if not n:
        return history.sparkSession.createDataFrame([], "game string, item int, ridge double, boosted double, n double")
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("game", "item", "features", "label").coalesce(1)
    # the penalty is on the sum of squares; Spark takes it on their mean and divides it by the label's deviation
    ridge = LinearRegression(regParam=alpha / n * spread, elasticNetParam=0.0, standardization=False, solver="normal", predictionCol="ridge").fit(data)
    boosted = GBTRegressor(maxIter=trees, maxDepth=DEPTH, stepSize=STEP, seed=0, predictionCol="boosted").fit(data)
    made = boosted.transform(ridge.transform(data)).select("game", "item", "ridge", "boosted")
    inverse = F.exp(-(F.col("ridge") + F.col("boosted")) / 2)
    return made.withColumn("n", inverse / F.sum(inverse).over(Window.partitionBy("game")))


@builder("learned")
def learned(history: DataFrame, budget: int, seed: int) -> DataFrame:
    """Tickets drawn by the inverse of the learned pick weights, stars alike."""
    return learned_tickets(history, crowd(history.sparkSession), budget, seed)


def learned_tickets(history: DataFrame, picks: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """game, place, main, star, score (the logarithm of the items' weights)."""
    mains = pick_weights(history, picks).select("game", F.lit("main").alias("kind"), "item", "n")
    stars = item_weights(history).where("kind = 'star'").withColumn("n", F.lit(1.0))
    weights = stored(mains.unionByName(stars.select("game", "kind", "item", "n")), "weights")
    return best(log_weight(sampled(weights, budget, seed, SPARE), weights), budget, F.col("try"))


def pick_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, picks: how many of the tickets sold have an item."""
    return ticket_sets(spark, sf_dir).select(F.explode("main").alias("item")).groupBy("item").agg(F.count("*").cast("double").alias("picks"))


def b11_pick_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models' picks of each game's items, learned from the tickets sold, and the weight that follows."""
    return pick_weights(draws(spark, sf_dir), pick_counts(spark, sf_dir)).select("game", "item", F.round("ridge", 6).alias("ridge"), F.round("boosted", 6).alias("boosted"), F.round("n", 8).alias("weight"))


def b11_learned_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty tickets of each game drawn by the inverse of the picks learned from the tickets sold."""
    made = learned_tickets(draws(spark, sf_dir), pick_counts(spark, sf_dir), 20, 11)
    return made.select("game", "place", levels.shown("main"), levels.shown("star"), F.round("score", 6).alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (b11_pick_weights, b11_learned_tickets)}
