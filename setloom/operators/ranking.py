"""Damped stationary ranking of the items of each game over its pair counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.plans.dialect import Duck, Spark, doubles
from setloom.plans.draws import table
from setloom.plans.views import COUNTS, DRAWS, LONG, PAIRS, domain, with_
from setloom.streaming.jobs import work_dir

DAMPING, ROUNDS = 0.85, 24
#: Rounds between two tables that cut the lineage.
CUT = 8

EDGES = """both_ways as (select game, a as src, b as dst, n from counts union all select game, b, a, n from counts),
edges as (select game, src, dst, n * 1.0 / sum(n) over (partition by game, src) as share from both_ways)"""


def stationary(edges: DataFrame, nodes: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """game, item, rank from edges(game, src, dst, share: sums to 1 for each src) and nodes(game, item).

    A round is one join and one sum. What dangling items hold is the rest of a game's mass, spread evenly.
    """
    spark, folder = edges.sparkSession, work_dir(edges.sparkSession)
    game = Window.partitionBy("game")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    edges = stored(edges, "edges")
    nodes = stored(nodes.withColumn("k", F.count("*").over(game)), "nodes")
    rank = nodes.select("game", "item", (F.lit(1.0) / F.col("k")).alias("rank"))
    for i in range(1, rounds + 1):
        flow = edges.join(rank.withColumnRenamed("item", "src"), ["game", "src"]).groupBy("game", F.col("dst").alias("item")).agg(F.sum(F.col("share") * F.col("rank")).alias("flow"))
        held = nodes.join(flow, ["game", "item"], "left").select("game", "item", "k", F.coalesce("flow", F.lit(0.0)).alias("flow"))
        rest = 1.0 - F.sum("flow").over(game)
        rank = held.select("game", "item", ((1 - damping) / F.col("k") + damping * (F.col("flow") + rest / F.col("k"))).alias("rank"))
        if i % CUT == 0 and i < rounds:
            rank = stored(rank, f"rank-{i}")
    return rank


def b4_stationary_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the 50 items of each game, and how far the ranks are from uniform (total variation)."""
    for t in ("orders", "lineitem"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    edges = spark.sql(Spark().written(with_(DRAWS, LONG, PAIRS, COUNTS, EDGES) + "select game, src, dst, share from edges"))
    nodes = spark.sql(doubles(with_(domain(Spark())) + "select distinct o_orderpriority as game, item from orders cross join domain"))
    rank = stationary(edges, nodes)
    far = F.sum(F.abs(F.col("rank") - 1.0 / 50)).over(Window.partitionBy("game")) / 2
    return rank.select("game", "item", F.round("rank", 9).alias("rank"), F.round(far, 8).alias("distance"))


def _oracle() -> str:
    d = Duck()
    parts = [DRAWS, LONG, PAIRS, COUNTS, EDGES, domain(d), "nodes as materialized (select distinct o_orderpriority as game, item from orders cross join domain)", "fixed as materialized (select * from edges)"]
    parts.append("r0 as materialized (select game, item, 1.0 / 50 as r from nodes)")
    for i in range(1, ROUNDS + 1):
        parts.append(f"f{i} as materialized (select e.game, e.dst as item, sum(e.share * r) as flow from fixed e join r{i - 1} x on x.game = e.game and x.item = e.src group by e.game, e.dst)")
        parts.append(f"h{i} as materialized (select n.game, n.item, coalesce(flow, 0.0) as flow from nodes n left join f{i} f on f.game = n.game and f.item = n.item)")
        parts.append(f"r{i} as materialized (select game, item, {1 - DAMPING:.2f} / 50 + {DAMPING} * (flow + (1.0 - sum(flow) over (partition by game)) / 50) as r from h{i})")
    return Duck().written(with_(*parts) + f"select game, item, round(r, 9) as rank, round(sum(abs(r - 1.0 / 50)) over (partition by game) / 2, 8) as distance from r{ROUNDS}")


QUERIES = {"b4_stationary_rank": b4_stationary_rank}
ORACLE_SQL = {"b4_stationary_rank": _oracle()}
