"""Draw views over the shared tables, and the first query: pair counts against a fair draw."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.sources.storage import stored

from .dialect import Spark
from .views import DRAWS

MAIN_N, MAIN_K = 50, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per draw and distinct item."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draw_id"), (F.col("l_partkey") % MAIN_N + 1).cast("int").alias("item")).distinct()


def d5_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws with at least five distinct items: draw_id and main, the five smallest in order. One shuffle, by draw."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draw_id"), (F.col("l_partkey") % MAIN_N + 1).cast("int").alias("item"))
    sets = lines.groupBy("draw_id").agg(F.array_sort(F.collect_set("item")).alias("all"))
    return sets.where(F.size("all") >= MAIN_K).select("draw_id", F.slice("all", 1, MAIN_K).alias("main"))


def pairs_of(main: str = "main") -> F.Column:
    """Array of structs (a, b), a < b, of a sorted item array."""
    return F.flatten(F.transform(main, lambda a: F.transform(F.filter(main, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def pair_counts(sets: DataFrame) -> DataFrame:
    pair = F.explode(pairs_of()).alias("p")
    return sets.select(pair).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def a4_top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 pairs furthest from a fair draw. Pair counts are at most C(50, 2) rows whatever the history's size."""
    sets = d5_sets(spark, sf_dir)
    share = comb(MAIN_K, 2) / comb(MAIN_N, 2)
    counts = pair_counts(sets)
    total = F.sum("n").over(Window.partitionBy()) / comb(MAIN_K, 2)
    z = (F.col("n") - total * share) / F.sqrt(total * share * (1 - share))
    return counts.select("a", "b", "n", F.round(z, 6).alias("z")).orderBy(F.abs("z").desc(), "a", "b").limit(25)


#: The stored draws of each session and folder.
_KEPT: dict[tuple[str, str], DataFrame] = {}


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with `t`: their number from 1 within `group` by `order`, without one task per group.

    Rows are dealt into ranges of (group, order) and stored; each range numbers its own rows, and a group's rows in
    earlier ranges are added: one number per range and group, however many rows there are.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(parts, group, *order).withColumn("part", F.spark_partition_id()), "ranged")
    sizes = dealt.groupBy(group, "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))
    met = dealt.withColumn("within", within).join(F.broadcast(sizes.select(group, "part", before.alias("before"))), [group, "part"])
    return met.withColumn("t", (F.col("before") + F.col("within")).cast("long")).drop("part", "within", "before")


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws of all games with mains b1 to b5, stars s1 and s2, and t in order of date; computed once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        day = F.col("o_orderdate").cast("date").alias("draw_date")
        mains = [F.col("main")[i].alias(f"b{i + 1}") for i in range(MAIN_K)]
        stars = [(F.col("draw_id") % 12 + 1).cast("int").alias("s1"), ((F.col("draw_id") % 12 + 1 + F.col("draw_id") % 11) % 12 + 1).cast("int").alias("s2")]
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("game"))
        wide = orders.join(d5_sets(spark, sf_dir), F.col("o_orderkey") == F.col("draw_id")).select("game", "draw_id", *mains, *stars, day, "o_orderdate")
        _KEPT[key] = stored(numbered(wide, "game", "o_orderdate", "draw_id").drop("o_orderdate"), "draws")
    return _KEPT[key]


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")


def run(spark: SparkSession, sf_dir: str, plan: str) -> DataFrame:
    """A plan in Spark's spelling over the tables that it names; the draws are those stored."""
    text = Spark().written(plan)
    if DRAWS in text:
        draws(spark, sf_dir).createOrReplaceTempView("setloom_draws")
        text = text.replace(DRAWS, "draws as (select * from setloom_draws)")
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


D5 = """items as (select distinct l_orderkey as draw_id, cast(l_partkey % 50 + 1 as int) as item from lineitem),
ranked as (select draw_id, item, row_number() over (partition by draw_id order by item) as rk, count(*) over (partition by draw_id) as k from items),
mains as (select draw_id, item, rk from ranked where k >= 5 and rk <= 5)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"a4_top_pairs": a4_top_pairs}
ORACLE_SQL: dict[str, str] = {
    "a4_top_pairs": f"""with {D5},
counts as (select x.item as a, y.item as b, count(*) as n from mains x join mains y on x.draw_id = y.draw_id and x.item < y.item group by x.item, y.item),
total as (select sum(n) / 10.0 as d, 10.0 / 1225.0 as p from counts)
select a, b, n, round((n - d * p) / sqrt(d * p * (1 - p)), 6) as z from counts, total order by abs(z) desc, a, b limit 25""",
}
