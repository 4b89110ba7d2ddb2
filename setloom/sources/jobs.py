"""Queries of the readers and sinks: Spark writes a file from the given tables, the reader gives its rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.plans.dialect import Duck
from setloom.plans.draws import draws, table
from setloom.plans.views import DRAWS, tickets, with_

from . import readers
from .storage import shared_dir

NUMBERS = ["b1", "b2", "b3", "b4", "b5", "s1", "s2"]
SHOWN = ", ".join(f"{a} as {b}" for a, b in zip(NUMBERS, readers.MAINS + readers.STARS))


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def s1_header_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws with other header names; a ball that is no number takes its row out."""
    path = _path(spark, "header")
    fifth = F.when(F.col("draw_id") % 97 == 0, F.lit("?")).otherwise(F.col("b5").cast("string"))
    rows = draws(spark, sf_dir).withColumn("b5", fifth)
    rows.select(F.col("draw_id").alias("Draw Id"), F.col("draw_date").alias(" Date "), *(F.col(f"b{i}").alias(f"Ball{i}") for i in range(1, 6)), F.col("s1").alias("Lucky Star1"), F.col("s2").alias("Lucky Star2")).write.csv(path, header=True)
    return readers.read_draws(spark, path, keep=["draw_id"]).withColumn("draw_id", F.col("draw_id").cast("bigint"))


def s2_positional_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "positional")
    draws(spark, sf_dir).select("draw_date", *NUMBERS, "game", "draw_id").write.csv(path)
    return readers.read_positional(spark, path)


def s3_number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of seven numbers between tabs and blanks; each seventeenth draw has one number less."""
    path = _path(spark, "numbers")
    short = F.concat_ws("\t", *NUMBERS[:-1])
    line = F.when(F.col("draw_id") % 17 == 0, short).otherwise(F.concat(F.lit("  "), short, F.lit(" \t"), F.col("s2")))
    draws(spark, sf_dir).select(line).write.text(path)
    return readers.read_numbers(spark, path)


def s6_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "lines")
    day = F.when(F.col("draw_id") % 2 == 0, F.col("draw_date").cast("string")).otherwise(F.date_format("draw_date", "d/M/yyyy"))
    line = F.concat(F.lit("Draw "), F.col("draw_id"), F.lit(" of "), day, F.lit(": "), F.concat_ws(" ", *NUMBERS[:5]), F.lit(" + "), F.concat_ws(", ", "s1", "s2"))
    draws(spark, sf_dir).select(F.when(F.col("draw_id") % 13 == 0, F.lit("no draw 1 2 3")).otherwise(line)).write.text(path)
    return readers.parse_lines(spark, path)


def s9_prize_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prize maps of draws, hits written with '_' or '+'."""
    path = _path(spark, "prizes")
    mark = F.when(F.col("draw_id") % 2 == 0, F.lit("_")).otherwise(F.lit("+"))
    prize = lambda km, ks: F.struct(F.concat(F.lit(str(km)), mark, F.lit(str(ks))).alias("k"), ((F.col("draw_id") % 1000 + 1) * 10.0**km + ks).alias("v"))
    draws(spark, sf_dir).select("draw_id", F.map_from_entries(F.array(*(prize(a, b) for a in (3, 4, 5) for b in (0, 1, 2)))).alias("prizes")).write.json(path)
    return readers.read_prizes(spark, path, "draw_id").withColumn("draw_id", F.col("draw_id").cast("bigint"))


def s11_jackpots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with a named jackpot column, and one where the last column of numbers counts."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("draw"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("other"), F.col("o_orderstatus").alias("note"))
    named, last = _path(spark, "named"), _path(spark, "last")
    orders.where("draw % 2 = 0").select("draw", F.col("price").alias("Jackpot EUR"), "other").write.csv(named, header=True)
    orders.where("draw % 2 = 1").select("draw", "other", F.col("price").alias("amount"), "note").write.csv(last, header=True)
    return readers.read_jackpots(spark, named, "draw").unionByName(readers.read_jackpots(spark, last, "draw"))


def s12_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older draws and newer ones that overlap, one row per game and date."""
    rows = draws(spark, sf_dir).select("game", "draw_date", "draw_id", "b1")
    old, new = rows.where("draw_id % 10 < 8"), rows.where("draw_id % 10 >= 5").withColumn("b1", F.col("b1") + 100)
    return readers.upsert(old, new, _path(spark, "upsert")).withColumn("game", F.col("game").cast("string"))


def ticket_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticket per customer: ticket_id, main and star in order."""
    c = "c_custkey"
    main = F.expr(f"array_sort(transform(sequence(0, 4), i -> cast(({c} + i * (1 + ({c} div 50) % 12)) % 50 + 1 as int)))")
    star = F.expr(f"array_sort(array(cast({c} % 12 + 1 as int), cast(({c} % 12 + 1 + {c} % 11) % 12 + 1 as int)))")
    return table(spark, sf_dir, "customer").select(F.col(c).alias("ticket_id"), main.alias("main"), star.alias("star"), "c_mktsegment", "c_acctbal")


def s13_record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending records written as JSON lines and read back, a row per ticket."""
    path = _path(spark, "records")
    rows = ticket_sets(spark, sf_dir)
    readers.write_records(rows.select(F.concat(F.lit("k"), "ticket_id").alias("draw_key"), F.lit("main game").alias("game"), F.col("c_mktsegment").alias("method"), F.array(F.array("main", "star")).alias("tickets"), F.lit(2.5).alias("ticket_price")), path)
    text = lambda x: F.concat_ws(" ", x.cast("array<string>"))
    opened = readers.read_records(spark, path).select("draw_key", "method", "ticket_price", F.explode("tickets").alias("ticket"))
    return opened.select("draw_key", "method", "ticket_price", text(F.col("ticket")[0]).alias("main"), text(F.col("ticket")[1]).alias("star"))


def s15_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets of five methods against their declared budgets; some tickets are illegal, tickets repeat."""
    path = _path(spark, "proposals")
    rows = ticket_sets(spark, sf_dir)
    bad = F.when(F.col("ticket_id") % 101 == 0, F.array_append(F.slice("main", 1, 4), F.col("main")[0])).otherwise(F.col("main"))
    readers.write_proposals(rows.select(F.col("c_mktsegment").alias("method"), "ticket_id", bad.alias("main"), "star", F.col("c_acctbal").alias("score")), path)
    declared = rows.groupBy(F.col("c_mktsegment").alias("method")).agg(F.count("*").alias("budget"))
    return readers.validate_proposals(spark, path, declared)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (s1_header_csv, s2_positional_csv, s3_number_text, s6_text_lines, s9_prize_map, s11_jackpots, s12_upsert, s13_record_lines, s15_proposals)}

_STARS = "cast(c_custkey % 12 + 1 as int) as x, cast((c_custkey % 12 + 1 + c_custkey % 11) % 12 + 1 as int) as y"
_SETS = tickets(Duck()) + f""", mains as (select ticket_id, list(item order by item) as main from tickets group by ticket_id),
stars as (select c_custkey as ticket_id, c_mktsegment, [least(x, y), greatest(x, y)] as star from (select c_custkey, c_mktsegment, {_STARS} from customer) as s)"""
_TIERS = " union all ".join(f"select draw_id, {a} as km, {b} as ks, (draw_id % 1000 + 1) * {10**a}.0 + {b} as prize from draws" for a in (3, 4, 5) for b in (0, 1, 2))
ORACLE_SQL: dict[str, str] = {
    name: Duck().written(text)
    for name, text in {
        "s1_header_csv": with_(DRAWS) + f"select draw_id, draw_date, {SHOWN} from draws where draw_id % 97 <> 0",
        "s2_positional_csv": with_(DRAWS) + f"select draw_date, {SHOWN} from draws",
        "s3_number_text": with_(DRAWS) + f"select {SHOWN} from draws where draw_id % 17 <> 0",
        "s6_text_lines": with_(DRAWS) + f"select draw_date, {SHOWN} from draws where draw_id % 13 <> 0",
        "s9_prize_map": with_(DRAWS) + f"select draw_id, cast(km as int) as km, cast(ks as int) as ks, cast(prize as double) as prize from ({_TIERS}) as x",
        "s11_jackpots": "select o_orderkey as draw, o_totalprice as jackpot from orders",
        "s12_upsert": with_(DRAWS) + """, both_ as (select game, draw_date, draw_id, b1, 0 as fresh from draws where draw_id % 10 < 8 union all select game, draw_date, draw_id, b1 + 100, 1 from draws where draw_id % 10 >= 5)
select game, draw_date, draw_id, b1 from (select *, row_number() over (partition by game, draw_date order by fresh desc, draw_id desc) as r from both_) as x where r = 1""",
        "s13_record_lines": with_(_SETS) + "select 'k' || m.ticket_id as draw_key, c_mktsegment as method, cast(2.5 as double) as ticket_price, array_to_string(main, ' ') as main, array_to_string(star, ' ') as star from mains m join stars s on s.ticket_id = m.ticket_id",
        "s15_proposals": with_(_SETS) + """, made as (select c_mktsegment as method, case when m.ticket_id % 101 = 0 then main[1:4] || [main[1]] else main end as main, star from mains m join stars s on s.ticket_id = m.ticket_id),
n as (select method, count(*) as budget, cast(sum(case when len(list_distinct(main)) = 5 then 1 else 0 end) as bigint) as legal, count(distinct {'m': main, 's': star}) as different from made group by method)
select method, budget, budget as tickets, legal, different, legal = budget and different = budget as valid from n""",
    }.items()
}
