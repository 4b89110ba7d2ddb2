"""Provenance of draw tables and records: described, verified, aged, compared, sealed and checked for tampering.

A digest is a sum of row hashes, so it needs no order and adds up over partitions: tables of any size are described in
one aggregation, and neither the order of rows nor of columns matters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.plans.dialect import Duck
from setloom.plans.draws import draws
from setloom.plans.views import DRAWS, with_
from setloom.sources.jobs import _path

METADATA = "game string, rows long, first_draw date, last_draw date, columns string, digest string"
#: Days after the newest draw from which on a table is stale.
STALE_AFTER = 14


def canonical(columns: list[str]) -> Column:
    """A row as text: its columns by name, each with its name; nulls are told apart from empty texts."""
    return F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def digest(columns: list[str]) -> Column:
    """Of all rows of a group: the sum of 52 bits of each row's md5; repeated rows count."""
    return F.sum(F.conv(F.substring(F.md5(canonical(columns)), 1, 13), 16, 10).cast("decimal(38,0)")).cast("string")


def describe(table: DataFrame, date: str = "draw_date", group: str = "game") -> DataFrame:
    """Rows of METADATA of each group; a group without a parseable date has null dates."""
    own = [c for c in table.columns if c != group]
    day = F.col(date).cast("string").try_cast("date")
    return table.groupBy(group).agg(F.count("*").alias("rows"), F.min(day).alias("first_draw"), F.max(day).alias("last_draw"), F.lit(",".join(sorted(table.columns))).alias("columns"), digest(own).alias("digest")).withColumnRenamed(group, "game")


def write(table: DataFrame, path: str) -> DataFrame:
    """Write the metadata as JSON lines and return it as read back."""
    describe(table).write.mode("overwrite").json(path)
    return read(table.sparkSession, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).json(path)


def verify(table: DataFrame, recorded: DataFrame) -> DataFrame:
    """game, ok, reason, rows, rows_delta, last_draw of each group that is in the table or in the metadata."""
    now = describe(table).alias("now")
    was = recorded.alias("was")
    met = now.join(was, F.col("now.game") == F.col("was.game"), "full_outer")
    reason = (
        F.when(F.col("was.game").isNull(), "no metadata recorded")
        .when(F.col("now.game").isNull(), "no rows")
        .when(F.col("now.columns") != F.col("was.columns"), "columns changed")
        .when(F.col("now.digest") != F.col("was.digest"), "content changed")
        .otherwise("matches")
    )
    out = met.select(F.coalesce("now.game", "was.game").alias("game"), reason.alias("reason"), F.coalesce("now.rows", F.lit(0)).alias("rows"), (F.coalesce("now.rows", F.lit(0)) - F.coalesce("was.rows", F.lit(0))).alias("rows_delta"), F.col("now.last_draw").alias("last_draw"))
    return out.withColumn("ok", F.col("reason") == "matches")


def staleness(metadata: DataFrame, today: str, limit: int = STALE_AFTER) -> DataFrame:
    """game, days from the newest draw to `today`, stale: more than `limit`."""
    days = F.datediff(F.lit(today).cast("date"), F.col("last_draw"))
    return metadata.select("game", days.alias("days"), (days > limit).alias("stale"))


def delta(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """game, added, removed, changed, same: rows of two versions of a table by key (the first column is the game)."""
    own = sorted(c for c in after.columns if c not in key)
    a, b = (t.groupBy(*key).agg(digest(own).alias(name)) for t, name in ((before, "was"), (after, "now")))
    met = a.join(b, key, "full_outer")
    count = lambda cond, name: F.count_if(cond).alias(name)
    return met.groupBy(key[0]).agg(count(F.col("was").isNull(), "added"), count(F.col("now").isNull(), "removed"), count(F.col("was") != F.col("now"), "changed"), count(F.col("was") == F.col("now"), "same"))


def sealed(records: DataFrame, name: str = "seal") -> DataFrame:
    """Records with the sha256 of all their other fields."""
    return records.withColumn(name, F.sha2(canonical([c for c in records.columns if c != name]), 256))


def tampered(records: DataFrame, name: str = "seal") -> DataFrame:
    """Records whose seal is missing or not that of their fields."""
    right = F.sha2(canonical([c for c in records.columns if c != name]), 256)
    return records.where(F.col(name).isNull() | (F.col(name) != right))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The draws of two games as they once were (without the three newest, two of them otherwise), and all as they are."""
    now = draws(spark, sf_dir)
    ends = now.groupBy("game").agg(F.max("t").alias("n"))
    was = now.join(ends, "game").where((F.col("t") <= F.col("n") - 3) | (F.col("game") == "5-LOW")).drop("n")
    was = was.where("game <> '2-HIGH'").withColumn("s1", F.when((F.col("game") == "1-URGENT") & (F.col("t") <= 2), F.col("s1") % 12 + 1).otherwise(F.col("s1")).cast("int"))
    return was, now


def a25_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's draws against the metadata written of an earlier version, and how old they are on a fixed day."""
    was, now = _versions(spark, sf_dir)
    checked = verify(now, write(was, _path(spark, "metadata")))
    return checked.join(staleness(describe(now), "1998-08-20"), "game").select("game", "ok", "reason", "rows", "rows_delta", "days", "stale")


def a25_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    was, now = _versions(spark, sf_dir)
    return delta(was, now, ["game", "draw_id"])


def a26_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all draws sealed; then one number is changed in every fifty-third, and a seal lost in every ninety-seventh."""
    rows = sealed(draws(spark, sf_dir).select("game", "draw_id", "b1", "b2", "b3", "b4", "b5", "s1", "s2"))
    path = _path(spark, "records")
    rows.withColumn("b5", F.when(F.col("draw_id") % 53 == 0, F.col("b5") + 1).otherwise(F.col("b5"))).withColumn("seal", F.when(F.col("draw_id") % 97 != 0, F.col("seal"))).write.json(path)
    read_back = spark.read.schema(rows.schema).json(path)
    return tampered(read_back).select("game", "draw_id", F.col("seal").isNull().alias("unsealed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (a25_verified, a25_delta, a26_tampered)}
_WAS = "ends as (select game, max(t) as n from draws group by game), was as (select d.*, (d.game = '1-URGENT' and t <= 2) as other from draws d join ends e on e.game = d.game where (t <= n - 3 or d.game = '5-LOW') and d.game <> '2-HIGH')"
ORACLE_SQL: dict[str, str] = {
    "a25_verified": with_(DRAWS, _WAS) + """select e.game, e.game = '5-LOW' as ok, case e.game when '5-LOW' then 'matches' when '2-HIGH' then 'no metadata recorded' else case when w.game is null then 'no metadata recorded' else 'content changed' end end as reason,
e.rows, e.rows - coalesce(w.rows, 0) as rows_delta, cast(date_diff('day', last_draw, date '1998-08-20') as int) as days, date_diff('day', last_draw, date '1998-08-20') > 14 as stale
from (select game, count(*) as rows, max(draw_date) as last_draw from draws group by game) e left join (select game, count(*) as rows from was group by game) w on w.game = e.game""",
    "a25_delta": with_(DRAWS, _WAS) + "select d.game, count(*) filter (where w.draw_id is null) as added, cast(0 as bigint) as removed, count(*) filter (where w.other) as changed, count(*) filter (where not w.other) as same from draws d left join was w on w.draw_id = d.draw_id group by d.game",
    "a26_tampered": with_(DRAWS) + "select game, draw_id, draw_id % 97 = 0 as unsealed from draws where draw_id % 53 = 0 or draw_id % 97 = 0",
}
ORACLE_SQL = {n: Duck().written(x) for n, x in ORACLE_SQL.items()}
