"""Readers of draw, prize and jackpot files, and sinks: upsert, JSON lines, proposals. All rows stay in Spark."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAINS, STARS = [f"ball_{i}" for i in range(1, 6)], [f"star_{i}" for i in range(1, 3)]
#: Names that header files use for a draw's columns, in lower case with underscores.
ALIASES: dict[str, tuple[str, ...]] = {
    "draw_date": ("draw_date", "date", "drawdate"),
    **{x: (x, x.replace("_", ""), x.replace("ball", "main")) for x in MAINS},
    **{x: (x, x.replace("_", ""), f"lucky_{x}", f"lucky_{x.replace('_', '')}") for x in STARS},
}


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def _cast(column: Column, name: str) -> Column:
    return column.try_cast("date" if name == "draw_date" else "int").alias(name)


def read_draws(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]] = ALIASES, keep: Sequence[str] = ()) -> DataFrame:
    """A CSV with a header: columns found by any alias, rows with a cell that is no number or date left out.

    Of columns of one name the first that is filled counts. A file without one of the columns is an error.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    found: dict[str, list[Column]] = {}
    for name in raw.columns:
        found.setdefault(plain_name(name), []).append(F.col("`" + name.replace("`", "``") + "`"))
    missing = [x for x, names in aliases.items() if not any(n in found for n in names)]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    picked = [_cast(F.coalesce(*(c for n in names for c in found.get(n, []))), x) for x, names in aliases.items()]
    return raw.select(*(found[k][0].alias(k) for k in keep), *picked).dropna(subset=[*aliases])


def read_positional(spark: SparkSession, path: str) -> DataFrame:
    """A CSV without header: the first eight columns are date, mains and stars; fewer columns are an error."""
    raw = spark.read.csv(path, header=False)
    names = ["draw_date", *MAINS, *STARS]
    if len(raw.columns) < len(names):
        raise ValueError(f"{len(raw.columns)} columns, {len(names)} are needed")
    return raw.select(*(_cast(F.col(c), n) for c, n in zip(raw.columns, names))).dropna()


def read_numbers(spark: SparkSession, path: str, columns: Sequence[str] = (*MAINS, *STARS)) -> DataFrame:
    """Text of numbers between blanks or tabs, one draw a line; lines with other than that many numbers are left out."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == len(columns))
    return rows.select(*(F.col("p")[i].try_cast("int").alias(c) for i, c in enumerate(columns))).dropna()


def parse_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of prose with a date (2001-02-03 or 3/2/2001) and, last, the seven numbers; other lines are left out."""
    iso, marks = F.regexp_extract("value", r"(\d{4}-\d{2}-\d{2})", 1), r"(\d{1,2})/(\d{1,2})/(\d{4})"
    day = F.coalesce(iso.try_cast("date"), F.make_date(*(F.nullif(F.regexp_extract("value", marks, i), F.lit("")).try_cast("int") for i in (3, 2, 1))))
    numbers = F.regexp_extract_all("value", F.lit(r"(\d+)"), F.lit(1))
    rows = spark.read.text(path).select(day.alias("draw_date"), numbers.alias("n")).where(F.size("n") >= len(MAINS + STARS))
    last = F.slice("n", -7, 7)
    return rows.select("draw_date", *(last[i].try_cast("int").alias(c) for i, c in enumerate(MAINS + STARS))).dropna()


def read_prizes(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """JSON lines with keys and a map `prizes` from hits ('5_2' or '5+2') to an amount: a row per hits."""
    schema = ", ".join([*(f"{k} string" for k in keys), "prizes map<string, double>"])
    rows = spark.read.schema(schema).json(path).select(*keys, F.explode("prizes").alias("hits", "prize"))
    part = F.split("hits", "[_+]")
    return rows.select(*keys, part[0].try_cast("int").alias("km"), part[1].try_cast("int").alias("ks"), "prize").dropna(subset=["km", "ks", "prize"])


def read_jackpots(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV of jackpots: the column that has the name in it, else the last one that holds numbers only."""
    raw = spark.read.csv(path, header=True)
    named = [c for c in raw.columns if "jackpot" in plain_name(c)]
    if not named:
        rest = [c for c in raw.columns if c != key]
        bad = raw.agg(*(F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(f"c{i}") for i, c in enumerate(rest))).first()
        named = [c for i, c in enumerate(rest) if not bad[i]][-1:]
    if not named:
        raise ValueError("no column of numbers")
    return raw.select(F.col(f"`{key}`").try_cast("bigint").alias(key), F.col(f"`{named[0]}`").try_cast("double").alias("jackpot"))


def upsert(old: DataFrame, new: DataFrame, path: str, keys: Sequence[str] = ("game", "draw_date"), order: str = "draw_id") -> DataFrame:
    """Both tables with one row per key, written by game and read back: new rows win, then the largest `order`."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    others = [c for c in old.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("_new", order)).alias("_row")).select(*keys, "_row.*")
    best.write.partitionBy("game").parquet(path)
    return old.sparkSession.read.schema(best.schema).parquet(path)


RECORD = "draw_key string, game string, method string, tickets array<array<array<int>>>, ticket_price double"


def write_records(records: DataFrame, path: str) -> None:
    """Pending records as JSON lines."""
    records.write.json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def write_proposals(tickets: DataFrame, path: str) -> None:
    """Tickets (method, ticket_id, main, star, score), a folder for each method."""
    tickets.write.partitionBy("method").parquet(path)


def validate_proposals(spark: SparkSession, path: str, declared: DataFrame, main_high: int = 50, star_high: int = 12) -> DataFrame:
    """Per method of `declared` (method, budget): tickets, legal and distinct ones, and whether all is as declared."""

    def legal(items: str, size: int, high: int) -> Column:
        return (F.size(F.array_distinct(items)) == size) & (F.array_min(items) >= 1) & (F.array_max(items) <= high)

    rows = spark.read.parquet(path)
    # equal tickets meet by their key first, so that no group holds a method's tickets
    met = rows.groupBy("method", "main", "star").agg(F.count("*").alias("n")).withColumn("ok", legal("main", 5, main_high) & legal("star", 2, star_high))
    sums = met.groupBy("method").agg(F.sum("n").alias("tickets"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("legal"), F.count("*").alias("different"))
    joined = declared.join(sums, "method", "left").na.fill(0, ["tickets", "legal", "different"])
    return joined.withColumn("valid", (F.col("tickets") == F.col("budget")) & (F.col("legal") == F.col("tickets")) & (F.col("different") == F.col("tickets")))
