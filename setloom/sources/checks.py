"""Bounds of numeric columns, and draws in result pages."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.plans.dialect import Duck
from setloom.plans.draws import draws, table
from setloom.plans.views import DRAWS, with_

#: A date that opens a draw, and a number alone in a list item or table cell.
DAY = r"\d{4}-\d{2}-\d{2}"
CELL = r"(?i)<(?:li|td)\b[^>]*>\s*(\d{1,9})\s*</(?:li|td)>"


def validate(rows: DataFrame, keys: Sequence[str], bounds: Mapping[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all bounds, with these columns as doubles; and keys, column, problem, value of the others.

    Problems are `missing` (null), `not a number`, `out of range` (bounds count as inside), and `no such column`, which
    is one violation with null keys and leaves the other columns' checks as they are. One pass, no shuffle.
    """
    there = [c for c in bounds if c in rows.columns]
    value = {c: F.col(f"`{c}`").cast("string") for c in bounds if c in there}
    number = {c: F.expr(f"try_cast(`{c}` as double)") for c in there}

    def problem(c: str) -> F.Column:
        low, high = bounds[c]
        wrong = F.when(value[c].isNull(), "missing").when(number[c].isNull() | F.isnan(number[c]), "not a number")
        return wrong.when(~number[c].between(low, high), "out of range")

    kinds = {"column": "string", "problem": "string", "value": "string"}
    found = F.array(*(F.struct(F.lit(c).alias("column"), problem(c).alias("problem"), value[c].alias("value")) for c in there))
    violations = rows.select(*keys, F.explode(F.filter(found, lambda x: x["problem"].isNotNull())).alias("x")).select(*keys, "x.*") if there else None
    absent = [(*[None] * len(keys), c, "no such column", None) for c in bounds if c not in there]
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), *(f"{c} {t}" for c, t in kinds.items())])
    lacking = rows.sparkSession.createDataFrame(absent, schema)
    valid = rows
    for c in there:
        valid = valid.where(problem(c).isNull())
    valid = valid.withColumns({c: number[c] for c in there}) if there else valid
    return valid, lacking if violations is None else violations.unionByName(lacking) if absent else violations


def draw_pages(pages: DataFrame, k: int, page: str = "page_id", html: str = "html") -> DataFrame:
    """page, at, draw_date, numbers of result pages: each date with the next k numbers of list items or table cells.

    What follows a date up to the next one is its row; a row of fewer than k numbers is skipped, further numbers are
    left out, and so are numbers before the first date. A date that is none gives no row. `at` counts the page's dates from 1.
    """
    parts = F.split(F.coalesce(F.col(html), F.lit("")), f"(?={DAY})")
    row = pages.select(page, F.posexplode(F.filter(parts, lambda x: x.rlike(f"^{DAY}"))).alias("at", "part"))
    numbers = F.transform(F.regexp_extract_all("part", F.lit(CELL), F.lit(1)), lambda x: x.cast("int"))
    day = F.expr("try_cast(substr(part, 1, 10) as date)")
    made = row.select(page, (F.col("at") + 1).alias("at"), day.alias("draw_date"), numbers.alias("numbers"))
    return made.where(F.col("draw_date").isNotNull() & (F.size("numbers") >= k)).withColumn("numbers", F.slice("numbers", 1, k))


def p1_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of bounds in the lines of orders: a column out of range, one that is no number, one that is not there."""
    bounds = {"l_quantity": (1, 40), "l_linenumber": (1, 6), "l_returnflag": (0, 1), "l_bonus": (0, 1)}
    made = validate(table(spark, sf_dir, "lineitem"), ["l_orderkey"], bounds)[1]
    return made.groupBy("column", "problem").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"), F.sum(F.expr("try_cast(value as double)")).alias("total"))


def s5_draw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws read back from a page for each draw: lists for some, tables for others, every seventh too short."""
    items = [F.concat(F.when(F.col("draw_id") % 2 == 0, "<li class='n'>").otherwise("<td>"), F.col(c).cast("string"), F.when(F.col("draw_id") % 2 == 0, "</li>").otherwise("</td>")) for c in ("b1", "b2", "b3", "b4", "b5", "s1", "s2")]
    head = F.concat(F.lit("<html><li>99</li><h2>"), F.date_format("draw_date", "yyyy-MM-dd"), F.lit("</h2>"))
    body = F.when(F.col("draw_id") % 7 == 0, F.concat(*items[:4])).otherwise(F.concat(*items, F.lit("<td>77</td>")))
    pages = draws(spark, sf_dir).select(F.col("draw_id").alias("page_id"), F.concat(head, body, F.lit("</html>")).alias("html"))
    made = draw_pages(pages, 7)
    return made.select("page_id", "draw_date", F.array_join(F.col("numbers").cast("array<string>"), " ").alias("numbers"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_violations": p1_violations, "s5_draw_pages": s5_draw_pages}
ORACLE_SQL: dict[str, str] = {
    name: Duck().written(text)
    for name, text in {
        "p1_violations": """select 'l_quantity' as "column", 'out of range' as problem, count(*) as n, min(l_orderkey) as first_order, sum(cast(l_quantity as double)) as total from lineitem where l_quantity < 1 or l_quantity > 40 having count(*) > 0
union all select 'l_linenumber', 'out of range', count(*), min(l_orderkey), sum(cast(l_linenumber as double)) from lineitem where l_linenumber < 1 or l_linenumber > 6 having count(*) > 0
union all select 'l_returnflag', 'not a number', count(*), min(l_orderkey), null from lineitem having count(*) > 0 union all select 'l_bonus', 'no such column', 1, null, null""",
        "s5_draw_pages": with_(DRAWS) + "select draw_id as page_id, draw_date, concat_ws(' ', b1, b2, b3, b4, b5, s1, s2) as numbers from draws where draw_id % 7 <> 0",
    }.items()
}
