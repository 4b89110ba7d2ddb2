"""All registered queries of the library's own operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from setloom.operators import benchmarks, branches, budgets, builders, cutoffs, filters, forward, learned, levels, measures, portfolio, provenance, ranking
from setloom.plans import draws, more, rows
from setloom.plans.dialect import Duck, Spark
from setloom.sources import checks
from setloom.sources import jobs as files
from setloom.streaming import jobs

FLAGSHIP = "a4_top_pairs"


def planned(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: draws.run(spark, sf_dir, more.SQL[name](Spark()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**draws.QUERIES, **ranking.QUERIES, **jobs.QUERIES, **files.QUERIES, **checks.QUERIES, **forward.QUERIES, **filters.QUERIES, **benchmarks.QUERIES, **branches.QUERIES, **cutoffs.QUERIES, **portfolio.QUERIES, **levels.QUERIES, **builders.QUERIES, **learned.QUERIES, **measures.QUERIES, **budgets.QUERIES, **provenance.QUERIES, **{n: planned(n) for n in more.SQL}, **rows.QUERIES}
ORACLE_SQL: dict[str, str] = {**draws.ORACLE_SQL, **ranking.ORACLE_SQL, **jobs.ORACLE_SQL, **files.ORACLE_SQL, **checks.ORACLE_SQL, **forward.ORACLE_SQL, **filters.ORACLE_SQL, **branches.ORACLE_SQL, **measures.ORACLE_SQL, **budgets.ORACLE_SQL, **portfolio.ORACLE_SQL, **provenance.ORACLE_SQL, **{n: Duck().written(f(Duck())) for n, f in more.SQL.items()}}
