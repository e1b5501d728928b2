"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans import page_queries, record_queries, stats_queries, text_queries
from siltstone.plans.rounding import COLUMNS, DIGITS

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (stats_queries, text_queries, page_queries, record_queries)


def _rounded(name: str, query: Query) -> Query:
    columns = COLUMNS.get(name, "").split()
    return (lambda spark, sf_dir: query(spark, sf_dir).withColumns({c: F.round(c, DIGITS) for c in columns})) if columns else query


def _rounded_sql(name: str, sql: str) -> str:
    columns = COLUMNS.get(name, "").split()
    return f"select * replace ({', '.join(f'round("{c}", {DIGITS}) as "{c}"' for c in columns)}) from ({sql})" if columns else sql


def queries() -> dict[str, Query]:
    return {name: _rounded(name, query) for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _rounded_sql(name, sql) for part in _PARTS for name, sql in part.SQL.items()}
