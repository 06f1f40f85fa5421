"""All registered queries and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.surrogates import TABLES, on_files, statement
from . import monitoring, pages
from .serving import STATEMENTS

__all__ = ["ORACLE", "QUERIES", "TABLES"]


def _query(ctes: list[str], sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(on_files(statement(ctes, sql, duck=False), sf_dir))

    return run


QUERIES = {n: _query(*s) for n, s in STATEMENTS.items()} | monitoring.QUERIES | pages.QUERIES
ORACLE = {n: statement(*s, duck=True) for n, s in STATEMENTS.items()} | monitoring.ORACLE | pages.ORACLE
