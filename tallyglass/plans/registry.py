"""The library's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: SQL whose numbers other queries go on with: written with $digits, which stands for 6 in ``SQL`` and for 15 here.
EXACT: dict[str, str] = {}
FLAGSHIP = "order_month_profile"


def query(name: str, sql: str | None = None):
    """Register the decorated function under ``name``."""

    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql.replace("$digits", "6")
            if "$digits" in sql:
                EXACT[name] = sql.replace("$digits", "15")
        return function

    return add


@query(
    "order_month_profile",
    """SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS orders,
              round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
)
def order_month_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their value by month."""
    return (
        spark.read.parquet(f"{sf_dir}/orders.parquet")
        .groupBy(F.trunc("o_orderdate", "MM").alias("month"))
        .agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )
