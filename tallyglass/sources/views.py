"""Panel views derived from the given tables.

``bars``: one row for each nation and month of shipped lines; a nation is an asset.
``facts``: order lines as dated facts of an issuer (the customer), known from shipping on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BARS_SQL = """bars AS (
  SELECT date_trunc('month', l_shipdate)::DATE AS date, s_nationkey::INT AS asset,
         avg(l_extendedprice * (1 - l_discount)) AS price, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         avg(l_extendedprice) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, asset, price (adjusted), high, low, close, volume."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .groupBy(F.trunc("l_shipdate", "MM").alias("date"), F.col("s_nationkey").cast("int").alias("asset"))
        .agg(
            F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"),
            F.max("l_extendedprice").alias("high"),
            F.min("l_extendedprice").alias("low"),
            F.avg("l_extendedprice").alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )


RETURNS_SQL = (
    BARS_SQL
    + """, rets AS (
  SELECT *, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS ret FROM bars)"""
)

#: The metrics that order lines tell: a line of number k tells those at k, k + 4 and k + 8, going round.
METRICS = ["assets", "revenue", "income", "cash_flow", "liabilities", "equity", "capex", "operating_income", "cash", "current_assets", "current_liabilities"]

FACTS_SQL = f"""filings AS (
  SELECT o_custkey AS issuer, l_linenumber AS line, l_extendedprice AS value, l_shipdate::DATE AS filed, l_orderkey AS accn, (l_suppkey % 3)::INT AS priority, l_partkey % 13 = 0 AS short,
         CASE l_orderkey % 8 WHEN 0 THEN '10-Q' WHEN 1 THEN '10-K/A' WHEN 2 THEN '8-K' ELSE '10-K' END AS form,
         (CASE WHEN l_orderkey % 8 = 0 THEN date_trunc('quarter', o_orderdate) ELSE date_trunc('year', o_orderdate) END::DATE - 1)::DATE AS "end"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 facts0 AS (SELECT issuer, metric, metric || '_' || priority AS concept, value, ("end" - (CASE WHEN short THEN 200 WHEN form = '10-Q' THEN 90 ELSE 364 END)::INT)::DATE AS start, "end", filed, accn, priority, form
  FROM (SELECT *, unnest([{METRICS}[(line + k - 1) % {len(METRICS)} + 1] for k in [0, 4, 8]]) AS metric FROM filings))"""


#: Order lines of one partition where they are dealt by issuer; each tells three facts.
LINES = 250_000


def parts(spark: SparkSession, sf_dir: str) -> int:
    """How many partitions by issuer the facts take: tasks grow in number with the lines, not in size. (Files' footers tell the number of lines.)"""
    return max(spark.sparkContext.defaultParallelism, 1 + table(spark, sf_dir, "lineitem").count() // LINES)


def facts(spark: SparkSession, sf_dir: str, dealt: int | None = None) -> DataFrame:
    """issuer, metric, concept, value, start, end, filed, accn, priority, form.

    ``dealt``: the number of partitions to deal them to by issuer (``parts``), as lines, before these become facts. What is grouped by
    issuer and more is then not shuffled again.

    An order is a filing: a year's report, an amended one, a quarter's or one of a form that does not
    count. It tells of the last year (quarter) that had ended by then, so that orders of one
    customer and year restate the same end, and those of the next year compare with it. Its lines become known one by one.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    kind = F.col("l_orderkey") % 8
    form = F.when(kind == 0, "10-Q").when(kind == 1, "10-K/A").when(kind == 2, "8-K").otherwise("10-K")
    end = F.date_sub(F.when(kind == 0, F.trunc("o_orderdate", "QUARTER")).otherwise(F.trunc("o_orderdate", "YEAR")), 1)
    told = F.array(*(F.get(F.array(*map(F.lit, METRICS)), ((F.col("line") - 1 + k) % len(METRICS)).cast("int")) for k in (0, 4, 8)))
    found = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("issuer"),
        F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_partkey") % 13 == 0, 200).when(kind == 0, 90).otherwise(364).alias("days"),
        end.alias("end"),
        F.col("l_shipdate").cast("date").alias("filed"),
        F.col("l_orderkey").alias("accn"),
        (F.col("l_suppkey") % 3).cast("int").alias("priority"),
        form.alias("form"),
    )
    if dealt:
        found = found.repartition(dealt, "issuer")
    of_metric = found.withColumn("metric", F.explode(told))
    return of_metric.select("issuer", "metric", F.concat("metric", F.lit("_"), F.col("priority").cast("string")).alias("concept"), "value", F.date_sub("end", F.col("days")).alias("start"), "end", "filed", "accn", "priority", "form")
