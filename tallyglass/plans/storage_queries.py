"""Queries that go through the library's readers and writers: what was written must come back as it was."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.operators import backtest as ops
from tallyglass.operators import experiment
from tallyglass.plans.backtest_queries import CAP, GRID, METRICS_SQL, NET_SQL, QUALITY_TARGETS_SQL, SHOWN, TARGETS_SQL, _net, _quality_targets, _targets
from tallyglass.plans.panel_queries import returns, rounded
from tallyglass.plans.registry import query
from tallyglass.sources import readers, sinks
from tallyglass.sources.views import BARS_SQL, FACTS_SQL, bars, facts, parts, table

#: The splits' first dates; the last one is open.
SPLITS = {"train": "1995-01-01", "validation": "1998-01-01", "test": "2000-01-01"}
_ENDS = [*list(SPLITS.values())[1:], "9999-01-01"]
_SPLIT_SQL = "CASE " + " ".join(f"WHEN date < DATE '{end}' THEN '{k}'" for k, end in zip(SPLITS, _ENDS)) + " END"


@query("price_splits", f"WITH {BARS_SQL} SELECT date, n_name AS ticker, round(price, 6) AS adj_close, {_SPLIT_SQL} AS split FROM bars JOIN nation ON n_nationkey = asset")
def price_splits(spark, sf_dir):
    """The panel's prices as one CSV data set a split, read by the declared schema. (O-1, O-2)"""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("asset"), F.col("n_name").alias("ticker"))
    prices = sinks.written(bars(spark, sf_dir).join(names, "asset").select("date", "ticker", F.col("price").alias("adj_close")))
    top, paths = sinks.shared_folder(spark), {}
    for (split, start), end in zip(SPLITS.items(), _ENDS):
        paths[split] = f"{top}/{split}.csv"
        prices.filter((F.col("date") >= start) & (F.col("date") < end)).write.option("header", True).csv(paths[split])
    return rounded(readers.prices(spark, paths))


def _filings(told_by):
    """path, value: each issuer's facts as one nested document."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    told = F.struct(text("start").alias("start"), text("end").alias("end"), F.col("value").alias("val"), F.col("accn").cast("string").alias("accn"), F.year("end").alias("fy"), "form", text("filed").alias("filed"))
    of_concept = told_by.groupBy("issuer", "concept", "metric").agg(F.collect_list(told).alias("rows"))
    entry = F.struct("concept", F.struct(F.col("metric").alias("label"), F.create_map(F.lit("USD"), F.col("rows")).alias("units")))
    of_issuer = of_concept.groupBy("issuer").agg(F.map_from_entries(F.collect_list(entry)).alias("concepts"))
    document = F.to_json(F.struct(F.col("issuer").alias("cik"), F.lit("issuer").alias("entityName"), F.create_map(F.lit("us-gaap"), F.col("concepts")).alias("facts")))
    return of_issuer.select(F.concat(F.lit("CIK"), F.col("issuer").cast("string"), F.lit(".json")).alias("path"), document.alias("value"))


@query(
    "filings_flat",
    f"""WITH {FACTS_SQL} SELECT issuer AS cik, concept, metric AS label, 'USD' AS unit, start, "end", value, accn::VARCHAR AS accn, form, filed, year("end")::INT AS fy FROM facts0""",
)
def filings_flat(spark, sf_dir):
    """Each issuer's facts as one nested document of a filing archive, and flat again by its schema. (O-5, O-6)"""
    raw = sinks.written(_filings(facts(spark, sf_dir, parts(spark, sf_dir))))
    flat = readers.flat_facts(readers.parsed(raw, F.col("value")))
    return flat.select("cik", "concept", "label", "unit", "start", "end", "value", "accn", "form", "filed", "fy")


@query("trading_symbols", "SELECT DISTINCT c_custkey AS cik, upper(trim(c_mktsegment)) AS symbol FROM customer WHERE trim(c_mktsegment) <> ''")
def trading_symbols(spark, sf_dir):
    """Symbols among facts of several concepts, in their normal form. (O-111)"""
    c = table(spark, sf_dir, "customer")
    told = F.array(F.struct(F.lit("dei_TradingSymbol").alias("concept"), F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("text")), F.struct(F.lit("Security").alias("concept"), F.col("c_name").alias("text")))
    flat = c.select(F.col("c_custkey").alias("cik"), F.explode(told).alias("f")).select("cik", "f.concept", "f.text")
    return readers.trading_symbols(flat)


@query("stored_results", f"WITH {NET_SQL} SELECT date, strategy, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(cost, 6) AS cost, round(net, 6) AS net FROM net WHERE strategy = 'diagonal'")
def stored_results(spark, sf_dir):
    """A result written whole, by strategy, and one strategy of it read back: only its files are opened. (O-12, O-13, O-16)"""
    targets, net = _net(spark, sf_dir)
    path = sinks.shared_folder(spark)
    sinks.write_result({"returns": net, "targets": targets}, path)
    return rounded(sinks.read_result(spark, path, "returns", strategy="diagonal").select("date", "strategy", "gross", "turnover", "cost", "net"))


@query("stored_report", f"WITH {METRICS_SQL} SELECT {SHOWN} FROM met")
def stored_report(spark, sf_dir):
    """The metric table as one file with a header, and what it says. (O-15)"""
    targets, net = _net(spark, sf_dir)
    path = sinks.shared_folder(spark)
    report = ops.metrics(net, targets)
    sinks.write_report(report, path)
    return rounded(spark.read.schema(report.schema).option("header", True).csv(path))


@query("cached_totals", "SELECT c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def cached_totals(spark, sf_dir):
    """A table kept under the content of its inputs: made once, and found as long as they stay as they are. (O-17, O-169)"""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    content = {"orders": experiment.fingerprint(orders, ["o_orderkey"]), "customers": experiment.fingerprint(customers, ["c_custkey"]), "by": "segment"}
    joined = orders.join(customers, F.col("c_custkey") == F.col("o_custkey"))
    make = lambda: joined.groupBy("segment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return sinks.content_cached(make, spark, sinks.kept_folder(spark, "totals"), content)


@query(
    "zero_strength_control",
    f"""WITH a AS (WITH {QUALITY_TARGETS_SQL} SELECT date, asset, weight FROM targets WHERE strategy = '0.0'), b AS (WITH {TARGETS_SQL} SELECT date, asset, weight FROM targets WHERE strategy = 'diagonal')
SELECT 'zero_strength_changes' AS name, count(*) FILTER (a.weight IS NULL OR b.weight IS NULL OR abs(a.weight - b.weight) > 1e-11) AS n, count(*) FILTER (a.weight IS NULL OR b.weight IS NULL OR abs(a.weight - b.weight) > 1e-11) = 0 AS passed
FROM a FULL JOIN b ON a.date = b.date AND a.asset = b.asset""",
)
def zero_strength_control(spark, sf_dir):
    """A quality penalty of no strength must leave the plain weights as they are. (O-167, O-170)"""
    r = sinks.written(returns(spark, sf_dir))
    zero = _quality_targets(spark, sf_dir, r)[0].filter("strategy = '0.0'").select("date", "asset", "weight")
    plain = _targets(r).filter("strategy = 'diagonal'").select("date", "asset", "weight")
    return experiment.audit({"zero_strength_changes": experiment.changed(zero, plain, ["date", "asset"], "weight")})


_COUNTS = {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey"}


@query(
    "specification_differences",
    "WITH n AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*)::VARCHAR AS rows, count(*) FILTER (o_orderstatus <> 'F')::VARCHAR AS later FROM {t}" if t == "orders" else f"SELECT '{t}', count(*)::VARCHAR, count(*)::VARCHAR FROM {t}" for t in _COUNTS)
    + """) SELECT 'selected' AS part UNION ALL SELECT 'selected.strength' UNION ALL SELECT 'sources' WHERE EXISTS (SELECT 1 FROM n WHERE rows <> later)""",
)
def specification_differences(spark, sf_dir):
    """A frozen specification against one with another strength, of no grid, and with fewer orders: what a run would be refused for. (O-165, O-166)"""
    rows = {t: table(spark, sf_dir, t).count() for t in _COUNTS}
    later = rows | {"orders": table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").count()}
    told = lambda counts, strength: experiment.Specification({"cap": CAP}, {"strength": list(GRID)}, {"strength": strength}, ["quality"], {k: str(v) for k, v in counts.items()}, list(_COUNTS))
    found = experiment.differences(told(rows, GRID[0]), told(later, 0.75))
    return spark.createDataFrame([(x,) for x in found], "part string")
