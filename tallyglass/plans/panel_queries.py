"""Queries over the panel of nations by month, with their SQL. Numbers are rounded to 6 digits in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions.columns import quantile_bucket, signed_rank
from tallyglass.operators import panel
from tallyglass.plans.registry import query
from tallyglass.sources.views import BARS_SQL, RETURNS_SQL, bars, table

SHORT, MIDDLE, LONG = 3, 6, 12


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.simple_returns(bars(spark, sf_dir))


@query("panel_bars", f"WITH {BARS_SQL} SELECT date, asset, round(price, 6) AS price, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM bars")
def panel_bars(spark, sf_dir):
    """The panel itself. (D2, D3)"""
    return rounded(bars(spark, sf_dir))


@query("simple_returns", f"WITH {RETURNS_SQL} SELECT date, asset, round(ret, 6) AS ret FROM rets")
def simple_returns(spark, sf_dir):
    return rounded(returns(spark, sf_dir).select("date", "asset", "ret"))


_W = "PARTITION BY asset ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"
_FULL = "CASE WHEN count(ret) OVER w{n} = {n} THEN {x} END"


def _full(n, x):
    return _FULL.format(n=n, x=x)


PRIOR_SQL = f"""WITH {RETURNS_SQL}
SELECT date, asset,
  round({_full(SHORT, f"product(1 + ret) OVER w{SHORT} - 1")}, $digits) AS momentum_{SHORT},
  round({_full(MIDDLE, f"product(1 + ret) OVER w{MIDDLE} - 1")}, $digits) AS momentum_{MIDDLE},
  round({_full(LONG, f"product(1 + ret) OVER w{LONG} - 1")}, $digits) AS momentum_{LONG},
  round({_full(SHORT, f"1 - product(1 + ret) OVER w{SHORT}")}, $digits) AS reversal_{SHORT},
  round({_full(MIDDLE, f"stddev_samp(ret) OVER w{MIDDLE} * sqrt(12)")}, $digits) AS volatility_{MIDDLE},
  round({_full(LONG, f"stddev_samp(ret) OVER w{LONG} * sqrt(12)")}, $digits) AS volatility_{LONG},
  round({_full(SHORT, f"stddev_samp(ret) OVER w{SHORT} * sqrt(12)")}, $digits) AS volatility_{SHORT},
  round(lag(price) OVER (PARTITION BY asset ORDER BY date) / CASE WHEN count(price) OVER w{MIDDLE} = {MIDDLE} THEN max(price) OVER w{MIDDLE} END - 1, $digits) AS drawdown_{MIDDLE},
  round({_full(MIDDLE, f"greatest(avg(least(ret, 0) * least(ret, 0)) OVER w{MIDDLE}, 1e-10)")}, $digits) AS downside_{MIDDLE},
  round({_full(LONG, f"skewness(ret) OVER w{LONG}")}, $digits) AS skew_{LONG},
  round(lag(price) OVER (PARTITION BY asset ORDER BY date) / CASE WHEN count(price) OVER w{LONG} = {LONG} THEN max(price) OVER w{LONG} END - 1, $digits) AS drawdown_{LONG}
FROM rets WINDOW {", ".join(f"w{n} AS ({_W.format(n=n)})" for n in (SHORT, MIDDLE, LONG))}"""


@query("prior_statistics", PRIOR_SQL)
def prior_statistics(spark, sf_dir):
    return rounded(panel.prior_statistics(returns(spark, sf_dir), SHORT, MIDDLE, LONG))


MARKET_SQL = RETURNS_SQL + ", market AS (SELECT date, avg(ret) AS market FROM rets WHERE ret IS NOT NULL GROUP BY date)"


@query(
    "market_exposure",
    f"""WITH {MARKET_SQL}, j AS (SELECT rets.*, market FROM rets LEFT JOIN market USING (date)),
 x AS (SELECT date, asset, count(CASE WHEN ret IS NOT NULL AND market IS NOT NULL THEN 1 END) OVER w AS n, covar_samp(ret, market) OVER w AS c,
         var_samp(market) OVER w AS vm, var_samp(ret) OVER w AS vr, product(1 + ret) OVER w AS pr, product(1 + market) OVER w AS pm
       FROM j WINDOW w AS ({_W.format(n=LONG)}))
SELECT date, asset, round(CASE WHEN n = {LONG} AND vm > 0 THEN c / vm END, $digits) AS beta,
       round(CASE WHEN n = {LONG} AND vm > 0 AND vr > 0 THEN c / sqrt(vm * vr) END, $digits) AS correlation,
       round(CASE WHEN n = {LONG} AND vm > 0 THEN sqrt(greatest(vr - c / vm * c / vm * vm, 0)) END, $digits) AS residual_volatility,
       round(CASE WHEN n = {LONG} AND vm > 0 THEN pr - pm END, $digits) AS relative_momentum FROM x""",
)
def market_exposure(spark, sf_dir):
    r = returns(spark, sf_dir)
    return rounded(panel.market_exposure(r, panel.market_returns(r), LONG))


@query(
    "forward_labels",
    f"""WITH {RETURNS_SQL} SELECT date, asset, round(CASE WHEN count(ret) OVER w = 4 THEN greatest(avg(least(ret, 0) * least(ret, 0)) OVER w, 1e-10) END, $digits) AS future_downside,
  CASE WHEN count(ret) OVER w = 4 THEN max(date) OVER w END AS label_end
  FROM rets WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)""",
)
def forward_labels(spark, sf_dir):
    return rounded(panel.forward_labels(returns(spark, sf_dir), 4))


@query(
    "activity_features",
    f"""WITH {RETURNS_SQL}, x AS (SELECT *, volume * close AS dollar FROM rets)
SELECT date, asset, round(CASE WHEN count(volume) OVER wl = {LONG} THEN ln(1 + avg(dollar) OVER ws) END, $digits) AS log_dollar_volume,
  round(CASE WHEN count(volume) OVER wl = {LONG} AND avg(volume) OVER wl > 0 THEN avg(volume) OVER ws / avg(volume) OVER wl END, $digits) AS relative_volume,
  round(CASE WHEN count(volume) OVER wl = {LONG} THEN avg(CASE WHEN dollar > 0 THEN abs(ret) / dollar END) OVER ws * 1e6 END, $digits) AS illiquidity,
  round(CASE WHEN count(volume) OVER wl = {LONG} THEN avg((high - low) / close) OVER ws END, $digits) AS range
FROM x WINDOW ws AS ({_W.format(n=SHORT)}), wl AS ({_W.format(n=LONG)})""",
)
def activity_features(spark, sf_dir):
    b = bars(spark, sf_dir)
    return rounded(panel.activity(b, panel.simple_returns(b), SHORT, LONG))


@query(
    "market_features",
    f"""WITH {MARKET_SQL}, x AS (SELECT *, product(1 + market) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM market)
SELECT date, round(market, $digits) AS market, round(CASE WHEN count(market) OVER w = {MIDDLE} THEN stddev_samp(market) OVER w END, $digits) AS realized_volatility,
  round(wealth / max(wealth) OVER (ORDER BY date ROWS BETWEEN {LONG - 1} PRECEDING AND CURRENT ROW) - 1, $digits) AS drawdown
FROM x WINDOW w AS (ORDER BY date ROWS BETWEEN {MIDDLE - 1} PRECEDING AND CURRENT ROW)""",
)
def market_features(spark, sf_dir):
    return rounded(panel.market_features(panel.market_returns(returns(spark, sf_dir)), MIDDLE, LONG))


@query(
    "average_correlation",
    f"""WITH {RETURNS_SQL}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM rets WHERE ret IS NOT NULL)),
 r AS (SELECT asset, ret, k, row_number() OVER (PARTITION BY asset ORDER BY date) AS own, rets.date FROM rets JOIN d USING (date) WHERE ret IS NOT NULL),
 e AS (SELECT e.date, e.asset, x.ret, e.own - x.own AS back FROM r e JOIN r x ON e.asset = x.asset AND x.own BETWEEN e.own - {LONG - 1} AND e.own WHERE e.own >= {LONG}),
 p AS (SELECT a.date, a.asset AS i, b.asset AS j, corr(a.ret, b.ret) AS c FROM e a JOIN e b ON a.date = b.date AND a.back = b.back AND a.asset < b.asset GROUP BY 1, 2, 3)
SELECT date, round(avg(c), $digits) AS average_correlation FROM p GROUP BY date""",
)
def average_correlation(spark, sf_dir):
    return rounded(panel.average_correlation(returns(spark, sf_dir), LONG))


@query(
    "running_drawdown",
    f"""WITH {RETURNS_SQL}, x AS (SELECT date, asset, product(1 + coalesce(ret, 0)) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM rets)
SELECT date, asset, round(wealth, 6) AS wealth, round(wealth / greatest(1, max(wealth) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1, 6) AS drawdown FROM x""",
)
def running_drawdown(spark, sf_dir):
    r = returns(spark, sf_dir).select("date", "asset", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    return rounded(panel.running_drawdown(r, "asset", "ret").drop("ret"))


@query(
    "underwater_length",
    f"""WITH {RETURNS_SQL}, x AS (SELECT date, asset, product(1 + coalesce(ret, 0)) OVER w AS wealth FROM rets WINDOW w AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)),
 y AS (SELECT *, wealth / greatest(1, max(wealth) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM x),
 z AS (SELECT *, sum((dd >= 0)::INT) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM y),
 n AS (SELECT asset, island, count(*) AS n FROM z WHERE dd < 0 GROUP BY 1, 2)
SELECT a.asset, coalesce(max(n.n), 0) AS underwater FROM (SELECT DISTINCT asset FROM rets) a LEFT JOIN n USING (asset) GROUP BY 1""",
)
def underwater_length(spark, sf_dir):
    r = returns(spark, sf_dir).select("date", "asset", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    return panel.underwater_length(panel.running_drawdown(r, "asset", "ret"), "asset")


@query(
    "trading_calendar",
    """WITH d AS (SELECT DISTINCT ts::DATE AS date FROM events) SELECT date, row_number() OVER (ORDER BY date)::INT AS session_no, lag(date) OVER (ORDER BY date) AS previous FROM d""",
)
def trading_calendar(spark, sf_dir):
    return panel.calendar(table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date")))


@query(
    "rebalance_calendar",
    """SELECT 'month' AS kind, min(o_orderdate)::DATE AS formation FROM orders GROUP BY date_trunc('month', o_orderdate)
UNION ALL SELECT 'quarter', min(o_orderdate)::DATE FROM orders GROUP BY date_trunc('quarter', o_orderdate)""",
)
def rebalance_calendar(spark, sf_dir):
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    month, quarter = panel.first_of_period(dates, "MM"), panel.first_of_period(dates, "QUARTER")
    return month.select(F.lit("month").alias("kind"), "formation").unionByName(quarter.select(F.lit("quarter").alias("kind"), "formation"))


@query("complete_dates", f"WITH {RETURNS_SQL} SELECT date FROM rets GROUP BY date HAVING count(ret) = (SELECT count(DISTINCT asset) FROM rets)")
def complete_dates(spark, sf_dir):
    return panel.complete_dates(returns(spark, sf_dir))


@query(
    "eligible_assets",
    f"""WITH {RETURNS_SQL}, cal AS (SELECT date, row_number() OVER (ORDER BY date) AS s FROM (SELECT DISTINCT date FROM rets)), n AS (SELECT rets.*, s, lag(price) OVER (PARTITION BY asset ORDER BY date) AS last FROM rets JOIN cal USING (date)),
 h AS (SELECT a.date, a.asset, a.s, any_value(a.last) AS last, count(b.ret) AS seen, least(a.s - 1, {LONG}) AS win FROM n a LEFT JOIN n b ON b.asset = a.asset AND b.s BETWEEN a.s - {LONG} AND a.s - 1 GROUP BY 1, 2, 3),
 e AS (SELECT * FROM h WHERE seen >= 10 AND win - seen <= 0.2 * win AND last > 0),
 d AS (SELECT e.date, k.s FROM e JOIN cal k ON k.s BETWEEN e.s - {LONG} AND e.s - 1 LEFT JOIN n b ON b.asset = e.asset AND b.s = k.s GROUP BY 1, 2 HAVING count(b.ret) = count(*)),
 j AS (SELECT date, count(*) AS joint FROM d GROUP BY 1 HAVING count(*) >= 10)
SELECT date, asset, seen, joint FROM e JOIN j USING (date)""",
)
def eligible_assets(spark, sf_dir):
    """Assets with enough of a history, alone and all together. (O-125)"""
    return panel.eligibility(returns(spark, sf_dir), LONG, 10, 0.2)


@query("extreme_returns", f"WITH {RETURNS_SQL} SELECT date, asset, round(ret, 6) AS ret FROM rets WHERE abs(ret) > 0.2")
def extreme_returns(spark, sf_dir):
    """Returns beyond 20 %. (O-29)"""
    return rounded(returns(spark, sf_dir).filter(F.abs("ret") > 0.2).select("date", "asset", "ret"))


@query(
    "split_summary",
    f"""WITH {BARS_SQL} SELECT CASE WHEN date < DATE '1996-01-01' THEN 'train' WHEN date < DATE '1997-01-01' THEN 'validation' ELSE 'test' END AS split,
 min(date) AS first, max(date) AS last, count(DISTINCT date) AS dates, count(DISTINCT asset) AS assets, count(*) AS n FROM bars GROUP BY 1""",
)
def split_summary(spark, sf_dir):
    """Splits by date range and their sizes. (D5, O-28, O-56)"""
    d = F.col("date")
    split = F.when(d < "1996-01-01", "train").when(d < "1997-01-01", "validation").otherwise("test")
    return bars(spark, sf_dir).groupBy(split.alias("split")).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("date").alias("dates"), F.count_distinct("asset").alias("assets"), F.count("*").alias("n"))


@query(
    "year_means",
    f"""WITH {RETURNS_SQL} SELECT year(date)::INT AS year, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS sd, count(ret) AS n FROM rets GROUP BY 1""",
)
def year_means(spark, sf_dir):
    """Means by calendar year. (O-57, O-74)"""
    return rounded(returns(spark, sf_dir).groupBy(F.year("date").alias("year")).agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.count("ret").alias("n")))


@query(
    "wide_panel",
    f"""WITH {BARS_SQL} SELECT date, {", ".join(f"round(max(price) FILTER (asset = {k}), 6) AS a{k}" for k in range(25))} FROM bars GROUP BY date""",
)
def wide_panel(spark, sf_dir):
    """Long to wide, with the assets named so that the plan needs no pass to find them. (O-30)"""
    wide = bars(spark, sf_dir).groupBy("date").pivot("asset", list(range(25))).agg(F.max("price"))
    return rounded(wide.select("date", *(F.col(str(k)).alias(f"a{k}") for k in range(25))))


@query(
    "unpivoted_bars",
    f"""WITH {BARS_SQL} SELECT date, asset, field, round(value, 6) AS value FROM bars UNPIVOT (value FOR field IN (high, low, close))""",
)
def unpivoted_bars(spark, sf_dir):
    """Wide to long. (O-31)"""
    return rounded(bars(spark, sf_dir).unpivot(["date", "asset"], ["high", "low", "close"], "field", "value"))


@query("cyclic_months", f"WITH {BARS_SQL} SELECT DISTINCT date, round(sin(2 * pi() * month(date) / 12), 6) AS month_sin, round(cos(2 * pi() * month(date) / 12), 6) AS month_cos FROM bars")
def cyclic_months(spark, sf_dir):
    """Month of the year on a circle. (O-112)"""
    angle = F.lit(2.0) * F.pi() * F.month("date") / 12
    return rounded(bars(spark, sf_dir).select("date", F.sin(angle).alias("month_sin"), F.cos(angle).alias("month_cos")).distinct())


_AVG_RANK = "(rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0)"


@query(
    "signed_ranks",
    f"""WITH {RETURNS_SQL}, x AS (SELECT date, asset, {_AVG_RANK} / count(*) OVER (PARTITION BY date) AS p FROM rets WHERE ret IS NOT NULL)
SELECT rets.date, rets.asset, round(coalesce(p, 0.5), 6) AS up, round(coalesce(1 - p, 0.5), 6) AS down FROM rets LEFT JOIN x USING (date, asset)""",
)
def signed_ranks(spark, sf_dir):
    r = returns(spark, sf_dir)
    return rounded(r.select("date", "asset", signed_rank(F.col("ret"), 1, "date").alias("up"), signed_rank(F.col("ret"), -1, "date").alias("down")))


@query(
    "quintile_means",
    f"""WITH {RETURNS_SQL}, x AS (SELECT date, asset, ret, row_number() OVER (PARTITION BY date ORDER BY price, asset) AS r, count(*) OVER (PARTITION BY date) AS n FROM rets WHERE ret IS NOT NULL),
 q AS (SELECT date, CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil((r - 1) * 5 / (n - 1)))::INT END AS quintile, avg(ret) AS m FROM x GROUP BY 1, 2)
SELECT quintile, round(avg(m), 6) AS mean FROM q GROUP BY 1""",
)
def quintile_means(spark, sf_dir):
    """Mean over dates of the mean by quintile. (O-78, O-96)"""
    r = returns(spark, sf_dir).filter("ret IS NOT NULL")
    q = r.withColumn("quintile", quantile_bucket(F.col("price"), 5, "date", tie="asset"))
    return rounded(q.groupBy("date", "quintile").agg(F.avg("ret").alias("m")).groupBy("quintile").agg(F.avg("m").alias("mean")))


@query(
    "lagged_signal",
    f"""WITH {RETURNS_SQL} SELECT date, asset, round(coalesce(lag(ret) OVER (PARTITION BY asset ORDER BY date), 0.5), 6) AS lagged FROM rets""",
)
def lagged_signal(spark, sf_dir):
    """The previous value by asset, 0.5 where there is none. (O-97)"""
    return rounded(returns(spark, sf_dir).select("date", "asset", F.coalesce(F.lag("ret").over(panel.by_asset()), F.lit(0.5)).alias("lagged")))


@query(
    "latest_before",
    f"""WITH {MARKET_SQL}, d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders)
SELECT d.date, round((SELECT arg_max(market, m.date) FROM market m WHERE m.date < d.date), 6) AS market FROM d""",
)
def latest_before(spark, sf_dir):
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return rounded(panel.latest_before(dates, panel.market_returns(returns(spark, sf_dir)), "market"))


@query(
    "forward_filled",
    f"""WITH {MARKET_SQL}, d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders)
SELECT d.date, round(last_value(market IGNORE NULLS) OVER (ORDER BY d.date ROWS UNBOUNDED PRECEDING), 6) AS market FROM d LEFT JOIN market USING (date)""",
)
def forward_filled(spark, sf_dir):
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return rounded(panel.forward_filled(dates, panel.market_returns(returns(spark, sf_dir)), "market"))


@query(
    "top_assets",
    f"""WITH {RETURNS_SQL} SELECT asset, round(avg(ret), 6) AS mean FROM rets GROUP BY asset ORDER BY avg(ret) DESC, asset LIMIT 5""",
)
def top_assets(spark, sf_dir):
    """The five assets with the highest mean: a top-k report. (O-79, O-104)"""
    return rounded(returns(spark, sf_dir).groupBy("asset").agg(F.avg("ret").alias("mean")).orderBy(F.desc("mean"), "asset").limit(5))


@query(
    "tail_means",
    f"""WITH {RETURNS_SQL}, v AS (SELECT asset, quantile_cont(-ret, 0.9) AS value_at_risk FROM rets WHERE ret IS NOT NULL GROUP BY 1)
SELECT asset, round(any_value(value_at_risk), 6) AS value_at_risk, round(avg(-ret), 6) AS expected_shortfall FROM rets JOIN v USING (asset) WHERE -ret >= value_at_risk GROUP BY 1""",
)
def tail_means(spark, sf_dir):
    """Exact quantile of losses and the mean beyond it. (O-71, O-72)"""
    r = returns(spark, sf_dir).filter("ret IS NOT NULL").select("asset", (-F.col("ret")).alias("loss"))
    at_risk = r.groupBy("asset").agg(F.percentile("loss", 0.9).alias("value_at_risk"))
    return rounded(r.join(at_risk, "asset").filter("loss >= value_at_risk").groupBy("asset").agg(F.max("value_at_risk").alias("value_at_risk"), F.avg("loss").alias("expected_shortfall")))


@query(
    "describe_returns",
    f"""WITH {RETURNS_SQL} SELECT asset, count(ret) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS sd, round(min(ret), 6) AS low, round(quantile_cont(ret, 0.25), 6) AS q1,
 round(quantile_cont(ret, 0.5), 6) AS middle, round(quantile_cont(ret, 0.75), 6) AS q3, round(max(ret), 6) AS high, round(product(1 + ret), 6) AS growth FROM rets GROUP BY asset""",
)
def describe_returns(spark, sf_dir):
    """Moments, exact quartiles and compound growth by asset. (O-73, O-76)"""
    r = F.col("ret")
    stats = [F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.min(r).alias("low"), F.max(r).alias("high"), F.product(1 + r).alias("growth")]
    quarters = [F.percentile(r, p).alias(n) for p, n in ((0.25, "q1"), (0.5, "middle"), (0.75, "q3"))]
    return rounded(returns(spark, sf_dir).groupBy("asset").agg(*stats, *quarters))


@query(
    "pair_covariances",
    f"""WITH {RETURNS_SQL} SELECT a.asset AS i, b.asset AS j, round(covar_samp(a.ret, b.ret), 6) AS cov, count(*) AS n FROM rets a JOIN rets b ON a.date = b.date AND a.asset <= b.asset
WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2""",
)
def pair_covariances(spark, sf_dir):
    """Covariances of all pairs of assets; the pairs are the result. (O-51, O-74)"""
    r = returns(spark, sf_dir).filter("ret IS NOT NULL").select("date", "asset", "ret")
    a, b = r.select("date", F.col("asset").alias("i"), F.col("ret").alias("x")), r.select("date", F.col("asset").alias("j"), F.col("ret").alias("y"))
    return rounded(a.join(b, "date").filter("i <= j").groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"), F.count("*").alias("n")))
