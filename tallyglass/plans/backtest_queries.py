"""Queries over portfolios: strategies on the nations' panel, formed at the start of each quarter."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyglass.functions.columns import clip, prior
from tallyglass.operators import backtest as ops
from tallyglass.operators import panel
from tallyglass.plans import registry
from tallyglass.plans.facts_queries import nation_quality, nation_quality_sql
from tallyglass.plans.panel_queries import LONG, MIDDLE, returns, rounded
from tallyglass.plans.registry import query
from tallyglass.sources.sinks import written
from tallyglass.sources.views import BARS_SQL, RETURNS_SQL, bars, table

BPS = 10.0
#: Strengths of the penalties; the candidates of the grid.
RIDGE, DOWNSIDE, GRID = 0.001, 0.5, (0.0, 0.25, 0.5, 1.0, 2.0)
CAP = 0.15
UNIVERSE_SQL = (
    RETURNS_SQL
    + f""", v AS (SELECT date, asset, CASE WHEN count(ret) OVER w = {LONG} THEN var_samp(ret) OVER w END AS variance, greatest(avg(least(ret, 0) * least(ret, 0)) OVER m, 1e-10) AS downside,
   lag(date) OVER (PARTITION BY asset ORDER BY date) AS history_end FROM rets
   WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN {LONG} PRECEDING AND 1 PRECEDING), m AS (PARTITION BY asset ORDER BY date ROWS BETWEEN {MIDDLE} PRECEDING AND 1 PRECEDING)),
 u AS (SELECT * FROM v WHERE variance > 0 AND date IN (SELECT min(date) FROM rets GROUP BY date_trunc('quarter', date)) QUALIFY count(*) OVER (PARTITION BY date) * {CAP} >= 1)"""
)


def capped_sql(rows: str, columns: str = "date, asset, strategy") -> str:
    """The targets of ``rows`` (``columns``, history_end, x): shares by x, those above the cap at it, by trying the numbers of them from none up."""
    n = int(1 / CAP) + 1
    return f"""ordered AS (SELECT {columns}, history_end, x, row_number() OVER p - 1 AS k, sum(x) OVER (PARTITION BY strategy, date ORDER BY x DESC, asset ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM ({rows}) WINDOW p AS (PARTITION BY strategy, date ORDER BY x DESC, asset)),
 tries AS (SELECT strategy, date, k, (1 - k * {CAP}) / rest AS t FROM ordered WHERE k <= {n} AND (1 - k * {CAP}) / rest * x <= {CAP}),
 least AS (SELECT strategy, date, min(k) AS k, arg_min(t, k) AS t FROM tries GROUP BY 1, 2),
 targets AS (SELECT {", ".join(f"o.{c.strip()}" for c in columns.split(","))}, CASE WHEN o.k < l.k THEN {CAP} ELSE l.t * o.x END AS weight, history_end FROM ordered o JOIN least l ON l.strategy = o.strategy AND l.date = o.date)"""


TARGETS_SQL = (
    UNIVERSE_SQL
    + f""", raw AS (SELECT date, asset, history_end, 'equal' AS strategy, 1.0::DOUBLE AS x FROM u UNION ALL SELECT date, asset, history_end, 'diagonal', 1 / (variance + {RIDGE}) FROM u
   UNION ALL SELECT date, asset, history_end, 'downside', 1 / (variance + {RIDGE} + {DOWNSIDE} * downside) FROM u), {capped_sql("SELECT * FROM raw")}"""
)
QUALITY_TARGETS_SQL = (
    UNIVERSE_SQL
    + f""", {nation_quality_sql("u")}, uq AS (SELECT u.*, coalesce(quality, 0.5) AS quality, median(variance) OVER (PARTITION BY u.date) AS mid FROM u LEFT JOIN (SELECT date, asset, quality FROM nq) USING (date, asset)),
 raw AS (SELECT date, asset, history_end, strength::VARCHAR AS strategy, 1 / (variance + {RIDGE} + strength * mid * (1 - quality)) AS x FROM uq CROSS JOIN (SELECT unnest({list(GRID)})::DOUBLE AS strength)), {capped_sql("SELECT * FROM raw")}"""
)


def net_sql(targets: str) -> str:
    """``targets`` and the accounting of their portfolios."""
    return (
        targets
        + f""", fd AS (SELECT DISTINCT strategy, date AS formation FROM targets), rd AS (SELECT DISTINCT date FROM rets),
 seg AS (SELECT strategy, rd.date, max(formation) AS formation FROM rd JOIN fd ON formation <= rd.date GROUP BY 1, 2),
 held AS (SELECT strategy, seg.formation, seg.date, t.asset, t.weight, coalesce(r.ret, 0) AS ret, t.weight * product(1 + coalesce(r.ret, 0)) OVER (PARTITION BY strategy, seg.formation, t.asset ORDER BY seg.date ROWS UNBOUNDED PRECEDING) AS value
   FROM seg JOIN (SELECT date AS formation, asset, strategy, weight FROM targets) t USING (strategy, formation) LEFT JOIN rets r ON r.date = seg.date AND r.asset = t.asset),
 tot AS (SELECT strategy, formation, date, sum(value) AS v FROM held GROUP BY ALL),
 gross AS (SELECT *, v / coalesce(lag(v) OVER w, 1) - 1 AS gross, lead(date) OVER w IS NULL AS last FROM tot WINDOW w AS (PARTITION BY strategy, formation ORDER BY date)),
 drift AS (SELECT held.strategy, held.formation, asset, value / v AS weight FROM held JOIN gross USING (strategy, formation, date) WHERE last),
 fs AS (SELECT strategy, date AS formation, lag(date) OVER (PARTITION BY strategy ORDER BY date) AS before FROM (SELECT DISTINCT strategy, date FROM targets)),
 old AS (SELECT d.strategy, fs.formation, asset, weight AS old FROM drift d JOIN fs ON fs.strategy = d.strategy AND fs.before = d.formation),
 mv AS (SELECT strategy, formation, sum(abs(coalesce(weight, 0) - coalesce(old, 0))) AS moved FROM (SELECT strategy, date AS formation, asset, weight FROM targets) FULL JOIN old USING (strategy, formation, asset) GROUP BY 1, 2),
 turn AS (SELECT strategy, formation, CASE WHEN before IS NULL THEN 1.0 ELSE moved END AS turnover FROM mv JOIN fs USING (strategy, formation)),
 n0 AS (SELECT strategy, date, gross, CASE WHEN date = formation THEN turnover ELSE 0 END AS turnover FROM gross LEFT JOIN turn USING (strategy, formation)),
 net AS (SELECT *, {BPS} / 1e4 * turnover AS cost, (1 - {BPS} / 1e4 * turnover) * (1 + gross) - 1 AS net FROM n0)"""
    )


NET_SQL = net_sql(TARGETS_SQL)


def _universe(r):
    """Assets with a full window at the start of each quarter: variance, downside and where the history ends.

    Quarters with fewer assets than the cap needs are no formations.
    """
    w, m = prior(panel.by_asset(), LONG), prior(panel.by_asset(), MIDDLE)
    down = F.pow(F.least("ret", F.lit(0.0)), F.lit(2.0))
    rows = r.select(
        "date",
        "asset",
        F.when(F.count("ret").over(w) == LONG, F.var_samp("ret").over(w)).alias("variance"),
        clip(F.avg(down).over(m), panel.FLOOR).alias("downside"),
        F.lag("date").over(panel.by_asset()).alias("history_end"),
    )
    first = panel.first_of_period(r, "QUARTER").select(F.col("formation").alias("date"))
    formed = rows.filter("variance > 0").join(F.broadcast(first), "date", "left_semi")  # a row for each quarter
    return formed.withColumn("_n", F.count("*").over(Window.partitionBy("date"))).filter(F.col("_n") * CAP >= 1).drop("_n")


def _targets(r):
    universe = _universe(r)
    made = lambda name, penalty: ops.diagonal_minimum_variance(universe, F.col("variance"), penalty, F.lit(name), CAP)
    return ops.equal_weights(universe).unionByName(made("diagonal", F.lit(RIDGE))).unionByName(made("downside", RIDGE + DOWNSIDE * F.col("downside")))


def _quality_targets(spark, sf_dir, r):
    """A candidate for each strength of the quality penalty, and the quality that they were formed with."""
    universe = written(_universe(r))
    quality = written(nation_quality(spark, sf_dir, universe))
    known = universe.join(quality, ["date", "asset"], "left").withColumn("quality", F.coalesce("quality", F.lit(0.5)))
    candidates = known.withColumn("penalty", F.explode(F.array(*map(F.lit, GRID))))
    priced = candidates.withColumn("_p", RIDGE + ops.quality_penalty(F.col("variance"), F.col("quality"), F.col("penalty")))
    return ops.diagonal_minimum_variance(priced, F.col("variance"), F.col("_p"), F.col("penalty").cast("string"), CAP), quality


def _paths(r, targets):
    """Gross returns and turnover, from the written panel of returns and targets."""
    held = ops.holdings(r, targets, "carry")
    gross = written(ops.gross_returns(held))
    return gross, ops.turnover(targets, ops.drifted_weights(held, gross))


def _net(spark, sf_dir):
    r = written(returns(spark, sf_dir))
    targets = written(_targets(r))
    gross, turn = _paths(r, targets)
    return targets, written(ops.net_returns(gross, turn, F.lit(BPS)))


@query("portfolio_targets", f"WITH {TARGETS_SQL} SELECT date, asset, strategy, round(weight, 6) AS weight, history_end FROM targets")
def portfolio_targets(spark, sf_dir):
    """Equal and diagonal minimum-variance weights. (O-135, O-138 to O-140)"""
    return rounded(_targets(returns(spark, sf_dir)))


@query("drifted_weights", f"WITH {NET_SQL} SELECT strategy, formation, asset, round(weight, 6) AS weight FROM drift")
def drifted_weights(spark, sf_dir):
    r = returns(spark, sf_dir)
    held = ops.holdings(r, _targets(r), "carry")
    return rounded(ops.drifted_weights(held, ops.gross_returns(held)))


@query("portfolio_returns", f"WITH {NET_SQL} SELECT strategy, date, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(cost, 6) AS cost, round(net, 6) AS net FROM net")
def portfolio_returns(spark, sf_dir):
    return rounded(_net(spark, sf_dir)[1])


@query(
    "concentration",
    f"""WITH {TARGETS_SQL} SELECT strategy, date, round(sum(weight * weight), 6) AS hhi, round(1 / sum(weight * weight), 6) AS effective, count(*) FILTER (weight > 1e-8) AS active, round(max(weight), 6) AS largest, count(*) AS eligible,
 NULL::DOUBLE AS quality, abs(sum(weight) - 1) > 1e-7 AS failed FROM targets GROUP BY 1, 2""",
)
def concentration(spark, sf_dir):
    return rounded(ops.concentration(_targets(returns(spark, sf_dir))))


def metrics_sql(net: str, quality: str = "NULL::DOUBLE") -> str:
    """``net`` (the accounting) and the metric table; ``quality`` is an asset's, from a table nq joined to the targets."""
    join = " LEFT JOIN (SELECT date, asset, quality FROM nq) USING (date, asset)" if quality != "NULL::DOUBLE" else ""
    return (
        net
        + f""", b AS (SELECT strategy, count(*) AS n, product(1 + net) AS wealth, avg(net) AS mean, stddev_samp(net) AS sd, sqrt(avg(least(net, 0) * least(net, 0))) AS down,
   sum(turnover) AS turnover, sum(cost) AS total_cost FROM net GROUP BY 1),
 w1 AS (SELECT strategy, date, product(1 + net) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM net),
 dd AS (SELECT *, wealth / greatest(1, max(wealth) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM w1),
 isl AS (SELECT *, sum((dd >= 0)::INT) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM dd),
 uw AS (SELECT strategy, coalesce(max(n), 0) AS underwater FROM (SELECT strategy, island, count(*) FILTER (dd < 0) AS n FROM isl GROUP BY 1, 2) GROUP BY 1),
 md AS (SELECT strategy, -min(dd) AS max_drawdown FROM dd GROUP BY 1),
 q AS (SELECT strategy, quantile_cont(-net, 0.95) AS q95, quantile_cont(-net, 0.99) AS q99 FROM net GROUP BY 1),
 tl AS (SELECT strategy, any_value(q95) AS var95, avg(-net) FILTER (-net >= q95) AS cvar95, any_value(q99) AS var99, avg(-net) FILTER (-net >= q99) AS cvar99 FROM net JOIN q USING (strategy) GROUP BY 1),
 c1 AS (SELECT strategy, date, sum(weight * weight) AS hhi, 1 / sum(weight * weight) AS effective, count(*) FILTER (weight > 1e-8) AS active, max(weight) AS largest, sum(weight * {quality}) AS quality,
   abs(sum(weight) - 1) > 1e-7 AS failed FROM targets{join} GROUP BY 1, 2),
 cc AS (SELECT strategy, count(*) AS rebalances, avg(hhi) AS hhi, avg(effective) AS effective, avg(active) AS active, avg(largest) AS largest, avg(quality) AS quality, count(*) FILTER (failed) AS solver_failures FROM c1 GROUP BY 1),
 g AS (SELECT f.strategy, f.date, a.asset, coalesce(weight, 0) AS x FROM (SELECT DISTINCT strategy, date FROM targets) f JOIN (SELECT DISTINCT strategy, asset FROM targets) a ON a.strategy = f.strategy
   LEFT JOIN targets t ON t.strategy = f.strategy AND t.date = f.date AND t.asset = a.asset),
 st AS (SELECT strategy, date, abs(x - lag(x) OVER (PARTITION BY strategy, asset ORDER BY date)) AS d FROM g),
 tc AS (SELECT strategy, avg(l1) AS target_change FROM (SELECT strategy, date, sum(d) AS l1 FROM st WHERE d IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
 met AS (SELECT strategy, wealth - 1 AS cumulative, pow(wealth, 12.0 / n) - 1 AS cagr, mean AS mean_return, mean * 12 AS annual_mean, sd * sqrt(12) AS volatility, down * sqrt(12) AS downside, mean / sd * sqrt(12) AS sharpe,
   mean / down * sqrt(12) AS sortino, max_drawdown, (pow(wealth, 12.0 / n) - 1) / max_drawdown AS calmar, underwater, var95, cvar95, var99, cvar99, turnover * 12 / n AS annual_turnover, turnover / rebalances AS mean_turnover,
   total_cost, rebalances, hhi, effective, active, largest, target_change, solver_failures, 0::BIGINT AS fallbacks, quality
   FROM b JOIN uw USING (strategy) JOIN md USING (strategy) JOIN tl USING (strategy) JOIN cc USING (strategy) JOIN tc USING (strategy))"""
    )


METRICS_SQL = metrics_sql(NET_SQL)
QUALITY_METRICS_SQL = metrics_sql(net_sql(QUALITY_TARGETS_SQL), "coalesce(quality, 0.5)")
_DOUBLES = "cumulative cagr mean_return annual_mean volatility downside sharpe sortino max_drawdown calmar var95 cvar95 var99 cvar99 annual_turnover mean_turnover total_cost hhi effective active largest target_change quality".split()
SHOWN = f"strategy, underwater, rebalances, solver_failures, fallbacks, {', '.join(f'round({c}, 6) AS {c}' for c in _DOUBLES)}"


@query("portfolio_metrics", f"WITH {METRICS_SQL} SELECT {SHOWN} FROM met")
def portfolio_metrics(spark, sf_dir):
    targets, net = _net(spark, sf_dir)
    return rounded(ops.metrics(net, targets))


registry.FLAGSHIP = "portfolio_metrics"


def _rank(c, sign=""):
    return f"(rank() OVER (ORDER BY {sign}{c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


_SCORE = " + ".join(f"{w} * {_rank(k, '-' if k == 'sharpe' else '')}" for k, w in ops.RISK_WEIGHTS.items())


@query("risk_scores", f"WITH {METRICS_SQL} SELECT strategy, round({_SCORE}, 6) AS risk_score FROM met")
def risk_scores(spark, sf_dir):
    targets, net = _net(spark, sf_dir)
    return rounded(ops.risk_scores(ops.metrics(net, targets)))


@query(
    "metric_differences",
    f"WITH {METRICS_SQL} SELECT a.strategy, round(a.volatility - b.volatility, 6) AS volatility, round(a.cagr - b.cagr, 6) AS cagr, round(a.cvar95 - b.cvar95, 6) AS cvar95 FROM met a JOIN met b ON b.strategy = 'equal' AND a.strategy <> 'equal'",
)
def metric_differences(spark, sf_dir):
    """Each strategy against the reference one. (O-101)"""
    targets, net = _net(spark, sf_dir)
    m = ops.metrics(net, targets).select("strategy", "volatility", "cagr", "cvar95")
    base = m.filter("strategy = 'equal'").select(*(F.col(c).alias(f"b_{c}") for c in ("volatility", "cagr", "cvar95")))
    return rounded(m.filter("strategy <> 'equal'").crossJoin(F.broadcast(base)).select("strategy", *((F.col(c) - F.col(f"b_{c}")).alias(c) for c in ("volatility", "cagr", "cvar95"))))  # one row


def _quality_metrics(spark, sf_dir):
    r = written(returns(spark, sf_dir))
    targets, quality = _quality_targets(spark, sf_dir, r)
    targets = written(targets)
    gross, turn = _paths(r, targets)
    return ops.metrics(written(ops.net_returns(gross, turn, F.lit(BPS))), targets, quality)


@query("quality_backtests", f"WITH {QUALITY_METRICS_SQL} SELECT {SHOWN} FROM met")
def quality_backtests(spark, sf_dir):
    """From facts and prices to quality, penalised weights and metrics: a backtest for each strength. (O-43, O-139, O-144, O-147)"""
    return rounded(_quality_metrics(spark, sf_dir))


@query("quality_exposure", f"WITH {QUALITY_METRICS_SQL} SELECT strategy, round(quality, 6) AS exposure FROM met")
def quality_exposure(spark, sf_dir):
    """Weighted quality of each candidate, over its formations. (O-152)"""
    return rounded(_quality_metrics(spark, sf_dir).select("strategy", F.col("quality").alias("exposure")))


@query(
    "grid_selection",
    f"""WITH {QUALITY_METRICS_SQL}, sc AS (SELECT strategy, strategy::DOUBLE AS strength, {_SCORE} AS risk_score FROM met)
SELECT strength, round(risk_score, 6) AS risk_score, row_number() OVER (ORDER BY round(risk_score, 9), strength) = 1 AS selected FROM sc""",
)
def grid_selection(spark, sf_dir):
    """Candidates by the risk score of their backtests; ties go to the least intervention. (O-103, O-164)"""
    scores = ops.risk_scores(_quality_metrics(spark, sf_dir)).select(F.col("strategy").cast("double").alias("strength"), "risk_score")
    w = Window.orderBy(F.round("risk_score", 9), "strength")  # one row for each candidate
    return rounded(scores.withColumn("selected", F.row_number().over(w) == 1))


@query(
    "result_invariants",
    f"""WITH {NET_SQL} SELECT name, n FROM (VALUES ('weights_sum', (SELECT count(*) FROM (SELECT sum(weight) AS s FROM targets GROUP BY strategy, date) WHERE abs(s - 1) > 1e-7)),
 ('weights_bounds', (SELECT count(*) FROM targets WHERE weight < -1e-8 OR weight > {CAP} + 1e-7)), ('weights_unique', (SELECT count(*) FROM (SELECT 1 FROM targets GROUP BY strategy, date, asset HAVING count(*) > 1))),
 ('weights_finite', (SELECT count(*) FROM targets WHERE weight IS NULL OR NOT isfinite(weight))), ('history_prior', (SELECT count(*) FROM targets WHERE history_end IS NULL OR history_end >= date)),
 ('dates_unique', (SELECT count(*) FROM (SELECT 1 FROM net GROUP BY strategy, date HAVING count(*) > 1))),
 ('formations_traded', (SELECT count(*) FROM (SELECT DISTINCT strategy, date FROM net WHERE turnover > 0) WHERE (strategy, date) NOT IN (SELECT (strategy, date) FROM targets))),
 ('returns_finite', (SELECT count(*) FROM net WHERE NOT (isfinite(net) AND isfinite(gross) AND isfinite(turnover) AND isfinite(cost)) OR net + gross + turnover + cost IS NULL)),
 ('wealth_positive', (SELECT count(*) FROM net WHERE net <= -1)), ('costs_bounded', (SELECT count(*) FROM net WHERE turnover < 0 OR cost < 0 OR cost >= 1)),
 ('net_identity', (SELECT count(*) FROM net WHERE abs((1 - cost) * (1 + gross) - 1 - net) > 1e-12)), ('cost_identity', (SELECT count(*) FROM net WHERE abs(cost - turnover * {BPS} / 1e4) > 1e-12))) AS t(name, n)""",
)
def result_invariants(spark, sf_dir):
    """(O-145, O-146)"""
    targets, net = _net(spark, sf_dir)
    return ops.violations(net, targets, CAP, BPS / 1e4)


@query(
    "annual_report",
    f"""WITH {NET_SQL}, q AS (SELECT strategy, year(date) AS year, quantile_cont(net, 0.05) AS q FROM net GROUP BY 1, 2)
SELECT strategy, q.year::INT AS year, count(*) AS days, round(product(1 + net) - 1, 6) AS ret, round(stddev_samp(net) * sqrt(12), 6) AS volatility, round(-avg(net) FILTER (net <= q), 6) AS cvar95
FROM net JOIN q USING (strategy) WHERE q.year = year(date) GROUP BY 1, 2""",
)
def annual_report(spark, sf_dir):
    return rounded(ops.annual(_net(spark, sf_dir)[1]))


@query(
    "cost_sensitivity",
    f"""WITH {NET_SQL} SELECT strategy, bps, round(pow(product((1 - bps / 1e4 * turnover) * (1 + gross)), 12.0 / count(*)) - 1, 6) AS cagr FROM net CROSS JOIN (SELECT unnest([0.0, 10.0, 25.0, 50.0])::DOUBLE AS bps) GROUP BY 1, 2""",
)
def cost_sensitivity(spark, sf_dir):
    r = written(returns(spark, sf_dir))
    gross, turn = _paths(r, written(_targets(r)))
    return rounded(ops.cost_sensitivity(gross, turn, [0.0, 10.0, 25.0, 50.0]))


STRESS_SQL = """stress AS (SELECT date_trunc('quarter', o_orderdate)::DATE AS date, avg((o_orderstatus = 'F')::INT) AS probability FROM orders GROUP BY 1)"""


@query(
    "regime_report",
    f"""WITH {NET_SQL}, {STRESS_SQL}, d AS (SELECT DISTINCT date FROM net),
 p AS (SELECT d.date, last_value(probability IGNORE NULLS) OVER (ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS probability FROM d LEFT JOIN stress USING (date)),
 r AS (SELECT strategy, net, CASE WHEN probability < 0.5 THEN 'calm' ELSE 'stress' END AS regime FROM net JOIN p USING (date) WHERE probability IS NOT NULL)
SELECT strategy, regime, count(*) AS days, round(stddev_samp(net) * sqrt(12), 6) AS volatility, round(CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(12) END, 6) AS sharpe FROM r GROUP BY 1, 2""",
)
def regime_report(spark, sf_dir):
    stress = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "QUARTER").alias("date")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("probability"))
    return rounded(ops.by_regime(_net(spark, sf_dir)[1], stress))


#: Draws, block lengths and pairs of the bootstrap.
DRAWS, BLOCKS, PAIRS = 2_000, [10, 20, 60], [("equal", "diagonal"), ("equal", "downside"), ("diagonal", "downside")]


@query(
    "block_bootstrap",
    f"""WITH {NET_SQL}, s AS (SELECT strategy, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS p, net FROM net), len AS (SELECT max(p) + 1 AS n FROM s),
 pos AS (SELECT block, rep, b * block + o AS k, ('0x' || substr(md5(block || ':' || rep || ':' || b), 1, 8))::BIGINT % (n - block + 1) + o AS p
   FROM len, range({DRAWS}) x(rep), (SELECT unnest({BLOCKS}) AS block) q, range(100) y(b), range(60) z(o) WHERE o < block AND b < ceil(n / block::DOUBLE) AND b * block + o < n
   UNION ALL SELECT 0, -1, k, k FROM len, range(500) y(k) WHERE k < n),
 r0 AS (SELECT strategy, block, rep, k, net, -net AS loss FROM pos JOIN s USING (p)),
 ct AS (SELECT strategy, block, rep, quantile_cont(loss, 0.95) AS cut FROM r0 GROUP BY 1, 2, 3),
 r1 AS (SELECT *, product(1 + net) OVER (PARTITION BY strategy, block, rep ORDER BY k ROWS UNBOUNDED PRECEDING) AS wealth FROM r0 JOIN ct USING (strategy, block, rep)),
 r2 AS (SELECT *, wealth / greatest(1, max(wealth) OVER (PARTITION BY strategy, block, rep ORDER BY k ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM r1),
 st AS (SELECT strategy, block, rep, stddev_samp(net) * sqrt(12) AS volatility, avg(loss) FILTER (loss >= cut) AS cvar95, -min(dd) AS max_drawdown, avg(net) / stddev_samp(net) * sqrt(12) AS sharpe FROM r2 GROUP BY 1, 2, 3),
 l AS (UNPIVOT st ON volatility, cvar95, max_drawdown, sharpe INTO NAME metric VALUE x),
 d AS (SELECT b.strategy AS reference, a.strategy, block, rep, metric, a.x - b.x AS d FROM l a JOIN l b USING (block, rep, metric) WHERE (b.strategy, a.strategy) IN ({", ".join(f"{p}" for p in PAIRS)})),
 f AS (SELECT reference, strategy, metric, d AS difference FROM d WHERE rep < 0)
SELECT reference, strategy, block::INT AS block, metric, round(any_value(difference), 6) AS difference, round(quantile_cont(d, 0.025), 6) AS lower, round(quantile_cont(d, 0.975), 6) AS upper,
  quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero FROM d JOIN f USING (reference, strategy, metric) WHERE rep >= 0 GROUP BY 1, 2, 3, 4""",
)
def block_bootstrap(spark, sf_dir):
    """Differences of all pairs with 95 % intervals by block length, and whether they exclude zero. (O-150, O-151)"""
    return rounded(ops.block_bootstrap(_net(spark, sf_dir)[1], PAIRS, DRAWS, BLOCKS))


@query(
    "price_reconciliation",
    f"""WITH {BARS_SQL}, m AS (SELECT date_trunc('month', l_shipdate)::DATE AS date, sum(l_extendedprice * (1 - l_discount)) AS worth FROM lineitem GROUP BY 1),
 n AS (SELECT date, sum(price * lines) AS worth FROM bars JOIN (SELECT date_trunc('month', l_shipdate)::DATE AS date, s_nationkey::INT AS asset, count(*) AS lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) USING (date, asset) GROUP BY 1)
SELECT count(*) AS cells, count(*) FILTER (m.worth IS NULL OR n.worth IS NULL OR abs(m.worth - n.worth) > 1e-6 * abs(m.worth)) AS mismatched, round(max(abs(m.worth / n.worth - 1)), 4) AS max_error FROM m FULL JOIN n USING (date)""",
)
def price_reconciliation(spark, sf_dir):
    """Each month's shipped worth from order lines alone against that from the panel's prices, weighed by lines: a supplier lost in the join, or a line counted twice, would show. (O-52)"""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.trunc("l_shipdate", "MM").alias("date"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"))
    direct = lines.groupBy("date").agg(F.sum("paid").alias("worth"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("asset"))
    counts = lines.join(suppliers, "l_suppkey").groupBy("date", "asset").agg(F.count("*").alias("lines"))
    panel_worth = bars(spark, sf_dir).select("date", "asset", "price").join(counts, ["date", "asset"]).groupBy("date").agg(F.sum(F.col("price") * F.col("lines")).alias("worth"))
    return rounded(ops.reconciled(direct, panel_worth, ["date"], "worth", 1e-6, relative=True), 4)


@query(
    "reconciliation",
    f"""WITH {NET_SQL}, gr AS (SELECT strategy, formation, seg.date, asset, row_number() OVER (PARTITION BY strategy, formation, asset ORDER BY seg.date) AS n FROM seg JOIN (SELECT date AS formation, strategy, asset FROM targets) USING (strategy, formation)),
 st AS (SELECT strategy, formation, gr.date, gr.asset, b.price, n, (SELECT max(date) FROM bars x WHERE x.asset = gr.asset AND x.date < gr.formation) AS base FROM gr LEFT JOIN bars b ON b.date = gr.date AND b.asset = gr.asset),
 lv AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY strategy, formation, asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS p FROM st),
 ow AS (SELECT lv.strategy, lv.formation, lv.date, sum(t.weight * coalesce(lv.p, b.price) / b.price) AS v FROM lv JOIN bars b ON b.asset = lv.asset AND b.date = lv.base JOIN targets t ON t.strategy = lv.strategy AND t.date = lv.formation AND t.asset = lv.asset GROUP BY 1, 2, 3),
 again AS (SELECT strategy, date, v / coalesce(lag(v) OVER (PARTITION BY strategy, formation ORDER BY date), 1) - 1 AS gross FROM ow)
SELECT count(*) AS cells, count(*) FILTER (a.gross IS NULL OR b.gross IS NULL OR abs(a.gross - b.gross) > 1e-9) AS mismatched, round(max(abs(a.gross - b.gross)), 6) AS max_error
FROM net a FULL JOIN again b ON a.strategy = b.strategy AND a.date = b.date""",
)
def reconciliation(spark, sf_dir):
    """Gross returns against the worth of shares at prices, cell by cell; nothing of it uses returns. (O-153)

    Shares are bought at the last price before a formation, and stand at their last price on days without one.
    """
    b = written(bars(spark, sf_dir).select("date", "asset", "price"))
    r = written(panel.simple_returns(b))
    targets = written(_targets(r))
    held = ops.gross_returns(ops.holdings(r, targets, "carry")).select("strategy", "date", "gross")
    seg = ops.segments(b.select("date").distinct(), targets.select("strategy", "date").distinct())
    grid = targets.select("strategy", F.col("date").alias("formation"), "asset", "weight", "history_end").join(seg, ["strategy", "formation"])
    base = b.select("asset", F.col("date").alias("history_end"), F.col("price").alias("paid"))
    priced = grid.join(b, ["date", "asset"], "left").join(base, ["asset", "history_end"])
    upto = Window.partitionBy("strategy", "formation", "asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    worth = priced.withColumn("p", F.coalesce(F.last("price", ignorenulls=True).over(upto), "paid")).groupBy("strategy", "formation", "date").agg(F.sum(F.col("weight") * F.col("p") / F.col("paid")).alias("v"))
    before = F.coalesce(F.lag("v").over(Window.partitionBy("strategy", "formation").orderBy("date")), F.lit(1.0))
    again = worth.select("strategy", "date", (F.col("v") / before - 1).alias("gross"))
    return rounded(ops.reconciled(held, again, ["strategy", "date"], "gross", 1e-9))


@query(
    "missing_held_returns",
    f"""WITH {NET_SQL} SELECT strategy, formation, seg.date, t.asset FROM seg JOIN (SELECT date AS formation, asset, strategy FROM targets) t USING (strategy, formation)
WHERE NOT EXISTS (SELECT 1 FROM rets r WHERE r.date = seg.date AND r.asset = t.asset AND ret IS NOT NULL)""",
)
def missing_held_returns(spark, sf_dir):
    """Held assets on days without a return of theirs: what the accounting carries, and would refuse by itself. (O-145)"""
    r = written(returns(spark, sf_dir))
    return ops.missing_returns(r, _targets(r))
