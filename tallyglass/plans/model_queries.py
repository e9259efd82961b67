"""Queries over risk models and forecasts. Fits have no SQL; what surrounds them has."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyglass.operators import backtest as ops
from tallyglass.operators import forecast, panel, risk
from tallyglass.operators.experiment import audit, fingerprint
from tallyglass.operators.facts import RATIOS
from tallyglass.plans.backtest_queries import BPS, CAP, RIDGE, SHOWN, UNIVERSE_SQL, _paths, _universe, capped_sql, metrics_sql, net_sql
from tallyglass.plans.facts_queries import nation_fundamentals, nation_quality, nation_quality_sql
from tallyglass.plans.panel_queries import LONG, MARKET_SQL, MIDDLE, SHORT, returns, rounded
from tallyglass.plans.registry import EXACT, query
from tallyglass.sources.sinks import kept_by_date, kept_folder, written
from tallyglass.sources.views import RETURNS_SQL

_DENSE = "d AS (SELECT date FROM rets WHERE ret IS NOT NULL GROUP BY date HAVING count(*) = (SELECT count(DISTINCT asset) FROM rets))"


@query(
    "shrunk_covariance",
    f"""WITH {RETURNS_SQL}, {_DENSE}, c AS (SELECT date, asset, ret - avg(ret) OVER (PARTITION BY asset) AS x FROM rets JOIN d USING (date)),
 s AS (SELECT a.asset AS i, b.asset AS j, avg(a.x * b.x) AS s, avg(a.x * b.x * a.x * b.x) AS s4, count(*) AS n FROM c a JOIN c b USING (date) GROUP BY 1, 2),
 t AS (SELECT avg(s) FILTER (i = j) AS mu FROM s),
 k AS (SELECT sum((s - CASE WHEN i = j THEN mu ELSE 0 END) * (s - CASE WHEN i = j THEN mu ELSE 0 END)) AS d2, sum((s4 - s * s) / n) AS b2 FROM s, t)
SELECT i, j, round((1 - least(b2, d2) / d2) * s + least(b2, d2) / d2 * CASE WHEN i = j THEN mu ELSE 0 END, 6) AS cov, round(least(b2, d2) / d2, 6) AS shrinkage FROM s, t, k""",
)
def shrunk_covariance(spark, sf_dir):
    return rounded(risk.ledoit_wolf(returns(spark, sf_dir).filter("ret IS NOT NULL")))


@query(
    "weighted_covariance",
    f"""WITH {RETURNS_SQL}, r AS (SELECT date, asset, ret, 1.0 / (1 + date_diff('month', date, DATE '2002-01-01')) AS w FROM rets WHERE ret IS NOT NULL),
 c AS (SELECT date, asset, w, ret - sum(w * ret) OVER (PARTITION BY asset) / sum(w) OVER (PARTITION BY asset) AS x FROM r)
SELECT a.asset AS i, b.asset AS j, round(sum(a.w * a.x * b.x) / (sum(a.w) - sum(a.w * a.w) / sum(a.w)), 6) AS cov, round(sum(a.w) * sum(a.w) / sum(a.w * a.w), 6) AS n_effective
FROM c a JOIN c b ON a.date = b.date AND a.asset <= b.asset GROUP BY 1, 2""",
)
def weighted_covariance(spark, sf_dir):
    """Recent months weigh more."""
    r = returns(spark, sf_dir).filter("ret IS NOT NULL")
    months = F.months_between(F.lit("2002-01-01").cast("date"), "date")
    weights = r.select("date").distinct().select("date", (1.0 / (1 + months)).alias("w"))
    return rounded(risk.weighted_covariance(r, weights))


#: The chain of the stress filter: chances to stay calm and stressed, spreads in units of the first LONG months'.
STAY_CALM, STAY_STRESS, CALM, HOT = 0.9, 0.8, 0.75, 1.75
FILTER_SQL = (
    MARKET_SQL
    + f""", mk AS (SELECT date, market, row_number() OVER (ORDER BY date) AS n FROM market), sp AS (SELECT stddev_samp(market) AS s FROM mk WHERE n <= {LONG}),
 lk AS (SELECT date, n, exp(-market * market / (2 * {HOT} * {HOT} * s * s)) / ({HOT} * s) AS hot, exp(-market * market / (2 * {CALM} * {CALM} * s * s)) / ({CALM} * s) AS calm FROM mk, sp),
 fl AS (SELECT 0::BIGINT AS n, NULL::DATE AS date, 0.5::DOUBLE AS stress UNION ALL
   SELECT lk.n, lk.date, (stress * {STAY_STRESS} + (1 - stress) * {1 - STAY_CALM}) * hot / ((stress * {STAY_STRESS} + (1 - stress) * {1 - STAY_CALM}) * hot + (1 - (stress * {STAY_STRESS} + (1 - stress) * {1 - STAY_CALM})) * calm)
   FROM fl JOIN lk ON lk.n = fl.n + 1),
 filtered AS (SELECT date, stress FROM fl WHERE n > 0),
 fc AS (SELECT date, 0 AS k, stress AS p, 0.0::DOUBLE AS s FROM filtered UNION ALL SELECT date, k + 1, p * {STAY_STRESS} + (1 - p) * {1 - STAY_CALM}, s + p * {STAY_STRESS} + (1 - p) * {1 - STAY_CALM} FROM fc WHERE k < 21),
 forecast AS (SELECT date, s / 21 AS stress FROM fc WHERE k = 21)"""
)


def _filtered(market):
    """date, stress of the market's months."""
    w = Window.orderBy("date")  # a row for each date
    spread = market.filter("market IS NOT NULL").select("market", F.row_number().over(w).alias("n")).filter(F.col("n") <= LONG).agg(F.stddev_samp("market")).scalar()
    return risk.filtered_stress(market, CALM * spread, HOT * spread, STAY_CALM, STAY_STRESS)


def _ahead(filtered):
    """date, stress: the mean probability over the horizon, as of each date."""
    return filtered.select("date", risk.forecast_stress(F.col("stress"), F.lit(STAY_CALM), F.lit(STAY_STRESS)).alias("stress"))


@query("filtered_stress", f"WITH RECURSIVE {FILTER_SQL} SELECT date, round(stress, 6) AS stress FROM filtered")
def filtered_stress(spark, sf_dir):
    """The probability of stress given the market so far. (O-129)"""
    return rounded(_filtered(panel.market_returns(returns(spark, sf_dir))))


@query("stress_forecast", f"WITH RECURSIVE {FILTER_SQL} SELECT date, round(stress, 6) AS stress FROM forecast")
def stress_forecast(spark, sf_dir):
    """A two-state chain's mean probability of stress over the horizon. (O-130)"""
    return rounded(_ahead(_filtered(panel.market_returns(returns(spark, sf_dir)))))


@query(
    "capped_weights",
    f"""WITH RECURSIVE {RETURNS_SQL}, r AS (SELECT date, asset, 0.04 + coalesce(ret, 0) AS raw FROM rets),
 b AS (SELECT date, 0 AS k, min(raw) - 1 AS lo, max(raw) AS hi, list(raw) AS l FROM r GROUP BY 1 HAVING count(*) * 0.1 >= 1 - 1e-12
  UNION ALL SELECT date, k + 1, CASE WHEN list_sum(list_transform(l, lambda x: least(greatest(x - (lo + hi) / 2, 0), 0.1))) > 1 THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN list_sum(list_transform(l, lambda x: least(greatest(x - (lo + hi) / 2, 0), 0.1))) > 1 THEN hi ELSE (lo + hi) / 2 END, l FROM b WHERE k < 60)
SELECT r.date, asset, round(least(greatest(raw - (lo + hi) / 2, 0), 0.1), 6) AS weight FROM r JOIN b ON r.date = b.date AND k = 60""",
)
def capped_weights(spark, sf_dir):
    """Raw weights projected on the simplex with a cap of a tenth; infeasible dates drop out. (O-136, O-137)"""
    raw = returns(spark, sf_dir).select("date", "asset", (F.coalesce("ret", F.lit(0.0)) + 0.04).alias("raw"))
    rows = raw.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("asset", "raw"))).alias("x"))
    w = rows.withColumn("w", risk.capped_weights(F.transform("x", lambda e: e["raw"]), 0.1)).filter("w IS NOT NULL")
    return rounded(w.select("date", F.explode(F.arrays_zip(F.transform("x", lambda e: e["asset"]).alias("asset"), F.col("w").alias("weight"))).alias("z")).select("date", "z.asset", "z.weight"))


def _formation_panel(spark, sf_dir):
    """Each quarter's formation with its window of complete days before it."""
    r = written(returns(spark, sf_dir))
    market = panel.market_features(panel.market_returns(r), 3, LONG).select("date", "market", F.col("realized_volatility").alias("volatility")).filter("volatility IS NOT NULL")
    dense = r.join(panel.complete_dates(r), "date", "left_semi").join(market, "date").select(F.col("date").alias("at"), "asset", "ret", "market", "volatility")
    forms = panel.first_of_period(r, "QUARTER").select(F.col("formation").alias("date"))
    # a day meets the quarters whose window may hold it: its own and those of the window's length after it
    quarter = lambda c: F.year(c) * 4 + F.quarter(c)
    met = dense.withColumn("_q", F.explode(F.sequence(quarter("at"), quarter("at") + LONG))).join(forms.withColumn("_q", quarter("date")), "_q").drop("_q")
    window = met.filter((F.col("at") < F.col("date")) & (F.col("at") >= F.add_months("date", -3 * LONG)))
    full = window.groupBy("date").agg(F.count_distinct("at").alias("n")).filter(F.col("n") >= 2 * LONG).select("date")
    held = window.join(full, "date", "left_semi")
    feasible = held.groupBy("date").agg(F.count_distinct("asset").alias("n")).filter(F.col("n") * CAP >= 1).select("date")  # O-137
    quality = nation_quality(spark, sf_dir, full).select("date", "asset", (1 - F.col("quality")).alias("penalty"))
    return held.join(feasible, "date", "left_semi").join(quality, ["date", "asset"], "left").fillna({"penalty": 0.5})


@query("regime_allocations")
def regime_allocations(spark, sf_dir):
    """Minimum-variance weights from shrunk, regime and penalised covariances. (O-126 to O-135)

    Formations are kept by date under the content of their windows, so that a new one costs one fit. (O-134)
    """
    windows = written(_formation_panel(spark, sf_dir))
    content = {"windows": fingerprint(windows, ["date", "at", "asset"]), "cap": CAP}
    make = lambda dates: risk.allocate(windows.join(dates, "date", "left_semi"), CAP)
    return rounded(kept_by_date(make, windows.select("date"), kept_folder(spark, "allocations"), content))


def _features(spark, sf_dir):
    r = returns(spark, sf_dir)
    stats = panel.prior_statistics(r, 3, MIDDLE, LONG)
    labels = panel.forward_labels(r, 4)
    both = stats.join(labels, ["date", "asset"])
    return forecast.targets(both, "future_downside", f"downside_{MIDDLE}")


FEATURES_SQL = (
    RETURNS_SQL
    + f""", st AS (SELECT date, asset, CASE WHEN count(ret) OVER w = {MIDDLE} THEN greatest(avg(least(ret, 0) * least(ret, 0)) OVER w, 1e-10) END AS downside_{MIDDLE},
   CASE WHEN count(ret) OVER x = 4 THEN greatest(avg(least(ret, 0) * least(ret, 0)) OVER x, 1e-10) END AS future_downside, CASE WHEN count(ret) OVER x = 4 THEN max(date) OVER x END AS label_end
   FROM rets WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN {MIDDLE} PRECEDING AND 1 PRECEDING), x AS (PARTITION BY asset ORDER BY date ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
 tg AS (SELECT *, ln(future_downside / downside_{MIDDLE}) AS target FROM st),
 yr AS (SELECT year(date) AS year, min(date) AS cutoff FROM st GROUP BY 1 HAVING year(date) >= 1996),
 tr AS (SELECT * FROM tg JOIN yr ON date < cutoff AND label_end < cutoff WHERE target IS NOT NULL)"""
)


@query("risk_targets", f"WITH {FEATURES_SQL} SELECT date, asset, round(target, 6) AS target, label_end FROM tg")
def risk_targets(spark, sf_dir):
    """(O-155)"""
    return rounded(_features(spark, sf_dir).select("date", "asset", "target", "label_end"))


@query("training_audit", f"WITH {FEATURES_SQL} SELECT year::INT AS year, max(cutoff) AS cutoff, count(*) AS n, count(DISTINCT date) AS dates, max(date) AS last_formation, max(label_end) AS last_label_end FROM tr GROUP BY 1")
def training_audit(spark, sf_dir):
    """(O-156, O-157)"""
    p = _features(spark, sf_dir)
    return forecast.training_audit(forecast.purged(p, forecast.cutoffs(p, 1996)))


#: Columns of the feature panel; each set holds the one before it. (O-162)
PRICE = [*(f"{x}_{n}" for x in ("momentum", "volatility") for n in (SHORT, MIDDLE, LONG)), f"reversal_{SHORT}", f"downside_{MIDDLE}", f"skew_{LONG}", f"drawdown_{MIDDLE}", f"drawdown_{LONG}"]
OWN = len(PRICE)
PRICE += ["beta", "correlation", "residual_volatility", "relative_momentum", "baseline_variance", "regime_variance", "stress_probability", "market_volatility", "market_drawdown", "market_correlation"]
FUNDAMENTAL = [*RATIOS, "revenue_growth", "log_assets", "score", "coverage"]
EXTRA = ["log_dollar_volume", "relative_volume", "illiquidity", "range", "report_age", "filing_lag", "annual_age", "amended", "known_filings", "missing", "month_sin", "month_cos"]
FEATURE_SETS = {"price": PRICE, "plus_fundamentals": PRICE + FUNDAMENTAL, "full": PRICE + FUNDAMENTAL + EXTRA}


def _feature_panel(spark, sf_dir):
    """All features of each asset at the start of each quarter, its label and the dates that both rest on. (O-154)"""
    r = written(returns(spark, sf_dir))
    universe = written(_universe(r))
    return _panel(r, universe, nation_fundamentals(spark, sf_dir, universe))


def _panel(r, formed, fundamentals):
    """The feature panel of the written returns, their universe and its fundamentals."""
    market = written(panel.market_returns(r))
    universe = formed.select("date", "asset", "history_end", F.col("variance").alias("baseline_variance"))
    filtered = written(_filtered(market))
    state = panel.market_features(market, MIDDLE, LONG).join(panel.average_correlation(r, LONG), "date", "left").join(_ahead(filtered), "date", "left")
    w = Window.orderBy("date")  # a row for each date
    next_ = written(state.select(
        F.lead("date").over(w).alias("date"),
        F.col("stress").alias("stress_probability"),
        F.col("realized_volatility").alias("market_volatility"),
        F.col("drawdown").alias("market_drawdown"),
        F.col("average_correlation").alias("market_correlation"),
    ).filter("date IS NOT NULL"))
    angle = F.lit(2.0) * F.pi() * F.month("date") / 12
    out = universe
    for part in (
        panel.prior_statistics(r, SHORT, MIDDLE, LONG),
        panel.market_exposure(r, market, LONG),
        panel.activity(r.drop("ret"), r, SHORT, LONG),
        panel.forward_labels(r, HORIZON),
        risk.regime_variance(r, filtered, next_.select("date", "stress_probability"), LONG),
    ):
        out = out.join(part, ["date", "asset"], "left")
    out = out.join(F.broadcast(next_), "date", "left")  # a row for each date
    out = out.join(fundamentals, ["date", "asset"], "left")
    out = out.withColumn("month_sin", F.sin(angle)).withColumn("month_cos", F.cos(angle))
    return forecast.targets(out, "future_downside", f"downside_{MIDDLE}").select("date", "asset", "history_end", "information_date", "latest_used_available", *FEATURE_SETS["full"], "future_downside", "label_end", "target")


HORIZON = 4
PANEL_SQL = f"""SELECT u.date, u.asset, history_end, information_date, latest_used_available, u.variance AS baseline_variance, {", ".join(f"p.{c}" for c in PRICE[:OWN])}, rv.regime_variance, x.* EXCLUDE (date, asset), stress_probability, market_volatility, market_drawdown,
 market_correlation, nq.* EXCLUDE (date, asset, quality, information_date, latest_used_available), a.* EXCLUDE (date, asset), sin(2 * pi() * month(u.date) / 12) AS month_sin, cos(2 * pi() * month(u.date) / 12) AS month_cos, future_downside, label_end,
 ln(future_downside / p.downside_{MIDDLE}) AS target
FROM u LEFT JOIN ({EXACT["prior_statistics"]}) p USING (date, asset) LEFT JOIN ({EXACT["market_exposure"]}) x USING (date, asset) LEFT JOIN ({EXACT["activity_features"]}) a USING (date, asset) LEFT JOIN ({EXACT["forward_labels"]}) f USING (date, asset)
 LEFT JOIN st USING (date) LEFT JOIN nq USING (date, asset) LEFT JOIN rv USING (date, asset)"""
# the filter's tables stand behind the universe's, which has the returns already
PANEL_WITH = f"""{UNIVERSE_SQL}, {nation_quality_sql("u")}, {FILTER_SQL.removeprefix(RETURNS_SQL + ", ")},
 st AS (SELECT lead(m.date) OVER (ORDER BY m.date) AS date, f.stress AS stress_probability, realized_volatility AS market_volatility, drawdown AS market_drawdown,
  average_correlation AS market_correlation FROM ({EXACT["market_features"]}) m LEFT JOIN ({EXACT["average_correlation"]}) USING (date) LEFT JOIN forecast f USING (date)),
 rw AS (SELECT r.date, r.asset, ret, f.stress AS p, q.stress_probability AS q FROM rets r LEFT JOIN filtered f USING (date) LEFT JOIN st q USING (date)),
 rs AS (SELECT date, asset, q, count(CASE WHEN ret IS NOT NULL THEN p END) OVER w AS n, sum(CASE WHEN ret IS NOT NULL THEN p END) OVER w AS w1, sum(p * ret) OVER w AS a1, sum(p * ret * ret) OVER w AS b1,
   sum(CASE WHEN ret IS NOT NULL THEN 1 - p END) OVER w AS w0, sum((1 - p) * ret) OVER w AS a0, sum((1 - p) * ret * ret) OVER w AS b0 FROM rw WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN {LONG} PRECEDING AND 1 PRECEDING)),
 rv AS (SELECT date, asset, CASE WHEN n = {LONG} THEN q * greatest(b1 / w1 - (a1 / w1) * (a1 / w1), 0) + (1 - q) * greatest(b0 / w0 - (a0 / w0) * (a0 / w0), 0) END AS regime_variance FROM rs)"""


@query(
    "feature_panel",
    f"""WITH RECURSIVE {PANEL_WITH}, p0 AS ({PANEL_SQL}) SELECT date, asset, history_end, information_date, latest_used_available, label_end, {", ".join(f"round({c}, 5) + 0 AS {c}" for c in (*FEATURE_SETS["full"], "future_downside", "target"))} FROM p0""",
)
def feature_panel(spark, sf_dir):
    """Prices, market, activity, calendar and fundamentals of each asset and formation, and its label. (O-154)"""
    return rounded(_feature_panel(spark, sf_dir), 5)


@query(
    "feature_panel_checks",
    f"""WITH RECURSIVE {PANEL_WITH}, p0 AS ({PANEL_SQL}), c AS (SELECT (SELECT count(*) FROM (SELECT 1 FROM p0 GROUP BY date, asset HAVING count(*) > 1)) AS repeated_keys, count(*) FILTER (history_end IS NULL OR history_end >= date) AS history_not_prior,
 count(*) FILTER (information_date >= date) AS information_not_prior, count(*) FILTER (latest_used_available > information_date) AS filing_not_available, count(*) FILTER (label_end < date) AS label_before_date,
 count(*) FILTER (information_date IS NULL) AS no_snapshot FROM p0)
SELECT name, n, n = 0 AS passed FROM (UNPIVOT c ON COLUMNS(*) INTO NAME name VALUE n)""",
)
def feature_panel_checks(spark, sf_dir):
    """Rows that break a guard of the panel: keys, order of dates, missing snapshots. (O-154)"""
    p = written(_feature_panel(spark, sf_dir))
    return audit(
        {
            "repeated_keys": p.groupBy("date", "asset").count().filter("count > 1"),
            "history_not_prior": p.filter("history_end IS NULL OR history_end >= date"),
            "information_not_prior": p.filter("information_date >= date"),
            "filing_not_available": p.filter("latest_used_available > information_date"),
            "label_before_date": p.filter("label_end < date"),
            "no_snapshot": p.filter("information_date IS NULL"),
        }
    )


#: The first year with forecasts, and the rows that must have matured before it (the months of nations are few).
FIRST_YEAR, LEAST = 1998, 50
#: Trees of a fit here: the library's default is 300, of which each is a handful of Spark jobs whatever the rows.
TREES = 60
#: Candidates: depths of the trees, strengths of the forecast's penalty; the strength of the quality penalty.
DEPTHS, ETAS, STRENGTH = (4, 6), (0.0, 0.25, 0.5, 1.0), 0.5


def _predicted(p, name="full", depth=DEPTHS[0]):
    """Forecasts and importances by the trees of a feature set; fits are kept beside the shared folder, so queries that need the same one make it once."""
    kept = kept_folder(p.sparkSession, "models")
    return forecast.walk_forward(p, forecast.cutoffs(p, FIRST_YEAR), FEATURE_SETS[name], depth, TREES, least=LEAST, model_dir=kept)


def _variances(p, depth=DEPTHS[0]):
    """date, asset, depth, cutoff, last_label_end, variance: the forecasts of a depth as variances."""
    trailing = f"downside_{MIDDLE}"
    joined = _predicted(p, depth=depth)[0].join(p.select("date", "asset", trailing), ["date", "asset"])
    return forecast.as_variance(joined, trailing).select("date", "asset", F.lit(depth).alias("depth"), "year", "cutoff", "last_label_end", "predicted", "variance")


@query("risk_forecasts")
def risk_forecasts(spark, sf_dir):
    """Walk-forward boosted trees on the whole feature panel, as variances, with what each was fitted on. (O-158, O-159)"""
    return rounded(_variances(written(_feature_panel(spark, sf_dir))))


@query("forecast_importance")
def forecast_importance(spark, sf_dir):
    """What each year's trees rest on. (O-160)"""
    return rounded(_predicted(written(_feature_panel(spark, sf_dir)))[1])


@query("feature_ablation")
def feature_ablation(spark, sf_dir):
    """Forecast errors by feature set. (O-161, O-162)"""
    p = written(_feature_panel(spark, sf_dir))
    out = None
    for name in FEATURE_SETS:
        predicted, _ = _predicted(p, name)
        row = forecast.diagnostics(predicted.join(p.select("date", "asset", "target"), ["date", "asset"])).select(F.lit(name).alias("features"), "*")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


def _candidates(spark, sf_dir):
    """(returns, rows of all assets, formations and candidates, forecasts): the candidate axis of one plan. (O-140, O-164)

    A forecast meets the formation of its own date; that its fit knew nothing later is what ``forecast.leaks`` tells.
    The control of no strength is there once.
    """
    r = written(returns(spark, sf_dir))
    universe = written(_universe(r))
    fundamentals = written(nation_fundamentals(spark, sf_dir, universe))  # the panel and the candidates rest on the same
    quality = fundamentals.select("date", "asset", "quality")
    known = written(universe.filter(F.year("date") >= FIRST_YEAR).join(quality, ["date", "asset"], "left").withColumn("quality", F.coalesce("quality", F.lit(0.5))))
    p = written(_panel(r, universe, fundamentals))
    variances = _variances(p, DEPTHS[0])
    for depth in DEPTHS[1:]:
        variances = variances.unionByName(_variances(p, depth))
    axis = [(d, e) for d in DEPTHS for e in ETAS if e or d == DEPTHS[0]]
    listed = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.lit(e).alias("eta")) for d, e in axis)))
    return r, known.select("*", listed.alias("_c")).select(*known.columns, "_c.*"), written(variances)


def _backtest(r, rows, penalty, name):
    """Targets, net returns and metrics of strategies that stand below each other in ``rows``."""
    priced = rows.withColumn("_p", RIDGE + penalty)
    targets = written(ops.diagonal_minimum_variance(priced, F.col("variance"), F.col("_p"), name, CAP))
    gross, turn = _paths(r, targets)
    net = written(ops.net_returns(gross, turn, F.lit(BPS)))
    return targets, net, ops.metrics(net, targets, rows.select("date", "asset", "quality").distinct())


def _required(forecasts, eta):
    """The forecast's penalty; a forecast that is missing where it counts ends the run."""
    bad = forecasts.isNull() | F.isnan(forecasts) | (forecasts < 0)
    return F.when(eta == 0, 0.0).when(bad, F.raise_error(F.lit("an asset has no forecast of its risk")).cast("double")).otherwise(eta * forecasts)


def _grid(spark, sf_dir):
    """(targets, net returns, metrics) of all candidates, and the rows and forecasts that they rest on."""
    r, rows, variances = _candidates(spark, sf_dir)
    met = rows.join(variances.select("date", "asset", "depth", F.col("variance").alias("forecast")), ["date", "asset", "depth"], "left")
    penalty = ops.quality_penalty(F.col("variance"), F.col("quality"), F.lit(STRENGTH)) + _required(F.col("forecast"), F.col("eta"))
    return *_backtest(r, met, penalty, F.concat_ws(";", F.col("depth").cast("string"), F.col("eta").cast("string"))), rows, variances


@query("forecast_grid")
def forecast_grid(spark, sf_dir):
    """Depth x strength: from panel to forecasts to penalised weights to net returns, metrics and risk score, for seven candidates. (O-103, O-140, O-164)

    Ties go to the least intervention: the lower strength, then the lower depth.
    """
    table = written(_grid(spark, sf_dir)[2])
    scored = ops.risk_scores(table).join(table, "strategy")
    parts = F.split("strategy", ";")
    named = scored.select(parts[0].cast("int").alias("depth"), parts[1].cast("double").alias("eta"), "risk_score", "volatility", "cvar95", "max_drawdown", "annual_turnover", "hhi", "sharpe", "cagr", "quality")
    w = Window.orderBy(F.round("risk_score", 9), "eta", "depth")  # one row for each candidate
    return rounded(named.withColumn("selected", F.row_number().over(w) == 1))


@query("forecast_portfolios")
def forecast_portfolios(spark, sf_dir):
    """Daily accounting of each candidate. (O-140, O-141)"""
    return rounded(_grid(spark, sf_dir)[1])


@query("forecast_checks")
def forecast_checks(spark, sf_dir):
    """Rows of forecast portfolios that break the order of time or an invariant, and whether no strength is no change. (O-140, O-146, O-167)"""
    targets, net, _, rows, variances = _grid(spark, sf_dir)
    first = DEPTHS[0]
    used = rows.filter((F.col("depth") == first) & (F.col("eta") == 0))
    checks = {f"depth_{d}_{k}": df for d in DEPTHS for k, df in forecast.leaks(variances.filter(F.col("depth") == d), used).items()}
    zero = targets.filter(F.col("strategy") == f"{first};0.0")
    penalty = RIDGE + ops.quality_penalty(F.col("variance"), F.col("quality"), F.lit(STRENGTH))
    plain = ops.diagonal_minimum_variance(used.withColumn("_p", penalty), F.col("variance"), F.col("_p"), F.lit("x"), CAP)
    both = zero.select("date", "asset", F.col("weight").alias("a")).join(plain.select("date", "asset", F.col("weight").alias("b")), ["date", "asset"], "full")
    checks["zero_strength_changes"] = both.filter("a IS NULL OR b IS NULL OR abs(a - b) > 1e-11")
    broken = ops.violations(net, targets, CAP, BPS / 1e4).select("name", "n", (F.col("n") == 0).alias("passed"))
    return audit(checks).unionByName(broken)


#: Controls: (name, quality penalty's score, whether the trailing downside is a penalty too).
CONTROLS = {"plain": ("1.0", 0), "neutral": ("0.5", 0), "quality": ("quality", 0), "quality_downside": ("quality", 1)}
CONTROL_SQL = (
    f"{UNIVERSE_SQL}, {nation_quality_sql('u')}, uq AS (SELECT u.*, coalesce(quality, 0.5) AS quality, median(variance) OVER (PARTITION BY u.date) AS mid FROM u LEFT JOIN (SELECT date, asset, quality FROM nq) USING (date, asset)), raw AS ("
    + " UNION ALL ".join(f"SELECT date, asset, history_end, '{k}' AS strategy, 1 / (variance + {RIDGE} + {STRENGTH} * mid * (1 - {q}) + {d} * downside) AS x FROM uq" for k, (q, d) in CONTROLS.items())
    + f"), {capped_sql('SELECT * FROM raw')}"
)


def _controls(known):
    """The rows of the controls, told apart by ``strategy``: score and eta are what their penalties take."""
    sides = [F.struct(F.lit(k).alias("strategy"), F.expr(q).cast("double").alias("score"), F.lit(float(d)).alias("eta"), F.col("downside").alias("risk")) for k, (q, d) in CONTROLS.items()]
    return known.select("*", F.explode(F.array(*sides)).alias("_c")).select(*known.columns, "_c.*")


def _controlled(r, rows):
    penalty = ops.quality_penalty(F.col("variance"), F.col("score"), F.lit(STRENGTH)) + F.col("eta") * F.col("risk")
    return _backtest(r, rows, penalty, F.col("strategy"))[2]


@query("penalty_controls", f"WITH {metrics_sql(net_sql(CONTROL_SQL), 'coalesce(quality, 0.5)')} SELECT {SHOWN} FROM met")
def penalty_controls(spark, sf_dir):
    """No penalty, a neutral score, the quality score, and the trailing downside beside it: what each adds. (O-163)"""
    r = written(returns(spark, sf_dir))
    universe = written(_universe(r))
    quality = nation_quality(spark, sf_dir, universe)
    known = written(universe.join(quality, ["date", "asset"], "left").withColumn("quality", F.coalesce("quality", F.lit(0.5))))
    return rounded(_controlled(r, _controls(known)))


@query("forecast_controls")
def forecast_controls(spark, sf_dir):
    """The controls and the forecasts at the same strength, on the same formations. (O-140, O-163)"""
    r, rows, variances = _candidates(spark, sf_dir)
    known = rows.filter((F.col("depth") == DEPTHS[0]) & (F.col("eta") == 0)).drop("depth", "eta")
    first = variances.filter(F.col("depth") == DEPTHS[0]).select("date", "asset", F.col("variance").alias("risk"))
    forecasts = known.join(first, ["date", "asset"], "left").select(*known.columns, F.lit("quality_forecast").alias("strategy"), F.col("quality").alias("score"), F.lit(1.0).alias("eta"), _required(F.col("risk"), F.lit(1.0)).alias("risk"))
    return rounded(_controlled(r, _controls(known).unionByName(forecasts)))


@query(
    "naive_diagnostics",
    f"""WITH {FEATURES_SQL}, s AS (SELECT date, asset, target, lag(target, 4) OVER (PARTITION BY asset ORDER BY date) AS predicted FROM tg), m AS (SELECT * FROM s WHERE target IS NOT NULL AND predicted IS NOT NULL),
 k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY target) + (count(*) OVER (PARTITION BY date, target) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY predicted) + (count(*) OVER (PARTITION BY date, predicted) - 1) / 2.0 AS b FROM m),
 c AS (SELECT date, CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END AS ic FROM k GROUP BY 1)
SELECT n, round(rmse, 6) AS rmse, round(mean_ic, 6) AS mean_ic, round(median_ic, 6) AS median_ic FROM (SELECT count(*) AS n, sqrt(avg((target - predicted) * (target - predicted))) AS rmse FROM m), (SELECT avg(ic) AS mean_ic, quantile_cont(ic, 0.5) AS median_ic FROM c)""",
)
def naive_diagnostics(spark, sf_dir):
    """The control forecast: what was known a label's length ago. (O-161, O-163)"""
    p = _features(spark, sf_dir)
    return rounded(forecast.diagnostics(p.select("date", "asset", "target", F.lag("target", 4).over(panel.by_asset()).alias("predicted"))))
