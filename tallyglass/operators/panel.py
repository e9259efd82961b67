"""Operators on a long panel (date, asset, ...): returns, strictly prior windows, labels, activity.

Every window is partitioned by asset and ordered by date, so that one shuffle by asset
serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyglass.functions.columns import clip, full, prior, unbiased_skew

PERIODS = 12
FLOOR = 1e-10


def by_asset() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("date")


def simple_returns(bars: DataFrame) -> DataFrame:
    """``bars`` with ret, the price's relative change; the first is null. (O-80)"""
    return bars.withColumn("ret", F.col("price") / F.lag("price").over(by_asset()) - 1)


def market_returns(returns: DataFrame) -> DataFrame:
    """date, market: the equal-weighted mean return. (O-88)"""
    return returns.filter("ret IS NOT NULL").groupBy("date").agg(F.avg("ret").alias("market"))


def growth(ret: Column) -> Column:
    return F.product(1 + ret)


def prior_statistics(returns: DataFrame, short: int, middle: int, long: int) -> DataFrame:
    """Momentum, reversal, volatility, downside, skew and drawdown of the rows before each date. (O-81, O-83 to O-87)"""
    r, w = F.col("ret"), by_asset()
    down = F.pow(F.least(r, F.lit(0.0)), F.lit(2.0))
    at = {n: prior(w, n) for n in (short, middle, long)}
    scale = F.sqrt(F.lit(float(PERIODS)))
    return returns.select(
        "date",
        "asset",
        *((full(growth(r), at[n], n, r) - 1).alias(f"momentum_{n}") for n in (short, middle, long)),
        (1 - full(growth(r), at[short], short, r)).alias(f"reversal_{short}"),
        *((full(F.stddev_samp(r), at[n], n, r) * scale).alias(f"volatility_{n}") for n in (short, middle, long)),
        clip(full(F.avg(down), at[middle], middle, r), FLOOR).alias(f"downside_{middle}"),
        F.when(F.count(r).over(at[long]) == long, unbiased_skew(r, at[long])).alias(f"skew_{long}"),
        *((F.lag("price").over(w) / full(F.max("price"), at[n], n, F.col("price")) - 1).alias(f"drawdown_{n}") for n in (middle, long)),
    )


def market_exposure(returns: DataFrame, market: DataFrame, n: int) -> DataFrame:
    """Beta, correlation, residual volatility and relative momentum against the market, over n prior rows. (O-88, O-89)"""
    r, m, w = F.col("ret"), F.col("market"), prior(by_asset(), n)
    joined = returns.join(market, "date", "left")
    both = F.when(r.isNotNull() & m.isNotNull(), r)
    var_m, var_r = F.var_samp(m).over(w), F.var_samp(r).over(w)
    beta = F.covar_samp(r, m).over(w) / var_m
    ok = (F.count(both).over(w) == n) & (var_m > 0)
    return joined.select(
        "date",
        "asset",
        F.when(ok, beta).alias("beta"),
        F.when(ok & (var_r > 0), F.covar_samp(r, m).over(w) / F.sqrt(var_m * var_r)).alias("correlation"),
        F.when(ok, F.sqrt(F.greatest(var_r - beta * beta * var_m, F.lit(0.0)))).alias("residual_volatility"),
        F.when(ok, growth(r).over(w) - growth(m).over(w)).alias("relative_momentum"),
    )


def forward_labels(returns: DataFrame, horizon: int) -> DataFrame:
    """Mean squared loss over the current and the next rows, ``horizon`` in all, and the last one's date; null unless all are there. (O-82)"""
    w = by_asset().rowsBetween(0, horizon - 1)
    loss = F.pow(F.least(F.col("ret"), F.lit(0.0)), F.lit(2.0))
    there = F.count("ret").over(w) == horizon
    return returns.select(
        "date", "asset", F.when(there, F.greatest(F.avg(loss).over(w), F.lit(FLOOR))).alias("future_downside"), F.when(there, F.max("date").over(w)).alias("label_end")
    )


def activity(bars: DataFrame, returns: DataFrame, short: int, long: int) -> DataFrame:
    """Log dollar volume, relative volume, illiquidity and range over prior rows. (O-113 to O-116)"""
    both = bars.join(returns.select("date", "asset", "ret"), ["date", "asset"])
    dollar = F.col("volume") * F.col("close")
    s, l_ = prior(by_asset(), short), prior(by_asset(), long)
    usual = F.avg("volume").over(l_)
    enough = F.count("volume").over(l_) == long
    return both.select(
        "date",
        "asset",
        F.when(enough, F.log1p(F.avg(dollar).over(s))).alias("log_dollar_volume"),
        F.when(enough & (usual > 0), F.avg("volume").over(s) / usual).alias("relative_volume"),
        F.when(enough, F.avg(F.when(dollar > 0, F.abs(F.col("ret")) / dollar)).over(s) * 1e6).alias("illiquidity"),
        F.when(enough, F.avg((F.col("high") - F.col("low")) / F.col("close")).over(s)).alias("range"),
    )


def calendar(bars: DataFrame) -> DataFrame:
    """date, session_no, previous: the sorted sessions; one row for each date, so one task holds them. (D4, O-41)"""
    dates, w = bars.select("date").distinct(), Window.orderBy("date")
    return dates.select("date", F.row_number().over(w).alias("session_no"), F.lag("date").over(w).alias("previous"))


def first_of_period(dates: DataFrame, period: str) -> DataFrame:
    """The first observed session of each month ("MM") or quarter ("QUARTER"). (O-109)"""
    return dates.groupBy(F.trunc("date", period).alias("period")).agg(F.min("date").alias("formation"))


def market_features(market: DataFrame, n: int, drawdown: int) -> DataFrame:
    """Rolling volatility (n rows needed) and drawdown of the market's wealth, current row included. (O-90)

    ``market`` has one row for each date, so its windows are small.
    """
    w = Window.orderBy("date")
    wealth = market.withColumn("wealth", growth(F.col("market")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return wealth.select(
        "date",
        "market",
        full(F.stddev_samp("market"), w.rowsBetween(1 - n, 0), n, F.col("market")).alias("realized_volatility"),
        (F.col("wealth") / F.max("wealth").over(w.rowsBetween(1 - drawdown, 0)) - 1).alias("drawdown"),
    )


def average_correlation(returns: DataFrame, n: int) -> DataFrame:
    """Mean correlation of all pairs of assets over the last n rows, by date. (O-91)

    With returns standardised within the window, the sum of all correlations is
    sum_t (sum_i z_it)^2 / (n - 1); so each window costs assets * n, not pairs * n.
    """
    w = by_asset().rowsBetween(1 - n, 0)
    last = returns.filter("ret IS NOT NULL").withColumn("mean", F.avg("ret").over(w)).withColumn("sd", F.stddev_samp("ret").over(w)).withColumn("seen", F.collect_list("ret").over(w))
    z = last.filter(F.size("seen") == n).select("date", "asset", F.posexplode("seen").alias("t", "x"), "mean", "sd")
    sums = z.filter("sd > 0").groupBy("date", "t").agg(F.sum((F.col("x") - F.col("mean")) / F.col("sd")).alias("s"), F.count("*").alias("assets"))
    return sums.groupBy("date").agg(F.max("assets").alias("assets"), (F.sum(F.col("s") * F.col("s")) / (n - 1)).alias("total")).filter("assets > 1").select(
        "date", ((F.col("total") - F.col("assets")) / (F.col("assets") * (F.col("assets") - 1))).alias("average_correlation")
    )


def running_drawdown(series: DataFrame, by: str, ret: str) -> DataFrame:
    """wealth and drawdown from the highest wealth so far, the start's 1 included. (O-92)"""
    w = Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    wealth = series.withColumn("wealth", growth(F.col(ret)).over(w))
    return wealth.withColumn("drawdown", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(w)) - 1)


def underwater_length(drawdowns: DataFrame, by: str) -> DataFrame:
    """The longest run of dates below the peak. (O-93)"""
    w = Window.partitionBy(by).orderBy("date")
    island = F.sum((F.col("drawdown") >= 0).cast("int")).over(w)
    runs = drawdowns.withColumn("island", island).filter("drawdown < 0").groupBy(by, "island").count()
    return drawdowns.select(by).distinct().join(runs.groupBy(by).agg(F.max("count").alias("n")), by, "left").select(by, F.coalesce("n", F.lit(0)).alias("underwater"))


def complete_dates(returns: DataFrame) -> DataFrame:
    """Dates on which every asset has a value. (O-32)"""
    assets = returns.agg(F.count_distinct("asset").alias("assets"))
    return returns.groupBy("date").agg(F.count("ret").alias("n")).crossJoin(F.broadcast(assets)).filter("n = assets").select("date")  # one row


def eligibility(returns: DataFrame, n: int, least: int, missing: float) -> DataFrame:
    """date, asset, seen, joint where the n sessions before have ``least`` returns, few missing, and a price, for enough joint rows. (O-125)

    Sessions are those of the whole panel. ``joint`` counts the sessions of the window on which every eligible asset of
    the date has a return; dates where that is below ``least`` have no eligible assets. Each asset's returns are a string of
    bits by session, so the joint count is an AND over assets of n bits, not a join of assets with sessions.
    """
    cal = calendar(returns).select("date", "session_no")
    numbered = returns.join(cal, "date").withColumn("_there", F.when(F.col("ret").isNotNull(), F.col("session_no")))
    w = Window.partitionBy("asset").orderBy("session_no").rangeBetween(-n, -1)
    before = Window.partitionBy("asset").orderBy("session_no").rowsBetween(Window.unboundedPreceding, -1)
    marked = numbered.select("date", "asset", "session_no", F.collect_list("_there").over(w).alias("at"), F.last("price").over(before).alias("last"))
    rows = marked.select("*", F.size("at").alias("seen"), F.least(F.col("session_no") - 1, F.lit(n)).alias("window"))
    fit = rows.filter((F.col("seen") >= least) & (F.col("window") - F.col("seen") <= missing * F.col("window")) & (F.col("last") > 0))
    # 60 sessions to a word: the k-th session before the date is bit (k - 1) % 60 of word (k - 1) / 60
    words = -(-n // 60)
    bit = lambda at: F.col("session_no") - at - 1

    def word(k):
        own = F.filter("at", lambda at: F.floor(bit(at) / 60) == k)
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, at: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (bit(at) % 60).cast("int"))))

    bits = fit.select("date", "asset", "seen", *(word(k).alias(f"_w{k}") for k in range(words)))
    joint = bits.groupBy("date").agg(*(F.bit_and(f"_w{k}").alias(f"_w{k}") for k in range(words)))
    counted = joint.select("date", sum((F.bit_count(f"_w{k}") for k in range(words)), F.lit(0)).alias("joint"))
    return fit.join(counted.filter(F.col("joint") >= least), "date").select("date", "asset", "seen", "joint")


def latest_before(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """``left`` (date) with the last non-null ``value`` of ``right`` (date, value) strictly before. (O-44)

    Both sides are series of dates (one row each), merged in one window.
    """
    both = left.select("date", F.lit(1).alias("ask"), F.lit(None).cast("double").alias(value)).unionByName(right.select("date", F.lit(0).alias("ask"), F.col(value).cast("double").alias(value)))
    numbered = both.withColumn("day", F.unix_date("date"))
    w = Window.orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    return numbered.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("ask = 1").select("date", value)


def forward_filled(dates: DataFrame, series: DataFrame, value: str) -> DataFrame:
    """The series at each date, the last one standing until the next. (O-45)"""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return dates.join(series.select("date", value), "date", "left").select("date", F.last(value, ignorenulls=True).over(w).alias(value))
