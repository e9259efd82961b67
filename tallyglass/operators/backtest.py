"""Portfolio accounting without a loop over dates.

Between two formations weights drift with returns. With G the compound growth of an asset
since its formation and w its target, the portfolio's value is V = sum(w G), the day's
return V / V_before - 1, and the drifted weight w G / V. So all segments are evaluated
at once by windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.columns import average_rank
from tallyglass.operators.panel import forward_filled, running_drawdown, underwater_length

PERIODS = 12


def equal_weights(universe: DataFrame) -> DataFrame:
    """weight 1 / N by date. (O-138)"""
    return universe.select("date", "asset", F.lit("equal").alias("strategy"), (1 / F.count("*").over(Window.partitionBy("date"))).alias("weight"), "history_end")


def diagonal_minimum_variance(universe: DataFrame, variance: Column, penalty: Column, name: Column, cap: float = 1.0) -> DataFrame:
    """Minimum-variance weights of a diagonal covariance with a penalty on its diagonal, none above ``cap``. (O-135 to O-137, O-139, O-140)

    ``universe``: date, asset, history_end and what the columns name; several strategies can
    stand below each other, told apart by ``name``. With x = 1 / (variance + penalty) the optimum is
    min(cap, t x): the k largest stand at the cap and the others share what is left by x, where k is
    the least number for which none of them exceeds it. A date on which the cap leaves no weights ends the run.
    """
    date = Window.partitionBy("strategy", "date")
    down = date.orderBy(F.desc("_x"), "asset")
    rows = universe.select("date", "asset", name.alias("strategy"), (1 / (variance + penalty)).alias("_x"), "history_end")
    left = F.sum("_x").over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = rows.select("*", (F.row_number().over(down) - 1).alias("_k"), F.count("*").over(date).alias("_n"), left.alias("_left"))
    share = (1 - F.col("_k") * cap) / F.col("_left")
    settled = ranked.select("*", share.alias("_t")).select("*", F.min(F.when(F.col("_t") * F.col("_x") <= cap, F.col("_k"))).over(date).alias("_capped"))
    told = settled.select("*", F.max(F.when(F.col("_k") == F.col("_capped"), F.col("_t"))).over(date).alias("_share"))
    feasible = (F.col("_n") * cap >= 1 - 1e-12) & F.col("_x").isNotNull()
    weight = F.when(~feasible, F.raise_error(F.lit("the cap leaves no feasible weights, or a variance is missing")).cast("double"))
    weight = weight.when(F.col("_k") < F.coalesce("_capped", "_n"), cap).otherwise(F.col("_share") * F.col("_x"))
    return told.select("date", "asset", "strategy", weight.alias("weight"), "history_end")


def quality_penalty(variance: Column, quality: Column, strength: Column) -> Column:
    """strength x the date's median variance x (1 - quality): what a diagonal gains for bad evidence. (O-139)

    Where candidates stand below each other the median is theirs together, which is the date's own as all have its assets.
    """
    return strength * F.median(variance).over(Window.partitionBy("date")) * (1 - quality)


def segments(dates: DataFrame, formations: DataFrame) -> DataFrame:
    """strategy, date, formation: the dates that each formation (strategy, date) lasts, until the strategy's next one.

    ``dates`` is a calendar. Formations meet it by the numbers of its sessions.
    """
    numbered = dates.select("date", F.row_number().over(Window.orderBy("date")).alias("_no"))  # a row for each date
    end = F.lead("_no").over(Window.partitionBy("strategy").orderBy("_no")) - 1
    last = numbered.agg(F.max("_no")).scalar()
    spans = formations.join(numbered, "date").select("strategy", F.col("date").alias("formation"), "_no", F.coalesce(end, last).alias("_end"))
    return spans.select("strategy", "formation", F.explode(F.sequence("_no", "_end")).alias("_no")).join(numbered, "_no").select("strategy", "date", "formation")


def holdings(returns: DataFrame, targets: DataFrame, missing: str = "raise") -> DataFrame:
    """strategy, formation, date, asset, weight, ret, value: of each target, on every date of its segment. (O-141, O-145)

    The grid is targets x dates, whether the asset has a row or not, so nothing that is held can vanish.
    A return that is infinite, not a number or below -1 ends the run. A missing one does too, unless ``missing``
    is "carry": then the asset stands at its last value, and its next return (from one row
    to the next) makes up for the gap.
    """
    if missing not in ("raise", "carry"):
        raise ValueError("missing returns either raise or are carried")
    seg = segments(returns.select("date").distinct(), targets.select("strategy", "date").distinct())
    grid = targets.withColumnRenamed("date", "formation").join(seg, ["strategy", "formation"])
    held = grid.join(returns.select("date", "asset", "ret"), ["date", "asset"], "left")
    told = F.concat_ws(" ", F.lit("return of held asset"), "asset", F.lit("on"), "date", F.lit("is no return:"), F.coalesce(F.col("ret").cast("string"), F.lit("missing")))
    sound = (F.abs("ret") < float("inf")) & (F.col("ret") >= -1)
    ret = F.when(F.col("ret").isNull(), F.lit(0.0) if missing == "carry" else F.raise_error(told).cast("double"))
    held = held.withColumn("ret", ret.when(sound, F.col("ret")).otherwise(F.raise_error(told).cast("double")))
    w = Window.partitionBy("strategy", "formation", "asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumn("value", F.col("weight") * F.product(1 + F.col("ret")).over(w))


def missing_returns(returns: DataFrame, targets: DataFrame) -> DataFrame:
    """strategy, formation, date, asset: what ``holdings`` would have to carry. (O-145)"""
    seg = segments(returns.select("date").distinct(), targets.select("strategy", "date").distinct())
    grid = targets.select("strategy", F.col("date").alias("formation"), "asset").join(seg, ["strategy", "formation"])
    return grid.join(returns.filter("ret IS NOT NULL"), ["date", "asset"], "left_anti").select("strategy", "formation", "date", "asset")


def gross_returns(held: DataFrame) -> DataFrame:
    """strategy, formation, date, gross, last: by portfolio and day. (O-141)"""
    totals = held.groupBy("strategy", "formation", "date").agg(F.sum("value").alias("v"))
    w = Window.partitionBy("strategy", "formation").orderBy("date")
    return totals.select("strategy", "formation", "date", "v", (F.col("v") / F.coalesce(F.lag("v").over(w), F.lit(1.0)) - 1).alias("gross"), (F.lead("date").over(w).isNull()).alias("last"))


def drifted_weights(held: DataFrame, gross: DataFrame) -> DataFrame:
    """strategy, formation, asset, weight: at each segment's end. (O-141)"""
    ends = gross.filter("last").select("strategy", "formation", "date", "v")
    return held.join(ends, ["strategy", "formation", "date"]).select("strategy", "formation", "asset", (F.col("value") / F.col("v")).alias("weight"))


def turnover(targets: DataFrame, drifted: DataFrame) -> DataFrame:
    """strategy, formation, turnover: absolute weight moved; the first formation moves 1. (O-36, O-46, O-142)"""
    order = Window.partitionBy("strategy").orderBy("formation")
    forms = targets.select("strategy", F.col("date").alias("formation")).distinct().withColumn("before", F.lag("formation").over(order))
    new = targets.select("strategy", F.col("date").alias("formation"), "asset", "weight")
    old = drifted.withColumnRenamed("formation", "before").join(forms, ["strategy", "before"]).select("strategy", "formation", "asset", F.col("weight").alias("old"))
    moved = new.join(old, ["strategy", "formation", "asset"], "full").groupBy("strategy", "formation").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("moved"))
    return moved.join(forms, ["strategy", "formation"]).select("strategy", "formation", F.when(F.col("before").isNull(), 1.0).otherwise(F.col("moved")).alias("turnover"))


def net_returns(gross: DataFrame, turn: DataFrame, bps: Column) -> DataFrame:
    """strategy, date, gross, turnover, cost, net: costs fall on formation days. (O-143)"""
    day = gross.join(turn, ["strategy", "formation"], "left").withColumn("turnover", F.when(F.col("date") == F.col("formation"), F.col("turnover")).otherwise(0.0))
    cost = bps / F.lit(1e4) * F.col("turnover")
    return day.select("strategy", "date", "gross", "turnover", cost.alias("cost"), ((1 - cost) * (1 + F.col("gross")) - 1).alias("net"))


def concentration(targets: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """By strategy and formation: HHI, effective and active assets, largest weight, weighted quality. (O-144)

    ``quality``: date, asset, quality; an asset without one is neutral, 0.5. Without the table the
    portfolio's quality is null. ``failed``: the weights are no portfolio.
    """
    w = F.col("weight")
    rows = targets if quality is None else targets.join(quality.select("date", "asset", "quality"), ["date", "asset"], "left")
    told = F.lit(None).cast("double") if quality is None else F.sum(w * F.coalesce("quality", F.lit(0.5)))
    return rows.groupBy("strategy", "date").agg(
        F.sum(w * w).alias("hhi"),
        (1 / F.sum(w * w)).alias("effective"),
        F.count_if(w > 1e-8).alias("active"),
        F.max(w).alias("largest"),
        F.count("*").alias("eligible"),
        told.alias("quality"),
        (F.coalesce(F.abs(F.sum(w) - 1), F.lit(1.0)) > 1e-7).alias("failed"),
    )


def target_changes(targets: DataFrame) -> DataFrame:
    """Mean absolute change of the target row from one formation to the next, by strategy. (O-148)"""
    forms = targets.select("strategy", "date").distinct()
    grid = forms.join(targets.select("strategy", "asset").distinct(), "strategy").join(targets, ["strategy", "date", "asset"], "left")
    w = Window.partitionBy("strategy", "asset").orderBy("date")
    x = F.coalesce("weight", F.lit(0.0))
    step = grid.withColumn("x", x).withColumn("d", F.abs(F.col("x") - F.lag("x").over(w))).filter("d IS NOT NULL")
    return step.groupBy("strategy", "date").agg(F.sum("d").alias("l1")).groupBy("strategy").agg(F.avg("l1").alias("target_change"))


def tail(net: DataFrame, level: float, name: str) -> DataFrame:
    """Value at risk and the mean loss from it on, by strategy. (O-72)"""
    loss = net.select("strategy", (-F.col("net")).alias("loss"))
    var = loss.groupBy("strategy").agg(F.percentile("loss", level).alias("var"))
    return loss.join(var, "strategy").filter("loss >= var").groupBy("strategy").agg(F.max("var").alias(f"var{name}"), F.avg("loss").alias(f"cvar{name}"))


def metrics(net: DataFrame, targets: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The metric table: one row for each strategy. (O-147)

    ``fallbacks`` counts formations whose ``fallback`` column, if the targets have one, is true.
    """
    r = F.col("net")
    scale = F.sqrt(F.lit(float(PERIODS)))
    base = net.groupBy("strategy").agg(
        F.count("*").alias("n"),
        F.product(1 + r).alias("wealth"),
        F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("sd"),
        F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), F.lit(2.0)))).alias("down"),
        F.sum("turnover").alias("turnover"),
        F.sum("cost").alias("total_cost"),
    )
    drawdowns = running_drawdown(net.select("strategy", "date", "net"), "strategy", "net")
    worst = drawdowns.groupBy("strategy").agg((-F.min("drawdown")).alias("max_drawdown"))
    weights = concentration(targets, quality).groupBy("strategy").agg(
        F.count("*").alias("rebalances"),
        *(F.avg(c).alias(c) for c in ("hhi", "effective", "active", "largest", "quality")),
        F.count_if("failed").alias("solver_failures"),
    )
    fallback = F.col("fallback") if "fallback" in targets.columns else F.lit(False)
    fell = targets.groupBy("strategy").agg(F.count_distinct(F.when(fallback, F.col("date"))).alias("fallbacks"))
    out = base
    for part in (worst, underwater_length(drawdowns, "strategy"), tail(net, 0.95, "95"), tail(net, 0.99, "99"), weights, fell, target_changes(targets)):
        out = out.join(F.broadcast(part), "strategy")  # a row for each strategy
    c = F.col
    cagr = F.pow(c("wealth"), F.lit(float(PERIODS)) / c("n")) - 1
    return out.select(
        "strategy",
        (c("wealth") - 1).alias("cumulative"),
        cagr.alias("cagr"),
        c("mean").alias("mean_return"),
        (c("mean") * PERIODS).alias("annual_mean"),
        (c("sd") * scale).alias("volatility"),
        (c("down") * scale).alias("downside"),
        F.when(c("sd") > 0, c("mean") / c("sd") * scale).alias("sharpe"),
        F.when(c("down") > 0, c("mean") / c("down") * scale).alias("sortino"),
        "max_drawdown",
        F.when(c("max_drawdown") > 0, cagr / c("max_drawdown")).alias("calmar"),
        "underwater",
        "var95",
        "cvar95",
        "var99",
        "cvar99",
        (c("turnover") * PERIODS / c("n")).alias("annual_turnover"),
        (c("turnover") / c("rebalances")).alias("mean_turnover"),
        "total_cost",
        "rebalances",
        "hhi",
        "effective",
        "active",
        "largest",
        "target_change",
        "solver_failures",
        "fallbacks",
        "quality",
    )


#: Weights of the risk score's ranks; a high Sharpe ratio ranks low.
RISK_WEIGHTS = {"volatility": 0.30, "cvar95": 0.25, "max_drawdown": 0.20, "annual_turnover": 0.10, "hhi": 0.10, "sharpe": 0.05}


def risk_scores(table: DataFrame) -> DataFrame:
    """The weighted mean of average ranks across strategies; lower is better. (O-95, O-149)"""
    ranks = table.select("strategy", *(average_rank(-F.col(k) if k == "sharpe" else F.col(k)).alias(k) for k in RISK_WEIGHTS))
    return ranks.select("strategy", sum((F.col(k) * w for k, w in RISK_WEIGHTS.items()), F.lit(0.0)).alias("risk_score"))


def violations(net: DataFrame, targets: DataFrame, cap: float, rate: float) -> DataFrame:
    """name, n: how many rows break each invariant of a result. (O-145, O-146)

    ``rate`` is the cost of a turnover of 1. Dates, weights, accounting and history are checked, in
    one pass over the returns and one over the targets.
    """
    c = F.col
    unsound = lambda x: c(x).isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    off = lambda a, b: F.abs(a - b) > 1e-12
    day, form = Window.partitionBy("strategy", "date"), Window.partitionBy("strategy", "date", "asset")
    formed = targets.select("strategy", "date").distinct().withColumn("_formed", F.lit(True))
    nth = lambda w, *order: F.row_number().over(w.orderBy(*order))
    # a group counts at its second row if it should have one, and at its first for what is wrong with all of it
    rows = net.join(formed, ["strategy", "date"], "left").select("*", nth(day, "net").alias("_nth"))
    of_net = rows.agg(
        F.count_if(c("_nth") == 2).alias("dates_unique"),
        F.count_if((c("turnover") > 0) & c("_formed").isNull()).alias("formations_traded"),
        F.count_if(unsound("gross") | unsound("net") | unsound("turnover") | unsound("cost")).alias("returns_finite"),
        F.count_if(c("net") <= -1).alias("wealth_positive"),
        F.count_if((c("turnover") < 0) | (c("cost") < 0) | (c("cost") >= 1)).alias("costs_bounded"),
        F.count_if(off((1 - c("cost")) * (1 + c("gross")) - 1, c("net"))).alias("net_identity"),
        F.count_if(off(c("cost"), c("turnover") * rate)).alias("cost_identity"),
    )
    sums = targets.select("*", F.sum("weight").over(day).alias("_sum"), nth(day, "asset").alias("_first"), nth(form, "weight").alias("_nth"))
    of_targets = sums.agg(
        F.count_if(c("_nth") == 2).alias("weights_unique"),
        F.count_if(c("history_end").isNull() | (c("history_end") >= c("date"))).alias("history_prior"),
        F.count_if(unsound("weight")).alias("weights_finite"),
        F.count_if((c("_first") == 1) & (F.abs(c("_sum") - 1) > 1e-7)).alias("weights_sum"),
        F.count_if((c("weight") < -1e-8) | (c("weight") > cap + 1e-7)).alias("weights_bounds"),
    )
    listed = lambda df: df.unpivot([], df.columns, "name", "n")
    return listed(of_net).unionByName(listed(of_targets))


def reconciled(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float, relative: bool = False) -> DataFrame:
    """cells, mismatched, max_error of two tables, cell by cell: a cell that one side lacks is a mismatch. (O-52, O-153)

    ``relative``: errors are shares of ``b``'s value.
    """
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    error = F.abs(F.col("_a") / F.col("_b") - 1) if relative else F.abs(F.col("_a") - F.col("_b"))
    return both.agg(F.count("*").alias("cells"), F.count_if(error.isNull() | (error > tolerance)).alias("mismatched"), F.max(error).alias("max_error"))


def annual(net: DataFrame) -> DataFrame:
    """By strategy and year: days, return, volatility and the mean of the worst 5 %. (O-98)"""
    y = net.withColumn("year", F.year("date"))
    cut = y.groupBy("strategy", "year").agg(F.percentile("net", 0.05).alias("q"))
    joined = y.join(cut, ["strategy", "year"])
    r = F.col("net")
    return joined.groupBy("strategy", "year").agg(
        F.count("*").alias("days"), (F.product(1 + r) - 1).alias("ret"), (F.stddev_samp(r) * F.sqrt(F.lit(float(PERIODS)))).alias("volatility"), (-F.avg(F.when(r <= F.col("q"), r))).alias("cvar95")
    )


def cost_sensitivity(gross: DataFrame, turn: DataFrame, levels: list[float]) -> DataFrame:
    """CAGR by strategy and cost level on the same gross path. (O-99)"""
    path = net_returns(gross, turn, F.lit(0.0)).select("strategy", "date", "gross", "turnover")
    priced = path.withColumn("bps", F.explode(F.array(*map(F.lit, levels))))
    net = (1 - F.col("bps") / 1e4 * F.col("turnover")) * (1 + F.col("gross"))
    return priced.groupBy("strategy", "bps").agg((F.pow(F.product(net), F.lit(float(PERIODS)) / F.count("*")) - 1).alias("cagr"))


def by_regime(net: DataFrame, stress: DataFrame) -> DataFrame:
    """Metrics on calm (below .5) and stressed days; ``stress`` (date, probability) stands until the next. (O-45, O-100)"""
    filled = forward_filled(net.select("date").distinct(), stress, "probability").filter("probability IS NOT NULL")
    r = net.join(filled, "date").withColumn("regime", F.when(F.col("probability") < 0.5, "calm").otherwise("stress"))
    scale = F.sqrt(F.lit(float(PERIODS)))
    sd = F.stddev_samp("net")
    return r.groupBy("strategy", "regime").agg(F.count("*").alias("days"), (sd * scale).alias("volatility"), F.when(sd > 0, F.avg("net") / sd * scale).alias("sharpe"))


def core_statistics(series: DataFrame, *by: str) -> DataFrame:
    """volatility, cvar95, max_drawdown and sharpe of each series (``by``, k, net) in the order of k."""
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = series.withColumn("loss", -F.col("net")).withColumn("cut", F.percentile("loss", 0.95).over(whole)).withColumn("wealth", F.product(1 + F.col("net")).over(upto))
    rows = rows.withColumn("drawdown", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(upto)) - 1)
    sd, scale = F.stddev_samp("net"), F.sqrt(F.lit(float(PERIODS)))
    return rows.groupBy(*by).agg(
        (sd * scale).alias("volatility"),
        F.avg(F.when(F.col("loss") >= F.col("cut"), F.col("loss"))).alias("cvar95"),
        (-F.min("drawdown")).alias("max_drawdown"),
        F.when(sd > 0, F.avg("net") / sd * scale).alias("sharpe"),
    )


def block_bootstrap(net: DataFrame, pairs: list[tuple[str, str]], replications: int, blocks: list[int]) -> DataFrame:
    """Paired moving-block bootstrap: reference, strategy, block, metric, difference, lower, upper, excludes_zero. (O-150, O-151)

    ``pairs`` of (reference, strategy) and block lengths are axes of one table of draws: each strategy's statistics are
    computed once for each length and replication, and pairs only subtract them. The b-th block of a replication starts
    where the first 8 digits of the MD5 of "length:replication:b" say, modulo the possible starts, so draws look
    independent and any engine draws the same; all strategies share them. ``difference`` is that of the full
    series (length 0), the interval that of the replications. A length beyond the series ends the run.
    """
    w = Window.partitionBy("strategy").orderBy("date")
    series = net.select("strategy", (F.row_number().over(w) - 1).cast("long").alias("at"), "net")
    n = F.col("n")
    spark = net.sparkSession
    length = series.agg((F.max("at") + 1).alias("n")).scalar()
    lengths = F.explode(F.array(*(F.lit(b) for b in blocks))).alias("block")
    reps = spark.range(replications).select(F.col("id").alias("rep"), length.alias("n")).select("*", lengths)
    fits = F.when(n >= F.col("block"), n).otherwise(F.raise_error(F.lit("a block is longer than the series")).cast("long"))
    each = reps.withColumn("n", fits).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / F.col("block")).cast("long") - 1)))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "block", "rep", "b").cast("binary")), 1, 8), 16, 10).cast("long")
    offsets = each.withColumn("start", drawn % (n - F.col("block") + 1)).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("block") - 1)))
    places = offsets.select("block", "rep", (F.col("b") * F.col("block") + F.col("o")).alias("k"), (F.col("start") + F.col("o")).alias("at"), "n").filter("k < n").drop("n")
    full = series.select("at").distinct().select(F.lit(0).alias("block"), F.lit(-1).cast("long").alias("rep"), F.col("at").alias("k"), "at")
    stats = core_statistics(places.unionByName(full).join(series, "at"), "strategy", "block", "rep")
    names = ["volatility", "cvar95", "max_drawdown", "sharpe"]
    long = stats.unpivot(["strategy", "block", "rep"], names, "metric", "x")
    sides = F.explode(F.array(*(F.struct(F.lit(a).alias("reference"), F.lit(b).alias("tested")) for a, b in pairs)))
    # each value stands once for each pair that it is of, with its sign
    signed = long.select("*", sides.alias("p")).filter("strategy IN (p.reference, p.tested)").select("p.*", "block", "rep", "metric", F.when(F.col("strategy") == F.col("p.tested"), F.col("x")).otherwise(-F.col("x")).alias("x"))
    diff = signed.groupBy("reference", "tested", "block", "rep", "metric").agg(F.sum("x").alias("d"))
    base = diff.filter("rep < 0").select("reference", "tested", "metric", F.col("d").alias("difference"))
    spread = diff.filter("rep >= 0").groupBy("reference", "tested", "block", "metric").agg(F.percentile("d", 0.025).alias("lower"), F.percentile("d", 0.975).alias("upper"))
    out = spread.join(base, ["reference", "tested", "metric"])
    return out.select("reference", F.col("tested").alias("strategy"), "block", "metric", "difference", "lower", "upper", ((F.col("lower") > 0) | (F.col("upper") < 0)).alias("excludes_zero"))
