"""Operators on inline fixtures: semantics that the SQL comparison does not show."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.functions import columns as c
from tallyglass.operators import backtest, experiment, facts, forecast, panel, risk
from tallyglass.sources import readers, sinks
from tallyglass.streaming import events as streaming

D = dt.date


def days(n, start=D(2020, 1, 2)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(1)
    return out


@pytest.fixture(scope="module")
def two_assets(spark):
    a, b = [0.1, 0.1, 0.0], [0.0, 0.0, 0.2]
    rows = [(d, k, r) for k, rets in enumerate((a, b)) for d, r in zip(days(3), rets)]
    return spark.createDataFrame(rows, "date date, asset int, ret double")


def test_drift_costs_and_turnover_of_two_assets(spark, two_assets):
    targets = spark.createDataFrame([(days(1)[0], k, "equal", 0.5) for k in (0, 1)], "date date, asset int, strategy string, weight double")
    held = backtest.holdings(two_assets, targets)
    gross = backtest.gross_returns(held)
    turn = backtest.turnover(targets, backtest.drifted_weights(held, gross))
    net = {r["date"]: r for r in backtest.net_returns(gross, turn, F.lit(10.0)).collect()}
    total = math.prod(1 + r["net"] for r in net.values())
    assert total == pytest.approx(0.999 * (0.5 * 1.1 * 1.1 + 0.5 * 1.2))
    assert net[days(3)[1]]["gross"] == pytest.approx(0.1 * 1.1 / 2.1)
    assert sum(r["turnover"] for r in net.values()) == 1.0


def test_violations_are_counted(spark):
    d = days(2)
    targets = spark.createDataFrame([(d[0], 0, "s", 0.9), (d[0], 0, "s", 0.2), (d[1], 1, "s", -0.1)], "date date, asset int, strategy string, weight double").withColumn("history_end", F.lit("2019-12-31").cast("date"))
    net = spark.createDataFrame([("s", d[0], 0.1, 0.0, 0.01, 0.2), ("s", d[0], 0.0, 0.0, 0.0, float("nan"))], "strategy string, date date, gross double, turnover double, cost double, net double")
    found = {r["name"]: r["n"] for r in backtest.violations(net, targets, 0.5, 0.001).collect()}
    assert {k: n for k, n in found.items() if n} == {"weights_sum": 2, "weights_bounds": 2, "weights_unique": 1, "dates_unique": 1, "returns_finite": 1, "net_identity": 2, "cost_identity": 1}
    assert len(found) == 12


def test_tail_and_drawdown(spark):
    rows = [("s", d, r) for d, r in zip(days(4), (-0.2, -0.1, 0.0, 0.1))]
    net = spark.createDataFrame(rows, "strategy string, date date, net double")
    got = backtest.tail(net, 0.75, "").first()
    assert got["var"] == pytest.approx(0.125) and got["cvar"] == pytest.approx(0.2)
    flat = spark.createDataFrame([("s", d, r) for d, r in zip(days(3), (-0.1, 0.0, 0.01))], "strategy string, date date, net double")
    down = panel.running_drawdown(flat, "strategy", "net")
    assert down.agg(F.min("drawdown")).first()[0] == pytest.approx(-0.1)
    assert panel.underwater_length(down, "strategy").first()["underwater"] == 3


def test_columns(spark):
    row = lambda *cols: spark.range(1).select(*cols).first()
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    assert tuple(row(c.finite(nan).alias("a"), c.finite(inf).alias("b"), c.guarded_ratio(F.lit(1.0), F.lit(0.0)).alias("d"), c.guarded_ratio(F.lit(1.0), F.lit(-2.0)).alias("e"), c.guarded_ratio(F.lit(3.0), F.lit(2.0)).alias("f"))) == (None, None, None, None, 1.5)
    dates = spark.createDataFrame([(D(2024, 1, k),) for k in range(4, 9)], "d date").select("d", c.next_business_day(F.col("d")).alias("n")).collect()
    assert [r["n"].day for r in dates] == [5, 8, 8, 8, 9]
    assert row(c.clip(F.lit(None).cast("double"), 0, 1).alias("x"))[0] is None
    ranks = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "x double").select("x", c.average_rank(F.col("x")).alias("r"), c.signed_rank(F.col("x"), -1).alias("s")).collect()
    assert sorted((r["x"] or 0, r["r"], round(r["s"], 6)) for r in ranks if r["x"]) == [(1.0, 1.0, round(1 - 1 / 3, 6)), (2.0, 2.5, round(1 - 2.5 / 3, 6)), (2.0, 2.5, round(1 - 2.5 / 3, 6))]
    assert [r["s"] for r in ranks if r["x"] is None] == [0.5]
    for n in (5, 7, 23):
        got = spark.range(n).select(c.quantile_bucket(F.col("id"), 5, tie="id").alias("q"), "id").orderBy("id").collect()
        cuts = np.quantile(np.arange(1, n + 1), np.linspace(0, 1, 6))
        assert [r["q"] for r in got] == [max(1, int(np.searchsorted(cuts, k, "left"))) for k in range(1, n + 1)]
    assert tuple(row(c.normalize_cik(F.lit(" 320193.0 ")).alias("a"), c.normalize_cik(F.lit("x")).alias("b"), c.normalize_ticker(F.lit(" brk-b ")).alias("d"))) == ("0000320193", None, "BRK.B")


FACT = "issuer string, metric string, concept string, value double, start date, end date, filed date, accn string, priority int, form string"


def fact(value, end, filed, form="10-K", metric="assets", accn="a", start=None, priority=0, issuer="A"):
    return (issuer, metric, f"{metric}{priority}", value, start, end, filed, accn, priority, form)


@pytest.mark.parametrize(
    "extra, date, information, expect",
    [
        ([], D(2020, 2, 4), D(2020, 2, 3), None),
        ([], D(2020, 2, 5), D(2020, 2, 4), 100.0),
        ([fact(1e12, D(2019, 12, 31), D(2021, 12, 31))], D(2020, 2, 5), D(2020, 2, 4), 100.0),
        ([fact(120.0, D(2020, 1, 31), D(2020, 2, 20), "10-K/A", accn="b")], D(2020, 2, 5), D(2020, 2, 4), 100.0),
        ([fact(120.0, D(2020, 1, 31), D(2020, 2, 20), "10-K/A", accn="b")], D(2020, 2, 24), D(2020, 2, 21), 120.0),
    ],
)
def test_nothing_is_seen_before_it_is_available(spark, extra, date, information, expect):
    df = spark.createDataFrame([fact(100.0, D(2019, 12, 31), D(2020, 2, 3)), *extra], FACT)
    forms = spark.createDataFrame([(date, information)], "date date, information date")
    got = facts.picks(facts.visible(facts.prepared(df), forms)).collect()
    assert [r["value"] for r in got] == ([] if expect is None else [expect])


def test_conflicts_and_invalid_facts_are_left_out(spark):
    e, f = D(2019, 12, 31), D(2020, 2, 3)
    rows = [fact(1.0, e, f), fact(1.0, e, f), fact(2.0, e, f, accn="c"), fact(3.0, e, f, accn="c"), fact(4.0, D(2020, 3, 1), f, accn="d"), fact(float("inf"), e, f, accn="e"), fact(5.0, e, f, "8-K", accn="g")]
    rows += [fact(6.0, e, f, metric="revenue", accn=k, start=e - dt.timedelta(n), form=form) for k, n, form in (("h", 329, "10-K"), ("i", 330, "10-K"), ("j", 400, "10-K/A"), ("k", 401, "10-K"), ("l", 365, "10-Q"))]
    df = spark.createDataFrame(rows, FACT)
    got = facts.prepared(df)
    assert {r["accn"] for r in got.collect()} == {"a", "i", "j"}
    assert {r["reason"]: r["n"] for r in facts.rejections(df).collect()} == {"invalid": 6, "ambiguous": 2}
    cut = spark.createDataFrame([("A", D(2020, 2, 3))], "issuer string, cutoff date")
    assert facts.before_cutoff(got, cut).count() == 0
    assert facts.prepared(df.limit(0)).count() == 0


def test_a_restatement_of_the_same_period_changes_only_later_snapshots(spark):
    rows = [fact(100.0, D(2019, 12, 31), D(2020, 2, 3), accn="first"), fact(120.0, D(2019, 12, 31), D(2020, 2, 20), "10-K/A", accn="amended")]
    forms = spark.createDataFrame([(D(2020, 2, 5), D(2020, 2, 4)), (D(2020, 2, 24), D(2020, 2, 21))], "date date, information date")
    issuers = spark.createDataFrame([("A",), ("B",)], "issuer string")
    df = facts.quality(facts.snapshots(facts.prepared(spark.createDataFrame(rows, FACT)), issuers, forms))
    got = {(r["issuer"], r["date"].day): r for r in df.collect()}
    assert got["A", 5]["log_assets"] == math.log(100) and got["A", 24]["log_assets"] == math.log(120)
    assert (got["A", 24]["known_filings"], got["A", 24]["amended"], got["A", 24]["report_age"], got["A", 24]["filing_lag"]) == (2, 0.5, 4, 51)
    absent = got["B", 24]
    assert (absent["known_filings"], absent["coverage"], absent["score"], absent["latest_used_available"]) == (0, 0.0, 0.5, None)
    empty = facts.quality(facts.snapshots(facts.prepared(spark.createDataFrame([], FACT)), issuers, forms)).collect()
    assert len(empty) == 4 and all(r["score"] == 0.5 and r["coverage"] == 0 for r in empty)


def test_keys_of_several_values_are_conflicts_also_across_forms(spark):
    e, f = D(2019, 12, 31), D(2020, 2, 3)
    rows = [fact(1.0, e, f, "10-K"), fact(2.0, e, f, "10-K/A"), fact(3.0, e, f, "10-K", accn="b"), fact(3.0, e, f, "10-K/A", accn="b")]
    assert [(r["accn"], r["value"]) for r in facts.prepared(spark.createDataFrame(rows, FACT)).collect()] == [("b", 3.0)]


def plain_snapshot(known, date):
    """One issuer at one date, fact by fact: ``known`` is what it had filed in time."""
    best = lambda fs: max(fs, key=lambda f: (f["end"], -f["priority"], f["filed"], f["accn"], f["start"], f["value"]), default=None)
    of = lambda metric, end: best([f for f in known if f["metric"] == metric and f["end"] == end])
    fresh = [f for f in known if f["end"] >= date - dt.timedelta(550)]
    annual = max((f["end"] for f in fresh if f["metric"] in ("revenue", "income", "cash_flow")), default=None)
    balance = max((f["end"] for f in fresh if f["metric"] == "assets"), default=None)
    a = {m: of(m, annual) for m in ("assets", "income", "cash_flow", "revenue", "operating_income", "capex")}
    b = {m: of(m, balance) for m in ("assets", "equity", "cash", "liabilities", "current_assets", "current_liabilities")}
    before = best([f for f in known if f["metric"] == "revenue" and annual and 330 <= (annual - f["end"]).days <= 400])
    before = before if before and before["value"] > 0 else None
    v = lambda f: f["value"] if f else None
    minus = lambda x, y: None if x is None or y is None else x - y
    div = lambda x, y: x / y if x is not None and y is not None and y > 0 else None
    used = [f for f in (*a.values(), *b.values(), before) if f]
    last = max(used, key=lambda f: (f["filed"], f["end"]), default=None)
    filings = {}
    for f in sorted(known, key=lambda f: (f["available"], f["end"], f["priority"], f["accn"], f["form"])):
        filings.setdefault((f["filed"], f["accn"], f["form"]), f)
    recent = list(filings)[-20:]
    growth = div(v(a["revenue"]), v(before))
    out = {
        "roa": div(v(a["income"]), v(a["assets"])),
        "operating_margin": div(v(a["operating_income"]), v(a["revenue"])),
        "cash_flow_to_assets": div(v(a["cash_flow"]), v(a["assets"])),
        "accruals": div(minus(v(a["income"]), v(a["cash_flow"])), v(a["assets"])),
        "free_cash_flow": div(minus(v(a["cash_flow"]), v(a["capex"])), v(a["assets"])),
        "equity_share": div(v(b["equity"]), v(b["assets"])),
        "cash_share": div(v(b["cash"]), v(b["assets"])),
        "leverage": div(v(b["liabilities"]), v(b["assets"])),
        "current_ratio": div(v(b["current_assets"]), v(b["current_liabilities"])),
    }
    out["missing"] = sum(x is None for x in out.values()) / 9
    out |= {"revenue_growth": None if growth is None else growth - 1, "log_assets": math.log(v(b["assets"])) if v(b["assets"]) and v(b["assets"]) > 0 else None}
    out |= {"annual_age": (date - annual).days if annual else None, "report_age": (date - last["filed"]).days if last else None, "filing_lag": (last["filed"] - last["end"]).days if last else None}
    out |= {"latest_used_available": max((f["available"] for f in used), default=None), "known_filings": len({f["accn"] for f in known}), "amended": sum(k[2].endswith("/A") for k in recent) / len(recent) if recent else None}
    return out


def test_snapshots_equal_the_rule_fact_by_fact(spark):
    rng = np.random.default_rng(8)
    metrics = [*facts.AT_ANNUAL_END, *facts.AT_BALANCE_END]
    rows, ends = [], [D(2015, 12, 31) + dt.timedelta(int(91.3 * k)) for k in range(20)]
    for k in range(1500):
        issuer, metric, end = str(rng.choice(["A", "B", "C"])), str(rng.choice(metrics)), ends[int(rng.integers(20))]
        annual = metric in facts.FLOWS
        filed = end + dt.timedelta(int(rng.integers(5, 400)))
        rows.append(fact(float(rng.integers(-20, 100)), end, filed, str(rng.choice(facts.ANNUAL_FORMS if annual else facts.FORMS)), metric, f"{issuer}{filed}{k % 3}", end - dt.timedelta(364 if annual else 90), int(rng.integers(2)), issuer))
    prepared = facts.prepared(spark.createDataFrame(rows, FACT)).cache()
    known = [r.asDict() for r in prepared.collect()]
    dates = [(D(2017, 1, 3) + dt.timedelta(31 * k), D(2017, 1, 2) + dt.timedelta(31 * k)) for k in range(40)]
    forms = spark.createDataFrame(dates, "date date, information date")
    panel_ = facts.snapshots(prepared, spark.createDataFrame([("A",), ("B",), ("C",), ("none",)], "issuer string"), forms).cache()
    got = panel_.collect()
    assert len(got) == 160 and sum(r["revenue_growth"] is not None for r in got) > 10
    for r in got:
        want = plain_snapshot([f for f in known if f["issuer"] == r["issuer"] and f["available"] <= r["information"]], r["date"])
        for k, x in want.items():
            assert r[k] == (pytest.approx(x) if isinstance(x, float) else x), (r["issuer"], r["date"], k)
    assert {r["name"]: r["n"] for r in facts.leaks(panel_).collect()} == dict.fromkeys(("repeated_keys", "used_before_available", "information_not_prior", "filed_not_prior"), 0)


def plain_core(x):
    wealth = np.cumprod(1 + x)
    loss = -x
    cut = np.quantile(loss, 0.95)
    return {"volatility": x.std(ddof=1) * np.sqrt(12), "cvar95": loss[loss >= cut].mean(), "max_drawdown": -(wealth / np.maximum.accumulate(np.append(1.0, wealth))[1:] - 1).min(), "sharpe": x.mean() / x.std(ddof=1) * np.sqrt(12)}


def test_bootstrap_equals_its_draws_one_by_one(spark):
    import hashlib

    rng = np.random.default_rng(12)
    x = rng.normal(0.01, 0.05, (37, 3))
    names = ("equal", "other", "third")
    net = spark.createDataFrame([(s, d, float(x[k, j])) for k, d in enumerate(days(37)) for j, s in enumerate(names)], "strategy string, date date, net double")
    pairs = [("equal", "other"), ("other", "third")]
    got = backtest.block_bootstrap(net, pairs, 60, [5, 37]).collect()
    assert len(got) == 2 * 2 * 4
    for r in got:
        a, b, length, k = names.index(r["reference"]), names.index(r["strategy"]), r["block"], r["metric"]
        draws = []
        for rep in range(60):
            starts = [int(hashlib.md5(f"{length}:{rep}:{j}".encode()).hexdigest()[:8], 16) % (37 - length + 1) for j in range(-(-37 // length))]
            at = np.concatenate([np.arange(s, s + length) for s in starts])[:37]
            draws.append(plain_core(x[at, b])[k] - plain_core(x[at, a])[k])
        assert r["difference"] == pytest.approx(plain_core(x[:, b])[k] - plain_core(x[:, a])[k])
        assert r["lower"] == pytest.approx(np.quantile(draws, 0.025)) and r["upper"] == pytest.approx(np.quantile(draws, 0.975))
    with pytest.raises(Exception, match="longer than the series"):
        backtest.block_bootstrap(net, pairs, 5, [38]).collect()


def plain_net(rets, targets, dates, rate):
    """Accounting day by day: {(date): (gross, turnover, net)} of one strategy; a missing return is 0."""
    held, out = {}, {}
    for d in dates:
        moved = 0.0
        if d in targets:
            moved = sum(abs(targets[d].get(a, 0) - held.get(a, 0)) for a in {*targets[d], *held}) if held else 1.0
            held = dict(targets[d])
        if held:
            gross = sum(w * (rets.get((d, a)) or 0.0) for a, w in held.items())
            out[d] = (gross, moved, (1 - rate * moved) * (1 + gross) - 1)
            held = {a: w * (1 + (rets.get((d, a)) or 0.0)) / (1 + gross) for a, w in held.items()}
    return out


def test_accounting_with_missing_rows_day_by_day(spark):
    rng = np.random.default_rng(21)
    dates, assets = days(40), range(6)
    rets = {(d, a): float(rng.normal(0, 0.1)) for d in dates for a in assets if rng.random() > 0.15}
    rets = {k: (None if rng.random() < 0.03 else v) for k, v in rets.items()}
    made = {"x": {}, "y": {}}
    for name, every, first in (("x", 7, 0), ("y", 11, 5)):
        for k in range(first, 40, every):
            w = rng.dirichlet(np.ones(4))
            made[name][dates[k]] = dict(zip(map(int, rng.permutation(6)[:4]), map(float, w)))
    returns = spark.createDataFrame([(d, a, r) for (d, a), r in rets.items()], "date date, asset int, ret double")
    targets = spark.createDataFrame([(n, d, a, w, D(2019, 12, 31)) for n, t in made.items() for d, ws in t.items() for a, w in ws.items()], "strategy string, date date, asset int, weight double, history_end date")
    held = backtest.holdings(returns, targets, "carry")
    gross = backtest.gross_returns(held)
    net = backtest.net_returns(gross, backtest.turnover(targets, backtest.drifted_weights(held, gross)), F.lit(10.0))
    got = {(r["strategy"], r["date"]): (r["gross"], r["turnover"], r["net"]) for r in net.collect()}
    want = {(n, d): x for n, t in made.items() for d, x in plain_net(rets, t, [d for d in dates if any((d, a) in rets for a in assets)], 0.001).items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert not [r for r in backtest.violations(net, targets, 1.0, 0.001).collect() if r["n"]]
    gaps = {(r["strategy"], r["date"], r["asset"]) for r in backtest.missing_returns(returns, targets).collect()}
    assert gaps == {(r["strategy"], r["date"], r["asset"]) for r in held.select("strategy", "date", "asset").collect() if rets.get((r["date"], r["asset"])) is None} and gaps
    with pytest.raises(Exception, match="missing"):
        backtest.holdings(returns, targets).collect()
    whole = returns.fillna({"ret": 0.0})
    for bad in (float("inf"), float("nan"), -1.5):
        spoiled = whole.withColumn("ret", F.when((F.col("asset") == 2) & (F.col("date") == dates[20]), bad).otherwise(F.col("ret")))
        if spoiled.filter((F.col("asset") == 2) & (F.col("date") == dates[20])).count():
            with pytest.raises(Exception, match="is no return"):
                backtest.holdings(spoiled, targets, "carry").collect()


def test_capped_diagonal_weights_are_the_optimum(spark):
    rng = np.random.default_rng(22)
    rows = [(D(2020, 1, 1 + k), a, float(v), D(2019, 12, 31)) for k, n in enumerate((4, 5, 7, 20)) for a, v in enumerate(rng.lognormal(0, 1.5, n))]
    u = spark.createDataFrame(rows, "date date, asset int, variance double, history_end date")
    got = {(r["date"], r["asset"]): r["weight"] for r in backtest.diagonal_minimum_variance(u, F.col("variance"), F.lit(0.0), F.lit("s"), 0.25).collect()}
    for d in {r[0] for r in rows}:
        v = np.array([r[2] for r in rows if r[0] == d])
        w = np.array([got[d, a] for a in range(len(v))])
        assert w.sum() == pytest.approx(1) and w.max() <= 0.25 + 1e-12
        assert w == pytest.approx(risk.minimum_variance(np.diag(v), 0.25), abs=1e-6)
    with pytest.raises(Exception, match="no feasible weights"):
        backtest.diagonal_minimum_variance(u, F.col("variance"), F.lit(0.0), F.lit("s"), 0.2).collect()


def test_metrics_average_over_formations_and_weigh_quality(spark):
    d = days(4)
    rows = [("s", d[0], 0, 0.8), ("s", d[0], 1, 0.2), ("s", d[2], 0, 0.5), ("s", d[2], 1, 0.5)]
    targets = spark.createDataFrame([(*r, D(2019, 12, 31)) for r in rows], "strategy string, date date, asset int, weight double, history_end date")
    net = spark.createDataFrame([("s", x, 0.01 * k, 1.0 if k == 0 else 0.6 if k == 2 else 0.0) for k, x in enumerate(d)], "strategy string, date date, gross double, turnover double")
    net = net.withColumn("cost", F.col("turnover") * 0.001).withColumn("net", (1 - F.col("cost")) * (1 + F.col("gross")) - 1)
    quality = spark.createDataFrame([(d[0], 0, 1.0), (d[2], 0, 0.0), (d[2], 1, 1.0)], "date date, asset int, quality double")
    m = backtest.metrics(net, targets, quality).first()
    assert m["largest"] == pytest.approx(0.65) and m["rebalances"] == 2 and m["quality"] == pytest.approx((0.8 + 0.2 * 0.5 + 0.5) / 2)
    assert m["mean_turnover"] == pytest.approx(0.8) and m["solver_failures"] == 0 and m["fallbacks"] == 0
    assert {r["name"] for r in backtest.violations(net, targets, 0.7, 0.001).collect() if r["n"]} == {"weights_bounds"}
    bad = targets.withColumn("history_end", F.col("date"))
    assert {r["name"]: r["n"] for r in backtest.violations(net, bad, 1.0, 0.002).collect() if r["n"]} == {"history_prior": 4, "cost_identity": 2}
    other = net.filter("gross < 0.03").withColumn("gross", F.when(F.col("gross") == 0, F.lit(1e-3)).otherwise(F.col("gross")))
    r = backtest.reconciled(net, other, ["strategy", "date"], "gross", 1e-9).first()
    assert (r["cells"], r["mismatched"], round(r["max_error"], 9)) == (4, 2, 0.001)


def test_names_and_caps(spark):
    assert c.find_column(["Issuer Name", "CIK_ID"], "cik id") == "CIK_ID" and c.find_column(["a"], "b") is None
    with pytest.raises(ValueError):
        risk.minimum_variance(np.eye(5), 0.15)


def test_prior_windows_see_nothing_of_their_own_day(spark):
    rng = np.random.default_rng(1)
    rows = [(d, 0, float(100 * (1 + x))) for d, x in zip(days(40), rng.normal(0, 0.1, 40))]
    make = lambda r: panel.prior_statistics(panel.simple_returns(spark.createDataFrame(r, "date date, asset int, price double")), 3, 6, 12).orderBy("date").collect()
    before, after = make(rows), make([*rows[:30], *((d, a, p * 3) for d, a, p in rows[30:])])
    assert before[:31] == after[:31] and before[31:] != after[31:]


def test_covariances_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (30, 4)) @ rng.normal(0, 1, (4, 4))
    df = spark.createDataFrame([(d, j, float(x[t, j])) for t, d in enumerate(days(30)) for j in range(4)], "date date, asset int, ret double")
    want, k = risk.shrunk(x)
    got = {(r["i"], r["j"]): r for r in risk.ledoit_wolf(df).collect()}
    assert all(got[i, j]["cov"] == pytest.approx(want[i, j]) and got[i, j]["shrinkage"] == pytest.approx(k) for i in range(4) for j in range(4))
    for block, some in ((1, 7), (3, 30), (2, 11)):
        blocks = {(r["i"], r["j"]): r for r in risk.ledoit_wolf(df, block, some).collect()}
        assert blocks.keys() == got.keys() and all(blocks[k]["cov"] == pytest.approx(got[k]["cov"]) for k in got)
    w = rng.uniform(0.1, 1, 30)
    weights = spark.createDataFrame([(d, float(v)) for d, v in zip(days(30), w)], "date date, w double")
    want = np.cov(x.T, aweights=w)
    for r in risk.weighted_covariance(df, weights).collect():
        assert r["cov"] == pytest.approx(want[r["i"], r["j"]])
    avg = panel.average_correlation(df, 30).collect()
    corr = np.corrcoef(x.T)
    assert len(avg) == 1 and avg[0]["average_correlation"] == pytest.approx((corr.sum() - 4) / 12)


def test_minimum_variance():
    cov = np.array([[0.04, 0.01], [0.01, 0.09]])
    w = risk.minimum_variance(cov, 1.0)
    assert w[0] == pytest.approx((0.09 - 0.01) / (0.04 + 0.09 - 0.02), abs=1e-7)
    assert risk.minimum_variance(cov, 0.6) == pytest.approx([0.6, 0.4])
    with pytest.raises(ValueError):
        risk.minimum_variance(cov, 0.4)
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, (60, 12))
    cov = risk.psd_floor(a.T @ a / 60)
    w = risk.minimum_variance(cov, 0.2)
    grad = cov @ w
    free = (w > 1e-7) & (w < 0.2 - 1e-7)
    assert w.sum() == pytest.approx(1) and np.ptp(grad[free]) < 1e-6
    assert (grad[w <= 1e-7] >= grad[free].mean() - 1e-6).all() and (grad[w >= 0.2 - 1e-7] <= grad[free].mean() + 1e-6).all()


def test_regimes_are_recovered():
    rng = np.random.default_rng(19)
    state = np.repeat([0, 1, 0, 1], [150, 60, 120, 70])
    x = np.stack([rng.normal(0, np.where(state, 0.03, 0.005)), np.where(state, 0.03, 0.005) * rng.uniform(0.8, 1.2, 400)], 1)
    _, post, move = risk.fit_regimes(x)
    hot = risk.stress_state(post, x[:, 1])
    assert ((post[:, hot] > 0.5) == state).mean() > 0.97
    assert move.sum(1) == pytest.approx([1, 1]) and (np.diag(move) > 0.9).all()
    again = risk.fit_regimes(x)
    assert np.array_equal(again[1], post)
    cov = risk.pooled_covariance(rng.normal(0, 1, (400, 3)), post, np.array([0.5, 0.5]))
    assert np.linalg.eigvalsh(cov).min() > 0


def test_trees_learn_and_do_not_see_the_future(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (600, 3))
    x[rng.random((600, 3)) < 0.05] = np.nan
    y = np.where(np.nan_to_num(x[:, 0]) > 0.3, 1.0, -1.0) + 0.1 * rng.normal(0, 1, 600)
    data = [(D(2009, 1 + k % 12, 1), k % 20, D(2009, 1 + k % 12, 28), *(None if math.isnan(v) else float(v) for v in x[k]), float(y[k])) for k in range(600)]
    data += [(D(2010, 1, 1), k, D(2010, 1, 28), 1.0 if k % 2 else -1.0, 0.0, 0.0, None) for k in range(20)]
    p = spark.createDataFrame(data, "date date, asset int, label_end date, a double, b double, c double, target double").withColumn("never", F.lit(None).cast("double"))
    out, importance = forecast.walk_forward(p, forecast.cutoffs(p, 2010), ["a", "b", "c", "never"], 3, 10, 0.3, least=100)
    assert all(abs(r["predicted"] - (1 if r["asset"] % 2 else -1)) < 0.3 for r in out.collect())
    told = {r["feature"]: r["importance"] for r in importance.collect()}
    assert max(told, key=told.get) == "a" and told["never"] == 0 and sum(told.values()) == pytest.approx(1)
    rows = []
    for m in range(36):
        d = D(2010 + m // 12, m % 12 + 1, 1)
        rows += [(d, a, D(d.year, d.month, 28), float(rng.normal()), float(rng.normal())) for a in range(20)]
    schema = "date date, asset int, label_end date, f double, target double"
    late = [(d, a, e, f, 1000.0 if e >= D(2012, 1, 1) else t) for d, a, e, f, t in rows]

    def run(r):
        p = spark.createDataFrame(r, schema)
        return {(x["date"], x["asset"]): x["predicted"] for x in forecast.walk_forward(p, forecast.cutoffs(p, 2012), ["f"], 2, 5, least=100)[0].collect()}

    assert run(rows) == run(late) and len(run(rows)) == 240


def test_chain_and_projection_columns(spark):
    p, a = 0.3, np.array([[0.9, 0.1], [0.2, 0.8]])
    got = spark.range(1).select(risk.forecast_stress(F.lit(p), F.lit(0.9), F.lit(0.8), 5).alias("s")).first()["s"]
    v, total = np.array([1 - p, p]), 0.0
    for _ in range(5):
        v = v @ a
        total += v[1] / 5
    assert got == pytest.approx(total)
    raw = [0.9, 0.3, -0.2, 0.25]
    w = spark.range(1).select(risk.capped_weights(F.array(*map(F.lit, raw)), 0.4).alias("w"), risk.capped_weights(F.array(*map(F.lit, raw)), 0.2).alias("none")).first()
    assert w["none"] is None and w["w"] == pytest.approx(risk.project(np.array(raw), 0.4))


def test_filing_documents(spark, tmp_path):
    good = '{"cik": 7, "entityName": "E", "facts": {"us-gaap": {"Assets": {"label": "a", "units": {"USD": [{"end": "2019-12-31", "val": 100, "accn": "x", "form": "10-K", "filed": "2020-02-03"}]}}}, "dei": {"TradingSymbol": {"units": {}}}}}'
    for name, text in (("a", good), ("b", "{broken"), ("c", '{"entityName": "no issuer"}')):
        (tmp_path / f"{name}.json").write_text(text)
    docs = readers.documents(spark, str(tmp_path))
    flat = readers.flat_facts(docs).collect()
    assert [(r["cik"], r["concept"], r["value"], r["filed"]) for r in flat] == [(7, "Assets", 100.0, D(2020, 2, 3))]
    assert {r["path"][-6:]: r["reason"] for r in readers.read_errors(docs).collect()} == {"b.json": "not readable", "c.json": "no issuer"}
    tags = spark.createDataFrame([("assets", "Assets", 0)], "metric string, concept string, priority int")
    issuers = spark.createDataFrame([("A", 7)], "ticker string, cik long")
    assert readers.metric_facts(readers.flat_facts(docs), tags, issuers).first()["issuer"] == "A"
    assert readers.inventory(spark, str(tmp_path)).first()["files"] == 3
    (tmp_path / "id").write_text('{"fields": ["cik", "name", "ticker", "exchange"], "data": [[1, "N", "B-A", "X"]]}')
    assert readers.identity_rows(spark, str(tmp_path / "id")).first()["ticker"] == "B.A"
    assert readers.first_existing(["", "/nowhere", str(tmp_path)]) == str(tmp_path)


def test_paths_of_nested_documents(spark):
    docs = [
        '{"cik": 7, "facts": {"us-gaap": {"Assets": {"label": "a", "units": {"USD": [{"val": 1, "form": "10-K"}, {"val": 2.5, "form": "10-Q"}]}}}}}',
        '{"cik": "8", "facts": {"us-gaap": {}}}',
        "{broken",
        None,
        "3",
    ]
    got = {(r["path"], r["depth"], r["type"]): r["n"] for r in readers.json_paths(spark.createDataFrame([(d,) for d in docs], "doc string"), "doc").collect()}
    assert got.pop(("cik", 1, "BIGINT")) == 1 and got.pop(("cik", 1, "STRING")) == 1
    deep = "facts.us-gaap.Assets.units.USD[].val"
    assert sum(n for (path, depth, kind), n in got.items() if path == deep) == 2 and {d for p, d, _ in got if p == deep} == {7}
    assert got["facts", 1, "OBJECT"] == 2 and got["facts.us-gaap.Assets.units.USD[].form", 7, "STRING"] == 2
    with pytest.raises(ValueError):
        readers.json_paths(spark.createDataFrame([(docs[0],)], "doc string"), "doc", depth=3)


def test_fingerprints_follow_the_order_of_rows(spark):
    rows = [(k, k % 3, float(k * k % 7)) for k in range(200)]
    df = lambda r: spark.createDataFrame(r, "k int, g int, x double")
    swapped = [(k, g, rows[{10: 13, 13: 10}.get(k, k)][2]) for k, g, _ in rows]
    first = experiment.fingerprint(df(rows), ["k"])
    assert first == experiment.fingerprint(df(rows[::-1]).repartition(5), ["k"]) == experiment.fingerprint(df(rows).coalesce(1), ["k"])
    assert first != experiment.fingerprint(df(swapped), ["k"])
    assert first != experiment.fingerprint(df(rows), ["x", "k"])
    by = lambda r, n: {x["g"]: x["digest"] for x in experiment.ordered_fingerprints(df(r).repartition(n), "g", ["k"]).collect()}
    one, other = by(rows, 1), by(swapped, 4)
    assert by(rows, 7) == one and {g for g in one if one[g] != other[g]} == {1}


def test_rejections_come_from_the_preparation(spark):
    e, f = D(2019, 12, 31), D(2020, 2, 3)
    rows = [fact(1.0, e, f), fact(2.0, e, f), fact(2.0, e, f), fact(3.0, e, f, accn="b"), fact(float("nan"), e, f, accn="c"), fact(1.0, f, e, accn="d"), fact(1.0, e, f, None, accn="e")]
    df = spark.createDataFrame(rows, FACT)
    keys = facts.sifted(df).cache()
    assert {r["reason"]: r["n"] for r in facts.rejections(keys).collect()} == {"invalid": 3, "ambiguous": 2}
    order = sorted(facts.prepared(df).columns)
    assert sorted(map(str, facts.prepared_from(keys).select(order).collect())) == sorted(map(str, facts.prepared(df).select(order).collect()))
    assert {r["n"] for r in facts.rejections(facts.sifted(spark.createDataFrame([], FACT))).collect()} == {0}


def test_eligibility_counts_joint_sessions(spark):
    rng = np.random.default_rng(31)
    dates = days(150)
    there = {(k, a): rng.random() > (0.02 if a < 4 else 0.12) for k in range(150) for a in range(6)}
    rows = [(dates[k], a, 10.0 + a, 0.01 if rng.random() > 0.05 else None) for (k, a), t in there.items() if t]
    ret = {(r[0], r[1]): r[3] for r in rows}
    n, least, missing = 70, 45, 0.15
    got = {(r["date"], r["asset"]): (r["seen"], r["joint"]) for r in panel.eligibility(spark.createDataFrame(rows, "date date, asset int, price double, ret double"), n, least, missing).collect()}
    want = {}
    for k in range(150):
        window = dates[max(0, k - n) : k]
        fit = {}
        for a in range(6):
            seen = sum(ret.get((d, a)) is not None for d in window)
            if (dates[k], a) in ret and seen >= least and len(window) - seen <= missing * len(window) and any((d, a) in ret for d in dates[:k]):
                fit[a] = seen
        joint = sum(all(ret.get((d, a)) is not None for a in fit) for d in window)
        if fit and joint >= least:
            want |= {(dates[k], a): (s, joint) for a, s in fit.items()}
    assert got == want and want


def test_stress_is_filtered_in_order_and_weighs_variances(spark):
    rng = np.random.default_rng(32)
    x = np.where(np.arange(60) // 15 % 2, rng.normal(0, 0.06, 60), rng.normal(0, 0.02, 60))
    dates = days(60)
    market = spark.createDataFrame([(d, float(v)) for d, v in zip(dates, x)], "date date, market double")
    filtered = risk.filtered_stress(market, F.lit(0.02), F.lit(0.06), 0.9, 0.8)
    got = {r["date"]: r["stress"] for r in filtered.collect()}
    p, want = 0.5, {}
    for d, v in zip(dates, x):
        ahead = p * 0.8 + (1 - p) * 0.1
        hot, cold = (w * math.exp(-v * v / (2 * s * s)) / s for w, s in ((ahead, 0.06), (1 - ahead, 0.02)))
        p = want[d] = hot / (hot + cold)
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)
    r = rng.normal(0, 0.1, 60)
    returns = spark.createDataFrame([(d, 3, float(v)) for d, v in zip(dates, r)], "date date, asset int, ret double")
    ahead = spark.createDataFrame([(d, 0.3) for d in dates], "date date, stress_probability double")
    told = {x["date"]: x["regime_variance"] for x in risk.regime_variance(returns, filtered, ahead, 12).collect()}
    for k, d in enumerate(dates):
        if k < 12:
            assert told[d] is None
            continue
        w, y = np.array([want[e] for e in dates[k - 12 : k]]), r[k - 12 : k]
        own = lambda w: (w @ (y * y)) / w.sum() - ((w @ y) / w.sum()) ** 2  # noqa: B023, E731
        assert told[d] == pytest.approx(0.3 * own(w) + 0.7 * own(1 - w))


def test_models_come_back_and_short_years_end_the_run(spark, tmp_path):
    rng = np.random.default_rng(33)
    rows = [(D(2010 + m // 12, m % 12 + 1, 1), a, D(2010 + m // 12, m % 12 + 1, 28), float(rng.normal()), float(rng.normal())) for m in range(30) for a in range(8)]
    p = spark.createDataFrame(rows, "date date, asset int, label_end date, f double, target double")
    run = lambda frame, **kw: {(r["date"], r["asset"]): tuple(r) for r in forecast.walk_forward(frame, forecast.cutoffs(frame, 2011), ["f"], 2, 4, least=90, model_dir=str(tmp_path), **kw)[0].collect()}
    first = run(p)
    kept = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*") if f.is_file()}
    assert len(list(tmp_path.iterdir())) == 2  # 2011 and 2012
    assert run(p.repartition(5)) == first and {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*") if f.is_file()} == kept
    later = p.withColumn("target", F.when(F.col("date") == D(2011, 5, 1), 5.0).otherwise(F.col("target")))
    again = run(later)
    assert len(list(tmp_path.iterdir())) == 3  # what 2011 learns from has not changed
    assert {k: v for k, v in again.items() if k[0].year == 2011} == {k: v for k, v in first.items() if k[0].year == 2011}
    assert all(r[3] == D(r[2], 1, 1) and r[4] < r[3] for r in first.values())  # cutoff and last label
    with pytest.raises(ValueError, match="2011: 96 rows"):
        forecast.walk_forward(p, forecast.cutoffs(p, 2011), ["f"], 2, 2, least=97)


def test_only_absent_dates_are_computed(spark, tmp_path):
    asked = []

    def make(dates):
        got = sorted(r["date"] for r in dates.collect())
        asked.append(got)
        return dates.filter(F.col("date") != D(2020, 1, 2)).withColumn("x", F.dayofmonth("date") * 10)

    frame = lambda *d: spark.createDataFrame([(x,) for x in d], "date date")
    run = lambda content, *d: {r["date"]: r["x"] for r in sinks.kept_by_date(make, frame(*d), str(tmp_path), content).collect()}
    a, b, c = D(2020, 1, 1), D(2020, 1, 2), D(2020, 1, 3)  # nothing is known of the second
    assert run("v1", a, b, a) == {a: 10} == run("v1", a, b)
    assert run("v1", a, b, c) == {a: 10, c: 30} and run("v1", c) == {c: 30}
    assert asked == [[a, b], [], [c], []]
    assert run("v2", c) == {c: 30} and asked[-1] == [c]
    assert run("v3", b) == {} and run("v3", b) == {} and asked[-1] == []


def test_leaks_of_forecasts_are_found(spark):
    d = D(2020, 1, 1)
    universe = spark.createDataFrame([(d, 1, D(2019, 12, 31)), (d, 2, d), (d, 3, D(2019, 12, 31)), (d, 4, D(2019, 12, 31))], "date date, asset int, history_end date")
    predicted = spark.createDataFrame([(d, 1, d, D(2019, 12, 1), 0.1), (d, 2, d, d, 0.1), (d, 3, D(2020, 2, 1), D(2019, 1, 1), -0.1), (d, 3, d, D(2019, 1, 1), 0.1)], "date date, asset int, cutoff date, last_label_end date, variance double")
    got = {k: df.count() for k, df in forecast.leaks(predicted, universe).items()}
    assert got == {"fitted_after_formation": 1, "label_not_matured": 1, "history_not_prior": 1, "no_forecast": 2, "repeated_forecasts": 1}


def test_results_and_specifications(spark, tmp_path, two_assets):
    sinks.write_result({"returns": two_assets.withColumn("strategy", F.lit("s"))}, str(tmp_path / "r"))
    back = sinks.read_result(spark, str(tmp_path / "r"), "returns", strategy="s")
    assert back.count() == 6 and dict(back.dtypes)["date"] == "date"
    assert experiment.fingerprint(two_assets, ["date"]) == experiment.fingerprint(two_assets.repartition(3), ["date"])
    assert experiment.fingerprint(two_assets, ["date"]) != experiment.fingerprint(two_assets.withColumnRenamed("ret", "x"), ["date"])
    spec = lambda s: experiment.Specification({"cap": 0.15}, {"strength": [0, 0.5]}, {"strength": s}, ["f"], {"prices": "x"}, ["prices"])
    assert experiment.differences(spec(0.5), spec(0.5)) == [] and "selected" in experiment.differences(spec(0.5), spec(0))
    assert experiment.differences(spec(9), spec(9)) == ["selected.strength"] and spec(0).digest() != spec(0.5).digest()
    gone = spec(0)
    gone.sources = {}
    assert "sources.prices" in experiment.differences(spec(0), gone)
    with pytest.raises(ValueError):
        sinks.write_result({"returns": two_assets, "none": two_assets.limit(0)}, str(tmp_path / "partial"))
    assert not (tmp_path / "partial").exists()
    made = []
    make = lambda: made.append(1) or two_assets
    for content in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert sinks.content_cached(make, spark, str(tmp_path / "cache"), content).count() == 6
    assert len(made) == 2
    assert experiment.equal_results(two_assets, two_assets, ["date", "asset"], "ret")
    assert not experiment.equal_results(two_assets, two_assets.withColumn("ret", F.col("ret") + 1e-6), ["date", "asset"], "ret")
    m = experiment.Manifest(str(tmp_path / "m.json"))
    assert m.run({"a": lambda r: 1, "b": lambda r: r["a"] + 1}) == {"a": 1, "b": 2} and m.state["status"] == "complete"
    with pytest.raises(ZeroDivisionError):
        m.run({"a": lambda r: 1 / 0})
    assert m.state == {"status": "failed", "at": "a", "error": "ZeroDivisionError"}
    got = {r["name"]: r["passed"] for r in experiment.audit({"none": two_assets.filter("ret > 9"), "some": two_assets}).collect()}
    assert got == {"none": True, "some": False}


def test_price_splits(spark, tmp_path):
    (tmp_path / "train.csv").write_text("date,ticker,adj_close\n2020-01-02,A,1.5\n")
    (tmp_path / "test.csv").write_text("date,ticker,adj_close\n2021-01-04,A,2\n")
    rows = readers.prices(spark, {"train": str(tmp_path / "train.csv"), "test": str(tmp_path / "test.csv")}).orderBy("date").collect()
    assert [(r["split"], r["adj_close"]) for r in rows] == [("train", 1.5), ("test", 2.0)]


def test_streamed_bars_equal_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(path).repartition(4).write.parquet(str(tmp_path / "in"))
    bars = streaming.daily_bars(streaming.read_events(spark, str(tmp_path / "in")), "60 days")
    query = bars.writeStream.outputMode("complete").format("memory").queryName("streamed_bars").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["asset"], r["date"]): r["volume"] for r in spark.sql("SELECT * FROM streamed_bars").collect()}
    want = {(r["asset"], r["date"]): r["volume"] for r in spark.read.parquet(path).groupBy(F.col("event_type").alias("asset"), F.to_date("ts").alias("date")).agg(F.count("*").alias("volume")).collect()}
    assert got == want
