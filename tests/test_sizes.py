"""What tables of any size rest on: ranks that no single task holds, facts that are dealt by issuer once, and what is sent to them."""

import datetime as dt
import random
import re

import pytest

from tallyglass.operators import facts
from tallyglass.plans import facts_queries, profile_queries, storage_queries  # noqa: F401
from tallyglass.plans.registry import QUERIES
from tallyglass.sources import views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quality_ranks_equal_the_rule_and_no_window_holds_a_date(spark):
    r = random.Random(7)
    value = lambda: r.choice([None, 0.0, -0.0, 5e-324, 1e308, -1e308, 1.0, 2.0, -2.0, r.gauss(0, 1), r.gauss(0, 1), round(r.gauss(0, 1), 1), 10 ** r.uniform(-9, 9)])
    rows = [(i, dt.date(2020, m, 1), *(value() for _ in facts.RATIOS), 0.0) for i in range(300) for m in (1, 4)]
    df = spark.createDataFrame(rows, "issuer long, date date, " + ", ".join(f"{k} double" for k in facts.RATIOS) + ", missing double")
    scored = facts.quality(df)
    ratios = "|".join(facts.RATIOS)
    assert not re.search(rf"windowspecdefinition\(date#\d+, ({ratios})#", scored._jdf.queryExecution().optimizedPlan().toString())
    got = {(x["issuer"], x["date"]): x for x in scored.collect()}
    assert len(got) == len(rows)
    for date in (dt.date(2020, 1, 1), dt.date(2020, 4, 1)):
        there = [x for x in rows if x[1] == date]
        rank = {}
        for j, k in enumerate(facts.RATIOS):
            values = sorted(x[2 + j] for x in there if x[2 + j] is not None)
            for x in there:
                v = x[2 + j]
                at = None if v is None else (sum(y < v for y in values) + (values.count(v) + 1) / 2) / len(values)
                rank[x[0], k] = 0.5 if at is None else (at - 0.5) * facts.SIGNS[k] + 0.5
        for x in there:
            domains = {d: sum(rank[x[0], k] for k in ks) / len(ks) for d, ks in facts.DOMAINS.items()}
            assert all(got[x[0], date][d] == pytest.approx(v, abs=1e-12) for d, v in domains.items())
            assert got[x[0], date]["score"] == pytest.approx(sum(domains.values()) / len(domains), abs=1e-12)


def test_facts_dealt_by_issuer_are_not_shuffled_again(spark):
    n = views.parts(spark, SF)
    told = views.facts(spark, SF, n)
    assert told.rdd.getNumPartitions() == n
    forms = spark.createDataFrame([(dt.date(1997, 1, 2), dt.date(1997, 1, 1)), (dt.date(1998, 1, 2), dt.date(1998, 1, 1))], "date date, information date")
    issuers = facts_queries._issuers(spark, SF)
    prepared = facts.prepared(told)
    dealt = r"Exchange hashpartitioning\((?!l_orderkey|o_orderkey)[^)]*\), ENSURE"
    for df in (prepared, facts.picks(facts.visible(prepared, forms)), facts.snapshots(prepared, issuers, forms), facts.filing_history(prepared, forms), facts.sifted(told)):
        assert not re.search(dealt, plan(df))


def test_partitions_grow_with_the_lines(spark, monkeypatch):
    lines = views.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(views, "LINES", 100)
    assert views.parts(spark, SF) == max(spark.sparkContext.defaultParallelism, 1 + lines // 100)


@pytest.mark.parametrize("name", ["repeated_publications", "fact_rejections", "facts_before_cutoff", "asof_picks", "revenue_growth", "fundamental_snapshots"])
def test_queries_of_facts_shuffle_lines_not_facts(spark, name):
    assert not re.search(r"Exchange hashpartitioning\((ok#\d+, )?issuer#\d+L?, [a-z_]\w*#", plan(QUERIES[name](spark, SF)))


def test_documents_of_filings_shuffle_lines_not_facts(spark):
    assert not re.search(r"Exchange hashpartitioning\(issuer#\d+L?, \w+#", plan(storage_queries._filings(views.facts(spark, SF, 4))))


def test_the_rules_of_time_are_checked_in_one_pass(spark):
    d = lambda *x: dt.date(*x)
    rows = [(1, d(2020, 1, 2), d(2020, 1, 1), d(2019, 5, 1), d(2019, 5, 2)), (1, d(2020, 1, 2), d(2020, 1, 2), d(2020, 1, 2), d(2020, 1, 3)), (2, d(2020, 1, 2), d(2020, 1, 1), None, None)]
    panel_ = spark.createDataFrame(rows, "issuer long, date date, information date, latest_used_filed date, latest_used_available date")
    assert {r["name"]: r["n"] for r in facts.leaks(panel_).collect()} == {"repeated_keys": 1, "used_before_available": 1, "information_not_prior": 1, "filed_not_prior": 1}
    assert [r["n"] for r in facts.leaks(panel_.filter("false")).collect()] == [0, 0, 0, 0]
    assert len(re.findall(r"explode\(sequence", facts.leaks(facts_queries._snapshots(spark, SF, filings=False))._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_facts_are_not_dealt_to_months_without_formations(spark):
    rows = [(i, "assets", "assets_0", 1.0, d, d, d, i, 0, "10-K") for i, d in enumerate([dt.date(1996, 1, 1), dt.date(1996, 3, 31), dt.date(1996, 12, 31)])]
    told = facts.prepared(spark.createDataFrame(rows, "issuer long, metric string, concept string, value double, start date, end date, filed date, accn long, priority int, form string"))
    forms = spark.createDataFrame([(dt.date(y, m, 3), dt.date(y, m, 2)) for y in range(1995, 2000) for m in (1, 4, 7, 10)], "date date, information date")
    got = {(r["issuer"], r["date"]) for r in facts.visible(told, forms).collect()}
    assert got == {(r["issuer"], f["date"]) for r in told.collect() for f in forms.collect() if r["available"] <= f["information"] and r["end"] >= f["date"] - dt.timedelta(facts.MAX_AGE)}
    dealt = facts.visible(told, forms)._jdf.queryExecution().optimizedPlan().toString()
    assert "month(" not in dealt and "explode(sequence" in dealt


def test_means_of_quality_equal_those_of_its_issuers_and_no_rank_goes_back(spark):
    from pyspark.sql import functions as F

    r = random.Random(8)
    value = lambda: r.choice([None, 0.0, 1.0, -2.0, r.gauss(0, 1), r.gauss(0, 1)])
    rows = [(i, (None, 1, 2, 3)[i % 4], dt.date(2020, m, 1), *((None,) * 9 if i % 4 == 3 else (value() for _ in facts.RATIOS)), (i % 10) / 10, float(i), dt.date(2020, 1, 1 + i % 20)) for i in range(300) for m in (1, 4)]
    df = spark.createDataFrame(rows, "issuer long, asset int, date date, " + ", ".join(f"{k} double" for k in facts.RATIOS) + ", missing double, known_filings double, latest date")
    told = facts.mean_quality(df, "asset", ["roa", "known_filings"], ["latest"])
    assert not re.search(r"Exchange hashpartitioning\((issuer|asset)", plan(told)) and "issuer" not in plan(told)
    got = {(x["date"], x["asset"]): x.asDict() for x in told.collect()}
    want = facts.quality(df).groupBy("date", "asset").agg(*(F.avg(c).alias(c) for c in ("roa", "known_filings", "score", "coverage")), F.max("latest").alias("latest")).collect()
    assert len(got) == len(want) == 8
    for x in want:
        for c, v in x.asDict().items():
            assert got[x["date"], x["asset"]][c] == (pytest.approx(v, abs=1e-12) if isinstance(v, float) else v), c


def test_snapshots_meet_their_ranks_in_partitions_that_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(facts, "ROWS", 10, raising=False)
    df = spark.createDataFrame([(i, dt.date(2020, 1, 1), *(float(i),) * 9, 0.0) for i in range(300)], "issuer long, date date, " + ", ".join(f"{k} double" for k in facts.RATIOS) + ", missing double")
    assert plan(facts.quality(df)).count("hashpartitioning(issuer#") >= 2 and re.search(r"hashpartitioning\(issuer#\d+L, date#\d+, 31\)", plan(facts.quality(df)))


def test_quality_alone_takes_no_history_of_filings(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(facts, "filing_history", lambda *a: asked.append(a))
    forms = spark.createDataFrame([(dt.date(1997, 1, 2),)], "date date")
    assert {r["quality"] > 0 for r in facts_queries.nation_quality(spark, SF, forms).collect()} == {True} and asked == []


def test_the_history_of_filings_is_added_up_apart_from_snapshots(spark, monkeypatch):
    from pyspark.sql import functions as F

    asked, whole = [], facts.snapshots
    monkeypatch.setattr(facts, "snapshots", lambda *a, **k: asked.append([*a[3:], *k.values()]) or whole(*a, **k))
    forms = spark.createDataFrame([(dt.date(y, m, 2),) for y in (1992, 1994, 1997) for m in (1, 7)], "date date")
    got = {(r["date"], r["asset"]): r for r in facts_queries.nation_fundamentals(spark, SF, forms).collect()}
    assert asked == [[False]]
    n = views.parts(spark, SF)
    issuers = facts_queries._issuers(spark, SF, F.col("c_nationkey").cast("int").alias("asset"))
    told = whole(facts.prepared(views.facts(spark, SF, n)), issuers, forms.withColumn("information", F.date_sub("date", 1)))
    want = told.groupBy("date", "asset").agg(F.avg("known_filings").alias("known_filings"), F.avg("amended").alias("amended"), F.avg("missing").alias("missing")).collect()
    assert len(got) == len(want) and any(r["known_filings"] for r in want) and any(r["known_filings"] == 0 and r["amended"] is None for r in want)
    for r in want:
        for c in ("known_filings", "amended", "missing"):
            assert got[r["date"], r["asset"]][c] == (None if r[c] is None else pytest.approx(r[c], abs=1e-12)), c


def test_filings_are_grouped_without_another_sort_of_facts(spark):
    forms = spark.createDataFrame([(dt.date(1997, 1, 2), dt.date(1997, 1, 1))], "date date, information date")
    assert "min(struct(" not in plan(facts.filing_history(facts.prepared(views.facts(spark, SF, 4)), forms))
