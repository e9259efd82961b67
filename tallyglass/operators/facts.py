"""Operators on dated facts that are known from a later day on (bitemporal data).

A fact (issuer, metric, concept, value, start, end, filed, accn, priority, form) is available
from the first business day after its filing. Nothing that was filed later may change what a
snapshot of an earlier day shows. A metric can be told by several concepts, of which that of
the lowest priority number is preferred.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.columns import average_rank, finite, guarded_ratio, missing_share, next_business_day
from tallyglass.sources.sinks import written

# Fixed values.
FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A")
ANNUAL_FORMS = ("10-K", "10-K/A")
FLOWS = ("revenue", "income", "operating_income", "cash_flow", "capex")
YEAR = (330, 400)
MAX_AGE = 550
LAST_FILINGS = 20
KEYS = ("issuer", "concept", "start", "end", "filed", "accn")
#: Metrics whose latest yearly end is the annual end, and what is read at either end.
ANNUAL = ("revenue", "income", "cash_flow")
AT_ANNUAL_END = ("assets", "income", "cash_flow", "revenue", "operating_income", "capex")
AT_BALANCE_END = ("assets", "equity", "cash", "liabilities", "current_assets", "current_liabilities")
#: The ratios of the quality score by domain; -1 where less is better.
DOMAINS = {
    "profitability": {"roa": 1, "operating_margin": 1},
    "balance_sheet": {"equity_share": 1, "cash_share": 1, "leverage": -1},
    "cash_generation": {"cash_flow_to_assets": 1, "accruals": -1, "free_cash_flow": 1},
    "liquidity": {"current_ratio": 1},
}
SIGNS = {k: sign for domain in DOMAINS.values() for k, sign in domain.items()}
RATIOS = tuple(SIGNS)


def with_duration(facts: DataFrame) -> DataFrame:
    """Days from start to end. (O-26)"""
    return facts.withColumn("duration", F.date_diff("end", "start"))


def _is_valid() -> Column:
    flow = ~F.col("metric").isin(*FLOWS) | (F.col("duration").between(*YEAR) & F.col("form").isin(*ANNUAL_FORMS))
    there = F.col("end").isNotNull() & F.col("filed").isNotNull() & F.col("accn").isNotNull()
    return F.col("form").isin(*FORMS) & there & finite(F.col("value")).isNotNull() & (F.col("end") <= F.col("filed")) & flow


def valid(facts: DataFrame) -> DataFrame:
    """Known forms, present keys, finite values, no end after filing, and yearly flows only. (O-21, O-23, O-24)"""
    return facts.filter(_is_valid())


def before_cutoff(facts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Facts of issuers with a cutoff (issuer, cutoff) only if filed before it. (O-22)"""
    return facts.join(cutoffs, "issuer", "left").filter("cutoff IS NULL OR filed < cutoff").drop("cutoff")


def unambiguous(facts: DataFrame) -> DataFrame:
    """Exact repeats become one; keys that still have several values are left out. (O-61)

    One aggregation: the least and the greatest value of a key tell both. Of repeats under
    several forms the first by name stays.
    """
    kept = [F.min(c).alias(c) for c in ("metric", "priority", "form", "duration", "value")]
    return facts.groupBy(*KEYS).agg(*kept, F.max("value").alias("_high")).filter("value = _high").drop("_high")


def available(facts: DataFrame) -> DataFrame:
    """The first day a fact may be used. (O-27)"""
    return facts.withColumn("available", next_business_day(F.col("filed")))


def prepared(facts: DataFrame) -> DataFrame:
    return available(unambiguous(valid(with_duration(facts))))


def sifted(facts: DataFrame) -> DataFrame:
    """Each key of the valid facts with the rows and different values that it has, and an issuer's invalid rows as one row. (O-25)

    One pass: the aggregation that ``prepared`` needs carries its own rejections. Invalid rows lose all keys but the issuer
    first, so a task has one row for each issuer's. (Counting them on the side, by accumulators, would
    count a task twice that is run again after its executor is lost.)
    """
    f = with_duration(facts)
    ok = F.coalesce(_is_valid(), F.lit(False))
    rows = f.select(ok.alias("ok"), "issuer", *(F.when(ok, F.col(c)).alias(c) for c in (*KEYS[1:], "metric", "priority", "form", "duration", "value")))
    kept = [F.min(c).alias(c) for c in ("metric", "priority", "form", "duration")]
    each = rows.groupBy("ok", *KEYS, "value").agg(*kept, F.count("*").alias("_n"))
    return each.groupBy("ok", *KEYS).agg(*kept, F.min("value").alias("value"), F.max("value").alias("_high"), F.sum("_n").alias("_rows"), F.count("value").alias("_values"))


def prepared_from(keys: DataFrame) -> DataFrame:
    """The prepared facts of a ``sifted`` table. (O-23, O-24, O-27, O-61)"""
    return available(keys.filter("ok AND value = _high").drop("ok", "_high", "_rows", "_values"))


def rejections(keys: DataFrame) -> DataFrame:
    """reason, n of facts, or of a ``sifted`` table of them: rows that are invalid, and values under keys that have several. (O-25)"""
    if "ok" not in keys.columns:
        keys = sifted(keys)
    several = F.when(F.col("ok") & (F.col("value") != F.col("_high")), F.col("_values"))
    counts = keys.agg(F.coalesce(F.sum(F.when(~F.col("ok"), F.col("_rows"))), F.lit(0)).alias("invalid"), F.coalesce(F.sum(several), F.lit(0)).cast("long").alias("ambiguous"))
    return counts.unpivot([], ["invalid", "ambiguous"], "reason", "n")


def _choice() -> Column:
    """What tells which fact of a metric is taken, the greatest: the latest end, the preferred concept, the last filing, the high accession."""
    return F.struct("end", (-F.col("priority")).alias("p"), "filed", "accn", "start", "value", "available")


_quarters = lambda c: F.year(c) * 4 + F.quarter(c)


def visible(facts: DataFrame, formations: DataFrame, max_age: int | Column = MAX_AGE) -> DataFrame:
    """Each fact at each formation (number, date, information) that may use it. (O-38)

    ``formations`` is the calendar, one row for each date, so it is sent to the facts, which stay where they are. They
    meet it by quarter of age: a fact meets the formations of its lifetime and no others, so rows grow with
    the facts, not with facts times dates. (By month most of a fact's rows would meet no formation.)
    """
    last = F.greatest(_quarters("available"), _quarters(F.date_add("end", max_age)))
    lived = facts.withColumn("_quarter", F.explode(F.sequence(_quarters("available"), last)))
    dated = formations.withColumn("_quarter", _quarters("date"))
    return lived.join(F.broadcast(dated), "_quarter").filter((F.col("available") <= F.col("information")) & (F.col("end") >= F.date_sub("date", max_age))).drop("_quarter")


def picks(seen: DataFrame) -> DataFrame:
    """For each issuer, date and metric the fact that ``_choice`` prefers. (O-38)"""
    out = seen.groupBy("issuer", "date", "metric").agg(F.max(_choice()).alias("x"))
    return out.select("issuer", "date", "metric", "x.end", "x.value", "x.filed", "x.available")


def matched(facts: DataFrame, formations: DataFrame) -> DataFrame:
    """By issuer and date both ends, the picks (value, filed, available, end) at them, a_ and b_ metrics, and ``prior``. (O-39, O-40)

    Flows and their denominator are those of the annual end, balances those of the latest
    end of assets. ``prior`` is the revenue that ended 330 to 400 days before the annual end, whatever its age: revenue
    is seen that much longer than other facts, and only what is ``MAX_AGE`` old at most tells the ends.
    """
    names = list(dict.fromkeys((*AT_ANNUAL_END, *AT_BALANCE_END)))
    number = F.array_position(F.array(*map(F.lit, names)), F.col("metric")).cast("int")  # told once for a fact, compared at each formation
    known = facts.filter(F.col("metric").isin(*names)).select("issuer", number.alias("m"), (F.col("metric") == "revenue").alias("longer"), "end", "available", _choice().alias("fact"))
    seen = visible(known, formations, F.when(F.col("longer"), MAX_AGE + YEAR[1]).otherwise(MAX_AGE)).select("issuer", "date", "m", "end", "fact")
    is_ = lambda metric: F.col("m") == names.index(metric) + 1
    by = Window.partitionBy("issuer", "date")
    fresh = F.col("end") >= F.date_sub("date", MAX_AGE)
    end_of = lambda metrics: F.max(F.when(reduce(lambda a, b: a | b, map(is_, metrics)) & fresh, F.col("end"))).over(by)
    marked = seen.withColumn("annual_end", end_of(ANNUAL)).withColumn("balance_end", end_of(["assets"]))
    pick = lambda metric, there: F.max(F.when(is_(metric) & there, F.col("fact")))
    at = lambda end: F.col("end") == F.col(end)
    return marked.groupBy("issuer", "date").agg(
        F.max("annual_end").alias("annual_end"),
        F.max("balance_end").alias("balance_end"),
        *(pick(m, at("annual_end")).alias(f"a_{m}") for m in AT_ANNUAL_END),
        *(pick(m, at("balance_end")).alias(f"b_{m}") for m in AT_BALANCE_END),
        pick("revenue", F.date_diff("annual_end", "end").between(*YEAR)).alias("prior"),
    )


def filing_history(facts: DataFrame, formations: DataFrame, last: int = LAST_FILINGS) -> DataFrame:
    """issuer, date, known_filings, amended at the formations (date, information) by which an issuer has filed. (O-58)

    All filings known by then count, however old: accessions, and the share of amendments
    among the last filings (filed, accn, form) in the order in which they became available.
    What a filing makes known stands until the next one, so it meets the formations between the two.
    """
    # end and priority as one number that keeps their order: a struct would be aggregated by another sort of all facts
    first = F.unix_date("end").cast("long") * (1 << 32) + F.coalesce("priority", F.lit(-(1 << 31)))
    filings = facts.groupBy("issuer", "available", "filed", "accn", "form").agg(F.min(first).alias("o"))
    order = ["available", "o", "accn", "form"]
    w = Window.partitionBy("issuer").orderBy(*order)
    new = F.row_number().over(Window.partitionBy("issuer", "accn").orderBy(*order)) == 1
    told = filings.withColumn("new", new.cast("int")).select(
        "issuer",
        "available",
        F.avg(F.col("form").endswith("/A").cast("int")).over(w.rowsBetween(1 - last, 0)).alias("amended"),
        F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("known_filings"),
        F.lead("available").over(w).alias("_next"),
    )
    stands = (F.col("available") <= F.col("information")) & (F.col("_next").isNull() | (F.col("_next") > F.col("information")))
    met = told.filter("_next IS NULL OR _next > available").join(F.broadcast(formations.select("date", "information")), stands)  # a calendar: some dates a year
    return met.select("issuer", "date", "known_filings", "amended")


def mean_history(facts: DataFrame, issuers: DataFrame, formations: DataFrame, by: str) -> DataFrame:
    """date, ``by``, known (filings of all its issuers by then) and the mean of ``amended`` over those that have filed, for ``mean_quality``. (O-43, O-58)

    ``issuers``: issuer, ``by``. Each task adds up the issuers that it has, where their facts were dealt, so no history goes to a snapshot.
    """
    told = filing_history(facts, formations).join(issuers, "issuer")
    return told.groupBy("date", by).agg(F.sum("known_filings").alias("known"), F.avg("amended").alias("amended"))


def snapshots(facts: DataFrame, issuers: DataFrame, formations: DataFrame, filings: bool = True) -> DataFrame:
    """Each of ``issuers`` (issuer) at each formation: ratios, growth, ages and coverage. (O-117 to O-122, O-124)

    The grid is the result, with the other columns of ``issuers``. An issuer without known facts has null ratios, no filings and
    ``missing`` 1. Ages are those of the facts that are used: ``filing_lag`` is that of the
    last one filed (of several, with the latest end). Picks, filings and the grid stand below each other and are
    grouped, which where all are dealt by issuer takes no further shuffle. Without ``filings`` their history is left out.
    """
    v = lambda c: F.col(f"{c}.value")
    before = F.when(v("prior") > 0, F.col("prior"))
    wide = matched(facts, formations).withColumn("prior", before)
    used = [*(f"a_{m}" for m in AT_ANNUAL_END), "prior", *(f"b_{m}" for m in AT_BALANCE_END)]
    rows = wide.withColumn("latest", F.greatest(*(F.when(F.col(c).isNotNull(), F.struct(f"{c}.filed", f"{c}.end")) for c in used)))
    ratios = {
        "roa": guarded_ratio(v("a_income"), v("a_assets")),
        "operating_margin": guarded_ratio(v("a_operating_income"), v("a_revenue")),
        "cash_flow_to_assets": guarded_ratio(v("a_cash_flow"), v("a_assets")),
        "accruals": guarded_ratio(v("a_income") - v("a_cash_flow"), v("a_assets")),
        "free_cash_flow": guarded_ratio(v("a_cash_flow") - v("a_capex"), v("a_assets")),
        "equity_share": guarded_ratio(v("b_equity"), v("b_assets")),
        "cash_share": guarded_ratio(v("b_cash"), v("b_assets")),
        "leverage": guarded_ratio(v("b_liabilities"), v("b_assets")),
        "current_ratio": guarded_ratio(v("b_current_assets"), v("b_current_liabilities")),
    }
    told = rows.select(
        "issuer",
        "date",
        "annual_end",
        "balance_end",
        *(ratios[k].alias(k) for k in RATIOS),
        (guarded_ratio(v("a_revenue"), v("prior")) - 1).alias("revenue_growth"),
        F.when(v("b_assets") > 0, F.ln(v("b_assets"))).alias("log_assets"),
        F.date_diff("date", "annual_end").alias("annual_age"),
        F.date_diff("date", F.col("latest.filed")).alias("report_age"),
        F.date_diff(F.col("latest.filed"), F.col("latest.end")).alias("filing_lag"),
        F.col("latest.filed").alias("latest_used_filed"),
        F.greatest(*(F.col(f"{c}.available") for c in used)).alias("latest_used_available"),
    )
    grid = issuers.crossJoin(F.broadcast(formations.select("date", "information")))  # a calendar: some dates a year
    both = grid.unionByName(told, allowMissingColumns=True)
    if filings:
        both = both.unionByName(filing_history(facts, formations), allowMissingColumns=True)
    one = both.filter("issuer IS NOT NULL").groupBy("issuer", "date").agg(*(F.max(c).alias(c) for c in both.columns if c not in ("issuer", "date")))
    out = one.filter("information IS NOT NULL")  # facts of others than ``issuers`` have no grid
    if filings:
        out = out.withColumn("known_filings", F.coalesce("known_filings", F.lit(0).cast("long")))
    return out.withColumn("missing", missing_share(*(F.col(k) for k in RATIOS)))


def _ranks(snapshot: DataFrame, by: str) -> DataFrame:
    """``by``, date, k and r, the signed rank of the k-th ratio among the date's, for each ratio that is there. (O-94)

    A date has as many values as there are issuers, so they are not sorted in one task: values are dealt into
    bins that keep their order (eighths of an octave), ranked within them, and the values in the bins before are added.
    """
    listed = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.col(k).alias("x")) for i, k in enumerate(RATIOS))))
    x = F.col("x")
    eighth = lambda c: F.floor(F.log2(c) * 8).cast("int") + 10_000  # noqa: E731  (doubles have at most 8,600 eighths on either side of 1)
    values = snapshot.select(by, "date", listed.alias("_v")).select(by, "date", "_v.*").filter("x IS NOT NULL")
    binned = values.withColumn("bin", F.when(x > 0, eighth(x)).when(x < 0, -eighth(-x)).otherwise(0))
    each = Window.partitionBy("date", "k")  # one row for each bin
    counts = binned.groupBy("date", "k", "bin").agg(F.count("*").alias("n"))
    bins = counts.select("date", "k", "bin", (F.sum("n").over(each.orderBy("bin")) - F.col("n")).alias("before"), F.sum("n").over(each).alias("all"))
    within = binned.withColumn("rank", average_rank(x, "date", "k", "bin"))
    sign = F.element_at(F.array(*(F.lit(SIGNS[k]) for k in RATIOS)), F.col("k") + 1)
    return within.join(F.broadcast(bins), ["date", "k", "bin"]).select(by, "date", "k", (((F.col("before") + F.col("rank")) / F.col("all") - 0.5) * sign + 0.5).alias("r"))


def _mean(columns: Collection[Column | float]) -> Column:
    return reduce(lambda a, b: a + b, columns) / len(columns)


#: Rows of a snapshot that meet their ranks in one task.
ROWS = 1_000_000


def quality(snapshot: DataFrame) -> DataFrame:
    """``snapshot`` with the mean of the domains' signed ranks by date, in 0 to 1, and the coverage. (O-59, O-123)

    A missing ratio has the neutral rank 0.5, so an issuer without facts scores 0.5. The snapshot is written, as
    it is read for the ranks too. Both meet in partitions that grow in number with its rows.
    """
    kept = written(snapshot)
    n = max(kept.sparkSession.sparkContext.defaultParallelism, 1 + kept.count() // ROWS)
    ranks = _ranks(kept, "issuer").repartition(n, "issuer", "date").groupBy("issuer", "date").agg(*(F.max(F.when(F.col("k") == i, F.col("r"))).alias(f"_{k}") for i, k in enumerate(RATIOS)))
    ranked = kept.repartition(n, "issuer", "date").join(ranks, ["issuer", "date"], "left")
    for domain, part in DOMAINS.items():
        ranked = ranked.withColumn(domain, _mean([F.coalesce(f"_{k}", F.lit(0.5)) for k in part]))
    score = _mean([F.col(d) for d in DOMAINS])
    return ranked.withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).withColumn("coverage", 1 - F.col("missing")).drop(*(f"_{k}" for k in RATIOS))


def mean_quality(snapshot: DataFrame, by: str, means: Collection[str], latest: Collection[str] = (), history: DataFrame | None = None) -> DataFrame:
    """date, ``by``, the means of ``means`` and of ``quality``'s score and coverage, and the greatest of ``latest``, over its issuers. (O-43, O-123)

    A score is a mean of ranks, so a group's mean is told by its sums of ranks: each task adds up the ranks that it has, and none
    goes back to its issuer. Of issuers only what is averaged here is written. ``history`` is that of ``mean_history``: with it
    the means of known_filings and amended are there too.
    """
    kept = written(snapshot.select("date", by, *dict.fromkeys([*RATIOS, "missing", *means, *latest])))
    sums = _ranks(kept, by).groupBy("date", by).agg(*(F.sum(F.when(F.col("k") == i, F.col("r"))).alias(f"_{k}") for i, k in enumerate(RATIOS)))
    told = kept.groupBy("date", by).agg(
        F.count("*").alias("_n"),
        *(F.count(k).alias(f"_n_{k}") for k in RATIOS),
        *(F.avg(c).alias(c) for c in means),
        F.avg(1 - F.col("missing")).alias("coverage"),
        *(F.max(c).alias(c) for c in latest),
    )
    rank = {k: (F.coalesce(f"_{k}", F.lit(0.0)) + 0.5 * (F.col("_n") - F.col(f"_n_{k}"))) / F.col("_n") for k in RATIOS}
    score = _mean([_mean([rank[k] for k in part]) for part in DOMAINS.values()])
    both = told.unionByName(sums, allowMissingColumns=True)
    filed = []
    if history is not None:
        both = both.unionByName(history, allowMissingColumns=True)
        filed = [(F.coalesce("known", F.lit(0)) / F.col("_n")).alias("known_filings"), "amended"]
    one = both.groupBy("date", by).agg(*(F.max(c).alias(c) for c in both.columns if c not in ("date", by)))
    return one.select("date", by, *means, *filed, score.alias("score"), "coverage", *latest)


def leaks(panel: DataFrame) -> DataFrame:
    """name, n: rows of a snapshot panel that break a rule of time, or repeat a key. (O-124)

    One pass: the rows of a key are counted where the panel's own grouping left them, and its violations with them.
    """
    rules = {
        "used_before_available": ~(F.col("latest_used_available") <= F.col("information")),
        "information_not_prior": ~(F.col("information") < F.col("date")),
        "filed_not_prior": ~(F.col("latest_used_filed") < F.col("date")),
    }
    keys = panel.groupBy("issuer", "date").agg((F.count("*") - 1).alias("repeated_keys"), *(F.count_if(bad).alias(k) for k, bad in rules.items()))
    names = ["repeated_keys", *rules]
    return keys.agg(*(F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in names)).unpivot([], names, "name", "n")
