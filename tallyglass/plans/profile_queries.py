"""Data profiling and quality queries over order lines, facts and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyglass.operators import facts as facts_ops
from tallyglass.plans.panel_queries import rounded
from tallyglass.operators import experiment
from tallyglass.plans.registry import query
from tallyglass.sources.views import BARS_SQL, FACTS_SQL, bars, facts, parts, table


@query(
    "universe_profile",
    """WITH x AS (SELECT l_suppkey AS asset, l_shipdate::DATE AS date, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_tax = 0 THEN -l_quantity ELSE l_quantity END AS v FROM lineitem)
SELECT asset, count(*) AS n, count(DISTINCT date) AS dates, min(date) AS first, max(date) AS last, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (v <= 0) AS non_positive,
 count(*) FILTER (v IS NULL OR NOT isfinite(v)) AS non_finite FROM x GROUP BY 1""",
)
def universe_profile(spark, sf_dir):
    """Rows, dates and bad values by asset; a missing value is also not finite. (O-53)"""
    v = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_tax") == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("asset"), F.col("l_shipdate").cast("date").alias("date"), v.alias("v"))
    bad = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    return x.groupBy("asset").agg(
        F.count("*").alias("n"), F.count_distinct("date").alias("dates"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_if(F.col("v").isNull()).alias("missing"), F.count_if(F.col("v") <= 0).alias("non_positive"), F.count_if(bad).alias("non_finite")
    )


@query("complete_history", f"WITH {BARS_SQL} SELECT asset, count(*) AS n FROM bars GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT date) FROM bars) AND count(DISTINCT date) = count(*) AND min(price) > 0")
def complete_history(spark, sf_dir):
    """Assets with a price on every date. (O-54)"""
    b = bars(spark, sf_dir)
    total = b.agg(F.count_distinct("date").alias("total"))
    per = b.groupBy("asset").agg(F.count("*").alias("n"), F.count_distinct("date").alias("d"), F.min("price").alias("low"))
    return per.crossJoin(total).filter("n = total AND d = n AND low > 0").select("asset", "n")  # one row


@query(
    "largest_issuers",
    """WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 50)
SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey IN (SELECT o_custkey FROM c) GROUP BY 1""",
)
def largest_issuers(spark, sf_dir):
    """The 50 issuers with the most records, and their totals: a top-n selection by semi join. (O-47, O-55)"""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    top = o.groupBy("o_custkey").count().orderBy(F.desc("count"), "o_custkey").limit(50)
    return o.join(top, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("filtered_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-06-30' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)")
def filtered_scan(spark, sf_dir):
    """Column and date pushed into the scan, keys by semi join. (O-2, O-3, O-28)"""
    l = table(spark, sf_dir, "lineitem").filter((F.col("l_shipdate") >= F.lit("1995-03-01").cast("timestamp_ntz")) & (F.col("l_shipdate") <= F.lit("1995-06-30").cast("timestamp_ntz")))
    keys = table(spark, sf_dir, "supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").alias("l_suppkey"))
    return l.join(keys, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("unmatched_customers", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1998-01-01')")
def unmatched_customers(spark, sf_dir):
    """Identifiers without a record since 1998. (O-48, O-107)"""
    recent = table(spark, sf_dir, "orders").filter("o_orderdate >= DATE '1998-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(recent, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(
    "unambiguous_parts",
    """WITH s AS (SELECT l_partkey, min(l_suppkey) AS supplier, count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_linenumber = 7 GROUP BY 1)
SELECT p_partkey, p_brand, CASE WHEN suppliers = 1 THEN supplier END AS supplier, suppliers FROM part JOIN s ON p_partkey = l_partkey""",
)
def unambiguous_parts(spark, sf_dir):
    """Keys of seventh lines joined where they map to exactly one other key; the ambiguous ones are told, without a match. (O-49)"""
    s = table(spark, sf_dir, "lineitem").filter("l_linenumber = 7").groupBy("l_partkey").agg(F.min("l_suppkey").alias("low"), F.count_distinct("l_suppkey").alias("suppliers"))
    joined = table(spark, sf_dir, "part").join(s, F.col("p_partkey") == F.col("l_partkey"))
    return joined.select("p_partkey", "p_brand", F.when(F.col("suppliers") == 1, F.col("low")).alias("supplier"), "suppliers")


@query(
    "mapped_nations",
    """SELECT s_suppkey, coalesce(o.n_name, n.n_name) AS nation, o.n_name IS NOT NULL AS overridden FROM supplier LEFT JOIN nation n ON n.n_nationkey = s_nationkey LEFT JOIN (SELECT n_nationkey + 100 AS k, n_name FROM nation WHERE n_nationkey < 3) o ON o.k = s_nationkey + 100""",
)
def mapped_nations(spark, sf_dir):
    """A dictionary look-up with overrides. (O-50)"""
    n = table(spark, sf_dir, "nation")
    over = n.filter("n_nationkey < 3").select(F.col("n_nationkey").alias("ok"), F.col("n_name").alias("over"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = s.join(n.select(F.col("n_nationkey").alias("nk"), "n_name"), F.col("s_nationkey") == F.col("nk"), "left").join(over, F.col("s_nationkey") == F.col("ok"), "left")
    return joined.select("s_suppkey", F.coalesce("over", "n_name").alias("nation"), F.col("over").isNotNull().alias("overridden"))


@query("duplicate_lines", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def duplicate_lines(spark, sf_dir):
    """All rows of keys that repeat; null keys count together. (O-60)"""
    w = Window.partitionBy("l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.count("*").over(w).alias("n")).filter("n > 1").drop("n")


@query(
    "repeated_publications",
    f"""WITH {FACTS_SQL} SELECT issuer, metric, "end", count(*) AS n, count(DISTINCT accn) AS accessions, count(DISTINCT filed) AS filings, count(DISTINCT value) AS distinct_values,
 count(DISTINCT value) > 1 AND max(filed) > min(filed) AS restated FROM facts0 GROUP BY 1, 2, 3 HAVING count(DISTINCT accn) > 1 OR count(DISTINCT filed) > 1""",
)
def repeated_publications(spark, sf_dir):
    """Periods that were published more than once, and whether values changed. (O-62, O-63)"""
    f = facts(spark, sf_dir, parts(spark, sf_dir)).select("issuer", "metric", "end", "accn", "filed", "value")
    told = {"accessions": "accn", "filings": "filed", "distinct_values": "value"}
    # the first row of each value is counted: several count_distincts would copy every row for each, and shuffle the copies
    first = lambda c: (F.row_number().over(Window.partitionBy("issuer", "metric", "end", c).orderBy(F.lit(1))) == 1) & F.col(c).isNotNull()
    marked = f.select("*", *(first(c).alias(f"_{k}") for k, c in told.items()))
    g = marked.groupBy("issuer", "metric", "end").agg(F.count("*").alias("n"), *(F.count_if(f"_{k}").alias(k) for k in told), F.min("filed").alias("a"), F.max("filed").alias("b"))
    return g.filter("accessions > 1 OR filings > 1").select("issuer", "metric", "end", "n", "accessions", "filings", "distinct_values", ((F.col("distinct_values") > 1) & (F.col("b") > F.col("a"))).alias("restated"))


@query("multi_form_metrics", f"WITH {FACTS_SQL} SELECT issuer, metric, count(DISTINCT form) AS forms FROM facts0 GROUP BY 1, 2 HAVING count(DISTINCT form) > 1")
def multi_form_metrics(spark, sf_dir):
    """Series that mix several units of one attribute. (O-64)"""
    return facts(spark, sf_dir).groupBy("issuer", "metric").agg(F.count_distinct("form").alias("forms")).filter("forms > 1")


#: Issues and period kinds of a fact, as SQL conditions that both engines read. (O-65, O-66)
ISSUES = {
    "filed_before_end": "lag < 0",
    "filed_late": "lag > 100",
    "nonpositive_value": "value <= 0",
    "unknown_form": "form NOT IN ('10-K', '10-K/A', '10-Q', '10-Q/A')",
    "amended": "form LIKE '%/A'",
    "starts_after_end": "duration < 0",
    "quarterly": "duration BETWEEN 60 AND 120",
    "half_year": "duration BETWEEN 150 AND 210",
    "three_quarters": "duration BETWEEN 240 AND 300",
    "yearly": "duration BETWEEN 330 AND 400",
}


@query(
    "quality_summary",
    f"""WITH {FACTS_SQL}, f AS (SELECT *, "end" - start AS duration, filed - "end" AS lag FROM facts0), s AS (SELECT count(*) AS n, {", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in ISSUES.items())} FROM f)
SELECT issue, k AS count, n AS denominator, round(k / n, 6) AS rate FROM s, LATERAL (VALUES {", ".join(f"('{k}', {k})" for k in ISSUES)}) AS v(issue, k)""",
)
def quality_summary(spark, sf_dir):
    """Counts of issues and of cumulative periods, with their denominators and rates. (O-65, O-66)"""
    f = facts_ops.with_duration(facts(spark, sf_dir)).withColumn("lag", F.date_diff("filed", "end"))
    s = f.agg(F.count("*").alias("n"), *(F.count_if(F.expr(c)).alias(k) for k, c in ISSUES.items()))
    stacked = ", ".join(f"'{k}', {k}" for k in ISSUES)
    rows = s.select("n", F.expr(f"stack({len(ISSUES)}, {stacked}) AS (issue, count)"))
    return rounded(rows.select("issue", "count", F.col("n").alias("denominator"), F.try_divide(F.col("count").cast("double"), F.col("n")).alias("rate")))


@query(
    "concept_coverage",
    f"""WITH {FACTS_SQL}, d AS (SELECT DISTINCT concept, form, "end" FROM facts0), g AS (SELECT *, ("end" - lag("end") OVER (PARTITION BY concept, form ORDER BY "end"))::INT AS gap FROM d)
SELECT concept, form, min("end") AS first, max("end") AS last, count(*) AS dates, max(gap) AS max_gap, round((max("end") - min("end")) / 365.25, 6) AS years FROM g GROUP BY 1, 2""",
)
def concept_coverage(spark, sf_dir):
    """How far and how densely each concept and unit reaches. (O-69)"""
    d = facts(spark, sf_dir).select("concept", "form", "end").distinct()
    g = d.withColumn("gap", F.date_diff("end", F.lag("end").over(Window.partitionBy("concept", "form").orderBy("end"))))
    years = F.date_diff(F.max("end"), F.min("end")) / F.lit(365.25)
    return rounded(g.groupBy("concept", "form").agg(F.min("end").alias("first"), F.max("end").alias("last"), F.count("*").alias("dates"), F.max("gap").alias("max_gap"), years.alias("years")))


@query(
    "filing_lags",
    f"""WITH {FACTS_SQL}, f AS (SELECT metric, (filed - "end")::DOUBLE AS lag FROM facts0 WHERE filed >= "end") SELECT metric, count(*) AS n, quantile_cont(lag, 0.5) AS median, round(quantile_cont(lag, 0.95), 6) AS p95 FROM f GROUP BY 1""",
)
def filing_lags(spark, sf_dir):
    """Exact median and 95th percentile of the days to filing. (O-66, O-71)"""
    f = facts(spark, sf_dir).filter("filed >= end").select("metric", F.date_diff("filed", "end").cast("double").alias("lag"))
    return rounded(f.groupBy("metric").agg(F.count("*").alias("n"), F.percentile("lag", 0.5).alias("median"), F.percentile("lag", 0.95).alias("p95")))


@query(
    "filing_cadence",
    f"""WITH {FACTS_SQL}, d AS (SELECT DISTINCT issuer, metric, "end" FROM facts0), s AS (SELECT issuer, metric, ("end" - lag("end") OVER (PARTITION BY issuer, metric ORDER BY "end"))::INT AS step FROM d),
 c AS (SELECT issuer, metric, step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT issuer, metric, step AS mode FROM c QUALIFY row_number() OVER (PARTITION BY issuer, metric ORDER BY n DESC, step) = 1),
 k AS (SELECT issuer, metric, quantile_cont(step::DOUBLE, 0.5) AS median, max(step) AS max_gap, count(*) AS steps FROM s WHERE step IS NOT NULL GROUP BY 1, 2)
SELECT k.*, mode FROM k JOIN m USING (issuer, metric)""",
)
def filing_cadence(spark, sf_dir):
    """Median, mode (the smallest of ties) and largest step between the periods of a series. (O-67, O-69)"""
    d = facts(spark, sf_dir).select("issuer", "metric", "end").distinct()
    w = Window.partitionBy("issuer", "metric").orderBy("end")
    s = d.select("issuer", "metric", F.date_diff("end", F.lag("end").over(w)).alias("step")).filter("step IS NOT NULL")
    return s.groupBy("issuer", "metric").agg(F.percentile(F.col("step").cast("double"), 0.5).alias("median"), F.max("step").alias("max_gap"), F.count("*").alias("steps"), F.mode("step", True).alias("mode"))


@query(
    "dominant_forms",
    f"""WITH {FACTS_SQL}, c AS (SELECT issuer, form, count(*) AS n FROM facts0 GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY issuer) AS share FROM c),
 t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY share DESC, form) = 1) SELECT issuer, CASE WHEN share >= 0.7 THEN form ELSE 'mixed' END AS kind, round(share, 6) AS share FROM t""",
)
def dominant_forms(spark, sf_dir):
    """The form that makes up 70 % of an issuer's facts, else mixed. (O-68)"""
    c = facts(spark, sf_dir).groupBy("issuer", "form").agg(F.count("*").alias("n"))
    w = Window.partitionBy("issuer")
    s = c.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("share"), "form"))).filter("k = 1")
    return rounded(s.select("issuer", F.when(F.col("share") >= 0.7, F.col("form")).otherwise("mixed").alias("kind"), "share"))


@query(
    "history_shares",
    f"""WITH {FACTS_SQL}, y AS (SELECT issuer, (max("end") - min("end")) / 365.25 AS years FROM facts0 GROUP BY 1) SELECT threshold, count(*) FILTER (years >= threshold) AS issuers, round(avg((years >= threshold)::INT), 6) AS share FROM y, (SELECT unnest([1, 2, 3, 5])::INT AS threshold) GROUP BY 1""",
)
def history_shares(spark, sf_dir):
    """The share of issuers with at least so many years of history. (O-69, O-70)"""
    y = facts(spark, sf_dir).groupBy("issuer").agg((F.date_diff(F.max("end"), F.min("end")) / F.lit(365.25)).alias("years"))
    x = y.withColumn("threshold", F.explode(F.array(*map(F.lit, (1, 2, 3, 5)))))
    return rounded(x.groupBy("threshold").agg(F.count_if(F.col("years") >= F.col("threshold")).alias("issuers"), F.avg((F.col("years") >= F.col("threshold")).cast("int")).alias("share")))


@query("column_coverage", "SELECT field, round(k / n, 6) AS share FROM (SELECT count(*) AS n, count(text) AS text, count(lang) AS lang, count(source) AS source, count(n_chars) AS n_chars FROM documents), LATERAL (VALUES ('text', text), ('lang', lang), ('source', source), ('n_chars', n_chars)) AS v(field, k)")
def column_coverage(spark, sf_dir):
    """The share of non-null values by column. (O-77)"""
    d = table(spark, sf_dir, "documents")
    wide = d.agg(*(F.count(c).cast("double").alias(c) for c in ("text", "lang", "source", "n_chars")), F.count("*").alias("n"))
    long = wide.unpivot(["n"], ["text", "lang", "source", "n_chars"], "field", "k")
    return rounded(long.select("field", F.try_divide("k", "n").alias("share")))


@query("common_keys", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def common_keys(spark, sf_dir):
    """Set intersection. (O-106)"""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf_dir, "orders").select("o_custkey"))


@query("all_keys", "SELECT s_nationkey AS k, 'supplier' AS kind FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer")
def all_keys(spark, sf_dir):
    """Union of all rows. (O-105)"""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("kind"))
    return s.unionByName(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("kind")))


@query("aligned_totals", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 3 GROUP BY 1) b ON a.k = b.k")
def aligned_totals(spark, sf_dir):
    """Two sides aligned on their keys, missing is 0. (O-36, O-46)"""
    a = table(spark, sf_dir, "customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("a"))
    b = table(spark, sf_dir, "supplier").filter("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("a", F.lit(0)).alias("customers"), F.coalesce("b", F.lit(0)).alias("suppliers"))


@query(
    "fingerprints_by_nation",
    """SELECT c_nationkey, sha256(count(*) || ':' || sum(('0x' || substr(sha256(c_custkey || ':' || c_name), 1, 12))::BIGINT)) AS fingerprint FROM customer GROUP BY 1""",
)
def fingerprints_by_nation(spark, sf_dir):
    """Content fingerprints: sums of row hashes, so no group is collected; the ordering key is in each row's hash. (O-169)"""
    row = F.sha2(F.concat_ws(":", F.col("c_custkey").cast("string"), "c_name"), 256)
    hashed = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(hashed).alias("s"))
    return g.select("c_nationkey", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")), 256).alias("fingerprint"))


@query(
    "ordered_fingerprints",
    """WITH h AS (SELECT c_nationkey, ('0x' || substr(sha256(c_custkey || ':' || c_name || ':' || c_mktsegment), 1, 12))::BIGINT % 2147483647 AS h, c_mktsegment, c_custkey FROM customer),
 r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS k FROM h) SELECT c_nationkey, count(*) AS n, sum(h::HUGEINT * k)::VARCHAR AS digest FROM r GROUP BY 1""",
)
def ordered_fingerprints(spark, sf_dir):
    """Fingerprints in which the order of rows enters, by nation. (O-169)"""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_name")
    digest = F.sha2(F.concat_ws(":", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment"), 256)
    return experiment.ordered_fingerprints(c, "c_nationkey", ["c_mktsegment", "c_custkey"], F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"))


@query(
    "checked_join",
    """SELECT count(*) AS n, count(*) FILTER (o_orderkey IS NULL) AS unmatched, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS repeated FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""",
)
def checked_join(spark, sf_dir):
    """A join with its own evidence: unmatched rows and repeated keys. (O-42)"""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    joined = table(spark, sf_dir, "lineitem").select("l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    repeated = o.groupBy("o_orderkey").count().filter("count > 1").agg(F.count("*").alias("repeated"))
    return joined.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey").isNull()).alias("unmatched")).crossJoin(repeated)  # one row each
