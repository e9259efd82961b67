"""Purged walk-forward forecasts of risk: targets, splits, boosted trees, diagnostics."""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.columns import average_rank, clip
from tallyglass.sources.sinks import exists, stable_json

# Trees of a fit and their rate, the rows that a fit needs, the bounds of a predicted log ratio.
TREES, RATE = 300, 0.04
LEAST = 1_000
BOUND = 3.0
#: The most values of the category, the seed of the trees, fits that run side by side, rows of a training partition.
MAX_BINS, SEED, FITS, PARTITION = 64, 17, 8, 50_000


def targets(panel: DataFrame, future: str, trailing: str) -> DataFrame:
    """target: the log of future over trailing downside. (O-155)"""
    ok = (F.col(future) > 0) & (F.col(trailing) > 0)
    return panel.withColumn("target", F.when(ok, F.ln(F.col(future) / F.col(trailing))))


def cutoffs(panel: DataFrame, first_year: int) -> DataFrame:
    """year, cutoff: the first date of each evaluation year. (O-156)"""
    return panel.groupBy(F.year("date").alias("year")).agg(F.min("date").alias("cutoff")).filter(F.col("year") >= first_year)


def purged(panel: DataFrame, years: DataFrame) -> DataFrame:
    """Training rows of each year: formed and matured before its cutoff. (O-156)

    ``years`` has one row for each year; a row belongs to every later year's training set,
    which is what expanding windows are.
    """
    return panel.filter("target IS NOT NULL").join(F.broadcast(years), (F.col("date") < F.col("cutoff")) & (F.col("label_end") < F.col("cutoff")))


def training_audit(train: DataFrame) -> DataFrame:
    """What each year was trained on. (O-157)"""
    return train.groupBy("year").agg(
        F.max("cutoff").alias("cutoff"), F.count("*").alias("n"), F.count_distinct("date").alias("dates"), F.max("date").alias("last_formation"), F.max("label_end").alias("last_label_end")
    )


def boosted(features: list[str], category: str, depth: int, trees: int, rate: float) -> Pipeline:
    """Median imputation, the category's index and gradient-boosted trees on ``target``. (O-158)

    The trees' histograms are Spark's own, built over partitions; a category has a bin for each
    of its values (``MAX_BINS`` of them at most, which the fit checks). Spark's trees know no penalty of leaf values;
    a leaf of 5 rows at least stands in for it.
    """
    filled = [f"_{f}" for f in features]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=features, outputCols=filled),
            StringIndexer(inputCol=category, outputCol="_category", handleInvalid="keep", stringOrderType="alphabetAsc"),
            VectorAssembler(inputCols=[*filled, "_category"], outputCol="_features"),
            GBTRegressor(featuresCol="_features", labelCol="target", predictionCol="predicted", maxDepth=depth, maxIter=trees, stepSize=rate, maxBins=MAX_BINS, minInstancesPerNode=5, seed=SEED),
        ]
    )


def _content(train: DataFrame, columns: list[str]) -> list[Column]:
    """Aggregates that tell one training set from another, whatever its partitions: rows, and a sum of row hashes."""
    doubles = {c for c, t in train.dtypes if t == "double"}
    row = F.xxhash64(*(F.round(c, 8) if c in doubles else F.col(c) for c in columns))
    return [F.count("*").alias("_n"), F.sum(row.cast("decimal(38,0)")).alias("_digest")]


def walk_forward(
    panel: DataFrame, years: DataFrame, features: list[str], depth: int = 4, trees: int = TREES, rate: float = RATE, least: int = LEAST, model_dir: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(date, asset, year, cutoff, last_label_end, predicted) and (year, feature, importance): each year by trees trained on what had matured before it. (O-156, O-158, O-160)

    One refit for each evaluation year (``years`` is that short list), each a Spark job over the
    panel filtered by the purged split; nothing is copied by year. Fits wait for many small jobs, so years run side
    by side. A year with fewer than ``least`` rows to learn from ends the run. Every prediction carries the
    cutoff of its training set and the last label in it, as lineage.

    ``model_dir`` keeps the fitted models under a digest of all that they depend on: settings, columns and
    training rows. A fit whose model is there is not made again, and reloaded models predict as the first. (O-18)
    """
    columns = [*features, "asset"]

    def one(row):
        year, cutoff = row["year"], F.lit(row["cutoff"])
        train = panel.filter("target IS NOT NULL").filter((F.col("date") < cutoff) & (F.col("label_end") < cutoff)).select("date", "target", "label_end", *columns)
        seen = train.agg(*_content(train, ["date", "target", *columns]), F.max("label_end").alias("_last"), *(F.count(f).alias(f) for f in features)).first()
        if seen["_n"] < least:
            raise ValueError(f"{year}: {seen['_n']} rows have matured before {row['cutoff']}, and a fit needs {least}")
        known = [f for f in features if seen[f]]  # a feature without any value so far has nothing to learn from
        key = hashlib.sha256(stable_json([known, depth, trees, rate, SEED, seen["_n"], str(seen["_digest"])]).encode()).hexdigest()[:24]
        path = f"{model_dir.rstrip('/')}/{key}" if model_dir else None
        if path and exists(panel.sparkSession, f"{path}/stages"):
            model = PipelineModel.load(path)
        else:
            rows = train.drop("label_end").repartitionByRange(1 + seen["_n"] // PARTITION, "date", "asset").sortWithinPartitions("date", "asset")
            model = boosted(known, "asset", depth, trees, rate).fit(rows)
            if path:
                model.write().overwrite().save(path)
        importance = model.stages[-1].featureImportances.toArray().tolist()
        told = [(year, name, x) for name, x in zip([*known, "asset"], importance)] + [(year, name, 0.0) for name in features if name not in known]
        test = panel.filter(F.year("date") == year).select("date", *columns)
        lineage = [F.lit(year).alias("year"), cutoff.cast("date").alias("cutoff"), F.lit(seen["_last"]).cast("date").alias("last_label_end")]
        return model.transform(test).select("date", "asset", *lineage, "predicted"), told

    with ThreadPoolExecutor(FITS) as pool:
        done = list(pool.map(one, years.orderBy("year").collect()))
    spark = panel.sparkSession
    out = reduce(DataFrame.unionByName, [p for p, _ in done]) if done else spark.createDataFrame([], "date date, asset int, year int, cutoff date, last_label_end date, predicted double")
    return out, spark.createDataFrame([t for _, told in done for t in told], "year int, feature string, importance double")


def as_variance(predicted: DataFrame, trailing: str) -> DataFrame:
    """The clipped log ratio turned back into a variance. (O-159)"""
    return predicted.withColumn("variance", F.col(trailing) * F.exp(clip(F.col("predicted"), -BOUND, BOUND)))


def leaks(predicted: DataFrame, universe: DataFrame) -> dict[str, DataFrame]:
    """Rows that break the order of time between a fit and the formation that uses it, or have no forecast; for ``experiment.audit``.

    ``predicted``: date, asset, cutoff, last_label_end, variance; ``universe``: date, asset, history_end. (O-140)
    """
    told = predicted.select("date", "asset", "cutoff", "last_label_end", "variance")
    used = universe.select("date", "asset", "history_end").join(told, ["date", "asset"], "left")
    return {
        "fitted_after_formation": used.filter("cutoff > date"),
        "label_not_matured": used.filter("last_label_end >= cutoff"),
        "history_not_prior": used.filter("history_end IS NULL OR history_end >= date"),
        "no_forecast": used.filter("variance IS NULL OR isnan(variance) OR variance < 0 OR variance = double('infinity')"),
        "repeated_forecasts": predicted.groupBy("date", "asset").count().filter("count > 1"),
    }


def diagnostics(scored: DataFrame) -> DataFrame:
    """Root mean squared log error, and mean and median rank correlation by date, of matured rows. (O-161)

    ``scored``: date, asset, target, predicted.
    """
    rows = scored.filter("target IS NOT NULL AND predicted IS NOT NULL")
    ranked = rows.select("date", average_rank(F.col("target"), "date").alias("a"), average_rank(F.col("predicted"), "date").alias("b"))
    spread = (F.var_pop("a") > 0) & (F.var_pop("b") > 0)
    ic = ranked.groupBy("date").agg(F.when(spread, F.covar_pop("a", "b") / F.sqrt(F.var_pop("a") * F.var_pop("b"))).alias("ic"))
    error = rows.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("target") - F.col("predicted"), F.lit(2.0)))).alias("rmse"))
    return error.crossJoin(ic.agg(F.avg("ic").alias("mean_ic"), F.percentile("ic", 0.5).alias("median_ic")))  # one row each
