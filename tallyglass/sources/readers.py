"""Readers with declared schemas. Nothing is inferred from data."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE = T.StructType([T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), T.StructField("adj_close", T.DoubleType())])
OHLCV = T.StructType([*PRICE.fields, *(T.StructField(n, T.DoubleType()) for n in ("high", "low", "close", "volume"))])

_FACT = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"
#: A filing archive's document: taxonomy -> concept -> units -> facts.
# The field names of the filing format.
COMPANY_FACTS = f"cik bigint, entityName string, facts map<string,map<string,struct<label:string,description:string,units:map<string,array<{_FACT}>>>>>, _bad string"


def first_existing(candidates: Iterable[str]) -> str:
    """The first path that is there: environment, data folder, cache. (O-4)"""
    for path in candidates:
        if path and Path(path).exists():
            return path
    raise FileNotFoundError("none of the given paths exists")


def prices(spark: SparkSession, paths: dict[str, str], schema: T.StructType = PRICE) -> DataFrame:
    """The splits' CSV or Parquet files as one table with a ``split`` column. (O-1)"""
    out = None
    for split, path in paths.items():
        reader = spark.read.schema(schema)
        part = (reader.option("header", True).csv(path) if path.endswith(".csv") else reader.parquet(path)).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Filing documents, one a file, parsed by the declared schema; ``_bad`` has what cannot be read. (O-5, O-8)"""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("value"), F.input_file_name().alias("path"))
    return parsed(raw, F.col("value"))


def parsed(raw: DataFrame, json: Column) -> DataFrame:
    doc = F.from_json(json, COMPANY_FACTS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return raw.withColumn("doc", doc).select("path", "doc.*")


def read_errors(docs: DataFrame) -> DataFrame:
    """path and reason of the documents that are of no use. (O-8)"""
    reason = F.when(F.col("_bad").isNotNull(), "not readable").when(F.col("cik").isNull(), "no issuer").when(F.col("facts").isNull(), "no facts")
    return docs.select("path", reason.alias("reason")).filter("reason IS NOT NULL")


def flat_facts(docs: DataFrame) -> DataFrame:
    """One row for each published fact, of all taxonomies and units. (O-6, D17)"""
    taxa = docs.filter("cik IS NOT NULL").select("path", "cik", F.col("entityName").alias("entity"), F.explode("facts").alias("taxonomy", "concepts"))
    concepts = taxa.select("path", "cik", "entity", "taxonomy", F.explode("concepts").alias("concept", "c"))
    units = concepts.select("path", "cik", "entity", "taxonomy", "concept", "c.label", "c.description", F.explode("c.units").alias("unit", "rows"))
    return units.select("path", "cik", "entity", "taxonomy", "concept", "label", "description", "unit", F.explode("rows").alias("f")).select(
        "path", "cik", "entity", "taxonomy", "concept", "label", "description", "unit", F.to_date("f.start").alias("start"), F.to_date("f.end").alias("end"), F.col("f.val").alias("value"), "f.accn", "f.fy", "f.fp", "f.form", F.to_date("f.filed").alias("filed"), "f.frame"
    )


def json_paths(docs: DataFrame, column: str, depth: int = 12) -> DataFrame:
    """path, depth, type, n: every field of nested documents by its path, whatever their schema. (O-7)

    Documents become variants, whose fields are exploded level by level; an element of a list has the path of the list with
    []. ``n`` counts the values of a type at a path (a list's elements each). What cannot be read, and null, has no fields.
    Counts merge by path, so what is shuffled are the paths of a task, not the documents. Levels below ``depth`` end the run.
    """
    spark = docs.sparkSession
    level = docs.select(F.lit("").alias("path"), F.try_parse_json(F.col(column)).alias("v")).filter("v IS NOT NULL")
    counts = None
    for d in range(1, depth + 1):
        inner = spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key"), F.col("value").alias("w"))
        dot = F.when(F.col("path") == "", "").otherwise(".")
        path = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat("path", dot, "key"))
        level = level.lateralJoin(inner).select(path.alias("path"), F.col("w").alias("v"))
        kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
        here = level.select("path", F.lit(d).alias("depth"), kind.alias("type"))
        counts = here if counts is None else counts.unionByName(here)
        if level.filter(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).isEmpty():
            return counts.groupBy("path", "depth", "type").agg(F.count("*").alias("n"))
    raise ValueError(f"documents go deeper than {depth} levels")


def metric_facts(flat: DataFrame, tags: DataFrame, issuers: DataFrame, taxonomy: str = "us-gaap", unit: str = "USD") -> DataFrame:
    """Facts of the wanted metrics by issuer: ``tags`` (metric, concept, priority), ``issuers`` (ticker, cik). (O-5, D7)

    Both are small dictionaries; the join strategy is left to their measured size.
    """
    wanted = flat.filter((F.col("taxonomy") == taxonomy) & (F.col("unit") == unit))
    return wanted.join(tags, "concept").join(issuers, "cik").select(F.col("ticker").alias("issuer"), "metric", "value", "start", "end", "filed", "accn", "priority", "form")


def trading_symbols(flat_text: DataFrame) -> DataFrame:
    """Distinct values of any concept that names a trading symbol; ``flat_text``: cik, concept, text. (O-111)"""
    return flat_text.filter(F.lower("concept").contains("tradingsymbol")).select("cik", F.upper(F.trim("text")).alias("symbol")).filter("symbol <> ''").distinct()


def identity_rows(spark: SparkSession, path: str) -> DataFrame:
    """A ``{fields, data}`` snapshot as rows: cik, name, ticker (dots for dashes), exchange. (O-10)"""
    doc = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "fields array<string>, data array<array<string>>").alias("d"))
    rows = doc.select("d.fields", F.explode("d.data").alias("row"))
    at = lambda name: F.get(F.col("row"), F.array_position("fields", name).cast("int") - 1)
    return rows.select(at("cik").cast("long").alias("cik"), at("name").alias("name"), F.translate(at("ticker"), "-", ".").alias("ticker"), at("exchange").alias("exchange"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Number and bytes of the files below a path. (O-9)"""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
