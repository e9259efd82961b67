"""Writers of results. Tables stay partitioned; small reports go to one file."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_result(tables: dict[str, DataFrame], path: str) -> None:
    """Each table below ``path``, by split and strategy where it has them. (O-13, O-16)

    A table without rows is refused before anything is written: a result is whole or absent.
    """
    empty = [name for name, df in tables.items() if df.isEmpty()]
    if empty:
        raise ValueError(f"no rows in {', '.join(sorted(empty))}")
    for name, df in tables.items():
        keys = [k for k in ("split", "strategy") if k in df.columns]
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{path}/{name}")


def read_result(spark: SparkSession, path: str, name: str, split: str | None = None, strategy: str | None = None) -> DataFrame:
    """A table back, with its types; split and strategy prune partitions. (O-12)"""
    df = spark.read.parquet(f"{path}/{name}")
    for key, value in (("split", split), ("strategy", strategy)):
        if value is not None:
            df = df.filter(df[key] == value)
    return df


def write_report(df: DataFrame, path: str) -> None:
    """A report of few rows as one CSV file with a header. (O-15)"""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def stable_json(value: object) -> str:
    """The same text for the same content. (O-14)"""
    return json.dumps(value, sort_keys=True, indent=2, default=str) + "\n"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors share.

    Only a local session without the setting gets a temporary folder of this machine; on a
    cluster its absence is an error, for executors would not see each other's files.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="tallyglass-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def kept_folder(spark: SparkSession, name: str) -> str:
    """A folder of a fixed name beside those of ``shared_folder``, for what later runs may find again."""
    return f"{shared_folder(spark).rsplit('/', 1)[0]}/{name}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: several readers compute it once, and its lineage ends here."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def content_cached(make: Callable[[], DataFrame], spark: SparkSession, folder: str, content: object) -> DataFrame:
    """The table that ``make`` gives, kept in ``folder`` under a digest of ``content``. (O-17)

    ``content`` is all that the table depends on (settings, fingerprints of the inputs). A table
    counts as there when its writer has finished.
    """
    path = f"{folder.rstrip('/')}/{hashlib.sha256(stable_json(content).encode()).hexdigest()[:16]}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def kept_by_date(make: Callable[[DataFrame], DataFrame], dates: DataFrame, folder: str, content: object) -> DataFrame:
    """The rows that ``make`` gives for ``dates`` (date), of which only absent dates are computed. (O-134)

    Rows are kept below ``folder`` under a digest of ``content`` (all that they depend on but the dates), partitioned by
    date. A manifest lists the dates that are complete, those without rows too; it is written after the rows, so what a failed run left
    behind is computed again and replaced. ``make`` gets the absent dates and returns their rows, with a column date.
    """
    spark = dates.sparkSession
    top = f"{folder.rstrip('/')}/{hashlib.sha256(stable_json(content).encode()).hexdigest()[:16]}"
    wanted = dates.select("date").distinct()
    there = exists(spark, f"{top}/manifest/_SUCCESS")
    absent = written(wanted.join(spark.read.schema(wanted.schema).parquet(f"{top}/manifest"), "date", "left_anti") if there else wanted)
    rows = make(absent)
    if not absent.isEmpty():
        new = rows.select("*", F.col("date").alias("_date"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_date").parquet(f"{top}/rows")
        absent.coalesce(1).write.mode("append").parquet(f"{top}/manifest")
    if not exists(spark, f"{top}/rows"):
        return rows
    kept = spark.read.schema(rows.schema.add("_date", "date")).parquet(f"{top}/rows")
    return kept.join(wanted.withColumnRenamed("date", "_date"), "_date", "left_semi").drop("_date")
