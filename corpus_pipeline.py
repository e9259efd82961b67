"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and
returns a DataFrame; all but the last return the columns of ``documents``, whatever their
names. Each stage takes an empty table and gives an empty one, and very long texts whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import decontam, jaccard_join, langid, packing, pii
from tallyglass.llm.common import saved, table

#: A language must have this share of a text's likelihood; with L languages chance is 1 / L.
MIN_LANGUAGE_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language cannot be told, go; null and empty texts among them.

    Repeated rows are judged each for itself. Without any labelled document all go.
    """
    return langid.keep_identified(docs, MIN_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 Jaccard similarity of five-word shingles tie together, the first stays.

    The first is that with the smallest id, a null id last; of equal rows one stays. Texts
    without words are tied to nothing and stay. Very long texts count whole, and are not shuffled unless they may go.
    """
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none, an empty benchmark leaves all. Repeated rows go or stay together."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that reveal it, are masked; n_chars follows the text.

    All rows stay, repeated ones and null texts too (a null text stays null).
    """
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; a null or empty text is one piece of one token, each repeated row has its own."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", sanitise),
    ("best_fit_packing", pack),
]

#: Tokenisation and the models cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
