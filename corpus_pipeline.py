"""A corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage works on all rows of the one before, whatever their columns are
called. Null texts count as empty. Rows that repeat are kept or dropped alike
but for near duplicates, of which one row stays. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regulus.llm import decontam, packing, pii, quality_rules, simhash
from regulus.llm.common import removed, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go, null and empty texts among them; the others stay with all their columns."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, by fingerprint or by five-word similarity from 0.8 on: that with the smallest id.

    Documents without an id come last, by a digest of their texts; of rows that
    repeat one stays. Texts are compared whole.
    """
    return simhash.keep_one(docs, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, as often as they repeat; texts are searched whole, and those without words stay."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, and ``n_chars`` counted anew where it was; every row stays, null texts as null."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences; null and empty texts are pieces of the end alone."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("simhash", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", pack)]

#: Hashing, token vocabularies and iteration to a fixed point are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents on; what a stage wrote is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
