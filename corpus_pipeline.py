"""From documents to packed training sequences: five stages, each written and read again before the next.

Between stages a table has the columns of ``documents``; where a stage changes texts, ``n_chars`` follows.  As every stage's result is written before the next one
begins, each begins by removing what the ones before it left in the shared folder.

Null and empty texts fail the quality rules, so no later stage sees them from here; given to a stage on their own, they are kept by line_dedup and secret_scan, are
near-duplicates of each other to near_dedup, and an end alone to pack.  Rows without an id pass all stages.  Repeated rows pass quality_rules, keep equal lines together in line_dedup, and become one in
near_dedup.  Of ties the smallest id, then the smallest row hash, is first.  Very long texts are worked on whole in every stage.  Empty tables stay empty, and other columns, whatever their names,
are kept up to pack, which has columns of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import linededup, packing, quality, secrets, simhash
from veilmark.llm.common import documents, drop_path, release, shared_dir


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, and documents that fail or lose too much."""
    release(spark)
    return _counted(quality.clean(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that repeat, but for two characters or a word in twenty, the first stays."""
    release(spark)
    return _counted(linededup.dedup(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the one with the smallest id stays."""
    release(spark)
    return simhash.distinct_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    release(spark)
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: one row per piece of a document."""
    import public_tokenizers

    release(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("pack", pack)]

#: SQL can't express tokenising, fingerprints or edit distance; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            drop_path(spark, last)
        last = path
    release(spark)
    return docs
