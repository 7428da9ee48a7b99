"""The row-local part of a run over a stream: notes are tokenised, tagged by rule and redacted as they arrive.

Every step works on one row, so no state and no watermark is needed, and a stream gives what a batch does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.text import COVER, rule_label
from veilmark.operators.redact import normalise, replacement


def read_notes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def redact_stream(notes: DataFrame, strategy: str = "replace_tag_type") -> DataFrame:
    """The notes with ``deid_text``; rule entities are pieces of the covering pattern, so no offsets are needed."""
    pieces = F.regexp_extract_all("text", F.lit(COVER), F.lit(0))

    def one(p):
        label = rule_label(p)
        return F.when(label.isNull(), p).otherwise(replacement(p, label, strategy))

    return notes.withColumn("deid_text", normalise(F.array_join(F.transform(pieces, one), "")))
