"""The queries of the training-data operators; each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import documents, fresh_path


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilmark.llm.packing import pack

    return pack(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilmark.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilmark.llm.pii import report

    return report(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilmark.llm.secrets import report

    return report(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilmark.llm.bpe import digest

    return digest(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilmark.llm.quality import quality

    return quality(documents(spark, sf_dir), clean=False)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilmark.llm.media import describe, encode

    return describe(encode(documents(spark, sf_dir)))


def op8_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilmark.llm.lmscore import score

    return score(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilmark.llm.linededup import report

    return report(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in four parts, each compacted with what is there."""
    from veilmark.llm.sharding import Store, append, compact, layout

    store = Store(spark, fresh_path(spark, "store"))
    docs = documents(spark, sf_dir)
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(4))
    for i in range(4):
        append(store, docs.where(part == i))
        compact(store)
        store.vacuum(grace=0, keep=1)  # there is no other writer
    return layout(store)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {}
