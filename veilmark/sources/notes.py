"""Reading and writing notes: Parquet, JSON lines, archives of XML, CoNLL, splits."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.schema import NOTE, PREFIXES


def load_parquet(spark: SparkSession, path: str, columns: dict[str, str], meta: dict[str, str] | None = None) -> DataFrame:
    """Notes from Parquet columns: ``columns`` gives the new names at the top level, ``meta`` those inside ``meta``; ``spans`` is
    empty where there is none.  Only these columns are read."""
    df = spark.read.parquet(path)
    out = [F.col(c).alias(n) for c, n in columns.items()]
    if meta:
        out.append(F.struct(*[F.col(c).alias(n) for c, n in meta.items()]).alias("meta"))
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,label:string>>")
    if "spans" not in columns.values():
        out.append(empty.alias("spans"))
    return df.select(*out)


def load_json(spark: SparkSession, paths: str | list[str], schema: str = NOTE) -> DataFrame:
    """JSON lines with a schema that is given, not inferred; a line that isn't JSON raises an error."""
    return spark.read.schema(schema).json(paths, mode="FAILFAST")


def load_splits(spark: SparkSession, files: dict[str, str | list[str]], schema: str = NOTE) -> dict[str, DataFrame]:
    """JSON-lines files by the name of their split."""
    return {s: load_json(spark, f, schema) for s, f in files.items()}


def non_empty(notes: DataFrame, text: str = "text") -> DataFrame:
    """Notes whose text is neither null nor empty; blanks alone are a text."""
    return notes.where(F.col(text).isNotNull() & (F.col(text) != ""))


def _archive_rows(batches: Iterator, suffix: str) -> Iterator:
    import io
    import tarfile
    from xml.etree import ElementTree

    import pandas as pd

    for pdf in batches:
        for raw in pdf["content"]:
            rows = []
            with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
                for m in tar:
                    if not m.isfile() or not m.name.endswith(suffix):
                        continue
                    ids = Path(m.name).stem.split("-")
                    if len(ids) != 2:
                        raise ValueError(f"{m.name}: a name of two parts is expected")
                    tree = ElementTree.fromstring(tar.extractfile(m).read())
                    spans = [dict(e.attrib) for e in tree.find("TAGS")]
                    rows.append((tree.find("TEXT").text, ids[0], ids[1], [{"start": int(s["start"]), "end": int(s["end"]), "type": s.get("TYPE"), "text": s.get("text"), "id": s.get("id")} for s in spans]))
            if rows:
                yield pd.DataFrame(rows, columns=["text", "patient", "record", "spans"])


def load_archive(spark: SparkSession, path: str, institute: str = "", suffix: str = ".xml") -> DataFrame:
    """Notes of XML members of tar files: TEXT, and the children of TAGS as spans with whole-number offsets."""
    spans = "array<struct<start:int,end:int,type:string,text:string,id:string>>"
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInPandas(lambda it: _archive_rows(it, suffix), f"text string, patient string, record string, spans {spans}")
    meta = F.struct(F.concat_ws("-", "patient", "record").alias("note_id"), F.col("patient").alias("patient"), F.col("record").alias("record"), F.lit(institute).alias("institute"))
    return rows.select("text", "spans", meta.alias("meta"))


def map_span_types(notes: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Spans whose ``type`` is mapped, with the ``label`` that it maps to; others go."""
    m = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    kept = F.filter("spans", lambda s: F.map_contains_key(m, s["type"]))
    return notes.withColumn("spans", F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(m, s["type"]).alias("label"))))


def abbreviations(spark: SparkSession, path: str) -> list[str]:
    """The lines of a word list that aren't empty, as they are and in lower case; a list of some hundred words."""
    words = [r[0].strip() for r in spark.read.text(path).collect()]
    return sorted({w for x in words if x for w in (x, x.lower())})


def validation_spans(notes: DataFrame) -> DataFrame:
    """(note_id, note_spans): the spans as they were given, in order."""
    return notes.select(F.col("meta.note_id").alias("note_id"), F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))).alias("note_spans"))


def conll(tokens: Column, labels: Column, info: Column) -> Column:
    """A sentence as ``token label {json}`` lines."""
    z = F.arrays_zip(tokens.alias("t"), labels.alias("l"), info.alias("i"))
    return F.array_join(F.transform(z, lambda x: F.concat_ws(" ", x["t"], x["l"], F.to_json(x["i"]))), "\n")


def write_conll(sentences: DataFrame, path: str, compression: str = "none") -> None:
    """One text file per partition, an empty line after each sentence."""
    sentences.select(F.concat(conll(F.col("tokens"), F.col("labels"), F.col("current_sent_info")), F.lit("\n")).alias("value")).write.text(path, compression=compression)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_splits(notes: DataFrame, path: str, split: str = "split") -> None:
    """All splits in one pass, a folder each."""
    notes.write.partitionBy(split).json(path)


def write_metrics(report: DataFrame, path: str) -> None:
    """(name, value) as one JSON object; a row for each metric of each type by now."""
    one = report.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))).alias("value"))
    one.coalesce(1).write.text(path)


#: Other names that settings go by.
ALIASES = {"max_prev_sentence_token": "max_prev", "max_next_sentence_token": "max_next", "default_chunk_size": "chunk", "post_processor": "post_process", "deid_strategy": "strategy"}


@dataclass
class RunConfig:
    """Settings of a run."""

    notation: str = "BILOU"
    ner_types: list[str] = field(default_factory=list)
    post_process: str = "argmax"
    threshold: float | None = None
    max_tokens: int = 128
    max_prev: int = 32
    max_next: int = 32
    chunk: int = 32
    strategy: str = "replace_tag_type"
    keep_age: bool = False
    span_constraint: str = "super_strict"

    def __post_init__(self):
        if self.notation not in PREFIXES:
            raise ValueError(f"notation {self.notation!r}")
        if self.span_constraint not in ("exact", "strict", "super_strict"):
            raise ValueError(f"span_constraint {self.span_constraint!r}")

    @classmethod
    def load(cls, path: str) -> RunConfig:
        """Settings of a JSON file; those that aren't known raise an error."""
        config, extra = cls.read(path)
        if extra:
            raise ValueError(f"unknown settings: {', '.join(extra)}")
        return config

    @classmethod
    def read(cls, path: str) -> tuple[RunConfig, list[str]]:
        """Settings of a JSON file, and the names of those that aren't known."""
        raw = {ALIASES.get(k, k): v for k, v in json.loads(Path(path).read_text()).items()}
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in raw.items() if k in known}), sorted(set(raw) - known)
