"""Redaction of entities in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.schema import NER_TYPES

STRATEGIES = ("remove", "replace_tag_type", "replace_informative")
#: A number from 1 to 8 or 10 to 88 with no digit beside it.
KEPT_AGE = r"(?<![0-9])(?:[1-7][0-9]?|8[0-8]?)(?![0-9])"
_NAMES = {"LOC": "LOCATION", "HOSP": "HOSPITAL"}


def templates(strategy: str) -> dict[str, str]:
    """What stands for an entity of each type; ``{}`` is its text."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy: one of {', '.join(STRATEGIES)}, not {strategy!r}")
    types = [*NER_TYPES, "MRN"]
    if strategy == "remove":
        return dict.fromkeys(types, "")
    wrap = "{}" if strategy == "replace_tag_type" else "<<{}:{{}}>>"
    return {t: wrap.format(_NAMES.get(t, t)) for t in types}


def replacement(value: Column, label: Column, strategy: str, keep_age: bool = False) -> Column:
    """An entity's replacement; unknown types raise an error."""
    by = F.create_map(*[F.lit(x) for kv in templates(strategy).items() for x in kv])
    got = F.coalesce(F.element_at(by, label), F.raise_error(F.concat(F.lit("no replacement for the type "), label)).cast("string"))
    got = F.replace(got, F.lit("{}"), value)
    return F.when((label == "AGE") & value.rlike(KEPT_AGE), value).otherwise(got) if keep_age else got


def normalise(text: Column) -> Column:
    """Runs of blanks to one, runs of line feeds to one, nothing at the ends."""
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x0B]+", " "), r"\n+", "\n")
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def redact(text: Column, entities: Column, strategy: str, keep_age: bool = False) -> Column:
    """A text with disjoint ``array<struct<start, end, label>>`` entities replaced, blanks normalised."""
    done = F.aggregate(
        F.array_sort(entities),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), replacement(F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), s["label"], strategy, keep_age)).alias("out"),
            s["end"].cast("long").alias("at"),
        ),
        lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    return normalise(done)


def redact_notes(notes: DataFrame, predictions: DataFrame, strategy: str, keep_age: bool = False) -> DataFrame:
    """Notes (note_id, text, seq) joined with predictions (note_id, entities): of notes that share an id the last one (by ``seq``) counts, and a
    prediction without a note raises an error."""
    last = notes.groupBy("note_id").agg(F.max_by("text", "seq").alias("text"))
    out = predictions.join(last, "note_id", "left")
    checked = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("no note "), F.col("note_id"))).cast("string")).otherwise(F.col("text"))
    return out.select("note_id", redact(checked, F.col("entities"), strategy, keep_age).alias("deid_text"))
