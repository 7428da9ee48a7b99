"""Span repair: blanks, alignment with tokens, and overlaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions.schema import PRIORITY

_SPANS = "array<struct<start:int,end:int,label:string>>"


def sort_spans(spans: Column) -> Column:
    """By start, then end; spans are structs that begin with these."""
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"]).cast("int"))


def strip_blanks(text: Column, span: Column) -> Column:
    """A span without one blank character at its start and all at its end."""
    start = span["start"] + F.when(F.substr(text, span["start"] + 1, F.lit(1)).rlike(r"(?U)^\s"), 1).otherwise(0)
    body = F.substr(text, start + 1, span["end"] - start)
    return F.struct(start.cast("int").alias("start"), (start + F.length(F.regexp_replace(body, r"(?U)\s+$", ""))).cast("int").alias("end"), span["label"].alias("label"))


def align(span: Column, starts: Column, ends: Column) -> Column:
    """A span grown to the nearest token start at or before its start and token end at or after its end; null fields if there is none."""
    return F.struct(
        F.array_max(F.filter(starts, lambda x: x <= span["start"])).alias("start"), F.array_min(F.filter(ends, lambda x: x >= span["end"])).alias("end"), span["label"].alias("label")
    )


def resolve(text: Column, spans: Column, priority: dict[str, int] = PRIORITY) -> Column:
    """Sorted spans without overlap: of equal ones the higher priority (the earlier at a tie), contained ones go, and one that
    begins inside the last kept one loses what they share and the blanks after it.

    The last span's start is remembered as it was before it was cut; only equality with the next span depends on it."""
    rank = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])
    none = F.from_json(F.lit("[]"), _SPANS)

    def step(a: Column, s: Column) -> Column:
        kept, n = a["out"], F.size(a["out"])
        same = (s["start"] == a["start"]) & (s["end"] == a["end"])
        wins = F.coalesce(F.element_at(rank, s["label"]), F.lit(0)) > F.coalesce(F.element_at(rank, a["label"]), F.lit(0))
        cut = F.substr(text, a["end"] + 1, s["end"] - a["end"])
        start = s["end"] - F.length(F.regexp_replace(cut, r"(?U)^\s+", ""))

        def state(out: Column) -> Column:
            return F.struct(out.alias("out"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["label"].alias("label"))

        def span(at: Column) -> Column:
            return F.array(F.struct(at.cast("int").alias("start"), s["end"].cast("int").alias("end"), s["label"].alias("label")))

        return (
            F.when(same & wins, state(F.concat(F.slice(kept, 1, F.greatest(n - 1, F.lit(0))), span(s["start"]))))
            .when(same, a)
            .when((s["start"] < a["end"]) & (s["end"] <= a["end"]), a)
            .when(s["start"] < a["end"], state(F.concat(kept, span(start))))
            .otherwise(state(F.concat(kept, span(s["start"]))))
        )

    zero = F.struct(none.alias("out"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(None).cast("string").alias("label"))
    return F.aggregate(sort_spans(spans), zero, step, lambda a: a["out"])


def fix(text: Column, spans: Column, starts: Column, ends: Column, priority: dict[str, int] = PRIORITY) -> Column:
    """Blanks, alignment and overlaps in turn."""
    stripped = F.transform(spans, lambda s: strip_blanks(text, s))
    return resolve(text, F.filter(F.transform(stripped, lambda s: align(s, starts, ends)), lambda s: s["start"].isNotNull() & s["end"].isNotNull()), priority)
