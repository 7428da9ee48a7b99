"""Regular-expression matches with code-point offsets, as column expressions.

``split`` and ``regexp_extract_all`` walk a text by the same leftmost matches, so the lengths of the pieces
between matches and of the matches themselves, summed up, give every offset in code points.  The sums are taken
in blocks of ``BLOCK`` matches, so a text with many matches costs its number of matches times the block.

Patterns are written so that no text makes them walk a run twice: a run is entered at its start only (or where the
last match ended, ``\\G``) and is never given back.  That keeps the leftmost matches as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


_SPANS = "array<struct<start:int,end:int,value:string>>"


def no_spans() -> Column:
    return F.from_json(F.lit("[]"), _SPANS)


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str, ask: Column | None = None) -> Column:
    """``array<struct<start, end, value>>`` of the non-empty matches; end is exclusive.  ``ask``: where to look at all."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ask = text.rlike(pattern) if ask is None else ask
    return F.when(ask, let(F.struct(F.split(text, pattern, -1).alias("p"), found.alias("m")), _offsets)).otherwise(no_spans())


def _offsets(x: Column) -> Column:
    steps = F.zip_with(F.slice(x["p"], 1, F.size(x["m"])), x["m"], lambda p, m: F.struct(F.length(p).alias("g"), F.length(m).alias("k"), m.alias("v")))

    def blocks(s: Column) -> Column:  # by place, not by slice, which copies the whole array each time
        return F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(BLOCK)), lambda b: F.transform(F.sequence(b, F.least(b + BLOCK, F.size(s)) - 1), lambda i: s[i]))

    return F.when(F.size(x["m"]) == 0, no_spans()).otherwise(let(let(steps, blocks), _place))


def _place(blocks: Column) -> Column:
    zero = F.lit(0)
    none = F.from_json(F.lit("[]"), "array<int>")
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, s: a + s["g"] + s["k"]))
    before = F.aggregate(
        totals,
        F.struct(zero.alias("at"), none.alias("all")),
        lambda a, t: F.struct((a["at"] + t).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
    )["all"]
    return F.flatten(F.zip_with(blocks, before, _within))


def _within(block: Column, at: Column) -> Column:
    return F.aggregate(
        block,
        F.struct(at.alias("at"), no_spans().alias("all")),
        lambda a, s: F.struct(
            (a["at"] + s["g"] + s["k"]).alias("at"),
            F.concat(a["all"], F.array(F.struct((a["at"] + s["g"]).alias("start"), (a["at"] + s["g"] + s["k"]).alias("end"), s["v"].alias("value")))).alias("all"),
        ),
    )["all"]


def joined(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of ``array<struct<start, rank, end>>`` in order, comma-joined; rank is the place in ``kinds``."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(names[s["rank"]], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))
