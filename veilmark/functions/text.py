"""Sentences and tokens with offsets in code points.

A covering pattern matches every character of a text.  Texts are walked in Arrow batches, which gives offsets with the matches (tokens: ``walk``): nothing is
shuffled, and a text of any length costs one walk.  As column expressions the offsets would be running sums over a shuffled window of all pieces,
or over nested arrays; both were several times slower.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.functions.arrow import arrow_task
from veilmark.functions.walk import slices, walk

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"\+[0-9][0-9 ().-]{7,}[0-9]"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
NUMBER = r"[0-9]{9,}"
#: Rules of the stand-in tagger, in order of preference.
RULES = [("EMAIL", EMAIL), ("PHONE", PHONE), ("ID", IP), ("ID", NUMBER)]
BASE = r"(?:\s+|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"
COVER = "(?:" + "|".join(p for _, p in RULES) + r"|\s+|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"
SENTENCE = r"(?:[^.!?\n]+[.!?\n]*|[.!?\n]+)"


#: Texts of a batch that are walked at once.
SLICE = 200
#: ASCII white space, as ``\\s`` means it outside Python.
_BLANK = r"[ \t\n\x0B\f\r]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


@cache
def compiled(pattern: str):
    import regex

    return regex.compile(pattern.replace(r"[^\s", "[^ \\t\\n\\x0B\\f\\r").replace(r"\s", _BLANK).replace(r"\S", _BLANK.replace("[", "[^", 1)))


def _rows(part: pa.RecordBatch, place: list[int], names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    """The last column's rows spread over their keys."""
    at = pa.array(place, pa.int32())
    return pa.RecordBatch.from_arrays([*[part.column(i).take(at) for i in range(part.num_columns - 1)], *columns], names=[*part.schema.names[:-1], *names])


def piece_batches(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[pa.RecordBatch]:
    find = compiled(pattern).finditer
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            found = [(r, i, m.group(), m.start(), m.end()) for r, x in enumerate(part.column(part.num_columns - 1).to_pylist()) for i, m in enumerate(find(x or ""))]
            r, i, p, s, e = zip(*found, strict=True) if found else ((),) * 5
            yield _rows(part, r, ["pos", "piece", "start", "end"], [pa.array(i, pa.int64()), pa.array(p, pa.string()), pa.array(s, pa.int64()), pa.array(e, pa.int64())])


def _with(docs: DataFrame, key: list[str], text: str, schema: str) -> tuple[DataFrame, T.StructType]:
    src = docs.select(*key, F.col(text).cast("string").alias("__text"))
    return src, T.StructType([*src.schema.fields[:-1], *T.StructType.fromDDL(schema).fields])


def pieces(docs: DataFrame, pattern: str, key: list[str], text: str = "text") -> DataFrame:
    """(key, pos, piece, start, end) of a covering pattern's matches; ``\\s`` is ASCII white space."""
    src, schema = _with(docs, key, text, "pos long, piece string, start long, end long")
    return src.mapInArrow(arrow_task(piece_batches, pattern=pattern), schema)


def rule_label(piece: Column) -> Column:
    """The type that the rules give a piece, or null."""
    out = F.lit(None).cast("string")
    for label, p in reversed(RULES):
        out = F.when(piece.rlike(f"^(?:{p})$"), label).otherwise(out)
    return F.when(piece.rlike("[0-9@]"), out)  # what no rule can do without


TOKEN_FIELDS = "token string, start long, end long, sent long, label string, ent long, k long, n long"


def kind_of(field: str) -> pa.DataType:
    return pa.string() if field in ("token", "label") else pa.int64()


def token_batches(batches: Iterator[pa.RecordBatch], nested: bool, labelled: bool, fields: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, off, data in slices(b.column(b.num_columns - 1)):
            part, w = b.slice(at, len(off) - 1), walk(off, data)
            keep = None
            if labelled:
                own = np.concatenate(([0], np.cumsum(w.label >= 0)))[w.ends]
                keep = np.repeat(np.diff(own) > 0, np.diff(w.ends))
            columns = [w.column(f) if keep is None else w.column(f).filter(pa.array(keep)) for f in fields]
            of = np.diff(w.ends) if keep is None else np.diff(w.ends) * (np.diff(own) > 0)
            if nested:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(of))), pa.int32()), pa.StructArray.from_arrays(columns, fields))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*part.schema.names[:-1], "tokens"])
            else:
                yield _rows(part, np.repeat(np.arange(len(of)), of), fields, columns)


def span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, off, data in slices(b.column(b.num_columns - 1)):
            part, w = b.slice(at, len(off) - 1), walk(off, data)
            first, last = np.flatnonzero((w.label >= 0) & (w.k == 1)), np.flatnonzero((w.label >= 0) & (w.k == w.n))
            label = pa.array([w.names[i] for i in w.label[first]], pa.string())
            yield _rows(part, np.searchsorted(w.ends, first, "right") - 1, ["ent", "label", "start", "end"], [pa.array(w.ent[first]), label, pa.array(w.start[first]), pa.array(w.end[last])])


def rule_spans(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, ent, label, start, end): the texts' entities by the rules, as ``tokens`` has them."""
    src, schema = _with(docs, key, text, "ent long, label string, start long, end long")
    return src.mapInArrow(arrow_task(span_batches), schema)


def _fields(names: list[str] | None) -> list[tuple[str, str]]:
    every = [tuple(f.split()) for f in f"idx long, {TOKEN_FIELDS}".split(", ")]
    return [f for f in every if names is None or f[0] in names]


def tokens(docs: DataFrame, key: list[str], text: str = "text", labelled: bool = False, fields: list[str] | None = None) -> DataFrame:
    """(key, idx, token, start, end, sent, label, ent, k, n): tokens that aren't blank, with the rule entity ``ent`` that they
    belong to, the token's place ``k`` of ``n`` in it, and their sentence; or ``fields`` of these.  Entities are split into tokens like any other text.  ``labelled``: only the
    tokens of texts that have an entity.  A text's tokens come one after another."""
    own = _fields(fields)
    src, schema = _with(docs, key, text, ", ".join(map(" ".join, own)))
    return src.mapInArrow(arrow_task(token_batches, nested=False, labelled=labelled, fields=[f for f, _ in own]), schema)


def note_tokens(docs: DataFrame, key: list[str], text: str = "text", labelled: bool = False) -> DataFrame:
    """(key, tokens): the same as an array of structs, a row for each text; a text without tokens has an empty one, and so has with ``labelled`` one without an entity."""
    src, schema = _with(docs, key, text, f"tokens array<struct<{TOKEN_FIELDS.replace(' ', ':').replace(',:', ',')}>>")
    return src.mapInArrow(arrow_task(token_batches, nested=True, labelled=labelled, fields=[f for f, _ in _fields(None)][1:]), schema)


def whole_note(text: Column) -> Column:
    """The whole note as one sentence: ``array<struct<text, start, end>>``."""
    return F.array(F.struct(text.alias("text"), F.lit(0).alias("start"), F.length(text).alias("end")))


def squeeze(token: Column) -> Column:
    """Long runs of signs become eight of the run's last; otherwise blanks in a token become hyphens."""
    sign = r"[^\p{L}\p{N}]"
    return F.when(token.rlike(f"({sign}){{9,}}"), F.regexp_replace(token, f"({sign}){{8,}}", "$1" * 8)).otherwise(F.regexp_replace(token, " ", "-"))


def chunks(items: Column, size: int) -> Column:
    """An array cut into arrays of ``size``; the last may be shorter."""
    if size < 1:
        raise ValueError("size: 1 or more")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(1), F.size(items), F.lit(size)), lambda p: F.slice(items, p, size))).otherwise(F.array())


_SENTENCIZERS: dict[str, Callable] = {"note": lambda docs, key: docs.select(*key, F.lit(0).cast("long").alias("pos"), F.col("text").alias("piece"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end")), "rule": lambda docs, key: pieces(docs, SENTENCE, key)}
_TOKENIZERS: dict[str, Callable] = {"rule": tokens}


def register(kind: str, name: str, make: Callable) -> None:
    """Add a sentencizer or tokenizer, for instance one that wraps a model in a pandas UDF."""
    {"sentencizer": _SENTENCIZERS, "tokenizer": _TOKENIZERS}[kind][name] = make


def sentencizer(name: str) -> Callable:
    if name not in _SENTENCIZERS:
        raise ValueError(f"no sentencizer {name!r}; there are {sorted(_SENTENCIZERS)}")
    return _SENTENCIZERS[name]


def tokenizer(name: str) -> Callable:
    if name not in _TOKENIZERS:
        raise ValueError(f"no tokenizer {name!r}; there are {sorted(_TOKENIZERS)}")
    return _TOKENIZERS[name]
