"""Context around sentences: windows, budget, chunks.

Rows of sentences are made in Arrow batches, from notes with their tokens or from texts that are tokenized on the spot: as column expressions every slice of
a note's tokens copied all of them first, so that a note cost as much as its tokens times its sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.functions.arrow import arrow_task
from veilmark.functions.text import kind_of
from veilmark.functions.walk import Walk, ranges, slices, walk


def trim(p: Column, c: Column, n: Column, budget: int, chunk: int) -> tuple[Column, Column]:
    """What is left of ``p`` tokens before and ``n`` after a sentence of ``c``, within the budget.

    The farther end of the longer side goes first, of the right one at a tie, as long as a side is longer than ``chunk``."""
    zero = F.lit(0)
    d = F.greatest(zero, p + c + n - budget)
    k = F.when(n >= p, F.least(d, n - p, F.greatest(n - chunk, zero))).otherwise(F.least(d, p - n, F.greatest(p - chunk, zero)))
    p1, n1, d1 = F.when(n >= p, p).otherwise(p - k), F.when(n >= p, n - k).otherwise(n), d - k
    more = F.when((d1 > 0) & (n1 == p1) & (n1 > chunk), F.least(d1, 2 * (n1 - chunk))).otherwise(zero)
    return p1 - F.floor(more / 2), n1 - F.ceil(more / 2)


@dataclass
class Notes:
    """Tokens of a batch of notes; those of note r are from ``ends[r]`` to ``ends[r + 1]``.  ``value``: a field of all tokens; tags are places in ``names``."""

    ends: np.ndarray
    sent: np.ndarray
    value: dict[str, pa.Array] | Walk
    tags: np.ndarray | None
    names: list[str]

    def column(self, field: str) -> pa.Array:
        if field == "tag":
            return pa.DictionaryArray.from_arrays(pa.array(self.tags, pa.int32()), pa.array(self.names, pa.string())).dictionary_decode()
        return self.value.column(field) if isinstance(self.value, Walk) else self.value[field]


def _notes(b: pa.RecordBatch, notation: str | None) -> Iterator[tuple[pa.RecordBatch, Notes]]:
    """Parts of a batch whose last column holds texts or tokens, and their notes."""
    last = b.column(b.num_columns - 1)
    if pa.types.is_string(last.type):
        for at, off, data in slices(last):
            w = walk(off, data)
            tags, names = w.tags(notation) if notation else (np.zeros(len(w.start), np.int64), ["O"])
            yield b.slice(at, len(off) - 1), Notes(w.ends, w.sent, w, tags, names)
        return
    for at in range(0, b.num_rows, 200):
        part = b.slice(at, 200)
        lists = part.column(part.num_columns - 1)
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        flat = lists.flatten()
        value = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
        tags, names = None, []
        if "tag" in value:
            coded = value["tag"].dictionary_encode()
            tags, names = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False), [*coded.dictionary.to_pylist(), None]
        yield part, Notes(ends, value["sent"].to_numpy(zero_copy_only=False) if "sent" in value else np.zeros(len(flat)), value, tags, names)


def note_batches(batches: Iterator[pa.RecordBatch], what: str, notation: str | None, **params) -> Iterator[pa.RecordBatch]:
    """Rows of notes by one of ``KINDS``: the notes' keys, and columns that it adds."""
    import veilmark.operators.subwords  # noqa: F401  has a kind of its own

    for b in batches:
        for part, notes in _notes(b, notation):
            of, columns = KINDS[what](notes, **params)
            at = pa.array(of.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*[part.column(i).take(at) for i in range(part.num_columns - 1)], *columns.values()], names=[*part.schema.names[:-1], *columns])


def note_rows(notes: DataFrame, key: list[str], tokens: str, what: str, schema: str | list, notation: str | None = None, **params) -> DataFrame:
    src = notes.select(*key, F.col(tokens).alias("__tokens"))
    added = T.StructType.fromDDL(schema).fields if isinstance(schema, str) else schema
    return src.mapInArrow(arrow_task(note_batches, what=what, notation=notation, **params), T.StructType([*src.schema.fields[:-1], *added]))


def _trimmed(p: np.ndarray, c: np.ndarray, n: np.ndarray, budget: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """``trim`` of arrays."""
    d = np.maximum(0, p + c + n - budget)
    right = n >= p
    k = np.where(right, np.minimum(np.minimum(d, n - p), np.maximum(n - chunk, 0)), np.minimum(np.minimum(d, p - n), np.maximum(p - chunk, 0)))
    p, n, d = np.where(right, p, p - k), np.where(right, n - k, n), d - k
    more = np.where((d > 0) & (n == p) & (n > chunk), np.minimum(d, 2 * (n - chunk)), 0)
    return p - more // 2, n - (more + 1) // 2


@dataclass
class Sentences:
    """Sentences as token ranges [i, j) of their notes: the note, its first token, and the sizes of the bounded contexts."""

    note: np.ndarray
    base: np.ndarray
    sent: np.ndarray
    i: np.ndarray
    j: np.ndarray
    n_before: np.ndarray
    n_after: np.ndarray


def _sentences(notes: Notes, before: int, after: int) -> Sentences:
    n = len(notes.sent)
    new = np.ones(n + 1, bool)
    new[1:n] = notes.sent[1:] != notes.sent[:-1]
    new[notes.ends] = True
    edges = np.flatnonzero(new)
    first, end = edges[:-1], edges[1:]
    note = np.searchsorted(notes.ends, first, "right") - 1
    base = notes.ends[note]
    i, j = first - base, end - base
    return Sentences(note, base, notes.sent[first], i, j, np.minimum(i, before), np.minimum(notes.ends[note + 1] - end, after))


def _lists(values: pa.Array, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values.take(pa.array(ranges(starts, sizes))))


def _numbers(**columns: np.ndarray) -> dict[str, pa.Array]:
    return {k: pa.array(v.astype(np.int64)) for k, v in columns.items()}


def _sentence_kind(notes: Notes, before: int, after: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
    s = _sentences(notes, before, after)
    return s.note, _numbers(sent=s.sent, i=s.i, j=s.j, n_before=s.n_before, n_after=s.n_after)


def _window_kind(notes: Notes, before: int, after: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
    s, token = _sentences(notes, before, after), notes.column("token")
    numbers = _numbers(sent=s.sent, i=s.i, j=s.j, n_before=s.n_before, n_after=s.n_after)
    return s.note, numbers | {"context_before": _lists(token, s.base + s.i - s.n_before, s.n_before), "context_after": _lists(token, s.base + s.j, s.n_after)}


@dataclass
class Shown:
    """Parts of sentences: the sentences, which of them a part is of, its ranges and contexts, and the batch's tokens that each part's row shows."""

    s: Sentences
    of: np.ndarray
    part: np.ndarray
    i: np.ndarray
    j: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def note(self) -> np.ndarray:
        return self.s.note[self.of]

    def starts(self) -> np.ndarray:
        return self.s.base[self.of] + self.i - self.left

    def sizes(self) -> np.ndarray:
        return self.left + self.j - self.i + self.right


def shown(notes: Notes, budget: int, chunk: int, before: int, after: int) -> Shown:
    """``parts`` of all sentences."""
    size = budget - 2 * chunk
    if size <= 0:
        raise ValueError("budget must exceed twice the chunk")
    s = _sentences(notes, before, after)
    p, n = _trimmed(s.n_before, s.j - s.i, s.n_after, budget, chunk)
    long_ = p + s.j - s.i + n > budget
    count = np.where(long_, -(-(s.j - s.i) // size), 1)
    of = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    i, j, p, n, long_ = s.i[of], s.j[of], p[of], n[of], long_[of]
    a = np.where(long_, i + k * size, i)
    z = np.where(long_, np.minimum(j, a + size), j)
    left, right = _trimmed(np.minimum(before, a - i), z - a, np.minimum(after, j - z), budget, chunk)
    return Shown(s, of, k, a, z, np.where(long_, left + np.where(k == 0, p, 0), p), np.where(long_, right + np.where(z == j, n, 0), n))


def _part_kind(notes: Notes, budget: int, chunk: int, before: int, after: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
    x = shown(notes, budget, chunk, before, after)
    return x.note(), _numbers(sent=x.s.sent[x.of], part=x.part, part_i=x.i, part_j=x.j, left=x.left, right=x.right)


def shown_tags(notes: Notes, x: Shown, context_labels: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(tokens that the rows show, their tags as places in a list, that list)."""
    sizes = x.sizes()
    at = ranges(x.starts(), sizes)
    tags = notes.tags[at]
    if context_labels != "label":
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = (place >= np.repeat(x.left, sizes)) & (place < np.repeat(sizes - x.right, sizes))
        tags = np.where(inside, tags, len(notes.names))
    return at, tags, [*notes.names, CONTEXT_LABEL]


def _row_kind(notes: Notes, budget: int, chunk: int, before: int, after: int, context_labels: str, info: list[str]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    x = shown(notes, budget, chunk, before, after)
    at, tags, names = shown_tags(notes, x, context_labels)
    ends = pa.array(np.concatenate(([0], np.cumsum(x.sizes()))), pa.int32())
    base = x.s.base[x.of]
    # every token is in the own part of one row, in order
    own = pa.StructArray.from_arrays([notes.column(SOURCE.get(f, f)) for f in info], info)
    tag = pa.DictionaryArray.from_arrays(pa.array(tags, pa.int32()), pa.array(names, pa.string())).dictionary_decode()
    return x.note(), _numbers(sent=x.s.sent[x.of], part=x.part) | {
        "start": notes.column("start").take(pa.array(base + x.i)), "end": notes.column("end").take(pa.array(base + x.j - 1)),
        "tokens": pa.ListArray.from_arrays(ends, notes.column("token").take(pa.array(at))), "labels": pa.ListArray.from_arrays(ends, tag),
        "current_sent_info": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(x.j - x.i))), pa.int32()), own),
    }


def _chunk_kind(notes: Notes, size: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """A note's tokens cut into arrays of ``size``; the last may be shorter."""
    of = np.diff(notes.ends)
    count = -(-of // size)
    note = np.repeat(np.arange(len(of)), count)
    k = np.arange(len(note)) - np.repeat(np.cumsum(count) - count, count)
    ends = np.append(notes.ends[note] + k * size, notes.ends[-1])
    return note, _numbers(chunk=k) | {"tokens": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), notes.column("token"))}


KINDS = {"sentences": _sentence_kind, "windows": _window_kind, "parts": _part_kind, "rows": _row_kind, "chunks": _chunk_kind}


def token_chunks(notes: DataFrame, key: list[str], size: int, tokens: str = "tokens") -> DataFrame:
    """(key, chunk, tokens): the tokens of notes, or of texts, in arrays of ``size``, of which a note's last may be shorter."""
    if size < 1:
        raise ValueError("size: 1 or more")
    return note_rows(notes, key, tokens, "chunks", "chunk long, tokens array<string>", size=size)


def sentences(notes: DataFrame, key: list[str], before: int = 32, after: int = 32, tokens: str = "tokens") -> DataFrame:
    """(key, sent, i, j, n_before, n_after): sentences of notes (key, tokens), or of texts, with the sizes of their bounded contexts."""
    return note_rows(notes, key, tokens, "sentences", "sent long, i long, j long, n_before long, n_after long", before=before, after=after)


def windows(notes: DataFrame, key: list[str], before: int = 32, after: int = 32, tokens: str = "tokens") -> DataFrame:
    """(key, sent, i, j, n_before, n_after, context_before, context_after) of notes (key, ``array<struct<token, sent, ..>>`` tokens), or of texts.

    Nothing is shuffled, and no sentence's row holds the whole note."""
    return note_rows(notes, key, tokens, "windows", "sent long, i long, j long, n_before long, n_after long, context_before array<string>, context_after array<string>", before=before, after=after)


def note_parts(notes: DataFrame, key: list[str], budget: int, chunk: int, before: int, after: int, tokens: str = "tokens") -> DataFrame:
    """(key, sent, part, part_i, part_j, left, right): ``sentences`` and ``split_long`` in one."""
    return note_rows(notes, key, tokens, "parts", "sent long, part long, part_i long, part_j long, left long, right long", budget=budget, chunk=chunk, before=before, after=after)


def parts(i: Column, j: Column, n_before: Column, n_after: Column, budget: int, chunk: int, before: int, after: int) -> Column:
    """``array<struct<part, part_i, part_j, left, right>>`` of a sentence [i, j) with contexts of ``n_before`` and ``n_after`` tokens.

    A sentence that exceeds the budget with its trimmed contexts is cut into ``budget - 2 * chunk`` tokens each, and the cuts are treated as the
    sentences of a note: each has up to ``before`` and ``after`` tokens of the others as context, trimmed to the budget.  The
    sentence's own trimmed contexts are then put before the first and after the last one, whatever length that gives."""
    size = budget - 2 * chunk
    if size <= 0:
        raise ValueError("budget must exceed twice the chunk")
    p, n = trim(n_before, j - i, n_after, budget, chunk)
    long_ = p + (j - i) + n > budget

    def cut(k: Column) -> Column:
        a = i + k * size
        z = F.least(j, a + size)
        left, right = trim(F.least(F.lit(before), a - i), z - a, F.least(F.lit(after), j - z), budget, chunk)
        return _part(k, a, z, left + F.when(k == 0, p).otherwise(0), right + F.when(z == j, n).otherwise(0))

    return F.when(long_, F.transform(F.sequence(F.lit(0), F.ceil((j - i) / size).cast("int") - 1), cut)).otherwise(F.array(_part(F.lit(0), i, j, p, n)))


def _part(*values: Column) -> Column:
    return F.struct(*[v.cast("long").alias(n) for n, v in zip(("part", "part_i", "part_j", "left", "right"), values, strict=True)])


def split_long(sentences: DataFrame, budget: int, chunk: int, before: int, after: int) -> DataFrame:
    """Sentences (i, j, n_before, n_after) with part, part_i, part_j, left, right: see ``parts``."""
    return sentences.select("*", F.inline(parts(F.col("i"), F.col("j"), F.col("n_before"), F.col("n_after"), budget, chunk, before, after)))


CONTEXT_LABEL = "NA"
#: Fields of ``current_sent_info`` that tokens have under another name.
SOURCE = {"text": "token", "label": "tag"}


def sentence_rows(notes: DataFrame, key: list[str], budget: int = 128, chunk: int = 32, before: int = 32, after: int = 32, context_labels: str = CONTEXT_LABEL, tokens: str = "tokens", info: list[str] | None = None, notation: str | None = None) -> DataFrame:
    """(key, sent, part, start, end, tokens, labels, current_sent_info): what a tagger is given, a row for each sentence or part of one.

    ``tokens`` of the notes: ``array<struct<token, start, end, sent, tag, ..>>``, or texts, whose tokens have the rules' tags in ``notation``, or O without one.  A row holds a part's tokens between its
    contexts.  Context tokens are labelled NA, so that nothing is learned or scored from
    them, or with ``context_labels="label"`` as they are.  ``current_sent_info`` holds the part's own tokens; start and end are those of its
    first and last one.  A note without tokens gives no row."""
    if context_labels not in (CONTEXT_LABEL, "label"):
        raise ValueError(f"context_labels: {CONTEXT_LABEL} or label, not {context_labels!r}")
    info = info or ["text", "start", "end", "label"]
    kind = notes.schema[tokens].dataType
    of = {f.name: f.dataType for f in kind.elementType} if isinstance(kind, T.ArrayType) else {f: T.StringType() if f == "tag" or pa.types.is_string(kind_of(f)) else T.LongType() for f in ("token", "start", "end", "sent", "tag", "label", "ent", "k", "n")}
    words, own = T.ArrayType(T.StringType()), T.StructType([T.StructField(f, of[SOURCE.get(f, f)]) for f in info])
    fields = {"sent": T.LongType(), "part": T.LongType(), "start": of["start"], "end": of["end"], "tokens": words, "labels": words, "current_sent_info": T.ArrayType(own)}
    return note_rows(notes, key, tokens, "rows", [T.StructField(n, k) for n, k in fields.items()], notation, budget=budget, chunk=chunk, before=before, after=after, context_labels=context_labels, info=info)
