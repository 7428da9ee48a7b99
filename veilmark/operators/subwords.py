"""Word pieces of tokens, and labels aligned with them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.arrow import arrow_task
from veilmark.functions.labels import inner_ids, label_ids, tag_id
from veilmark.functions.walk import ranges, strings
from veilmark.operators.context import CONTEXT_LABEL, KINDS, Notes, note_rows, shown, shown_tags
from veilmark.operators.scores import IGNORED


def rule_pieces(tokens: Column, size: int = 4) -> Column:
    """``array<array<string>>``: each token in pieces of ``size`` code points, a stand-in for a model's vocabulary; an empty token has one empty piece."""
    return F.transform(tokens, lambda t: F.when(t == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))))


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def piece_batches(batches: Iterator[pa.RecordBatch], path: str, at: int) -> Iterator[pa.RecordBatch]:
    tok = _tokenizer(path)
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            rows = [[e.tokens or [""] for e in tok.encode_batch(list(x), add_special_tokens=False)] if x else [] for x in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(pa.list_(pa.string())))], names=[*part.schema.names, "pieces"])


def model_pieces(df: DataFrame, path: str, tokens: str = "tokens") -> DataFrame:
    """Adds ``pieces`` (``array<array<string>>``) by a ``tokenizers`` file, each token on its own; a token that has no piece has an empty one."""
    from pyspark.sql import types as T

    added = T.StructField("pieces", T.ArrayType(T.ArrayType(T.StringType())))
    return df.mapInArrow(arrow_task(piece_batches, path=path, at=df.columns.index(tokens)), T.StructType([*df.schema.fields, added]))


def align(pieces: Column, labels: Column, tags: list[str], label_all: bool = False, special: bool = True) -> Column:
    """``array<struct<piece, word, label>>`` of a sentence's word pieces with label ids.

    The first piece of a token has the id of its tag; later ones are ignored, or with ``label_all`` have the same id, a first tag's becoming the inner tag's.
    Context tokens are ignored, and so are the ``special`` pieces (null) at both ends.  Tags that aren't in the vocabulary raise an error."""
    ids, inner = label_ids(tags), F.create_map(*[F.lit(x) for kv in inner_ids(tags).items() for x in kv])
    none = F.lit(IGNORED)

    def row(piece: Column, word: Column, label: Column) -> Column:
        return F.struct(piece.alias("piece"), word.cast("int").alias("word"), label.cast("int").alias("label"))

    def word(p: Column, y: Column, w: Column) -> Column:
        first = F.when(y == CONTEXT_LABEL, none).otherwise(tag_id(F.when(y == CONTEXT_LABEL, tags[0]).otherwise(y), ids))
        later = F.when(first == none, none).otherwise(F.element_at(inner, first)) if label_all else none
        return F.transform(p, lambda x, i: row(x, w, F.when(i == 0, first).otherwise(later)))

    words = F.transform(F.arrays_zip(pieces.alias("p"), labels.alias("y")), lambda x, w: word(x["p"], x["y"], w))
    end = F.array(row(F.lit(None).cast("string"), F.lit(None), none))
    return F.concat(end, F.flatten(words), end) if special else F.flatten(words)


def _pieces(tokens: pa.Array, size: int) -> tuple[pa.Array, np.ndarray]:
    """(the pieces of all tokens, where each token's begin): see ``rule_pieces``."""
    _, off, data = tokens.buffers()
    off = np.frombuffer(off, np.int32)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    at = np.searchsorted(place, off - off[0])
    count = np.maximum(1, -(-np.diff(at) // size))
    begins = np.concatenate(([0], np.cumsum(count)))
    k = np.arange(begins[-1]) - np.repeat(begins[:-1], count)
    return strings(data, np.append(place[np.repeat(at[:-1], count) + size * k], len(data))), begins


def _piece_kind(notes: Notes, tags: list[str], label_all: bool, size: int, context_labels: str, **parts) -> tuple[np.ndarray, dict[str, pa.Array]]:
    x = shown(notes, **parts)
    at, own, names = shown_tags(notes, x, context_labels)
    ids, inner = label_ids(tags), inner_ids(tags)
    unknown = {names[t] for t in np.unique(own)} - {*ids, CONTEXT_LABEL}
    if unknown:
        raise ValueError(f"no id for the tag {unknown.pop()}")
    first = np.array([IGNORED if t == CONTEXT_LABEL else ids.get(t, IGNORED) for t in names])
    later = np.array([inner.get(i, IGNORED) if label_all else IGNORED for i in first.tolist()])
    pieces, begins = _pieces(notes.column("token"), size)
    count, sizes = np.diff(begins)[at], x.sizes()
    row = np.repeat(np.arange(len(sizes)), sizes)
    word = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    body = np.arange(count.sum()) + 2 * np.repeat(row, count) + 1  # a special piece at both ends of a row
    total = len(body) + 2 * len(sizes)
    which, words, labels, none = np.zeros(total, np.int64), np.zeros(total, np.int32), np.full(total, IGNORED, np.int32), np.ones(total, bool)
    which[body], words[body], none[body] = ranges(begins[at], count), np.repeat(word, count), False
    labels[body] = np.where(np.arange(len(body)) == np.repeat(np.cumsum(count) - count, count), np.repeat(first[own], count), np.repeat(later[own], count))
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, count, len(sizes)).astype(np.int64) + 2)))
    items = pa.StructArray.from_arrays([pieces.take(pa.array(which, mask=none)), pa.array(words, mask=none), pa.array(labels)], ["piece", "word", "label"])
    return x.note(), {"sent": pa.array(x.s.sent[x.of].astype(np.int64)), "part": pa.array(x.part), "a": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)}


KINDS["pieces"] = _piece_kind


def piece_rows(notes: DataFrame, key: list[str], tags: list[str], label_all: bool = False, size: int = 4, budget: int = 128, chunk: int = 32, before: int = 32, after: int = 32, context_labels: str = CONTEXT_LABEL, tokens: str = "tokens", notation: str | None = None) -> DataFrame:
    """(key, sent, part, a): ``align`` of the ``rule_pieces`` of ``context.sentence_rows``, made in one step."""
    schema = "sent long, part long, a array<struct<piece:string,word:int,label:int>>"
    return note_rows(notes, key, tokens, "pieces", schema, notation, tags=tags, label_all=label_all, size=size, context_labels=context_labels, budget=budget, chunk=chunk, before=before, after=after)
