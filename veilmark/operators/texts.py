"""Entities, violations and counters of texts that are tokenized and tagged on the spot, text by text.

Nothing is shuffled, and no token leaves the task.  The results are those of ``entities`` and ``metrics`` for tables of tokens in any order, which need a window over each
key.  Tags are the rules', or what a function ``module:name`` makes of them: ``f(part, walk, tags, names)`` gives the tags of a batch's tokens as places in ``names``.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.functions.arrow import arrow_task
from veilmark.functions.schema import label_map, prefixes
from veilmark.functions.walk import Walk, slices, walk


class Tags:
    """Tags as places in a list of names, the first of which is O; what is asked of a tag is looked up by place."""

    def __init__(self, codes: np.ndarray, names: list[str], new: np.ndarray):
        self.codes, self.new = codes, new  # new: where texts begin
        self.prev = np.empty_like(codes)
        self.prev[1:] = codes[:-1]
        self.prev[new] = 0
        self._set(names)

    def _set(self, names: list[str]) -> None:
        self.names, self.types = names, list(dict.fromkeys(t[2:] for t in names if "-" in t))
        kinds = np.array([self.types.index(t[2:]) if "-" in t else -1 for t in names], np.int16)
        self.type, self.type_before = kinds[self.codes], kinds[self.prev]  # -1: none

    def mapped(self, to: dict[str, str]) -> Tags:
        out = object.__new__(Tags)
        used = np.bincount(self.codes, minlength=len(self.names)) > 0
        missing = [t for t, x in zip(self.names, used, strict=True) if x and t not in to]
        if missing:
            raise ValueError(f"no mapping for the tag {missing[0]}")
        out.codes, out.prev, out.new = self.codes, self.prev, self.new
        out._set([to.get(t, "O") for t in self.names])
        return out

    def begins(self, *prefix: str, codes: np.ndarray | None = None) -> np.ndarray:
        """Whether tags, or the tags at ``codes``, have one of the prefixes."""
        return np.array([t[:1] in prefix for t in self.names])[self.codes if codes is None else codes]

    def runs(self, notation: str, mode: str) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) token of each entity: see ``entities.entities`` and ``entities.lenient_entities``."""
        if mode == "lenient":
            opens = self.begins("B", "S", "U") | self.begins("E", "L", "S", "U", codes=self.prev) | (self.type != self.type_before)
        elif notation == "IO":
            opens = self.type != self.type_before
        else:
            first, inner, last, only = prefixes(notation)
            opens = ~(self.begins(inner, last) & self.begins(first, inner, codes=self.prev) & (self.type == self.type_before))
        typed = self.type >= 0
        start = typed & (opens | self.new | (self.type_before < 0))
        goes_on = np.append((typed & ~start)[1:], False)
        a, z = np.flatnonzero(start), np.flatnonzero(typed & ~goes_on)
        if mode != "lenient" and notation != "IO":
            ok = self.begins("B", codes=self.codes[a]) if notation == "BIO" else (self.begins(first, codes=self.codes[a]) & self.begins(last, codes=self.codes[z])) | self.begins(only, codes=self.codes[a])
            a, z = a[ok], z[ok]
        return a, z

    def violations(self, notation: str) -> np.ndarray:
        """Whether each tag may not follow the one before it."""
        if notation == "IO":
            return np.zeros(len(self.codes), bool)
        first, inner, last, only = prefixes(notation)
        none, typed = self.begins("O"), self.type >= 0
        if notation == "BIO":
            return ~(none | self.begins("B") | (self.begins("B", "I", codes=self.prev) & (self.type_before == self.type) & typed))
        inside = self.begins(first, inner, codes=self.prev) & (self.type_before == self.type) & typed
        return ~none & np.where(self.begins(first, only), ~self.begins("O", last, only, codes=self.prev), ~inside)


def _absorb(t: Tags, soft: np.ndarray) -> None:
    """Soft O tokens between two of one type take that type."""
    n = len(t.codes)
    at = np.arange(n)
    text = np.maximum.accumulate(np.where(t.new, at, 0))
    back = np.maximum.accumulate(np.where(soft, -1, at))
    ahead = np.minimum.accumulate(np.where(soft, n, at)[::-1])[::-1]
    x = np.flatnonzero(soft)
    x = x[(back[x] >= text[x]) & (ahead[x] < n)]
    x = x[text[ahead[x]] == text[x]]
    x = x[t.type[back[x]] == t.type[ahead[x]]]
    t.type[x] = t.type[back[x]]
    t.type_before[1:] = t.type[:-1]
    t.type_before[t.new] = -1


def _walked(batches: Iterator[pa.RecordBatch], notation: str, retag: str | None) -> Iterator[tuple[pa.RecordBatch, Walk, np.ndarray, np.ndarray, Tags, Tags]]:
    """(keys, walk, each token's row, rows with tokens, tags, the rules' tags) of batches whose last column holds texts."""
    change = getattr(import_module(retag.split(":")[0]), retag.split(":")[1]) if retag else None
    for b in batches:
        for at, off, data in slices(b.column(b.num_columns - 1)):
            part, w = b.slice(at, len(off) - 1), walk(off, data)
            if len(w.start):
                of = np.diff(w.ends)
                new = np.zeros(len(w.start), bool)
                new[w.ends[:-1][of > 0]] = True
                codes, names = w.tags(notation)
                yield part, w, np.repeat(np.arange(len(of)), of), np.flatnonzero(of), Tags(change(part, w, codes, names) if change else codes, names, new), Tags(codes, names, new)


def _keys(part: pa.RecordBatch, at: np.ndarray) -> list[pa.Array]:
    return [part.column(i).take(pa.array(at)) for i in range(part.num_columns - 1)]


def _named(names: list[str], at: np.ndarray) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(at, pa.int32()), pa.array(names, pa.string())).dictionary_decode()


def entity_batches(batches: Iterator[pa.RecordBatch], notation: str, mode: str, retag: str | None) -> Iterator[pa.RecordBatch]:
    for part, w, row, _, t, _ in _walked(batches, notation, retag):
        if mode == "signs":
            _absorb(t, (t.type < 0) & pc.match_substring_regex(w.token, r"^[^\p{L}\p{N}]+$").to_numpy(zero_copy_only=False))
        a, z = t.runs("IO" if mode in ("merged", "signs") else notation, mode)
        yield pa.RecordBatch.from_arrays([*_keys(part, row[a]), _named(t.types, t.type[a]), pa.array(w.start[a]), pa.array(w.end[z])], names=[*part.schema.names[:-1], "label", "start", "end"])


def _mapped(docs: DataFrame, key: list[str], text: str, fn, added: str, **params) -> DataFrame:
    src = docs.select(*key, F.col(text).cast("string").alias("__text"))
    return src.mapInArrow(arrow_task(fn, **params), T.StructType([*src.schema.fields[:-1], *T.StructType.fromDDL(added).fields]))


def entities(docs: DataFrame, key: list[str], notation: str, mode: str = "strict", retag: str | None = None, text: str = "text") -> DataFrame:
    """(key, label, start, end) of texts.  ``mode``: strict and lenient as in ``operators.entities``; merged with neighbours of a type as one (``relax``), signs with the signs between them as well
    (``absorb_signs``)."""
    if mode not in ("strict", "lenient", "merged", "signs"):
        raise ValueError(f"mode: strict, lenient, merged or signs, not {mode!r}")
    return _mapped(docs, key, text, entity_batches, "label string, start long, end long", notation=notation, mode=mode, retag=retag)


def violation_batches(batches: Iterator[pa.RecordBatch], notation: str, retag: str | None) -> Iterator[pa.RecordBatch]:
    for part, w, _, some, t, _ in _walked(batches, notation, retag):
        n = np.add.reduceat(t.violations(notation).astype(np.int64), w.ends[some])
        yield pa.RecordBatch.from_arrays([*_keys(part, some), pa.array(n)], names=[*part.schema.names[:-1], "violations"])


def violations(docs: DataFrame, key: list[str], notation: str, retag: str | None = None, text: str = "text") -> DataFrame:
    """(key, violations) of texts that have a token."""
    return _mapped(docs, key, text, violation_batches, "violations long", notation=notation, retag=retag)


def measure_batches(batches: Iterator[pa.RecordBatch], notation: str, maps: dict[str, dict[str, str]], mode: str, retag: str | None) -> Iterator[pa.RecordBatch]:
    for part, w, row, _, tags, truths in _walked(batches, notation, retag):
        keys = part.schema.names[:-1]
        for name, m in maps.items():
            t, y = (x.mapped(label_map(notation, m)) if m else x for x in (tags, truths))
            a, z = t.runs(notation, mode)
            g = np.flatnonzero((w.k == 1) & (y.type >= 0))
            n = np.bincount((y.type.astype(np.int64) + 1) * (len(t.types) + 1) + t.type + 1)
            pair = np.flatnonzero(n)
            spans = lambda kind, x, at, end: (kind, at, _named(x.types, x.type[at]), None, pa.array(w.start[at]), pa.array(end), None)  # noqa: E731, B023
            for kind, at, label, pred, start, end, count in (
                spans("gold", y, g, w.end[g + w.n[g] - 1]),
                spans("span", t, a, w.end[z]),
                ("pair", None, _named(["O", *y.types], pair // (len(t.types) + 1)), _named(["O", *t.types], pair % (len(t.types) + 1)), None, None, pa.array(n[pair])),
                ("violations", None, pa.nulls(1, pa.string()), None, None, None, pa.array([int(t.violations(notation).sum())])),
            ):
                size = len(label)
                own = [pa.nulls(size, part.column(i).type) for i in range(len(keys))] if at is None else _keys(part, row[at])
                rest = [pa.nulls(size, k) if x is None else x for x, k in ((pred, pa.string()), (start, pa.int64()), (end, pa.int64()), (count, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*own, pa.array([name] * size, pa.string()), pa.array([kind] * size, pa.string()), label, *rest], names=[*keys, "map", "kind", "label", "pred", "start", "end", "n"])


def measured(docs: DataFrame, key: list[str], notation: str, maps: dict[str, dict[str, str]], mode: str, retag: str | None = None, text: str = "text") -> DataFrame:
    """(key, map, kind, label, pred, start, end, n) of texts in one walk, under each projection of types by its name: the rules' entities (gold) and those of
    the tags (span), numbers of tokens by true (label) and predicted type (pair), and numbers of violations."""
    return _mapped(docs, key, text, measure_batches, "map string, kind string, label string, pred string, start long, end long, n long", notation=notation, maps=maps, mode=mode, retag=retag)
