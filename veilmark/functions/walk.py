"""The rule tokenizer over a batch of texts at once, in numpy.

Code points are blanks, parts of words, or signs; where one kind follows another a piece begins, so blanks, words and signs need no walk.  Only what a rule may match,
a run of non-blanks with an ``@``, a plus before a digit, nine digits or three dots between digits, is walked by the covering pattern,
from the run's start to the next blank that no rule takes: what the pattern finds there doesn't depend on what is before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of the texts that are walked at once; one text may have more.
BYTES = 1 << 19
_WORD, _SIGN = 1, 2


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point: blank, part of a word, or sign."""
    import regex

    kind = np.full(0x110000, _SIGN, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for m in regex.finditer(r"[\p{L}\p{N}_]+", every):
        kind[m.start() : m.end()] = _WORD
    kind[[ord(c) for c in " \t\n\x0b\f\r"]] = 0
    return kind


@dataclass
class Walk:
    """Tokens of texts; those of text r are from ``ends[r]`` to ``ends[r + 1]``.  ``label``: place in ``names`` or -1."""

    ends: np.ndarray
    token: pa.Array
    start: np.ndarray
    end: np.ndarray
    sent: np.ndarray
    label: np.ndarray
    ent: np.ndarray
    k: np.ndarray
    n: np.ndarray
    names: list[str]

    def idx(self) -> np.ndarray:
        return np.arange(len(self.start)) - np.repeat(self.ends[:-1], np.diff(self.ends))

    def column(self, field: str) -> pa.Array:
        if field == "token":
            return self.token
        if field == "label":
            return pa.DictionaryArray.from_arrays(pa.array(self.label, mask=self.label < 0), self.names).dictionary_decode()
        return pa.array(self.idx() if field == "idx" else getattr(self, field))


    def tags(self, notation: str) -> tuple[np.ndarray, list[str]]:
        """The tokens' tags, as places in a list of tags."""
        from veilmark.functions.schema import prefixes

        first, inner, last, only = prefixes(notation)
        own = np.where(self.n == 1, 3, np.where(self.k == 1, 0, np.where(self.k == self.n, 2, 1)))
        return np.where(self.label < 0, 0, 1 + 4 * self.label.astype(np.int64) + own), ["O", *[f"{p}-{x}" for x in self.names for p in (first, inner, last, only)]]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    total = np.cumsum(sizes)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of texts, about ``BYTES`` at a time."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(off, off[at] + BYTES, "right")) - 1)
        yield at, off[at : end + 1] - off[at], data[off[at] : off[end]]
        at = end


def _matches(text: str, at: int) -> tuple[list[tuple[int, int, str]], int]:
    """The rule pieces (start, end, label) from a piece's start on, up to the next blank piece, and that one's start."""
    from veilmark.functions.text import RULES, compiled

    rules = [(name, p) for name, p in RULES if name != "EMAIL" or "@" in text]
    found = []
    for m in compiled("|".join(f"({p})" for _, p in rules) + r"|\s+|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]").finditer(text, at):
        if m.lastindex is not None:
            found.append((m.start(), m.end(), rules[m.lastindex - 1][0]))
        elif m.group()[0] in " \t\n\x0b\f\r":
            return found, m.start()
    return found, len(text)


def _candidates(cp: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Places that whatever a rule matches holds one of; ``cut``: where texts begin."""
    at = [np.flatnonzero(cp == ord("@"))]
    digit = (cp >= ord("0")) & (cp <= ord("9"))
    if digit.any():
        plus = np.flatnonzero(cp[:-1] == ord("+"))
        dot = np.flatnonzero(cp[1:-1] == ord(".")) + 1
        dot = dot[digit[dot - 1] & digit[dot + 1]]
        near = np.diff(dot) <= 4
        first, last = digit & cut[:-1], digit & cut[1:]
        first[1:] |= digit[1:] & ~digit[:-1]
        last[:-1] |= digit[:-1] & ~digit[1:]
        last[-1] |= digit[-1]
        first[0] |= digit[0]
        first = np.flatnonzero(first)
        at += [plus[digit[plus + 1]], dot[:-2][near[:-1] & near[1:]], first[np.flatnonzero(last) - first >= 8]]
    return np.sort(np.concatenate(at))


def walk(off: np.ndarray, data: np.ndarray) -> Walk:
    """The tokens of texts that lie one after another in ``data``, from offset to offset."""
    from veilmark.functions.text import RULES

    names = list(dict.fromkeys(name for name, _ in RULES))
    if not len(data) or data.max() < 128:
        cp, rows, place = data, off, None
    else:
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        rows = np.searchsorted(place, off)
    size = len(cp)
    kind = _kinds()[cp]
    cut = np.zeros(size + 1, bool)  # where a piece begins whatever is before it
    cut[rows] = True
    blank = kind == 0
    spans: list[tuple[int, int, int]] = []
    found = _candidates(cp, cut)
    if len(found):
        solid = ~blank
        first = solid.copy()
        first[1:] &= blank[:-1] | cut[1:-1]
        first = np.flatnonzero(first)
        done = row = -1
        for seg in np.unique(first[np.searchsorted(first, found, "right") - 1]).tolist():
            r = int(np.searchsorted(rows, seg, "right")) - 1
            if r != row:
                row, base = r, int(rows[r])
                text = data[off[r] : off[r + 1]].tobytes().decode("utf-8")
            elif seg < done:
                continue
            got, done = _matches(text, seg - base)
            done += base
            spans += [(base + s, base + e, names.index(label)) for s, e, label in got]
        for s, e, _ in spans:
            cut[s] = cut[e] = True
    same = np.zeros(size, bool)  # goes on with the piece before
    same[1:] = (kind[1:] == kind[:-1]) & (kind[1:] != _SIGN)
    begins = ~(same & ~cut[:-1])
    token, gap = begins & ~blank, begins & blank
    start = np.flatnonzero(token)
    ends_at = ~blank
    ends_at[:-1] &= begins[1:]
    end = np.flatnonzero(ends_at) + 1
    pieces, stop = begins.copy(), (cp == ord(".")) | (cp == ord("!")) | (cp == ord("?"))
    feed = cp == 10
    for s, e, _ in spans:
        pieces[s + 1 : e] = False
        gap[s:e] = stop[s:e] = feed[s:e] = False
    # a sign that ends a sentence, or a run of blanks with a line feed, which counts at its start
    if feed.any():
        runs = np.flatnonzero(gap)
        stop[runs[np.searchsorted(runs, np.flatnonzero(feed), "right") - 1]] = True
    before = np.concatenate(([0], np.cumsum(stop)))
    piece = np.concatenate(([0], np.cumsum(pieces)))
    ends = np.searchsorted(start, rows)
    of = np.diff(ends)
    sent = before[start] - np.repeat(before[rows[:-1]], of)
    ent = piece[start + 1] - 1 - np.repeat(piece[rows[:-1]], of)
    label, k, n = np.full(len(start), -1, np.int8), np.ones(len(start), np.int64), np.ones(len(start), np.int64)
    for s, e, name in spans:
        lo, hi = np.searchsorted(start, (s, e))
        label[lo:hi], k[lo:hi], n[lo:hi] = name, np.arange(1, hi - lo + 1), hi - lo
    sizes = end - start if place is None else place[end] - place[start]
    text = strings(data[_kinds()[data] != 0 if place is None else (data >= 128) | (_kinds()[:256][data] != 0)], np.concatenate(([0], np.cumsum(sizes))))
    shift = np.repeat(rows[:-1], of)
    return Walk(ends, text, start - shift, end - shift, sent, label, ent, k, n, names)
