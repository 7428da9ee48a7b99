"""Line deduplication by a segment-partition edit join.

Lines that a text holds are compared across all documents.  Equal lines are linked, whatever their length.  Two different lines are linked if they are
within one single-character edit for every ``PER_CHARS`` code points of the shorter one, ``EDITS`` at most, or within one word inserted, deleted or
replaced for every ``PER_EDIT`` words of the one with fewer words: both thresholds grow with the line, and lines of fewer code points than ``PER_CHARS`` only equal each other.
Linked lines form classes; of a class the first occurrence, by document and line, stays and the others
go.  Blank lines always stay; blanks at a line's ends don't count.

The join is exact.  A line is cut into one segment more than its threshold, of even length; if a line as long or longer is within the threshold,
at least one segment of the shorter occurs in it unchanged, near its own place.  An index holds each segment's hash with its line's
length and the segment's number; each line probes, for every length that may match, the few substrings that the length
difference leaves possible.  Index and probe keys of a bucket meet as sorted arrays; within it 40 bits of a key tell it apart, and what meets by chance is verified like all else.

Word edits have keys of their own.  Lines of fewer than ``LONG`` words are cut into segments of words in the same way, so that a passage that many lines hold isn't a key.  Of m words, ``LONG`` or more,
``m // PER_EDIT`` edits leave a run of at least ``RUN`` untouched, and whatever run of ``RUN``
words two lines share, both have the smallest hash of the ``GRAM``-word grams in it among their keys: the smallest of every run's.  So their number grows
with the line's words only.  Of so many words that any character edits within the threshold are word edits within theirs, a line has keys of words alone.  Lines have marks, bits that a word
edit changes two of and a character edit three at most (``word_marks``): lines whose sizes or marks differ by more than the edits allow are no candidates.  Candidates are verified on
their whole lines by a bit-parallel edit distance, banded by the threshold: it stops where no cell of the band can come back under it.

Equal lines are one line throughout, by a 128-bit hash; for verification only lines that pass a filter of the candidates' ids, of fixed size, are moved.  Keys are spread over buckets by hash, the number of
which grows with the number of lines.  A key that more than ``HOT`` lines share (templates) is hot.  If sizes and marks leave few of its pairs, these are candidates; else such lines are paired with the key's first one and with the lines beside them
in order of text, and then only with lines of the key that this leaves in another class (see ``graph``), so what is formed grows with the lines and not with their pairs, and no link between classes is lost.
A run's hot key is first divided by number of words, in overlapping cells, as lines of different ones can't be linked.
Keys that are hot within a task's own lines go to buckets of no one, so no task holds all lines of one key; so do frequent lines, when the occurrences of equal lines meet in buckets.

Null texts stay null and have no lines; documents with a null id take part (they come first); repeated rows are documents of their
own: the row that sorts first keeps its lines, and so does every row equal to it in id and text; of ties the smaller row hash is first; very long texts are split into lines
and never held but as the batch they come in; an empty table gives no rows; other columns are kept by ``dedup`` and ignored by ``report``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import among, free_name, mapped, materialise, row_key
from veilmark.llm.graph import classes_of, components

EDITS, PER_CHARS = 2, 32
#: Lines that share a key from which on they aren't paired with each other at once; lines of a task whose keys were made already and are remembered.
HOT, SEEN = 32, 200_000
#: Words for each word edit; words of a line from which on its keys are runs; the untouched run that the edits leave then (57 words in four parts, at worst), and words of a gram in it.
PER_EDIT, LONG, RUN, GRAM = 20, 60, 15, 9
#: Growth of the sizes that a cell of a hot run key holds: more than a linked line's may differ by.
CELL = 1.06
#: Keys of a bucket, about; and candidate pairs formed at once.
BUCKET_KEYS, SLICE, FLUSH = 1_000_000, 2_000_000, 300_000
#: Bits of the filter that is sent along to find candidates' lines: 1 MB, whatever the number of lines.
FILTER_BITS = 1 << 23
#: Bytes of a line's short id; bits of a key within its bucket.
SHORT, IN_BUCKET = 6, np.uint64(40)
#: Lines that a row of occurrences holds; occurrences of a bucket, about, and those made at once; how often a line is among these from which on it isn't looked at by its bucket alone.
PART, BUCKET_LINES, AT_ONCE, MANY = 50_000, 200_000, 100_000, 1_000
#: Stands for a null id: it comes first.
NO_ID = -(1 << 62)
#: Marks of a line's words that go with its runs' keys.
MARKS = 48
#: Ranges of lines in order of text, and code points of a line's start by which they are told apart.
RANGES, START = 64, 256
#: Members of a hot key up to which all its pairs are looked at by marks of the lines' words at once.
ALL_PAIRS = 4096


def allowed(n: int, edits: int = EDITS) -> int:
    """Edits that a line of n code points may be from one as long or longer."""
    return min(edits, n // PER_CHARS)


def line_id(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def segments(n: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the segments of a line of n characters; the later ones are the longer by one."""
    k = edits + 1
    short, more = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        size = short + (i >= k - more)
        out.append((at, size))
        at += size
    return out


def probes(n: int, length: int, edits: int) -> list[tuple[int, int, int]]:
    """(segment, start, size): substrings of a line of n characters that may equal a segment of one of ``length`` <= n."""
    out, gap = [], n - length
    for i, (p, size) in enumerate(segments(length, edits)):
        # from the left at most i edits lie before the segment, from the right at most edits - i after it
        lo = max(0, p - i, p + gap - (edits - i))
        hi = min(n - size, p + i, p + gap + (edits - i))
        out += [(i, s, size) for s in range(lo, hi + 1)]
    return out


_plans: dict[tuple[int, int], tuple[list, list]] = {}


def _plan(n: int, edits: int) -> tuple[list, list]:
    """What a line of n characters puts into the index, which it probes as well, and what else it probes: (seed, start, end)."""
    if (n, edits) not in _plans:
        if len(_plans) > 2_000:
            _plans.clear()
        own = [(((n << 4) | i), p, p + s) for i, (p, s) in enumerate(segments(n, allowed(n, edits)))]
        ask = [(((m << 4) | i), p, p + s) for m in range(max(PER_CHARS, n - edits), n + 1) if n - m <= allowed(m, edits) for i, p, s in probes(n, m, allowed(m, edits))]
        _plans[n, edits] = own, [x for x in ask if x not in own]
    return _plans[n, edits]


_word_plans: dict[int, tuple[list, list]] = {}


def _word_plan(n: int) -> tuple[list, list]:
    """The same for n words and word edits, as far as a line of fewer than ``LONG`` words is concerned."""
    if n not in _word_plans:
        seed = lambda m, i: (1 << 40) | (m << 8) | i
        own = [(seed(n, i), p, p + s) for i, (p, s) in enumerate(segments(n, n // PER_EDIT))] if n < LONG else []
        ask = [(seed(m, i), p, p + s) for m in range(PER_EDIT, min(n + 1, LONG)) if n - m <= m // PER_EDIT for i, p, s in probes(n, m, m // PER_EDIT)]
        _word_plans[n] = own, [x for x in ask if x not in own]
    return _word_plans[n]


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``; what both lines start and end with is cut off first."""
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    n = min(len(a), len(b))
    i = _common(a, b, n)
    a, b = a[i:], b[i:]
    n -= i
    j = _common(a[::-1], b[::-1], n)
    if j:
        a, b = a[:-j], b[:-j]
    m = len(a)
    if not m or not len(b):
        return max(m, len(b)) <= edits
    return _walk(a, b, edits)


def _common(a: str, b: str, n: int) -> int:
    """Length of the common start, by halving."""
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _walk(a: str, b: str, edits: int) -> bool:
    """Bit-parallel: bit r of level d's vector says that row r of this column can be reached with d edits; the band
    keeps rows within ``edits`` of the diagonal, so the vectors stay 2 * edits + 1 bits wide."""
    m, width = len(a), 2 * edits + 1
    keep = (1 << width) - 1
    # window bit k at column c is row c - edits + k; rows below 0 don't exist
    level = [0] * (edits + 1)
    for d in range(edits + 1):
        for r in range(d + 1):
            level[d] |= 1 << (edits + r)
    for c, ch in enumerate(b):
        # equality of b[c] with a[row] for the rows of the window at column c
        lo = c - edits
        eq = 0
        for k in range(width):
            r = lo + k
            if 0 <= r < m and a[r] == ch:
                eq |= 1 << k
        before = level
        level = []
        for d in range(edits + 1):
            # the window moves down by one: a step along the diagonal keeps its bit
            v = before[d] & eq
            if d:
                v |= before[d - 1]  # replaced
                v |= before[d - 1] >> 1  # a character of b more: the same row, one bit lower in the new window
                v |= level[d - 1] << 1  # a character of a more
            level.append(v & keep)
        if not level[-1]:
            return False
    k = m - len(b) + edits
    return 0 <= k < width and bool(level[edits] >> k & 1)


def words_within(a: list[str], b: list[str]) -> bool:
    """Whether one word edit for every ``PER_EDIT`` words of the shorter line makes ``b`` of ``a``; by diagonals, how far each edit gets on each."""
    n, m = len(a), len(b)
    edits = min(n, m) // PER_EDIT
    if not edits or abs(n - m) > edits:
        return False
    more = (Counter(a) - Counter(b)).total()
    if max(more, more - n + m) > edits:  # a word that one has more often than the other takes an edit of its own each time
        return False
    far: dict[int, int] = {}
    for e in range(edits + 1):
        before, far = far, {}
        for d in range(-e, e + 1):  # place in b less place in a
            i = max(before.get(d, -2) + 1, before.get(d + 1, -2) + 1, before.get(d - 1, -1)) if e else 0
            if i < 0 or i > n or i + d > m or i + d < 0:
                continue
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            if i == n and i + d == m:
                return True
            far[d] = i
    return False


def short_id(raw: bytes) -> int:
    return int.from_bytes(raw[:SHORT], "big")


_OCCURRENCES = "row binary, doc_id long, part long, nos binary, lines binary"


def line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, part, line numbers, ids) of the lines of (row, doc_id, text) that may go: a row for each document, and one more for each ``PART`` lines from there on."""
    for b in batches:
        for at in range(0, b.num_rows, 500):
            out: list[list] = [[], [], [], [], []]
            part = b.slice(at, 500)
            for r, d, x in zip(*[c.to_pylist() for c in part.columns], strict=True):
                lines = list(map(str.strip, (x or "").split("\n")))
                nos = [i for i, line in enumerate(lines) if line]
                for k in range(0, len(nos) or 1, PART):
                    own = nos[k : k + PART]
                    for c, v in zip(out, (r, d, k, np.array(own, "<i8").tobytes(), b"".join([line_id(lines[i]) for i in own])), strict=True):
                        c.append(v)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["row", "doc_id", "part", "nos", "lines"])


_BLOBS = "bucket long, kind int, keys binary, ids binary"
#: Kinds of packed rows: keys with lines, members of hot keys, and hot keys alone.
_COLD, _MEMBER, _MARK = 0, 1, 2


def _groups(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, sizes) of equal keys."""
    order = np.argsort(k.astype(np.uint16) if len(k) and 0 <= k.min() and k.max() < 1 << 16 else k, kind="stable")  # small numbers are sorted by their digits
    s = k[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1])))
    return order, starts, np.diff(np.concatenate((starts, [len(s)])))


def _wire(x: np.ndarray) -> bytes:
    """Numbers in as many bytes each as the largest takes; the first byte tells how many."""
    width = (int(x.max()).bit_length() + 7) // 8 or 1
    return bytes([width]) + np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unwired(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """n numbers from a place on, and the place after them."""
    width = raw[at]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(n, width)
    return out.view("<u8")[:, 0], at + 1 + n * width


def _pack(keys: np.ndarray, ids: np.ndarray, kind: int, bucket: np.ndarray) -> list[tuple]:
    order, starts, sizes = _groups(bucket)
    keys, bucket, columns = keys[order], bucket[order], ids[order].reshape(len(ids), -1).T
    return [(int(bucket[a]), kind, _wire(keys[a : a + n]), b"".join(_wire(c[a : a + n]) for c in columns)) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _unpack(keys: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and a row for each of what was packed with it."""
    k, _ = _unwired(keys, 0, (len(keys) - 1) // keys[0])
    columns, at = [], 0
    while at < len(ids):
        c, at = _unwired(ids, at, len(k))
        columns.append(c)
    return k, np.stack(columns, 1)


def _hot(same: np.ndarray, ids: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows have a key that more than ``HOT`` different lines have, or one of ``also``; which of them are the first of their key and line, and a row of each hot key."""
    hot, first = np.zeros(len(same), bool), np.zeros(len(same), bool)
    s = np.sort(same)
    often = s[HOT:][s[HOT:] == s[:-HOT]]  # by rows, of which a line may have several
    often = np.unique(often if also is None else np.concatenate((often, also)))
    at = np.flatnonzero(_in(same, often))
    if not len(at):
        return hot, first, at
    order = at[np.lexsort((ids[at], same[at]))]
    k, i = same[order], ids[order]
    key = np.ones(len(k), bool)
    key[1:] = k[1:] != k[:-1]
    new = key.copy()
    new[1:] |= i[1:] != i[:-1]
    group = np.cumsum(key) - 1
    many = np.bincount(group, new) > HOT
    if also is not None:
        many |= np.isin(k[key], also)
    hot[order], first[order] = many[group], new
    return hot, first, order[np.flatnonzero(key)[many]]


def _in(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each is one of the sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _spread(k: np.ndarray, ids: np.ndarray, bits: int, buckets: int, first: int) -> list[tuple]:
    """Packed rows of keys (whose lowest ``bits`` don't count for equality) with lines, ``ids`` being lines, or (line, what else): those hot here go as members, to any bucket, and as
    marks, to that of their key.  A key is its bucket and ``IN_BUCKET`` bits; within the bucket only these travel."""
    home = (k >> IN_BUCKET) % np.uint64(buckets)
    own = k & ((np.uint64(1) << IN_BUCKET) - np.uint64(1))
    home, k = home.astype(np.int64) + first, home << IN_BUCKET | own
    line = ids if ids.ndim == 1 else ids[:, 0]
    hot, once, heads = _hot(k >> np.uint64(bits), line)
    out = _pack(own[~hot], ids[~hot], _COLD, home[~hot])
    if len(heads):
        member = hot & once
        any_ = (line[member] % np.uint64(buckets)).astype(np.int64) + first
        out += _pack(k[member], ids[member], _MEMBER, any_) + _pack(own[heads], ids[heads], _MARK, home[heads])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


#: What ``str.split`` splits at, by code point; there is none above.
_BLANK = np.array([chr(c).isspace() for c in range(1 << 14)])
_ODD, _ODD_INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    """The powers of the odd number and of its inverse, n and more; kept for texts of usual lengths."""
    if _powers and n <= len(_powers[0]):
        return _powers
    with np.errstate(over="ignore"):
        got = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64))), dtype=np.uint64) for x in (_ODD, _ODD_INVERSE)]
    if n <= 4 * FLUSH:
        _powers[:] = got
    return got


class Hashes:
    """Hashes of parts of a sequence of numbers, from one sum over it: those of equal parts are equal, wherever they lie."""

    def __init__(self, values: np.ndarray):
        self.powers = _powers_to(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_mix(values) * self.powers[0][: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.powers[1][start]
            return _mix(h + _mix(np.asarray(seed, np.uint64) + np.uint64(0xA0761D6478BD642F)))


def _planned(plans: list[tuple[list, list]], cache: dict, sizes: np.ndarray, twice: bool) -> tuple[np.ndarray, ...]:
    """(line, seed, start, end, index) of the keys that lines with these plans have: those of the index, ``twice`` as probes as well, and the other probes."""
    held = []
    for n, (own, ask) in zip(sizes.tolist(), plans, strict=True):
        got = cache.get(n)
        if got is None:
            if len(cache) > 2_000:
                cache.clear()
            got = cache[n] = np.array([(*x, 1) for x in own] + [(*x, 0) for x in [*own * twice, *ask]], np.int64).reshape(-1, 4)
        held.append(got)
    rows = np.concatenate(held) if held else np.zeros((0, 4), np.int64)
    return np.repeat(np.arange(len(held)), list(map(len, held))), *np.ascontiguousarray(rows.T)


def _parsed(lines: list[str]) -> tuple[np.ndarray, np.ndarray, Hashes, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of lines, their places in a sum over them all, that sum, the hashes of all their words, and of each line the first of these and their number."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    base = np.cumsum(size + 1) - (size + 1)
    text = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    hashes = Hashes(text.astype(np.uint64))
    # words lie between blanks
    blank = np.ones(len(text) + 1, bool)
    low = text < len(_BLANK)
    blank[1:] = low
    blank[1:][low] = _BLANK[text[low]]
    begin, stop = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    first = np.searchsorted(begin, base)
    return size, base, hashes, hashes.of(begin, stop), first, np.diff(np.append(first, len(begin)))


def word_marks(words: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """Of each line so many bits, each telling whether an odd number of the line's words falls on it, a word's second occurrence being another word than the first.  So one word edit
    changes two of them at most, one character edit three (a blank put in or taken out: one word for two)."""
    if not len(first):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        line = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.append(first, len(words))))
        order, starts, sizes = _groups(_mix(words + _mix(line + np.uint64(_ODD))))
        turn = np.empty(len(words), np.uint64)
        turn[order] = np.arange(len(words)) - np.repeat(starts, sizes)
        return np.bitwise_xor.reduceat(np.uint64(1) << _mix(words + turn * np.uint64(_ODD)) % np.uint64(bits), first)


_tables: dict[tuple[int, bool], dict] = {}
_word_tables: dict[bool, dict] = {}


def line_keys(lines: list[str], me: np.ndarray, edits: int, twice: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ids) of the segments of lines and of their words, the lowest bit telling probes from index keys, which unless ``twice`` stand for the same probes as well, and lines that words suffice for have no others; and
    (hashes, sizes, ids) of the words of lines of ``LONG`` or more."""
    size, base, hashes, words, first, n_words = _parsed(lines)
    # each character edit is two word edits at most, and changes the number of words by one at most: of this many words those links are found by words, too
    chars = np.arange(len(lines)) if twice else np.flatnonzero(n_words < 2 * edits * PER_EDIT + edits)
    line, seed, start, end, index = _planned([_plan(n, edits) for n in size[chars].tolist()], _tables.setdefault((edits, twice), {}), size[chars], twice)
    line = chars[line]
    keys, ids = [hashes.of(base[line] + start, base[line] + end, seed) & ~np.uint64(1) | (1 - index).astype(np.uint64)], [me[line]]
    at = np.flatnonzero((n_words >= PER_EDIT) & (n_words < LONG + LONG // PER_EDIT))
    line, seed, start, end, index = _planned([_word_plan(n) for n in n_words[at].tolist()], _word_tables.setdefault(twice, {}), n_words[at], twice)
    if len(line):
        of_words = Hashes(words)
        line = at[line]
        keys.append(of_words.of(first[line] + start, first[line] + end, seed) & ~np.uint64(1) | (1 - index).astype(np.uint64))
        ids.append(me[line])
    long = n_words >= LONG
    return np.concatenate(keys), np.concatenate(ids), words[np.repeat(long, n_words)], n_words[long], me[long]


def key_blobs(batches: Iterator[pa.RecordBatch], edits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed index and probe keys of the texts' lines, made of many lines at once; the first ``SEEN`` lines of a task are taken once."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True))
        return pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())], names=["bucket", "kind", "keys", "ids"])

    lines, mine, chars, old = [], [], 0, set()
    made: list[list[np.ndarray]] = [[], [], [], [], []]

    def take() -> None:
        nonlocal chars
        for x, y in zip(made, line_keys(lines, np.array(mine, np.uint64), edits, twice=False), strict=True):
            x.append(y)
        lines.clear()
        mine.clear()
        chars = 0

    def flushed(of: list[list[np.ndarray]]) -> list[np.ndarray]:
        got = [np.concatenate(x) for x in of]
        for x in of:
            x.clear()
        return got

    def segments_out() -> Iterator[pa.RecordBatch]:
        keys, ids = flushed(made[:2])
        if len(keys):
            yield batch(_spread(keys, ids, 1, buckets, 0))

    def runs_out() -> Iterator[pa.RecordBatch]:
        hashes, sizes, ids = flushed(made[2:])
        if len(sizes):
            k, i = run_keys(hashes, sizes, ids)
            yield batch(_spread(k, i, 0, buckets, buckets))

    for b in batches:
        seen = set()
        for x in b.column(0).to_pylist():
            for line in (x or "").split("\n"):
                line = line.strip()
                if len(line) < PER_CHARS:
                    continue
                raw = line_id(line)
                if raw in seen or raw in old:
                    continue
                (old if len(old) < SEEN else seen).add(raw)
                lines.append(line)
                mine.append(short_id(raw))
                chars += len(line)
                if chars > FLUSH:
                    take()
                    if sum(map(len, made[0])) > FLUSH:
                        yield from segments_out()
                    if sum(map(len, made[2])) > FLUSH:
                        yield from runs_out()
    if lines:
        take()
    if made[0]:
        yield from segments_out()
    if made[2]:
        yield from runs_out()


def run_keys(hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines, given as the hashes of all their words: of every run of ``RUN`` words the smallest hash of a gram, each once; with each the
    line's id, its number of words and ``MARKS`` marks of these."""
    h, line = np.asarray(hashes, np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    prime = np.uint64(0x9E3779B97F4A7C15)
    g = np.zeros(len(h) - GRAM + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            g = (g + h[k : k + len(g)]) * prime
            g ^= g >> np.uint64(29)
    n = len(h) - RUN + 1
    place = np.arange(n) + np.stack([g[k : k + n] for k in range(RUN - GRAM + 1)]).argmin(0)
    place = place[line[:n] == line[RUN - 1 :]]  # never goes back
    place = place[np.flatnonzero(np.diff(place, prepend=-1))]
    with np.errstate(over="ignore"):
        key = g[place] * np.uint64(0xD6E8FEB86659FD93)  # the smallest hashes would fill few buckets
    key, of = _once(key ^ (key >> np.uint64(32)), line[place])
    marks = word_marks(np.asarray(hashes, np.uint64), np.cumsum(sizes) - sizes, MARKS)
    return key, np.stack((np.asarray(ids, np.uint64)[of], np.asarray(sizes, np.uint64)[of], marks[of]), 1)


_CANDIDATES = "a long, b long, key long, runs boolean"


def candidate_pairs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b), a < b, of line ids that an index and a probe key share, or a run's key (from bucket ``buckets`` on), and the members of hot keys:
    a line, b what else is known of it, and the key.  Input sorted by bucket."""
    held: dict = {"bucket": None, _COLD: ([], []), _MARK: ([], [])}

    def rows(a: np.ndarray, b: np.ndarray, key: np.ndarray | None, runs: bool) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none if key is None else pa.array(key.view(np.int64)), pa.array(np.full(len(a), runs))], names=["a", "b", "key", "runs"])

    def members(k: np.ndarray, i: np.ndarray, runs: bool) -> pa.RecordBatch:
        return rows(i[:, 0].copy(), np.zeros(len(i), np.uint64), k if runs else k >> np.uint64(1), runs)

    def out() -> Iterator[pa.RecordBatch]:
        runs = held["bucket"] >= buckets
        bits, home = np.uint64(0 if runs else 1), np.uint64(held["bucket"] % buckets) << IN_BUCKET
        k, mark = (np.concatenate([np.zeros(0, np.uint64), *held[c][0]]) | home for c in (_COLD, _MARK))
        if not len(k):
            return
        at = _meeting(k, bits, mark)
        k, i = k[at], np.concatenate(held[_COLD][1])[at]
        hot, once, _ = _hot(k >> bits, i[:, 0], mark >> bits)
        if hot.any():
            yield members(k[hot & once], i[hot & once], runs)
        k, i = k[~hot], i[~hot]
        if runs:  # each with those that come after it in order of size, as far as the edits of the shorter allow
            order = np.lexsort((i[:, 0], i[:, 1], k))
            k, i = k[order], i[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1]).any(1)
            k, i = k[new], i[new]
            ii = qi = i[:, 0]
            size, marks = i[:, 1].astype(np.int64), i[:, 2]
            room = size // PER_EDIT
            key = np.cumsum(np.concatenate((np.zeros(min(1, len(k)), np.int64), k[1:] != k[:-1]))) << 32
            lo, end = np.arange(1, len(k) + 1), np.searchsorted(key | size, key | (size + room), "right")
        else:
            index = k & np.uint64(1) == 0
            k = k >> np.uint64(1)
            ik, ii = _once(k[index], i[index, 0])
            qk, qi = _once(k, i[:, 0])
            lo, end = np.searchsorted(ik, qk, "left"), np.searchsorted(ik, qk, "right")
        n = end - lo
        at = np.flatnonzero(n > 0)
        lo, n, qi = lo[at], n[at], qi[at]
        ends = np.cumsum(n)
        start = 0
        while start < (ends[-1] if len(ends) else 0):
            # slices of bounded size, even inside one probe's matches
            stop = min(start + SLICE, int(ends[-1]))
            flat = np.arange(start, stop)
            q = np.searchsorted(ends, flat, "right") if start or stop < ends[-1] else np.repeat(np.arange(len(n)), n)
            j = lo[q] + flat - (ends[q] - n[q])
            if runs:
                x = at[q]
                ok = np.flatnonzero(np.bitwise_count(marks[x] ^ marks[j]) <= 2 * room[x])
                q, j = q[ok], j[ok]
            a, b = np.minimum(qi[q], ii[j]), np.maximum(qi[q], ii[j])
            ok = a != b
            a, b = _once(a[ok], b[ok])
            yield rows(a, b, None, runs)
            start = stop

    for x in batches:
        for bucket, kind, keys, ids in zip(*[c.to_pylist() for c in x.columns], strict=True):
            if bucket != held["bucket"] and held["bucket"] is not None:
                yield from out()
                for c in (_COLD, _MARK):
                    held[c] = ([], [])
            held["bucket"] = bucket
            keys, ids = _unpack(keys, ids)
            if kind == _MEMBER:
                yield members(keys, ids, bucket >= buckets)
            else:
                held[kind][0].append(keys)
                held[kind][1].append(ids)
    if held["bucket"] is not None:
        yield from out()


def _meeting(k: np.ndarray, bits: np.uint64, mark: np.ndarray) -> np.ndarray:
    """Where keys are that meet another one, of which with ``bits`` one is of the index, and those that are marked."""
    order = np.argsort(k)
    s = k[order]
    same = s >> bits
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), same[1:] != same[:-1])))
    n = np.diff(np.append(starts, len(s)))
    ok = n > 1
    if bits:
        ok &= s[starts] & np.uint64(1) == 0
    if len(mark):
        ok |= np.isin(same[starts], mark >> bits)
    return order[np.repeat(ok, n)]


def _once(k: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by key and id, without repeats."""
    order = np.argsort(k)
    k, i = k[order], i[order]
    tied = np.zeros(len(k), bool)
    tied[1:] = k[1:] == k[:-1]
    tied[:-1] |= tied[1:]
    at = np.flatnonzero(tied)
    i[at] = i[at][np.lexsort((i[at], k[at]))]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
    return k[new], i[new]


_LINES = "short long, line binary, words string, n long, m long, marks long"


def wanted_lines(batches: Iterator[pa.RecordBatch], bits: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    """(short id, id, line, code points, words, 64 marks of its words) of the texts' lines that pass the filter, once per batch."""
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for k, x in bits.items():
        held[k << 12 : (k << 12) + len(x)] = np.frombuffer(x, np.uint8)
    for b in batches:
        lines = [line for x in b.column(0).to_pylist() for line in map(str.strip, (x or "").split("\n")) if len(line) >= PER_CHARS]
        raw = list(map(line_id, lines))
        short = np.frombuffer(b"".join(raw), ">u8")[::2] >> np.uint64(64 - 8 * SHORT)
        slot = (short % np.uint64(FILTER_BITS)).astype(np.int64)
        at = np.flatnonzero(held[slot >> 3] >> (slot & 7) & 1).tolist()
        seen = {raw[i]: lines[i] for i in at}
        size, _, _, words, first, n_words = _parsed(list(seen.values()))
        marks = word_marks(words, first, 64).view(np.int64)
        shorts = pa.array([short_id(k) for k in seen], pa.int64())
        yield pa.record_batch([shorts, pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.string()), pa.array(size), pa.array(n_words.astype(np.int64)), pa.array(marks)], names=["short", "line", "words", "n", "m", "marks"])


_SETTLED = "a long, b long, key long, runs boolean, n long, m long, marks long"


def settle(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    """Hot keys' members (key, id, runs, n, m, marks), sorted by key: pairs (a, b) of those whose sizes and marks leave a link possible; the members as they came, with
    a the id and b null, of keys that have more than ``ALL_PAIRS`` members or ``HOT`` such pairs for each of them."""
    names = ["a", "b", "key", "runs", "n", "m", "marks"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 3]

    def back(part: pa.RecordBatch) -> pa.RecordBatch:
        c = dict(zip(part.schema.names, part.columns, strict=True)) | {"b": pa.nulls(part.num_rows, pa.int64())}
        return pa.record_batch([c["id" if k == "a" else k] for k in names], names=names)

    def pairs(part: pa.RecordBatch) -> pa.RecordBatch | None:
        i, n, m, marks = (part.column(part.schema.get_field_index(k)).to_numpy() for k in ("id", "n", "m", "marks"))
        marks, found, many = marks.view(np.uint64), [], HOT * len(i)
        chars, words = np.minimum(edits, n // PER_CHARS), m // PER_EDIT
        for lo in range(0, len(i), 256):
            x = slice(lo, lo + 256)
            apart = np.bitwise_count(marks[x, None] ^ marks[None, lo:])
            few = np.minimum(chars[x, None], chars[None, lo:])
            ok = (np.abs(n[x, None] - n[None, lo:]) <= few) & (apart <= 3 * few)
            few = np.minimum(words[x, None], words[None, lo:])
            ok |= (np.abs(m[x, None] - m[None, lo:]) <= few) & (apart <= 2 * few)
            p, q = np.nonzero(np.triu(ok, 1))
            many -= len(p)
            if many < 0:
                return None
            found.append(np.stack((i[lo + p], i[lo + q])))
        a, b = np.concatenate(found, 1)
        a, b = _once(np.minimum(a, b), np.maximum(a, b))
        return pa.record_batch([pa.array(a), pa.array(b), *[pa.nulls(len(a), k) for k in kinds[2:]]], names=names)

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        got = pairs(part) if part.num_rows <= ALL_PAIRS else None
        return back(part) if got is None else got

    rest, spilled = None, None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if rest is None else pa.concat_batches([rest, b])
        key = b.column(0).to_numpy()
        starts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
        for at, end in zip(starts, starts[1:], strict=False):
            yield back(b.slice(at, end - at)) if key[at] == spilled else one(b.slice(at, end - at))
        rest = b.slice(starts[-1])
        if rest.num_rows > ALL_PAIRS or key[-1] == spilled:
            yield back(rest)
            rest, spilled = None, key[-1]
    if rest is not None:
        yield one(rest)


def near(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether two different lines are linked."""
    return within(a, b, allowed(min(len(a), len(b)), edits)) or words_within(a.split(), b.split())


def verify(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    """The pairs of (a, b, id, line, id, line) within a threshold."""
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            mask = pa.array([near(x, y, edits) for x, y in zip(part.column(3).to_pylist(), part.column(5).to_pylist(), strict=True)], pa.bool_())
            yield pa.record_batch([part.column(i).filter(mask) for i in (0, 1, 2, 4)], names=["a", "b", "la", "lb"])


def adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b), a < b, of each id and the one after it."""
    last = np.zeros(0, np.int64)
    for b in batches:
        ids = np.concatenate((last, b.column(0).to_numpy()))
        last = ids[-1:]
        yield pa.record_batch([pa.array(np.minimum(ids[:-1], ids[1:])), pa.array(np.maximum(ids[:-1], ids[1:]))], names=["a", "b"])


def _bucket_count(n_lines: int, edits: int) -> int:
    per = sum(max(1, (edits * edits - g * g) // 2 + edits + 1) for g in range(edits + 1))
    return max(1, -(-n_lines * per // BUCKET_KEYS))


def _keep(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines' sizes and marks leave a link possible."""
    apart = F.bit_count(a["marks"].bitwiseXOR(b["marks"]))
    chars, words = F.least(F.lit(edits), F.floor(F.least(a["n"], b["n"]) / PER_CHARS)), F.floor(F.least(a["m"], b["m"]) / PER_EDIT)
    return (F.abs(a["n"] - b["n"]) <= chars) & (apart <= 3 * chars) | (F.abs(a["m"] - b["m"]) <= words) & (apart <= 2 * words)


def _by_cell(members: DataFrame) -> DataFrame:
    """Members (key, id, info) of hot keys, those of runs by key and number of words: in each of two cells, so that lines that word edits link share one."""
    cell = F.floor(F.log(F.col("info.m").cast("double")) / F.log(F.lit(CELL)))
    runs = members.where("info.runs").withColumn("cell", F.explode(F.array(cell, cell + 1)))
    return runs.select(F.xxhash64("key", "cell").alias("key"), "id", "info").unionByName(members.where("not info.runs"))


def beside(lines: DataFrame, order: Column) -> DataFrame:
    """The short ids of lines in an order of text.  Ranges are found from the texts' starts, and there are ``RANGES`` at most, as the driver is sent a sample that grows with both."""
    ranges = min(RANGES, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return lines.select("short", order.alias("o")).repartitionByRange(ranges, F.substring("o", 1, START)).sortWithinPartitions("o").select("short")


def line_links(texts: DataFrame, n_lines: int, edits: int = EDITS) -> DataFrame:
    """(la, lb) of ids of different lines: links that connect whatever lines are within the thresholds of each other."""
    if not 0 <= edits <= 8:
        raise ValueError("edits: from 0 to 8")
    buckets = max(_bucket_count(n_lines, edits), 1)
    blobs = mapped(texts, key_blobs, _BLOBS, edits=edits, buckets=buckets)
    found = materialise(mapped(blobs.repartition(min(-(-buckets // 2), 4000), "bucket").sortWithinPartitions("bucket"), candidate_pairs, _CANDIDATES, buckets=buckets), "candidates")
    # the lines that occur in a candidate: a filter of fixed size keeps most others from being shuffled
    ids = materialise(found.select(F.explode(F.when(F.col("key").isNull(), F.array("a", "b")).otherwise(F.array("a"))).alias("short")).distinct(), "candidate-lines")
    slot = F.pmod("short", F.lit(FILTER_BITS)) + 1
    maps = ids.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bits = {r["k"] - 1: bytes(r["bits"]) for r in maps.collect()}  # FILTER_BITS / 32768 rows of 4 KB at most
    lines = mapped(texts, wanted_lines, _LINES, bits=bits).join(ids, "short", "left_semi")
    lines = materialise(lines.dropDuplicates(["short", "line"]), "lines")  # where the join has put them
    # of most hot keys the lines' marks leave few pairs
    members = found.where("key is not null").select(F.xxhash64("key", "runs").alias("key"), F.col("a").alias("id"), "runs").distinct()
    members = members.join(lines.select(F.col("short").alias("id"), "n", "m", "marks"), "id").select("key", "id", "runs", "n", "m", "marks")
    settled = materialise(mapped(members.repartition("key").sortWithinPartitions("key"), settle, _SETTLED, edits=edits), "settled")
    pairs = found.where("key is null").select("a", "b").unionByName(settled.where("key is null").select("a", "b"))
    members = settled.where("key is not null").select("key", F.col("a").alias("id"), F.struct("runs", "n", "m", "marks").alias("info"))
    # lines of templates are mostly like those beside them in order of text, or of text read backwards
    may = among(members.select("id").distinct())
    hot = materialise(lines.where(may(F.col("short"))).join(members.select(F.col("id").alias("short")).distinct(), "short", "left_semi"), "hot-lines") if may else lines
    for order in (F.col("words"), F.reverse("words")) if may else ():
        pairs = pairs.unionByName(mapped(beside(hot, order), adjacent, "a long, b long"))
    tables = iter([lines])

    def verified(pairs: DataFrame) -> DataFrame:
        known, table = F.struct("n", "m", "marks"), next(tables, hot)  # after the first look all pairs are of hot keys' members
        look = table.select(F.col("short").alias("a"), known.alias("ia"))
        a = table.select(F.col("short").alias("a"), F.col("line").alias("la"), F.col("words").alias("wa"))
        b = table.select(F.col("short").alias("b"), F.col("line").alias("lb"), F.col("words").alias("wb"), known.alias("ib"))
        # sizes and marks leave few pairs, whose texts travel
        near = pairs.join(look, "a").join(b, "b").where(_keep(F.col("ia"), F.col("ib"), edits)).drop("ia", "ib")
        return mapped(near.join(a, "a").select("a", "b", "la", "wa", "lb", "wb"), verify, "a long, b long, la binary, lb binary", edits=edits)

    return classes_of(_by_cell(members), pairs, lambda a, b: _keep(a, b, edits), verified).select("la", "lb")


#: An occurrence of a line: line, row, document, line number; a line and its class; packed, by bucket of the line.
_OCC = np.dtype([("l0", "<u8"), ("l1", "<u8"), ("r0", "<u8"), ("r1", "<u8"), ("doc", "<i8"), ("no", "<i8")])
_NODE = np.dtype([("l0", "<u8"), ("l1", "<u8"), ("c0", "<u8"), ("c1", "<u8")])
_CLASS = 3
_PACKED = "bucket long, kind int, data binary"
_HITS = "root binary, line binary, row binary, doc_id long, no long, class_doc long, class_line long"


def _packed(x: np.ndarray, kind: int, bucket: np.ndarray) -> pa.RecordBatch:
    order, starts, sizes = _groups(bucket)
    x, bucket = x[order], bucket[order]
    data = [x[a : a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    return pa.record_batch([pa.array(bucket[starts].astype(np.int64)), pa.array(np.full(len(starts), kind, np.int32)), pa.array(data, pa.binary())], names=["bucket", "kind", "data"])


def spread_lines(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Occurrences by bucket of their line; those of lines that are frequent here go to any bucket, and a mark of the line to its own."""
    held, n = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        x = np.concatenate(held)
        home = x["l0"] % np.uint64(buckets)
        _, at, times = np.unique(x["l0"].astype(np.uint64), return_inverse=True, return_counts=True)
        often = times[at] > MANY
        yield _packed(x[~often], _COLD, home[~often])
        if often.any():
            x, home = x[often], home[often]
            yield _packed(x, _MEMBER, x["r0"] % np.uint64(buckets))
            _, first = np.unique(x[["l0", "l1"]], return_index=True)
            yield _packed(x[first], _MARK, home[first])

    for b in batches:
        row, doc, _, nos, lines = (c.to_pylist() for c in b.columns)
        size = np.fromiter((len(x) // 16 for x in lines), np.int64, len(lines))
        x = np.zeros(int(size.sum()), _OCC)
        line, of = (np.frombuffer(b"".join(c), ">u8").reshape(-1, 2) for c in (lines, row))
        x["l0"], x["l1"] = line[:, 0], line[:, 1]
        x["r0"], x["r1"] = (np.repeat(of[:, k], size) for k in (0, 1))
        x["doc"], x["no"] = np.repeat(np.array([NO_ID if d is None else d for d in doc], np.int64), size), np.frombuffer(b"".join(nos), "<i8")
        held.append(x)
        n += len(x)
        if n > AT_ONCE:
            yield from out()
            held, n = [], 0
    if n:
        yield from out()


def spread_classes(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(node, root) by bucket of the line."""
    for b in batches:
        if b.num_rows:
            node, root = (np.frombuffer(b"".join(c.to_pylist()), ">u8").reshape(-1, 2) for c in b.columns)
            x = np.zeros(b.num_rows, _NODE)
            x["l0"], x["l1"], x["c0"], x["c1"] = node[:, 0], node[:, 1], root[:, 0], root[:, 1]
            yield _packed(x, _CLASS, x["l0"] % np.uint64(buckets))


def line_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences (row, doc_id, no), sorted by bucket, that their class or an equal line may drop: with the class, with the line if it is frequent, or, for those that go as an equal
    line is first and the line has no class, with that first one."""
    held: dict[int, list[bytes]] = {_COLD: [], _MARK: [], _CLASS: []}

    def ids(x: np.ndarray, a: str, b: str) -> pa.Array:
        data = np.stack((x[a], x[b]), 1).astype(">u8").tobytes()
        return pa.array([data[i : i + 16] for i in range(0, len(data), 16)], pa.binary())

    def rows(x: np.ndarray, root: pa.Array | None = None, line: pa.Array | None = None, first: np.ndarray | None = None) -> pa.RecordBatch:
        none, null = pa.nulls(len(x), pa.binary()), pa.nulls(len(x), pa.int64())
        doc = [null, null] if first is None else [pa.array(first["doc"], pa.int64(), mask=first["doc"] == NO_ID), pa.array(first["no"].astype(np.int64))]
        return pa.record_batch([none if root is None else root, none if line is None else line, ids(x, "r0", "r1"), pa.array(x["doc"].astype(np.int64)), pa.array(x["no"].astype(np.int64)), *doc], names=[k.split()[0] for k in _HITS.split(", ")])

    def out() -> Iterator[pa.RecordBatch]:
        x, mark, node = (np.frombuffer(b"".join(held[k]), t) for k, t in ((_COLD, _OCC), (_MARK, _OCC), (_CLASS, _NODE)))
        # what is one of a kind is left out by the first half of its id
        l0 = x["l0"].astype(np.uint64)
        order, starts, sizes = _groups(l0)
        wanted = np.sort(np.concatenate((node["l0"], mark["l0"])).astype(np.uint64))
        x = x[order[np.repeat((sizes > 1) | _in(l0[order[starts]], wanted), sizes)]]
        if not len(x):
            return
        columns = {k: x[k].astype(np.int64 if k in ("doc", "no") else np.uint64) for k in _OCC.names}
        order = np.lexsort([columns[k] for k in ("no", "r1", "r0", "doc", "l1", "l0")])
        x, columns = x[order], {k: c[order] for k, c in columns.items()}
        head = np.ones(len(x), bool)
        head[1:] = (columns["l0"][1:] != columns["l0"][:-1]) | (columns["l1"][1:] != columns["l1"][:-1])
        starts = np.flatnonzero(head)
        of = np.cumsum(head) - 1
        at = {(a, b): i for i, (a, b) in enumerate(zip(node["l0"].tolist(), node["l1"].tolist(), strict=True))}
        marked = set(zip(mark["l0"].tolist(), mark["l1"].tolist(), strict=True))
        own = list(zip(columns["l0"][starts].tolist(), columns["l1"][starts].tolist(), strict=True))
        frequent = np.fromiter((k in marked for k in own), bool, len(own))[of]
        place = np.fromiter((at.get(k, -1) for k in own), np.int64, len(own))[of]
        if frequent.any():
            yield rows(x[frequent], line=ids(x[frequent], "l0", "l1"))
        classed = ~frequent & (place >= 0)
        if classed.any():
            yield rows(x[classed], root=ids(node[place[classed]], "c0", "c1"))
        first = starts[of]
        gone = ~frequent & (place < 0) & ((columns["r0"] != columns["r0"][first]) | (columns["r1"] != columns["r1"][first]) | (columns["no"] != columns["no"][first]))
        if gone.any():
            yield rows(x[gone], first=x[first[gone]])

    last = None
    for b in batches:
        for bucket, kind, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if bucket != last and last is not None:
                yield from out()
                for k in held:
                    held[k] = []
            last = bucket
            if kind == _MEMBER:
                x = np.frombuffer(data, _OCC)
                yield rows(x, line=ids(x, "l0", "l1"))
            else:
                held[kind].append(data)
    if last is not None:
        yield from out()


def occurrences(docs: DataFrame) -> DataFrame:
    """The lines of (row, doc_id, text), see ``line_rows``; the rows with ``part`` 0 are the documents."""
    return materialise(mapped(docs.select("row", "doc_id", "text"), line_rows, _OCCURRENCES), "occurrences")


def find(docs: DataFrame, occ: DataFrame, edits: int = EDITS) -> DataFrame:
    """(row, dropped, n_class_lines): per document with a line that isn't one of a kind, the numbers of the lines that go with their classes (doc_id, line) of first
    occurrence, and how many other different lines are in its lines' classes.  ``docs``: row, doc_id, text; ``occ``: their occurrences."""
    n_lines = occ.agg(F.sum(F.octet_length("nos") / 8)).first()[0] or 0
    links = line_links(docs.select("text"), int(n_lines), edits).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    comp = materialise(components(links), "line-classes")
    buckets = max(1, -(-int(n_lines) // BUCKET_LINES))
    packed = mapped(occ, spread_lines, _PACKED, buckets=buckets).unionByName(mapped(comp.select("node", "root"), spread_classes, _PACKED, buckets=buckets))
    hits = materialise(mapped(packed.repartition(min(buckets, 4000), "bucket").sortWithinPartitions("bucket"), line_hits, _HITS), "hits")
    # of frequent lines and classes, which lie in many buckets, the first occurrence
    frequent = hits.where("line is not null").drop("root").join(comp, F.col("line") == F.col("node"), "left").withColumn("root", F.coalesce("root", "line"))
    classed = hits.where("root is not null").select("root", "row", "doc_id", "no").unionByName(frequent.select("root", "row", "doc_id", "no"))
    keep = classed.groupBy("root").agg(F.min(F.struct("doc_id", "row", "no")).alias("keep"))
    others = comp.groupBy("root").agg((F.count("*") - 1).alias("others"))
    gone = (F.col("keep.row") != F.col("row")) | (F.col("keep.no") != F.col("no"))
    hit = classed.join(keep.join(others, "root", "left"), "root").select("row", "no", gone.alias("gone"), F.nullif(F.col("keep.doc_id"), F.lit(NO_ID)).alias("class_doc"), F.col("keep.no").alias("class_line"), F.coalesce("others", F.lit(0)).cast("long").alias("others"))
    equal = hits.where("root is null and line is null").select("row", "no", F.lit(True).alias("gone"), "class_doc", "class_line", F.lit(0).cast("long").alias("others"))
    # a set: equal rows of the input share their key and have the same lines
    one = F.struct("no", "gone", "class_doc", "class_line", "others")
    per = hit.where(F.col("gone") | (F.col("others") > 0)).unionByName(equal).groupBy("row").agg(F.array_sort(F.collect_set(one)).alias("s"))
    dropped = F.transform(F.filter("s", lambda x: x["gone"]), lambda x: F.struct(x["no"].alias("no"), x["class_doc"].alias("class_doc"), x["class_line"].alias("class_line")))
    return per.select("row", dropped.alias("dropped"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["others"]).alias("n_class_lines"))


def rows_of(docs: DataFrame) -> DataFrame:
    """Documents with a key ``row`` that equal rows share."""
    return docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def report(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """One row per document: n_dropped lines, their numbers, the document and line of the class that each repeats, and how many other different lines are in the classes of its lines."""
    rows = rows_of(docs)
    occ = occurrences(rows)
    out = occ.where("part = 0").select("row", "doc_id").join(find(rows, occ, edits), "row", "left")
    none = F.from_json(F.lit("[]"), "array<struct<no:bigint,class_doc:bigint,class_line:bigint>>")
    d = F.coalesce("dropped", none)
    return out.select(
        "doc_id",
        F.size(d).cast("long").alias("n_dropped"),
        F.array_join(F.transform(d, lambda x: x["no"].cast("string")), ",").alias("dropped_lines"),
        F.array_join(F.transform(d, lambda x: F.concat(F.coalesce(x["class_doc"].cast("string"), F.lit("null")), F.lit(":"), x["class_line"].cast("string"))), ",").alias("class_of"),
        F.coalesce("n_class_lines", F.lit(0)).cast("long").alias("n_class_lines"),
    )


def dedup(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The documents, all their columns, without the lines that go; texts that lose none are as they were."""
    key, gone = free_name(docs, "key"), free_name(docs, "gone")
    rows = rows_of(docs)
    per = find(rows, occurrences(rows), edits).where(F.size("dropped") > 0).select(F.col("row").alias(key), F.transform("dropped", lambda x: x["no"]).alias(gone))
    out = docs.withColumn(key, row_key()).join(per, key, "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col(gone), i.cast("long"))), "\n")
    return out.select(*[F.when(F.col(gone).isNotNull(), kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns])
