"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its words (ASCII white space between them, A-Z in lower case) and one end.  The model codes it byte by
byte: a word's bytes and a blank, or the end's byte alone, each byte as eight binary choices from the highest bit.  A bit is
predicted from counts in five contexts: the last one, two and three bytes (hashed), all of the word so far, and all of the word so far
with the class of the byte that the word before ended in (``CLASS``: which endings a language has says much about what comes next).

* counts: each context counts zeros and ones over all training tokens.
* mixing: the predictions' logits are combined by weights that a gate selects: how often the word so far was seen, and how often with that class.
  Weights are learned online, by Newton steps whose curvature adds up as nodes go by, in slices of the vocabulary, each from the same start, and averaged over
  slices by their curvature.  A bit is predicted without its own occurrence in the two deep contexts, so these are trusted as far as they
  hold for unseen text.
* refining: an adaptive probability map corrects the mixed prediction by what was seen at that quantised prediction and gate in learning.

Every bit's two probabilities add up to one, so the model is a distribution over texts.  ``score`` is the log10
probability of the text, ``bits_per_byte`` its total bits over its coded bytes.  ``base_score`` is the unigram score of
the contract.

The probability of a word depends on the word and that class alone: a *step* is (class, word), and all learning and scoring is done once per
distinct step, weighted by how often it occurs.  Words lie in order, so the contexts of the word so far are runs of neighbours; what the
steps of a run share is worked out once.  Slices are cut by a hash of a word's first ``HEAD`` bytes, and the nodes of these bytes are worked out in a slice of
their own, so all counts are whole.  Slices depend on the vocabulary alone: however the documents are spread, their scores are the same.

Counts of the low contexts come from distinct sequences of four bytes, which grow with the alphabet and not with the corpus; the tables of the deep
ones grow with the corpus, as do the slices' number.  Documents are split into words once: the numbers of their steps in a block and the block's vocabulary, a row for each word, are written, the
vocabularies are counted, and joined with the scores.  A block's scores are written to a place of their own, from where the tasks that read its documents take them, so documents are never shuffled.

Null texts count as empty: an end alone.  A null id counts as training (its remainder is null); repeated rows are scored
and learned each on its own; very long texts are split in their row, and their words are looked up in their block's vocabulary; the order of equal
counts is that of the words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import drop_path, mapped, materialise, written

MOD, HELD_OUT = 7, 2
CLASSES, LOW, INPUTS = 8, 3, 6
HEAD = 4
#: Words of a slice, about; characters of text in a block; words of a vocabulary in a batch.
SLICE_WORDS, BLOCK_CHARS, PACK = 100_000, 24_000_000, 20_000
#: Bits of the hashed tables of one, two and three bytes.
LOW_BITS = (16, 20, 22)
#: Nodes of a step of learning, and tokens that the weights it starts from are worth.
ROUND, PRIOR = 32_768, 20.0
_APM, _LIMIT = 33, 12.0
_NONE = CLASSES - 1


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)  # letters outside ASCII and digits
    for c, group in enumerate((b"e", b"n", b"s", b"rt", b"aoiu", b"dhlmygfbcjkpqvwxz"), 1):
        out[list(group)] = c
    out[[b for b in range(128) if not chr(b).isalnum()]] = _NONE
    return out


#: Classes of last bytes; the last one is that of signs, and of no byte at all.
CLASS = _classes()


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % MOD == HELD_OUT


_WORDS = ", ".join(f"c{i} long" for i in range(CLASSES))
_BLOCKS = f"block long, doc_id long, ids binary, place int, word binary, mask int, {_WORDS}"


def split_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (doc_id, text): of each document its steps by number, and of each block the words with the number of their first step, their classes as bits, and the training
    occurrences of each class that occurs."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 24
    known: dict[bytes, int] = defaultdict(count().__next__)
    codes, ids, size = [], [], 0
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), *[pa.int64()] * CLASSES]
    names = [f.split()[0] for f in _BLOCKS.split(", ")]

    def rows(n: int, without: dict[str, np.ndarray], **columns) -> pa.RecordBatch:
        columns["block"] = np.full(n, block)
        return pa.record_batch([pa.array(columns[k], t, mask=without.get(k)) if k in columns else pa.nulls(n, t) for k, t in zip(names, kinds, strict=True)], names=names)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal block, size
        ends = np.cumsum([0, *map(len, codes)])
        word, words = np.concatenate(codes), list(known)
        last = CLASS[np.frombuffer(b"".join([w[-1:] or b" " for w in words]), np.uint8)]
        step = word * CLASSES  # before a document's first word is the end of another, or nothing: no byte in either case
        step[1:] += last[word[:-1]]
        step[0] += _NONE
        there = np.bincount(step, minlength=len(words) * CLASSES) > 0
        at = (np.cumsum(there) - 1)[step].astype("<u4")
        train = np.repeat([0.0 if held_out(d) else 1.0 for d in ids], np.diff(ends))
        n = np.bincount(step, train, len(there)).astype(np.int64).reshape(-1, CLASSES)
        there = there.reshape(-1, CLASSES)
        mask, place = np.packbits(there, 1, "little")[:, 0].astype(np.int32), np.cumsum(there.sum(1)) - there.sum(1)
        for lo in range(0, len(words), PACK):
            own = slice(lo, lo + PACK)
            counts, without = ({f"c{i}": x[own, i] for i in range(CLASSES)} for x in (n, ~there))
            yield rows(len(mask[own]), without, place=place[own], word=words[own], mask=mask[own], **counts)
        for lo in range(0, len(ids), 500):
            k = range(lo, min(lo + 500, len(ids)))
            yield rows(len(k), {}, doc_id=[ids[i] for i in k], ids=[_planes(at[ends[i] : ends[i + 1]]) for i in k])
        block += 1
        known.clear()
        known.default_factory = count().__next__
        codes.clear()
        ids.clear()
        size = 0

    for b in batches:
        for d, x in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if not ids:
                known[b""]  # the end is the empty word, and the first
            words = tokens(x)
            words.append(b"")
            codes.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            ids.append(d)
            size += len(x or "")
            if size > BLOCK_CHARS:
                yield from flush()
    if ids:
        yield from flush()


def _planes(x: np.ndarray) -> bytes:
    """All first bytes of the numbers, then all second ones and so on: what compresses well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(raw: bytes | np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(int(kind[-1]), -1).T).view(kind).ravel()


def _coded(words: list[bytes]) -> list[bytes]:
    return [w + b"\x20" if w else b"\x0a" for w in words]


def _columns(batches: Iterator[pa.RecordBatch]) -> tuple[list[bytes], np.ndarray]:
    """Words and their counts by class (nan: no such step), from batches of both."""
    words, counts = [], [np.zeros((0, CLASSES))]
    for b in batches:
        words += b.column(0).to_pylist()
        counts.append(np.stack([b.column(1 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(CLASSES)], 1))
    return words, np.concatenate(counts)


def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, c): counts of four bytes in a row, the last three before a coded byte and it, over the words' tokens."""
    held = np.zeros(0, np.int64), np.zeros(0)
    for b in batches:
        words, counts = _columns([b])
        coded = _coded(words)
        n = np.fromiter(map(len, coded), np.int64, len(coded))
        data = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
        pos = np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)
        code = data.copy()
        for k in (1, 2, 3):
            code |= np.where(pos >= k, np.roll(data, k), 0x20) << (8 * k)
        all_, c = np.concatenate((held[0], code)), np.concatenate((held[1], np.repeat(np.nansum(counts, 1), n)))
        code, at = np.unique(all_, return_inverse=True)
        held = code, np.bincount(at, c, len(code))
    some = held[1] > 0
    yield pa.record_batch([pa.array(held[0][some]), pa.array(held[1][some].astype(np.int64))], names=["code", "c"])


def _slot(ctx: np.ndarray, node: np.ndarray, order: int) -> np.ndarray:
    key = (ctx.astype(np.uint64) << np.uint64(8)) | node.astype(np.uint64)
    with np.errstate(over="ignore"):
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - LOW_BITS[order - 1])).astype(np.int64)


def _files(path: str) -> Iterator[pq.ParquetFile]:
    """The files of a written table, or of a part of it."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    for f in sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet")):
        with system.open_input_file(f) as file:
            yield pq.ParquetFile(file)


class LowOrders:
    """Logits in the contexts of the last one, two and three bytes, from a table of ``grams``."""

    def __init__(self, path: str):
        n = [np.zeros((2, 1 << b)) for b in LOW_BITS]
        for f in _files(path):
            for b in f.iter_batches(200_000, columns=["code", "c"]):
                code, c = (b.column(i).to_numpy() for i in range(2))
                byte = code & 255
                for k in range(8):
                    node, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
                    for o in range(1, LOW + 1):
                        s = _slot((code >> 8) & ((1 << (8 * o)) - 1), node, o)
                        np.add.at(n[o - 1], (bit, s), c)
        self.logit = [np.log((x[1] + 0.4) / (x[0] + 0.4)).astype(np.float32) for x in n]

    def inputs(self, ctx: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
        return [self.logit[o - 1][_slot(ctx & ((1 << (8 * o)) - 1), node, o)] for o in range(1, LOW + 1)]


_low: dict[str, LowOrders] = {}


def _low_orders(path: str) -> LowOrders:
    if path not in _low:
        _low.clear()
        _low[path] = LowOrders(path)
    return _low[path]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Numbers of runs of equal keys."""
    new = np.zeros(len(keys[0]), np.int64)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def levels(words: list[bytes], counts: np.ndarray, first: int, until: int):
    """The bits of the words' bytes from ``first`` to ``until``, one choice of one byte at a time, over words in order: for the pairs (node, class) that occur the context before, the node,
    and zeros and ones of the node and of the pair; and for the steps their number, their pair and their bit."""
    coded = _coded(words)
    n = np.fromiter(map(len, coded), np.int64, len(coded))
    start = np.cumsum(n) - n
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
    word, cls = np.nonzero(~np.isnan(counts))
    c = counts[word, cls]
    live, step = np.arange(len(words)), np.arange(len(word))
    group, back = np.zeros(len(words), np.int64), np.full(len(words), 0x202020, np.int64)
    for p in range(min(until, int(n.max()) if len(n) else 0)):
        more = n[live] > p
        live, group, back = live[more], _runs(group[more]), back[more]
        byte = data[start[live] + p]
        if p >= first:
            step = step[n[word[step]] > p]
            of = np.searchsorted(live, word[step])
            for k in range(8):
                g = _runs(group, byte >> (8 - k))
                head = np.flatnonzero(np.diff(g, prepend=-1))
                bit = (byte >> (7 - k)) & 1
                gs, cs, bs = g[of], c[step], bit[of]
                key = gs * CLASSES + cls[step]
                size = len(head) * CLASSES
                there = np.flatnonzero(np.bincount(key, minlength=size))
                m1, m = np.bincount(key, cs * bs, size)[there], np.bincount(key, cs, size)[there]
                n1, n_ = np.bincount(gs, cs * bs, len(head)), np.bincount(gs, cs, len(head))
                at = there // CLASSES
                pair = np.zeros(size, np.int64)
                pair[there] = np.arange(len(there))
                node = (1 << k) | (byte[head] >> (8 - k))
                yield back[head][at], node[at], n_[at] - n1[at], n1[at], m - m1, m1, step, pair[key], bs
        group = _runs(group, byte)
        back = ((back << 8) | byte) & 0xFFFFFF


_W_CUTS, _C_CUTS = np.array([1, 2, 4, 16, 256]), np.array([1, 4, 64])
GATES = (len(_W_CUTS) + 1) * (len(_C_CUTS) + 1)


def start_weights() -> np.ndarray:
    """By gate: the low contexts lead where the word so far is unknown, and it leads where it is known."""
    w = np.zeros((GATES, INPUTS))
    for i in range(len(_W_CUTS) + 1):
        for j in range(len(_C_CUTS) + 1):
            w[i * (len(_C_CUTS) + 1) + j] = (0.1, 0.2, 0.7, 0, 0, 0) if i == 0 else (0, 0, 0.3, 0.6, 0.1, 0) if j < 2 else (0, 0, 0, 0.5, 0.5, 0)
    return w


def _inputs(low: list[np.ndarray], n0: np.ndarray, n1: np.ndarray, m0: np.ndarray, m1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, rows), and the gate of each row."""
    x = np.stack([*low, np.log((n1 + 0.05) / (n0 + 0.05)), np.log((m1 + 0.05) / (m0 + 0.05)), np.full(len(n0), 0.3)])
    gate = np.searchsorted(_W_CUTS, n0 + n1, "right") * (len(_C_CUTS) + 1) + np.searchsorted(_C_CUTS, m0 + m1, "right")
    return np.clip(x, -_LIMIT, _LIMIT), gate


def _mixed(x: np.ndarray, gate: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(sum(x[i] * w[:, i][gate] for i in range(INPUTS)), -_LIMIT, _LIMIT)


def _cell(z: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return gate * _APM + np.rint((z + _LIMIT) * (_APM - 1) / (2 * _LIMIT)).astype(np.int64)


_PAIRS = [(i, j) for i in range(INPUTS) for j in range(i, INPUTS)]


def learn(batches: Iterator[pa.RecordBatch], path: str, first: int, until: int) -> Iterator[pa.RecordBatch]:
    """What a slice of words learns, in rows (kind, i, a): kind 0 the curvature by gate, kind 1 the same times the weights, kinds 2 and 3 the ones and all of each cell of the
    probability map."""
    words, counts = _columns(batches)
    if not words:
        return
    low_, w, seen = _low_orders(path), start_weights(), np.zeros((2, GATES * _APM))
    bend = np.tile(np.eye(INPUTS) * PRIOR, (GATES, 1, 1))
    for back, node, n0, n1, m0, m1, *_ in levels(words, counts, first, until):
        for lo in range(0, len(node), ROUND):
            s, slope = slice(lo, lo + ROUND), np.zeros((GATES, INPUTS))
            low = low_.inputs(back[s], node[s])
            for bit, often in ((1, m1[s]), (0, m0[s])):
                own = np.flatnonzero(often)
                if not len(own):
                    continue
                # without the occurrence that is predicted
                x, gate = _inputs([v[own] for v in low], *(v[s][own] - (b == bit) for v, b in ((n0, 0), (n1, 1), (m0, 0), (m1, 1))))
                z, c = _mixed(x, gate, w), often[own]
                p = 1 / (1 + np.exp(-z))
                cell = _cell(z, gate)
                seen[0] += np.bincount(cell, c * bit, GATES * _APM)
                seen[1] += np.bincount(cell, c, GATES * _APM)
                err, bent = c * (bit - p), c * np.maximum(p * (1 - p), 1e-3)
                for i in range(INPUTS):
                    slope[:, i] += np.bincount(gate, err * x[i], GATES)
                for i, j in _PAIRS:
                    more = np.bincount(gate, bent * x[i] * x[j], GATES)
                    bend[:, i, j] += more
                    bend[:, j, i] += more if i != j else 0
            w = w + np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
    parts = [bend.ravel(), (bend @ w[:, :, None]).ravel(), *seen]
    yield pa.record_batch([pa.array(np.repeat(np.arange(4), list(map(len, parts)))), pa.array(np.concatenate([np.arange(len(v)) for v in parts])), pa.array(np.concatenate(parts))], names=["kind", "i", "a"])


_SCORED = "word binary, c long, " + ", ".join(f"s{i} double" for i in range(CLASSES))


def _of_heads(words: list[bytes], path: str) -> np.ndarray:
    """Scores by class of the first ``HEAD`` bytes of words that have as many, from a table of ``score_words``; what is held is as long as the words are many."""
    head, at = np.unique(np.array([w[:HEAD].hex() for w in words], "S"), return_inverse=True)
    out, found = np.zeros((len(head), CLASSES)), np.zeros(len(head), bool)
    for f in _files(path):
        for b in f.iter_batches(100_000, columns=["word", *[f"s{i}" for i in range(CLASSES)]]):
            b = b.filter(pc.equal(pc.binary_length(b.column(0)), HEAD))
            if not b.num_rows:
                continue
            name = np.array([w.hex() for w in b.column(0).to_pylist()], "S")
            k = np.minimum(np.searchsorted(head, name), len(head) - 1)
            own = head[k] == name
            out[k[own]] = np.stack([b.column(1 + i).to_numpy(zero_copy_only=False)[own] for i in range(CLASSES)], 1)
            found[k[own]] = True
    if not found.all():
        raise ValueError("the first bytes of a word have no score: the documents changed while they were scored")
    return out[at]


def score_words(batches: Iterator[pa.RecordBatch], path: str, first: int, until: int, weights: list[float], apm: list[float], heads: str | None = None) -> Iterator[pa.RecordBatch]:
    """log10 probabilities of a slice of words, bytes ``first`` to ``until``, by class (nan: no such step), with their training occurrences; ``heads``: with those of the bytes before
    ``first``, from that table."""
    words, counts = _columns(batches)
    if not words:
        return
    low_, w = _low_orders(path), np.array(weights).reshape(GATES, INPUTS)
    ones, all_ = np.array(apm).reshape(2, -1)
    word, cls = np.nonzero(~np.isnan(counts))
    out = np.zeros(len(word))
    for back, node, n0, n1, m0, m1, step, pair, bit in levels(words, counts, first, until):
        p = np.zeros(len(node))
        for lo in range(0, len(node), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            x, gate = _inputs(low_.inputs(back[s], node[s]), n0[s], n1[s], m0[s], m1[s])
            z = _mixed(x, gate, w)
            q = 1 / (1 + np.exp(-z))
            c = _cell(z, gate)
            p[s] = (q + (ones[c] + 32 * q) / (all_[c] + 32)) / 2
        p = np.clip(p, 1e-6, 1 - 1e-6)
        out[step] += np.where(bit > 0, np.log10(p)[pair], np.log10(1 - p)[pair])
    grid = np.full(counts.shape, np.nan)
    grid[word, cls] = out
    if heads:
        grid += _of_heads(words, heads)
    known = np.nansum(counts, 1).astype(np.int64)
    for lo in range(0, len(words), 10_000):
        s = slice(lo, lo + 10_000)
        yield pa.record_batch([pa.array(words[s], pa.binary()), pa.array(known[s]), *[pa.array(grid[s, i]) for i in range(CLASSES)]], names=[f.split()[0] for f in _SCORED.split(", ")])


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _packed(place: np.ndarray, steps: np.ndarray, c: np.ndarray, size: np.ndarray, s: np.ndarray) -> bytes:
    """The numbers of rows and scores, the scores, and all bytes of the others by their significance, compressed; places as differences."""
    small = [_planes(x.astype(k)) for x, k in ((np.diff(place, prepend=0), "<u4"), (steps, "<u1"), (c, "<i8"), (size, "<u4"))]
    return np.array([len(place), len(s)], "<u4").tobytes() + s.astype("<f8").tobytes() + zlib.compress(b"".join(small), 1)


def pack_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, ids, packed): the rows (block, place, c, s, size) of each block in order of place, as columns of numbers: what the scores leave is small, and compressed.  With a column
    of bits after these, s is the scores of a word by class, from its first step's place on, and the bits tell which occur in the block."""
    held: list[tuple[np.ndarray, ...]] = []

    def columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        block, place, c, size = (b.column(i).to_numpy() for i in (0, 1, 2, 4))
        if b.num_columns == 5:
            return block, place, c, size, b.column(3).to_numpy().reshape(-1, 1), np.ones((len(c), 1), bool)
        there = np.unpackbits(b.column(5).to_numpy().astype(np.uint8).reshape(-1, 1), 1, CLASSES, "little").astype(bool)
        return block, place, c, size, b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, CLASSES), there

    def flush() -> pa.RecordBatch:
        t = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        order = np.lexsort((t[1], t[0]))
        blocks, place, c, size, s, there = (x[order] for x in t)
        s, steps = s[there], there.sum(1)
        if np.isnan(s).any():
            raise ValueError("a step has no score: the documents changed while they were scored")
        cuts = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1)).tolist()
        ends = np.concatenate(([0], np.cumsum(steps)))
        packed = [_packed(place[lo:hi], steps[lo:hi], c[lo:hi], size[lo:hi], s[ends[lo] : ends[hi]]) for lo, hi in zip(cuts, [*cuts[1:], len(blocks)])]
        return pa.record_batch([pa.array(blocks[cuts]), pa.nulls(len(cuts), pa.int64()), pa.nulls(len(cuts), pa.binary()), pa.array(packed, pa.binary())], names=["block", "doc_id", "ids", "packed"])

    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(columns(b))
            rows += b.num_rows
        if rows > 500_000:
            yield flush()
            rows = 0
    if held:
        yield flush()


def _unpacked(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Occurrences, scores and bytes of a block's steps, in order of their places."""
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    for x in parts:
        n, m = np.frombuffer(x, "<u4", 2).tolist()
        columns[4].append(np.frombuffer(x, "<f8", m, 8))
        small, at = np.frombuffer(zlib.decompress(memoryview(x)[8 + 8 * m :]), np.uint8), 0
        for i, k in ((0, "<u4"), (1, "<u1"), (2, "<i8"), (3, "<u4")):
            size = n * int(k[-1])
            own = _from_planes(small[at : at + size], k)
            columns[i].append(np.cumsum(own, dtype=np.int64) if i == 0 else own)
            at += size
    first, steps, c, size, s = (np.concatenate(v) for v in columns)
    steps = steps.astype(np.int64)
    place = np.repeat(first - (np.cumsum(steps) - steps), steps) + np.arange(len(s))
    order = np.argsort(place)
    if (place[order] != np.arange(len(place))).any():
        raise ValueError("a step has no score: the documents changed while they were scored")
    return np.repeat(c, steps)[order], s[order], np.repeat(size, steps)[order].astype(np.int64)


def score_documents(batches: Iterator[pa.RecordBatch], path: str, total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """The scores of documents (block, doc_id, ids), by those of their block's steps, which lie in the folder of the block."""
    block, values = None, ()
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in _SCORES.split(", ")]
    for b in batches:
        made: list[tuple] = []
        for k, d, ids in zip(*[x.to_pylist() for x in b.columns], strict=True):
            if k != block:
                c, s, size = _unpacked([x for f in _files(f"{path}/block={k}") for x in f.read(["packed"]).column(0).to_pylist()])
                block, values = k, (np.log10((c + 1) / (total + 1 * (distinct + 1))), s, size, c > 0)
            at = _from_planes(ids, "<u4")
            score = float(values[1][at].sum())
            made.append((d, held_out(d), len(at), int(values[3][at].sum()), total, float(values[0][at].sum()), score, -score / np.log10(2) / int(values[2][at].sum())))
        if made:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names)


def score(docs: DataFrame) -> DataFrame:
    """One row per document: see ``_SCORES`` and the module's text."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = materialise(mapped(src, split_words, _BLOCKS), "blocks")
    vocabulary = blocks.where("word is not null")
    by_class = [F.sum(f"c{i}").alias(f"c{i}") for i in range(CLASSES)]
    kept: list[str] = []

    def kept_at(df: DataFrame, name: str) -> DataFrame:
        kept.append(written(df, name))
        return spark.read.schema(df.schema).parquet(kept[-1])

    words = kept_at(vocabulary.groupBy("word").agg(*by_class), "words")
    counts = [f"c{i}" for i in range(CLASSES)]
    known = sum((F.coalesce(F.col(c), F.lit(0)) for c in counts), F.lit(0))
    n = words.agg(F.count("*").alias("all"), F.sum((known > 0).cast("long")).alias("v"), F.sum(known).alias("n")).first()
    total, distinct = n["n"] or 0, n["v"] or 0
    kept_at(mapped(words.select("word", *counts), grams, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")), "grams")
    codes = kept[-1]

    # the first bytes of all words as one slice, and the rest in slices of words that share theirs
    start = F.concat("word", F.lit(b" "))
    slices = max(1, -(-n["all"] // SLICE_WORDS))
    rest = words.where(F.octet_length("word") >= HEAD).select("word", *counts)
    rest = rest.repartitionById(slices, F.pmod(F.xxhash64(F.substring("word", 1, HEAD)), F.lit(slices)).cast("int")).sortWithinPartitions("word")
    # the end is a word of its own; it has no blank, and no other word begins with its byte
    cut = F.when(F.octet_length("word") == 0, F.col("word")).otherwise(F.substring(start, 1, HEAD))
    first = words.groupBy(cut.alias("word")).agg(*[F.sum(c).alias(c) for c in counts])
    first = kept_at(first, "heads").repartition(1).sortWithinPartitions("word")
    parts = ((first, 0, HEAD), (rest, HEAD, 1 << 30))

    learned = None
    for part, lo, hi in parts:
        own = mapped(part, learn, "kind long, i long, a double", path=codes, first=lo, until=hi)
        learned = own if learned is None else learned.unionByName(own)
    # GATES * (INPUTS * INPUTS + INPUTS + 2 * _APM) rows at most, whatever the size of the corpus
    sums = learned.groupBy("kind", "i").agg(F.sum("a").alias("a")).collect()
    parts_ = [np.zeros(GATES * INPUTS * INPUTS), np.zeros(GATES * INPUTS), np.zeros(GATES * _APM), np.zeros(GATES * _APM)]
    for r in sums:
        parts_[r["kind"]][r["i"]] = r["a"]
    bend = parts_[0].reshape(GATES, INPUTS, INPUTS) + np.eye(INPUTS)
    weights = np.linalg.solve(bend, (parts_[1].reshape(GATES, INPUTS) + start_weights())[:, :, None])[:, :, 0]
    # sums of doubles depend on their order in the last places
    how = {"path": codes, "weights": np.round(weights, 6).ravel().tolist(), "apm": np.round(np.concatenate(parts_[2:])).tolist()}
    heads = kept_at(mapped(first, score_words, _SCORED, first=0, until=HEAD, **how), "head-scores")
    tails = kept_at(mapped(rest, score_words, _SCORED, first=HEAD, until=1 << 30, heads=kept[-1], **how), "tail-scores")
    for path in kept[:-2]:
        drop_path(spark, path)
    # a word of fewer bytes is a head with its blank, or the end
    short = heads.where((F.octet_length("word") == 0) | (F.substring("word", -1, 1) == F.lit(b" ")))
    short = short.withColumn("word", F.substring("word", F.lit(1), F.greatest(F.octet_length("word") - 1, F.lit(0))))
    by_word = short.unionByName(tails).select("word", "c", F.array(*[f"s{i}" for i in range(CLASSES)]).alias("s"))
    size = F.when(F.octet_length("word") == 0, 1).otherwise(F.octet_length("word") + 1).cast("long")
    named = vocabulary.select("block", "place", "word", "mask").join(by_word, "word").select("block", "place", "c", "s", size.alias("size"), "mask")
    vocab = mapped(named, pack_scores, "block long, doc_id long, ids binary, packed binary").select("block", "packed")
    packed = written(vocab.repartition("block"), "packed", "block")
    for path in kept[-2:]:
        drop_path(spark, path)
    texts = blocks.where("word is null").select("block", "doc_id", "ids")
    return mapped(texts, score_documents, _SCORES, path=packed, total=int(total), distinct=int(distinct))
