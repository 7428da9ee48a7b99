"""Packing documents into token windows by non-negative least squares over a length histogram.

A document's ids (and one end id) are cut into whole windows and a rest.  Of every block of documents the histogram of rests, which has at
most ``window`` bins, is matched by shallow combinations of lengths that fill a
window exactly: ``min ||A x - h||`` over ``x >= 0`` gives how often each combination should repeat.  Rounded
counts are applied to the block, and what they leave over is packed greedily, cutting where a window
ends.  The last, partly filled window of a block is cut at powers of two, so that nothing is padded.  Combinations are all pairs of lengths, and the
triples of the ``TRIPLE_LENGTHS`` commonest: what no combination takes is packed greedily, so these decide how much is cut, never what is packed.

A block is what a task tokenises one after another, of about ``BLOCK_TOKENS`` ids; nothing is shuffled, and a lost task's blocks come out the same again.

Null texts count as empty, so such a document is its end id alone; null ids are kept as they are; repeated rows
are packed each on its own; very long texts are cut into whole windows, which are never moved; equal lengths are taken in order, the last first; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import mapped
from veilmark.llm.tokens import byte_bpe

WINDOW = 1024
#: Ids held at once by a task while it packs; a block's last window is the only one not filled.
BLOCK_TOKENS = 6_000_000
#: Lengths, the commonest, from which combinations of three are formed.
TRIPLE_LENGTHS = 64

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def tokenise(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = byte_bpe(path)
    end = np.array([end_id], enc.dtype).tobytes()
    for b in batches:
        texts = b.column(1)
        for at in range(0, b.num_rows, 1000):
            ids = [enc.encode(x or "") + end for x in texts.slice(at, 1000).to_pylist()]
            n = [len(x) // enc.width for x in ids]
            yield pa.record_batch([b.column(0).slice(at, 1000).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n", "ids"])


def combinations(hist: np.ndarray, window: int) -> np.ndarray:
    """Combinations of two and three lengths that fill ``window``; a column of length 0 stands for none."""
    have = np.flatnonzero(hist[:window])
    have = have[have > 0]
    out = [(a, window - a, 0) for a in have if a <= window - a and hist[window - a]]
    top = sorted(have, key=lambda a: (-hist[a], a))[:TRIPLE_LENGTHS]
    out += {tuple(sorted((a, b, window - a - b))) for a in top for b in top if a <= b and window - a - b > 0 and hist[window - a - b]}
    return np.array(sorted(map(tuple, out)), np.int64).reshape(-1, 3)


def solve_nnls(hist: np.ndarray, pats: np.ndarray, rounds: int = 400) -> np.ndarray:
    """``x >= 0`` with small ``||A x - hist||``, by multiplicative steps; column p of A counts lengths in ``pats[p]``."""
    if not len(pats):
        return np.zeros(0)
    h = hist.astype(float).copy()
    h[0] = 0
    used = pats > 0

    def fold(v: np.ndarray) -> np.ndarray:  # A^T v
        return np.where(used, v[pats], 0).sum(1)

    x, goal = np.full(len(pats), max(h.sum() / max(1, len(pats)), 1e-9)), fold(h)
    for _ in range(rounds):
        fit = np.bincount(pats[used], np.repeat(x, used.sum(1)), len(h))
        x *= goal / np.maximum(fold(fit), 1e-12)
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and whole repeat counts that don't use any length more often than it occurs."""
    pats = combinations(hist, window)
    x = np.round(solve_nnls(hist, pats)).astype(np.int64)
    left, keep = hist.astype(np.int64).copy(), []
    for p in np.argsort(-x, kind="stable"):
        if x[p] <= 0:
            break
        lens, mult = np.unique(pats[p][pats[p] > 0], return_counts=True)
        m = min(int(x[p]), int((left[lens] // mult).min()))
        if m > 0:
            left[lens] -= m * mult
            keep.append((p, m))
    return pats[[p for p, _ in keep]].reshape(-1, 3), np.array([m for _, m in keep], np.int64)


def _pack_block(n: np.ndarray, window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset, sequence length) of the documents with ``n`` ids."""
    pats, counts = plan(np.bincount(n % window, minlength=window + 1), window)
    out: list[tuple[int, int, int, int, int, int]] = []
    seq = 0
    rest: list[list[tuple[int, int]]] = [[] for _ in range(window)]  # by length: document, start
    for i, k in enumerate(n.tolist()):
        for at in range(0, k - window + 1, window):
            out.append((i, at, window, seq, 0, window))
            seq += 1
        if k % window:
            rest[k % window].append((i, k - k % window))
    for lens, m in zip(pats.tolist(), counts.tolist(), strict=True):
        lens = [a for a in lens if a]
        for _ in range(m):
            off = 0
            for a in lens:
                i, at = rest[a].pop()
                out.append((i, at, a, seq, off, window))
                off += a
            seq += 1
    left = [(i, at, a) for a in range(window - 1, 0, -1) for i, at in rest[a]]
    total, size, off = sum(a for _, _, a in left), 0, 0
    for i, at, a in left:
        while a:
            if off == size:
                seq += size > 0
                off, size = 0, window if total >= window else 1 << (total.bit_length() - 1)
            k = min(a, size - off)
            out.append((i, at, k, seq, off, size))
            at, a, off, total = at + k, a - k, off + k, total - k
    return out


def pack_texts(batches: Iterator[pa.RecordBatch], path: str, end_id: int, window: int) -> Iterator[pa.RecordBatch]:
    """The pieces of (doc_id, text), block by block."""
    from pyspark import TaskContext

    base, width = TaskContext.get().partitionId() << 40, byte_bpe(path).width
    dtype = f"<u{width}"
    held: list[tuple[int | None, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal base, size
        n = np.array([len(x) // width for _, x in held], np.int64)
        got = _pack_block(n, window)
        crc = [zlib.crc32(np.frombuffer(held[i][1], dtype, k, at * width).astype("<u4").tobytes()) for i, at, k, *_ in got]
        c = list(zip(*got, strict=True))
        arrays = [pa.array([held[i][0] for i in c[0]], pa.int64()), c[1], c[2], crc, n[list(c[0])], np.array(c[3], np.int64) + base, c[4], c[5]]
        base += max(c[3]) + 1
        held.clear()
        size = 0
        return pa.record_batch([pa.array(x, pa.int64()) if not isinstance(x, pa.Array) else x for x in arrays], names=[f.split()[0] for f in _PIECES.split(", ")])

    for b in tokenise(batches, path, end_id):
        for d, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            held.append((d, ids))
            size += len(ids) // width
            if size >= BLOCK_TOKENS:
                yield flush()
    if held:
        yield flush()


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence (see the module's text).

    Besides the contract's columns: ``sequence_length``, the sequence's length, which is never padded.
    """
    if window & (window - 1) or not 2 <= window <= 1 << 16:
        raise ValueError("window: a power of two from 2 to 65536")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(src, pack_texts, _PIECES, path=tokenizer, end_id=end_id, window=window)
