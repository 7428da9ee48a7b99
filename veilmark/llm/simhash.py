"""SimHash near-duplicates: exact comparison of fingerprint tiles by exclusive-or and bit counts.

Each document's fingerprint takes a bit where over half of its shingles' XXH64 have it.  Equal fingerprints are
one row from then on.  Two fingerprints that differ in at most ``radius`` bits agree on at least ``blocks - radius``
of ``blocks`` blocks of bits, so every link is found among the fingerprints that share some choice of blocks.
Within such a bucket tiles are compared whole with numpy, in order of bit count, and a pair of tiles is skipped
where the counts alone differ by more than the radius.  A bucket of more than ``TILE`` rows is cut into tiles by bit
count and hash, and its tile pairs go to different tasks.  A tile comparison returns a spanning set of its links.

Null texts and texts without words have fingerprint zero and are linked like any other; documents with a null
id take part and have a row each; repeated rows keep a row each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import among, free_name, mapped, materialise, row_key
from veilmark.llm.graph import components

RADIUS, BLOCKS, SHINGLE, SEED = 4, 6, 4, 42
#: Rows of a bucket that one task compares; larger buckets are cut into tiles of about this many.
TILE = 4096
_SIDE = 512


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    buf = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.array([digest(buf[a:b], seed) for a, b in spans], "<u8")
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        set_ += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_ * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = []
        for at in range(0, b.num_rows, 500):
            fps += [fingerprint(x, k) for x in b.column(1).slice(at, 500).to_pylist()]
        yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def _star(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of positions in ``fp`` replaced by as few that connect the same: each to its class's first."""
    label = np.arange(len(fp))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(fp)))
    return fp[label[own]], fp[own]


def _tiles(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between rows of ``a`` and ``b`` (one array if ``same``), each in order of bit count."""
    both = a if same else np.concatenate((a, b))
    ca, cb = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    I, J = [], []
    for p in range(0, len(a), _SIDE):
        for q in range(p if same else 0, len(b), _SIDE):
            x, y = ca[p : p + _SIDE], cb[q : q + _SIDE]
            if y[0] - x[-1] > radius or x[0] - y[-1] > radius:
                continue
            i, j = np.nonzero(np.bitwise_count(a[p : p + _SIDE, None] ^ b[None, q : q + _SIDE]) <= radius)
            i, j = i + p, j + q
            if same:
                i, j = i[i < j], j[i < j]
            I.append(i)
            J.append(j if same else j + len(a))
            if sum(map(len, I)) > 1 << 20:  # keep only what connects
                f, g = _star(np.arange(len(both)), np.concatenate(I), np.concatenate(J))
                I, J = [f], [g]
    if not I:
        return both[:0], both[:0]
    return _star(both, np.concatenate(I), np.concatenate(J))


def _runs(key: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys; where a run has rows of sides 1 and 2, those between them only."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.concatenate((starts, [len(key)])))
    A, B = [], []
    for s, k in zip(starts[n > 32], n[n > 32], strict=True):
        f, d = fp[s : s + k], side[s : s + k]
        x, y = (f[d == 1], f[d == 2]) if (d == 2).any() else (f, f)
        f, g = _tiles(x, y, not (d == 2).any(), radius)
        A.append(f)
        B.append(g)
    left = np.repeat(n, n) - (np.arange(len(key)) - np.repeat(starts, n))  # rows to the run's end, itself included
    alive = np.flatnonzero((np.repeat(n, n) <= 32) & (left > 1))
    d = 1
    while len(alive):
        near = (np.bitwise_count(fp[alive] ^ fp[alive + d]) <= radius) & ((side[alive] != side[alive + d]) | (side[alive] == 0))
        A.append(fp[alive[near]])
        B.append(fp[alive[near] + d])
        d += 1
        alive = alive[left[alive] > d]
    empty = fp[:0]
    return np.concatenate([*A, empty]), np.concatenate([*B, empty])


def compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches of (key, side, fp) sorted by key, side and bit count: links."""
    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]

    def out(k: int) -> pa.RecordBatch:
        a, b = _runs(held[0][:k], held[1][:k], held[2][:k], radius)
        for c in range(3):
            held[c] = held[c][k:]
        return pa.record_batch([pa.array(np.minimum(a.view(np.int64), b.view(np.int64))), pa.array(np.maximum(a.view(np.int64), b.view(np.int64)))], names=["a", "b"])

    for x in batches:
        if x.num_rows:
            cols = [x.column(0).to_numpy(), x.column(1).to_numpy(), x.column(2).to_numpy().view(np.uint64)]
            held = [np.concatenate((h, c)) for h, c in zip(held, cols, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1], "left")) if (np.diff(held[0]) >= 0).all() else int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1
            if last:
                yield out(last)
    if len(held[0]):
        yield out(len(held[0]))


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b), a < b, that connect whatever distinct fingerprints ``fp`` differ in at most ``radius`` bits."""
    if not radius < blocks <= 16:
        raise ValueError("blocks: more than radius, 16 at most")
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for i, keep in enumerate(combinations(range(blocks), blocks - radius)):
        m = sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in keep)
        masks.append((i, m - (1 << 64) if m >= 1 << 63 else m))
    pop = F.bit_count("fp")
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in masks])
    rows = fps.select("fp", F.explode(keys).alias("key"))
    large = materialise(rows.groupBy("key").count().where(F.col("count") > TILE), "buckets")
    cold, hot = rows, None
    if large.head(1):
        cold = rows.join(large, "key", "left_anti")
        # tiles are named by bit count and hash; a row goes to every pair of tiles that its own can be linked with
        m = F.ceil(F.col("count") / (4 * TILE))
        hot = rows.join(large, "key").select("key", "fp", pop.alias("p"), F.pmod(F.xxhash64("fp", F.lit(1)), m).cast("int").alias("s"), m.cast("int").alias("m"))
        hot = hot.select("*", F.explode(F.sequence(F.col("p") - radius, F.col("p") + radius)).alias("p2")).select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("s2"))
        mine, other = F.struct("p", "s"), F.struct(F.col("p2").alias("p"), F.col("s2").alias("s"))
        lo, hi = F.least(mine, other), F.greatest(mine, other)
        hot = hot.select(F.xxhash64("key", lo["p"], lo["s"], hi["p"], hi["s"]).alias("key"), F.when(mine == other, 0).when(mine < other, 1).otherwise(2).cast("long").alias("side"), "fp")
    cold = cold.select("key", F.lit(0).cast("long").alias("side"), "fp")
    found = None
    for part in (cold, hot):
        if part is not None:
            part = mapped(part.repartition("key").sortWithinPartitions("key", "side", pop), compare, "a long, b long", radius=radius)
            found = part if found is None else found.unionByName(part)
    return found.where("a <> b").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links lead to."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fps = materialise(mapped(src, fingerprints, "doc_id long, fp long", k=k), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = materialise(links(distinct, radius, blocks), "links")
    comp = components(found)  # node, root
    root = F.coalesce("root", "fp")
    named = materialise(distinct.join(comp, distinct.fp == comp.node, "left").select("fp", "least", root.alias("root")), "named")
    # only classes of several fingerprints need to be gathered
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "root").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def distinct_documents(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, k: int = 5) -> DataFrame:
    """The documents, all their columns, of which each class of near-duplicates leaves the one with the smallest id.

    Documents are linked where the Jaccard similarity of their sets of ``k``-word shingles is 0.8 or more.  Fingerprints of the same shingles find the
    closest of them by tiles; whatever similar pair differs in more than ``radius`` bits is found by a prefix-filtered join of the sets
    (``jaccard``), and every pair is verified on whole sets.  Rows that share an id but not a text are documents
    of their own, and of equal rows one stays.  Rows without an id can't stand for a class and all stay."""
    from veilmark.llm import jaccard

    some = docs.where("doc_id is not null")
    row = free_name(docs, "row")

    def close(sets: DataFrame) -> DataFrame:
        least = materialise(sets.groupBy("fp").agg(F.min("set").alias("least")), "set-fingerprints")
        same = sets.select("set", "fp").join(least, "fp").where("set <> least").select(F.col("least").alias("a"), F.col("set").alias("b"))
        far = materialise(links(least.select("fp"), radius, blocks), "close").join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
        return same.unionByName(far.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))

    named = materialise(jaccard.near_duplicates(some, k, close).select(F.col("row").alias(row), "stays"), "verdicts")
    # only documents that go or that have an equal row are gathered; the texts of all others stay where they are
    looked = among(named.groupBy(row).agg((F.count("*") > 1).alias("several"), F.every("stays").alias("stays")).where("several or not stays").select(row))
    docs_by = some.withColumn(row, row_key())
    if looked is None:
        return docs
    keep = named.where("stays").select(row).distinct()
    gathered = docs_by.where(looked(F.col(row))).join(keep, row, "left_semi").dropDuplicates([row])
    return docs_by.where(~looked(F.col(row))).unionByName(gathered).drop(row).unionByName(docs.where("doc_id is null"))
