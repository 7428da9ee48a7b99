"""Near-duplicates by the Jaccard similarity of their sets of word shingles: an exact prefix-filtered set join.

A document is the set of its ``SHINGLE``-word shingles (XXH64; words as in ``simhash``; a shorter text is one shingle).  Two documents are
linked where the Jaccard similarity of their sets is at least ``NUM / DEN``.  Equal sets are one row from then on.

The join is exact.  Every set is put in one order that all sets share, and of n shingles the first n - ceil(n * NUM / DEN) + 1 are its
keys: two sets that are similar enough share a key.  At their first common key the sizes and what is left of both sets bound
the similarity, so most other pairs end there.  Sets have marks, a bit for each shingle or so, of which every shingle that only one of two sets has changes one
(``set_marks``): pairs whose marks differ in more bits than the similarity allows end next, and the few that are left are verified on their whole sets.

Shingles that a sample finds in several documents come last in the order, the more frequent the later, so that boilerplate isn't a key. The
order decides how many pairs are looked at and never which are found, so the sample and the table of frequent shingles have fixed sizes.
Of many sets that share a key, each is compared with one first; only what that leaves in different classes is compared further (see ``graph``).

Null texts and texts without words are equal, empty sets; rows that share an id count as one document; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.common import among, drop_path, mapped, materialise, row_key, written
from veilmark.llm.graph import classes_of, components
from veilmark.llm.simhash import majority

SHINGLE, NUM, DEN, SEED = 5, 4, 5, 42
#: Documents of the sample, about, and frequent shingles that are told apart.
SAMPLE, FREQUENT = 20_000, 50_000


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    buf = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.unique(np.array([digest(buf[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def set_marks(s: np.ndarray) -> bytes:
    """Parities of the shingles by their last bits: as many bits as shingles, rounded up to a power of two, 64 at least."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def marks_apart(x: bytes, y: bytes) -> int:
    """Bits that differ, the longer marks folded to the shorter: at most as many as there are shingles that one set has and the other hasn't."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, size), 0) for m in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of (a, b, shingles of a, of b, marks of a, of b) that may be similar enough."""
    for b in batches:
        n = b.column(2).to_numpy() + b.column(3).to_numpy()
        apart = np.fromiter(map(marks_apart, b.column(4).to_pylist(), b.column(5).to_pylist()), np.int64, b.num_rows)
        mask = pa.array(apart * (DEN + NUM) <= n * (DEN - NUM))
        yield pa.record_batch([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])


def sampled(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The shingles of (text)."""
    for b in batches:
        for at in range(0, b.num_rows, 500):
            sets = [shingles(x, k) for x in b.column(0).slice(at, 500).to_pylist()]
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["s"])


def keyed(batches: Iterator[pa.RecordBatch], k: int, known: bytes, often: bytes) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, set, n, fp, marks, keys) of (row, doc_id, text); fp is the set's SimHash fingerprint.  known, often: the frequent shingles, sorted, and their counts."""
    f, c = np.frombuffer(known, np.uint64), np.frombuffer(often, np.int64)
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part, ids, ns, fps, marks, keys = b.slice(at, 500), [], [], [], [], []
            for x in part.column(2).to_pylist():
                s = shingles(x, k)
                ids.append(set_id(s))
                ns.append(len(s))
                fps.append(majority(s))
                marks.append(set_marks(s))
                if len(f) and len(s):
                    i = np.minimum(np.searchsorted(f, s), len(f) - 1)
                    ordered = s[np.lexsort((s, np.where(f[i] == s, c[i], 0)))]
                else:
                    ordered = s
                keys.append(ordered[: len(s) - -(-len(s) * NUM // DEN) + 1].view(np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(marks, pa.binary()), lists], names=["row", "doc_id", "set", "n", "fp", "marks", "keys"])


def whole(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(set, all) of (text): the set itself."""
    for b in batches:
        for at in range(0, b.num_rows, 200):
            sets = [shingles(x, k) for x in b.column(0).slice(at, 200).to_pylist()]
            yield pa.record_batch([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set", "all"])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of (a, b, set of a, set of b) that are similar enough."""
    for b in batches:
        ok = []
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both * DEN >= NUM * (len(x) + len(y) - both))
        mask = pa.array(ok, pa.bool_())
        yield pa.record_batch([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])


def near_duplicates(docs: DataFrame, k: int = SHINGLE, hints: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(row, doc_id, component_id, stays), a row for each document, ``stays`` for one row of each class: component_id is the smallest doc_id that links lead to.

    ``hints``: of the table of distinct sets (set, row, least, n, fp, marks), pairs (a, b) of sets to look at first."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = src.withColumn("row", row_key())
    every = max(1, round(src.count() / SAMPLE))
    some = mapped(src.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text"), sampled, "s long", k=k)
    top = some.groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(FREQUENT).collect()
    s, c = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    order = np.argsort(s)
    keyed_sets = mapped(rows.select("row", "doc_id", "text"), keyed, "row binary, doc_id long, set long, n long, fp long, marks binary, keys array<long>", k=k, known=s[order].tobytes(), often=c[order].tobytes())
    path = written(keyed_sets, "keyed-sets")
    wide = docs.sparkSession.read.schema(keyed_sets.schema).parquet(path)
    distinct = materialise(wide.groupBy("set").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("marks").alias("marks")), "distinct")

    # keys travel once: equal sets and keys of one set alone end where the key's rows meet
    keys = wide.select(F.col("set").alias("id"), F.col("n"), F.posexplode("keys").alias("pos", "key")).select("key", "id", (F.shiftleft("n", 32) + F.col("pos")).alias("at"))
    met = keys.repartition("key").dropDuplicates(["key", "id"]).withColumn("c", F.count("*").over(Window.partitionBy("key"))).where("c > 1")
    info = F.struct(F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))
    members = materialise(met.select("key", "id", info.alias("info")), "members")
    sets = materialise(wide.select("row", "doc_id", "set"), "sets")
    drop_path(docs.sparkSession, path)

    def keep(a: Column, b: Column) -> Column:
        left = F.least(a["n"] - a["pos"], b["n"] - b["pos"])  # what the sets can share from their first common key on
        return left * (NUM + DEN) >= (a["n"] + b["n"]) * NUM

    first = hints(distinct) if hints else None

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = (distinct.select(F.col("set").alias(side), F.col("n").alias(f"n_{side}"), F.col("marks").alias(f"marks_{side}")) for side in "ab")
        near = pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "marks_a", "marks_b")
        pairs = materialise(mapped(near, possible, "a long, b long"), "possible")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
        of = materialise(distinct.select("set", "row").join(ids, "set", "left_semi").select("row"), "candidates")
        asked = among(of)
        texts = rows.limit(0) if asked is None else rows.where(asked(F.col("row"))).join(of, "row", "left_semi").dropDuplicates(["row"])
        full = mapped(texts.select("text"), whole, "set long, all binary", k=k)
        full = materialise(full, "whole-sets")
        x, y = (full.select(F.col("set").alias(side), F.col("all").alias(f"all_{side}")) for side in "ab")
        return mapped(pairs.join(x, "a").join(y, "b").select("a", "b", "all_a", "all_b"), verify, "a long, b long")

    links = classes_of(members, first, keep, verified)
    comp = components(links)  # node, root
    named = distinct.join(comp, distinct["set"] == comp.node, "left").select("set", F.coalesce("root", "set").alias("root"))
    named = materialise(sets.select("row", "doc_id", "set").join(named, "set").select("row", "doc_id", "root"), "named")
    least = named.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    return named.join(least, "root").select("row", "doc_id", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("stays"))
