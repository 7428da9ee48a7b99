"""Connected components of an edge table by alternating large and small stars, and the pairs that a similarity join has to look at to find them.

Few links are one task's; else every round ends in a written table.  A join by shared keys needn't look at all pairs of a key that many members share: ``stars`` pairs each
member with the first one that it shares a key with, and ``crossing`` gives the pairs that share a key but no class yet, by
representatives or whole.  Whatever pairs are left out lie within a class, so the classes are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import alone, mapped, materialise

#: Links up to which one task finds the components.
FEW = 500_000


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the components of all links (u, v) at once."""
    held = pa.Table.from_batches(held) if (held := list(batches)) else None
    if held is None or not held.num_rows:
        return
    nodes = pc.unique(pa.chunked_array([*held.column(0).chunks, *held.column(1).chunks]))
    nodes = nodes.take(pc.sort_indices(nodes))
    u, v = (pc.index_in(c, value_set=nodes).to_numpy().astype(np.int64) for c in held.columns)
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[u], root[v])
        before = root.copy()
        for end in (root[u], root[v], u, v):
            np.minimum.at(root, end, least)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    yield pa.record_batch([nodes, nodes.take(pa.array(root))], names=["node", "root"])


def _least(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the smallest node of its component.

    Up to ``FEW`` different links are one task's; beyond, rounds grow with the logarithm of the number of nodes; nothing is gathered by node, as minima are aggregated
    before the shuffle and the joins back are on the edges, where skewed nodes are split.  Self-links and
    repeated links do no harm; no links give no rows.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if e.count() <= FEW:
        kind = e.schema["u"].dataType.simpleString()
        return materialise(mapped(e.coalesce(1), united, f"node {kind}, root {kind}"), "components")
    before = None
    while True:
        # large star: every larger neighbour of u joins u's smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours join the smallest of them
        least = _least(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def stars(members: DataFrame, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs (a, b), a < b: every member of (key, id, info) with the least one of its keys' least that ``keep`` (of both infos) allows."""
    least = members.groupBy("key").agg(F.min(F.struct("id", "info")).alias("m"))
    near = members.join(least, "key").where(F.col("id") != F.col("m.id")).where(keep(F.col("info"), F.col("m.info")))
    return near.groupBy("id").agg(F.min("m.id").alias("m")).select(F.col("m").alias("a"), F.col("id").alias("b"))


def crossing(members: DataFrame, classes: DataFrame, keep: Callable[[Column, Column], Column], whole: bool) -> DataFrame:
    """Pairs (a, b) of members (key, id, info) that share a key but no class of ``classes`` (node, root); unless ``whole``, of one class its
    least member of the key stands for all.  Keys whose members are all of one class end before any pair is formed."""
    named = materialise(members.join(classes, F.col("id") == F.col("node"), "left").select("key", "id", "info", F.coalesce("root", "id").alias("root")), "members")
    per = named.groupBy("key", "root").agg(F.min(F.struct("id", "info")).alias("rep"))
    several = per.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    other = materialise(per.join(several, "key", "left_semi").select("key", F.col("root").alias("other"), "rep"), "key-classes")
    meet = named.join(other, "key").where("root < other")
    if whole:
        far = named.select("key", F.col("root").alias("other"), F.struct("id", "info").alias("far"))
        meet = meet.drop("rep").join(far, ["key", "other"]).withColumnRenamed("far", "rep")
    pairs = meet.where(keep(F.col("info"), F.col("rep.info"))).select(F.least("id", "rep.id").alias("a"), F.greatest("id", "rep.id").alias("b"))
    return pairs.distinct()


def classes_of(members: DataFrame, first: DataFrame | None, keep: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that connect what the links between members that share a key connect.

    ``first``: pairs to look at besides.  ``verify``: the pairs of (a, b) that are links, with whatever columns it adds."""
    members = materialise(members.distinct(), "sharing")
    some = bool(members.head(1))
    pairs = stars(members, keep) if some or first is None else first
    seen = materialise((pairs.unionByName(first) if some and first is not None else pairs).where("a <> b").distinct(), "pairs")
    links = alone(lambda: verify(seen), "links")
    if not some:
        return links
    for whole in (False, True):
        classes = components(links.select("a", "b"))
        more = alone(lambda: crossing(members, classes, keep, whole).join(seen, ["a", "b"], "left_anti"), "pairs")  # noqa: B023
        if more.head(1):
            links = links.unionByName(alone(lambda: verify(more), "links"))  # noqa: B023
            seen = seen.unionByName(more)
    return links
