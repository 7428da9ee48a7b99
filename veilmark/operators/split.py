"""Splits of a corpus by group, and label distributions."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")


def distribution(spans: DataFrame, group: str) -> DataFrame:
    """(group, label, n) of rows (group, label); groups whose labels are all null keep a row with n = 0."""
    return spans.groupBy(group, "label").agg(F.count("label").alias("n"))


def percentages(spans: DataFrame) -> DataFrame:
    """(label, n, percent)."""
    n = spans.where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    # one row per label by now
    return n.select("label", "n", (100 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("percent"))


def targets(total: int, weights: dict[str, float]) -> dict[str, int]:
    """Groups per split, cut to whole numbers."""
    return {s: int(w * total / 100) for s, w in weights.items()}


def bucket(group: Column, weights: dict[str, int]) -> Column:
    """The split of a group, by a hash of its name: the same whatever else is in the corpus, and in whatever order."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights: at least one above 0")
    # four hexadecimal digits of md5, as any engine has them
    h = F.conv(F.substring(F.md5(group), 1, 4), 16, 10).cast("long") % total
    out, at = F.lit(None).cast("string"), total
    for s, w in reversed(weights.items()):
        out = F.when(h < at, s).otherwise(out)
        at -= w
    return out


def report(rows: DataFrame) -> DataFrame:
    """(split, label, n, level) of (split, label): counts by both, by split and overall."""
    out = rows.groupingSets([["split", "label"], ["split"], []], "split", "label").agg(F.count("label").alias("n"), F.grouping_id().cast("long").alias("level"))
    return out


def overview(rows: DataFrame, group: str) -> DataFrame:
    """(split, notes, groups, label, n, percent, place) of (split, group, label), a row for each span and for each note without one: labels of a split by falling
    count (by name where counts are equal), with the split's notes and groups beside them; ``total`` for all splits."""
    both = rows.unionByName(rows.withColumn("split", F.lit("total")))
    size = both.groupBy("split").agg(F.countDistinct("note").alias("notes"), F.countDistinct(group).alias("groups"))
    n = both.where("label is not null").groupBy("split", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("split")  # a row for each label
    n = n.select("*", (100 * F.col("n") / F.sum("n").over(w)).alias("percent"), F.row_number().over(w.orderBy(F.desc("n"), "label")).cast("long").alias("place"))
    return size.join(n, "split", "left").select("split", "notes", "groups", "label", "n", "percent", "place")


def top_label(spans: DataFrame, group: str) -> DataFrame:
    """(group, label, n): the commonest label of each group, the first by name of equally common ones."""
    n = spans.where("label is not null").groupBy(group, "label").agg(F.count("*").alias("n"))
    best = n.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"))
    return best.select(group, "b.label", (-F.col("b.m")).alias("n"))


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in an order; fewer rows than that raise an error."""
    out = df.orderBy(order).limit(n)
    have = out.agg(F.count("*").alias("have"))
    enough = have.select(F.when(F.col("have") < n, F.raise_error(F.lit(f"fewer than {n} rows")).cast("boolean")).otherwise(F.lit(True)).alias("enough"))
    return out.join(F.broadcast(enough)).where("enough").drop("enough")  # one row


def shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """The rows in an order that depends on the seed and each row's key alone, so it's the same however the rows are spread; adds that order's ``shuffle_key``."""
    return df.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("shuffle_key", key)


def greedy(groups: list[tuple[str, dict[str, int]]], weights: dict[str, float], margin: float, seed: int = 41) -> dict[str, str]:
    """Splits drawn one group at a time, on the driver, for corpora of few groups: a draw is taken if every label of the group keeps its
    share of that split within its share of the corpus and the margin; after two refusals, or where the other weights are 0, any draw is."""
    rng = random.Random(seed)
    total: dict[str, int] = {}
    for _, c in groups:
        for k, v in c.items():
            total[k] = total.get(k, 0) + v
    everything = sum(total.values()) or 1
    have: dict[str, dict[str, int]] = {s: {} for s in weights}
    out: dict[str, str] = {}
    for g, c in groups:
        if g in out:
            continue
        open_, pick = {s: w for s, w in weights.items() if w > 0}, None
        while open_:
            pick = rng.choices(list(open_), list(open_.values()))[0]
            size = sum(have[pick].values()) + sum(c.values())
            if size == 0 or all(100 * (have[pick].get(k, 0) + v) / size <= 100 * total[k] / everything + margin for k, v in c.items()):
                break
            if len(open_) == 1:
                pick = rng.choices([s for s in weights if weights[s] > 0], [w for w in weights.values() if w > 0])[0]
                break
            del open_[pick]
        out[g] = pick
        for k, v in c.items():
            have[pick][k] = have[pick].get(k, 0) + v
    return out
