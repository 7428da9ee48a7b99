"""Entities in tag sequences, tag violations, and notes put together from sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.labels import merge_adjacent
from veilmark.functions.schema import prefixes


def _parts(t: Column) -> tuple[Column, Column]:
    return F.substring(t, 1, 1), F.when(t.contains("-"), F.substring(t, 3, 1 << 20))


def violation(before: Column, tag: Column, notation: str) -> Column:
    """1 where a tag may not follow the one before it (null at the start), else 0."""
    first, inner, last, only = prefixes(notation)
    prev = F.coalesce(before, F.lit("O"))
    p, t = _parts(tag)
    q, u = _parts(prev)
    opens = p.isin(first, only)
    closed = q.isin("O", last, only) | (q == ("I" if notation == "BIO" else "O"))
    inside = q.isin(first, inner) & (u == t)
    if notation == "IO":
        return F.lit(0)
    if notation == "BIO":
        return F.when(tag.isNull() | (p == "O") | (p == "B"), 0).when(q.isin("B", "I") & (u == t), 0).otherwise(1)
    return F.when(tag.isNull() | (p == "O"), 0).when(opens, F.when(closed, 0).otherwise(1)).when(inside, 0).otherwise(1)


def violations(tokens: DataFrame, key: list[str], notation: str, tag: str = "tag") -> DataFrame:
    """(key, violations) of tokens (key, idx, tag)."""
    w = Window.partitionBy(*key).orderBy("idx")
    v = tokens.select(*key, violation(F.lag(tag).over(w), F.col(tag), notation).cast("long").alias("v"))
    return v.groupBy(*key).agg(F.sum("v").alias("violations"))


def _runs(tokens: DataFrame, key: list[str], opens: Column, tag: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy("idx")
    t = tokens.withColumn("type", _parts(F.col(tag))[1]).withColumn("p", _parts(F.col(tag))[0])
    t = t.withColumns({"q": F.lag("p").over(w), "u": F.lag("type").over(w)})
    return t.withColumn("run", F.sum(opens.cast("int")).over(w)).where("type is not null")


def entities(tokens: DataFrame, key: list[str], notation: str, tag: str = "tag") -> DataFrame:
    """(key, label, start, end) of the well-formed entities of tokens (key, idx, start, end, tag); ill-formed runs give none.

    A run begins at a first or only tag (IO: where the type changes).  It is an entity if all of its tags up to its last are of one type and in
    order; BIO and IO entities end where that stops, the others need their closing tag."""
    first, inner, last, only = prefixes(notation)
    new = F.coalesce(F.col("q"), F.lit("O")) == "O"
    changed = new | ~F.col("type").eqNullSafe(F.col("u"))
    if notation == "IO":
        opens = F.col("type").isNotNull() & changed
        runs = _runs(tokens, key, opens, tag)
        return runs.groupBy(*key, "run").agg(F.first("type").alias("label"), F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
    # every first, only, stray or O tag begins a run, so that an entity's run holds nothing else but its own tags
    follows = F.col("p").isin(inner, last) & F.col("q").isin(first, inner) & F.col("type").eqNullSafe(F.col("u"))
    runs = _runs(tokens, key, ~follows, tag)
    e = runs.groupBy(*key, "run").agg(F.min_by("p", "idx").alias("a"), F.max_by("p", "idx").alias("z"), F.first("type").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"))
    if notation == "BIO":
        return e.where(F.col("a") == "B").drop("run", "a", "z")
    return e.where(((F.col("a") == first) & (F.col("z") == last)) | (F.col("a") == only)).drop("run", "a", "z")


def lenient_entities(tokens: DataFrame, key: list[str], tag: str = "tag") -> DataFrame:
    """The same with every run of a type: an entity also begins at a tag that isn't first, and ends where its type does."""
    opens = F.col("p").isin("B", "S", "U") | F.col("q").isin("E", "L", "S", "U") | (F.coalesce(F.col("q"), F.lit("O")) == "O") | ~F.col("type").eqNullSafe(F.col("u"))
    runs = _runs(tokens, key, opens, tag)
    return runs.groupBy(*key, "run").agg(F.first("type").alias("label"), F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def relax(tokens: DataFrame, tag: str = "tag") -> DataFrame:
    """Tags that merge neighbours of one type."""
    return tokens.withColumn(tag, merge_adjacent(F.col(tag)))


def absorb_signs(tokens: DataFrame, key: list[str], tag: str = "tag", token: str = "token") -> DataFrame:
    """``relax``, and O tokens of signs alone between two tokens of one type take that type."""
    # both ways a frame that only grows: one that shrinks from the front is evaluated anew from every row
    w, back = (Window.partitionBy(*key).orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in ("idx", F.desc("idx")))
    t = relax(tokens, tag)
    soft = (F.col(tag) == "O") & F.col(token).rlike(r"^[^\p{L}\p{N}]+$")
    hard = F.when(~soft, F.col(tag))
    t = t.withColumns({"back": F.last(hard, ignorenulls=True).over(w), "ahead": F.last(hard, ignorenulls=True).over(back), "soft": soft})
    return t.withColumn(tag, F.when(F.col("soft") & (F.col("back") == F.col("ahead")), F.col("back")).otherwise(F.col(tag))).drop("back", "ahead", "soft")


def gather_notes(sentences: DataFrame, notes: DataFrame) -> DataFrame:
    """(note_id, tokens, labels, predictions) of sentence rows (note_id, start, tokens, labels, predictions), in order of start.

    A note without sentences, sentences of a note that isn't listed and notes listed twice raise an error."""
    parts = sentences.groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("start", "tokens", "labels", "predictions"))).alias("s"))
    out = notes.groupBy("note_id").agg(F.count("*").alias("listed")).join(parts, "note_id", "full")
    ok = (F.col("listed") == 1) & F.col("s").isNotNull()
    out = out.withColumn("s", F.when(ok, F.col("s")).otherwise(F.raise_error(F.concat(F.lit("notes and sentences don't agree at "), F.col("note_id")))))
    return out.select("note_id", *[F.flatten(F.col("s")[c]).alias(c) for c in ("tokens", "labels", "predictions")])
