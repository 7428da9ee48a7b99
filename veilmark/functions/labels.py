"""Tags from spans, and tags under label maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions.schema import label_map, prefixes


def tag(k: Column, n: Column, label: Column, notation: str) -> Column:
    """The tag of token ``k`` (from 1) of an entity of ``n`` tokens; O where ``label`` is null."""
    first, inner, last, only = prefixes(notation)
    p = F.when(n == 1, only).when(k == 1, first).when(k == n, last).otherwise(inner)
    return F.when(label.isNull(), "O").otherwise(F.concat(p, F.lit("-"), label))


def tag_tokens(tokens: Column, spans: Column, notation: str) -> Column:
    """Tags of ``array<struct<start, end, ..>>`` tokens by the spans that contain them; spans disjoint, aligned with tokens.

    A span that begins or ends inside a token, or overlaps another, raises an error."""
    first, inner, last, only = prefixes(notation)

    def one(t: Column) -> Column:
        s = F.filter(spans, lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"]))
        ok = (F.size(s) == 1) & (s[0]["start"] <= t["start"]) & (t["end"] <= s[0]["end"])
        p = F.when((t["start"] == s[0]["start"]) & (t["end"] == s[0]["end"]), only).when(t["start"] == s[0]["start"], first).when(t["end"] == s[0]["end"], last).otherwise(inner)
        return F.when(F.size(s) == 0, "O").when(ok, F.concat(p, F.lit("-"), s[0]["label"])).otherwise(F.raise_error(F.lit("a span doesn't agree with the tokens")).cast("string"))

    return F.transform(tokens, one)


def _literal(m: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in m.items() for x in kv])


def map_tag(t: Column, notation: str, types: dict[str, str]) -> Column:
    """A tag under a projection of types; unknown tags raise an error."""
    got = F.element_at(_literal(label_map(notation, types)), t)
    return F.when(t.isNull(), F.lit(None)).otherwise(F.coalesce(got, F.raise_error(F.concat(F.lit("no mapping for the tag "), t)).cast("string")))


def map_label(label: Column, types: dict[str, str]) -> Column:
    """A span's type under a projection of types; unknown types raise an error."""
    return F.coalesce(F.element_at(_literal(types), label), F.raise_error(F.concat(F.lit("no mapping for the type "), label)).cast("string"))


def map_spans(spans: Column, types: dict[str, str]) -> Column:
    """Spans under a projection of types; those that become O stay, as O."""
    return F.transform(spans, lambda s: s.withField("label", map_label(s["label"], types)))


def label_ids(tags: list[str]) -> dict[str, int]:
    """Ids of tags, by their place in the vocabulary."""
    return {t: i for i, t in enumerate(tags)}


def tag_id(t: Column, ids: dict[str, int]) -> Column:
    """A tag's id; tags that aren't in the vocabulary raise an error."""
    got = F.element_at(F.create_map(*[F.lit(x) for kv in ids.items() for x in kv]), t)
    return F.coalesce(got, F.raise_error(F.concat(F.lit("no id for the tag "), t)).cast("int"))


def inner_ids(tags: list[str]) -> dict[int, int]:
    """For the id of a first tag that of the inner tag of its type, where there is one; others stay as they are."""
    ids = label_ids(tags)
    return {i: ids.get(f"I-{t[2:]}", i) if t[:1] == "B" and t[1:2] == "-" else i for t, i in ids.items()}


FORBIDDEN = "OTHERISSUE"


def checked(t: Column) -> Column:
    """A tag; one of the type that marks an open question of annotation raises an error."""
    return F.when(F.substring(t, 3, 1 << 20) == FORBIDDEN, F.raise_error(F.lit(f"spans of type {FORBIDDEN} are to be settled first")).cast("string")).otherwise(t)


def default_tags(tokens: Column, mode: str, notation: str, spans: Column | None = None) -> Column:
    """Tags of tokens for a mode: by their spans to train, O throughout to predict."""
    if mode == "predict":
        return F.transform(tokens, lambda _: F.lit("O"))
    if mode != "train":
        raise ValueError(f"mode: train or predict, not {mode!r}")
    if spans is None:
        raise ValueError("spans are needed to train")
    return F.transform(tag_tokens(tokens, spans, notation), checked)


def strip_prefix(t: Column) -> Column:
    """The type of a tag; O stays."""
    return F.when(t == "O", t).otherwise(F.substring(t, 3, 1 << 20))


def merge_adjacent(t: Column) -> Column:
    """Every tag of a type becomes its inner tag, so that neighbours of a type are one entity."""
    return F.when(t.contains("-"), F.concat(F.lit("I-"), F.substring(t, 3, 1 << 20))).otherwise(t)


def zip_equal(*columns: Column) -> Column:
    """``arrays_zip`` of arrays of one length; other lengths raise an error."""
    same = [F.size(c) == F.size(columns[0]) for c in columns[1:]]
    ok = same[0]
    for s in same[1:]:
        ok &= s
    return F.when(ok, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit("arrays of different lengths")))
