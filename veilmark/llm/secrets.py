"""Secret scans: fixed patterns, and weak candidates that are reported only beside their complements.

Base spans are assignments (``assign``), access key ids (``access``) and long hexadecimal runs (``hex``).  Credentials
often come in parts, none of which means much alone.  Weak candidates of three roles are looked for as well:

* ``ident``: an access identifier, ``user|username|login|account|client_id|access_key(_id)`` and a value;
* ``weak``: a secret too short or too plain for the base, ``pass|pwd|pw|key|auth|credential|private_key`` and a value;
* ``endpoint``: a URL with a host, or ``host|hostname|server|endpoint|url|dsn`` and a value.

A scope is ``SCOPE`` code points around a part, from its start backwards and from its end onwards.  The parts of a document, base spans among them (``access`` is an
identifier, ``assign`` and ``hex`` are secrets), are interval-joined within scopes: a weak identifier is reported where
a secret lies within its scope, a weak secret where an identifier does, and an endpoint where both do.  Secrets of the base
complete an identifier, base identifiers complete a secret; two weak candidates complete each other too.

The join is a running maximum over (document, stretch): each part is sent to all stretches of ``STRETCH`` code
points that its scope reaches, so no text's parts, however many, are one task's work.  All of it is DataFrame operations.
Null texts count as empty: no spans; very long texts are scanned whole, each in its row; of parts that start together each is judged on its own.  Documents with a null id take part; repeated rows keep a row each with equal spans; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.common import free_name, materialise, row_key
from veilmark.llm.spans import joined, let, matches, ranked

KINDS = ["assign", "access", "hex", "ident", "weak", "endpoint"]
SCOPE, STRETCH = 200, 4096

#: Group 2's characters come last, so a match's value ends in the longest run of them.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]+"""
#: A shorter run holds no longer match, so the least lengths may stand in these two patterns.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
_VALUE = r"""["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9@+/_.%$!#-]{3,}+"""
IDENT = r"(?<![A-Za-z0-9])(?i:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?)" + _VALUE
WEAK = r"(?<![A-Za-z0-9])(?i:pass(?:phrase|code)?|pwd|pw|auth(?:_?key)?|credentials?|private_?key|key)" + _VALUE
ENDPOINT = r"(?<![A-Za-z0-9])(?i:(?:https?|ftp|ssh|jdbc:[a-z]{1,20}+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~%:@\[\]-]{3,}+|(?:host(?:_?name)?|server|endpoint|url|dsn)" + _VALUE + ")"


def base_spans(text: Column) -> list[Column]:
    def assign(s: Column) -> Column:
        # what follows the sign, blanks and a quote is group 2
        value = F.regexp_replace(s["value"], r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?""", "")
        return F.length(value) >= 8

    return [
        F.filter(matches(text, ASSIGN), assign),
        matches(text, ACCESS, F.contains(text, F.lit("AKIA"))),
        matches(text, HEX),
    ]


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


_LINKED = "array<struct<start:int,rank:int,end:int>>"


def _candidates(text: Column) -> dict[str, Column]:
    found = [*base_spans(text), matches(text, IDENT), matches(text, WEAK), matches(text, ENDPOINT)]
    return {k: _bare(c) for k, c in zip(KINDS, found, strict=True)}


def _several(at: Callable[[str], Column] = F.col) -> Column:
    """Whether a row has weak candidates at all."""
    return F.size(at("ident")) + F.size(at("weak")) + F.size(at("endpoint")) > 0


def link(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row_key, linked) of rows (row_key, the kinds' spans): the weak candidates that complement each other, of rows that have some."""
    parts = rows.where(_several()).dropDuplicates(["row_key"]).select("row_key", F.explode(F.concat(*[ranked(F.col(k), i) for i, k in enumerate(KINDS)])).alias("s")).select("row_key", "s.*")
    # every stretch that a part's scope touches: of two parts with a gap of at most a scope, each's scope reaches the other
    first, last = (F.greatest(F.col("start") - scope, F.lit(0)) / STRETCH).cast("int"), ((F.col("end") + scope) / STRETCH).cast("int")
    parts = parts.select("*", F.explode(F.sequence(first, last)).alias("stretch"))
    # a part counts from its start on; it is judged where its scope ends, by the furthest end that has come till then
    ends = parts.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("asks")).withColumn("at", F.when(F.col("asks"), F.col("end") + scope).otherwise(F.col("start")))
    w = Window.partitionBy("row_key", "stretch").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    has = {r: F.coalesce(F.max(F.when(~F.col("asks") & F.col("rank").isin(ranks), F.col("end"))).over(w) >= F.col("start") - scope, F.lit(False)) for r, ranks in (("id", [1, 3]), ("secret", [0, 2, 4]))}
    near = ends.select("*", has["id"].alias("id"), has["secret"].alias("secret")).where("asks")
    near = near.groupBy("row_key", "start", "rank", "end").agg(F.max("id").alias("id"), F.max("secret").alias("secret"))
    ok = ((F.col("rank") == 3) & F.col("secret")) | ((F.col("rank") == 4) & F.col("id")) | ((F.col("rank") == 5) & F.col("id") & F.col("secret"))
    return near.where(ok).groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("linked"))


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, the base kinds as arrays of (start, end), and ``linked``: ``array<struct<start, rank, end>>`` of the weak
    candidates that complement each other, rank being the place in ``KINDS``."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    all_ = materialise(src.select("doc_id", row_key().alias("row_key"), *[c.alias(k) for k, c in _candidates(F.col("text")).items()]), "secrets")
    out = all_.drop("ident", "weak", "endpoint").join(link(all_, scope), "row_key", "left")
    return out.withColumn("linked", F.coalesce("linked", F.from_json(F.lit("[]"), _LINKED)))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, ``base_sha256`` and ``spans`` as the contract has them."""
    f = find(docs)
    base = F.concat(*[ranked(F.col(k), i) for i, k in enumerate(KINDS[:3])])
    return f.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.size("linked").cast("long").alias("n_linked"),
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"),
        joined(F.concat(base, F.col("linked")), KINDS).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """The documents, all their columns, with every span of ``find`` replaced by ``mark``; texts without one are as
    they were.  Where spans overlap they are replaced as one.

    Texts are changed in their rows; only those with weak candidates are joined with what the interval join says of these."""
    name = free_name(docs, "secrets")
    own = docs.withColumn(name, F.struct(row_key().alias("row_key"), *[c.alias(k) for k, c in _candidates(F.coalesce(F.col("text").cast("string"), F.lit(""))).items()]))
    own = materialise(own, "scanned")
    at = lambda k: F.col(name)[k]
    linked, none = link(own.select(f"{name}.*")).withColumnsRenamed({"linked": free_name(own, "linked"), "row_key": free_name(own, "key")}), F.from_json(F.lit("[]"), _LINKED)
    extra, key = free_name(own, "linked"), free_name(own, "key")
    both = own.where(~_several(at)).withColumn(extra, none).unionByName(
        own.where(_several(at)).join(linked, at("row_key") == F.col(key), "left").drop(key).withColumn(extra, F.coalesce(extra, none))
    )
    spans = F.array_sort(F.concat(*[at(k) for k in KINDS[:3]], _bare(F.col(extra))))
    done = lambda all_: F.aggregate(
        all_,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(
            s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))
        ).otherwise(F.struct(F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"), s["end"].alias("at"))),
        lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    text = F.when(F.size(spans) > 0, let(spans, done)).otherwise(F.col("text"))
    return both.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])
