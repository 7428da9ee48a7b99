"""Personal data: fixed patterns, and terms that disclose what the patterns found.

Base spans are e-mail addresses, IP addresses, payment cards (Luhn) and phone numbers.  Each distinct value found is
a protected entity, and each run of letters, in lower case, a term.  The corpus then says how much a term reveals of an entity.  With ``N``
documents, ``n(e)`` of which hold the entity, ``n(t)`` the term and ``n(e,t)`` both, the information that ``t`` gives about ``e`` is the pointwise mutual information

    PMI(e, t) = log2(n(e,t) * N / (n(t) * n(e))),   IC(e) = log2(N / n(e)),

and its share of what there is to know is PMI / IC.  Shares are shrunk by how much evidence there is: if ``m`` different texts hold both, by
``1 - 4 ** (1 - m)``, so one text, however often it is copied, shows nothing, two weigh three quarters, and more soon weigh all.  A term whose share of some entity is
``DISCLOSE`` or more is removed; one whose share lies between ``GENERALISE`` and that is generalised: it's replaced by the term that says most
about the entity below these thresholds, or by the entity's kind if there is none.  Both are spans of kind ``term``, at every place where the term
stands, in whatever document, but for places inside base spans.

All of it is DataFrame operations.  Statistics cover every row; joins are on (entity), (entity, term) and (term), whose
counts are aggregated before the shuffle; nothing is gathered per key.  Terms are looked for in all texts by way of a bitmap of fixed size, which lets through all
terms asked for and few others.  Null texts count as empty: no spans.
Documents with a null id take part; repeated rows keep a row each with equal spans, and each counts in ``n`` but not in ``m``; very long texts are scanned whole, each in its row; of an
entity's terms with equal shares the last in order generalises; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import among, materialise, row_key
from veilmark.llm.spans import joined, matches, ranked

KINDS = ["email", "ip", "card", "phone", "term"]
GENERALISE, DISCLOSE = 0.75, 0.9
_OTHER = r"[^\p{L}]+"

_LOCAL, _DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_DOMAIN}]++(?:\.[{_DOMAIN}]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int")))),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def base_spans(text: Column) -> list[Column]:
    """The spans of the first four kinds."""
    ip = F.filter(matches(text, IP), lambda s: s["value"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))

    def card(s: Column) -> Column:
        digits = F.regexp_replace(s["value"], r"[\x20-]", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)

    def phone(s: Column) -> Column:
        return F.length(F.regexp_replace(s["value"], "[^0-9]", "")).between(9, 15)

    return [
        matches(text, EMAIL, F.contains(text, F.lit("@"))),
        ip,
        F.filter(matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), card),
        F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), phone),
    ]


def _terms(text: Column) -> Column:
    """The terms of a text, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(text, _OTHER), F.lower), lambda t: t != ""))


_TERMS = "array<struct<start:int,end:int,share:double,removed:boolean,by:string>>"


def disclosing(hits: DataFrame, texts: DataFrame, total: int, disclose: float = DISCLOSE, generalise: float = GENERALISE) -> DataFrame | None:
    """(term, share, removed, by) of the terms over a threshold; None if no entity is in two different texts.

    ``hits``: (hash, values, terms) of the documents with entities; ``texts``: (text) of all."""
    each = hits.select("hash", F.explode("values").alias("v"), "terms").select("hash", "v.kind", "v.value", "terms")
    entities = materialise(each.groupBy("kind", "value").agg(F.count("*").alias("ne"), F.countDistinct("hash").alias("me")).where("me > 1"), "entities")
    pairs = each.join(entities.select("kind", "value"), ["kind", "value"]).select("hash", "kind", "value", F.explode("terms").alias("term"))
    joint = pairs.groupBy("kind", "value", "term").agg(F.count("*").alias("net"), F.countDistinct("hash").alias("m")).where("m > 1")
    joint = materialise(joint, "joint")
    asked = among(joint.select("term"), inside=True)
    if asked is None:
        return None
    counts = texts.select(F.explode(F.filter(_terms(F.col("text")), asked)).alias("term")).groupBy("term").agg(F.count("*").alias("nt"))
    n = F.lit(float(total))
    pmi, ic = F.log2(F.col("net") * n / (F.col("nt") * F.col("ne"))), F.log2(n / F.col("ne"))
    share = F.when(ic > 0, pmi / ic).otherwise(0.0) * (1 - F.pow(F.lit(4.0), 1 - F.col("m")))
    shares = materialise(joint.join(entities, ["kind", "value"]).join(counts, "term").select("kind", "value", "term", share.alias("share")), "shares")
    below = shares.where((F.col("share") > 0) & (F.col("share") < generalise)).groupBy("kind", "value").agg(F.max(F.struct("share", "term")).alias("g"))
    over = shares.where(F.col("share") >= generalise).join(below, ["kind", "value"], "left")
    by = F.coalesce("g.term", F.concat(F.lit("<"), F.col("kind"), F.lit(">")))
    best = over.groupBy("term").agg(F.max(F.struct("share", "kind", "value", by.alias("by"))).alias("x"))
    return materialise(best.select("term", "x.share", (F.col("x.share") >= disclose).alias("removed"), "x.by"), "disclosing")


def find(docs: DataFrame, disclose: float = DISCLOSE, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, row_key, the four base kinds as arrays (``email``, ``ip``, ``card``, ``phone``), and ``terms``: ``_TERMS`` (see the module's text)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src = src.select("doc_id", "text", row_key().alias("row_key"))
    text = F.col("text")
    found = src.select("doc_id", "row_key", "text", *[c.alias(k) for k, c in zip(KINDS, base_spans(text), strict=False)])
    values = F.array_distinct(F.concat(*[F.transform(F.col(k), lambda s: F.struct(F.lit(k).alias("kind"), s["value"].alias("value"))) for k in KINDS[:4]]))
    hit = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    bare = [F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS[:4]]
    base = materialise(found.select("doc_id", "row_key", *bare, *[F.when(hit, c).alias(n) for n, c in (("hash", F.md5(text.cast("binary"))), ("values", values), ("words", _terms(text)))]), "pii")
    hits = base.where("values is not null").select("hash", "values", F.col("words").alias("terms"))
    flagged = disclosing(hits, src.select("text"), base.count(), disclose, generalise)
    base, none = base.drop("hash", "values", "words"), F.from_json(F.lit("[]"), _TERMS)
    asked = None if flagged is None else among(flagged.select("term"), inside=True)
    if asked is None:
        return base.withColumn("terms", none)
    # only the places of terms that may be asked for are kept, so the walk over a text's words copies little
    walk = F.aggregate(
        F.zip_with(F.split(text, r"\p{L}++", -1), F.regexp_extract_all(text, F.lit(r"\p{L}++"), F.lit(0)), lambda g, w: F.struct(F.length(g).alias("g"), F.lower(w).alias("t"), F.length(w).alias("n"))),
        F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<struct<start:int,end:int,term:string>>").alias("all")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + F.coalesce(x["n"], F.lit(0))).alias("at"),
            F.when(asked(x["t"]), F.concat(a["all"], F.array(F.struct((a["at"] + x["g"]).alias("start"), (a["at"] + x["g"] + x["n"]).alias("end"), x["t"].alias("term"))))).otherwise(a["all"]).alias("all"),
        ),
    )
    placed = walk["all"]
    places = src.where(F.exists(_terms(text), asked)).select("row_key", F.inline(placed)).distinct().join(flagged, "term")
    terms = places.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "share", "removed", "by"))).alias("terms"))
    out = base.join(terms, "row_key", "left")
    inside = lambda t: F.exists(F.concat(*KINDS[:4]), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    return out.withColumn("terms", F.coalesce(F.filter("terms", lambda t: ~inside(t)), none))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, ``base_sha256`` and ``spans`` as the contract has them."""
    f = find(docs)
    base = F.concat(*[ranked(F.col(k), i) for i, k in enumerate(KINDS[:4])])
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("rank"), t["end"].alias("end")))
    return f.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.size("terms").cast("long").alias("n_term"),
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"),
        joined(F.concat(base, terms), KINDS).alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and the text with base spans replaced by ``<kind>``, terms generalised and disclosing ones removed.

    Where spans overlap, the first (and of those that start together the longest) is replaced."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    f = find(docs).drop("doc_id").dropDuplicates(["row_key"])

    def marked(k: str) -> Column:
        return F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), F.lit(f"<{k}>").alias("by")))

    edits = F.array_sort(F.concat(
        *map(marked, KINDS[:4]),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), (-t["end"]).alias("e"), F.when(t["removed"], "").otherwise(t["by"]).alias("by"))),
    ))
    out = F.aggregate(
        edits,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, s["start"] - a["at"]), s["by"]).alias("out"), (-s["e"]).alias("at"))),
    )
    done = F.transform(F.array(out), lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, F.length("text"))))[0]
    return src.select("*", row_key().alias("row_key")).join(f, "row_key").select("doc_id", done.alias("text"))
