"""Tags from score vectors, calibration of thresholds, and constrained decoding."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100


def softmax(v: Column) -> Column:
    m = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - m))
    return F.transform(F.array(e), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))[0]


def argmax(v: Column) -> Column:
    """Place (from 0) of the first largest."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("long")


def _others(p: Column, o: int) -> Column:
    return F.transform(p, lambda x, i: F.when(i == o, F.lit(-1.0)).otherwise(x))


def threshold_max(v: Column, o: int, t: float) -> Column:
    """The likeliest place but ``o`` if any of these has probability ``t`` or more, else ``o``."""
    p = _others(softmax(v), o)
    return F.when(F.array_max(p) >= t, argmax(p)).otherwise(F.lit(o).cast("long"))


def threshold_sum(v: Column, o: int, t: float) -> Column:
    """The likeliest place but ``o`` if all of these together have probability ``t`` or more, else ``o``."""
    p = softmax(v)
    rest = F.aggregate(F.transform(p, lambda x, i: F.when(i == o, 0.0).otherwise(x)), F.lit(0.0), lambda a, x: a + x)
    return F.when(rest >= t, argmax(_others(p, o))).otherwise(F.lit(o).cast("long"))


def phi_score(v: Column, o: int, how: str) -> Column:
    """Probability that a token is of any type: the largest or the sum over types."""
    p = softmax(v)
    if how == "max":
        return F.array_max(_others(p, o))
    if how == "sum":
        return F.aggregate(F.transform(p, lambda x, i: F.when(i == o, 0.0).otherwise(x)), F.lit(0.0), lambda a, x: a + x)
    raise ValueError(f"how: max or sum, not {how!r}")


def unmasked(predictions: Column, labels: Column) -> Column:
    """Predictions at places whose label isn't ignored (context, special tokens, later word pieces)."""
    z = F.zip_with(predictions, labels, lambda p, y: F.struct(p.alias("p"), y.alias("y")))
    return F.transform(F.filter(z, lambda x: x["y"] != IGNORED), lambda x: x["p"])


POST_PROCESS = {
    "argmax": lambda v, o, t: argmax(v),
    "threshold_max": threshold_max,
    "threshold_sum": threshold_sum,
    "logits": lambda v, o, t: v,
}


def post_process(name: str, v: Column, o: int, threshold: float | None = None) -> Column:
    if name not in POST_PROCESS:
        raise ValueError(f"no post-processor {name!r}; there are {sorted(POST_PROCESS)}")
    if name.startswith("threshold") and threshold is None:
        raise ValueError(f"{name} needs a threshold")
    return POST_PROCESS[name](v, o, threshold)


def decoded(df: DataFrame, name: str, tags: list[str], threshold: float | None = None, notation: str = "BILOU", predictions: str = "predictions", labels: str = "labels") -> DataFrame:
    """Note rows with ``labels`` (ids) and ``predictions`` (a score vector a place) as tags, without the places that are ignored.

    ``name``: argmax, threshold_max, threshold_sum, logits (vectors stay), or crf (the best legal path)."""
    names = F.array(*[F.lit(t) for t in tags])
    kept = F.transform(F.filter(labels, lambda y: y != IGNORED), lambda y: names[y])
    if name == "crf":
        own = viterbi(df, predictions, notation, tags, "__path", labels)
        return own.withColumn(labels, kept).withColumn(predictions, F.col("__path")).drop("__path")
    o = tags.index("O")
    own = F.transform(unmasked(F.col(predictions), F.col(labels)), lambda v: post_process(name, v, o, threshold))
    # ignored places are taken out by the labels as they were
    out = own if name == "logits" else F.transform(own, lambda i: names[i.cast("int")])
    return df.withColumns({predictions: out, labels: kept})


def recall_threshold(scores: DataFrame, recall: float, parts: int = 64) -> DataFrame:
    """(precision, recall, threshold): the highest threshold whose recall exceeds ``recall``; no row if none does.

    ``scores``: score, truth (boolean).  Rows are counted by distinct score, and scores fall into ``parts`` ranges of about as many each;
    a range's counts start from the sums of the ranges above it, so no task sees more than its range's scores."""
    by = scores.groupBy("score").agg(F.sum(F.col("truth").cast("long")).alias("t"), F.count("*").alias("n"))
    cuts = by.agg(F.percentile_approx("score", [i / parts for i in range(1, parts)], 10_000).alias("cuts"))
    placed = by.join(F.broadcast(cuts)).select("score", "t", "n", F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda c: c < F.col("score"))).alias("part"))  # one row of cuts
    sums = placed.groupBy("part").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    zero = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    base = sums.select("part", zero("t").alias("t0"), zero("n").alias("n0"), F.sum("t").over(Window.partitionBy()).alias("all"))
    w = Window.partitionBy("part").orderBy(F.desc("score"))
    run = placed.join(F.broadcast(base), "part").select("score", (F.sum("t").over(w) + F.col("t0")).alias("tp"), (F.sum("n").over(w) + F.col("n0")).alias("pp"), "all")
    ok = run.where((F.col("all") > 0) & (F.col("tp") / F.col("all") > recall))
    best = ok.agg(F.max_by(F.struct("tp", "pp", "all", "score"), "score").alias("b")).where("b is not null")
    return best.select((F.col("b.tp") / F.col("b.pp")).alias("precision"), (F.col("b.tp") / F.col("b.all")).alias("recall"), F.col("b.score").alias("threshold"))


#: By notation: the tags that may come first, those that may come last, and for each tag those that may follow it, of any type or of its own.
_RULES = {
    "BILOU": ("OBUIL", "OBUIL", {**dict.fromkeys("OLU", ("OBU", "")), **dict.fromkeys("BI", ("", "IL"))}),
    "BIO": ("OBI", "OBI", {"O": ("OB", ""), "B": ("OB", "I"), "I": ("OB", "I")}),
    "IOB1": ("OI", "OBI", {"O": ("OI", ""), "B": ("OI", "B"), "I": ("OI", "B")}),
    "BMES": ("BS", "ES", {"B": ("", "ME"), "M": ("", "ME"), "E": ("BS", ""), "S": ("BS", "")}),
}
_RULES["BIOUL"] = _RULES["BILOU"]


def legal(notation: str, a: str, b: str) -> bool:
    """Whether tag ``b`` may follow ``a``; START and END stand for the ends.

    A note's rows are cut where sentences are, so in BILOU and BIO an entity may go on from before the start, or past the end."""
    if notation not in _RULES:
        raise ValueError(f"no transitions for {notation!r}")
    first, final, after = _RULES[notation]
    if b == "START" or a == "END":
        return False
    if a == "START":
        return b != "END" and b[:1] in first
    if b == "END":
        return a[:1] in final
    anyone, own = after.get(a[:1], ("", ""))
    return b[:1] in anyone or (b[:1] in own and a[1:] == b[1:])


def transitions(spark, notation: str, tags: list[str]) -> DataFrame:
    """(from_tag, to_tag) of the legal neighbours among tags, START and END."""
    pairs = [(a, b) for a in [*tags, "START"] for b in [*tags, "END"] if legal(notation, a, b)]
    return spark.createDataFrame(pairs, "from_tag string, to_tag string")


def viterbi(df: DataFrame, scores: str, notation: str, tags: list[str], out: str = "path", labels: str | None = None, weights: list[list[float]] | None = None, top_k: int | None = None) -> DataFrame:
    """Adds the best legal path (array of tags) for a column of ``array<array<double>>`` emission scores.

    ``labels``: a column of label ids; places whose id is ``IGNORED`` (context, special tokens, later word pieces) are left out before decoding.  ``weights``: scores of tag
    pairs, (tags + 2) squared with START and END last; 0 by default.  ``top_k``: the column holds that many paths at most, best first, as
    structs of path and score.  A row without places, or without a legal path, has an empty one (none with ``top_k``).

    Dynamic programming per row over Arrow batches; the table of transitions is fixed by the tags."""
    import numpy as np
    import pyarrow as pa

    n, k_ = len(tags), top_k or 1
    named = [*tags, "START", "END"]
    w = np.zeros((n + 2, n + 2)) if weights is None else np.array(weights, float)
    table = np.array([[w[i, j] if legal(notation, a, b) else -np.inf for j, b in enumerate(named)] for i, a in enumerate(named)])
    trans, first, end = table[:n, :n], table[n, :n], table[:n, n + 1]

    def best(m: list) -> list[tuple[float, list[str]]]:
        if not m:
            return []
        e = np.array(m, float).reshape(-1, n)
        at, back = (e[0] + first)[None], []  # (rank, tag): the best scores of paths that end there
        for row in e[1:]:
            step = (at[:, :, None] + trans).reshape(-1, n)  # (rank and tag before, tag)
            order = np.argsort(-step, axis=0, kind="stable")[:k_]
            back.append(order)
            at = np.take_along_axis(step, order, 0) + row
        last = (at + end).ravel()
        found = []
        for x in np.argsort(-last, kind="stable")[:k_].tolist():
            if not np.isfinite(last[x]):
                break
            path = [x]
            for order in reversed(back):
                path.append(int(order[divmod(path[-1], n)]))
            found.append((float(last[x]), [tags[i % n] for i in reversed(path)]))
        return found

    where, ids = df.columns.index(scores), None if labels is None else df.columns.index(labels)
    kind = pa.list_(pa.string()) if top_k is None else pa.list_(pa.struct([("path", pa.list_(pa.string())), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(where).to_pylist()
            if ids is not None:
                rows = [[v for v, y in zip(r or [], ys or [], strict=True) if y != IGNORED] for r, ys in zip(rows, b.column(ids).to_pylist(), strict=True)]
            paths = [best(x or []) for x in rows]
            got = [p[0][1] if p else [] for p in paths] if top_k is None else [[{"path": t, "score": v} for v, t in p] for p in paths]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], names=[*b.schema.names, out])

    from pyspark.sql import types as T

    path = T.ArrayType(T.StringType())
    added = path if top_k is None else T.ArrayType(T.StructType([T.StructField("path", path), T.StructField("score", T.DoubleType())]))
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, added)]))
