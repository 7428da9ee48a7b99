"""Span and token metrics; counters are computed once and every average is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, zero: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(zero)).otherwise(a / b)


def f_beta(p: Column, r: Column, beta: float = 1.0) -> Column:
    """A zero denominator counts as one."""
    d = beta * beta * p + r
    return (1 + beta * beta) * p * r / F.when(d == 0, 1.0).otherwise(d)


def span_counts(gold: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """(label, tp, predicted, actual) of spans (key, label, start, end); equal spans count once."""
    cols = [*key, "label", "start", "end"]
    both = gold.select(*cols).distinct().withColumn("g", F.lit(1)).unionByName(predicted.select(*cols).distinct().withColumn("g", F.lit(2)))
    one = both.groupBy(*cols).agg(F.sum("g").alias("g"))
    return one.groupBy("label").agg(F.sum((F.col("g") == 3).cast("long")).alias("tp"), F.sum((F.col("g") >= 2).cast("long")).alias("predicted"), F.sum((F.col("g") != 2).cast("long")).alias("actual"))


def token_counts(tokens: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """The same for tokens with types ``truth`` and ``pred``; O is no type."""
    return pair_counts(tokens.groupBy(truth, pred).agg(F.count("*").alias("n")), truth, pred)


def pair_counts(n: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """The same from the number ``n`` of tokens by both types."""
    long_ = n.select(F.explode(F.array_distinct(F.array(truth, pred))).alias("label"), F.col(truth).alias("t"), F.col(pred).alias("p"), "n").where("label <> 'O'")
    hit = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return long_.groupBy("label").agg(hit((F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))).alias("tp"), hit(F.col("p") == F.col("label")).alias("predicted"), hit(F.col("t") == F.col("label")).alias("actual"))


def scores(counts: DataFrame, beta: float = 1.0, zero: float = 0.0) -> DataFrame:
    """precision, recall, f1 and support by label."""
    p, r = ratio(F.col("tp"), F.col("predicted"), zero), ratio(F.col("tp"), F.col("actual"), zero)
    return counts.select("label", p.alias("precision"), r.alias("recall"), f_beta(p, r, beta).alias("f1"), F.col("actual").alias("support"))


def averages(counts: DataFrame, beta: float = 1.0, zero: float = 0.0) -> DataFrame:
    """(average, precision, recall, f1, support) for micro, macro and weighted averages."""
    s = scores(counts, beta, zero)
    m = counts.agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("actual").alias("actual"))
    micro = scores(m.withColumn("label", F.lit("micro")), beta, zero)
    macro = s.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit("macro").alias("label"), "*")
    w = s.agg(*[F.when(F.sum("support") == 0, 0.0).otherwise(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    out = micro.unionByName(macro).unionByName(w.select(F.lit("weighted").alias("label"), "*"))
    return out.withColumnRenamed("label", "average")


def confusion(tokens: DataFrame, types: list[str], truth: str = "truth", pred: str = "pred", share: bool = False) -> DataFrame:
    """A row per true type and a column ``pred_<type>`` per predicted one, in the order given, O last; ``share``: parts of the row's sum."""
    order = [*types, "O"]
    n = tokens.groupBy(truth).agg(*[F.sum((F.col(pred) == t).cast("long")).alias(f"pred_{t}") for t in order])
    rows = tokens.sparkSession.createDataFrame([(t, i) for i, t in enumerate(order)], "truth string, row int")
    out = rows.join(n.withColumnRenamed(truth, "truth"), "truth", "left").na.fill(0)
    if share:
        total = sum((F.col(f"pred_{t}") for t in order), F.lit(0))
        out = out.select("truth", "row", *[ratio(F.col(f"pred_{t}"), total).alias(f"pred_{t}") for t in order])
    return out


_METRIC = r"^(.*)_(precision|recall|f1|number)$"


def report(spans: DataFrame, tokens: DataFrame, violations: DataFrame, description: str = "", beta: float = 1.0, zero: float = 0.0) -> DataFrame:
    """(name, value), a metric a row: by type, micro and macro averages, of spans and of tokens, and the number of violations.

    ``spans``, ``tokens``: counters (label, tp, predicted, actual); ``violations``: (violations) a note."""
    out = None

    def add(rows: DataFrame) -> None:
        nonlocal out
        out = rows if out is None else out.unionByName(rows)

    for counts, scope in ((spans, ""), (tokens, "TOKEN")):
        own = scores(counts, beta, zero).withColumn("name", F.concat_ws("-", "label", *([F.lit(scope)] if scope else [])))
        add(_named(own, {"precision": "precision", "recall": "recall", "f1": "f1", "number": "support"}))
        mean = averages(counts, beta, zero).where("average <> 'weighted'")
        token = "token-" if scope else ""
        name = F.when(F.col("average") == "micro", f"{token}overall{description}").otherwise(f"macro-{token}overall{description}")
        add(_named(mean.withColumn("name", name), {m: m for m in ("precision", "recall", "f1")}))
    total = violations.agg(F.coalesce(F.sum("violations"), F.lit(0)).cast("double").alias("count")).withColumn("name", F.lit(f"violations{description}"))
    add(_named(total, {"count": "count"}))
    return out


def _named(rows: DataFrame, values: dict[str, str]) -> DataFrame:
    wide = rows.select("name", *[F.col(c).cast("double").alias(m) for m, c in values.items()])
    return wide.unpivot(["name"], list(values), "metric", "value").select(F.concat_ws("_", "name", "metric").alias("name"), "value")


def pivot(flat: DataFrame) -> DataFrame:
    """(entity, precision, recall, f1, number) from flat names."""
    e = flat.select(F.regexp_extract("name", _METRIC, 1).alias("entity"), F.regexp_extract("name", _METRIC, 2).alias("m"), "value")
    return e.where("m <> ''").groupBy("entity").pivot("m", ["precision", "recall", "f1", "number"]).agg(F.first("value"))
