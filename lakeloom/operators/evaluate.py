"""Exact evaluation of binary scores, and the model registry's promotion rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auc(df: DataFrame, label: str, score: str, ranges: int = 256) -> DataFrame:
    """One row: exact area under the ROC curve, ties counted half; null without both classes.

    Distinct scores are counted first; sums below a score run inside ranges between
    approximate quantiles of the distinct scores and then over the ranges, so scores are
    never sorted in one task, however they crowd.
    """
    s = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("p"), F.sum((F.col(label) != 1).cast("bigint")).alias("n"))
    edges = s.agg(F.array_distinct(F.percentile_approx("s", [i / ranges for i in range(1, ranges)], 10_000)).alias("edges"))
    s = s.crossJoin(F.broadcast(edges)).withColumn("r", F.size(F.filter("edges", lambda e: e < F.col("s")))).drop("edges")
    tot = s.groupBy("r").agg(F.sum("n").alias("rn"))
    tot = tot.select("r", (F.sum("rn").over(Window.orderBy("r")) - F.col("rn")).alias("before"))
    below = F.sum("n").over(Window.partitionBy("r").orderBy("s")) - F.col("n")
    d = s.withColumn("below", below).join(F.broadcast(tot), "r")
    a = d.agg(F.sum(F.col("p") * (F.col("below") + F.col("before") + F.col("n") * 0.5)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return a.select(F.try_divide(F.col("u"), F.col("p") * F.col("n")).alias("auc"))


def predicted(score: Column, threshold: float = 0.5) -> Column:
    return (score >= threshold).cast("int")


def precision_recall(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """precision, recall; 0 where nothing divides."""
    y, p = F.col(label) == 1, predicted(F.col(score), threshold) == 1
    c = df.agg(F.count_if(y & p).alias("tp"), F.count_if(p).alias("pp"), F.count_if(y).alias("ap"))
    return c.select(F.coalesce(F.try_divide("tp", "pp"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("tp", "ap"), F.lit(0.0)).alias("recall"))


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """(actual, predicted, n) of all four cells."""
    y, p = F.col(label), predicted(F.col(score), threshold)
    c = df.agg(*(F.count_if((y == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)))
    return c.select(F.explode(F.array(*(F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"c{a}{b}").alias("n")) for a in (0, 1) for b in (0, 1)))).alias("x")).select("x.*")


def class_report(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """(class, precision, recall, f1, support) per class and for accuracy, macro avg, weighted avg."""
    y, p = F.col(label), predicted(F.col(score), threshold)
    c = df.agg(*(F.count_if((y == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)))
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    rows = {}
    for k in (0, 1):
        tp, sup = F.col(f"c{k}{k}"), F.col(f"c{k}0") + F.col(f"c{k}1")
        pr, rc = z(tp, F.col(f"c0{k}") + F.col(f"c1{k}")), z(tp, sup)
        rows[k] = (pr, rc, z(2 * pr * rc, pr + rc), sup)
    acc = z(F.col("c00") + F.col("c11"), n)
    make = lambda name, v: F.struct(F.lit(name).alias("class"), v[0].alias("precision"), v[1].alias("recall"), v[2].alias("f1"), v[3].cast("bigint").alias("support"))
    macro = tuple((rows[0][i] + rows[1][i]) / 2 for i in range(3))
    weighted = tuple(z(rows[0][i] * rows[0][3] + rows[1][i] * rows[1][3], n) for i in range(3))
    return c.select(F.explode(F.array(make("0", rows[0]), make("1", rows[1]), make("accuracy", (acc, acc, acc, n)), make("macro avg", (*macro, n)), make("weighted avg", (*weighted, n)))).alias("x")).select("x.*")


def best_model(base: DataFrame, challenger: DataFrame, names: tuple[str, str] = ("logistic", "boosted")) -> DataFrame:
    """One row: the challenger only if its auc is strictly greater."""
    return base.select(F.col("auc").alias("a")).crossJoin(challenger.select(F.col("auc").alias("b"))).select(
        F.when(F.col("b") > F.col("a"), names[1]).otherwise(names[0]).alias("best_model"), F.greatest("a", "b").alias("auc")
    )


def promotion(versions: DataFrame) -> DataFrame:
    """(name, version, auc, promoted, stage) of registered versions.

    A version is promoted if there is no earlier one in production or it beats that one
    strictly. As only better ones replace it, production's metric is the maximum so far.
    """
    w = Window.partitionBy("name").orderBy("version")
    best = F.max("auc").over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(w) == 1
    d = versions.withColumn("promoted", first | best.isNull() | F.coalesce(F.col("auc") > best, F.lit(False)))
    last = F.max(F.when(F.col("promoted"), F.col("version"))).over(Window.partitionBy("name"))
    return d.withColumn("stage", F.when(~F.col("promoted"), "None").when(F.col("version") == last, "Production").otherwise("Archived"))
