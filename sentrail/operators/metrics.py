"""Evaluation measures as partial aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def binary_metrics(df: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """precision, recall, fpr and f1 with a small constant in every denominator; null flags count as false."""
    y, p = F.coalesce(F.col(truth), F.lit(False)), F.coalesce(F.col(predicted), F.lit(False))
    c = df.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp") + EPS), F.col("tp") / (F.col("tp") + F.col("fn") + EPS)
    return c.select(*by, F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.col("fp") / (F.col("fp") + F.col("tn") + EPS), 6).alias("fpr"), F.round(2 * precision * recall / (precision + recall + EPS), 6).alias("f1"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """precision, recall, f1 and support per class; a class that is never predicted has precision 0."""
    sides = df.select(F.explode(F.array(F.struct(F.col(truth).alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("s")).select("s.*").filter("cls IS NOT NULL")
    c = sides.groupBy("cls").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    precision = F.when(F.col("p") > 0, F.col("hit") / F.col("p")).otherwise(0.0)
    recall = F.when(F.col("t") > 0, F.col("hit") / F.col("t")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return c.select("cls", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.col("t").alias("support"))


def mcnemar(df: DataFrame, truth: str, first: str, second: str) -> tuple[float, float]:
    """Chi-square with continuity correction and p of two predictions; (0, 1) if they never differ in being right."""
    a, b = F.col(first).eqNullSafe(F.col(truth)), F.col(second).eqNullSafe(F.col(truth))
    n10, n01 = df.agg(F.count_if(a & ~b), F.count_if(~a & b)).first()
    if n10 + n01 == 0:
        return 0.0, 1.0
    x = max(abs(n10 - n01) - 1, 0) ** 2 / (n10 + n01)
    return x, math.erfc(math.sqrt(x / 2))


def fleiss(df: DataFrame, item: str, category: str) -> Column:
    """Kappa over one row per item and rating; every item has the same number of ratings."""
    n = df.groupBy(item, category).agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy(item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("q"))
    agree, items, m = per.agg(F.avg((F.col("q") - F.col("m")) / (F.col("m") * (F.col("m") - 1) + EPS)), F.count(F.lit(1)), F.max("m")).first()
    chance = sum((r[1] / (items * m)) ** 2 for r in n.groupBy(category).agg(F.sum("n")).collect())
    return F.lit((agree - chance) / (1 - chance + EPS))


def youden(df: DataFrame, truth: str, score: str, max_fpr: float = 0.05, digits: int = 3) -> DataFrame:
    """threshold, tpr, fpr with the largest tpr - fpr among those with fpr <= max_fpr; ties: highest threshold.

    Scores (0 to 1) are rounded to `digits` and counted per value first, so the ordered pass sees at most
    10**digits + 1 rows at any scale.
    """
    from pyspark.sql import Window

    v = df.filter(F.col(score).isNotNull()).groupBy(F.round(score, digits).alias("threshold")).agg(F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("n")).withColumn("_all", F.lit(1))
    down = Window.partitionBy("_all").orderBy(F.col("threshold").desc())
    whole = Window.partitionBy("_all")
    r = v.select("threshold", (F.sum("p").over(down) / F.greatest(F.sum("p").over(whole), F.lit(1))).alias("tpr"), (F.sum("n").over(down) / F.greatest(F.sum("n").over(whole), F.lit(1))).alias("fpr"))
    return r.filter(F.col("fpr") <= max_fpr).orderBy((F.col("tpr") - F.col("fpr")).desc(), F.col("threshold").desc()).limit(1)


def normal_tail(z: Column) -> Column:
    """P(Z > |z|) of the standard normal, to 7 digits (the usual rational series of five terms)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    # Coefficients of the series.
    series = sum((c * F.pow(t, F.lit(i)) for i, c in enumerate((0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429), 1)), F.lit(0.0))
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series
