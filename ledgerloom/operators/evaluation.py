"""Precision, recall and agreement of predicted label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(a, b):
    return F.round(F.when(b > 0, a / b).otherwise(1.0), 4)


def micro(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(cases, tp, fp, fn, precision, recall, exact): over array columns; nulls count as empty sets."""
    g = F.array_distinct(F.coalesce(gold, F.array().cast("array<string>")))
    p = F.array_distinct(F.coalesce(predicted, F.array().cast("array<string>")))
    cut = rows.select(F.size(F.array_intersect(g, p)).alias("tp"), F.size(F.array_except(p, g)).alias("fp"), F.size(F.array_except(g, p)).alias("fn"))
    total = cut.agg(F.count("*").alias("cases"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.count_if((F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact"))
    return total.select("cases", "tp", "fp", "fn", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), "exact")


def by_class(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(label, support, predicted, hit, precision, recall) per label that either side has."""
    g, p = F.coalesce(gold, F.array().cast("array<string>")), F.coalesce(predicted, F.array().cast("array<string>"))
    labels = rows.select(F.explode(F.array_union(g, p)).alias("label"), g.alias("g"), p.alias("p"))
    flags = labels.select("label", F.array_contains("g", F.col("label")).alias("in_g"), F.array_contains("p", F.col("label")).alias("in_p"))
    out = flags.groupBy("label").agg(F.count_if("in_g").alias("support"), F.count_if("in_p").alias("predicted"), F.count_if(F.col("in_g") & F.col("in_p")).alias("hit"))
    return out.select("*", _ratio(F.col("hit"), F.col("predicted")).alias("precision"), _ratio(F.col("hit"), F.col("support")).alias("recall"))


def agreement(rows: DataFrame, key: str, rater: str, value: str, first: str, second: str) -> DataFrame:
    """(a, b, n): the confusion matrix of two raters over the keys that both rated."""
    a = rows.filter(F.col(rater) == first).select(key, F.col(value).alias("a"))
    b = rows.filter(F.col(rater) == second).select(key, F.col(value).alias("b"))
    return a.join(b, key).groupBy("a", "b").agg(F.count("*").alias("n"))
