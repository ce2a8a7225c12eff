"""Aggregates that pick, list or count within groups, all combined on the map side where they can be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): the most common value of each group; ties go to the shortest, then the smallest. Nulls don't count."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("_n"), F.length(value).alias("_l"), value)).alias("b"))
    return best.select(*keys, F.col(f"b.{value}").alias(value), (-F.col("b._n")).alias("n"))


def single_or_empty(value: Column) -> Column:
    """Aggregate: the value if a group has exactly one distinct non-empty value, else ''. Min and max stand for the set."""
    seen = F.nullif(value, F.lit(""))
    return F.when(F.min(seen) == F.max(seen), F.min(seen)).otherwise("")


def shortest(value: Column) -> Column:
    """Aggregate: the shortest non-empty value, the smallest of equals."""
    return F.min(F.when(value != "", F.struct(F.length(value).alias("l"), value.alias("v"))))["v"]


def sorted_list(value: Column, sep: str) -> Column:
    """Aggregate: the distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(value)), sep)


def best_by_rank(rows: DataFrame, keys: list[str], ranks: list[Column], fields: list[str]) -> DataFrame:
    """The fields of each group's first row by the ranks (greater first); the last rank should break all ties."""
    struct = F.struct(*(r.alias(f"_r{i}") for i, r in enumerate(ranks)), *fields)
    top = rows.groupBy(*keys).agg(F.max(struct).alias("b"))
    return top.select(*keys, *(F.col(f"b.{c}").alias(c) for c in fields))
