"""Change tracking: what is new, updated or merely seen again; versions, upserts and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flags(observations: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """Adds is_first (no earlier observation of the key) and is_changed (content differs from the one before).

    Null contents count as a value of their own. The window is partitioned by the key alone, so a
    key's own observations are all it holds.
    """
    before = Window.partitionBy(key).orderBy(*order)
    return (
        observations.withColumns({"_n": F.row_number().over(before), "_before": F.lag(content).over(before)})
        .withColumns({"is_first": F.col("_n") == 1, "is_changed": (F.col("_n") > 1) & ~F.col("_before").eqNullSafe(F.col(content))})
        .drop("_n", "_before")
    )


def once_per_run(observations: DataFrame, run: str, key: str, order: str) -> DataFrame:
    """The first observation of a key in a run; later writes in the same run are ignored.

    min_by instead of a window: it combines on the map side, so a run with very many rows is no burden.
    """
    rest = [c for c in observations.columns if c not in (run, key)]
    first = observations.groupBy(run, key).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("r"))
    return first.select(run, key, *(F.col(f"r.{c}").alias(c) for c in rest))


def daily_status(flagged: DataFrame, key: str, at: str) -> DataFrame:
    """(key, day, status, first_at, last_at, n): NEW before UPDATED before SEEN_AGAIN, one row a key and day."""
    status = F.when(F.max("is_first"), "NEW").when(F.max("is_changed"), "UPDATED").otherwise("SEEN_AGAIN")
    return flagged.groupBy(key, F.to_date(at).alias("day")).agg(status.alias("status"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest order (insertion order, not time); combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), order).alias("r"))
    return top.select(*keys, *(F.col(f"r.{c}").alias(c) for c in (order, *rest)))


def upserted(rows: DataFrame, keys: list[str], order: str, kept: str) -> DataFrame:
    """One row a key with the last row's values, the first row's ``kept`` (its id) and the number of versions."""
    rest = [c for c in rows.columns if c not in (*keys, kept, order)]
    agg = rows.groupBy(*keys).agg(F.min(kept).alias(kept), F.max_by(F.struct(*rest), order).alias("r"), F.count("*").alias("versions"))
    return agg.select(*keys, kept, *(F.col(f"r.{c}").alias(c) for c in rest), "versions")


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, changed): names of the fields whose values differ, null-safe; keys in one table only count as a change of all fields."""
    a = old.select(key, *(F.col(c).alias(f"_old_{c}") for c in fields), F.lit(True).alias("_in_old"))
    b = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in fields), F.lit(True).alias("_in_new"))
    both = a.join(b, key, "full")
    differs = [F.when(F.col("_in_old").isNull() | F.col("_in_new").isNull() | ~F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}")), F.lit(c)) for c in fields]
    return both.select(key, F.array_compact(F.array(*differs)).alias("changed")).filter(F.size("changed") > 0)


def best_status(status: Column, order: list[str]) -> Column:
    """Aggregate: the status that stands first in the order; others come last."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), status), F.lit(0).cast("long")), F.lit(len(order) + 1).cast("long"))
    return F.min_by(status, F.struct(rank, status))


def trailing_mean(rows: DataFrame, key: str, order: str, value: str, rows_back: int) -> DataFrame:
    """Adds baseline and samples: mean and count of up to rows_back strictly earlier rows of the key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-rows_back, -1)
    return rows.withColumns({"baseline": F.avg(value).over(w), "samples": F.count(value).over(w)})


def latest_before(rows: DataFrame, keys: list[str], order: str, value: str, width: int = 10_000) -> DataFrame:
    """Adds latest_before: the greatest value of the key's rows with a smaller order, null for the first.

    The running maximum is taken in two levels, over stretches of ``width`` of the integer order and
    inside each, so a key that holds a large part of all rows isn't walked in one task.
    """
    cut = rows.withColumn("_stretch", F.floor(F.col(order) / width))
    above = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.groupBy(*keys, "_stretch").agg(F.max(value).alias("_m")).select(*keys, "_stretch", F.max("_m").over(above).alias("_earlier"))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("_inside", F.max(value).over(inside)).join(whole, [*keys, "_stretch"]).withColumn("latest_before", F.greatest("_inside", "_earlier")).drop("_stretch", "_inside", "_earlier")


def numbered(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Adds n, the row's place in its key's time order from 1, and before, the time of the row before it.

    Counted in two levels, over months and inside each, so a key with very many rows isn't walked in one task.
    """
    cut = rows.withColumn("_month", F.trunc(at, "month"))
    above = Window.partitionBy(key).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = cut.groupBy(key, "_month").agg(F.count("*").alias("_c"), F.max(at).alias("_last")).select(key, "_month", F.coalesce(F.sum("_c").over(above), F.lit(0)).alias("_earlier"), F.max("_last").over(above).alias("_last"))
    inside = Window.partitionBy(key, "_month").orderBy(at, tie)
    each = cut.withColumns({"_n": F.row_number().over(inside), "_lag": F.lag(at).over(inside)}).join(months, [key, "_month"])
    return each.withColumns({"n": (F.col("_n") + F.col("_earlier")).cast("int"), "before": F.coalesce("_lag", "_last")}).drop("_month", "_n", "_lag", "_earlier", "_last")
