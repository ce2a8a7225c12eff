"""Record linkage: blocking, pair scores, a merged review queue, clusters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..session import checkpointed


def blocks(rows: DataFrame, id_col: str, keys: Column) -> DataFrame:
    """(key, id): one row per key of each record; keys is an array, ids are unique."""
    return rows.select(F.explode(F.array_distinct(keys)).alias("key"), F.col(id_col).alias("id"))


def block_sizes(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("key").agg(F.count("*").alias("size"))


def blocked_pairs(keyed: DataFrame, least: int = 2, most: int = 25) -> DataFrame:
    """(a, b) with a < b of records that share a block of ``least`` to ``most`` records.

    Sizes are counted first, so larger blocks, which say too little to compare by, never reach the
    self-join; no block makes more than most^2 / 2 pairs.
    """
    sizes = block_sizes(keyed).filter(F.col("size").between(least, most)).select("key")
    kept = keyed.join(sizes, "key", "left_semi")
    a, b = kept.alias("a"), kept.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def similar_candidates(rows: DataFrame, group: Sequence[str], items: Column, percent: int) -> DataFrame:
    """(a, b) with a < b, each once: all rows of one group whose sets have a Jaccard of at least ``percent`` of 100, among others that may not; no block is left out.

    rows: id, the group's columns, those of items, a set. Sets of n items that are so similar share
    at least ceil(percent n / 100) of them, so the rarest item that both have is one of the n + 1
    less that number that are rarest in either: only these are joined, by their hashes. From its
    place in both sets follows how many they can share; too few for sets of their sizes, and the
    pair isn't made.
    """
    hashed = rows.select("id", items.alias("items"), *group).select("id", F.size("items").alias("n"), F.explode(F.transform("items", lambda x: F.xxhash64(*group, x))).alias("key"))
    # items of one set alone come first in it and join nothing
    counts = hashed.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1")
    ranked = hashed.join(counts, "key").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("p"))
    posted = ranked.select("id", "n", (F.col("n") - F.size("p")).alias("alone"), F.posexplode("p").alias("place", "k")).select("id", "n", F.expr("n - alone - place").alias("rest"), F.col("k.key").alias("key"))
    posted = checkpointed(posted.filter(f"100 * rest >= {percent} * n"))
    a, b = posted.alias("a"), posted.alias("b")
    fits = (F.col("a.id") < F.col("b.id")) & ((100 + percent) * F.least("a.rest", "b.rest") >= percent * (F.col("a.n") + F.col("b.n")))
    return a.join(b, "key").filter(fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def with_both(pairs: DataFrame, records: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Adds a_<field> and b_<field> of both ends."""
    left = records.select(F.col(id_col).alias("a"), *(F.col(f).alias(f"a_{f}") for f in fields))
    right = records.select(F.col(id_col).alias("b"), *(F.col(f).alias(f"b_{f}") for f in fields))
    return pairs.join(left, "a").join(right, "b")


@pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts; it isn't symmetric, so the order of the arguments matters."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def merged_queue(old: DataFrame, new: DataFrame, keys: list[str], evidence: str) -> DataFrame:
    """(keys, evidence, status, active): yesterday's review queue brought up to date with today's candidates.

    old: (keys, evidence, status); new: (keys, evidence). What isn't found any more becomes
    inactive; CONFIRMED and REJECTED stick; DEFERRED reopens only if its evidence changed.
    """
    a = old.select(*keys, F.col(evidence).alias("_was"), F.col("status").alias("_status"))
    b = new.select(*keys, F.col(evidence).alias("_is"), F.lit(True).alias("active"))
    status = F.when(F.col("_status").isNull(), "PENDING").when((F.col("_status") == "DEFERRED") & F.col("active") & ~F.col("_was").eqNullSafe(F.col("_is")), "PENDING").otherwise(F.col("_status"))
    joined = a.join(b, keys, "full")
    return joined.select(*keys, F.coalesce("_is", "_was").alias(evidence), status.alias("status"), F.coalesce("active", F.lit(False)).alias("active"))


def cluster_conflicts(members: DataFrame, fields: list[str]) -> DataFrame:
    """(root, n, <field>s, conflict): distinct non-empty values of each field in a cluster; two of any make a conflict."""
    counts = [F.count_distinct(F.nullif(F.col(f), F.lit(""))).alias(f"{f}s") for f in fields]
    grouped = members.groupBy("root").agg(F.count("*").alias("n"), *counts)
    conflict = F.lit(False)
    for f in fields:
        conflict = conflict | (F.col(f"{f}s") > 1)
    return grouped.withColumn("conflict", conflict)


def first_fit(events: DataFrame, keys: list[str], day: str, tolerance: int = 7) -> DataFrame:
    """Adds leader: the first day of the event's group. A group takes all events of its key up to ``tolerance`` days after its first.

    This is greedy, no transitive closure: a chain of events a few days apart is cut anew each
    time. The distinct days of the keys are sorted within partitions and walked batch by batch, so
    no group is ever held as a whole. Events without a day make a group of their own.
    """
    days = events.filter(F.col(day).isNotNull()).select(*keys, F.col(day).alias("_day")).distinct()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, first = None, None
        for b in batches:
            leaders = []
            for *key, x in b[[*keys, "_day"]].itertuples(index=False):
                if key != now or (x - first).days > tolerance:
                    now, first = key, x
                leaders.append(first)
            yield b.assign(leader=leaders)

    types = dict(days.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, "_day"]) + ", leader date"
    led = days.repartition(*keys).sortWithinPartitions(*keys, "_day").mapInPandas(walk, schema).withColumnRenamed("_day", day)
    return events.join(led, [*keys, day], "left")
