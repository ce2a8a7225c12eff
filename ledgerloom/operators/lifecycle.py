"""Events with versions, and what they say of a work's life: stage, coverage, confidence, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extraction import event_key


def first_of(text: Column, kinds: dict[str, str], other: str) -> Column:
    """The first kind, in the table's order, whose pattern the text holds: a result before a candidate before a tender."""
    out = None
    for kind, pattern in kinds.items():
        hit = F.coalesce(text.rlike(pattern), F.lit(False))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(other)


def scope(*parts: Column) -> Column:
    """Phase, lot and the like, those that are there, joined: the part of a work an event is about; empty for the whole."""
    return F.concat_ws("|", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def with_keys(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.withColumn("event_key", event_key(*(F.col(k) for k in keys)))


def versioned(old: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """The stored events brought up to date with those a new extractor version gives.

    old: (event_key, ..., extractor_version, is_active); new: the same columns without these two.
    Events found again take the new version's values, those not found any more become inactive and
    keep theirs; of new events with one key the smallest row counts.
    """
    rest = [c for c in new.columns if c != "event_key"]
    fresh = new.groupBy("event_key").agg(F.min(F.struct(*rest)).alias("n"))
    both = old.select("event_key", F.struct(*rest).alias("o"), F.col("extractor_version").alias("was")).join(fresh, "event_key", "full")
    here = F.col("n").isNotNull()
    return both.select("event_key", *(F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest), F.when(here, version).otherwise(F.col("was")).alias("extractor_version"), here.alias("is_active"))


def coverage(events: DataFrame, key: str, stage: str, wanted: list[str]) -> DataFrame:
    """(key, seen, coverage, missing): the stages an entity's events cover of those wanted, and which it lacks up to its latest one."""
    order = F.create_map(*(x for i, s in enumerate(wanted) for x in (F.lit(s), F.lit(i))))
    held = events.filter(F.col(stage).isin(*wanted)).groupBy(key).agg(F.collect_set(stage).alias("s"))
    top = F.array_max(F.transform("s", lambda x: order[x]))
    missing = F.filter(F.slice(F.array(*map(F.lit, wanted)), F.lit(1), top + 1), lambda x: ~F.array_contains("s", x))
    return held.select(key, F.size("s").alias("seen"), F.round(F.size("s") / len(wanted), 4).alias("coverage"), F.array_join(missing, ",").alias("missing"))


def confidence(sources: Column, dated: Column, events: Column) -> Column:
    """HIGH for two sources or more with every event dated, LOW for one source without any date, else MEDIUM."""
    return F.when((sources >= 2) & (dated == events), "HIGH").when((sources < 2) & (dated == 0), "LOW").otherwise("MEDIUM")


def integrity(events: DataFrame) -> DataFrame:
    """(event_key, problem): active events without an entity, a type or a known date, and keys that are given twice."""
    live = events.filter("is_active")
    why = F.filter(F.array(F.when(F.coalesce(F.col("entity"), F.lit("")) == "", "no entity"), F.when(F.coalesce(F.col("event_type"), F.lit("")) == "", "no type"), F.when(F.col("day").isNull(), "no date")), lambda x: x.isNotNull())
    each = live.select("event_key", F.explode(why).alias("problem"))
    twice = live.groupBy("event_key").agg(F.count("*").alias("n")).filter("n > 1").select("event_key", F.lit("key given twice").alias("problem"))
    return each.unionByName(twice).distinct()
