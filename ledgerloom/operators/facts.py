"""Facts with provenance, versions and human reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNATURE = ["notice_id", "fact_type", "value", "source"]


def best(facts: DataFrame) -> DataFrame:
    """The best fact of each notice and type: confirmed, then confidence, then source rank, then the smallest id.

    facts: (id, notice_id, fact_type, value, source, confidence, source_rank, confirmed).
    """
    rank = F.struct(F.coalesce("confirmed", F.lit(False)).alias("c"), "confidence", "source_rank", (-F.col("id")).alias("i"))
    top = facts.groupBy("notice_id", "fact_type").agg(F.max_by(F.struct("id", "value", "source", "confidence"), rank).alias("r"))
    return top.select("notice_id", "fact_type", "r.id", "r.value", "r.source", "r.confidence")


def last_reviews(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """The review of each key that holds: the one given last (greatest review_id)."""
    rest = [c for c in reviews.columns if c not in keys]
    return reviews.groupBy(*keys).agg(F.max_by(F.struct(*rest), "review_id").alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def resolved(facts: DataFrame, reviews: DataFrame) -> DataFrame:
    """(notice_id, fact_type, value, decided_by): what holds after human review.

    reviews: (review_id, notice_id, fact_type, value, source, action). In this order: a REJECT
    removes a fact by its signature, so the same fact extracted anew stays rejected; CLEAR empties
    the field; OVERRIDE sets the review's value; CONFIRM prefers the confirmed fact; else the best.
    """
    rejected = last_reviews(reviews.filter("action in ('REJECT', 'CONFIRM')"), SIGNATURE)
    signed = facts.join(rejected.select(*SIGNATURE, "action"), SIGNATURE, "left")
    kept = signed.filter("action is null or action <> 'REJECT'").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)) | (F.coalesce("action", F.lit("")) == "CONFIRM"))
    chosen = best(kept.drop("action")).select("notice_id", "fact_type", "value")
    was = kept.groupBy("notice_id", "fact_type").agg(F.max("confirmed").alias("confirmed"))
    field = last_reviews(reviews.filter("action in ('CLEAR', 'OVERRIDE')"), ["notice_id", "fact_type"]).select("notice_id", "fact_type", F.col("value").alias("_set"), F.col("action").alias("_how"))
    both = chosen.join(was, ["notice_id", "fact_type"]).join(field, ["notice_id", "fact_type"], "full")
    value = F.when(F.col("_how") == "CLEAR", F.lit(None)).when(F.col("_how") == "OVERRIDE", F.col("_set")).otherwise(F.col("value"))
    how = F.when(F.col("_how").isNotNull(), F.col("_how")).when(F.col("confirmed"), "CONFIRM").otherwise("MACHINE")
    return both.select("notice_id", "fact_type", value.alias("value"), how.alias("decided_by"))


def persisted(old: DataFrame, new: DataFrame) -> DataFrame:
    """The versioned store after an extraction: new facts active, old ones kept but inactive unless confirmed. Nothing is lost."""
    fresh = new.select(*SIGNATURE, F.lit(True).alias("active"))
    gone = old.join(new.select(*SIGNATURE), SIGNATURE, "left_anti")
    return fresh.unionByName(gone.select(*SIGNATURE, F.coalesce("confirmed", F.lit(False)).alias("active")))


def difference(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, added, removed, changed, unchanged): how two versions of records differ, per field."""
    a = old.select(key, *(F.col(f).alias(f"_o{i}") for i, f in enumerate(fields)))
    b = new.select(key, *(F.col(f).alias(f"_n{i}") for i, f in enumerate(fields)))
    both = a.join(b, key, "full")

    def kind(i: int) -> Column:
        o, n = F.coalesce(F.col(f"_o{i}"), F.lit("")), F.coalesce(F.col(f"_n{i}"), F.lit(""))
        return F.when(o == n, "unchanged").when(o == "", "added").when(n == "", "removed").otherwise("changed")

    cells = both.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), kind(i).alias("kind")) for i, f in enumerate(fields)))).alias("x"))
    return cells.groupBy("x.field").agg(*(F.count_if(F.col("x.kind") == k).alias(k) for k in ("added", "removed", "changed", "unchanged")))


def review_queue(facts: DataFrame, reviews: DataFrame, limit: int | None = None) -> DataFrame:
    """Unreviewed facts by priority: conflicting values first, then weak ones, then the rest; one line a notice in P0."""
    open_ = facts.join(reviews.select(*SIGNATURE).distinct(), SIGNATURE, "left_anti")
    values = open_.groupBy("notice_id", "fact_type").agg(F.count_distinct("value").alias("values"), F.min("id").alias("first"))
    rows = open_.join(values, ["notice_id", "fact_type"])
    priority = F.when(F.col("values") > 1, "P0").when(F.col("confidence") < 0.5, "P1").when(F.col("confidence") < 0.8, "P2").otherwise("P3")
    rows = rows.withColumn("priority", priority).filter((F.col("priority") != "P0") | (F.col("id") == F.col("first")))
    out = rows.select("id", "notice_id", "fact_type", "value", "priority").orderBy("priority", "id")
    return out.limit(limit) if limit else out


def preview(facts: DataFrame, reviews: DataFrame, hypothetical: DataFrame) -> DataFrame:
    """(notice_id, fact_type, before, after): what further reviews would change, without writing any."""
    key = ["notice_id", "fact_type"]
    before = resolved(facts, reviews).select(*key, F.col("value").alias("before"))
    after = resolved(facts, reviews.unionByName(hypothetical)).select(*key, F.col("value").alias("after"))
    return before.join(after, key, "full").filter(~F.col("before").eqNullSafe(F.col("after")))
