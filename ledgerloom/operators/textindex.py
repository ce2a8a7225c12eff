"""A stored full-text index: postings in buckets of their terms, appended to by batch, read by the query's terms alone."""

from __future__ import annotations

import re
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

BUCKETS = 16  # partitions of the postings; a larger corpus takes more


def query_terms(text: str) -> list[str]:
    """The terms of a query as typed: runs of letters and digits in lower case, each once; marks mean nothing."""
    return list(dict.fromkeys(x for x in re.split(r"[\W_]+", text.lower()) if x))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """Postings (term, id, version, tf) by bucket of the term, and documents (id, version, length).

    A document added again replaces its earlier version, one removed has a last version without a
    length; only last versions count. Nothing is rewritten.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, docs: DataFrame, version: int, id_col: str = "id", text: str = "text") -> None:
        cut = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(version).cast("long").alias("version"), search.tokens(F.col(text)).alias("t"))
        each = cut.select("id", "version", F.explode("t").alias("term")).groupBy("id", "version", "term").agg(F.count("*").alias("tf"))
        posted = each.select("term", "id", "version", "tf", _bucket(F.col("term")).alias("bucket"))
        posted.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        cut.select("id", "version", F.size("t").cast("long").alias("length")).write.mode("append").parquet(f"{self.path}/documents")

    def remove(self, ids: DataFrame, version: int, id_col: str = "id") -> None:
        gone = ids.select(F.col(id_col).cast("long").alias("id"), F.lit(version).cast("long").alias("version"), F.lit(None).cast("long").alias("length"))
        gone.write.mode("append").parquet(f"{self.path}/documents")

    def documents(self) -> DataFrame:
        """(id, version, length) of the last versions that are there."""
        rows = self.spark.read.schema("id long, version long, length long").parquet(f"{self.path}/documents")
        last = rows.groupBy("id").agg(F.max(F.struct("version", "length")).alias("d"))
        return last.select("id", "d.version", "d.length").filter("length is not null")

    def search(self, query: list[str], limit: int | None = 20) -> DataFrame:
        """(id, score) as ``search.bm25``: documents with all terms, best first, ties by id."""
        terms = list(dict.fromkeys(query))
        if not terms:
            return self.spark.createDataFrame([], "id long, score double")
        posted = self.spark.read.schema("term string, id long, version long, tf long, bucket int").parquet(f"{self.path}/postings")
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"))).distinct().collect()]
        held = self.documents()
        n, mean = held.agg(F.count("*"), F.avg("length")).first()
        # only the buckets of the query's terms are read
        hits = posted.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).join(held, ["id", "version"])
        per = hits.groupBy("id", "length").agg(*(F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(terms)))
        df = per.agg(*(F.count(f"tf{i}") for i in range(len(terms)))).first()
        score = F.lit(0.0)
        for i, c in enumerate(df):
            tf = F.col(f"tf{i}")
            score = score + F.lit(log(1 + (n - c + 0.5) / (c + 0.5))) * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * F.col("length") / F.lit(mean or 1.0)))
        ranked = per.filter(" and ".join(f"tf{i} > 0" for i in range(len(terms)))).select("id", F.round(score, 6).alias("score"))
        return ranked.orderBy(F.desc("score"), "id").limit(limit) if limit else ranked
