"""Mixing sources to target weights (problem 9).

Weighted fair queueing: the documents of each source are shuffled by hash; each copy of a document
gets as virtual finish time the source's cumulative tokens, this copy included, divided by the
source's target weight. All copies are range-sorted by finish time and cut at the total budget.
Sources whose repeats are used up leave the queue and the others go on.

Cumulative sums are taken in two levels, so that no source, however large, is summed in one task:
tokens per (source, hash bucket), a running sum over the buckets, and a window inside each bucket.
A document's copies differ only by whole rounds of its source, so copies are made after the sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .encoding import PATTERN, VOCABULARIES, load_ranks
from .support import checkpointed, once

SEED = 20240607
MOST_SOURCES = 10_000  # rows of the table of targets, which is held on the driver
PER_BUCKET = 50_000


def token_count(docs: DataFrame, text: Column, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Column:
    """Tokens of a text in a public vocabulary; null for null."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(name, folder))
    key = uuid4().hex

    def made():
        import tiktoken

        return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})

    @pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = once(key, made).encode_ordinary
        for s in parts:
            yield pd.Series([None if t is None else len(encode(t)) for t in s], dtype="Int64")

    return count(text)


def virtual_end(totals: list[tuple[float, float]], budget: float) -> float:
    """The virtual time at which sources with (share, most tokens) have given the budget, or all they have."""
    ends = sorted((most / share, share, most) for share, most in totals if share > 0)
    given, rate, now = 0.0, sum(share for _, share, _ in ends), 0.0
    for end, share, _ in ends:
        if given + rate * (end - now) >= budget:
            return now + (budget - given) / rate
        given, now, rate = given + rate * (end - now), end, max(rate - share, 0.0)
    return now


def plan(sizes: DataFrame, targets: DataFrame, budget: float | None) -> tuple[list[tuple], float]:
    """([(source, share, share among sources with tokens, tokens, most tokens)], virtual end)."""
    rows = targets.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).filter("source is not null and share > 0").join(sizes, "source", "left").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    have = sum(r.share for r in rows if r.tokens)
    out = [(r.source, r.share, r.share / have if r.tokens else 0.0, r.tokens or 0, (r.tokens or 0) * max(r.repeats or 0.0, 0.0)) for r in rows]
    live = [(share, most) for _, _, share, _, most in out if share > 0 and most > 0]
    if budget is None:  # the largest total at which every source with documents reaches its share
        budget = min((most / share for share, most in live), default=0.0)
    return sorted(out), virtual_end(live, budget)


def mixed(docs: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, copy_no, source, n_tokens, finish_time), sorted by finish time: the mixture.

    docs: (doc_id, text, source); targets: (source, target_share, max_repeats). ``budget`` is the
    total in tokens, by default the largest at which every source with documents reaches its share
    within its repeats. Null, empty and other texts without tokens, null and unlisted sources take
    no part; a listed source without documents gives nothing and its share falls to the others in
    proportion. Copies are numbered from 0; a last round may be partial.
    """
    listed = targets.select("source").distinct()
    sized = docs.filter("text <> ''").join(listed, "source", "left_semi").select("doc_id", "source", token_count(docs, F.col("text")).alias("n_tokens"))
    sized = checkpointed(sized.filter("n_tokens > 0").withColumn("h", F.xxhash64("doc_id", F.lit(seed))))
    totals, end = plan(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), targets, budget)
    weights = docs.sparkSession.createDataFrame([(s, w, t, m) for s, _, w, t, m in totals if w > 0], "source string, w double, tokens long, most double")
    buckets = max(1, sized.count() // PER_BUCKET)
    cells = sized.withColumn("bucket", F.floor((F.shiftright("h", 32) + 2**31) * buckets / 2**32))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")).select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.withColumn("inside", F.sum("n_tokens").over(inside)).join(offsets, ["source", "bucket"]).join(F.broadcast(weights), "source")  # at most MOST_SOURCES rows
    limit = F.least(F.col("w") * end, F.col("most"))
    first = F.col("offset") + F.col("inside")
    rounds = F.floor((limit - first) / F.col("tokens"))
    copies = summed.withColumn("first", first).filter(first <= limit).withColumn("copy_no", F.explode(F.sequence(F.lit(0), rounds.cast("int"))))
    finish = (F.col("first") + F.col("copy_no") * F.col("tokens")) / F.col("w")
    return copies.select("doc_id", "copy_no", "source", "n_tokens", F.round(finish, 6).alias("finish_time")).orderBy("finish_time", "doc_id", "copy_no")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, actual_share, documents, most_copies) of every listed source."""
    got = mix.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"), (F.max("copy_no") + 1).alias("most_copies"))
    got = checkpointed(got)  # one row a listed source
    whole = got.agg(F.sum("tokens")).first()[0] or 0
    wanted = targets.groupBy("source").agg(F.sum("target_share").alias("target_share")).filter("source is not null")
    rows = wanted.join(got, "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
    return rows.select("source", "target_share", "tokens", (F.col("tokens") / F.lit(float(whole or 1))).alias("actual_share"), "documents", "most_copies")
