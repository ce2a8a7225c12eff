"""Full-text search: postings with positions, BM25, phrases and snippets."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(c: Column) -> Column:
    """array<string>: runs of letters and digits in lower case; a run of Han characters is one token."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def pairs_of_han(c: Column) -> Column:
    """array<string>: pairs of neighbouring Han characters, so that words inside a run are found."""
    # an empty match that looks ahead moves on by one character: one pass, however long the text
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?=([一-鿿]{2}))"), 1)


def postings(docs: DataFrame, id_col: str, toks: Column) -> tuple[DataFrame, DataFrame]:
    """((term, id, tf, positions), (id, length)); documents without tokens have a length of 0."""
    cut = docs.select(F.col(id_col).alias("id"), toks.alias("t"))
    lengths = cut.select("id", F.size("t").alias("length"))
    at = cut.select("id", F.posexplode("t").alias("pos", "term"))
    return at.groupBy("term", "id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions")), lengths


def _times(term: str) -> Column:
    return F.size(F.filter("t", lambda x: x == F.lit(term)))


def bm25(docs: DataFrame, id_col: str, toks: Column, query: list[str], limit: int | None = 20) -> DataFrame:
    """(id, score): documents that hold all terms of the query, best first, ties by id.

    Only the query's terms leave the scan: every document keeps its length and the counts of these
    terms, one pass and no shuffle of postings; corpus statistics are one row.
    """
    terms = list(dict.fromkeys(query))
    rows = docs.select(F.col(id_col).alias("id"), toks.alias("t"))
    counted = rows.select("id", F.size("t").alias("length"), *(_times(q).alias(f"tf{i}") for i, q in enumerate(terms)))
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    whole = stats.first()  # one row of counts
    hit = counted.filter(" and ".join(f"tf{i} > 0" for i in range(len(terms))) or "false")
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), whole[f"df{i}"]
        idf = log(1 + (whole["n"] - df + 0.5) / (df + 0.5))
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(whole["mean"] or 1.0)))
    ranked = hit.select("id", F.round(score, 6).alias("score"))
    return ranked.orderBy(F.desc("score"), "id").limit(limit) if limit else ranked


def phrase(posted: DataFrame, query: list[str]) -> DataFrame:
    """(id, starts): where the terms stand one after the other."""
    wanted = posted.filter(F.col("term").isin(query)).select("id", "term", "positions")
    per = wanted.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"))
    for q in query:
        per = per.filter(F.map_contains_key("m", q))
    starts = F.filter(F.col("m")[query[0]], lambda p: F.forall(F.array(*(F.array_contains(F.col("m")[q], p + i) for i, q in enumerate(query))), lambda ok: ok))
    return per.select("id", starts.alias("starts")).filter(F.size("starts") > 0)


def snippet(text: Column, word: str, around: int = 24) -> Column:
    """The text around the first occurrence of a word, the word in brackets, … where text is left out; null without one."""
    at = F.instr(F.lower(text), word.lower())
    start = F.greatest(at - around, F.lit(1))
    end = at + len(word) + around
    body = F.concat(F.substring(text, start, at - start), F.lit("["), F.substring(text, at, F.lit(len(word))), F.lit("]"), F.substring(text, at + len(word), F.lit(around)))
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(F.length(text) >= end, "…").otherwise("")))


def phrase_in(docs: DataFrame, query: list[str]) -> DataFrame:
    """(id, starts) of documents (id, t array of tokens) that hold the terms one after the other; all inside the row."""
    at = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda p: F.forall(F.array(*(F.coalesce(F.get("t", p + i) == F.lit(q), F.lit(False)) for i, q in enumerate(query))), lambda ok: ok))
    return docs.filter(F.size("t") > 0).select("id", at.alias("starts")).filter(F.size("starts") > 0)


def token_snippet(toks: Column, word: str, window: int = 24) -> Column:
    """The window of tokens around the first occurrence of a word, its occurrences in brackets, … where tokens are left out; null without one."""
    at = F.array_position(toks, word)
    start = F.greatest(at - window // 2, F.lit(1).cast("long")).cast("int")
    shown = F.transform(F.slice(toks, start, window), lambda x: F.when(x == word, F.concat(F.lit("["), x, F.lit("]"))).otherwise(x))
    body = F.concat(F.when(start > 1, "… ").otherwise(""), F.array_join(shown, " "), F.when(F.size(toks) > start + window - 1, " …").otherwise(""))
    return F.when(at > 0, body)
