"""Lines repeated across one site's documents (problem 7).

PrefixSpan over the sequences of line identifiers of each source. A line's identifier is a 64-bit
hash of the line after dropping blanks at both ends and taking every run of digits as one. Patterns
grow by one line a level, from projected sequences that are first merged where equal, so a site
whose thousands of documents carry the same furniture costs one row a distinct furniture sequence.

Every line of a frequent sequence is frequent itself, and single lines are sequences, so sequences of
more lines than ``longest`` add no line to what is deleted; they only lengthen the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import BLANKS, checkpointed, small

MIN_DOCUMENTS = 5
MIN_SHARE = 20  # one document in so many


def line_keys(text: Column) -> Column:
    """Identifiers of the lines of a text, null for blank ones. Digits are taken as one over the whole text at once."""
    return F.transform(F.split(F.regexp_replace(text, r"\p{Nd}+", "0"), "\n"), lambda x: F.when(F.btrim(x, F.lit(BLANKS)) != "", F.xxhash64(F.btrim(x, F.lit(BLANKS)))))


def with_lines(docs: DataFrame, id_col: str, source: str, text: str) -> DataFrame:
    """(id, source, lines): the identifiers of all lines; rows without source or text have none."""
    return docs.filter(F.col(source).isNotNull() & (F.col(text) != "")).select(
        F.col(id_col).alias("id"), F.col(source).alias("source"), line_keys(F.col(text)).alias("lines")
    )


def support_needed(lines: DataFrame) -> DataFrame:
    return lines.groupBy("source").agg(F.count("*").alias("n")).select("source", F.greatest(F.lit(MIN_DOCUMENTS), F.ceil(F.col("n") / MIN_SHARE)).alias("least"))


def frequent_lines(lines: DataFrame, least: DataFrame) -> DataFrame:
    """Level 1: (source, line, support), support in distinct documents."""
    held = lines.select("source", F.explode(F.array_distinct(F.array_compact("lines"))).alias("line"))
    return held.groupBy("source", "line").agg(F.count("*").alias("support")).filter(F.col("support") >= MIN_DOCUMENTS).join(least, "source").filter(F.col("support") >= F.col("least")).select("source", "line", "support")


def repeated(docs: DataFrame, id_col: str = "id", source: str = "source_site", text: str = "raw_text") -> DataFrame:
    """(id, line_no) of every line that its source repeats; line_no counts from 1.

    Null and empty texts and rows without a source give no rows; an empty table gives an empty
    result. Documents given twice count twice, as two documents. The lines are those of all
    sequences that PrefixSpan finds frequent, single ones included.
    """
    lines = with_lines(docs, id_col, source, text)
    often = small(frequent_sequences(docs, id_col, source, text).select("source", F.explode("sequence").alias("line")).distinct())
    at = lines.select("id", "source", F.posexplode("lines").alias("at", "line")).filter("line is not null")
    return at.join(often, ["source", "line"], "left_semi").select("id", (F.col("at") + 1).alias("line_no"))


def without_repeated(docs: DataFrame, id_col: str = "id", source: str = "source_site", text: str = "raw_text") -> DataFrame:
    """(id, text) of all rows, the repeated lines taken out; null stays null, other lines stay as they are."""
    gone = repeated(docs, id_col, source, text).groupBy("id").agg(F.collect_list("line_no").alias("gone"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i + 1)), "\n")
    plain = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return plain.join(gone, "id", "left").select("id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))


def frequent_sequences(docs: DataFrame, id_col: str = "id", source: str = "source_site", text: str = "raw_text", longest: int = 3) -> DataFrame:
    """PrefixSpan: (source, sequence array<long>, support) of the frequent line sequences.

    A document holds a sequence if its lines occur in that order, others between them or not.
    ``longest`` bounds the length of the patterns reported, not the documents looked at.
    """
    lines = with_lines(docs, id_col, source, text)
    least = support_needed(lines)
    often = frequent_lines(lines, least)
    bare = lines.select("id", "source", F.posexplode("lines").alias("at", "line")).join(often.select("source", "line"), ["source", "line"], "left_semi")
    rows = bare.groupBy("id", "source").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("s"))
    rows = checkpointed(rows.select("source", F.col("s.line").alias("rest")).groupBy("source", "rest").agg(F.count("*").alias("w")))
    found = often.select("source", F.array("line").alias("sequence"), "support")
    state = rows.withColumn("sequence", F.array().cast("array<bigint>"))
    for size in range(1, longest + 1):
        grown = state.withColumn("line", F.explode(F.array_distinct("rest"))).select(
            "source", F.concat("sequence", F.array("line")).alias("sequence"), F.expr("slice(rest, array_position(rest, line) + 1, size(rest))").alias("rest"), "w"
        )
        often = grown.groupBy("source", "sequence").agg(F.sum("w").alias("support")).join(least, "source").filter("support >= least").select("source", "sequence", "support")
        if size > 1:
            found = found.unionByName(often)
        if size < longest:
            grown = grown.filter(F.size("rest") > 0).groupBy("source", "sequence", "rest").agg(F.sum("w").alias("w"))
            state = grown.join(often.select("source", "sequence"), ["source", "sequence"], "left_semi")
    return found
