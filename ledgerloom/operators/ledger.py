"""Ledgers that are only appended to: runs from begin to finish, attachments and their states, feedback.

Each entry is a row; the state of a key is the fold of its rows in their order, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runs(events: DataFrame) -> DataFrame:
    """(run_id, source_id, started_at, finished_at, status, error) of run events.

    events: (seq, run_id, source_id, kind, at, status, error), kind BEGIN or FINISH. A run that was
    begun and not finished is RUNNING; the first BEGIN and the last FINISH count; a FINISH alone has
    no start. Errors of partial runs are kept, those of good ones dropped.
    """
    begin, finish = F.col("kind") == "BEGIN", F.col("kind") == "FINISH"
    last = F.max(F.when(finish, F.struct("seq", "at", "status", "error")))
    out = events.groupBy("run_id").agg(F.min(F.when(begin, F.struct("seq", "at", "source_id"))).alias("b"), last.alias("f"), F.first("source_id", ignorenulls=True).alias("any"))
    status = F.when(F.col("f").isNull(), "RUNNING").otherwise(F.coalesce("f.status", F.lit("success")))
    return out.select("run_id", F.coalesce("b.source_id", "any").alias("source_id"), F.col("b.at").alias("started_at"), F.col("f.at").alias("finished_at"), status.alias("status"), F.when(status != "success", F.coalesce("f.error", F.lit(""))).otherwise("").alias("error"))


#: States of an attachment that a later discovery of the same address leaves as they are.
SETTLED = ("DOWNLOADED", "PARSED", "PURGED")


def attachments(events: DataFrame) -> DataFrame:
    """(notice_id, url, file_name, status, error, versions): the attachments of notices.

    events: (seq, notice_id, url, file_name, status, error). The last name and status count, but a
    new discovery (PENDING) doesn't undo a settled state. Null addresses are left out.
    """
    rows = events.filter("url is not null")
    pending = F.col("status") == "PENDING"
    done = F.max(F.when(F.col("status").isin(*SETTLED) | ~pending, F.struct("seq", "status", "error")))
    out = rows.groupBy("notice_id", "url").agg(F.max_by("file_name", "seq").alias("file_name"), done.alias("d"), F.max(F.when(pending, F.col("seq"))).alias("p"), F.count("*").alias("versions"))
    again = (F.col("d.status") == "FAILED") & (F.col("p") > F.col("d.seq"))
    return out.select("notice_id", "url", "file_name", F.when(F.col("d").isNull() | again, "PENDING").otherwise(F.col("d.status")).alias("status"), F.when(F.col("d").isNull() | again, "").otherwise(F.coalesce("d.error", F.lit(""))).alias("error"), "versions")


def feedback(entries: DataFrame, notices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) feedback: (seq, notice_id, verdict, note) on notices that exist, with a known verdict."""
    known = entries.join(notices.select(F.col("id").alias("notice_id"), F.lit(True).alias("there")).distinct(), "notice_id", "left")
    why = F.when(F.col("there").isNull(), "no such notice").when(~F.coalesce(F.col("verdict").isin("USEFUL", "USELESS", "WRONG"), F.lit(False)), "no such verdict")
    tagged = known.select("seq", "notice_id", "verdict", F.coalesce("note", F.lit("")).alias("note"), why.alias("reason"))
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null")
