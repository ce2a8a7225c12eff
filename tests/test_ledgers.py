"""Ledgers folded from their entries, versions of events, coverage of lives."""

from ledgerloom.operators import ledger, lifecycle
from pyspark.sql import functions as F


def test_runs(spark, rows):
    events = [(1, 1, "a", "BEGIN", "t1", None, None), (2, 1, "a", "FINISH", "t2", "partial", "e"), (3, 2, "a", "BEGIN", "t3", None, None), (4, 3, "b", "FINISH", "t4", None, "x"), (5, 1, "a", "FINISH", "t5", "success", "old"), (6, 4, "b", "BEGIN", "t6", None, None), (7, 4, "b", "FINISH", "t7", "failed", None)]
    df = spark.createDataFrame(events, "seq long, run_id long, source_id string, kind string, at string, status string, error string")
    assert rows(ledger.runs(df)) == [(1, "a", "t1", "t5", "success", ""), (2, "a", "t3", None, "RUNNING", ""), (3, "b", None, "t4", "success", ""), (4, "b", "t6", "t7", "failed", "")]
    assert ledger.runs(df.limit(0)).count() == 0


def test_attachments(spark, rows):
    events = [(1, 1, "u", "a.pdf", "PENDING", None), (2, 1, "u", "b.pdf", "PARSED", None), (3, 1, "u", "c.pdf", "PENDING", None), (4, 1, "v", "x", "FAILED", "gone"), (5, 2, "u", "y", "FAILED", "no"), (6, 2, "u", "y", "PENDING", None), (7, 3, None, "z", "PENDING", None), (8, 3, "w", "z", "PENDING", None)]
    df = spark.createDataFrame(events, "seq long, notice_id long, url string, file_name string, status string, error string")
    assert rows(ledger.attachments(df)) == [(1, "u", "c.pdf", "PARSED", "", 3), (1, "v", "x", "FAILED", "gone", 1), (2, "u", "y", "PENDING", "", 2), (3, "w", "z", "PENDING", "", 1)]


def test_feedback(spark, rows):
    notices = spark.createDataFrame([(1, 7), (1, 8)], "id long, note int")
    entries = spark.createDataFrame([(1, 1, "USEFUL", None), (2, 1, "odd", "n"), (3, 9, "WRONG", "n"), (4, None, None, None)], "seq long, notice_id long, verdict string, note string")
    good, bad = ledger.feedback(entries, notices)
    assert rows(good) == [(1, 1, "USEFUL", "")] and rows(bad, "seq", "reason") == [(2, "no such verdict"), (3, "no such notice"), (4, "no such notice")]


def test_versions_and_integrity(spark, rows):
    cols = "event_key string, id long, entity string, event_type string, day string"
    old = spark.createDataFrame([("k1", 1, "e", "WON", "d"), ("k2", 2, "e", "WON", None)], cols).withColumns({"extractor_version": F.lit("v1"), "is_active": F.lit(True)})
    new = spark.createDataFrame([("k1", 5, "e", "PLAN", "d"), ("k3", 7, "", None, None), ("k3", 6, "", None, None)], cols)
    out = lifecycle.versioned(old, new, "v2")
    assert rows(out, "event_key", "id", "event_type", "extractor_version", "is_active") == [("k1", 5, "PLAN", "v2", True), ("k2", 2, "WON", "v1", False), ("k3", 6, None, "v2", True)]
    assert rows(lifecycle.integrity(out.unionByName(out.filter("id = 5")))) == [("k1", "key given twice"), ("k3", "no date"), ("k3", "no entity"), ("k3", "no type")]


def test_coverage_and_kinds(spark, rows):
    df = spark.createDataFrame([("e", "B"), ("e", "B"), ("e", "D"), ("f", "A"), ("g", "Z"), (None, None)], "k string, s string")
    assert rows(lifecycle.coverage(df, "k", "s", ["A", "B", "C", "D"])) == [("e", 2, 0.5, "A,C"), ("f", 1, 0.25, "")]
    kinds = {"WON": "中标结果", "TENDER": "公告"}
    t = spark.createDataFrame([("中标结果公告",), ("招标公告",), (None,)], "t string")
    assert [r.k for r in t.select(lifecycle.first_of(F.col("t"), kinds, "OTHER").alias("k")).collect()] == ["WON", "TENDER", "OTHER"]
