from datetime import date

from ledgerloom.operators import extraction as X
from ledgerloom.operators import facts
from ledgerloom.store import Store
from pyspark.sql import functions as F


def test_snapshots_and_upserts(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.versions("t") == [] and store.read("t") is None
    a = spark.createDataFrame([("u", 1, "old"), ("v", 2, None)], "url string, id long, name string")
    b = spark.createDataFrame([("u", 9, None), ("w", 3, "new")], "url string, id long, name string")
    assert store.upsert("t", a, ["url"], "id") == 1 and store.upsert("t", b, ["url"], "id") == 2
    assert rows(store.read("t")) == [("u", 1, None), ("v", 2, None), ("w", 3, "new")] and rows(store.read("t", 1)) == [("u", 1, "old"), ("v", 2, None)]
    assert store.read("t", 7) is None
    assert rows(store.difference("t", ["url"], 1, 2)) == [("u", "CHANGED"), ("w", "ADDED")]
    (tmp_path / "t" / "v=3").mkdir()  # a write that never ended
    assert store.versions("t") == [1, 2] and store.write("t", a) == 3
    store.append("t", a)
    store.append("t", b)
    assert store.history("t").count() == 4


def test_lots():
    want = {"第1-3标段施工": ["1", "2", "3"], "一、二、四标段": ["1", "2", "4"], "SG-02标": ["SG-2"], "2#标段": ["2"], "第二标段及第二标段": ["2"], "1-3标段和5标段": ["1", "2", "3", "5"], "3-1标段": [], "TJ-1标至TJ-3标": ["TJ-1", "TJ-3"], "II标段": ["2"], "无": [], "": [], None: []}
    assert {k: X.lots_of(k) for k in want} == want


def test_cores_dates_and_keys(spark):
    df = spark.createDataFrame([("某河段治理工程施工招标公告", "发布时间：2025年1月3日", "2025-02-01", 'a"b'), ("工程公告", None, "2025/2/1", None), (None, "x", None, "\\")], "name string, t string, p string, k string")
    r = df.select(X.core(F.col("name")).alias("c"), X.event_date(F.col("t"), F.col("p")).alias("e"), X.event_key(F.col("k"), F.lit(1)).alias("k"), X.kilometres(F.lit("K1+2 至 K3+4与K5+6-K7+8")).alias("km")).collect()
    assert [x.c for x in r] == ["某河段治理工程", "工程公告", ""]
    assert [tuple(x.e) for x in r] == [(date(2025, 1, 3), "TEXT"), (date(2025, 2, 1), "PUBLISHED"), (None, "UNKNOWN")]
    assert r[0].km == ["K1+2-K3+4", "K5+6-K7+8"] and len({x.k for x in r}) == 3
    import hashlib
    import json

    assert [x.k for x in r] == [hashlib.sha256(json.dumps([k, "1"], separators=(",", ":")).encode()).hexdigest() for k in ('a"b', "", "\\")]


def test_preview_writes_nothing(spark, rows):
    f = spark.createDataFrame([(1, 1, "t", "A", "s", 0.9, 1, False), (2, 2, "t", "B", "s", 0.9, 1, False)], "id long, notice_id long, fact_type string, value string, source string, confidence double, source_rank int, confirmed boolean")
    none = spark.createDataFrame([], "review_id long, notice_id long, fact_type string, value string, source string, action string")
    more = spark.createDataFrame([(1, 1, "t", "Z", "h", "OVERRIDE"), (2, 2, "t", "B", "s", "CONFIRM")], none.schema)
    assert rows(facts.preview(f, none, more)) == [(1, "t", "A", "Z")]


def test_differences_by_field(spark, rows):
    a = spark.createDataFrame([(1, "x", None), (2, "x", "y"), (3, None, None)], "k long, a string, b string")
    b = spark.createDataFrame([(1, "x", "n"), (2, "z", None), (4, None, "q")], "k long, a string, b string")
    assert rows(facts.difference(a, b, "k", ["a", "b"])) == [("a", 0, 0, 1, 3), ("b", 2, 1, 0, 1)]
