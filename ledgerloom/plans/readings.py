"""Queries that read notices back from pages made of them: list pages, detail pages, attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import details, html, listings
from .tables import table

FIELDS = {"tenderer": r"招标人为\s*(\S[^，\n]*)", "number": r"项目编号[：:]\s*([A-Za-z0-9_-]+)"}
SINCE, WANTED, DIRECTION = "2025-03-01", "公告", "管片|箱梁|顶管|沉箱"


def _escaped(c: str):
    text = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(list pages, detail pages) of the notices; a detail page has a head, the article and a foot."""
    rows = table(spark, d, "project")
    address = F.concat(F.lit("/d/"), "id", F.lit(".html"))
    lists = rows.select(F.lit("https://list.test/").alias("url"), F.concat(F.lit("<ul><li><a href='"), address, F.lit("'>公告 "), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, "计划").otherwise("公告"), F.lit("</a><span>"), F.date_format("created_at", "yyyy-MM-dd"), F.lit("</span></li></ul>")).alias("html"))
    body = F.concat(F.lit("<html><body><div class='head'>沉箱 menu</div><div class='big newsCon'><p>项目编号："), F.col("id").cast("string"), F.lit("-A</p><script>x</script><p>招标人为 甲"), F.col("id").cast("string"), F.lit(" & 乙，</p><p>"), F.replace(_escaped("raw_text"), F.lit("\n"), F.lit("<br>")), F.lit("</p></div><div>foot</div></body></html>"))
    return lists, rows.select(F.concat(F.lit("https://list.test"), address).alias("url"), body.alias("html"))


def collector_notices(spark: SparkSession, d: str) -> DataFrame:
    notices, _ = details.collected(*_pages(spark, d), SINCE, WANTED + "$", DIRECTION, ["newsCon"], ["head"], FIELDS)
    return notices.select("url", "date", "project_name", "tenderer", "number")


def collector_funnel(spark: SparkSession, d: str) -> DataFrame:
    _, funnel = details.collected(*_pages(spark, d), SINCE, WANTED + "$", DIRECTION, ["newsCon"], ["head"], FIELDS)
    return funnel


def address_dates(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://h.test/"), F.date_format("created_at", "yyyyMM/dd"), F.lit("/x"), F.col("id").cast("string"), F.lit(".html"))
    return table(spark, d, "project").select("id", details.date_in_address(url).alias("day"))


def reply_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What the replies of runs were, by their status as a code and their error as a page."""
    code = F.when(F.col("status") == "success", 200).when(F.col("status") == "partial", 429).when(F.col("status") == "warning", 403).otherwise(502)
    rows = table(spark, d, "source_run").select("id", listings.response_kind(code, F.col("source_name"), F.col("error")).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def api_notices(spark: SparkSession, d: str) -> DataFrame:
    """Notices read back from JSON replies, the number standing in where a name is missing."""
    cell = F.struct(F.col("project_no").alias("no"), F.when(F.col("id") % 2 == 0, F.col("project_name")).alias("name"), F.col("id"))
    body = F.to_json(F.struct(F.when(F.col("id") % 5 == 0, 1).otherwise(0).alias("code"), F.struct(F.array(cell).alias("rows")).alias("data")))
    replies = table(spark, d, "project").select(body.alias("body"))
    return listings.from_api(replies, "body", 0, "rows", "no string, name string, id long", {"id": ["id"], "project_name": ["name", "no"]})


def unioned_scans(spark: SparkSession, d: str) -> DataFrame:
    """Two scans of one site's notices, the later one replacing what the earlier one had of an address."""
    rows = table(spark, d, "project").select("id", "url", F.col("project_name").alias("name"))
    return listings.union_last_wins([rows.filter("id % 3 <> 0"), rows.filter("id % 2 = 0").withColumn("name", F.lit("again"))], ["url"])


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Attachments of pages that link a notice's files, a download, and a page of its own."""
    n = F.col("id").cast("string")
    page = F.concat(F.lit("<a href='f/"), n, F.lit(".pdf#p'>图纸</a><a href='/download?id="), n, F.lit("'>招标文件下载</a><a href='/x?id="), n, F.lit("'>下载中心</a>"))
    rows = table(spark, d, "project").select(F.concat(F.lit("https://h.test/n/"), n, F.lit("/")).alias("url"), page.alias("html"))
    return html.links(rows).select("page_url", "url", "title")


QUERIES = {f.__name__: f for f in (collector_notices, collector_funnel, address_dates, reply_kinds, api_notices, unioned_scans, page_links)}

_PAGES = f"""
WITH p AS (SELECT id, 'https://list.test/d/' || id || '.html' AS url, strftime(created_at, '%Y-%m-%d') AS date, '公告 ' || id || CASE WHEN id % 3 = 0 THEN '计划' ELSE '公告' END AS project_name,
    regexp_matches(replace(coalesce(raw_text, ''), chr(10), chr(10)), '{DIRECTION}') AS fits FROM project),
s AS (SELECT *, date >= '{SINCE}' AS recent, id % 3 <> 0 AS titled FROM p)
"""
SQL = {
    "collector_notices": _PAGES + "SELECT url, date, project_name, '甲' || id || ' & 乙' AS tenderer, id || '-A' AS number FROM s WHERE recent AND titled AND fits",
    "collector_funnel": _PAGES + """SELECT 'listed' AS step, count(*) AS n FROM s UNION ALL SELECT 'recent', count(*) FILTER (recent) FROM s UNION ALL SELECT 'titled', count(*) FILTER (recent AND titled) FROM s
UNION ALL SELECT 'detailed', count(*) FILTER (recent AND titled) FROM s UNION ALL SELECT 'kept', count(*) FILTER (recent AND titled AND fits) FROM s""",
    "address_dates": "SELECT id, CAST(created_at AS DATE) AS day FROM project",
    "reply_kinds": """
WITH c AS (SELECT CASE status WHEN 'success' THEN 200 WHEN 'partial' THEN 429 WHEN 'warning' THEN 403 ELSE 502 END AS code, lower(concat_ws(chr(10), source_name, error)) AS t FROM source_run)
SELECT CASE WHEN code = 429 OR regexp_matches(t, 'too many requests|访问频繁|请求过于频繁') THEN 'RATE_LIMIT' WHEN code = 403 OR regexp_matches(t, 'cloudwaf|访问被拦截|疑似攻击行为') THEN 'WAF'
    WHEN regexp_matches(t, '登录状态已失效|请登录|重新登录') THEN 'AUTH_EXPIRED' WHEN code >= 500 THEN 'UPSTREAM_BROKEN' ELSE 'OK' END AS kind, count(*) AS n FROM c GROUP BY 1""",
    "api_notices": "SELECT CAST(id AS VARCHAR) AS id, coalesce(nullif(CASE WHEN id % 2 = 0 THEN trim(project_name, ' ') END, ''), nullif(trim(project_no, ' '), '')) AS project_name FROM project WHERE id % 5 <> 0",
    "unioned_scans": "SELECT url, id, CASE WHEN id % 2 = 0 THEN 'again' ELSE project_name END AS name FROM project WHERE id % 3 <> 0 OR id % 2 = 0",
    "page_links": "SELECT 'https://h.test/n/' || id || '/' AS page_url, 'https://h.test/n/' || id || '/f/' || id || '.pdf' AS url, '图纸' AS title FROM project UNION ALL SELECT 'https://h.test/n/' || id || '/', 'https://h.test/download?id=' || id, '招标文件下载' FROM project",
}
