"""Queries that read facts and events out of notices and follow them in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes
from ..operators import extraction as X
from ..operators.components import components
from .linking import _COMPONENTS, _edges
from .relating import LOT, PHASE
from .tables import table
from .tracking import _PUBLISHED


def notice_lots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project").select("id", X.lots("project_name").alias("l")).filter(F.size("l") > 0).select("id", F.array_join("l", ",").alias("lots"))


def core_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project").select("id", X.core(F.col("project_name")).alias("core"))


def kilometre_ranges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project").select("id", F.explode(X.kilometres(F.col("raw_text"))).alias("stretch")).distinct()


def fact_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Facts of several types with where they stand, one row each; empty ones are left out."""
    first = lambda c, p: F.regexp_extract(F.coalesce(c, F.lit("")), p, 1)
    facts = {
        ("phase", "title"): first("project_name", PHASE), ("lot", "title"): first("project_name", LOT), ("number", "field"): F.coalesce("project_no", F.lit("")),
        ("owner", "field"): F.coalesce("owner", F.lit("")), ("owner", "body"): first("raw_text", r"招标人为([^，。；\n]{2,60})"), ("stretch", "body"): first("raw_text", r"(K\d+\+\d+至K\d+\+\d+)"),
        ("period_days", "body"): first("raw_text", r"计划工期(\d+)日历天"), ("approval", "body"): first("raw_text", r"预算批复(\d+)号"), ("funding", "body"): first("raw_text", r"建设资金来自([^，。；\n]{2,20})"),
    }
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("fact_type"), F.lit(s).alias("source"), v.alias("value")) for (t, s), v in facts.items()))).alias("f")
    return table(spark, d, "project").select(F.col("id").alias("notice_id"), each).select("notice_id", "f.fact_type", "f.source", "f.value").filter("value <> ''")


def fact_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = fact_extraction(spark, d)
    return rows.groupBy("fact_type", "source").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"))


def owner_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """Notices whose text names another owner than their field."""
    rows = fact_extraction(spark, d).filter("fact_type = 'owner'").groupBy("notice_id").pivot("source", ["field", "body"]).agg(F.first("value"))
    return rows.filter("field is not null and body is not null and field <> body")


def event_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "project").select("id", X.event_date(F.col("raw_text"), F.col("publish_date")).alias("e"))
    return rows.select("id", "e.day", "e.source")


def events(spark: SparkSession, d: str) -> DataFrame:
    """One event a notice and product, or a general one, with a key that doesn't hold its date."""
    product = F.explode(F.when(F.size("matched_products") > 0, F.col("matched_products")).otherwise(F.array(F.lit("")))).alias("product")
    rows = table(spark, d, "project").select("id", "owner", F.col("project_stage").alias("event_type"), product)
    return rows.select("id", "event_type", "product", X.event_key(F.col("owner"), F.col("id"), F.col("event_type"), F.col("product")).alias("event_key"))


def owner_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Each owner's notices in time with the days since the one before."""
    rows = table(spark, d, "project").filter("owner <> ''").select("owner", "id", "project_stage", "created_at")
    return changes.numbered(rows, "owner", "created_at", "id").select("owner", "id", "n", "project_stage", F.date_diff("created_at", "before").alias("days_since"))


def cluster_view(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of notices with their size, members, sources and span of time."""
    members = components(_edges(spark, d)).join(table(spark, d, "project").select(F.col("id").alias("node"), "source_site", "created_at"), "node")
    return members.groupBy("root").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("members"), F.count_distinct("source_site").alias("sites"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a report, ready for a text sink: one a notice of at least 60 points."""
    rows = table(spark, d, "project").filter("ai_score >= 60")
    title = T.file_name(F.col("project_name"))
    return rows.select("id", F.format_string("- [%d] %s (%s): %s", F.col("ai_score"), title, F.coalesce("source_site", F.lit("?")), F.coalesce(F.nullif("owner", F.lit("")), F.lit("-"))).alias("line"))


QUERIES = {
    f.__name__: f
    for f in (notice_lots, core_names, kilometre_ranges, fact_extraction, fact_statistics, owner_disagreements, event_dates, events, owner_timeline, cluster_view, report_lines)
}

_FACTS = (
    "WITH f AS (SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT id AS notice_id, '{t}' AS fact_type, '{s}' AS source, {v} AS value FROM project"
        for t, s, v in (
            ("phase", "title", f"regexp_extract(coalesce(project_name, ''), '{PHASE}', 1)"), ("lot", "title", f"regexp_extract(coalesce(project_name, ''), '{LOT}', 1)"), ("number", "field", "coalesce(project_no, '')"),
            ("owner", "field", "coalesce(owner, '')"), ("owner", "body", r"regexp_extract(coalesce(raw_text, ''), '招标人为([^，。；\n]{2,60})', 1)"), ("stretch", "body", r"regexp_extract(coalesce(raw_text, ''), '(K\d+\+\d+至K\d+\+\d+)', 1)"),
            ("period_days", "body", r"regexp_extract(coalesce(raw_text, ''), '计划工期(\d+)日历天', 1)"), ("approval", "body", r"regexp_extract(coalesce(raw_text, ''), '预算批复(\d+)号', 1)"), ("funding", "body", r"regexp_extract(coalesce(raw_text, ''), '建设资金来自([^，。；\n]{2,20})', 1)"),
        )
    )
    + ") WHERE value <> '')"
)
_STATED = r"regexp_replace(regexp_replace(regexp_extract(coalesce(raw_text, ''), '(?:发布时间|更新时间|开标时间)[：:]\s*(\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?)', 1), '[年月/.]', '-', 'g'), '日$', '')"
SQL = {
    "core_names": "SELECT id, CASE WHEN regexp_extract(project_name, '^(.{4,}(?:项目|工程)).*(?:采购|租赁|分包|招标|公告|公示|计划).*$', 1) <> '' THEN regexp_extract(project_name, '^(.{4,}(?:项目|工程)).*(?:采购|租赁|分包|招标|公告|公示|计划).*$', 1) ELSE coalesce(project_name, '') END AS core FROM project",
    "kilometre_ranges": r"SELECT DISTINCT id, regexp_replace(unnest(regexp_extract_all(raw_text, '(K\d+\+\d+\s*(?:至|～|~|-)\s*K\d+\+\d+)', 1)), '\s*(?:至|～|~)\s*', '-', 'g') AS stretch FROM project",
    "fact_extraction": _FACTS + "SELECT * FROM f",
    "fact_statistics": _FACTS + "SELECT fact_type, source, count(*) AS n, count(DISTINCT value) AS distinct_values FROM f GROUP BY 1, 2",
    "owner_disagreements": _FACTS + "SELECT a.notice_id, a.value AS field, b.value AS body FROM f a JOIN f b ON a.notice_id = b.notice_id AND a.fact_type = 'owner' AND b.fact_type = 'owner' AND a.source = 'field' AND b.source = 'body' WHERE a.value <> b.value",
    "event_dates": f"""
SELECT id, coalesce(s, p) AS day, CASE WHEN s IS NOT NULL THEN 'TEXT' WHEN p IS NOT NULL THEN 'PUBLISHED' ELSE 'UNKNOWN' END AS source
FROM (SELECT id, CAST(try_strptime({_STATED}, '%Y-%m-%d') AS DATE) AS s, {_PUBLISHED} AS p FROM project)""",
    "events": r"""
SELECT id, event_type, product, sha256('["' || concat_ws('","', replace(replace(coalesce(owner, ''), '\', '\\'), '"', '\"'), CAST(id AS VARCHAR), coalesce(event_type, ''), product) || '"]') AS event_key
FROM (SELECT id, owner, project_stage AS event_type, unnest(CASE WHEN len(matched_products) > 0 THEN matched_products ELSE [''] END) AS product FROM project)""",
    "owner_timeline": """
SELECT owner, id, CAST(row_number() OVER w AS INTEGER) AS n, project_stage, CAST(date_diff('day', CAST(lag(created_at) OVER w AS DATE), CAST(created_at AS DATE)) AS INTEGER) AS days_since
FROM project WHERE owner <> '' WINDOW w AS (PARTITION BY owner ORDER BY created_at, id)""",
    "cluster_view": _COMPONENTS + "SELECT root, count(*) AS n, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members, count(DISTINCT source_site) AS sites, min(created_at) AS first_at, max(created_at) AS last_at FROM comp JOIN project ON id = node GROUP BY 1",
    "report_lines": r"""
SELECT id, printf('- [%d] %s (%s): %s', ai_score, substring(trim(regexp_replace(coalesce(project_name, ''), '[\\/:*?"<>|\x00-\x1f]+', '_', 'g'), ' '), 1, 180), coalesce(source_site, '?'), coalesce(nullif(owner, ''), '-')) AS line FROM project WHERE ai_score >= 60""",
}
