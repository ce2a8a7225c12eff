"""Report tables: the daily report, listings and indexes, as rows that a sink writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grouping
from . import tracking
from .tables import table


def daily_report(spark: SparkSession, d: str) -> DataFrame:
    """Notices of each day and status that score at least 30, with what the report prints of them."""
    status = tracking.cdc_daily_rollup(spark, d).select(F.col("notice_id").alias("id"), "day", "status")
    rows = table(spark, d, "project").filter("ai_score >= 30").select("id", "project_name", "owner", "ai_score")
    return status.filter("status <> 'SEEN_AGAIN'").join(rows, "id")


def daily_report_counts(spark: SparkSession, d: str) -> DataFrame:
    return tracking.cdc_daily_rollup(spark, d).groupBy("day", "status").agg(F.count("*").alias("n"))


def listing_by_site(spark: SparkSession, d: str) -> DataFrame:
    """One index a site: how many notices, the products named, the newest."""
    rows = table(spark, d, "project")
    newest = F.max_by("project_name", F.struct("created_at", "id"))
    return rows.groupBy("source_site").agg(F.count("*").alias("n"), newest.alias("newest"), F.count_if(F.size("matched_products") > 0).alias("with_products"))


def listing_by_region(spark: SparkSession, d: str) -> DataFrame:
    region = T.first_label(F.col("region"), {"北京": ["北京"], "天津": ["天津"], "河北": ["河北"]}, "其他")
    rows = table(spark, d, "project").select(region.alias("region"), "project_stage", "id")
    return rows.groupBy("region").pivot("project_stage", ["招标计划", "资格预审公告", "施工招标公告", "竞争性谈判采购公告", "中标候选人公示", "中标结果公告"]).agg(F.count("id"))


def source_report(spark: SparkSession, d: str) -> DataFrame:
    """Each source's best status and its errors, listed."""
    from ..operators.changes import best_status

    rows = table(spark, d, "source_run")
    return rows.groupBy("source_id").agg(best_status(F.col("status"), tracking.STATUS_ORDER).alias("best"), grouping.sorted_list(F.nullif("error", F.lit("")), "；").alias("errors"), F.count("*").alias("runs"))


QUERIES = {f.__name__: f for f in (daily_report, daily_report_counts, listing_by_site, listing_by_region, source_report)}

_DAILY = tracking.SQL["cdc_daily_rollup"].strip()
SQL = {
    "daily_report": f"SELECT p.id, d.day, d.status, p.project_name, p.owner, p.ai_score FROM ({_DAILY}) d JOIN project p ON p.id = d.notice_id WHERE d.status <> 'SEEN_AGAIN' AND p.ai_score >= 30",
    "daily_report_counts": f"SELECT day, status, count(*) AS n FROM ({_DAILY.replace('count(*) AS n', 'count(*) AS m')}) GROUP BY 1, 2",
    "listing_by_site": "SELECT source_site, count(*) AS n, arg_max(project_name, (created_at, id)) AS newest, count(*) FILTER (len(matched_products) > 0) AS with_products FROM project GROUP BY 1",
    "listing_by_region": """
SELECT CASE WHEN contains(coalesce(region, ''), '北京') THEN '北京' WHEN contains(coalesce(region, ''), '天津') THEN '天津' WHEN contains(coalesce(region, ''), '河北') THEN '河北' ELSE '其他' END AS region,
"""
    + ", ".join(f"nullif(count(*) FILTER (project_stage = '{s}'), 0) AS {s}" for s in ("招标计划", "资格预审公告", "施工招标公告", "竞争性谈判采购公告", "中标候选人公示", "中标结果公告"))
    + " FROM project GROUP BY 1",
    "source_report": f"SELECT source_id, arg_min(status, {tracking._RANK}) AS best, coalesce(string_agg(DISTINCT nullif(error, ''), '；' ORDER BY nullif(error, '')), '') AS errors, count(*) AS runs FROM source_run GROUP BY 1",
}
