"""Listings that need no parser: API replies, rows of cells, windows of text lines, registries of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOTICE = "project_name string, project_no string, publish_date string, region string, owner string, tenderer string, source_site string, url string, raw_text string"


def from_api(replies: DataFrame, body: str, ok_code: int, rows_at: str, row_schema: str, fields: dict[str, list[str]]) -> DataFrame:
    """Rows of JSON replies {code, data: {<rows_at>: [...]}}: each field is the first of its names that isn't empty.

    Replies with another code, or that aren't JSON, give no rows.
    """
    schema = f"code int, data struct<{rows_at}: array<struct<{row_schema}>>>"
    parsed = replies.select("*", F.from_json(body, schema).alias("_j")).filter(F.col("_j.code") == ok_code)
    each = parsed.select(*replies.columns, F.explode(F.col(f"_j.data.{rows_at}")).alias("_r"))

    def first(names: list[str]) -> Column:
        return F.coalesce(*(F.nullif(F.trim(F.col(f"_r.{n}").cast("string")), F.lit("")) for n in names))

    return each.select(*(c for c in replies.columns if c != body), *(first(names).alias(f) for f, names in fields.items()))


def from_cells(rows: DataFrame, cells: str, positions: dict[str, int], least: int) -> DataFrame:
    """Rows of table cells (array<string>) as columns; shorter rows are left out."""
    kept = rows.filter(F.size(cells) >= least)
    return kept.select(*(F.trim(F.get(F.col(cells), F.lit(i))).alias(name) for name, i in positions.items()))


def from_lines(texts: DataFrame, id_col: str, text: str, date_pattern: str = r"^(20\d{2}[-./年]\d{1,2}[-./月]\d{1,2}日?)$") -> DataFrame:
    """(id, date, title, region, tenderer): each line that is a date, with the three non-blank lines before it."""
    lines = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("pos", "line")).select("id", "pos", F.trim("line").alias("line")).filter("line <> ''")
    w = Window.partitionBy("id").orderBy("pos")
    lagged = lines.withColumns({"title": F.lag("line", 3).over(w), "region": F.lag("line", 2).over(w), "tenderer": F.lag("line", 1).over(w)})
    return lagged.filter(F.col("line").rlike(date_pattern)).select("id", F.col("line").alias("date"), "title", "region", "tenderer")


def union_last_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of scans in which later ones replace earlier rows of the same key."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    whole = tagged[0]
    for p in tagged[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    rest = [c for c in whole.columns if c not in (*keys, "_part")]
    top = whole.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_part").alias("r"))
    return top.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def registry_errors(sources: DataFrame, implemented: DataFrame) -> DataFrame:
    """(id, error) of a table of sources (id, enabled): ids given twice, and enabled ones without a reader."""
    twice = sources.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("duplicate id").alias("error"))
    missing = sources.filter("enabled").join(implemented, "id", "left_anti").select("id", F.lit("no reader").alias("error")).distinct()
    return twice.unionByName(missing)


def search_terms(preferred: Column, fallback: Column) -> Column:
    """array<string>: the preferred terms if there are any, else the others; trimmed, each once, in order."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.size(clean(preferred)) > 0, clean(preferred)).otherwise(clean(fallback))


#: Words of pages that limit the rate, block, or ask to log in again.
LIMITED, BLOCKED, EXPIRED = "too many requests|访问频繁|请求过于频繁", "cloudwaf|访问被拦截|疑似攻击行为", "登录状态已失效|请登录|重新登录"


def response_kind(status: Column, title: Column, body: Column) -> Column:
    """What a stored reply is, the first that holds: RATE_LIMIT, WAF, AUTH_EXPIRED, UPSTREAM_BROKEN, ERROR, OK. A null status is an error."""
    text = F.lower(F.concat_ws("\n", title, body))
    code = F.coalesce(status, F.lit(0))
    return (
        F.when((code == 429) | text.rlike(LIMITED), "RATE_LIMIT").when(code.isin(403, 418) | text.rlike(BLOCKED), "WAF").when(text.rlike(EXPIRED), "AUTH_EXPIRED")
        .when(code >= 500, "UPSTREAM_BROKEN").when((code >= 400) | (code == 0), "ERROR").otherwise("OK")
    )


def sample_notices(spark: SparkSession, sites: list[str]) -> DataFrame:
    """One fixed notice a site, for trying a pipeline out."""
    rows = [(f"{s}示例工程施工招标公告", f"2025-{i:06d}", "2025-03-01", "北京市", "示例业主", None, s, f"https://example.test/{i}", "示例工程采用预制管片。") for i, s in enumerate(sites)]
    return spark.createDataFrame(rows, NOTICE)
