"""Queries on runs, observations and notices as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, validation
from .tables import table

STATUS_ORDER = ["success", "warning", "partial", "failed"]


def _observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notice_observation").select("id", "run_id", "notice_id", "observed_at", "content_hash")


def cdc_daily_rollup(spark: SparkSession, d: str) -> DataFrame:
    # a second write in a run is ignored; flags see all runs, failed ones too; only then are failed runs dropped
    once = changes.once_per_run(_observations(spark, d), "run_id", "notice_id", "id")
    runs = table(spark, d, "source_run").filter("status <> 'failed'").select(F.col("id").alias("run_id"))
    flagged = changes.flags(once, "notice_id", ["run_id", "id"], "content_hash")
    return changes.daily_status(flagged.join(runs, "run_id", "left_semi"), "notice_id", "observed_at")


def cdc_flags(spark: SparkSession, d: str) -> DataFrame:
    once = changes.once_per_run(_observations(spark, d), "run_id", "notice_id", "id")
    return changes.flags(once, "notice_id", ["run_id", "id"], "content_hash").select("id", "run_id", "notice_id", "is_first", "is_changed")


def observation_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Rows inserted twice: the same notice in the same run at the same time."""
    rows = table(spark, d, "notice_observation").groupBy("run_id", "notice_id", "observed_at").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return rows.filter("n > 1")


def source_status_latest(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "source_run").select("source_id", "id", "status", "item_count", "finished_at")
    return changes.latest(runs, ["source_id"], "id")


def source_health_baseline(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "source_run").filter("status = 'success'").select("source_id", "id", F.col("collected_count").cast("double").alias("collected"))
    based = changes.trailing_mean(runs, "source_id", "id", "collected", 7)
    suspect = (F.col("collected") == 0) & (F.col("samples") >= 3) & (F.col("baseline") >= 3)
    return based.select("source_id", "id", "collected", F.round("baseline", 2).alias("baseline"), "samples", suspect.alias("suspect"))


def source_funnel(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "source_run").select("source_id", F.explode("funnel").alias("step", "n"))
    return steps.groupBy("source_id", "step").agg(F.sum("n").alias("total"), F.count("*").alias("runs"))


def source_run_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "source_run")
    return runs.groupBy("source_id").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "success").alias("good"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("collected_count").alias("collected"), F.sum("rejected_count").alias("rejected"), F.count_distinct(F.nullif("error", F.lit(""))).alias("kinds_of_error"),
        F.max("duration_ms").alias("longest_ms"), F.min(F.when(F.col("status") == "success", F.col("started_at"))).alias("first_good"),
    )


def run_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "notice_observation").groupBy("run_id").agg(F.count("*").alias("observed"), F.count_distinct("notice_id").alias("notices"))
    runs = table(spark, d, "source_run").select(F.col("id").alias("run_id"), "item_count")
    both = runs.join(seen, "run_id", "left").fillna(0, ["observed", "notices"])
    return both.withColumn("difference", F.col("observed") - F.coalesce("item_count", F.lit(0)))


def observation_violations(spark: SparkSession, d: str) -> DataFrame:
    """Observations whose run is missing or belongs to another source, or that a run wrote a second time."""
    runs = table(spark, d, "source_run").select(F.col("id").alias("run_id"), F.col("source_id").alias("run_source"))
    rows = table(spark, d, "notice_observation").select("id", "run_id", "notice_id", "source_id")
    first = rows.groupBy("run_id", "notice_id").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    why = F.when(F.col("run_source").isNull(), "no such run").when(F.col("run_source") != F.col("source_id"), "another source").when(F.col("id") > F.col("first"), "second write")
    return rows.join(runs, "run_id", "left").join(first, ["run_id", "notice_id"], "left").select("id", why.alias("violation")).filter("violation is not null")


def business_day_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "notice_observation")
    return rows.groupBy("source_id", F.to_date("observed_at").alias("day")).agg(F.count("*").alias("n"), F.sum("is_first_seen").alias("first_seen"), F.sum("content_changed").alias("changed"))


def validate_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "project").select("id", "project_name", "source_site", "url", "region", "publish_date")
    checks = {
        "no name": F.trim("project_name") != "",
        "no site": F.trim("source_site") != "",
        "bad url": F.col("url").rlike(r"^(?i)https?://[^/\s]+"),
        "bad region": F.col("region").rlike("北京|天津|河北"),
        "bad date": validation.sent_dates(F.col("publish_date")).isNotNull(),
    }
    out = validation.validated(rows, checks, ["source_site", "url"], "id")
    return out.select("id", "accepted", F.array_join("reasons", "; ").alias("reasons"))


def reject_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    out = validate_reject_reasons(spark, d).filter("not accepted")
    return out.select(F.explode(F.split("reasons", "; ")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def publish_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "project").select("id", validation.sent_dates(F.col("publish_date")).alias("published"), "created_at")
    return rows.select("id", "published", F.date_diff("created_at", "published").alias("days_before"))


def recency_filter(spark: SparkSession, d: str) -> DataFrame:
    """Notices published in the 30 days before a given day; others, undated ones too, are left out."""
    day = F.lit("2025-05-01").cast("date")
    rows = table(spark, d, "project").select("id", "source_site", validation.sent_dates(F.col("publish_date")).alias("published"))
    return rows.filter((F.col("published") >= F.date_sub(day, 30)) & (F.col("published") <= day))


CONTENT = ["project_name", "project_no", "publish_date", "region", "owner", "tenderer", "project_stage", "construction_content", "raw_text"]


def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Of the fields as they came, blanks apart; content_fingerprint_normal has the normal form."""
    return table(spark, d, "project").select("id", validation.fingerprint(*map(F.col, CONTENT)).alias("fingerprint"))


def content_fingerprint_normal(spark: SparkSession, d: str) -> DataFrame:
    """Of the fields' business wording: without markup, zero-width characters, compatibility forms and volatile lines."""
    return table(spark, d, "project").select("id", validation.fingerprint(*(validation.normalised(F.col(n)) for n in CONTENT)).alias("fingerprint"))


def upsert_latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "project").select("id", F.col("id").alias("seq"), "source_site", "url", "project_name", "ai_score", "created_at")
    return changes.upserted(rows, ["source_site", "url"], "seq", "id")


def version_differences(spark: SparkSession, d: str) -> DataFrame:
    """Fields that differ between each notice and the earliest one at the same address, protocol and parameters apart."""
    page = F.regexp_replace(F.lower("url"), r"^https?://|[?#].*$", "")
    rows = table(spark, d, "project").select("id", page.alias("url"), "project_name", "owner", "region", "ai_score")
    firsts = rows.groupBy("url").agg(F.min("id").alias("first"))
    later = rows.join(firsts, "url").filter("id > first")
    fields = ["project_name", "owner", "region", "ai_score"]
    old = later.select("id", F.col("first")).join(rows.select(F.col("id").alias("first"), *fields), "first").select("id", *fields)
    return changes.changed_fields(old, later.select("id", *fields), "id", fields).select("id", F.array_join("changed", ",").alias("changed"))


def snapshot_merge_by_url(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "source_run").select(F.col("id").alias("run_id"), "status")
    seen = table(spark, d, "notice_observation").select("run_id", F.col("notice_id").alias("id"), "observed_at", "content_changed").join(runs, "run_id")
    rows = seen.join(table(spark, d, "project").select("id", "url"), "id")
    return rows.groupBy("url").agg(
        F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.max("content_changed").alias("changed"),
        changes.best_status(F.col("status"), STATUS_ORDER).alias("status"), F.count("*").alias("n"),
    )


def recent_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "project").select("id", "project_name", "ai_score", "created_at")
    return rows.orderBy(F.desc_nulls_last("ai_score"), F.desc("created_at"), F.desc("id")).limit(50)


def follow_up_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "project").filter("notice_actionability = 'OPEN' and project_tracking_recommendation = 'ACTIVE_WATCH'")
    rows = rows.select("id", "project_name", validation.sent_dates(F.col("publish_date")).alias("published"), "ai_score")
    return rows.orderBy(F.desc_nulls_last("published"), F.desc_nulls_last("ai_score"), F.desc("id")).limit(30)


def dynamic_predicate_scan(spark: SparkSession, d: str, project_no: str | None = None, site: str | None = "京畿工程交易协同网", least: int | None = 50) -> DataFrame:
    """AND of the conditions that are given; all of them reach the scan."""
    rows = table(spark, d, "project").select("id", "project_no", "source_site", "ai_score")
    for given, condition in ((project_no, F.col("project_no") == project_no), (site, F.col("source_site") == site), (least, F.col("ai_score") >= (least or 0))):
        if given is not None:
            rows = rows.filter(condition)
    return rows


def never_observed(spark: SparkSession, d: str) -> DataFrame:
    """Notices that no successful run has seen."""
    good = table(spark, d, "source_run").filter("status = 'success'").select(F.col("id").alias("run_id"))
    seen = table(spark, d, "notice_observation").join(good, "run_id", "left_semi").select(F.col("notice_id").alias("id"))
    return table(spark, d, "project").select("id", "source_site").join(seen, "id", "left_anti")


def seen_in_failed_runs(spark: SparkSession, d: str) -> DataFrame:
    failed = table(spark, d, "source_run").filter("status in ('failed', 'partial')").select(F.col("id").alias("run_id"))
    seen = table(spark, d, "notice_observation").join(failed, "run_id", "left_semi").select(F.col("notice_id").alias("id"))
    return table(spark, d, "project").select("id", "source_site").join(seen, "id", "left_semi")


def late_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations inserted after a later one of the same source and run."""
    rows = table(spark, d, "notice_observation").select("id", "run_id", "source_id", "observed_at")
    return changes.latest_before(rows, ["run_id", "source_id"], "id", "observed_at").filter("observed_at < latest_before").select("id", "observed_at", "latest_before")


def canonical_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of the canonical JSON (sorted names, no blanks) of the fields' business wording."""
    fields = {("name" if n == "project_name" else "stage" if n == "project_stage" else n): validation.normalised(F.col(n)) for n in CONTENT}
    return table(spark, d, "project").select("id", validation.canonical_fingerprint(fields).alias("fingerprint"))


def first_seen_flags(spark: SparkSession, d: str) -> DataFrame:
    """First observations that are news: the notice wasn't there on a day before it."""
    once = changes.once_per_run(_observations(spark, d), "run_id", "notice_id", "id")
    first = changes.flags(once, "notice_id", ["run_id", "id"], "content_hash").filter("is_first")
    made = table(spark, d, "project").select(F.col("id").alias("notice_id"), "created_at")
    return first.join(made, "notice_id").select("id", "notice_id", (F.to_date("created_at") >= F.to_date("observed_at")).alias("is_news"))


QUERIES = {
    f.__name__: f
    for f in (
        cdc_daily_rollup, cdc_flags, observation_repeats, source_status_latest, source_health_baseline, source_funnel, source_run_summary, run_reconciliation,
        observation_violations, business_day_counts, validate_reject_reasons, reject_reason_counts, publish_dates, recency_filter, content_fingerprint, content_fingerprint_normal,
        upsert_latest_by_key, version_differences, snapshot_merge_by_url, recent_topk, follow_up_topk, dynamic_predicate_scan, never_observed, seen_in_failed_runs, late_observations, canonical_fingerprints, first_seen_flags,
    )
}

_PUBLISHED = r"CASE WHEN regexp_matches(regexp_replace(regexp_replace(trim(publish_date), '[年月/.]', '-', 'g'), '日$', ''), '^\d{4}-\d{1,2}-\d{1,2}$') THEN CAST(try_strptime(regexp_replace(regexp_replace(trim(publish_date), '[年月/.]', '-', 'g'), '日$', ''), '%Y-%m-%d') AS DATE) END"
_SQUASH = r"replace(trim(regexp_replace(coalesce({0}, ''), '[ \t\r\n\f]+', ' ', 'g'), ' '), chr(31), ' ')"
_VALID = rf"""
WITH v AS (SELECT id, source_site, url, list_filter([
    CASE WHEN coalesce(trim(project_name), '') = '' THEN 'no name' END, CASE WHEN coalesce(trim(source_site), '') = '' THEN 'no site' END,
    CASE WHEN NOT coalesce(regexp_matches(url, '^(?i)https?://[^/\s]+'), FALSE) THEN 'bad url' END,
    CASE WHEN NOT coalesce(regexp_matches(region, '北京|天津|河北'), FALSE) THEN 'bad region' END,
    CASE WHEN {_PUBLISHED} IS NULL THEN 'bad date' END], lambda x: x IS NOT NULL) AS own FROM project),
w AS (SELECT *, sum(CASE WHEN len(own) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_site, url ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
r AS (SELECT id, CASE WHEN len(own) = 0 AND before > 0 THEN ['duplicate'] ELSE own END AS reasons FROM w)
"""
_RANK = "CASE status WHEN 'success' THEN 1 WHEN 'warning' THEN 2 WHEN 'partial' THEN 3 WHEN 'failed' THEN 4 ELSE 5 END"

SQL = {
    "cdc_daily_rollup": """
WITH o AS (SELECT * FROM notice_observation QUALIFY row_number() OVER (PARTITION BY run_id, notice_id ORDER BY id) = 1),
f AS (SELECT *, row_number() OVER w = 1 AS is_first, row_number() OVER w > 1 AND lag(content_hash) OVER w IS DISTINCT FROM content_hash AS is_changed
           FROM o WINDOW w AS (PARTITION BY notice_id ORDER BY run_id, id))
SELECT notice_id, CAST(observed_at AS DATE) AS day,
       CASE WHEN bool_or(is_first) THEN 'NEW' WHEN bool_or(is_changed) THEN 'UPDATED' ELSE 'SEEN_AGAIN' END AS status,
       min(observed_at) AS first_at, max(observed_at) AS last_at, count(*) AS n
FROM f WHERE run_id IN (SELECT id FROM source_run WHERE status <> 'failed') GROUP BY 1, 2""",
    "cdc_flags": """
WITH o AS (SELECT * FROM notice_observation QUALIFY row_number() OVER (PARTITION BY run_id, notice_id ORDER BY id) = 1)
SELECT id, run_id, notice_id, row_number() OVER w = 1 AS is_first, row_number() OVER w > 1 AND lag(content_hash) OVER w IS DISTINCT FROM content_hash AS is_changed
FROM o WINDOW w AS (PARTITION BY notice_id ORDER BY run_id, id)""",
    "observation_repeats": "SELECT run_id, notice_id, observed_at, count(*) AS n, min(id) AS first_id FROM notice_observation GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "source_status_latest": "SELECT source_id, id, status, item_count, finished_at FROM source_run WHERE id IN (SELECT max(id) FROM source_run GROUP BY source_id)",
    "source_health_baseline": """
WITH b AS (SELECT source_id, id, CAST(collected_count AS DOUBLE) AS collected, avg(collected_count) OVER w AS m, count(collected_count) OVER w AS samples
           FROM source_run WHERE status = 'success' WINDOW w AS (PARTITION BY source_id ORDER BY id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT source_id, id, collected, round(m, 2) AS baseline, samples, collected = 0 AND samples >= 3 AND m >= 3 AS suspect FROM b""",
    "source_funnel": """
SELECT source_id, e.key AS step, CAST(sum(e.value) AS BIGINT) AS total, count(*) AS runs
FROM (SELECT source_id, unnest(map_entries(funnel)) AS e FROM source_run) GROUP BY 1, 2""",
    "source_run_summary": """
SELECT source_id, count(*) AS runs, count(*) FILTER (status = 'success') AS good, count(*) FILTER (status = 'failed') AS failed,
       CAST(sum(collected_count) AS BIGINT) AS collected, CAST(sum(rejected_count) AS BIGINT) AS rejected, count(DISTINCT nullif(error, '')) AS kinds_of_error,
       max(duration_ms) AS longest_ms, min(CASE WHEN status = 'success' THEN started_at END) AS first_good FROM source_run GROUP BY 1""",
    "run_reconciliation": """
SELECT r.id AS run_id, r.item_count, coalesce(s.observed, 0) AS observed, coalesce(s.notices, 0) AS notices, coalesce(s.observed, 0) - coalesce(r.item_count, 0) AS difference
FROM source_run r LEFT JOIN (SELECT run_id, count(*) AS observed, count(DISTINCT notice_id) AS notices FROM notice_observation GROUP BY 1) s ON s.run_id = r.id""",
    "observation_violations": """
SELECT * FROM (SELECT o.id, CASE WHEN r.id IS NULL THEN 'no such run' WHEN r.source_id <> o.source_id THEN 'another source'
    WHEN row_number() OVER (PARTITION BY o.run_id, o.notice_id ORDER BY o.id) > 1 THEN 'second write' END AS violation
FROM notice_observation o LEFT JOIN source_run r ON r.id = o.run_id) WHERE violation IS NOT NULL""",
    "business_day_counts": """
SELECT source_id, CAST(observed_at AS DATE) AS day, count(*) AS n, CAST(sum(is_first_seen) AS BIGINT) AS first_seen, CAST(sum(content_changed) AS BIGINT) AS changed
FROM notice_observation GROUP BY 1, 2""",
    "validate_reject_reasons": _VALID + "SELECT id, len(reasons) = 0 AS accepted, array_to_string(reasons, '; ') AS reasons FROM r",
    "reject_reason_counts": _VALID + "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY 1",
    "publish_dates": f"SELECT id, {_PUBLISHED} AS published, CAST(date_diff('day', {_PUBLISHED}, CAST(created_at AS DATE)) AS INTEGER) AS days_before FROM project",
    "recency_filter": f"SELECT * FROM (SELECT id, source_site, {_PUBLISHED} AS published FROM project) WHERE published BETWEEN DATE '2025-04-01' AND DATE '2025-05-01'",
    "content_fingerprint": "SELECT id, sha256(concat_ws(chr(31), " + ", ".join(_SQUASH.format(c) for c in ("project_name", "project_no", "publish_date", "region", "owner", "tenderer", "project_stage", "construction_content", "raw_text")) + ")) AS fingerprint FROM project",
    "upsert_latest_by_key": """
SELECT source_site, url, min(id) AS id, arg_max(project_name, id) AS project_name, arg_max(ai_score, id) AS ai_score, arg_max(created_at, id) AS created_at, count(*) AS versions
FROM project GROUP BY 1, 2""",
    "version_differences": """
WITH p AS (SELECT id, url, project_name, owner, region, ai_score, min(id) OVER (PARTITION BY regexp_replace(lower(url), '^https?://|[?#].*$', '', 'g')) AS first FROM project)
SELECT n.id, concat_ws(',', CASE WHEN n.project_name IS DISTINCT FROM o.project_name THEN 'project_name' END, CASE WHEN n.owner IS DISTINCT FROM o.owner THEN 'owner' END,
       CASE WHEN n.region IS DISTINCT FROM o.region THEN 'region' END, CASE WHEN n.ai_score IS DISTINCT FROM o.ai_score THEN 'ai_score' END) AS changed
FROM p n JOIN project o ON o.id = n.first WHERE n.id > n.first AND (n.project_name, n.owner, n.region, n.ai_score) IS DISTINCT FROM (o.project_name, o.owner, o.region, o.ai_score)""",
    "snapshot_merge_by_url": f"""
SELECT p.url, min(o.observed_at) AS first_at, max(o.observed_at) AS last_at, max(o.content_changed) AS changed, arg_min(r.status, {_RANK}) AS status, count(*) AS n
FROM notice_observation o JOIN source_run r ON r.id = o.run_id JOIN project p ON p.id = o.notice_id GROUP BY 1""",
    "recent_topk": "SELECT id, project_name, ai_score, created_at FROM project ORDER BY ai_score DESC NULLS LAST, created_at DESC, id DESC LIMIT 50",
    "follow_up_topk": f"""
SELECT id, project_name, {_PUBLISHED} AS published, ai_score FROM project WHERE notice_actionability = 'OPEN' AND project_tracking_recommendation = 'ACTIVE_WATCH'
ORDER BY published DESC NULLS LAST, ai_score DESC NULLS LAST, id DESC LIMIT 30""",
    "dynamic_predicate_scan": "SELECT id, project_no, source_site, ai_score FROM project WHERE source_site = '京畿工程交易协同网' AND ai_score >= 50",
    "never_observed": "SELECT id, source_site FROM project WHERE id NOT IN (SELECT notice_id FROM notice_observation WHERE notice_id IS NOT NULL AND run_id IN (SELECT id FROM source_run WHERE status = 'success'))",
    "seen_in_failed_runs": "SELECT id, source_site FROM project WHERE id IN (SELECT notice_id FROM notice_observation WHERE run_id IN (SELECT id FROM source_run WHERE status IN ('failed', 'partial')))",
    "first_seen_flags": """
WITH o AS (SELECT * FROM notice_observation QUALIFY row_number() OVER (PARTITION BY run_id, notice_id ORDER BY id) = 1),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY notice_id ORDER BY run_id, id) = 1)
SELECT f.id, notice_id, CAST(created_at AS DATE) >= CAST(observed_at AS DATE) AS is_news FROM f JOIN project p ON p.id = notice_id""",
    "late_observations": """
SELECT id, observed_at, latest_before FROM (SELECT id, observed_at, max(observed_at) OVER (PARTITION BY run_id, source_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_before
FROM notice_observation) WHERE observed_at < latest_before""",
}
