"""Queries on the events of owners' works as versions, coverage and audit, and on ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction as X
from ..operators import ledger, lifecycle
from .relating import LOT, PHASE
from .tables import table
from .tracking import _PUBLISHED

#: Kinds of events by words of the title, in their precedence.
KINDS = {"WON": "中标结果|成交", "CANDIDATES": "中标候选", "TENDER": "招标公告|采购公告", "PREQUALIFICATION": "资格预审", "PLAN": "招标计划"}
COURSE = ["PLAN", "PREQUALIFICATION", "TENDER", "CANDIDATES", "WON"]


def _events(spark: SparkSession, d: str) -> DataFrame:
    name = F.coalesce("project_name", F.lit(""))
    part = lifecycle.scope(F.regexp_extract(name, PHASE, 1), F.regexp_extract(name, LOT, 1))
    party = F.when(F.col("kind") == "WON", F.coalesce("tenderer", F.lit(""))).otherwise("")
    rows = table(spark, d, "project").select("id", "source_site", "tenderer", F.coalesce("owner", F.lit("")).alias("entity"), lifecycle.first_of(name, KINDS, "OTHER").alias("kind"), part.alias("scope"), X.event_date(F.col("raw_text"), F.col("publish_date"))["day"].alias("day"))
    return lifecycle.with_keys(rows.withColumn("party", party).drop("tenderer").withColumnRenamed("kind", "event_type"), ["entity", "event_type", "scope", "party"])


def scoped_events(spark: SparkSession, d: str) -> DataFrame:
    """One event a notice, its type by precedence of the title's words, with scope, party and a key that holds them."""
    return _events(spark, d).select("id", "event_type", "scope", "party", "day", "event_key")


def versioned_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the notices that had come with an even id, brought up to date with all but those of id 0 modulo 4."""
    rows = _events(spark, d).select("event_key", "id", "event_type", "day")
    one = rows.groupBy("event_key").agg(F.min(F.struct("id", "event_type", "day")).alias("r"))
    one = one.select("event_key", "r.id", "r.event_type", "r.day")
    old = one.filter("id % 2 = 0").withColumns({"extractor_version": F.lit("v1"), "is_active": F.lit(True)})
    return lifecycle.versioned(old, one.filter("id % 4 <> 0"), "v2").select("event_key", "id", "event_type", "day", "extractor_version", "is_active")


def stage_coverage(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.coverage(_events(spark, d).filter("entity <> ''"), "entity", "event_type", COURSE)


def lifecycle_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).filter("entity <> ''").groupBy("entity").agg(F.count_distinct("source_site").alias("sources"), F.count("day").alias("dated"), F.count("*").alias("events"))
    return rows.withColumn("confidence", lifecycle.confidence(F.col("sources"), F.col("dated"), F.col("events")))


def event_integrity(spark: SparkSession, d: str) -> DataFrame:
    """How many active events lack what, and how many keys are given twice."""
    rows = _events(spark, d).withColumn("event_type", F.when(F.col("event_type") == "OTHER", "").otherwise(F.col("event_type"))).withColumn("is_active", F.lit(True))
    return lifecycle.integrity(rows).groupBy("problem").agg(F.count("*").alias("n"))


def run_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Runs folded from the events that begin and finish them."""
    runs = table(spark, d, "source_run")
    begin = runs.select((F.col("id") * 2).alias("seq"), F.col("id").alias("run_id"), "source_id", F.lit("BEGIN").alias("kind"), F.col("started_at").alias("at"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("error"))
    end = runs.filter("finished_at is not null").select((F.col("id") * 2 + 1).alias("seq"), F.col("id").alias("run_id"), "source_id", F.lit("FINISH").alias("kind"), F.col("finished_at").alias("at"), "status", "error")
    return ledger.runs(begin.unionByName(end))


QUERIES = {f.__name__: f for f in (scoped_events, versioned_events, stage_coverage, lifecycle_confidence, event_integrity, run_ledger)}

_KIND = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(project_name, ''), '{p}') THEN '{k}'" for k, p in KINDS.items()) + " ELSE 'OTHER' END"
_STATED = r"regexp_replace(regexp_replace(regexp_extract(coalesce(raw_text, ''), '(?:发布时间|更新时间|开标时间)[：:]\s*(\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?)', 1), '[年月/.]', '-', 'g'), '日$', '')"
_QUOTED = r"""'"' || replace(replace({0}, '\', '\\'), '"', '\"') || '"'"""
_EVENTS = rf"""
WITH e AS (SELECT id, source_site, coalesce(owner, '') AS entity, {_KIND} AS event_type, tenderer,
    concat_ws('|', nullif(regexp_extract(coalesce(project_name, ''), '{PHASE}', 1), ''), nullif(regexp_extract(coalesce(project_name, ''), '{LOT}', 1), '')) AS scope,
    coalesce(CAST(try_strptime({_STATED}, '%Y-%m-%d') AS DATE), {_PUBLISHED}) AS day FROM project),
v AS (SELECT * EXCLUDE (tenderer), CASE WHEN event_type = 'WON' THEN coalesce(tenderer, '') ELSE '' END AS party FROM e),
k AS (SELECT *, sha256('[' || concat_ws(',', {", ".join(_QUOTED.format(c) for c in ("entity", "event_type", "scope", "party"))}) || ']') AS event_key FROM v)
"""
SQL = {
    "scoped_events": _EVENTS + "SELECT id, event_type, scope, party, day, event_key FROM k",
    "versioned_events": _EVENTS + """, one AS (SELECT event_key, id, event_type, day FROM k QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY id) = 1)
SELECT event_key, id, event_type, day, CASE WHEN id % 4 <> 0 THEN 'v2' ELSE 'v1' END AS extractor_version, id % 4 <> 0 AS is_active FROM one""",
    "stage_coverage": _EVENTS + f"""
, o(event_type, place) AS (VALUES {", ".join(f"('{s}', {i})" for i, s in enumerate(COURSE))}),
h AS (SELECT DISTINCT entity, event_type, place FROM k JOIN o USING (event_type) WHERE entity <> ''), t AS (SELECT entity, count(*) AS seen, max(place) AS top FROM h GROUP BY 1),
m AS (SELECT t.entity, string_agg(o.event_type, ',' ORDER BY o.place) AS missing FROM t JOIN o ON o.place <= t.top WHERE (t.entity, o.event_type) NOT IN (SELECT (entity, event_type) FROM h) GROUP BY 1)
SELECT entity, CAST(seen AS INTEGER) AS seen, round(seen / {len(COURSE)}, 4) AS coverage, coalesce(missing, '') AS missing FROM t LEFT JOIN m USING (entity)""",
    "lifecycle_confidence": _EVENTS + """, c AS (SELECT entity, count(DISTINCT source_site) AS sources, count(day) AS dated, count(*) AS events FROM k WHERE entity <> '' GROUP BY 1)
SELECT *, CASE WHEN sources >= 2 AND dated = events THEN 'HIGH' WHEN sources < 2 AND dated = 0 THEN 'LOW' ELSE 'MEDIUM' END AS confidence FROM c""",
    "event_integrity": _EVENTS + """, p AS (SELECT event_key, 'no entity' AS problem FROM k WHERE entity = '' UNION SELECT event_key, 'no type' FROM k WHERE event_type = 'OTHER' UNION SELECT event_key, 'no date' FROM k WHERE day IS NULL
  UNION SELECT event_key, 'key given twice' FROM k GROUP BY 1 HAVING count(*) > 1) SELECT problem, count(*) AS n FROM p GROUP BY 1""",
    "run_ledger": "SELECT id AS run_id, source_id, started_at, finished_at, CASE WHEN finished_at IS NULL THEN 'RUNNING' ELSE coalesce(status, 'success') END AS status, CASE WHEN finished_at IS NULL OR status = 'success' THEN '' ELSE coalesce(error, '') END AS error FROM source_run",
}
