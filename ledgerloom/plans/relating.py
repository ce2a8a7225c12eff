"""Queries on the register of works: relations, entities by identifier, phases and lots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import linking, relating
from .tables import table

PHASE = r"第?([一二三四五六七八九十]+|[IVX]+|\d+)期"
LOT = r"第?([一二三四五六七八九十]+|[IVX]+|\d+)#?标段"
NUMBERS = ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十"]


def phase_and_lot(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of phase and lot in each notice's name, however they are written."""
    name = F.col("project_name")
    phase, lot = (F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in (PHASE, LOT))
    return table(spark, d, "project").select("id", T.chinese_number(phase).alias("phase"), T.chinese_number(lot).alias("lot")).filter("phase is not null or lot is not null")


def _works(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "engineering_project_identifier").filter("identifier_type <> '计划编号'").groupBy(F.col("engineering_project_id").alias("id")).agg(F.collect_set(T.identifier(F.col("identifier_value"))).alias("identifiers"))
    name = F.regexp_replace(T.identity_text(F.regexp_replace("canonical_name", PHASE, "")), "工程|项目", "")
    one = lambda c: F.array_compact(F.array(F.nullif(F.trim(F.col(c)), F.lit(""))))
    phase = F.nullif(F.regexp_extract("canonical_name", PHASE, 1), F.lit(""))
    rows = table(spark, d, "engineering_project").select("id", name.alias("name"), one("region").alias("regions"), one("owner").alias("owners"), F.array_compact(F.array(T.chinese_number(phase))).alias("phases"))
    return rows.join(ids, "id", "left").withColumn("identifiers", F.coalesce("identifiers", F.array().cast("array<string>")))


def entity_relation_scores(spark: SparkSession, d: str) -> DataFrame:
    works = _works(spark, d)
    return relating.related(works, linking.blocks(works, "id", T.ngrams(F.col("name"), 8)))


def entities_by_identifier(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "engineering_project_identifier").filter("identifier_type <> '计划编号'")
    return relating.by_identifiers(rows.select(F.col("engineering_project_id").alias("id"), T.identifier(F.col("identifier_value")).alias("identifier")))


def entity_features(spark: SparkSession, d: str) -> DataFrame:
    works = _works(spark, d)
    return works.select("id", "name", F.array_join("regions", "|").alias("regions"), F.array_join("owners", "|").alias("owners"), F.array_join("phases", "|").alias("phases"), F.array_join(F.array_sort("identifiers"), "|").alias("identifiers"))


QUERIES = {f.__name__: f for f in (phase_and_lot, entity_relation_scores, entities_by_identifier, entity_features)}

_NUMBER = (
    "CASE WHEN regexp_full_match({0}, '\\d+') THEN CAST({0} AS INTEGER) "
    + " ".join(f"WHEN {{0}} = '{c}' THEN {i}" for i, c in enumerate(NUMBERS, 1))
    + " ".join(f" WHEN {{0}} = '{r}' THEN {i}" for i, r in enumerate(("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"), 1))
    + " END"
)
_ID = r"upper(translate(regexp_replace(coalesce(identifier_value, ''), '[\s\p{Z}\p{Cf}]+', '', 'g'), '－—–‐‑−﹣', '-------'))"
_WORKS = rf"""
WITH RECURSIVE i AS (SELECT engineering_project_id AS id, list_sort(list(DISTINCT {_ID})) AS identifiers FROM engineering_project_identifier WHERE identifier_type <> '计划编号' GROUP BY 1),
w AS (SELECT e.id, regexp_replace(lower(regexp_replace(regexp_replace(canonical_name, '{PHASE}', '', 'g'), '[\s\p{{Z}}\p{{P}}\p{{S}}\p{{Cf}}]+', '', 'g')), '工程|项目', '', 'g') AS name,
       list_filter([nullif(trim(region, ' '), '')], lambda x: x IS NOT NULL) AS regions, list_filter([nullif(trim(owner, ' '), '')], lambda x: x IS NOT NULL) AS owners,
       list_filter([{_NUMBER.format(f"regexp_extract(canonical_name, '{PHASE}', 1)")}], lambda x: x IS NOT NULL) AS phases, coalesce(i.identifiers, []) AS identifiers
      FROM engineering_project e LEFT JOIN i USING (id))
"""


def _overlap(c: str, same: int, other: int) -> str:
    return f"CASE WHEN len(x.{c}) > 0 AND len(y.{c}) > 0 THEN CASE WHEN list_has_any(x.{c}, y.{c}) THEN {same} ELSE {other} END ELSE 0 END"


SQL = {
    "phase_and_lot": f"""
SELECT * FROM (SELECT id, {_NUMBER.format(f"regexp_extract(project_name, '{PHASE}', 1)")} AS phase, {_NUMBER.format(f"regexp_extract(project_name, '{LOT}', 1)")} AS lot FROM project) WHERE phase IS NOT NULL OR lot IS NOT NULL""",
    "entity_relation_scores": _WORKS + f""", k AS (SELECT DISTINCT substring(name, i, 8) AS key, id FROM (SELECT id, name, unnest(range(1, greatest(length(name) - 7, 1) + 1)) AS i FROM w WHERE name <> '')),
kept AS (SELECT k.* FROM k JOIN (SELECT key FROM k GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20) USING (key)),
p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM kept a JOIN kept b ON a.key = b.key AND a.id < b.id),
s AS (SELECT a, b, CAST(greatest(0, least(100, CASE WHEN x.name = y.name THEN 55 WHEN contains(x.name, y.name) OR contains(y.name, x.name) THEN 40 ELSE 30 END
        + {_overlap("identifiers", 30, 0)} + {_overlap("regions", 10, -25)} + {_overlap("owners", 10, -20)} + {_overlap("phases", 5, -10)})) AS INTEGER) AS score,
      CASE WHEN len(x.phases) > 0 AND len(y.phases) > 0 AND NOT list_has_any(x.phases, y.phases) THEN 'OTHER_PHASE' WHEN x.name <> y.name AND (contains(x.name, y.name) OR contains(y.name, x.name)) THEN 'PART' ELSE 'SAME' END AS relation
      FROM p JOIN w x ON x.id = a JOIN w y ON y.id = b)
SELECT * FROM s WHERE score >= 60""",
    "entities_by_identifier": rf"""
WITH RECURSIVE l AS (SELECT DISTINCT engineering_project_id AS id, {_ID} AS identifier FROM engineering_project_identifier WHERE identifier_type <> '计划编号'),
e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM l x JOIN l y USING (identifier) WHERE identifier <> '' AND x.id <> y.id),
r AS (SELECT DISTINCT id, id AS other FROM l UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other)
SELECT id, min(other) AS entity FROM r GROUP BY 1""",
    "entity_features": _WORKS + "SELECT id, name, array_to_string(regions, '|') AS regions, array_to_string(owners, '|') AS owners, array_to_string(phases, '|') AS phases, array_to_string(identifiers, '|') AS identifiers FROM w",
}
