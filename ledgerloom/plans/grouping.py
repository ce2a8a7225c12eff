"""Queries on entities, their attributes and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import grouping
from .tables import table


def identifier_shared_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per type: values, rows, values shared by several works, most works of one value."""
    rows = table(spark, d, "engineering_project_identifier").filter("identifier_value <> ''")
    by_value = rows.groupBy("identifier_type", "identifier_value").agg(F.count("*").alias("n"), F.count_distinct("engineering_project_id").alias("works"))
    return by_value.groupBy("identifier_type").agg(F.count("*").alias("distinct_values"), F.sum("n").alias("total"), F.count_if(F.col("works") > 1).alias("shared"), F.max("works").alias("most_works"))


def shared_identifier_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "engineering_project_identifier")
    by_value = rows.groupBy("identifier_type", "identifier_value").agg(F.count_distinct("engineering_project_id").alias("works"), grouping.sorted_list(F.col("engineering_project_id"), ",").alias("ids"))
    return by_value.filter("works > 1").orderBy(F.desc("works"), "identifier_type", "identifier_value").limit(20)


def works_without_identifier(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "engineering_project_identifier").select(F.col("engineering_project_id").alias("id"))
    return table(spark, d, "engineering_project").select("id", "canonical_name").join(ids, "id", "left_anti")


def thinly_identified(spark: SparkSession, d: str) -> DataFrame:
    """Works with no identifier or just one: left join with an OR condition."""
    n = table(spark, d, "engineering_project_identifier").groupBy(F.col("engineering_project_id").alias("id")).agg(F.count("*").alias("identifiers"))
    return table(spark, d, "engineering_project").select("id", "identity_key").join(n, "id", "left").filter("identifiers is null or identifiers = 1")


def owner_size_stats(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "project").filter("owner <> ''").groupBy("owner").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("owners"), F.sum("n").alias("notices"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("several"), F.max("n").alias("most"))


def owners_with_several(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "project").filter("owner <> ''")
    return rows.groupBy("owner").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("n > 1")


def owner_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "project").filter("owner <> ''")
    return rows.groupBy("owner").agg(
        grouping.single_or_empty(F.col("region")).alias("region"), grouping.shortest(F.col("project_name")).alias("shortest_name"),
        F.count_distinct("source_site").alias("sites"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
    )


def composite_key_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of two notices or more that agree in name, region and owner, none of them empty."""
    rows = table(spark, d, "project").filter("project_name <> '' and region <> '' and owner <> '' and length(project_name) >= 6")
    key = F.sha2(F.concat_ws("\x1f", "project_name", "region", "owner"), 256).alias("entity_key")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("primary_id")).filter("n > 1")


def stage_mode_by_site(spark: SparkSession, d: str) -> DataFrame:
    return grouping.mode(table(spark, d, "project"), ["source_site"], "project_stage")


def site_stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project").groupBy("source_site", "project_stage").agg(F.count("*").alias("n"))


def field_presence_by_site(spark: SparkSession, d: str) -> DataFrame:
    """Provenance audit: how many notices of a site have each field."""
    names = ["project_no", "publish_date", "region", "owner", "tenderer", "raw_text"]
    rows = table(spark, d, "project").select("source_site", *names)
    present = rows.groupBy("source_site").agg(F.count("*").alias("notices"), *(F.count_if(F.coalesce(F.col(n), F.lit("")) != "").alias(n) for n in names))
    return present.unpivot(["source_site", "notices"], names, "field", "present")


def product_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "project").filter(F.size("matched_products") > 0)
    return rows.groupBy("source_site").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("matched_products")))), ",").alias("products"), F.sum(F.size("matched_products")).alias("matches"))


def best_notice_of_owner(spark: SparkSession, d: str) -> DataFrame:
    """Each owner's best notice: actionable first, then the score, then the smallest id."""
    rows = table(spark, d, "project").filter("owner <> ''")
    ranks = [(F.col("notice_actionability") == "OPEN").cast("int"), F.coalesce("ai_score", F.lit(-1)), -F.col("id")]
    return grouping.best_by_rank(rows, ["owner"], ranks, ["id", "ai_score"])


def nations_of_region(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(grouping.sorted_list(F.col("n_name"), "|").alias("nations"))


def latest_assessment_version(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each (notice address, analyzer version) by insertion, whatever its time."""
    rows = table(spark, d, "project")
    return rows.groupBy("url", "analyzer_version").agg(F.max_by(F.struct("id", "ai_score", "rules_version"), "id").alias("r")).select("url", "analyzer_version", "r.id", "r.ai_score", "r.rules_version")


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the analysis JSON with the columns as fallback."""
    j = F.from_json("analysis_json", "lead_score int, products array<string>")
    rows = table(spark, d, "project").select("id", "ai_score", "matched_products", j.alias("j"))
    return rows.select("id", F.coalesce("j.lead_score", "ai_score").alias("lead_score"), F.array_join(F.coalesce("j.products", "matched_products"), ",").alias("products"))


def rank_order_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Per owner: pairs of stages, the higher first reached before the lower."""
    rank = F.create_map(*(x for i, s in enumerate(("招标计划", "资格预审公告", "施工招标公告", "中标候选人公示", "中标结果公告")) for x in (F.lit(s), F.lit(i))))
    rows = table(spark, d, "project").filter("owner <> ''").select("owner", "project_stage", rank[F.col("project_stage")].alias("rank"), "created_at").filter("rank is not null")
    first = rows.groupBy("owner", "project_stage", "rank").agg(F.min("created_at").alias("at"))
    a, b = first.alias("a"), first.alias("b")
    pairs = a.join(b, (F.col("a.owner") == F.col("b.owner")) & (F.col("a.rank") > F.col("b.rank")) & (F.col("a.at") < F.col("b.at")))
    return pairs.select(F.col("a.owner").alias("owner"), F.col("a.project_stage").alias("higher"), F.col("b.project_stage").alias("lower"))


def highest_rank(spark: SparkSession, d: str) -> DataFrame:
    """Per owner: the highest stage reached, since when, and the one before it."""
    rank = F.create_map(*(x for i, s in enumerate(("招标计划", "资格预审公告", "施工招标公告", "中标候选人公示", "中标结果公告")) for x in (F.lit(s), F.lit(i))))
    rows = table(spark, d, "project").filter("owner <> ''").select("owner", "project_stage", rank[F.col("project_stage")].alias("rank"), "created_at").filter("rank is not null")
    first = rows.groupBy("owner", "project_stage", "rank").agg(F.min("created_at").alias("since"))
    w = Window.partitionBy("owner").orderBy(F.desc("rank"))
    ranked = first.withColumns({"n": F.row_number().over(w), "previous": F.lead("project_stage").over(w)})
    return ranked.filter("n = 1").select("owner", F.col("project_stage").alias("stage"), "since", "previous")


def schema_ledger_check(spark: SparkSession, d: str) -> DataFrame:
    """Gaps in a numbered ledger (run ids): where a whole round of other sources or more lies between."""
    w = Window.partitionBy("source_id").orderBy("id")
    rows = table(spark, d, "source_run").select("source_id", "id", F.lag("id").over(w).alias("before"))
    return rows.filter("id - before >= 12")


def time_gaps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy("started_at", "id")
    rows = table(spark, d, "source_run").select("source_id", "id", "started_at", F.lag("started_at").over(w).alias("before"))
    return rows.select("source_id", "id", F.timestamp_diff("HOUR", "before", "started_at").alias("hours")).filter("hours >= 24")


QUERIES = {
    f.__name__: f
    for f in (
        identifier_shared_stats, shared_identifier_samples, works_without_identifier, thinly_identified, owner_size_stats, owners_with_several, owner_profile,
        composite_key_groups, stage_mode_by_site, site_stage_counts, field_presence_by_site, product_sets, best_notice_of_owner, nations_of_region,
        latest_assessment_version, json_fields, rank_order_conflicts, highest_rank, schema_ledger_check, time_gaps,
    )
}

_RANKED = """
WITH r(project_stage, rank) AS (VALUES ('招标计划', 0), ('资格预审公告', 1), ('施工招标公告', 2), ('中标候选人公示', 3), ('中标结果公告', 4)),
f AS (SELECT owner, project_stage, rank, min(created_at) AS since FROM project JOIN r USING (project_stage) WHERE owner <> '' GROUP BY ALL)
"""
SQL = {
    "identifier_shared_stats": """
SELECT identifier_type, count(*) AS distinct_values, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (works > 1) AS shared, max(works) AS most_works
FROM (SELECT identifier_type, identifier_value, count(*) AS n, count(DISTINCT engineering_project_id) AS works FROM engineering_project_identifier WHERE identifier_value <> '' GROUP BY 1, 2) GROUP BY 1""",
    "shared_identifier_samples": """
SELECT identifier_type, identifier_value, count(DISTINCT engineering_project_id) AS works, string_agg(DISTINCT CAST(engineering_project_id AS VARCHAR), ',' ORDER BY CAST(engineering_project_id AS VARCHAR)) AS ids
FROM engineering_project_identifier GROUP BY 1, 2 HAVING count(DISTINCT engineering_project_id) > 1 ORDER BY works DESC, 1, 2 LIMIT 20""",
    "works_without_identifier": "SELECT id, canonical_name FROM engineering_project WHERE id NOT IN (SELECT engineering_project_id FROM engineering_project_identifier)",
    "thinly_identified": """
SELECT e.id, e.identity_key, n.identifiers FROM engineering_project e LEFT JOIN (SELECT engineering_project_id AS id, count(*) AS identifiers FROM engineering_project_identifier GROUP BY 1) n USING (id)
WHERE n.identifiers IS NULL OR n.identifiers = 1""",
    "owner_size_stats": "SELECT count(*) AS owners, CAST(sum(n) AS BIGINT) AS notices, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS several, max(n) AS most FROM (SELECT owner, count(*) AS n FROM project WHERE owner <> '' GROUP BY 1)",
    "owners_with_several": "SELECT owner, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM project WHERE owner <> '' GROUP BY 1 HAVING count(*) > 1",
    "owner_profile": """
SELECT owner, CASE WHEN count(DISTINCT nullif(region, '')) = 1 THEN min(nullif(region, '')) ELSE '' END AS region, arg_min(project_name, (length(project_name), project_name)) FILTER (project_name <> '') AS shortest_name,
       count(DISTINCT source_site) AS sites, min(created_at) AS first_at, max(created_at) AS last_at FROM project WHERE owner <> '' GROUP BY 1""",
    "composite_key_groups": """
SELECT sha256(concat_ws(chr(31), project_name, region, owner)) AS entity_key, count(*) AS n, min(id) AS primary_id FROM project
WHERE project_name <> '' AND region <> '' AND owner <> '' AND length(project_name) >= 6 GROUP BY 1 HAVING count(*) > 1""",
    "stage_mode_by_site": """
SELECT source_site, project_stage, n FROM (SELECT source_site, project_stage, count(*) AS n FROM project WHERE project_stage IS NOT NULL GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY source_site ORDER BY n DESC, length(project_stage), project_stage) = 1""",
    "site_stage_counts": "SELECT source_site, project_stage, count(*) AS n FROM project GROUP BY 1, 2",
    "field_presence_by_site": """
UNPIVOT (SELECT source_site, count(*) AS notices, count(*) FILTER (project_no <> '') AS project_no, count(*) FILTER (publish_date <> '') AS publish_date, count(*) FILTER (region <> '') AS region,
         count(*) FILTER (owner <> '') AS owner, count(*) FILTER (tenderer <> '') AS tenderer, count(*) FILTER (raw_text <> '') AS raw_text FROM project GROUP BY 1)
ON project_no, publish_date, region, owner, tenderer, raw_text INTO NAME field VALUE present""",
    "product_sets": """
SELECT source_site, string_agg(DISTINCT p, ',' ORDER BY p) AS products, count(*) AS matches FROM (SELECT source_site, unnest(matched_products) AS p FROM project) GROUP BY 1""",
    "best_notice_of_owner": """
SELECT owner, id, ai_score FROM project WHERE owner <> ''
QUALIFY row_number() OVER (PARTITION BY owner ORDER BY coalesce(notice_actionability = 'OPEN', FALSE) DESC, coalesce(ai_score, -1) DESC, id) = 1""",
    "nations_of_region": "SELECT r_name, string_agg(n_name, '|' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "latest_assessment_version": "SELECT url, analyzer_version, id, ai_score, rules_version FROM project QUALIFY row_number() OVER (PARTITION BY url, analyzer_version ORDER BY id DESC) = 1",
    "json_fields": """
SELECT id, coalesce(CAST(json_extract(analysis_json, '$.lead_score') AS INTEGER), ai_score) AS lead_score,
       array_to_string(coalesce(CAST(json_extract(analysis_json, '$.products') AS VARCHAR[]), matched_products), ',') AS products FROM project""",
    "rank_order_conflicts": _RANKED + "SELECT a.owner, a.project_stage AS higher, b.project_stage AS lower FROM f a JOIN f b ON a.owner = b.owner AND a.rank > b.rank AND a.since < b.since",
    "highest_rank": _RANKED + "SELECT owner, project_stage AS stage, since, lead(project_stage) OVER w AS previous FROM f WINDOW w AS (PARTITION BY owner ORDER BY rank DESC) QUALIFY row_number() OVER w = 1",
    "schema_ledger_check": "SELECT source_id, id, before FROM (SELECT source_id, id, lag(id) OVER (PARTITION BY source_id ORDER BY id) AS before FROM source_run) WHERE id - before >= 12",
    "time_gaps": """
SELECT source_id, id, hours FROM (SELECT source_id, id, CAST(floor(epoch(started_at - lag(started_at) OVER (PARTITION BY source_id ORDER BY started_at, id)) / 3600) AS BIGINT) AS hours FROM source_run) WHERE hours >= 24""",
}
