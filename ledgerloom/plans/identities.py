"""Queries on what identifies notices: names, owners, regions, numbers, parts, parties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extraction as X
from .tables import table

PROVINCES = {"北京市": ["北京"], "天津市": ["天津"], "河北省": ["河北"]}
#: The number systems of sites; a site of several provinces has one for each.
SPACES = {"京畿工程交易协同网": {"北京市": "JJ_BEIJING", "天津市": "JJ_TIANJIN", "河北省": "JJ_HEBEI", "": "JJ"}, "澄川公共采购平台": {"": "CHENGCHUAN"}, "临澄水务招采中心": {"": "LINCHENG"}}


def identities(spark: SparkSession, d: str) -> DataFrame:
    """Names as notices, works and events compare them."""
    name = F.col("project_name")
    return table(spark, d, "project").select("id", T.notice_identity(name).alias("notice"), T.work_identity(name).alias("work"), T.event_identity(name).alias("event"))


def cleaned_owners(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project").select("id", T.owner_name(F.col("owner")).alias("owner"))


def strict_regions(spark: SparkSession, d: str) -> DataFrame:
    """The one province a field names, empty for none or two."""
    return table(spark, d, "project").select("id", T.only_label(F.col("region"), PROVINCES).alias("province"))


def title_regions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "project").select("id", T.title_label(F.col("project_name"), PROVINCES).alias("t"))
    return rows.select("id", F.col("t.label").alias("province"), "t.marker")


def number_spaces(spark: SparkSession, d: str) -> DataFrame:
    """The number system that a notice's number belongs to, by its site and, where that has several, its province."""
    space = F.lit("UNKNOWN")
    for site, spaces in SPACES.items():
        inner = F.lit(spaces[""])
        for province, name in spaces.items():
            inner = F.when(F.col("province") == province, name).otherwise(inner) if province else inner
        space = F.when(F.col("source_site") == site, inner).otherwise(space)
    rows = table(spark, d, "project").select("id", "source_site", T.only_label(F.col("region"), PROVINCES).alias("province"))
    return rows.select("id", space.alias("space"))


def number_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "project").select("id", T.number_class(T.identifier(F.col("project_no"))).alias("c"))
    return rows.select("id", "c.kind", "c.strength")


def split_names(spark: SparkSession, d: str) -> DataFrame:
    """Core and purchase of each name, with the part of the work that the purchase is for."""
    name = F.concat(F.coalesce("project_name", F.lit("")), F.lit("项目"), F.coalesce("construction_content", F.lit("")), F.lit("采购"))
    rows = table(spark, d, "project").select("id", T.split_name(name).alias("s"))
    return rows.select("id", "s.core", "s.tail", T.part_scope(F.col("s.tail")).alias("part"))


def result_parties(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws("\n", "raw_text", F.concat(F.lit("中标人："), "tenderer"))
    return table(spark, d, "project").select("id", T.result_party(text).alias("party"))


def named_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project").select("id", T.years(F.concat_ws("\n", "project_name", "raw_text")).alias("y")).filter("size(y) > 0").select("id", F.array_join("y", ",").alias("years"))


def ordered_lots(spark: SparkSession, d: str) -> DataFrame:
    """Lots of each name, numbers by value before codes."""
    rows = table(spark, d, "project").select("id", X.lots("project_name").alias("l")).filter(F.size("l") > 0)
    return rows.select("id", F.array_join(T.lot_order(F.col("l")), ",").alias("lots"))


def event_rich_owners(spark: SparkSession, d: str) -> DataFrame:
    """The 20 owners with the most events; ties by name."""
    rows = table(spark, d, "project").filter("owner <> ''").groupBy("owner").agg(F.sum(F.greatest(F.size("matched_products"), F.lit(1))).alias("events"))
    return rows.orderBy(F.desc("events"), "owner").limit(20)


QUERIES = {
    f.__name__: f
    for f in (identities, cleaned_owners, strict_regions, title_regions, number_spaces, number_classes, split_names, result_parties, named_years, ordered_lots, event_rich_owners)
}


def _class(place: int, other: str) -> str:
    return "CASE WHEN n = '' THEN '' " + " ".join(f"WHEN regexp_matches(n, '{x[1]}') THEN '{x[place]}'" for x in T.NUMBERS) + f" ELSE '{other}' END"


_ONE = "CASE WHEN contains({0}, '北京')::INT + contains({0}, '天津')::INT + contains({0}, '河北')::INT = 1 THEN CASE WHEN contains({0}, '北京') THEN '北京市' WHEN contains({0}, '天津') THEN '天津市' ELSE '河北省' END ELSE '' END"
_REGION = _ONE.format(r"regexp_replace(coalesce(region, ''), '[\s\p{Z}]+', '', 'g')")
_TITLE = "regexp_replace(coalesce(project_name, ''), '^.{0,45}?(?:集团股份有限公司|集团有限公司|有限责任公司|有限公司)', '')"
_NUMBER = r"upper(translate(regexp_replace(coalesce(project_no, ''), '[\s\p{Z}\p{Cf}]+', '', 'g'), '－—–‐‑−﹣', '-------'))"
_SPLIT = r"(?s)^(.*项目)(.*?(?:采购|租赁|劳务分包|专业分包).*)$"
_ENDS = " ，,。.;；-—"
SQL = {
    "strict_regions": f"SELECT id, {_REGION} AS province FROM project",
    "title_regions": f"SELECT id, {_ONE.format('t')} AS province, left({_ONE.format('t')}, 2) AS marker FROM (SELECT id, {_TITLE} AS t FROM project)",
    "number_spaces": f"""
WITH r AS (SELECT id, source_site, {_REGION} AS province FROM project)
SELECT id, CASE source_site WHEN '京畿工程交易协同网' THEN CASE province WHEN '北京市' THEN 'JJ_BEIJING' WHEN '天津市' THEN 'JJ_TIANJIN' WHEN '河北省' THEN 'JJ_HEBEI' ELSE 'JJ' END
    WHEN '澄川公共采购平台' THEN 'CHENGCHUAN' WHEN '临澄水务招采中心' THEN 'LINCHENG' ELSE 'UNKNOWN' END AS space FROM r""",
    "number_classes": f"WITH c AS (SELECT id, {_NUMBER} AS n FROM project) SELECT id, {_class(0, 'OTHER')} AS kind, {_class(2, 'WEAK')} AS strength FROM c",
    "split_names": rf"""
WITH n AS (SELECT id, coalesce(project_name, '') || '项目' || coalesce(construction_content, '') || '采购' AS n FROM project),
h AS (SELECT id, n, regexp_extract(n, '{_SPLIT}', 1) AS h, trim(regexp_extract(n, '{_SPLIT}', 2), '{_ENDS}') AS t FROM n),
c AS (SELECT id, n, h, t, h <> '' AND length(translate(regexp_replace(h, '[\s\p{{Z}}]+', '', 'g'), '，,。.;；:：''"“”‘’()（）[]【】_-', '')) >= 6 AS cut FROM h),
s AS (SELECT id, CASE WHEN cut THEN h ELSE n END AS core, CASE WHEN cut THEN t ELSE '' END AS tail FROM c),
p AS (SELECT *, trim(regexp_extract(tail, '^(.*?)(?:{T.PART_ENDS})', 1), '{_ENDS}') AS p FROM s)
SELECT id, core, tail, CASE WHEN length(p) <= 20 AND regexp_matches(p, '{T.PARTS}') THEN p ELSE '' END AS part FROM p""",
    "result_parties": f"WITH p AS (SELECT id, trim(regexp_extract(concat_ws(chr(10), raw_text, '中标人：' || tenderer), '{T.PARTY}', 1), ' ') AS p FROM project) SELECT id, CASE WHEN regexp_matches(p, '{T.NO_PARTY}') THEN '' ELSE p END AS party FROM p",
    "named_years": r"""
WITH y AS (SELECT id, regexp_extract_all(concat_ws(chr(10), project_name, raw_text), '(20\d{2})年(?:度)?', 1) AS y FROM project), n AS (SELECT id, unnest(y) AS v, generate_subscripts(y, 1) AS i FROM y), u AS (SELECT id, v, min(i) AS i FROM n GROUP BY 1, 2)
SELECT id, string_agg(v, ',' ORDER BY i) AS years FROM u GROUP BY 1""",
    "event_rich_owners": "SELECT owner, CAST(sum(greatest(coalesce(len(matched_products), 1), 1)) AS BIGINT) AS events FROM project WHERE owner <> '' GROUP BY 1 ORDER BY events DESC, owner LIMIT 20",
}
