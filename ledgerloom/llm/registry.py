"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, encoding, incremental, linkage, lookalikes, mixture, pii, reading, regions, spellings
from .support import drop_folder, shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]
P4_FIELDS = ["project_name", "project_no", "owner"]


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    return regions.mapped(table(spark, d, "project"), table(spark, d, "region_ref"))


def _p1_misses(spark: SparkSession, d: str) -> DataFrame:
    return regions.misses(table(spark, d, "project"), table(spark, d, "region_ref"))


def _p2(spark: SparkSession, d: str) -> DataFrame:
    notices = table(spark, d, "project").select("id", F.col("project_name").alias("name"), "owner", "region", F.array("project_no").alias("numbers"))
    numbers = table(spark, d, "engineering_project_identifier").groupBy(F.col("engineering_project_id").alias("id")).agg(F.collect_set("identifier_value").alias("numbers"))
    register = table(spark, d, "engineering_project").join(numbers, "id", "left").select("id", F.col("canonical_name").alias("name"), "owner", "region", "numbers")
    return linkage.matches(notices, register, table(spark, d, "region_ref"))


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).select("id", "engineering_project_id")


def _p2_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).select("id", "engineering_project_id", F.round("confidence", 6).alias("confidence"))


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "project"), table(spark, d, "region_ref"))


def _p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "project"), table(spark, d, "region_ref"))


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.disguised(table(spark, d, "project"), P4_FIELDS)


def _p4_plain(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.plain_forms(table(spark, d, "project"), P4_FIELDS).select("id", "field_name", "plain")


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The first import, then three parts of the later runs, taken one after the other into a stored index."""
    notices = table(spark, d, "project").select("id", "url", "source_site", "raw_text")
    seen = table(spark, d, "notice_observation")
    first = seen.filter("is_first_seen = 1").select(F.col("notice_id").alias("id"), F.col("run_id").alias("run"))
    path = shared_folder(spark, "history-index")
    found = incremental.repeats_in_batches(notices, seen.select("notice_id", "content_hash"), first, path)
    drop_folder(spark, path)  # the groups are checkpointed apart from it
    return found


def _p5_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same groups from an index over all notices at once."""
    notices = table(spark, d, "project").select("id", "url", "source_site", "raw_text")
    return incremental.repeats(notices, table(spark, d, "notice_observation").select("notice_id", "content_hash"))


def _p6_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project").select(F.explode(F.array("owner", "tenderer")).alias("value"))


def _p6_found(spark: SparkSession, d: str) -> DataFrame:
    return spellings.pairs(_p6_values(spark, d), table(spark, d, "region_ref"))


def _p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return spellings.classes(_p6_values(spark, d), table(spark, d, "region_ref"))


def _p7_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated(table(spark, d, "project")).select("id", "line_no")


def _p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.without_repeated(table(spark, d, "project"))


def _p7_sequences(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.frequent_sequences(table(spark, d, "project")).select("source", F.concat_ws(" ", F.col("sequence").cast("array<string>")).alias("sequence"), "support")


def _p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encoded(table(spark, d, "documents"))


def _p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixed(table(spark, d, "documents").select("doc_id", "text", "source"), table(spark, d, "mix_target"))


def _p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(_p9_mix(spark, d), table(spark, d, "mix_target"))


def _p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.demanding(table(spark, d, "documents"), table(spark, d, "reading_label"))


def _p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_label")).select("doc_id", "level")


def queries() -> dict[str, Query]:
    return {
        "p1_found": _p1_found,
        "p1_misses": _p1_misses,
        "p2_found": _p2_found,
        "p2_confidence": _p2_confidence,
        "p3_found": _p3_found,
        "p3_redacted": _p3_redacted,
        "p4_found": _p4_found,
        "p4_plain": _p4_plain,
        "p5_found": _p5_found,
        "p5_whole": _p5_whole,
        "p6_found": _p6_found,
        "p6_classes": _p6_classes,
        "p7_found": _p7_found,
        "p7_clean": _p7_clean,
        "p7_sequences": _p7_sequences,
        "p8_ids": _p8_ids,
        "p9_mix": _p9_mix,
        "p9_shares": _p9_shares,
        "p10_found": _p10_found,
        "p10_levels": _p10_levels,
    }


_LINES = r"""
WITH cut AS (SELECT id, source_site, raw_text, string_split(raw_text, chr(10)) AS l FROM project WHERE source_site IS NOT NULL AND raw_text <> ''),
cells AS (SELECT id, source_site, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM cut),
norm AS (SELECT id, source_site, line, line_no,
           regexp_replace(regexp_replace(line, '^[\s\p{Z}\x{85}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{AD}]+|[\s\p{Z}\x{85}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{AD}]+$', '', 'g'), '\p{Nd}+', '0', 'g') AS k FROM cells),
sites AS (SELECT source_site, count(*) AS n FROM cut GROUP BY 1),
often AS (SELECT source_site, k FROM norm JOIN sites USING (source_site) WHERE k <> ''
          GROUP BY source_site, k, n HAVING count(DISTINCT id) >= 5 AND 20 * count(DISTINCT id) >= n)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": _LINES + "SELECT id, CAST(line_no AS INTEGER) AS line_no FROM norm JOIN often USING (source_site, k)",
        "p7_clean": _LINES
        + """, kept AS (SELECT id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM norm ANTI JOIN often USING (source_site, k) GROUP BY 1)
SELECT p.id, CASE WHEN p.raw_text IS NULL THEN NULL WHEN p.raw_text = '' OR p.source_site IS NULL THEN p.raw_text ELSE coalesce(kept.text, '') END AS text
FROM project p LEFT JOIN kept ON p.id = kept.id""",
    }
