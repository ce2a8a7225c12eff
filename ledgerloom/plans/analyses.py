"""Queries on what the sentences of notices say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis as A
from ..functions import text as T
from .tables import table
from .texts import _CUT, AFTER, BEFORE, PRODUCTS, WORDS


def _said(spark: SparkSession, d: str) -> DataFrame:
    """(id, pos, location, sentence) of titles (pos -1) and texts."""
    title = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(A.TITLE).alias("location"), F.coalesce("project_name", F.lit("")).alias("s")))
    body = F.transform(T.sentences(F.col("raw_text")), lambda x, i: F.struct(i.alias("pos"), F.lit(A.BODY).alias("location"), x.alias("s")))
    return table(spark, d, "project").select("id", F.explode(F.concat(title, body)).alias("x")).select("id", "x.pos", "x.location", F.col("x.s").alias("sentence"))


def sentence_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = _said(spark, d)
    return rows.select("id", "pos", A.section(F.col("location"), F.col("sentence")).alias("section"))


def work_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that name a product and speak of the work, with their section."""
    rows = _said(spark, d).withColumn("section", A.section(F.col("location"), F.col("sentence")))
    return rows.filter(A.about_works(F.col("section"), F.col("sentence"), WORDS)).select("id", "pos", "section")


def notice_intents(spark: SparkSession, d: str) -> DataFrame:
    """What each notice wants, by the sentences that name a product."""
    rows = table(spark, d, "project").select("id", F.array_join(F.filter(T.sentences(F.col("raw_text")), lambda x: x.rlike("|".join(WORDS))), "\n").alias("t"))
    return rows.filter("t <> ''").select("id", A.intent(F.col("t"), "未知").alias("intent"))


def procurement_subjects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project").select("id", A.subject(F.concat(F.coalesce("project_name", F.lit("")), F.lit("预制构件采购"))).alias("subject"))


def scope_confirmations(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pipes' rings stay in scope where a sentence speaks against them."""
    ws = PRODUCTS["管片"]
    s = F.filter(T.sentences(F.col("raw_text")), lambda x: x.rlike("|".join(ws)))
    rows = table(spark, d, "project").select("id", s.alias("s")).filter(F.size("s") > 0)
    no = F.filter("s", lambda x: T.negated(x, ws, BEFORE, AFTER))
    yes = F.filter("s", lambda x: ~T.negated(x, ws, BEFORE, AFTER))
    return rows.select("id", A.confirmed_scope(yes, no, "采购|供应|预制").alias("in_scope"))


QUERIES = {f.__name__: f for f in (sentence_sections, work_contexts, notice_intents, procurement_subjects, scope_confirmations)}

_SAID = f"""
WITH c AS (SELECT id, {_CUT.format("raw_text")} AS l FROM project),
s AS (SELECT id, -1 AS pos, '{A.TITLE}' AS location, coalesce(project_name, '') AS sentence FROM project UNION ALL SELECT id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER), '{A.BODY}', unnest(l) FROM c),
x AS (SELECT *, CASE WHEN location <> '{A.BODY}' THEN location {" ".join(f"WHEN regexp_matches(sentence, '{w}') THEN '{n}'" for n, w in A.SECTIONS)} ELSE location END AS section FROM s)
"""
_NO = f"(?:{'|'.join(BEFORE)})[^。；;]{{0,20}}(?:{'|'.join(PRODUCTS['管片'])})|(?:{'|'.join(PRODUCTS['管片'])})[^。；;]{{0,20}}(?:{'|'.join(AFTER)})"
_BEFORE = "CASE " + " ".join(f"WHEN instr(t, '{a}') > 0 THEN left(t, instr(t, '{a}') - 1)" for a in A.ACTIONS) + " END"
_AFTER = "CASE " + " ".join(f"WHEN instr(t, '{a}') > 0 THEN substring(t, instr(t, '{a}') + {len(a)})" for a in A.ACTIONS) + " END"
SQL = {
    "sentence_sections": _SAID + "SELECT id, pos, section FROM x",
    "work_contexts": _SAID + f"""
, t AS (SELECT *, CASE WHEN section = '{A.TITLE}' THEN regexp_replace(sentence, '{A.COMPANY}', '') ELSE sentence END AS t FROM x)
SELECT id, pos, section FROM t WHERE NOT regexp_matches(t, '{A.BESIDE}') AND NOT regexp_matches(t, '{A.LEFT_OUT}') AND ({" OR ".join(f"contains(lower(t), '{w.lower()}')" for w in WORDS)})
  AND (section IN ({", ".join(f"'{x}'" for x in A.MEANT)}) OR regexp_matches(sentence, '{A.WORKS}'))""",
    "notice_intents": f"""
WITH c AS (SELECT id, array_to_string(list_filter({_CUT.format("raw_text")}, lambda x: regexp_matches(x, '{"|".join(WORDS)}')), chr(10)) AS t FROM project)
SELECT id, CASE {" ".join(f"WHEN regexp_matches(t, '{w}') THEN '{n}'" for n, w in A.INTENTS.items())} ELSE '未知' END AS intent FROM c WHERE t <> ''""",
    "procurement_subjects": f"""
WITH t AS (SELECT id, coalesce(project_name, '') || '预制构件采购' AS t FROM project), c AS (SELECT id, {_BEFORE} AS b, {_AFTER} AS a FROM t),
x AS (SELECT id, regexp_replace(trim(regexp_replace(b, '(?s)^.*[。！？；;：:]', ''), ' ，,（('), '(?s)^.*项目', '') AS l, trim(regexp_replace(a, '(?s)[。！？；;：:].*$', ''), ' ，,）)') AS r FROM c),
f AS (SELECT id, trim(regexp_replace(CASE WHEN l <> '' THEN l ELSE r END, '{A.OPENING}', ''), ' ：:，,') AS f FROM x)
SELECT id, CASE WHEN length(f) BETWEEN 2 AND 80 THEN f ELSE '' END AS subject FROM f""",
    "scope_confirmations": f"""
WITH c AS (SELECT id, list_filter({_CUT.format("raw_text")}, lambda x: regexp_matches(x, '{"|".join(PRODUCTS["管片"])}')) AS s FROM project)
SELECT id, len(list_filter(s, lambda x: regexp_matches(x, '{_NO}'))) = 0 OR len(list_filter(s, lambda x: NOT regexp_matches(x, '{_NO}') AND regexp_matches(x, '采购|供应|预制'))) > 0 AS in_scope FROM c WHERE len(s) > 0""",
}
