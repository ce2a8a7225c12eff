"""Queries that search, evaluate and resolve facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, facts, search, textindex
from ..session import working_folder
from .tables import table
from .texts import PRODUCTS

ENGLISH = ["drainage", "works"]
HAN = ["沉箱", "管片"]


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return search.bm25(docs, "doc_id", search.tokens(F.col("text")), ENGLISH)


def bm25_search_han(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return search.bm25(docs, "doc_id", search.pairs_of_han(F.col("text")), HAN)


def stored_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The same search from a stored index that took the documents in two batches, one of them twice."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    index = textindex.TextIndex(spark, working_folder(spark, "text-index"))
    index.add(docs.filter("id % 2 = 0").withColumn("text", F.lit("drainage works")), 1)
    index.add(docs.filter("id % 2 = 1"), 2)
    index.add(docs.filter("id % 2 = 0"), 3)
    return index.search(textindex.query_terms(" ".join(ENGLISH)))


def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), search.tokens(F.col("text")).alias("t"))
    return search.phrase_in(docs, ENGLISH).select("id", F.size("starts").alias("times"))


def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", search.snippet(F.col("text"), "沉箱").alias("snippet"))
    return docs.filter("snippet is not null")


def token_snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", search.token_snippet(search.tokens(F.col("text")), "drainage").alias("snippet"))
    return docs.filter("snippet is not null")


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.explode(search.tokens(F.col("text"))).alias("term"))
    per = docs.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """Products named in the text against those matched."""
    gold = ["管片", "箱梁", "圆形顶管", "矩形顶管"]
    named = F.array_compact(F.array(*(F.when(F.col("raw_text").rlike("|".join(PRODUCTS[p])), F.lit(p)) for p in gold)))
    return table(spark, d, "project").select("id", F.col("matched_products").alias("gold"), named.alias("predicted"))


def evaluation_micro(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.micro(_predicted(spark, d), "gold", "predicted")


def evaluation_by_class(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.by_class(_predicted(spark, d), "gold", "predicted")


def rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.agreement(table(spark, d, "reading_label"), "doc_id", "rater", "reading_level", "r1", "r2")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Province facts of each notice from its field and its title, with provenance."""
    labels = {"北京市": ["北京"], "天津市": ["天津"], "河北省": ["河北"]}
    rows = table(spark, d, "project").select("id", T.first_label(F.col("region"), labels, "").alias("field"), T.first_label(F.col("project_name"), labels, "").alias("title"), T.first_label(F.col("raw_text"), labels, "").alias("body"))
    ranks = {"field": (0.9, 3), "title": (0.7, 2), "body": (0.4, 1)}
    each = F.explode(F.array(*(F.struct((F.col("id") * 3 + i).alias("fid"), F.col(c).alias("value"), F.lit(c).alias("source"), F.lit(conf).alias("confidence"), F.lit(rank).alias("source_rank")) for i, (c, (conf, rank)) in enumerate(ranks.items())))).alias("f")
    out = rows.select(F.col("id").alias("notice_id"), each).select(F.col("f.fid").alias("id"), "notice_id", F.lit("province").alias("fact_type"), "f.value", "f.source", "f.confidence", "f.source_rank", F.lit(False).alias("confirmed"))
    return out.filter("value <> ''")


def fact_best_by_rank(spark: SparkSession, d: str) -> DataFrame:
    return facts.best(_facts(spark, d)).select("notice_id", "value", "source")


def fact_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = _facts(spark, d).groupBy("notice_id").agg(F.count_distinct("value").alias("values"), F.array_join(F.array_sort(F.collect_set("value")), ",").alias("all_values"))
    return rows.filter("values > 1")


def fact_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).groupBy("source", "value").agg(F.count("*").alias("n"))


def fact_review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Facts still to be reviewed, where those from the field count as confirmed."""
    all_ = _facts(spark, d)
    reviews = all_.filter("source = 'field'").select(F.col("id").alias("review_id"), "notice_id", "fact_type", "value", "source", F.lit("CONFIRM").alias("action"))
    return facts.review_queue(all_, reviews).select("id", "notice_id", "value", "priority")


def fact_difference(spark: SparkSession, d: str) -> DataFrame:
    """How the province from the title differs from that in the field, and likewise the owner and the tenderer."""
    rows = table(spark, d, "project")
    labels = {"北京市": ["北京"], "天津市": ["天津"], "河北省": ["河北"]}
    old = rows.select("id", T.first_label(F.col("region"), labels, "").alias("province"), F.col("owner").alias("party"))
    new = rows.select("id", T.first_label(F.col("project_name"), labels, "").alias("province"), F.col("tenderer").alias("party"))
    return facts.difference(old, new, "id", ["province", "party"])


QUERIES = {
    f.__name__: f
    for f in (
        bm25_search, bm25_search_han, stored_index_search, phrase_search, search_snippets, token_snippets, term_statistics, evaluation_micro, evaluation_by_class, rater_agreement,
        fact_best_by_rank, fact_conflicts, fact_source_counts, fact_review_queue, fact_difference,
    )
}


def _bm25_sql(toks: str, terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(terms)))
    return f"""
WITH t AS (SELECT doc_id AS id, {toks} AS t FROM documents), c AS (SELECT id, len(t) AS length, {tf} FROM t), s AS (SELECT count(*) AS n, avg(length) AS mean, {df} FROM c)
SELECT id, round({part}, 6) AS score FROM c, s WHERE {" AND ".join(f"tf{i} > 0" for i in range(len(terms)))} ORDER BY score DESC, id LIMIT 20"""


_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_HAN = r"list_filter(list_transform(range(1, greatest(length(coalesce(text, '')) - 1, 1) + 1), lambda i: substring(coalesce(text, ''), i, 2)), lambda g: regexp_full_match(g, '[一-鿿]{2}'))"
_GOLD = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(raw_text, '{'|'.join(PRODUCTS[p])}') THEN '{p}' END" for p in ("管片", "箱梁", "圆形顶管", "矩形顶管")) + "], lambda x: x IS NOT NULL)"
_SETS = f"WITH s AS (SELECT id, list_distinct(coalesce(matched_products, [])) AS g, {_GOLD} AS p FROM project)"
_LABEL = "CASE WHEN contains(coalesce({0}, ''), '北京') THEN '北京市' WHEN contains(coalesce({0}, ''), '天津') THEN '天津市' WHEN contains(coalesce({0}, ''), '河北') THEN '河北省' ELSE '' END"
_FACTS = "WITH f AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT id * 3 + {i} AS id, id AS notice_id, {_LABEL.format(c)} AS value, '{s}' AS source, {conf} AS confidence, {rank} AS source_rank FROM project" for i, (c, s, conf, rank) in enumerate((("region", "field", 0.9, 3), ("project_name", "title", 0.7, 2), ("raw_text", "body", 0.4, 1)))) + ") WHERE value <> '')"
SQL = {
    "bm25_search": _bm25_sql(_TOKENS, ENGLISH),
    "stored_index_search": _bm25_sql(_TOKENS, ENGLISH),
    "bm25_search_han": _bm25_sql(_HAN, HAN),
    "term_statistics": f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1",
    "phrase_search": f"SELECT id, len(s) AS times FROM (SELECT doc_id AS id, list_filter(range(1, len(t) + 1), lambda i: t[i] = 'drainage' AND t[i + 1] = 'works') AS s FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)) WHERE len(s) > 0",
    "search_snippets": """
WITH c AS (SELECT doc_id, text, instr(lower(text), '沉箱') AS spot FROM documents), w AS (SELECT *, greatest(spot - 24, 1) AS start FROM c WHERE spot > 0)
SELECT doc_id, CASE WHEN start > 1 THEN '…' ELSE '' END || substring(text, start, spot - start) || '[' || substring(text, spot, 2) || ']' || substring(text, spot + 2, 24) || CASE WHEN length(text) >= spot + 26 THEN '…' ELSE '' END AS snippet FROM w""",
    "token_snippets": f"""
WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents), w AS (SELECT doc_id, t, list_position(t, 'drainage') AS spot FROM t WHERE list_contains(t, 'drainage')), s AS (SELECT *, greatest(spot - 12, 1) AS start FROM w)
SELECT doc_id, CASE WHEN start > 1 THEN '… ' ELSE '' END || array_to_string(list_transform(t[start:start + 23], lambda x: CASE WHEN x = 'drainage' THEN '[' || x || ']' ELSE x END), ' ') || CASE WHEN len(t) > start + 23 THEN ' …' ELSE '' END AS snippet FROM s""",
    "evaluation_micro": _SETS + """, c AS (SELECT len(list_intersect(g, p)) AS tp, len(p) - len(list_intersect(g, p)) AS fp, len(g) - len(list_intersect(g, p)) AS fn FROM s),
t AS (SELECT count(*) AS cases, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) FILTER (fp = 0 AND fn = 0) AS exact FROM c)
SELECT cases, tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, exact FROM t""",
    "evaluation_by_class": _SETS + """, l AS (SELECT label, list_contains(g, label) AS in_g, list_contains(p, label) AS in_p FROM (SELECT g, p, unnest(list_distinct(list_concat(g, p))) AS label FROM s)),
t AS (SELECT label, count(*) FILTER (in_g) AS support, count(*) FILTER (in_p) AS predicted, count(*) FILTER (in_g AND in_p) AS hit FROM l GROUP BY 1)
SELECT *, round(CASE WHEN predicted > 0 THEN hit / predicted ELSE 1 END, 4) AS precision, round(CASE WHEN support > 0 THEN hit / support ELSE 1 END, 4) AS recall FROM t""",
    "rater_agreement": "SELECT x.reading_level AS a, y.reading_level AS b, count(*) AS n FROM reading_label x JOIN reading_label y ON x.doc_id = y.doc_id AND x.rater = 'r1' AND y.rater = 'r2' GROUP BY 1, 2",
    "fact_best_by_rank": _FACTS + "SELECT notice_id, value, source FROM f QUALIFY row_number() OVER (PARTITION BY notice_id ORDER BY confidence DESC, source_rank DESC, id) = 1",
    "fact_conflicts": _FACTS + "SELECT notice_id, count(DISTINCT value) AS values, string_agg(DISTINCT value, ',' ORDER BY value) AS all_values FROM f GROUP BY 1 HAVING count(DISTINCT value) > 1",
    "fact_source_counts": _FACTS + "SELECT source, value, count(*) AS n FROM f GROUP BY 1, 2",
    "fact_review_queue": _FACTS + """, o AS (SELECT * FROM f WHERE source <> 'field'), v AS (SELECT notice_id, count(DISTINCT value) AS n, min(id) AS first FROM o GROUP BY 1),
r AS (SELECT o.id, notice_id, value, first, CASE WHEN n > 1 THEN 'P0' WHEN confidence < 0.5 THEN 'P1' WHEN confidence < 0.8 THEN 'P2' ELSE 'P3' END AS priority FROM o JOIN v USING (notice_id))
SELECT id, notice_id, value, priority FROM r WHERE priority <> 'P0' OR id = first""",
    "fact_difference": f"""
WITH c AS (SELECT {_LABEL.format("region")} AS o0, {_LABEL.format("project_name")} AS n0, coalesce(owner, '') AS o1, coalesce(tenderer, '') AS n1 FROM project),
x AS (SELECT 'province' AS field, o0 AS o, n0 AS n FROM c UNION ALL SELECT 'party', o1, n1 FROM c)
SELECT field, count(*) FILTER (o <> n AND o = '') AS added, count(*) FILTER (o <> n AND o <> '' AND n = '') AS removed, count(*) FILTER (o <> n AND o <> '' AND n <> '') AS changed, count(*) FILTER (o = n) AS unchanged FROM x GROUP BY 1""",
}
