"""Queries on texts: dictionaries, evidence, labels, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import table

PRODUCTS = {"管片": ["管片", "盾构"], "箱梁": ["箱梁", "T梁"], "圆形顶管": ["圆形顶管"], "矩形顶管": ["矩形顶管"], "沉箱": ["沉箱"], "塔筒": ["塔筒"], "叠合板": ["叠合板", "装配率"]}
WORDS = [w for ws in PRODUCTS.values() for w in ws]
BEFORE = ["不含", "取消", "不接受", "除"]
AFTER = ["除外", "不适用", "另行招标", "另行委托"]
REGIONS = {"北京": ["北京", "京畿"], "天津": ["天津"], "河北": ["河北", "冀"]}
STAGES = {"结果": ["中标", "成交"], "招标": ["招标公告", "采购公告", "资格预审"], "计划": ["计划"]}
SUFFIXES = ["招标计划", "施工招标公告", "招标公告", "资格预审公告", "竞争性谈判采购公告", "中标候选人公示", "中标结果公告"]
#: Patterns of identifiers inside texts.
IDENTIFIERS = {"交易项目编号": r"(?i)\b(S\d{6,}[A-Za-z0-9_-]*)\b", "工程编号": r"(?i)\b(20\d{2}[-－—][A-Za-z0-9]{2,24})\b", "项目编号": r"(?i)(?:工程|项目|交易|招标)编号[：:\s]*([A-Za-z0-9][A-Za-z0-9_.-]{4,40})"}


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project").select("id", F.posexplode(T.sentences(F.col("raw_text"))).alias("pos", "sentence"))


def sentence_hits(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that hold a keyword, with the keywords."""
    rows = _sentences(spark, d).withColumn("words", T.hits(F.col("sentence"), WORDS)).filter(F.size("words") > 0)
    return rows.select("id", "pos", F.array_join("words", ",").alias("words"))


def negation_contexts(spark: SparkSession, d: str) -> DataFrame:
    rows = _sentences(spark, d).filter(F.col("sentence").rlike("|".join(WORDS)))
    return rows.groupBy("id").agg(F.count("*").alias("contexts"), F.count_if(T.negated(F.col("sentence"), WORDS, BEFORE, AFTER)).alias("negated"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """(id, e): the evidence of each product named, all inside the notice's row."""
    marked = F.filter(F.transform(T.sentences(F.col("raw_text")), lambda x, i: F.struct(i.alias("pos"), x.alias("s"))), lambda x: x["s"].rlike("|".join(WORDS)))
    rows = table(spark, d, "project").select("id", marked.alias("m")).filter(F.size("m") > 0)

    def side(ws: list[str]) -> Column:
        return F.transform(F.filter("m", lambda x: x["s"].rlike("|".join(ws))), lambda x: F.struct(x["pos"].alias("pos"), T.negated(x["s"], ws, BEFORE, AFTER).alias("no")))

    per = F.array(*(F.struct(F.lit(p).alias("product"), side(ws).alias("hits")) for p, ws in PRODUCTS.items()))
    found = F.transform(
        F.filter("per", lambda e: F.size(e["hits"]) > 0),
        lambda e: F.struct(e["product"].alias("product"), F.size(F.filter(e["hits"], lambda h: ~h["no"])).cast("long").alias("positive"), F.size(F.filter(e["hits"], lambda h: h["no"])).cast("long").alias("negative"), e["hits"][0]["pos"].alias("first_pos")),
    )
    return rows.select("id", per.alias("per")).select("id", found.alias("e"))


def _strength(e: Column) -> Column:
    return (F.when(e["positive"] == 0, 0).otherwise(F.least(F.lit(100), 40 + 20 * e["positive"]) - F.when(e["negative"] > 0, 20).otherwise(0))).cast("int")


def product_evidence(spark: SparkSession, d: str) -> DataFrame:
    """One row per notice and product named: sentences for and against, title hit, strength."""
    rows = _evidence(spark, d).select("id", F.explode("e").alias("e"))
    return rows.select("id", "e.product", "e.positive", "e.negative", "e.first_pos", _strength(F.col("e")).alias("strength"))


def evidence_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per notice: the strongest product (the earliest named of equals), and how many are named at all."""
    best = F.array_max(F.transform("e", lambda x: F.struct(_strength(x).alias("strength"), (-x["first_pos"]).alias("at"), x["product"].alias("product"))))
    return _evidence(spark, d).select("id", best.alias("b"), F.size("e").cast("long").alias("products")).select("id", F.col("b.product").alias("strongest"), "b.strength", "products")


def evidence_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project").filter("raw_text <> ''").select("id", T.excerpt(F.col("raw_text"), WORDS).alias("excerpt"))


def title_stages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project").select("id", T.first_label(F.col("project_name"), STAGES, "其他").alias("stage"))


def region_multi_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project").select("id", T.multi_label(F.concat_ws(" ", "region", "project_name"), REGIONS).alias("regions"))


def title_filter(spark: SparkSession, d: str) -> DataFrame:
    """Titles on works: a deny list, an exception to it, an allow list."""
    name = F.col("project_name")
    denied, excepted, allowed = name.rlike("监理|设计|勘察|检测"), name.rlike("EPC|总承包"), name.rlike("工程|项目|施工|改造")
    return table(spark, d, "project").filter((~denied | excepted) & allowed).select("id", "project_name")


def text_identifiers(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws("\n", "project_name", F.concat(F.lit("项目编号:"), "project_no"), "raw_text")
    rows = table(spark, d, "project").select("id", T.extracted(text, IDENTIFIERS).alias("found")).filter(F.size("found") > 0)
    return rows.select("id", F.array_join("found", ";").alias("identifiers"))


def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project").select("id", T.canonical_name(F.col("project_name"), SUFFIXES).alias("name"))


def identity_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project").select("id", T.identity_text(F.col("project_name")).alias("name"), T.identifier(F.col("project_no")).alias("number"))


def lines_of_labels(spark: SparkSession, d: str) -> DataFrame:
    """Lines that begin with a label and a colon, with the value, or the next line where the value is empty."""
    cut = table(spark, d, "project").select("id", F.split("raw_text", "\n").alias("l"))
    lines = cut.select("id", F.posexplode(F.arrays_zip("l", F.slice("l", 2, F.size("l")).alias("next"))).alias("pos", "x")).select("id", "pos", F.col("x.l").alias("line"), "x.next")
    label = F.regexp_extract("line", r"^([^：:\s，。]{2,8})[：:]", 1)
    value = F.trim(F.regexp_replace("line", r"^[^：:\s，。]{2,8}[：:]", ""))
    return lines.filter(label != "").select("id", "pos", label.alias("label"), F.coalesce(F.nullif(value, F.lit("")), F.trim("next"), F.lit("")).alias("value"))


def preceding_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold a date of publication with the three lines before them."""
    cut = table(spark, d, "project").select("id", F.split("raw_text", "\n").alias("l"))
    before = [F.concat(F.array_repeat(F.lit(None).cast("string"), n), "l").alias(f"b{n}") for n in (1, 2, 3)]
    each = cut.select("id", "l", *before).select("id", F.posexplode(F.arrays_zip("l", "b1", "b2", "b3")).alias("pos", "x"))
    return each.filter(F.col("x.l").rlike("发布时间|更新时间")).select("id", "pos", F.col("x.b1").alias("one_before"), F.col("x.b2").alias("two_before"), F.col("x.b3").alias("three_before"))


def document_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return rows.groupBy("source", "lang").agg(
        F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty"),
        F.count_distinct(F.sha2("text", 256)).alias("distinct_texts"), F.max("n_chars").alias("longest"),
    )


def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("text <> ''").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return rows.filter("n > 1")


def scrubbed_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_run").select("id", F.substring(T.scrubbed(F.concat(F.lit("token="), "run_id", F.lit(" error: "), "error")), 1, 3000).alias("message"))
    return rows


def safe_file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project").select("id", T.file_name(F.concat_ws("/", "publish_date", "project_name")).alias("file_name"))


QUERIES = {
    f.__name__: f
    for f in (
        sentence_hits, negation_contexts, product_evidence, evidence_rollup, evidence_excerpts, title_stages, region_multi_match, title_filter, text_identifiers,
        canonical_names, identity_texts, lines_of_labels, preceding_lines, document_profile, exact_copies, scrubbed_errors, safe_file_names,
    )
}

_CUT = r"list_filter(list_transform(string_split(regexp_replace(coalesce({0}, ''), '([。！？；;])', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_SENTENCES = f"""
WITH c AS (SELECT id, {_CUT.format("raw_text")} AS l FROM project),
s AS (SELECT id, unnest(l) AS sentence, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM c)
"""


def _no(words: list[str]) -> str:
    w, b, a = "|".join(words), "|".join(BEFORE), "|".join(AFTER)
    return f"regexp_matches(sentence, '(?:{b})[^。；;]{{0,20}}(?:{w})|(?:{w})[^。；;]{{0,20}}(?:{a})')"


_EVIDENCE = (
    _SENTENCES
    + ", e AS ("
    + " UNION ALL ".join(f"SELECT id, pos, '{p}' AS product, {_no(ws)} AS no FROM s WHERE regexp_matches(sentence, '{'|'.join(ws)}')" for p, ws in PRODUCTS.items())
    + """), g AS (SELECT id, product, count(*) FILTER (NOT no) AS positive, count(*) FILTER (no) AS negative, min(pos) AS first_pos FROM e GROUP BY 1, 2),
v AS (SELECT *, CAST(CASE WHEN positive = 0 THEN 0 ELSE least(100, 40 + 20 * positive) - CASE WHEN negative > 0 THEN 20 ELSE 0 END END AS INTEGER) AS strength FROM g)
"""
)
_LINES = "WITH c AS (SELECT id, string_split(raw_text, chr(10)) AS l FROM project), n AS (SELECT id, unnest(l) AS line, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM c)"
_CLEAN = r"trim(regexp_replace(raw_text, '[ \t\r\n\f]+', ' ', 'g'), ' ')"

SQL = {
    "sentence_hits": _SENTENCES + "SELECT id, pos, words FROM (SELECT id, pos, concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(sentence), '{w.lower()}') THEN '{w}' END" for w in WORDS) + ") AS words FROM s) WHERE words <> ''",
    "negation_contexts": _SENTENCES + f"SELECT id, count(*) AS contexts, count(*) FILTER ({_no(WORDS)}) AS negated FROM s WHERE regexp_matches(sentence, '{'|'.join(WORDS)}') GROUP BY 1",
    "product_evidence": _EVIDENCE + "SELECT * FROM v",
    "evidence_rollup": _EVIDENCE + "SELECT id, arg_max(product, (strength, -first_pos, product)) AS strongest, max(strength) AS strength, count(*) AS products FROM v GROUP BY 1",
    "evidence_excerpts": f"""
WITH c AS (SELECT id, {_CLEAN} AS t FROM project WHERE raw_text <> ''),
g AS (SELECT id, t, list_filter({_CUT.format("t")}, lambda x: regexp_matches(x, '{"|".join(WORDS)}')) AS l FROM c)
SELECT id, substring(CASE WHEN len(l) > 0 THEN array_to_string(l[1:5], ' ') ELSE t END, 1, 600) AS excerpt FROM g""",
    "title_stages": "SELECT id, CASE " + " ".join(f"WHEN regexp_matches(coalesce(project_name, ''), '{'|'.join(m)}') THEN '{k}'" for k, m in STAGES.items()) + " ELSE '其他' END AS stage FROM project",
    "region_multi_match": "SELECT id, concat_ws('、', " + ", ".join(f"CASE WHEN regexp_matches(concat_ws(' ', region, project_name), '{'|'.join(m)}') THEN '{k}' END" for k, m in REGIONS.items()) + ") AS regions FROM project",
    "title_filter": "SELECT id, project_name FROM project WHERE (NOT regexp_matches(project_name, '监理|设计|勘察|检测') OR regexp_matches(project_name, 'EPC|总承包')) AND regexp_matches(project_name, '工程|项目|施工|改造')",
    "canonical_names": rf"SELECT id, regexp_replace(trim(coalesce(project_name, ''), ' '), '(?:[\s\-_]*(?:{'|'.join(SUFFIXES)}))+$', '') AS name FROM project",
    "identity_texts": r"""
SELECT id, lower(regexp_replace(coalesce(project_name, ''), '[\s\p{Z}\p{P}\p{S}\p{Cf}]+', '', 'g')) AS name,
       upper(translate(regexp_replace(coalesce(project_no, ''), '[\s\p{Z}\p{Cf}]+', '', 'g'), '－—–‐‑−﹣', '-------')) AS number FROM project""",
    "lines_of_labels": _LINES + r""", w AS (SELECT *, lead(line) OVER (PARTITION BY id ORDER BY pos) AS next FROM n)
SELECT id, pos, regexp_extract(line, '^([^：:\s，。]{2,8})[：:]', 1) AS label, coalesce(nullif(trim(regexp_replace(line, '^[^：:\s，。]{2,8}[：:]', ''), ' '), ''), trim(next, ' '), '') AS value
FROM w WHERE regexp_matches(line, '^[^：:\s，。]{2,8}[：:]')""",
    "preceding_lines": _LINES + """, w AS (SELECT *, lag(line) OVER o AS one_before, lag(line, 2) OVER o AS two_before, lag(line, 3) OVER o AS three_before FROM n WINDOW o AS (PARTITION BY id ORDER BY pos))
SELECT id, pos, one_before, two_before, three_before FROM w WHERE regexp_matches(line, '发布时间|更新时间')""",
    "document_profile": """
SELECT source, lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (coalesce(trim(text, ' '), '') = '') AS empty,
       count(DISTINCT sha256(text)) AS distinct_texts, max(n_chars) AS longest FROM documents GROUP BY 1, 2""",
    "exact_copies": "SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1",
    "scrubbed_errors": "SELECT id, substring('token=*** error: ' || error, 1, 3000) AS message FROM source_run",
    "safe_file_names": r"""SELECT id, substring(trim(regexp_replace(concat_ws('/', publish_date, project_name), '[\\/:*?"<>|\x00-\x1f]+', '_', 'g'), ' '), 1, 180) AS file_name FROM project""",
}
