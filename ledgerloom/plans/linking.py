"""Queries that link records, cluster them and group their events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import linking
from ..operators.components import components
from ..session import checkpointed
from .tables import table
from .texts import SUFFIXES


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Notices with a compact name and a province, the prefix of their blocks."""
    rows = table(spark, d, "project").select("id", "source_site", "owner", "region", "project_stage", "created_at", T.identity_text(T.canonical_name(F.col("project_name"), SUFFIXES)).alias("name"))
    return rows.withColumn("province", T.first_label(F.col("region"), {"北京": ["北京"], "天津": ["天津"], "河北": ["河北"]}, ""))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    rows = _named(spark, d).filter("province <> '' and name <> ''")
    return linking.blocks(rows, "id", F.transform(T.ngrams(F.col("name"), 6), lambda g: F.concat("province", F.lit("|"), g)))


def ngram_block_sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = linking.block_sizes(_keyed(spark, d))
    return sizes.groupBy("size").agg(F.count("*").alias("blocks"))


def ngram_blocking_pairs(spark: SparkSession, d: str) -> DataFrame:
    return linking.blocked_pairs(_keyed(spark, d))


def _whole_pairs(rows: DataFrame, same: Sequence[str] = (), fields: Sequence[str] = ()) -> DataFrame:
    """(a, b, points) with a < b, and both ends' fields, of all records of one province whose names are equal, or whose names have points by _pointed and whose ``same`` fields are equal and not empty.

    rows: (id, province, name) and the fields. Different names are compared once, then stand for all records that bear them.
    """
    rows = checkpointed(rows.filter("province <> '' and name <> ''").select("id", "province", "name", *dict.fromkeys([*same, *fields])))
    x, y = rows.alias("x"), rows.alias("y")
    ends = [F.col(f"{n}.{f}").alias(f"{e}_{f}") for n, e in ("xa", "yb") for f in fields]
    equal = x.join(y, (F.col("x.province") == F.col("y.province")) & (F.col("x.name") == F.col("y.name")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(45).alias("points"), *ends)
    keys = ["province", *same]
    kept = rows.filter(" and ".join(f"{k} <> ''" for k in keys))
    names = checkpointed(kept.groupBy(*keys, "name").agg(F.min("id").alias("id")))
    alike = linking.similar_candidates(names, keys, T.ngrams(F.col("name"), 3), 55)
    begins = F.transform(F.sequence(F.lit(8), F.length("name") - 1), lambda n: F.xxhash64(*keys, F.substring(F.col("name"), F.lit(1), n)))
    begun = names.filter("length(name) > 8").select(F.col("id").alias("y"), F.explode(begins).alias("key")).join(names.select(F.col("id").alias("x"), F.xxhash64(*keys, "name").alias("key")), "key")
    pairs = alike.unionByName(begun.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()
    both = linking.with_both(pairs, names, "id", [*keys, "name"]).filter(" and ".join(f"a_{k} = b_{k}" for k in keys))
    near = _pointed(both).filter("points > 0").select("a", "b", "points")
    bear = kept.join(names.withColumnRenamed("id", "first"), [*keys, "name"]).select("first", F.struct("id", *fields).alias("row"))
    met = near.join(bear.select(F.col("first").alias("a"), F.col("row").alias("x")), "a").join(bear.select(F.col("first").alias("b"), F.col("row").alias("y")), "b")
    met = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "points")
    return equal.unionByName(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "points", *ends))


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return linking.with_both(ngram_blocking_pairs(spark, d), _named(spark, d), "id", ["name", "owner", "province", "source_site", "created_at"])


def ngram_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    both = _compared(spark, d)
    return both.select("a", "b", F.round(T.jaccard(T.ngrams(F.col("a_name"), 3), T.ngrams(F.col("b_name"), 3)), 4).alias("jaccard"))


def _pointed(compared: DataFrame) -> DataFrame:
    """Adds points: up to 45 of 100, for the names alone."""
    both = compared.withColumn("jaccard", T.jaccard(T.ngrams(F.col("a_name"), 3), T.ngrams(F.col("b_name"), 3)))
    contained = (F.least(F.length("a_name"), F.length("b_name")) >= 8) & (F.startswith("a_name", F.col("b_name")) | F.startswith("b_name", F.col("a_name")))
    return both.withColumn("points", F.when(F.col("a_name") == F.col("b_name"), 45).when(contained, 38).when(F.col("jaccard") >= 0.65, 35).when(F.col("jaccard") >= 0.55, 30).otherwise(0))


def _scored(pointed: DataFrame) -> DataFrame:
    """Pairs with a score of at least 75 of 100, added up from name, owner, source and time."""
    owner = F.when((F.col("a_owner") != "") & (F.col("a_owner") == F.col("b_owner")), 25).otherwise(0)
    apart = F.abs(F.date_diff("a_created_at", "b_created_at"))
    time = F.when(apart <= 730, 5).when(apart > 1460, -10).otherwise(0)
    cross = F.when(F.col("a_source_site") != F.col("b_source_site"), 5).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.col("points") + owner + time + cross + 10 + 10)).cast("int")
    return pointed.filter("points > 0").select("a", "b", score.alias("score")).filter("score >= 75").withColumn("level", F.when(F.col("score") >= 90, "HIGH").otherwise("MEDIUM"))


def pair_score_additive(spark: SparkSession, d: str) -> DataFrame:
    return _scored(_pointed(_compared(spark, d)))


def pair_score_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same scores over all pairs of a province that can reach 75, however common their n-grams are.

    Names that differ have 38 points at most, so without an owner in common they reach 38 + 5 + 5 + 20 = 68: they are compared only where the owners are equal.
    """
    return _scored(_whole_pairs(_named(spark, d), ["owner"], ["owner", "source_site", "created_at"]))


def matching_ratio_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Ratcliff-Obershelp ratio of the pairs whose n-grams don't settle the matter."""
    both = _compared(spark, d).withColumn("jaccard", T.jaccard(T.ngrams(F.col("a_name"), 3), T.ngrams(F.col("b_name"), 3)))
    return both.filter((F.col("a_name") != F.col("b_name")) & (F.col("jaccard") >= 0.4)).select("a", "b", F.round(linking.matching_ratio("a_name", "b_name"), 6).alias("ratio"))


def candidate_queue_merge(spark: SparkSession, d: str) -> DataFrame:
    """The queue of the notices that had come by May brought up to date with all."""
    pairs = pair_score_additive(spark, d)
    came = table(spark, d, "project").filter("created_at < timestamp_ntz '2025-05-01'").select("id")
    old = pairs.join(came.withColumnRenamed("id", "a"), "a", "left_semi").join(came.withColumnRenamed("id", "b"), "b", "left_semi")
    old = old.select("a", "b", F.col("score").cast("string").alias("evidence"), F.when(F.col("level") == "HIGH", "CONFIRMED").otherwise("DEFERRED").alias("status"))
    return linking.merged_queue(old, pairs.select("a", "b", F.col("score").cast("string").alias("evidence")), ["a", "b"], "evidence")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Each notice with the first of its page and the first with its number: stars, never all pairs of a group."""
    rows = table(spark, d, "project").select("id", F.explode(F.array(F.concat(F.lit("u"), "url"), F.concat(F.lit("n"), T.identifier(F.col("project_no"))))).alias("key")).filter("key is not null and length(key) > 5")
    first = rows.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(first, "key").filter("id > a").select("a", F.col("id").alias("b"))


def components_min_label(spark: SparkSession, d: str) -> DataFrame:
    return components(_edges(spark, d))


def cluster_conflicts(spark: SparkSession, d: str) -> DataFrame:
    members = components_min_label(spark, d).join(_named(spark, d).select(F.col("id").alias("node"), "owner", "province"), "node")
    return linking.cluster_conflicts(members, ["owner", "province"])


def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    """A cluster's suggested name: the most common, the shortest of equals, the smallest of these."""
    from ..operators.grouping import mode

    members = components_min_label(spark, d).join(_named(spark, d).select(F.col("id").alias("node"), "name"), "node")
    return mode(members, ["root"], "name")


def duplicate_audit(spark: SparkSession, d: str) -> DataFrame:
    """Notices of one exact name: how many, from how many sources, with one owner or more."""
    rows = _named(spark, d).filter("length(name) >= 6").groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("source_site").alias("sites"), F.count_distinct(F.nullif("owner", F.lit(""))).alias("owners"))
    level = F.when((F.col("sites") > 1) & (F.col("owners") <= 1), "HIGH").when(F.col("owners") <= 1, "MEDIUM").otherwise("NOT_QUEUED")
    return rows.filter("n > 1").withColumn("level", level)


def event_first_fit(spark: SparkSession, d: str) -> DataFrame:
    """Notices of one owner and stage grouped within seven days of the group's first."""
    rows = table(spark, d, "project").filter("owner <> ''").select("id", "owner", "project_stage", F.to_date("created_at").alias("day"))
    return linking.first_fit(rows, ["owner", "project_stage"], "day").select("id", "leader")


def event_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "project").filter("owner <> ''").select("id", "source_site", "owner", "project_stage", F.to_date("created_at").alias("day"))
    led = linking.first_fit(rows, ["owner", "project_stage"], "day")
    return led.groupBy("owner", "project_stage", "leader").agg(F.count("*").alias("n"), F.count_distinct("source_site").alias("sources"), F.min("id").alias("primary_id"), F.max("day").alias("last_day"))


#: Facilities and routes by which records of one place meet.
ANCHORS = (r"(?:国道|省道|县道|高速公路|轨道交通|地铁)\s*[A-Za-z]?\d+(?:号线)?", r"[一-鿿]{2,10}(?:河|渠|水库|泵站|水闸|道路|公路|桥|隧道)")
LOT = r"第?(?:[一二三四五六七八九十]+|[ivx]+|[a-z]{1,3}\d+|\d+)#?标段?"


def _families(spark: SparkSession, d: str) -> DataFrame:
    """(family, key, id): the keys of all four families, each with the province."""
    rows = _named(spark, d).filter("province <> '' and name <> ''").withColumn("parent", F.regexp_replace("name", LOT, ""))
    of = {"exact": F.array("name"), "parent": F.array("parent"), "gram": T.ngrams(F.col("parent"), 6), "anchor": F.concat(*(F.regexp_extract_all("name", F.lit(p), 0) for p in ANCHORS))}

    def keyed(family: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(family).alias("family"), F.concat_ws("|", F.lit(family), "province", k).alias("key")))

    each = F.flatten(F.array(*(keyed(f, keys) for f, keys in of.items())))
    return rows.select("id", F.explode(F.array_distinct(each)).alias("k")).select("k.family", "k.key", "id")


def block_families(spark: SparkSession, d: str) -> DataFrame:
    """Blocks, members and the largest block of each family of keys."""
    sizes = _families(spark, d).groupBy("family", "key").agg(F.count("*").alias("size"))
    return sizes.groupBy("family").agg(F.count("*").alias("blocks"), F.sum("size").alias("members"), F.max("size").alias("largest"))


def family_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share an exact, parent, anchor or gram key with at most 24 others."""
    return linking.blocked_pairs(_families(spark, d).select("key", "id"))


def _clustered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(edges (a, b, score), members (node, root)) of the pairs that score 75 or more."""
    edges = checkpointed(pair_score_additive(spark, d).select("a", "b", "score"))
    return edges, checkpointed(components(edges))


def clusters_by_score(spark: SparkSession, d: str) -> DataFrame:
    """Clusters, those with the best edge first."""
    edges, members = _clustered(spark, d)
    best = edges.join(members, F.col("a") == F.col("node")).groupBy("root").agg(F.max("score").alias("best"), F.count("*").alias("edges"))
    return members.groupBy("root").agg(F.count("*").alias("n")).join(best, "root").orderBy(F.desc("best"), "root")


def cluster_pair_check(spark: SparkSession, d: str) -> DataFrame:
    """Pairs inside each cluster without an edge of their own, and pairs whose owners or provinces differ.

    Counted from the members' values (n over 2 less the pairs of equal ones), so no cluster is expanded into its pairs.
    """
    edges, members = _clustered(spark, d)
    pairs = lambda n: n * (n - 1) / 2
    linked = edges.join(members, F.col("a") == F.col("node")).groupBy("root").agg(F.count("*").alias("edges"))
    out = members.groupBy("root").agg(F.count("*").alias("n")).join(linked, "root").select("root", "n", (pairs(F.col("n")) - F.col("edges")).cast("long").alias("unlinked"))
    valued = members.join(_named(spark, d).select(F.col("id").alias("node"), "owner", "province"), "node")
    for field in ("owner", "province"):
        counts = valued.filter(f"{field} <> ''").groupBy("root", field).agg(F.count("*").alias("c"))
        other = counts.groupBy("root").agg((pairs(F.sum("c")) - F.sum(pairs(F.col("c")))).cast("long").alias(f"other_{field}"))
        out = out.join(other, "root", "left").fillna(0, [f"other_{field}"])
    return out


QUERIES = {
    f.__name__: f
    for f in (
        ngram_block_sizes, ngram_blocking_pairs, ngram_jaccard_pairs, pair_score_additive, pair_score_whole, matching_ratio_pairs, candidate_queue_merge, components_min_label,
        cluster_conflicts, cluster_names, block_families, family_pairs, clusters_by_score, cluster_pair_check, duplicate_audit, event_first_fit, event_groups,
    )
}

_NAMED = rf"""
WITH RECURSIVE named AS (
  SELECT id, source_site, owner, created_at, lower(regexp_replace(regexp_replace(trim(coalesce(project_name, ''), ' '), '(?:[\s\-_]*(?:{"|".join(SUFFIXES)}))+$', ''), '[\s\p{{Z}}\p{{P}}\p{{S}}\p{{Cf}}]+', '', 'g')) AS name,
         CASE WHEN contains(coalesce(region, ''), '北京') THEN '北京' WHEN contains(coalesce(region, ''), '天津') THEN '天津' WHEN contains(coalesce(region, ''), '河北') THEN '河北' ELSE '' END AS province FROM project)
"""
_PAIRS = (
    _NAMED
    + """, keyed AS (SELECT DISTINCT province || '|' || substring(name, i, 6) AS key, id FROM (SELECT *, unnest(range(1, greatest(length(name) - 5, 1) + 1)) AS i FROM named WHERE province <> '' AND name <> '')),
sized AS (SELECT key, count(*) AS size FROM keyed GROUP BY 1),
kept AS (SELECT k.* FROM keyed k JOIN sized USING (key) WHERE size BETWEEN 2 AND 25),
pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM kept x JOIN kept y ON x.key = y.key AND x.id < y.id),
grams AS (SELECT id, list_distinct(list_transform(range(1, greatest(length(name) - 2, 1) + 1), lambda i: substring(name, i, 3))) AS g FROM named WHERE name <> ''),
both_ AS (SELECT a, b, x.name AS a_name, y.name AS b_name, x.owner AS a_owner, y.owner AS b_owner, x.source_site AS a_site, y.source_site AS b_site, x.created_at AS a_at, y.created_at AS b_at,
                 len(list_intersect(g.g, h.g)) / len(list_distinct(list_concat(g.g, h.g))) AS jaccard
          FROM pairs JOIN named x ON x.id = a JOIN named y ON y.id = b JOIN grams g ON g.id = a JOIN grams h ON h.id = b)
"""
)
_SCORES = (
    _PAIRS
    + """, named_score AS (SELECT *, CASE WHEN a_name = b_name THEN 45 WHEN least(length(a_name), length(b_name)) >= 8 AND (starts_with(a_name, b_name) OR starts_with(b_name, a_name)) THEN 38
    WHEN jaccard >= 0.65 THEN 35 WHEN jaccard >= 0.55 THEN 30 ELSE 0 END AS ns, abs(date_diff('day', CAST(b_at AS DATE), CAST(a_at AS DATE))) AS apart FROM both_),
scored AS (SELECT a, b, CAST(greatest(0, least(100, ns + CASE WHEN a_owner <> '' AND a_owner = b_owner THEN 25 ELSE 0 END + CASE WHEN apart <= 730 THEN 5 WHEN apart > 1460 THEN -10 ELSE 0 END
    + CASE WHEN a_site <> b_site THEN 5 ELSE 0 END + 20)) AS INTEGER) AS score FROM named_score WHERE ns > 0),
good AS (SELECT a, b, score, CASE WHEN score >= 90 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM scored WHERE score >= 75)
"""
)
_COMPONENTS = (
    _NAMED
    + r""", cells AS (SELECT id, unnest(['u' || url, 'n' || upper(translate(regexp_replace(coalesce(project_no, ''), '[\s\p{Z}\p{Cf}]+', '', 'g'), '－—–‐‑−﹣', '-------'))]) AS key FROM project),
firsts AS (SELECT key, min(id) AS a FROM cells WHERE length(key) > 5 GROUP BY 1 HAVING count(*) > 1),
edges AS (SELECT DISTINCT a, id AS b FROM cells JOIN firsts USING (key) WHERE id > a),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS node, a AS other FROM sym UNION SELECT r.node, s.b FROM reach r JOIN sym s ON s.a = r.other),
comp AS (SELECT node, min(other) AS root FROM reach GROUP BY 1)
"""
)
_FIRST_FIT = """
WITH RECURSIVE e AS (SELECT id, source_site, owner, project_stage, CAST(created_at AS DATE) AS day FROM project WHERE owner <> ''),
days AS (SELECT DISTINCT owner, project_stage, day FROM e),
leaders AS (SELECT owner, project_stage, min(day) AS leader FROM days GROUP BY 1, 2
  UNION SELECT l.owner, l.project_stage, (SELECT min(d.day) FROM days d WHERE d.owner = l.owner AND d.project_stage = l.project_stage AND d.day > l.leader + 7) FROM leaders l WHERE l.leader IS NOT NULL),
led AS (SELECT e.id, e.source_site, e.owner, e.project_stage, e.day, max(l.leader) AS leader FROM e JOIN leaders l ON l.owner = e.owner AND l.project_stage = e.project_stage AND l.leader <= e.day GROUP BY ALL)
"""
_FAMILIES = (
    _NAMED
    + rf""", base AS (SELECT id, province, name, regexp_replace(name, '{LOT}', '', 'g') AS parent FROM named WHERE province <> '' AND name <> ''),
each AS (SELECT id, 'exact' AS family, province, name AS k FROM base UNION ALL SELECT id, 'parent', province, parent FROM base
  UNION ALL SELECT id, 'gram', province, substring(parent, i, 6) FROM (SELECT *, unnest(range(1, greatest(length(parent) - 5, 1) + 1)) AS i FROM base WHERE parent <> '')
  UNION ALL SELECT id, 'anchor', province, unnest(list_concat(regexp_extract_all(name, '{ANCHORS[0]}', 0), regexp_extract_all(name, '{ANCHORS[1]}', 0))) FROM base),
fam AS (SELECT DISTINCT id, family, family || '|' || province || '|' || k AS key FROM each)
"""
)
_CLUSTERS = _SCORES + """, sym AS (SELECT a, b FROM good UNION SELECT b, a FROM good),
reach AS (SELECT a AS node, a AS other FROM sym UNION SELECT r.node, s.b FROM reach r JOIN sym s ON s.a = r.other),
comp AS (SELECT node, min(other) AS root FROM reach GROUP BY 1), ec AS (SELECT root, score FROM good JOIN comp ON node = a),
sizes AS (SELECT root, count(*) AS n FROM comp GROUP BY 1), linked AS (SELECT root, max(score) AS best, count(*) AS edges FROM ec GROUP BY 1)
"""


def _other(field: str) -> str:
    return f"(SELECT root, CAST((sum(c) * (sum(c) - 1) - sum(c * (c - 1))) / 2 AS BIGINT) AS other_{field} FROM (SELECT root, {field}, count(*) AS c FROM comp JOIN named ON id = node WHERE {field} <> '' GROUP BY 1, 2) GROUP BY 1)"


SQL = {
    "block_families": _FAMILIES + "SELECT family, count(*) AS blocks, CAST(sum(size) AS BIGINT) AS members, max(size) AS largest FROM (SELECT family, key, count(*) AS size FROM fam GROUP BY 1, 2) GROUP BY 1",
    "family_pairs": _FAMILIES + ", kept AS (SELECT * FROM fam WHERE key IN (SELECT key FROM fam GROUP BY 1 HAVING count(*) BETWEEN 2 AND 25)) SELECT DISTINCT x.id AS a, y.id AS b FROM kept x JOIN kept y ON x.key = y.key AND x.id < y.id",
    "clusters_by_score": _CLUSTERS + "SELECT root, n, best, edges FROM sizes JOIN linked USING (root)",
    "cluster_pair_check": _CLUSTERS + f"SELECT root, n, CAST(n * (n - 1) / 2 - edges AS BIGINT) AS unlinked, coalesce(other_owner, 0) AS other_owner, coalesce(other_province, 0) AS other_province FROM sizes JOIN linked USING (root) LEFT JOIN {_other('owner')} USING (root) LEFT JOIN {_other('province')} USING (root)",
    "ngram_block_sizes": _PAIRS + "SELECT size, count(*) AS blocks FROM sized GROUP BY 1",
    "ngram_blocking_pairs": _PAIRS + "SELECT * FROM pairs",
    "ngram_jaccard_pairs": _PAIRS + "SELECT a, b, round(jaccard, 4) AS jaccard FROM both_",
    "pair_score_additive": _SCORES + "SELECT * FROM good",
    "candidate_queue_merge": _SCORES + """, old AS (SELECT g.a, g.b, CASE WHEN level = 'HIGH' THEN 'CONFIRMED' ELSE 'DEFERRED' END AS status FROM good g
  JOIN project x ON x.id = g.a AND x.created_at < TIMESTAMP '2025-05-01' JOIN project y ON y.id = g.b AND y.created_at < TIMESTAMP '2025-05-01')
SELECT a, b, CAST(score AS VARCHAR) AS evidence, coalesce(old.status, 'PENDING') AS status, TRUE AS active FROM good LEFT JOIN old USING (a, b)""",
    "components_min_label": _COMPONENTS + "SELECT node, root FROM comp",
    "cluster_conflicts": _COMPONENTS + """, m AS (SELECT root, owner, province FROM comp JOIN named ON id = node),
c AS (SELECT root, count(*) AS n, count(DISTINCT nullif(owner, '')) AS owners, count(DISTINCT nullif(province, '')) AS provinces FROM m GROUP BY 1)
SELECT *, owners > 1 OR provinces > 1 AS conflict FROM c""",
    "cluster_names": _COMPONENTS + """, m AS (SELECT root, name, count(*) AS n FROM comp JOIN named ON id = node GROUP BY 1, 2)
SELECT root, name, n FROM m QUALIFY row_number() OVER (PARTITION BY root ORDER BY n DESC, length(name), name) = 1""",
    "duplicate_audit": _NAMED + """, g AS (SELECT name, count(*) AS n, count(DISTINCT source_site) AS sites, count(DISTINCT nullif(owner, '')) AS owners FROM named WHERE length(name) >= 6 GROUP BY 1 HAVING count(*) > 1)
SELECT *, CASE WHEN sites > 1 AND owners <= 1 THEN 'HIGH' WHEN owners <= 1 THEN 'MEDIUM' ELSE 'NOT_QUEUED' END AS level FROM g""",
    "event_first_fit": _FIRST_FIT + "SELECT id, leader FROM led",
    "event_groups": _FIRST_FIT + "SELECT owner, project_stage, leader, count(*) AS n, count(DISTINCT source_site) AS sources, min(id) AS primary_id, max(day) AS last_day FROM led GROUP BY 1, 2, 3",
}
