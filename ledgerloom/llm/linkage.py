"""Matching entities across sources without keys (problem 2).

Both tables are turned into bags of terms over all their attributes (work, place, owner, region,
numbers, phase, and pairs of these). The register is an inverted index with BM25 weights. Retrieval
is exact MaxScore pruning: a match must reach SHARE of the score a notice has with itself, so a
notice's weakest terms, whose upper bounds together stay below that, are never looked up; only its
essential terms, mostly rare pairs, probe the index, and every entry that can reach the bound shares
one of them. The full score is then taken over all shared terms.

A notice's best entry counts if it passes a mutual-nearest test (several notices may belong to one
work, so the entry's side asks that the notice reaches MUTUAL of the entry's best score) and if its
confidence, a logistic calibration over relative score, gap to the second best and agreement of the
attributes, is at least one half. The calibration is fitted around prior weights on silver labels:
pairs that share a project number (as positives, with numbers left out of the features), and
runners-up of these. The weight of a shared number itself comes from the other side: how much more
often pairs whose attributes agree share one than runners-up do. A number that more than SHARED
entries hold (plans of many works) still is a term of the search but names no work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookalikes import REGULAR, Plain, bigrams, fields
from .pii import places
from .regions import Resolver, entries_of
from .spellings import Parser, vocabulary
from .support import char_tables, checkpointed, once, sampled

SHARE = 0.22
MUTUAL = 0.35
K1, B = 1.2, 0.3
#: Pairs taken into the fit of the calibration, by hash of their ids.
FITTED = 5_000
FEATURES = ("relative", "gap", "work", "place", "owner_same", "owner_other", "region_same", "region_other", "phase_same", "phase_other", "phase_missing", "neither", "phase_lone")
#: What every match should have, as prior weights of the calibration (constant first), so that a small or one-sided sample stays sane.
PRIOR = (-4.0, 2.0, 2.0, 3.0, 1.0, 1.5, -1.5, 1.0, -9.0, 1.5, -12.0, -3.0, -12.0, -9.0)
#: A number that more register entries than this share names no work; the shortest that may name one.
SHARED, SHORTEST = 2, 6
_REGULAR = re.compile(f"{REGULAR}*")
#: Digits of phases.
DIGITS = {"一": "1", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9", "十": "10", "I": "1", "II": "2", "III": "3", "IV": "4", "V": "5", "Ⅰ": "1", "Ⅱ": "2", "Ⅲ": "3"}
_NOTICE = re.compile(r"(?:(?:施工|监理|设计|勘察|材料|设备)?(?:招标计划|招标公告|采购公告|资格预审公告|竞争性谈判采购公告|竞争性磋商公告)|中标候选人公示|中标结果公告|中标公告|成交公告|更正公告|变更公告|终止公告)$")
_NOTICE_OTHER = re.compile(r"[一-鿿]{0,4}(?:公告|公示|通知)$")
_LOT = re.compile(r"(?:[A-Z]{1,3}-?\d+标段?|第?[一二三四五六七八九十IVX\d]+#?标段|[A-Z]区|EPC总承包|施工总承包|标段)")
_PHASE = re.compile(r"[(（]?第?([一二三四五六七八九十]|[IVⅠⅡⅢ]+|\d)期(?:工程|项目)?[)）]?")
_TAIL = re.compile(r"(?:工程|项目)+$")
#: What follows a place's own name; a region's name before it is part of that name.
FACILITY = "路街镇园线渠河村"


class Bag:
    """Attributes of a record, as typed -> the normal forms they are compared by."""

    def __init__(self, plain: Plain, parser: Parser, resolver: Resolver):
        self.plain, self.parser, self.resolver = plain, parser, resolver
        self.districts = {e.id for found in resolver.by_base.values() for e in found}
        self.regions: dict[str, int] = {}
        self.owners: dict[str, str] = {}

    def clean(self, v: str | None) -> str:
        return "" if not v else v if _REGULAR.fullmatch(v) else self.plain(v)

    def region(self, v: str) -> int:
        if v not in self.regions:
            if len(self.regions) > 100_000:
                self.regions.clear()
            self.regions[v] = self.resolver(v) if v.strip() else 0
        return self.regions[v]

    def owner(self, v: str) -> str:
        if v not in self.owners:
            if len(self.owners) > 100_000:
                self.owners.clear()
            kind, line, _, parts, _ = self.parser(v)
            self.owners[v] = f"{kind}|{line}|{''.join(parts)}" if kind else ""
        return self.owners[v]

    def name(self, v: str) -> tuple[str, str, int]:
        """(work, phase, region id) of a name."""
        s = re.sub(r"\s+", "", v)
        before = None
        while before != s:
            before, s = s, _NOTICE.sub("", s)
        s = _NOTICE_OTHER.sub("", s)
        s = _LOT.sub("", s)
        phase = ""
        if m := _PHASE.search(s):
            phase, s = DIGITS.get(m[1], m[1]), s[: m.start()] + s[m.end() :]
        s = _LOT.sub("", s)
        where = ""
        if m := re.search(r"[(（]([一-鿿]{2,8})[)）]", s):
            if self.region(m[1]):
                where = m[1]
            s = s[: m.start()] + s[m.end() :]
        found, rest = self.parser.region_of(s)
        if found and len(rest) >= 4 and rest[0] not in FACILITY:
            where, s = where or s[: len(s) - len(rest)], rest
        s = _TAIL.sub("", re.sub(r"[()（）\-—_]", "", s))
        return s, phase, self.region(where) if where else 0

    def number(self, v: str) -> str:
        s = re.sub(r"^[^0-9A-Za-z]*[:：]?", "", self.clean(v)).upper()
        s = re.sub(r"-?(?:SG|BD|TJ)\d*$", "", s.replace(" ", ""))
        return re.sub(r"[^0-9A-Z]", "", s)

    def __call__(self, name: str | None, owner: str | None, region: str | None, numbers: list[str]) -> tuple[str, str, str, int, bool, str, list[str]]:
        work, phase, named = self.name(self.clean(name))
        sound = "".join(self.parser.read(work))
        place = "".join(self.parser.read(work[:3]))
        typed = self.region(self.clean(region))
        # a district beats a province, and the name, where it says one, beats the field
        region_id = named if named in self.districts else typed or named
        return sound, place, phase, region_id, region_id not in self.districts, self.owner(self.clean(owner)), sorted({n for x in numbers if (n := self.number(x or ""))})


def bags(records: DataFrame, reference: DataFrame, model: DataFrame) -> DataFrame:
    """(id, work, place, phase, region, wide, owner, numbers), wide where the region is no district. records: (id, name, owner, region, numbers)."""
    spark = records.sparkSession
    tables, gazetteer = char_tables(spark), places(reference)
    words = vocabulary(model.select("owner").filter("owner is not null").distinct(), "owner")
    counts = spark.sparkContext.broadcast(bigrams(fields(model, "id", ["name", "owner"])))
    entries = spark.sparkContext.broadcast(entries_of(reference, model, "region"))
    key = uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bag = once(key, lambda: Bag(Plain(tables.value, counts.value), Parser(tables.value, *gazetteer, words), Resolver(entries.value, tables.value)))
        for b in batches:
            yield pd.DataFrame([(r[0], *bag(r[1], r[2], r[3], list(r[4]) if r[4] is not None else [])) for r in b.itertuples(index=False)], columns=["id", "work", "place", "phase", "region", "wide", "owner", "numbers"])

    return records.select("id", "name", "owner", "region", "numbers").mapInPandas(run, "id long, work string, place string, phase string, region int, wide boolean, owner string, numbers array<string>")


def terms(b: DataFrame) -> DataFrame:
    """Adds terms: array<long>, hashes of the record's terms; a term with an empty part is none."""

    def term(kind: str, *parts: Column) -> Column:
        whole = F.concat_ws("\x01", F.lit(kind), *parts)
        ok = F.lit(True)
        for p in parts:
            ok = ok & (p != "")
        return F.when(ok, F.xxhash64(whole))

    region = F.when(F.col("region") > 0, F.col("region").cast("string")).otherwise("")
    work, place, owner, phase = (F.col(c) for c in ("work", "place", "owner", "phase"))
    kind = F.expr("substring(work, length(place) + 1)")
    made = [
        term("work", work), term("work+phase", work, phase), term("work+region", work, region), term("work+owner", work, owner),
        term("place+region", place, region), term("place+owner", place, owner), term("place", place), term("owner+region", owner, region),
        term("owner", owner), term("region", region), term("type", kind), term("phase", phase),
    ]
    numbers = F.transform("numbers", lambda n: F.xxhash64(F.concat_ws("\x01", F.lit("number"), n)))
    return b.withColumn("terms", F.array_distinct(F.concat(F.array_compact(F.array(*made)), numbers)))


def weights(register: DataFrame) -> tuple[DataFrame, int, float]:
    """(term, idf) of the register's terms, its size and mean bag size."""
    n, mean = register.agg(F.count("*"), F.avg(F.size("terms"))).first()
    df = register.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.select("term", "df", idf.alias("idf")), n, mean or 1.0


def weighted(records: DataFrame, idf: DataFrame, n: int) -> DataFrame:
    """(id, own, w: array<struct<idf, term>>): the score of a record with itself, and its terms that the register has, heaviest first.

    A term the register lacks counts in ``own`` with the weight of one it has never seen.
    """
    unseen = float(np.log(1 + (n + 0.5) / 0.5))
    rows = records.select("id", F.explode("terms").alias("term")).join(idf, "term", "left")
    heavy = F.sort_array(F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("idf", "term"))), asc=False)
    return rows.groupBy("id").agg(F.sum(F.coalesce("idf", F.lit(unseen))).alias("own"), heavy.alias("w"))


def retrieved(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(a, b, score, own): every pair that reaches SHARE of the query's own score.

    queries, index: (id, terms). No pair that reaches the bound is lost and none is capped.
    """
    idf, n, mean = weights(index)
    idf = checkpointed(idf)
    size = index.select(F.col("id").alias("b"), "terms", (1 / (1 + K1 * (1 - B + B * F.size("terms") / mean)) * (K1 + 1)).alias("norm"))
    bound = (K1 + 1) / (1 + K1 * (1 - B))  # no entry's length factor exceeds it
    asked = weighted(queries, idf.select("term", "idf"), n)
    # heaviest first: a term is essential while it and all lighter ones together can still reach the bound
    rest = F.transform("w", lambda x, i: F.struct(x["term"].alias("term"), F.aggregate(F.slice("w", i + 1, F.size("w")), F.lit(0.0), lambda s, y: s + y["idf"]).alias("left")))
    essential = F.filter(rest, lambda x: x["left"] * bound >= SHARE * F.col("own"))
    probing = asked.select(F.col("id").alias("a"), F.explode(F.transform(essential, lambda x: x["term"])).alias("term"))
    posted = index.select(F.col("id").alias("b"), F.explode("terms").alias("term"))
    pairs = checkpointed(probing.join(posted, "term").select("a", "b").distinct())
    scored = pairs.join(asked.select(F.col("id").alias("a"), "w", "own"), "a").join(size, "b")
    score = F.col("norm") * F.aggregate(F.filter("w", lambda x: F.array_contains("terms", x["term"])), F.lit(0.0), lambda s, x: s + x["idf"])
    return scored.select("a", "b", score.alias("score"), "own").filter(F.col("score") >= SHARE * F.col("own"))


def compared(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Adds the features of the pairs, ranks and the mutual test."""
    x = left.select(F.col("id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in ("work", "place", "phase", "region", "wide", "owner", "numbers")))
    y = right.select(F.col("id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in ("work", "place", "phase", "region", "wide", "owner", "telling")))
    both = pairs.join(x, "a").join(y, "b")

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    def differs(c: str, none) -> Column:
        return (F.col(f"a_{c}") != none) & (F.col(f"b_{c}") != none) & (F.col(f"a_{c}") != F.col(f"b_{c}"))

    province = F.col("a_wide") | F.col("b_wide")
    both = both.withColumns(
        {
            "work": flag(F.col("a_work") == F.col("b_work")),
            "place": flag(F.col("a_place") == F.col("b_place")),
            "owner_same": flag((F.col("a_owner") != "") & (F.col("a_owner") == F.col("b_owner"))),
            "owner_other": flag(differs("owner", "")),
            "region_same": flag((F.col("a_region") > 0) & (F.col("a_region") == F.col("b_region"))),
            "region_other": flag(differs("region", 0) & ~province),
            "phase_same": flag(F.col("a_phase") == F.col("b_phase")),
            "phase_other": flag(differs("phase", "")),
            "phase_missing": flag((F.col("a_phase") == "") != (F.col("b_phase") == "")),
            "number": flag(F.size(F.array_intersect("a_numbers", "b_telling")) > 0),
            "numbered": flag((F.size("a_numbers") > 0) & (F.size("b_telling") > 0)),
        }
    )
    both = both.withColumns({"neither": (1 - F.col("work")) * (1 - F.col("number")), "phase_lone": F.col("phase_missing") * (1 - F.col("number"))})
    # one number alone can be mistyped, so it never outweighs another phase
    fit = F.col("score") * (1 - 0.5 * F.col("phase_other") - 0.25 * F.col("phase_missing") * (1 - F.col("number")) - 0.3 * F.col("region_other")) * (1 - 0.4 * (1 - F.col("work")) * (1 - F.col("number")))
    both = both.withColumn("fit", fit)
    by_a = Window.partitionBy("a").orderBy(F.desc("fit"), "b")
    best_of_b = both.groupBy("b").agg(F.max("fit").alias("best"))
    both = both.withColumns({"rank": F.row_number().over(by_a), "second": F.lead("fit").over(by_a)}).join(best_of_b, "b")
    return both.withColumns(
        {
            "relative": F.least(F.col("fit") / F.col("own"), F.lit(1.5)),
            "gap": F.when(F.col("rank") == 1, (F.col("fit") - F.coalesce("second", F.lit(0.0))) / F.col("own")).otherwise(0.0),
            "mutual": F.col("fit") >= MUTUAL * F.col("best"),
        }
    )


def calibration(pairs: DataFrame) -> np.ndarray:
    """Weights of the logistic calibration (constant first), from silver labels on at most FITTED pairs."""
    silver = pairs.filter("(rank = 1 and number = 1 and phase_other = 0) or (rank > 1 and number = 0)")
    rows = sampled(silver, FITTED, "a", "b").select(F.col("rank").alias("r"), *FEATURES).toPandas()
    x = np.concatenate([np.ones((len(rows), 1)), rows[list(FEATURES)].to_numpy(dtype=float)], axis=1)
    y = (rows["r"] == 1).to_numpy(dtype=float)
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 2.0 * np.eye(len(w)), x.T @ (y - p) - 2.0 * (w - prior))
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return w


def number_weight(pairs: DataFrame) -> float:
    """How much a shared number says: the log of how often best pairs whose attributes agree share one, over how often runners-up do."""
    agree = (F.col("rank") == 1) & (F.col("work") == 1) & (F.col("owner_same") == 1) & (F.col("phase_same") == 1)
    each = lambda c: [F.count(F.when(c, 1)), F.count(F.when(c & (F.col("number") == 1), 1))]
    n, m, others, u = pairs.filter("numbered = 1").agg(*each(agree), *each((F.col("rank") > 1) & (F.col("work") == 0))).first()
    return float(np.clip(np.log((m + 2) / (n + 4)) - np.log((u + 0.1) / (others + 4)), 0.5, 6.0))


def telling(register: DataFrame) -> DataFrame:
    """Adds telling: the numbers of an entry that name a work, as at most SHARED entries hold them."""
    held = register.select("id", F.explode("numbers").alias("n")).filter(F.length("n") >= SHORTEST)
    few = held.groupBy("n").agg(F.count("*").alias("c")).filter(F.col("c") <= SHARED).select("n")
    good = held.join(few, "n").groupBy("id").agg(F.collect_set("n").alias("telling"))
    return register.join(good, "id", "left").withColumn("telling", F.coalesce("telling", F.array().cast("array<string>")))


def matches(notices: DataFrame, register: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, engineering_project_id, score, confidence): each notice's entry, if it has one.

    notices, register: (id, name, owner, region, numbers array<string>), any of them null but id.
    Records without any term match nothing; of equal candidates the smaller id wins; empty tables
    give an empty result.
    """
    left = checkpointed(terms(bags(notices, reference, notices)))
    right = checkpointed(telling(terms(bags(register, reference, notices))))
    # Without a work there is no place either; owner, region and phase alone stay far below one half (PRIOR's
    # weight of "neither"), so records with neither work nor number, whose terms may all be hot, ask for nothing
    asking = left.filter("work <> '' or size(numbers) > 0")
    pairs = checkpointed(compared(retrieved(asking, right), left, right))
    w = calibration(pairs)
    logit = F.lit(float(w[0]))
    for c, v in zip(FEATURES, w[1:], strict=True):
        logit = logit + F.col(c) * float(v)
    logit = logit + F.col("number") * number_weight(pairs)
    sure = pairs.withColumn("confidence", 1 / (1 + F.exp(-logit)))
    return sure.filter((F.col("rank") == 1) & F.col("mutual") & (F.col("confidence") >= 0.5)).select(F.col("a").alias("id"), F.col("b").alias("engineering_project_id"), "score", "confidence")
