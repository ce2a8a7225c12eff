"""Identities of names, owners, regions and numbers; stored search; hot keys walked in stretches."""

import hashlib
import json
import random
import unicodedata

from ledgerloom.functions import text as T
from ledgerloom.operators import changes, extraction, search, textindex, validation
from pyspark.sql import functions as F


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    return [r.v for r in df.select("id", column(F.col("t")).alias("v")).orderBy("id").collect()]


def test_identities(spark):
    odd = ("ＡB-1_（一）　工程", "Straße①期", "㎡ﬁ", None, "", " \u3000", "北京·天津", "字" * 50_000)
    assert values(spark, T.nfkc, *odd) == [unicodedata.normalize("NFKC", x or "") for x in odd]
    assert values(spark, T.notice_identity, *odd[:2], None) == ["ab1一工程", "strasse1期", ""]
    assert values(spark, T.work_identity, odd[0]) == ["ab-1_一工程"] and values(spark, T.event_identity, odd[0], "a·b") == ["ab1_一工程", "ab"]
    plain = [x for x in odd if x]
    assert values(spark, T.caseless, *plain) == [unicodedata.normalize("NFKC", x).casefold() for x in plain]


def test_owners_and_regions(spark):
    assert values(spark, T.owner_name, " 甲公司，。", "甲\n  公司", "甲", None, "甲公司联系电话", "Ａ公司", "长" * 101) == ["甲公司", "甲 公司", "", "", "", "A公司", ""]
    labels = {"北京市": ["北京市", "东城区"], "河北省": ["河北省", "唐山"]}
    assert values(spark, lambda c: T.only_label(c, labels), "北 京 市", "唐山、北京市", None, "上海", "河北省唐山") == ["北京市", "", "", "", "河北省"]
    got = values(spark, lambda c: T.title_label(c, labels), "北京市甲有限公司唐山项目", "河北省唐山工程", "北京市唐山", None)
    assert [(x.label, x.marker) for x in got] == [("河北省", "唐山"), ("河北省", "河北省"), ("", ""), ("", "")]


def test_numbers_parts_and_parties(spark):
    assert [tuple(x) for x in values(spark, T.number_class, "S123456", "G123456789012", "2025-ABC", "x", "", None)][:5] == [("TRANSACTION", "STRONG"), ("HEBEI_TRANSACTION", "STRONG"), ("ENGINEERING", "STRONG"), ("OTHER", "WEAK"), ("", "")]
    got = values(spark, T.split_name, "某某大型水闸项目预制构件采购", "小项目采购", "某某项目二期项目厂房混凝土采购项目", None)
    assert [(x.core, x.tail) for x in got] == [("某某大型水闸项目", "预制构件采购"), ("小项目采购", ""), ("某某项目二期项目", "厂房混凝土采购项目"), ("", "")]
    assert values(spark, T.part_scope, "厂房混凝土采购", "预制构件采购", "绿化工程", None) == ["厂房", "", "", None] or values(spark, T.part_scope, "厂房混凝土采购")[0] == "厂房"
    assert values(spark, T.result_party, "x\n中标人名称：甲公司，乙", "中标单位: 如下：", None) == ["甲公司", "", ""]
    assert values(spark, T.years, "2025年度与2024年和2025年", None) == [["2025", "2024"], []]
    df = spark.createDataFrame([(["10", "2", "SG-1", "1"],), ([],)], "l array<string>")
    assert [r.o for r in df.select(T.lot_order(F.col("l")).alias("o")).collect()] == [["1", "2", "10", "SG-1"], []]


def test_lots_in_all_forms():
    cases = {"1-3标段": ["1", "2", "3"], "第一、三标段": ["1", "3"], "SG-01标段": ["SG-1"], "2#标段": ["2"], "第二合同段": ["2"], "标段3": ["3"], "某桥二标项目": ["2"], "施工5标": ["5"], "监理TJ02": ["TJ-2"], "目标项目": [], "": [], None: []}
    assert {k: extraction.lots_of(k) for k in cases} == cases


def test_canonical_fingerprint(spark):
    rows = [("名/称\"q\\", None), ("a\tb", "é"), ("", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, b string, a string")
    got = [r.f for r in df.select("id", validation.canonical_fingerprint({"b": F.col("b"), "a": F.col("a")}).alias("f")).orderBy("id").collect()]
    want = [hashlib.sha256(json.dumps({"a": a or "", "b": b or ""}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for b, a in rows]
    assert got == want


def test_running_maxima_and_places_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else "b", f"2025-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} 00:00:00") for i in range(1, 121)]
    df = spark.createDataFrame(rows, "id long, k string, at string").withColumn("at", F.to_timestamp("at"))
    want, best = {}, {}
    for i, k, at in rows:
        want[i] = best.get(k)
        best[k] = max(best.get(k, at), at)
    got = {r.id: str(r.latest_before) if r.latest_before else None for r in changes.latest_before(df, ["k"], "id", "at", 7).collect()}
    assert got == want
    order = {k: sorted((at, i) for i, kk, at in rows if kk == k) for k in ("hot", "b")}
    places = {i: (n + 1, o[n - 1][0] if n else None) for o in order.values() for n, (_, i) in enumerate(o)}
    assert {r.id: (r.n, str(r.before) if r.before else None) for r in changes.numbered(df, "k", "at", "id").collect()} == places


def test_stored_index_equals_a_search_of_the_texts(spark, tmp_path):
    texts = {1: "Drainage works", 2: "works of drainage, drainage", 3: "other works", 4: None, 5: "", 6: "drainage"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    index = textindex.TextIndex(spark, str(tmp_path / "index"))
    index.add(df.withColumn("text", F.lit("drainage works")), 1)
    index.add(df, 2)
    want = search.bm25(df, "id", search.tokens(F.col("text")), ["drainage", "works"])
    assert [tuple(r) for r in index.search(textindex.query_terms(" Drainage; WORKS drainage")).collect()] == [tuple(r) for r in want.collect()]
    index.remove(df.filter("id = 2"), 3)
    assert [r.id for r in index.search(["drainage", "works"]).collect()] == [1] and index.search([]).count() == 0
    assert index.search(["nowhere"]).count() == 0


def test_phrases_and_windows(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["b", "a"]), (3, []), (4, ["a"])], "id long, t array<string>")
    assert {r.id: r.starts for r in search.phrase_in(df, ["a", "b"]).collect()} == {1: [0, 2]}
    got = {r.id: r.s for r in df.select("id", search.token_snippet(F.col("t"), "b", 2).alias("s")).collect()}
    assert got == {1: "a [b] …", 2: "[b] a", 3: None, 4: None}
