"""Problems 1, 2, 4 and 6: values and names."""

import random

import pytest
from ledgerloom.llm import linkage, lookalikes, regions, spellings
from ledgerloom.llm.support import char_tables
from pyspark.sql import functions as F

REGIONS = [(1, "北京市", "北京市", "province"), (2, "天津市", "天津市", "province"), (3, "河北省", "河北省", "province"), (4, "北京市澄川区", "北京市", "district"), (5, "北京市桐柏岭区", "北京市", "district"), (6, "北京市鹭洲区", "北京市", "district"), (7, "天津市鹭洲区", "天津市", "district"), (8, "河北省麒林县", "河北省", "district"), (9, "河北省旭津市", "河北省", "district"), (10, "河北省粟川县", "河北省", "district")]


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame(REGIONS, "region_id int, region_name string, province string, region_level string")


VALUES = {
    "澄川": 4, "北京澄川": 4, "京澄川区": 4, "北京市澄澄川区": 4, "北京市川澄区": 4, "北京程川": 4, "Beijing Chengchuan": 4, "chengchuanqu, BEIJING": 4, "建设地点：北京市澄川区": 4, "澄川区（北京）": 4,
    "北京市澄川县": 4, "北京市岭柏桐区": 5, "桐柏岭区松谷镇": 5, "鹭洲": 0, "鹭洲区,天津市": 7, "天津市鹭洲区粟川路一带": 7, "天津市鷺洲區": 7, "河北麒霖": 8, "河北省津旭市": 9, "旭津市": 9, "河北莲泽": 3,
    "京津冀": 0, "北京市、河北省": 0, "全国": 0, "东锡省白庐市": 0, "冀": 3, "TIANJIN": 2, "河北地区": 3, "北京市粟川县": 0, "100000": 0, "北​京市澄川区": 4,
}


def test_regions(spark, rows, reference):
    ids = {v: i for i, v in enumerate(VALUES)}
    df = spark.createDataFrame([(i, v, 9) for v, i in ids.items()] + [(100, None, 1), (101, "", 1), (102, " 　", 1), (103, "北京市澄川区", 1)], "id long, region string, region_id int")
    got = {r.id: r.region_id for r in regions.mapped(df, reference).collect()}
    assert {v: got.get(i) for v, i in ids.items()} == VALUES
    assert set(got) == set(ids.values())  # null, blank and exact values give no rows
    lost = {r.value: r.n for r in regions.misses(df.unionByName(df.filter("id = 21").withColumn("id", F.lit(200).cast("long"))), reference).collect()}
    assert lost["鹭洲"] == 1 and lost[list(VALUES)[21]] == 2


def test_misses_count_rows_that_share_an_id(spark, reference):
    df = spark.createDataFrame([(1, "全国"), (1, "全国"), (1, "全国"), (2, "chengchuan" * 3)], "id long, region string")
    assert {r.value: r.n for r in regions.misses(df, reference).collect()} == {"全国": 3, "chengchuan" * 3: 1}


def test_regions_of_odd_input(spark, reference):
    assert regions.mapped(spark.createDataFrame([], "id long, region string"), reference).count() == 0
    long = spark.createDataFrame([(1, "北京" * 50_000), (1, "冀"), (1, "冀")], "id long, region string")
    assert sorted(r.region_id for r in regions.mapped(long, reference).collect()) == [1, 3, 3]
    empty = reference.limit(0)
    assert [r.region_id for r in regions.mapped(long.limit(1), empty).collect()] == [0]


def test_region_distance_costs_less_for_usual_errors(spark):
    sound = char_tables(spark).value.pinyin
    assert regions.distance("澄川", "澄川", sound) == 0
    assert regions.distance("程川", "澄川", sound) == regions.distance("川澄", "澄川", sound) == 0.5
    assert regions.distance("松川", "澄川", sound) == 1
    words = ["澄川区", "程川", "桐柏岭区", "柏桐岭", "粟川县", "川"]
    rng = random.Random(3)
    for _ in range(200):  # the symmetric-delete index finds all that are within its distance
        a, b = rng.choice(words), rng.choice(words)
        if sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b)) <= 1:
            assert regions.deletions(a, 1) & regions.deletions(b, 1)


def test_plain_forms(spark, rows):
    cases = {"ＺＢ００-0１": "ZB00-01", "北​方­公司": "北方公司", "Société": "Société", "施⼯招标": "施工招标", "SG—02标": "SG-02标", "𝐄PC总承包": "EPC总承包", "Ѕ1000": "S1000", "ΖΒ00/ΡC": "ZB00/PC", "A　B": "A B", "Ⅱ标段": "II标段", "⻋站": "车站"}
    plain = ["ZB00-01", "北方（集团）公司", "Société", "施工——招标", "a  b", "", "Zürich ø"]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate([*cases, *plain])] + [(99, None, 1, "x")], "id long, value string, plain int, field_name string")
    got = {r.id: (r.value, r.plain) for r in lookalikes.plain_forms(df, ["value"]).collect()}
    assert {v: p for v, p in (got[i] for i in range(len(cases)))} == cases
    assert all(v == p for v, p in (got[i] for i in range(len(cases), len(cases) + len(plain)))) and 99 not in got
    assert rows(lookalikes.disguised(df, ["value"]), "id") == sorted(((i,) for i in range(len(cases))), key=str)


def test_latin_letters_in_words_of_another_script(spark):
    df = spark.createDataFrame([(1, "BETOHHЫЙ завoд"), (2, "Λόγoς"), (3, "БЕТОН ABC-12"), (4, "ABC12")], "id long, value string")
    got = {r.id: r.plain for r in lookalikes.plain_forms(df, ["value"]).collect()}
    assert got == {1: "ВЕТОННЫЙ завод", 2: "Λόγος", 3: "БЕТОН ABC-12", 4: "ABC12"}


def test_plain_forms_keep_real_scripts_and_long_texts(spark):
    df = spark.createDataFrame([(1, "Москва"), (2, "Ｘ" * 20_000), (3, "​")], "id long, value string")
    got = {r.id: r.plain for r in lookalikes.plain_forms(df, ["value"]).collect()}
    assert got == {1: "Москва", 2: "X" * 20_000, 3: ""}
    assert lookalikes.disguised(df.limit(0), ["value"]).count() == 0


def test_spellings(spark, reference):
    groups = [
        ["澄川区瑞麟沐路桥工程有限公司", "澄川瑞麟沐路桥工程有限公司", "北京市澄川区瑞麟沐路桥工程有限公司", "瑞麟沐路桥", "瑞麟沐(澄川)路桥工程有限公司", "业主:澄川区瑞麟沐路桥工程有限公司", "澄川区瑞林沐路桥工程有限公司", "澄川区麟瑞沐路桥工程有限公司", "澄川区瑞麟沐沐路桥工程有限公司", "Ruilinmu路桥工程有限公司", "澄川区瑞麟沐路桥工有限公司", "澄川区瑞麟沐路桥工程有限公 司"],
        ["澄川区瑞麟沐预制构件有限公司", "瑞麟沐预制"],
        ["Voskdimulmsol Bridge and Tunnel Co., Ltd.", "VOSKDIMULMSOL BRIDGE AND TUNNEL CO LTD", "Voskdimulmsol Bridge & Tunnel", "Bridge and Tunnel Voskdimulmsol Ltd", "Voskdiulmsol Bridge and Tunnel Co. Ltd", "The Voskdimulmsol Bridge and Tunnel Company Limited"],
        ["Voskdimulmsol Marine Works Co., Ltd.", "Voskdimulmsol Marine Wks"],
        ["Voskkimulmsol Bridge and Tunnel Co., Ltd."],
        ["桓涵章", "桓 涵章", "桓涵张", "桓涵章经理", "Huan, Hanzhang", "Hanzhang Huan", "HUAN Hanzhang", "Han-Zhang Huan"],
        ["桓涵文"],
    ]
    # others in the same lines of business, from which the lines are learned
    others = [f"{r}区{a}{b}{c}{line}有限公司" for line in ("路桥工程", "预制构件") for r, a, b, c in (("鹭洲", x, y, z) for x, y, z in zip("松梅兰竹菊荷桂桐槐柳杉柏", "谷川溪岭峰湖泉滩湾渡桥津", "诚信达安泰和顺昌隆盛兴旺", strict=True))]
    others += [f"{n} {t} Co., Ltd." for t in ("Bridge and Tunnel", "Marine Works") for n in ("Zelkor", "Hestvel", "Branum", "Fentol", "Prasquin")]
    values = [(v, 1) for g in groups for v in g] + [(None, 1), ("", 1), ("  ", 1), ("桓涵章", 2), ("桓​涵章", 1)] + [(v, 1) for v in others]
    df = spark.createDataFrame(values, "value string, entity int")
    got = {}
    for r in spellings.classes(df, reference).collect():
        got.setdefault(r.entity, set()).add(r.value)
    mine = [g for g in got.values() if not g & set(others)]
    assert sorted(map(sorted, mine)) == sorted(sorted(set(g) | ({"桓​涵章"} if "桓涵章" in g else set())) for g in groups)
    pairs = {(r.spelling_a, r.spelling_b) for r in spellings.pairs(df, reference).collect()}
    assert all(a < b for a, b in pairs) and ("桓​涵章", "桓涵章") not in pairs and ("桓​涵章", "桓涵张") in pairs
    n = sum(len(g) * (len(g) - 1) // 2 for g in groups) + 7
    assert len(pairs) == n


def variants(rng, region, brand, line, short):
    """Spellings of one name as people type them."""
    i = rng.randrange(len(brand) - 1)
    typed = [f"{region}{brand}{line}有限公司", f"{region[:-1]}{brand}{line}股份有限公司", f"{brand}({region}){line}有限责任公司", f"招标人：{region}{brand}{line}有限公司", f"{region} {brand} {line} 有限公司", f"{region}{brand}{line}公司", f"{brand}{short}"]
    return typed + [f"{region}{brand[:i]}{brand[i + 1]}{brand[i]}{brand[i + 2:]}{line}有限公司", f"{region}{brand[: i + 1]}{brand[i:]}{line}有限公司", f"{region}{brand}{line[:1]}{line[2:]}有限公司"]


def test_names_whose_trades_and_brands_are_in_no_list(spark, reference):
    """Recall and precision over pairs, with all lines of business learned from the names themselves."""
    rng = random.Random(11)
    lines = [("果蔬种业", "种业"), ("冷链物流运输", "冷链"), ("食品饮料加工", "食品"), ("影视文化传媒", "影视"), ("园林绿化养护", "园林")]
    lines = [(l, l[0] + l[2]) for l, _ in lines]
    chars = "岚峻澜霁曜翊珩珞琬琰瑾璟璇瓒芷芮苒茗荔莘菡葭蓁蔚薇蘅"
    truth, made = {}, set()
    for k in range(80):
        brand = "".join(rng.sample(chars, 3))
        line, short = lines[k % 5]
        if (frozenset(brand), line) in made:
            continue
        made.add((frozenset(brand), line))
        for v in variants(rng, rng.choice(["澄川区", "麒林县", "粟川县"]), brand, line, short):
            truth[v] = f"{brand}{line}"
    for k in range(40):
        brand = "".join(rng.choice(["qua", "ren", "tol", "vim", "bas", "dor"]) for _ in range(4)).title() + "xyz"[k % 3]
        for t in ("Cold Storage", "Fruit Packing")[k % 2 : k % 2 + 1]:
            for v in (f"{brand} {t} Co., Ltd.", f"{brand.upper()} {t.upper()} LTD", f"{t} {brand}", f"{brand[:4]}{brand[5:]} {t} Limited", f"The {brand} {t} Company", f"{brand[:-2]}{ {'a': 's', 'o': 'p', 'r': 't', 'n': 'm', 's': 'a', 'l': 'k', 'm': 'n', 'e': 'w'}.get(brand[-2], brand[-2]) }{brand[-1]} {t} Ltd"):
                truth[v] = f"{brand} {t}"
    for family, given in (("苍", "语岚"), ("麻", "知夏"), ("白", "砚秋"), ("顾", "南枝")):
        for v in (f"{family}{given}", f"{family} {given}", f"{family}{given}女士", f"联系人：{family}{given}"):
            truth[v] = family + given
    got = {r.value: r.entity for r in spellings.classes(spark.createDataFrame([(v,) for v in truth], "value string"), reference).collect()}
    values = sorted(truth)
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if truth[a] == truth[b]}
    found = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if a in got and got[a] == got.get(b)}
    assert len(want & found) / len(want) >= 0.9 and len(want & found) / len(found) >= 0.95, (len(want & found) / len(want), len(want & found) / len(found), sorted(want - found)[:40], sorted(found - want)[:20])


def test_most_links_come_from_the_segment_join(spark, reference, monkeypatch):
    values = ["澄川区瑞麟沐路桥工程有限公司", "澄川瑞麟沐路桥工程有限公司", "瑞麟沐(澄川)路桥工程有限公司", "澄川区瑞林沐路桥工程有限公司"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    assert spellings.pairs(df, reference).count() == 6
    monkeypatch.setattr(spellings, "_near", lambda forms: spark.createDataFrame([], "a long, b long"))
    assert spellings.pairs(df, reference).count() == 0


def test_edits():
    assert spellings.edits(list("acme"), list("acne")) == 1 and spellings.edits(list("acme"), list("axle")) > 1
    assert spellings.edits(["rui", "lin"], ["lin", "rui"]) == 1 and spellings.edits(["rui", "lin"], ["rui", "ling"]) == 1


def test_segments_find_all_within_the_distance():
    rng = random.Random(5)
    for _ in range(2000):
        a = [rng.choice("abc") for _ in range(rng.randint(3, 12))]
        b = list(a)
        for _ in range(spellings.K):
            i = rng.randrange(len(b))
            op = rng.randrange(3)
            b = b[:i] + b[i + 1 :] if op == 0 and len(b) > 1 else b[:i] + [rng.choice("abc")] + b[i + (op == 1) :]
        posted = {(i, t) for i, _, t in spellings.segments(a)}
        assert posted & spellings.probes(b), (a, b)


def test_spellings_of_nothing(spark, reference):
    assert spellings.pairs(spark.createDataFrame([], "value string"), reference).count() == 0
    assert spellings.pairs(spark.createDataFrame([("x" * 50_000,), (None,), ("(",)], "value string"), reference).count() == 0


RECORD = "id long, name string, owner string, region string, numbers array<string>, score int"


def test_linkage(spark, rows, reference):
    works = [(901, "北京市澄川区仁骏河排涝泵站工程", "澄川区瑞麟沐路桥工程有限公司", "北京市澄川区", ["2025-180001"], 1), (902, "仁骏河排涝泵站工程（澄川区）第二期", "澄川区瑞麟沐路桥工程有限公司", None, None, 1), (903, "河北麒林县仁骏河排涝泵站", None, "河北省麒林县", [], 1), (904, "北京市澄川区仁骏河河道治理工程", "澄川区瑞麟沐路桥工程有限公司", "北京市澄川区", ["2025/180002"], 1), (905, None, None, None, None, 1)]
    works += [(1000 + i, f"北京市澄川区{a}{b}路隧道工程", f"{b}{a}渡路桥工程有限公司", "北京市澄川区", [f"2024-{i:06d}"], 1) for i, (a, b) in enumerate((a, b) for a in "松梅兰竹菊荷" for b in "谷川溪岭峰")]
    notices = [
        (1, "仁骏河排涝泵站（澄川区）三标段 竞争性谈判采购公告", "瑞麟沐路桥", "北京", ["S1700"], 1), (2, "澄川仁俊河排涝泵站工程EPC总承包招标计划", None, "北京市澄川区", [None], 1), (3, "北京澄川区仁骏河排涝泵站工程II期 资格预审公告", "澄川区瑞麟沐路桥工程有限公司", None, ["项目编号:2025-180009"], 1),
        (4, "仁骏河排涝泵站工程III期", "澄川区瑞麟沐路桥工程有限公司", "北京市澄川区", None, 1), (5, "麒林仁骏河排涝泵站施工招标公告", "x", "冀", None, 1), (6, "北京市澄川区仁骏河河道治理工程中标结果公告", None, None, ["2025 180002-SG2"], 1), (7, None, None, None, None, 1), (8, "", "", "", [""], 1), (9, "北京市澄川区别的河水闸重建工程", "澄川区瑞麟沐路桥工程有限公司", "北京市澄川区", None, 1),
    ]
    notices += [(100 + i, w[1] + "招标计划", w[2], w[3], w[4], 1) for i, w in enumerate(works[5:])]
    n, w = spark.createDataFrame(notices, RECORD), spark.createDataFrame(works, RECORD)
    out = linkage.matches(n, w, reference).collect()
    got = {r.id: r.engineering_project_id for r in out}
    assert {k: v for k, v in got.items() if k < 100} == {1: 901, 2: 901, 3: 902, 5: 903, 6: 904}
    assert all(got[100 + i] == x[0] for i, x in enumerate(works[5:])) and all(0.5 <= r.confidence <= 1 for r in out)


def test_linkage_prunes_exactly(spark):
    """Against all pairs: none that reaches the bound is lost."""
    rng = random.Random(1)
    bag = lambda i: (i, [rng.randrange(40) ** 2 // 40 for _ in range(rng.randint(0, 8))])
    q = spark.createDataFrame([bag(i) for i in range(60)], "id long, terms array<long>").withColumn("terms", F.array_distinct("terms"))
    x = spark.createDataFrame([bag(1000 + i) for i in range(60)], "id long, terms array<long>").withColumn("terms", F.array_distinct("terms"))
    got = {(r.a, r.b): round(r.score, 9) for r in linkage.retrieved(q, x).collect()}
    idf_df, n, mean = linkage.weights(x)
    idf = {r.term: r.idf for r in idf_df.collect()}
    want = {}
    for a in q.collect():
        own = sum(idf.get(t, __import__("math").log(1 + (n + 0.5) / 0.5)) for t in a.terms)
        for b in x.collect():
            norm = (linkage.K1 + 1) / (1 + linkage.K1 * (1 - linkage.B + linkage.B * len(b.terms) / mean))
            s = norm * sum(idf[t] for t in a.terms if t in b.terms)
            if s >= linkage.SHARE * own and s > 0:
                want[a.id, b.id] = round(s, 9)
    assert got == want


def test_linkage_of_nothing(spark, reference):
    none = spark.createDataFrame([], RECORD)
    some = spark.createDataFrame([(1, "某工程", None, None, None, 1)], RECORD)
    for a, b in ((none, none), (none, some), (some, none)):
        assert linkage.matches(a, b, reference).count() == 0
