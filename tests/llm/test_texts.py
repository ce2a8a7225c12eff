"""Problems 3, 5 and 7: texts of notices."""

import random

import numpy as np
from ledgerloom.llm import boilerplate, incremental, pii
from pyspark.sql import functions as F

REGIONS = [(1, "北京市", "北京市", "province"), (2, "河北省", "河北省", "province"), (3, "北京市澄川区", "北京市", "district"), (4, "河北省麒林县", "河北省", "district")]


def reference(spark):
    return spark.createDataFrame(REGIONS, "region_id int, region_name string, province string, region_level string")


LINES = [
    ("联系人：柯渡舟　电话：+86 16057423731", [("name", "柯渡舟"), ("phone", "+86 16057423731")]),
    ("招标代理经办人Yan Chenshi，邮箱branlum+zb@office.example。", [("name", "Yan Chenshi"), ("email", "branlum+zb@office.example")]),
    ("项目负责人：郗桐骏，身份证号：110199199309121585", [("name", "郗桐骏"), ("id_number", "110199199309121585")]),
    ("安全员证件：G1758865（柯坪文）", [("id_number", "G1758865"), ("name", "柯坪文")]),
    ("投诉受理：滕玉，河北省麒林县义远巷12号远义大厦A座154室，(0319)1319165", [("name", "滕玉"), ("address", "河北省麒林县义远巷12号远义大厦A座154室"), ("phone", "(0319)1319165")]),
    ("现场踏勘请与缪坪岚联系（１５４２８５２１７９１），集合地点为北京澄川区涵朗西路223号。", [("name", "缪坪岚"), ("phone", "１５４２８５２１７９１"), ("address", "北京澄川区涵朗西路223号")]),
    ("如有疑问，可致电010-18204262转820或来函lum_vel11 [at] zbcg.example.org咨询。", [("phone", "010-18204262转820"), ("email", "lum_vel11 [at] zbcg.example.org")]),
    ("评标委员会成员：尹沐、柯泰梧、Xi Bingming。", [("name", "尹沐"), ("name", "柯泰梧"), ("name", "Xi Bingming")]),
]
CLEAN = ["某公司投标保证金账户6215568503147469013，户名同招标人。", "霞坪57号楼及80号泵站纳入工程范围。", "工程联系人：详见招标文件第26页。", "工程位于北京市澄川区湾路与泰街交口西侧。", "统一社会信用代码91110199MA7G0KXN7A。", "工程概算编号202235924324.2，单位为元。"]


def test_personal_information(spark):
    texts = [("\n".join(l for l, _ in LINES), 1), ("\n".join(CLEAN), 1), (None, 1), ("", 1), ("  \n", 1), ("页\n" * 30_000 + LINES[0][0], 1)]
    df = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(texts * 6)], "id long, raw_text string, votes int")
    got = {}
    for r in pii.found(df, reference(spark)).collect():
        got.setdefault(r.id, set()).add((r.pii_kind, r.pii_value))
    assert got[0] == {x for _, xs in LINES for x in xs}
    assert got[5] == set(LINES[0][1]) and not {1, 2, 3, 4} & set(got)
    clean = {r.id: r.text for r in pii.redacted(df, reference(spark)).collect()}
    assert clean[2] is None and clean[3] == "" and clean[4] == "  \n" and clean[1] == texts[1][0]
    assert clean[0].split("\n")[0] == "联系人：[NAME]　电话：[PHONE]" and clean[5].startswith("页\n页")
    assert all(v not in clean[0] for _, xs in LINES for _, v in xs)


def test_personal_information_of_nothing(spark):
    assert pii.found(spark.createDataFrame([], "id long, raw_text string"), reference(spark)).count() == 0
    assert pii.redacted(spark.createDataFrame([], "id long, raw_text string"), reference(spark)).count() == 0


def test_anchors_leave_out_no_candidate():
    find = pii.Finder(["澄川区"], ["北京市", "北京"])
    rng = random.Random(4)
    words = [w.replace(" ", x) for w in (*pii.BEFORE, *pii.LISTS, *pii.ACTS, *pii.TITLES, *pii.DETAILS) for x in ("", " ")]
    lines = [f"{a}{m}王建国{m}{b}" for a in words for m in (":", "：", "", " ", "(") for b in ("", "。", "、李晓明", *rng.sample(words, 3))]
    lines += [f"{a}王建国{b}" for a in ("（", "1(", "与", ",", "") for b in words + ["(13812345678)", "，138－1234－5678", ", +86 13812345678", "）"]]
    lines += ["138－1234－5678", "a [at] b.cn", "a@b.cn", "（0319）1319165", "北京澄川区涵朗西路223号", "名单：" + "、".join(["王建国"] * 300), "CONTACT: Wang Jianguo", "attn:Wang Jianguo, tel"]
    rng.shuffle(lines)
    text = "\n".join(lines)
    key = lambda x: (x[0], *x[2])
    every = sorted(find(text, anchored=False), key=key)
    assert sorted(find(text), key=key) == every and len(every) > 900
    said = {x[1][x[2].start : x[2].end] for x in every}
    assert {"王建国", "138-1234-5678", "a@b.cn", "Wang Jianguo"} <= said
    assert sum(x[1].startswith("名单") and x[2].kind == "name" for x in every) >= 300


def test_names_by_any_label(spark):
    labels = ["安全员：", "质检员:", "施工员:", "寄件人:", "供稿：", "联系人："]
    df = spark.createDataFrame([(i, f"{labels[i % 6]}王建国\n组长：陈小明、李建军") for i in range(60)], "id long, raw_text string")
    got = {}
    for r in pii.found(df, reference(spark)).collect():
        got.setdefault(r.id, set()).add(r.pii_value)
    assert all(got[i] == {"王建国", "陈小明", "李建军"} for i in range(60))


def test_a_gazetteer_beyond_its_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_ENTRIES", 3)
    import pytest

    with pytest.raises(ValueError):
        pii.places(reference(spark))


def test_reliabilities_find_the_good_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.4
    votes = np.ones((5000, 6), dtype=int)
    for j, good in enumerate((0.95, 0.9, 0.85, 0.6)):
        said = np.where(rng.random(5000) < good, truth, ~truth)
        votes[:, j] = np.where(rng.random(5000) < 0.8, said * 2, 1)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    likely = pii.reliabilities(patterns, counts.astype(float))[where.ravel()]
    places = rng.integers(0, pii.PLACES, (5000, 3))
    places[:, 0] = truth * 7  # a context that tells; it does no harm, but adds nothing over the labelers: both are right in 0.946
    w = pii.span_classifier(votes, places, likely, np.ones(5000))
    p = pii.scored(["name"] * 5000, [pii._votes(*(v - 1)) for v in votes], list(places), {"name": w})
    assert ((likely >= 0.5) == truth).mean() > 0.9 and ((p >= 0.5) == truth).mean() > 0.9


def furniture(site, rng, n):
    return [f"{site} 版权所有 {rng.randint(1, 9)}", f"今日访问 {rng.randint(1, 999)} 人次 {site}", "   "][:n]


def corpus(seed, n):
    rng = random.Random(seed)
    words = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥"
    sentence = lambda: "".join(rng.choice(words) for _ in range(8)) + str(rng.randint(1, 99))
    rows, bodies = [], []
    for i in range(1, n + 1):
        site = rng.choice("ABB")
        if bodies and rng.random() < 0.5:
            body = list(rng.choice(bodies))
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(3)
                if k == 0 and len(body) > 1:
                    body.pop(rng.randrange(len(body)))
                elif k == 1:
                    body.insert(rng.randint(0, len(body)), sentence())
                else:
                    rng.shuffle(body)
        else:
            body = [sentence() for _ in range(rng.randint(1, 9))]
        bodies.append(body)
        lines = [x + "。" for x in body]
        for f in furniture(site, rng, rng.randint(1, 3)):
            lines.insert(rng.randint(0, len(lines)), f)
        text = rng.choice([None, "", " "]) if rng.random() < 0.06 else "\n".join(lines)
        url = rng.choice([None, "", f"HTTP://h.test:80//p/{rng.randint(1, n)}?utm_source=x#a", f"https://h.test/./p/{i}/?b=2&a={i % 7}"])
        rows.append((i, url, site, text))
    return rows


def brute(rows, hashes):
    import collections
    import re

    norm = lambda l: re.sub(r"\d+", "0", l.strip())
    held, total = collections.Counter(), collections.Counter()
    for _, _, site, text in rows:
        if text:
            total[site] += 1
            held.update({(site, norm(l)) for l in text.split("\n") if l.strip()})
    often = {k for k, v in held.items() if v >= 5 and 20 * v >= total[k[0]]}
    lines = {(i, n + 1) for i, _, site, text in rows if text for n, l in enumerate(text.split("\n")) if l.strip() and (site, norm(l)) in often}
    firsts = {}
    for i, _, site, text in rows:
        if text:
            firsts.setdefault((site, norm(max(text.split("\n"), key=len))), (i, text))
    held, total = collections.Counter(), collections.Counter()
    for (site, _), (_, text) in firsts.items():
        total[site] += 1
        held.update({(site, norm(l)) for l in text.split("\n") if l.strip()})
    often = {k for k, v in held.items() if v >= 5 and 20 * v >= total[k[0]]}
    sets = {i: frozenset(s for l in text.split("\n") if l.strip() and (site, norm(l)) not in often for x in l.split("。") if (s := re.sub(r"[\W_]", "", x).lower())) for i, _, site, text in rows if text}
    sets = {i: s for i, s in sets.items() if s}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def union(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            c = len(sets[a] & sets[b])
            if c >= 2 and c >= incremental.THRESHOLD * len(sets[a] | sets[b]) or sets[a] == sets[b]:
                union(a, b)
    keys = collections.defaultdict(set)
    for i, url, _, _ in rows:
        if url:
            path, _, q = re.sub(r"#.*", "", re.sub(r"(?i)^https?://", "", url)).partition("?")
            path = re.sub(r"/+", "/", path.lower().replace(":80", "").replace("/./", "/")).rstrip("/")
            keys[path, tuple(sorted(x for x in q.split("&") if x and not x.startswith("utm")))].add(i)
    for i, h in hashes:
        if h:
            keys[h].add(i)
    for group in keys.values():
        for b in group:
            union(min(group), b)
    return {(find(i), i) for i in list(parent) if find(i) != i}, lines


def tables(spark, rows, hashes):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, url string, source_site string, raw_text string, tokens int, key int")
    return df, spark.createDataFrame(hashes, "notice_id long, content_hash string")


def test_repeats_and_lines_equal_brute_force(spark, monkeypatch):
    for seed, hot in ((1, 50), (2, 2)):
        monkeypatch.setattr(incremental, "HOT", hot)
        rows = corpus(seed, 160)
        hashes = [(r[0], random.Random(r[0]).choice(["", None, f"h{r[0] % 61}", f"x{r[0]}"])) for r in rows]
        df, h = tables(spark, rows, hashes)
        want, lines = brute(rows, hashes)
        assert {(r.id_a, r.id_b) for r in incremental.repeats(df, h).collect()} == want
        assert {(r.id, r.line_no) for r in boilerplate.repeated(df).collect()} == lines


def test_batches_equal_the_whole(spark, tmp_path):
    rows = corpus(4, 120)
    df, h = tables(spark, rows, [(r[0], f"h{r[0] % 53}") for r in rows])
    sets = incremental.token_sets(df).persist()
    whole = {(r.id_a, r.id_b) for r in incremental.repeats(df, h).collect()}
    index = incremental.HistoryIndex(spark, str(tmp_path / "index"))
    for lo, hi in ((0, 50), (50, 80), (80, 121)):
        cut = f"{{}} > {lo} and {{}} <= {hi}"
        part = df.filter(cut.format("id", "id"))
        new = index.add(part, h.filter(cut.format("notice_id", "notice_id")), sets.filter(cut.format("id", "id"))).collect()
        assert all(lo < r.id_b <= hi for r in new)
        for r in new:
            # the group's earliest at that time; groups that later batches join have one earlier still
            assert any(b == r.id_b for _, b in whole)
    assert {(r.id_a, r.id_b) for r in index.groups().collect()} == whole


def test_tokens_that_become_hot_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "HOT", 2)
    rows = [(i, u, None, t) for i, u, _, t in corpus(6, 110)]
    df, h = tables(spark, rows, [(1, None)])
    whole = {(r.id_a, r.id_b) for r in incremental.repeats(df, h).collect()}
    for few in (0, 1000):
        monkeypatch.setattr(incremental, "FEW", few)
        index = incremental.HistoryIndex(spark, str(tmp_path / f"index{few}"))
        for k in range(3 if few == 0 else 2):
            index.add(df.filter(f"id % {3 if few == 0 else 2} = {k}"), h)
        assert {(r.id_a, r.id_b) for r in index.groups().collect()} == whole
        assert index.stored("hot").count() > 0


def test_a_line_that_becomes_frequent_late_keeps_its_list_short(spark, tmp_path):
    text = lambda i: "。".join([f"独{i}", f"有{i}", f"又{i}"] + (["后来人人都写的一句话"] if i > 20 else []))
    df, h = tables(spark, [(i, None, None, text(i)) for i in range(1, 341)], [(1, None)])
    index = incremental.HistoryIndex(spark, str(tmp_path / "index"))
    for batch in ("id <= 60", "id between 61 and 320", "id > 320"):
        index.add(df.filter(batch), h)
    lists = index.stored("postings").groupBy("key", "second").count()
    assert lists.agg(F.max("count")).first()[0] <= incremental.HOT and index.stored("hot").count() == 1
    assert index.groups().count() == 0


def test_postings_do_not_grow_with_copies(spark, tmp_path):
    sizes = []
    for n in (50, 400):
        body = "。".join(f"同一句话{i}" for i in range(12))
        df, h = tables(spark, [(i, None, None, body) for i in range(1, n + 1)], [(1, None)])
        index = incremental.HistoryIndex(spark, str(tmp_path / f"index{n}"))
        index.add(df.filter("id % 2 = 0"), h)
        index.add(df.filter("id % 2 = 1"), h)
        sizes.append((index.stored("postings").count(), index.stored("sets").count()))
        assert index.groups().count() == n - 1 and index.stored("links").count() == n - 1 + 0
    assert sizes[0] == sizes[1]


def test_a_small_batch_reads_the_buckets_of_its_keys(spark, tmp_path):
    df, h = tables(spark, [(i, f"https://h.test/{i % 90}", None, f"句{i}甲。句{i}乙") for i in range(1, 121)], [(1, None)])
    index = incremental.HistoryIndex(spark, str(tmp_path / "index"))
    index.add(df.filter("id <= 100"), h)
    some = index.stored("sets").select("id").limit(2)
    read = index.found("sets", some, True)
    assert read.count() == 2 and len(read.inputFiles()) >= 1 and "In(id" in read._jdf.queryExecution().toString()
    assert {tuple(r) for r in read.select("id").collect()} == {tuple(r) for r in index.found("sets", some, False).select("id").collect()}
    assert {(r.id_a, r.id_b) for r in index.add(df.filter("id > 100"), h).collect()} == {(i - 90, i) for i in range(101, 121)}


def test_late_batches_with_smaller_ids(spark, tmp_path):
    rows = corpus(9, 90)
    rows = [(i, u, None, t) for i, u, _, t in rows]  # no site, so no furniture, which batches see by and by
    df, h = tables(spark, rows, [(r[0], f"h{r[0] % 41}") for r in rows])
    runs = spark.createDataFrame([(r[0], 1 + (r[0] * 7) % 5) for r in rows if r[0] % 11], "id long, run long")
    got = {(r.id_a, r.id_b) for r in incremental.repeats_in_batches(df, h, runs, str(tmp_path / "index")).collect()}
    assert got == {(r.id_a, r.id_b) for r in incremental.repeats(df, h).collect()}


def test_a_third_of_all_rows_in_one_group(spark):
    body = "。".join(f"同一句话{i}" for i in range(12))
    rows = [(i, "https://h.test/same" if i % 3 == 0 else None, "A", body if i % 3 == 1 else f"独{i}。有{i}") for i in range(1, 301)]
    df, h = tables(spark, rows, [(1, None)])
    got = {(r.id_a, r.id_b) for r in incremental.repeats(df, h).collect()}
    assert got == {(3, i) for i in range(6, 301, 3)} | {(1, i) for i in range(4, 301, 3)}


def test_copies_post_once_in_the_index(spark, tmp_path):
    body = [f"同一句话{i}" for i in range(12)]
    near = body[:10] + ["改了的话"]
    text = lambda i: "。".join(body if i % 3 == 1 else near if i in (60, 99) else [f"独{i}", f"有{i}"])
    df, h = tables(spark, [(i, None, None, text(i)) for i in range(1, 121)], [(1, None)])
    index = incremental.HistoryIndex(spark, str(tmp_path / "index"))
    for batch in ("id between 41 and 80", "id <= 40", "id > 80"):
        index.add(df.filter(batch), h)
    for stored in ("sets", "postings"):
        ids = [r.id for r in index.stored(stored).select("id").distinct().collect()]
        assert [i for i in ids if i % 3 == 1] == [43]
        assert [i for i in ids if i in (60, 99)] == [60]
    assert {(r.id_a, r.id_b) for r in index.groups().collect()} == {(1, i) for i in range(2, 121) if i % 3 == 1 or i in (60, 99)}


def test_pages(spark):
    same = ["https://H.test/a/b.html", "http://h.test:80/a/b.html ", "HTTPS://h.test:443//a/./b.html#top", "https://h.test/a/b.html?utm_source=wx&from=timeline"]
    other = ["https://h.test/a/B.html", "https://h.test:8080/a/b.html", "https://h.test/a/b.html?id=1", "nonsense"]
    df = spark.createDataFrame([(u,) for u in [*same, *other, None, "", " "]], "u string")
    got = [r.p for r in df.select(incremental.page_of(F.col("u")).alias("p")).collect()]
    assert len(set(got[:4])) == 1 and len({*got[:1], *got[4:8]}) == 5 and got[8:] == [None] * 3


def test_nothing_repeats_nothing(spark):
    df, h = tables(spark, [(1, None, None, None)], [(1, None)])
    assert incremental.repeats(df.limit(0), h.limit(0)).count() == 0 and incremental.repeats(df, h).count() == 0
    assert boilerplate.repeated(df).count() == 0 and boilerplate.without_repeated(df).count() == 1


def test_repeated_lines_go_and_others_stay(spark, rows):
    site = [(i, "A", f" 分享到　{i} \n正文{chr(0x4E00 + i)}\n\n\t末行") for i in range(6)] + [(7, "A", "正文"), (8, "A", None), (9, None, "分享到 1"), (10, "B", "末行")]
    df = spark.createDataFrame(site, "id long, source_site string, raw_text string")
    assert rows(boilerplate.repeated(df), "id", "line_no") == sorted([(i, n) for i in range(6) for n in (1, 4)], key=str)
    text = {r.id: r.text for r in boilerplate.without_repeated(df).collect()}
    assert text[0] == "正文一\n" and text[7] == "正文" and text[8] is None and text[9] == "分享到 1" and text[10] == "末行"


def test_frequent_sequences_equal_brute_force(spark):
    from itertools import combinations

    rng = random.Random(2)
    docs = [[rng.choice("abcd") for _ in range(rng.randint(1, 6))] for _ in range(40)]
    df = spark.createDataFrame([(i, "S", "\n".join(d)) for i, d in enumerate(docs)], "id long, source_site string, raw_text string")
    key = {r.c: r.k for r in spark.createDataFrame([(c,) for c in "abcd"], "c string").select("c", F.element_at(boilerplate.line_keys(F.col("c")), 1).alias("k")).collect()}
    want = {}
    for d in docs:
        for s in {c for n in (1, 2, 3) for c in combinations(d, n)}:
            want[s] = want.get(s, 0) + 1
    got = {tuple(r.sequence): r.support for r in boilerplate.frequent_sequences(df).collect()}
    assert got == {tuple(key[c] for c in s): n for s, n in want.items() if n >= 5}
