from datetime import date, datetime

from ledgerloom.operators import changes, evaluation, facts, grouping, linking, search, validation
from ledgerloom.operators.components import components
from pyspark.sql import functions as F


def test_flags_see_failed_runs_and_nulls(spark, rows):
    df = spark.createDataFrame([(1, 1, 7, "a"), (2, 2, 7, "a"), (3, 3, 7, None), (4, 4, 7, None), (5, 5, 8, None)], "id long, run_id long, notice_id long, h string")
    out = rows(changes.flags(df, "notice_id", ["run_id"], "h"), "id", "is_first", "is_changed")
    assert out == [(1, True, False), (2, False, False), (3, False, True), (4, False, False), (5, True, False)]


def test_once_per_run_keeps_the_first(spark, rows):
    df = spark.createDataFrame([(2, 1, 7, "b"), (1, 1, 7, "a"), (3, 2, 7, "c")], "id long, run_id long, notice_id long, h string")
    assert rows(changes.once_per_run(df, "run_id", "notice_id", "id"), "id", "h") == [(1, "a"), (3, "c")]


def test_daily_status_prefers_new(spark, rows):
    df = spark.createDataFrame([(1, datetime(2025, 1, 1, 9), True, False), (1, datetime(2025, 1, 1, 10), False, True), (1, datetime(2025, 1, 2, 9), False, True), (1, datetime(2025, 1, 3, 9), False, False)], "k long, at timestamp_ntz, is_first boolean, is_changed boolean")
    assert rows(changes.daily_status(df, "k", "at"), "day", "status", "n") == [(date(2025, 1, 1), "NEW", 2), (date(2025, 1, 2), "UPDATED", 1), (date(2025, 1, 3), "SEEN_AGAIN", 1)]


def test_upsert_keeps_the_first_id(spark, rows):
    df = spark.createDataFrame([(1, 1, "u", "old"), (2, 2, "u", "new"), (3, 3, "v", "x")], "id long, seq long, url string, name string")
    assert rows(changes.upserted(df, ["url"], "seq", "id"), "url", "id", "name", "versions") == [("u", 1, "new", 2), ("v", 3, "x", 1)]


def test_changed_fields_is_null_safe(spark, rows):
    a = spark.createDataFrame([(1, None, 1), (2, "x", 1), (3, "x", 1)], "k long, s string, n int")
    b = spark.createDataFrame([(1, None, 1), (2, None, 1), (4, "y", 2)], "k long, s string, n int")
    assert rows(changes.changed_fields(a, b, "k", ["s", "n"])) == [(2, ["s"]), (3, ["s", "n"]), (4, ["s", "n"])]


def test_best_status_and_trailing_mean(spark, rows):
    df = spark.createDataFrame([("a", 1, "failed", 4.0), ("a", 2, "warning", 2.0), ("a", 3, "odd", 9.0), ("b", 1, "odd", 1.0)], "k string, id long, s string, v double")
    assert rows(df.groupBy("k").agg(changes.best_status(F.col("s"), ["success", "warning", "failed"]).alias("s"))) == [("a", "warning"), ("b", "odd")]
    assert rows(changes.trailing_mean(df, "k", "id", "v", 2), "k", "id", "baseline", "samples") == [("a", 1, None, 0), ("a", 2, 4.0, 1), ("a", 3, 3.0, 2), ("b", 1, None, 0)]


def test_validation_counts_only_accepted_rows_as_seen(spark, rows):
    df = spark.createDataFrame([(1, "", "u"), (2, "n", "u"), (3, "n", "u"), (4, None, "u")], "id long, name string, url string")
    out = validation.validated(df, {"no name": F.col("name") != ""}, ["url"], "id")
    assert rows(out, "id", "accepted", "reasons") == [(1, False, ["no name"]), (2, True, []), (3, False, ["duplicate"]), (4, False, ["no name"])]


def test_fingerprint_ignores_blanks_and_nulls(spark):
    df = spark.createDataFrame([("a  b", None), (" a b ", ""), ("ab", "")], "x string, y string")
    one, two, three = (r.f for r in df.select(validation.fingerprint(F.col("x"), F.col("y")).alias("f")).collect())
    assert one == two != three


def test_fingerprint_of_the_normal_form(spark):
    same = ["工程：一期（A）\n更新时间：2025-01-01\n第2标段", "工程:一期(A)\r\n浏览次数 : 17\r\n第2标段", "工程&#65306;一期(\u200bＡ)\r第２标段\u3000", "<p>工程：一期（A）<br>最后更新: 3</p><script>x()</script><!-- y -->第2标段", "工程：一期（A）\x0b\n\n第②标段"]
    other = ["工程：一期（A）更新时间：2025-01-01 第2标段", "工程：一期（A）第2标段", "a < b & c > d", "<noscript>x</p>y</noscript>z<b>v", "", None, "ﬁ e\u0301 …\x85\x1c㎡", "<![CDATA[k]]>l&amp;lt;m"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(same + other)], "i int, x string")
    got = [tuple(r) for r in df.select("x", validation.normalised(F.col("x")).alias("n"), validation.fingerprint(validation.normalised(F.col("x"))).alias("f"), "i").orderBy("i").collect()]
    assert [n for _, n, _, _ in got] == [validation.normal_text(x or "") for x in same + other]
    assert {n for _, n, _, _ in got[:5]} == {"工程:一期(A) 第2标段"} and len({f for _, _, f, _ in got[:5]}) == 1
    assert [n for _, n, _, _ in got[5:]] == ["工程:一期(A)更新时间:2025-01-01 第2标段", "工程:一期(A)第2标段", "a < b & c > d", "z v", "", "", "fi é ... m2", "k l<m"]


def test_dates_in_all_layouts(spark):
    df = spark.createDataFrame([("2025-01-31",), ("2025/1/31",), ("2025年1月31日",), ("2025-02-30",), ("soon",), (None,)], "d string")
    got = [r.x for r in df.select(validation.sent_dates(F.col("d")).alias("x")).collect()]
    assert got == [date(2025, 1, 31)] * 3 + [None] * 3


def test_mode_breaks_ties(spark, rows):
    df = spark.createDataFrame([("k", "bbb"), ("k", "bbb"), ("k", "cc"), ("k", "cc"), ("k", "aa"), ("k", "aa"), ("k", None)], "k string, v string")
    assert rows(grouping.mode(df, ["k"], "v")) == [("k", "aa", 2)]


def test_single_or_empty_and_shortest(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("a", ""), ("a", None), ("b", "x"), ("b", "yy"), ("c", "")], "k string, v string")
    out = df.groupBy("k").agg(grouping.single_or_empty(F.col("v")).alias("s"), grouping.shortest(F.col("v")).alias("m"))
    assert rows(out) == [("a", "x", "x"), ("b", "", "x"), ("c", None, None)] or rows(out) == [("a", "x", "x"), ("b", "", "x"), ("c", "", None)]


def test_a_name_of_many_entities_keeps_its_relations(spark):
    from itertools import combinations

    from ledgerloom.operators import relating

    schema = "id long, name string, regions array<string>, owners array<string>, identifiers array<string>, phases array<int>"
    made = [(i, "甲路工程", [["R"], ["S"], []][i % 3], ["O"], [], [1] if i % 2 else []) for i in range(1, 31)] + [(i, "乙路", ["R"], [], [], []) for i in (40, 41)]
    e = spark.createDataFrame(made, schema)
    k = spark.createDataFrame([(key, r[0]) for r in made for key in ("甲路", "路")], "key string, id long")
    got = {(r.a, r.b): (r.score, r.relation) for r in relating.related(e, k).collect()}
    few = spark.createDataFrame([(2 * (100 * a + b) + j, f"{a}-{b}", *made[i - 1][2:]) for a, b in combinations(range(1, 31), 2) for j, i in enumerate((a, b))], schema)
    each = {divmod(r.a // 2, 100): (r.score, r.relation) for r in relating.related(few, k.limit(0)).collect()}
    first = {i: min(r[0] for r in made if r[2:] == made[i - 1][2:]) for i in range(1, 31)}
    links = {(first[i], i) for i in first if first[i] < i}
    for (a, b), want in each.items():
        x, y = sorted((first[a], first[b]))
        assert got[(x, y) if x < y else (x, max(a, b))] == want
    assert got.pop((40, 41)) == (65, "SAME")
    assert set(got) <= set(each) and {p for p in got if p[0] != first[p[0]] or p[1] != first[p[1]]} <= links


def test_components_with_a_hot_node_and_a_chain(spark):
    star = [(0, i) for i in range(1, 500)]
    chain = [(1000 + i, 1001 + i) for i in range(60)]
    out = components(spark.createDataFrame([*star, *chain, (5, 5), (7, 0), (None, 3)], "a long, b long"))
    got = {r.node: r.root for r in out.collect()}
    assert len(got) == 500 + 61
    assert {got[i] for i in range(500)} == {0} and {got[1000 + i] for i in range(61)} == {1000}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_pairs_equal_brute_force(spark):
    import random
    from itertools import combinations

    from ledgerloom.plans.linking import _whole_pairs

    rng = random.Random(3)
    made = [(i, rng.choice("PPQ"), "河北省兰璟市琼道路" + "".join(rng.choice("东西桥") for _ in range(rng.randint(0, 9)))) for i in range(1, 81)] + [(81, "", "河北"), (82, "P", ""), (83, "P", "短"), (84, "P", "短")]
    grams = lambda s: {s[i : i + 3] for i in range(max(1, len(s) - 2))}

    def fits(x, y):
        begins = min(len(x), len(y)) >= 8 and (x.startswith(y) or y.startswith(x))
        return begins or len(grams(x) & grams(y)) / len(grams(x) | grams(y)) >= 0.55

    want = sorted((a, b) for (a, p, x), (b, q, y) in combinations(made, 2) if p == q != "" and x and y and fits(x, y))
    df = spark.createDataFrame(made, "id long, province string, name string")
    assert sorted((r.a, r.b) for r in _whole_pairs(df).collect()) == want
    assert (83, 84) in want and len(want) > 500


def test_whole_scores_compare_different_names_of_one_owner_only(spark, rows, tmp_path, monkeypatch):
    import random
    from itertools import combinations

    from ledgerloom.plans.linking import pair_score_whole

    rng = random.Random(5)
    days = [None, datetime(2018, 1, 1), datetime(2022, 6, 1), datetime(2024, 5, 31), datetime(2025, 1, 1)]
    made = [(i, rng.choice(["s", "t", None]), f"o{i}" if i <= 300 else rng.choice(["甲", "乙", "", None]), rng.choice(["河北省", "河北", "天津"]), None, "河北省兰璟市琼道路" + "".join(rng.choice("东西桥") for _ in range(rng.randint(0, 9))), rng.choice(days)) for i in range(1, 381)]
    spark.createDataFrame(made, "id long, source_site string, owner string, region string, project_stage string, project_name string, created_at timestamp_ntz").write.parquet(f"{tmp_path}/project.parquet")
    grams = lambda s: {s[i : i + 3] for i in range(max(1, len(s) - 2))}

    def score(x, y):
        (_, s, o, p, _, n, d), (_, t, q, r, _, m, e) = x, y
        alike = len(grams(n) & grams(m)) / len(grams(n) | grams(m))
        points = 45 if n == m else 38 if n.startswith(m) or m.startswith(n) else 35 if alike >= 0.65 else 30 if alike >= 0.55 else 0
        apart = abs((d - e).days) if d and e else 1000
        return (p[:2] == r[:2] and points > 0) * (points + 25 * bool(o and o == q) + (5 if apart <= 730 else -10 if apart > 1460 else 0) + 5 * bool(s and t and s != t) + 20)

    want = {(x[0], y[0]): score(x, y) for x, y in combinations(made, 2)}
    compared, both = [], linking.with_both
    monkeypatch.setattr(linking, "with_both", lambda pairs, *others: compared.append(pairs.count()) or both(pairs, *others))
    got = rows(pair_score_whole(spark, str(tmp_path)))
    assert got == sorted(((a, b, s, "HIGH" if s >= 90 else "MEDIUM") for (a, b), s in want.items() if s >= 75), key=str)
    assert {75, 80, 83, 90} <= {s for *_, s, _ in got}
    assert sum(compared) < 2000 < sum(s > 0 for s in want.values())


def test_blocks_over_the_limit_make_no_pairs(spark, rows):
    keyed = spark.createDataFrame([("k", i) for i in range(30)] + [("m", 1), ("m", 2), ("x", 5)], "key string, id long")
    assert rows(linking.blocked_pairs(keyed)) == [(1, 2)]


def test_matching_ratio_is_the_usual_one(spark):
    from difflib import SequenceMatcher

    df = spark.createDataFrame([("abcd", "bcde"), (None, "a"), ("", "")], "a string, b string")
    assert [r.x for r in df.select(linking.matching_ratio("a", "b").alias("x")).collect()] == [SequenceMatcher(None, "abcd", "bcde").ratio(), 0.0, 1.0]


def test_queue_keeps_decisions(spark, rows):
    old = spark.createDataFrame([(1, "e", "CONFIRMED"), (2, "e", "DEFERRED"), (3, "e", "DEFERRED"), (4, "e", "PENDING")], "k long, e string, status string")
    new = spark.createDataFrame([(1, "f"), (2, "e"), (3, "f"), (5, "g")], "k long, e string")
    assert rows(linking.merged_queue(old, new, ["k"], "e")) == [(1, "f", "CONFIRMED", True), (2, "e", "DEFERRED", True), (3, "f", "PENDING", True), (4, "e", "PENDING", False), (5, "g", "PENDING", True)]


def test_first_fit_is_greedy(spark, rows):
    days = [1, 5, 8, 9, 16, 20]
    df = spark.createDataFrame([("k", date(2025, 1, x), x) for x in days] + [("k", None, 99)], "k string, day date, id int")
    got = [(r.id, r.leader and r.leader.day) for r in linking.first_fit(df, ["k"], "day").orderBy("id").collect()]
    assert got == [(1, 1), (5, 1), (8, 1), (9, 9), (16, 9), (20, 20), (99, None)]


def test_bm25_needs_all_terms_and_ranks(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta beta gamma gamma gamma"), (3, "alpha"), (4, None), (5, "")], "id long, t string")
    out = search.bm25(df, "id", search.tokens(F.col("t")), ["alpha", "beta"]).collect()
    assert [r.id for r in out] == [1, 2] and out[0].score > out[1].score > 0


def test_phrases_and_snippets(spark, rows):
    df = spark.createDataFrame([(1, "one two three"), (2, "two one"), (3, None)], "id long, t string")
    posted, lengths = search.postings(df, "id", search.tokens(F.col("t")))
    assert rows(search.phrase(posted, ["one", "two"]), "id") == [(1,)]
    assert rows(lengths) == [(1, 3), (2, 2), (3, 0)]
    assert [r.s for r in df.select(search.snippet(F.col("t"), "two", 3).alias("s")).collect()] == ["…ne [two] th…", "[two] on…", None]


def test_micro_and_classes(spark, rows):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (["a"], ["a"]), (None, ["c"])], "g array<string>, p array<string>")
    assert rows(evaluation.micro(df, "g", "p")) == [(3, 2, 1, 1, 0.6667, 0.6667, 1)]
    assert rows(evaluation.by_class(df, "g", "p")) == [("a", 2, 2, 2, 1.0, 1.0), ("b", 1, 0, 0, 1.0, 0.0), ("c", 0, 1, 0, 0.0, 1.0)]


FACTS = "id long, notice_id long, fact_type string, value string, source string, confidence double, source_rank int, confirmed boolean"


def test_reviews_are_applied_in_order(spark, rows):
    f = spark.createDataFrame([(1, 1, "region", "A", "field", 0.9, 3, False), (2, 1, "region", "B", "title", 0.5, 2, False), (3, 2, "region", "C", "field", 0.9, 3, False), (4, 3, "region", "D", "field", 0.9, 3, None), (5, 4, "region", "E", "field", 0.2, 1, False)], FACTS)
    r = spark.createDataFrame([(1, 1, "region", "A", "field", "REJECT"), (2, 2, "region", None, None, "CLEAR"), (3, 3, "region", "Z", "human", "OVERRIDE"), (4, 4, "region", "E", "field", "CONFIRM"), (5, 9, "region", "N", "human", "OVERRIDE")], "review_id long, notice_id long, fact_type string, value string, source string, action string")
    assert rows(facts.resolved(f, r), "notice_id", "value", "decided_by") == [(1, "B", "MACHINE"), (2, None, "CLEAR"), (3, "Z", "OVERRIDE"), (4, "E", "CONFIRM"), (9, "N", "OVERRIDE")]


def test_persisted_facts_stay_and_queue_has_conflicts_first(spark, rows):
    old = spark.createDataFrame([(1, 1, "t", "A", "s", 0.9, 1, False), (2, 1, "t", "B", "s", 0.9, 1, True)], FACTS)
    new = spark.createDataFrame([(3, 1, "t", "C", "s", 0.9, 1, False), (4, 1, "t", "D", "s", 0.3, 1, False), (5, 2, "t", "D", "s", 0.3, 1, False)], FACTS)
    assert rows(facts.persisted(old, new), "value", "active") == [("A", False), ("B", True), ("C", True), ("D", True), ("D", True)]
    none = spark.createDataFrame([], "review_id long, notice_id long, fact_type string, value string, source string, action string")
    assert [(r.id, r.priority) for r in facts.review_queue(new, none).collect()] == [(3, "P0"), (5, "P1")]


def test_chinese_numbers(spark):
    from ledgerloom.functions import text as T

    want = {"一": 1, "十": 10, "十二": 12, "二十": 20, "二十一": 21, "百零三": 103, "三百二十五": 325, "一二": 12, "II": 2, "x": 10, "7": 7, "012": 12, "": None, "甲": None, None: None}
    got = [r.n for r in spark.createDataFrame([(k,) for k in want], "t string").select(T.chinese_number(F.col("t")).alias("n")).collect()]
    assert got == list(want.values())


def test_relations_and_entities(spark, rows):
    from ledgerloom.operators import relating

    e = spark.createDataFrame([(1, "甲路工程", ["R"], ["O"], ["n1"], [1]), (2, "甲路工程", ["R"], [], ["n1"], [2]), (3, "甲路工程东段", ["R"], ["O"], [], []), (4, "乙", [], [], [], [])], "id long, name string, regions array<string>, owners array<string>, identifiers array<string>, phases array<int>")
    k = spark.createDataFrame([("甲", 1), ("甲", 2), ("甲", 3), ("乙", 4)], "key string, id long")
    assert rows(relating.related(e, k)) == [(1, 2, 85, "OTHER_PHASE"), (1, 3, 60, "PART")]
    links = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, ""), (5, "c"), (6, None)], "id long, identifier string")
    assert rows(relating.by_identifiers(links)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)]
