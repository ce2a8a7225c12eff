"""Problems 8, 9 and 10: the corpus."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerloom.llm import encoding, mixture, reading


@pytest.fixture(scope="module")
def coders():
    import tiktoken

    ranks = encoding.load_ranks()
    return encoding.Encoder(ranks), tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(blacklist_categories=("Cs",)), st.sampled_from("abc the 中文工程 \n\t0123'")), max_size=60), max_size=4))
def test_ids_equal_the_public_tokenizer(coders, texts):
    ours, public = coders
    ids, ends = ours.encode(texts)
    assert [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(texts))] == [public.encode_ordinary(t) for t in texts]


def test_ids_of_long_pieces(coders, monkeypatch):
    texts = ["中文工程" * 3000, "abcab" * 5000, "x" * 5000, "".join(chr(0x4E00 + i * 7 % 9000) for i in range(6000))]
    ids, ends = coders[0].encode(texts)
    assert [ids[ends[i] : ends[i + 1]].tolist() for i in range(4)] == [coders[1].encode_ordinary(t) for t in texts]
    monkeypatch.setattr(encoding, "LONG", 3)
    coders[0].known.clear()
    some = ["招标公告 and tenders", "équipement", "aaaaaaa"]
    ids, ends = coders[0].encode(some)
    assert [ids[ends[i] : ends[i + 1]].tolist() for i in range(3)] == [coders[1].encode_ordinary(t) for t in some]


def test_ids_of_all_documents(spark, coders):
    texts = [None, "", " ", "<|endoftext|>", "中" * 3000, "word " * 2000, "混合 text\n\n行", "é" * 50]
    df = spark.createDataFrame([(i, t, [9]) for i, t in enumerate([*texts, *texts])], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in encoding.encoded(df).collect()}
    assert got == {i: coders[1].encode_ordinary(t) if t else [] for i, t in enumerate([*texts, *texts])}
    assert encoding.encoded(df.limit(0)).count() == 0


def documents(spark, n=240):
    rng = random.Random(6)
    rows = [(i, "字" * rng.randint(1, 30), rng.choice("AAAAAAB"), 1, 1) for i in range(n)]
    rows += [(900 + i, f"小来源 {i}", "C", 1, 1) for i in range(6)] + [(990, None, "A", 1, 1), (991, "", "B", 1, 1), (992, "无来源", None, 1, 1), (993, "未列", "Z", 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int, bucket int")


TARGETS = [("A", 0.5, 1.0), ("B", 0.3, 2.0), ("C", 0.1, 2.5), ("D", 0.1, 3.0), (None, 0.2, 1.0)]


def test_mixture_meets_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixture, "PER_BUCKET", 20)
    docs, targets = documents(spark), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats double")
    mix = mixture.mixed(docs, targets).collect()
    assert [r.finish_time for r in mix] == sorted(r.finish_time for r in mix) and len({(r.doc_id, r.copy_no) for r in mix}) == len(mix)
    assert {r.source for r in mix} == {"A", "B", "C"} and not {990, 991, 992, 993} & {r.doc_id for r in mix}
    # brute force: each source's cumulative tokens in the order of the mixture, over its weight
    weight, seen = {"A": 0.5 / 0.9, "B": 0.3 / 0.9, "C": 0.1 / 0.9}, dict.fromkeys("ABC", 0)
    for r in mix:
        seen[r.source] += r.n_tokens
        assert abs(seen[r.source] / weight[r.source] - r.finish_time) < 1e-5
    shares = {r.source: r for r in mixture.shares(mixture.mixed(docs, targets), targets).collect()}
    assert set(shares) == {"A", "B", "C", "D"} and shares["D"].tokens == 0 and shares["D"].actual_share == 0
    assert all(abs(shares[s].actual_share - w) < 0.1 for s, w in weight.items()) and shares["C"].most_copies <= 3


def test_mixture_over_the_caps_uses_all(spark):
    docs, targets = documents(spark), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats double")
    mix = mixture.mixed(docs, targets, budget=1e9).collect()
    total = {}
    for r in mixture.mixed(docs, spark.createDataFrame([(s, 1.0, 1.0) for s in "ABC"], "source string, target_share double, max_repeats double"), budget=1e9).collect():
        total[r.source] = total.get(r.source, 0) + r.n_tokens
    used = {}
    for r in mix:
        used[r.source] = used.get(r.source, 0) + r.n_tokens
    assert used["A"] == total["A"] and used["B"] == 2 * total["B"] and 2 * total["C"] <= used["C"] <= 2.5 * total["C"]
    small = mixture.mixed(docs, targets, budget=500.0).collect()
    assert sum(r.n_tokens for r in small) <= 500


def test_mixture_of_nothing(spark):
    docs, targets = documents(spark), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats double")
    assert mixture.mixed(docs.limit(0), targets).count() == 0 and mixture.mixed(docs, targets.limit(0)).count() == 0


def test_virtual_end():
    assert mixture.virtual_end([(0.5, 100.0), (0.5, 10.0)], 20) == 20
    assert mixture.virtual_end([(0.5, 100.0), (0.5, 10.0)], 40) == 60
    assert mixture.virtual_end([(0.5, 100.0), (0.5, 10.0)], 999) == 200
    assert mixture.virtual_end([], 5) == 0


def levelled(spark, n):
    rng = random.Random(8)
    own = {k: [chr(0x4E00 + 400 * k + i) + chr(0x5E00 + 400 * k + i) for i in range(60)] for k in range(1, 6)}
    rows = []
    for i in range(n):
        k = rng.randint(1, 5)
        words = [rng.choice(own[k if rng.random() < 0.8 else rng.randint(1, 5)]) for _ in range(rng.randint(10, 60))]
        rows.append((i, "。".join(words) + "。", k))
    return rows


def test_held_out_levels(spark):
    rows = levelled(spark, 400)
    extra = [(1000, None), (1001, ""), (1002, " \n"), (1003, "甲 | 1 | 2\n乙 | 3 | 4\n"), (1004, rows[0][1]), (1005, rows[1][1] * 300)]
    docs = spark.createDataFrame([(i, t, 7) for i, t, _ in rows] + [(i, t, 7) for i, t in extra], "doc_id long, text string, level int")
    labels = spark.createDataFrame([(i, k, "r1") for i, _, k in rows if i % 2] + [(i, 6 - k, "r2") for i, _, k in rows], "doc_id long, reading_level int, rater string")
    got = {r.doc_id: r.level for r in reading.levels(docs, labels).collect()}
    assert np.mean([got[i] == k for i, _, k in rows if i % 2 == 0]) > 0.9
    assert not {1000, 1001, 1002, 1003} & set(got) and got[1004] == got[0] and got[1005] == got[1]
    assert {r.doc_id for r in reading.demanding(docs, labels).collect()} == {i for i, k in got.items() if k >= 4}


def test_levels_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, "一句话。")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, reading_level int, rater string")
    assert [r.level for r in reading.levels(docs, none).collect()] == [3]
    assert reading.levels(docs.limit(0), none).count() == 0 and reading.levels(docs.limit(0), spark.createDataFrame([(1, 3, "r1")], none.schema)).count() == 0


def test_cut_points_part_with_fewest_errors():
    s, k = np.array([1.0, 1.1, 2.0, 2.1, 3.0, 4.0, 5.0]), np.array([1, 1, 2, 2, 3, 4, 5])
    assert (np.searchsorted(reading.cut_points(s, k), s) + 1 == k).all()


def test_difficulty_grows_with_the_levels_of_documents():
    counts = np.array([[9, 1, 0, 0, 0], [2, 2, 2, 2, 2], [0, 0, 0, 1, 9]], dtype=float)
    b = reading.difficulties(counts, reading.steps_of(np.ones(5)))
    assert b[0] < b[1] < b[2] and abs(b[1]) < 1e-6


def test_places_are_packed_without_loss():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    docs = [np.unique(rng.integers(0, reading.PLACES, n)) for n in (0, 1, 3, 0, 400, 5000)] + [np.array([reading.STEP]), np.array([0, 2 * reading.STEP, 2 * reading.STEP + 5]), np.array([], dtype=np.int64)]
    flat, sizes = reading.unpacked(pa.array([reading.packed(d) for d in docs], pa.binary()))
    assert sizes.tolist() == [len(d) for d in docs] and flat.tolist() == np.concatenate(docs).tolist()
    flat, sizes = reading.unpacked(pa.array([], pa.binary()))
    assert len(flat) == len(sizes) == 0
