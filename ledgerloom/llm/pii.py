"""Personal information inside free text (problem 3).

Candidate spans come from loose patterns, one kind each. Labelers (patterns, gazetteers, context)
vote on each: for, against, or not at all. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is and how likely each pattern is a true span; with
those likelihoods as soft labels a logistic span classifier is trained over the votes and over what
stands in and around the span (neighbouring characters, first and last one, shape, length), which
decides. The corpus is looked at in one Arrow-batched pass whose spans are checkpointed; what the
driver sees are the counts of vote patterns, at most 3^6 a kind, and FITTED spans a kind.

Lines are looked at one by one, whole texts without any limit. A line is scanned for a kind if it
has one of the kind's anchors, pieces that each of its patterns needs.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import bounded, checkpointed

KINDS = ("name", "phone", "email", "id_number", "address")
LABELERS = 6
#: Places of the hashed context features of a kind, and spans a kind that the classifier is fitted on.
PLACES = 512
FITTED = 4_000
#: Rows of the canonical list, held on the driver and broadcast; a longer one is refused.
MOST_ENTRIES = 100_000
#: Usual and rarer family names, single characters.
FAMILY = set(
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
    "蔺殳郗桑宓柯缪滕瞿苌佘晏闵甄牟亓桓常温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符舒阮纪梅童凌毕单季裴霍涂成苗谷盛曲翁冉骆蓝路游辛靳管柴蒙鲍华喻祁蒲房滑屈饶解"
)
DOUBLE = ("欧阳", "司马", "上官", "诸葛", "夏侯", "东方", "皇甫", "尉迟", "公孙", "慕容", "令狐", "长孙")
_SYLLABLE = r"(?:[bpmfdtnlgkhjqxrzcsyw]|[zcs]h)?(?:[aeiouv]|ai|ei|ui|ao|ou|iu|ie|ve|ue|er|an|en|in|un|ang|eng|ing|ong|ia|iao|ian|iang|iong|ua|uo|uai|uan|uang)"
_READ = re.compile(rf"(?:{_SYLLABLE}){{1,3}}", re.I)

_WIDE = {**{chr(0xFF10 + i): str(i) for i in range(10)}, "＋": "+", "－": "-", "＠": "@", "（": "(", "）": ")", "　": " ", "Ｘ": "X", "ｘ": "x", "‑": "-", "–": "-", "—": "-", "：": ":", "，": ","}


def narrow(text: str) -> str:
    """Wide digits and marks as their usual forms, character by character, so positions stay."""
    for wide, usual in _WIDE.items():
        if wide in text:
            text = text.replace(wide, usual)
    return text


_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+", re.I)
_PHONE = re.compile(r"(?<![0-9A-Za-z.])(?:(?:\+|00)?86[- ]?)?(?:1[3-9]\d[- ]?\d{4}[- ]?\d{4}|(?:\(0\d{2,3}\)|0\d{2,3})[- ]?\d{7,8}(?: ?(?:转|分机|ext\.?) ?\d{1,6})?|[48]00[- ]?\d{3}[- ]?\d{4})(?![0-9A-Za-z]|\.\d|-\d)", re.I)
_ID = re.compile(r"(?<![0-9A-Za-z])(?:\d{6}[- ]?(?:19|20)\d{6}[- ]?\d{3}[0-9Xx]|\d{18}|[A-Z]{1,2}\d{7,8})(?![0-9A-Za-z]|-\d)")
_STREET = r"[一-鿿]{1,8}?(?:路|街|巷|胡同|道|里|村)"
_HOUSE = r"[甲乙丙]?\d+(?:-\d+)?(?:号院?|弄)(?:[甲乙丙]?\d+号楼?|\d+号)?(?:[一-鿿]{1,6}?(?:大厦|大楼|广场|中心|公寓|小区|花园|园))?(?:[A-Za-z\d]+(?:座|栋|幢|号楼))?(?:\d+单元)?(?:[A-Za-z]?\d+(?:室|层|楼|房|号))?"
#: Words right before a name; a blank in one may be there or not.
BEFORE = ("联 系 人", "联络人", "负责人", "经办人", "代表人", "项目经理", "收件人", "签收人", "寄件人", "通讯员", "居民代表", "投诉受理", "受理人", "委托", "安全员", "质检员", "施工员", "资料员", "监理员", "供稿", "编辑", "Contact", "Attn")
#: Words before a list of names, which goes on up to a full stop.
LISTS = ("成 员", "名单", "组长", "专家")
#: Words right after a name, and titles.
ACTS = ("联系", "办理", "供稿", "代办", "签字", "转交")
TITLES = ("先生", "女士", "经理", "主任", "工程师", "老师")
#: What comes after a name and a comma or blank.
DETAILS = ("住", "证件", "身份证", "邮箱", "手机", "电话", "Tel")


def _any(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(" ", " ?") for w in words)


_NAME_BEFORE = re.compile(rf"(?:{_any(BEFORE)})[: ]*$", re.I)
_LIST = re.compile(rf"(?:{_any(LISTS)})[: ]")
_NAME_AFTER = re.compile(rf"^(?:{_any(ACTS)}| ?\(?(?:{_any(TITLES)})|, ?(?:{_any(DETAILS)})| +(?:{_any(DETAILS)}|供稿)|\((?:\d|[A-Z]{{1,2}}\d{{6}}|\+|0)|, ?(?:\+?\d|\(0))")


def _anchored(word: str) -> str:
    """A word whose letters may be of either case, begun by alternatives of one character, which the scanner can skip to."""
    first, rest = word[0], "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else " ?" if c == " " else c for c in word[1:])
    return "|".join(x + rest for x in sorted({first.lower(), first.upper()}))


#: What every candidate of a kind holds, or has beside it: only lines with an anchor are looked at for
#: that kind. They are made of the patterns' own words, so they leave out no line that a pattern takes.
ANCHORS = {
    "email": r"[@\[(]",
    "number": r"\d[\d \-]{5}\d",
    "address": r"\d[号弄]",
    "name": "|".join(map(_anchored, (*BEFORE, *LISTS, *ACTS, *TITLES, *DETAILS))) + r"|,[ +(\d]|\((?:[\d+]|[A-Z]{1,2}\d{6})|[\dXx]\(|与",
}
_ANCHORS = {k: re.compile(v) for k, v in ANCHORS.items()}
_HAN_NAME = r"[一-鿿]{2,4}?"
_NAME = re.compile(rf"(?:(?<=[: ,(、])|(?<=联系人)|(?<=负责人)|(?<=经办人)|(?<=代表人)|(?<=经理)|(?<=件人)|(?<=收人)|(?<=通讯员)|(?<=代表)(?!人)|(?<=受理)|(?<=委托)|(?<=供稿)|(?<=编辑)|(?<=员)|(?<=与))(?:({_HAN_NAME})(?=联系|办理|供稿|先生|女士|经理|主任|[,()。;、 ]|$)|([A-Z][A-Za-z'\-]+,? [A-Z][A-Za-z'\-]+)(?=联系|办理|供稿|先生|女士|[^A-Za-z&.]|$))")
_TITLE = re.compile(rf"(?:{_any(TITLES)})$")
_NO_NAME = re.compile(r"公司|集团|部|局|处|厅|委|中心|站|网|院|所|招标|文件|详见|采购|工程|项目|单位|平台|电话|地址|邮箱|方式|人员|办|Co\b|Ltd|Works|Bridge|Tunnel|Wind|Tower|Marine|Precast|Systems")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    votes: int  # base 3: 0 against, 1 nothing, 2 for


def _votes(*each: int) -> int:
    code = 0
    for v in (*each, *[0] * (LABELERS - len(each))):
        code = code * 3 + v + 1
    return code


def _for(yes: bool) -> int:
    return 1 if yes else 0


def _either(yes: bool, no: bool) -> int:
    return 1 if yes else -1 if no else 0


_MAIL_WORD = re.compile(r"(?:邮箱|信箱|来函|发送至|E-?mail|邮件|邮|至)[: ]*$", re.I)
_PHONE_WORD = re.compile(r"(?:电话|手机|致电|Tel|电|传真|[,/(])[:. ]*$", re.I)
_NUMBER_WORD = re.compile(r"(?:账户|账号|编号|代码|批复|备案|许可|发票|合同号|流水号|QQ)[^,。]{0,4}$")
_ID_WORD = re.compile(r"(?:身份证号?码?|证件号?码?|护照号?码?|证号|[一-鿿a-z]\()[: ]*$")
_PLACE_WORD = re.compile(r"(?:地址|住|住址|邮寄至|寄至|送达|集合地点为|地点为|[,])[: ]*$")
_IN_BRACKET = re.compile(r"[0-9Xx]\($")
_SITE_WORD = re.compile(r"(?:位于|建设地点|工程地点|起点接|项目地点)[^,。]{0,6}$")


class Finder:
    """Candidate spans of a line with their votes."""

    def __init__(self, districts: list[str], provinces: list[str]):
        wide = "|".join(map(re.escape, sorted(provinces, key=len, reverse=True)))
        near = "|".join(map(re.escape, sorted(districts, key=len, reverse=True))) or r"(?!)"
        self.place = re.compile(rf"^(?:{wide})?(?:{near})")
        any_place = rf"(?:(?:{wide})?(?:{near})|(?:(?<=[住至为达])|(?<=地址:))[一-鿿]{{2,9}}?[省市区县](?:[一-鿿]{{2,4}}[市区县])?)"
        self.address = re.compile(rf"{any_place}(?:[一-鿿]{{1,4}}?[镇乡]|[一-鿿]{{1,4}}?街道)?{_STREET}{_HOUSE}")

    def numbers(self, s: str) -> Iterator[Span]:
        taken: list[tuple[int, int]] = []
        for m in _ID.finditer(s):
            before = s[max(0, m.start() - 12) : m.start()]
            digits = re.sub(r"[- ]", "", m[0])
            dated = len(digits) == 18 and "01" <= digits[10:12] <= "12" and "01" <= digits[12:14] <= "31" and digits[6:8] in ("19", "20")
            taken.append(m.span())
            yield Span("id_number", *m.span(), _votes(_either(dated, len(digits) == 18), _for(len(digits) < 12), _either(bool(_ID_WORD.search(before)), bool(_NUMBER_WORD.search(before))), _for(s[m.end() : m.end() + 1] in (")", "("))))
        for m in _PHONE.finditer(s):
            if any(a < m.end() and m.start() < b for a, b in taken):
                continue
            before = s[max(0, m.start() - 12) : m.start()]
            digits = re.sub(r"\D", "", m[0])
            yield Span("phone", *m.span(), _votes(_for(len(digits) in (11, 13)), _for(bool(re.match(r"\(?0\d", m[0]))), _either(bool(_PHONE_WORD.search(before)), bool(_NUMBER_WORD.search(before))), _for(m[0][0] == "+"), _either(False, before[-1:].isalpha() and before[-1:].isascii())))

    def emails(self, s: str) -> Iterator[Span]:
        for m in _EMAIL.finditer(s):
            before = s[max(0, m.start() - 12) : m.start()]
            yield Span("email", *m.span(), _votes(_for("@" in m[0]), _for("@" not in m[0]), _for(bool(_MAIL_WORD.search(before))), _either(m[0].rsplit(".", 1)[1].isalpha(), True), _either(False, before.endswith("//"))))

    def addresses(self, s: str) -> Iterator[Span]:
        for m in self.address.finditer(s):
            before = s[max(0, m.start() - 14) : m.start()]
            yield Span("address", *m.span(), _votes(_for(bool(self.place.match(m[0]))), _for("号" in m[0] or "弄" in m[0]), _for(m[0][-1] in "室层"), _either(bool(_PLACE_WORD.search(before)), bool(_SITE_WORD.search(before))), _either(False, "工程" in m[0] or "项目" in m[0])))

    def names(self, s: str) -> Iterator[Span]:
        labels = [m.end() for m in _LIST.finditer(s)]
        stops = [i for i, c in enumerate(s) if c in "。;"] if labels else []
        for m in _NAME.finditer(s):
            start, end = m.span()
            value = m[0]
            if t := _TITLE.search(value):
                end -= len(t[0])
                value = value[: -len(t[0])]
            if len(value) < 2:
                continue
            before, after = s[max(0, start - 10) : start], s[end : end + 12]
            left = bool(_NAME_BEFORE.search(before)) or bool(_IN_BRACKET.search(before)) or before.endswith("与") and after.startswith("联系")
            if not left and labels and before[-1:] in (":", "、"):
                i = bisect_right(labels, start)
                left = i > 0 and bisect_left(stops, labels[i - 1]) == bisect_left(stops, start)
            right = bool(_NAME_AFTER.match(after)) or left and after[:1] in ("、", "。", ")")
            if not (left or right):
                continue  # a candidate has a context; see ANCHORS
            if m[1]:
                known = value[0] in FAMILY or value[:2] in DOUBLE
                shape = _either(len(value) in (2, 3) or value[:2] in DOUBLE, True)
            else:
                parts = re.split(r"[ ,\-]+", value)
                known = all(_READ.fullmatch(p) for p in parts)
                shape = _either(len(parts) <= 3, True)
            yield Span("name", start, end, _votes(_either(known, True), _for(left), _for(right), shape, _either(False, bool(_NO_NAME.search(value))), _either(False, not left and not known)))

    def __call__(self, text: str, anchored: bool = True) -> Iterator[tuple[int, str, Span]]:
        """(offset, line, span) of all candidates of a text; ``anchored`` off looks at every line for every kind."""
        s = text if text.isascii() else narrow(text)
        for kind, find in (("email", self.emails), ("number", self.numbers), ("address", self.addresses), ("name", self.names)):
            anchor, at, end = _ANCHORS[kind].search, 0, len(s)
            while at <= end:
                if anchored:
                    if not (m := anchor(s, at)):
                        break
                    at = s.rfind("\n", at, m.start()) + 1 or at
                stop = s.find("\n", at)
                stop = end if stop < 0 else stop
                line = s[at:stop]
                for span in find(line):
                    yield at, line, span
                at = stop + 1


def features(line: str, span: Span) -> list[int]:
    """Places of what stands in and around a span: neighbours, first and last character, shape and length."""
    _, start, end, _ = span
    value = line[start:end]
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "a" if c.isascii() and c.isalpha() else "汉" if "一" <= c <= "鿿" else c for c in value))
    said = ("p" + line[max(0, start - 1) : start], "pp" + line[max(0, start - 2) : start], "n" + line[end : end + 1], "nn" + line[end : end + 2], "f" + value[:1], "l" + value[-1:], "s" + shape[:12], "k" + str(min(len(value), 24)))
    return [zlib.crc32(x.encode("utf-8", "replace")) % PLACES for x in said]


@lru_cache(maxsize=1 << 14)
def _decode(votes: int) -> tuple[int, ...]:
    out = []
    for _ in range(LABELERS):
        votes, v = divmod(votes, 3)
        out.append(v)
    return tuple(reversed(out))


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """EM over vote patterns: how likely each pattern is a true span. votes: patterns x labelers in 0, 1, 2."""
    likely = np.clip(0.5 + 0.25 * (votes - 1).sum(1), 0.02, 0.98)
    likely[(votes == 0).any(1)] = np.minimum(likely[(votes == 0).any(1)], 0.5)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - likely), counts * likely])  # class x pattern
        prior = (weight.sum(1) + 1) / (counts.sum() + 2)
        score = np.tile(np.log(prior)[:, None], (1, len(votes)))
        for j in range(votes.shape[1]):
            table = np.stack([[weight[y][votes[:, j] == v].sum() + 1 for v in range(3)] for y in (0, 1)])
            table /= table.sum(1, keepdims=True)
            # a labeler's vote never counts for the other side
            table[1, 2], table[1, 0] = max(table[1, 2], table[0, 2]), min(table[1, 0], table[0, 0])
            score += np.log(table)[:, votes[:, j]]
        likely = 1 / (1 + np.exp(np.clip(score[0] - score[1], -30, 30)))
    return likely


def span_classifier(votes: np.ndarray, places: np.ndarray, likely: np.ndarray, weight: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Logistic regression with soft labels over the votes, one-hot, and what stands in and around the spans.

    votes: spans x LABELERS, places: spans x features. Returns the weights: constant, votes for,
    votes against, places.
    """
    x = np.zeros((len(votes), 1 + 2 * LABELERS + PLACES), dtype=np.float32)
    x[:, 0], x[:, 1 : 1 + LABELERS], x[:, 1 + LABELERS : 1 + 2 * LABELERS] = 1, votes == 2, votes == 0
    np.put_along_axis(x, 1 + 2 * LABELERS + places, 1, axis=1)
    used = np.flatnonzero(x.any(0))
    x = x[:, used]
    # what a few spans show of a context counts little against what all labelers say
    ridge = np.where(used < 1 + 2 * LABELERS, 0.02, 4.0)
    w = np.zeros(len(used))
    for _ in range(rounds):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None].astype(np.float32)).T @ x + np.diag(ridge), x.T @ (weight * (likely - p)) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-4:
            break
    out = np.zeros(1 + 2 * LABELERS + PLACES)
    out[used] = w
    return out


def scored(kinds, votes, places, model: dict[str, np.ndarray]) -> np.ndarray:
    """The probability of each span, 0 for a kind without a model."""
    out = np.zeros(len(votes))
    kinds, votes = np.asarray(kinds), np.asarray(votes, dtype=np.int64)
    places = np.stack(places).astype(np.int64) if len(votes) else np.zeros((0, 1), dtype=np.int64)
    for kind, w in model.items():
        at = np.flatnonzero(kinds == kind)
        if len(at):
            said = np.array([_decode(v) for v in votes[at].tolist()])
            z = w[0] + (said == 2) @ w[1 : 1 + LABELERS] + (said == 0) @ w[1 + LABELERS : 1 + 2 * LABELERS] + w[1 + 2 * LABELERS + places[at]].sum(1)
            out[at] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def places(reference: DataFrame) -> tuple[list[str], list[str]]:
    """The gazetteer: names of districts and provinces of the canonical list (refused beyond MOST_ENTRIES)."""
    rows = bounded(reference.select("region_name", "province", "region_level"), MOST_ENTRIES, "the gazetteer")
    provinces = sorted({p for r in rows for p in (r.province, r.province.rstrip("省市"))})
    return sorted({r.region_name[len(r.province) :] for r in rows if r.region_level != "province"}), provinces


SPAN = "struct<kind:string,start:int,stop:int,votes:int,places:array<int>>"


def candidates(texts: DataFrame, reference: DataFrame, id_col: str = "id", text: str = "raw_text") -> DataFrame:
    """(id, text, spans) of all rows, checkpointed: the one pass that looks for spans. Places are counted from 0 in characters."""
    gazetteer = places(reference)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(*gazetteer)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("votes", pa.int32()), ("places", pa.list_(pa.int32()))]))
        for b in batches:
            out = [[{"kind": s.kind, "start": at + s.start, "stop": at + s.end, "votes": s.votes, "places": features(line, s)} for at, line, s in find(t)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], ["id", "text", "spans"])

    rows = texts.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return checkpointed(rows.mapInArrow(run, f"id long, text string, spans array<{SPAN}>"))


def model_of(found: DataFrame) -> dict[str, np.ndarray]:
    """The span classifier of each kind.

    EM runs over the counts of the vote patterns of all spans (at most 3^6 a kind); the classifier
    is fitted on about FITTED spans a kind, taken by hash, with the patterns' likelihoods as labels.
    """
    spans = found.select(F.explode("spans").alias("s"), F.xxhash64("text").alias("h"))
    counts = spans.groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect()
    total = {k: sum(r.n for r in counts if r.kind == k) for k in KINDS}
    share = F.lit(0)
    for k in KINDS:
        share = F.when(F.col("s.kind") == k, int(min(1.0, FITTED / max(total[k], 1)) * (1 << 30))).otherwise(share)
    picked = spans.filter(F.pmod(F.xxhash64("h", "s.start"), F.lit(1 << 30)) < share).select("s.kind", "s.votes", "s.places").toPandas()
    out = {}
    for kind in KINDS:
        rows = sorted((r.votes, r.n) for r in counts if r.kind == kind)
        mine = picked[picked["kind"] == kind]
        if rows and len(mine):
            said = np.array([_decode(v) for v, _ in rows])
            likely = dict(zip([v for v, _ in rows], reliabilities(said, np.array([float(n) for _, n in rows])), strict=True))
            votes = mine["votes"].tolist()
            out[kind] = span_classifier(np.array([_decode(v) for v in votes]), np.stack(mine["places"].tolist()).astype(np.int64), np.array([likely[v] for v in votes]), np.ones(len(votes)))
    return out


def _accepted(spans: list[dict], model: dict[str, np.ndarray]) -> list[dict]:
    p = scored([s["kind"] for s in spans], [s["votes"] for s in spans], [s["places"] for s in spans], model)
    return [s for s, x in zip(spans, p, strict=True) if x >= 0.5]


def found(texts: DataFrame, reference: DataFrame, id_col: str = "id", text: str = "raw_text") -> DataFrame:
    """(id, pii_kind, pii_value): the distinct values of personal information in each text.

    Null, empty and blank texts give no rows; a text given twice under one id gives its values once.
    """
    spans = candidates(texts, reference, id_col, text)
    model = model_of(spans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[scored(b["kind"], b["votes"], b["places"].tolist(), model) >= 0.5, ["id", "pii_kind", "pii_value"]] if len(b) else b[["id", "pii_kind", "pii_value"]]

    each = spans.select("id", "text", F.explode("spans").alias("s"))
    rows = each.select("id", F.col("s.kind").alias("pii_kind"), F.expr("substring(text, s.start + 1, s.stop - s.start)").alias("pii_value"), F.col("s.kind").alias("kind"), "s.votes", "s.places")
    return rows.mapInPandas(run, "id long, pii_kind string, pii_value string").distinct()


def redacted(texts: DataFrame, reference: DataFrame, id_col: str = "id", text: str = "raw_text") -> DataFrame:
    """(id, text): each value replaced by ``[KIND]``, all else unchanged; null stays null. Of overlapping values the first, then the longest counts."""
    spans = candidates(texts, reference, id_col, text)
    model = model_of(spans)

    def clean(t: str, said: list[dict]) -> str:
        out, at = [], 0
        for s in sorted(_accepted(said, model), key=lambda s: (s["start"], -s["stop"])):
            if s["start"] >= at:
                out += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                at = s["stop"]
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [clean(t, s) if s else t for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], ["id", "text"])

    return spans.mapInArrow(run, "id long, text string")
