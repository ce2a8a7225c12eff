"""Column functions on text: built-in expressions that stay in the JVM, but for the few values whose compatibility form needs Unicode's tables."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Characters whose compatibility form is themselves, or one ASCII character that WIDE has.
STABLE = r"\x00-\x7f\u00b7\u2013\u2014\u2018-\u201d\u3000-\u3002\u3008-\u3011\u4e00-\u9fff\uff01-\uff5e"
WIDE = "\u3000" + "".join(map(chr, range(0xFF01, 0xFF5F)))
THIN = " " + "".join(map(chr, range(0x21, 0x7F)))


def sentences(c: Column) -> Column:
    """array<string>: pieces after 。！？；; or line ends, trimmed, blank ones left out."""
    marked = F.regexp_replace(F.coalesce(c, F.lit("")), "([。！？；;])", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def hits(c: Column, words: list[str]) -> Column:
    """array<string>: the words the text holds, in the list's order, letters' case aside."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in words)))


def negated(sentence: Column, words: list[str], before: list[str], after: list[str], reach: int = 20) -> Column:
    """Whether a word follows a negator, or is followed by one, within ``reach`` characters of the sentence."""
    w, b, a = ("|".join(map(_quoted, x)) for x in (words, before, after))
    return sentence.rlike(f"(?:{b})[^。；;]{{0,{reach}}}(?:{w})|(?:{w})[^。；;]{{0,{reach}}}(?:{a})")


def _quoted(word: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in word)


def multi_label(c: Column, labels: dict[str, list[str]], sep: str = "、") -> Column:
    """All labels with any marker in the text, joined in the order of the labels."""
    text = F.coalesce(c, F.lit(""))
    found = (F.when(reduce(lambda x, y: x | y, (F.contains(text, F.lit(m)) for m in marks)), F.lit(label)) for label, marks in labels.items())
    return F.array_join(F.array_compact(F.array(*found)), sep)


def first_label(c: Column, labels: dict[str, list[str]], other: str) -> Column:
    """The first label, in order, with any marker in the text."""
    text, out = F.coalesce(c, F.lit("")), None
    for label, marks in labels.items():
        any_ = reduce(lambda x, y: x | y, (F.contains(text, F.lit(m)) for m in marks))
        out = F.when(any_, label) if out is None else out.when(any_, label)
    return out.otherwise(other)


def excerpt(c: Column, words: list[str], pieces: int = 5, chars: int = 600) -> Column:
    """Up to ``pieces`` sentences that hold a word, joined and cut to ``chars``; the squashed text if none does."""
    clean = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\r\n\f]+", " "))
    good = F.filter(sentences(clean), lambda x: reduce(lambda p, q: p | q, (F.contains(x, F.lit(w)) for w in words)))
    return F.substring(F.when(F.size(good) > 0, F.array_join(F.slice(good, 1, pieces), " ")).otherwise(clean), 1, chars)


def identity_text(c: Column) -> Column:
    """Lower case without blanks and punctuation."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Z}\p{P}\p{S}\p{Cf}]+", ""))


def canonical_name(c: Column, suffixes: list[str]) -> Column:
    """A name without the suffixes at its end, however many follow each other, and the marks between them."""
    joined = "|".join(map(_quoted, suffixes))
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), rf"(?:[\s\-_]*(?:{joined}))+$", "")


def identifier(c: Column) -> Column:
    """Upper case, without blanks, all dashes as one kind."""
    return F.upper(F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Z}\p{Cf}]+", ""), "－—–‐‑−﹣", "-------"))


def extracted(c: Column, patterns: dict[str, str]) -> Column:
    """array<string> ``kind:value`` of all matches of the patterns' first group, in order, each once."""
    text = F.coalesce(c, F.lit(""))

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: F.concat(F.lit(f"{kind}:"), v))

    return F.array_distinct(F.concat(*(of(k, p) for k, p in patterns.items())))


def ngrams(c: Column, n: int) -> Column:
    """array<string>: distinct character n-grams; a shorter text is its own only one, an empty one has none."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays; 0 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    whole = F.size(F.array_union(a, b))
    return F.when(whole > 0, shared / whole).otherwise(0.0)


def scrubbed(c: Column) -> Column:
    """Secrets in texts of errors and logs: values after password, token, cookie and key names, and bearer tokens."""
    named = F.regexp_replace(c, r"(?i)\b(password|passwd|token|cookie|secret|api[_-]?key)(\s*[:=]\s*)[^\s,;&]+", "$1$2***")
    return F.regexp_replace(named, r"(?i)\bbearer\s+[A-Za-z0-9._\-]+", "Bearer ***")


def file_name(c: Column, longest: int = 180) -> Column:
    """A text usable as a file name: characters that file systems refuse become _, ends are trimmed."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|\x00-\x1f]+', "_")
    return F.substring(F.trim(clean), 1, longest)


def same_host(url: Column, page: Column, allowed: list[str]) -> Column:
    """Whether an address is on the page's host or on an allowed one or below it."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    below = [(host == a) | host.endswith("." + a) for a in allowed]
    return F.coalesce(reduce(lambda x, y: x | y, below, host == F.lower(F.try_parse_url(page, F.lit("HOST")))), F.lit(False))


#: Chinese digits by their place.
DIGITS = "〇一二三四五六七八九"


def chinese_number(c: Column) -> Column:
    """Numbers up to 999 in Chinese (二十一, 百零三, 一二), in Roman I to X or in digits; null for anything else."""
    text = F.upper(F.trim(F.translate(c, "零两", "〇二")))
    digits = F.translate(text, DIGITS, "0123456789")

    def part(pattern: str, none: int) -> Column:
        found = F.regexp_extract(digits, pattern, 1)
        return F.when(found == "", F.lit(none)).otherwise(found.cast("int"))

    hundreds = F.when(digits.contains("百"), part(r"^(\d)百", 1)).otherwise(0)
    tens = F.when(digits.contains("十"), part(r"(\d)十", 1)).otherwise(0)
    ones = part(r"[十百]0?(\d)$", 0)
    roman = F.create_map(*(x for i, r in enumerate(("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"), 1) for x in (F.lit(r), F.lit(i))))
    return F.when(digits.rlike(r"^\d{1,9}$"), F.try_to_number(digits, F.lit("999999999")).cast("int")).when(digits.rlike(r"^(?:\d?百)?0?(?:\d?十)?\d?$") & digits.rlike("[十百]"), hundreds * 100 + tens * 10 + ones).otherwise(roman[text])


@pandas_udf(StringType())
def _compatible(c: pd.Series) -> pd.Series:
    return c.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@pandas_udf(StringType())
def _caseless(c: pd.Series) -> pd.Series:
    return c.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


def nfkc(c: Column) -> Column:
    """The compatibility form, null to empty; only values with characters that it may change beyond width leave the JVM."""
    hard = c.rlike(f"[^{STABLE}]")
    return F.coalesce(F.when(hard, _compatible(F.when(hard, c))).otherwise(F.translate(c, WIDE, THIN)), F.lit(""))


def caseless(c: Column) -> Column:
    """The compatibility form without regard to case, null to empty."""
    hard = c.rlike(f"[^{STABLE}]")
    return F.coalesce(F.when(hard, _caseless(F.when(hard, c))).otherwise(F.lower(F.translate(c, WIDE, THIN))), F.lit(""))


#: Marks that identities of works leave out; those of notices leave out two more, those of events all.
MARKS = "，,。.;；:：'\"“”‘’()（）[]【】"
NOTICE_MARKS = MARKS + "_-"


def _without(c: Column, marks: str) -> Column:
    blanks = F.regexp_replace(c, r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+", "")
    return F.translate(blanks, marks, "")


def notice_identity(c: Column) -> Column:
    return _without(caseless(c), NOTICE_MARKS)


def work_identity(c: Column) -> Column:
    return _without(caseless(c), MARKS)


def event_identity(c: Column) -> Column:
    """Letters, digits and underscores only."""
    return F.regexp_replace(caseless(c), r"[^\p{L}\p{N}_]+", "")


#: Words that tell that a text beside an owner's label is no owner.
NO_OWNER = ("或招标代理机构提出", "招标代理机构", "联系人", "联系电话", "电话", "电子邮箱", "监督部门")


def owner_name(c: Column) -> Column:
    """An owner in its compatibility form with single blanks and bare ends; empty if too short, too long or no owner."""
    clean = F.btrim(F.regexp_replace(nfkc(c), r"[\s\p{Z}]+", " "), F.lit(" ，,。.;；"))
    ok = F.length(clean).between(2, 100) & ~clean.rlike("|".join(NO_OWNER))
    return F.when(ok, clean).otherwise("")


def only_label(c: Column, labels: dict[str, list[str]]) -> Column:
    """The one label with a marker in the text; empty for none and for two or more."""
    found = F.split(multi_label(F.regexp_replace(nfkc(c), r"[\s\p{Z}]+", ""), labels, "\n"), "\n")
    return F.when(F.size(found) == 1, found[0]).otherwise("")


def title_label(c: Column, labels: dict[str, list[str]]) -> Column:
    """struct<label, marker>: the one label of a title, a company's name before it left out, with its longest marker."""
    text = F.regexp_replace(nfkc(c), "^.{0,45}?(?:集团股份有限公司|集团有限公司|有限责任公司|有限公司)", "")
    hits = F.array_compact(F.array(*(F.when(F.contains(text, F.lit(m)), F.struct(F.lit(-len(m)).alias("n"), F.lit(i).alias("at"), F.lit(label).alias("label"), F.lit(m).alias("marker"))) for i, (label, m) in enumerate((k, m) for k, ms in labels.items() for m in ms))))
    one = F.size(F.array_distinct(F.transform(hits, lambda h: h["label"]))) == 1
    first = F.array_min(hits)
    return F.struct(F.when(one, first["label"]).otherwise("").alias("label"), F.when(one, first["marker"]).otherwise("").alias("marker"))


def split_name(c: Column) -> Column:
    """struct<core, tail>: a name cut after its last 项目 that six characters or more lead up to and a purchase follows."""
    pattern = r"(?s)^(.*项目)(.*?(?:采购|租赁|劳务分包|专业分包).*)$"
    name = F.coalesce(c, F.lit(""))
    head = F.regexp_extract(name, pattern, 1)
    cut = (head != "") & (F.length(_without(head, NOTICE_MARKS)) >= 6)
    tail = F.btrim(F.regexp_extract(name, pattern, 2), F.lit(" ，,。.;；-—"))
    return F.struct(F.when(cut, head).otherwise(name).alias("core"), F.when(cut, tail).otherwise("").alias("tail"))


#: What names a part of a work, and what ends that part's name.
PARTS = "酒店|商业|山姆|住宅|写字楼|办公楼|学校|医院|地库|地下室|裙房|塔楼|厂房|宿舍|站房|车站|楼栋|地块|功能区"
PART_ENDS = "装配式|预制|混凝土|构件|管片|箱梁|材料|设备|工程|劳务|专业|租赁|采购|供应|制作|安装"


def part_scope(tail: Column) -> Column:
    """The part of a work that a tail begins with, of at most 20 characters; empty without one."""
    head = F.btrim(F.regexp_extract(tail, rf"^(.*?)(?:{PART_ENDS})", 1), F.lit(" ，,。.;；-—"))
    return F.when((F.length(head) <= 20) & head.rlike(PARTS), head).otherwise("")


#: Number systems and how much a number of each says, in the order they are tried.
NUMBERS = (("TRANSACTION", r"^S\d{6,}[A-Z0-9_-]*$", "STRONG"), ("HEBEI_TRANSACTION", r"^[GI]\d{12,}[A-Z0-9_-]*$", "STRONG"), ("ENGINEERING", r"^20\d{2}-[A-Z0-9]{3,24}$", "STRONG"))


def number_class(c: Column) -> Column:
    """struct<kind, strength> of an identifier in its normal form; OTHER is weak, an empty one has none."""
    kind, strength = F.when(c == "", ""), F.when(c == "", "")
    for name, pattern, how in NUMBERS:
        kind, strength = kind.when(c.rlike(pattern), name), strength.when(c.rlike(pattern), how)
    return F.struct(kind.otherwise("OTHER").alias("kind"), strength.otherwise("WEAK").alias("strength"))


#: The party after a result's label, and what stands there where none is named.
PARTY, NO_PARTY = r"(?:中标人|中标单位)(?:名称)?\s*[：:]\s*([^\r\n,，。；;]{2,100})", r"^(?:如下|信息如下|情况如下)\s*[：:]?$"


def result_party(c: Column) -> Column:
    found = F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), PARTY, 1))
    return F.when(found.rlike(NO_PARTY), "").otherwise(found)


def years(c: Column) -> Column:
    """array<string> of the years named, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(20\d{2})年(?:度)?"), 1))


def lot_order(lots: Column) -> Column:
    """Lots in order: numbers by value before all others, these by their characters."""
    number = lambda x: F.when(x.rlike(r"^\d{1,18}$"), x).cast("long")
    keyed = F.transform(lots, lambda x: F.struct(number(x).isNull().alias("other"), number(x).alias("n"), x.alias("lot")))
    return F.transform(F.array_sort(keyed), lambda k: k["lot"])
