"""Variant spellings of names typed by people (problem 6).

A spelling, in its plain form and without labels, titles and legal forms, is read as a sequence of
parts: syllables of a Chinese brand, letters of a foreign one, readings of a person's names; with it
go the line of business and the region, where they are written. Which words at the end of Chinese
names and in foreign ones are lines of business is learned from the data: the ends of names are a
tree of suffixes, and a line ends where the characters before it begin to spread.

Sequences meet in a pigeonhole segment join: each is cut into k + 1 segments, each is posted with its
number in an inverted index under its line of business and, for Chinese brands, region; substrings
of the other sequences shifted by up to k positions look it up, and a banded edit distance decides.
Spellings with the same sequence, distance 0, are linked as a star first, so a name with very many
spellings enters the segments once. Components of the links are the organisations and persons.

All joins run over distinct spellings, not rows; one owner's share of the rows doesn't matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from . import lookalikes
from .pii import _READ, DOUBLE, FAMILY, places
from .support import CharTables, char_tables, checkpointed

K = 2  # edits that the segments allow for; a swap of neighbours counts as two
#: Words of foreign names that say only the legal form.
LEGAL = {"co", "ltd", "company", "limited", "inc", "corp", "corporation", "the", "llc", "plc", "gmbh", "ag", "ab", "ltda"}
#: Least names that share a word before it counts as a line of business, and the least share of all of them (one in so many).
LEAST, ONE_IN = 3, 1_000
#: From so many different characters before it, in effect, a suffix is a whole line of business.
SPREAD = 12
LONGEST = 8
_ROLE = re.compile(r"^(?:业主|建设单位|招标人|采购人|发包人|投标人|中标人|单位名称|名称|联系人|负责人)[:：]\s*|[(（](?:建设单位|业主|负责人|联系人|法人|招标人|采购人|发包人|盖章|公章)[)）]$")
_FORM = re.compile(r"(?:集团|股份|有限|责任|控股|公司|有限责任公|有限公|公$)+$")
_TITLE = re.compile(r"(?:经理|先生|女士|主任|总工|老师|总)$")
#: Readings of family names that differ from the characters' usual ones.
FAMILY_READ = {"缪": "miao", "牟": "mou", "瞿": "qu", "郗": "xi", "宓": "mi", "单": "shan", "解": "xie", "仇": "qiu", "曾": "zeng", "华": "hua", "查": "zha", "尉": "yu", "任": "ren", "佘": "she", "苌": "chang", "殳": "shu", "亓": "qi"}
EMPTY = ("", "", "", [], "")
#: Neighbours on the usual keyboard, which fingers take for each other.
_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
BESIDE = {frozenset(p) for row in _KEYS for p in zip(row, row[1:], strict=False)} | {frozenset((_KEYS[r][i], _KEYS[r + 1][j])) for r in (0, 1) for i in range(len(_KEYS[r])) for j in (i - 1, i) if 0 <= j < len(_KEYS[r + 1])}


class Vocabulary(NamedTuple):
    lines: list[str]  # lines of business at the end of Chinese names, the usual first
    trades: list[str]  # words of foreign names that say a line of business, the usual first


def _lines_of(nodes: dict[str, tuple[int, float]]) -> list[str]:
    """The lines of business in a tree of suffixes: suffix -> (names, effective number of characters before it)."""
    out: list[str] = []
    for t in sorted(nodes, key=lambda t: (len(t), t)):
        n, spread = nodes[t]
        if not any(t.endswith(x) for x in out) and spread >= min(SPREAD, n / 3):
            out.append(t)
    out = sorted(out, key=lambda t: (-nodes[t][0], t))
    return [t for t in out if not any(len(t) < len(x) and _within(t, x) for x in out)]


def vocabulary(names: DataFrame, name: str = "name") -> Vocabulary:
    """Learned from distinct names: suffixes that share LEAST names and one in ONE_IN of all of them or more.

    What the driver collects is bounded by that share: at most ONE_IN suffixes a length, and words by the
    number of words in a name.
    """
    bare = F.regexp_replace(F.regexp_replace(F.col(name), r"[\s\p{Z}]+", ""), r"[(（][^()（）]*[)）]", "")
    stem = F.regexp_replace(bare, _FORM.pattern, "")
    chinese = names.filter(F.col(name).rlike(r"\p{IsHan}")).select(bare.alias("bare"), stem.alias("stem")).filter("stem <> bare").select("stem").distinct()
    ends = F.transform(F.sequence(F.lit(2), F.least(F.lit(LONGEST), F.length("stem") - 1)), lambda n: F.struct(F.substring("stem", F.length("stem") - n + 1, n).alias("end"), F.substring("stem", F.length("stem") - n, F.lit(1)).alias("before")))
    each = chinese.filter(F.length("stem") > 2).select(F.explode(ends).alias("e")).groupBy("e.end", "e.before").agg(F.count("*").alias("n"))
    least = F.lit(max(LEAST, chinese.count() // ONE_IN))
    spread = F.exp(F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n"))
    nodes = {r.end: (r.n, r.spread) for r in each.groupBy("end").agg(F.sum("n").alias("n"), spread.alias("spread")).filter(F.col("n") >= least).collect()}
    words = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(F.col(name), "&", " and ")), F.lit(r"\p{L}+"), F.lit(0))), F.array(*map(F.lit, sorted(LEGAL))))
    foreign = names.filter(~F.col(name).rlike(r"\p{IsHan}")).select(F.array_sort(words).alias("w")).filter("size(w) > 1").distinct()
    least = max(LEAST, foreign.count() // 100)
    used = foreign.select(F.explode("w").alias("word"), "w").groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") > least).collect()
    trades = [r.word for r in sorted(used, key=lambda r: (-r.n, r.word)) if len(r.word) > 1]
    return Vocabulary(_lines_of(nodes), [t for t in trades if not any(_shortened(t, x) for x in trades)])


def _within(short: str, word: str) -> bool:
    """Whether a short form takes its letters from a word, in order, the first one first."""
    at = iter(word)
    return short[0] == word[0] and all(c in at for c in short)


def _shortened(short: str, word: str) -> bool:
    """Whether a word of a foreign name may be the other one cut short."""
    return 1 < len(short) < 6 and len(short) <= len(word) // 2 + 1 and short != word and _within(short, word)


class Parser:
    """Spelling in plain form -> (kind, line, region, parts, brand in Han)."""

    def __init__(self, tables: CharTables, districts: list[str], provinces: list[str], words: Vocabulary):
        self.sound = tables.pinyin
        self.provinces = sorted({p for p in provinces} | {p.rstrip("省市") for p in provinces}, key=len, reverse=True)
        self.districts = {d: d[:-1] for d in districts} | {d[:-1]: d[:-1] for d in districts}
        self.by_sound = {(self.read(d[:-1]), d[-1]): d[:-1] for d in districts}
        self.lines: dict[str, str] = {}
        self.trades = words.trades
        for line in words.lines:
            # as it is, with a character dropped, swapped or doubled, and the short forms made of its characters
            short = ["".join(line[i] for i in (0, *at)) for n in range(1, len(line) - 1) for at in combinations(range(1, len(line)), n)]
            forms = [line, *short, *(line[:i] + line[i + 1 :] for i in range(len(line))), *(line[:i] + line[i + 1] + line[i] + line[i + 2 :] for i in range(len(line) - 1)), *(line[:i] + line[i] + line[i:] for i in range(len(line)))]
            for f in forms:
                self.lines.setdefault(f, line)
        self.line_sounds = {self.read(f): (line, len(f)) for f, line in reversed(self.lines.items())}
        self.longest = max(map(len, self.lines), default=0)

    def read(self, s: str) -> tuple[str, ...]:
        return tuple(self.sound.get(c, c.lower()) for c in s)

    def line_of(self, s: str) -> tuple[str, str]:
        for n in range(min(self.longest, len(s) - 1), 1, -1):
            tail = s[-n:]
            if (line := self.lines.get(tail)) or (line := self.line_sounds.get(self.read(tail), ("", 0))[0]):
                return line, s[:-n]
        return "", s

    def trade_of(self, word: str) -> str:
        """The word of trade that a shortened one stands for, else the word itself."""
        return next((t for t in self.trades if _shortened(word, t)), word)

    def region_of(self, s: str) -> tuple[str, str]:
        """(region, rest) of a name that begins with its region."""
        rest = s
        for p in self.provinces:
            if rest.startswith(p) and len(rest) > len(p) + 1:
                rest = rest[len(p) :]
                break
        for n in (4, 3, 2):
            head = rest[:n]
            if len(rest) - n >= 2:
                if head in self.districts:
                    return self.districts[head], rest[n:]
                if n > 2 and (found := self.by_sound.get((self.read(head[:-1]), head[-1]))):
                    return found, rest[n:]
        return "", rest

    def syllables(self, brand: str) -> list[str]:
        """Syllables of a brand in Han or in Latin letters."""
        if re.fullmatch(r"[A-Za-z]+", brand):
            return [brand.lower()]
        return list(self.read(brand))

    def person(self, s: str) -> tuple | None:
        bare = _TITLE.sub("", s.replace(" ", ""))
        if 2 <= len(bare) <= 4 and re.fullmatch(r"[一-鿿]+", bare) and (bare[0] in FAMILY or bare[:2] in DOUBLE):
            n = 2 if bare[:2] in DOUBLE and len(bare) > 2 else 1
            family = "".join(FAMILY_READ.get(c, self.sound.get(c, c)) for c in bare[:n])
            given = "".join(self.read(bare[n:]))
            return "person", "", "", sorted([family, given]), bare
        words = [w.replace("-", "").replace("'", "").lower() for w in re.split(r"[ ,]+", s) if w]
        if len(words) == 2 and all(w.isascii() and w.isalpha() and _READ.fullmatch(w) for w in words) and not set(words) & LEGAL and not set(words) & set(self.trades):
            return "person", "", "", sorted(words), ""
        return None

    def __call__(self, plain: str) -> tuple:
        s = unicodedata.normalize("NFKC", plain).strip()
        before = None
        while before != s:
            before, s = s, _ROLE.sub("", s).strip()
        if not s:
            return EMPTY
        if not re.search(r"[一-鿿]", s):
            if p := self.person(s):
                return p
            words = [w for w in re.findall(r"[^\W\d_]+|\d+", s.lower().replace("&", " and ")) if w not in LEGAL]
            if len(words) > 1:
                words = [w if w in self.trades else self.trade_of(w) for w in words]
            line = sorted(w for w in words if w in self.trades)
            name = [w for w in words if w not in self.trades]
            return "foreign", " ".join(line), "", list("".join(name) or " ".join(words)), ""
        s = s.replace(" ", "")
        inner = re.search(r"[(（]([一-鿿]{2,4})[)）]", s)
        region = ""
        if inner and (inner[1] in self.districts or inner[1] in self.provinces):
            region = self.districts.get(inner[1], "")
            s = s[: inner.start()] + s[inner.end() :]
        stem = _FORM.sub("", s)
        line, head = self.line_of(stem)
        if not line and stem == s and (p := self.person(s)):
            return p
        if not region:
            region, head = self.region_of(head)
        return "organisation", line or stem[-2:], region, self.syllables(head), head if re.fullmatch(r"[一-鿿]+", head) else ""


def edits(a: list[str], b: list[str], most: int = 1) -> int:
    """Banded edit distance with swaps of neighbours; parts that sound alike but for a letter may replace each other in short sequences."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    letters = all(len(x) == 1 for x in a + b)
    rows = {(-1, -1): 0}
    for i in range(-1, len(a)):
        for j in range(max(-1, i - most), min(len(b), i + most + 1)):
            if i < 0 or j < 0:
                rows[i, j] = i + j + 2
                continue
            x, y = a[i], b[j]
            if x == y:
                change = 0
            elif letters:
                # another letter makes another name, unless it lies beside the right one
                change = 1 if len(a) > 3 and frozenset((x, y)) in BESIDE else most + 1
            else:
                change = 1 if abs(len(x) - len(y)) <= 1 and (x.startswith(y) or y.startswith(x)) else most + 1
            best = min(rows.get((i - 1, j - 1), 99) + change, rows.get((i - 1, j), 99) + 1, rows.get((i, j - 1), 99) + 1)
            if i and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, rows.get((i - 2, j - 2), 99) + 1)
            rows[i, j] = best
    return rows.get((len(a) - 1, len(b) - 1), most + 1)


def segments(parts: list[str], k: int = K) -> list[tuple[int, int, str]]:
    """(number, position, text) of k + 1 even segments."""
    n, out, at = len(parts), [], 0
    for i in range(k + 1):
        size = n // (k + 1) + (i >= (k + 1) - n % (k + 1))
        if size:
            out.append((i, at, "|".join(parts[at : at + size])))
        at += size
    return out


def probes(parts: list[str], k: int = K) -> set[tuple[int, str]]:
    """(number, text) of all substrings that a segment of a sequence within k edits may be, lengths from n - k to n + k."""
    out = set()
    for n in range(max(1, len(parts) - k), len(parts) + k + 1):
        at = 0
        for i in range(k + 1):
            size = n // (k + 1) + (i >= (k + 1) - n % (k + 1))
            for start in range(max(0, at - k), min(len(parts) - size, at + k) + 1) if size else ():
                out.add((i, "|".join(parts[start : start + size])))
            at += size
    return out


def parsed(plain: DataFrame, reference: DataFrame) -> DataFrame:
    """(plain, kind, line, region, parts, han) of distinct plain spellings."""
    tables, gazetteer, words = char_tables(plain.sparkSession), places(reference), vocabulary(plain, "plain")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = Parser(tables.value, *gazetteer, words)
        for b in batches:
            yield pd.DataFrame([(v, *parse(v)) for v in b["plain"]], columns=["plain", "kind", "line", "region", "parts", "han"])

    return plain.mapInPandas(run, "plain string, kind string, line string, region string, parts array<string>, han string").filter("kind <> ''")


def _near(forms: DataFrame) -> DataFrame:
    """(a, b) links between spellings with the same sequence and with sequences that a typing error parts. forms: (form, kind, line, region, brand, parts).

    The smallest id of each sequence stands for it in the segments; the others are linked to it.

    Persons' readings are taken as they are: a letter more or less is another name's reading.
    """

    sequence = ["kind", "line", "region", "brand"]
    one = checkpointed(forms.groupBy(*sequence).agg(F.min("form").alias("a"), F.max(F.struct(F.size("parts"), "parts"))["parts"].alias("parts")))
    star = forms.select("form", *sequence).join(one.drop("parts"), sequence).filter("form <> a").select("a", F.col("form").alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for form, kind, line, region, parts in b.itertuples(index=False):
                parts = list(parts)
                scope = f"{kind}|{line}|"
                if kind == "person" or kind == "organisation" and len(parts) < 2:
                    continue
                # a short brand meets others in its region only; of a long one four parts say enough
                scopes = [scope + region] if kind == "foreign" or region else []
                if kind == "organisation" and len(parts) > 3:
                    scopes.append(scope + "long")
                for x in scopes:
                    out += [(f"{x}|{i}|{t}", form, True, parts, region) for i, _, t in segments(parts)]
                    out += [(f"{x}|{i}|{t}", form, False, parts, region) for i, t in probes(parts)]
                if kind == "organisation":  # swapped or doubled parts, with or without a region
                    key = f"{scope}set|" + "|".join(sorted(set(parts)))
                    out += [(key, form, True, parts, region), (key, form, False, parts, region)]
            yield pd.DataFrame(out, columns=["key", "form", "posted", "parts", "region"])

    keyed = checkpointed(one.select(F.col("a").alias("form"), "kind", "line", "region", "parts").mapInPandas(run, "key string, form long, posted boolean, parts array<string>, region string"))
    a = keyed.filter("posted").select("key", F.col("form").alias("a"), F.col("parts").alias("x"), F.col("region").alias("r"))
    b = keyed.filter("not posted").select("key", F.col("form").alias("b"), F.col("parts").alias("y"), F.col("region").alias("s"))
    # two regions are two organisations, whatever their brands
    pairs = a.join(b, "key").filter("a < b and (r = s or r = '' or s = '')").select("a", "b", "x", "y").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.loc[[edits(list(x), list(y)) <= 1 for x, y in zip(p["x"], p["y"], strict=True)], ["a", "b"]]

    return star.unionByName(pairs.mapInPandas(verify, "a long, b long"))


def classes(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(value, plain, entity) of the distinct values: entity is the same for spellings of one name.

    values: one string column ``value``. Null, empty and blank values have no entity.
    """
    distinct = values.select("value").filter("value is not null and trim(value) <> ''").distinct().withColumn("id", F.xxhash64("value"))
    plain = checkpointed(lookalikes.plain_forms(distinct, ["value"]).select(F.col("value"), "plain"))
    spelled = parsed(checkpointed(plain.select("plain").distinct()), reference)
    spelled = checkpointed(spelled.withColumn("brand", F.when(F.col("kind") == "person", F.array_join("parts", " ")).otherwise(F.array_join("parts", ""))))
    # a name without region goes to the region of the same brand in the same characters, else to any one with its sound
    key = ["kind", "line", "brand"]
    known = spelled.filter("region <> ''").groupBy(*key).agg(F.collect_set(F.struct("region", "han")).alias("at"))
    same = F.filter("at", lambda x: x["han"] == F.col("han"))
    spelled = spelled.join(known, key, "left").withColumn("region", F.when((F.col("region") != "") | F.col("at").isNull(), F.col("region")).when(F.size(same) > 0, F.array_min(same)["region"]).otherwise(F.array_min("at")["region"]))
    spelled = checkpointed(spelled.select("plain", *key, "region", "parts").withColumn("form", F.xxhash64("plain")))
    linked = components(_near(spelled))
    named = spelled.join(linked, F.col("form") == F.col("node"), "left").select("plain", F.coalesce("root", "form").alias("entity"))
    return plain.join(named, "plain").select("value", "plain", "entity")


def pairs(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(spelling_a, spelling_b): pairs of values that mean the same, the smaller by code points first.

    Values with the same plain form make no pair with each other.
    """
    all_ = checkpointed(classes(values, reference))
    # pairs of plain forms first: a name with thousands of disguised spellings never meets itself
    forms = all_.select("entity", "plain").distinct()
    p, q = forms.withColumnRenamed("plain", "p"), forms.withColumnRenamed("plain", "q")
    met = checkpointed(p.join(q, "entity").filter("p < q").select("p", "q"))
    x, y = all_.select(F.col("plain").alias("p"), F.col("value").alias("x")), all_.select(F.col("plain").alias("q"), F.col("value").alias("y"))
    return met.join(x, "p").join(y, "q").select(F.least("x", "y").alias("spelling_a"), F.greatest("x", "y").alias("spelling_b"))
