"""Mapping free-entered values to a canonical list (problem 1).

The canonical entries are split into parts (province, base name, kind) and put, with their Latin
readings, into a symmetric-delete dictionary: every key with up to two characters deleted points to
the key. A value is split into its parts, its head is looked up by its own deletions, and what is
found is ranked by weighted Damerau-Levenshtein distance (same sound, swapped and doubled
characters cost less) and then by the entry's frequency in the data. Values that mean no entry, or
more than one, get 0 and are reported.

The dictionary is broadcast: its size follows the canonical list alone (some 40 keys an entry).
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from itertools import combinations
from typing import NamedTuple
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .support import CharTables, char_tables, ignorable, is_blank, once, per_distinct

#: Short names of provinces, in natural order.
SHORT = {"京": "北京", "津": "天津", "冀": "河北"}
#: Kinds of districts with their Latin readings.
KINDS = {"区": "qu", "县": "xian", "市": "shi"}
#: The canonical list is held on the driver and broadcast; a longer one is refused.
MOST_ENTRIES = 100_000
_LABEL = re.compile(r"^(?:(?:建设|项目|工程)?(?:地点|地区|地址|区域)|所在地|属地|中国|中华人民共和国)[:：]?\s*")
_TAIL = re.compile(r"(?:\(?含?周边\)?|境内|一带|地区|全境|[。.;；!！]+)$")
_SPLIT = re.compile(r"[\s,，、/;；·•\-－—_()（）|>&+]+")


class Entry(NamedTuple):
    id: int
    province: str  # base of the province
    base: str  # base of the district, empty for a province
    kind: str
    often: int


def distance(a: str, b: str, sound: dict[str, str]) -> float:
    """Weighted Damerau-Levenshtein distance (optimal string alignment).

    Characters of the same sound cost 0.5, a doubled one 0.4, swapped neighbours 0.5. All characters
    in another order count as one slip of the pen: 0.5 where both ends stay, else 0.8.
    """
    if sorted(a) == sorted(b) and len(a) > 2 and a != b:
        return 0.8 if a[0] != b[0] or a[-1] != b[-1] else 0.5
    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                rows[i][j] = float(i + j)
                continue
            x, y = a[i - 1], b[j - 1]
            same = 0.0 if x == y else 0.5 if sound.get(x, x) == sound.get(y, y) else 1.0
            twice = 0.4 if i > 1 and a[i - 2] == x else 1.0
            best = min(rows[i - 1][j - 1] + same, rows[i - 1][j] + twice, rows[i][j - 1] + 1.0)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, rows[i - 2][j - 2] + 0.5)
            rows[i][j] = best
    return rows[-1][-1]


def deletions(key: str, most: int) -> set[str]:
    """The key with up to ``most`` characters deleted."""
    n = len(key)
    return {"".join(c for i, c in enumerate(key) if i not in gone) for k in range(min(most, n - 1) + 1) for gone in combinations(range(n), k)}


class Resolver:
    """Finds the id of the entry that a value means, 0 for none."""

    def __init__(self, entries: list[Entry], tables: CharTables):
        self.sound, self.simple = tables.pinyin, tables.simple
        read = lambda s: "".join(self.sound.get(c, c) for c in s)
        self.provinces = {e.province: e.id for e in entries if not e.base}
        self.latin = {read(p): p for p in self.provinces}
        self.short = {s: p for s, p in SHORT.items() if p in self.provinces}
        self.by_base: dict[str, list[Entry]] = defaultdict(list)
        self.index: dict[str, set[tuple[str, Entry]]] = defaultdict(set)
        self.latin_index: dict[str, set[tuple[str, Entry]]] = defaultdict(set)
        for e in entries:
            if e.base:
                self.by_base[e.base].append(e)
                for key in (e.base, e.base + e.kind):
                    for d in deletions(key, 2 if len(key) > 3 else 1):
                        self.index[d].add((key, e))
                for d in deletions(read(e.base), 2):
                    self.latin_index[d].add((read(e.base), e))
        self.longest = max(map(len, self.by_base), default=0)
        self.longest_latin = max((len(read(b)) for b in self.by_base), default=0)

    def province_of(self, token: str, first: bool) -> tuple[str, str]:
        """(province, rest) if the token begins with one; by a short form only the first that is named."""
        for p in self.provinces:
            if token.startswith(p):
                return p, re.sub(r"^[市省]+", "", token[len(p) :]) if token[len(p) : len(p) + 1] in ("市", "省") else token[len(p) :]
        if token[:1] in self.short and (first or all(c in self.short for c in token)) and not any(token.startswith(b) for b in self.by_base):
            return self.short[token[0]], token[1:]
        return "", token

    def pick(self, found: list[Entry], after: str, province: str) -> int | None:
        """One of several entries with the same base: the one of the province, or of the kind named."""
        if province:
            found = [e for e in found if e.province == province] or [None]
        if len(found) > 1:
            found = [e for e in found if after.startswith(e.kind)]
        return found[0].id if len(found) == 1 and found[0] else 0

    def exact(self, token: str, province: str) -> int | None:
        for n in range(self.longest, 0, -1):
            if token[:n] in self.by_base:
                return self.pick(self.by_base[token[:n]], token[n:], province)
        return None

    def near(self, token: str, province: str) -> int | None:
        best: dict[int, tuple[float, int, int]] = {}
        for n in range(2, self.longest + 3):
            head = token[:n]
            if len(head) < n:
                break
            for d in deletions(head, 2 if n > 3 else 1):
                for key, e in self.index.get(d, ()):
                    if province and e.province != province or abs(len(key) - n) > 1:
                        continue
                    full = len(key) > len(e.base)
                    if not (province or full):
                        continue
                    cost = distance(head, key, self.sound)
                    if cost <= (1.0 if province or len(e.base) > 2 else 0.5):
                        best[e.id] = min(best.get(e.id, (9.0, 0, 0)), (cost, -len(key), -e.often))
        ranked = sorted((v, k) for k, v in best.items())
        return ranked[0][1] if ranked else None

    def by_reading(self, text: str) -> int:
        words = re.findall(r"[a-z]+", text.lower())
        run = "".join(words)
        named = {p for r, p in self.latin.items() if r in words or run.startswith(r) or run.endswith(r)}
        if len(named) > 1:
            return 0
        province = next(iter(named), "")
        rest = "".join(w for w in words if self.latin.get(w) != province or not province)
        if province:
            r = next(k for k, p in self.latin.items() if p == province)
            rest = rest.removeprefix(r).removesuffix(r)
        best: dict[int, tuple[float, int]] = {}
        for form in {rest, *(rest.removesuffix(k) for k in KINDS.values())}:
            # a form longer by three than every key is more than two deletions from all of them
            for d in deletions(form, 2) if 0 < len(form) <= self.longest_latin + 2 else ():
                for key, e in self.latin_index.get(d, ()):
                    if not province or e.province == province:
                        cost = distance(form, key, {})
                        if cost <= (1.0 if len(key) > 4 else 0.5):
                            best[e.id] = min(best.get(e.id, (9.0, 0)), (cost, -e.often))
        ranked = sorted((v, k) for k, v in best.items())
        if ranked:
            return ranked[0][1] if province or len(ranked) < 2 or ranked[0][0][0] < ranked[1][0][0] else 0
        return self.provinces.get(province, 0)

    def __call__(self, value: str) -> int:
        text = unicodedata.normalize("NFKC", "".join(c for c in value if not ignorable(c)))
        text = "".join(self.simple.get(c, c) for c in text).strip()
        if not re.search(r"[㐀-鿿]", text):
            return self.by_reading(text)
        before = None
        while before != text:
            before, text = text, _TAIL.sub("", _LABEL.sub("", text)).strip()
        named: list[str] = []
        rest: list[str] = []
        for token in filter(None, _SPLIT.split(text)):
            while token:
                province, left = self.province_of(token, not named)
                if not province:
                    rest.append(token)
                    break
                named.append(province)
                token = left
        if len(set(named)) > 1:
            return 0
        province = named[0] if named else ""
        for find in (self.exact, self.near):
            for token in rest:
                if (hit := find(token, province)) is not None:
                    return hit
        return self.provinces.get(province, 0)


def entries_of(reference: DataFrame, values: DataFrame, value: str) -> list[Entry]:
    """The canonical entries with their frequency in the data as exact values."""
    often = values.groupBy(F.col(value).alias("region_name")).agg(F.count("*").alias("often"))
    rows = reference.join(often, "region_name", "left").select("region_id", "region_name", "province", "region_level", F.coalesce("often", F.lit(0)).alias("often")).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the canonical list has more than {MOST_ENTRIES} entries")
    out = []
    for r in rows:
        district = r.region_level != "province"
        name = r.region_name[len(r.province) :] if district else ""
        out.append(Entry(r.region_id, r.province[:-1] if r.province[-1] in "市省" else r.province, name[:-1], name[-1:], r.often))
    return out


def resolver(reference: DataFrame, values: DataFrame, value: str):
    """A column function value -> id, with the dictionary broadcast and each distinct value resolved once a batch."""
    spark = values.sparkSession
    entries = spark.sparkContext.broadcast(entries_of(reference, values, value))
    tables = char_tables(spark)
    key = uuid4().hex

    @pandas_udf("int")
    def found(s: pd.Series) -> pd.Series:
        one = once(key, lambda: Resolver(entries.value, tables.value))
        return pd.Series(per_distinct(s, lambda v: None if v is None else one(v)), dtype="Int32")

    return found


def _mapped(rows: DataFrame, reference: DataFrame, id_col: str, value: str) -> DataFrame:
    names = F.broadcast(reference.select(F.col("region_name").alias("value")))  # the list is bounded by MOST_ENTRIES
    odd = rows.select(F.col(id_col).alias("id"), F.col(value).alias("value")).filter(~is_blank(F.col("value"))).join(names, "value", "left_anti")
    return odd.select("id", "value", resolver(reference, rows, value)("value").alias("region_id"))


def mapped(rows: DataFrame, reference: DataFrame, id_col: str = "id", value: str = "region") -> DataFrame:
    """(id, region_id) of the rows whose value isn't null or blank and isn't exactly a name of the list.

    region_id is 0 for a value that means no entry or several (a miss). An empty table gives an
    empty result; repeated rows are mapped each.
    """
    return _mapped(rows, reference, id_col, value).select("id", "region_id")


def misses(rows: DataFrame, reference: DataFrame, id_col: str = "id", value: str = "region") -> DataFrame:
    """(value, n): the values that mean no entry, with the number of rows holding them.

    Rows that share an id or are given twice count each.
    """
    return _mapped(rows, reference, id_col, value).filter("region_id = 0").groupBy("value").agg(F.count("*").alias("n"))
