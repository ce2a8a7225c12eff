"""Facts inside names and texts: cores and tails, lots in lists and ranges, kilometres, dates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from .validation import sent_dates

#: Chinese and Roman numbers as digits.
_NUMBERS = {c: str(i) for i, c in enumerate("一二三四五六七八九十", 1)} | {r: str(i) for i, r in enumerate(("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"), 1)}
_N = r"(?:[一二三四五六七八九十]|[IVX]{1,4}|\d{1,3})"
_RANGE = re.compile(rf"第?({_N})\s*(?:-|－|~|～|—|至|到)\s*第?({_N})#?标段?")
_LIST = re.compile(rf"第?({_N}(?:\s*[、,，]\s*第?{_N})+)#?标段?")
_CODE = re.compile(r"([A-Z]{1,4})-?0*(\d{1,3})标段?")
_ONE = re.compile(rf"第?({_N})#?(?:标段|合同段)")
#: Lots written behind 标段, before a bare 标, and codes that need no 标 at all.
_AFTER = re.compile(rf"标段({_N})(?![A-Za-z0-9])")
_BARE = re.compile(rf"(?:施工|(?<=[一-鿿]))({_N})标(?=项目|工程|招标|采购|桥梁)|施工({_N})标(?!段)")
_PLAIN_CODE = re.compile(r"(?<![A-Za-z0-9])(SG|TJ)-?0*(\d{1,3})(?![A-Za-z0-9])")
WIDEST = 20  # lots of a range


def lots_of(text: str | None) -> list[str]:
    """Lots named in a text, each once and in order: ranges and lists are written out, codes are PREFIX-n.

    A span that one form has taken isn't read again by a later one, so "1-3标段" isn't also lot 3.
    """
    rest, found = text or "", []

    def number(x: str) -> int:
        return int(_NUMBERS.get(x, x))

    def take(pattern: re.Pattern, each) -> None:
        nonlocal rest
        for m in list(pattern.finditer(rest)):
            found.extend((m.start(), v) for v in each(m))
            rest = rest[: m.start()] + " " * (m.end() - m.start()) + rest[m.end() :]

    def between(m: re.Match) -> list[str]:
        try:
            a, b = number(m[1]), number(m[2])
        except ValueError:
            return []
        return [str(i) for i in range(a, b + 1)] if a < b <= a + WIDEST else []

    def numbers(m: re.Match) -> list[str]:
        return [str(number(x)) for x in re.findall(_N, m[1]) if x in _NUMBERS or x.isdigit()]

    take(_RANGE, between)
    take(_LIST, numbers)
    take(_CODE, lambda m: [f"{m[1]}-{m[2]}"])
    take(_ONE, numbers)
    take(_AFTER, numbers)
    take(_BARE, lambda m: [str(number(m[1] or m[2]))] if (m[1] or m[2]) in _NUMBERS or (m[1] or m[2]).isdigit() else [])
    take(_PLAIN_CODE, lambda m: [f"{m[1]}-{m[2]}"])
    return list(dict.fromkeys(v for _, v in sorted(found, key=lambda x: x[0])))


@pandas_udf(ArrayType(StringType()))
def lots(text: pd.Series) -> pd.Series:
    return text.map(lots_of)


def core(name: Column, tail: str = "采购|租赁|分包|招标|公告|公示|计划") -> Column:
    """A name up to its last 项目 or 工程, if that leaves six characters or more and what follows is a tail; else the whole."""
    head = F.regexp_extract(name, rf"^(.{{4,}}(?:项目|工程)).*(?:{tail}).*$", 1)
    return F.when(head != "", head).otherwise(F.coalesce(name, F.lit("")))


def kilometres(text: Column) -> Column:
    """array<string> of stretches K1+200-K3+400."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(K\d+\+\d+\s*(?:至|～|~|-)\s*K\d+\+\d+)"), 1), lambda x: F.regexp_replace(x, r"\s*(?:至|～|~)\s*", "-"))


def event_date(text: Column, published: Column, label: str = "发布时间|更新时间|开标时间") -> Column:
    """struct<day date, source string>: the date after a label in the text, else the day of publication, else none."""
    stated = sent_dates(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?:{label})[：:]\s*(\d{{4}}[-/.年]\d{{1,2}}[-/.月]\d{{1,2}}日?)", 1))
    known = sent_dates(published)
    source = F.when(stated.isNotNull(), "TEXT").when(known.isNotNull(), "PUBLISHED").otherwise("UNKNOWN")
    return F.struct(F.coalesce(stated, known).alias("day"), source.alias("source"))


def event_key(*parts: Column) -> Column:
    """SHA-256 of the parts as a JSON array of strings; null is an empty string."""
    cells = (F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(p.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for p in parts)
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")), 256)
