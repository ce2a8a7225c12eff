"""Shared pieces of the training-data operators: character tables, checkpoints, small helpers."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from uuid import uuid4

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed as checkpointed

#: Blanks of any kind, and characters that take no room, as a Java/RE2/Python character class body.
BLANK = r"\s\p{Z}\x{85}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{AD}"

#: The same characters in full.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u200c\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff\xad"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder, which all executors share."""
    checkpointed(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def is_blank(c: Column) -> Column:
    return c.isNull() | c.rlike(rf"^[{BLANK}]*$")


@dataclass(frozen=True)
class CharTables:
    """Fixed facts about characters, independent of any data (about 25,000 entries)."""

    pinyin: dict[str, str]  # a Han character's usual reading without tone
    simple: dict[str, str]  # traditional -> simplified, where they differ
    alike: dict[str, str]  # a character -> the string of its look-alike class


_TABLES: dict[str, Broadcast] = {}


def _by_icu(spark: SparkSession, rule: str, chars: list[str]) -> list[str]:
    icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance(rule)
    return str(icu.transliterate("\n".join(chars))).split("\n")


def char_tables(spark: SparkSession) -> Broadcast:
    """Broadcast of CharTables, made once a session from the ICU that ships with Spark.

    Its size is fixed by Unicode, not by data: 20,992 readings and some 4,000 look-alikes.
    """
    key = spark.sparkContext.applicationId
    if key not in _TABLES:
        han = [chr(c) for c in range(0x4E00, 0xA000)]
        read = _by_icu(spark, "Han-Latin; Latin-ASCII", han)
        thin = _by_icu(spark, "Traditional-Simplified", han)
        letters = [
            chr(c)
            for lo, hi in ((0x21, 0x530), (0x530, 0x590), (0x10A0, 0x1100), (0x13A0, 0x1400), (0x1D00, 0x2C00), (0x2C60, 0x2FE0), (0xA4D0, 0xA500), (0xA640, 0xA7F0), (0xAB30, 0xAB70))
            for c in range(lo, hi)
            if unicodedata.category(chr(c))[0] in "LNSP"
        ]
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        # one call: the skeleton of a text is the text of the skeletons, line ends stay
        alike = str(checker.getSkeleton("\n".join(letters))).split("\n")
        _TABLES[key] = spark.sparkContext.broadcast(
            CharTables(
                {c: r.strip().lower() for c, r in zip(han, read, strict=True) if r.strip().isalpha()},
                {c: t for c, t in zip(han, thin, strict=True) if t != c and len(t) == 1},
                {c: a for c, a in zip(letters, alike, strict=True) if a},
            )
        )
    return _TABLES[key]


@lru_cache(maxsize=1 << 16)
def ignorable(c: str) -> bool:
    """Whether a character isn't seen at all (format characters, selectors, fillers)."""
    o = ord(c)
    return unicodedata.category(c) == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D)


#: Rows of a side that may be broadcast; a larger side is joined by shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A checkpointed copy, marked for broadcast if its rows are counted and few."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def bounded(df: DataFrame, most: int, what: str) -> list:
    """All rows of reference data that may be held on the driver; more than ``most`` are refused, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def sampled(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """About ``most`` rows at the most, chosen by a hash of the keys; all rows if they are fewer."""
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def per_distinct(values, fn):
    """Apply fn once to every distinct value of a pandas Series and spread the results."""
    known = {v: fn(v) for v in values.unique()}
    return [known[v] for v in values]


_MADE: dict[str, object] = {}


def once(key: str, make):
    """What make() gives, made once a Python worker and kept for its next batches."""
    if key not in _MADE:
        if len(_MADE) > 2:
            _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]
