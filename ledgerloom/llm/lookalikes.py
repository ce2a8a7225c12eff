"""Visually identical text with different characters (problem 4).

A value is brought to one plain form in three steps: characters that aren't seen are deleted and
base letters composed with their accents; every character that isn't regular is replaced by its
compatibility form; letters span a lattice of their look-alikes per token, in which Viterbi finds the likeliest path
under character bigrams counted over all plain values, with a price for changing the script inside
a token. Where a text has Greek or Cyrillic letters that no Latin one looks like, the lattice leads
to that script too, so Latin letters inside such a word are mended as well. A value is disguised if
its plain form differs.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import CharTables, char_tables, ignorable

#: What needs no look: printable ASCII, Han, Chinese brackets and marks, composed Latin letters.
REGULAR = r"[\x20-\x7E㐀-䶿一-鿿、。〇-】！（），：；？·‘-”À-ÖØ-öø-ſ]"
TOKEN = r"[0-9A-Za-zÀ-ɏͰ-ϿЀ-ӿ]+"
_REGULAR = re.compile(REGULAR)
_ALNUM = re.compile(r"[0-9A-Za-z]")
_DASHES = set("‐‑‒–—―−﹣－﹘")
#: Scripts beside Latin in which whole words are written with letters that look like others.
SCRIPTS = ("GREEK", "CYRILLIC")
SWITCH = 6.0  # price of a change of script inside a token, in nats


def bigrams(values: DataFrame, value: str = "value") -> dict[tuple[str, str], int]:
    """Character bigrams of the tokens of all regular values, ``^`` and ``$`` at the ends.

    Collected to the driver: keys are pairs over a fixed alphabet of about 1,000 letters and digits.
    """
    tokens = values.filter(F.col(value).rlike(rf"^{REGULAR}*$")).select(F.explode(F.regexp_extract_all(value, F.lit(TOKEN), 0)).alias("t"))
    tokens = tokens.groupBy("t").agg(F.count("*").alias("n")).select(F.concat(F.lit("^"), "t", F.lit("$")).alias("t"), "n")
    pairs = tokens.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring("t", i, F.lit(2)))).alias("b"), "n")
    return {(r.b[0], r.b[1]): int(r.n) for r in pairs.groupBy("b").agg(F.sum("n").alias("n")).toLocalIterator() if len(r.b) == 2}


@lru_cache(maxsize=1 << 14)
def script(c: str) -> str:
    if c.isascii():
        return "LATIN" if c.isalpha() else ""
    return unicodedata.name(c, "?").split(" ")[0] if unicodedata.category(c)[0] == "L" else ""


class Plain:
    """The plain form of a text."""

    def __init__(self, tables: CharTables, counts: dict[tuple[str, str], int]):
        self.after: dict[str, float] = defaultdict(float)
        for (a, _), n in counts.items():
            self.after[a] += n
        self.counts, self.size = counts, 1 + len({b for _, b in counts})
        by_class = defaultdict(list)
        for c in [*map(chr, range(0x21, 0x7F)), *(c for c in tables.alike if script(c) in SCRIPTS)]:
            by_class[tables.alike.get(c, c)].append(c)

        def same_case(c: str, like: list[str]) -> list[str]:
            like = [x for x in like if x.isdigit() or x.isupper() == c.isupper()] or like
            seen = tables.alike.get(c.upper(), c.upper())  # letters that look alike in both cases come first
            return [x for x in like if tables.alike.get(x.upper(), x.upper()) == seen] or like

        #: look-alikes of a letter of another script among ASCII letters and digits, same case first
        self.choices = {}
        for c, a in tables.alike.items():
            if not c.isascii() and script(c) not in ("", "CJK", "KANGXI") and (like := [x for x in by_class.get(a, []) if x.isascii() and x.isalnum()]):
                self.choices[c] = same_case(c, like)
        #: look-alikes of any letter or digit in each script whose words may be spoilt by letters of another
        self.other = defaultdict(dict)
        for c in {*map(chr, range(0x30, 0x7B)), *tables.alike}:
            like = [x for x in by_class.get(tables.alike.get(c, c), []) if x != c and script(x) in SCRIPTS] if c.isalpha() else []
            for s in {script(x) for x in like} - {script(c)}:
                self.other[s][c] = same_case(c, [x for x in like if script(x) == s])
        self.alike = tables.alike

    def score(self, a: str, b: str) -> float:
        return math.log((self.counts.get((a, b), 0) + 0.1) / (self.after.get(a, 0.0) + 0.1 * self.size))

    def compatible(self, c: str) -> str:
        if c in _DASHES:
            return "-"
        plain = unicodedata.normalize("NFKC", c)
        if plain == c and 0x2E80 <= ord(c) < 0x2FE0:
            plain = self.alike.get(c, c)
        return plain.replace("−", "-").replace("　", " ")

    def best(self, token: str, foreign: str) -> str:
        """The likeliest path through the look-alikes of a token; foreign: the script whose letters without Latin look-alikes the text has, or ''."""
        ends: dict[str, tuple[float, str]] = {"^": (0.0, "")}
        for c in token:
            new: dict[str, tuple[float, str]] = {}
            for x in [*self.choices.get(c, []), *self.other.get(foreign, {}).get(c, []), c]:
                own = x == c and c in self.choices
                price = (-SWITCH if foreign else SWITCH) if own else 0.0
                best, way = max((s + self.score(a, x) - (SWITCH if script(a) and script(x) and script(a) != script(x) else 0.0), w) for a, (s, w) in ends.items())
                new[x] = (best - price, way + x)
            ends = new
        return max((s + self.score(a, "$"), w) for a, (s, w) in ends.items())[1]

    def __call__(self, text: str) -> str:
        seen = unicodedata.normalize("NFC", "".join(c for c in text if not ignorable(c)))
        out = []
        for i, c in enumerate(seen):
            if c == "—" and not any(_ALNUM.match(self.compatible(x)) for x in (seen[i - 1 : i], seen[i + 1 : i + 2]) if x):
                out.append(c)  # a dash between Chinese words
            else:
                out.append(c if _REGULAR.match(c) else self.compatible(c))
        plain = "".join(out)
        if any(c in self.choices or script(c) in SCRIPTS for c in plain):
            own = [script(c) for c in plain if script(c) in SCRIPTS and c not in self.choices]
            foreign = max(SCRIPTS, key=own.count) if own else ""
            plain = re.sub(TOKEN, lambda m: self.best(m[0], foreign) if any(c in self.choices or script(c) in SCRIPTS for c in m[0]) else m[0], plain)
        return plain


def fields(rows: DataFrame, id_col: str, names: list[str]) -> DataFrame:
    """(id, field_name, value) of the values that aren't null."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(n).cast("string").alias("value")) for n in names))).alias("x")
    return rows.select(F.col(id_col).alias("id"), pairs).select("id", "x.field_name", "x.value").filter("value is not null")


def plain_forms(rows: DataFrame, names: list[str], id_col: str = "id") -> DataFrame:
    """(id, field_name, value, plain): the plain form of every value of the named fields.

    Null values give no rows; empty and blank ones stay as they are. Values of regular characters
    are their own plain form and never leave the JVM.
    """
    spark = rows.sparkSession
    values = fields(rows, id_col, names)
    regular = F.col("value").rlike(rf"^{REGULAR}*$")
    model = spark.sparkContext.broadcast(bigrams(values))
    tables = char_tables(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = Plain(tables.value, model.value)
        known = lru_cache(maxsize=1 << 16)(plain.__call__)
        for b in batches:
            yield b.assign(plain=[known(v) for v in b["value"]])

    strange = values.filter(~regular).mapInPandas(run, "id long, field_name string, value string, plain string")
    return values.filter(regular).withColumn("plain", F.col("value")).unionByName(strange)


def disguised(rows: DataFrame, names: list[str], id_col: str = "id") -> DataFrame:
    """(id, field_name) of the values that hold a disguised character."""
    return plain_forms(rows, names, id_col).filter("plain <> value").select("id", "field_name")
