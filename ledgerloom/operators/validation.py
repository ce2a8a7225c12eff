"""Row validation with reject reasons, and content fingerprints."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.text import STABLE, THIN, WIDE

#: Lines that change without the content, elements without text, elements without an end.
VOLATILE = r"^(?:更新时间|更新日期|最后更新|发布时间戳|浏览(?:次数|量)?|点击(?:次数|量)?|访问量) ?[：:]"
SKIPPED = {"script", "style", "noscript", "template"}
VOID = {"area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr"}


def reasons(checks: dict[str, Column]) -> Column:
    """array<string> of the names of the failed checks, in their order; a null check counts as failed."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))


def validated(rows: DataFrame, checks: dict[str, Column], keys: list[str], order: str) -> DataFrame:
    """Adds reasons array<string> and accepted; a row that repeats an accepted earlier one of the key is rejected as duplicate.

    Only accepted rows count as seen, so a row that follows a rejected one of its key is accepted.
    """
    tagged = rows.withColumn("_own", reasons(checks)).withColumn("_ok", (F.size("_own") == 0).cast("int"))
    # the first valid row of a key is the accepted one: an aggregate and a join, no window over a hot key
    first = tagged.filter("_ok = 1").groupBy(*keys).agg(F.min(order).alias("_first"))
    joined = tagged.join(first, keys, "left")
    again = (F.col("_ok") == 1) & (F.col(order) > F.col("_first"))
    all_reasons = F.when(again, F.array(F.lit("duplicate"))).otherwise(F.col("_own"))
    return joined.withColumn("reasons", all_reasons).withColumn("accepted", F.size("reasons") == 0).drop("_own", "_ok", "_first")


def squashed(c: Column) -> Column:
    """Blanks to one, ends trimmed, null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\r\n\f]+", " "))


def fingerprint(*fields: Column) -> Column:
    """SHA-256 over the fields' squashed forms, parted by a character that no field holds."""
    return F.sha2(F.concat_ws("\x1f", *(F.replace(squashed(f), F.lit("\x1f"), F.lit(" ")) for f in fields)), 256)


def canonical_fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as a JSON object: names in order, no blanks between, characters as they are; null as an empty string."""
    return F.sha2(F.to_json(F.struct(*(F.coalesce(fields[n], F.lit("")).alias(n) for n in sorted(fields)))), 256)


class _Text(HTMLParser):
    """The texts between tags, a line each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self._open: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.text.append("\n")
        if tag not in VOID:
            self._open.append(tag)

    def handle_endtag(self, tag):
        self.text.append("\n")
        if tag in self._open:
            while self._open.pop() != tag:
                pass

    def handle_data(self, data):
        if not SKIPPED.intersection(self._open):
            self.text.append(data)

    def handle_comment(self, data):
        self.text.append("\n")

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self.text.append("\n")
        if data.upper().startswith("CDATA["):
            self.handle_data(data[6:] + "\n")


def normal_text(value: str) -> str:
    """The business wording of a text: entities and tags resolved, NFKC, volatile and blank lines left out, blanks to one."""
    value = html.unescape(value)
    if "<" in value and ">" in value:
        page = _Text()
        page.feed(value)
        page.close()
        value = "".join(page.text)
    value = unicodedata.normalize("NFKC", re.sub("[\u200b-\u200f\u2060\ufeff]", "", value))
    lines = (re.sub(r"\s+", " ", x).strip() for x in re.split("[\r\n]", value))
    return " ".join(x for x in lines if x and not re.match(VOLATILE, x))


@pandas_udf(StringType())
def _normal_texts(c: pd.Series) -> pd.Series:
    return c.map(normal_text, na_action="ignore")


def normalised(c: Column) -> Column:
    """``normal_text`` as a column, null to empty; only values with markup or characters that NFKC may change leave the JVM."""
    hard = c.rlike(rf"[&<]|[^{STABLE}]")
    lines = F.transform(F.split(F.translate(c, WIDE, THIN), r"[\r\n]"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\x0b\f\x1c-\x1f]+", " ")))
    plain = F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(VOLATILE)), " ")
    return F.coalesce(F.when(hard, _normal_texts(F.when(hard, c))).otherwise(plain), F.lit(""))


def sent_dates(c: Column) -> Column:
    """Dates in the layouts 2025-01-31, 2025/1/31, 2025.1.31 and 2025年1月31日; null for anything else."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), "[年月/.]", "-"), "日$", "")
    return F.when(plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(plain, "yyyy-M-d"))


def running_number(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)))
