"""Readers of sources: a registry of them, detail pages, and the way from list pages to notices."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import BLOCKS, SKIPPED, list_rows

#: What a reader is: (session, where its stored replies lie) -> notices.
Reader = Callable[[SparkSession, str], DataFrame]
VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}


class Registry:
    """Readers by the id of their source; each id once."""

    def __init__(self) -> None:
        self.readers: dict[str, Reader] = {}

    def add(self, source_id: str, reader: Reader) -> None:
        if source_id in self.readers:
            raise ValueError(f"source given twice: {source_id}")
        self.readers[source_id] = reader

    def read(self, spark: SparkSession, sources: dict[str, str]) -> DataFrame:
        """The notices of all named sources (id -> where they lie) with their source_id; an id without a reader is refused."""
        missing = sorted(set(sources) - set(self.readers))
        if missing:
            raise ValueError(f"no reader for {', '.join(missing)}")
        parts = [self.readers[i](spark, at).withColumn("source_id", F.lit(i)) for i, at in sources.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out


class _Article(HTMLParser):
    """Text of the first element of each wanted class, the classes in order of preference."""

    def __init__(self, classes: list[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.classes, self.text = classes, {}
        self._open: list[tuple[str, str | None]] = []
        self._skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self._skip += 1
        if tag in BLOCKS:
            self._add("\n")
        if tag in VOID:
            return
        held = (dict(attrs).get("class") or "").split()
        mine = next((c for c in self.classes if c in held and c not in self.text), None)
        if mine:
            self.text[mine] = []
        self._open.append((tag, mine))

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self._skip = max(0, self._skip - 1)
        if tag in BLOCKS:
            self._add("\n")
        if any(t == tag for t, _ in self._open):
            while self._open.pop()[0] != tag:
                pass

    def _add(self, data):
        for _, mine in self._open:
            if mine:
                self.text[mine].append(data)

    def handle_data(self, data):
        if not self._skip:
            self._add(data)

    def of(self, classes: list[str]) -> str | None:
        found = next((c for c in classes if c in self.text), None)
        return None if found is None else "\n".join(x for x in (" ".join(line.split()) for line in "".join(self.text[found]).split("\n")) if x)


def detail_of(html: str | None, article: list[str], title: list[str], patterns: dict[str, str]) -> tuple | None:
    """(title, text, fields...) of a detail page, each field the first match of its pattern in the text; None without an article."""
    page = _Article([*article, *title])
    page.feed(html or "")
    page.close()
    text = page.of(article)
    if text is None:
        return None
    head = page.of(title)
    found = ((re.search(p, text) or [None, ""])[1].strip() for p in patterns.values())
    return (head.replace("\n", " ") if head else None, text, *(v or None for v in found))


def details(pages: DataFrame, article: list[str], title: list[str], patterns: dict[str, str], url: str = "url", html: str = "html") -> DataFrame:
    """(url, title, text, <fields>) of the detail pages that have an article; a field that isn't found is null."""
    names = ["url", "title", "text", *patterns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, d) for u, d in ((u, detail_of(h, article, title, patterns)) for u, h in zip(b["u"], b["h"], strict=True)) if d]
            yield pd.DataFrame([(u, *d) for u, d in rows], columns=names)

    return pages.select(F.col(url).alias("u"), F.col(html).alias("h")).mapInPandas(run, ", ".join(f"`{n}` string" for n in names))


def date_in_address(url: Column) -> Column:
    """The date in an address' path (2025/0131, 20250131, 2025-01-31 and the like); null without one."""
    digits = F.regexp_replace(F.regexp_extract(url, r"[/_-](20\d{2}[-/]?(?:0[1-9]|1[0-2])[-/]?(?:0[1-9]|[12]\d|3[01]))(?!\d)", 1), "[-/]", "")
    return F.when(digits != "", F.try_to_date(digits, "yyyyMMdd"))


def collected(lists: DataFrame, pages: DataFrame, since: str, wanted: str, direction: str, article: list[str], title: list[str], patterns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(notices, funnel): list pages -> recent rows -> wanted titles -> their detail pages -> those in the direction.

    lists, pages: (url, html) of stored list and detail pages. An address listed twice counts once,
    with its last date. funnel: (step, n) from all rows listed to the notices kept.
    """
    listed = list_rows(lists).groupBy("url").agg(F.max(F.struct("date", "title")).alias("l")).select("url", "l.date", F.col("l.title").alias("listed_title"))
    tagged = listed.withColumns({"recent": F.col("date") >= since, "titled": F.col("listed_title").rlike(wanted)})
    found = details(pages, article, title, patterns).dropDuplicates(["url"])
    whole = tagged.join(found, "url", "left").withColumn("fits", F.coalesce(F.concat_ws("\n", "listed_title", "text").rlike(direction), F.lit(False)))
    steps = {"listed": F.lit(True), "recent": F.col("recent"), "titled": F.col("recent") & F.col("titled")}
    steps["detailed"] = steps["titled"] & F.col("text").isNotNull()
    steps["kept"] = steps["detailed"] & F.col("fits")
    funnel = whole.agg(*(F.count_if(c).alias(n) for n, c in steps.items())).unpivot([], list(steps), "step", "n")
    notices = whole.filter(steps["kept"]).select("url", "date", F.coalesce("listed_title", "title").alias("project_name"), F.col("text").alias("raw_text"), *patterns)
    return notices, funnel
