"""Stored HTML pages: text, links and list rows, parsed by Arrow batches with the standard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

SKIPPED = {"script", "style", "noscript", "template"}
BLOCKS = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "table", "article", "section", "ul", "ol", "td", "th"}
#: Kinds of attachments, words that announce one, pieces of paths of downloads.
EXTENSIONS = (".pdf", ".docx", ".xlsx", ".zip")
MARKERS = ("附件", "下载", "初步设计", "施工图", "招标文件", "工程量清单")
DOWNLOADS = ("attachment", "download", "upload")
_DATE = re.compile(r"(20\d{2})[-年./](\d{1,2})[-月./](\d{1,2})")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.rows: list[list[str]] = []
        self._skip = 0
        self._link: list[str] | None = None
        self._cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self._skip += 1
        elif tag in BLOCKS:
            self.text.append("\n")
        if tag == "a":
            self._link = [dict(attrs).get("href") or "", ""]
        elif tag in ("tr", "li"):
            self.rows.append([])
        elif tag in ("td", "th"):
            self._cell = [""]

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self._skip = max(0, self._skip - 1)
        elif tag in BLOCKS:
            self.text.append("\n")
        if tag == "a" and self._link:
            self.links.append((self._link[0], " ".join(self._link[1].split())))
            self._link = None
        elif tag in ("td", "th") and self._cell is not None:
            if self.rows:
                self.rows[-1].append(" ".join(self._cell[0].split()))
            self._cell = None

    def handle_data(self, data):
        if self._skip:
            return
        self.text.append(data)
        if self._link:
            self._link[1] += data
        if self._cell is not None:
            self._cell[0] += data


def _parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def plain_text(html: str | None) -> str | None:
    """Text of a page: a line a block, blanks squashed, scripts and styles left out."""
    if html is None:
        return None
    lines = (" ".join(x.split()) for x in "".join(_parsed(html).text).split("\n"))
    return "\n".join(x for x in lines if x)


@pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(plain_text, na_action="ignore")


def attachment_links(html: str | None, url: str | None) -> list[tuple[str, str]]:
    """(address, title) of a page's attachments: absolute, without fragment, one row an address, the last title of it.

    A link counts if its path has a known extension, or if its title announces a document and its path a download.
    """
    found: dict[str, str] = {}
    for href, title in _parsed(html).links:
        try:
            full = urldefrag(urljoin(url or "", href.strip()))[0]
            parts = urlsplit(full)
        except ValueError:
            continue
        if parts.scheme not in ("http", "https"):
            continue
        known = parts.path.lower().endswith(EXTENSIONS)
        if known or any(m in title for m in MARKERS) and any(x in parts.path.lower() for x in DOWNLOADS):
            found[full] = title
    return list(found.items())


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page_url, url, title) of all attachments of the pages. Null pages have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(u, *x) for u, h in zip(b["u"], b["h"], strict=True) for x in attachment_links(h, u)], columns=["page_url", "url", "title"])

    return pages.select(F.col(url).alias("u"), F.col(html).alias("h")).mapInPandas(run, "page_url string, url string, title string")


def list_items(html: str | None, url: str | None) -> list[tuple[str, str, str]]:
    """(title, date, address) of the links of a list page that have a date beside them."""
    out = []
    pieces = re.split(r"(?i)<(?:li|tr)\b[^>]*>", html or "")[1:]
    for piece in pieces:
        page = _parsed(piece)
        date = _DATE.search("".join(page.text))
        for href, title in page.links[:1]:
            if date and title and href:
                out.append((title, f"{date[1]}-{int(date[2]):02d}-{int(date[3]):02d}", urljoin(url or "", href)))
    return out


def list_rows(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page_url, title, date, url) of all list pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(u, *x) for u, h in zip(b["u"], b["h"], strict=True) for x in list_items(h, u)], columns=["page_url", "title", "date", "url"])

    return pages.select(F.col(url).alias("u"), F.col(html).alias("h")).mapInPandas(run, "page_url string, title string, date string, url string")
