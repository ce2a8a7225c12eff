"""Texts of stored attachments: docx, xlsx, zip and plain text, with limits, by Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST = 2_000_000  # characters of a text
MEMBERS, UNPACKED = 100, 200 << 20  # of a zip
SHEETS, CELLS = 20, 100_000  # of a workbook
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


class Refused(ValueError):
    """An attachment that is over a limit, encrypted or of no known kind."""


def _docx(z: zipfile.ZipFile) -> str:
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines, tables = [], []
    for el in body if body is not None else []:
        if el.tag == f"{_W}p":
            lines.append("".join(t.text or "" for t in el.iter(f"{_W}t")))
        elif el.tag == f"{_W}tbl":
            tables += ["\t".join("".join(t.text or "" for t in c.iter(f"{_W}t")) for c in row.iter(f"{_W}tc")) for row in el.iter(f"{_W}tr")]
    return "\n".join(x for x in lines + tables if x.strip())


def _xlsx(z: zipfile.ZipFile) -> tuple[str, bool]:
    """Text of the cells, and whether sheets or cells beyond the limits are left out."""
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    lines, cells = [], 0
    for name in sheets[:SHEETS]:
        for row in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
            values = []
            for c in row.iter(f"{_S}c"):
                v = c.find(f"{_S}v")
                text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else v.text if v is not None and v.text else ""
                values.append(shared[int(text)] if c.get("t") == "s" and text else text)
                cells += 1
            if any(values):
                lines.append("\t".join(values))
            if cells >= CELLS:
                return "\n".join(lines), True
    return "\n".join(lines), len(sheets) > SHEETS


def text_of(name: str, data: bytes, nested: bool = False) -> tuple[str, str, bool]:
    """(kind, text, whether a limit has cut it) of an attachment; Refused if it can't be read."""
    cut = False
    kind = name.lower().rsplit(".", 1)[-1]
    if kind in ("txt", "md", "csv"):
        text = data.decode("utf-8", "replace")
    elif kind in ("docx", "xlsx", "zip"):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                if any(i.flag_bits & 1 for i in z.infolist()):
                    raise Refused("encrypted")
                if len(z.infolist()) > MEMBERS * (20 if kind != "zip" else 1) or sum(i.file_size for i in z.infolist()) > UNPACKED:
                    raise Refused("too large")
                if kind == "zip":
                    if nested:
                        raise Refused("zip in zip")
                    parts = [text_of(i.filename, z.read(i), True)[1:] for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith((".txt", ".md", ".csv", ".docx", ".xlsx"))]
                    text, cut = "\n\n".join(p for p, _ in parts if p), any(c for _, c in parts)
                elif kind == "docx":
                    text = _docx(z)
                else:
                    text, cut = _xlsx(z)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error, IndexError) as e:
            raise Refused(f"damaged: {type(e).__name__}") from e
    else:
        raise Refused("no reader")
    text = text.replace("\x00", "")
    return kind, text[:LONGEST], cut or len(text) > LONGEST


def texts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, status, kind, text, error, truncated, needs_ocr) of files as ``binaryFile`` gives them: PARSED, or FAILED with the reason.

    A PDF has no reader here and is FAILED; null contents are too. ``truncated`` says that sheets,
    cells or characters beyond the limits are missing from the text, ``needs_ocr`` that a file that
    could be read has no text, so its content must be in pictures.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, data in zip(b["path"], b["content"], strict=True):
                try:
                    if data is None:
                        raise Refused("no content")
                    kind, text, cut = text_of(p, bytes(data))
                    out.append((p, "PARSED", kind, text, None, cut, not text.strip()))
                except Refused as e:
                    out.append((p, "FAILED", p.lower().rsplit(".", 1)[-1], None, str(e), False, False))
            yield pd.DataFrame(out, columns=["path", "status", "kind", "text", "error", "truncated", "needs_ocr"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, status string, kind string, text string, error string, truncated boolean, needs_ocr boolean")


def read(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def to_do(attachments: DataFrame, done: DataFrame) -> DataFrame:
    """Attachments not yet parsed or purged: an incremental run skips the others."""
    return attachments.join(done.filter("status in ('PARSED', 'PURGED')").select("path"), "path", "left_anti")


def to_clean_up(documents: DataFrame, cutoff: str, root: str) -> DataFrame:
    """Parsed files under the root whose parsing is older than the cutoff."""
    return documents.filter((F.col("status") == "PARSED") & F.col("path").startswith(root.rstrip("/") + "/") & (F.col("parsed_at") <= F.lit(cutoff).cast("timestamp_ntz")))
