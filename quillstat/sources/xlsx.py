"""The first sheet of an .xlsx workbook, with the standard library only.

A workbook is one compressed document, so one task reads it; it comes through Spark's binary reader and so from
any file system that Spark has. Numbers in a date format become dates as text, "2024-03-01" or "2024-03-01 12:30:00";
those before 1 March 1900, where the calendar of workbooks has a day too many, and pure times stay numbers.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


#: The built-in number formats that show a date.
DATE_FORMATS = (14, 15, 16, 17, 22)


def date_styles(styles: bytes) -> set[int]:
    """Cell styles whose number format shows a year, or a day with a month."""
    root = ElementTree.fromstring(styles)
    dates = set(DATE_FORMATS)
    for f in root.iter(f"{_NS}numFmt"):
        shown = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")).lower()
        if "y" in shown or ("d" in shown and "m" in shown):
            dates.add(int(f.get("numFmtId")))
    formats = root.find(f"{_NS}cellXfs")
    return {k for k, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId") or 0) in dates}


def as_date(raw: str, since_1904: bool) -> str:
    days = float(raw)
    if days < (0 if since_1904 else 61) or days > 2_958_465:
        return raw
    start = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30)
    at = start + datetime.timedelta(seconds=round(days * 86400))
    return at.strftime("%Y-%m-%d" if at.time() == datetime.time() else "%Y-%m-%d %H:%M:%S")


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        first = next(workbook.iter(f"{_NS}sheet"))
        settings = workbook.find(f"{_NS}workbookPr")
        since_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        dates = date_styles(book.read("xl/styles.xml")) if "xl/styles.xml" in names else set()
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = links[first.get(f"{_REL}id")].lstrip("/")
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_NS}row":
                    continue
                values: list[str | None] = []
                for k, cell in enumerate(row.iter(f"{_NS}c")):
                    at = _column(cell.get("r")) if cell.get("r") else k
                    values += [None] * (at + 1 - len(values))
                    raw = cell.findtext(f"{_NS}v")
                    kind = cell.get("t")
                    if kind == "inlineStr":
                        raw = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                    elif kind == "s" and raw is not None:
                        raw = shared[int(raw)]
                    elif kind == "b" and raw is not None:
                        raw = "true" if raw == "1" else "false"
                    elif kind in (None, "n") and raw and int(cell.get("s") or 0) in dates:
                        raw = as_date(raw, since_1904)
                    values[at] = raw
                yield values
                row.clear()


def read_xlsx(spark: SparkSession, path: str, sheet_rows=sheet_rows) -> DataFrame:
    """The first row holds the names. sheet_rows parses a workbook's bytes to rows of texts."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                part = []
                for values in sheet_rows(bytes(content)):
                    part.append(values)
                    if len(part) == 5000:
                        yield pd.DataFrame({"cells": part})
                        part = []
                if part:
                    yield pd.DataFrame({"cells": part})

    cells = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "cells array<string>")
    head = cells.first()
    if head is None:
        return spark.createDataFrame([], "empty string")
    names = [n if n else f"column_{k + 1}" for k, n in enumerate(head["cells"])]
    numbered = cells.withColumn("_n", F.monotonically_increasing_id()).filter("_n > 0")
    return numbered.select(*[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)])
