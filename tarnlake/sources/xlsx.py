"""Excel workbooks: unpacked by the executors with the standard library, one task per workbook.

The format itself limits a sheet to 1,048,576 rows, and rows leave the task in small batches. A number is a date
only by the style of its cell, so styles are resolved while a workbook is unpacked: each cell is a text and a kind.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.session import keep, ship_package

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: ``kinds`` has one letter per cell: whole number, number, date, timestamp, boolean, text, or - for an empty one;
#: ``titles`` is the sheet's first row
CELLS = (
    "path string, sheet string, sheet_no int, row_no int, header boolean, cells array<string>, kinds string, "
    "titles array<string>"
)
BATCH = 2000
# Number formats of the file format that show a date, a time of day, or both.
DATES = {14, 15, 16, 17, *range(27, 32), 36, *range(50, 55), 57, 58}
TIMES = {18, 19, 20, 21, 32, 33, 34, 35, 45, 46, 47, 55, 56}
BOTH = {22}


def _column_number(reference: str) -> int:
    """0 for A1, 27 for AB7."""
    n = 0
    for letter in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _text(element) -> str:
    return "".join(t.text or "" for t in element.iter(MAIN + "t"))


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, member path) in workbook order."""
    with book.open("xl/_rels/workbook.xml.rels") as f:
        targets = {e.get("Id"): e.get("Target") for _, e in iterparse(f) if e.get("Target")}
    with book.open("xl/workbook.xml") as f:
        found = [(e.get("name"), e.get(REL + "id")) for _, e in iterparse(f) if e.tag == MAIN + "sheet"]
    out = []
    for name, rid in found:
        target = targets[rid]
        out.append((name, target.lstrip("/") if target.startswith("/") else "xl/" + target))
    return out


def shown_as(code: str) -> str:
    """What a number format shows: ``d`` a date, ``h`` a time of day, ``t`` both, ``n`` a number."""
    # texts in quotes, escaped letters and colours or conditions are no part of the pattern; [h] is elapsed time
    plain = re.sub(r'"[^"]*"|\\.|_.|\*.', "", code.split(";")[0].lower())
    clock = bool(re.search(r"[hs]", plain))
    plain = re.sub(r"\[[^\]]*\]", "", plain).replace("general", "")
    day = bool(re.search(r"[dy]", plain)) or ("m" in plain and not clock)
    clock = clock and bool(re.search(r"[hms]", plain) or re.search(r"\[[hms]+\]", code.lower()))
    return "t" if day and clock else "d" if day else "h" if clock else "n"


def _styles(book: zipfile.ZipFile) -> list[str]:
    """For each cell style what its number format shows."""
    if "xl/styles.xml" not in book.namelist():
        return []
    own: dict[int, str] = {}
    styles: list[str] = []
    with book.open("xl/styles.xml") as f:
        for _, e in iterparse(f):
            if e.tag == MAIN + "numFmt":
                own[int(e.get("numFmtId"))] = shown_as(e.get("formatCode") or "")
            elif e.tag == MAIN + "cellXfs":
                for x in e.iter(MAIN + "xf"):
                    n = int(x.get("numFmtId") or 0)
                    styles.append(own.get(n) or ("d" if n in DATES else "h" if n in TIMES else "t" if n in BOTH else "n"))
    return styles


def _from_1904(book: zipfile.ZipFile) -> bool:
    with book.open("xl/workbook.xml") as f:
        return any(e.tag == MAIN + "workbookPr" and e.get("date1904") in ("1", "true") for _, e in iterparse(f))


def moment(serial: float, shows: str, from_1904: bool) -> tuple[str, str]:
    """(text, kind) of a date number. Days count from 1904-01-01 or from 1900-01-01, where day 60 is a 29 February that
    there was not; a number that is no date (negative, or after the year 9999) stays one."""
    start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 31 if serial < 60 else 30)
    try:
        at = start + dt.timedelta(milliseconds=round(serial * 86_400_000)) if serial >= 0 else None
    except OverflowError:
        at = None
    if at is None:
        return _number(repr(serial))
    if shows == "h":
        seconds = round(serial * 86_400)
        return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}", "s"
    if shows == "d" and serial == int(serial):
        return at.date().isoformat(), "d"
    return at.isoformat(" "), "t"


def _number(text: str) -> tuple[str, str]:
    value = float(text)
    return (str(int(value)), "w") if abs(value) < 2**53 and value == int(value) else (text, "n")


def _cell(cell, shared: list[str], styles: list[str], from_1904: bool) -> tuple[str | None, str]:
    """(text, kind) of one cell; errors are empty."""
    kind = cell.get("t")
    if kind == "inlineStr":
        return _text(cell), "s"
    value = cell.find(MAIN + "v")
    if value is None or value.text is None or kind == "e":
        return None, "-"
    if kind == "s":
        return shared[int(value.text)], "s"
    if kind == "b":
        return ("true" if value.text == "1" else "false"), "b"
    if kind == "str":
        return value.text, "s"
    if kind == "d":
        return value.text.replace("T", " "), "d" if len(value.text) == 10 else "t"
    try:
        style = int(cell.get("s") or 0)
        shows = styles[style] if style < len(styles) else "n"
        return _number(value.text) if shows == "n" else moment(float(value.text), shows, from_1904)
    except ValueError:
        return value.text, "s"


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, int, bool, list, str, list]]:
    """(sheet, sheet number, row number, first row of its sheet, cell texts, kinds, titles) of a workbook."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            shared = [_text(e) for _, e in iterparse(f) if e.tag == MAIN + "si"]
    styles, from_1904 = _styles(book), _from_1904(book)
    for number, (sheet, member) in enumerate(_sheets(book)):
        titles: list | None = None
        with book.open(member) as f:
            for _, row in iterparse(f):
                if row.tag != MAIN + "row":
                    continue
                cells: list = []
                kinds: list[str] = []
                for cell in row.iter(MAIN + "c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kinds += ["-"] * (at + 1 - len(kinds))
                    cells[at], kinds[at] = _cell(cell, shared, styles, from_1904)
                header = titles is None
                titles = cells if header else titles
                yield sheet, number, int(row.get("r") or 0), header, cells, "".join(kinds), titles
                row.clear()


def unpack(workbooks: DataFrame) -> DataFrame:
    """Cell rows of workbooks given as (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "sheet", "sheet_no", "row_no", "header", "cells", "kinds", "titles"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                for row in workbook_rows(content):
                    rows.append((path, *row))
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    ship_package(workbooks.sparkSession)
    return workbooks.select("path", "content").mapInPandas(run, CELLS)


def sheet_frame(cells: DataFrame, header: list[str]) -> DataFrame:
    """Columns of unpacked rows, named by the header; the header rows are left out."""
    return cells.filter("NOT header").select(
        *[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(header)]
    )


def _layouts(cells: DataFrame) -> list[list]:
    """The different first rows of the sheets; one row per layout comes to the driver."""
    return sorted((r["titles"] for r in cells.filter("header").select("titles").distinct().collect()), key=str)


def _columns(cells: DataFrame, titles: list, typed: bool) -> DataFrame:
    """The rows under one header. A column of dates only is of that type; with ``typed`` also one of numbers or booleans.
    All others are text."""
    mine = cells.filter("NOT header").filter(F.col("titles").eqNullSafe(F.array(*[F.lit(t).cast("string") for t in titles])))
    at = F.explode(F.sequence(F.lit(1), F.length("kinds"))).alias("at")
    seen = (
        mine.filter("length(kinds) > 0").select("kinds", at)
        .groupBy("at").agg(F.collect_set(F.expr("substring(kinds, at, 1)")).alias("kinds"))
    )
    kinds = {r["at"] - 1: frozenset(r["kinds"]) - {"-"} for r in seen.filter(F.col("at") <= len(titles)).collect()}
    names = [c or f"col_{i}" for i, c in enumerate(titles)]
    return sheet_frame(mine, names).select(
        *[F.col(f"`{n.replace('`', '``')}`").cast(_type_of(kinds.get(i, frozenset()), typed)).alias(n) for i, n in enumerate(names)]
        if len(set(names)) == len(names)
        else "*"
    )


def _type_of(kinds: frozenset, typed: bool) -> str:
    if kinds and kinds <= {"d", "t"}:
        return "timestamp_ntz" if "t" in kinds else "date"
    if typed and kinds and kinds <= {"w", "n"}:
        return "double" if "n" in kinds else "bigint"
    return "boolean" if typed and kinds == {"b"} else "string"


def _cells(workbooks: DataFrame, sheet: str | None) -> DataFrame:
    """The unpacked rows of one sheet per workbook, kept: header, types and rows come from one parse."""
    cells = unpack(workbooks)
    return keep(cells.filter(F.col("sheet") == sheet) if sheet else cells.filter("sheet_no = 0"), "cells")


def workbook_frame(workbooks: DataFrame, sheet: str | None = None, typed: bool = False) -> DataFrame:
    """The first sheet (or the named one) of workbooks given as (path, content), columns named by its first row.

    Columns of dates are dates, or timestamps if one has a time of day; all others are text unless ``typed``, when
    numbers and booleans have their types as well. Times of day, and dates in a column of other values, are texts.
    The workbooks must share their header.
    """
    cells = _cells(workbooks, sheet)
    layouts = _layouts(cells)
    if len(layouts) > 1:
        raise ValueError("the workbooks have different headers; read and concatenate them by name")
    return _columns(cells, layouts[0] if layouts else [], typed)


def read_excel(
    spark: SparkSession, path: str, sheet: str | None = None, typed: bool = False, **options: str
) -> DataFrame:
    """The workbooks of a path, as :func:`workbook_frame` gives them; options choose the files."""
    return workbook_frame(spark.read.format("binaryFile").options(**options).load(path), sheet, typed)


def excel_frames(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """One typed frame for each header among the first sheets of the workbooks."""
    cells = _cells(spark.read.format("binaryFile").load(paths), None)
    return [_columns(cells, titles, True) for titles in _layouts(cells)]


def describe_sheets(cells: DataFrame, samples: int = 5) -> DataFrame:
    """One row per workbook and sheet: header, data rows, columns and the first sample rows."""
    early = ~F.col("header") & (F.col("row_no") <= samples + 1)
    return cells.groupBy("path", "sheet_no", "sheet").agg(
        F.max(F.when(F.col("header"), F.col("cells"))).alias("header"),
        F.count_if(~F.col("header")).alias("row_count"),
        F.max(F.size("cells")).alias("column_count"),
        F.array_sort(F.collect_list(F.when(early, F.struct("row_no", "cells")))).alias("samples"),
    )
