"""Workbooks: a Python data source over the zipped XML, one partition per sheet, every row and column."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMATS = {14, 15, 16, 17, 22, 27, 30, 36, 45, 46, 47, 50, 57}


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, path in the archive) in workbook order."""
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = []
    for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{M}sheet"):
        t = targets[s.get(f"{R}id")].lstrip("/")
        found.append((s.get("name"), t if t.startswith("xl/") else f"xl/{t}"))
    return found


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{M}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{M}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Style numbers that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{M}numFmt") if re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    xfs = root.find(f"{M}cellXfs")
    return {i for i, xf in enumerate(xfs if xfs is not None else []) if int(xf.get("numFmtId", 0)) in DATE_FORMATS | own}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _cell(c: ET.Element, strings: list[str], dates: set[int]) -> str | None:
    """Flat text: shared and rich text joined, formulas by their result, errors null, booleans Yes or No, dates ISO."""
    kind, v = c.get("t"), c.find(f"{M}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{M}t"))
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(v.text)]
    if kind == "b":
        return "Yes" if v.text == "1" else "No"
    if kind in ("str", "d"):
        return v.text
    if int(c.get("s", 0)) in dates:
        at = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(float(v.text) * 86_400))
        return at.isoformat(sep=" ")
    number = float(v.text)
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else v.text


def _links(book: zipfile.ZipFile, path: str) -> dict[str, str]:
    """{cell reference: target} of a sheet's external links, mail addresses without their scheme."""
    folder, _, name = path.rpartition("/")
    listed = f"{folder}/_rels/{name}.rels"
    if listed not in book.namelist():
        return {}
    targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(book.read(listed)) if r.get("Type", "").endswith("/hyperlink")}
    found: dict[str, str] = {}
    if targets:
        # links stand behind the rows in the file
        with book.open(path) as f:
            for _, el in ET.iterparse(f):
                if el.tag == f"{M}hyperlink" and el.get(f"{R}id") in targets:
                    found[el.get("ref", "").split(":")[0]] = re.sub("(?i)^mailto:", "", targets[el.get(f"{R}id")])
                elif el.tag == f"{M}row":
                    el.clear()
    return found


def rows(book: zipfile.ZipFile, path: str) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of every row, empty ones included; a linked cell without text holds its target."""
    strings, dates, links = _strings(book), _date_styles(book), _links(book, path)
    with book.open(path) as f:
        last = 0
        for _, el in ET.iterparse(f):
            if el.tag != f"{M}row":
                continue
            number = int(el.get("r", last + 1))
            for missing in range(last + 1, number):
                yield missing, []
            last = number
            cells: list[str | None] = []
            for c in el.iter(f"{M}c"):
                i = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (i + 1 - len(cells))
                text = _cell(c, strings, dates)
                cells[i] = links.get(c.get("r")) if text is None or text == "" else text
            yield number, cells
            el.clear()


class SheetPartition(InputPartition):
    def __init__(self, name: str, path: str):
        self.name, self.path = name, path


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.file, self.sheet, self.mode = options["path"], options.get("sheet"), options.get("mode", "rows")

    def partitions(self) -> list[InputPartition]:
        with zipfile.ZipFile(self.file) as book:
            found = sheets(book)
        if self.sheet is not None and self.sheet not in [n for n, _ in found]:
            raise ValueError(f"no sheet {self.sheet!r}; there are {', '.join(n for n, _ in found)}")
        return [SheetPartition(n, p) for n, p in found if self.sheet in (None, n)]

    def read(self, partition: SheetPartition):
        if self.mode == "sheets":
            yield (partition.name,)
            return
        with zipfile.ZipFile(self.file) as book:
            for number, cells in rows(book, partition.path):
                yield (partition.name, number, cells)


class XlsxSource(DataSource):
    """``spark.dataSource.register(XlsxSource)``; options path, sheet (default all), mode 'rows' or 'sheets'."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_sheet"

    def schema(self) -> str:
        return "sheet string" if self.options.get("mode") == "sheets" else "sheet string, row_number int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return XlsxReader(dict(self.options))
