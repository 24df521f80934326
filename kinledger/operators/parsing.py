"""Rows that fail to parse: recursive-descent grammars that locate the error and go on at the next record.

Terminals are compiled patterns, productions are methods; positions are code-point offsets. Everything runs on Arrow
batches inside the executors, one line at a time, and keeps no state between lines.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number of cells of each layout, and where serial, name and dates stand.
LAYOUTS = {
    "registered_nbfc": {"cells": 9, "name": 1, "yes_no": [3], "dates": []},
    "registered_arc": {"cells": 6, "name": 1, "yes_no": [], "dates": []},
    "cancelled_company": {"cells": 4, "name": 1, "yes_no": [], "dates": []},
    "cancelled_record": {"cells": 10, "name": 2, "yes_no": [], "dates": [7, 8]},
}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
YES_NO = {"yes", "no", "y", "n", "true", "false", ""}

PLAIN = re.compile(r'[^",\r\n]*')
QUOTED = re.compile(r'"((?:[^"]|"")*)"')
RECORD_START = re.compile(r"(?:\r\n|\n|\r)(?=[^\S\r\n]*\"?[^\S\r\n]*(?:[0-9]+[^\S\r\n]*\"?,|sl\. no|sr no))", re.I)
CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f�]")
SPACES = re.compile(r"[\s﻿​]+")


class Fault(Exception):
    """(what, where)"""


@dataclass
class Record:
    start: int
    cells: list[str] = field(default_factory=list)
    error: str | None = None
    error_at: int | None = None


class SheetGrammar:
    """file := record (EOL record)* EOL? ; record := cell (',' cell)* ; cell := QUOTED | PLAIN.

    A production that fails raises with its place. The record is closed there, and parsing resumes at the next
    line end behind which a record start is validated (serial and comma, or a header word), else at the end.
    """

    def __init__(self, text: str):
        self.text, self.pos = text, 0

    def file(self):
        """All records; a trailing carriage return or line end belongs to the last record."""
        while True:
            record = Record(self.pos)
            try:
                self.record(record)
                yield record
            except Fault as e:
                record.error, record.error_at = e.args
                yield record
                anchor = RECORD_START.search(self.text, self.pos)
                if not anchor:
                    return
                self.pos = anchor.end()
                continue
            if self.pos >= len(self.text):
                return
            self.line_end()
            if self.pos >= len(self.text):
                return

    def line_end(self):
        self.pos += 2 if self.text.startswith("\r\n", self.pos) else 1

    def record(self, record: Record):
        self.cell(record)
        while self.text.startswith(",", self.pos):
            self.pos += 1
            self.cell(record)
        if self.pos < len(self.text) and self.text[self.pos] not in "\r\n":
            raise Fault("unexpected character", self.pos)

    def cell(self, record: Record):
        if self.text.startswith('"', self.pos):
            m = QUOTED.match(self.text, self.pos)
            if not m:
                raise Fault("quote never closed", self.pos)
            if m.end() < len(self.text) and self.text[m.end()] not in ",\r\n":
                # the quote may belong to a later record, so recovery looks behind the opening one
                raise Fault("text after closing quote", m.end())
            self.pos = m.end()
            record.cells.append(m[1].replace('""', '"'))
        else:
            m = PLAIN.match(self.text, self.pos)
            self.pos = m.end()
            if self.text.startswith('"', self.pos):
                raise Fault("quote inside unquoted cell", self.pos)
            record.cells.append(m[0])


def squeeze(s: str) -> str:
    return SPACES.sub(" ", s).strip()


def _real(y: int, m: int, d: int) -> bool:
    if not (1 <= m <= 12 and 1 <= y <= 9999):
        return False
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return 1 <= d <= [31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m - 1]


def _month(word: str) -> int:
    w = word.lower()
    return next((i + 1 for i, m in enumerate(MONTHS) if w in (m, m[:3])), 0)


DATE_SHAPES = [
    (re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?: 00:00:00)?"), lambda g: _real(int(g[1]), int(g[2]), int(g[3]))),
    (re.compile(r"([0-9]{1,2})[- ]([A-Za-z]+)[- ]([0-9]{4})"), lambda g: _real(int(g[3]), _month(g[2]), int(g[1]))),
    (re.compile(r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"), lambda g: _real(int(g[3]), int(g[2]), int(g[1]))),
    (re.compile(r"([A-Za-z]+) ([0-9]{1,2}), ?([0-9]{4})"), lambda g: _real(int(g[3]), _month(g[1]), int(g[2]))),
    (re.compile(r"[0-9]{5}"), lambda g: True),
]


def is_sheet_date(s: str) -> bool:
    return any((g := shape.fullmatch(s)) is not None and real(g) for shape, real in DATE_SHAPES)


def read_sheet_line(line: str | None, dataset: str | None) -> dict:
    """Cells of a line or the reason why there are none.

    ``kind`` is 'data', 'furniture' (blank lines, headings, headers) or 'rejected'. A null line or an unknown layout
    is rejected. The reason names the first rule that is broken, ``error_at`` the place if it is a place in the line.
    """
    out = {"kind": "rejected", "cells": None, "reason": None, "error_at": None}
    layout = LAYOUTS.get(dataset)
    if line is None or layout is None:
        return out | {"reason": "no line" if line is None else "unknown layout"}
    records = list(SheetGrammar(line[:-1] if line.endswith("\r") else line).file())
    bad = next((r for r in records if r.error), None)
    if bad:
        return out | {"reason": bad.error, "error_at": bad.error_at}
    if len(records) != 1 or (line[:-1] if line.endswith("\r") else line).endswith(("\r", "\n")):
        return out | {"reason": "line break outside quotes", "error_at": records[-1].start}
    cells = records[0].cells
    if len(cells) != layout["cells"]:
        return out | {"cells": cells, "reason": f"{len(cells)} cells instead of {layout['cells']}"}
    if m := CONTROL.search(line[:-1] if line.endswith("\r") else line):
        return out | {"cells": cells, "reason": "control character", "error_at": m.start()}
    cells = [squeeze(c) for c in cells]
    out["cells"] = cells
    head = cells[0].lower()
    if not any(cells[1:]) or head.startswith(("sl. no", "sr no")):
        # only text in the first cell, or nothing at all; a lone serial is text as well
        return out | {"kind": "furniture"}
    if not re.fullmatch(r"[0-9]+", cells[0], re.A):
        return out | {"reason": "serial is not a number"}
    if not cells[layout["name"]]:
        return out | {"reason": "no name"}
    if any(cells[i].lower() not in YES_NO for i in layout["yes_no"]):
        return out | {"reason": "deposits neither yes nor no"}
    if any(cells[i] and not is_sheet_date(cells[i]) for i in layout["dates"]):
        return out | {"reason": "not a calendar date"}
    return out | {"kind": "data"}


RECORD_TYPE = T.ArrayType(T.StructType().add("record_no", "integer").add("starts_at", "integer").add("cells", T.ArrayType(T.StringType())).add("reason", "string").add("error_at", "integer"))


def recover_records(line: str | None, dataset: str | None) -> list[dict]:
    """Every record of a line in which the grammar finds more than one, with cells or the located error.

    A line is one record by contract, so such a line is set apart as a whole; what stands behind a validated record
    start is read all the same, and judged by the rules of its layout.
    """
    layout = LAYOUTS.get(dataset)
    if line is None or layout is None:
        return []
    records = list(SheetGrammar(line).file())
    if len(records) < 2:
        return []
    out = []
    for i, r in enumerate(records):
        if r.error:
            out.append({"record_no": i, "starts_at": r.start, "cells": None, "reason": r.error, "error_at": r.error_at})
            continue
        end = records[i + 1].start if i + 1 < len(records) else len(line)
        read = read_sheet_line(line[r.start : end].rstrip("\r\n"), dataset)
        out.append({"record_no": i, "starts_at": r.start, "cells": read["cells"], "reason": read["reason"] if read["kind"] != "furniture" else "no data", "error_at": read["error_at"] if read["error_at"] is None else r.start + read["error_at"]})
    return out


@F.pandas_udf(RECORD_TYPE)
def _recover(line: pd.Series, dataset: pd.Series) -> pd.Series:
    return pd.Series([recover_records(a, b) for a, b in zip(line, dataset, strict=True)], dtype=object)


def recovered_records(df: DataFrame, key: str = "line_id", line: str = "line", dataset: str = "dataset_key") -> DataFrame:
    """(row_key, dataset_key, record_no, starts_at, cells, reason, error_at) of lines that hold several records.

    Rows with null ``reason`` are valid records found behind an error or behind another record. Narrow, one stage.
    """
    each = df.select(F.col(key).alias("row_key"), F.col(dataset).alias("dataset_key"), F.explode(_recover(F.col(line), F.col(dataset))).alias("r"))
    return each.select("row_key", "dataset_key", "r.*")


SHEET_TYPE = T.StructType().add("kind", "string").add("cells", T.ArrayType(T.StringType())).add("reason", "string").add("error_at", "integer")


@F.pandas_udf(SHEET_TYPE)
def _read_lines(line: pd.Series, dataset: pd.Series) -> pd.DataFrame:
    rows = [read_sheet_line(a, b) for a, b in zip(line, dataset, strict=True)]
    return pd.DataFrame(rows, columns=["kind", "cells", "reason", "error_at"]).astype({"error_at": "Int32"})


class JsonGrammar:
    """RFC 8259 by recursive descent; raises Fault with the place of the first fault.

    Values nested deeper than DEPTH are refused: statistics never nest beyond two, so these are a case either way.
    """

    BLANK = re.compile(r"[ \t\n\r]*")
    STRING = re.compile(r'"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)"')
    NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
    WORD = re.compile(r"true|false|null")
    WORDS = {"true": True, "false": False, "null": None}
    DEPTH = 200

    def __init__(self, text: str):
        self.text, self.pos = text, 0

    def document(self):
        self.blank()
        value = self.value(0)
        self.blank()
        if self.pos < len(self.text):
            raise Fault("text after the value", self.pos)
        return value

    def blank(self):
        self.pos = self.BLANK.match(self.text, self.pos).end()

    def take(self, terminal: re.Pattern, what: str) -> re.Match:
        m = terminal.match(self.text, self.pos)
        if not m:
            raise Fault(what, self.pos)
        self.pos = m.end()
        return m

    def sign(self, c: str) -> bool:
        self.blank()
        if self.text.startswith(c, self.pos):
            self.pos += 1
            return True
        return False

    def value(self, depth: int):
        self.blank()
        c = self.text[self.pos : self.pos + 1]
        if depth > self.DEPTH:
            raise Fault("nested too deeply", self.pos)
        if c == "{":
            return self.members(depth)
        if c == "[":
            return self.elements(depth)
        if c == '"':
            return json.loads(self.take(self.STRING, "bad string")[0])
        if c == "-" or c.isascii() and c.isdigit():
            return float(self.take(self.NUMBER, "bad number")[0])
        return self.WORDS[self.take(self.WORD, "unexpected character")[0]]

    def members(self, depth: int) -> list[tuple]:
        """A list of pairs, so that a repeated key stays visible."""
        self.pos += 1
        found: list[tuple] = []
        if self.sign("}"):
            return Members(found)
        while True:
            self.blank()
            key = json.loads(self.take(self.STRING, "key expected")[0])
            if not self.sign(":"):
                raise Fault("colon expected", self.pos)
            found.append((key, self.value(depth + 1)))
            if self.sign("}"):
                return Members(found)
            if not self.sign(","):
                raise Fault("comma expected", self.pos)

    def elements(self, depth: int) -> list:
        self.pos += 1
        found: list = []
        if self.sign("]"):
            return found
        while True:
            found.append(self.value(depth + 1))
            if self.sign("]"):
                return found
            if not self.sign(","):
                raise Fault("comma expected", self.pos)


class Members(list):
    """Pairs of a JSON object."""


NOTES_TYPE = T.StructType().add("messages", T.ArrayType(T.StringType())).add("truncated", "boolean").add("failure", "string").add("reason", "string").add("error_at", "integer")


def read_notes(notes: str | None) -> dict:
    """Import statistics of a run's ``notes``; null notes are no error and hold nothing."""
    out = {"messages": None, "truncated": None, "failure": None, "reason": None, "error_at": None}
    if notes is None:
        return out
    try:
        value = JsonGrammar(notes).document()
    except Fault as e:
        return out | {"reason": e.args[0], "error_at": e.args[1]}
    if not isinstance(value, Members):
        return out | {"reason": "not an object"}
    if sorted(k for k, _ in value) != ["failure", "messages", "truncated"]:
        return out | {"reason": "other keys than messages, truncated, failure"}
    v = dict(value)
    if isinstance(v["messages"], Members) or not isinstance(v["messages"], list) or not all(isinstance(m, str) for m in v["messages"]):
        return out | {"reason": "messages is not an array of strings"}
    if not isinstance(v["truncated"], bool):
        return out | {"reason": "truncated is not a boolean"}
    if v["failure"] is not None and not isinstance(v["failure"], str):
        return out | {"reason": "failure is neither a string nor null"}
    safe = [m.encode("utf-8", "replace").decode() for m in v["messages"]]
    return out | {"messages": safe, "truncated": v["truncated"], "failure": v["failure"] and v["failure"].encode("utf-8", "replace").decode()}


@F.pandas_udf(NOTES_TYPE)
def _read_notes(notes: pd.Series) -> pd.DataFrame:
    rows = [read_notes(n) for n in notes]
    return pd.DataFrame(rows, columns=["messages", "truncated", "failure", "reason", "error_at"]).astype({"error_at": "Int32", "truncated": "boolean"})


def sheet_line(line: Column, dataset: Column) -> Column:
    return _read_lines(line, dataset)


def parse_sheet_rows(df: DataFrame, key: str = "line_id", line: str = "line", dataset: str = "dataset_key") -> DataFrame:
    """Key, dataset and the struct of :func:`read_sheet_line`; one row per line, in one narrow stage."""
    return df.select(F.col(key).alias("row_key"), F.col(dataset).alias("dataset_key"), sheet_line(F.col(line), F.col(dataset)).alias("parsed"))


def parse_import_notes(df: DataFrame, key: str = "run_id", notes: str = "notes") -> DataFrame:
    """Key and the struct of :func:`read_notes`; one row per run."""
    return df.select(F.col(key).alias("row_key"), _read_notes(F.col(notes)).alias("parsed"))


def split_sheet_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed data rows, rejected rows with their reason); headings and blank lines are in neither."""
    parsed = parse_sheet_rows(df)
    cell = lambda i: F.get("parsed.cells", F.lit(i))
    is_record, is_nbfc = F.col("dataset_key") == "cancelled_record", F.col("dataset_key") == "registered_nbfc"
    good = parsed.where("parsed.kind = 'data'").select(
        "row_key",
        "dataset_key",
        cell(0).cast("decimal(38,0)").alias("serial"),
        F.when(is_record, cell(2)).otherwise(cell(1)).alias("name"),
        F.when(is_record, cell(3)).otherwise(cell(2)).alias("regional_office"),
        F.when(is_nbfc & (cell(3) != ""), F.lower(cell(3)).isin("yes", "y", "true")).alias("deposits"),
        "parsed.cells",
    )
    bad = parsed.where("parsed.kind = 'rejected'").select("row_key", "dataset_key", "parsed.reason", "parsed.error_at")
    return good, bad


def failed_rows(sheet_rows: DataFrame, import_runs: DataFrame) -> DataFrame:
    """Keys of the lines and notes that are set apart, with the table they are in."""
    lines = parse_sheet_rows(sheet_rows).where("parsed.kind = 'rejected'").select(F.lit("sheet_rows").alias("table_name"), "row_key", "parsed.reason")
    notes = parse_import_notes(import_runs).where("parsed.reason is not null").select(F.lit("import_runs").alias("table_name"), "row_key", "parsed.reason")
    return lines.unionByName(notes)

