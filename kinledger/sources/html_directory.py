"""Directory pages: a table walk in document order as a table function."""

from __future__ import annotations

import html
import re

from pyspark.sql.functions import udtf

TOKEN = re.compile(r"<(?P<close>/?)(?P<tag>h[1-6]|tr|td|th|a|br)\b(?P<rest>[^>]*)>|<[^>]*>|(?P<text>[^<]+)", re.I)
HREF = re.compile(r"""href\s*=\s*["']([^"']+)["']""", re.I)


def entries(page: str | None):
    """(heading, name, website, address) of each row under its last heading.

    A cell is a linked name, or a name with address lines; rows without a name and repetitions of (heading, name,
    website) are left out. Null and empty pages have no entries.
    """
    heading, seen = "", set()
    in_heading = in_cell = False
    buffer: list[str] = []
    link = None
    cells: list[tuple[list[str], str | None]] = []
    for m in TOKEN.finditer(re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ", page or "")):
        tag, close = (m["tag"] or "").lower(), bool(m["close"])
        if m["text"] is not None:
            if in_heading or in_cell:
                buffer.append(html.unescape(m["text"]))
        elif tag.startswith("h") and tag[1:].isdigit():
            if close and in_heading:
                heading = " ".join("".join(buffer).split()) or heading
            in_heading, buffer = not close, []
        elif tag in ("td", "th"):
            if close and in_cell:
                cells.append(([" ".join(x.split()) for x in "".join(buffer).split("\n")], link))
            in_cell, buffer, link = not close, [], None
        elif tag == "a" and in_cell and not close:
            h = HREF.search(m["rest"])
            link = h[1] if h else link
        elif tag == "br" and in_cell:
            buffer.append("\n")
        elif tag == "tr":
            if close:
                for lines, site in cells:
                    lines = [x for x in lines if x]
                    if not lines:
                        continue
                    name = re.sub(r"^\d+[.)]?\s*|[,*\s]+$", "", lines[0]).strip()
                    key = (heading.lower(), name.lower(), site)
                    if name and key not in seen:
                        seen.add(key)
                        yield heading, name, site, ", ".join(lines[1:]) or None
            cells = []


@udtf(returnType="heading: string, name: string, website: string, address: string")
class DirectoryEntries:
    """``LATERAL directory_entries(html)`` after ``spark.udtf.register("directory_entries", DirectoryEntries)``."""

    def eval(self, page: str):
        yield from entries(page)
