"""Text of office files from their XML."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

from corpusmill.operators.tables import letters

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_X = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
EMPTY_BOOK = "No data could be extracted from this workbook."


def docx_text(data: bytes, ext: str = "docx") -> str:
    """Paragraphs of the body, tables left out, one a line."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.findall(f"{_W}p")).strip()


def slide_text(xml: bytes) -> str:
    lines = []
    for p in ET.fromstring(xml).iter(f"{_A}p"):
        line = "".join(t.text or "" for t in p.iter(f"{_A}t"))
        if line.strip() and line.strip() != "-":
            lines.append("- " + line)
    return "\n".join(lines)


def pptx_text(data: bytes, ext: str = "pptx") -> str:
    """Slides in the order of their numbers; blank slides are left out."""
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = [f"## Slide {i}\n\n{t}\n\n---\n\n" for i, n in slides if (t := slide_text(z.read(n)))]
    return "".join(out) or "No text could be extracted from this presentation."


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheet(name: str, rows: list[list[str]]) -> str:
    lines = [
        f"Row {i}: " + "; ".join(f"Col {letters(j)}: {v.strip()}" for j, v in enumerate(row) if v.strip()) + "\n"
        for i, row in enumerate(rows, 1)
        if any(v.strip() for v in row)
    ]
    return f"## Sheet: {name}\n\n" + "".join(lines) + "\n" if lines else ""


def _trimmed(cells: dict[tuple[int, int], str]) -> list[list[str]]:
    """Rows of the used range, counted from its corner."""
    if not cells:
        return []
    top, left = min(r for r, _ in cells), min(c for _, c in cells)
    bottom, right = max(r for r, _ in cells), max(c for _, c in cells)
    return [[cells.get((r, c), "") for c in range(left, right + 1)] for r in range(top, bottom + 1)]


def xlsx_text(data: bytes, ext: str = "xlsx") -> str:
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    sheets = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    parts = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
    out = ""
    for name, (_, part) in zip(sheets, parts):
        cells = {}
        for c in ET.fromstring(z.read(part)).iter(f"{_S}c"):
            ref, kind, v = c.get("r"), c.get("t"), c.find(f"{_S}v")
            value = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else "" if v is None else v.text or ""
            if kind == "s":
                value = shared[int(value)]
            elif kind == "b":
                value = "true" if value == "1" else "false"
            if value:
                cells[int(re.search(r"\d+", ref)[0]), _column(ref)] = value
        out += _sheet(name, _trimmed(cells))
    return out or EMPTY_BOOK


def ods_text(data: bytes, ext: str = "ods") -> str:
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml"))
    out = ""
    for sheet in root.iter(f"{_T}table"):
        cells, r = {}, 0
        for row in sheet.iter(f"{_T}table-row"):
            c = 0
            for cell in row:
                value = "\n".join("".join(p.itertext()) for p in cell.iter(f"{_X}p"))
                times = int(cell.get(f"{_T}number-columns-repeated", "1"))
                if value:
                    for k in range(times):
                        cells[r, c + k] = value
                c += times
            r += int(row.get(f"{_T}number-rows-repeated", "1"))
        out += _sheet(sheet.get(f"{_T}name"), _trimmed(cells))
    return out or EMPTY_BOOK
