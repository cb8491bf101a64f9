"""Bytes of one file as rows of text cells, and back: CSV, JSON lines and XLSX."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def read_rows(data: bytes, kind: str, names: list[str], options: dict[str, str]) -> Iterator[list[str | None]]:
    """Rows with as many cells as there are in the file; None for what JSON leaves out."""
    if kind == "xlsx":
        yield from _skipped(read_xlsx(data, options.get("sheet")), int(options.get("skip_lines", 0) or 0) + (options.get("include_header", "").lower() == "true"))
    elif kind == "json":
        for line in io.StringIO(data.decode("utf-8", "replace")):
            if line.strip():
                o = json.loads(line)
                yield [_cell(o.get(n)) for n in names]
    else:
        text = io.StringIO(data.decode("utf-8", "replace"), newline="")
        for _ in range(int(options.get("skip_lines", 0) or 0)):
            text.readline()
        for row in csv.reader(text, delimiter=_delimiter(options), quotechar=options.get("quote_char", '"') or '"', skipinitialspace=True):
            if row:
                yield row


def _delimiter(options: dict[str, str]) -> str:
    return (options.get("delimiter") or ",").encode().decode("unicode_escape")


def _cell(v) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _skipped(rows: Iterable, n: int) -> Iterator:
    for k, r in enumerate(rows):
        if k >= n:
            yield r


def read_xlsx(data: bytes, sheet: str | None = None) -> Iterator[list[str]]:
    """Cells of a sheet (the first by default) as text, row by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), links[s.get(_REL)]) for s in book.iter(f"{_NS}sheet")]
        target = next((t for n, t in sheets if not sheet or n == sheet), None)
        if target is None:
            raise ValueError(f"the workbook has no sheet {sheet}")
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                out: list[str] = []
                for c in row.iter(f"{_NS}c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(out)
                    out += [""] * (at - len(out))
                    kind, v = c.get("t"), c.findtext(f"{_NS}v")
                    if kind == "s" and v is not None:
                        v = shared[int(v)]
                    elif kind == "inlineStr":
                        v = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif kind == "b":
                        v = "TRUE" if v == "1" else "FALSE"
                    out.append(v or "")
                yield out
                row.clear()


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref).group():
        n = n * 26 + ord(c) - 64
    return max(0, n - 1)


def write_xlsx(rows: Iterable[list[str]], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet with text cells; rows are taken one by one."""
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_NS[1:-1]}" xmlns:r="{_REL[1:-3]}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'{head}<worksheet xmlns="{_NS[1:-1]}"><sheetData>'.encode())
            for k, row in enumerate(rows, 1):
                f.write(f'<row r="{k}">{"".join(f"<c t={chr(34)}inlineStr{chr(34)}><is><t xml:space={chr(34)}preserve{chr(34)}>{escape(re.sub(r"[^\t\n\r -\ud7ff\ue000-\ufffd]", "", v))}</t></is></c>" for v in row)}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def write_csv(rows: Iterable[list[str]], options: dict[str, str]) -> bytes:
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=_delimiter(options), lineterminator="\n").writerows(rows)
    return out.getvalue().encode()


def write_json(rows: Iterable[list[str]], names: list[str]) -> bytes:
    return "".join(json.dumps(dict(zip(names, r)), ensure_ascii=False) + "\n" for r in rows).encode()
