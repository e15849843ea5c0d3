"""Office files with the standard library: text of .docx, cells of .xlsx."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Unpacked bytes of one member beyond which a file is refused.
MEMBER_BYTES = 512 << 20


class Unsupported(ValueError):
    """A file kind that needs a parser that is not installed."""


def _member(z: zipfile.ZipFile, name: str) -> bytes:
    if z.getinfo(name).file_size > MEMBER_BYTES:
        raise ValueError(f"{name} is larger than {MEMBER_BYTES} bytes")
    return z.read(name)


def docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(_member(z, "word/document.xml"))
    lines = []
    for p in root.iter(_W + "p"):
        parts = []
        for node in p.iter():
            if node.tag == _W + "t":
                parts.append(node.text or "")
            elif node.tag in (_W + "tab",):
                parts.append("\t")
            elif node.tag in (_W + "br", _W + "cr"):
                parts.append("\n")
        lines.append("".join(parts))
    return "\n".join(lines).strip()


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_cells(content: bytes):
    """(sheet, row, col, kind, raw), rows and columns from 0. A formula gives
    its text, not its value."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(_member(z, "xl/sharedStrings.xml")).iter(_S + "si"):
                shared.append("".join(t.text or "" for t in si.iter(_S + "t")))
        dates = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(_member(z, "xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iter(_S + "numFmt") if re.search(r"[dmyh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
            xfs = styles.find(_S + "cellXfs")
            for i, xf in enumerate(xfs if xfs is not None else []):
                if int(xf.get("numFmtId", "0")) in own | set(range(14, 23)):
                    dates.add(i)
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(_member(z, "xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(_member(z, "xl/workbook.xml")).iter(_S + "sheet"):
            target = rels[sheet.get(_R + "id")].lstrip("/")
            root = ElementTree.fromstring(_member(z, target if target.startswith("xl/") else "xl/" + target))
            for c in root.iter(_S + "c"):
                ref, t = c.get("r"), c.get("t", "n")
                row, col = int(re.search(r"\d+", ref)[0]) - 1, _column(ref)
                f, v = c.find(_S + "f"), c.find(_S + "v")
                value = v.text if v is not None else None
                if f is not None and f.text:
                    yield sheet.get("name"), row, col, "formula", f.text
                elif t == "s":
                    yield sheet.get("name"), row, col, "string", shared[int(value)]
                elif t == "inlineStr":
                    yield sheet.get("name"), row, col, "string", "".join(x.text or "" for x in c.iter(_S + "t"))
                elif t == "str":
                    yield sheet.get("name"), row, col, "string", value or ""
                elif t == "b":
                    yield sheet.get("name"), row, col, "boolean", "true" if value == "1" else "false"
                elif value is not None and int(c.get("s", "-1")) in dates:
                    import datetime

                    yield sheet.get("name"), row, col, "date", (datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(value))).isoformat()
                elif value is not None:
                    yield sheet.get("name"), row, col, "number", value


def flat_cells(cells) -> str:
    """Sheets as text: a title line, then rows with cells joined by bars."""
    out, last = [], (None, None)
    for sheet, row, _, kind, raw in cells:
        if sheet != last[0]:
            out.append(f"=== Sheet: {sheet} ===")
            out.append("")
            last = (sheet, None)
        text = repr(float(raw)) if kind == "number" else raw
        if row != last[1]:
            out[-1 if last[1] is None else len(out) :] = [text]
            last = (sheet, row)
        else:
            out[-1] += " | " + text
    return "\n".join(out)


def read_text(path: str, kind: str, content: bytes) -> str:
    """Text of a file by its kind; kinds without a parser raise Unsupported."""
    low = path.lower()
    if kind == "TXT":
        return content.decode("utf-8", "replace")
    if low.endswith(".docx"):
        return docx_text(content)
    if low.endswith(".xlsx"):
        return flat_cells(xlsx_cells(content))
    if low.endswith(".pdf"):
        return _pdf(content)
    raise Unsupported(f"no parser for {low.rsplit('.', 1)[-1]} files is installed")


def _pdf(content: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError:
        raise Unsupported("no parser for pdf files is installed") from None
    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)
