"""Office files as Markdown and as structure: both formats are zip archives of XML, read with the standard
library, a file per row in Arrow batches. Files that cannot be read give empty text or no rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unpacked bytes of an archive that are read at most; a larger one counts as unreadable.
MAX_UNPACKED = 200 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_STRUCTURE = "kind string, id string, label string, src string, dst string, relation string, source_file string"


def _open(content: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(content))
    if sum(i.file_size for i in z.infolist()) > MAX_UNPACKED:
        raise ValueError("the archive is too large when unpacked")
    return z


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in z.namelist():
        return None
    data = z.read(name)
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise ValueError("document types are not read")
    return ElementTree.fromstring(data)


def _table(rows: list[list[str]]) -> list[str]:
    if not rows:
        return []
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return [line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])]


def docx_markdown(content: bytes) -> str:
    """Paragraphs in order (headings 1 to 3 and list items by style), then the tables; "" if unreadable."""
    try:
        z = _open(content)
        styles = {}
        for s in (root.iter(f"{_W}style") if (root := _xml(z, "word/styles.xml")) is not None else ()):
            name = s.find(f"{_W}name")
            styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val", "") if name is not None else ""
        body = _xml(z, "word/document.xml").find(f"{_W}body")
        text_of = lambda e: "".join(
            (t.text or "") if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in e.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")
        ).strip()
        out = []
        for p in body.findall(f"{_W}p"):
            text = text_of(p)
            ref = p.find(f"{_W}pPr/{_W}pStyle")
            style_id = ref.get(f"{_W}val", "") if ref is not None else ""
            style = (styles.get(style_id) or style_id).lower().replace(" ", "")
            lead = next((m for s, m in (("heading1", "# "), ("heading2", "## "), ("heading3", "### "), ("list", "- ")) if style.startswith(s)), "")
            out.append(lead + text if text else "")
        for t in body.findall(f"{_W}tbl"):
            out += _table([["\n".join(filter(None, (text_of(p) for p in c.findall(f"{_W}p")))) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")])
        return "\n".join(out)
    except Exception:  # an unreadable file has no text
        return ""


def _sheets(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """(name, part) of the sheets in order."""
    rels = {r.get("Id"): r.get("Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
    for s in _xml(z, "xl/workbook.xml").iter(f"{_S}sheet"):
        target = rels[s.get(f"{_R}id")]
        yield s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _rows(z: zipfile.ZipFile, part: str, shared: list[str]) -> list[list[str | None]]:
    """Cells of a sheet, by row; None where there is no value."""
    out = []
    for r in _xml(z, part).iter(f"{_S}row"):
        cells: dict[int, str | None] = {}
        for i, c in enumerate(r.findall(f"{_S}c")):
            kind, v = c.get("t"), c.find(f"{_S}v")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
            elif v is None or v.text is None:
                value = None
            elif kind == "s":
                value = shared[int(v.text)]
            elif kind == "b":
                value = str(v.text == "1")
            else:
                value = v.text
            cells[_column(c.get("r")) if c.get("r") else i] = value
        out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    wide = max(map(len, out), default=0)
    return [r + [None] * (wide - len(r)) for r in out]


def _shared(z: zipfile.ZipFile) -> list[str]:
    root = _xml(z, "xl/sharedStrings.xml")
    return [] if root is None else ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in root.findall(f"{_S}si")]


def xlsx_markdown(content: bytes) -> str:
    """A section with a table per sheet, empty rows and empty sheets left out; "" if unreadable."""
    try:
        z = _open(content)
        shared, out = _shared(z), []
        for name, part in _sheets(z):
            rows = [["" if c is None else c for c in r] for r in _rows(z, part, shared) if any(c is not None for c in r)]
            if rows:
                out += [f"## Sheet: {name}", *_table(rows)]
        return "\n".join(out)
    except Exception:  # an unreadable file has no text
        return ""


def _key(*parts: str) -> str:
    return re.sub("[^a-z0-9_]", "_", "_".join(p.lower() for p in parts).strip("_"))


def xlsx_structure(path: str, content: bytes) -> list[dict]:
    """Rows of kind node and edge: the file contains sheets, these tables, these columns."""
    try:
        z = _open(content)
        stem = re.sub("[^a-z0-9]", "_", path.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower())
        out, seen = [], set()

        def node(nid: str, label: str, parent: str | None) -> str:
            if nid not in seen:
                seen.add(nid)
                out.append(dict(kind="node", id=nid, label=label, source_file=path))
            if parent:
                out.append(dict(kind="edge", src=parent, dst=nid, relation="contains", source_file=path))
            return nid

        file = node(_key(path), path.rsplit("/", 1)[-1], None)
        for name, part in _sheets(z):
            sheet = node(_key(stem, name), f"{name} (sheet)", file)
            folder, leaf = part.rsplit("/", 1)
            rels = _xml(z, f"{folder}/_rels/{leaf}.rels")
            for rel in () if rels is None else rels:
                if not rel.get("Type", "").endswith("/table"):
                    continue
                target = rel.get("Target")
                at = target.lstrip("/") if target.startswith("/") else re.sub(r"[^/]+/\.\./", "", f"{folder}/{target}")
                t = _xml(z, at)
                table = node(_key(stem, name, t.get("name")), t.get("name"), sheet)
                for c in t.iter(f"{_S}tableColumn"):
                    if c.get("name"):
                        node(_key(stem, t.get("name"), c.get("name")), c.get("name"), table)
        return out
    except Exception:  # an unreadable file has no structure
        return []


def sidecar_name(path: Column) -> Column:
    """Name of the Markdown file beside an office file: its stem and eight digits of the path's SHA-256."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.concat(stem, F.lit("_"), F.substring(F.sha2(path, 256), 1, 8), F.lit(".md"))


def office_markdown(files: DataFrame) -> DataFrame:
    """(path, sidecar, markdown) of the office files among ``files`` (path, content) that have text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [docx_markdown(c) if p.lower().endswith(".docx") else xlsx_markdown(c) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "text": texts})

    office = files.where(F.lower("path").rlike(r"\.(docx|xlsx)$") & F.col("content").isNotNull()).select("path", "content")
    got = office.mapInPandas(run, "path string, text string").where(F.trim("text") != "")
    head = F.concat(F.lit("<!-- converted from "), F.substring_index("path", "/", -1), F.lit(" -->\n\n"))
    return got.select("path", sidecar_name(F.col("path")).alias("sidecar"), F.concat(head, "text").alias("markdown"))


def office_structure(files: DataFrame) -> DataFrame:
    """Nodes and edges of the workbooks among ``files`` (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _STRUCTURE.split(", ")]
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in xlsx_structure(p, c)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype(object).where(out.notna(), None)

    return files.where(F.lower("path").endswith(".xlsx") & F.col("content").isNotNull()).select("path", "content").mapInPandas(run, _STRUCTURE)
