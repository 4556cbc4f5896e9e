"""Files to blocks (S1-S9, N6): text, Word and Excel files with the standard library only.

A parse failure is a row with an error, never a failed job. ``EXTRACTORS`` takes
readers of formats that need a library, and better ones of those read here: a PDF
scan, which needs character recognition, is a typed failure without one.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import ParserConfig
from tessera.schemas import BLOCKS, FINGERPRINT
from tessera.sources import pdf

ACCEPTED = ("docx", "txt", "md", "pdf", "xlsx", "xls")
LEGACY = ("doc", "wps", "et", "rtf")
CHARS_PER_PAGE = 1500
MAX_UNPACKED = 200 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: extension -> function(bytes) -> (blocks, pages, fingerprint), for formats that need a library.
EXTRACTORS: dict[str, Callable] = {}


def block(text: str, level: int | None = None, page: int | None = None, row: bool = False, item: bool = False) -> dict:
    return {"text": text, "heading_level": level, "page": page, "is_table_row": row, "is_list_item": item}


def decode_text(data: bytes) -> str:
    """UTF-8 with or without a mark, else GB18030."""
    data = data.removeprefix(b"\xef\xbb\xbf")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("gb18030", errors="replace")


def parse_text(data: bytes) -> tuple[list[dict], int, dict]:
    text = decode_text(data)
    return [block(text)], max(1, len(text) // CHARS_PER_PAGE), {}


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        info = archive.getinfo(name)
    except KeyError:
        return None
    if info.file_size > MAX_UNPACKED:
        raise ValueError(f"{name} unpacks to {info.file_size} bytes")
    data = archive.read(info)
    if b"<!ENTITY" in data:
        raise ValueError(f"{name} declares entities")
    return ElementTree.fromstring(data)


def heading_level(style: str) -> int | None:
    """Heading1 to Heading9, or the bare numbers that some word processors use."""
    m = re.fullmatch(r"(?:heading)?\s*([1-9])", style.strip(), re.I)
    return int(m[1]) if m else None


def _paragraph(p: ElementTree.Element) -> tuple[str, int | None, bool]:
    text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
    style, outline = p.find(f".//{_W}pStyle"), p.find(f".//{_W}outlineLvl")
    level = heading_level(style.get(f"{_W}val", "")) if style is not None else None
    if outline is not None and (v := outline.get(f"{_W}val", "").strip()).isdigit() and int(v) <= 8:
        level = int(v) + 1
    return text, level, p.find(f".//{_W}numPr") is not None


def _table_rows(table: ElementTree.Element) -> Iterator[str]:
    """Rows of the outermost table; a cell has the paragraphs of tables in it too."""
    for row in table.iter(f"{_W}tr"):
        if row not in list(table):
            continue
        cells = [" ".join(t for t in (_paragraph(p)[0] for p in cell.iter(f"{_W}p")) if t) for cell in row.findall(f"{_W}tc")]
        if any(cells):
            yield " | ".join(cells)


def _body(node: ElementTree.Element) -> Iterator[dict]:
    for child in node:
        if child.tag == f"{_W}tbl":
            for text in _table_rows(child):
                yield block(text, row=True)
        elif child.tag == f"{_W}p":
            text, level, item = _paragraph(child)
            if text:
                yield block(text, level, item=item)
        else:
            yield from _body(child)


def _local(root: ElementTree.Element | None) -> dict[str, str]:
    return {} if root is None else {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in root.iter() if (e.text or "").strip()}


def parse_docx(data: bytes) -> tuple[list[dict], int, dict]:
    """S3, S4."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        document = _part(z, "word/document.xml")
        if document is None:
            raise ValueError("no word/document.xml in the file")
        core, app = _local(_part(z, "docProps/core.xml")), _local(_part(z, "docProps/app.xml"))
    blocks = list(_body(document))
    minutes = app.get("TotalTime", "")
    fingerprint = {
        "author": core.get("creator"), "last_modified_by": core.get("lastModifiedBy"), "created": core.get("created"), "modified": core.get("modified"),
        "app": app.get("Application"), "revision": core.get("revision"), "total_edit_minutes": int(minutes) if minutes.isdigit() else None,
    }
    chars = sum(len(b["text"]) for b in blocks)
    pages = int(app["Pages"]) if app.get("Pages", "").isdigit() else max(1, chars // CHARS_PER_PAGE)
    return blocks, pages, fingerprint


def cell_text(kind: str, value: str | None, shared: list[str], inline: str, date: bool) -> str:
    """Numbers without an idle fraction, dates as ISO, truth values in words, errors empty."""
    if kind == "s" and value is not None:
        return shared[int(value)].strip()
    if kind in ("inlineStr", "str"):
        return (inline or value or "").strip()
    if kind == "b":
        return "是" if value == "1" else "否"
    if kind == "e" or value in (None, ""):
        return ""
    if kind == "d":
        return value
    number = float(value)
    if date:
        when = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=number)
        return when.strftime("%Y-%m-%d" if when.time() == datetime.time() else "%Y-%m-%d %H:%M")
    return str(int(number)) if number.is_integer() else repr(number)


def _column(ref: str) -> int:
    out = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        out = out * 26 + ord(ch) - 64
    return out - 1


def _date_styles(styles: ElementTree.Element | None) -> set[int]:
    if styles is None:
        return set()
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_S}numFmt")}
    cells = styles.find(f"{_S}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
    # fixed values: built-in date formats
    return {i for i, n in enumerate(ids) if n in {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47} or re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^]]*\]', "", own.get(n, "")), re.I)}


def parse_xlsx(data: bytes) -> tuple[list[dict], int, dict]:
    """Each sheet's name is a heading, each row with text a table row; the page is the sheet's number."""
    blocks: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book, links, strings = _part(z, "xl/workbook.xml"), _part(z, "xl/_rels/workbook.xml.rels"), _part(z, "xl/sharedStrings.xml")
        if book is None or links is None:
            raise ValueError("no workbook in the file")
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in strings] if strings is not None else []
        dates = _date_styles(_part(z, "xl/styles.xml"))
        targets = {r.get("Id"): r.get("Target") for r in links}
        sheets = list(book.iter(f"{_S}sheet"))
        for page, sheet in enumerate(sheets, 1):
            target = targets.get(sheet.get(f"{_R}id"), "")
            root = _part(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            if root is None or root.find(f"{_S}sheetData") is None:
                continue
            blocks.append(block(sheet.get("name", ""), 1, page))
            for row in root.iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for c in row.findall(f"{_S}c"):
                    inline = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    cells[_column(c.get("r", "")) if c.get("r") else len(cells)] = cell_text(
                        c.get("t", "n"), getattr(c.find(f"{_S}v"), "text", None), shared, inline, int(c.get("s", -1)) in dates
                    )
                filled = [k for k, v in cells.items() if v]
                if filled:
                    blocks.append(block(" | ".join(cells.get(i, "") for i in range(max(filled) + 1)), page=page, row=True))
    if not any(b["text"].strip() for b in blocks):
        raise ValueError("no data in the workbook")
    return blocks, max(1, len(sheets)), {}


def parse_pdf(data: bytes) -> tuple[list[dict], int, dict]:
    """A block per page with text."""
    texts, fingerprint = pdf.page_texts(data)
    return [block(t, page=i) for i, t in enumerate(texts, 1) if t], max(1, len(texts)), fingerprint


def _is_page_number(line: str) -> bool:
    return len(line) <= 12 and re.fullmatch(r"[0-9\-–—/. \t第页共()]*[0-9][0-9\-–—/. \t第页共()]*", line) is not None


def strip_header_footer(blocks: list[dict]) -> list[dict]:
    """From paged blocks, lines at an edge that most pages share, and page numbers near an edge."""
    paged = [b for b in blocks if b["page"] is not None and not b["is_table_row"]]
    if len(paged) < 3:
        return blocks
    filled = [[i for i, line in enumerate(b["text"].splitlines()) if line.strip()] for b in paged]

    def repeated(edge: int) -> set[str]:
        seen = Counter(b["text"].splitlines()[at[edge]].strip() for b, at in zip(paged, filled, strict=True) if at)
        need = max(3, -(-len(paged) * 3 // 5))
        return {line for line, n in seen.items() if n >= need and 2 <= len(line) <= 60}

    heads, feet = repeated(0), repeated(-1)
    kept = {}
    for b, at in zip(paged, filled, strict=True):
        lines = b["text"].splitlines()
        near = set(at[:2] + at[-2:])
        gone = {i for i in near if _is_page_number(lines[i].strip())}
        gone |= {i for i in at[:1] if lines[i].strip() in heads} | {i for i in at[-1:] if lines[i].strip() in feet}
        kept[id(b)] = "\n".join(line for i, line in enumerate(lines) if i not in gone)
    return [b | {"text": kept.get(id(b), b["text"])} for b in blocks]


def parse_file(extension: str, data: bytes, options: ParserConfig | None = None) -> dict:
    """Blocks, pages, char_count, method and fingerprint of one file, or its error."""
    options, ext = options or ParserConfig(), extension.lower().lstrip(".")
    readers = {"txt": parse_text, "md": parse_text, "docx": parse_docx, "xlsx": parse_xlsx, "pdf": parse_pdf, **EXTRACTORS}
    out = {"status": "failed", "parse_error": None, "parse_method": None, "pages": None, "char_count": None, "blocks": [], "fingerprint": None}
    if ext not in readers:
        hint = "convert it to docx or xlsx first" if ext in LEGACY else "no reader for this format"
        return out | {"parse_error": f"unsupported: {ext}: {hint}"}
    try:
        blocks, pages, fingerprint = readers[ext](data)
    except Exception as e:  # noqa: BLE001  any damage in a file is that file's failure
        return out | {"parse_error": f"{type(e).__name__}: {e}"}
    if options.remove_header_footer:
        blocks = strip_header_footer(blocks)
    names = [f.split()[0] for f in FINGERPRINT.split(", ")]
    return out | {
        "status": "parsed", "parse_method": "text" if ext in ("txt", "md") else ext, "pages": pages, "char_count": sum(len(b["text"]) for b in blocks),
        "blocks": [{"block_idx": i, **b} for i, b in enumerate(blocks)], "fingerprint": {k: fingerprint.get(k) for k in names},
    }


def _fields(ddl: str) -> str:
    return ",".join(f.strip().replace(" ", ":", 1) for f in ddl.split(","))


PARSED = f"path string, file_hash string, status string, parse_error string, parse_method string, pages int, char_count long, blocks array<struct<{_fields(BLOCKS)}>>, fingerprint struct<{_fields(FINGERPRINT)}>"


def parse_files(files: DataFrame, options: ParserConfig | None = None) -> DataFrame:
    """``files(path, file_hash, extension, content)`` to one parsed or failed row each."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"path": p, "file_hash": h, **parse_file(e, bytes(c), options)} for p, h, e, c in zip(pdf["path"], pdf["file_hash"], pdf["extension"], pdf["content"], strict=True)]
            out = pd.DataFrame(rows)
            out["pages"], out["char_count"] = pd.array(out["pages"], dtype="Int32"), pd.array(out["char_count"], dtype="Int64")
            yield out

    return files.select("path", "file_hash", "extension", "content").mapInPandas(of, PARSED)


def read_files(spark, paths: list[str] | str) -> DataFrame:  # noqa: ANN001
    """Path, extension, content and SHA-256 of files, wherever Spark can read."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select("path", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("extension"), "length", "content", F.sha2("content", 256).alias("file_hash"))


def parse_meta(parsed: DataFrame) -> DataFrame:
    """S9."""
    return parsed.select("path", "pages", "char_count")
