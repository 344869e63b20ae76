"""Parsers of file formats into a uniform record, with the standard library only.

Every parser takes the bytes of a file and gives text, metadata (strings) and tables (columns, rows).
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from textquarry.sources.html import read_html

MOST_ENTRIES, MOST_RATIO, MOST_BYTES = 10_000, 100, 500_000_000

# First bytes of formats.
MAGIC = ((b"%PDF", "pdf"), (b"\x89PNG", "image"), (b"\xff\xd8\xff", "image"), (b"GIF8", "image"), (b"II*\x00", "image"), (b"MM\x00*", "image"), (b"\xd0\xcf\x11\xe0", "ole"), (b"PK\x03\x04", "zip"))
EXTENSIONS = {
    "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown",
    "txt": "text", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "epub": "epub", "xml": "text", "pdf": "pdf",
    "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "tif": "image", "tiff": "image",
    "mp3": "audio", "wav": "audio", "m4a": "audio", "mp4": "video", "mov": "video",
}


class ReadError(ValueError):
    """A file that can't be read; the code tells why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def sniff(data: bytes) -> str | None:
    """Format by the first bytes; zip archives by their members."""
    kind = next((k for magic, k in MAGIC if data.startswith(magic)), None)
    if kind == "zip":
        try:
            names = zipfile.ZipFile(io.BytesIO(data)).namelist()
        except zipfile.BadZipFile:
            return None
        for part, name in (("word/", "docx"), ("ppt/", "pptx"), ("xl/", "xlsx"), ("META-INF/container.xml", "epub")):
            if any(n.startswith(part) for n in names):
                return name
    if kind is None and re.match(rb"\s*(?:<!doctype html|<html)", data[:512], re.I):
        return "html"
    return kind


def source_type(path: str, data: bytes) -> str:
    """Format of a file by extension, else by content; raises where the two disagree."""
    by_name = EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if "." in path.rsplit("/", 1)[-1] else None
    by_content = sniff(data)
    if by_name is None and by_content is None:
        raise ReadError("E001", "unknown format")
    binary = {"pdf", "docx", "pptx", "xlsx", "epub", "image"}
    if by_name in binary and by_content != by_name or by_content in binary and by_name not in (None, by_content):
        raise ReadError("E002", f"named {by_name}, but holds {by_content}")
    return by_name or by_content or "text"


def check_archive(data: bytes) -> zipfile.ZipFile:
    """The archive, unless it has too many entries or unpacks to too much."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ReadError("E003", "broken archive") from e
    infos = archive.infolist()
    if len(infos) > MOST_ENTRIES:
        raise ReadError("E004", "too many entries")
    if sum(i.file_size for i in infos) > MOST_RATIO * max(1, sum(i.compress_size for i in infos)):
        raise ReadError("E004", "unpacks to too much")
    return archive


def decode(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _record(text: str, metadata: dict | None = None, tables: list[dict] | None = None) -> dict:
    return {"text": text.replace("\x00", ""), "metadata": {k: str(v) for k, v in (metadata or {}).items()}, "tables": tables or []}


def read_csv(data: bytes) -> dict:
    if not data.strip():
        raise ReadError("E003", "empty file")
    text = decode(data)
    rows = list(csv.reader(io.StringIO(text), delimiter="\t" if "\t" in text.split("\n", 1)[0] and "," not in text.split("\n", 1)[0] else ","))
    full = any(c for r in rows[1:] for c in r)
    width = max((len(r) for r in rows), default=0)
    table = [{"columns": rows[0], "rows": rows[1:]}] if full else []
    return _record("\n".join(" ".join(r) for r in rows), {"row_count": len(rows), "column_count": width}, table)


def read_json(data: bytes) -> dict:
    text = decode(data)
    try:
        value = json.loads(text)
    except ValueError:
        try:
            value = [json.loads(x) for x in text.splitlines() if x.strip()]
        except ValueError as e:
            raise ReadError("E003", "no JSON") from e
    meta: dict = {"type": type(value).__name__}
    tables = []
    if isinstance(value, dict):
        meta["keys"] = ",".join(map(str, value))
    if isinstance(value, list):
        meta["length"] = len(value)
        if value and all(isinstance(x, dict) for x in value):
            keys = list(value[0])
            tables = [{"columns": list(map(str, keys)), "rows": [[str(x.get(k, "")) for k in keys] for x in value]}]
    return _record(json.dumps(value, indent=2, ensure_ascii=False), meta, tables)


def read_page(data: bytes) -> dict:
    page = read_html(decode(data))
    return _record(page["text"], {"title": page["title"], **({"lang": page["lang"]} if page["lang"] else {}), **page["meta"]}, page["tables"])


def read_markdown(data: bytes) -> dict:
    """Front matter to metadata; fences, rules and emphasis removed, headings kept, pipe tables taken out as tables."""
    text = re.sub(r"\r\n?", "\n", decode(data))
    meta = {}
    front = re.match(r"---\n(.*?)\n---(?:\n|$)", text, re.S)
    if front:
        text = text[front.end() :]
        meta = {k.strip(): v.strip() for k, v in (x.split(":", 1) for x in front.group(1).split("\n") if ":" in x)}
    out, tables, pipe, fenced = [], [], [], False

    def close() -> None:
        cells = [[c.strip() for c in r.strip().strip("|").split("|")] for r in pipe]
        rule = len(cells) > 1 and all(re.fullmatch(r":?-+:?", c) for c in cells[1])
        if len(cells) >= 2:
            head = cells[0] if rule else [f"Column {i + 1}" for i in range(len(cells[0]))]
            tables.append({"columns": head, "rows": cells[2:] if rule else cells})
        pipe.clear()

    for line in text.split("\n"):
        if line.startswith("```"):
            fenced = not fenced
            continue
        if not fenced and line.lstrip().startswith("|"):
            pipe.append(line)
            continue
        if pipe:
            close()
        if not fenced:
            if re.fullmatch(r"\s*(?:-{3,}|\*{3,}|_{3,})\s*", line):
                continue
            line = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"[image: \1]", line)
            line = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", line)
            line = re.sub(r"(\*\*|__)(.+?)\1", r"\2", line)
            line = re.sub(r"(?<!\w)[*_]([^*_\n]+)[*_](?!\w)", r"\1", line)
            line = re.sub(r"^\s*[-*+]\s+", "", line)
        out.append(line)
    if pipe:
        close()
    return _record(re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip(), meta, tables)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(archive.read(name))
    except (KeyError, ElementTree.ParseError) as e:
        raise ReadError("E003", f"{name} can't be read") from e


def _said(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _core(archive: zipfile.ZipFile) -> dict[str, str]:
    if "docProps/core.xml" not in archive.namelist():
        return {}
    return {_local(x.tag): x.text for x in _xml(archive, "docProps/core.xml") if x.text}


def _matrix(table: ElementTree.Element) -> list[list[str]]:
    return [[" ".join(_said(c).split()) for c in row if _local(c.tag) == "tc"] for row in table.iter() if _local(row.tag) == "tr"]


def read_docx(data: bytes) -> dict:
    archive = check_archive(data)
    body = next(iter(_xml(archive, "word/document.xml")))
    paragraphs = [s for s in (_said(p).strip() for p in body if _local(p.tag) == "p") if s]
    grids = [g for g in (_matrix(t) for t in body if _local(t.tag) == "tbl") if g]
    return _record("\n\n".join(paragraphs), _core(archive), [{"columns": g[0], "rows": g[1:]} for g in grids])


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[tuple[int, str]]:
    return sorted((int(m.group(1)), n) for n in archive.namelist() if (m := re.fullmatch(pattern, n)))


def read_pptx(data: bytes) -> dict:
    archive = check_archive(data)
    parts, tables = [], []
    for k, name in _numbered(archive, r"ppt/slides/slide(\d+)\.xml"):
        slide = _xml(archive, name)
        parts.append(f"--- Slide {k} ---\n" + "\n".join(s for s in (_said(p).strip() for p in slide.iter() if _local(p.tag) == "p") if s))
        tables += [{"columns": g[0], "rows": g[1:]} for g in (_matrix(t) for t in slide.iter() if _local(t.tag) == "tbl") if g]
    return _record("\n\n".join(parts), {**_core(archive), "slide_count": len(parts)}, tables)


def read_xlsx(data: bytes) -> dict:
    archive = check_archive(data)
    shared = [_said(s) for s in _xml(archive, "xl/sharedStrings.xml") if _local(s.tag) == "si"] if "xl/sharedStrings.xml" in archive.namelist() else []
    names = [s.get("name", "") for s in _xml(archive, "xl/workbook.xml").iter() if _local(s.tag) == "sheet"]
    parts, tables = [], []
    for i, (_, part) in enumerate(_numbered(archive, r"xl/worksheets/sheet(\d+)\.xml")):
        rows = []
        for row in (r for r in _xml(archive, part).iter() if _local(r.tag) == "row"):
            cells: dict[int, str] = {}
            for cell in (c for c in row if _local(c.tag) == "c"):
                letters = re.match(r"[A-Z]+", cell.get("r", "")) or re.match("", "")
                at = 0
                for ch in letters.group(0):
                    at = at * 26 + ord(ch) - 64
                raw = next((v.text or "" for v in cell if _local(v.tag) == "v"), "")
                index = at - 1 if at else len(cells)
                cells[index] = shared[int(raw)] if cell.get("t") == "s" and raw.isdigit() and int(raw) < len(shared) else _said(cell) if cell.get("t") == "inlineStr" else raw
            rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
        name = names[i] if i < len(names) else f"Sheet{i + 1}"
        parts.append(f"--- Sheet: {name} ---\n" + "\n".join("\t".join(r) for r in rows))
        if rows:
            tables.append({"columns": rows[0], "rows": rows[1:]})
    return _record("\n\n".join(parts), {"sheet_count": len(parts), "sheet_names": ",".join(names)}, tables)


def read_epub(data: bytes) -> dict:
    archive = check_archive(data)
    package = next((n for n in archive.namelist() if n.endswith(".opf")), None)
    meta, order = {}, [n for n in sorted(archive.namelist()) if n.endswith((".xhtml", ".html", ".htm"))]
    if package:
        root = _xml(archive, package)
        meta = {_local(x.tag): x.text for x in root.iter() if "purl.org/dc" in x.tag and x.text}
        items = {x.get("id"): x.get("href") for x in root.iter() if _local(x.tag) == "item"}
        base = package.rsplit("/", 1)[0] + "/" if "/" in package else ""
        spine = [base + items[x.get("idref")] for x in root.iter() if _local(x.tag) == "itemref" and items.get(x.get("idref"))]
        order = [n for n in spine if n in archive.namelist()] or order
    pages = [read_html(decode(archive.read(n))) for n in order]
    return _record("\n\n".join(p["text"] for p in pages if p["text"]), meta, [t for p in pages for t in p["tables"]])


def read_text(data: bytes) -> dict:
    return _record(decode(data))


READERS: dict[str, Callable[[bytes], dict]] = {
    "csv": read_csv, "json": read_json, "html": read_page, "markdown": read_markdown, "text": read_text,
    "docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx, "epub": read_epub,
}


def register_reader(kind: str, extensions: list[str], reader: Callable[[bytes], dict]) -> None:
    """Add a format of one's own; importable code, so that executors have it too."""
    READERS[kind] = reader
    EXTENSIONS.update({e.lower().lstrip("."): kind for e in extensions})


def read_file(path: str, data: bytes | None) -> dict:
    """The record of a file; raises ReadError for what can't be read."""
    if not data:
        raise ReadError("E003", "empty file")
    if len(data) > MOST_BYTES:
        raise ReadError("E005", "file too large")
    kind = source_type(path, data)
    if kind not in READERS:
        raise ReadError("E006", f"no reader for {kind}")
    return {"source_type": kind, **READERS[kind](data)}
