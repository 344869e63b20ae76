"""HTML to text, title, metadata, tables, links and images with the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

DROPPED = frozenset({"script", "style", "nav", "footer", "header", "noscript", "template"})
BREAKS = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figure form h1 h2 h3 h4 h5 h6 hr li main ol p pre section table tbody td tfoot th thead tr ul".split()
)
ENDLESS = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Reader(HTMLParser):
    """Collects the parts of one page; elements in DROPPED give no text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title, self.lang = "", None
        self.meta: dict[str, str] = {}
        self.links: list[str] = []
        self.images: list[tuple[str, str]] = []
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self._open_tables: list[list[list[tuple[str, int, int]]]] = []
        self._cell: list[str] | None = None
        self._span = (1, 1)
        self._silent, self._in_title = 0, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in DROPPED:
            self._silent += 1
        elif tag == "html":
            self.lang = a.get("lang") or self.lang
        elif tag == "title":
            self._in_title = True
        elif tag == "meta" and (a.get("name") or a.get("property")):
            self.meta[a.get("name") or a["property"]] = a.get("content", "")
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "img":
            self.images.append((a.get("src", ""), a.get("alt", "")))
        elif tag == "table":
            self._open_tables.append([])
        elif tag == "tr" and self._open_tables:
            self._close_cell()
            self._open_tables[-1].append([])
        elif tag in ("td", "th") and self._open_tables:
            self._close_cell()
            if not self._open_tables[-1]:
                self._open_tables[-1].append([])
            self._cell = []
            number = lambda k: int(a[k]) if a.get(k, "").isdigit() and 0 < int(a[k]) <= 1000 else 1
            self._span = number("colspan"), number("rowspan")
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self._silent = max(0, self._silent - 1)
        elif tag == "title":
            self._in_title = False
        elif tag in ("td", "th", "tr"):
            self._close_cell()
        elif tag == "table" and self._open_tables:
            self._close_cell()
            self.tables.append(self._open_tables.pop())
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data
        elif not self._silent:
            self.parts.append(data)
            if self._cell is not None:
                self._cell.append(data)

    def _close_cell(self) -> None:
        if self._cell is not None and self._open_tables and self._open_tables[-1]:
            self._open_tables[-1][-1].append((" ".join("".join(self._cell).split()), *self._span))
        self._cell = None

    def finish(self) -> None:
        while self._open_tables:
            self._close_cell()
            self.tables.append(self._open_tables.pop())


def grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """A table with spanning cells repeated in every place they cover."""
    filled: dict[tuple[int, int], str] = {}
    for r, row in enumerate(rows):
        c = 0
        for text, across, down in row:
            while (r, c) in filled:
                c += 1
            for i in range(r, min(len(rows), r + down)):
                for j in range(c, c + across):
                    filled[i, j] = text
            c += across
    width = max((c for _, c in filled), default=-1) + 1
    return [[filled.get((r, c), "") for c in range(width)] for r in range(len(rows))]


def read_html(source: str) -> dict:
    """text, title, lang, meta, links, images and tables (first row as columns) of a page."""
    reader = Reader()
    reader.feed(source)
    reader.close()
    reader.finish()
    lines = [" ".join(x.split()) for x in "".join(reader.parts).split("\n")]
    tables = []
    for rows in reader.tables:
        full = [r for r in grid(rows) if r]
        if full:
            tables.append({"columns": full[0], "rows": full[1:]})
    return {
        "text": "\n".join(x for x in lines if x),
        "title": " ".join(reader.title.split()),
        "lang": reader.lang,
        "meta": reader.meta,
        "links": reader.links,
        "images": reader.images,
        "tables": tables,
    }
