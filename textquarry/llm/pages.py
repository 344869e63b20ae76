"""The main body of web pages, by consensus paths of each host.

1. Every page is parsed once into blocks (text between block-level tags) with their containers; the
   parsed pages are kept in packed chunks, so that the corpus is held and moved once, compressed.
2. A sentence is site furniture if it stands on a share of its host's addresses, on a share of all
   hosts, or if it is furniture on most of the hosts that have it and that have addresses enough to tell.
3. On each page the containers are scored by the words of their own paragraphs that are no furniture and
   no link text; the page votes for the generalised tag-class path of its best container.
4. The votes are summed per host, and every page is extracted again from the container on the winning
   path, leaving out furniture, labelled sections (related stories, comments) and link bars inside.
"""

from __future__ import annotations

import functools
import html
import itertools
import marshal
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A sentence is furniture of a host from this share of its addresses, and this many, on.
HOST_SHARE, HOST_LEAST = 0.01, 3
# One is furniture everywhere if it stands on this share of all hosts, or if it is furniture on this share of
# its hosts that can tell, and on this many. In places where a host has mostly text of its own it stays.
HOSTS_SHARE, SURE_SHARE, HOSTS_LEAST = 0.1, 0.5, 3
# A place (path) is looked at only if it holds this share of the host's blocks, so that a host has at most 1 / PLACE_SHARE of them.
PLACE_SHARE = 0.0001
# A path wins on a host from this share of its votes on; the words of one page count as votes up to VOTE_WORDS.
VOTE_SHARE, VOTE_WORDS = 0.1, 100.0
CHUNK_PAGES = 512
TOLD_ROWS = 2_000_000

# HTML's block-level elements, void elements and elements without running text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td"
    " tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript title template textarea iframe svg object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that a start tag ends, and the ones beyond which it doesn't reach.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
APART = frozenset("nav aside footer form dialog menu button select".split())
NAMED = re.compile(
    r"(?:^|[^a-z])(?:comments?|disqus|replies|related|recommend\w*|sidebar|rail|menu|nav\w*|breadcrumbs?|cookies?|consent|banner|footer|"
    r"promo\w*|advert\w*|ads?|sponsor\w*|share|sharing|social|newsletter|subscribe|teasers?|popup|modal|pagination|pager)(?:[^a-z]|$)"
)
SECTION_LABEL = re.compile(r"^(?:\d+ )?(?:comments?|replies|responses|kommentare?|antworten|commentaires?|comentarios?|respuestas)(?: \d+)?$")

TOKEN = re.compile(r"<!--.*?(?:--!?>|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"\b(id|class)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[^\W_]+")
TRAIL = re.compile(r"[›»→>/|·]")
STOP = re.compile(r"[.!?]\s")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def plain(text: str) -> str:
    """Lower case, runs of other characters than letters and digits as one space."""
    return " ".join(WORDS.findall(text.lower()))


@functools.lru_cache(maxsize=100_000)
def _label(tag: str, attributes: str, index: int) -> str:
    """Generalised tag-class step of a path: all ids and classes, sorted; numbers of three or more digits are dropped."""
    names = {
        ("#" if m.group(1).lower() == "id" else ".") + value
        for m in ATTRIBUTE.finditer(attributes)
        for word in (m.group(2) or m.group(3) or m.group(4) or "").lower().split()
        if (value := re.sub(r"\d{3,}", "", word))
    }
    return tag + "".join(sorted(names)) + (f"[{index}]" if tag in ("td", "th") else "")


@functools.lru_cache(maxsize=10_000)
def _kind(tag: str) -> tuple[str, str]:
    """A tag in lower case and its kind: silent, a, br, block, apart (inline, but no part of a word) or inline."""
    tag = tag.lower()
    if tag in SILENT or tag in BLOCK:
        return tag, "silent" if tag in SILENT else "block"
    return tag, tag if tag in ("a", "br") else "apart" if tag in ("button", "option", "label") else "inline"


def parse(source: str) -> tuple[list[list], list[list]]:
    """(nodes, blocks) of a page.

    nodes: [parent, label]; blocks: [node, plain form, words, link words, links, is a trail, numbers of words
    of its sentences, hashes of its sentences]. An hr is a block without words.
    """
    nodes: list[list] = [[-1, "root"]]
    stack: list[tuple[str, int]] = [("root", 0)]
    cells: dict[int, int] = {}
    blocks: list[list] = []
    text: list[str] = []
    link: list[str] = []
    links, anchors, silent = 0, 0, None

    def close() -> None:
        low = text[0] if len(text) == 1 else "".join(text)
        text.clear()
        if "&" in low:
            low = html.unescape(low).lower()
        if STOP.search(low):
            spoken = sentences(low)
            forms = [" ".join(s) for s in spoken]
            whole, lengths = " ".join(forms), [len(s) for s in spoken]
            words = sum(lengths)
        else:
            found = WORDS.findall(low)
            words = len(found)
            whole = " ".join(found)
            forms, lengths = [whole], [words]
        if words:
            linked = "".join(link)
            n = len(WORDS.findall(html.unescape(linked) if "&" in linked else linked)) if linked else 0
            trail = int(links >= 1 and "." not in low and len(TRAIL.findall(low)) >= 2)
            blocks.append([stack[-1][1], whole, words, n, links, trail, lengths, [_hash(f) for f in forms]])

    # names of tags and characters are only looked at in lower case
    pieces = TOKEN.split(source.lower())
    for piece, slash, raw, attributes in zip(pieces[::4], pieces[1::4], pieces[2::4], pieces[3::4]):
        if piece and silent is None and (text or not piece.isspace()):
            text.append(piece)
            if anchors:
                link.append(piece)
        if raw is None:
            continue
        tag, kind = _kind(raw)
        if silent is not None:
            if slash and tag == silent:
                silent = None
            continue
        if kind == "inline":
            continue
        if kind != "block":
            if kind == "silent":
                if not slash and not attributes.rstrip().endswith("/"):
                    silent = tag
                if tag != "title" and text:
                    text.append(" ")
            elif kind == "a":
                anchors = 0 if slash else 1
                links += not slash
                if link and not slash:
                    link.append(" ")
            elif text:
                text.append(" ")
                if anchors and kind == "br":
                    link.append(" ")
            continue
        if text:
            close()
        if link:
            link.clear()
        links = 0
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if tag == "hr":
            if stack[-1][0] == "p":
                stack.pop()
            blocks.append([stack[-1][1], "", 0, 0, 0, 0, [], []])
            continue
        if stack[-1][0] == "p" or stack[-1][0] in HEADINGS and tag in HEADINGS:
            stack.pop()
        if tag in ENDS:
            ended, limits = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in limits and not (tag == "td" and stack[k][0] == "td"):
                    break
                if stack[k][0] in ended:
                    del stack[k:]
                    if tag != "tr":
                        break
                    continue
        if tag in ("html", "head") or tag == "body" and any(t == "body" for t, _ in stack):
            continue
        parent = stack[-1][1]
        index = 0
        if tag in ("td", "th"):
            index = cells.get(parent, 0)
            cells[parent] = index + 1
        nodes.append([parent, _label(tag, attributes, index)])
        stack.append((tag, len(nodes) - 1))
    if silent is None and (text or not pieces[-1].isspace()):
        text.append(pieces[-1])
        if anchors:
            link.append(pieces[-1])
    if text:
        close()
    return nodes, blocks


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence of a text in lower case that has any."""
    return [w for w in map(WORDS.findall, SENTENCE.split(text)) if w]


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


@functools.lru_cache(maxsize=100_000)
def _tag(label: str) -> str:
    return re.match(r"[a-z0-9:-]*", label).group(0)


@functools.lru_cache(maxsize=100_000)
def _set_apart(label: str) -> bool:
    """Whether an element is by its tag or name no place for main body."""
    return _tag(label) in APART or bool(NAMED.search(label[len(_tag(label)) :]))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower().removeprefix("www.")
    except ValueError:
        return ""


class Page:
    """A parsed page with what is known about its sentences."""

    def __init__(self, nodes: list[list], blocks: list[list], known: set[int] | frozenset[int], on_host: set[int] | frozenset[int] | None = None):
        self.nodes, self.blocks, self.on_host = nodes, blocks, known if on_host is None else on_host
        self.paths: list[str] = []
        self.apart: list[bool] = []
        for parent, label in nodes:
            self.paths.append(f"{self.paths[parent]}/{label}" if parent >= 0 else "")
            self.apart.append(parent >= 0 and (self.apart[parent] or _set_apart(label)))
        self.furniture = [self._furniture(b, known) for b in blocks]

    def _furniture(self, block: list, known: set[int] | frozenset[int]) -> bool:
        node, _, words, link_words, links, trail, lengths, hashes = block
        if not words:
            return False
        if 2 * sum(n for h, n in zip(hashes, lengths) if h in known) >= words or trail and _tag(self.nodes[node][1]) not in ("td", "pre"):
            return True
        return links >= 3 and link_words >= 0.8 * words and _tag(self.nodes[node][1]) not in ("li", "td", "th")

    def scores(self) -> dict[int, float]:
        """Own words of each container: its paragraphs count fully, its children's by half."""
        found: dict[int, float] = {}
        for (node, _, words, link_words, *_), furniture in zip(self.blocks, self.furniture):
            parent = max(self.nodes[node][0], 0)
            if furniture or words == 0 or 2 * link_words >= words or self.apart[node]:
                continue
            inline = _tag(self.nodes[node][1]) in ("td", "th", "body")
            good = (words - link_words) * (1.0 if words >= 5 else 0.2)
            holder = node if inline else parent
            found[holder] = found.get(holder, 0.0) + good
            above = self.nodes[holder][0]
            if above > 0:
                found[above] = found.get(above, 0.0) + good / 2
        return found

    def _up(self, node: int) -> Iterator[int]:
        while node > 0:
            yield node
            node = self.nodes[node][0]

    def path_counts(self) -> dict[str, tuple[int, int]]:
        """(furniture, blocks) on each path."""
        found: dict[str, tuple[int, int]] = {}
        for (node, text, *_), furniture in zip(self.blocks, self.furniture):
            if text:
                f, n = found.get(self.paths[node], (0, 0))
                found[self.paths[node]] = (f + furniture, n + 1)
        return found

    def main_blocks(self, root: int, mixed: frozenset[str] = frozenset()) -> list[str]:
        """Plain forms of the blocks of main body under the container ``root``.

        What is known only from other hosts stays if it stands on a ``mixed`` path, on which the host
        mostly has text of its own. A page without one paragraph of its own has no main body.
        """
        inside: dict[int, list[int]] = {}
        mine = []
        for k, (node, *_rest) in enumerate(self.blocks):
            above = []
            for n in (*self._up(node), 0):
                if n == root:
                    mine.append(k)
                    for a in above:
                        inside.setdefault(a, []).append(k)
                    break
                above.append(n)
        out_nodes = set()
        for n, ks in inside.items():
            spoken = [k for k in ks if self.blocks[k][1]]
            if _set_apart(self.nodes[n][1]):
                out_nodes.add(n)
            elif spoken and n != self.blocks[spoken[0]][0] or len(spoken) > 1:
                first = spoken[0] if spoken else None
                bad = sum(self.furniture[k] for k in spoken)
                label = first is not None and (self.furniture[first] or bool(SECTION_LABEL.match(self.blocks[first][1])))
                short = first is not None and self.blocks[first][2] <= 6
                if len(spoken) > 1 and (label and short or 5 * bad >= 3 * len(spoken)):
                    out_nodes.add(n)
        result, section, own = [], False, 0
        for k in mine:
            node, text, *_ = self.blocks[k]
            if not text:
                section = False
                continue
            heading = _tag(self.nodes[node][1]) in HEADINGS
            if any(n in out_nodes for n in self._up(node)):
                continue
            rescued = self.furniture[k] and self.paths[node] in mixed and not heading and not self._furniture(self.blocks[k], self.on_host)
            if self.furniture[k] and not rescued or heading and SECTION_LABEL.match(text):
                section = section or heading
                continue
            if heading:
                section = False
            if not section:
                result.append(text)
                own += not rescued and self.blocks[k][2] >= 3 and 2 * self.blocks[k][3] < self.blocks[k][2]
        return result if own else []


def _vote(page: Page) -> tuple[str, float] | None:
    scores = page.scores()
    if not scores:
        return None
    node = max(scores, key=lambda n: (scores[n], -n))
    return page.paths[node], min(scores[node], VOTE_WORDS)


def _choose(page: Page, winners: dict[str, float]) -> int | None:
    """The container to extract; None if the headline in its place is furniture (a message, not a page)."""
    scores = page.scores()
    headlines = [k for k, b in enumerate(page.blocks) if _tag(page.nodes[b[0]][1]) == "h1"]
    if headlines and all(page.furniture[k] for k in headlines):
        if any(page.paths[page.nodes[page.blocks[k][0]][0]] in winners for k in headlines):
            return None
    on_path = [(winners[p] * (1.0 + scores.get(n, 0.0)), -n) for n, p in enumerate(page.paths) if p in winners]
    if on_path:
        return -max(on_path)[1]
    return max(scores, key=lambda n: (scores[n], -n)) if scores else None


def pack(pages: Iterable[tuple[list[list], list[list]]]) -> tuple[bytes, list[int], list[int]]:
    """(compressed pages, hashes of their sentences, number of sentences of each page)."""
    import zstandard

    hashes: list[int] = []
    ends: list[int] = []
    bare = []
    for nodes, blocks in pages:
        own = [h for b in blocks for h in b[7]]
        hashes += own
        ends.append(len(own))
        bare.append(marshal.dumps((nodes, [b[:7] for b in blocks])))
    sizes = np.array([len(bare), *map(len, bare)], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(bare)), hashes, ends


def unpack(packed: bytes, hashes: bytes) -> Iterator[tuple[list[list], list[list]]]:
    """The (nodes, blocks) that ``pack`` was given."""
    import zstandard

    data = memoryview(zstandard.ZstdDecompressor().decompress(packed))
    n = int.from_bytes(data[:4], "little")
    starts = 4 + 4 * n + np.r_[0, np.cumsum(np.frombuffer(data[4 : 4 + 4 * n], np.uint32))]
    told, at = np.frombuffer(hashes, np.int64).tolist(), 0
    for start, end in itertools.pairwise(starts.tolist()):
        nodes, blocks = marshal.loads(data[start:end])
        for b in blocks:
            b.append(told[at : at + len(b[6])])
            at += len(b[6])
        yield nodes, blocks


def parsed_pages(crawl: DataFrame) -> DataFrame:
    """(chunk, ids, hosts, addresses, ends, sentences, packed): chunks of parsed pages; of repeated rows the last taken in.

    Hosts, addresses and sentences are hashes; an address that is null is the page itself.
    """
    rows = crawl.where(F.col("page_id").isNotNull()).select("page_id", F.struct("ingested_at", "fetched_at", "url", "html").alias("v"))
    last = rows.groupBy("page_id").agg(F.max("v").alias("v")).select("page_id", "v.url", "v.html").where(F.length(F.trim("html")) > 0)
    id_type = last.schema["page_id"].dataType.simpleString()
    names = ["ids", "hosts", "addresses", "ends", "sentences", "packed"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK_PAGES):
                part = pdf.iloc[at : at + CHUNK_PAGES]
                rows: list[tuple] = []

                def parsed(part: pd.DataFrame, rows: list[tuple]) -> Iterator[tuple[list[list], list[list]]]:
                    for i, url, source in zip(part["page_id"], part["url"], part["html"]):
                        nodes, blocks = parse(source)
                        if blocks:
                            rows.append((i, _hash(host_of(url)), _hash(f"page {i}" if url is None else url)))
                            yield nodes, blocks

                packed, hashes, ends = pack(parsed(part, rows))
                if rows:
                    yield pd.DataFrame([(*map(list, zip(*rows)), ends, np.array(hashes, np.int64).tobytes(), packed)], columns=names)

    chunks = last.mapInPandas(read, f"ids array<{id_type}>, hosts array<bigint>, addresses array<bigint>, ends array<int>, sentences binary, packed binary")
    return chunks.withColumn("chunk", F.monotonically_increasing_id())


def furniture_of(pages: DataFrame) -> DataFrame:
    """(host, own, others): the hashes of each host's sentences that are furniture by its own addresses, or by other hosts only.

    The own ones are at most the mean number of sentences of a page / HOST_SHARE.
    """
    from textquarry.session import cut_lineage

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for hosts, addresses, ends, sentences in zip(*(b.column(k).to_pylist() for k in range(4))):
                columns = [np.repeat(np.array(x, np.int64), ends) for x in (hosts, addresses)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(np.frombuffer(sentences, np.int64)), pa.array(columns[1])], ["host", "h", "address"])

    stands = pages.select("hosts", "addresses", "ends", "sentences").mapInArrow(each, "host bigint, h bigint, address bigint")
    placed = pages.select(F.explode(F.arrays_zip("hosts", "addresses")).alias("x")).select(F.col("x.hosts").alias("host"), F.col("x.addresses").alias("address"))
    sizes = placed.distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    on_host = stands.distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).join(sizes, "host")
    least = F.greatest(F.lit(HOST_LEAST), F.col("size") * HOST_SHARE)
    on_host = cut_lineage(on_host.select("host", "h", (F.col("n") >= least).alias("own"), (F.col("size") > HOST_LEAST).alias("tells")))
    hosts = sizes.agg(F.count(F.lit(1)).alias("all"))
    stand = on_host.groupBy("h").agg(F.count(F.lit(1)).alias("hosts"), F.sum(F.col("own").cast("int")).alias("sure"), F.sum(F.col("tells").cast("int")).alias("tell"))
    wide = (F.col("hosts") >= HOSTS_SHARE * F.col("all")) | (F.col("sure") >= HOSTS_LEAST) & (F.col("sure") >= SURE_SHARE * F.col("tell"))
    common = stand.where(F.col("hosts") >= HOSTS_LEAST).join(F.broadcast(hosts)).where(wide).select("h", F.lit(True).alias("common"))
    known = on_host.join(common, "h", "left").where(F.col("own") | F.col("common"))
    return known.groupBy("host").agg(F.collect_list(F.when(F.col("own"), F.col("h"))).alias("own"), F.collect_list(F.when(~F.col("own"), F.col("h"))).alias("others"))


def with_hosts(pages: DataFrame, per_host: DataFrame, most_rows: int) -> tuple[DataFrame, Callable[[Any], dict]]:
    """(pages, look): ``look`` of a row's ``told`` is the dictionary from its hosts to what ``per_host`` (host, arrays) tells.

    What is told of hosts is sent to all executors if its arrays have at most ``most_rows`` elements,
    else each chunk is joined with that of its own hosts.
    """
    arrays = [c for c in per_host.columns if c != "host"]
    size = sum((F.greatest(F.size(c), F.lit(0)) for c in arrays), F.lit(1))
    if (per_host.agg(F.sum(size)).first()[0] or 0) <= most_rows:
        packed = {r["host"]: {c: np.array(r[c], np.int64) if c in ("own", "others") and r[c] else r[c] or () for c in arrays} for r in per_host.toLocalIterator()}
        sent = pages.sparkSession.sparkContext.broadcast(packed)
        return pages.withColumn("told", F.lit(0)), lambda told: sent.value
    of_chunk = pages.select("chunk", F.explode(F.array_distinct("hosts")).alias("host")).join(per_host, "host")
    told = of_chunk.groupBy("chunk").agg(F.collect_list(F.struct("host", *arrays)).alias("told"))
    return pages.join(told, "chunk", "left"), lambda told: {t["host"]: {c: t[c] if t[c] is not None else () for c in arrays} for t in told} if told is not None else {}


def main_body(crawl: DataFrame, most_told: int = TOLD_ROWS) -> DataFrame:
    """(page_id, block): the plain form of each block of main body.

    Null, empty and blank html have no blocks, nor have pages of which all is furniture (errors,
    redirects); repeated rows of a page_id count once; the status code is not asked; null urls form one
    host; extra columns are ignored; an empty table gives an empty result. ``most_told`` bounds what is
    sent of the hosts to every executor; beyond it chunks of pages are joined with their hosts.
    """
    from textquarry.session import cut_lineage

    pages = cut_lineage(parsed_pages(crawl))
    id_type = pages.schema["ids"].dataType.elementType.simpleString()
    known = cut_lineage(furniture_of(pages))

    def each(pdf: pd.DataFrame, of: Callable[[Any], dict]) -> Iterator[tuple[int, dict, Page]]:
        """(host, what is told of the host, page)."""
        nothing: dict = {}
        sets: dict[int, tuple[frozenset[int], frozenset[int]]] = {}
        for hosts, sentences, packed, told in zip(pdf["hosts"], pdf["sentences"], pdf["packed"], pdf["told"]):
            hosts_told = of(told)
            for host, (nodes, blocks) in zip(hosts.tolist(), unpack(packed, sentences)):
                info = hosts_told.get(host, nothing)
                if host not in sets:
                    own, others = (frozenset(np.asarray(info.get(c, ()), np.int64).tolist()) for c in ("own", "others"))
                    sets[host] = (own | others, own)
                yield host, info, Page(nodes, blocks, *sets[host])

    to_vote, known_of = with_hosts(pages.select("chunk", "hosts", "sentences", "packed"), known, most_told)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[tuple[int, str], list[float]] = {}
            for host, _, page in each(pdf, known_of):
                if won := _vote(page):
                    found.setdefault((host, won[0]), [0.0, 0, 0])[0] += won[1]
                for path, (furniture, n) in page.path_counts().items():
                    counts = found.setdefault((host, path), [0.0, 0, 0])
                    counts[1] += furniture
                    counts[2] += n
            yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["host", "path", "score", "furniture", "blocks"])

    sums = [F.sum(c).alias(c) for c in ("score", "furniture", "blocks")]
    votes = to_vote.mapInPandas(vote, "host bigint, path string, score double, furniture bigint, blocks bigint").groupBy("host", "path").agg(*sums)
    votes = cut_lineage(votes)
    total = votes.groupBy("host").agg(F.sum("score").alias("total"), F.sum("blocks").alias("all_blocks"))
    won = (F.col("score") > 0) & (F.col("score") >= VOTE_SHARE * F.col("total"))
    mixed = (F.col("furniture") > 0) & (2 * F.col("furniture") < F.col("blocks")) & (F.col("blocks") >= PLACE_SHARE * F.col("all_blocks"))
    winners = (
        votes.join(total, "host")
        .where(won | mixed)
        .groupBy("host")
        .agg(
            F.collect_list(F.when(won, F.struct("path", (F.col("score") / F.col("total")).alias("share")))).alias("winners"),
            F.collect_list(F.when(mixed, F.col("path"))).alias("mixed"),
        )
    )
    to_read, told_of = with_hosts(pages.select("chunk", "ids", "hosts", "sentences", "packed"), cut_lineage(known.join(winners, "host", "full_outer")), most_told)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [i for x in pdf["ids"] for i in x.tolist()]
            rows = []
            for i, (_, info, page) in zip(ids, each(pdf, told_of)):
                node = _choose(page, {w["path"]: w["share"] for w in info.get("winners", ())})
                if node is not None:
                    rows += [(i, b) for b in dict.fromkeys(page.main_blocks(node, frozenset(info.get("mixed", ()))))]
            yield pd.DataFrame(rows, columns=["page_id", "block"])

    return to_read.mapInPandas(extract, f"page_id {id_type}, block string")
