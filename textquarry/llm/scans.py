"""Repairs of text from scanned pages: what to drop, join and correct, and where paragraphs begin.

Per document, running headers and footers are lines at page edges that repeat, fuzzily, on other pages
or give the document's title, and page numbers are lines at page edges whose numbers follow the pages.
Words are counted over the whole corpus; a word cut at the end of a line is joined in the form that the
corpus uses, and a word that turns into a far more frequent one by undoing usual misreadings is corrected.
"""

from __future__ import annotations

import difflib
import functools
import itertools
import json
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.transcripts import SPEECH_TYPES, latest_documents
from textquarry.session import cut_lineage, shuffle_width

SCAN_TYPES = ("pdf", "image")
# Lines from the edge of a page inwards that can be headers and footers; the first one that is none ends the search.
EDGE_LINES = 3
# A kind of misreading is undone at no more places of a word.
PLACES = 3
LIKE = 0.82
TIMES_MORE = 8
LEAST_COUNT = 4

# Signs for a word cut at the end of a line.
CUT = "-¬\xad‐‑"
ENDS = ".,;:!?()[]{}\"'“”‘’«»…"
# Fixed values: (read as, printed) pairs of letters that recognition takes for each other.
MISREADINGS = (
    ("c", "e"), ("e", "c"), ("f", "t"), ("0", "o"), ("5", "s"), ("1", "l"), ("l", "i"), ("|", "l"), ("cl", "d"), ("v", "y"), ("rn", "m"),
    ("m", "rn"), ("ii", "u"), ("b", "h"), ("6", "b"), ("9", "g"), ("m", "in"), ("vv", "w"), ("h", "li"), ("i", "l"), ("1", "i"), ("|", "i"),
    ("8", "b"), ("li", "h"), ("d", "cl"), ("u", "ii"), ("h", "b"), ("nn", "m"), ("iii", "m"), ("o", "c"), ("c", "o"),
)
LOOKALIKES = str.maketrans({"ɑ": "a", "í": "i", "ì": "i", "ı": "i", "ο": "o", "о": "o", "е": "e", "а": "a", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff"})
# What stays of letters that are read for each other; d is as cl, and runs of i and of v are one.
STROKES = ("ceo0mnuhbrli1|68vwyft5s9g", "ooooiiiiiiiiiiiivvvffssgg")
TO_DIGIT = str.maketrans({"l": "1", "i": "1", "|": "1", "o": "0", "b": "6", "s": "5", "z": "2", "g": "9", "q": "9", "í": "1"})
ROMAN = re.compile(r"^(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
HEADING = re.compile(r"^\s*\d{1,3}(?:\.\d{1,3})*[.)]\s+[^\W\d_]")


@functools.lru_cache(maxsize=200_000)
def bare(token: str) -> str:
    """A word in lower case without punctuation at its ends."""
    return token.strip(ENDS).lower()


def _roman(s: str) -> int | None:
    if not s or not ROMAN.match(s):
        return None
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in s]
    return sum(-v if v < max(values[k:]) else v for k, v in enumerate(values))


@functools.lru_cache(maxsize=200_000)
def _readings(token: str) -> frozenset[int]:
    """The numbers that a token may be: printed, misread or roman."""
    token = token.lower().strip(ENDS + "-–—[]")
    found = set()
    if re.fullmatch(r"[\dli|obszgqí]{1,6}", token) and (re.search(r"\d", token) or re.fullmatch(r"[lio|]{1,5}", token)):
        found.add(int(token.translate(TO_DIGIT)))
    if token.isascii():
        for form in (token, token.replace("l", "i"), token.replace("e", "c")):
            if (n := _roman(form)) is not None:
                found.add(n)
    return frozenset(found)


def _numbers(line: str) -> set[int]:
    return {n for t in re.split(r"\s+\|?\s*", line) for n in _readings(t)}


def _skeleton(line: str) -> str:
    """Letters of a line without its numbers."""
    return re.sub(r"[^a-z ]", "", " ".join(t for t in re.split(r"\s+\|?\s*", line.lower()) if not _readings(t)).translate(LOOKALIKES).translate(str.maketrans("015|", "olsl"))).strip()


def _ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b or abs(len(a) - len(b)) > 4:
        return 0.0
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return m.ratio() if m.real_quick_ratio() >= LIKE and m.quick_ratio() >= LIKE else 0.0


def _alike(a: str, b: str) -> bool:
    return _ratio(a, b) >= LIKE


class EdgeLines:
    """The different edge lines (skeletons) of a document, to find those alike on other pages.

    Only lines of which the letters, whatever their order, could reach the likeness are compared one by one.
    """

    def __init__(self, on: dict[str, set[int]]):
        self.lines = [s for s in on if s]
        self.pages = [on[s] for s in self.lines]
        self.sizes = np.array([len(s) for s in self.lines], np.int64)
        self.letters = self._letters(self.lines)
        self.known: dict[str, list[tuple[float, set[int]]]] = {}

    @staticmethod
    def _letters(lines: list[str]) -> np.ndarray:
        found = np.zeros((len(lines), 27), np.int32)
        for k, s in enumerate(lines):
            np.add.at(found[k], np.frombuffer(s.encode("ascii"), np.uint8) % 32 % 27, 1)
        return found

    def alike(self, skeleton: str, page: int) -> tuple[float, int]:
        """(greatest likeness with a line of another page, other pages with a line of 0.9 or more)."""
        if not skeleton:
            return 0.0, 0
        if skeleton not in self.known:
            near = np.flatnonzero(np.abs(self.sizes - len(skeleton)) <= 4)
            shared = np.minimum(self.letters[near], self._letters([skeleton])[0]).sum(axis=1)
            near = near[2 * shared >= LIKE * (self.sizes[near] + len(skeleton)) - 1e-9]
            self.known[skeleton] = [(r, self.pages[k]) for k in near.tolist() if (r := _ratio(skeleton, self.lines[k])) >= LIKE]
        others = [(r, pages) for r, pages in self.known[skeleton] if len(pages) > (page in pages)]
        close = [pages for r, pages in others if r >= 0.9]
        pages = set().union(*close) if len(close) < 9 and all(len(x) < 4 for x in close) else {-1, -2}
        return max((r for r, _ in others), default=0.0), min(2, len(pages - {page}))


class Scan:
    """Lines and pages of one document."""

    def __init__(self, text: str, metadata: dict[str, str] | None, dropped: Sequence[int] | None = None):
        """``dropped``: the lines to drop, if they are known already."""
        self.metadata = metadata or {}
        self.lines = [x.replace("\r", "") for x in text.split("\n")]
        self.page = self._pages(text)
        self.blank = [not x.strip("\f \t\xa0") for x in self.lines]
        if dropped is None:
            self.dropped = self._dropped()
        else:
            self.dropped = [False] * len(self.lines)
            for k in dropped:
                self.dropped[k] = True
        self.kept = [k for k in range(len(self.lines)) if not self.blank[k] and not self.dropped[k]]

    def _pages(self, text: str) -> list[int]:
        try:
            breaks = sorted(int(x) for x in json.loads(self.metadata.get("page_breaks") or "[]"))
        except (ValueError, TypeError):
            breaks = []
        pages, at, page = [], 0, 0
        for line in self.lines:
            if breaks:
                pages.append(bisect_right(breaks, at + (len(line) - len(line.lstrip("\f \t"))) if line.strip() else at))
            else:
                page += "\f" in line and not line.strip("\f \t")
                pages.append(page)
            at += len(line) + 1
        return pages

    def _edges(self) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
        of: dict[int, list[int]] = {}
        for k, p in enumerate(self.page):
            if not self.blank[k]:
                of.setdefault(p, []).append(k)
        return {p: ks[:EDGE_LINES] for p, ks in of.items()}, {p: ks[-EDGE_LINES:] for p, ks in of.items()}

    def _dropped(self) -> list[bool]:
        tops, bottoms = self._edges()
        gone = [False] * len(self.lines)
        title = _skeleton(self.metadata.get("title") or "")
        skeletons = {k: _skeleton(self.lines[k]) for ks in (*tops.values(), *bottoms.values()) for k in ks}
        # page numbers follow the pages: the offset that most edge lines agree on
        offsets: Counter = Counter()
        for edges in (tops, bottoms):
            for p, ks in edges.items():
                offsets.update({n - p for k in ks if len(self.lines[k].split()) <= 6 for n in _numbers(self.lines[k])})
        best = max(offsets.values(), default=0)
        usual = {o for o, n in offsets.items() if n == best and (n >= 2 or len(tops) == 1)}
        for edges, inward in ((tops, 1), (bottoms, -1)):
            on: dict[str, set[int]] = {}
            for p, ks in edges.items():
                for k in ks:
                    on.setdefault(skeletons[k], set()).add(p)
            others = EdgeLines(on)
            for p, ks in edges.items():
                for k in ks if inward > 0 else reversed(ks):
                    if not self._is_edge(k, p, skeletons[k], others, edges, title, usual, inward > 0):
                        break
                    gone[k] = True
        return gone

    def _is_edge(
        self, k: int, page: int, skeleton: str, others: EdgeLines, edges: dict[int, list[int]], title: str, usual: set[int], top: bool
    ) -> bool:
        line = self.lines[k].strip()
        words = line.split()
        numbers = _numbers(line)
        in_step = any(n - page in usual for n in numbers)
        letters = re.sub(r"\b(?:page|of|p|pp|seite|pag)\b", "", skeleton).strip()
        if not letters and numbers and len(words) <= 5:
            return in_step or bool(re.match(r"^(?:page|p\.|-|–)", line.lower())) or len(words) == 1 and not usual and line[-1] != "."
        if HEADING.match(line) or len(words) > 14:
            return False
        if title and _alike(skeleton, title):
            return True
        ended = line[-1:] in ".,;:?!" and not numbers
        if ended or not letters:
            return False
        if not (line[0].isupper() or line[0].isdigit() or in_step):
            return False
        likeness, close = others.alike(skeleton, page)
        named = len(words) <= 6 and all(not w[0].islower() for w in words if w[0].isalpha())
        if likeness >= LIKE and (in_step or named):
            return True
        if len(skeleton) >= 16 and line[0].isupper() and (likeness >= 0.95 or close >= 2):
            return True
        outer = k == (edges[page][0] if top else edges[page][-1])
        return named and sum(w[0].isalpha() for w in words) >= 2 and (in_step or line.isupper() or outer and len(edges) > 1 and len(words) <= 4)

    def cut_word(self, k: int, follows: int) -> tuple[str, str, str] | None:
        """(first part, sign, second part) of a word that goes on in the line ``follows``."""
        last = self.lines[k].split()[-1]
        if len(last) < 2 or last[-1] not in CUT or not last[-2].isalnum():
            return None
        first, rest = last.rstrip(CUT), self.lines[follows].split()[0]
        return (bare(first), last[-1], bare(rest)) if bare(first) and bare(rest) else None

    def words(self) -> tuple[Counter, set[str]]:
        """Words that stand whole in kept lines, with their counts, and the possible forms of cut ones."""
        whole: Counter = Counter()
        forms: set[str] = set()
        skip = False
        for i, k in enumerate(self.kept):
            tokens = self.lines[k].split()
            cut = self.cut_word(k, self.kept[i + 1]) if i + 1 < len(self.kept) else None
            for j, t in enumerate(tokens):
                if j == 0 and skip or j == len(tokens) - 1 and cut:
                    continue
                w = bare(t)
                if w:
                    whole[w] += 1
            if cut:
                forms.update((cut[0] + cut[2], f"{cut[0]}-{cut[2]}"))
            skip = cut is not None
        return whole, forms

    def repairs(self, counts: dict[str, int], right: dict[str, str]) -> list[tuple[int, str, str]]:
        """(line_no, repair, repaired)."""
        out = [(k + 1, "drop", "") for k in range(len(self.lines)) if self.dropped[k]]
        skip = False
        for i, k in enumerate(self.kept):
            cut = self.cut_word(k, self.kept[i + 1]) if i + 1 < len(self.kept) else None
            tokens = self.lines[k].split()
            for j, t in enumerate(tokens):
                if j == 0 and skip or j == len(tokens) - 1 and cut:
                    continue
                fixed = read_right(bare(t), right)
                if fixed:
                    out.append((k + 1, "misread", fixed))
            if cut:
                out.append((k + 1, "join", joined(*cut, counts, right)))
            skip = cut is not None
        out += [(k + 1, "para", "") for k in self.paragraphs()]
        return out

    def paragraphs(self) -> list[int]:
        """Lines that begin a paragraph or are a heading."""
        kept = self.kept
        if not kept:
            return []
        indent = {k: len(self.lines[k].expandtabs(4)) - len(self.lines[k].expandtabs(4).lstrip()) for k in kept}
        inner = sum(2 <= indent[k] <= 8 for k in kept)
        indented = inner >= 2 or inner == 1 and len(kept) <= 12
        widths = sorted(len(self.lines[k].rstrip()) for k in kept)
        width = widths[int(0.95 * (len(widths) - 1))]
        found = []
        for i, k in enumerate(kept):
            if i == 0 or HEADING.match(self.lines[k]) and self._heading(k, i, width):
                found.append(k)
                continue
            before = kept[i - 1]
            if before in found and HEADING.match(self.lines[before]):
                found.append(k)
                continue
            if indented:
                if 2 <= indent[k] <= 8:
                    found.append(k)
                continue
            last = self.lines[before].rstrip()
            finished = last[-1:] in ".!?…\"”)" and last[-1:] != ""
            if not finished:
                continue
            first = self.lines[k].split()[0]
            short = len(last) + 1 + len(first) <= width
            same_page = self.page[k] == self.page[before]
            gap = any(self.blank[j] for j in range(before + 1, k))
            around = any(self.dropped[j] for j in range(before + 1, k))
            if same_page and gap and not around:
                found.append(k)
            elif not same_page or around:
                if short and first[0].isupper() or short and first[0].isdigit():
                    found.append(k)
        return found

    def _heading(self, k: int, i: int, width: int) -> bool:
        line = self.lines[k].strip()
        return line[-1:] not in ".,;:!?" and len(line) <= 0.8 * width + 8 and len(line.split()) <= 10


@functools.lru_cache(maxsize=200_000)
def digits_right(word: str) -> str | None:
    """A number, or the number of a mark such as AB-1234, with letters read for digits put right."""
    m = re.fullmatch(r"([a-z]{2}-)?([\dli|obszgqí]+)", word)
    if not m or m.group(2).isdigit() or not re.search(r"\d", m.group(2)):
        return None
    if not m.group(1) and len(m.group(2)) < 2:
        return None
    return (m.group(1) or "") + m.group(2).translate(TO_DIGIT)


def read_right(word: str, right: dict[str, str]) -> str | None:
    fixed = right.get(word)
    return fixed or digits_right(word)


def joined(first: str, sign: str, rest: str, counts: dict[str, int], right: dict[str, str]) -> str:
    """The whole word of two parts, with or without a hyphen of its own."""
    closed, open_ = first + rest, f"{first}-{rest}"
    n_closed = max(counts.get(closed, 0), counts.get(right.get(closed, ""), 0), LEAST_COUNT if closed in right else 0)
    n_open = max(counts.get(open_, 0), counts.get(right.get(open_, ""), 0))
    if rest[:1].isdigit() and first.isalpha() and len(first) <= 3:
        keep = True
    elif n_open or n_closed:
        keep = n_open > n_closed
    else:
        keep = sign == "-" and rest[:1].isdigit()
    whole = open_ if keep else closed
    return read_right(whole, right) or whole


def undone(word: str) -> Iterator[str]:
    """Words that may have been read as ``word``, perhaps repeated: every usual misreading undone at up to PLACES places."""
    plain = word.translate(LOOKALIKES)
    if plain != word:
        yield plain
    if len(plain) < 2 or not re.search(r"[^\W\d_]", plain):
        return
    for wrong, printed in MISREADINGS:
        spots = [m.start() for m in re.finditer(f"(?={re.escape(wrong)})", plain)]
        for n in range(1, min(PLACES, len(spots)) + 1):
            for places in itertools.combinations(spots, n):
                if any(b - a < len(wrong) for a, b in itertools.pairwise(places)):
                    continue
                made, at = "", 0
                for p in places:
                    made += plain[at:p] + printed
                    at = p + len(wrong)
                yield made + plain[at:]


def candidates(word: str) -> set[str]:
    """Words that may have been read as ``word``."""
    return set(undone(word)) - {word}


def second_candidates(word: str) -> set[str]:
    """Words that may have been read as ``word`` by misreadings of two kinds."""
    once = candidates(word)
    return {c for w in once for c in undone(w)} - once - {word}


def strokes(word: Column) -> Column:
    """A form that a word shares with every word that usual misreadings make of it."""
    plain = word
    for seen, printed in LOOKALIKES.items():
        plain = F.replace(plain, F.lit(chr(seen)), F.lit(printed))
    single = F.translate(F.replace(plain, F.lit("d"), F.lit("cl")), *STROKES)
    return F.regexp_replace(F.regexp_replace(single, "i+", "i"), "v+", "v")


def kinds_of(word: str, known: list[str]) -> Iterator[tuple[str, int]]:
    """(known word, kinds of misreadings that make it ``word``, 1 or 2)."""
    once = candidates(word)
    twice: set[str] | None = None
    for k in known:
        if k in once:
            yield k, 1
            continue
        twice = second_candidates(word) if twice is None else twice
        if k in twice:
            yield k, 2


FACTS = "document_id string, dropped array<int>, words array<string>, counts array<int>, forms array<string>"


def looked_at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines to drop, the whole words with their counts, and the possible forms of cut words, of each scan."""
    for pdf in batches:
        rows = []
        for i, text, meta in zip(pdf["document_id"], pdf["text"], pdf["metadata"]):
            if text and text.strip():
                s = Scan(text, json.loads(meta) if meta else None)
                whole, forms = s.words()
                rows.append((i, [k for k, d in enumerate(s.dropped) if d], list(whole), list(whole.values()), sorted(forms)))
        yield pd.DataFrame(rows, columns=["document_id", "dropped", "words", "counts", "forms"])


def word_counts(raw: DataFrame, facts: DataFrame) -> DataFrame:
    """(word, n, scanned) over all texts: words standing whole in scans (``scanned``), and words of the documents that are no scans or speech."""

    def of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total = Counter(w for t in pdf["text"] for w in map(bare, t.split()) if w)
            yield pd.DataFrame(list(total.items()), columns=["word", "n"])

    others = raw.where(~F.col("source_type").isin(*SCAN_TYPES, *SPEECH_TYPES) & F.col("text").isNotNull()).select("text")
    scanned = facts.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").cast("bigint").alias("n"), F.lit(True).alias("scanned"))
    told = others.mapInPandas(of_texts, "word string, n bigint").withColumn("scanned", F.lit(False))
    return scanned.unionByName(told).groupBy("word").agg(F.sum("n").alias("n"), F.max("scanned").alias("scanned"))


def scan_repairs(raw: DataFrame, types: tuple[str, ...] = SCAN_TYPES) -> DataFrame:
    """(document_id, line_no, repair, repaired) for the scanned documents among raw documents.

    Null, empty and blank texts need no repair; without page_breaks a line holding only a form feed
    ends a page; unreadable metadata counts as missing; repeated rows of a document count once (the
    last taken in); extra columns are ignored; an empty table gives an empty result.
    """
    scans = latest_documents(raw, types)
    facts = cut_lineage(scans.mapInPandas(looked_at, FACTS))
    counts = cut_lineage(word_counts(raw, facts))

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for word, known, counts in zip(pdf["word"], pdf["known"], pdf["counts"]):
                times = dict(zip(known, counts))
                best = max(((-kind, times[k], k) for k, kind in kinds_of(word, list(known))), default=None)
                if best:
                    rows.append((word, best[2], best[1]))
            yield pd.DataFrame(rows, columns=["word", "right", "m"])

    telling = (F.length("word") > 1) & F.col("word").rlike(r"\p{L}")
    whole = facts.select("document_id", F.explode("words").alias("word"))
    forms = facts.select("document_id", F.explode("forms").alias("word"))
    standing = counts.where(F.col("scanned") & telling).select("word", "n")
    cut = forms.select("word").distinct().join(standing, "word", "left_anti").join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    distinct = standing.unionByName(cut)
    known = counts.where(F.col("n") >= LEAST_COUNT).select(F.col("word").alias("candidate"), F.col("n").alias("m"), strokes(F.col("word")).alias("strokes"))
    paired = (
        distinct.withColumn("strokes", strokes(F.col("word")))
        .join(known, "strokes")
        .where((F.col("candidate") != F.col("word")) & (F.col("m") >= TIMES_MORE * F.greatest("n", F.lit(1))))
        .groupBy("word")
        .agg(F.collect_list("candidate").alias("known"), F.collect_list("m").alias("counts"))
    )
    # few words by bytes, but much work: no partition is merged with another
    better = cut_lineage(paired.repartition(shuffle_width(raw.sparkSession), F.xxhash64("word")).mapInPandas(checked, "word string, right string, m bigint"))
    # whole words matter only where they are misread, so frequent words never meet their documents
    misread = distinct.join(better, "word")
    parted = distinct.join(better, "word", "left").where(F.col("right").isNotNull() | (F.col("n") > 0))
    per_document = (
        whole.join(misread, "word")
        .unionByName(forms.join(parted, "word"))
        .groupBy("document_id")
        .agg(F.collect_list(F.struct("word", "n", "right", F.coalesce("m", F.lit(0)).alias("m"))).alias("told"))
    )

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, meta, dropped, told in zip(*(pdf[c] for c in ("document_id", "text", "metadata", "dropped", "told"))):
                n, right = {}, {}
                for f in told if told is not None else ():
                    n[f["word"]] = f["n"]
                    if f["right"]:
                        right[f["word"]] = f["right"]
                        n.setdefault(f["right"], f["m"])
                rows += [(i, *r) for r in Scan(text, json.loads(meta) if meta else None, dropped).repairs(n, right)]
            yield pd.DataFrame(rows, columns=["document_id", "line_no", "repair", "repaired"])

    ready = scans.join(facts.select("document_id", "dropped"), "document_id").join(per_document, "document_id", "left")
    return ready.mapInPandas(repair, "document_id string, line_no int, repair string, repaired string")
