"""Evaluation passages inside training texts, by spaced-seed hashing.

Fixed masks pick word positions of a window and ignore others, so that a window still matches when an
ignored word was changed. The hashes of all windows of the passages are joined with those of the windows
of every training text. Around each hit both sides are compared word by word on the hit's diagonal, over
changed words, and the stretches found are chained in order; a passage counts as leaked if the chained
words make up at least half of it and are not only the words that most passages share.

The passages are a stated query set. While they have at most MOST_INDEX_WORDS words their hashes are sent to
the executors, which look up the windows of their texts; a larger set is joined with the texts' windows as
tables, hash with hash, and the pairs met are verified in the same way.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")

# The masks (1 counts, 0 is ignored), for passages from LONG_PASSAGE words and for shorter ones.
# The first three match where every third, or every fourth or a later word, or a few words were changed.
LONG_MASKS = ("11011011", "1110111", "111111", "110010111", "1101000111", "1010110011")
SHORT_MASKS = ("1111", "11011")
LONG_PASSAGE = 48
SHARE = 0.5
MOST_INDEX_WORDS = 400_000
MOST_HITS = 1_000_000
# Stretches are chained if at most SHIFT words more or fewer stand between them in the text; of solid ones, that
# hold SOLID_WORDS equal words and SOLID_SHARE of their own, up to as many as the passage has.
SHIFT = 12
SOLID_WORDS, SOLID_SHARE = 16, 0.8
DROP = 6
# A word is common if more than this share of the passages has it. Of the others at least half as large a share
# must be among the words found as of all, else only the frame of usual sentences is shared.
COMMON_SHARE = 0.1
# Windows of passages are looked for if they pick SEED_RARE words that are not common, or if fewer than RARE_SHARE of
# the passage's words are rare.
SEED_RARE, RARE_SHARE = 1, 0.1
PAD = 16


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return WORD.findall(text.lower()) if text else []


@dataclass
class SeedIndex:
    """Windows of a block of passages. Words are numbered from 1; 0 is any other word."""

    vocabulary: dict[str, int]
    items: np.ndarray
    passages: list[np.ndarray]
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    rare: list[np.ndarray]

    def __post_init__(self) -> None:
        self.lengths = np.array([len(x) for x in self.passages], np.int64)
        self.flat = np.concatenate([*self.passages, np.zeros(0, np.int64)])
        self.begin = np.r_[0, np.cumsum(self.lengths)]


def _multipliers(n: int, salt: int) -> np.ndarray:
    return np.random.default_rng(1000 + salt).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def _window_keys(ids: np.ndarray, offsets: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the picked positions of each window, and whether all of them are known words."""
    n = len(ids) - int(offsets[-1])
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    key, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for m, o in zip(_multipliers(len(offsets), salt), offsets):
        part = ids[o : o + n]
        key += (part.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * m
        key ^= key >> np.uint64(29)
        known &= part > 0
    return key, known


def _masks(n: int) -> list[tuple[int, np.ndarray]]:
    """The masks for a passage of n words; one of fewer than four words is taken whole."""
    if n < len(SHORT_MASKS[0]):
        return [(100 + n, np.arange(n))] if n else []
    chosen = enumerate(LONG_MASKS) if n >= LONG_PASSAGE else enumerate(SHORT_MASKS, len(LONG_MASKS))
    return [(salt, np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == 49)) for salt, m in chosen]


def telling_windows(rare: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Windows of which at least SEED_RARE picked words are rare; all windows of a passage that has few rare words."""
    n = max(0, len(rare) - int(offsets[-1]))
    if not n or rare.sum() < RARE_SHARE * len(rare):
        return np.ones(n, bool)
    return sum(rare[o : o + n].astype(np.int64) for o in offsets) >= min(SEED_RARE, len(offsets))


def build_index(items: list[tuple[int, str | None]], common: frozenset[str] = frozenset()) -> SeedIndex:
    """``common``: the words that most passages have and that tell little."""
    vocabulary: dict[str, int] = {}
    passages = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(p)], np.int64) for _, p in items]
    rare = [np.array([w not in common for w in words_of(p)], bool) for _, p in items]
    rows: dict[int, list] = {}
    shape: dict[int, np.ndarray] = {}
    for i, ids in enumerate(passages):
        for salt, offsets in _masks(len(ids)):
            pos = np.flatnonzero(telling_windows(rare[i], offsets))
            key = _window_keys(ids, offsets, salt)[0][pos]
            rows.setdefault(salt, []).append((key, np.full(len(key), i, np.int32), pos.astype(np.int32)))
            shape[salt] = offsets
    tables = []
    for salt, parts in rows.items():
        key, item, pos = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key, kind="stable")
        seen = np.zeros(1 << 20, bool)
        seen[(key >> np.uint64(44)).astype(np.int64)] = True
        tables.append((np.array([salt]), shape[salt], key[order], item[order], pos[order], seen))
    return SeedIndex(vocabulary, np.array([i for i, _ in items], np.int64), passages, tables, rare)


def _hits(index: SeedIndex, ids: np.ndarray, rows: np.ndarray, most: int = MOST_HITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text position, item, passage position, span) of matching windows, all of a text's and a passage's at once.

    ``rows`` gives the number of the text at each position. About ``most`` hits are expanded at a time: those
    of some texts, or, of a text that has more, those of every n-th passage.
    """
    met = []
    for t, (salt, offsets, keys, items, pos, seen) in enumerate(index.tables):
        key, known = _window_keys(ids, offsets, int(salt[0]))
        known &= seen[(key >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(known)
        key = key[at]
        lo = np.searchsorted(keys, key, "left")
        there = lo < len(keys)
        there[there] = keys[lo[there]] == key[there]
        at, lo, key = at[there], lo[there], key[there]
        met.append((at, np.full(len(at), t), lo, np.searchsorted(keys, key, "right") - lo))
    if not met:
        return
    at, table, lo, n = (np.concatenate(x) for x in zip(*met))
    order = np.argsort(at, kind="stable")
    at, table, lo, n = at[order], table[order], lo[order], n[order]
    ends = np.r_[np.flatnonzero(np.diff(rows[at])) + 1, len(at)] if len(at) else np.zeros(0, np.int64)
    total = np.r_[0, np.cumsum(n)]

    def expand(a: int, b: int) -> tuple[np.ndarray, ...]:
        where, of = np.repeat(at[a:b], n[a:b]), np.repeat(table[a:b], n[a:b])
        k = np.repeat(lo[a:b] - (total[a:b] - total[a]), n[a:b]) + np.arange(int(total[b] - total[a]))
        item, pos, span = np.empty(len(k), np.int64), np.empty(len(k), np.int64), np.empty(len(k), np.int64)
        for t, x in enumerate(index.tables):
            mine = of == t
            item[mine], pos[mine], span[mine] = x[3][k[mine]], x[4][k[mine]], int(x[1][-1]) + 1
        return where, item, pos, span

    a = 0
    while a < len(at):
        b = int(ends[max(np.searchsorted(ends, a, "right"), np.searchsorted(ends, np.searchsorted(total, total[a] + most, "right") - 1, "right") - 1)])
        parts = int(-(-(total[b] - total[a]) // (2 * most)))
        if parts <= 1:
            yield expand(a, b)
        else:
            slices = np.unique(np.r_[a, np.searchsorted(total[a:b], np.arange(total[a], total[b], most)) + a, b])
            for k in range(parts):
                some = [tuple(x[h[1] % parts == k] for x in h) for u, v in itertools.pairwise(slices) for h in [expand(int(u), int(v))]]
                yield tuple(np.concatenate(x) for x in zip(*some))
        a = b


def _stretch(text: np.ndarray, passage: np.ndarray, diagonal: int, start: int, end: int) -> tuple[int, int]:
    """Widen passage[start:end] on its diagonal while matches outweigh mismatches (a drop of DROP ends it)."""
    n = len(passage)
    for step in (1, -1):
        score = best = 0
        i = end if step > 0 else start - 1
        reach = i
        while 0 <= i < n and 0 <= i + diagonal < len(text):
            score += 1 if text[i + diagonal] == passage[i] else -1
            i += step
            if score > best:
                best, reach = score, i
            elif score <= best - DROP:
                break
        start, end = (start, max(end, reach)) if step > 0 else (min(start, reach + 1), end)
    return start, end


def matched_words(text: np.ndarray, passage: np.ndarray, spans: list[tuple[int, int, int]], rare: np.ndarray) -> tuple[int, int]:
    """Most words of the passage that stretches (diagonal, start, end), chained in order, find in the text, and how many of them are rare."""
    done: dict[int, list[tuple[int, int]]] = {}
    for d, a, b in sorted(spans):
        have = done.setdefault(d, [])
        if have and b <= have[-1][1]:
            continue
        a, b = _stretch(text, passage, d, a, b)
        if have and a <= have[-1][1]:
            have[-1] = (min(a, have[-1][0]), max(b, have[-1][1]))
        else:
            have.append((a, b))
    pieces = sorted((a + d, a, b, d) for d, have in done.items() for a, b in have)
    starts = [x[0] for x in pieces]
    same = [text[a + d : b + d] == passage[a:b] for _, a, b, d in pieces]
    equal = [np.r_[0, np.cumsum(x)] for x in same]
    telling = [np.r_[0, np.cumsum(x & rare[a:b])] for x, (_, a, b, _) in zip(same, pieces)]
    best = [(int(e[-1]), int(r[-1])) for e, r in zip(equal, telling)]
    solid = [e >= SOLID_WORDS and e >= SOLID_SHARE * (b - a) for (e, _), (_, a, b, _) in zip(best, pieces)]
    n = len(passage)
    for j, (at, a, b, d) in enumerate(pieces):
        for i in range(bisect_left(starts, at - 2 * n), j):
            _, _, pb, pd_ = pieces[i]
            free = max(a, pb, pb + pd_ - d)
            near = abs(d - pd_) <= SHIFT or solid[i] and solid[j] and free + d - pb - pd_ <= n
            if near and free < b and b > pb and b + d > pb + pd_:
                more = int(equal[j][-1] - equal[j][free - a]), int(telling[j][-1] - telling[j][free - a])
                best[j] = max(best[j], (best[i][0] + more[0], best[i][1] + more[1]))
    return max(best, default=(0, 0))


def find_in_batch(index: SeedIndex, texts: list[str | None], share: float = SHARE, most_hits: int = MOST_HITS) -> list[tuple[int, int]]:
    """(row, item) of every passage found in a list of texts."""
    get = index.vocabulary.get
    parts, starts, at = [], [], 0
    for t in texts:
        words = words_of(t)
        starts.append(at)
        parts += [np.fromiter(map(get, words, itertools.repeat(0)), np.int32, len(words)), np.zeros(PAD, np.int32)]
        at += len(words) + PAD
    if not parts:
        return []
    text, first = np.concatenate(parts), np.array(starts)
    rows = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(text)]))
    last = np.r_[first[1:], len(text)] - PAD
    found = set()
    for where, item, pos, span in _hits(index, text, rows, most_hits):
        if not len(where):
            continue
        row, diagonal = rows[where], where - pos
        order = np.lexsort((pos, diagonal, item, row))
        item, pos, span, row, diagonal = (x[order] for x in (item, pos, span, row, diagonal))
        new_pair = np.r_[True, (np.diff(row) != 0) | (np.diff(item) != 0)]
        begin = np.flatnonzero(new_pair)
        end = np.r_[begin[1:], len(row)]
        for k in np.flatnonzero(_most_words(index, text, first, last, row, item, diagonal, begin) >= share * index.lengths[item[begin]]):
            a, b = begin[k], end[k]
            r, i = int(row[a]), int(item[a])
            lo, hi = first[r], last[r]
            spans = list(zip((diagonal[a:b] - lo).tolist(), pos[a:b].tolist(), (pos[a:b] + span[a:b]).tolist()))
            said, telling = matched_words(text[lo:hi], index.passages[i], spans, index.rare[i])
            if said >= share * index.lengths[i] and telling >= share / 2 * int(index.rare[i].sum()):
                found.add((r, i))
    return sorted(found)


def _most_words(
    index: SeedIndex, text: np.ndarray, first: np.ndarray, last: np.ndarray, row: np.ndarray, item: np.ndarray, diagonal: np.ndarray, begin: np.ndarray
) -> np.ndarray:
    """An upper bound of the chained words of each pair that begins at ``begin``: the equal words on all of its hits' diagonals."""
    new = np.r_[True, (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) != 0)]
    each = np.flatnonzero(new)
    equal = np.zeros(len(row), np.int64)
    for a in range(0, len(each), 20_000):
        part = each[a : a + 20_000]
        n = index.lengths[item[part]]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        here = np.repeat(diagonal[part], n) + step
        inside = (here >= np.repeat(first[row[part]], n)) & (here < np.repeat(last[row[part]], n))
        same = inside & (text[np.where(inside, here, 0)] == index.flat[np.repeat(index.begin[item[part]], n) + step])
        equal[part] = np.add.reduceat(same, np.cumsum(n) - n, dtype=np.int64)
    return np.add.reduceat(equal, begin)


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    passage_col: str = "passage",
    share: float = SHARE,
    most_words: int = MOST_INDEX_WORDS,
) -> DataFrame:
    """(id_col, item_col): texts that hold at least ``share`` of a passage's words in order in one stretch.

    Words are lower-case runs of letters and digits; parts of a passage with more than SHIFT words put between
    them are one stretch only if both are solid and no further apart than the passage is long. Passages without a word are never found; several rows of one item
    are several passages of it; null and empty texts hold nothing; repeated rows give one pair; extra
    columns are ignored. The passages' index is sent out only while they have at most ``most_words`` words.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    id_type = texts.schema["id"].dataType.simpleString()
    queries = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(passage_col).alias("passage")).where(F.col(item_col).isNotNull() & (F.length(passage_col) > 0)).distinct()
    # of the words of a passage at most the mean number / COMMON_SHARE words are common
    met = queries.mapInPandas(
        lambda batches: (pd.DataFrame({"word": [w for p in pdf["passage"] for w in set(words_of(p))]}) for pdf in batches), "word string"
    )
    often = met.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).join(F.broadcast(queries.agg(F.count(F.lit(1)).alias("all"))))
    common = frozenset(r[0] for r in often.where(F.col("n") > COMMON_SHARE * F.col("all")).select("word").collect())
    words = queries.agg(F.sum(F.size(F.split("passage", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    found = (_looked_up if words <= most_words else _joined)(texts, queries, id_type, share, common)
    return found.distinct().select(F.col("id").alias(id_col), F.col("item").alias(item_col))


def _looked_up(texts: DataFrame, queries: DataFrame, id_type: str, share: float, common: frozenset[str]) -> DataFrame:
    """(id, item): the windows of each text looked up in the passages' index."""
    shared = texts.sparkSession.sparkContext.broadcast(build_index([tuple(r) for r in queries.collect()], common))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            pairs = find_in_batch(index, b.column(1).to_pylist(), share)
            rows = pa.array([r for r, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([int(index.items[i]) for _, i in pairs], pa.int64())], ["id", "item"])

    return texts.mapInArrow(probe, f"id {id_type}, item bigint")


def _joined(texts: DataFrame, queries: DataFrame, id_type: str, share: float, common: frozenset[str]) -> DataFrame:
    """(id, item): the texts' windows joined with the passages' by mask and hash, and each pair met verified."""

    def windows(masks_of) -> object:
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for b in batches:
                for owner, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = np.fromiter((xxhash.xxh64_intdigest(w) >> 1 | 1 for w in words_of(text)), np.int64)
                    for salt, offsets in masks_of(len(ids)):
                        keys = np.unique(_window_keys(ids, offsets, salt)[0].astype(np.int64))
                        if len(keys):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), salt, np.int32)), pa.array(keys), pa.array(np.full(len(keys), owner))], ["salt", "key", "owner"])

        return read

    schema = "salt int, key bigint, owner bigint"
    passages = queries.withColumn("owner", F.xxhash64("item", "passage"))
    sides = texts.withColumn("owner", F.xxhash64("id", "text"))
    theirs = passages.select("owner", "passage").mapInArrow(windows(_masks), schema)
    salts = sorted(r[0] for r in theirs.select("salt").distinct().collect())
    shapes = [(s, o) for n in (1, 2, 3, LONG_PASSAGE - 1, LONG_PASSAGE) for s, o in _masks(n) if s in salts]
    ours = sides.select("owner", "text").mapInArrow(windows(lambda n: shapes), schema).withColumnRenamed("owner", "text_owner")
    pairs = ours.join(theirs, ["salt", "key"]).select("text_owner", "owner").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [bool(find_in_batch(build_index([(0, p)], common), [t], share)) for p, t in zip(pdf["passage"], pdf["text"])]
            yield pdf.loc[np.array(keep, bool), ["id", "item"]]

    both = pairs.join(passages, "owner").join(sides.withColumnRenamed("owner", "text_owner"), "text_owner").select("id", "item", "passage", "text")
    return both.mapInPandas(verify, f"id {id_type}, item bigint")
