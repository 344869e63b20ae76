"""Lexical and dense retrieval for sets of queries, and fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textquarry.functions.text import ascii_terms, split_words
from textquarry.session import cut_lineage, shuffle_width

K1, B = 1.5, 0.75
RRF_K = 60
MOST_SENT_TERMS = 10_000
MOST_SENT_PAIRS = 500_000
BLOCK_DOCS, BLOCK_HITS = 32_768, 4_000_000
PIECE_BYTES = 1 << 19
COMMON_SHARE = 0.1
SPREAD_WORD, SPREAD_STATE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, dl): how often each term occurs, and the number of terms of the text."""
    terms = docs.where(F.length(text_col) > 0).select(F.col(id_col), ascii_terms(F.col(text_col)).alias("t"))
    each = terms.select(id_col, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return each.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def term_statistics(docs: DataFrame) -> DataFrame:
    """(term, df, cf): documents with the term and its occurrences."""
    return postings(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _sent_queries(wanted: DataFrame, most_sent: int) -> tuple[list[str], dict] | None:
    """The terms of (query_id, term) and each query's numbers of them; None if they are too many to be sent to the executors."""
    pairs = wanted.select("query_id", "term").limit(MOST_SENT_PAIRS + 1).collect()
    terms = sorted({t for _, t in pairs})
    if len(pairs) > MOST_SENT_PAIRS or len(terms) > most_sent:
        return None
    number, of = {t: k for k, t in enumerate(terms)}, {}
    for query, term in pairs:
        of.setdefault(query, []).append(number[term])
    return terms, of


def _in_terms(b: np.ndarray) -> np.ndarray:
    """Which bytes are letters or digits of ascii_terms."""
    return (b - np.uint8(97) < 26) | (b - np.uint8(48) < 10)


def _in_words(b: np.ndarray) -> np.ndarray:
    """Which bytes are none of the spaces that split_words splits at."""
    return (b != 32) & (b != 10) & (b != 9) & (b != 13) & (b != 12)


class Sought:
    """Finds a set of terms in texts' UTF-8, whole pieces of text at once.

    A term is looked up by its length and its first 8 bytes, what this leaves by the next 8 and so on; the
    last step knows all its bytes, so nothing but the term itself is found.
    """

    def __init__(self, terms: list[str], inside: Callable[[np.ndarray], np.ndarray]):
        self.width, self.inside, self.levels = len(terms), inside, []
        raw = [t.encode() for t in terms]
        state, left = [len(t) for t in raw], range(len(raw))
        while left:
            at = 8 * len(self.levels)
            nodes: dict[tuple[int, int], int] = {}
            node = {i: nodes.setdefault((state[i], int.from_bytes(raw[i][at : at + 8], "little")), len(nodes)) for i in left}
            states, words = np.array([s for s, _ in nodes], np.int64), np.array([w for _, w in nodes], np.uint64)
            then = np.arange(len(nodes))
            for i in left:
                state[i] = node[i]
                if len(raw[i]) <= at + 8:
                    then[node[i]] = i
            mixer = SPREAD_STATE
            while len(np.unique(h := words * SPREAD_WORD + states.astype(np.uint64) * mixer)) < len(h):
                mixer += np.uint64(2)
            by, slots = np.argsort(h), np.full(1 << 18, -1, np.int32)
            slots[h[by] >> np.uint64(46)] = np.arange(len(h))
            self.levels.append((mixer, slots, h[by], states[by], then[by]))
            left = [i for i in left if len(raw[i]) > at + 8]

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each text, texts of the hits, their terms, their counts); text i is ``data[offsets[i] : offsets[i + 1]]``, 8 more bytes follow the last."""
        inside = self.inside(data[: offsets[-1]])
        first, last = np.zeros_like(inside), np.zeros_like(inside)
        first[1:], last[:-1] = inside[1:] > inside[:-1], inside[:-1] > inside[1:]
        some = offsets[1:] > offsets[:-1]
        for edge, at in ((first, offsets[:-1][some]), (last, offsets[1:][some] - 1)):
            edge[at] = inside[at]
        starts = np.flatnonzero(first)
        sizes, lengths = np.diff(np.searchsorted(starts, offsets)), np.flatnonzero(last) + 1 - starts
        eight = np.ndarray(offsets[-1], "<u8", data, strides=(1,))
        place, state, left, doc, docs, codes = starts, lengths, lengths, np.repeat(np.arange(len(sizes)), sizes), [], []
        for mixer, slots, known, states, then in self.levels:
            h = (eight[place] & FIRST_BYTES[np.minimum(left, 8)]) * SPREAD_WORD + state.astype(np.uint64) * mixer
            slot = slots[h >> np.uint64(46)]
            may = np.flatnonzero(slot >= 0)
            at, h = slot[may], h[may]
            others = np.flatnonzero(known[at] != h)  # of a slot that several share only one is in it
            at[others] = np.minimum(np.searchsorted(known, h[others]), len(known) - 1)
            same = (known[at] == h) & (states[at] == state[may])
            may, state = may[same], then[at[same]]
            place, left, doc = place[may], left[may], doc[may]
            whole = left <= 8
            docs.append(doc[whole])
            codes.append(state[whole])
            place, state, left, doc = place[~whole] + 8, state[~whole], left[~whole] - 8, doc[~whole]
        key, n = np.unique(np.concatenate(docs) * self.width + np.concatenate(codes) if docs else np.zeros(0, np.int64), return_counts=True)
        return sizes, key // max(1, self.width), key % max(1, self.width), n


def _pieces(texts: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, their bytes and 8 more, offsets) of up to PIECE_BYTES or one text; never more than ``most`` texts."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data, at = np.frombuffer(data or b"", np.uint8), 0
    while at < len(texts):
        stop = min(max(int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1, at + 1), at + most, len(texts))
        yield at, stop - at, np.concatenate([data[offsets[at] : offsets[stop]], np.zeros(8, np.uint8)]), offsets[at : stop + 1] - offsets[at]
        at = stop


def _hit_blocks(batches: Iterator[pa.RecordBatch], seekers: list[Sought]) -> Iterator[tuple[list, list[tuple]]]:
    """(ids, for each of the seekers: terms of each text, hits of each term, their texts, their counts) of up to BLOCK_DOCS lower-case texts.

    Texts are numbered in the order of their ids, hits stand in the order of term and text.
    """
    ids, parts, held = [], [[] for _ in seekers], [0] * len(seekers)

    def block() -> tuple:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        found = []
        for seeker, part in zip(seekers, parts):
            sizes, doc, term, n = (np.concatenate(x) for x in zip(*part))
            doc = place[doc]
            by = np.argsort(term * len(ids) + doc)
            found.append((sizes[order], np.bincount(term, minlength=seeker.width), doc[by].astype(np.int32), n[by].astype(np.int32)))
        return [ids[i] for i in order], found

    for batch in batches:
        named = batch.column(0).to_pylist()
        for first, number, data, offsets in _pieces(batch.column(1), BLOCK_DOCS):
            if len(ids) + number > BLOCK_DOCS or max(held) >= BLOCK_HITS:
                yield block()
                ids, parts, held = [], [[] for _ in seekers], [0] * len(seekers)
            for k, seeker in enumerate(seekers):
                sizes, doc, term, n = seeker.find(data, offsets)
                parts[k].append((sizes, doc + len(ids), term, n))
                held[k] += len(n)
            ids += named[first : first + number]
    if ids:
        yield block()


def _rounded(x: np.ndarray) -> np.ndarray:
    """To 6 digits, halves away from zero, for x >= 0."""
    y = x * 1e6
    low = np.floor(y)
    return (low + (y - low >= 0.5)) / 1e6


def _leading(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; of equal ones the first."""
    if len(score) <= k:
        return np.arange(len(score))
    kth = np.partition(score, len(score) - k)[len(score) - k]
    over = np.flatnonzero(score > kth)
    return np.concatenate([over, np.flatnonzero(score == kth)[: k - len(over)]])


def best_of_block(size: int, hits: np.ndarray, docs: np.ndarray, weights: np.ndarray, queries: list[tuple], k: int) -> list[tuple]:
    """(query_id, places of its k best texts, their scores); ``queries``: (query_id, its numbers of terms, what the sum is divided by).

    Weights are positive. The sums of common terms (COMMON_SHARE of the texts) are made once for all queries
    that share them. The k-th best of any k texts can't be better than the k-th best of all, so that only texts that
    reach those with a query's rarest term, or the best by its common terms, are rounded and sorted. Nothing is lost.
    """
    start = np.r_[0, np.cumsum(hits)]
    common = hits > COMMON_SHARE * size
    docs = docs.astype(np.int64)  # as an index twice as fast
    of = [(docs[a:b], weights[a:b]) for a, b in zip(start[:-1], start[1:])]
    shared_of = sorted((tuple(sorted(t for t in terms if common[t])), q) for q, (_, terms, _) in enumerate(queries))
    at, score, out = None, np.empty(size), []
    for shared, q in shared_of:
        query, terms, divisor = queries[q]
        rare = sorted((t for t in terms if hits[t] and not common[t]), key=lambda t: hits[t])
        if not shared and not rare:
            continue
        if shared != at:
            at, whole = shared, np.zeros(size)
            for t in shared:
                whole[of[t][0]] += of[t][1]
            best = np.argpartition(whole, size - k)[size - k :] if shared and size > k else np.arange(0)
        np.copyto(score, whole)
        for t in rare:
            d, w = of[t]
            score[d] += w
        least = score[best].min(initial=np.inf) if len(best) else 0.0
        led = next((of[t][0] for t in rare if hits[t] >= k), None)
        if led is not None:
            least = max(least, np.partition(score[led], len(led) - k)[len(led) - k])
        least -= 2e-6 * divisor
        seen = np.flatnonzero(score >= least if least > 0 else score > 0)
        rounded = _rounded(score[seen] / divisor)
        leading = _leading(rounded, k)
        out.append((query, seen[leading], rounded[leading]))
    return out


def _best_rows(ids: list, query: list, places: np.ndarray, score: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, schema.field(0).type), pa.array([ids[i] for i in places.tolist()], schema.field(1).type), pa.array(score, pa.float64())], schema=schema)


def _joined(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries' numbers, places, scores) of all that best_of_block found."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    query, places, score = zip(*found)
    return np.repeat(np.array(query, np.int64), [len(p) for p in places]), np.concatenate(places), np.concatenate(score)


def _lowered(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.where(F.col("text") != "").select(id_col, F.lower("text").alias("text"))


def _sought_table(docs: DataFrame, terms: DataFrame, id_col: str) -> DataFrame:
    """(id, term, tf, dl, df, docs, avgdl) of the sought ``terms``, the last three over all texts; for terms too many to send."""
    kept = cut_lineage(docs.where(F.length("text") > 0).select(id_col, ascii_terms(F.col("text")).alias("t")).select(id_col, F.size("t").alias("dl"), "t"))
    each = kept.select(id_col, "dl", F.explode("t").alias("term")).join(terms, "term", "left_semi")
    found = each.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    size = kept.where("dl > 0").agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avgdl"))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return found.join(df, "term").join(F.broadcast(size))


def _wanted_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct terms of each query."""
    return queries.where(F.length("query") > 0).select("query_id", F.explode(F.array_distinct(ascii_terms(F.col("query")))).alias("term"))


def _words(c: Column) -> Column:
    return F.array_distinct(split_words(F.lower(c)))


def _wanted_words(queries: DataFrame) -> DataFrame:
    return queries.where(F.length("query") > 0).select("query_id", F.explode(_words(F.col("query"))).alias("term"))


def _list_type(docs: DataFrame, queries: DataFrame, id_col: str) -> T.StructType:
    return T.StructType([queries.schema["query_id"], T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])


def _packed_hits(docs: DataFrame, id_col: str, terms: list[str], words: tuple[list[str], dict] | None = None, k: int = 0) -> DataFrame:
    """Blocks of texts with their hits of ``terms`` and, if ``words`` are given, each query's k best by keyword overlap, from one reading of the texts."""
    told = docs.sparkSession.sparkContext.broadcast((terms, words))
    kinds = [T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), *(T.StructField(c, T.BinaryType()) for c in ("dl", "hits", "docs", "tf")), T.StructField("sums", T.ArrayType(T.LongType()))]
    packed_type = T.StructType(kinds + [T.StructField(c, T.BinaryType()) for c in ("query", "place", "score") if words])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, (terms, words) = to_arrow_schema(packed_type), told.value
        seekers = [Sought(terms, _in_terms), *([Sought(words[0], _in_words)] if words else [])]
        queries = [(q, numbers, len(numbers)) for q, numbers in enumerate(words[1].values())] if words else []
        for ids, ((dl, hits, places, tf), *other) in _hit_blocks(batches, seekers):
            sums = [*hits.tolist(), int((dl > 0).sum()), int(dl.sum())]
            row = [ids, dl.tobytes(), hits.tobytes(), places.tobytes(), tf.tobytes(), sums]
            for _, its_hits, its_places, _ in other:
                row += [x.tobytes() for x in _joined(best_of_block(len(ids), its_hits, its_places, np.ones(len(its_places)), queries, k))]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    return cut_lineage(_lowered(docs, id_col).mapInArrow(pack, packed_type))


def _bm25_of(packed: DataFrame, out_type: T.StructType, sent: tuple[list[str], dict], k: int, k1: float, b: float) -> DataFrame:
    id_col, asked = out_type.names[1], list(sent[1])
    sums = {r[0]: r[1] for r in packed.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n")).collect()}
    df, n = np.array([sums.get(t, 0) for t in range(len(sent[0]))]), sums.get(len(sent[0]), 0)
    idf, average = np.log((n - df + 0.5) / (df + 0.5) + 1.0), sums.get(len(sent[0]) + 1, 0) / max(1, n)
    told = packed.sparkSession.sparkContext.broadcast((asked, [(q, numbers, 1.0) for q, numbers in enumerate(sent[1].values())]))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, (asked, queries) = to_arrow_schema(out_type), told.value
        for batch in batches:
            for row in (x for at in range(batch.num_rows) for x in batch.slice(at, 1).to_pylist()):
                dl, hits = np.frombuffer(row["dl"], np.int64), np.frombuffer(row["hits"], np.int64)
                places, tf = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tf"], np.int32)
                w = np.repeat(idf, hits) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl[places] / average))
                query, found, score = _joined(best_of_block(len(dl), hits, places, w, queries, k))
                yield _best_rows(row["ids"], [asked[q] for q in query.tolist()], found, score, schema)

    return top_per_query(packed.select("ids", "dl", "hits", "docs", "tf").mapInArrow(rank, out_type), k, id_col)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", k1: float = K1, b: float = B, most_sent: int = MOST_SENT_TERMS) -> DataFrame:
    """(query_id, id, score, rank) of the k best texts for each query, by Okapi BM25.

    ``queries`` has query_id and query. Only the distinct terms of the queries are counted; repeated
    terms of a query count once; ties go to the smaller id; queries without a known term give no row.
    Each text is split once, its hits stay where they are in blocks, and of each block only the k best of a
    query are moved. More than ``most_sent`` terms, or MOST_SENT_PAIRS of query and term, are joined as a table.
    Ids are unique.
    """
    wanted = _wanted_terms(queries)
    sent = _sent_queries(wanted, most_sent)
    if sent is None:
        weight = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0) * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        weighted = _sought_table(docs, wanted.select("term").distinct(), id_col).select(id_col, "term", weight.alias("w"))
        return top_per_query(weighted.join(wanted, "term").groupBy("query_id", id_col).agg(F.round(F.sum("w"), 6).alias("score")), k, id_col)
    return _bm25_of(_packed_hits(docs, id_col, sent[0]), _list_type(docs, queries, id_col), sent, k, k1, b)


def top_per_query(scores: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 10, id_col: str = "doc_id", constant: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rank): the sum of 1 / (constant + rank - 1) over the lists' ranks from 1."""
    parts = [x.select("query_id", id_col, (F.lit(1.0) / (F.col("rank") - 1 + constant)).alias("s")) for x in lists]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy("query_id", id_col).agg(F.round(F.sum("s"), 9).alias("score"))
    return top_per_query(fused, k, id_col)


def keyword_overlap(docs: DataFrame, queries: DataFrame, k: int = 10, most_sent: int = MOST_SENT_TERMS) -> DataFrame:
    """(query_id, doc_id, score, rank): the share of a query's distinct words that a text has.

    Of each block of texts only the k best of a query are moved, as in bm25; more than ``most_sent`` words are joined as a table.
    """
    wanted = _wanted_words(queries)
    sent = _sent_queries(wanted, most_sent)
    if sent is None:
        size = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        have = docs.where(F.length("text") > 0).select("doc_id", F.explode(_words(F.col("text"))).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
        hits = have.join(wanted, "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("hits")).join(size, "query_id")
        return top_per_query(hits.select("query_id", "doc_id", F.round(F.col("hits") / F.col("n"), 6).alias("score")), k)
    told, out_type = docs.sparkSession.sparkContext.broadcast(sent), _list_type(docs, queries, "doc_id")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, asked = to_arrow_schema(out_type), list(told.value[1])
        numbered = [(q, numbers, len(numbers)) for q, numbers in enumerate(told.value[1].values())]
        for ids, [(_, hits, places, _)] in _hit_blocks(batches, [Sought(told.value[0], _in_words)]):
            query, found, score = _joined(best_of_block(len(ids), hits, places, np.ones(len(places)), numbered, k))
            yield _best_rows(ids, [asked[q] for q in query.tolist()], found, score, schema)

    return top_per_query(_lowered(docs, "doc_id").mapInArrow(rank, out_type), k)


def lexical_lists(docs: DataFrame, queries: DataFrame, k: int = 10, most_sent: int = MOST_SENT_TERMS) -> tuple[DataFrame, DataFrame]:
    """The lists of bm25 and of keyword_overlap, from one reading of the texts."""
    terms, words = _sent_queries(_wanted_terms(queries), most_sent), _sent_queries(_wanted_words(queries), most_sent)
    if terms is None or words is None:
        return bm25(docs, queries, k, most_sent=most_sent), keyword_overlap(docs, queries, k, most_sent)
    packed, out_type = _packed_hits(docs, "doc_id", terms[0], words, k), _list_type(docs, queries, "doc_id")
    told = docs.sparkSession.sparkContext.broadcast(list(words[1]))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, asked = to_arrow_schema(out_type), told.value
        for row in (x for batch in batches for at in range(batch.num_rows) for x in batch.slice(at, 1).to_pylist()):
            query, found, score = np.frombuffer(row["query"], np.int64), np.frombuffer(row["place"], np.int64), np.frombuffer(row["score"], np.float64)
            yield _best_rows(row["ids"], [asked[q] for q in query.tolist()], found, score, schema)

    overlap = packed.select("ids", "query", "place", "score").mapInArrow(unpack, out_type)
    return _bm25_of(packed, out_type, terms, k, K1, B), top_per_query(overlap, k)


def query_weights(query: Column) -> dict[str, Column]:
    """Columns dense_weight and sparse_weight from the lexical density of a query."""
    terms = ascii_terms(query)
    n, distinct = F.size(terms), F.size(F.array_distinct(terms))
    sparse = F.when(n <= 2, F.lit(0.2)).otherwise(F.lit(0.3) + F.lit(0.5) * distinct / n)
    return {"sparse_weight": F.round(sparse, 6), "dense_weight": F.round(F.lit(1.0) - sparse, 6)}


def linear_fusion(dense: DataFrame, sparse: DataFrame, weights: DataFrame, k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """dense_weight * dense + sparse_weight * sparse / max sparse, over the union of both lists; ``weights`` per query_id."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    s = sparse.select("query_id", id_col, F.coalesce(F.try_divide("score", top), F.lit(0.0)).alias("sparse"))
    both = dense.select("query_id", id_col, F.col("score").alias("dense")).join(s, ["query_id", id_col], "full_outer").join(weights, "query_id")
    score = F.coalesce("dense", F.lit(0.0)) * F.col("dense_weight") + F.coalesce("sparse", F.lit(0.0)) * F.col("sparse_weight")
    return top_per_query(both.select("query_id", id_col, F.round(score, 6).alias("score")), k, id_col)


def vector_search(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", block_rows: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k nearest rows of each query vector, exactly, without the row itself.

    Rows and queries are packed into blocks by hash, and each pair of blocks is one task's matrix product.
    ``metric``: cosine, or l2 (score is the negated distance). Null, empty and (for cosine) zero vectors
    never match; vectors of different lengths never meet.
    """
    spark = rows.sparkSession

    def blocks(df: DataFrame, name: str) -> DataFrame:
        usable = df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x)))
        if metric == "cosine":
            usable = usable.where(F.exists(vec_col, lambda x: x != 0))
        flat = usable.select(F.col(id_col).cast("bigint").alias("i"), F.col(vec_col).alias("v"), F.size(vec_col).alias("dim"))
        n = flat.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
        placed = flat.join(n, "dim").withColumn("block", F.pmod(F.xxhash64("i"), "blocks").cast("int"))

        def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(pdf["v"].to_list()).astype(np.float64)
            return pd.DataFrame({"dim": [key[0]], "blocks": [key[1]], f"{name}_block": [key[2]], f"{name}_ids": [pdf["i"].to_numpy(np.int64).tobytes()], f"{name}_data": [x.tobytes()]})

        packed = placed.groupBy("dim", "blocks", "block").applyInPandas(pack, f"dim int, blocks int, {name}_block int, {name}_ids binary, {name}_data binary")
        return packed.withColumnRenamed("blocks", f"{name}_blocks")

    q, r = blocks(queries, "q"), blocks(rows, "r")
    counts = q.groupBy("dim").agg(F.first("q_blocks").alias("n"))
    spread = r.join(counts, "dim").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    tiles = spread.select("dim", "q_block", "r_block", "r_ids", "r_data").join(q.select("dim", "q_block", "q_ids", "q_data"), ["dim", "q_block"])

    def multiply(batches):
        for pdf in batches:
            out = []
            for dim, qi, qd, ri, rd in zip(pdf["dim"], pdf["q_ids"], pdf["q_data"], pdf["r_ids"], pdf["r_data"]):
                a, b = np.frombuffer(qd).reshape(-1, dim), np.frombuffer(rd).reshape(-1, dim)
                ia, ib = np.frombuffer(qi, np.int64), np.frombuffer(ri, np.int64)
                for at in range(0, len(a), 256):
                    part, ids = a[at : at + 256], ia[at : at + 256]
                    if metric == "cosine":
                        s = (part / np.linalg.norm(part, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
                    else:
                        s = -np.sqrt(np.maximum(0, (part**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * part @ b.T))
                    s = np.where(ids[:, None] == ib[None, :], -np.inf, np.round(s, 6))
                    kth = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
                    i, j = np.nonzero((s >= kth[:, None]) & np.isfinite(s))
                    out.append(pd.DataFrame({"query_id": ids[i], id_col: ib[j], "score": s[i, j]}))
            yield pd.concat(out) if out else pd.DataFrame({"query_id": [], id_col: [], "score": []})

    found = tiles.repartition(shuffle_width(spark), "q_block", "r_block").mapInPandas(multiply, f"query_id bigint, {id_col} bigint, score double")
    return top_per_query(found, k, id_col)


def cached_answers(queries: DataFrame, cache: DataFrame, least: float = 0.95) -> DataFrame:
    """(query_id, cached_id, similarity): for each query (query_id, query, embedding) the cached one it may take.

    ``cache``: cached_id, query, embedding, expires; expired entries don't count. An equal text is a hit
    of 1.0, else the nearest cached vector of a cosine of at least ``least``.
    """
    alive = cache.where(F.col("expires").isNull() | (F.col("expires") > F.current_timestamp()))
    same = queries.join(alive.groupBy(F.lower("query").alias("k")).agg(F.min("cached_id").alias("cached_id")), F.lower(F.col("query")) == F.col("k"))
    exact = same.select("query_id", "cached_id", F.lit(1.0).alias("similarity"))
    near = vector_search(
        alive.select((-F.col("cached_id") - 1).alias("vec_id"), "embedding"), queries.select(F.col("query_id").alias("vec_id"), "embedding"), 1
    ).where(F.col("score") >= least)
    close = near.select("query_id", (-F.col("vec_id") - 1).alias("cached_id"), F.col("score").alias("similarity")).join(exact.select("query_id"), "query_id", "left_anti")
    return exact.unionByName(close)


def merged_results(results: DataFrame, k: int = 10) -> DataFrame:
    """(question_id, confidence, latency_ms, cost) of the answers of several engines: confidence is sum(c * c) / sum(c)."""
    return results.groupBy("question_id").agg(
        F.round(F.coalesce(F.try_divide(F.sum(F.col("confidence") * F.col("confidence")), F.sum("confidence")), F.lit(0.0)), 6).alias("confidence"),
        F.sum("latency_ms").alias("latency_ms"),
        F.round(F.sum("cost"), 6).alias("cost"),
    )


def hashed_terms(docs: DataFrame, dims: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bucket, weight): a text's terms hashed into ``dims`` buckets with signs, scaled to length 1.

    The default embedding where no model is injected; zero weights are left out.
    """
    h = F.md5("term")
    number = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")
    signed = postings(docs, id_col, text_col).select(id_col, (number(1) % dims).cast("int").alias("bucket"), (F.when(number(9) % 2 == 0, 1).otherwise(-1) * F.col("tf")).alias("w"))
    summed = signed.groupBy(id_col, "bucket").agg(F.sum("w").cast("double").alias("w")).where("w <> 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return summed.select(id_col, "bucket", F.round(F.col("w") / norm, 6).alias("weight"))


def hashed_embeddings(docs: DataFrame, dims: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, embedding): hashed_terms as dense vectors."""
    m = hashed_terms(docs, dims, id_col, text_col).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0.0)).cast("float"))
    return m.select(id_col, dense.alias("embedding"))


def variant_union(lists: list[DataFrame], k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """(query_id, id, score, rank): the results of several wordings of each question, each text once with its best score."""
    union = lists[0].select("query_id", id_col, "score")
    for x in lists[1:]:
        union = union.unionByName(x.select("query_id", id_col, "score"))
    return top_per_query(union.groupBy("query_id", id_col).agg(F.max("score").alias("score")), k, id_col)
