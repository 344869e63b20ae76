"""Cutting texts into chunks, as generators over rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import split_words, strip
from textquarry.functions.tokens import TOKENIZERS, encoder


def fixed_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_seq, start_index, end_index, chunk): windows of ``size`` characters every ``size - overlap``.

    Null and empty texts have no chunks; end_index is cut to the text's length.
    """
    step = max(size - overlap, 1)
    full = docs.where(F.length(text_col) > 0).select(F.col(id_col), F.col(text_col).alias("_t"))
    starts = full.select(id_col, "_t", F.posexplode(F.sequence(F.lit(0), F.length("_t") - 1, F.lit(step))).alias("chunk_seq", "start_index"))
    return starts.select(
        id_col,
        "chunk_seq",
        "start_index",
        F.least(F.col("start_index") + size, F.length("_t")).alias("end_index"),
        F.col("_t").substr(F.col("start_index") + 1, F.lit(size)).alias("chunk"),
    )


def parent_child_chunks(docs: DataFrame, parent_size: int = 1500, parent_overlap: int = 100, child_size: int = 300) -> DataFrame:
    """Parents (level 1) and their children (level 0), with offsets in the whole text."""
    parents = fixed_chunks(docs, parent_size, parent_overlap).withColumn("chunk_id", F.concat(F.lit("parent_"), F.col("chunk_seq")))
    kids = parents.select(
        "doc_id", F.col("chunk_id").alias("parent_chunk_id"), F.col("chunk_seq").alias("p"), F.col("start_index").alias("base"), "chunk",
        F.posexplode(F.sequence(F.lit(0), F.length("chunk") - 1, F.lit(child_size))).alias("c", "s"),
    )
    children = kids.select(
        "doc_id",
        F.concat(F.lit("child_"), F.col("p"), F.lit("_"), F.col("c")).alias("chunk_id"),
        "parent_chunk_id",
        F.lit(0).alias("level"),
        (F.col("base") + F.col("s")).alias("start_index"),
        (F.col("base") + F.least(F.col("s") + child_size, F.length("chunk"))).alias("end_index"),
    )
    return parents.select("doc_id", "chunk_id", F.lit(None).cast("string").alias("parent_chunk_id"), F.lit(1).alias("level"), "start_index", "end_index").unionByName(children)


def sentence_list(text):
    """Trimmed, non-empty sentences: cuts after . ! or ? before white space."""
    parts = F.split(text, r"(?<=[.!?])[ \t\n\r\f]+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentence_windows(docs: DataFrame, size: int = 5, overlap: int = 1) -> DataFrame:
    """(doc_id, chunk_seq, num_sentences, chunk): ``size`` sentences every ``size - overlap``."""
    step = max(size - overlap, 1)
    s = docs.where(F.length("text") > 0).select("doc_id", sentence_list(F.col("text")).alias("s")).where(F.size("s") > 0)
    w = s.select("doc_id", "s", F.posexplode(F.sequence(F.lit(0), F.size("s") - 1, F.lit(step))).alias("chunk_seq", "i"))
    part = F.slice("s", F.col("i") + 1, F.lit(size))
    return w.select("doc_id", "chunk_seq", F.size(part).alias("num_sentences"), F.array_join(part, " ").alias("chunk"))


def page_chunks(docs: DataFrame, id_col: str = "document_id") -> DataFrame:
    """(id, page, start_index, end_index): pages cut at the offsets in metadata['page_breaks']; without any, one page."""
    n = F.length("text")
    breaks = F.coalesce(F.from_json(F.col("metadata")["page_breaks"], "array<int>"), F.array().cast("array<int>"))
    inner = F.array_sort(F.array_distinct(F.filter(breaks, lambda b: (b > 0) & (b < F.length("text")))))
    full = docs.where(n > 0).select(id_col, n.alias("n"), inner.alias("b"))
    edges = full.select(id_col, F.concat(F.array(F.lit(0)), "b").alias("s"), F.concat("b", F.array("n")).alias("e"))
    return edges.select(id_col, F.posexplode(F.arrays_zip("s", "e")).alias("page", "x")).select(
        id_col, F.col("page"), F.col("x.s").alias("start_index"), F.col("x.e").alias("end_index")
    )


def heading_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_seq, heading, chunk): the text under each ATX heading; what stands before the first has none.

    Sections without text are left out.
    """
    mark = "\u001e"
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.regexp_replace("text", "\r\n?", "\n")), r"\n#{1,6}[ \t]+([^\n]*)", f"{mark}$1\n")
    parts = docs.where(F.length("text") > 0).select("doc_id", F.posexplode(F.split(marked, mark)).alias("k", "p"))
    head = F.when(F.col("k") > 0, strip(F.regexp_extract("p", r"^([^\n]*)", 1)))
    body = strip(F.when(F.col("k") > 0, F.regexp_replace("p", r"^[^\n]*", "")).otherwise(F.col("p")))
    out = parts.select("doc_id", F.col("k").alias("chunk_seq"), head.alias("heading"), body.alias("chunk"))
    return out.where(F.col("chunk") != "")


def paragraph_chunks(docs: DataFrame, size: int = 1000) -> DataFrame:
    """(doc_id, chunk_seq, chunk): paragraphs packed in order while they fit into ``size`` characters.

    The order decides where a chunk ends, so each text is one fold over its paragraphs.
    """
    paragraphs = F.filter(F.transform(F.split("text", r"\n[ \t\r]*\n[ \t\r\n]*"), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(acc, p):
        fits = (acc["now"] == "") | (F.length(acc["now"]) + F.length(p) <= size)
        together = F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p))
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))).alias("done"),
            F.when(fits, together).otherwise(p).alias("now"),
        )

    packed = F.aggregate(paragraphs, start, add, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))
    return docs.where(F.length("text") > 0).select("doc_id", F.posexplode(packed).alias("chunk_seq", "chunk"))


def chosen_strategy(docs: DataFrame) -> DataFrame:
    """(doc_id, strategy): by_heading for headings, hierarchical from 10 000 words, fixed_size for tables, else sentence_window."""
    words = F.size(split_words(F.col("text")))
    rows = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\|.*\|[ \r]*$") | x.rlike(r"^([^,\n]*,){3,}[^,\n]*$")))
    academic = F.size(F.array_intersect(F.slice(split_words(F.lower("text")), 1, 50), F.array(*map(F.lit, ("abstract", "introduction", "methodology", "references", "thesis"))))) > 0
    kind = (
        F.when(F.col("text").rlike(r"(?m)^#{1,6} [^ ]"), "by_heading")
        .when(words > 10_000, "hierarchical")
        .when(academic, "by_heading")
        .when(rows > 3, "fixed_size")
        .otherwise("sentence_window")
    )
    return docs.where(F.length("text") > 0).select("doc_id", kind.alias("strategy"))


def token_windows(text: str, size: int, overlap: int, folder: str, name: str) -> list[tuple[int, int, int, str]]:
    """(seq, start, end, chunk) of windows of ``size`` tokens; a character cut by a window's edge belongs to both."""
    enc = encoder(folder, name)
    ids = enc.encode_ordinary(text)
    ends = [0]
    for token in ids:
        ends.append(ends[-1] + len(enc.decode_single_token_bytes(token)))
    data = text.encode()
    # characters that begin before each byte
    before = [0]
    for byte in data:
        before.append(before[-1] + (byte & 0xC0 != 0x80))
    out = []
    for seq, at in enumerate(range(0, len(ids), max(size - overlap, 1))):
        to = min(at + size, len(ids))
        start = before[ends[at]] if ends[at] == len(data) or data[ends[at]] & 0xC0 != 0x80 else before[ends[at]] - 1
        end = before[ends[to]]
        out.append((seq, start, end, text[start:end]))
    return out


def token_chunks(docs: DataFrame, size: int = 256, overlap: int = 32, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, chunk_seq, start_index, end_index, chunk): windows of ``size`` tokens every ``size - overlap``.

    Without a vocabulary (folder None) a token counts as four characters.
    """
    if folder is None:
        return fixed_chunks(docs, size * 4, overlap * 4)
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *w) for i, t in zip(pdf["doc_id"], pdf["text"]) for w in token_windows(t, size, overlap, folder, name)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_seq", "start_index", "end_index", "chunk"])

    schema = f"doc_id {kind}, chunk_seq int, start_index int, end_index int, chunk string"
    return docs.where(F.length("text") > 0).select("doc_id", "text").mapInPandas(cut, schema)


def corpus_strategy(docs: DataFrame) -> DataFrame:
    """One row (texts, headings, code, pages, strategy): the cut that suits a corpus, from its averages.

    by_page for texts with form feeds, fixed_size for tables, by_heading for headings or code, else semantic.
    """
    text = F.col("text")
    means = docs.where(F.length("text") > 0).agg(
        F.count(F.lit(1)).alias("texts"),
        F.round(F.avg(F.regexp_count(text, F.lit(r"(?m)^#{1,6} "))), 6).alias("headings"),
        F.round(F.avg(F.regexp_count(text, F.lit(r"(?m)^```"))), 6).alias("code"),
        F.round(F.avg(F.regexp_count(text, F.lit("\f"))), 6).alias("pages"),
        F.round(F.avg(F.regexp_count(text, F.lit(r"(?m)^\|.*\|"))), 6).alias("rows"),
    )
    kind = F.when(F.col("pages") > 0.5, "by_page").when(F.col("rows") > 3, "fixed_size").when((F.col("headings") > 2) | (F.col("code") > 1), "by_heading").otherwise("semantic")
    return means.withColumn("strategy", kind)


STRATEGIES = {
    "fixed_size": fixed_chunks,
    "by_heading": heading_chunks,
    "semantic": paragraph_chunks,
    "sentence_window": sentence_windows,
    "by_token": token_chunks,
    "hierarchical": parent_child_chunks,
    "by_page": page_chunks,
}


def chunk(docs: DataFrame, strategy: str, **options) -> DataFrame:
    """The chunks of a strategy by its name."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](docs, **options)
