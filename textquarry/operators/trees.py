"""Summary trees, line diffs and examples made from texts."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN, LEVELS, LONGEST = 5, 3, 2000


def _summary(rows: Column) -> Column:
    """Texts in order, those with equal first 100 characters once, as paragraphs, cut with dots."""
    texts = F.transform(F.array_sort(rows), lambda r: r["text"])
    distinct = F.aggregate(
        texts,
        F.array().cast("array<string>"),
        lambda kept, t: F.when(F.exists(kept, lambda k: F.substring(k, 1, 100) == F.substring(t, 1, 100)), kept).otherwise(F.concat(kept, F.array(t))),
    )
    joined = F.array_join(distinct, "\n\n")
    return F.when(F.length(joined) > LONGEST, F.concat(F.substring(joined, 1, LONGEST), F.lit("..."))).otherwise(joined)


def summary_tree(chunks: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(doc_id, node_id, parent_id, level, text): leaves and the summaries of each ``fan`` neighbours above them.

    ``chunks``: doc_id, chunk_seq, chunk. A level with one node of a document ends its tree; documents
    with several nodes left after ``levels`` levels get a root.
    """
    w = Window.partitionBy("doc_id").orderBy("chunk_seq")
    now = chunks.select("doc_id", (F.row_number().over(w) - 1).alias("i"), F.col("chunk").alias("text"))
    name = lambda level, i: F.concat(F.lit(f"L{level}_"), i)
    out = None
    for level in range(levels + 1):
        many = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
        sized = now.withColumn("n", many)
        above = F.floor(F.col("i") / fan).cast("int") if level < levels else F.lit(0)
        nodes = sized.select("doc_id", name(level, F.col("i")).alias("node_id"), F.when(F.col("n") > 1, name(level + 1, above)).alias("parent_id"), F.lit(level).alias("level"), "text")
        out = nodes if out is None else out.unionByName(nodes)
        now = sized.where("n > 1").groupBy("doc_id", above.alias("up")).agg(F.collect_list(F.struct("i", "text")).alias("r")).select("doc_id", F.col("up").alias("i"), _summary(F.col("r")).alias("text"))
    root = now.select("doc_id", name(levels + 1, F.col("i")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(levels + 1).alias("level"), "text")
    return out.unionByName(root)


def line_diff(pairs: DataFrame) -> DataFrame:
    """(id, change, old_line, new_line, line): lines removed and added between old and new, numbered from 1.

    A replaced block is removed, then added. Null texts count as empty.
    """

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, old, new in zip(pdf["id"], pdf["old"], pdf["new"]):
                a, b = (old or "").splitlines(), (new or "").splitlines()
                for op, a0, a1, b0, b1 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                    if op != "equal":
                        rows += [(key, "removed", k + 1, None, a[k]) for k in range(a0, a1)]
                        rows += [(key, "added", None, k + 1, b[k]) for k in range(b0, b1)]
            out = pd.DataFrame(rows, columns=["id", "change", "old_line", "new_line", "line"])
            yield out.astype({"old_line": "Int64", "new_line": "Int64"})

    kind = dict(pairs.dtypes)["id"]
    return pairs.select("id", "old", "new").mapInPandas(diff, f"id {kind}, change string, old_line bigint, new_line bigint, line string")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("id").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))


def topics(text: Column, most: int = 5) -> Column:
    """Up to ``most`` topics: the first three long capitalised words of each sentence of 20 characters or more."""
    parts = F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) >= 20)
    named = F.transform(parts, lambda s: F.array_join(F.slice(F.regexp_extract_all(s, F.lit(r"\b([A-Z][a-z]{4,})\b"), 1), 1, 3), " "))
    found = F.slice(F.array_distinct(F.filter(named, lambda t: t != "")), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("document content")))


def node_scores(nodes: DataFrame, question: str, k: int = 5) -> DataFrame:
    """The k nodes (doc_id, node_id, level, text) that fit a question best.

    Share of its words, 1.5 more for the whole phrase, damped for texts over 500 characters, weighed by level.
    """
    words = sorted(set(question.lower().split()))
    low = F.lower("text")
    recall = sum((F.when(F.contains(low, F.lit(w)), 1.0).otherwise(0.0) for w in words), F.lit(0.0)) / max(1, len(words))
    phrase = F.when(F.contains(low, F.lit(question.lower())), 1.5).otherwise(0.0)
    weight = F.when(F.col("level") == 0, 1.0).when(F.col("level") == 1, 0.8).when(F.col("level") == 2, 0.6).when(F.col("level") == 3, 0.5).otherwise(0.3)
    score = (recall + phrase) * F.least(F.lit(1.0), F.try_divide(F.lit(500.0), F.length("text"))) * weight
    return nodes.where(F.length("text") > 0).withColumn("score", F.round(score, 6)).where("score > 0").orderBy(F.desc("score"), "doc_id", "node_id").limit(k)


# Forms of questions made from a topic.
FORMS = ("What does the text say about {}?", "Explain {} as told in the text.", "Summarise what is known about {}.")


def made_examples(docs: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, example_no, instruction, output): questions on a text's topics with the first sentence that has the topic.

    The form is chosen by a hash of the id and the topic, so that every run gives the same.
    """
    t = docs.where(F.length("text") > 100).select("doc_id", "text", F.posexplode(topics(F.col("text"), most)).alias("example_no", "topic"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(" "), "topic")), 1, 8), 16, 10).cast("bigint") % len(FORMS)
    form = F.element_at(F.array(*(F.lit(f) for f in FORMS)), (drawn + 1).cast("int"))
    sentences = F.split("text", r"(?<=[.!?])[ \t\n\r]+")
    answer = F.get(F.filter(sentences, lambda s: F.contains(s, F.element_at(F.split(F.col("topic"), " "), 1))), F.lit(0))
    return t.select("doc_id", "example_no", F.replace(form, F.lit("{}"), F.col("topic")).alias("instruction"), F.substring(F.coalesce(answer, "text"), 1, 300).alias("output"))


def reading_order(elements: DataFrame, *ties: str) -> DataFrame:
    """Layout elements (doc_id, page, x0, y0, text) with their column (left or right of the mean x0) and place; ``ties`` decide between equal places."""
    mean = F.avg("x0").over(Window.partitionBy("doc_id"))
    placed = elements.withColumn("side", F.when(F.col("x0") < mean, "left").otherwise("right"))
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y0", "x0", *ties)))


def cluster_nodes(nodes: DataFrame, size: int = FAN, least: float = 0.7) -> DataFrame:
    """(doc_id, i, cluster) of nodes (doc_id, i, embedding): greedily, each free node takes later free ones alike.

    In the order of ``i``, a node that no cluster has begins one and takes the next free nodes of a cosine of at
    least ``least`` until it has ``size``; ``cluster`` is its first ``i``. The nodes of one document are one group.
    """
    import numpy as np

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        x = np.array(pdf["embedding"].tolist(), np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
        free = np.ones(len(x), bool)
        own = np.zeros(len(x), np.int64)
        for k in range(len(x)):
            if free[k]:
                later = np.flatnonzero(free[k + 1 :]) + k + 1
                taken = later[np.round(x[later] @ x[k], 9) >= least][: size - 1]
                free[taken] = free[k] = False
                own[taken] = own[k] = pdf["i"].iloc[k]
        return pd.DataFrame({"doc_id": pdf["doc_id"], "i": pdf["i"], "cluster": own})

    kinds = dict(nodes.dtypes)
    return nodes.where(F.size("embedding") > 0).groupBy("doc_id").applyInPandas(cluster, f"doc_id {kinds['doc_id']}, i {kinds['i']}, cluster bigint")
