"""Subject areas of documents, from labelling functions weighed by a latent-class model.

A lexicon of words per subject is learned from a bounded sample of hand labels and then widened over the
whole corpus: sentences that the first lexicon decides lend their subject to the words beside them.
For each document and subject, labelling functions vote: the share of sentences (or rows) that the lexicon
gives to the subject, its headings and title, its address, its source, and a hand label where there is
one. A latent-class model fitted by expectation maximisation on the counts of vote patterns learns how
reliable each function is; documents get the subjects of which the posterior is at least a half.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.session import cut_lineage

MOST_LABELS = 20_000
MOST_SENT = 500_000
LEXICON_SHARE = 0.7
LEAST_DOCS, LEAST_SENTENCES = 3, 4
# Bounds of the bins of the share of sentences; about a quarter makes a subject.
BINS = (0.001, 0.1, 0.175, 0.25, 0.4)
START = (0.005, 0.01, 0.08, 0.6, 0.97, 0.995)
ANCHOR = 0.5
FUNCTIONS = {"lexicon": len(BINS) + 1, "section": 3, "address": 3, "source": 3, "hand": 3}
ROUNDS = 60

WORD = re.compile(r"[^\W\d_]{3,}")
UNIT = re.compile(r"(?<=[.!?])\s+|\n+")
HEADING = re.compile(r"^\s*(?:#{1,6}\s+\S|\"(?:topic|title|subject|section|heading|name)\"\s*:|(?:topic|title|subject|section|betreff|sujet|objet|asunto)\s*:)", re.I)


def units_of(text: str) -> list[list[str]]:
    """The words of each sentence or row that has at least two."""
    return [w for w in (WORD.findall(u) for u in UNIT.split(text.lower())) if len(w) > 1]


class Lexicon:
    """Subject and weight of words."""

    def __init__(self, entries: dict[str, tuple[int, float]]):
        self.entries = entries

    def decide(self, words: list[str]) -> int | None:
        """The subject with the greatest summed weight, or None without a known word."""
        known = [self.entries[w] for w in words if w in self.entries]
        if not known:
            return None
        if len(known) == 1:
            return known[0][0]
        total: dict[int, float] = {}
        for k, weight in known:
            total[k] = total.get(k, 0.0) + weight
        return max(total, key=lambda k: (total[k], -k))

    def votes(self, text: str, title: str | None, path: str | None) -> dict[int, tuple[int, int, int]]:
        """subject -> votes (lexicon bin, section, address); 0 abstains, 1 is no, 2 is yes."""
        units = units_of(text)
        if not units:
            return {}
        shares = Counter(k for k in map(self.decide, units) if k is not None)
        heads = [line for line in text.split("\n") if HEADING.match(line)] if "#" in text or ":" in text else []
        named = {k for h in [*heads, title or ""] if (k := self.decide(WORD.findall(h.lower()))) is not None}
        placed = {k for w in WORD.findall((path or "").lower()) if w in self.entries for k in [self.entries[w][0]]}
        return {
            k: (int(np.searchsorted(BINS, shares.get(k, 0) / len(units), "right")), (2 if k in named else 1) if named else 0, (2 if k in placed else 1) if placed else 0)
            for k in shares.keys() | named | placed
        }


def fit_lexicon(counts: DataFrame, base: DataFrame, least: float) -> DataFrame:
    """(word, subject, weight): words of at least ``least`` uses of which, after evening out the sizes of the subjects, most belong to one.

    ``counts`` has word, subject and n, ``base`` the size of each subject (subject, size). Of subjects with
    equal shares of a word the first is taken.
    """
    sizes = base.select("subject", F.greatest("size", F.lit(1.0)).alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"), F.count(F.lit(1)).alias("subjects"))
    rated = counts.join(F.broadcast(sizes.join(mean)), "subject").withColumn("rate", F.col("n") / F.col("size") * F.col("mean"))
    of_word = rated.groupBy("word").agg(F.sum("n").alias("all"), F.sum("rate").alias("rates"), F.max(F.struct("rate", (-F.col("subject")).alias("first"))).alias("best"), F.first("subjects").alias("subjects"))
    weight = (F.col("best.rate") + 0.1) / (F.col("rates") + 0.1 * F.col("subjects"))
    return of_word.where(F.col("all") >= least).select("word", (-F.col("best.first")).alias("subject"), weight.alias("weight")).where(F.col("weight") >= LEXICON_SHARE)


def with_lexicon(texts: DataFrame, lexicon: DataFrame, columns: tuple[str, ...], most_sent: int) -> tuple[DataFrame, Callable[[Any], Lexicon]]:
    """(texts, look): ``look`` of a row's ``told`` is the lexicon, or the part of it that the row's words need.

    A lexicon of at most ``most_sent`` words is sent to the executors; a larger one is joined with the
    distinct words of each text.
    """
    if lexicon.count() <= most_sent:
        sent = texts.sparkSession.sparkContext.broadcast(Lexicon({r["word"]: (r["subject"], r["weight"]) for r in lexicon.toLocalIterator()}))
        return texts.withColumn("told", F.lit(0)), lambda told: sent.value
    keyed = texts.withColumn("row", F.xxhash64(*columns))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, *said in zip(pdf["row"], *(pdf[c] for c in columns)):
                found = list({w for t in said if t for w in WORD.findall(t.lower())})
                yield pd.DataFrame({"row": np.full(len(found), row, np.int64), "word": found})

    used = keyed.select("row", *columns).distinct().mapInPandas(split, "row bigint, word string").join(lexicon, "word")
    told = used.groupBy("row").agg(F.collect_list(F.struct("word", "subject", "weight")).alias("told"))
    return keyed.join(told, "row", "left").drop("row"), lambda told: Lexicon({t["word"]: (t["subject"], t["weight"]) for t in told} if told is not None else {})


def fit_latent(patterns: pd.DataFrame, rounds: int = ROUNDS) -> pd.DataFrame:
    """Posterior of each vote pattern (columns of FUNCTIONS and n), by EM of a two-class latent model.

    Functions count as independent given the truth; a vote of 0 other than the lexicon's abstains. The
    lexicon's bins say by definition what the share of sentences is, so its parameters carry a prior
    of the weight ANCHOR of all rows with the chances START; the other functions are learned freely.
    """
    names = list(FUNCTIONS)
    votes = patterns[names].to_numpy(int)
    n = patterns["n"].to_numpy(float)
    q = np.array(START)[votes[:, 0]]
    q = np.where(votes[:, 4] == 2, 1 - (1 - q) * 0.2, np.where(votes[:, 4] == 1, q * 0.2, q))
    for _ in range(rounds):
        prior = np.clip((n * q).sum() / n.sum(), 1e-4, 1 - 1e-4)
        odds = np.full(len(n), np.log(prior / (1 - prior)))
        for f, name in enumerate(names):
            values = np.arange(FUNCTIONS[name])
            yes = np.array([(n * q)[votes[:, f] == v].sum() for v in values]) + 0.5
            no = np.array([(n * (1 - q))[votes[:, f] == v].sum() for v in values]) + 0.5
            if name == "lexicon":
                mass = ANCHOR * n.sum() / len(START)
                yes, no = yes + mass * np.array(START), no + mass * (1 - np.array(START))
            else:
                yes[0] = no[0] = 0.0
            yes, no = yes / yes.sum(), no / no.sum()
            with np.errstate(divide="ignore", invalid="ignore"):
                weight = np.where((yes > 0) & (no > 0), np.log(yes / no), 0.0)
            odds += weight[votes[:, f]]
        q = 1 / (1 + np.exp(-odds))
    return patterns.assign(posterior=q)


def clean_labels(labels: DataFrame, subjects: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """(doc_id, subject) without repeats and with the spelling of the list; at most ``most`` rows, by hash of doc_id."""
    plain = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("doc_id").isNotNull()).distinct()
    known = subjects.select(F.lower(F.trim("subject")).alias("subject")).distinct()
    return plain.join(known, "subject", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "subject").limit(most)


def document_subjects(
    docs: DataFrame,
    labels: DataFrame,
    subjects: DataFrame,
    most_labels: int = MOST_LABELS,
    most_sent: int = MOST_SENT,
    functions: tuple[str, ...] = tuple(FUNCTIONS),
) -> DataFrame:
    """(doc_id, subject): every subject that at least about a quarter of a text's sentences or rows treat.

    Null, empty and wordless texts have no subject. Only labels are sampled (``most_labels`` rows); all
    counts, patterns and assignments cover every document. Rows with a null doc_id are left out;
    repeated rows give one row per subject; null title, source or path abstain; extra columns are
    ignored; without documents or usable labels the result is empty. ``subjects`` is a fixed list. A
    lexicon of more than ``most_sent`` words is joined with the texts instead of sent to the executors.
    Labelling functions that are not among ``functions`` abstain (to measure what each one adds).
    """
    spark = docs.sparkSession
    names = sorted(r[0] for r in subjects.select(F.lower(F.trim("subject"))).where(F.col("subject").isNotNull()).distinct().collect() if r[0])
    number = {s: k for k, s in enumerate(names)}
    hand = clean_labels(labels, subjects, most_labels).toPandas()
    hand["k"] = hand["subject"].map(number)
    texts = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    of_doc = hand.groupby("doc_id")["k"].agg(list) if len(hand) else pd.Series(dtype=object)
    single = {d: ks[0] for d, ks in of_doc.items() if len(ks) == 1}
    marked = spark.createDataFrame([(d, ks) for d, ks in of_doc.items()], f"doc_id {id_type}, hand array<int>")

    def count_labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = Counter((w, ks[0]) for t, ks in zip(pdf["text"], pdf["hand"]) if len(ks) == 1 for w in set(WORD.findall(t.lower())))
            yield pd.DataFrame([(w, k, float(n)) for (w, k), n in found.items()], columns=["word", "subject", "n"])

    schema = "word string, subject int, n double"
    labelled = texts.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    first_counts = labelled.select("text", "hand").mapInPandas(count_labelled, schema).groupBy("word", "subject").agg(F.sum("n").alias("n"))
    base = spark.createDataFrame([(k, float(n)) for k, n in Counter(single.values()).items()], "subject int, size double")
    first = cut_lineage(fit_lexicon(first_counts, base, LEAST_DOCS))
    to_decide, lexicon_of = with_lexicon(texts.select("text"), first, ("text",), most_sent)

    def count_decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: Counter = Counter()
            for t, told in zip(pdf["text"], pdf["told"]):
                lexicon = lexicon_of(told)
                for words in units_of(t):
                    k = lexicon.decide(words)
                    if k is not None:
                        found.update((w, k) for w in set(words))
            yield pd.DataFrame([(w, k, float(n)) for (w, k), n in found.items()], columns=["word", "subject", "n"])

    decided = cut_lineage(to_decide.mapInPandas(count_decided, schema).groupBy("word", "subject").agg(F.sum("n").alias("n")))
    sizes = decided.groupBy("subject").agg(F.sum("n").alias("size"))
    second = cut_lineage(fit_lexicon(decided, sizes, LEAST_SENTENCES))
    columns = ("text", "title", "source_path")
    to_vote, widened_of = with_lexicon(texts.select("doc_id", "source", *columns), second, columns, most_sent)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, title, path, source, told in zip(*(pdf[c] for c in ("doc_id", "text", "title", "source_path", "source", "told"))):
                rows += [(i, source, k, *v) for k, v in widened_of(told).votes(text, title, path).items()]
            yield pd.DataFrame(rows, columns=["doc_id", "source", "subject", "lexicon", "section", "address"])

    votes = cut_lineage(
        to_vote.mapInPandas(vote, f"doc_id {id_type}, source string, subject int, lexicon int, section int, address int")
        .join(F.broadcast(marked), "doc_id", "left")
        .withColumn("hand", F.when(F.col("hand").isNull(), 0).when(F.array_contains("hand", F.col("subject")), 2).otherwise(1))
    )
    strong = F.sum(F.when(F.col("lexicon") >= 4, 1).otherwise(0)).alias("strong")
    by_source = votes.groupBy("source", "subject").agg(strong)
    of_source = votes.groupBy("source").agg(F.sum(F.when(F.col("lexicon") >= 4, 1).otherwise(0)).alias("source_all"))
    of_subject = votes.groupBy("subject").agg(F.sum(F.when(F.col("lexicon") >= 4, 1).otherwise(0)).alias("subject_all"))
    everything = votes.agg(F.greatest(F.lit(1), F.sum(F.when(F.col("lexicon") >= 4, 1).otherwise(0))).alias("total"))
    lift = (
        by_source.join(of_source, "source")
        .join(F.broadcast(of_subject), "subject")
        .join(F.broadcast(everything))
        .withColumn("expected", F.col("source_all") * F.col("subject_all") / F.col("total"))
        .select("source", "subject", F.when(F.col("strong") >= 1.5 * F.col("expected") + 2, 2).when(F.col("strong") <= 0.5 * F.col("expected") - 2, 1).otherwise(0).alias("source_vote"))
    )
    voted = votes.join(lift, ["source", "subject"], "left").withColumn("source_vote", F.coalesce("source_vote", F.lit(0)))
    voted = voted.select("doc_id", "subject", "lexicon", "section", "address", F.col("source_vote").alias("source"), "hand")
    voted = voted.withColumns({f: F.lit(0) for f in FUNCTIONS if f not in functions})
    patterns = voted.groupBy(*FUNCTIONS).agg(F.count(F.lit(1)).alias("n")).toPandas()
    if patterns.empty:
        return spark.createDataFrame([], f"doc_id {id_type}, subject string")
    fitted = fit_latent(patterns)
    chosen = spark.createDataFrame(fitted[fitted["posterior"] >= 0.5][list(FUNCTIONS)].astype(int).values.tolist() or [], ", ".join(f"{f} int" for f in FUNCTIONS))
    spelled = spark.createDataFrame(list(enumerate(names)), "subject int, name string")
    return (
        voted.join(F.broadcast(chosen), list(FUNCTIONS), "left_semi")
        .join(F.broadcast(spelled), "subject")
        .select("doc_id", F.col("name").alias("subject"))
        .distinct()
    )
