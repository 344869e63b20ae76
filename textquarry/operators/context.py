"""Context packing, citations, and measures of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import ascii_terms, estimated_tokens, split_words


def pack_by_score(chunks: DataFrame, budget: int) -> DataFrame:
    """(query_id, chunks_used, total_tokens, chunk_ids): greedily by score; what doesn't fit is skipped and the next tried.

    ``chunks``: query_id, chunk_id, score, text. Skipping depends on order, so each query is one fold
    over its (top-k) list; ties of score go to the smaller chunk_id.
    """
    return _packed(chunks.withColumn("_order", F.struct((-F.col("score")).alias("s"), F.col("chunk_id").alias("c"))), budget)


def pack_round_robin(chunks: DataFrame, budget: int) -> DataFrame:
    """Like pack_by_score, in turns over the sources (column source) in the order of their first chunk."""
    by_source = Window.partitionBy("query_id", "source")
    turn = F.row_number().over(by_source.orderBy("position"))
    first = F.min("position").over(by_source)
    return _packed(chunks.withColumn("_order", F.struct(turn.alias("t"), first.alias("f"))), budget)


def _packed(ordered: DataFrame, budget: int) -> DataFrame:
    rows = ordered.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_order", "chunk_id", estimated_tokens(F.col("text")).alias("t")))).alias("rows"))
    kind = dict(ordered.dtypes)["chunk_id"]
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<{kind}>").alias("ids"))
    folded = F.aggregate(
        "rows",
        start,
        lambda a, x: F.when(a["used"] + x["t"] > budget, a).otherwise(F.struct((a["used"] + x["t"]).alias("used"), F.concat(a["ids"], F.array(x["chunk_id"])).alias("ids"))),
    )
    return rows.select("query_id", folded.alias("p")).select("query_id", F.size("p.ids").alias("chunks_used"), F.col("p.used").alias("total_tokens"), F.col("p.ids").alias("chunk_ids"))


def merge_neighbours(chunks: DataFrame, most_tokens: int = 800) -> DataFrame:
    """(query_id, parts): consecutive chunks of one source put together while their tokens stay under ``most_tokens``."""
    rows = chunks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "source", "text", estimated_tokens(F.col("text")).alias("t")))).alias("rows"))
    part = "struct<source:string,text:string,t:bigint>"
    start = F.array().cast(f"array<{part}>")

    def add(acc, x):
        one = F.struct(x["source"].alias("source"), x["text"].alias("text"), x["t"].alias("t"))
        last = F.element_at(acc, -1)
        joined = F.struct(last["source"].alias("source"), F.concat(last["text"], F.lit("\n"), x["text"]).alias("text"), (last["t"] + x["t"]).alias("t"))
        fits = (F.size(acc) > 0) & last["source"].eqNullSafe(x["source"]) & (last["t"] + x["t"] < most_tokens)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(one)))

    guarded = F.aggregate("rows", start, lambda a, x: F.when(F.size(a) == 0, F.array(F.struct(x["source"].alias("source"), x["text"].alias("text"), x["t"].alias("t")))).otherwise(add(a, x)))
    return rows.select("query_id", guarded.alias("parts"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(F.size(whole) > 0, F.round(F.size(F.array_intersect(part, whole)) / F.size(whole), 6)).otherwise(F.lit(0.0))


def answer_measures(pairs: DataFrame) -> DataFrame:
    """(id, relevance, faithfulness, jaccard) of question, context and answer by their distinct lower-case words.

    relevance: share of the question's words in the answer; faithfulness: share of the answer's words in
    the context; an empty side gives 0.
    """
    words = lambda c: F.array_distinct(split_words(F.lower(F.coalesce(F.col(c), F.lit("")))))
    w = pairs.select("id", words("question").alias("q"), words("context").alias("c"), words("answer").alias("a"))
    union = F.size(F.array_union("a", "c"))
    return w.select(
        "id",
        _share(F.col("a"), F.col("q")).alias("relevance"),
        _share(F.col("c"), F.col("a")).alias("faithfulness"),
        F.when(union > 0, F.round(F.size(F.array_intersect("a", "c")) / union, 6)).otherwise(F.lit(0.0)).alias("jaccard"),
    )


def confidence(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, confidence) from retrieved chunks (query_id, score, source, text) and answers (query_id, question, answer).

    0.3 retrieval + 0.2 source diversity + 0.2 relevance of the chunks + 0.3 faithfulness.
    """
    words = lambda c: F.array_distinct(split_words(F.lower(F.coalesce(F.col(c), F.lit("")))))
    full = chunks.join(answers.select("query_id", words("question").alias("q"), words("answer").alias("a")), "query_id").withColumn("c", words("text"))
    per = full.groupBy("query_id").agg(
        (F.avg("score") - 0.2 * (F.max("score") - F.min("score"))).alias("retrieval"),
        F.count_distinct(F.when(F.col("source") != "", F.col("source"))).alias("sources"),
        F.count(F.lit(1)).alias("n"),
        F.avg(_share(F.col("c"), F.col("q"))).alias("relevance"),
        F.array_distinct(F.flatten(F.collect_list("c"))).alias("all"),
        F.first("a").alias("a"),
    )
    diversity = F.when(F.col("sources") == 0, 0.3).otherwise(F.least(F.lit(1.0), 2 * F.col("sources") / F.col("n")))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("retrieval")))
    total = 0.3 * clipped + 0.2 * diversity + 0.2 * F.col("relevance") + 0.3 * _share(F.col("all"), F.col("a"))
    return per.select("query_id", F.round(total, 4).alias("confidence"))


def citations(claims: DataFrame, sentences: DataFrame, top: int = 3, least: float = 0.1) -> DataFrame:
    """(claim_id, sentence_id, score, rank): the best sentences for each claim by Jaccard of their word sets.

    Words meet by an equi-join, so pairs without a common word are never formed.
    """
    a = claims.select("claim_id", F.array_distinct(ascii_terms(F.col("text"))).alias("w"))
    b = sentences.select("sentence_id", F.array_distinct(ascii_terms(F.col("text"))).alias("w"))
    pairs = (
        a.select("claim_id", F.size("w").alias("n"), F.explode("w").alias("word"))
        .join(b.select("sentence_id", F.size("w").alias("m"), F.explode("w").alias("word")), "word")
        .groupBy("claim_id", "sentence_id")
        .agg(F.count(F.lit(1)).alias("both"), F.first("n").alias("n"), F.first("m").alias("m"))
        .select("claim_id", "sentence_id", F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 6).alias("score"))
        .where(F.col("score") >= least)
    )
    w = Window.partitionBy("claim_id").orderBy(F.desc("score"), "sentence_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def compressed(chunks: DataFrame, budget: int = 4000, most_tokens: int = 800) -> DataFrame:
    """(query_id, place, source, score, text): the chunks (query_id, chunk_id, position, source, score, text) within ``budget`` tokens.

    What fits stays as it is. Else neighbours of one source are put together while under ``most_tokens``; if
    that is still too much, parts are taken by score, and what doesn't fit is skipped and the next tried.
    Tokens are 1.33 a word. A merged part has the score of its first chunk; ties go to the earlier place.
    """
    words = lambda t: F.floor(F.size(split_words(t)) * 1.33).cast("bigint")
    item = F.struct("position", F.col("source"), F.col("score"), F.col("text"))
    rows = chunks.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + words(x["text"]))
    kind = "array<struct<source:string,score:double,text:string>>"
    as_part = lambda x: F.struct(x["source"].alias("source"), x["score"].cast("double").alias("score"), x["text"].alias("text"))

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["source"].alias("source"), last["score"].alias("score"), F.concat(last["text"], F.lit("\n"), x["text"]).alias("text"))
        fits = last["source"].eqNullSafe(x["source"]) & (words(last["text"]) + words(x["text"]) < most_tokens)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(as_part(x))))

    merged = F.aggregate("rows", F.array().cast(kind), lambda a, x: F.when(F.size(a) == 0, F.array(as_part(x))).otherwise(add(a, x)))
    plain = F.transform("rows", as_part)
    fitted = rows.select("query_id", F.when(total(F.col("rows")) <= budget, plain).otherwise(merged).alias("parts")).withColumn("fits", total(F.col("parts")) <= budget)
    ordered = F.array_sort(F.transform("parts", lambda x, i: F.struct((-x["score"]).alias("s"), i.alias("i"), x.alias("x"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(kind).alias("kept"))
    greedy = F.aggregate(
        ordered,
        start,
        lambda a, o: F.when(a["used"] + words(o["x"]["text"]) > budget, a).otherwise(
            F.struct((a["used"] + words(o["x"]["text"])).alias("used"), F.concat(a["kept"], F.array(o["x"])).alias("kept"))
        ),
    )["kept"]
    kept = fitted.select("query_id", F.when(F.col("fits"), F.col("parts")).otherwise(greedy).alias("parts"))
    return kept.select("query_id", F.posexplode("parts").alias("place", "p")).select("query_id", "place", "p.source", "p.score", "p.text")


def pack_with_stub(chunks: DataFrame, budget: int, least: float = 0.5, stub: int = 1000) -> DataFrame:
    """(query_id, chunk_id, score, text): all chunks that fit into ``budget`` tokens together, else those of a score of ``least`` and one stub.

    The stub has a null chunk_id, the score 0.3 and the first ``stub`` characters of the other chunks in their order.
    """
    tokens = F.sum(estimated_tokens(F.col("text"))).over(Window.partitionBy("query_id"))
    sized = chunks.select("query_id", "chunk_id", "position", "score", "text", (tokens <= budget).alias("fits"))
    kept = sized.where(F.col("fits") | (F.col("score") >= least)).select("query_id", "chunk_id", "score", "text")
    rest = sized.where(~F.col("fits") & (F.col("score") < least)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", F.substring("text", 1, stub).alias("text")))).alias("r"))
    joined = F.substring(F.array_join(F.transform("r", lambda x: x["text"]), " "), 1, stub)
    kind = dict(chunks.dtypes)["chunk_id"]
    return kept.unionByName(rest.select("query_id", F.lit(None).cast(kind).alias("chunk_id"), F.lit(0.3).alias("score"), joined.alias("text")))
