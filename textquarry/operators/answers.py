"""Questions answered from a corpus: hybrid retrieval, packing, an answer, and the evaluation of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import split_words
from textquarry.operators.chunking import fixed_chunks
from textquarry.operators.context import pack_by_score
from textquarry.operators.models import Model, answer_prompt, call_model, question_and_answer, test_prompt, translation_prompt
from textquarry.operators.retrieval import bm25, hashed_embeddings, linear_fusion, query_weights, vector_search


def dense_hits(docs: DataFrame, queries: DataFrame, k: int = 10, dims: int = 64) -> DataFrame:
    """(query_id, doc_id, score, rank): the nearest texts by cosine of hashed embeddings."""
    rows = hashed_embeddings(docs.select("doc_id", "text"), dims).withColumnRenamed("doc_id", "vec_id")
    asked = hashed_embeddings(queries.select(F.col("query_id").alias("doc_id"), F.col("query").alias("text")), dims)
    # ids of queries are shifted under all ids of texts, so that a query never counts as the text itself
    shifted = asked.select((-F.col("doc_id") - 1).alias("vec_id"), "embedding")
    found = vector_search(rows, shifted, k)
    return found.select((-F.col("query_id") - 1).alias("query_id"), F.col("vec_id").alias("doc_id"), "score", "rank")


def hybrid_search(docs: DataFrame, queries: DataFrame, k: int = 10, dims: int = 64) -> DataFrame:
    """(query_id, doc_id, score, rank): cosine of embeddings and BM25 as a share of its best, by the query's weights."""
    weights = queries.select("query_id", *(c.alias(n) for n, c in query_weights(F.col("query")).items()))
    return linear_fusion(dense_hits(docs, queries, k, dims), bm25(docs, queries, k), weights, k)


def best_sentence(question: Column, context: Column) -> Column:
    """The context's sentence with most words of the question; the first of equals. Null without a sentence."""
    wanted = F.array_distinct(split_words(F.lower(question)))
    parts = F.filter(F.split(context, r"(?<=[.!?])[ \t\r\n]+"), lambda s: F.length(s) > 0)
    scored = F.transform(parts, lambda s, i: F.struct(F.size(F.array_intersect(split_words(F.lower(s)), wanted)).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.array_max(scored)["s"]


def ask(docs: DataFrame, queries: DataFrame, model: Model | None = None, k: int = 5, budget: int = 2000, **options) -> DataFrame:
    """(query_id, answer, doc_ids, top_score, error): retrieval, packing and an answer for each question (query_id, query).

    The texts found are packed by score into ``budget`` tokens. Without a model the answer is the packed
    texts' sentence that shares most words with the question. A question without a text found has a null answer.
    """
    found = hybrid_search(docs, queries, k)
    texts = found.join(docs.select("doc_id", "text"), "doc_id")
    packed = pack_by_score(texts.select("query_id", F.col("doc_id").alias("chunk_id"), "score", "text"), budget)
    picked = packed.select("query_id", F.posexplode("chunk_ids").alias("place", "doc_id")).join(texts.select("query_id", "doc_id", "text"), ["query_id", "doc_id"])
    context = picked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("c"))
    top = found.groupBy("query_id").agg(F.max("score").alias("top_score"))
    whole = (
        queries.select("query_id", "query")
        .join(packed.select("query_id", F.col("chunk_ids").alias("doc_ids")), "query_id", "left")
        .join(context.select("query_id", F.array_join(F.transform("c", lambda x: x["text"]), "\n").alias("context")), "query_id", "left")
        .join(top, "query_id", "left")
    )
    if model is None:
        return whole.select("query_id", best_sentence(F.col("query"), F.col("context")).alias("answer"), "doc_ids", "top_score", F.lit(None).cast("string").alias("error"))
    asked = call_model(whole, F.when(F.col("context").isNotNull(), answer_prompt(F.col("query"), F.col("context"))), model, **options)
    return asked.select("query_id", "answer", "doc_ids", "top_score", "error")


def test_set(chunks: DataFrame, model: Model, n: int = 50, **options) -> DataFrame:
    """(chunk_id, question, answer, text): questions that single chunks (chunk_id, text) answer; ``n`` chunks, drawn by hash.

    Drawing some chunks is the feature; answers that have no line Q and A are left out.
    """
    drawn = chunks.where(F.length("text") > 0).select("chunk_id", "text").orderBy(F.md5(F.concat(F.col("chunk_id").cast("string"), "text")), "chunk_id").limit(n)
    asked = call_model(drawn, test_prompt(F.col("text")), model, "said", **options)
    made = question_and_answer(F.col("said"))
    return asked.select("chunk_id", made["question"].alias("question"), made["answer"].alias("answer"), "text").where(F.col("question").isNotNull() & F.col("answer").isNotNull())


def _words(c: Column) -> Column:
    return F.array_distinct(split_words(F.lower(F.coalesce(c, F.lit("")))))


def evaluate(tests: DataFrame, results: DataFrame) -> DataFrame:
    """(metric, mean, std, min, max, n) of results (id, answer, contexts) for tests (id, question, answer).

    answer_relevance: share of the question's words in the answer; context_precision: share of the contexts
    that hold the expected answer; faithfulness: share of the answer's words in the contexts;
    answer_similarity: Jaccard of answer and expected answer. Tests without a result are left out; an empty
    side gives 0.
    """
    x = tests.select("id", "question", F.col("answer").alias("expected")).join(results.select("id", "answer", "contexts"), "id")
    w = x.select(
        _words(F.col("question")).alias("q"), _words(F.col("expected")).alias("e"), _words(F.col("answer")).alias("a"),
        _words(F.array_join(F.coalesce("contexts", F.array().cast("array<string>")), "\n")).alias("c"), "expected", "contexts",
    )
    share = lambda part, whole: F.when(F.size(whole) > 0, F.size(F.array_intersect(part, whole)) / F.size(whole)).otherwise(F.lit(0.0))
    union = F.size(F.array_union("a", "e"))
    holds = F.size(F.filter("contexts", lambda t: F.contains(F.lower(t), F.lower(F.col("expected")))))
    rows = w.select(
        F.explode(
            F.array(
                F.struct(F.lit("answer_relevance").alias("metric"), share(F.col("a"), F.col("q")).alias("value")),
                F.struct(F.lit("context_precision").alias("metric"), F.when(F.size("contexts") > 0, F.coalesce(holds, F.lit(0)) / F.size("contexts")).otherwise(F.lit(0.0)).alias("value")),
                F.struct(F.lit("faithfulness").alias("metric"), share(F.col("c"), F.col("a")).alias("value")),
                F.struct(F.lit("answer_similarity").alias("metric"), F.when(union > 0, F.size(F.array_intersect("a", "e")) / union).otherwise(F.lit(0.0)).alias("value")),
            )
        ).alias("m")
    ).select("m.*")
    return rows.groupBy("metric").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop("value"), F.lit(0.0)), 6).alias("std"), F.round(F.min("value"), 6).alias("min"), F.round(F.max("value"), 6).alias("max"), F.count(F.lit(1)).alias("n")
    )


def routed(questions: DataFrame, routes: DataFrame, answers: DataFrame, fuse: bool = True) -> DataFrame:
    """(query_id, targets, confidence, latency_ms, cost) of a question's answers by the targets it is routed to.

    ``routes``: query_id, target; ``answers``: query_id, target, confidence, latency_ms, cost. With ``fuse`` the
    confidence is sum(c * c) / sum(c), else that of the best answer. Questions without an answer are left out.
    """
    x = questions.select("query_id").join(routes.select("query_id", "target"), "query_id").join(answers, ["query_id", "target"])
    fused = F.coalesce(F.try_divide(F.sum(F.col("confidence") * F.col("confidence")), F.sum("confidence")), F.lit(0.0))
    return x.groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"), F.round(fused if fuse else F.max("confidence"), 6).alias("confidence"),
        F.sum("latency_ms").alias("latency_ms"), F.round(F.sum("cost"), 6).alias("cost"),
    )


def index_items(docs: DataFrame) -> DataFrame:
    """(doc_id, item_type, seq, text): a text's tables (runs of pipe lines), images (mark-up with alternative text) and the text left."""
    table, image = r"(?m)((?:^\|[^\n]*\|[ \t\r]*$\n?)+)", r"!\[([^\]\n]*)\]\([^)\n]*\)"
    plain = F.regexp_replace(F.regexp_replace("text", table, ""), image, "")
    kinds = F.array(
        F.struct(F.lit("table").alias("item_type"), F.regexp_extract_all("text", F.lit(table), 1).alias("items")),
        F.struct(F.lit("image").alias("item_type"), F.regexp_extract_all("text", F.lit(image), 1).alias("items")),
        F.struct(F.lit("text").alias("item_type"), F.filter(F.array(plain), lambda t: F.length(F.trim(t)) > 0).alias("items")),
    )
    each = docs.where(F.length("text") > 0).select("doc_id", F.inline(kinds))
    return each.select("doc_id", "item_type", F.posexplode("items").alias("seq", "text"))


def item_stats(items: DataFrame) -> DataFrame:
    """(item_type, items, docs, chars) of an index."""
    return items.groupBy("item_type").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("doc_id").alias("docs"), F.sum(F.length("text")).alias("chars"))


def pages_of(chunks: DataFrame, breaks: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Chunks (id, start_index, end_index, ...) with first_page and last_page, by the texts' page breaks (id, breaks)."""
    page = lambda at: F.size(F.filter(F.coalesce("breaks", F.array().cast("array<int>")), lambda b: b <= at)) + 1
    last = F.greatest(F.col("start_index"), F.col("end_index") - 1)
    return chunks.join(breaks, id_col, "left").withColumns({"first_page": page(F.col("start_index")), "last_page": page(last)}).drop("breaks")


def chat_window(turns: DataFrame, most_turns: int = 10, budget: int = 4000) -> DataFrame:
    """The last turns (chat_id, turn_no, role, text) of each chat: at most ``most_turns``, of ``budget`` tokens together."""
    back = Window.partitionBy("chat_id").orderBy(F.desc("turn_no"))
    tokens = F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / 4))
    sized = turns.withColumns({"_r": F.row_number().over(back), "_t": F.sum(tokens).over(back.rowsBetween(Window.unboundedPreceding, 0))})
    return sized.where((F.col("_r") <= most_turns) & (F.col("_t") <= budget)).drop("_r", "_t")


def ask_translated(docs: DataFrame, queries: DataFrame, languages: DataFrame, model: Model, base: str = "en", **options) -> DataFrame:
    """(query_id, answer, doc_ids): as ``ask``, for questions in other languages than the corpus.

    ``languages``: query_id, lang. Questions not in ``base`` are translated into it, and their answers back, by
    the model; each different question is translated once.
    """
    asked = queries.select("query_id", "query").join(languages.select("query_id", "lang"), "query_id", "left").withColumn("lang", F.coalesce("lang", F.lit(base)))
    foreign = asked.where(F.col("lang") != base)
    told = call_model(foreign.select("query", "lang").distinct(), translation_prompt(F.col("query"), F.lit(base)), model, "said", **options).select("query", "lang", "said")
    turned = asked.join(told, ["query", "lang"], "left")
    found = ask(docs, turned.select("query_id", F.coalesce("said", "query").alias("query")), model, **options)
    whole = found.select("query_id", "answer", "doc_ids").join(asked.select("query_id", "lang"), "query_id")
    back = call_model(whole, F.when(F.col("lang") != base, translation_prompt(F.col("answer"), F.col("lang"))), model, "back", **options)
    return back.select("query_id", F.coalesce("back", "answer").alias("answer"), "doc_ids")


def index_documents(docs: DataFrame, path: str, size: int = 1000, overlap: int = 100, dims: int = 64) -> DataFrame:
    """The index (doc_id, chunk_seq, chunk, embedding) of texts, cut, embedded and written to ``path`` as parquet."""
    chunks = fixed_chunks(docs, size, overlap).select("doc_id", "chunk_seq", "chunk")
    keyed = chunks.select(F.struct("doc_id", "chunk_seq").alias("key"), F.col("chunk").alias("text"))
    embedded = hashed_embeddings(keyed, dims, "key").select("key.doc_id", "key.chunk_seq", "embedding")
    chunks.join(embedded, ["doc_id", "chunk_seq"], "left").write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)
