"""Operators that ask a language model, given as a function from a list of prompts to a list of answers.

Prompts are built and answers are parsed by Column expressions; only the call itself runs in Python, for
batches of rows. The function is sent to the executors, so it must be picklable; a client should be made
inside it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textquarry.functions.redact import redact_secrets
from textquarry.functions.text import sanitise_input, strip
from textquarry.operators.chunking import fixed_chunks

Model = Callable[[list[str]], list[str]]
BATCH, ATTEMPTS, WAIT, FAILURES = 32, 3, 0.2, 5


def call_model(
    rows: DataFrame,
    prompt: Column,
    model: Model,
    out: str = "answer",
    accept: Callable[[str], bool] | None = None,
    batch: int = BATCH,
    attempts: int = ATTEMPTS,
    wait: float = WAIT,
    failures: int = FAILURES,
) -> DataFrame:
    """``rows`` with ``out`` and ``error``: the model's answer to each row's prompt.

    Prompts are freed of control characters. A call that fails is repeated, with a growing pause, up to
    ``attempts`` times; answers that ``accept`` turns down are asked for again as often. After ``failures``
    batches of a task that failed for good the task asks no more (its circuit is open). Null prompts are not
    asked; a row has an answer or an error, in which secrets are replaced.
    """
    asked = rows.withColumn("_prompt", sanitise_input(prompt))
    kept = len(rows.columns)
    schema = StructType([*rows.schema.fields, StructField(out, StringType()), StructField("error", StringType())])

    def once(prompts: list[str]) -> list[str]:
        for attempt in range(attempts):
            try:
                answers = list(model(prompts))
                if len(answers) != len(prompts):
                    raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
                return answers
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(wait * 2**attempt)
        return []

    def answered(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        found: list[tuple[str | None, str | None]] = [(a, None) for a in once(prompts)]
        for _ in range(attempts - 1):
            again = [k for k, (a, _) in enumerate(found) if accept and not accept(a or "")]
            if not again:
                break
            for k, a in zip(again, once([prompts[k] for k in again])):
                found[k] = (a, None)
        return [(a, None) if not accept or accept(a or "") else (None, "answer not accepted") for a, _ in found]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        broken = 0
        for b in batches:
            prompts = b.column(kept).to_pylist()
            told: list[tuple[str | None, str | None]] = [(None, None)] * len(prompts)
            full = [k for k, p in enumerate(prompts) if p is not None]
            for at in range(0, len(full), batch):
                part = full[at : at + batch]
                if broken >= failures:
                    got: list[tuple[str | None, str | None]] = [(None, "circuit open")] * len(part)
                else:
                    try:
                        got, broken = answered([prompts[k] for k in part]), 0
                    except Exception as e:
                        got, broken = [(None, f"{type(e).__name__}: {e}")] * len(part), broken + 1
                for k, x in zip(part, got):
                    told[k] = x
            columns = [*b.columns[:kept], pa.array([a for a, _ in told], pa.string()), pa.array([e for _, e in told], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:kept], out, "error"])

    return asked.mapInArrow(ask, schema).withColumn("error", redact_secrets(F.col("error")))


def _told(task: str, text: Column) -> Column:
    return F.concat(F.lit(task + "\n\n"), text)


# Prompts. Each gives null for a null text.


def summary_prompt(text: Column, words: int = 200) -> Column:
    return _told(f"Summarise the text in at most {words} words.", text)


def keywords_prompt(text: Column, n: int = 10) -> Column:
    return _told(f"Name the {n} most telling keywords of the text, separated by commas.", text)


def questions_prompt(text: Column, n: int = 5) -> Column:
    return _told(f"Ask {n} questions that the text answers, one in each line.", text)


def entities_prompt(text: Column) -> Column:
    return _told('Name the persons, organisations and places of the text as JSON: [{"label": ..., "type": ...}].', text)


def answer_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer the question from the context alone; say so if it isn't there.\n\nContext:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), question)


def variants_prompt(question: Column, n: int = 3) -> Column:
    return _told(f"Put the question in {n} other ways, one in each line.", question)


def translation_prompt(text: Column, language: Column) -> Column:
    return F.concat(F.lit("Translate into "), language, F.lit(":\n\n"), text)


def fields_prompt(text: Column, schema: str) -> Column:
    return _told(f"Give these fields of the text as one JSON object, null where it doesn't tell them: {schema}", text)


def test_prompt(text: Column) -> Column:
    return _told("Ask one question that this text alone answers, and give the answer in its words.\nQ: <question>\nA: <answer>", text)


def list_of(answer: Column) -> Column:
    """The lines or comma-separated parts of an answer, without bullets and numbers."""
    parts = F.split(answer, r"\n" + "|,")
    return F.filter(F.transform(parts, lambda p: strip(F.regexp_replace(p, r"^[ \t]*(?:[-*•]|\d+[.)])[ \t]*", ""))), lambda p: p != "")


def lines_of(answer: Column) -> Column:
    """The lines of an answer, without bullets and numbers."""
    return F.filter(F.transform(F.split(answer, "\n"), lambda p: strip(F.regexp_replace(p, r"^[ \t]*(?:[-*•]|\d+[.)])[ \t]*", ""))), lambda p: p != "")


def object_of(answer: Column, schema: str) -> Column:
    """The first JSON object of an answer as a struct; null fields where it has others."""
    return F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), schema)


def question_and_answer(answer: Column) -> dict[str, Column]:
    """Columns question and answer of lines beginning with Q and A."""
    line = lambda c: F.nullif(strip(F.regexp_extract(answer, rf"(?m)^{c}[: ]+(.*)$", 1)), F.lit(""))
    return {"question": line("Q"), "answer": line("A")}


# Operators


def call_chunked(docs: DataFrame, model: Model, task: str, size: int = 50_000, **options) -> DataFrame:
    """(doc_id, answer, error): long texts are cut, asked about part by part, and the parts' answers are put together by the model.

    An error in any part is the text's error. Null and empty texts are left out.
    """
    chunks = fixed_chunks(docs, size, 0).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    head = F.concat(F.lit("Part "), F.col("chunk_seq") + 1, F.lit(" of "), F.col("n"), F.lit(":\n\n"))
    told = call_model(chunks, _told(task, F.when(F.col("n") > 1, F.concat(head, "chunk")).otherwise(F.col("chunk"))), model, "part", **options)
    rows = told.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_seq", "part"))).alias("r"), F.min("error").alias("failed"))
    joined = F.array_join(F.transform("r", lambda x: F.concat(F.lit("--- Part "), x["chunk_seq"] + 1, F.lit(" ---\n"), F.coalesce(x["part"], F.lit("")))), "\n\n")
    prompt = F.when((F.size("r") > 1) & F.col("failed").isNull(), _told("Put these answers to the parts of one text together, each thing once.", joined))
    whole = call_model(rows, prompt, model, "merged", **options)
    return whole.select("doc_id", F.when(F.col("failed").isNull(), F.coalesce("merged", F.when(F.size("r") == 1, F.element_at("r", 1)["part"]))).alias("answer"), F.coalesce("failed", "error").alias("error"))


def extract_fields(docs: DataFrame, model: Model, schema: str, **options) -> DataFrame:
    """(doc_id, fields, error): structs of ``schema`` read from the model's JSON; an answer without JSON is asked for again."""
    import json

    def is_object(answer: str) -> bool:
        at, to = answer.find("{"), answer.rfind("}")
        try:
            return at >= 0 and isinstance(json.loads(answer[at : to + 1]), dict)
        except ValueError:
            return False

    asked = call_model(docs.where(F.length("text") > 0).select("doc_id", "text"), fields_prompt(F.col("text"), schema), model, accept=is_object, **options)
    return asked.select("doc_id", object_of(F.col("answer"), schema).alias("fields"), "error")


def model_list(docs: DataFrame, model: Model, prompt: Callable[[Column], Column], **options) -> DataFrame:
    """(doc_id, seq, item): the list that the model gives for each text (keywords, questions, other wordings)."""
    asked = call_model(docs.where(F.length("text") > 0).select("doc_id", "text"), prompt(F.col("text")), model, **options)
    return asked.where(F.col("answer").isNotNull()).select("doc_id", F.posexplode(F.array_distinct(list_of(F.col("answer")))).alias("seq", "item"))


def rerank(results: DataFrame, model: Model, k: int = 5, **options) -> DataFrame:
    """(query_id, doc_id, score, rank) of results (query_id, query, doc_id, text) by the number that the model gives from 0 to 10.

    An answer without a number counts as 0; ties go to the smaller id.
    """
    prompt = F.concat(F.lit("How well does the text answer the question, from 0 to 10?\n\nQuestion: "), "query", F.lit("\n\nText:\n"), "text")
    asked = call_model(results.select("query_id", "query", "doc_id", "text"), prompt, model, **options)
    number = F.regexp_extract("answer", r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    score = F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0)) / 10)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    scored = asked.select("query_id", "doc_id", F.round(score, 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reason(questions: DataFrame, parts: DataFrame, model: Model, **options) -> DataFrame:
    """(query_id, steps, answer): each part (query_id, part_no, part) of a question is answered, then the question from those answers."""
    told = call_model(parts.select("query_id", "part_no", "part"), _told("Answer in one sentence.", F.col("part")), model, "said", **options)
    steps = told.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("part_no", "part", "said"))).alias("steps"))
    context = F.array_join(F.transform("steps", lambda s: F.concat(s["part"], F.lit(": "), F.coalesce(s["said"], F.lit("")))), "\n")
    whole = questions.select("query_id", "query").join(steps, "query_id", "left")
    return call_model(whole, answer_prompt(F.col("query"), context), model, **options).select("query_id", F.greatest(F.size("steps"), F.lit(0)).alias("steps"), "answer")
