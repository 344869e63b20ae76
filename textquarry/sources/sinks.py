"""Exports as projections to JSON, and upserts into an index table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def alpaca(examples: DataFrame) -> DataFrame:
    """(example_id, json): {instruction, input, output}; nulls as empty strings."""
    row = F.struct(_text("instruction").alias("instruction"), _text("input").alias("input"), _text("output").alias("output"))
    return examples.select("example_id", F.to_json(row).alias("json"))


def _asked() -> Column:
    return F.when(_text("input") == "", _text("instruction")).otherwise(F.concat(_text("instruction"), F.lit("\n\n"), F.col("input")))


def _turn(role_key: str, role: str, value_key: str, value: Column) -> Column:
    return F.struct(F.lit(role).alias(role_key), value.alias(value_key))


def sharegpt(examples: DataFrame) -> DataFrame:
    """(example_id, json): {conversations: [{from, value}, ...]}."""
    turns = F.array(_turn("from", "human", "value", _asked()), _turn("from", "gpt", "value", _text("output")))
    return examples.select("example_id", F.to_json(F.struct(turns.alias("conversations"))).alias("json"))


def messages(examples: DataFrame) -> DataFrame:
    """(example_id, json): {messages: [{role, content}, ...]}."""
    turns = F.array(_turn("role", "user", "content", _asked()), _turn("role", "assistant", "content", _text("output")))
    return examples.select("example_id", F.to_json(F.struct(turns.alias("messages"))).alias("json"))


def evaluation_records(items: DataFrame) -> DataFrame:
    """(item_id, json): {question, answer, contexts, ground_truth} of evaluation items."""
    row = F.struct(_text("question").alias("question"), _text("answer").alias("answer"), F.array(_text("passage")).alias("contexts"), _text("answer").alias("ground_truth"))
    return items.select("item_id", F.to_json(row).alias("json"))


def document_records(docs: DataFrame) -> DataFrame:
    """(doc_id, json): {id, content, meta} of documents, NUL characters taken out."""
    meta = F.struct(F.col("lang"), F.col("source"), F.col("title"))
    row = F.struct(F.col("doc_id").cast("string").alias("id"), F.translate(_text("text"), "\x00", "").alias("content"), meta.alias("meta"))
    return docs.select("doc_id", F.to_json(row, {"ignoreNullFields": "true"}).alias("json"))


def markdown(documents: DataFrame) -> DataFrame:
    """(document_id, markdown): title, text and pipe tables of parsed documents; short rows are padded."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def table(t: Column, i: Column) -> Column:
        width = F.size(t["columns"])
        full = F.transform(t["rows"], lambda r: line(F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(r)))), 1, F.greatest(width, F.size(r)))))
        rule = line(F.array_repeat(F.lit("---"), width))
        return F.concat(F.lit("## Table "), (i + 1).cast("string"), F.lit("\n\n"), F.array_join(F.concat(F.array(line(t["columns"]), rule), full), "\n"))

    title = F.when(F.coalesce(F.col("metadata")["title"], F.lit("")) != "", F.concat(F.lit("# "), F.col("metadata")["title"], F.lit("\n\n"))).otherwise("")
    tables = F.array_join(F.transform(F.coalesce("tables", F.array()), table), "\n\n")
    return documents.select("document_id", F.concat(title, _text("text"), F.when(F.size("tables") > 0, F.concat(F.lit("\n\n"), tables)).otherwise("")).alias("markdown"))


def contents_markdown(headings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, contents): the headings of each text as an indented list."""
    item = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), F.col("title"))
    rows = headings.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))).alias("r"))
    return rows.select(id_col, F.array_join(F.transform("r", lambda x: x["item"]), "\n").alias("contents"))


def upsert(index: DataFrame, fresh: DataFrame, key: str, at: str) -> DataFrame:
    """Rows of both with the newest ``at`` of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    both = index.unionByName(fresh, allowMissingColumns=True)
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def delete_by_source(index: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of the index whose source isn't among ``sources``."""
    return index.join(sources.select("source").distinct(), "source", "left_anti")
