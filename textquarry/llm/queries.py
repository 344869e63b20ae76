"""Queries of the problems tagged llm and, where SQL can express one, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.encoding import encode_texts
from textquarry.llm.leakage import leaked_items
from textquarry.llm.neighbours import neighbour_pairs
from textquarry.llm.pages import main_body
from textquarry.llm.pairs import pair_defects
from textquarry.llm.scans import scan_repairs
from textquarry.llm.subjects import document_subjects
from textquarry.llm.transcripts import speaker_turns, turn_md5
from textquarry.session import spread, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_body(table(spark, sf_dir, "crawl_results")).select("page_id", F.md5("block").alias("para_md5")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repairs(table(spark, sf_dir, "raw_documents")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects(table(spark, sf_dir, "fine_tune_examples"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = speaker_turns(table(spark, sf_dir, "raw_documents"))
    return found.select("document_id", "turn_no", "speaker", turn_md5(found["turn_text"]).alias("turn_md5"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(table(spark, sf_dir, "embedding_store"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "title", "source", "source_path")
    return document_subjects(spread(docs), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found}
SQL: dict[str, str] = {}
