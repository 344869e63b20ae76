"""DataFrame sources: files of any known format, sitemaps, feeds; and the work left for an index."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.sources.formats import ReadError, read_file

DOCUMENT = (
    "document_id string, source_path string, source_type string, text string, metadata map<string,string>,"
    " tables array<struct<columns:array<string>,rows:array<array<string>>>>, error_code string, error string"
)


def parse_files(files: DataFrame) -> DataFrame:
    """Documents from (path, content); files that can't be read have an error_code and no text.

    document_id is 12 hex digits of the hash of path and content, so that another run gives the same.
    """
    keyed = files.select("path", "content", F.substring(F.sha2(F.concat(F.encode("path", "UTF-8"), F.coalesce("content", F.lit(b""))), 256), 1, 12).alias("id"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data, key in zip(pdf["path"], pdf["content"], pdf["id"]):
                try:
                    r = read_file(path, bytes(data) if data is not None else None)
                    rows.append((key, path, r["source_type"], r["text"], r["metadata"], r["tables"], None, None))
                except ReadError as e:
                    rows.append((key, path, None, None, None, None, e.code, str(e)))
                except Exception as e:  # a parser of one file must not end the job
                    rows.append((key, path, None, None, None, None, "E999", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["document_id", "source_path", "source_type", "text", "metadata", "tables", "error_code", "error"])

    return keyed.mapInPandas(parse, DOCUMENT)


def load_documents(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Documents of the files under a path or URI (local, s3a, gs, abfss)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return parse_files((reader.option("pathGlobFilter", glob) if glob else reader).load(path))


def load_bytes(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    """Documents of (name, bytes) pairs; control characters are taken out of names."""
    frame = spark.createDataFrame(files or [], "path string, content binary")
    return parse_files(frame.withColumn("path", F.regexp_replace("path", r"[\x00-\x1F/\\:*?\"<>|]", "_")))


def split_errors(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents read, rejects with their code)."""
    return documents.where("error_code IS NULL").drop("error_code", "error"), documents.where("error_code IS NOT NULL").select("source_path", "error_code", "error")


def long_tables(documents: DataFrame) -> DataFrame:
    """(document_id, table_no, row_no, column, value) of all tables."""
    t = documents.select("document_id", F.posexplode("tables").alias("table_no", "t"))
    r = t.select("document_id", "table_no", F.col("t.columns").alias("c"), F.posexplode("t.rows").alias("row_no", "r"))
    return r.select("c", "document_id", "table_no", "row_no", F.posexplode("r").alias("k", "value")).select(
        "document_id", "table_no", "row_no", F.get("c", F.col("k")).alias("column"), "value"
    )


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of the url entries of sitemap files."""
    x = spark.read.format("xml").schema("loc string, lastmod string").option("rowTag", "url").load(path)
    return x.select(F.trim("loc").alias("loc"), "lastmod").where("loc <> ''").distinct()


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, summary, published) of RSS items."""
    x = spark.read.format("xml").schema("title string, link string, description string, pubDate string").option("rowTag", "item").load(path)
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", r"^[A-Za-z]+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("pubDate"))
    return x.select(F.trim("title").alias("title"), F.trim("link").alias("link"), F.col("description").alias("summary"), when.alias("published"))


def work_left(listing: DataFrame, done: DataFrame) -> DataFrame:
    """Files (path, modificationTime) not yet in ``done`` in this version."""
    return listing.join(done.select("path", "modificationTime"), ["path", "modificationTime"], "left_anti")
