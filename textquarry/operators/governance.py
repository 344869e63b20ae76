"""Access rules, index checks, versions and synchronisation plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import split_words


def glob_to_regex(glob: str) -> str:
    """A pattern for the whole string: * any run, ? one character."""
    special = set("\\^$.|+()[]{}")
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in glob) + "$"


def decide_access(paths: DataFrame, rules: list[tuple[str, list[str]]], roles: list[str]) -> DataFrame:
    """(path, rule, allowed): the first rule (glob, roles) that fits a path decides; no rules allow all, no fit denies."""
    rule, allowed = F.lit(None).cast("string"), F.lit(not rules)
    for glob, who in reversed(rules):
        fits = F.col("path").rlike(glob_to_regex(glob))
        rule = F.when(fits, glob).otherwise(rule)
        allowed = F.when(fits, F.lit("*" in who or bool(set(who) & set(roles)))).otherwise(allowed)
    return paths.where(F.col("path").isNotNull()).select("path", rule.alias("rule"), allowed.alias("allowed"))


def url_verdict(url: Column) -> Column:
    """ok, or why a URL isn't fetched: scheme, host, or a private address."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    private = host.rlike(r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)") | host.isin("localhost", "metadata.google.internal")
    return F.when(~F.lower(url).rlike("^https?://"), "scheme").when(host == "", "host").when(private, "private").otherwise("ok")


def is_traversal(path: Column) -> Column:
    """A path with NUL, a network prefix, or a .. part."""
    return path.contains("\x00") | path.rlike(r"^(//|\\\\)") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)")


def index_report(docs: DataFrame) -> DataFrame:
    """One row of counts: texts, empty, short (under 10 words), long (over 3000), without source or language."""
    n = F.size(split_words(F.coalesce("text", F.lit(""))))
    return docs.agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(n == 0).alias("empty"),
        F.count_if((n > 0) & (n < 10)).alias("short"),
        F.count_if(n > 3000).alias("long"),
        F.count_if(F.coalesce("source", F.lit("")) == "").alias("no_source"),
        F.count_if(F.col("lang").isNull()).alias("no_lang"),
    )


def snapshot_list(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """(snapshot_id, collection, created_at, tag, files, chunks): each snapshot with its delivered rows."""
    n = files.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"), F.sum("chunk_count").alias("chunks"))
    return snapshots.withColumnRenamed("id", "snapshot_id").join(n, "snapshot_id", "left").select(
        "snapshot_id", "collection", "created_at", "tag", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("chunks", F.lit(0)).alias("chunks")
    )


def changelog(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(collection, day, change_type, n): changes by the day of the later snapshot."""
    s = snapshots.select(F.col("id").alias("snapshot_id"), "collection", F.to_date("created_at").alias("day"))
    return changes.join(s, "snapshot_id").groupBy("collection", "day", "change_type").agg(F.count(F.lit(1)).alias("n"))


def rollback_plan(files: DataFrame, order: DataFrame) -> DataFrame:
    """(collection, path, action): from each collection's newest full snapshot back to the one before.

    delete what only the newest has, restore what only the older has, replace what has another hash.
    ``files`` are the latest rows of each snapshot (collection, path, seq, chunk_hash).
    """
    last = order.groupBy("collection").agg(F.max("seq").alias("top"))
    x = files.join(F.broadcast(last), "collection").where(F.col("seq") >= F.col("top") - 1)
    per = x.groupBy("collection", "path").agg(
        F.max(F.when(F.col("seq") == F.col("top"), F.struct(F.lit(1).alias("there"), F.col("chunk_hash").alias("h")))).alias("new"),
        F.max(F.when(F.col("seq") < F.col("top"), F.struct(F.lit(1).alias("there"), F.col("chunk_hash").alias("h")))).alias("old"),
    )
    action = F.when(F.col("old").isNull(), "delete").when(F.col("new").isNull(), "restore").when(F.col("new.h") != F.col("old.h"), "replace")
    return per.select("collection", "path", action.alias("action")).where(F.col("action").isNotNull())


def sync_plan(listing: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, action): ingest what is new or newer (path, mtime), delete what is gone."""
    both = listing.select("path", F.col("mtime").alias("m")).join(indexed.select("path", F.col("mtime").alias("i")), "path", "full_outer")
    action = F.when(F.col("i").isNull(), "ingest").when(F.col("m").isNull(), "delete").when(F.col("m") > F.col("i"), "refresh")
    return both.select("path", action.alias("action")).where(F.col("action").isNotNull())


def latest_version(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The row of each key with the greatest ``at`` (upsert)."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def copy_plan(source: DataFrame, target: DataFrame, overwrite: bool = True) -> DataFrame:
    """(path, action) to make a folder like another: copy what is missing and, with ``overwrite``, what differs (path, md5)."""
    both = source.select("path", F.col("md5").alias("a")).join(target.select("path", F.col("md5").alias("b")), "path", "left")
    action = F.when(F.col("b").isNull(), "copy").when((F.col("a") != F.col("b")) & F.lit(overwrite), "overwrite")
    return both.select("path", action.alias("action")).where(F.col("action").isNotNull())


def file_verdict(path: Column, length: Column, extensions: list[str], most: int = 500_000_000) -> Column:
    """ok, or why a file isn't read: empty, too large, or of an unknown extension."""
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(length == 0, "empty").when(length > most, "too_large").when(~kind.isin(*extensions), "extension").otherwise("ok")


def index_fixes(docs: DataFrame, live: DataFrame) -> DataFrame:
    """(doc_id, reason): texts of an index to delete: empty, short (under 10 words) or orphan (source not among ``live``)."""
    n = F.size(split_words(F.coalesce("text", F.lit(""))))
    known = live.select("source").where(F.col("source").isNotNull()).distinct().withColumn("_live", F.lit(True))
    reason = F.when(n == 0, "empty").when(n < 10, "short").when(F.col("_live").isNull(), "orphan")
    return docs.select("doc_id", "text", "source").join(known, "source", "left").select("doc_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def tenant_rows(index: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    """The rows of one tenant of an index that is written partitioned by tenant; an empty name is an error."""
    if not tenant:
        raise ValueError("a tenant must be named")
    return index.where(F.col(column) == tenant)
