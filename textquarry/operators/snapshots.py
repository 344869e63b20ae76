"""What changed between full snapshots of a table, as sums of signed cells.

Every delivered row is unpivoted into cells ``(key, field, value)`` plus one key-presence marker. A
row counts +1 in the comparison in which its snapshot is the later one and -1 in the comparison in
which it is the earlier one. Cells that did not change cancel; what is left over per key tells
whether the key was added, removed or modified, and in which fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDED, REMOVED, MODIFIED = "added", "removed", "modified"


def clean_path(path: Column) -> Column:
    """Relative path: forward slashes, no scheme, no empty or ``.`` parts, no outer blanks."""
    plain = F.regexp_replace(F.translate(F.trim(path), "\\", "/"), r"^[A-Za-z][A-Za-z0-9+.\-]+:(?=/)", "")
    parts = F.filter(F.split(plain, "/"), lambda p: (F.trim(p) != "") & (F.trim(p) != "."))
    return F.trim(F.array_join(parts, "/"))


def clean_hash(value: Column) -> Column:
    """Content hash in lower-case hex without algorithm prefix or blanks; empty counts as null."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"^[a-z0-9_\-]+:\s*", "")
    return F.when(bare == "", None).otherwise(bare)


def clean_mtime(value: Column) -> Column:
    """Epoch seconds; values that can only be milliseconds are divided by 1000."""
    return F.when(F.abs(value) >= 1e11, value / 1000.0).otherwise(value)


def snapshot_order(snapshots: DataFrame) -> DataFrame:
    """Full snapshots with their place and neighbours within the collection, by created_at, then id.

    Snapshots tagged ``aborted`` are not full; those without a collection or a time can't be ordered.
    Both are left out.
    """
    full = snapshots.where(
        (F.coalesce(F.lower(F.trim("tag")), F.lit("")) != "aborted")
        & F.col("collection").isNotNull()
        & F.col("created_at").isNotNull()
        & F.col("id").isNotNull()
    )
    w = Window.partitionBy("collection").orderBy("created_at", "id")
    return full.select(
        F.col("id").alias("snapshot_id"),
        "collection",
        F.row_number().over(w).alias("seq"),
        F.lag("id").over(w).alias("prev_id"),
        F.lead("id").over(w).alias("next_id"),
    )


def latest_files(source_files: DataFrame, order: DataFrame) -> DataFrame:
    """One row per file and full snapshot: the one delivered last (ties: the greatest id)."""
    rows = source_files.select(
        "snapshot_id",
        clean_path(F.col("path")).alias("path"),
        F.struct(
            F.col("delivered_at"),
            F.col("id"),
            clean_hash(F.col("chunk_hash")).alias("chunk_hash"),
            clean_mtime(F.col("mtime")).alias("mtime"),
        ).alias("v"),
    ).where(F.col("path").isNotNull() & (F.col("path") != "") & F.col("snapshot_id").isNotNull())
    last = rows.groupBy("snapshot_id", "path").agg(F.max("v").alias("v"))
    return last.join(order, "snapshot_id").select(
        "collection", "path", "seq", "snapshot_id", "prev_id", "next_id", "v.chunk_hash", "v.mtime"
    )


def carry_known(files: DataFrame, field: str) -> DataFrame:
    """Fill nulls of ``field`` with the last value known since the file was added.

    A file that leaves and comes back starts anew. One window over (collection, path): where the
    last known value lies before the start of the current unbroken run, it doesn't count.
    """
    w = Window.partitionBy("collection", "path").orderBy("seq")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.when(F.coalesce(F.lag("seq").over(w) + 1 != F.col("seq"), F.lit(True)), F.col("seq"))
    marked = files.withColumn("_start", starts)
    return marked.withColumns(
        {
            field: F.when(
                F.max(F.when(F.col(field).isNotNull(), F.col("seq"))).over(running) >= F.max("_start").over(running),
                F.last(field, ignorenulls=True).over(running),
            )
        }
    ).drop("_start")


def signed_cells(files: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Cells (collection, path, at, field, value, sign); field null is the key-presence marker.

    ``at`` is the later snapshot of the comparison. A null value says nothing and makes no cell.
    """
    cells = [F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"))]
    cells += [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    kept = F.filter(F.array(*cells), lambda c: c["field"].isNull() | c["value"].isNotNull())
    sides = F.filter(
        F.array(
            F.struct(F.when(F.col("prev_id").isNotNull(), F.col("snapshot_id")).alias("at"), F.lit(1).alias("sign")),
            F.struct(F.col("next_id").alias("at"), F.lit(-1).alias("sign")),
        ),
        lambda s: s["at"].isNotNull(),
    )
    both = files.select("collection", "path", F.explode(sides).alias("side"), kept.alias("cells"))
    return both.select("collection", "path", "side.at", "side.sign", F.inline("cells"))


def snapshot_changes(source_files: DataFrame, snapshots: DataFrame, fields: Sequence[str] = ("chunk_hash",)) -> DataFrame:
    """Rows (snapshot_id, path, change_type, changed_fields) for consecutive full snapshots.

    The first snapshot of a collection yields nothing; an empty one removes every path. A field is
    changed if the comparison has a value left over on both sides, so a value known on one side only
    is no change. Rows with a null or empty path, or of an unknown snapshot, are left out; repeated
    rows count once; extra columns are ignored; empty tables give an empty result.
    """
    files = latest_files(source_files, snapshot_order(snapshots))
    files = carry_known(files, "chunk_hash") if "chunk_hash" in fields else files
    left = (
        signed_cells(files, fields)
        .groupBy("collection", "path", "at", "field", "value")
        .agg(F.sum("sign").alias("s"))
        .where(F.col("s") != 0)
    )
    per_key = left.groupBy("collection", "path", "at").agg(
        F.coalesce(F.sum(F.when(F.col("field").isNull(), F.col("s"))), F.lit(0)).alias("presence"),
        F.collect_set(F.when(F.col("s") > 0, F.col("field"))).alias("plus"),
        F.collect_set(F.when(F.col("s") < 0, F.col("field"))).alias("minus"),
    )
    changed = F.array_sort(F.array_intersect("plus", "minus"))
    kind = (
        F.when(F.col("presence") > 0, ADDED)
        .when(F.col("presence") < 0, REMOVED)
        .when(F.size(changed) > 0, MODIFIED)
    )
    return per_key.select(
        F.col("at").alias("snapshot_id"),
        "path",
        kind.alias("change_type"),
        F.when(F.col("presence") == 0, changed).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
    ).where(F.col("change_type").isNotNull())
