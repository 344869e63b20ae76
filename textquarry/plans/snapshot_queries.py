"""Queries of problem 2 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators.snapshots import snapshot_changes
from textquarry.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snapshot_changes(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "snapshots"))
    return found.select("snapshot_id", "path", "change_type")


def p2_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snapshot_changes(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "snapshots"), ("chunk_hash", "mtime"))
    return found.select("snapshot_id", "path", "change_type", F.array_join("changed_fields", ",").alias("changed_fields"))


_FILES = r"""
WITH o AS (
  SELECT id AS snapshot_id, collection, row_number() OVER w AS seq, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id
  FROM snapshots WHERE coalesce(lower(trim(tag)), '') <> 'aborted'
  WINDOW w AS (PARTITION BY collection ORDER BY created_at, id)
), r AS (
  SELECT snapshot_id, id, delivered_at,
         array_to_string(list_filter(string_split(regexp_replace(replace(trim(path), '\', '/'), '^[A-Za-z][A-Za-z0-9+.\-]+:', ''), '/'), lambda x: trim(x) <> '' AND trim(x) <> '.'), '/') AS path,
         nullif(regexp_replace(lower(trim(chunk_hash)), '^[a-z0-9_\-]+:\s*', ''), '') AS h,
         CASE WHEN abs(mtime) >= 1e11 THEN mtime / 1000.0 ELSE mtime END AS m
  FROM source_files
), l AS (
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY snapshot_id, path ORDER BY delivered_at DESC, id DESC) = 1
), f AS (
  SELECT o.collection, l.path, o.seq, o.snapshot_id, o.prev_id, o.next_id, l.h, l.m,
         o.seq - row_number() OVER (PARTITION BY o.collection, l.path ORDER BY o.seq) AS run
  FROM l JOIN o USING (snapshot_id)
), e AS (
  SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY collection, path, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k
  FROM f
), d AS (
  SELECT coalesce(n.snapshot_id, p.next_id) AS snapshot_id, coalesce(n.path, p.path) AS path,
         p.path IS NULL AS is_new, n.path IS NULL AS is_gone,
         coalesce(n.k <> p.k, false) AS hash_changed, coalesce(n.m <> p.m, false) AS mtime_changed
  FROM (SELECT * FROM e WHERE prev_id IS NOT NULL) n
  FULL JOIN (SELECT * FROM e WHERE next_id IS NOT NULL) p
    ON n.collection = p.collection AND n.path = p.path AND n.prev_id = p.snapshot_id
)
"""

P2_FOUND_SQL = _FILES + """
SELECT snapshot_id, path, CASE WHEN is_new THEN 'added' WHEN is_gone THEN 'removed' ELSE 'modified' END AS change_type
FROM d WHERE is_new OR is_gone OR hash_changed
"""

P2_FIELDS_SQL = _FILES + """
SELECT snapshot_id, path, CASE WHEN is_new THEN 'added' WHEN is_gone THEN 'removed' ELSE 'modified' END AS change_type,
       CASE WHEN is_new OR is_gone THEN '' WHEN hash_changed AND mtime_changed THEN 'chunk_hash,mtime'
            WHEN hash_changed THEN 'chunk_hash' ELSE 'mtime' END AS changed_fields
FROM d WHERE is_new OR is_gone OR hash_changed OR mtime_changed
"""

QUERIES = {"p2_found": p2_found, "p2_changed_fields": p2_changed_fields}
SQL = {"p2_found": P2_FOUND_SQL, "p2_changed_fields": P2_FIELDS_SQL}
