from datetime import datetime

import pytest
from pyspark.sql import functions as F

from textquarry.operators.snapshots import clean_hash, clean_path, snapshot_changes

FILES = "id bigint, snapshot_id bigint, path string, mtime double, chunk_hash string, chunk_count int, delivered_at timestamp, collection string, seq int"
SNAPS = "id bigint, created_at timestamp, collection string, tag string, path string"


def day(n):
    return datetime(2025, 1, n)


def files(spark, rows):
    return spark.createDataFrame([(i, s, p, m, h, 1, d, "clash", 9) for i, (s, p, m, h, d) in enumerate(rows)], FILES)


def snaps(spark, rows):
    return spark.createDataFrame([(i, d, c, t, "clash") for i, d, c, t in rows], SNAPS)


def changes(spark, f, s, fields=("chunk_hash",)):
    return {(r.snapshot_id, r.path, r.change_type, tuple(r.changed_fields)) for r in snapshot_changes(files(spark, f), snaps(spark, s), fields).collect()}


def test_added_removed_modified_with_dirt(spark):
    s = [(1, day(1), "a", None), (2, day(2), "a", "aborted"), (3, day(3), "a", "x"), (4, day(4), "a", None), (9, day(2), "b", None)]
    f = [
        (1, "./x/a.txt", 1.0, "AA", day(1)),
        (1, "gone.txt", 1.0, "bb", day(1)),
        (2, "x/never.txt", 1.0, "cc", day(2)),
        (3, "x\\a.txt", 2.0, " sha256:aa ", day(3)),  # the same hash, written otherwise
        (3, "file:///new.txt", 1.0, None, day(3)),
        (3, "new.txt", 1.0, "dd", day(2)),  # delivered before the null
        (4, "x//a.txt", 2.0, "ee", day(4)),
        (4, "x/a.txt", 2.0, "ff", day(9)),  # late, but the last
        (4, "new.txt", 1.0, "11", day(4)),
        (9, "other.txt", 1.0, "aa", day(2)),
        (None, "lost", 1.0, "aa", day(1)),
        (3, None, 1.0, "aa", day(1)),
        (3, "  ", 1.0, "aa", day(1)),
        (77, "unknown.txt", 1.0, "aa", day(1)),
    ]
    assert changes(spark, f, s) == {
        (3, "gone.txt", "removed", ()),
        (3, "new.txt", "added", ()),
        (4, "x/a.txt", "modified", ("chunk_hash",)),
    }


def test_null_hash_keeps_the_last_known_and_starts_anew(spark):
    s = [(k, day(k), "a", None) for k in range(1, 7)]
    f = [
        (1, "a", 1.0, "x", day(1)), (2, "a", 1.0, None, day(2)), (3, "a", 1.0, "x", day(3)), (4, "a", 1.0, None, day(4)), (5, "a", 1.0, "y", day(5)),
        (1, "b", 1.0, "x", day(1)), (3, "b", 1.0, None, day(3)), (4, "b", 1.0, "z", day(4)),
        (6, "z", 1.0, "x", day(6)),
    ]
    got = changes(spark, f, s)
    assert {x for x in got if x[1] == "a"} == {(5, "a", "modified", ("chunk_hash",)), (6, "a", "removed", ())}
    assert {x for x in got if x[1] == "b"} == {(2, "b", "removed", ()), (3, "b", "added", ()), (5, "b", "removed", ())}


def test_empty_snapshot_removes_all_and_fields_are_reported(spark):
    s = [(1, day(1), "a", None), (2, day(2), "a", None), (3, day(3), "a", None)]
    f = [(1, "a", 1.0, "x", day(1)), (2, "a", 2.0, "x", day(2))]
    assert changes(spark, f, s, ("chunk_hash", "mtime")) == {(2, "a", "modified", ("mtime",)), (3, "a", "removed", ())}


def test_ties_and_repeats(spark):
    s = [(1, day(1), "a", None), (2, day(2), "a", None)]
    f = [(1, "a", 1.0, "x", day(1))] * 3 + [(2, "a", 1.0, "x", day(2)), (2, "a", 1.0, "y", day(2))]
    assert changes(spark, f, s) == {(2, "a", "modified", ("chunk_hash",))}


@pytest.mark.parametrize("f,s", [([], []), ([], [(1, day(1), "a", None)]), ([(1, "a", 1.0, "x", day(1))], [])])
def test_empty_tables(spark, f, s):
    assert changes(spark, f, s) == set()


def test_clean(spark):
    rows = spark.createDataFrame([(" C:\\a\\.\\b ", "0XAB"), ("FILE://h/x", ""), (None, None), ("a b/ c", "MD5: Q")], "p string, h string")
    got = [tuple(r) for r in rows.select(clean_path(F.col("p")), clean_hash(F.col("h"))).collect()]
    assert got == [("C:/a/b", "0xab"), ("h/x", None), (None, None), ("a b/ c", "q")]
