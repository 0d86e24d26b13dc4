"""Snapshot tables: commits, readers beside them, conflicts, and a change that dies."""

import pytest
from pyspark.sql import functions as F

from lodestack.sources import snapshots

FIELDS = "source_stem string, chunk_id string, v int"


def rows(spark, *r):
    return spark.createDataFrame(list(r), FIELDS)


def have(table, version=None):
    return sorted((r.source_stem, r.chunk_id, r.v) for r in table.read(version).collect())


@pytest.fixture
def table(spark, tmp_path):
    t = snapshots.SnapshotTable(spark, f"file://{tmp_path}/t", buckets=8)
    t.replace(rows(spark, *[(f"s{i}", f"s{i}_{j}", 1) for i in range(12) for j in range(3)]))
    return t


def test_replace_upsert_delete(spark, table):
    assert table.versions() == [1] and len(have(table)) == 36
    assert table.replace(rows(spark, ("s3", "new", 2), ("s99", "x", 2))) == 2
    assert [r for r in have(table) if r[0] in ("s3", "s99")] == [("s3", "new", 2), ("s99", "x", 2)] and len(have(table)) == 35
    table.upsert(rows(spark, ("s4", "s4_0", 7), ("s4", "more", 7)), ["source_stem", "chunk_id"])
    assert [r for r in have(table) if r[0] == "s4"] == [("s4", "more", 7), ("s4", "s4_0", 7), ("s4", "s4_1", 1), ("s4", "s4_2", 1)]
    table.delete(spark.createDataFrame([("s99",), ("nothing",)], "source_stem string"))
    assert not [r for r in have(table) if r[0] == "s99"]
    assert len(have(table, 1)) == 36 and len(have(table, 2)) == 35  # older snapshots stay as they were
    for i in range(12):
        table.delete(spark.createDataFrame([(f"s{i}",)], "source_stem string"))
    assert have(table) == []
    with pytest.raises(ValueError, match="keys"):
        table.upsert(rows(spark, ("a", "b", 1)), ["chunk_id"])


def test_only_touched_buckets_are_written(spark, table):
    before = table.snapshot().folders
    table.replace(rows(spark, ("s3", "new", 2)))
    after = table.snapshot().folders
    assert sum(before[b] != after[b] for b in before) == 1


def test_null_document(spark, table):
    table.replace(rows(spark, (None, "a", 1)))
    table.replace(rows(spark, (None, "b", 2)))
    assert [r for r in table.read().filter("source_stem is null").collect()] == [(None, "b", 2)]


def test_a_change_that_dies(spark, table, tmp_path, monkeypatch):
    """It writes its folder and is killed before the manifest: readers see the old snapshot, the next change succeeds, the folder goes."""

    def killed(*_):
        raise KeyboardInterrupt

    want = have(table)
    with monkeypatch.context() as m:
        m.setattr(snapshots.SnapshotTable, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            table.replace(rows(spark, ("s3", "lost", 9)))
    assert have(table) == want and table.versions() == [1]

    bad = rows(spark, ("s3", "lost", 9)).withColumn("v", F.raise_error(F.lit("task failed")).cast("int"))
    with pytest.raises(Exception, match="task failed"):
        table.replace(bad)
    assert have(table) == want
    table.replace(rows(spark, ("s3", "new", 2)))
    n = len(list((tmp_path / "t/data").iterdir()))
    assert table.vacuum(keep=2) >= 1 and len(list((tmp_path / "t/data").iterdir())) < n
    assert ("s3", "new", 2) in have(table) and have(table, 1) == want


def test_conflict(spark, table):
    """Two changes from one snapshot: the second is refused and changes nothing."""
    table.replace(rows(spark, ("s1", "first", 2)), version=1)
    want = have(table)
    with pytest.raises(snapshots.Conflict):
        table.replace(rows(spark, ("s2", "second", 2)), version=1)
    assert have(table) == want and table.versions() == [1, 2]


def test_a_reader_keeps_its_snapshot(spark, table):
    reading = table.read()
    table.replace(rows(spark, ("s1", "later", 2)))
    assert reading.count() == 36


def test_no_table(spark, tmp_path):
    t = snapshots.SnapshotTable(spark, f"file://{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        t.read()
    with pytest.raises(FileNotFoundError):
        t.delete(spark.createDataFrame([("a",)], "source_stem string"))
    t.replace(rows(spark))
    assert have(t) == []
