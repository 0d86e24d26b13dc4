"""A spool with failures, bad lines and a crash between two batches ends with each record done once."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestack.sources import spool


def drain(query, checkpoint_of=None, batches=30):
    """Run until nothing is left; an available-now query takes what there was when it began, so kept records need another."""
    q = query.trigger(processingTime="0 seconds").start()
    try:
        for _ in range(batches * 10):
            q.processAllAvailable()
            break
    finally:
        q.stop()
    return q


def read_done(spark, done):
    rows = spark.read.parquet(f"{done}/records")
    return Counter(json.loads(r.record)["n"] for r in rows.collect()), rows


def test_replay(spark, tmp_path):
    folder, done = str(tmp_path / "spool"), str(tmp_path / "done")
    spool.append(folder, "a", [{"n": i, "q": "frage\n", "a": "é"} for i in range(25)])
    with open(f"{folder}/a.jsonl", "a") as f:
        f.write("no json\n[1, 2]\n\n")
    spool.append(folder, "b", [{"n": 100 + i} for i in range(13)])
    with open(f"{folder}/b.jsonl", "a") as f:
        f.write('{"n": 999, "half')  # a line that is still being written

    def attempt(rows):
        n = F.get_json_object("record", "$.n").cast("int")
        return rows.withColumn("ok", (n % 5 != 0) | (F.col("tries") >= 2))  # every fifth fails twice

    calls = []

    def crashing(rows):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed between two batches")
        return attempt(rows)

    first = spool.replay(spark, folder, done, crashing, str(tmp_path / "ck"), records=7)
    with pytest.raises(Exception, match="killed"):
        drain(first)
    half, _ = read_done(spark, done)
    assert 0 < sum(half.values()) < 38
    drain(spool.replay(spark, folder, done, attempt, str(tmp_path / "ck"), records=7))
    with open(f"{folder}/b.jsonl", "a") as f:
        f.write('": 1}\n')
    drain(spool.replay(spark, folder, done, attempt, str(tmp_path / "ck"), records=7))
    got, rows = read_done(spark, done)
    assert got == Counter([*range(25), *range(100, 113), 999])
    counts = spark.read.parquet(f"{done}/counts").collect()
    assert sum(r.bad for r in counts) == 3 and sum(r.sent for r in counts) == 39 and all(r.sent + r.kept + r.bad <= 7 for r in counts)
    assert sum(r.kept for r in counts) == 2 * 8  # five, five and three tens fail twice each: 0, 5, ..., 20 and 100, 105, 110


def test_empty_spool(spark, tmp_path):
    q = spool.replay(spark, str(tmp_path / "none"), str(tmp_path / "done"), lambda rows: rows.withColumn("ok", F.lit(True)), str(tmp_path / "ck"))
    drain(q)
    done = str(tmp_path / "done")
    assert not (tmp_path / "done").exists() or spark.read.parquet(f"{done}/records").count() == 0


def test_offsets(tmp_path):
    folder = str(tmp_path)
    spool.append(folder, "x", [{"n": i} for i in range(5)])
    reader = spool.SpoolReader(folder, 3)
    first = reader.latestOffset()
    assert len(list(reader.read(*reader.partitions({}, first)))) == 3
    assert spool.SpoolReader(folder, 3).latestOffset()["x.jsonl"] == (tmp_path / "x.jsonl").stat().st_size  # a new reader goes on from there


def test_tasks_share_a_batch(spark, tmp_path):
    folder = str(tmp_path / "spool")
    spool.append(folder, "x", [{"n": i, "pad": "é" * (i % 40)} for i in range(200)])
    spool.append(folder, "y", [{"n": 200 + i} for i in range(5)])
    reader = spool.SpoolReader(folder, 20, 8)
    end = reader.latestOffset()
    pieces = reader.partitions({}, end)
    read = [[json.loads(row[2])["n"] for row in reader.read(p)] for p in pieces]
    assert len(pieces) > 4 and sum(read, []) == list(range(160)) and max(map(len, read)) < 60
    later = reader.latestOffset()
    assert [json.loads(row[2])["n"] for p in reader.partitions(end, later) for row in reader.read(p)] == list(range(160, 205))

    ok = lambda rows: rows.withColumn("ok", F.get_json_object("record", "$.n").cast("int") % 7 != 0)
    other, done = str(tmp_path / "other"), str(tmp_path / "done")
    spool.append(other, "x", [{"n": i} for i in range(1, 120) if i % 7])
    drain(spool.replay(spark, other, done, ok, str(tmp_path / "ck"), records=20, tasks=8))
    assert read_done(spark, done)[0] == Counter(i for i in range(1, 120) if i % 7)
    assert len(spark.read.parquet(f"{done}/counts").collect()) == 1  # a batch of 20 lines a task, where one of 20 lines took six
