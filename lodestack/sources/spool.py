"""A spool of records as a streaming source, and its replay.

A spool is a folder of files of JSON lines that writers only append to. The source
``spool`` reads it from where the last batch ended: an offset is, for each file, how
many bytes of whole lines are behind it. A batch has ``records`` lines at most for
each of ``tasks`` tasks (one, if not said), so a backlog is taken in portions and a
larger cluster needs fewer of them; a line without its end is left for later. Lines
that are no JSON object come as rows with ``bad`` and without values.

``replay`` runs a stream over it. Records that fail go into a file of their own at the
end of the spool and come again in a later batch; done ones are written once, bad
lines are counted. Files of a batch carry its number, and a batch that runs again
after a crash replaces them, so each record is done once whatever dies in between.

The folder must be one that driver and executors can open as files.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RECORDS = 100
FIELDS = "file string, at bigint, record string, bad boolean, tries int"


def append(folder: str, name: str, records: list[dict]) -> None:
    """Append records to a file of the spool; a line is written with its end in one call."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{name}.jsonl"), "a", encoding="utf-8") as f:
        f.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in records))
        f.flush()
        os.fsync(f.fileno())


class Piece(InputPartition):
    """The lines of a file that begin from ``start`` on and before ``end``; ``whole``: a line begins at ``start``."""

    def __init__(self, file: str, start: int, end: int, whole: bool):
        super().__init__((file, start, end, whole))
        self.file, self.start, self.end, self.whole = file, start, end, whole


class SpoolReader(DataSourceStreamReader):
    def __init__(self, folder: str, records: int, tasks: int = 1):
        self.folder, self.records, self.tasks, self.last = folder, records, tasks, None

    def _progress(self) -> str:
        return os.path.join(self.folder, ".progress")

    def _files(self) -> list[str]:
        return sorted(f for f in os.listdir(self.folder) if f.endswith((".jsonl", ".txt")) and f[0] not in "._") if os.path.isdir(self.folder) else []

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """``records`` lines for each task beyond the last planned batch, or all that there are."""
        at, left = dict(self._known()), self.records * self.tasks
        for name in self._files():
            if left <= 0:
                break
            if os.path.getsize(os.path.join(self.folder, name)) <= at.get(name, 0):
                continue
            with open(os.path.join(self.folder, name), "rb") as f:
                f.seek(at.get(name, 0))
                while left > 0 and (line := f.readline()) and line.endswith(b"\n"):
                    at[name] = at.get(name, 0) + len(line)
                    left -= 1
        return at

    def _known(self) -> dict:
        """Where the last planned batch ends: after a restart, as it was left in the folder."""
        if self.last is None:
            try:
                with open(self._progress(), encoding="utf-8") as f:
                    self.last = json.load(f)
            except (FileNotFoundError, ValueError):
                self.last = {}
        return self.last

    def _keep(self, end: dict) -> None:
        self.last = dict(end)
        draft = f"{self._progress()}.{os.getpid()}"
        with open(draft, "w", encoding="utf-8") as f:
            json.dump(self.last, f)
        os.replace(draft, self._progress())

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if os.path.isdir(self.folder):
            self._keep({k: max(v, self._known().get(k, 0)) for k, v in end.items()})
        spans = [(os.path.join(self.folder, f), start.get(f, 0), to) for f, to in sorted(end.items()) if to > start.get(f, 0)]
        step = -(-sum(to - at for _, at, to in spans) // self.tasks)  # bytes of a task
        return [Piece(f, a, min(a + step, to), a == at) for f, at, to in spans for a in range(at, to, step)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        with open(partition.file, "rb") as f:
            f.seek(partition.start if partition.whole else partition.start - 1)
            if not partition.whole:
                f.readline()  # the piece before has it
            while f.tell() < partition.end:
                at, raw = f.tell(), f.readline()
                line = raw.decode("utf-8", "replace").strip()
                try:
                    value = json.loads(line)
                except ValueError:
                    value = None
                good = isinstance(value, dict)
                tries = value.pop("__tries", 0) if good else 0
                yield os.path.basename(partition.file), at, json.dumps(value, ensure_ascii=False) if good else None, not good, tries if isinstance(tries, int) else 0

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class Spool(DataSource):
    """``spark.readStream.format("spool").option("path", ...).option("records", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return FIELDS

    def streamReader(self, schema) -> SpoolReader:
        return SpoolReader(self.options["path"], int(self.options.get("records", RECORDS)), int(self.options.get("tasks", 1)))


def stream(spark: SparkSession, folder: str, records: int = RECORDS, tasks: int = 1) -> DataFrame:
    spark.dataSource.register(Spool)
    return spark.readStream.format("spool").option("path", folder).option("records", records).option("tasks", tasks).load()


def replay(spark: SparkSession, folder: str, done: str, attempt: Callable[[DataFrame], DataFrame], checkpoint: str, records: int = RECORDS, tasks: int = 1):
    """A query, not yet started, that replays the spool at ``folder`` into ``done``.

    ``attempt``: gives the rows it is given with a boolean ``ok``; rows of ``record``
    (a JSON text) and ``tries``. ``done`` gets ``batch=<n>/`` of records that went through and
    ``counts/batch=<n>`` of (sent, kept, bad).
    """

    def batch_of(rows: DataFrame, number: int) -> None:
        seen = Observation()
        rows = rows.observe(seen, F.count_if(~F.col("bad")).alias("n"), F.count_if("bad").alias("bad"))
        tried = attempt(rows.filter("not bad").select("file", "at", "record", "tries"))
        part = f"{done}/.tried/batch={number}"
        tried.write.mode("overwrite").parquet(part)  # tried once, whatever follows
        tried = rows.sparkSession.read.schema(tried.schema).parquet(part)
        tried.filter("ok").select("record", "tries").write.mode("overwrite").parquet(f"{done}/records/batch={number}")
        failed = sorted(tried.filter("not coalesce(ok, false)").collect(), key=lambda r: (r["file"], r["at"]))  # of one batch
        kept = [dict(json.loads(r["record"]), __tries=r["tries"] + 1) for r in failed]
        # A name that sorts behind all others; the same batch writes the same file.
        target = os.path.join(folder, f"~kept-{number:012d}.jsonl")
        if kept:
            draft = f"{target}.{os.getpid()}"
            with open(draft, "w", encoding="utf-8") as f:
                f.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in kept))
                f.flush()
                os.fsync(f.fileno())
            os.replace(draft, target)
        n, bad = seen.get["n"], seen.get["bad"]
        counts = {"sent": n - len(kept), "kept": len(kept), "bad": bad}
        rows.sparkSession.range(1).select(*(F.lit(v).cast("bigint").alias(k) for k, v in counts.items())).write.mode("overwrite").parquet(f"{done}/counts/batch={number}")

    return stream(spark, folder, records, tasks).writeStream.foreachBatch(batch_of).option("checkpointLocation", checkpoint)
