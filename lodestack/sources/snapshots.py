"""Tables that are replaced by document, one snapshot after the other.

Rows are kept in buckets by a hash of their document. A change reads and writes
the buckets that it touches only, into a folder of its own; then a manifest of the
new snapshot, which names the folder of every bucket, appears under the next number
by one rename. A reader takes the manifest of the highest number, so it sees the
table before a change or after it and nothing between. A change that dies leaves
a folder that no manifest names; ``vacuum`` deletes such folders. Two changes from
the same snapshot cannot both take the next number: the later one is refused.

Everything goes through Spark's own file system, so the table can be wherever
Spark reads. Manifests have one entry a bucket; rows never pass the driver.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another change has taken the number."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    schema: T.StructType
    folders: dict[int, str]  # bucket: folder


class SnapshotTable:
    """A table at ``path``; ``key``: the document of a row."""

    def __init__(self, spark: SparkSession, path: str, key: str = "source_stem", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        jvm = spark.sparkContext._jvm
        self._to_path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._to_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- manifests ---

    def versions(self) -> list[int]:
        folder = self._to_path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot | None:
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        text = self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).first()[0]
        m = json.loads(text)
        return Snapshot(version, T.StructType.fromJson(m["schema"]), {int(b): f for b, f in m["folders"].items()})

    def _publish(self, snapshot: Snapshot) -> None:
        """Write the manifest under a name of its own, then rename it; a name that is there is never replaced."""
        body = json.dumps({"schema": snapshot.schema.jsonValue(), "folders": {str(b): f for b, f in sorted(snapshot.folders.items())}})
        draft, final = self._to_path(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._to_path(f"{self.path}/manifests/{snapshot.version:012d}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"snapshot {snapshot.version} of {self.path} is there already")

    # --- reading ---

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest snapshot, or of an older one."""
        snap = self.snapshot(version)
        if snap is None:
            raise FileNotFoundError(f"{self.path} has no snapshot")
        return self._rows(snap, list(snap.folders))

    def _rows(self, snap: Snapshot, buckets: list[int]) -> DataFrame:
        folders = [f"{self.path}/data/{snap.folders[b]}" for b in sorted(buckets) if b in snap.folders]
        return self.spark.read.schema(snap.schema).parquet(*folders) if folders else self.spark.createDataFrame([], snap.schema)

    # --- changing ---

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def replace(self, rows: DataFrame, version: int | None = None) -> int:
        """Put in the rows' documents whole: what the table had of them goes first. Gives the snapshot's number."""
        return self._change(rows, rows.select(self.key).distinct(), [self.key], version)

    def upsert(self, rows: DataFrame, keys: list[str], version: int | None = None) -> int:
        """Put in rows, each in place of the one of its keys, which hold the document's; of equal ones any."""
        if self.key not in keys:
            raise ValueError(f"the keys must have {self.key}")
        once = rows.dropDuplicates(keys)
        return self._change(once, once.select(*keys), keys, version)

    def delete(self, documents: DataFrame, version: int | None = None) -> int:
        """Take out all rows of the documents (one column, named as the key)."""
        return self._change(None, documents.select(self.key).distinct(), [self.key], version)

    def _change(self, rows: DataFrame | None, gone: DataFrame, keys: list[str], version: int | None) -> int:
        old = self.snapshot(version)
        if old is None and rows is None:
            raise FileNotFoundError(f"{self.path} has no snapshot")
        touched = [r[0] for r in gone.select(self._bucket().alias("b")).distinct().collect()]  # as many as buckets at most
        schema = old.schema if old else rows.schema
        kept = None
        if old and any(b in old.folders for b in touched):
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
            match = same[0]
            for s in same[1:]:
                match &= s
            kept = self._rows(old, touched).alias("o").join(gone.alias("g"), match, "left_anti")
        new = None if rows is None else rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        both = new if kept is None else kept if new is None else kept.unionByName(new)
        name = f"{uuid.uuid4().hex}"
        folders = {b: f for b, f in (old.folders if old else {}).items() if b not in touched}
        if both is not None and touched:
            # A rebalance by bucket: large buckets are split over several tasks.
            spread = both.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET)
            spread.write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
            for status in self._fs.listStatus(self._to_path(f"{self.path}/data/{name}")):
                part = status.getPath().getName()
                if part.startswith(f"{BUCKET}="):
                    folders[int(part.split("=")[1])] = f"{name}/{part}"
        number = (old.version if old else 0) + 1
        self._publish(Snapshot(number, schema, folders))
        return number

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the newest ``keep`` snapshots and delete the folders that none of those names; no change may be under way. Gives the number of deleted folders."""
        known = self.versions()
        named = {f.split("/")[0] for v in known[-keep:] for f in self.snapshot(v).folders.values()}
        for v in known[:-keep]:
            self._fs.delete(self._to_path(f"{self.path}/manifests/{v:012d}.json"), False)
        data, n = self._to_path(f"{self.path}/data"), 0
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if status.getPath().getName() not in named:
                self._fs.delete(status.getPath(), True)
                n += 1
        return n
