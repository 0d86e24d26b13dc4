"""Helpers shared by the operators that work on Arrow batches inside Spark tasks.

Nothing here holds more than one slice of documents (about ``SLICE_BYTES`` of
text, or one document if that is longer) at a time.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import delete_folder

SLICE_BYTES = 1 << 20
BATCH_BYTES = 2 << 20

# White space that ends a word, 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Everything but 0-9, a-z and non-ASCII ends a word of benchmark matching.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False

#: Lower-cases A-Z only, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of several texts: ``buf`` has each word followed by one space."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # word index of each text's first word, and the total at the end

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        out = np.empty(len(self), np.uint64)
        # In blocks of about a megabyte, or one word.
        cut = np.unique(np.concatenate((np.searchsorted(self.start, np.arange(0, len(self.buf), 1 << 20)), [len(self)])))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            start, end = self.start[a:b], self.end[a:b]
            place = np.arange(start[0], end[-1] + 1) - np.repeat(start, end + 1 - start)
            longest = int((end - start).max()) + 1
            power = _POWER if longest <= len(_POWER) else np.cumprod(np.full(longest, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
            value = _BYTE[self.buf[start[0] : end[-1] + 1]]
            value *= power[place]
            out[a:b] = np.add.reduceat(value, start - start[0])
        return mix(out)

    def bytes_of(self) -> bytes:
        return self.buf.tobytes()


def split_words(texts: Iterable[bytes | None], ends: np.ndarray = SPACE, lower: bool = False) -> Words:
    """Split UTF-8 texts at the bytes marked in ``ends`` (all of them ASCII)."""
    parts = [x or b"" for x in texts]
    raw = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
    if lower:
        raw = LOWER[raw]
    offset = np.cumsum([0] + [len(x) + 1 for x in parts])
    gap = ends[raw]
    after = np.empty_like(gap)  # the byte before is part of a word
    if len(gap):
        after[0] = False
        np.logical_not(gap[:-1], out=after[1:])
    begins = np.flatnonzero(~gap & ~after)
    first = np.searchsorted(begins, offset)
    keep = ~gap | after
    buf = np.where(gap, np.uint8(32), raw)[keep]
    # Inside a word no byte is 0x20: both tables end words there.
    end = np.flatnonzero(buf == 32)
    start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
    return Words(buf, start, end, first)


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice has at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, i = np.cumsum(size, dtype=np.int64), 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + limit, side="right")))
            yield batch.slice(i, j - i)
            i = j
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task shall not hold it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def append_columns(
    df: DataFrame,
    text_col: str,
    make: Callable[[pa.RecordBatch], list],
    fields: str,
    keep: list[str] | None = None,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Add the columns that ``make`` gives for each slice; no shuffle.

    ``keep``: columns of ``df`` to carry along (all by default). A carried
    column that has the name of a new one gives way to it.
    """
    bound_batches(df.sparkSession)
    new = T.StructType.fromDDL(fields)
    taken = {f.name.lower() for f in new}
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    source = df.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *new.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [f.type for f in to_arrow_schema(new)]
        for part in slices(batches, "__text", limit):
            made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, kind) for x, kind in zip(make(part), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=schema.names)

    return source.mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes as well as rows: ten thousand long texts are much for a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(name).rstrip("b"))
    except ValueError:
        return  # set by the user, with a unit
    if now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all of Spark runs on this machine (as
    in tests) is a folder of its own used; elsewhere that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file:///tmp/checkpoints/lodestack"
    return folder.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage; lost executors cost nothing that was written. The table
    stays until it is dropped.
    """
    bound_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*stashed: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for df in stashed:
        if files := df.inputFiles():
            delete_folder(df.sparkSession, files[0].rsplit("/", 1)[0])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
