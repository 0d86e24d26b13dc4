"""Binary files in the folder that driver and executors share.

Tasks open them by URI. ``s3a`` and ``s3n``, Spark's names for the usual object
store, are read by Arrow's own client for it; a scheme that tasks cannot open is
refused in the driver, before any work.
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

# Spark's names of a store and Arrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "abfs": "abfs", "gs": "gs", "s3": "s3", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file"}


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system that every executor reaches, and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), path
    try:
        return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
        raise ValueError(f"files in {path} cannot be opened by tasks: {e}; give a folder by another scheme") from e


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system, whatever its scheme is."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file of numbers: memory-mapped where it is a local file, read whole elsewhere."""
    if isinstance(fs, pafs.LocalFileSystem) or getattr(fs, "type_name", "") == "local":
        with open(path, "rb") as f:
            if not f.seek(0, 2):
                return np.zeros(0, kind)
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)
