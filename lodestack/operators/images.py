"""Sizes of images, from their first bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def image_size(raw: bytes | None) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, BMP or JPEG; None for anything else."""
    if not raw:
        return None
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", raw[16:24])
        if raw[:4] == b"GIF8":
            return struct.unpack("<HH", raw[6:10])
        if raw[:2] == b"BM":
            w, h = struct.unpack("<ii", raw[18:26])
            return w, abs(h)
        at = 2
        while raw[:2] == b"\xff\xd8" and at + 9 < len(raw):
            if raw[at] != 0xFF:
                return None
            if 0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
                return w, h
            at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    except struct.error:
        pass
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def size_of(raw: pd.Series) -> pd.DataFrame:
    found = [image_size(x) or (None, None) for x in raw]
    return pd.DataFrame({"width": pd.array([w for w, _ in found], "Int32"), "height": pd.array([h for _, h in found], "Int32")})


def is_decorative(width: Column, height: Column) -> Column:
    """A side below 10 pixels, or both below 32."""
    return (F.least(width, height) < 10) | ((width < 32) & (height < 32))
