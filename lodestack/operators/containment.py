"""Texts that stand in other texts of their group, by a substring join.

Texts are classed by length: from ``q`` characters on, from twice, four times as
many, and so on. A class has grams of one size and windows of as many characters
as its shortest text; of each window the grams with the least hash are picked. A
text that stands in another brings its windows along, so what is picked of it is
picked of the longer one as well. Of each text one gram of its own class, that
which the fewest texts have, is the key; longer texts are looked up with what is
picked of them in their own and all shorter classes. Where a key is met, the
shorter text would have to begin at one place of the longer one. The ``AROUND``
characters on either side of the gram, four bits of each, leave out most of the
others; what is left is compared there.

A Bloom filter of the keys, of ``FILTER_BYTES`` at most, goes to all tasks, so
that picked grams that are nobody's key are not shuffled. So does one of the texts
that are to be compared: no others are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import packed, written

Q, LONGEST_GRAM = 8, 32
SLICE_CHARS = 1 << 17
#: The filter's parts, its size and its bits a key; with more keys it lets more through.
PARTS, FILTER_BYTES, BITS = 256, 128 << 20, 16
ROWS = "key long, row long, n int, place int, around long"
#: Characters on each side of a gram that are told by four bits.
AROUND = 8
#: Grams of several texts whose numbers are broadcast.
BROADCAST_ROWS = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slide(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """The best of each ``size`` neighbours."""
    step = 1
    while 2 * step <= size:
        x, step = best(x[:-step], x[step:]), 2 * step
    return best(x[: len(x) - size + step], x[size - step :]) if size > step else x


def _grams(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbours, never 0."""
    step = 1
    while step < size:
        by = min(step, size - step)
        x, step = x[:-by] * np.uint64(0x9E3779B97F4A7C15 + 2 * by) + x[by:], step + by
    return _mix(x) | np.uint64(1)


def _around(c: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray, gram: int) -> np.ndarray:
    """Of the characters on both sides of the grams at ``at``, 1 to 15 for each that the text has, as one number, else 0."""
    out = np.zeros(len(at), np.uint64)
    for j in range(AROUND):
        for place, has, shift in ((at - 1 - j, before > j, 4 * j), (at + gram + j, after > j, 4 * (j + AROUND))):
            told = (c[np.where(has, place, 0)] >> np.uint64(32)) % np.uint64(15) + np.uint64(1)
            out |= np.where(has, told, np.uint64(0)) << np.uint64(shift)
    return out


def picked(texts: list[str], q: int, own: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]]:
    """(class, text numbers, places from 0, hashes, what is around some) of the picked grams; of each text in its ``own`` class only, or in that and all shorter ones."""
    size = np.array([len(t) for t in texts])
    chars = _mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    text, left = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size), size) - np.arange(len(chars))
    level, least = 0, q
    while least <= size.max(initial=0):
        here = (size >= least) & (size < 2 * least) if own else size >= least
        if here.any():
            inside = here[text]
            c, t, r = chars[inside], text[inside], left[inside]
            gram = max(q, min(least // 2, LONGEST_GRAM))
            window = least - gram + 1
            h = _grams(c, gram)
            low = _slide(h, window, np.minimum)
            low[r[: len(low)] < least] = 0  # would end in the next text
            edge = np.zeros(window - 1, np.uint64)
            at = np.flatnonzero(_slide(np.concatenate((edge, low, edge)), window, np.maximum) == h)
            place, after = size[t[at]] - r[at], r[at] - gram
            yield level, t[at], place, h[at], lambda i: _around(c, at[i], place[i], after[i], gram)
        level, least = level + 1, 2 * least


def _keys(pdf: pd.DataFrame, q: int, own: bool, let: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[pd.DataFrame]:
    """Rows of ``ROWS`` for a batch of (row, salt, text); ``let``: numbers of the keys that count."""
    cut = np.cumsum(pdf["text"].str.len().to_numpy()) // SLICE_CHARS
    for _, part in pdf.groupby(cut, sort=False):
        texts, row, salt = part["text"].tolist(), part["row"].to_numpy(), part["salt"].to_numpy().astype(np.int64).view(np.uint64)
        size = part["text"].str.len().to_numpy()
        for level, t, place, h, around in picked(texts, q, own):
            key = _mix(h ^ _mix(salt[t] + np.uint64(level))).view(np.int64)
            i = np.arange(len(key)) if let is None else let(key)
            t, place = t[i], place[i]
            yield pd.DataFrame({"key": key[i], "row": row[t], "n": size[t].astype(np.int32), "place": (place + 1).astype(np.int32), "around": around(i).view(np.int64)})


def _probes(key: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of a key in its part of the filter, which has ``bits`` bits, a power of two."""
    return [((key >> np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in (0, 18, 36)]


def key_filter(keys: DataFrame) -> tuple[int, np.ndarray]:
    """(bits of a part, the parts' bytes one after the other) of a Bloom filter of ``key``; a part is made by one task."""
    wanted = max(1, keys.count()) * BITS // PARTS
    bits = min(FILTER_BYTES * 8 // PARTS, 1 << max(10, int(wanted).bit_length()))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[int, np.ndarray] = {}
        for pdf in batches:
            for part, own in pdf.groupby("part")["key"]:
                on = parts.setdefault(part, np.zeros(bits, bool))
                for at in _probes(own.to_numpy().view(np.uint64), bits):
                    on[at] = True
        for part, on in parts.items():
            yield pd.DataFrame({"part": [part], "bytes": [np.packbits(on, bitorder="little").tobytes()]})

    dealt = keys.select("key", F.shiftrightunsigned("key", 56).cast("int").alias("part")).repartition("part")
    out = np.zeros((PARTS, bits // 8), np.uint8)
    for r in dealt.mapInPandas(fill, "part int, bytes binary").collect():  # of a bounded size
        out[r.part] = np.frombuffer(r.bytes, np.uint8)
    return bits, out.ravel()


def passes(key: np.ndarray, bits: int, known: np.ndarray) -> np.ndarray:
    """Numbers of the keys that the filter lets through."""
    key = key.view(np.uint64)
    left = np.arange(len(key))
    for i in range(3):
        k = key[left]
        at = (k >> np.uint64(56)).astype(np.int64) * bits + _probes(k, bits)[i]
        left = left[(known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    return left


def _numbered(texts: DataFrame, q: int) -> DataFrame:
    """(row, grp, id, text, n), written: texts of ``q`` characters and more under a number of their own."""
    rows = texts.filter(F.col("grp").isNotNull() & (F.length("text") >= q)).select(F.monotonically_increasing_id().alias("row"), "grp", "id", "text", F.length("text").alias("n"))
    return packed(rows, "texts")


def _met(rows: DataFrame, q: int) -> DataFrame:
    """(inner, outer, size, at): row numbers of a text and a longer one that has its key, and where it would begin, from 1."""
    spark = rows.sparkSession
    salted = rows.select("row", F.xxhash64("grp").alias("salt"), "text")

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _keys(pdf, q, True)

    mine = written(salted.mapInPandas(own, ROWS), "grams")
    # Written, so that the join is shuffled by itself and Spark can split a key that many texts have.
    often = written(mine.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1"), "often")
    often = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
    # A text's grams stand one after the other: where they have not been shuffled, one row a text is.
    rarest = mine.join(often, "key", "left").groupBy("row", "n").agg(F.min(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "place", "key", "around")).alias("r"))
    keys = written(rarest.select(F.col("r.key").alias("key"), F.col("row").alias("inner"), F.col("n").alias("size"), F.col("r.place").alias("offset"), F.col("r.around").alias("own")), "keys")
    bits, known = key_filter(keys)
    shared = spark.sparkContext.broadcast(known)

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _keys(pdf, q, False, lambda key: passes(key, bits, shared.value))

    grams = salted.mapInPandas(seen, ROWS)
    fits = (F.col("n") > F.col("size")) & (F.col("place") >= F.col("offset")) & (F.col("n") - F.col("place") >= F.col("size") - F.col("offset"))
    # Four bits that are not 0 are a character that the shorter text has.
    some = reduce(lambda x, n: x.bitwiseOR(F.shiftrightunsigned("own", n)), (1, 2, 3), F.col("own")).bitwiseAND(F.lit(0x1111111111111111))
    mask = reduce(lambda x, n: x.bitwiseOR(F.shiftleft(some, n)), (1, 2, 3), some)
    alike = F.col("own").bitwiseXOR(F.col("around")).bitwiseAND(mask) == 0
    return keys.join(grams, "key").filter(fits & alike).select("inner", F.col("row").alias("outer"), "size", (F.col("place") - F.col("offset") + 1).alias("at"))


def candidates(texts: DataFrame, q: int = Q) -> DataFrame:
    """(inner, outer, size, at): numbers of texts of which the longer one has the shorter one's key; ``at``: where that would begin, from 1."""
    return _met(_numbered(texts, q), q)


def contained(texts: DataFrame, q: int = Q) -> DataFrame:
    """(grp, inner, outer): each distinct pair of texts of a group of which one stands in the other.

    ``texts``: grp, id, text, with distinct texts in a group. Texts of fewer than
    ``q`` characters are in no pair, as the inner one or the outer one.
    """
    rows = _numbered(texts, q)
    met = written(_met(rows, q), "met")
    few = packed(_only(rows, met.select(F.explode(F.array("inner", "outer")).alias("row"))), "met-texts")
    # Only the piece of the longer text goes on, not all of it.
    outer = few.select(F.col("row").alias("outer"), F.col("grp").alias("outer_grp"), F.col("id").alias("outer_id"), "text")
    pieces = met.join(outer, "outer").select("inner", "outer_grp", "outer_id", F.substring("text", F.col("at"), F.col("size")).alias("piece"))
    both = pieces.join(few.select(F.col("row").alias("inner"), "grp", "id", "text"), "inner")
    return both.filter((F.col("piece") == F.col("text")) & (F.col("grp") == F.col("outer_grp"))).select("grp", F.col("id").alias("inner"), F.col("outer_id").alias("outer")).distinct()


def _only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows that a filter of the ``wanted`` (row) lets through: all of them, and few others."""
    bits, known = key_filter(wanted.select(F.xxhash64("row").alias("key")).distinct())
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def let(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.iloc[passes(pdf.pop("key").to_numpy(), bits, shared.value)]

    return rows.withColumn("key", F.xxhash64("row")).mapInPandas(let, rows.schema)
