"""Removal of repeated passages, by super-k-mers.

A window is ``WINDOW`` consecutive words of a document. Its minimiser is the
smallest hash of the ``MMER``-word grams in it; consecutive windows with the
same minimiser travel as one packed string (a super-k-mer) to the minimiser's
bucket. A task packs each distinct string once and sends its strings for one
bucket as one compressed row; the number of buckets grows with the text. A bucket sorts the windows of its strings, counts
them exactly (windows of equal hash are told apart by their words), and finds
the smallest document of each; windows of larger documents go back as word
ranges.

Hot minimisers: a first pass counts minimisers. Each task reports those that
hold at least 1/K of its strings, which includes all that hold 2/K of all
strings, and those that sum up to 1/K are hot, at most K of them (K is a few
times the number of shuffle partitions). A window takes a hot gram as its minimiser only
if it has no other, so contexts that share a frequent line or the edge of a
frequent passage spread over many buckets. Strings all of whose grams are hot
are copies of a few passages: they go to the bucket without their occurrences,
only with the smallest and largest document of each task, and the answers for
them are joined with the occurrences by a 128-bit digest, a join that Spark can
split.

Defined results: null text has no words; a document of fewer words than a
window loses none; a null id counts as larger than any other; rows with the
same id are judged each by their own text; repeated rows lose the same words;
windows are judged on the input, not on what is left; an empty table gives an
empty result. Columns named as an output are replaced.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import SPACE, Words, append_columns, mix, slices, split_words, stash, texts_of

WINDOW, MMER = 50, 6
#: What a task packs before it sends it: bytes of new strings, and so many for each occurrence.
FLUSH_BYTES, OCCURRENCE_BYTES = 16 << 20, 32
#: Text whose strings one bucket is to have.
BUCKET_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max
_C = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(1 << 63)


def _span_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, from spans of powers of two."""
    out, done, level, width = None, 0, h, 1
    spans = {}
    while width <= n:
        spans[width] = level
        if len(level) > width:
            level = mix(level[: len(level) - width] * _C + level[width:])
        else:
            level = level[:0]
        width *= 2
    size = max(0, len(h) - n + 1)
    for width in sorted(spans, reverse=True):
        if n & width:
            part = spans[width][done : done + size]
            out = part.copy() if out is None else mix(out * _C + part)
            done += width
    return out


def _span_min(v: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    width = 1
    while width * 2 <= n and len(v) > width:
        v = np.minimum(v[: len(v) - width], v[width:])
        width *= 2
    rest = n - width
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest and len(v) > rest else v if not rest else v[:0]


def super_kmers(w: Words, hot: np.ndarray, window: int = WINDOW, mmer: int = MMER) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, minimiser) of each run; the top bit marks hot minimisers."""
    none = np.zeros(0, np.int64)
    if len(w) < window:
        return none, none, none.astype(np.uint64)
    v = _span_hash(w.hashes(), mmer) >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
        v = np.where(hot[at] == v, v | _TOP, v)
    least = _span_min(v, window - mmer + 1)
    doc = w.doc()[: len(least)]
    ok = np.flatnonzero(np.arange(len(least)) + window <= w.first[doc + 1])
    if not len(ok):
        return none, none, none.astype(np.uint64)
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(ok) != 1) | (least[ok[1:]] != least[ok[:-1]]) | (doc[ok[1:]] != doc[ok[:-1]]))))
    return ok[cut], np.diff(np.concatenate((cut, [len(ok)]))), least[ok[cut]]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(NO_ID))).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")


def hot_minimisers(source: DataFrame, k: int, window: int, mmer: int) -> np.ndarray:
    """Minimisers that hold a large share of all super-k-mers, k at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, times, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for part in slices(batches, "text"):
            _, _, v = super_kmers(split_words(texts_of(part.column("text")), SPACE), np.zeros(0, np.uint64), window, mmer)
            total += len(v)
            own, n = np.unique(v, return_counts=True)
            both = np.concatenate((values, own))
            values, place = np.unique(both, return_inverse=True)
            times = np.bincount(place, weights=np.concatenate((times, n))).astype(np.int64)
        often = times * k >= total
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((values[often].astype(np.int64), [-1]))), pa.array(np.concatenate((times[often], [total])))], names=["v", "n"])

    sums = stash(source.mapInArrow(count, "v bigint, n bigint").groupBy("v").agg(F.sum("n").alias("n")), "dedup-minimisers")
    total = sums.filter("v = -1").agg(F.sum("n")).first()[0] or 0
    # At most k values reach a k-th of the total.
    found = sums.filter((F.col("v") >= 0) & (F.col("n") > 1) & (F.col("n") * k >= total)).select("v").limit(k).toPandas()["v"]
    return np.sort(found.to_numpy().astype(np.uint64))


class _Packer:
    """Distinct strings of one task and their occurrences, until they are sent."""

    def __init__(self, buckets: int):
        self.buckets, self.packer = buckets, zstandard.ZstdCompressor(level=3)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.bucket, self.hot, self.least, self.most = [], [], [], []
        self.occ, self.size = [], 0

    def add(self, text: bytes, v: int, doc: int, tag: int, start: int) -> None:
        if (k := self.known.get(text)) is None:
            k = self.known[text] = len(self.bucket)
            self.bucket.append(int(v) % self.buckets)
            self.hot.append(v >> 63 == 1)
            self.least.append(doc)
            self.most.append(doc)
            self.size += len(text)
        elif doc < self.least[k]:
            self.least[k] = doc
        elif doc > self.most[k]:
            self.most[k] = doc
        if not self.hot[k]:
            self.occ.append((k, doc, tag, start))
            self.size += OCCURRENCE_BYTES

    def rows(self) -> Iterator[pa.RecordBatch]:
        texts, bucket = list(self.known), np.array(self.bucket, np.int64)
        occ = np.array(self.occ, np.int64).reshape(-1, 4)
        occ = occ[np.argsort(bucket[occ[:, 0]], kind="stable")]
        edges = np.searchsorted(bucket[occ[:, 0]], np.arange(self.buckets + 1))
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        place = np.empty(len(order), np.int64)
        ids, blobs = [], []
        hot, least, most = np.array(self.hot, bool), np.array(self.least, np.int64), np.array(self.most, np.int64)
        for b in np.unique(bucket).tolist():
            own = order[ends[b] : ends[b + 1]]
            place[own] = np.arange(len(own))
            at = occ[edges[b] : edges[b + 1]]
            columns = [place[at[:, 0]].astype(np.int32), at[:, 1], at[:, 2].astype(np.uint32), at[:, 3].astype(np.int32)]
            packed = pickle.dumps((b"\n".join(texts[k] for k in own.tolist()), hot[own], least[own][hot[own]], most[own][hot[own]], columns), protocol=5)
            ids.append(b)
            blobs.append(self.packer.compress(packed))
        self.clear()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "packed"])


def _tags(texts: list[bytes | None]) -> list[int]:
    return [zlib.crc32(t or b"") for t in texts]


def _pack(source: DataFrame, hot: np.ndarray, buckets: int, window: int, mmer: int) -> DataFrame:
    shipped = source.sparkSession.sparkContext.broadcast(hot)  # bounded by a few times the number of shuffle partitions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Packer(buckets)
        for part in slices(batches, "text"):
            texts, ids = texts_of(part.column("text")), part.column("id").to_pylist()
            w, tags = split_words(texts, SPACE), _tags(texts)
            i, n, v = super_kmers(w, shipped.value, window, mmer)
            buf, doc = w.bytes_of(), np.searchsorted(w.first, i, side="right") - 1
            a, b = w.start[i], w.end[i + n + window - 2]
            for d, x, y, m, s in zip(doc.tolist(), a.tolist(), b.tolist(), v.tolist(), (i - w.first[doc]).tolist(), strict=True):
                out.add(buf[x:y], m, ids[d], tags[d], s)
            if out.size > FLUSH_BYTES:
                yield from out.rows()
        if out.known:
            yield from out.rows()

    return source.mapInArrow(run, "bucket int, packed binary")


FOUND = "id bigint, tag bigint, start int, end int, key binary, least array<bigint>"


def _count_bucket(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        least, most, hot, occs = [], [], [], []
        unpack = zstandard.ZstdDecompressor()
        for blob in pdf["packed"]:
            text, is_hot, low, high, occ = pickle.loads(unpack.decompress(blob))
            place = np.empty(len(is_hot), np.int64)
            ends = iter(zip(low.tolist(), high.tolist(), strict=True))
            for j, (x, q) in enumerate(zip(text.split(b"\n"), is_hot.tolist(), strict=True)):
                if (k := known.get(x)) is None:
                    k = known[x] = len(hot)
                    hot.append(q)
                    least.append(NO_ID)
                    most.append(-NO_ID)
                place[j] = k
                if q:
                    a, b = next(ends)
                    least[k], most[k] = min(least[k], a), max(most[k], b)
            occs.append([place[occ[0]], *occ[1:]])
        u, doc, tag, start = (np.concatenate([o[c] for o in occs]).astype(np.int64) for c in range(4))
        texts = list(known)
        known.clear()
        low, high, hot_ = np.array(least), np.array(most), np.array(hot)
        np.minimum.at(low, u, doc)
        np.maximum.at(high, u, doc)
        w = split_words(texts, SPACE)
        owner = w.doc()
        at = np.arange(len(w) - window + 1)
        at = at[at + window <= w.first[owner[: len(at)] + 1]]
        # Sort the windows; those of equal hash are compared by their words.
        key = _span_hash(w.hashes(), window)[at]
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        buf, extra = w.bytes_of(), int(group[-1]) + 1
        seen: dict[tuple[int, bytes], int] = {}
        firsts: set[int] = set()
        for j in np.flatnonzero(size[group] > 1).tolist():
            i = at[order[j]]
            g = int(group[j])
            mark = (g, buf[w.start[i] : w.end[i + window - 1]])
            if (same := seen.get(mark)) is None:
                if g in firsts:
                    same, extra = extra, extra + 1
                else:
                    same = g
                    firsts.add(g)
                seen[mark] = same
            group[j] = same
        seen.clear()
        mine = owner[at[order]]
        floor, ceil = np.full(extra, NO_ID), np.full(extra, -NO_ID)
        np.minimum.at(floor, group, low[mine])
        np.maximum.at(ceil, group, high[mine])
        smallest, shared = np.empty(len(at), np.int64), np.empty(len(at), bool)
        smallest[order], shared[order] = floor[group], (floor < ceil)[group]
        own = owner[at]
        begin = np.searchsorted(own, np.arange(len(texts) + 1))
        some = np.zeros(len(texts), bool)
        some[own[shared]] = True
        out = []
        for k in np.flatnonzero(some & hot_).tolist():
            out.append((None, None, None, None, hashlib.blake2b(texts[k], digest_size=16).digest(), smallest[begin[k] : begin[k + 1]].tolist()))
        # Ranges of the windows that a smaller document has, for every occurrence.
        pick = np.flatnonzero(some[u] & ~hot_[u])
        for k, d, t, s in zip(u[pick].tolist(), doc[pick].tolist(), tag[pick].tolist(), start[pick].tolist(), strict=True):
            out += [(d, t, s + a, s + b + window - 1, None, None) for a, b in runs(smallest[begin[k] : begin[k + 1]] < d)]
        frame = pd.DataFrame(out, columns=["id", "tag", "start", "end", "key", "least"])
        return frame.astype({"id": "Int64", "tag": "Int64", "start": "Int32", "end": "Int32"})

    return run


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first, after the last) of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _hot_occurrences(source: DataFrame, hot: np.ndarray, window: int, mmer: int) -> DataFrame:
    shipped = source.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts, ids = texts_of(part.column("text")), part.column("id").to_pylist()
            w, tags = split_words(texts, SPACE), _tags(texts)
            i, n, v = super_kmers(w, shipped.value, window, mmer)
            keep = v >= _TOP
            i, n = i[keep], n[keep]
            buf, doc = w.bytes_of(), np.searchsorted(w.first, i, side="right") - 1
            keys = [hashlib.blake2b(buf[a:b], digest_size=16).digest() for a, b in zip(w.start[i].tolist(), w.end[i + n + window - 2].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([ids[d] for d in doc.tolist()], pa.int64()), pa.array([tags[d] for d in doc.tolist()], pa.int64()), pa.array((i - w.first[doc]).astype(np.int32))],
                names=["key", "id", "tag", "start"],
            )

    return source.mapInArrow(run, "key binary, id bigint, tag bigint, start int")


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mmer: int = MMER) -> DataFrame:
    """(id, tag, ranges): word ranges that a document with a smaller id has too; tag is the text's crc32."""
    spark, source = docs.sparkSession, _source(docs, id_col, text_col)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(6 * partitions, -(-size // BUCKET_BYTES))
    # A string that is not hot is less than a bucket's share.
    hot = hot_minimisers(source, max(24 * partitions, buckets), window, mmer)
    packed = _pack(source, hot, buckets, window, mmer)
    found = packed.groupBy("bucket").applyInPandas(_count_bucket(window), FOUND)
    if len(hot):
        found = stash(found, "dedup-found")
        answers = found.filter("key is not null").select("key", "least")
        joined = _hot_occurrences(source, hot, window, mmer).join(answers, "key")
        # Runs of windows that a smaller document has, in words.
        late = F.filter(F.sequence(F.lit(1), F.size("least")), lambda i: F.element_at("least", i) < F.col("id"))
        words = F.transform(_joined_runs("late"), lambda r: F.struct((F.col("start") + r["a"] - 1).alias("start"), (F.col("start") + r["b"] + window - 1).alias("end")))
        hot_ranges = joined.withColumn("late", late).filter("size(late) > 0").select("id", "tag", F.explode(words).alias("r"))
        found = found.filter("key is null").select("id", "tag", F.struct("start", "end").alias("r")).unionByName(hot_ranges)
    else:
        found = found.select("id", "tag", F.struct("start", "end").alias("r"))
    # As a set: rows with the same id and text have the same ranges.
    return found.groupBy("id", "tag").agg(F.collect_set("r").alias("ranges"))


def _joined_runs(col: str):
    """Runs (a, b) of consecutive numbers in a sorted array."""
    start = F.array().cast("array<struct<a:int,b:int>>")

    def step(acc, i):
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), i.alias("b"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] == i - 1), longer).otherwise(F.concat(acc, F.array(F.struct(i.alias("a"), i.alias("b")))))

    return F.aggregate(col, start, step)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mmer: int = MMER, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_words``, ``removed_spans`` (word ranges) and ``kept_text`` (the other words, joined by one space)."""
    ranges = repeated_ranges(docs, id_col, text_col, window, mmer).withColumnsRenamed({"id": "__id", "tag": "__tag", "ranges": "__ranges"})
    cols = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_words", "removed_spans", "kept_text")]
    own = docs.select(*dict.fromkeys([*cols, text_col])).withColumn("__row", F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(NO_ID)))).withColumn("__crc", F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    both = own.join(ranges, (F.col("__row") == F.col("__id")) & (F.col("__crc") == F.col("__tag")), "left").drop("__row", "__crc", "__id", "__tag")

    def run(batch: pa.RecordBatch) -> list:
        w = split_words(texts_of(batch.column("__text")), SPACE)
        edge = np.zeros(len(w) + 1, np.int64)
        own = batch.column("__ranges")
        spans = []
        for d, found in enumerate(own.to_pylist()):
            for r in found or []:
                edge[w.first[d] + r["start"]] += 1
                edge[w.first[d] + r["end"]] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        for d, n in enumerate(w.counts().tolist()):
            a = int(w.first[d])
            spans.append([{"start": x, "end": y} for x, y in runs(gone[a : a + n])] if own[d].is_valid else [])
        left = w.buf[np.repeat(~gone, w.end - w.start + 1)].tobytes()
        ends = np.concatenate(([0], np.cumsum(np.where(gone, 0, w.end - w.start + 1))))[w.first]
        kept = [left[a : b - 1].decode() if b > a else "" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return [w.counts(), spans, kept]

    out = append_columns(both, text_col, run, "n_words bigint, removed_spans array<struct<start:int,end:int>>, kept_text string", keep=[*cols, "__ranges"])
    return out.drop("__ranges")


def digest(done: DataFrame) -> DataFrame:
    """The digest columns of query op1."""
    removed = F.aggregate("removed_spans", F.lit(0).cast("bigint"), lambda a, x: a + (x["end"] - x["start"]))
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(deduplicate(docs, keep=["doc_id"]))


def brute_force(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """(id, words, removed words, digest of the rest) with a table of all windows; for tests."""
    import re

    words = [(i if i is not None else int(NO_ID), re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    least: dict[tuple, int] = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, i), i)
    out = []
    for (i, w), (raw, _) in zip(words, docs):
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((raw, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
