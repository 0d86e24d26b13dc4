"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` deals the training documents into shards of about a megabyte and
stores one row for each: the sorted terms of the shard, and for every term the
list of its word positions. A frequent term's list is thereby split over all
shards that have it, and no posting is shuffled. ``prepare`` does the same for
the benchmark: its windows, numbered by their terms, in written blocks.

Searching, a task holds one shard and one block at a time. In a shard, a window
whose rarest benchmark term is there, and all its others, takes the list of its
term that is rarest in the shard, shifts it by the term's offset, and intersects
it with the shifted lists of the other terms from rare to frequent: what is left
are the exact phrase matches. A proximity match has all terms of the window, in
any order, within ``slop`` words more than the window has; lists are intersected
around the places of the rarest term first.

Words: A-Z lower-cased, then runs of ``0-9a-z`` and non-ASCII characters.
A window has ``width`` consecutive words of one benchmark item; an item with
fewer words, but not none, is one window.

Defined results: null or empty text has no words and no hits; a null item text
or id has no windows; repeated rows are judged each by itself; an empty benchmark
marks nothing; documents of any length are searched whole. A column named as
an output is replaced by it.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import NOT_ALNUM, bound_batches, give_back, slices, split_words, stash, texts_of
from .files import open_folder

WIDTH = 10
#: Words by which a proximity match may be longer than its window.
SLOP = 5
#: Benchmark text of one block, the most that a task holds at once (or one item).
BLOCK_BYTES = 4 << 20


@dataclass
class Queries:
    """Windows of one block of the benchmark, by the place of their terms in ``terms``."""

    terms: np.ndarray  # sorted hashes
    items: list[str]
    term: np.ndarray  # windows x width, -1 beyond a short window; ordered by the block's rarest term
    lead: np.ndarray  # first window of each term's windows, and their number at the end
    first: np.ndarray  # of each window in ``owner``, and the total at the end
    owner: np.ndarray  # items of the windows

    @property
    def width(self) -> np.ndarray:
        return (self.term >= 0).sum(1)


def make_queries(ids: list, texts: list[bytes | None], width: int = WIDTH) -> Queries:
    words = split_words(texts, NOT_ALNUM, lower=True)
    terms, place, times = np.unique(words.hashes(), return_inverse=True, return_counts=True)
    count = words.counts()
    n = np.where(count > 0, np.maximum(count - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), n)
    start = np.repeat(words.first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    offset = np.arange(width)
    short = offset >= count[owner][:, None]
    term = np.where(short, -1, place[np.minimum(start[:, None] + offset, max(0, len(place) - 1))] if len(place) else -1).astype(np.int32).reshape(-1, width)
    # Equal windows of several items are one; first those that are led by the same rarest term.
    lead = np.where(term >= 0, times[term] if len(times) else 0, np.iinfo(np.int64).max).argmin(1) if len(term) else np.zeros(0, np.int64)
    lead = term[np.arange(len(term)), lead]
    order = np.lexsort((owner, *term.T[::-1], lead)) if len(term) else np.zeros(0, np.int64)
    term, owner, lead = term[order], owner[order], lead[order]
    new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]).any(1)))) if len(term) else np.zeros(0, np.int64)
    return Queries(terms, [str(i) for i in ids], term[new], np.searchsorted(lead[new], np.arange(len(terms) + 1)), np.concatenate((new, [len(owner)])), owner.astype(np.int32))


@dataclass
class Shard:
    """Positional postings of some documents."""

    terms: np.ndarray  # sorted hashes
    begin: np.ndarray  # start of each term's list in ``where``, and the total at the end
    where: np.ndarray  # word positions, by term and then in order
    first: np.ndarray  # word position of each document's first word, and the total at the end


def make_shard(texts: list[bytes | None]) -> Shard:
    words = split_words(texts, NOT_ALNUM, lower=True)
    h = words.hashes()
    where = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], h[where][1:] != h[where][:-1]))) if len(h) else np.zeros(0, np.int64)
    return Shard(h[where][new], np.concatenate((new, [len(h)])), where, words.first)


def pack(*x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def pack_shard(s: Shard) -> bytes:
    """Lists as distances from one position to the next, a byte plane each."""
    step = np.diff(s.where, prepend=0).astype(np.int32)
    return pack(s.terms, s.begin.astype(np.int32), np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T), s.first)


def unpack_shard(blob: bytes) -> Shard:
    terms, begin, planes, first = unpack(blob)
    return Shard(terms, begin.astype(np.int64), np.cumsum(np.ascontiguousarray(planes.T).view(np.int32).ravel(), dtype=np.int64), first)


def find_windows(s: Shard, q: Queries, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, position of its start) of every phrase match, (window, position of its rarest term) of every proximity match."""
    none = np.zeros(0, np.int64)
    total = int(s.first[-1])
    if not len(q.term) or not total:
        return none, none, none, none
    at = np.minimum(np.searchsorted(s.terms, q.terms), len(s.terms) - 1)
    local = np.where(s.terms[at] == q.terms, at, -1)
    leads = np.flatnonzero(local >= 0)
    n = q.lead[leads + 1] - q.lead[leads]
    win = np.repeat(q.lead[leads], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    for k in range(q.term.shape[1]):
        win = win[(q.term[win, k] < 0) | (local[q.term[win, k]] >= 0)]
    if not len(win):
        return none, none, none, none
    term = np.where(q.term[win] >= 0, local[q.term[win]], -1)
    size = np.diff(s.begin)
    order = np.argsort(np.where(term >= 0, size[term], total + 1), axis=1, kind="stable")  # offsets, rarest term first
    rare = term[np.arange(len(win)), order[:, 0]]
    n = size[rare]
    row = np.repeat(np.arange(len(win)), n)
    anchor = s.where[np.repeat(s.begin[rare], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    doc = np.searchsorted(s.first, anchor, side="right") - 1
    # All lists in one: term and position as one sorted number.
    lists = np.repeat(np.arange(len(size)), size) * total + s.where

    def next_at(t: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first entry from ``least`` on in the list of each term ``t``, as a position; beyond the end if there is none."""
        found = lists[np.minimum(np.searchsorted(lists, t * total + least), len(lists) - 1)] - t * total
        return np.where((found >= least) & (found < total), found, total)

    wide = (term >= 0).sum(1)
    start = anchor - order[row, 0]
    live = np.flatnonzero((start >= s.first[doc]) & (start + wide[row] <= s.first[doc + 1]))
    r, begin = row[live], start[live]
    for k in range(1, term.shape[1]):
        off = order[r, k]
        t = term[r, off]
        ok = (t < 0) | (next_at(np.maximum(t, 0), begin + off) == begin + off)
        r, begin = r[ok], begin[ok]

    # Proximity: a cover of all terms around the anchor, first coarsely, then from each term's last place before it.
    reach = wide[row] + slop
    low, high = np.maximum(anchor - reach + 1, s.first[doc]), np.minimum(anchor + reach, s.first[doc + 1])
    for k in range(1, term.shape[1]):
        t = term[row, order[row, k]]
        ok = (t < 0) | (next_at(np.maximum(t, 0), low) < high)
        row, anchor, doc, low, high, reach = (x[ok] for x in (row, anchor, doc, low, high, reach))
    near = np.zeros(len(row), bool)
    for j in range(term.shape[1]):
        t = term[row, order[row, j]]
        place = np.searchsorted(lists, np.maximum(t, 0) * total + anchor, side="right") - 1
        p = lists[np.maximum(place, 0)] - np.maximum(t, 0) * total
        open_ = np.flatnonzero(~near & (t >= 0) & (place >= 0) & (p >= low))
        for k in range(term.shape[1]):
            t = term[row[open_], k]
            open_ = open_[(t < 0) | (next_at(np.maximum(t, 0), p[open_]) < np.minimum(p[open_] + reach[open_], s.first[doc[open_] + 1]))]
        near[open_] = True
    return win[r], begin, win[row[near]], anchor[near]


def _ranges(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Ranges joined where they touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[new].tolist(), end[np.concatenate((new[1:] - 1, [len(end) - 1]))].tolist(), strict=True))


def build_index(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The stored index: for each shard its documents' ``keep`` columns, in order, and its packed postings."""
    bound_batches(docs.sparkSession)
    cols = docs.columns if keep is None else keep
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("rows", T.ArrayType(source.schema["row"].dataType)), T.StructField("postings", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            row = part.column("row")
            whole = pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row)
            yield pa.RecordBatch.from_arrays([whole, pa.array([pack_shard(make_shard(texts_of(part.column("text"))))], pa.binary())], names=["rows", "postings"])

    return stash(source.mapInArrow(run, schema), "decon-index")


def prepare(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The benchmark's windows in written blocks."""
    source = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text is not null and id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for part in slices(batches, "text", block_bytes):
            own = texts_of(part.column("text"))
            if texts and size + sum(map(len, own)) > block_bytes:
                yield _block(ids, texts, width)
                ids, texts, size = [], [], 0
            ids, texts, size = ids + part.column("id").to_pylist(), texts + own, size + sum(map(len, own))
        if texts:
            yield _block(ids, texts, width)

    return stash(source.mapInArrow(run, "block binary"), "decon-queries")


def _block(ids: list, texts: list[bytes], width: int) -> pa.RecordBatch:
    q = make_queries(ids, texts, width)
    return pa.RecordBatch.from_arrays([pa.array([pack(q.terms, q.items, q.term, q.lead, q.first, q.owner)], pa.binary())], names=["block"])


class _Blocks:
    """The written blocks, one at a time; a benchmark of one block is read once for each task."""

    def __init__(self, files: list[str]):
        self.files, self.last = files, (None, None)

    def __iter__(self) -> Iterator[Queries]:
        for name in self.files:
            fs, path = open_folder(name)
            with fs.open_input_file(path) as f:
                file = pq.ParquetFile(f)
                for g in range(file.num_row_groups):
                    for k in range(file.metadata.row_group(g).num_rows):
                        if self.last[0] != (name, g, k):
                            blob = file.read_row_group(g).column("block")[k].as_py()
                            self.last = (name, g, k), Queries(*unpack(blob))
                        yield self.last[1]


#: Packed postings of the shards that meet the blocks of the benchmark in one pass.
HELD_BYTES = 8 << 20


class _Shard:
    """A shard and what has been found in it so far."""

    def __init__(self, rows: pa.StructArray, packed: bytes):
        n = len(rows)
        self.rows, self.index = rows, unpack_shard(packed)
        self.starts, self.ends, self.items, self.near = [[] for _ in range(n)], [[] for _ in range(n)], [set() for _ in range(n)], [set() for _ in range(n)]

    def search(self, q: Queries, slop: int) -> None:
        first = self.index.first
        win, at, win2, at2 = find_windows(self.index, q, slop)
        for d, own in _by_doc(np.searchsorted(first, at, side="right") - 1):
            a = at[own] - first[d]
            self.starts[d].append(a)
            self.ends[d].append(a + q.width[win[own]])
            self.items[d].update(_owners(q, win[own]))
        for d, own in _by_doc(np.searchsorted(first, at2, side="right") - 1):
            self.near[d].update(_owners(q, win2[own]))

    def found(self) -> list:
        spans = [[{"start": a, "end": b} for a, b in _ranges(np.concatenate(x), np.concatenate(y))] if x else [] for x, y in zip(self.starts, self.ends)]
        return [np.diff(self.index.first), spans, [sorted(x) for x in self.items], [sorted(x) for x in self.near]]


FIELDS = "decon_words bigint, decon_spans array<struct<start:int,end:int>>, decon_items array<string>, decon_near array<string>"


def search(index: DataFrame, queries: DataFrame, slop: int = SLOP) -> DataFrame:
    """One row for each document of ``index``: its columns, ``decon_words`` (its word
    count), ``decon_spans`` (word ranges covered by phrase matches), ``decon_items``
    (items with a phrase match) and ``decon_near`` (items with a proximity match).
    """
    files = sorted(queries.inputFiles())  # names only
    new = T.StructType.fromDDL(FIELDS)
    taken = {f.name.lower() for f in new}
    carried = [f for f in index.schema["rows"].dataType.elementType if f.name.lower() not in taken]
    schema = T.StructType([*carried, *new])
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [f.type for f in to_arrow_schema(new)]
        blocks, held, size = _Blocks(files), [], 0

        def searched() -> Iterator[pa.RecordBatch]:
            for q in blocks:
                for shard in held:
                    shard.search(q, slop)
            for shard in held:
                made = shard.found()
                yield pa.RecordBatch.from_arrays([*[shard.rows.field(f.name) for f in carried], *[pa.array(x, kind) for x, kind in zip(made, kinds)]], names=schema.names)

        for batch in batches:
            for i in range(batch.num_rows):
                packed = batch.column("postings")[i].as_py()
                held.append(_Shard(batch.column("rows")[i].values, packed))
                size += len(packed)
                if size >= HELD_BYTES:
                    yield from searched()
                    held, size = [], 0
        yield from searched()
        give_back()

    return index.mapInArrow(run, schema)


def _by_doc(doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(doc, kind="stable")
    names, first = np.unique(doc[order], return_index=True)
    for d, own in zip(names.tolist(), np.split(order, first[1:])):
        yield d, own


def _owners(q: Queries, win: np.ndarray) -> set[str]:
    return {q.items[i] for w in np.unique(win).tolist() for i in q.owner[q.first[w] : q.first[w + 1]].tolist()}


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    slop: int = SLOP,
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Index the documents, and ``search`` them for the benchmark."""
    return search(build_index(docs, text_col, keep), prepare(benchmark, item_id_col, item_text_col, width, block_bytes), slop)


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of query op10, with the number of items that have a proximity match."""
    return found.select(
        "doc_id",
        F.col("decon_words").alias("n_words"),
        F.aggregate("decon_spans", F.lit(0).cast("bigint"), lambda a, x: a + (x["end"] - x["start"])).alias("n_hit"),
        F.size("decon_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("decon_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("decon_spans") > 0).alias("contaminated"),
        F.size("decon_near").cast("bigint").alias("n_near_items"),
        F.sha2(F.array_join("decon_near", ",").cast("binary"), 256).alias("near_items_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"]))


def brute_force(docs: list[tuple], benchmark: list[tuple], width: int = WIDTH, slop: int = SLOP) -> list[tuple]:
    """The same rows, one window at a time; for tests."""
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    windows = {}
    for i, t in benchmark:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    sha = lambda items: hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
    out = []
    for d, t in docs:
        w, hit, items, near = words(t), set(), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= own
        where = {}
        for k, x in enumerate(w):
            where.setdefault(x, []).append(k)
        for g, own in windows.items():
            if all(x in where for x in g) and any(set(g) <= set(w[k : k + len(g) + slop]) for x in g for k in where[x]):
                near |= own
        out.append((d, len(w), len(hit), len(items), sha(items), bool(hit), len(near), sha(near)))
    return out
