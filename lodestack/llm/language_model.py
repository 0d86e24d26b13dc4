"""Language-model scores by context-tree weighting, with a word baseline.

The model predicts a byte bit by bit. The state of a prediction is a context,
the last 0 to ``DEPTH`` bytes, and a node, the bits of the byte so far. Every
pair of them that training has seen has counts of zeros and ones and their
Krichevsky-Trofimov estimate. Context-tree weighting mixes, at every node, the
estimate of a context with those of the contexts that are one byte longer:
``Pw = (KT + product of the longer contexts' Pw) / 2``, so the weight of each
depth follows from the training counts. A text is scored by the mixture along
its contexts; a path ends with the longest context that training has seen. The
score is a code length: ``-score / log10(2)`` is its bits.

A gram is ``DEPTH`` bytes of context, the nearest first, and the byte after
them, as one number; sorted grams have the contexts of every length together.

On Spark: a block is the documents of one input partition. It gives its
documents, packed by the megabyte, and asks for its distinct words and grams,
with their counts in training documents, in packed rows for each bucket of
words and of grams. Word buckets add up the counts. A gram bucket has all grams
of some contexts of ``SPLIT`` bytes and works out the trees below them. How many
grams each bucket was asked for is summed up before any is brought together: one
of more than ``MOST_GRAMS`` is dealt anew by one more byte of context, and so on
down to whole contexts, so a frequent context is spread over as many buckets as
its weight needs. What the trees of a bucket give to shorter contexts goes to
buckets of these, level by level down to two bytes, whose sums for one byte (at
most 256 x 255 rows) meet in the driver. The weights go back the same way, and
the buckets answer the blocks, which meet their documents in a cogroup. All
counts come from all documents; nothing that grows with the corpus goes through
the driver or one task, and the number of buckets grows with the input.

Defined results: null text is empty, which still has its end; a null id is
neither learned from nor held out; repeated rows are learned from each time and
scored each by itself; without training documents every bit has probability
one half and N is 0; an empty table gives an empty result. A score is the sum
of its bytes' log10 probabilities in units of ``2**-44``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import LOWER, SPACE, give_back, mix, slices, split_words, stash, texts_of
from .langid import distinct

DEPTH = 6
#: Context bytes that a gram bucket has whole trees of, at least; grams that it is asked for at most, if one more byte of context can part them.
SPLIT, MOST_GRAMS = 3, 1 << 24
#: Text worked on at once.
SLICE = 1 << 19
#: Text that a bucket stands for.
BUCKET_BYTES = 256 << 20
#: Grams whose trees are worked out at once (whole contexts of SPLIT bytes), and grams of a block held before they are sent.
CHUNK, HELD = 1 << 16, 1 << 22
#: Words or grams in one packed row: rows of some hundred kilobytes are easy on the executors' memory.
ROW = 1 << 15
EDGE = 0xFF  # stands before and after a text; no byte of UTF-8
UNIT = float(1 << 44)
_HALF = np.log(0.5)
U64 = np.uint64


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0."""
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


_SMALL = 64
_KT = _log_kt(*(x.ravel().astype(float) for x in np.mgrid[:_SMALL, :_SMALL]))
_KT[0] = 0.0


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    small = (zeros < _SMALL) & (ones < _SMALL)
    out = _KT[np.where(small, zeros * _SMALL + ones, 0)]
    large = np.flatnonzero(~small)
    out[large] = _log_kt(zeros[large].astype(float), ones[large].astype(float))
    return out


def text_grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text) for each byte of each lower-cased text and its end."""
    pad = bytes([EDGE]) * DEPTH
    b = LOWER[np.frombuffer(pad + pad.join([*(t or b"" for t in texts), b""]), np.uint8)].astype(U64)
    code = b[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        code |= b[DEPTH - k : len(b) - k] << U64(8 * (DEPTH + 1 - k))
    size = np.array([len(t or b"") + DEPTH for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    keep = at < (size - DEPTH + 1)[doc]
    return code[: len(doc)][keep], doc[keep]


def run_starts(key: np.ndarray) -> np.ndarray:
    """Where the runs of equal neighbours begin."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)


class Counts:
    """Sums by sorted key; new ones are put in when they are a quarter of the old."""

    def __init__(self):
        self.key, self.n = np.zeros(0, U64), np.zeros(0, np.int64)
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        """Add sorted keys, each there once."""
        self.fresh.append((key, n))
        self.waiting += len(key)
        if self.waiting > max(1 << 18, len(self.key) // 4):
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if self.fresh:
            key, n = self.fresh[0]
            if len(self.fresh) > 1:
                key, n = (np.concatenate(c) for c in zip(*self.fresh))
                order = np.argsort(key)
                key, n = key[order], n[order]
                first = run_starts(key)
                key, n = key[first], np.add.reduceat(n, first) if len(first) else n
            self.fresh, self.waiting = [], 0
            at = np.searchsorted(self.key, key)
            old = at < len(self.key)
            old[old] = self.key[at[old]] == key[old]
            self.n[at[old]] += n[old]
            self.key, self.n = (np.insert(x, at[~old], y[~old]) for x, y in ((self.key, key), (self.n, n)))
        return self.key, self.n


@dataclass
class Tree:
    """The (context, node) pairs of one depth for some sorted (context, byte) keys; node k of a byte is its first k bits."""

    depth: int
    key: np.ndarray  # context << 8 | byte, sorted
    n: np.ndarray
    up: np.ndarray | None = None  # place of each key in the shallower tree

    def __post_init__(self):
        size = len(self.key)
        self.pair = np.empty((8, size), np.int32)
        firsts, zeros, ones, total = [], [], [], 0
        for k in range(8):
            first = run_starts(self.key >> U64(8 - k))
            mark = np.zeros(size, np.int32)
            mark[first] = 1
            self.pair[k] = np.cumsum(mark) + (total - 1)
            one = np.where((self.key >> U64(7 - k)) & U64(1), self.n, 0)
            ones.append(np.add.reduceat(one, first))
            zeros.append(np.add.reduceat(self.n, first) - ones[-1])
            firsts.append(first)
            total += len(first)
        self.first, self.level = np.concatenate(firsts), np.repeat(np.arange(8), [len(f) for f in firsts])
        self.zeros, self.ones = np.concatenate(zeros), np.concatenate(ones)
        self.kt = log_kt(self.zeros, self.ones)
        self.weight, self.pw = np.ones(total), self.kt

    def node_key(self) -> np.ndarray:
        """context << 8 | node of every pair, nodes numbered 1 to 255 from the root."""
        key, k = self.key[self.first], self.level.astype(U64)
        return key >> U64(8) << U64(8) | U64(1) << k | (key & U64(0xFF)) >> (U64(8) - k)

    def shallower(self) -> Tree:
        """The tree of the contexts that are a byte shorter."""
        key = self.key >> U64(16) << U64(8) | self.key & U64(0xFF)
        order = np.argsort(key)
        first = run_starts(key[order])
        place = np.zeros(len(key), np.int32)
        place[first] = 1
        self.up = np.empty(len(key), np.int64)
        self.up[order] = np.cumsum(place) - 1
        return Tree(self.depth - 1, key[order][first], np.add.reduceat(self.n[order], first))

    def parents(self, tree: Tree) -> np.ndarray:
        """The pair of the shallower ``tree`` that each pair hangs on."""
        return tree.pair[self.level, self.up[self.first]]

    def weigh(self, below: np.ndarray) -> None:
        """Mix with the summed log Pw of the longer contexts."""
        self.pw, self.weight = mixed(self.kt, below)


def mixed(kt: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log Pw, weight of the own estimate)."""
    pw = np.logaddexp(kt, below) + _HALF
    return pw, np.exp(kt + _HALF - pw)


def trees(gram: np.ndarray, n: np.ndarray, split: int = SPLIT) -> list[Tree]:
    """Trees of depth DEPTH to ``split`` of sorted grams with whole contexts of ``split`` bytes."""
    out = [Tree(DEPTH, gram, n)]
    while out[-1].depth > split:
        longer = out[-1]
        out.append(longer.shallower())
        out[-1].weigh(np.bincount(longer.parents(out[-1]), weights=longer.pw, minlength=len(out[-1].kt)))
    return out


def chunks(gram: np.ndarray, split: int = SPLIT) -> Iterator[slice]:
    """Ranges of about CHUNK grams, or one context of ``split`` bytes."""
    context, i = gram >> U64(8 * (DEPTH + 1 - split)), 0
    while i < len(gram):
        j = min(len(gram), i + CHUNK)
        j = len(gram) if j == len(gram) else int(np.searchsorted(context, context[j - 1], side="right"))
        yield slice(i, j)
        i = j


@dataclass
class State:
    """What a descent has gathered: probability of each bit if the path ends here, their mixture so far, and the weight left."""

    end: np.ndarray  # 2 x pairs
    sum: np.ndarray
    rest: np.ndarray

    def down(self, at: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weight: np.ndarray) -> State:
        """The state one byte of context further, at pairs that hang on the pairs ``at``."""
        count = np.stack((zeros, ones)).astype(np.float64)
        total = count[0] + count[1]
        own, sum_, rest = (count + 0.5) / (total + 1.0), self.sum[:, at], self.rest[at]
        end = np.where(total > 0, sum_ + rest * own, self.end[:, at])
        return State(end, sum_ + rest * weight * own, rest * (1 - weight))


@dataclass
class Level:
    """Pairs of a short context by their sorted ``context << 8 | node``."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weight: np.ndarray

    def down(self, shorter: Level | None, state: State) -> State:
        at = np.searchsorted(shorter.key, cut(self.key)) if shorter else np.zeros(len(self.key), np.int64)
        return state.down(at, self.zeros, self.ones, self.weight)


def cut(key: np.ndarray) -> np.ndarray:
    """The pairs with the context's farthest byte left out."""
    return key >> 16 << 8 | key & 0xFF


def summed(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted keys and the sums of the columns."""
    out, place = np.unique(key, return_inverse=True)
    return out, *(np.bincount(place, weights=c, minlength=len(out)) for c in columns)


def top_levels(table: pd.DataFrame) -> tuple[Level, Level]:
    """Levels 0 and 1 from sums over level 2: key (one-byte context and node), zeros, ones, pw."""
    key, zeros, ones, below = summed(table["key"].to_numpy(np.int64), *(table[c].to_numpy(float) for c in ("zeros", "ones", "pw")))
    kt = log_kt(zeros.astype(np.int64), ones.astype(np.int64))
    pw, weight = mixed(kt, below)
    one = Level(key, zeros, ones, weight)
    key, zeros, ones, below = summed(cut(key), zeros, ones, pw)
    return Level(key, zeros, ones, mixed(log_kt(zeros.astype(np.int64), ones.astype(np.int64)), below)[1]), one


def log10_probability(gram: np.ndarray, n: np.ndarray, above: Level, state: State, split: int) -> np.ndarray:
    """log10 of the mixture's probability of each gram's byte after its context, for sorted grams with whole contexts of ``split`` bytes."""
    levels = trees(gram, n, split)[::-1]
    at = np.searchsorted(above.key, cut(levels[0].node_key().astype(np.int64)))
    for tree, longer in zip(levels, [*levels[1:], None]):
        state = state.down(at, tree.zeros, tree.ones, tree.weight)
        if longer is not None:
            at = longer.parents(tree)
    last, p = levels[-1], np.ones(len(gram))
    for k in range(8):
        bit = ((gram >> U64(7 - k)) & U64(1)).astype(np.int64)
        p *= state.end[bit, last.pair[k]]
    return np.log10(p)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers, the lowest of all first: neighbours are alike."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(raw: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _pack(*x) -> bytes:
    """Compressed; sorted unsigned numbers as their differences, any numbers as planes."""

    def plain(v):
        if isinstance(v, np.ndarray) and v.dtype == U64:
            return "sorted", _planes(np.diff(v, prepend=U64(0)))
        if isinstance(v, np.ndarray) and v.dtype.itemsize == 8:
            return v.dtype.str, _planes(np.ascontiguousarray(v))
        return None, v

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps([plain(v) for v in x], protocol=5))


def _unpack(blob: bytes) -> list:
    def plain(kind, v):
        return v if kind is None else np.cumsum(_numbers(v, U64), dtype=U64) if kind == "sorted" else _numbers(v, kind)

    return [plain(*x) for x in pickle.loads(zstandard.ZstdDecompressor().decompress(blob))]


class _Words:
    """Distinct words of a block: hash, length, training count and bytes, by hash."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.fresh = 0

    def add(self, h: np.ndarray, size: np.ndarray, times: np.ndarray, body: np.ndarray) -> None:
        self.parts.append((h, size, times, body))
        self.fresh += len(h)
        if self.fresh > max(1 << 16, len(self.parts[0][0])):
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            h, size, times, body = (np.concatenate(c) for c in zip(*self.parts))
            h, first, place = np.unique(h, return_index=True, return_inverse=True)
            self.parts = [(h, size[first], np.bincount(place, weights=times, minlength=len(h)).astype(np.int64), cut_out(body, size, first))]
        self.fresh = 0
        return self.parts[0] if self.parts else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))


def cut_out(body: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The strings ``own`` of strings of these sizes that stand one after the other."""
    begin, n = (np.cumsum(size) - size)[own], size[own]
    return body[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]


ASKED = "kind string, bucket int, block int, n bigint, packed binary"


def _requests(rows: DataFrame, buckets: int) -> DataFrame:
    """Packed documents, distinct words and distinct grams of each input partition."""
    # A two-byte context is dealt over so many buckets.
    spread = int(np.clip(buckets // 8, 1, 256))

    def bucket_of(gram: np.ndarray) -> np.ndarray:
        context = gram >> U64(8 * (DEPTH + 1 - SPLIT))
        return ((mix(context >> U64(8)) + mix(context & U64(0xFF)) % U64(spread)) % U64(buckets)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        words, grams, ends = _Words(), Counts(), 0

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            kind, bucket, n, packed = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(bucket, pa.int32()), pa.array([block] * len(out), pa.int32()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=[c.split()[0] for c in ASKED.split(", ")])

        def gram_rows() -> Iterator[pa.RecordBatch]:
            key, n = grams.merged()
            first = run_starts(key >> U64(1))
            gram, often = key[first] >> U64(1), np.add.reduceat(np.where(key & U64(1), n, 0), first) if len(first) else n
            for b, whole in _groups(bucket_of(gram)):
                for own in _rows(whole):
                    yield rows_of([("gram", b, len(own), _pack(gram[own], often[own]))])

        for part in slices(batches, "text", SLICE):
            texts = texts_of(part.column("text"))
            learn = np.array(part.column("learn").to_pylist(), bool)
            ends += int(learn.sum())
            yield rows_of([("doc", 0, 0, _pack(part.column("doc_id").to_pylist(), texts))])
            w = split_words(texts, SPACE, lower=True)
            u, place = distinct(w)
            if len(u):
                words.add(u.hashes(), u.end - u.start + 1, np.bincount(place, weights=learn[w.doc()], minlength=len(u)).astype(np.int64), u.buf)
            g, doc = text_grams(texts)
            g = np.sort(g << U64(1) | learn[doc].astype(U64))
            first = run_starts(g)
            grams.add(g[first], np.diff(np.concatenate((first, [len(g)]))))
            if len(grams.key) > HELD:
                yield from gram_rows()
                grams = Counts()
        if ends:
            yield rows_of([("end", 0, ends, b"")])
        h, size, times, body = words.merged()
        for b, whole in _groups((h % U64(buckets)).astype(np.int64)):
            for own in _rows(whole):
                yield rows_of([("word", b, 0, _pack(h[own], cut_out(body, size, own).tobytes(), times[own]))])
        yield from gram_rows()

    return rows.mapInArrow(run, ASKED)


def _groups(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    for b, a, z in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        yield b, order[a:z]


def _rows(x: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(0, len(x), ROW):
        yield x[i : i + ROW]


ANSWER = "block int, kind string, packed binary, v bigint, n bigint"


def _answers(rows: list[tuple]) -> pd.DataFrame:
    give_back()
    return pd.DataFrame(rows, columns=["block", "kind", "packed", "v", "n"])


def _count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """Total counts of the words of one bucket, for each block that asks; new and total tokens of the bucket with the first."""
    known: dict[bytes, int] = {}
    total, ids = np.zeros(0, np.int64), []
    for blob in pdf["packed"]:
        _, text, times = _unpack(blob)
        own = text.split(b" ")[:-1]
        at = np.fromiter((known.setdefault(x, len(known)) for x in own), np.int64, len(own))
        total = np.bincount(np.concatenate((np.arange(len(total)), at)), weights=np.concatenate((total, times)), minlength=len(known)).astype(np.int64)
        ids.append(at)
    new = (int((total > 0).sum()), int(total.sum()))
    return _answers([(b, "word", _pack(_unpack(blob)[0], total[at]), *(new if i == 0 else (0, 0))) for i, (b, blob, at) in enumerate(zip(pdf["block"], pdf["packed"], ids))])


def _merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bucket's sorted grams and their counts; one request is unpacked at a time."""
    sums = Counts()
    for blob in pdf["packed"]:
        sums.add(*_unpack(blob))
    return sums.merged()


GRAMS = "bucket int, depth int, block int, n bigint, packed binary"


def _dealt(grams: DataFrame, buckets: int) -> DataFrame:
    """The requests for grams, those of heavy buckets dealt anew by one more byte of context until none is too heavy."""
    spark = grams.sparkSession
    rows = grams.select("bucket", F.lit(SPLIT).alias("depth"), "block", "n", "packed")
    done, fresh = buckets, rows
    for depth in range(SPLIT, DEPTH):
        heavy = fresh.groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > MOST_GRAMS).collect()  # as many as the input has times MOST_GRAMS grams
        if not heavy:
            break
        plan = []
        for r in heavy:
            parts = int(min(256, -(-2 * r["n"] // MOST_GRAMS)))
            plan.append((r["bucket"], done, parts))
            done += parts
        named = F.broadcast(spark.createDataFrame(plan, "bucket int, first int, parts int"))
        fresh = stash(fresh.join(named, "bucket").select("first", "parts", "block", "packed").mapInArrow(_part_by(depth + 1), GRAMS), "lm-parts")
        rows = rows.join(named, "bucket", "left_anti").select(*rows.columns).unionByName(fresh)
    return rows


def _part_by(depth: int):
    """Requests parted by contexts of ``depth`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, parts, block, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gram, n = _unpack(packed)
                to = first + (mix(gram >> U64(8 * (DEPTH + 1 - depth))) % U64(parts)).astype(np.int64)
                for bucket, own in _groups(to):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([depth], pa.int32()), pa.array([block], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([_pack(gram[own], n[own])], pa.binary())], names=["bucket", "depth", "block", "n", "packed"])

    return run


SUMS = "level int, bucket int, asker int, packed binary"


def _sent(level: int, buckets: int, asker: int | None, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, pw: np.ndarray) -> list[tuple]:
    """Sums of pairs of ``level`` bytes of context, packed by the bucket of the context."""
    to = (mix(key.astype(U64) >> U64(8)) % U64(buckets)).astype(np.int64)
    return [(level, b, asker, _pack(key[own].astype(U64), zeros[own].astype(np.int64), ones[own].astype(np.int64), pw[own])) for b, own in _groups(to)]


def _sums(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["level", "bucket", "asker", "packed"]).astype({"asker": "Int32"})


def _tree_sums(buckets: int):
    """What the trees of a bucket give to the contexts that are a byte shorter; of still shorter ones it asks for the weights only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        depth, asker = int(pdf["depth"].iloc[0]), int(pdf["bucket"].iloc[0])
        gram, n = _merged(pdf)
        parts = []
        for own in chunks(gram, depth):
            top = trees(gram[own], n[own], depth)[-1]
            parts.append(summed(cut(top.node_key().astype(np.int64)), top.zeros, top.ones, top.pw))
        key, *sums = summed(*(np.concatenate(c) for c in zip(*parts)))
        out = _sent(depth - 1, buckets, asker, key, *sums)
        for level in range(depth - 2, 1, -1):
            key = np.unique(cut(key))
            out += _sent(level, buckets, asker, key, *np.zeros((3, len(key))))
        give_back()
        return _sums(out)

    return run


PAIRS = "kind string, level int, bucket int, packed binary, key bigint, zeros bigint, ones bigint, pw double"


def _weigh(level: int, buckets: int):
    """Weights of contexts of ``level`` bytes for the buckets that asked, and the sums for contexts that are a byte shorter."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [(None if pd.isna(a) else int(a), *_unpack(x)) for a, x in zip(pdf["asker"], pdf["packed"])]
        key, zeros, ones, below = summed(*(np.concatenate(c) for c in list(zip(*asked))[1:]))
        zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)
        pw, weight = mixed(log_kt(zeros, ones), below)
        out = []
        for asker, own, *_ in asked:
            if asker is not None:
                at = np.searchsorted(key, own)
                out.append(("weight", level, asker, _pack(own, zeros[at], ones[at], weight[at]), None, None, None, None))
        shorter = summed(cut(key.astype(np.int64)), zeros, ones, pw)
        if level > 2:
            out += [("sum", to, b, x, None, None, None, None) for to, b, _, x in _sent(level - 1, buckets, None, *shorter)]
        else:
            out += [("one", None, None, None, int(k), int(z), int(o), float(p)) for k, z, o, p in zip(*shorter)]
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PAIRS.split(", ")])
        return frame.astype({"level": "Int32", "bucket": "Int32", "key": "Int64", "zeros": "Int64", "ones": "Int64"})

    return run


def _predict(zero: Level, one: Level):
    def run(pairs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return _answers([])
        depth = int(asked["depth"].iloc[0])
        start = State(np.full((2, 1), 0.5), np.zeros((2, 1)), np.ones(1))
        above, state = one, one.down(zero, zero.down(None, start))
        for level in range(2, depth):
            parts = [_unpack(x) for x in pairs["packed"][pairs["level"] == level]]
            key, zeros, ones, weight = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(key)
            here = Level(key[order].astype(np.int64), zeros[order], ones[order], weight[order])
            above, state = here, here.down(above, state)
        gram, n = _merged(asked)
        p = np.concatenate([log10_probability(gram[own], n[own], above, state, depth) for own in chunks(gram, depth)])
        units = np.rint(-p * UNIT).astype(np.int64)
        out = []
        for block, blob in zip(asked["block"], asked["packed"]):
            own = _unpack(blob)[0]
            out.append((block, "gram", _pack(own, units[np.searchsorted(gram, own)]), 0, 0))
        return _answers(out)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn_col: str = "learn") -> DataFrame:
    """One row for each document: ``doc_id``, ``n_bytes``, ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score``, ``score``. Rows with a true
    ``learn_col`` are learned from.
    """
    col = lambda c: F.col(f"`{c}`")
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(col(learn_col), F.lit(False)).alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    asked = stash(_requests(rows, buckets), "lm-requests")
    of = lambda kind: asked.filter(F.col("kind") == kind)
    dealt = _dealt(of("gram"), buckets)
    sums = stash(dealt.groupBy("bucket").applyInPandas(_tree_sums(buckets), SUMS), "lm-sums")
    weights, carried = [], None
    for level in range((dealt.agg(F.max("depth")).first()[0] or SPLIT) - 1, 1, -1):
        rows_of = sums.filter(F.col("level") == level)
        rows_of = rows_of if carried is None else rows_of.unionByName(carried)
        pairs = stash(rows_of.groupBy("bucket").applyInPandas(_weigh(level, buckets), PAIRS), "lm-pairs")
        weights.append(pairs.filter("kind = 'weight'").select("bucket", "level", "packed"))
        carried = pairs.filter("kind = 'sum'").select("level", "bucket", F.lit(None).cast("int").alias("asker"), "packed")
    # One-byte contexts and nodes: at most 256 x 255 rows.
    table = pairs.filter("kind = 'one'").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "pw")]).toPandas()
    known = weights[0]
    for w in weights[1:]:
        known = known.unionByName(w)
    # Dealt anew: see the note on unions in the entry.
    known = known.repartition(F.col("bucket"))
    grams = known.groupBy("bucket").cogroup(dealt.select("bucket", "depth", "block", "packed").groupBy("bucket")).applyInPandas(_predict(*top_levels(table)), ANSWER)
    words = stash(of("word").groupBy("bucket").applyInPandas(_count_words, ANSWER), "lm-words")
    v, n = words.agg(F.sum("v"), F.sum("n")).first()
    ends = of("end").agg(F.sum("n")).first()[0] or 0
    total, kinds = (n or 0) + ends, (v or 0) + (ends > 0)
    log_base = float(np.log10(total + kinds + 1))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tables = {kind: _table(own) for kind, own in right.groupby("kind")["packed"]}
        out = []
        for packed in left["packed"]:
            ids, texts = _unpack(packed)
            w = split_words(texts, SPACE, lower=True)
            c = _look_up(*tables["word"], w.hashes()) if len(w) else np.zeros(0)
            doc, size = w.doc(), len(texts)
            base = np.bincount(doc, weights=np.log10(c + 1), minlength=size) + np.log10(ends + 1) - (w.counts() + 1) * log_base
            known = np.bincount(doc, weights=c > 0, minlength=size).astype(np.int64) + int(ends > 0)
            g, owner = text_grams(texts)
            order = np.argsort(g)
            p = _look_up(*tables["gram"], g[order]) / -UNIT
            own = np.bincount(owner[order], weights=p, minlength=size)
            bytes_ = np.array([len(t) for t in texts], np.int64)
            out.append(pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "n_bytes": bytes_, "n_tokens": w.counts().astype(np.int64) + 1, "n_known": known, "train_tokens": total, "base_score": base, "score": own}))
        give_back()
        return pd.concat(out)

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    answers = words.select("block", "kind", "packed").unionByName(grams.select("block", "kind", "packed"))
    # So many partitions that a task has a block or two, however many there are.
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * of("doc").select("block").distinct().count())
    parted = lambda df: df.repartition(n, "block").groupBy("block")
    return parted(of("doc").select("block", "packed")).cogroup(parted(answers)).applyInPandas(run, schema)


def _table(packed: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a block's answers, by key."""
    k, x = (np.concatenate(c) for c in zip(*map(_unpack, packed)))
    order = np.argsort(k)
    return k[order], x[order]


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of keys that are all there; neighbours that are equal are looked up once."""
    first = run_starts(wanted)
    return np.repeat(values[np.searchsorted(keys, wanted[first])], np.diff(np.concatenate((first, [len(wanted)]))))


def query(spark, sf_dir: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (~third).alias("learn"))
    bits = -F.col("score") / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)  # the end counts as a byte
    return score(docs).select("doc_id", F.coalesce(third, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))


def brute_force(docs: list[tuple[str | None, bool]]) -> list[tuple[int, int, int, float, float]]:
    """(tokens, known, N, base, score) with plain dictionaries, one bit at a time; for tests."""
    import math
    import re
    from collections import Counter, defaultdict

    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for t, _ in docs]
    count = Counter(x for w, (_, learn) in zip(tokens, docs) if learn for x in w)
    total, kinds = sum(count.values()), len(count)
    tree: dict = defaultdict(lambda: [0, 0])
    steps = []
    for t, learn in docs:
        b = bytes([EDGE]) * DEPTH + low(t).encode() + bytes([EDGE])
        own = []
        for i in range(DEPTH, len(b)):
            for k in range(8):
                node, bit = (1 << k) | b[i] >> (8 - k), b[i] >> (7 - k) & 1
                own.append(([(b[i - d : i], node) for d in range(DEPTH + 1)], bit))
        steps.append(own)
        if learn:
            for contexts, bit in own:
                for c in contexts:
                    tree[c][bit] += 1
    longer = defaultdict(list)
    for c, node in tree:
        if c:
            longer[c[1:], node].append((c, node))
    kt = {c: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for c, (a, b) in tree.items()}
    pw, weight = {}, {}
    for c in sorted(tree, key=lambda x: -len(x[0])):
        if len(c[0]) == DEPTH:
            pw[c], weight[c] = kt[c], 1.0
        else:
            rest = sum(pw[x] for x in longer[c])
            top = max(kt[c], rest)
            pw[c] = top + math.log(math.exp(kt[c] - top) + math.exp(rest - top)) + math.log(0.5)
            weight[c] = math.exp(kt[c] + math.log(0.5) - pw[c])
    out = []
    for w, own in zip(tokens, steps):
        score = 0.0
        for contexts, bit in own:
            p, rest, mixed = 0.5, 1.0, 0.0
            for c in contexts:
                if c not in tree:
                    break
                est = (tree[c][bit] + 0.5) / (sum(tree[c]) + 1)
                p, mixed, rest = mixed + rest * est, mixed + rest * weight[c] * est, rest * (1 - weight[c])
            score += math.log10(p)
        base = sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w)
        out.append((len(w), sum(count[x] > 0 for x in w), total, base, score))
    return out
