"""Byte-level BPE encoding and decoding.

A text is cut at the special tokens' strings, then by the pre-tokenizer's
pattern into short words. Each word is merged over a contiguous rank array:
the list of its parts and, beside it, the rank of every adjacent pair; the
smallest rank (the leftmost of equals) is found by a scan, that boundary is
deleted, and the two neighbouring ranks are looked up again. A worker keeps the
words it has merged, up to ``CACHE`` of them.

Defined results: null text stays null ids (the query reads null as empty);
empty text has no ids; a word of more than ``LONG`` bytes takes the smallest
pair from a heap instead of a scan, with the same result; decoding ids that
are not valid UTF-8 gives replacement characters; null ids decode to null; ids
outside the vocabulary are skipped, as the library skips them. A column named
as an output is replaced by it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append_columns

CACHE = 400_000
LONG = 200
# The pre-tokenizer's pattern with the White_Space characters spelled out.
_WS = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe(dict):
    """Maps a word to the little-endian 32-bit ids of its pieces."""

    def __init__(self, spec: bytes):
        super().__init__()
        model = json.loads(spec)
        vocab = model["model"]["vocab"]
        byte_of = byte_characters()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.single = [0] * 256
        for ch, b in byte_of.items():
            self.single[b] = vocab[ch]
        self.pairs = {}
        for rank, m in enumerate(model["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        size = max([*vocab.values(), *self.special.values()]) + 1
        raw = [b""] * size
        for piece, i in vocab.items():
            raw[i] = bytes(byte_of[c] for c in piece)
        for piece, i in self.special.items():
            raw[i] = piece.encode()
        self.length = np.array([len(x) for x in raw], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.length)))
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.words = regex.compile(PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __missing__(self, word: str) -> bytes:
        parts = [self.single[b] for b in word.encode()]
        ids = self.merge(parts) if len(parts) <= LONG else self.merge_long(parts)
        out = np.array(ids, "<i4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        if len(parts) <= LONG:
            self[word] = out
        return out

    def merge(self, parts: list[int]) -> list[int]:
        pairs, none = self.pairs, (1 << 30, -1)
        ranks = [pairs.get(a << 20 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            parts[i] = best[1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pairs.get(parts[i - 1] << 20 | parts[i], none)
            if i < len(ranks):
                ranks[i] = pairs.get(parts[i] << 20 | parts[i + 1], none)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n, pairs = len(parts), self.pairs
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int, int, int]] = []

        def look(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (hit := pairs.get(parts[i] << 20 | parts[j])):
                heapq.heappush(heap, (hit[0], i, parts[i], parts[j], hit[1]))

        for i in range(n):
            look(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue  # one of the two has gone into another part
            parts[i], parts[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            look(before[i])
            look(i)
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> bytes:
        if self.at_special is None or not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, self.words(text)))
        out = []
        for k, piece in enumerate(self.at_special.split(text)):
            if k % 2:
                out.append(np.array([self.special[piece]], "<i4").tobytes())
            else:
                out += map(self.__getitem__, self.words(piece))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids[(ids >= 0) & (ids < len(self.length))]
        n = self.length[ids]
        ends = np.cumsum(n)
        place = np.repeat(self.offset[ids] - (ends - n), n) + np.arange(n.sum())
        return self.bytes[place].tobytes()


_loaded: dict[bytes, Bpe] = {}


def _model(shipped) -> Bpe:
    """One vocabulary for each worker and broadcast."""
    if (key := shipped.value) not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(key)
    return _loaded[key]


def _ship(df: DataFrame, vocabulary: str | None):
    """The vocabulary file is of a fixed size; tasks get it as a broadcast."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, text_col: str = "text", out: str = "bpe_ids", vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``out``, the token ids of each whole text."""
    shipped = _ship(docs, vocabulary)

    def run(batch: pa.RecordBatch) -> list:
        m = _model(shipped)
        ids = [None if t is None else m.encode(t) for t in batch.column("__text").to_pylist()]
        offset = np.cumsum([0] + [len(x or b"") // 4 for x in ids]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(x or b"" for x in ids), "<i4"))
        return [pa.ListArray.from_arrays(pa.array(offset), values, mask=pa.array([x is None for x in ids]))]

    return append_columns(docs, text_col, run, f"`{out}` array<int>", keep)


def decode(df: DataFrame, ids_col: str = "bpe_ids", out: str = "bpe_text", vocabulary: str | None = None) -> DataFrame:
    """Add ``out``, the text of each list of ids."""
    shipped = _ship(df, vocabulary)
    rest = df.drop(out)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shipped)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                col = batch.column(ids_col)
                texts = []
                for x in col:
                    if not x.is_valid:
                        texts.append(None)
                        continue
                    own = x.values.drop_null().to_numpy(zero_copy_only=False)
                    texts.append(m.decode(own).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rest.mapInArrow(run, schema)


def digest(coded: DataFrame) -> DataFrame:
    """The digest columns of query op9."""
    return coded.select(
        "doc_id",
        F.size("bpe_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe_text").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return digest(decode(encode(docs, keep=["doc_id"])))
