"""Token ids as flat files of unsigned integers, with 64-bit document offsets.

Writing: documents are range-partitioned and sorted by their id. Each task
encodes its documents in order and streams their ids into ``*.bin``, a flat file
of little-endian unsigned integers (16 bits where the vocabulary allows it, else
32), their offsets into ``*.idx`` (n + 1 unsigned 64-bit numbers, counted from
the file's start) and their document ids into ``*.key`` (an Arrow file). A file
that has ``FILE_BYTES`` of ids, or ``FILE_DOCS`` documents, is followed by a new
one, so no file grows with a partition. A task gives back one line for each of
its files; the bases of all files are prefix sums over these lines and stand,
with the lines, in the folder's ``manifest`` table. Names are those of the
attempt: files of an attempt that was lost are in no line, and never read.

Reading: files are dealt over tasks by lines of the manifest, memory-mapped
(read whole where the folder is no local file system) and cut by their offsets;
a document's place in all ids is its offset plus its file's base.

Encoding: the library's own encoder, over pieces of a text that it would encode
alike in the text; a worker keeps the ids of the pieces it has met. Texts are cut
at ASCII white space, after runs of Latin letters, single digits and symbols where
the next character is ASCII too: no token of this pre-tokenizer spans such a
place, but for an apostrophe's and from a symbol to a control character, which
are never cut. New pieces of one pre-token each go to the library in one call,
and their ids are told apart by the ends of words. Texts with a special token's
string, and all texts under a tokenizer of another kind, go to it whole.

Defined results: null and empty texts have the end id only; documents of equal
id (or of a null one, which come first) are ordered by a hash of their text,
then by their place in the input, and each has its own row; an empty table
gives an empty manifest. Columns of other names are not written.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrow import bound_batches, give_back, shared_folder, slices
from .files import mapped, open_folder

FILE_BYTES, FILE_DOCS = 256 << 20, 1 << 22
#: Pieces that a worker keeps, twice (new ones and those before them), and their length.
CACHE, KEPT_LENGTH = 400_000, 64
#: Bytes of ids that a reading task gives at once.
READ_BYTES = 1 << 20
# Latin letters that stay letters when normalised and lower-cased.
_LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0100-\u012f\u0131-\u017f"
_SYMBOLS = r"!-&(-/:-@\[-`{-~"
#: Pieces that no token reaches out of; the last kind takes the rest up to white space.
PIECES = re.compile(rf"[{_LETTERS}]++(?![^\x00-\x7f])|[0-9](?![^\x00-\x7f])|[{_SYMBOLS}]++(?![\x00-\x08\x0e-\x1f\x7f-\U0010ffff'])|[^ \t\n\r\f\v]+")
ONE_WORD = re.compile(rf"[{_LETTERS}]+|[0-9]|[{_SYMBOLS}]+")
# The tokenizer that these cuts are made for.
KIND = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
WORD_END = "</w>"
LINES = "part int, seq int, name string, width int, docs bigint, tokens bigint"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder(dict):
    """Maps a piece of a text to its ids' bytes."""

    def __init__(self, spec: str, end_id: int | None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        whole = json.loads(spec)
        self.cuts = all(whole.get(k) == v for k, v in KIND.items()) and whole["model"].get("end_of_word_suffix") == WORD_END
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab()
        largest = max(vocab.values())
        self.kind = "<u2" if max(largest, end_id or 0) < 1 << 16 else "<u4"
        self.ends = np.zeros(largest + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self.end = b"" if end_id is None else np.array([end_id], self.kind).tobytes()
        self.before: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def keep(self, piece: str, ids: bytes) -> None:
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= CACHE:
                self.before = dict(self)
                self.clear()
            self[piece] = ids

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.before.get(piece)) is None:
            ids = self.whole(piece)
        self.keep(piece, ids)
        return ids

    def learn(self, pieces: set[str]) -> None:
        """Encode new pieces of one word in one call."""
        words = [p for p in pieces if p not in self and p not in self.before and len(p) <= KEPT_LENGTH and ONE_WORD.fullmatch(p)]
        if len(words) > CACHE:
            return
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, self.kind)
        after = np.flatnonzero(self.ends[ids]) + 1
        if len(after) != len(words):  # not one word each under this vocabulary
            return
        raw, size = ids.tobytes(), ids.itemsize
        at = 0
        for word, end in zip(words, (after * size).tolist(), strict=True):
            self.keep(word, raw[at:end])
            at = end

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [self.whole(t) + self.end for t in texts]
        cut = [None if any(s in t for s in self.special) else PIECES.findall(t) for t in texts]
        self.learn(set().union(*[c for c in cut if c]))
        return [(self.whole(t) if c is None else b"".join(map(self.__getitem__, c))) + self.end for t, c in zip(texts, cut, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_loaded: dict[tuple, Encoder] = {}


def _encoder(shipped, end_id: int | None) -> Encoder:
    if (key := (hash(shipped.value), end_id)) not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(shipped.value, end_id)
    return _loaded[key]


class _Writer:
    """One set of files, written as documents come."""

    def __init__(self, folder: str, kind: str, keys: pa.Schema):
        self.fs, path = open_folder(folder)
        self.fs.create_dir(path)
        self.name, self.kind, self.docs, self.tokens, self.offsets = f"ids-{uuid.uuid4().hex}", np.dtype(kind), 0, 0, [np.zeros(1, "<u8")]
        self.path = f"{path}/{self.name}"
        self.bin = self.fs.open_output_stream(f"{self.path}.bin")
        self.sink = self.fs.open_output_stream(f"{self.path}.key")
        self.key = pa.ipc.new_file(self.sink, keys)

    def add(self, keys: pa.RecordBatch, ids: list[bytes]) -> None:
        ends = np.cumsum([len(x) // self.kind.itemsize for x in ids], dtype=np.uint64)
        self.bin.write(b"".join(ids))
        self.key.write_batch(keys)
        self.offsets.append((ends + np.uint64(self.tokens)).astype("<u8"))
        self.docs, self.tokens = self.docs + len(ids), self.tokens + int(ends[-1])

    def full(self, file_bytes: int) -> bool:
        return self.tokens * self.kind.itemsize >= file_bytes or self.docs >= FILE_DOCS

    def close(self) -> tuple:
        self.key.close()
        for f in (self.bin, self.sink):
            f.close()
        with self.fs.open_output_stream(f"{self.path}.idx") as f:
            f.write(np.concatenate(self.offsets).tobytes())
        return self.name, self.kind.itemsize, self.docs, self.tokens


def write(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int | None = 2, file_bytes: int = FILE_BYTES) -> str:
    """Write the ids of all documents; gives the folder."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    open_folder(folder)  # a scheme that tasks cannot open fails here
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        shipped = spark.sparkContext.broadcast(f.read())  # of a fixed size
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    keyed = rows.withColumns({"__hash": F.xxhash64("__text"), "__place": F.monotonically_increasing_id()})
    order = ["__id", "__hash", "__place"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("__id", "__text")
    keys = to_arrow_schema(T.StructType([T.StructField(id_col, rows.schema["__id"].dataType)]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, out, lines = _encoder(shipped, end_id), TaskContext.get().partitionId(), None, []
        for batch in slices(batches, "__text"):
            if not batch.num_rows:
                continue
            if out is None:
                out = _Writer(folder, e.kind, keys)
            own = pa.RecordBatch.from_arrays([batch.column(0).cast(keys.field(0).type)], schema=keys)
            out.add(own, e.encode_all(batch.column(1).to_pylist()))
            if out.full(file_bytes):
                lines.append(out.close())
                out = None
        if out is not None:
            lines.append(out.close())
        give_back()
        names, widths, n, tokens = zip(*lines, strict=True) if lines else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(lines), pa.int32()), pa.array(range(len(lines)), pa.int32()), pa.array(names, pa.string()), pa.array(widths, pa.int32()), pa.array(n, pa.int64()), pa.array(tokens, pa.int64())],
            names=["part", "seq", "name", "width", "docs", "tokens"],
        )

    lines = ordered.mapInArrow(encode, LINES)
    # One row a file: bases are sums over all files before.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{c}_base": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("docs", "tokens")}
    lines.withColumns(sums).write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{LINES}, docs_base bigint, tokens_base bigint").parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, id_col: str = "doc_id", id_type: str = "bigint", raw: bool = False) -> DataFrame:
    """(id_col, place, start, n_tokens, ids) of each document, from the files.

    ``place``: documents before it; ``start``: ids before it. ``ids`` are numbers,
    or with ``raw`` the bytes of little-endian unsigned 32-bit numbers.
    """
    bound_batches(spark)
    schema = T.StructType.fromDDL(f"`{id_col}` {id_type}, place bigint, start bigint, n_tokens bigint, ids {'binary' if raw else 'array<bigint>'}")
    kinds = [f.type for f in to_arrow_schema(schema)]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        for batch in batches:
            for line in batch.to_pylist():
                stem, width = f"{path}/{line['name']}", line["width"]
                ids, offsets = mapped(fs, f"{stem}.bin", f"<u{width}"), mapped(fs, f"{stem}.idx", "<u8").astype(np.int64)
                if len(offsets) != line["docs"] + 1 or offsets[-1] != line["tokens"] or len(ids) != line["tokens"]:
                    raise ValueError(f"{stem}: the files are not as the manifest says")
                with fs.open_input_file(f"{stem}.key") as f:
                    key = pa.ipc.open_file(f).read_all().column(0).combine_chunks()
                i = 0
                while i < line["docs"]:
                    j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + READ_BYTES // 4, side="right")) - 1)
                    own, cut = ids[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                    if raw:
                        made = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(own.astype("<u4"))])
                    else:
                        made = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(own.astype(np.int64)))
                    at = np.arange(i, j, dtype=np.int64) + line["docs_base"]
                    columns = [key.slice(i, j - i), at, offsets[i:j] + line["tokens_base"], np.diff(cut), made]
                    yield pa.RecordBatch.from_arrays([(x if isinstance(x, pa.Array) else pa.array(x)).cast(k) for x, k in zip(columns, kinds, strict=True)], names=schema.names)
                    i = j
        give_back()

    lines = manifest(spark, folder)
    return lines.repartition(max(1, lines.count()), "name").mapInArrow(documents, schema)  # a file is a task's share


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = write(docs)
    found = read(spark, folder, id_type=docs.schema["doc_id"].dataType.simpleString(), raw=True)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
