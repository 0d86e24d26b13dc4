"""Vectors as short codes: product quantisation over integers.

Components are scaled and rounded down to integers, and vectors are cut into
equal parts, each with a codebook of its own. A codebook starts as that part of
the vectors of the smallest ids; in each round every part goes to its nearest
entry (squared distance, ties to the lower index) and entries move to the
rounded-down means of their parts. All arithmetic is exact.

The nearest entry is found by partial-distance search: the dimensions of a part
are taken in descending variance of its codebook. A part starts with the entry
nearest in the first of them, whose complete distance is the one to beat; then
each entry's distance grows dimension by dimension over all rows at once, and a
mask drops the rows where it strictly exceeds the best complete distance so far.

Every round is one pass over the vectors: tasks give back sums and counts for
each entry (parts x entries rows, whatever the input is), which are added up in
Spark; only the codebooks, whose size is fixed by parameters, come to the
driver. No vector is shuffled.

Defined results: rows with a null vector, a null or non-finite component, an
empty vector or one of another length than most (of the lengths that can be cut
into equal parts, the most frequent; of ties the largest) have no code and are
dropped; with fewer vectors than entries the codebooks are as short; rows of a
null id are coded but start no codebook; of equal ids that start codebooks the
smaller vector comes first, and repeated rows count each; an empty table has no
codebooks and no rows. Integers of 2^27 or more after scaling are an error, as
distances would no longer be exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrow import bound_batches, give_back, stash
from .vector_rows import integers, usable

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
#: Distances over 64 dimensions and more stay below 2^63.
LIMIT = 1 << 27
#: Rows whose distances a task works out at once.
ROWS = 4096


@dataclass(frozen=True)
class Codebooks:
    """``entries``: parts x entries x width."""

    entries: np.ndarray
    scale: float

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of the decimal components by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry and squared distance of each part of each row, and the number of components that were looked at."""
        parts, n, width = self.entries.shape
        codes, distances, looked = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64), 0
        for p, book in enumerate(self.entries):
            order = np.argsort(-book.var(axis=0), kind="stable")
            own, book = np.ascontiguousarray(x[:, p * width : (p + 1) * width][:, order].T), book[:, order]
            first = (own[0][:, None] - book[:, 0]) ** 2
            code = first.argmin(axis=1)
            best = ((own - book[code].T) ** 2).sum(axis=0)
            guess = code.copy()
            looked += first.size + len(x) * (width - 1)
            for k in range(n):
                live = np.flatnonzero((first[:, k] <= best) & (guess != k))
                sofar = first[live, k]
                for d in range(1, width):
                    if not len(live):
                        break
                    looked += len(live)
                    sofar = sofar + (own[d, live] - book[k, d]) ** 2
                    stay = sofar <= best[live]
                    live, sofar = live[stay], sofar[stay]
                better = (sofar < best[live]) | (k < code[live])
                code[live[better]], best[live[better]] = k, sofar[better]
            codes[:, p], distances[:, p] = code, best
        return codes, distances, looked


def _pass(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Entries moved to the means of their parts."""
    parts, n, width = books.entries.shape
    schema = T.StructType.fromDDL("part int, entry int, n bigint, " + ", ".join(f"s{i} bigint" for i in range(width)))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, n), np.int64), np.zeros((parts, n, width), np.int64)
        for x in _rows(batches, books):
            codes, _, _ = books.nearest(x[1])
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=n)
                np.add.at(total[p], codes[:, p], x[1][:, p * width : (p + 1) * width])
        give_back()
        part, entry = np.nonzero(count)
        sums = [total[part, entry, i] for i in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), *map(pa.array, sums)], names=schema.names)

    exact = "decimal(38,0)"
    found = vectors.select("v").mapInArrow(add_up, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s{i}").cast(exact)).alias(f"s{i}") for i in range(width)])
    moved = books.entries.copy()
    for r in found.collect():  # parts x entries rows at most
        moved[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return Codebooks(moved, books.scale)


def _rows(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the rows that have a usable vector, and their integers."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            kept, x = integers(part.column(part.num_columns - 1), books.scale, books.dims, LIMIT)
            if len(kept):
                yield (part if len(kept) == part.num_rows else part.take(pa.array(kept))), x.astype(np.int64)


def fit(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> Codebooks:
    """Codebooks of all vectors."""
    bound_batches(rows.sparkSession)
    vectors = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).filter(usable("v"))
    lengths = vectors.filter(F.size("v") % parts == 0).groupBy(F.size("v").alias("size")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    if most is None:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    first = vectors.filter((F.size("v") == most["size"]) & F.col("id").isNotNull()).orderBy("id", "v").limit(entries).collect()  # the codebooks' first entries
    _, x = integers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), scale, most["size"], LIMIT)
    books = Codebooks(np.ascontiguousarray(x.astype(np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        books = _pass(vectors, books)
    return books


def encode(rows: DataFrame, books: Codebooks, vector_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Rows with a usable vector, with ``code`` (two hex digits a part) and ``error`` (squared distance to what the code stands for)."""
    bound_batches(rows.sparkSession)
    carried = [c for c in (rows.columns if keep is None else keep) if c.lower() not in ("code", "error")]
    source = rows.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{vector_col}`").alias("__v"))
    schema = T.StructType([*source.schema.fields[:-1], *T.StructType.fromDDL("code string, error bigint").fields])
    if not books.entries.size:
        return rows.sparkSession.createDataFrame([], schema)
    names = [f"{i:02x}" for i in range(books.entries.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for part, x in _rows(batches, books):
            codes, distances, _ = books.nearest(x)
            text = ["".join([names[i] for i in row]) for row in codes.tolist()]
            made = [*part.columns[:-1], pa.array(text), pa.array(distances.sum(axis=1))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, kinds, strict=True)], names=schema.names)
        give_back()

    return source.filter(F.col("__v").isNotNull()).mapInArrow(run, schema)


def decode(coded: DataFrame, books: Codebooks, out: str = "decoded") -> DataFrame:
    """Add ``out``, the vector that each code stands for: the middles of its integers' intervals, scaled back. Column functions only."""
    parts, n, width = books.entries.shape
    middles = ((books.entries + 0.5) / books.scale).reshape(parts * n, width).tolist()
    book = F.array(*[F.array(*map(F.lit, x)) for x in middles])
    entry = lambda p: F.conv(F.substring("code", p * 2 + 1, 2), 16, 10).cast("int")
    return coded.withColumn("__book", book).withColumn(out, F.flatten(F.array(*[F.element_at("__book", entry(p) + p * n + 1) for p in range(parts)]))).drop("__book")


def with_group_error(coded: DataFrame, by: str = "label", out: str = "label_error") -> DataFrame:
    """Add the error summed over equal values of ``by``, nulls together; sums are made before any row is shuffled, and the join can be split."""
    sums = coded.groupBy(F.col(by).alias("__by")).agg(F.sum("error").alias(out))
    return coded.join(sums, coded[by].eqNullSafe(sums["__by"])).drop("__by")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    books = fit(rows)
    coded = stash(encode(rows, books, keep=["vec_id", "label"]), "vector-codes")
    return with_group_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


_DISTANCE = "CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _sql() -> str:
    """The same in SQL, a pair of tables for each round."""
    assign = lambda r: f"a{r} AS MATERIALIZED (SELECT id, part, v, entry, {_DISTANCE} AS d FROM p JOIN s{r} USING (part) QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY {_DISTANCE}, entry) = 1)"
    move = lambda r: f"""m{r} AS (SELECT part, entry, list(x ORDER BY i) AS c FROM (SELECT part, entry, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x FROM a{r}, range(1, {64 // PARTS + 1}) t(i) GROUP BY ALL) GROUP BY ALL),
s{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.c, s{r}.c) AS c FROM s{r} LEFT JOIN m{r} USING (part, entry))"""  # noqa: E731
    steps = ",\n".join(f"{assign(r)},\n{move(r)}" for r in range(ROUNDS))
    w = 64 // PARTS
    return f"""WITH k AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT id, part, e[part * {w} + 1 : part * {w} + {w}] AS v FROM k, range({PARTS}) r(part)),
s0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS entry, v AS c FROM p WHERE id IN (SELECT id FROM k ORDER BY id LIMIT {ENTRIES})),
{steps},
{assign(ROUNDS)},
coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id),
whole AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM s{ROUNDS})
SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN k USING (id), whole"""


ORACLE_SQL = _sql()
