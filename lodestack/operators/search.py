"""Vector search: a stated set of queries against all rows, in blocks.

Rows and queries are packed into blocks of a bounded size. Every block of rows
meets every block of queries, is scored as a product of matrices, and keeps its
best k rows for each query, so what is shuffled is k rows for each query and
block. The blocks of queries are broadcast where their measured size is small,
and joined by their number where it is not; none goes through the driver's
Python.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Of the queries of one block, and of the queries that are broadcast.
BLOCK_BYTES, BROADCAST_BYTES = 8 << 20, 32 << 20
#: Rows of one block, and the numbers that a task scores at once.
BLOCK_ROWS, SCORED = 8192, 1 << 20
DIGITS = 6


def cosine_scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """rows x queries; 0 where either vector has no length."""
    n = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None]
    return np.divide(rows @ queries.T, n, out=np.zeros_like(n), where=n > 0)


def leading_dot(size: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Dot product of the first ``size`` numbers."""
    return lambda rows, queries: rows[:, :size] @ queries[:, :size].T


def top_k(
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    score: Callable[[np.ndarray, np.ndarray], np.ndarray] = cosine_scores,
    query_col: str = "query_id",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k best rows of each query, itself left out.

    Scores have six decimals; ties go to the smaller id. Rows and queries
    without a vector take no part.
    """
    q = queries.select(F.col(query_col).alias("id"), F.col(vector_col).alias("v")).filter("v is not null and size(v) > 0")
    size = q.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    asked = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(_pack_queries, "block int, queries binary")
    plain = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("v is not null and size(v) > 0")
    packed = plain.mapInPandas(_pack_rows, "rows binary").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = packed.join(F.broadcast(asked) if size <= BROADCAST_BYTES else asked, "block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for mine, theirs in zip(pdf["rows"], pdf["queries"]):
                (own, vectors), (ids, wanted) = pickle.loads(mine), pickle.loads(theirs)
                step = max(1, SCORED // len(own))
                for a in range(0, len(ids), step):
                    yield _best(own, ids[a : a + step], np.round(score(vectors, wanted[a : a + step]), DIGITS) + 0.0, k)

    found = met.select("rows", "queries").mapInPandas(search, f"query_id {dict(queries.dtypes)[query_col]}, chunk_id {dict(rows.dtypes)[id_col]}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _matrix(pdf: pd.DataFrame) -> bytes:
    return pickle.dumps((pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype(np.float64)), protocol=5)


def _pack_queries(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "queries": [_matrix(pdf)]})


def _pack_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for a in range(0, len(pdf), BLOCK_ROWS):
            yield pd.DataFrame({"rows": [_matrix(pdf.iloc[a : a + BLOCK_ROWS])]})


def _best(own: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of each query by score and then id, the query itself left out."""
    order = np.argsort(own, kind="stable")
    own, s = own[order], np.where(own[order][:, None] == ids[None], -np.inf, s[order])
    best = np.argsort(-s, axis=0, kind="stable")[:k]
    top = np.take_along_axis(s, best, 0)
    keep = top > -np.inf
    query = np.broadcast_to(ids, best.shape)
    return pd.DataFrame({"query_id": query[keep], "chunk_id": own[best][keep], "score": top[keep]})
