"""Hard negatives by one-dimensional distance keys.

Index: vectors of whole numbers get one more component, so that all have the
length of the longest one and the largest inner products are the smallest
distances. Each is assigned to the nearest of a few pivots (fitted on a bounded
sample), and all are stored sorted by (pivot, distance to it), in blocks of
``BLOCK_ROWS`` that lie in one cell of these keys each. Every row is indexed.

Search: a query's distance to a row is at least the difference of their
distances to the row's pivot. So a radius is an interval of keys around the
query's own key, at each pivot. Rounds widen the radius: the rows in the new
part of the intervals (the annuli) are scored, and a query is done when its k-th
best score is above all that the remaining distance allows, or no remaining row
can have the least score asked for. The radius never grows beyond what certifies
the k-th score found so far. Results are exact, ties included.

Queries are packed into blocks of neighbours and joined to the row blocks of the
cells that their intervals meet; they are broadcast up to ``BROADCAST_BYTES`` of
measured size and shuffled beyond. A task keeps the best k of each query over
all blocks that it sees, so what is merged is small, and each query's k-th score
so far keeps others from being listed. Pivots and cells, of a size fixed by
parameters, are all that the driver holds.

Mining: an anchor's positives are its best rows of the same label, by a search
for equal labels; a second search, for other labels with scores between a share
of each positive's score and that score, gives all negatives of an anchor at once.

Defined results: rows with a null id or label, a null or empty vector, a null
or non-finite component, or another length than most (of ties the largest) take
no part. Ties go to the smaller id. Of anchors with equal ids the smallest
(label, vector) asks; each other repeated row counts as a row; rows of the
anchor's own id are never among its results. An empty table gives no rows.
Scores are exact while squared lengths stay below 2^53, and longer vectors are
an error. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrow import bound_batches, drop, give_back, stash
from .vector_rows import integers, usable

SCALE = 256.0
#: Pivots, and the rows that they, the cells and the first radius are fitted on (those of the smallest hashes of their ids).
PIVOTS, SAMPLE = 16, 4096
BLOCK_ROWS, QUERY_ROWS = 4096, 512
#: Cells of all pivots at most; rows that a cell is made for.
CELLS, CELL_ROWS = 4096, 16384
#: Share of rows that the first annuli hold, by the sample; growth of the radius from round to round.
FIRST, WIDER = 0.02, 16.0
BROADCAST_BYTES = 32 << 20
#: Scores that a task works out at once; query blocks whose best rows it keeps.
SCORED, HELD = 1 << 19, 64


@dataclass(frozen=True)
class Index:
    """``blocks``: pivot, cell, lo, hi, rows. ``top``: the largest squared length. ``cuts``: the cells' inner limits at each pivot."""

    blocks: DataFrame | None
    pivots: np.ndarray
    top: float
    cuts: list[np.ndarray]
    first: float
    dims: int
    id_type: T.DataType
    label_type: T.DataType
    scale: float

    def light(self) -> Index:
        """Without the blocks, as tasks need it."""
        return replace(self, blocks=None)

    def keys(self, x: np.ndarray, last: np.ndarray | float) -> np.ndarray:
        """Distances of augmented vectors to all pivots."""
        square = (x * x).sum(1) + np.square(last)
        d = square[:, None] + (self.pivots**2).sum(1)[None] - 2 * (x @ self.pivots[:, :-1].T + np.multiply.outer(np.broadcast_to(last, len(x)), self.pivots[:, -1]))
        return np.sqrt(np.maximum(d, 0))

    def slack(self, square: np.ndarray) -> np.ndarray:
        """More than what rounding can do to a distance."""
        return 1e-6 + 1e-7 * (np.sqrt(square) + np.sqrt(self.top))

    def reach(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The radius beyond which no row has ``score`` or more."""
        both = square + self.top
        return np.sqrt(np.maximum(both - 2 * score + 1 + both * 1e-12, 0)) + 2 * self.slack(square)


def _last(x: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - (x * x).sum(1), 0))


def _fit_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Far points of the sample, then moved to the means of their surroundings a few times."""
    chosen = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    nearest = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(1))
    pivots = x[chosen].copy()
    for _ in range(5):
        near = ((x * x).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T).argmin(1)
        for j in range(len(pivots)):
            if (near == j).any():
                pivots[j] = x[near == j].mean(0)
    return pivots


def build(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = SCALE, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> Index | None:
    """Index of all rows with an id, a label and a usable vector; None if there are none."""
    spark = rows.sparkSession
    bound_batches(spark)
    vectors = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    most = vectors.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if most is None:
        return None
    dims, total = most["size"], most["count"]
    vectors = vectors.filter(F.size("v") == dims)

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = 0.0
        for batch in batches:
            _, x = integers(batch.column(0), scale, dims, 1 << 26)
            square = max(square, float((x * x).sum(1).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([square])], names=["square"])

    top = vectors.select("v").mapInArrow(longest, "square double").agg(F.max("square")).first()[0]
    if top >= 1 << 53:
        raise ValueError("vectors too long for exact scores")
    some = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").collect()  # of a fixed size
    _, x = integers(pa.array([r["v"] for r in some], pa.list_(pa.float64())), scale, dims, 1 << 26)
    last = _last(x, top)
    centres = _fit_pivots(np.concatenate((x, last[:, None]), 1), min(pivots, len(x)))
    id_type, label_type = vectors.schema["id"].dataType, vectors.schema["label"].dataType
    draft = Index(None, centres, top, [], 0.0, dims, id_type, label_type, scale)
    keys = draft.keys(x, last)
    home = keys.argmin(1)
    per_pivot = max(1, min(CELLS, -(-total // cell_rows)) // len(centres))
    cuts = [np.unique(np.quantile(own, np.arange(1, per_pivot) / per_pivot)) if len(own := keys[home == j, j]) and per_pivot > 1 else np.zeros(0) for j in range(len(centres))]
    asking = draft.keys(x[:256], 0.0)
    gaps = np.abs(keys[np.arange(len(x)), home][None] - asking[:, home])
    first = max(1.0, float(np.quantile(gaps, FIRST)))

    schema = T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("key", T.DoubleType()), T.StructField("id", id_type), T.StructField("label", label_type), T.StructField("x", T.BinaryType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [f.type for f in to_arrow_schema(schema)]
        for batch in batches:
            kept, x = integers(batch.column(2), scale, dims, 1 << 26)
            keys = draft.keys(x, _last(x, top))
            home = keys.argmin(1)
            own = keys[np.arange(len(x)), home]
            cell = np.zeros(len(x), np.int32)
            for j in np.unique(home):
                cell[home == j] = np.searchsorted(cuts[j], own[home == j], side="right")
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dims * 4), len(x), [None, pa.py_buffer(x.astype("<i4").tobytes())])
            made = [pa.array(home.astype(np.int32)), pa.array(cell), pa.array(own), batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept)), raw]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(made, kinds, strict=True)], names=schema.names)
        give_back()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, n = [], 0
        for pdf in batches:
            for _, part in pdf.groupby((pdf[["pivot", "cell"]].diff() != 0).any(axis=1).cumsum(), sort=False):
                if open_ and (open_[-1]["pivot"].iloc[-1], open_[-1]["cell"].iloc[-1]) != (part["pivot"].iloc[0], part["cell"].iloc[0]):
                    yield _block(pd.concat(open_), dims)
                    open_, n = [], 0
                while len(part):
                    room = part.iloc[: block_rows - n]
                    part = part.iloc[block_rows - n :]
                    open_.append(room)
                    n += len(room)
                    if n >= block_rows:
                        yield _block(pd.concat(open_), dims)
                        open_, n = [], 0
        if open_:
            yield _block(pd.concat(open_), dims)
        give_back()

    order = ["pivot", "key", "id"]
    placed = vectors.mapInArrow(place, schema).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = stash(placed.mapInPandas(pack, "pivot int, cell int, lo double, hi double, rows binary"), "distance-keys")
    return Index(blocks, centres, top, cuts, first, dims, id_type, label_type, scale)


def _block(pdf: pd.DataFrame, dims: int) -> pd.DataFrame:
    x = np.frombuffer(b"".join(pdf["x"]), "<i4").reshape(-1, dims)
    key = pdf["key"].to_numpy()
    blob = pickle.dumps((pdf["id"].to_numpy(), pdf["label"].to_numpy(), key, x), protocol=5)
    return pd.DataFrame({"pivot": [pdf["pivot"].iloc[0]], "cell": [pdf["cell"].iloc[0]], "lo": [key[0]], "hi": [key[-1]], "rows": [blob]})


@dataclass
class _Asked:
    """A block of queries. Slots: limits of the scores asked for, and the k-th score so far (-inf: fewer than k)."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    keys: np.ndarray
    seen: np.ndarray
    radius: np.ndarray
    most: np.ndarray
    least: np.ndarray
    floor: np.ndarray


class _Best:
    """The best k rows of each (query, slot) of a block that a task has seen."""

    def __init__(self, q: _Asked, k: int):
        self.q, self.k, self.floor = q, k, q.floor.copy()
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, slot: int, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.found.append((np.full(len(query), slot), query, score, ids))
        if sum(len(x[1]) for x in self.found) > 4 * self.k * self.floor.size + 10_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.found:
            return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, self.q.ids.dtype))
        slot, query, score, ids = (np.concatenate(x) for x in zip(*self.found))
        order = np.argsort(ids, kind="stable")
        order = order[np.lexsort((-score[order], query[order], slot[order]))]  # stable: ties stay in the order of ids
        slot, query, score, ids = slot[order], query[order], score[order], ids[order]
        new = np.flatnonzero(np.concatenate(([True], (slot[1:] != slot[:-1]) | (query[1:] != query[:-1]))))
        place = np.arange(len(slot)) - np.repeat(new, np.diff(np.append(new, len(slot))))
        full = place == self.k - 1
        np.maximum.at(self.floor, (query[full], slot[full]), score[full])
        keep = place < self.k
        self.found = [(slot[keep], query[keep], score[keep], ids[keep])]
        return self.found[0]


def _scan(pivot: int, rows: tuple, q: _Asked, best: _Best, same: bool) -> int:
    """Score the rows of a block that lie in the queries' new annuli; gives how many."""
    ids, labels, key, x = rows
    own = q.keys[:, pivot]
    # Queries whose interval meets the block, and has not covered it before.
    near, far = np.maximum(np.maximum(key[0] - own, own - key[-1]), 0), np.maximum(np.abs(key[0] - own), np.abs(key[-1] - own))
    use = np.flatnonzero((near <= q.radius) & (far > q.seen))
    step, scored = max(1, SCORED // len(ids)), 0
    x = x.astype(np.float64)
    for a in range(0, len(use), step):
        u = use[a : a + step]
        gap = np.abs(key[:, None] - own[u][None])
        ok = (gap <= q.radius[u]) & (gap > q.seen[u])
        scored += int(ok.sum())
        ok &= (labels[:, None] == q.labels[u][None]) == same
        ok &= ids[:, None] != q.ids[u][None]
        s = x @ q.x[u].T
        for slot in range(q.most.shape[1]):
            r, c = np.nonzero(ok & (s <= q.most[u, slot]) & (s >= np.maximum(q.least[u, slot], best.floor[u, slot])))
            if len(r):
                best.add(slot, u[c], s[r, c], ids[r])
    return scored


def _ask(index: Index, queries: DataFrame) -> DataFrame:
    """Rows of (id, label, v, most, least) as the search's state, with the first radius."""
    index = index.light()
    id_field, label_field = T.StructField("id", index.id_type), T.StructField("label", index.label_type)
    schema = T.StructType([id_field, label_field, *T.StructType.fromDDL("x binary, most array<double>, least array<double>, floor array<double>, seen double, radius double, home int, near double").fields])

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.floor(np.stack(pdf["v"].to_numpy()).astype(np.float64) * index.scale) if len(pdf) else np.zeros((0, index.dims))
            keys = index.keys(x, 0.0)
            out = pdf[["id", "label", "most", "least"]].assign(x=[r.tobytes() for r in x], floor=[[-np.inf] * len(m) for m in pdf["most"]], seen=-1.0, radius=index.first, home=keys.argmin(1) if len(x) else 0, near=keys.min(1) if len(x) else 0.0)
            yield out[schema.names]

    return queries.filter(F.size("v") == index.dims).select("id", "label", "v", "most", "least").mapInPandas(start, schema)


def _widen(index: Index, state: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The queries that are not done, with the radius of the next round."""
    index = index.light()
    kth = found.groupBy("query_id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k)
    maps = kth.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "s"))).alias("__kth"))  # as many as slots
    joined = state.join(maps, state["id"] == maps["query_id"], "left").drop("query_id")
    floor = F.transform("floor", lambda f, i: F.coalesce(F.col("__kth")[i], f))
    joined = joined.withColumn("floor", F.when(F.col("__kth").isNotNull(), floor).otherwise(F.col("floor"))).drop("__kth")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            radius = []
            for x, most, least, floor, r in zip(pdf["x"], pdf["most"], pdf["least"], pdf["floor"], pdf["radius"], strict=True):
                x, most, least, floor = np.frombuffer(x), np.asarray(most, float), np.asarray(least, float), np.asarray(floor, float)
                square = float(x @ x)
                all_of = np.sqrt(square) + 2 * np.sqrt(index.top) + 1
                needed = np.where(np.maximum(floor, least) > -np.inf, index.reach(square, np.where(np.isfinite(least) | np.isfinite(floor), np.maximum(floor, least), 0.0)), all_of)
                needed = np.where(most < least, 0.0, np.minimum(needed, all_of)).max(initial=0.0)
                radius.append(-1.0 if needed <= r else min(needed, max(r, 1.0) * WIDER))
            pdf = pdf.assign(seen=pdf["radius"], radius=radius)
            yield pdf[pdf["radius"] >= 0]

    return joined.mapInPandas(run, state.schema)


def search(index: Index, queries: DataFrame, k: int, same: bool, scored=None) -> DataFrame:
    """(query_id, slot, score, id, rank): the k best rows of each slot of each query.

    ``queries``: (id, label, v, most, least), with the limits of each slot's
    scores; ids are distinct. ``same``: rows of the query's label, else of others.
    ``scored``: an accumulator of the pairs that were scored.
    """
    spark = queries.sparkSession
    bound_batches(spark)
    state, found = stash(_ask(index, queries), "asked"), None
    by = Window.partitionBy("query_id", "slot").orderBy(F.desc("score"), "id")
    while (left := state.agg(F.count("*").alias("n"), F.sum(F.octet_length("x") + 64).alias("size")).first())["n"]:
        asked, keys = _packed(index, state)
        small = left["size"] * 2 <= BROADCAST_BYTES
        hint = F.broadcast if small else lambda df: df
        meets = (F.col("lo") <= F.col("to_key")) & (F.col("hi") >= F.col("from_key"))
        pairs = index.blocks.join(hint(keys), ["pivot", "cell"]).filter(meets).select("pivot", "rows", "block").join(hint(asked), "block")
        new = _score(index, pairs.select("pivot", "rows", "block", "asked"), k, same, scored)
        both = new if found is None else found.drop("rank").unionByName(new)
        merged = stash(both.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k), "nearest")
        wider = stash(_widen(index, state, merged, k), "asked")
        drop(*[x for x in (state, found, asked, keys) if x is not None])
        state, found = wider, merged
    drop(state)
    if found is None:
        found = spark.createDataFrame([], T.StructType([T.StructField("query_id", index.id_type), *T.StructType.fromDDL("slot int, score bigint").fields, T.StructField("id", index.id_type), T.StructField("rank", T.IntegerType())]))
    return found


def _packed(index: Index, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Query blocks, and the intervals of keys that each asks for."""
    index = index.light()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        for pdf in batches:
            for a in range(0, len(pdf), QUERY_ROWS):
                part = pdf.iloc[a : a + QUERY_ROWS]
                x = np.stack([np.frombuffer(b) for b in part["x"]])
                slots = max(map(len, part["most"]))
                filled = lambda c, v: np.array([[*m, *[v] * (slots - len(m))] for m in part[c]], float)
                q = _Asked(part["id"].to_numpy(), part["label"].to_numpy(), x, index.keys(x, 0.0), part["seen"].to_numpy(), part["radius"].to_numpy(), filled("most", -np.inf), filled("least", np.inf), filled("floor", -np.inf))
                yield pd.DataFrame({"block": [uuid.uuid4().hex], "asked": [pickle.dumps(q, protocol=5)]})

    near = state.repartitionByRange("home", "near", "id").sortWithinPartitions("home", "near", "id")
    asked = stash(near.mapInPandas(pack, "block string, asked binary"), "query-blocks")  # written: names are drawn once

    def intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, blob in zip(pdf["block"], pdf["asked"], strict=True):
                q: _Asked = pickle.loads(blob)
                lo, hi = (q.keys - q.radius[:, None]).min(0), (q.keys + q.radius[:, None]).max(0)
                out = []
                for j, cuts in enumerate(index.cuts):
                    a, b = np.searchsorted(cuts, lo[j], side="right"), np.searchsorted(cuts, hi[j], side="right")
                    out += [(name, j, c, lo[j], hi[j]) for c in range(a, b + 1)]
                yield pd.DataFrame(out, columns=["block", "pivot", "cell", "from_key", "to_key"])

    return asked, stash(asked.mapInPandas(intervals, "block string, pivot int, cell int, from_key double, to_key double"), "query-keys")


def _score(index: Index, pairs: DataFrame, k: int, same: bool, scored) -> DataFrame:
    schema = T.StructType([T.StructField("query_id", index.id_type), *T.StructType.fromDDL("slot int, score bigint").fields, T.StructField("id", index.id_type)])

    def give(best: _Best) -> pd.DataFrame:
        slot, query, score, ids = best.cut()
        return pd.DataFrame({"query_id": best.q.ids[query], "slot": slot, "score": score.astype(np.int64), "id": ids})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, _Best] = {}
        for pdf in batches:
            for pivot, rows, name, asked in zip(pdf["pivot"], pdf["rows"], pdf["block"], pdf["asked"], strict=True):
                if name not in held:
                    if len(held) >= HELD:
                        yield give(held.pop(next(iter(held))))
                    held[name] = _Best(pickle.loads(asked), k)
                best = held[name]
                n = _scan(pivot, pickle.loads(rows), best.q, best, same)
                best.cut()
                if scored is not None:
                    scored.add(n)
        for best in held.values():
            yield give(best)
        give_back()

    return pairs.mapInPandas(run, schema)


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: float = SCALE, index: Index | None = None, scored=None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor``: a condition on ``id_col`` and ``label_col``. A negative's score is at most its
    positive's and at least ``share`` (numerator, denominator) of it.
    """
    spark, given = rows.sparkSession, index
    index = index or build(rows, id_col, label_col, vector_col, scale)
    id_type = rows.schema[id_col].dataType.simpleString()
    out = f"anchor_id {id_type}, positive_id {id_type}, rank int, negative_id {id_type}, positive_score bigint, negative_score bigint"
    if index is None:
        return spark.createDataFrame([], out)
    own = rows.filter(is_anchor).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    own = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v")).filter(F.size("v") == index.dims)
    anchors = stash(own.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"), "anchors")
    free = lambda x: F.array(F.lit(float(x)))
    near = search(index, anchors.withColumns({"most": free("inf"), "least": free("-inf")}), positives, True, scored)
    # At most ``positives`` rows an anchor.
    pairs = near.select(F.col("query_id").alias("anchor_id"), (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    slots = pairs.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("s"))

    def least(x: Column) -> Column:
        """The smallest whole score s with part * positive <= whole * s."""
        below = -x["positive_score"] * share[0]
        return (-(below - F.pmod(below, F.lit(share[1]))) / share[1]).cast("double")

    asking = anchors.join(slots, "id").select("id", "label", "v", F.transform("s", lambda x: x["positive_score"].cast("double")).alias("most"), F.transform("s", least).alias("least"))
    hard = search(index, asking, negatives, False, scored)
    drop(anchors, *([] if given else [index.blocks]))
    hard = hard.select(F.col("query_id").alias("anchor_id"), "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(hard, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", changed), F.col("vec_id") % 100 == 0)


ORACLE_SQL = f"""WITH k AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, CAST(list_dot_product(a.e, r.e) AS BIGINT) AS score FROM k a JOIN k r ON a.id <> r.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5"""
