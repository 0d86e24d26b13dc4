"""Near-duplicate classes by BagMinHash, banding and exact multiset overlap.

A text is the bag of its five-word shingles. Every shingle owns Poisson
processes on the discretised weight axis: one on [0, 1), and one on each
doubling interval [1, 2), [2, 4), [4, 8) ... up to its count, so a count c
costs about log2(c) processes. A process of an interval of width w has points
at rate ``w`` for each of the ``M`` signature components; a point carries a
weight inside the interval and counts if that is below the shingle's count.
A component keeps the earliest point that counts, which two bags share with a
probability equal to their weighted Jaccard similarity. Points are drawn in
time order and a process stops once it is later than the latest component.

Texts of the same words are one node, known by a 128-bit digest. Signatures are
cut into ``BANDS`` bands of ``ROWS`` components. Inside a band's bucket:

1. Every member is compared with the bucket's head, the member that shares most
   buckets; those that are left out of its class are compared with a head of
   their own. Links join classes.
2. A member a that is still apart from its bucket's class (the largest that the
   members meet) may be linked with a member b of that class or with another one
   that is apart from it. Let R be
   what most of some members of the class have (any set R will do). What a and b
   have in common lies in R or outside of it. If they share nothing outside R,
   then with m the smaller of their overlaps with R their similarity is at most
   m / (|a| + |b| - m), which leaves few sizes of b. So the pairs to compare are
   those that share an item outside R (an equi-join of the items outside R) and
   those of such sizes (an equi-join by size). Of the items outside R only the
   rarest take part, as many as a prefix filter needs.

So no link between texts that share a bucket is lost, and a large group of
texts, most of which resemble one of them, costs its size and not its square.
Overlaps are counted exactly. The members of a large bucket or class are dealt
over several keys in joins; what is grouped by bucket or class is added up in
parts first.

Defined results: a text of one to four words is one shingle; null text and text
without words are alone in their class; rows with a null id have a class of
null if it holds no other id; copies and repeated rows share a class; empty
tables give empty results. A pair with a similarity of 0.8 has an equal band
with a probability of 0.99994.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import SPACE, drop, mix, slices, split_words, stash, texts_of

SHINGLE = 5
THRESHOLD = 0.8
#: Members of a class that say what most of it has; any number gives the same links.
MODELS = 31
ROWS, BANDS = 6, 32
#: Members of a bucket, or of a class, that a join puts together; more of them are dealt over several keys.
TOGETHER, CLASS_KEYS = 500, 16
M = ROWS * BANDS
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def shingle_bags(texts: list[bytes | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """(text, shingle hash, count) of every distinct shingle, and each text's digest (None without words)."""
    w = split_words(texts, SPACE)
    counts, h = w.counts(), w.hashes()
    buf = w.bytes_of()
    digests = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        digests.append(hashlib.blake2b(buf[w.start[a] : w.end[b - 1]], digest_size=16).digest() if b > a else None)
    size = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    text = np.repeat(np.arange(len(texts)), size)
    at = np.repeat(w.first[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    length = np.minimum(counts, n)[text]
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        ok = k < length
        out[ok] = mix(out[ok] * _C1 + h[at[ok] + k] + np.uint64(k + 1))
    order = np.lexsort((out, text))
    text, out = text[order], out[order]
    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (out[1:] != out[:-1])))) if len(out) else np.zeros(0, np.int64)
    return text[new], out[new], np.diff(np.concatenate((new, [len(out)]))), digests


def bag_min_hash(doc: np.ndarray, item: np.ndarray, count: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """n_docs x m identities of the earliest points; 0 for bags without items."""
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64) + 1, 1)
    owner = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    d, bound = doc[owner], count[owner].astype(np.float64)
    whole = low + width <= bound  # every point of the interval counts
    seed = mix(item[owner] + level.astype(np.uint64) * _C2)
    t = np.zeros(len(owner))
    best = np.full(n_docs * m, np.inf)
    ident = np.zeros(n_docs * m, np.uint64)
    r = 0
    while len(t):
        r += 1
        x = mix(seed + np.full(1, r, np.uint64) * _C1)
        t = t - np.log(((x >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53) / (width * m)
        y = mix(x ^ _C2)
        slot = d * m + (y % np.uint64(m)).astype(np.int64)
        z = mix(y + _C1)
        counts = whole | (low + width * ((z >> np.uint64(11)).astype(np.float64) / 2.0**53) < bound)
        hit = np.flatnonzero(counts & (t < best[slot]))
        hit = hit[np.argsort(-t[hit], kind="stable")]  # the earliest is written last
        best[slot[hit]] = t[hit]
        ident[slot[hit]] = z[hit]
        live = np.flatnonzero(t < best.reshape(n_docs, m).max(1)[d])
        t, d, low, width, bound, whole, seed = (v[live] for v in (t, d, low, width, bound, whole, seed))
    return ident.reshape(n_docs, m)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, m = signature.shape
    parts = signature.reshape(n, m // rows, rows)
    key = np.broadcast_to(np.arange(m // rows, dtype=np.uint64), (n, m // rows)) * _C2
    for k in range(rows):
        key = mix(key * _C1 + parts[:, :, k])
    return key.astype(np.int64)


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            doc, item, count, digests = shingle_bags(texts_of(part.column("text")))
            keys = band_keys(bag_min_hash(doc, item, count, part.num_rows))
            offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS)
            bands = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)), mask=pa.array([x is None for x in digests]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(digests, pa.binary()), bands], names=["doc_id", "text_key", "node", "bands"])

    return source.mapInArrow(run, f"doc_id {kind}, text_key bigint, node binary, bands array<bigint>")


def _bags(docs: DataFrame) -> DataFrame:
    """(node, items): the bag as a set, the k-th copy of a shingle being an item of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            doc, item, count, digests = shingle_bags(texts_of(part.column("text")))
            copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            keys = mix(np.repeat(item, count) + copy.astype(np.uint64) * _C2).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(np.bincount(np.repeat(doc, count), minlength=part.num_rows))))
            items = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), items], names=["node", "items"])

    return docs.select("text").mapInArrow(run, "node binary, items array<bigint>")


def _compared(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """Add ``sim``, the weighted Jaccard similarity of nodes ``a`` and ``b``."""
    one = bags.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    two = bags.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    both = pairs.join(one, "a").join(two, "b").withColumns({"na": F.size("items_a"), "nb": F.size("items_b"), "both": F.size(F.array_intersect("items_a", "items_b"))})
    return both.withColumn("sim", F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b", "sim")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) is connected with.

    Labels take the smallest label of the neighbours and then their label's
    label, so paths shorten by half; every round is a written table.
    """
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), name)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        upper = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = stash(step.join(upper, "label", "left").select("node", "old", F.least("label", "up").alias("label")), name)
        drop(labels)
        labels = new.select("node", "label")
        if new.filter("old <> label").isEmpty():
            drop(both)
            return labels


def _relabel(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Labels after joining the classes at the ends of ``links`` (la, lb)."""
    merged = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), name)
    out = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    return stash(out.select("node", F.coalesce("to", "label").alias("label")), name)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``text_key`` (hash of its
    text), ``node`` (digest of its words), ``class_id`` (the smallest id of its
    class) and ``first`` (it is the row that stands for its class; copies of a
    row with the same id are all first).
    """
    sig = stash(_signatures(docs, id_col, text_col), "near-signatures")
    # Copies of a text have equal bands: counting distinct texts needs one row of each.
    bands = sig.filter("node is not null").groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    multi = stash(bands.join(sizes, "bucket"), "near-buckets")
    if multi.isEmpty():
        labels = multi.select("node", F.col("node").alias("label"))
    else:
        labels = _link(docs, id_col, text_col, sig, multi, threshold)
    rows = sig.select("doc_id", "text_key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    classes = rows.filter("label is not null").groupBy("label").agg(F.min(order).alias("least"))
    alone = F.col("label").isNull()
    return rows.join(classes, "label", "left").select(
        "doc_id", "text_key", "node",
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.id")).alias("class_id"),
        (alone | (order == F.col("least"))).alias("first"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, one of each class."""
    judged = stash(near_duplicates(docs, id_col, text_col, threshold).select("doc_id", "text_key", "node", "first"), "near-classes")
    losers = judged.filter("not first").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    # The whole row as one column, so that no name in it can clash.
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{id_col}`").alias("__own"), F.xxhash64(text).alias("__text_key"), F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("__word"))
    left = keyed.join(losers, keyed["__own"].eqNullSafe(losers["__id"]) & (keyed["__text_key"] == losers["__key"]), "left_anti")
    copies = judged.filter("first and node is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1")
    if not copies.isEmpty():  # whole rows that come more than once
        left = left.filter("__word").dropDuplicates(["__own", "__text_key"]).unionByName(left.filter("not __word"))
    return left.select("__row.*")


def _link(docs: DataFrame, id_col: str, text_col: str, sig: DataFrame, multi: DataFrame, threshold: float) -> DataFrame:
    support = multi.groupBy("node").agg(F.sum("n").alias("support"))
    keys = F.ceil(F.col("n") / TOGETHER).cast("int")
    multi = stash(multi.join(support, "node").select("bucket", "node", "support", keys.alias("keys"), F.pmod(F.xxhash64("node"), keys.cast("bigint")).cast("int").alias("key")), "near-buckets")
    # A row for every bucket, for each key that the bucket's members are dealt over.
    dealt = lambda df: df.withColumn("key", F.explode(F.sequence(F.lit(0), F.col("keys") - 1))).drop("keys")
    keys, by = F.max("keys").alias("keys"), ["bucket", "key"]
    wanted = support.select("node")
    # Whole texts of the nodes in question, from one row each.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    source = sig.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(order).alias("o")).select("o.__id", "o.__key")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    rows = rows.join(source, rows["doc_id"].eqNullSafe(source["__id"]) & (rows["text_key"] == source["__key"]), "left_semi")
    bags = stash(_bags(rows.dropDuplicates(["doc_id", "text_key"])), "near-bags")

    heads = multi.groupBy("bucket").agg(F.max(F.struct("support", "node"))["node"].alias("head"), keys)
    with_head = multi.join(dealt(heads), by).filter("node <> head")
    pairs = with_head.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    judged = stash(_compared(pairs, bags), "near-judged")
    loops = wanted.select(F.col("node").alias("a"), F.col("node").alias("b"))
    labels = components(loops.union(judged.filter(F.col("sim") >= threshold).select("a", "b")), "near-labels")

    ends = lambda side, df=None: (labels if df is None else df).select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    left = with_head.join(labels, "node").join(ends("head"), "head").filter("label <> lhead")
    second = left.groupBy("bucket").agg(F.max(F.struct("support", "node", "label")).alias("h"), keys).select("bucket", F.col("h.node").alias("b"), F.col("h.label").alias("lb"), "keys")
    pairs = left.join(dealt(second), by).filter("label <> lb").select(F.col("node").alias("a"), "b").distinct()
    labels = _judge(pairs, bags, labels, threshold, "near-second")

    # A bucket's class is the largest that its members meet in their buckets; nodes apart from it, with its members.
    # A class may hold a third of all members: what is known of it goes to them by several keys.
    every_share = F.explode(F.sequence(F.lit(0), F.lit(CLASS_KEYS - 1)))
    sizes = labels.groupBy("label").agg(F.count("*").alias("size")).filter("size > 1").withColumn("share", every_share)
    share = F.pmod(F.xxhash64("bucket", "node"), F.lit(CLASS_KEYS)).cast("int")
    placed = multi.select("bucket", "key", "keys", "node").join(labels, "node").withColumn("share", share).join(sizes, ["label", "share"], "left")
    placed = stash(placed.select("bucket", "key", "keys", "node", "label", F.coalesce("size", F.lit(1)).alias("size")), "near-placed")
    mixed = placed.groupBy("bucket").agg(F.max(F.struct("size", "label")).alias("top"), F.min("label").alias("low"), F.max("label").alias("high"), keys)
    home = placed.select("bucket", "key", "node").join(dealt(mixed.select("bucket", "top", "keys")), by).groupBy("node").agg(F.max("top").alias("home"))
    met = placed.join(dealt(mixed.filter("low <> high").select("bucket", "keys")), by, "left_semi").join(home, "node")
    cls = met.groupBy("bucket").agg(F.max("home")["label"].alias("cls"), keys)
    away = stash(met.join(dealt(cls), by).filter("label <> cls").select("node", "label", "cls").distinct(), "near-away")
    inside = labels.join(away.select(F.col("cls").alias("label")).distinct(), "label", "left_semi").select("node", "label", F.col("label").alias("cls"))
    some = Window.partitionBy("cls").orderBy(F.xxhash64("node"), "node")
    models = inside.withColumn("place", F.row_number().over(some)).filter(F.col("place") <= MODELS)
    votes = models.join(bags, "node").select("cls", F.explode("items").alias("item")).groupBy("cls", "item").agg(F.count("*").alias("votes"))
    quorum = models.groupBy("cls").agg(F.count("*").alias("models"))
    common = votes.join(quorum, "cls").filter("votes * 2 > models").groupBy("cls").agg(F.collect_list("item").alias("common"))
    both = away.withColumn("apart", F.lit(True)).unionByName(inside.withColumn("apart", F.lit(False))).join(bags, "node")
    both = both.withColumn("share", F.pmod(F.xxhash64("node"), F.lit(CLASS_KEYS)).cast("int")).join(common.withColumn("share", every_share), ["cls", "share"], "left")
    shared = F.coalesce("common", F.array().cast("array<bigint>"))
    around = both.select("cls", "node", "label", "apart", F.size("items").alias("na"), F.size(F.array_intersect("items", shared)).alias("both"), F.array_except("items", shared).alias("outside"))
    around = stash(around, "near-around")
    apart = around.filter("apart")
    t = threshold
    # Of a's items outside R at most (1 - t)|a| are not in b, so the first common one in any fixed order,
    # the rarest first, is among that many and one of either.
    long = around.select("cls", "node", "label", "apart", "na", F.explode("outside").alias("item"))
    long = long.withColumn("often", F.count("*").over(Window.partitionBy("cls", "item")))
    rarest = F.row_number().over(Window.partitionBy("cls", "node").orderBy("often", "item"))
    first = stash(long.withColumn("place", rarest).filter(F.col("place") <= F.floor((1 - t) * F.col("na") + 1e-9) + 1).filter("often > 1"), "near-rarest")
    items = lambda df, tag: df.select("cls", "item", F.col("node").alias(f"a{tag}"), F.col("label").alias(f"l{tag}"), F.col("apart").alias(f"apart{tag}"), F.col("na").alias(f"n{tag}"))
    # Two members that are both apart meet once, in the order of their digests.
    once = (F.col("l1") != F.col("l2")) & (~F.col("apart2") | (F.col("a1") < F.col("a2"))) & (F.col("n1") >= t * F.col("n2") - 1e-9) & (F.col("n2") >= t * F.col("n1") - 1e-9)
    sharing = items(first.filter("apart"), 1).join(items(first, 2), ["cls", "item"]).filter(once)
    sizes = F.sequence(F.ceil(t * F.col("na") - 1e-9), F.floor(F.least(F.col("both") * (1 + t) / t - F.col("na"), F.col("na") / t) + 1e-9))
    any_size = F.ceil(t * F.col("na") - 1e-9) <= F.floor(F.least(F.col("both") * (1 + t) / t - F.col("na"), F.col("na") / t) + 1e-9)
    fit = apart.filter(any_size).select("cls", F.explode(sizes).alias("size"), F.col("node").alias("a1"), F.col("label").alias("l1"), F.col("na").alias("n1"))
    others = around.select("cls", F.col("na").cast("bigint").alias("size"), F.col("node").alias("a2"), F.col("label").alias("l2"), F.col("both").alias("both2"))
    sized = fit.join(others, ["cls", "size"]).filter((F.col("l1") != F.col("l2")) & (F.col("both2") >= t * (F.col("n1") + F.col("size")) / (1 + t) - 1e-9))
    both = sharing.select("a1", "a2").union(sized.select("a1", "a2"))
    pairs = both.select(F.least("a1", "a2").alias("a"), F.greatest("a1", "a2").alias("b")).distinct()
    out = _judge(pairs, bags, labels, threshold, "near-rest")
    drop(multi, bags, judged, placed, away, around, first)
    return out


def _judge(pairs: DataFrame, bags: DataFrame, labels: DataFrame, threshold: float, name: str) -> DataFrame:
    found = _compared(pairs, bags).filter(F.col("sim") >= threshold)
    ends = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    links = stash(found.join(ends("a"), "a").join(ends("b"), "b").filter("la <> lb").select("la", "lb").distinct(), f"{name}-links")
    return labels if links.isEmpty() else _relabel(labels, links, name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id")


def brute_force(docs: list[tuple], threshold: float = THRESHOLD) -> dict:
    """Class of each id by comparing all pairs; for tests."""
    import re
    from collections import Counter

    bags, root = {}, {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        bags[i] = Counter(tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))) if w else Counter()
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, total = list(bags), {i: sum(b.values()) for i, b in bags.items()}
    where: dict = {}
    for i in ids:
        for s in bags[i]:
            where.setdefault(s, []).append(i)
    for i in ids:
        near = Counter()
        for s, c in bags[i].items():
            for j in where[s]:
                if j < i:
                    near[j] += min(c, bags[j][s])
        for j, both in near.items():
            if both / (total[i] + total[j] - both) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}
