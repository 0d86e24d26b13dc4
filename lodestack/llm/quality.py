"""Quality rules with thresholds learned from the data.

Each text gives integer measures (per word or per line, in millionths). A
log-linear histogram is the quantile sketch of a measure: values below 64 have
buckets of their own, larger ones share a bucket with those of the same five
leading bits after the first, so a quantile is right within 1/32. Histograms
merge by adding counts: they are built for each language and source, merged
into those of a language and of all rows, and give the quartiles. The quartiles
of a language are drawn towards those of all rows, and those of a language and
source towards its language's, with the weight of ``PRIOR`` documents, so a
small group borrows from a large one and thresholds change smoothly as it grows.
A document is kept if every measure lies within ``REACH`` quartile distances of
the quartiles of its own language and source. Where the quartiles are close,
``FLOORS`` take the place of their distance; three of them lie within what the
base rule allows. Learned are documents that pass the base rule.

Words end at 0x20 and 0x09 to 0x0D. Defined results: null text has no words, no
lines and fails the base rule; null languages and sources are groups of their
own; repeated rows count each time; texts of any length are measured whole; an
empty table gives an empty result. A column named as an output is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import SPACE, append_columns, mix, split_words, stash, texts_of

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30  # base rule: words, per cent
PRIOR = 200  # documents that a larger group's quartiles count as
REACH = 3  # quartile distances
#: Measure: (least distance, whether values below the fence fail too), in millionths.
MEASURES = {
    "word_length": (300_000, True),
    "symbols": (5_000, False),
    "dup_lines": (80_000, False),
    "repeats": (50_000, False),
}
FLOORS = {m: d for m, (d, _) in MEASURES.items()}


def repeated_words(h: np.ndarray, first: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Words of each text inside n-word windows that it has twice or more."""
    counts = np.diff(first)
    if len(h) < n:
        return np.zeros(len(counts), np.int64)
    # Doubling: the hash of 2, 4 and 8 words from that of half as many.
    g, width = h, 1
    while width < n:
        g = mix(g[: len(g) - width] * np.uint64(0x9E3779B97F4A7C15) + g[width:])
        width *= 2
    doc = np.repeat(np.arange(len(counts)), counts)[: len(g)]
    inside = np.arange(len(g)) + n <= first[doc + 1]
    at = np.flatnonzero(inside)
    key = mix(g[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))
    _, place, times = np.unique(key, return_inverse=True, return_counts=True)
    at = at[times[place] > 1]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:-1] > 0)))
    return covered[first[1:]] - covered[first[:-1]]


FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"


def measure(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the counts of FIELDS."""

    def run(batch: pa.RecordBatch) -> list:
        texts = texts_of(batch.column("__text"))
        w = split_words(texts, SPACE)
        size = np.array([len(t or b"") + 1 for t in texts])
        raw = np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]), np.uint8)
        ends = np.cumsum(size)
        total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[np.concatenate(([0], ends))])
        chars = total(~SPACE[raw] & ((raw & 0xC0) != 0x80))
        lines, dups = [], []
        for t in texts:
            own = [x for x in (t or b"").split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            lines.append(len(own))
            dups.append(len(own) - len(set(own)))
        return [w.counts(), chars, total(SYMBOLS[raw]), np.array(lines, np.int64), np.array(dups, np.int64), repeated_words(w.hashes(), w.first)]

    return append_columns(docs, text_col, run, FIELDS, keep)


def _values():
    return {
        "word_length": F.expr("case when n_words > 0 then word_chars * 1000000 div n_words else 0 end"),
        "symbols": F.expr("case when n_words > 0 then n_symbols * 1000000 div n_words else 0 end"),
        "dup_lines": F.expr("case when n_lines > 0 then n_dup_lines * 1000000 div n_lines else 0 end"),
        "repeats": F.expr("case when n_words > 0 then n_repeat_words * 1000000 div n_words else 0 end"),
    }


def bucket_of(value: str):
    """Histogram bucket of a non-negative integer column."""
    return F.expr(f"case when {value} < 64 then {value} else (length(bin({value})) - 6) * 32 + shiftright({value}, length(bin({value})) - 6) end")


def top_of(bucket: str):
    """The largest value of a bucket."""
    return F.expr(f"case when {bucket} < 64 then {bucket} else shiftleft(cast({bucket} - ({bucket} div 32 - 1) * 32 + 1 as bigint), cast({bucket} div 32 - 1 as int)) - 1 end")


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """n, q1 and q3 of each measure from sketches merged by ``keys``."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    run = merged.select(*keys, "measure", "bucket", F.sum("n").over(w.orderBy("bucket")).alias("run"), F.sum("n").over(w).alias("n"))
    least = lambda q: F.min(F.when(F.col("run") * 4 >= F.col("n") * q, F.col("bucket")))
    out = run.groupBy(*keys, "measure").agg(F.max("n").alias("n"), least(1).alias("b1"), least(3).alias("b3"))
    return out.select(*keys, "measure", "n", top_of("b1").alias("q1"), top_of("b3").alias("q3"))


def drawn(own: str, n: str, wider: str) -> str:
    """A group's quartile, drawn towards the wider group's by the weight of PRIOR documents; integers, as SQL."""
    return f"({n} * {own} + {PRIOR} * {wider}) div ({n} + {PRIOR})"


def fences(rows: DataFrame, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Lowest and highest value that is kept, for each group and measure.

    ``rows``: the groups' columns and a ``values`` map of the measures of the
    rows to learn from.
    """
    one, two = keys
    long = rows.select(one, two, F.explode("values").alias("measure", "value"))
    sketch = stash(long.groupBy(one, two, "measure", bucket_of("value").alias("bucket")).agg(F.count("*").alias("n")), "quality-sketch")
    named = lambda df, tag: df.withColumnsRenamed({c: f"{c}_{tag}" for c in df.columns})
    own, lang, every = quartiles(sketch, [one, two]), named(quartiles(sketch, [one]), "l"), named(quartiles(sketch, []), "a")
    out = own.join(lang, own[one].eqNullSafe(lang[f"{one}_l"]) & (own["measure"] == lang["measure_l"])).join(every, own["measure"] == every["measure_a"])
    out = out.withColumns({f"w{k}": F.expr(drawn(f"q{k}_l", "n_l", f"q{k}_a")) for k in (1, 3)})
    out = out.withColumns({f"d{k}": F.expr(drawn(f"q{k}", "n", f"w{k}")) for k in (1, 3)})
    least = F.create_map(*[F.lit(x) for m, d in FLOORS.items() for x in (m, d)])[F.col("measure")]
    reach = REACH * F.greatest(F.col("d3") - F.col("d1"), least)
    both = F.col("measure").isin([m for m, (_, b) in MEASURES.items() if b])
    return out.select(one, two, "measure", F.when(both, F.col("d1") - reach).otherwise(F.lit(-1)).alias("low"), (F.col("d3") + reach).alias("high"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row for each document: its id, the counts, ``base_failed``, ``failed`` (measures outside their fences) and ``kept``."""
    counted = stash(measure(docs.select(id_col, *keys, text_col), text_col, keep=[id_col, *keys]), "quality-counts")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = counted.withColumn("base_failed", failed).withColumn("values", F.create_map(*[x for m, v in _values().items() for x in (F.lit(m), v)]))
    limits = fences(rows.filter("not base_failed"), keys)
    # The joined filter: one row of limits for each group.
    wide = limits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("limits")).withColumnsRenamed({k: f"__{k}" for k in keys})
    joined = rows.join(wide, rows[keys[0]].eqNullSafe(wide[f"__{keys[0]}"]) & rows[keys[1]].eqNullSafe(wide[f"__{keys[1]}"]), "left")
    out = [m for m in MEASURES]
    outside = F.filter(F.array(*map(F.lit, out)), lambda m: (F.col("values")[m] < F.col("limits")[m]["low"]) | (F.col("values")[m] > F.col("limits")[m]["high"]))
    judged = joined.withColumn("failed", F.coalesce(outside, F.array().cast("array<string>")))
    return judged.select(id_col, *[c.split()[0] for c in FIELDS.split(", ")], "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_BUCKET = "CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) END"
_DRAWN = f"({{n}} * {{q}} + {PRIOR} * {{w}}) // ({{n}} + {PRIOR})"
_TOP = "CASE WHEN {b} < 64 THEN {b} ELSE (({b} - ({b} // 32 - 1) * 32 + 1) << CAST({b} // 32 - 1 AS INT)) - 1 END"


def _quartile_sql(keys: list[str]) -> str:
    k = "".join(f"{x}, " for x in keys)
    return f"""SELECT {k}measure, max(t) AS n, min(CASE WHEN run * 4 >= t THEN {_TOP.format(b="bucket")} END) AS q1, min(CASE WHEN run * 4 >= t * 3 THEN {_TOP.format(b="bucket")} END) AS q3
      FROM (SELECT {k}measure, bucket, sum(n) OVER (PARTITION BY {k}measure ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY {k}measure) AS t
            FROM (SELECT {k}measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL"""


ORACLE_SQL = f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), win AS (SELECT doc_id, i, w[i:i+{WINDOW - 1}] AS g FROM w, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i)),
rep AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN rep USING (doc_id, g), unnest(range(0, {WINDOW})) AS u(k) GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)
), base AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counts
), long AS (
  SELECT doc_id, lang, source, base_failed, unnest([
    {{'measure': 'word_length', 'v': CASE WHEN n_words > 0 THEN word_chars * 1000000 // n_words ELSE 0 END}},
    {{'measure': 'symbols', 'v': CASE WHEN n_words > 0 THEN n_symbols * 1000000 // n_words ELSE 0 END}},
    {{'measure': 'dup_lines', 'v': CASE WHEN n_lines > 0 THEN n_dup_lines * 1000000 // n_lines ELSE 0 END}},
    {{'measure': 'repeats', 'v': CASE WHEN n_words > 0 THEN n_repeat_words * 1000000 // n_words ELSE 0 END}}], recursive := true)
  FROM base
), sketch AS (
  SELECT lang, source, measure, {_BUCKET} AS bucket, count(*) AS n FROM long WHERE NOT base_failed GROUP BY ALL
), own AS ({_quartile_sql(["lang", "source"])}), per_lang AS ({_quartile_sql(["lang"])}), per_all AS ({_quartile_sql([])}),
wide AS (SELECT l.lang, l.measure, l.n, {_DRAWN.format(q="l.q1", n="l.n", w="a.q1")} AS q1, {_DRAWN.format(q="l.q3", n="l.n", w="a.q3")} AS q3 FROM per_lang l JOIN per_all a ON l.measure = a.measure),
picked AS (
  SELECT o.lang, o.source, o.measure, {_DRAWN.format(q="o.q1", n="o.n", w="w.q1")} AS q1, {_DRAWN.format(q="o.q3", n="o.n", w="w.q3")} AS q3,
         CASE o.measure {" ".join(f"WHEN '{m}' THEN {d}" for m, d in FLOORS.items())} END AS least
  FROM own o JOIN wide w ON o.lang IS NOT DISTINCT FROM w.lang AND o.measure = w.measure
), fences AS (
  SELECT lang, source, measure, CASE WHEN measure IN ({", ".join(f"'{m}'" for m, (_, b) in MEASURES.items() if b)}) THEN q1 - {REACH} * greatest(q3 - q1, least) ELSE -1 END AS low,
         q3 + {REACH} * greatest(q3 - q1, least) AS high FROM picked
), bad AS (
  SELECT DISTINCT doc_id FROM long x JOIN fences f ON x.lang IS NOT DISTINCT FROM f.lang AND x.source IS NOT DISTINCT FROM f.source AND x.measure = f.measure WHERE x.v < f.low OR x.v > f.high
)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM base
"""
