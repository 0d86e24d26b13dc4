"""Taking glued words apart: unigram segmentation with costs from the documents' own words.

A word costs the negative logarithm of its share of all words, in thousandths of
nats. The best split of a run of letters has the least total cost; of equal ones
that with fewer words, then that whose first word is longer, and so on to the
right. A letter that no known word covers may stand alone at ``UNKNOWN`` more
than the rarest word.

The words that stand in a run are found by a trie with failure links where the
vocabulary's measured size lets it be shipped, and by a join of the run's
substrings with the table of words beyond; both give the same matches. Only
distinct runs are split. Runs of more than ``LONG`` letters are split in parts of
that length.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import GLUE_WORDS, filled
from ..sources.scratch import written

RUN = "[a-z]{24,}"
#: Letters of a word at most; times that it must stand alone somewhere.
LONGEST, LEAST = 20, 2
UNKNOWN, LONG = 5000, 10_000
SHIPPED_BYTES = 32 << 20


def word_costs(docs: DataFrame, text_col: str = "text", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(word, cost) of the lower-case words that stand between other characters, ``least`` times or more."""
    found = docs.select(F.explode(F.regexp_extract_all(filled(F.col(text_col)), F.lit(r"(?<![A-Za-z])[a-z]+(?![A-Za-z])"), F.lit(0))).alias("word"))
    counts = found.filter(F.length("word") <= longest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    counts = written(counts, "word-counts")
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("word", F.round(1000 * F.log(F.col("total") / F.col("n"))).cast("bigint").alias("cost"))


def glued_runs(c: Column) -> Column:
    """The distinct runs that are to be split: a function word stands in them after the third letter."""
    return F.array_distinct(F.filter(F.regexp_extract_all(filled(c), F.lit(RUN), F.lit(0)), lambda t: F.substring(t, 4, 1 << 20).rlike(GLUE_WORDS)))


def best_split(run: str, words: list[tuple[int, int, int]], alone: int) -> list[str]:
    """The best split of a run by the words (start, end, cost) that stand in it; ``alone``: what an unknown letter costs."""
    at: list[list[tuple[int, int]]] = [[] for _ in run]
    for start, end, cost in words:
        at[start].append((end, cost))
    n = len(run)
    best: list[tuple[int, int, int]] = [(0, 0, 0)] * (n + 1)  # cost, words, end of the first word
    for i in range(n - 1, -1, -1):
        choices = [(cost + best[end][0], 1 + best[end][1], -end) for end, cost in at[i]]
        if not any(end == i + 1 for end, _ in at[i]):
            choices.append((alone + best[i + 1][0], 1 + best[i + 1][1], -(i + 1)))
        cost, count, end = min(choices)
        best[i] = (cost, count, -end)
    out, i = [], 0
    while i < n:
        out.append(run[i : best[i][2]])
        i = best[i][2]
    return out


def split_runs(runs: DataFrame, costs: DataFrame, shipped_bytes: int = SHIPPED_BYTES) -> DataFrame:
    """(run, words): the distinct runs with the words they split into, between blanks."""
    costs = written(costs, "word-costs")
    size, dearest = costs.agg(F.sum(F.length("word") + 16), F.max("cost")).first()
    alone = (dearest or 0) + UNKNOWN
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("run") - 1) / LONG)), lambda i: F.substring(F.col("run"), i * LONG + 1, F.lit(LONG)))
    parts = runs.select("run").distinct().select("run", F.posexplode(cut).alias("place", "part"))
    pieces = parts.select("part").distinct()
    split = _by_trie(pieces, costs, alone) if (size or 0) <= shipped_bytes else _by_join(pieces, costs, alone)
    whole = parts.join(split, "part").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("place", "words"))).alias("w"))
    return whole.select("run", F.array_join(F.transform("w", lambda x: x["words"]), " ").alias("words"))


def _by_trie(pieces: DataFrame, costs: DataFrame, alone: int) -> DataFrame:
    pairs = [(r["word"], r["cost"]) for r in costs.toLocalIterator()]  # of measured size
    shipped = pieces.sparkSession.sparkContext.broadcast(pickle.dumps(pairs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        trie = ahocorasick.Automaton()
        for word, cost in pickle.loads(shipped.value):
            trie.add_word(word, (len(word), cost))
        trie.make_automaton()
        for pdf in batches:
            words = [" ".join(best_split(p, [(last + 1 - n, last + 1, cost) for last, (n, cost) in trie.iter(p)] if len(trie) else [], alone)) for p in pdf["part"]]
            yield pdf.assign(words=words)

    return pieces.mapInPandas(run, "part string, words string")


def _by_join(pieces: DataFrame, costs: DataFrame, alone: int) -> DataFrame:
    starts = pieces.select("part", F.explode(F.sequence(F.lit(0), F.length("part") - 1)).alias("start"))
    ends = starts.select("part", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + LONGEST, F.length("part")))).alias("end"))
    found = ends.withColumn("word", F.expr("substring(part, start + 1, end - start)")).join(costs, "word")
    words = found.groupBy("part").agg(F.collect_list(F.struct("start", "end", "cost")).alias("found"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            split = [" ".join(best_split(p, [(w["start"], w["end"], w["cost"]) for w in ([] if f is None else f)], alone)) for p, f in zip(pdf["part"], pdf["found"], strict=True)]
            yield pd.DataFrame({"part": pdf["part"], "words": split})

    return pieces.join(words, "part", "left").mapInPandas(run, "part string, words string")


def deglued(docs: DataFrame, costs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shipped_bytes: int = SHIPPED_BYTES) -> DataFrame:
    """Documents with their glued runs split in ``text_col``, and ``split_runs``, how many there were; ids are distinct."""
    runs = written(docs.select(id_col, F.explode(glued_runs(F.col(text_col))).alias("run")), "glued-runs")
    split = split_runs(runs, costs, shipped_bytes)
    maps = runs.join(split, "run").groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("run", "words"))).alias("__split"))
    # The text between runs, and the runs, in turn.
    between, found = F.split(filled(F.col(text_col)), RUN), F.regexp_extract_all(filled(F.col(text_col)), F.lit(RUN), F.lit(0))
    joined = docs.join(maps, id_col, "left")
    mended = F.array_join(F.flatten(F.zip_with(between, F.transform(found, lambda r: F.coalesce(F.try_element_at("__split", r), r)), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    n = F.size(F.filter(found, lambda r: F.map_contains_key("__split", r)))
    has = F.col("__split").isNotNull()
    return joined.withColumns({text_col: F.when(has, mended).otherwise(F.col(text_col)), "split_runs": F.when(has, n).otherwise(0)}).drop("__split")
