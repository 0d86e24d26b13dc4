"""Token counts of a unigram vocabulary, without making the tokens.

A text becomes units as the library's Metaspace pre-tokenizer makes them:
spaces turn into U+2581, which starts a unit. An Aho-Corasick automaton lists
the vocabulary pieces that end at each character of a unit, and a dynamic
program carries the best score and its number of pieces. Tie rules are the
tokenizer's: arrivals at a place are weighed in the order of their starts, and
only a strictly better score replaces an earlier one; a character that no
one-character piece matches may be taken as unknown, 10 below the smallest
score; a run of unknown characters is one token, or its bytes' tokens where
the vocabulary has a piece for every byte.

The public vocabulary file that is the default holds the pieces of a merge-based
model; here their scores are those of a unigram model, as the library's own
unigram model takes them when it is given the same pieces.

A worker keeps the counts of ``CACHE`` units; a unit of any length is counted.

Defined results: null text counts as empty, which has no tokens; repeated rows
are counted each by itself. A column named as an output is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import append_columns

CACHE = 600_000
KEPT_LENGTH = 100
MARK = "▁"
UNKNOWN_PENALTY = 10.0


def default_vocabulary() -> list[tuple[str, float]]:
    """Pieces and scores of the public 32,000-piece model."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Maps a unit to (tokens, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        super().__init__()
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        pieces = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))

    def __missing__(self, unit: str) -> tuple[int, float]:
        n = len(unit)
        arrivals: list[list] = [[] for _ in range(n + 1)]
        for last, (length, score) in self.automaton.iter(unit):
            arrivals[last + 1].append((length, score))
        best, count, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        unknown, by_byte = self.unknown, self.bytes
        for end in range(1, n + 1):
            top, own = None, arrivals[end]
            if len(own) > 1:
                own.sort(reverse=True)
            single = False
            for length, score in own:
                start = end - length
                single |= length == 1
                value = best[start] + score
                if top is None or value > top:
                    top, got, run = value, count[start] + 1, False
            if not single and (top is None or best[end - 1] + unknown > top):
                top = best[end - 1] + unknown
                got = count[end - 1] + (len(unit[end - 1].encode()) if by_byte else not open_run[end - 1])
                run = True
            best[end], count[end], open_run[end] = top, got, run
        out = (int(count[n]), best[n])
        if n <= KEPT_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[unit] = out
        return out

    def count(self, text: str) -> tuple[int, float]:
        segments = text.replace(" ", MARK).split(MARK)
        # A text that doesn't start with the mark gets one; an empty text stays empty.
        units = [MARK + s for s in segments[0 if segments[0] else 1 :]] if text else []
        found = list(map(self.__getitem__, units))
        return sum(x[0] for x in found), sum(x[1] for x in found)


_loaded: dict[int, Counter] = {}


def _counter(shipped) -> Counter:
    import pickle

    key = hash(shipped.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Counter(pickle.loads(shipped.value))
    return _loaded[key]


def count_tokens(docs: DataFrame, text_col: str = "text", vocabulary: list[tuple[str, float]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens`` and ``token_score``, the sum of the best path's scores."""
    import pickle

    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(vocabulary or default_vocabulary()))  # a vocabulary is of a fixed size

    def run(batch: pa.RecordBatch) -> list:
        c = _counter(shipped)
        got = [c.count(t or "") for t in batch.column("__text").to_pylist()]
        return [np.array([x[0] for x in got], np.int64), np.array([x[1] for x in got], np.float64)]

    return append_columns(docs, text_col, run, "n_tokens bigint, token_score double", keep)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text"))
    return count_tokens(docs, keep=["doc_id"])
