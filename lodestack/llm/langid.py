"""Language identification with spans of mixed-language text.

Script ranges narrow the candidates: a word of a script can only be in the
languages whose training text has that script. Each remaining language gives a
word the log-likelihood of its byte n-grams (within the word and its
boundaries, hashed into ``BUCKETS`` counters). A Viterbi pass over the words
with a switching penalty labels them; runs of one label are the spans, and the
language with most letters (bytes of words) is the document's.

Training counts n-grams of all labelled texts. The model has ``BUCKETS`` numbers
a language for up to ``MAX_LANGUAGES`` languages; with more of them neighbouring
counters are joined, so that its size stays the same. (Beyond 32 times as many
languages fewer than ``LEAST_BUCKETS`` would be left, which is an error.)

Defined results: null text, text without a letter, or a model without
languages gives ``und``, score 0 and no spans; ties go to the language that
sorts first; words without a letter take the label of their neighbours and
count for none; rows without a language or text are not learned from; repeated
rows are learned from each time and judged each by itself. A column named as
an output is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import LOWER, SPACE, Words, append_columns, mix, slices, split_words, stash, texts_of

BUCKETS = 1 << 15
ORDERS = (2, 3, 4, 5)
MAX_LANGUAGES, LEAST_BUCKETS = 256, 1 << 10
PENALTY = 9.0
#: n-grams of several orders repeat the same evidence.
DAMPING = 0.5
SMOOTHING = 0.5
#: Share of a language's words in a script from which on it is a candidate there.
SCRIPT_SHARE = 0.001

# UTF-8 lead bytes (first, last) of the scripts told apart.
SCRIPTS = [
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC3, 0xC9), ("greek", 0xCE, 0xCF), ("cyrillic", 0xD0, 0xD3), ("armenian", 0xD4, 0xD5),
    ("hebrew", 0xD6, 0xD7), ("arabic", 0xD8, 0xDB), ("syriac", 0xDC, 0xDF), ("indic", 0xE0, 0xE0), ("southeast", 0xE1, 0xE1), ("kana", 0xE3, 0xE3), ("han", 0xE4, 0xE9), ("hangul", 0xEA, 0xED), ("other", 0xF0, 0xF4),
]
NAMES = list(dict.fromkeys(name for name, _, _ in SCRIPTS))
_SCRIPT = np.zeros(256, np.int8)
for _name, _a, _b in SCRIPTS:
    _SCRIPT[_a : _b + 1] = NAMES.index(_name) + 1


def distinct(w: Words) -> tuple[Words, np.ndarray]:
    """The distinct words (as texts of one word each) and the place of each word among them."""
    h = w.hashes()
    _, at, place = np.unique(h, return_index=True, return_inverse=True)
    n = w.end[at] - w.start[at] + 1
    ends = np.cumsum(n)
    take = np.arange(ends[-1] if len(n) else 0) + np.repeat(w.start[at] - (ends - n), n)
    return Words(w.buf[take], ends - n, ends - 1, np.arange(len(n) + 1)), place


def grams(u: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of the words, boundaries included."""
    if not len(u):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = LOWER[np.concatenate(([np.uint8(32)], u.buf))].astype(np.uint64)
    word = np.repeat(np.arange(len(u)), u.end - u.start + 1)
    word = np.concatenate((word, [len(u)]))  # of the boundary before each word
    gap = np.cumsum(b == 32)
    owners, buckets = [], []
    code = b.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(b) < n:
            break
        code = code[: len(b) - n + 1] | b[n - 1 :] << np.uint64(8 * (n - 1))
        if n not in ORDERS:
            continue
        # No boundary but at the ends.
        inner = gap[n - 2 : len(b) - 1] - gap[: len(b) - n + 1]
        ok = np.flatnonzero((inner[: len(code)] == 0) | (n == 2))
        if n == 2:
            ok = ok[~((b[ok] == 32) & (b[ok + 1] == 32))]
        owners.append(word[ok])
        buckets.append((mix(code[ok] + np.uint64(n << 56)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def scripts(u: Words) -> np.ndarray:
    """Script of each word, 0 if it has no letter; of several, the one listed last."""
    return np.maximum.reduceat(_SCRIPT[u.buf], u.start).astype(np.int64) if len(u) else np.zeros(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # buckets x languages
    allowed: np.ndarray  # scripts x languages


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count the n-grams of every labelled text and make the model."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    width = BUCKETS + len(NAMES) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            names, lang = np.unique(np.array(part.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            w = split_words(texts_of(part.column("text")))
            u, place = distinct(w)
            times = np.bincount(lang[w.doc()] * max(1, len(u)) + place, minlength=len(names) * max(1, len(u))).reshape(len(names), -1)
            owner, bucket = grams(u)
            script = scripts(u)
            for k, name in enumerate(names.tolist()):
                own = total.setdefault(name, np.zeros(width))
                if len(u):
                    own[:BUCKETS] += np.bincount(bucket, weights=times[k][owner], minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(script, weights=times[k], minlength=len(NAMES) + 1)
        for name, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at].astype(np.int64))], names=["lang", "bucket", "n"])

    counted = stash(rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "langid-counts")
    many, size = counted.select("lang").distinct().count(), BUCKETS
    while many * size > MAX_LANGUAGES * BUCKETS:
        size //= 2
    if size < LEAST_BUCKETS:
        raise ValueError(f"{many} languages; the model is bounded to {MAX_LANGUAGES * BUCKETS // LEAST_BUCKETS}")
    # The low bits of a bucket's number are those of its hash.
    place = F.when(F.col("bucket") < BUCKETS, F.col("bucket") % size).otherwise(F.col("bucket") - BUCKETS + size)
    wide = size + len(NAMES) + 1

    def dense(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.bincount(pdf["bucket"], weights=pdf["n"], minlength=wide)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [own.tobytes()]})

    # One row a language, MAX_LANGUAGES x BUCKETS numbers and those of the scripts at most, whatever the input.
    table = counted.select("lang", place.alias("bucket"), "n").groupBy("lang").applyInPandas(dense, "lang string, counts binary").collect()
    table = sorted((r.lang, r.counts) for r in table)
    languages = [lang for lang, _ in table]
    n = np.array([np.frombuffer(x) for _, x in table]).reshape(len(table), wide).T
    body = n[:size] + SMOOTHING
    logp = np.log(body / body.sum(0, keepdims=True)) if languages else body
    logp = (logp - logp.mean(1, keepdims=True)) * DAMPING if languages else logp
    share = n[size:] / np.maximum(1, n[size:].sum(0))
    return Model(languages, logp.astype(np.float32), share >= SCRIPT_SHARE)


def word_scores(u: Words, m: Model) -> np.ndarray:
    """Log-likelihood, less the languages' mean, of each word in each language."""
    owner, bucket = grams(u)
    bucket %= len(m.logp)
    out = np.zeros((len(u), len(m.languages)), np.float64)
    for k in range(len(m.languages)):
        out[:, k] = np.bincount(owner, weights=m.logp[bucket, k], minlength=len(u))
    script = scripts(u)
    out[script == 0] = 0
    some = m.allowed[script].any(1) & (script > 0)
    out[some[:, None] & ~m.allowed[script]] = -50.0
    out[(script > 0) & ~some] = 0
    return out


def viterbi(s: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best label of each word; all documents advance together, one word at a time."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    live = np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), side="left")  # documents longer than t
    head = first[:-1][order]
    back = np.empty(s.shape, np.int8 if s.shape[1] < 128 else np.int16)
    same = np.arange(s.shape[1])
    v = np.zeros((len(order), s.shape[1]))
    for t, k in enumerate(live.tolist()):
        at = head[:k] + t
        prev = v[:k]
        best = prev.argmax(1)
        top = prev[np.arange(k), best] - penalty if t else np.zeros(k)
        stay = prev >= top[:, None]
        back[at] = np.where(stay, same, best[:, None])
        v[:k] = np.maximum(prev, top[:, None]) + s[at]
    out = np.empty(len(s), np.int64)
    label = v.argmax(1)
    for t in range(len(live) - 1, -1, -1):
        k = live[t]
        at = head[:k] + t
        out[at] = label[:k]
        label[:k] = back[at, label[:k]]
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``lang_score`` (its share of the letters) and ``lang_spans`` (labelled word ranges)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x MAX_LANGUAGES numbers at most
    fields = "lang_pred string, lang_score double, lang_spans array<struct<lang:string,start:int,end:int>>"

    def run(batch: pa.RecordBatch) -> list:
        m = shipped.value
        texts = batch.column("__text").to_pylist()
        lettered = np.array([t is not None and (t.isascii() and any(c.isalpha() for c in t) or any(c.isalpha() for c in t)) for t in texts], bool)
        none = [["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]]
        if not m.languages:
            return none
        w = split_words(texts_of(batch.column("__text")), SPACE)
        if not len(w):
            return none
        u, place = distinct(w)
        label = viterbi(word_scores(u, m)[place], w.first)
        size = np.where(scripts(u) > 0, u.end - u.start, 0)[place]
        doc = w.doc()
        share = np.bincount(doc * len(m.languages) + label, weights=size, minlength=len(texts) * len(m.languages)).reshape(len(texts), -1)
        best, total = share.argmax(1), share.sum(1)
        cut = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1]))))
        spans: list[list] = [[] for _ in texts]
        stops = np.concatenate((cut[1:], [len(label)]))
        for a, b, d in zip(cut.tolist(), stops.tolist(), doc[cut].tolist(), strict=True):
            if lettered[d]:
                spans[d].append({"lang": m.languages[label[a]], "start": a - int(w.first[d]), "end": b - int(w.first[d])})
        pred = [m.languages[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        score = np.where(lettered & (total > 0), share[np.arange(len(texts)), best] / np.maximum(1, total), 0.0)
        return [pred, score.tolist(), spans]

    return append_columns(docs, text_col, run, fields, keep)


def held_out(id_col: str = "doc_id"):
    """Rows kept out of training: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = fit(docs.filter("not held_out and doc_id is not null"))
    return identify(docs, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def brute_force(train: list[tuple[str | None, str | None]], texts: list[str | None]) -> list[tuple[str, float]]:
    """(lang_pred, score) of texts, a word and an n-gram at a time; for tests."""
    import re
    from collections import Counter, defaultdict

    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())

    def buckets(word: bytes) -> list[int]:
        b = b" " + bytes(LOWER[c] for c in word) + b" "
        codes = [sum(c << 8 * k for k, c in enumerate(b[i : i + n])) + (n << 56) for n in ORDERS for i in range(len(b) - n + 1)]
        return (mix(np.array(codes, np.uint64)) % np.uint64(BUCKETS)).tolist()

    seen, kinds = defaultdict(Counter), defaultdict(Counter)
    for t, lang in train:
        if t is not None and lang is not None:
            for w in split(t):
                seen[lang].update(buckets(w))
                kinds[lang][max(_SCRIPT[c] for c in w)] += 1
            seen[lang].update([])
    langs = sorted(seen)
    n = np.array([[seen[x][b] for x in langs] for b in range(BUCKETS)], float).reshape(BUCKETS, len(langs)) + SMOOTHING
    logp = np.log(n / n.sum(0)) if langs else n
    logp = ((logp - logp.mean(1, keepdims=True)) * DAMPING).astype(np.float32) if langs else n
    allowed = {k: [kinds[x][k] / max(1, sum(kinds[x].values())) >= SCRIPT_SHARE for x in langs] for k in range(len(NAMES) + 1)}
    out = []
    for t in texts:
        words = split(t)
        if not langs or not words or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        v, back = [0.0] * len(langs), []
        script = [max(_SCRIPT[c] for c in w) for w in words]
        for i, w in enumerate(words):
            own = [0.0] * len(langs)
            if script[i] and any(allowed[script[i]]):
                b = buckets(w)
                own = [float(np.cumsum(logp[b, k].astype(np.float64))[-1]) if allowed[script[i]][k] else -50.0 for k in range(len(langs))]
            best = v.index(max(v))
            top = v[best] - PENALTY if i else 0.0
            back.append([k if v[k] >= top else best for k in range(len(langs))])
            v = [max(v[k], top) + own[k] for k in range(len(langs))]
        k, share = v.index(max(v)), [0] * len(langs)
        for i in range(len(words) - 1, -1, -1):
            share[k] += len(words[i]) if script[i] else 0
            k = back[i][k]
        best = share.index(max(share))
        out.append((langs[best], share[best] / max(1, sum(share))))
    return out
