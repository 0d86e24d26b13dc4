"""Secret scans in DataFrame functions only.

Base kinds are found by three fixed patterns, leftmost and non-overlapping for
each kind. Beside them, candidate strings (runs of 20 or more characters of a
key alphabet) are judged by the Shannon entropy of a window that slides over
them. With counts c of the characters in a window of W, the entropy is
``log2(W) - S / W`` for ``S = sum(c * log2(c))``. The counts are carried from
window to window, 5 bits each in a few integers: a step takes one off the
character that leaves, adds one to the character that enters, and corrects S by
two numbers from a table (S is kept as an integer, so nothing drifts). Every
character class has its own threshold: hexadecimal strings can reach 4 bits,
mixed alphanumeric ones 6. A candidate with a window over its class's threshold
is a span of kind ``entropy``, unless the allow-list has it or it lies inside a
base span.

Positions come from the pieces between matches: ``split`` and
``regexp_extract_all`` walk the same matches, so the lengths of pieces and
matches add up to code point offsets. Running sums go over blocks of finds and
then over the finds of each block, so that their cost grows with the number of
finds. Texts in which a pattern's cheap filter finds nothing skip it.

Defined results: null text counts as empty; a text without finds has zero
counts, an empty span list and the hash of the empty string; repeated rows are
scanned each by itself; texts of any length are scanned whole. A column named
as an output is replaced by it; no other column is touched.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # finds the runs of AKIA[A-Z0-9]+ that have 18 characters
HEX = r"[0-9a-f]{16,}"  # finds the runs of [0-9a-f]+ that have 16 characters
ASSIGN_CHARS, WINDOW = 12, 20

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Code of the first character of the key alphabet; the last one's is 79 more.
FIRST_CODE, CODES, PER_WORD = 43, 80, 12
#: Bits per character that a window of 20 must exceed, by class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "symbol": 3.8}
#: Strings that are not secrets: without a letter, UUIDs (with a name before them), placeholders.
ALLOW = [
    r"^[^A-Za-z]*$",
    r"(?i)^(?:[a-z_-]+=)?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)^(?:[a-z_-]+=)?(?:your|my|example|placeholder|changeme|xxxxx|redacted|dummy)",
    r"(?i)(?:example|placeholder|redacted|dummy)(?:_?key|_?token|_?secret)?[0-9]*$",
]
#: What words joined by separators, with a short number at the end, do not have: a letter of one case alone
#: amid the other, or a digit before the end.
NO_WORDS = r"(?<=[A-Z0-9])[a-z](?![a-z])|(?<![a-z])[a-z](?=[A-Z0-9])|(?<![A-Z])[A-Z](?![A-Z]|[a-z]{2}|[+/_=-]|$)|[0-9](?![0-9]{0,3}$)"

#: Finds that a running sum takes at once.
BLOCK = 256
SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"
NO_SPANS = f"array<{SPAN}>"

# Steps of S, in units of 2**-40: what the n-th equal character adds.
_UNIT = float(1 << 40)
_CLOG = [round(n * math.log2(n) * _UNIT) if n > 1 else 0 for n in range(WINDOW + 1)]
_GAIN = [b - a for a, b in zip(_CLOG[:-1], _CLOG[1:])]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scanned(items: Column, start: Column, ahead: Callable[[Column, Column], Column], fold: Callable[[Column, Column], Column]) -> Column:
    """An array from left to right: ``fold(block, state)`` gives a block's part
    of the result, ``ahead(block, state)`` the state after the block.
    """

    def over(blocks: Column) -> Column:
        first = F.struct(start.alias("at"), F.array(start).alias("out"))

        def step(acc: Column, b: Column) -> Column:
            return let(ahead(b, acc["at"]), lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))

        states = F.aggregate(blocks, first, step)["out"]
        return F.flatten(F.zip_with(blocks, F.slice(states, 1, F.size(blocks)), fold))

    def cut(all_: Column) -> Column:
        last = F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / BLOCK).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_, k * BLOCK + 1, BLOCK)), over)

    return let(items, cut)


def located(text: Column, pattern: str, kind: str, rank: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the pattern's matches; ``keep`` judges the matched string."""
    total = lambda b, at: F.aggregate(b, at, lambda n, x: n + x["gap"] + x["size"])

    def fold(block: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.array().cast(NO_SPANS).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + x["size"]
            one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(x["keep"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, first, step)["out"]

    def spans(found: Column) -> Column:
        judged = lambda m: F.lit(True) if keep is None else F.coalesce(keep(m), F.lit(False))
        size = lambda c: F.length(c).cast("bigint")
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        return scanned(F.zip_with(pieces, found, lambda p, m: F.struct(size(p).alias("gap"), size(m).alias("size"), judged(m).alias("keep"))), F.lit(0).cast("bigint"), total, fold)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _when_found(cheap: Column, spans: Column) -> Column:
    return F.when(cheap, spans).otherwise(F.array().cast(NO_SPANS))


def peak_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest entropy, in bits per character, of a window in ``s``, a string of the key alphabet."""
    gain = F.array(*[F.lit(x) for x in _GAIN[:window]])
    words = -(-CODES // PER_WORD)
    zero = F.array(*[F.lit(0).cast("bigint")] * words)
    # The word, the place and the unit of a character's count.
    slot = lambda c: let(F.ascii(c) - FIRST_CODE, lambda k: F.struct(F.floor(k / PER_WORD).cast("int").alias("word"), (k % PER_WORD * 5).alias("place"), F.call_function("shiftleft", F.lit(1).cast("bigint"), k % PER_WORD * 5).alias("unit")))
    count = lambda counts, x: F.call_function("shiftright", F.get(counts, x["word"]), x["place"]).bitwiseAND(31).cast("int")
    moved = lambda counts, x, sign: F.transform(counts, lambda c, k: F.when(k == x["word"], c + sign * x["unit"]).otherwise(c))

    def enter(acc: Column, x: Column) -> Column:
        return F.struct(moved(acc["counts"], x, 1).alias("counts"), (acc["s"] + F.get(gain, count(acc["counts"], x))).alias("s"))

    def leave(acc: Column, x: Column) -> Column:
        return F.struct(moved(acc["counts"], x, -1).alias("counts"), (acc["s"] - F.get(gain, count(acc["counts"], x) - 1)).alias("s"))

    def slide(slots: Column):
        def step(acc: Column, i: Column) -> Column:
            left = leave(acc, F.get(slots, i))
            return let(let(left, lambda a: enter(a, F.get(slots, i + window))), lambda a: F.struct(a["counts"].alias("counts"), a["s"].alias("s"), F.least(acc["low"], a["s"]).alias("low")))

        return step

    def peak(slots: Column) -> Column:
        first = F.aggregate(F.slice(slots, 1, window), F.struct(zero.alias("counts"), F.lit(0).cast("bigint").alias("s")), enter)
        steps = F.when(F.size(slots) > window, F.sequence(F.lit(0), F.size(slots) - window - 1)).otherwise(F.array().cast("array<int>"))
        low = let(first, lambda a: F.aggregate(steps, F.struct(a["counts"].alias("counts"), a["s"].alias("s"), a["s"].alias("low")), slide(slots))["low"])
        width = F.least(F.lit(window), F.size(slots)).cast("double")
        return F.log2(width) - low / F.lit(_UNIT) / width

    return let(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), slot), peak)


def _risky(s: Column) -> Column:
    limit = F.when(s.rlike(r"^[0-9a-fA-F]+$"), THRESHOLDS["hex"]).when(s.rlike(r"^[A-Za-z0-9]+$"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["symbol"])
    allowed = ~s.rlike(NO_WORDS)
    for pattern in ALLOW:
        allowed = allowed | s.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(peak_entropy(s) > limit)


def _beside(sorted_: Column) -> Column:
    """Sorted spans without the entropy spans that lie inside a base span: those before it reach to its end."""
    reach = lambda at, x: F.when(x["rank"] < 3, F.greatest(at, x["end"])).otherwise(at)

    def fold(block: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            kept = (x["rank"] < 3) | (x["end"] > acc["at"])
            return F.struct(reach(acc["at"], x).alias("at"), F.when(kept, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(NO_SPANS).alias("out")), step)["out"]

    return scanned(sorted_, F.lit(-1).cast("bigint"), lambda b, at: F.aggregate(b, at, reach), fold)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``secret_spans``: kind, start and end (code points, end exclusive) of every find, by start and then kind."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_CHARS
    found = F.concat(
        _when_found(text.rlike(ASSIGN), located(text, ASSIGN, "assign", 0, value)),
        _when_found(F.contains(text, F.lit("AKIA")), located(text, ACCESS, "access", 1)),
        _when_found(text.rlike(HEX), located(text, HEX, "hex", 2)),
        _when_found(text.rlike(CANDIDATE), located(text, CANDIDATE, "entropy", 3, _risky)),
    )
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    shown = lambda spans: F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return docs.withColumn("secret_spans", let(found, lambda spans: F.when(F.size(spans) > 0, shown(_beside(F.array_sort(spans)))).otherwise(none)))


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "secret_spans", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span of the text by ``mark``; overlapping spans are replaced together."""
    text = F.col(f"`{text_col}`").cast("string")

    def cut(chars: Column) -> Column:
        def fold(block: Column, at: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                gap = F.array_join(F.slice(chars, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int")), "")
                out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
                return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

            return F.aggregate(block, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), step)["out"]

        far = lambda b, at: F.aggregate(b, at, lambda n, x: F.greatest(n, x["end"]))
        start = F.lit(0).cast("bigint")
        last = far(F.col(spans_col), start)
        tail = F.array_join(F.slice(chars, (last + 1).cast("int"), F.size(chars)), "")
        return F.concat(F.array_join(scanned(F.col(spans_col), start, far, fold), ""), tail)

    return docs.withColumn(text_col, F.when(F.size(spans_col) > 0, let(F.split(text, ""), cut)).otherwise(text))


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of query op6."""
    n = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("secret_spans", lambda x: x["kind"] != "entropy")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "secret_spans"))


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """Spans of one text, every window counted afresh; for tests."""
    import re

    text, base, out = text or "", [], []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 12:
            base.append((m.start(), 0, "assign", m.end()))
    base += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    for m in re.finditer(CANDIDATE, text):
        s = m[0]
        if any(re.search(p, s) for p in ALLOW) or not re.search(NO_WORDS, s) or any(b[0] <= m.start() and m.end() <= b[3] for b in base):
            continue
        limit = THRESHOLDS["hex" if re.fullmatch(r"[0-9a-fA-F]+", s) else "alnum" if re.fullmatch(r"[A-Za-z0-9]+", s) else "symbol"]
        peak = max(-sum(c / WINDOW * math.log2(c / WINDOW) for c in (w.count(x) for x in set(w))) for w in (s[i : i + WINDOW] for i in range(len(s) - WINDOW + 1)))
        if peak > limit:
            out.append((m.start(), 3, "entropy", m.end()))
    return [(k, a, b) for a, _, k, b in sorted(base + out)]
