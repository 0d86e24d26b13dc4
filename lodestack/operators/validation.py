"""JSON payloads and typed arguments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import filled


def payload(raw: Column, schema: str) -> Column:
    """The object between the first and the last brace, parsed; null if there is none or it is broken."""
    return F.from_json(F.regexp_extract(filled(raw), r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"})


@dataclass
class Rule:
    name: str
    kind: str  # string, integer, number or boolean
    required: bool = False
    allowed: list[str] = field(default_factory=list)
    longest: int | None = None
    least: float | None = None
    most: float | None = None


def coerced(args: Column, rules: list[Rule]) -> Column:
    """struct(values, errors) of a map of strings: values by their types, and what is wrong.

    ``3.0`` is an integer, ``true`` is none; unknown names are reported.
    """
    errors, values = [], []
    for r in rules:
        raw = F.try_element_at(args, F.lit(r.name))
        whole, number = raw.rlike(r"^[+-]?\d+(\.0*)?$"), raw.try_cast("double").isNotNull()
        good = {"string": F.lit(True), "integer": whole, "number": number, "boolean": F.lower(raw).isin("true", "false")}[r.kind]
        as_kind = {"string": raw, "integer": raw.try_cast("double").cast("bigint"), "number": raw.try_cast("double"), "boolean": raw.try_cast("boolean")}[r.kind]
        values.append(F.when(good, as_kind).alias(r.name))
        if r.required:
            errors.append(F.when(raw.isNull(), f"{r.name}: missing"))
        if r.kind != "string":
            article = "an" if r.kind == "integer" else "a"
            errors.append(F.when(raw.isNotNull() & ~good, f"{r.name}: not {article} {r.kind}"))
        if r.allowed:
            errors.append(F.when(raw.isNotNull() & ~raw.isin(r.allowed), f"{r.name}: not allowed"))
        if r.least is not None or r.most is not None:
            low, high = (raw.try_cast("double") < r.least if r.least is not None else F.lit(False)), (raw.try_cast("double") > r.most if r.most is not None else F.lit(False))
            errors.append(F.when(raw.isNotNull() & good & (low | high), f"{r.name}: out of range"))
        if r.longest is not None:
            errors.append(F.when(F.length(raw) > r.longest, f"{r.name}: too long"))
    unknown = F.transform(F.filter(F.map_keys(args), lambda k: ~k.isin([r.name for r in rules])), lambda k: F.concat(k, F.lit(": unknown")))
    return F.struct(F.struct(*values).alias("values"), F.concat(F.array_compact(F.array(*errors)), unknown).alias("errors"))


def strings_with(raw: Column, marker: str) -> Column:
    """All string values of a JSON text, however nested, that hold the marker."""
    # A quoted string that no colon follows is a value.
    quoted = F.regexp_extract_all(filled(raw), F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    values = F.transform(F.filter(quoted, lambda x: x.endswith('"')), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.filter(values, lambda x: F.contains(x, F.lit(marker)))


def repaired(raw: Column) -> Column:
    """A JSON text cut short, with its open string, arrays and objects closed."""
    t = F.regexp_replace(filled(raw), r"[,:\s]+$", "")
    bare = F.regexp_replace(t, r'"(?:[^"\\]|\\.)*"', "")
    quoted = F.when(bare.contains('"'), F.concat(t, F.lit('"'))).otherwise(t)
    clean = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", ""), "", ""), "")
    # A stack of the closing marks that are still due.
    due = F.aggregate(clean, F.lit(""), lambda s, c: F.when(c == "{", F.concat(F.lit("}"), s)).when(c == "[", F.concat(F.lit("]"), s)).when(c.isin("}", "]"), F.substring(s, 2, 1 << 20)).otherwise(s))
    return F.concat(quoted, due)


#: What the lexer stops at within a string: an escape that JSON knows, any other backslash, a quote that ends the string, any other quote.
_IN_STRING = re.compile(r"""\\["\\/bfnrtu]|(?P<stray>\\)|(?P<end>"(?=[ \t\r\n]*[,:}\]]))|(?P<bare>")""")


def with_quotes_mended(text: str) -> str:
    """A JSON text whose strings have bare quotes or unknown escapes, with these escaped.

    The lexer is outside of strings or in one. A quote opens a string; within it,
    a quote ends it if a comma, a colon or a closing bracket comes next, white
    space left aside, and else belongs to it. A text that ends in a string is left open.
    """
    out, at, inside = [], 0, False
    while True:
        if not inside:
            opened = text.find('"', at)
            if opened < 0:
                break
            out.append(text[at : opened + 1])
            at, inside = opened + 1, True
        found = _IN_STRING.search(text, at)
        if found is None:
            break
        out.append(text[at : found.start()])
        at = found.end()
        kind = found.lastgroup
        out.append({"stray": "\\\\", "bare": '\\"'}.get(kind, found[0]))
        inside = kind != "end"
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def quotes_mended(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(with_quotes_mended, na_action="ignore")
