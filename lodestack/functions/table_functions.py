"""Table functions of a search service, for SQL: polymorphic Python UDTFs made from specs.

Each takes a table argument, keeps its columns and adds its own; partitions and
order are those of the call, so Spark spreads the work::

    SELECT * FROM search_text(TABLE(hits) PARTITION BY query_id ORDER BY (score DESC, chunk_id), k => 3, score_ratio => 0.4)

Arguments are checked when the call is analysed, before any row is read: unknown
names, missing ones, wrong types and values out of range are errors that name the
function. A row function sees one row at a time and holds a few numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.validation import Rule


@dataclass(frozen=True)
class Parameter:
    """``kind``: int, double, boolean or string; without a default it has to be given."""

    kind: str
    default: Any = None
    required: bool = False
    least: float | None = None
    most: float | None = None
    longest: int | None = None
    allowed: tuple = ()


@dataclass(frozen=True)
class TableFunction:
    name: str
    category: str
    parameters: dict[str, Parameter]
    needs: tuple[str, ...]  # columns of the table argument
    adds: T.StructField  # the column that it adds
    worker: type = field(repr=False)


PYTHON = {"int": int, "double": (int, float), "boolean": bool, "string": str}


def checked(name: str, parameters: dict[str, Parameter], given: dict[str, Any]) -> dict[str, Any]:
    """The arguments with defaults; a ValueError names the first that is wrong."""
    for p in given:
        if p not in parameters:
            raise ValueError(f"{name}: unknown argument {p}")
    out = {}
    for p, rule in parameters.items():
        value = given.get(p)
        if value is None:
            if rule.required:
                raise ValueError(f"{name}: {p} is missing")
            out[p] = rule.default
            continue
        if not isinstance(value, PYTHON[rule.kind]) or (isinstance(value, bool) and rule.kind != "boolean"):
            raise ValueError(f"{name}: {p} must be {rule.kind}")
        if (rule.least is not None and value < rule.least) or (rule.most is not None and value > rule.most):
            raise ValueError(f"{name}: {p} is out of range")
        if rule.longest is not None and len(value) > rule.longest:
            raise ValueError(f"{name}: {p} is too long")
        if rule.allowed and value not in rule.allowed:
            raise ValueError(f"{name}: {p} is not allowed")
        out[p] = value
    return out


def rules(f: TableFunction) -> list[Rule]:
    """The spec as rules for arguments that come as texts."""
    kinds = {"int": "integer", "double": "number", "boolean": "boolean", "string": "string"}
    return [Rule(n, kinds[p.kind], p.required, list(p.allowed), p.longest, p.least, p.most) for n, p in f.parameters.items()]


def as_udtf(f: TableFunction):
    """The UDTF of a spec: ``analyze`` checks the call, ``eval`` hands rows to the worker."""
    import decimal
    import json

    name, parameters, needs, adds, worker = f.name, f.parameters, f.needs, f.adds, f.worker

    class Function:
        def __init__(self, result: AnalyzeResult | None = None):
            self.worker = worker(**json.loads(result.name_of_call)) if result is not None else None

        @staticmethod
        def analyze(*tables: AnalyzeArgument, **arguments: AnalyzeArgument) -> AnalyzeResult:
            if len(tables) != 1 or not tables[0].isTable:
                raise ValueError(f"{name}: takes one table")
            have = {c.name for c in tables[0].dataType.fields}
            if lacks := [c for c in needs if c not in have]:
                raise ValueError(f"{name}: the table has no column {lacks[0]}")
            given = {}
            for p, a in arguments.items():
                if a.isTable or not a.isConstantExpression:
                    raise ValueError(f"{name}: {p} must be a constant")
                given[p] = float(a.value) if isinstance(a.value, decimal.Decimal) else a.value
            values = checked(name, parameters, given)
            schema = T.StructType([*[c for c in tables[0].dataType.fields if c.name != adds.name], adds])
            out = Call(schema=schema)
            out.name_of_call = json.dumps(values)
            return out

        def eval(self, row: Row, *_, **__):
            for new in self.worker.row(row):
                yield (*[v for c, v in row.asDict().items() if c != adds.name], new)

    Function.__name__ = name
    return udtf(Function)


@dataclass
class Call(AnalyzeResult):
    """What ``analyze`` hands on to the rows: the checked arguments."""

    name_of_call: str = "{}"


class SearchText:
    """The first k rows of a partition whose score is at least a share of the first's; rows of the scope come through alone if there is one."""

    def __init__(self, k: int, score_ratio: float, scope_stem: str):
        self.k, self.ratio, self.scope, self.n, self.top = k, score_ratio, scope_stem, 0, None

    def row(self, r: Row):
        if self.scope and not (r["source_stem"] or "").startswith(self.scope):
            return
        self.top = r["score"] if self.top is None else self.top
        if self.n < self.k and r["score"] >= self.top * self.ratio:
            self.n += 1
            yield self.n


class SearchBatch:
    """Rows of the main question and of its parts (``sub`` from 1): each chunk once, the first ``per_sub`` new ones of each part pinned."""

    def __init__(self, per_sub: int):
        self.per_sub, self.seen, self.counts = per_sub, set(), {}

    def row(self, r: Row):
        if r["chunk_id"] in self.seen:
            return
        self.seen.add(r["chunk_id"])
        n = self.counts[r["sub"]] = self.counts.get(r["sub"], 0) + 1
        if r["sub"] == 0 or n <= self.per_sub:
            yield r["sub"] > 0


class SearchImage:
    """The first k rows of a partition; portraits only if they are asked for."""

    def __init__(self, k: int, include_portraits: bool, score_ratio: float):
        self.k, self.portraits, self.ratio, self.n, self.top = k, include_portraits, score_ratio, 0, None

    def row(self, r: Row):
        if r["content_type"] == "portrait" and not self.portraits:
            return
        self.top = r["score"] if self.top is None else self.top
        if self.n < self.k and r["score"] >= self.top * self.ratio:
            self.n += 1
            yield self.n


class GetChunk:
    """The chunk of an id, whole; of its text ``max_chars`` characters at most beside it."""

    def __init__(self, chunk_id: str, max_chars: int):
        self.chunk_id, self.max_chars = chunk_id, max_chars

    def row(self, r: Row):
        if r["chunk_id"] == self.chunk_id:
            yield (r["content"] or "")[: self.max_chars]


_K = Parameter("int", 3, least=1, most=50)
_RATIO = Parameter("double", 0.6, least=0, most=1)
FUNCTIONS = {
    f.name: f
    for f in (
        TableFunction("search_text", "retrieval", {"k": _K, "score_ratio": _RATIO, "scope_stem": Parameter("string", "", longest=200)}, ("score", "source_stem"), T.StructField("place", T.IntegerType()), SearchText),
        TableFunction("search_batch", "retrieval", {"per_sub": Parameter("int", 4, least=1, most=20)}, ("chunk_id", "sub"), T.StructField("pinned", T.BooleanType()), SearchBatch),
        TableFunction("search_image", "retrieval", {"k": _K, "include_portraits": Parameter("boolean", False), "score_ratio": _RATIO}, ("score", "content_type"), T.StructField("place", T.IntegerType()), SearchImage),
        TableFunction("get_chunk", "catalogue", {"chunk_id": Parameter("string", required=True, longest=200), "max_chars": Parameter("int", 800, least=1)}, ("chunk_id", "content"), T.StructField("shown", T.StringType()), GetChunk),
    )
}


def register(spark: SparkSession) -> None:
    """Make all table functions known to the session's SQL."""
    for f in FUNCTIONS.values():
        spark.udtf.register(f.name, as_udtf(f))
