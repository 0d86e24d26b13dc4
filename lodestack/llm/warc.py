"""WARC archives with a two-level capture index.

Writing: every page becomes one WARC/1.1 record, each a gzip member of its own,
so that a record can be read by its range. Of records with equal payloads of at
least ``LEAST_BYTES`` bytes, that with the smallest page id is a response, the
others are revisits that carry no payload, but the id and the URL of that
response's record. Tasks write their archive files straight to the shared
folder, under a name of their own attempt, and give back one capture line for
each record; only the lines of the attempts that succeeded are known.

Index: capture lines are sorted by a key of the reversed host, path and query,
then by payload digest, responses first, and a running number; they are
range-partitioned and packed into compressed blocks of ``BLOCK_LINES`` lines.
Each sorted part has a sparse directory with the first key and the range of
every block; the first keys of the parts (one a partition) form the top.

Reading: look-ups are sorted by key. A task finds the part in the top, the block
in the part's directory and the line in the block by binary search each, then
reads the record's range. Length and digest are those of the payload that was
read. For revisits that is the payload of the response, which is looked up in
the same way by its URL's key and digest, in an order of its own: a response
with many revisits is read once by each task that has some of them.

Defined results: a null or empty payload is written as an empty record; a null
URL has the key of an empty one; a null page id is written and never referred
to; of repeated rows one at most is a response, if the payload is long enough,
and all are found, as equal keys are told apart by a running number; an empty
table gives no files and an empty result.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import shared_folder, stash
from .files import open_folder

LEAST_BYTES = 100
BLOCK_LINES = 300
KEPT = 8  # directories and blocks that a task keeps


def url_key(url: str | None) -> str:
    """Reversed host, port, path and query: ``https://a.b.com/x?y`` is ``com,b,a)/x?y``; the fragment is dropped."""
    if not url:
        return ")/"
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return ")/" + re.sub(r"\s", "%20", url)
    host = ",".join(reversed(re.sub(r"^www\d*\.", "", host).split(".")))
    at = f":{port}" if port and (u.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return re.sub(r"\s", "%20", f"{host}{at})" + (u.path or "/") + (f"?{u.query}" if u.query else ""))


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers: int | None, refers_url: str | None, number: int) -> bytes:
    """One record as a gzip member."""
    clean = lambda u: re.sub(r"[\r\n]", "", u or "")
    # There is one response with a long payload for each digest; other records are numbered.
    own = digest if kind == "response" and len(payload) >= LEAST_BYTES and page_id is not None else number
    heads = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, own)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", clean(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if kind == "revisit":
        heads += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers, digest)), ("WARC-Refers-To-Target-URI", clean(refers_url)), ("WARC-Refers-To-Date", "1970-01-01T00:00:00Z")]
        payload = b""
    heads += [("Content-Type", "text/html"), ("Content-Length", str(len(payload)))]
    body = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads) + "\r\n"
    return gzip.compress(body.encode() + payload + b"\r\n\r\n", 6, mtime=0)


def record_id(page_id: int | None, own: str | int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{own}>"


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    heads = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    n = int(heads["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record of the wrong length")
    return heads, rest[:n]


def plan_records(pages: DataFrame) -> DataFrame:
    """Pages with ``digest``, ``kind``, ``refers`` and ``refers_url``; only digests, ids and URLs are grouped, with partial sums first."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html").cast("bigint"))
    same = rows.filter(F.col("size") >= LEAST_BYTES).groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.min(F.struct("url"))["url"].alias("url"))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "n")))
    groups = same.groupBy("digest").agg(least.alias("least"), F.sum("n").alias("n")).filter("n > 1 and least is not null")
    first = stash(groups.select("digest", F.col("least.page_id").alias("least"), F.col("least.url").alias("least_url"), F.col("least.n").alias("ties")), "warc-groups")
    joined = rows.join(first, "digest", "left")
    # A null id, like any but the smallest, refers to the smallest.
    smallest = F.col("least").isNotNull() & F.col("page_id").eqNullSafe(F.col("least"))
    planned = lambda df, again: df.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("least")).alias("refers"), F.when(again, F.col("least_url")).alias("refers_url"))
    if first.filter("ties > 1").isEmpty():
        return planned(joined, F.col("least").isNotNull() & ~smallest)
    tied = F.coalesce(smallest & (F.col("ties") > 1), F.lit(False))
    place = F.row_number().over(Window.partitionBy("digest").orderBy(F.col("url").asc_nulls_first()))
    return planned(joined.filter(~tied), F.col("least").isNotNull() & ~smallest).unionByName(planned(joined.filter(tied).withColumn("place", place), F.col("place") > 1))


CAPTURE = "key string, page_id bigint, number bigint, file string, start bigint, length bigint, digest string, again int"


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Write one archive for each partition and give the capture lines, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, base = open_folder(folder)
        name = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc.gz"
        out, at, number = None, 0, ctx.partitionId() << 40
        for batch in batches:
            lines = []
            for page, url, html, digest, kind, refers, refers_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)  # the members are compressed already
                member = make_record(page, url, html.encode(), digest, kind, refers, refers_url, number)
                out.write(member)
                lines.append((url_key(url), page, number, name, at, len(member), digest, int(kind == "revisit")))
                at, number = at + len(member), number + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines) if lines else [[]] * 8, types_of(CAPTURE), strict=True)], names=names_of(CAPTURE))
        if out is not None:
            out.close()

    return stash(planned.mapInArrow(run, CAPTURE), "warc-captures")


def names_of(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def types_of(ddl: str) -> list[pa.DataType]:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return [kinds[x.split()[1]] for x in ddl.split(", ")]


#: What capture lines are sorted by; a look-up knows all of it but the number of a response.
ORDER = ("key", "digest", "again", "number")


def _line(*x) -> bytes:
    return "\t".join(map(str, x)).encode()


def build_index(captures: DataFrame, folder: str) -> list[tuple]:
    """Write sorted blocks and directories; the top: first key and name of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, base = open_folder(folder)
        name = f"index-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        out, at, first, block, directory = None, 0, None, [], []

        def close_block() -> int:
            packed = zlib.compress(b"\n".join(_line(*r) for r in block), 6)
            out.write(packed)
            directory.append(_line(*block[0][:4], at, len(packed)))
            block.clear()
            return at + len(packed)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*ORDER, "page_id", "file", "start", "length")), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out, first = fs.open_output_stream(f"{base}/{name}.blocks"), row[:4]
                block.append(row)
                if len(block) == BLOCK_LINES:
                    at = close_block()
        if out is not None:
            if block:
                at = close_block()
            out.close()
            with fs.open_output_stream(f"{base}/{name}.directory") as f:
                f.write(zlib.compress(b"\n".join(directory), 6))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*first, name), types_of(TOP), strict=True)], names=names_of(TOP))

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    parts = stash(ordered.mapInArrow(run, TOP), "warc-parts")
    # One row for each sorted part, so as many as there are partitions.
    return sorted(((r.key, r.digest, r.again, r.number), r.name) for r in parts.collect())


TOP = "key string, digest string, again int, number bigint, name string"


class Reader:
    """Look-ups in one folder, for one task."""

    def __init__(self, archives: str, index: str, top: list[tuple]):
        self.fs, self.archives = open_folder(archives)
        self.index_fs, self.index = open_folder(index)
        self.top = top
        self.kept: OrderedDict = OrderedDict()

    def _cached(self, name, make):
        if name not in self.kept:
            self.kept[name] = make()
            if len(self.kept) > KEPT:
                self.kept.popitem(last=False)
        self.kept.move_to_end(name)
        return self.kept[name]

    @staticmethod
    def _range(fs, path: str, start: int, length: int) -> bytes:
        with fs.open_input_file(path) as f:
            return f.read_at(length, start)

    @staticmethod
    def _lines(raw: bytes) -> list[list[str]]:
        return [x.split("\t") for x in zlib.decompress(raw).decode().split("\n")]

    def _directory(self, name: str):
        def read():
            with self.index_fs.open_input_stream(f"{self.index}/{name}.directory") as f:
                return [((k, d, int(r), int(n)), int(a), int(b)) for k, d, r, n, a, b in self._lines(f.read())]

        return self._cached(("directory", name), read)

    def _block(self, name: str, start: int, length: int):
        def read():
            raw = self._range(self.index_fs, f"{self.index}/{name}.blocks", start, length)
            return [((k, d, int(r), int(n)), f, int(a), int(b)) for k, d, r, n, _, f, a, b in self._lines(raw)]

        return self._cached(("block", name, start), read)

    def find(self, wanted: tuple) -> tuple | None:
        """The first capture line that is not before ``wanted`` (key, digest, again, number), if it has its key, digest and kind."""
        part = max(0, bisect.bisect_right(self.top, wanted, key=lambda r: r[0]) - 1)
        for name in [x[1] for x in self.top[part : part + 2]]:  # the first line of the next part may be meant
            directory = self._directory(name)
            k = max(0, bisect.bisect_right(directory, wanted, key=lambda r: r[0]) - 1)
            for _, at, size in directory[k : k + 2]:
                block = self._block(name, at, size)
                j = bisect.bisect_left(block, wanted, key=lambda r: r[0])
                if j < len(block):
                    return block[j] if block[j][0][:3] == wanted[:3] else None
        return None

    def read(self, wanted: tuple) -> tuple[dict[str, str], bytes]:
        """The record of a capture, and its payload."""
        line = self.find(wanted)
        if line is None:
            raise LookupError(f"no capture for {wanted[0]}")
        return parse_record(self._range(self.fs, f"{self.archives}/{line[1]}", line[2], line[3]))


FOUND = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string, target string"


def look_up(requests: DataFrame, archives: str, index: str, top: list[tuple], payload: bool = True) -> DataFrame:
    """Read the records of ``requests`` (key, digest, again, number, page_id) through
    the index. A revisit has no length yet, the digest of its header, and the key
    of the response's URL in ``target``. ``payload``: give the payloads back too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(archives, index, top)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                rows = []
                for *wanted, page in zip(*(whole.slice(i, 500).column(c).to_pylist() for c in (*ORDER, "page_id")), strict=True):
                    heads, body = reader.read(tuple(wanted))
                    told = heads["WARC-Payload-Digest"].removeprefix("sha256:")
                    if heads["WARC-Type"] == "revisit":
                        refers = int(heads["WARC-Refers-To"].split(":")[2])
                        rows.append((page, None, told, "revisit", refers, None, url_key(heads["WARC-Refers-To-Target-URI"])))
                    else:
                        rows.append((page, len(body), checked(body, told), "response", None, body.decode() if payload else None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types_of(FOUND), strict=True)], names=names_of(FOUND))

    return requests.select(*ORDER, "page_id").mapInArrow(run, FOUND)


def checked(body: bytes, told: str) -> str:
    """The payload's own digest."""
    own = hashlib.sha256(body).hexdigest()
    if own != told:
        raise ValueError(f"a payload of digest {own} where {told} was written")
    return own


def resolve(revisits: DataFrame, archives: str, index: str, top: list[tuple], payload: bool = True) -> DataFrame:
    """``look_up``'s revisits with length, digest and payload of the response that they refer to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(archives, index, top)
        last, body, digest = None, b"", ""
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                rows = []
                for page, told, refers, target in zip(*(whole.slice(i, 500).column(c).to_pylist() for c in ("page_id", "payload_digest", "refers_to", "target")), strict=True):
                    if (target, told) != last:
                        heads, body = reader.read((target, told, 0, -1))
                        digest, last = checked(body, told), (target, told)
                    if heads["WARC-Record-ID"] != record_id(refers, told):
                        raise ValueError(f"a revisit of {record_id(refers, told)}, which is not there")
                    rows.append((page, len(body), digest, "revisit", refers, body.decode() if payload else None, target))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types_of(FOUND), strict=True)], names=names_of(FOUND))

    n = int(revisits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The page id splits the revisits of one response over tasks.
    order = ("target", "payload_digest", "page_id")
    return revisits.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, FOUND)


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str, str, list[tuple]]:
    """Write archives and index of (page_id, url, html); capture lines, both folders and the index's top."""
    base = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    captures = write_archives(plan_records(pages), f"{base}/archives")
    return captures, f"{base}/archives", f"{base}/index", build_index(captures, f"{base}/index")


def read_back(pages: DataFrame, folder: str | None = None, payload: bool = True) -> DataFrame:
    """Archive the pages, then look every capture up in the order of the index, and every revisit's response."""
    captures, archives, index, top = archive(pages, folder)
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    requests = captures.select(*ORDER, "page_id").repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    found = stash(look_up(requests, archives, index, top, payload), "warc-found")
    return found.filter("record_type = 'response'").unionByName(resolve(found.filter("record_type = 'revisit'"), archives, index, top, payload)).drop("target")


def query(spark, sf_dir: str) -> DataFrame:
    got = read_back(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), payload=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS size, sha256(html) AS digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS least FROM d)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= {LEAST_BYTES} AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= {LEAST_BYTES} AND page_id <> least THEN least END AS refers_to
FROM m
"""
