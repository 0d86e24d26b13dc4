import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestack.llm import warc as A

LONG = "<p>é " + "x" * 200
ROWS = [
    (5, "https://www.a.b.com/x?y=1#f", LONG), (3, "http://a.b.com:8080/x", LONG), (9, None, LONG), (None, "http://c.org/", LONG), (4, "http://c.org/", "short"), (6, "http://c.org/", "short"),
    (7, "bad url\n[", None), (8, "", ""), (10, "http://[::1", "y" * 100), (11, "http://z.net/a b", "y" * 100), (12, "http://z.net", "\r\n\r\nWARC/1.1\r\n" * 20), (12, "http://z.net", "\r\n\r\nWARC/1.1\r\n" * 20),
    (13, "http://big.net", "é" * 300000),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "key": F.lit(2)}).repartition(3)


def test_keys():
    assert A.url_key("https://www.a.b.com/x?y=1#f") == "com,b,a)/x?y=1"
    assert A.url_key("http://A.b.com:8080") == "com,b,a:8080)/" and A.url_key(None) == ")/"


@pytest.mark.parametrize("block", [300, 2])
def test_round_trip(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(A, "BLOCK_LINES", block)
    out = A.read_back(frame(spark), f"file://{tmp_path}/w").collect()
    assert len(out) == len(ROWS)
    html = {}
    for i, _, h in ROWS:
        html[i] = (h or "").encode()
    for r in out:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest()
        assert r.payload.encode() == html[r.page_id]
    by = {r.page_id: (r.record_type, r.refers_to) for r in out}
    assert by[3] == ("response", None) and by[5] == by[9] == by[None] == ("revisit", 3)
    assert by[4] == by[6] == by[7] == by[8] == ("response", None) and by[11] == ("revisit", 10)
    assert sorted((r.record_type, r.refers_to) for r in out if r.page_id == 12) == [("response", None), ("revisit", 12)]  # a repeated row
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w/archives").iterdir())
    ids = re.findall(rb"WARC-Record-ID: (\S+)", whole)
    assert len(ids) == len(set(ids)) == len(ROWS)
    refers = re.findall(rb"WARC-Refers-To: (\S+)", whole)
    assert len(refers) == sum(r.record_type == "revisit" for r in out) and set(refers) <= set(ids)
    assert b"Payload-Length" not in whole


def test_missing_keys(spark, tmp_path):
    captures, archives, index, top = A.archive(frame(spark), f"file://{tmp_path}/w")
    reader = A.Reader(archives, index, top)
    assert reader.find(("", "", 0, 0)) is None and reader.find(("zz", "", 0, 0)) is None and reader.find(("com,b,a)/x", "", 0, -5)) is None
    r = captures.filter("page_id = 3").first()
    assert reader.read((r.key, r.digest, r.again, r.number))[1].decode() == LONG
    assert reader.read((r.key, r.digest, 0, -1))[1].decode() == LONG and reader.find((r.key, r.digest, 1, -1)) is None


def test_hot_payload(spark, tmp_path):
    """A third of all pages are copies of one; every one is resolved through its response."""
    rows = [(i, f"http://h{i % 7}.org/{i}", "copy " * 40 if i % 3 else f"page {i} " * 30) for i in range(900)]
    out = A.read_back(frame(spark, rows), f"file://{tmp_path}/w", payload=False).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out) == [(i, len(h), "revisit" if i % 3 and i > 1 else "response", 1 if i % 3 and i > 1 else None) for i, _, h in rows]


def test_empty(spark):
    assert A.read_back(frame(spark, [])).count() == 0
