"""Archives: members that can be read alone, ids of the whole range, odd tables, large payloads."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from driftline.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def plain(rows):
    """(payload_bytes, digest, type, refers_to, url) of each row, by comparing all payloads."""
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        keeper = max((p for p, _, h in rows if p is not None and (h or "") == (html or "")), default=None) if len(data) >= 1000 else None
        revisit = keeper is not None and i != keeper
        out.append((i, url or "", len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


ODD = [
    (1, "http://a.org/", "x" * 1000), (1, "http://a.org/", "x" * 1000), (None, None, None), (None, "http://b.org/ two", "x" * 1000), (2, "", ""), (3, "no url", "é" * 600),
    (-(2**63), "http://a.org/", "y" * 2000), (2**63 - 1, "http://a.org/", "y" * 2000), (10**13, "http://a.org/", "\r\n\r\n\0WARC/1.1\r\n" * 90), (3 * 10**11, "http://a.org/", "\0" * 5000), (0, "http://a.org/", "tie"), (-5, "http://a.org/", "tie"),
]


def test_odd_pages(spark, tmp_path):
    pages = spark.createDataFrame(ODD, SCHEMA).repartition(3).withColumns({c: F.lit("extra") for c in ("payload", "digest", "n", "key", "keeper", "value", "time", "offset", "archive", "range", "url_key", "seq")})
    path = str(tmp_path / "a")
    warc.write_archives(pages, path)
    assert got(warc.read_archives(spark, path)) == plain(ODD)
    index = warc.archive_and_index(pages).orderBy("capture_rank").collect()
    assert [r.capture_rank for r in index] == list(range(len(ODD)))
    same = [r.page_id for r in index if r.url_key == "org,a)/"]
    assert same == sorted(same)
    keys = [(r.url_key, r.time) for r in index]
    assert keys == sorted(keys)


@pytest.mark.parametrize("ids", [[-(2**63), -(10**18), -1, 0, 1, 10**13, 3 * 10**11, 2**63 - 1], [random.Random(5).randrange(-(2**63), 2**63) for _ in range(200)]])
def test_times_sort_as_ids(ids):
    times = [warc.capture_time(i) for i in sorted(ids)]
    assert times == sorted(times) and len({len(t) for t in times}) == 1


def test_records_can_be_read_alone(spark, tmp_path, monkeypatch):
    """At an index entry's offset lies a member with that record; archives hold no more records than their class allows, and begin with their own."""
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", ((300, 7), (1 << 20, 2), (1 << 31, 1)))
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 5}.org/{i}", "".join(rng.choices("abc <>é", k=rng.choice([0, 50, 200, 900, 4000])))) for i in range(90)]
    path = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(4), path)
    captures = warc.read_archives(spark, path).collect()
    html = {i: h for i, _, h in rows}
    count = {}
    for r in captures:
        with open(f"{path}/{r.archive}", "rb") as f:
            data = f.read()
        count[r.archive] = count.get(r.archive, 0) + 1
        assert next(warc.parse_archive(data))[1]["warc-type"] == "warcinfo"
        at, headers, block = next(warc.parse_archive(data[r.offset :]))
        assert at == 0 and headers["warc-record-id"] == f"<urn:page:{r.page_id}>"
        assert block.split(b"\r\n\r\n", 1)[1] == html[r.page_id].encode()
        assert gzip.decompress(data).startswith(b"WARC/1.1")
    assert len(captures) == 90 and all(n <= (7 if "upto-300/" in a else 2) for a, n in count.items())


def test_very_long_payload(spark, tmp_path):
    """A record over 16 MB is two members; its archive is read back whole."""
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh\n", k=1 << 16)) * 300
    rows = [(7, "http://a.org/long", long), (8, "http://a.org/long", long), (9, "http://a.org/", "short")]
    path = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    assert got(warc.read_archives(spark, path)) == plain(rows)


def test_ids_that_are_no_numbers_are_refused(spark, tmp_path):
    with pytest.raises(TypeError):
        warc.write_archives(spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string"), str(tmp_path / "a"))


@pytest.mark.parametrize("data", [b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc", b"WARC/1.1\r\nWARC-Type: x\r\n\r\n\r\n\r\n", b"hello\r\n\r\n", gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")[:-3]])
def test_broken_archives(data):
    with pytest.raises(ValueError):
        list(warc.parse_archive(data))
