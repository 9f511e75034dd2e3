import base64
import gzip
import hashlib
import io

import pytest

from loomspan.llm import queries, warc
from loomspan.llm.files import open_file

SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute_force(pages, least=0):
    last = {}
    for i, html in pages:
        last[html or ""] = max(last.get(html or "", i), i)
    out = []
    for i, html in pages:
        html = html or ""
        to = last[html] if last[html] > i and len(html.encode()) >= least else None
        out.append((i, len(html.encode()), digest(html), "response" if to is None else "revisit", to))
    return sorted(out)


def got(df):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_query_equals_brute_force(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert got(queries.op7_warc(spark, sf)) == brute_force(pages)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i}/é%\r\n", ["", None, "<p>same</p>", f"<p>{i}</p>\r\n\r\nWARC/1.1\r\n", "é" * 5000][i % 5]) for i in range(60)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("least", [0, 5, 10**6])
def test_round_trip_and_revisits(pages, least, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    rows, df = pages
    archives = warc.normalise(warc.write_archives(df, least))
    back = warc.read_archives(archives).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == brute_force([(i, h) for i, _, h in rows], least)
    texts = {r.page_id: r.html for r in back if r.record_type == "response"}
    assert all(r.url == rows[r.page_id][1] and texts[r.page_id if r.refers_to is None else r.refers_to] == (rows[r.page_id][2] or "") for r in back)


def test_every_record_is_a_member_at_its_offset(pages):
    for row in warc.normalise(warc.write_archives(pages[1])).collect():
        with open_file(row.index_uri) as f:
            index = [x.split("\t") for x in f.read().decode().splitlines()]
        with open_file(row.uri) as f:
            raw = f.read()
        assert len(index) == row.n_records
        at = 0
        for offset, length, kind, name in index:
            assert int(offset) == at
            text = gzip.decompress(raw[at:at + int(length)])
            assert text.startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode()) and name.encode() in text
            at += int(length)
        assert at == len(raw)


def test_streams_of_several_members_and_broken_ones():
    one = warc.record(1, "u", b"x" * 100, digest("x" * 100), None, "d")
    two = warc.record(2, "u", b"", digest(""), 1, "d")
    raw = gzip.compress(one[:50]) + gzip.compress(one[50:] + two)
    assert list(warc.records(warc.inflate(io.BytesIO(raw)))) == [one, two]
    with pytest.raises(ValueError):
        list(warc.records(iter([one[:-9]])))


def test_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, None), (None, "u", "same"), (3, None, "same"), (3, None, "same"), (2, "u", "same"), (3, "u", "other")], SCHEMA)
    rows = warc.read_archives(warc.normalise(warc.write_archives(odd))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in rows) == [
        (0, "response", 0), (0, "response", 0), (2, "revisit", 3), (3, "response", 0), (3, "response", 0), (3, "response", 0)]
    assert warc.read_archives(warc.normalise(warc.write_archives(odd.limit(0)))).count() == 0
