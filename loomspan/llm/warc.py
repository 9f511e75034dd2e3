"""WARC archives: written as whole-file gzip streams, normalised to one member a record, read back by index.

`write_archives` makes monolithic archives (one gzip stream each) of bounded
size.  `normalise` inflates each stream once, front to back, rewrites every
record as its own gzip member and writes a sidecar index of member offsets.
`read_archives` seeks to each member that the index names.

Of pages with equal payloads, the one with the largest page_id is a response and
the others are revisit records without a payload, which name it; payloads
shorter than `least` bytes are all responses.  A null html counts as empty.
Rows without a page_id are responses that no revisit names.  Rows that repeat a
page_id each give a record; of those with the largest page_id, all are responses.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import create, open_file
from .scratch import Table, new_path, small_batches

#: An archive is closed when so many bytes went into it.
ARCHIVE_BYTES = 16 << 20
READ_BYTES = 1 << 20
LEVEL = 5
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD_ID = "urn:loomspan:page:"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str | None) -> str:
    """A header value: line ends would end it, so they are escaped."""
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, with the blank lines after it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <{_RECORD_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_RECORD_ID}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a header block, by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a stream of WARC bytes; one record is held at a time."""
    held = bytearray()
    at_end = False

    def more() -> bool:
        nonlocal at_end
        piece = next(pieces, None)
        at_end = piece is None
        held.extend(piece or b"")
        return not at_end

    while True:
        while b"\r\n\r\n" not in held and more():
            pass
        end = held.find(b"\r\n\r\n")
        if end < 0:
            if held.strip():
                raise ValueError("the archive ends within a record")
            return
        whole = end + 4 + int(fields(bytes(held[:end]))["content-length"]) + 4
        while len(held) < whole and more():
            pass
        if len(held) < whole:
            raise ValueError("the archive ends within a record")
        yield bytes(held[:whole])
        del held[:whole]


def inflate(source) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, read once from front to back."""
    member = zlib.decompressobj(31)
    while piece := source.read(READ_BYTES):
        while piece:
            if out := member.decompress(piece, READ_BYTES):
                yield out
            piece = member.unconsumed_tail
            if member.eof:
                piece = member.unused_data
                member = zlib.decompressobj(31)
    if out := member.flush():
        yield out


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archives, out, uri, stream, size, count = TaskContext.get().partitionId(), 0, None, "", None, 0, 0

        def close() -> pa.RecordBatch:
            out.write(stream.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"uri": [uri], "n_records": [count]})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4))):
                if out is None:
                    uri, out = create(folder, f"pages-{task:06d}-{archives:06d}", ".warc.gz")
                    stream, size, count = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                    archives += 1
                payload = (html.as_py() or "").encode()
                raw = record(page_id.as_py(), url.as_py(), payload, sha1_base32(payload), refers_to.as_py(), date)
                out.write(stream.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                stem = uri.rsplit("/", 1)[1].removesuffix(".warc.gz")
                new, out = create(folder, stem, ".warc.gz")
                index_uri, index = create(folder, stem, ".idx")
                offset = count = 0
                with open_file(uri) as source, out, index:
                    for raw in records(inflate(source)):
                        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = pack.compress(raw) + pack.flush()
                        out.write(member)
                        head = fields(raw[:raw.find(b"\r\n\r\n")])
                        index.write(f"{offset}\t{len(member)}\t{head['warc-type']}\t{head['warc-record-id']}\n".encode())
                        offset, count = offset + len(member), count + 1
                yield pa.RecordBatch.from_pydict({"uri": [new], "index_uri": [index_uri], "n_records": [count]})

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html")
    for batch in batches:
        for uri, index_uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with open_file(index_uri) as f:
                index = [line.split("\t") for line in f.read().decode().splitlines()]
            rows, held = [], 0
            with open_file(uri) as f:
                for offset, length, _, _ in index:
                    f.seek(int(offset))
                    raw = zlib.decompress(f.read(int(length)), 31)
                    end = raw.find(b"\r\n\r\n")
                    head = fields(raw[:end])
                    block = raw[end + 4:end + 4 + int(head["content-length"])]
                    http = block.find(b"\r\n\r\n")
                    payload = block[http + 4:] if head["warc-type"] == "response" else None
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if payload is not None and sha1_base32(payload) != digest:
                        raise ValueError(f"{uri} at {offset}: the payload does not have its digest")
                    named = [head.get(k, "").strip("<>").removeprefix(_RECORD_ID) for k in ("warc-record-id", "warc-refers-to")]
                    url = head["warc-target-uri"].replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                    rows.append((int(named[0]) if named[0] else None, url, int(fields(block[:http])["content-length"]), digest,
                                 head["warc-type"], int(named[1]) if named[1] else None, None if payload is None else payload.decode()))
                    held += len(raw)
                    if held >= READ_BYTES:
                        yield _rows(names, rows)
                        rows, held = [], 0
            if rows:
                yield _rows(names, rows)


def _rows(names, rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=list(names))


def _spread(manifest: DataFrame) -> DataFrame:
    """A manifest dealt out by archive: its rows are few and small, but each stands for much work."""
    return manifest.repartition(max(1, min(manifest.count(), 10_000)), "uri")


def write_archives(pages: DataFrame, least: int = 0, folder: str | None = None, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write monolithic archives; the manifest (uri, n_records)."""
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
                       F.sha1(html.cast("binary")).alias("digest"))
    names = own.where("page_id is not null").where(F.octet_length("html") >= least).select("page_id", "digest").distinct()
    last = Table(names.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads").df
    revisits = names.join(last, "digest").where("page_id < refers_to")
    return Table(own.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
                 .mapInArrow(_write(folder or new_path(spark, "warc"), date), "uri string, n_records long"), "archives").df


def normalise(archives: DataFrame, folder: str | None = None) -> DataFrame:
    """Rewrite archives (column uri) with one member a record; the manifest (uri, index_uri, n_records)."""
    spark = archives.sparkSession
    return Table(_spread(archives.select("uri")).mapInArrow(
        _normalise(folder or new_path(spark, "warc")), "uri string, index_uri string, n_records long"), "archives").df


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html) of every record; html is null for revisits."""
    return _spread(archives.select("uri", "index_uri")).mapInArrow(
        _read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")
