"""Token-id files: a concatenated id array, and Elias-Fano codes of its document boundaries.

Documents are range-partitioned and sorted by doc_id, encoded, ended with an end
id and written as shards of bounded size to the cluster's shared folder.  Each
shard holds a header, the Elias-Fano codes of its document boundaries and of its
doc_ids, and the ids in the narrowest of 16 and 32 bits.  The manifest has a row
for each shard; the ids before a shard are a running sum over it.

Null texts count as empty and have the end id alone.  Rows without a doc_id come
first and keep a null doc_id; rows that share one follow each other, ordered by
their text.  Extra columns are not stored.  An empty table gives no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import chunks, text_bytes
from .bpe import tokenizer
from .elias_fano import EliasFano, encode
from .files import create, open_file
from .scratch import Table, new_path, small_batches

MAGIC = b"LOOMTOK1"
#: documents, documents without a doc_id, ids, bytes of an id, least doc_id
_HEAD = struct.Struct("<8sQQQQq")
#: A shard is closed when it holds so many ids; the document that passes the mark is still its.
SHARD_IDS = 4_000_000


def shard_bytes(doc_ids: np.ndarray, nulls: int, bounds: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a shard of documents whose ids end at bounds[1:]; the first `nulls` have no doc_id."""
    wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    least = int(doc_ids[0]) if len(doc_ids) else 0
    above = doc_ids.astype(np.uint64) - np.uint64(least & 0xFFFFFFFFFFFFFFFF)
    return [_HEAD.pack(MAGIC, len(bounds) - 1, nulls, len(ids), wide, least), encode(bounds), encode(above),
            ids.astype("<u2" if wide == 2 else "<u4").tobytes()]


class Shard:
    """A shard that has been read: boundaries by select, ids of a document without touching the others."""

    def __init__(self, raw: bytes):
        magic, self.docs, self.nulls, self.size, self.wide, self.least = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.bounds = EliasFano(raw, _HEAD.size)
        self.keys = EliasFano(raw, _HEAD.size + self.bounds.size)
        at = _HEAD.size + self.bounds.size + self.keys.size
        self.ids = np.frombuffer(raw, "<u2" if self.wide == 2 else "<u4", self.size, at)

    def doc_ids(self) -> list[int | None]:
        found = self.keys.get(np.arange(self.docs - self.nulls)) + np.uint64(self.least & 0xFFFFFFFFFFFFFFFF)
        return [None] * self.nulls + found.view(np.int64).tolist()

    def document(self, k: int) -> np.ndarray:
        first, last = self.bounds.get(np.array([k, k + 1])).astype(np.int64)
        return self.ids[first:last]


def _writer(path: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, shards = tokenizer(path), TaskContext.get().partitionId(), 0
        keys, parts, sizes, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            bounds = np.r_[0, np.cumsum(np.concatenate(sizes))]
            named = [k for k in keys if k is not None]
            uri, out = create(folder, f"tokens-{task:06d}-{shards:06d}", ".bin")
            with out:
                for x in shard_bytes(np.array(named, np.int64), len(keys) - len(named), bounds, ids):
                    out.write(x)
            return pa.RecordBatch.from_pydict({"part": [task], "shard": [shards], "uri": [uri], "n_docs": [len(keys)], "n_ids": [len(ids)]})

        for batch in batches:
            for piece in chunks(batch):
                flat, ptr = own.encode_batch(*text_bytes(piece.column(1)))
                size = np.diff(ptr) + 1
                whole = np.full(len(flat) + len(size), end_id, np.int32)
                inner = np.ones(len(whole), bool)
                inner[np.cumsum(size) - 1] = False
                whole[inner] = flat
                keys += piece.column(0).to_pylist()
                parts.append(whole)
                sizes.append(size)
                held += len(whole)
                if held >= SHARD_IDS:
                    yield close()
                    shards, keys, parts, sizes, held = shards + 1, [], [], [], 0
        if keys:
            yield close()

    return run


def write_token_files(documents: DataFrame, path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write shards; the manifest (part, shard, uri, n_docs, n_ids, start), start being the ids of all shards before."""
    spark = documents.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "tokens")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made = Table(ordered.mapInArrow(_writer(path, folder, end_id), "part long, shard long, uri string, n_docs long, n_ids long"), "manifest").df
    parts = made.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return made.withColumn("within", within).join(before, "part").select(
        "part", "shard", "uri", "n_docs", "n_ids", (F.col("before") + F.col("within")).alias("start"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with open_file(uri) as f:
                shard = Shard(f.read())
            bounds = shard.bounds.get(np.arange(shard.docs + 1)).astype(np.int64)
            keys = shard.doc_ids()
            for i in range(0, shard.docs, 4096):
                at = bounds[i:i + 4097]
                ids = shard.ids[at[0]:at[-1]].astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1] - at[0], at[1:] - at[0])]
                rows = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys[i:i + 4096], pa.int64()), "start": base + at[:-1], "n_tokens": np.diff(at),
                                                  "ids_crc32": pa.array(crc, pa.int64()), "ids": rows})


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document of the manifest's shards, from the files alone."""
    small_batches(manifest.sparkSession)
    files = manifest.count()
    spread = manifest.select("uri", "start", "part", "shard").repartition(max(1, min(files, 10_000)), "part", "shard").select("uri", "start")
    return spread.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
