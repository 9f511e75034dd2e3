"""Substring dedup: passages of 50 words or more that an earlier document has too are cut.

Anchors are windows of 20 words that begin at positions of a difference cover
modulo 31.  For any two positions the cover has a common shift below 31, so two
equal passages of 50 words hold an equal anchor at equal offsets, wherever they
begin.  An anchor that only one document has tells that no passage around it
repeats; the others are extended: the 50-word windows that hold one are compared
by hash, and each is cut from all documents but the one with the least doc_id.

Shared anchors are told to the workers as a bitmap of bounded size; a false hit
there only makes more windows to compare.  Windows are combined within a chunk
of text before they are shuffled, so a frequent passage sends a row for each
chunk and not for each document, and passages found there travel as runs.

Windows are judged on the input.  Null texts have no words.  Rows without a
doc_id are neither cut nor compared.  Rows that share a doc_id do not cut each
other.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .arrowtext import Words, batch_words, chunks, signed
from .bpe import gather
from .scratch import small_batches

WINDOW = 50
#: A difference cover: every residue modulo PERIOD is a difference of two members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1
_COVERED = np.isin(np.arange(PERIOD), COVER)
#: Bits of the bitmap of shared anchors (32 MB) and of the bitmap of cut documents (2 MB).
ANCHOR_BITS, DOCUMENT_BITS = 28, 24
#: A position is held with a tag of its text, so that rows that share a doc_id are told apart.
_PLACE_BITS = 36
_TAG_SHIFT = np.uint64(_PLACE_BITS)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, at, hashes = words.windows(ANCHOR)
    own = _COVERED[(at - words.ptr[doc]) % PERIOD]
    return doc[own], at[own], hashes[own]


def _tags(words: Words) -> np.ndarray:
    return words.whole() >> np.uint64(_PLACE_BITS + 1) << _TAG_SHIFT


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, least and largest doc_id) of every anchor of a chunk."""
    for batch in batches:
        for part in chunks(batch):
            doc, _, hashes = _anchors(batch_words(part))
            ids = _ids(part)[doc]
            order = np.lexsort((ids, hashes))
            hashes, ids = hashes[order], ids[order]
            first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][:len(hashes)])
            last = np.r_[first[1:], len(hashes)][:len(first)] - 1
            yield pa.RecordBatch.from_pydict({"h": signed(hashes[first]), "lo": ids[first], "hi": ids[last]})


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes & np.uint64((1 << bits) - 1)


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First indices and lengths of runs of consecutive positions of one document; input sorted by both."""
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)][:len(doc)])
    return first, np.diff(np.r_[first, len(doc)])[:len(first)]


def _window_rows(shared):
    """Windows that hold a shared anchor: (hash, doc_id, place, 0) for the least doc_id in the chunk; what the
    others lose at once as runs (random key, doc_id, place, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for part in chunks(batch):
                words = batch_words(part)
                doc, at, hashes = _anchors(words)
                place = _place(hashes, ANCHOR_BITS)
                hit = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                edge = np.zeros(len(words.hashes) + 1, np.int32)
                np.add.at(edge, np.maximum(at[hit] - (PERIOD - 1), words.ptr[doc[hit]]), 1)
                np.add.at(edge, at[hit] + 1, -1)
                doc, at, hashes = words.windows(WINDOW)
                held = np.cumsum(edge)[at] > 0
                doc, at, hashes = doc[held], at[held], hashes[held]
                ids = _ids(part)
                order = np.lexsort((ids[doc], hashes))
                doc, at, hashes = doc[order], at[order], hashes[order]
                first = np.r_[True, hashes[1:] != hashes[:-1]][:len(hashes)]
                least = ids[doc][np.flatnonzero(first)][np.cumsum(first) - 1] if len(doc) else ids[doc]
                stays = ids[doc] == least
                own = at - words.ptr[doc]
                lost = np.flatnonzero(~stays)
                lost = lost[np.lexsort((own[lost], doc[lost]))]
                begin, length = _runs(doc[lost], own[lost])
                begin = lost[begin]
                tags = _tags(words)
                row = np.r_[np.flatnonzero(stays), begin]
                yield pa.RecordBatch.from_pydict({
                    "h": signed(hashes[row]), "doc_id": ids[doc[row]],
                    "place": signed(tags[doc[row]] | own[row].astype(np.uint64)), "run": np.r_[np.zeros(stays.sum(), np.int64), length]})

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hash, doc_id): what is lost as (doc_id, place, length); a group may span any number of batches."""
    open_hash, open_doc = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, ids, place, run = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        done = np.flatnonzero(run > 0)
        single = np.flatnonzero(run == 0)
        lost = single[:0]
        if len(single):
            hs, ds = h[single], ids[single]
            first = np.r_[True, hs[1:] != hs[:-1]]
            least = ds[np.flatnonzero(first)]
            if open_hash == hs[0]:
                least[0] = open_doc
            owner = np.cumsum(first) - 1
            lost = single[ds != least[owner]]
            open_hash, open_doc = hs[-1], least[-1]
        row = np.r_[done, lost]
        yield pa.RecordBatch.from_pydict({"doc_id": ids[row], "place": place[row], "run": np.maximum(run[row], 1)})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, n_removed, kept) of (doc_id, text, lost) rows."""
    for batch in batches:
        for part in chunks(batch):
            words = batch_words(part)
            n = len(words.hashes)
            gone = np.zeros(n + 1, np.int32)
            lost, tags = part.column(2), _tags(words)
            for i in range(part.num_rows):
                if not lost[i].is_valid:
                    continue
                both = lost[i].values
                place = both.field(0).to_numpy().view(np.uint64)
                mine = place >> _TAG_SHIFT << _TAG_SHIFT == tags[i]
                begin = (place[mine] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64) + words.ptr[i]
                np.add.at(gone, begin, 1)
                np.add.at(gone, begin + both.field(1).to_numpy()[mine] + WINDOW - 1, -1)
            stay = np.cumsum(gone)[:n] == 0
            length = (words.end - words.start)[stay] + 1
            text = gather(np.append(words.data, np.uint8(32)), words.start[stay], length)
            ends = np.r_[0, np.cumsum(length)]
            text[ends[1:] - 1] = 32
            kept = np.r_[0, np.cumsum(stay)][words.ptr]
            raw, at = text.tobytes(), ends[kept]
            out = [raw[a:max(a, b - 1)] for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(0), "n_words": words.counts, "n_removed": words.counts - np.diff(kept),
                "kept": pa.array(out, pa.binary()).cast(pa.string())})


def dedup_substrings(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; kept holds the remaining words, joined by one space."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where("doc_id is not null")
    anchors = named.mapInArrow(_anchor_rows, "h long, lo long, hi long")
    shared = anchors.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    bits = spark.sparkContext.broadcast(bitmap.to_numpy(bitmap.of_places(shared.select(F.col("h").bitwiseAND((1 << ANCHOR_BITS) - 1).alias("p"))), ANCHOR_BITS))
    rows = named.mapInArrow(_window_rows(bits), "h long, doc_id long, place long, run long")
    lost = rows.repartition("h").sortWithinPartitions("h", "doc_id").mapInArrow(_scan, "doc_id long, place long, run long") \
        .groupBy("doc_id").agg(F.collect_list(F.struct("place", "run")).alias("lost"))
    return docs.join(lost, "doc_id", "left").select("doc_id", "text", "lost").mapInArrow(
        _cut, "doc_id long, n_words long, n_removed long, kept string")


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    return dedup_substrings(documents).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
