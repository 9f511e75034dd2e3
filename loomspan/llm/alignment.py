"""Alignment of two tokenizers' tokens, weighted by what stands together in the whole corpus.

A text's tokens by two tokenizers are cut into groups at the byte offsets where tokens of both
end; every A token of a group is linked with every B token of it.  A pair of ids counts in
how many documents it is linked.

    encode     each task writes, for its documents, what a document has by itself, its postings
               (pair, document, how many links) packed by slot of the A id, and its pair counts
    counts     the pairs' counts are added up by Spark
    cogroup    a slot's counts and postings meet in one task as a sorted stream, counts
               first; the task keeps the counts, takes the largest of each A id, and
               turns postings into what they add to their documents
    documents  those sums, packed by the part that documents were encoded in, are added up by document

Only counts are kept in memory, and their number is bounded by the vocabularies; the
postings go by.  A slot with more than its share of postings is dealt over several tasks, each
of which gets its counts.

Texts that are null, empty, or that one of the tokenizers does not give back byte by byte have no
tokens.  Rows without a doc_id, repeated rows and rows that share a doc_id are documents of their
own.  Special tokens' texts are plain text.  Extra columns are ignored.  An id pair that links
several times in a document counts once for it.  A group of very many tokens costs the
number of its different ids on both sides, multiplied.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import chunks, text_bytes
from .bpe import _flat, gather, tokenizer
from .scratch import Table, small_batches

#: Slots of A ids; postings, or documents, that a task holds before it packs them; pair counts that it holds before it gives them away.
SLOTS, POSTINGS, PAIRS = 1024, 1_000_000, 1_000_000
#: A slot's postings are dealt anew in parts of a quarter of an even share of the tasks, within these bounds.
LEAST_PART, MOST_PART = 100_000, 20_000_000
#: Groups with more links than this are counted by their different ids.
LARGE_GROUP = 1 << 16


class ByteSide:
    """A byte-level tokenizer; a space goes before each text."""

    def __init__(self, path: str):
        self.own = tokenizer(path, specials=False)
        self.size = len(self.own.token_length)

    def encode(self, data: np.ndarray, offsets: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.own.encode_batch(data, offsets)

    def pieces(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.own.token, self.own.token_start[ids], self.own.token_length[ids]), self.own.token_length[ids]


class PieceSide:
    """A tokenizer of pieces, which adds a space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.own.get_piece_size()
        told = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in enumerate(map(self.own.id_to_piece, range(self.size)))]
        self.token, self.start, self.length = _flat(told)

    def encode(self, data: np.ndarray, offsets: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.own.encode(texts, num_threads=1)
        ptr = np.r_[0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]
        return np.fromiter(chain.from_iterable(found), np.int32, int(ptr[-1])), ptr

    def pieces(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.token, self.start[ids], self.length[ids]), self.length[ids]


_loaded: dict[tuple[str, str], tuple[ByteSide, PieceSide]] = {}


def sides(byte_path: str, piece_path: str) -> tuple[ByteSide, PieceSide]:
    """Both tokenizers, loaded once for each worker."""
    if (byte_path, piece_path) not in _loaded:
        _loaded[byte_path, piece_path] = ByteSide(byte_path), PieceSide(piece_path)
    return _loaded[byte_path, piece_path]


class Aligned:
    """The tokens and groups of some texts: ids of each side, and the group and document of each."""

    def __init__(self, column: pa.Array, both: tuple[ByteSide, PieceSide]):
        bare, at = text_bytes(column)
        docs = len(column)
        data = np.insert(bare, at[:-1], ord(" ")) if docs else bare
        offsets = at + np.arange(docs + 1)
        texts = [x or "" for x in column.to_pylist()]
        ids, ptrs, raws, ends = [], [], [], []
        for side in both:
            own, ptr = side.encode(data, offsets, texts)
            raw, length = side.pieces(own)
            ids.append(own)
            ptrs.append(ptr)
            raws.append(raw.tobytes())
            ends.append(np.r_[0, np.cumsum(length)])
        told = data.tobytes()
        good = np.diff(at) > 0
        for i in np.flatnonzero(good):
            want = told[offsets[i]:offsets[i + 1]]
            good[i] = all(raw[end[ptr[i]]:end[ptr[i + 1]]] == want for raw, end, ptr in zip(raws, ends, ptrs))
        self.docs, self.good = docs, good
        self.ids, self.doc, stops = [], [], []
        for own, ptr, end in zip(ids, ptrs, ends):
            doc = np.repeat(np.arange(docs), np.diff(ptr))
            keep = good[doc]
            self.ids.append(own[keep].astype(np.int64))
            self.doc.append(doc[keep])
            stops.append(np.cumsum(np.diff(end)[keep]))
        size = int(stops[0][-1]) if len(stops[0]) else 0
        marks = [np.zeros(size + 1, bool) for _ in both]
        for mark, stop in zip(marks, stops):
            mark[stop] = True
        shared = np.cumsum(marks[0] & marks[1])
        # the group of a token: the shared ends before its own last byte
        self.group = [shared[stop - 1] for stop in stops]
        self.groups = int(shared[-1])
        self.sizes = [np.bincount(g, minlength=self.groups) for g in self.group]
        self.group_doc = np.zeros(self.groups, np.int64)
        self.group_doc[self.group[0]] = self.doc[0]

    def per_document(self) -> tuple[np.ndarray, ...]:
        """A tokens, B tokens, groups and links of each document."""
        links = np.zeros(self.docs, np.int64)
        np.add.at(links, self.group_doc, self.sizes[0] * self.sizes[1])
        return *(np.bincount(x, minlength=self.docs) for x in (*self.doc, self.group_doc)), links

    def written(self, numbers: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
        token, token_start, token_length = numbers
        a, b = self.sizes
        before_a, before_b = np.cumsum(a) - a, np.cumsum(b) - b
        n = len(self.ids[0]) + len(self.ids[1])
        all_ids, mark = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
        all_ids[np.arange(len(self.ids[0])) + before_b[self.group[0]]] = self.ids[0]
        all_ids[np.arange(len(self.ids[1])) + (before_a + a)[self.group[1]]] = self.ids[1]
        mark[before_a + before_b + a - 1] = ord("|")
        mark[before_a + before_b + a + b - 1] = ord(";")
        length = token_length[all_ids]
        flat = gather(token, token_start[all_ids], length)
        ends = np.cumsum(length)
        flat[ends - 1] = mark
        tokens = np.cumsum(np.bincount(np.r_[self.doc[0], self.doc[1]], minlength=self.docs))
        bounds = np.r_[0, ends][np.r_[0, tokens]].tolist()
        raw = flat.tobytes()
        return [raw[i:max(i, j - 1)] for i, j in zip(bounds, bounds[1:])]

    def links(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, links of it in the document), sorted; a pair is a * width + b."""
        a, b = self.sizes
        before_b = np.cumsum(b) - b
        large = a * b > LARGE_GROUP
        small = ~large[self.group[0]]
        group, ids, doc = self.group[0][small], self.ids[0][small], self.doc[0][small]
        fan = b[group]
        docs, pairs, times = [np.repeat(doc, fan)], [np.repeat(ids, fan) * width + gather(self.ids[1], before_b[group], fan)], [np.ones(int(fan.sum()), np.int64)]
        before_a = np.cumsum(a) - a
        for g in np.flatnonzero(large):
            (x, n), (y, m) = (np.unique(self.ids[s][start[g]:start[g] + size[g]], return_counts=True) for s, start, size in ((0, before_a, a), (1, before_b, b)))
            docs.append(np.full(len(x) * len(y), self.group_doc[g]))
            pairs.append((x[:, None] * width + y).reshape(-1))
            times.append((n[:, None] * m).reshape(-1))
        doc, pair, n = map(np.concatenate, (docs, pairs, times))
        order = np.lexsort((pair, doc))
        doc, pair, n = doc[order], pair[order], n[order]
        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])]) if len(doc) else np.zeros(0, np.int64)
        return doc[head], pair[head], np.add.reduceat(n, head) if len(head) else n


def decimals(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The decimal numbers below size, each with room for a mark after it."""
    return _flat([b"%d," % i for i in range(size)])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers that are not negative, each in the narrowest of four widths."""
    out = []
    for x in arrays:
        most = int(x.max()) if len(x) else 0
        kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * np.dtype(k).itemsize)
        out.append(b"%c%b" % (np.dtype(kind).itemsize, len(x).to_bytes(8, "little")) + x.astype(kind).tobytes())
    return b"".join(out)


def unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        width, n = raw[at], int.from_bytes(raw[at + 1:at + 9], "little")
        out.append(np.frombuffer(raw, f"<u{width}", n, at + 9).astype(np.int64))
        at += 9 + width * n
    return out


_ENCODED = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " \
    "slot int, part long, n_postings long, postings binary, pair long, n long"


def _slots(pair: np.ndarray, width: int) -> np.ndarray:
    return (pair // width % SLOTS).astype(np.int32)


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    """A batch of _ENCODED; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    named = [x.split(" ") for x in _ENCODED.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kinds[kind])) for name, kind in named], names=[name for name, _ in named])


class _Postings:
    """Postings and pair counts of a task."""

    def __init__(self, width: int, low: int = 0):
        self.width, self.low = width, low
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0
        self.pairs = self.counts = np.zeros(0, np.int64)

    def add(self, uid: np.ndarray, pair: np.ndarray, times: np.ndarray) -> None:
        self.held.append((uid, pair, times))
        self.size += len(uid)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        uid, pair, times = map(np.concatenate, zip(*self.held))
        self.held, self.size = [], 0
        slot = _slots(pair, self.width)
        order = np.lexsort((uid, pair, slot))
        uid, pair, times, slot = uid[order], pair[order], times[order], slot[order]
        head = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        runs = np.diff(np.r_[head, len(pair)])
        merged = np.concatenate([self.pairs, pair[head]])
        self.pairs, back = np.unique(merged, return_inverse=True)
        self.counts = np.bincount(back, np.r_[self.counts, runs], len(self.pairs)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        ends = np.r_[cut[1:], len(slot)]
        first = np.searchsorted(head, np.r_[cut, len(slot)])
        low = self.low
        blobs = [pack(pair[head[i:j]], runs[i:j], uid[a:b] - low, times[a:b]) for a, b, i, j in zip(cut, ends, first[:-1], first[1:])]
        yield _batch(slot=pa.array(slot[cut]), part=pa.array(np.full(len(cut), low)), n_postings=pa.array(ends - cut), postings=pa.array(blobs, pa.binary()))
        if len(self.pairs) >= PAIRS:
            yield from self.totals()

    def totals(self) -> Iterator[pa.RecordBatch]:
        if len(self.pairs):
            yield _batch(pair=pa.array(self.pairs), n=pa.array(self.counts))
        self.pairs = self.counts = np.zeros(0, np.int64)


def _encode(byte_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(byte_path, piece_path)
        numbers = decimals(max(x.size for x in both))
        uid = TaskContext.get().partitionId() << 40
        own = _Postings(both[1].size, uid)
        for batch in batches:
            for part in chunks(batch):
                found = Aligned(part.column(1), both)
                n_a, n_b, n_groups, n_links = found.per_document()
                digests = [hashlib.sha256(x).hexdigest() if x else "" for x in found.written(numbers)]
                yield _batch(uid=pa.array(np.arange(uid, uid + found.docs)), doc_id=part.column(0), n_a=pa.array(n_a), n_b=pa.array(n_b),
                             n_groups=pa.array(n_groups), n_links=pa.array(n_links), groups_sha256=pa.array(digests, pa.string()))
                doc, pair, times = found.links(own.width)
                own.add(doc + uid, pair, times)
                uid += found.docs
                if own.size >= POSTINGS or uid - own.low >= POSTINGS:
                    yield from own.flush()
                    own.low = uid
        yield from own.flush()
        yield from own.totals()

    return run


class _Slot:
    """A slot's counts, and what its postings add to documents."""

    def __init__(self, width: int):
        self.width = width
        self.told: list[tuple[np.ndarray, np.ndarray]] = []
        self.pairs = None

    def learn(self, pair: np.ndarray, n: np.ndarray) -> None:
        self.told.append((pair, n))

    def settle(self) -> None:
        pair, n = map(np.concatenate, zip(*self.told))
        order = np.argsort(pair)
        self.pairs, self.counts = pair[order], n[order]
        a = self.pairs // self.width
        head = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        largest = np.maximum.reduceat(self.counts, head)
        self.best = self.counts == np.repeat(largest, np.diff(np.r_[head, len(a)]))

    def add(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in its part, best links, sum of counts) of packed postings' documents."""
        if self.pairs is None:
            self.settle()
        pair, runs, place, times = unpack(raw)
        at = np.searchsorted(self.pairs, pair)
        return place, times * np.repeat(self.best[at], runs), times * np.repeat(self.counts[at], runs)


def _packed_sums(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """(part, contributions): for each part that documents were encoded in, what is added to each of its documents."""
    part, place, best, total = map(np.concatenate, zip(*held))
    order = np.lexsort((place, part))
    part, place = part[order], place[order]
    head = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (place[1:] != place[:-1])])
    part, place, best, total = part[head], place[head], np.add.reduceat(best[order], head), np.add.reduceat(total[order], head)
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    blobs = [pack(place[a:b], best[a:b], total[a:b]) for a, b in zip(cut, [*cut[1:], len(part)])]
    return pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(blobs, pa.binary())], names=["part", "contributions"])


def _cogroup(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, slot, held, size = None, _Slot(width), [], 0
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            pair, n, raws, parts = batch.column(3), batch.column(4), batch.column(5), batch.column(6)
            at = 0
            while at < len(keys):
                if keys[at] != key:
                    key, slot = keys[at], _Slot(width)
                if raws[at].is_valid:
                    place, best, total = slot.add(raws[at].as_py())
                    held.append((np.full(len(place), parts[at].as_py()), place, best, total))
                    size += len(place)
                    at += 1
                    if size >= POSTINGS:
                        yield _packed_sums(held)
                        held, size = [], 0
                    continue
                to = at + 1
                while to < len(keys) and keys[to] == key and not raws[to].is_valid:
                    to += 1
                slot.learn(pair[at:to].to_numpy(), n[at:to].to_numpy())
                at = to
        if held:
            yield _packed_sums(held)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, n_best, count_sum) of every document of a part, from all contributions to it; parts come one after the other."""
    part, sums = None, np.zeros((2, 0), np.int64)

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(part, part + sums.shape[1])), pa.array(sums[0]), pa.array(sums[1])], names=["uid", "n_best", "count_sum"])

    for batch in batches:
        for own, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            if own != part:
                if part is not None:
                    yield told()
                part, sums = own, np.zeros((2, 0), np.int64)
            place, best, total = unpack(raw.as_py())
            if place[-1] >= sums.shape[1]:
                sums = np.pad(sums, ((0, 0), (0, int(place[-1]) + 1 - sums.shape[1])))
            sums[0, place] += best
            sums[1, place] += total
    if part is not None:
        yield told()


def _width(piece_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(pair, n): in how many documents each pair of ids is linked."""
    return encoded.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))


def contributions(encoded: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """(uid, n_best, count_sum), added up by document; slots with many postings are dealt over several tasks."""
    spark = encoded.sparkSession
    postings = encoded.where("postings is not null").select("slot", "part", "postings")
    sizes = encoded.where("postings is not null").groupBy("slot").agg(F.sum("n_postings").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = min(MOST_PART, max(LEAST_PART, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    shares = F.broadcast(sizes.select("slot", F.ceil(F.col("n") / share).cast("int").alias("shares")))  # SLOTS rows at most
    left = counts.withColumn("slot", F.expr(f"cast((pair div {width}) % {SLOTS} as int)")).join(shares, "slot") \
        .select("slot", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), "pair", "n", F.lit(None).cast("binary").alias("postings"), F.lit(None).cast("long").alias("part"))
    right = postings.join(shares, "slot").select("slot", F.pmod(F.xxhash64("part"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("kind"),
                                                 F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("n"), "postings", "part")
    met = left.unionByName(right).repartition("slot", "share").sortWithinPartitions("slot", "share", "kind")
    added = met.mapInArrow(_cogroup(width), "part long, contributions binary").repartition("part").sortWithinPartitions("part")
    return added.mapInArrow(_add_up, "uid long, n_best long, count_sum long")


def alignments(documents: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = Table(docs.mapInArrow(_encode(byte_path, piece_path), _ENCODED), "alignment").df
    counts = Table(pair_counts(encoded), "pair-counts").df
    sums = contributions(encoded, counts, _width(piece_path))
    zero = F.lit(0).cast("long")
    return encoded.where("uid is not null").join(sums, "uid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def token_pairs(documents: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(a, b, n, best): the corpus' dictionary from one tokenizer's ids to the other's, with the largest count of each A id marked."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = docs.mapInArrow(_encode(byte_path, piece_path), _ENCODED)
    width = _width(piece_path)
    pairs = pair_counts(encoded).select(F.expr(f"pair div {width}").alias("a"), (F.col("pair") % width).alias("b"), "n")
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    return pairs.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def groups(documents: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, groups) of every row, groups as ``a1,a2|b1;a3|b2,b3``."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(byte_path, piece_path)
        numbers = decimals(max(x.size for x in both))
        for batch in batches:
            for part in chunks(batch):
                told = Aligned(part.column(1), both).written(numbers)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.decode() for x in told], pa.string())], names=["doc_id", "groups"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, groups string")
