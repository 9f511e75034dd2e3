"""Collocations: phrases whose words stand together far more often than their parts would.

Every task grows count tries of limited depth, one for each language of a shard of its
words: a path is the next words of a piece of text, and a node's count is how often
its path occurs.  A shard's tries are serialised in sorted order, cut by range of their
two-word prefixes, and sent to the range's task, which merges all shards' tries of the
range.  Only what occurs `least` times in all leaves that task: no phrase of interest has
a rarer part, so the cuts of a phrase need no others.  A cut's left part is the path of a
node above it, its right part the path that the node's suffix link leads to; both are
found by equi-joins on paths.

Words are 64-bit hashes in the tries.  Tries of depth one carry the words themselves, and
a merge that meets two words of one hash in a language fails rather than add them up;
another `seed` then gives other hashes.

Null texts count as empty.  A null language is `und`.  Rows without a doc_id, repeated rows
and rows that share a doc_id count like others; extra columns are ignored.  Empty tables
and languages without a phrase give no rows.  Ties are broken by count, then by phrase.  A
very long text is one shard by itself.  Counts may be as large as 10**15.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import chunks, mix, split_words, text_bytes
from .bpe import gather
from .scratch import Table, small_batches

#: Words that a shard holds (some 100 bytes each while its trie is sorted).
SHARD_WORDS = 1_500_000
#: Ranges of prefixes for each partition of the input, and at least so many in all.
RANGES, LEAST_RANGES = 8, 256
UNKNOWN = "und"
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATORS = _BREAKS.copy()
_SEPARATORS[[0x20, 0x09]] = True


class _Shard:
    """Words of some documents: hashes, pieces, languages and bytes."""

    def __init__(self, seed: int):
        self.seed = np.uint64(seed)
        self.langs: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.data, self.start, self.length, self.hashes, self.piece, self.lang = [], [], [], [], [], []
        self.size = self.bytes = self.pieces = 0

    def add(self, texts: pa.Array, langs: pa.Array) -> None:
        data, offsets = text_bytes(texts)
        words = split_words(data, offsets, fold=True, separators=_SEPARATORS)
        codes = np.array([self.langs.setdefault(x if x is not None else UNKNOWN, len(self.langs)) for x in langs.to_pylist()], np.int64)
        doc = words.doc_of()
        piece = np.cumsum(_BREAKS[data])[words.start] + doc + self.pieces if len(words.start) else np.zeros(0, np.int64)
        self.data.append(words.data)
        self.start.append(words.start + self.bytes)
        self.length.append(words.end - words.start)
        self.hashes.append(np.maximum(mix(words.hashes + self.seed), np.uint64(1)))  # 0 is the end of a piece
        self.piece.append(piece)
        self.lang.append(codes[doc])
        self.size += len(piece)
        self.bytes += len(data)
        self.pieces += int(_BREAKS[data].sum()) + len(codes)

    def tries(self, depth: int, bits: int) -> Iterator[tuple[str, int, bytes | None, bytes | None]]:
        """(language, range, words, paths) of every range that has any."""
        if not self.size:
            return
        data, start, length, hashes, piece, lang = map(np.concatenate, (self.data, self.start, self.length, self.hashes, self.piece, self.lang))
        for name, code in self.langs.items():
            at = np.flatnonzero(lang == code)
            if not len(at):
                continue
            own = hashes[at]
            found, one, count = np.unique(own, return_index=True, return_counts=True)
            where = at[one]
            words = dict(_word_blobs(found, count, data, start[where], length[where], bits))
            paths = dict(_path_blobs(own, piece[at], depth, bits))
            for r in sorted(words.keys() | paths.keys()):
                yield name, r, words.get(r), paths.get(r)


def _cuts(ranges: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted ranges."""
    head = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(ranges) else np.zeros(0, np.int64)
    yield from zip(ranges[head].tolist(), head.tolist(), [*head[1:].tolist(), len(ranges)])


def _word_blobs(hashes, count, data, start, length, bits) -> Iterator[tuple[int, bytes]]:
    """Sorted words of a shard by range of their hash: how many, hashes, counts, lengths, bytes."""
    flat, ends = gather(data, start, length), np.r_[0, np.cumsum(length)]
    count, length = count.astype(np.uint32), length.astype(np.uint32)
    for r, a, b in _cuts((hashes >> np.uint64(64 - bits)).astype(np.int64)):
        yield r, b"".join((struct.pack("<I", b - a), hashes[a:b].tobytes(), count[a:b].tobytes(), length[a:b].tobytes(), flat[ends[a]:ends[b]].tobytes()))


def _prefix_range(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second) >> np.uint64(64 - bits)


def _path_blobs(hashes: np.ndarray, piece: np.ndarray, depth: int, bits: int) -> Iterator[tuple[int, bytes]]:
    """A shard's trie by range of prefixes: nodes of every depth in sorted order, each with the number of its children (the deepest: of its occurrences)."""
    n = len(hashes)
    at = np.flatnonzero(piece[1:] == piece[:-1]) if n > 1 else np.zeros(0, np.int64)
    path = [hashes[at], hashes[at + 1]]
    for d in range(2, depth):
        inside = at + d < n
        inside[inside] = piece[at[inside] + d] == piece[at[inside]]
        path.append(np.where(inside, hashes[np.minimum(at + d, n - 1)], np.uint64(0)))
    ranges = _prefix_range(path[0], path[1], bits)
    # one key of the range and of parts of the first two words sorts like all three, but for rare nodes that are then told twice
    lead = ranges << np.uint64(64 - bits) | path[0] >> np.uint64(40) << np.uint64(40 - bits) | path[1] >> np.uint64(24 + bits)
    order = np.lexsort((*path[:1:-1], lead))
    ranges, path = ranges[order].astype(np.int64), [p[order] for p in path]
    new = np.r_[True, ranges[1:] != ranges[:-1]] if len(at) else np.zeros(0, bool)
    heads = []
    for p in path:
        new = new | np.r_[True, p[1:] != p[:-1]] if len(at) else new
        heads.append(np.flatnonzero(new))
    below = [np.diff(np.r_[np.searchsorted(deeper, head), len(deeper)]) for head, deeper in zip(heads, heads[1:])]
    below.append(np.diff(np.r_[heads[-1], len(at)]))
    below = [x.astype(np.uint32) for x in below]
    nodes = [p[h] for p, h in zip(path, heads)]
    bounds = list(_cuts(ranges))
    edges = [np.searchsorted(h, [a for _, a, _ in bounds] + [len(at)]).tolist() for h in heads]
    for i, (r, _, _) in enumerate(bounds):
        spans = [(e[i], e[i + 1]) for e in edges]
        yield r, b"".join([struct.pack(f"<{depth}I", *(b - a for a, b in spans)),
                           *(x for d, (a, b) in enumerate(spans) for x in (nodes[d][a:b].tobytes(), below[d][a:b].tobytes()))])


def _grow(depth: int, bits: int, seed: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(seed)

        def flush() -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for row in shard.tries(depth, bits):
                held.append(row)
                if len(held) == 512:
                    yield _rows(held)
                    held = []
            if held:
                yield _rows(held)
            shard.clear()

        for batch in batches:
            for part in chunks(batch):
                shard.add(part.column(0), part.column(1))
                if shard.size >= size:
                    yield from flush()
        yield from flush()

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    lang, r, words, paths = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(r, pa.int32()), pa.array(words, pa.binary()), pa.array(paths, pa.binary())],
                                      names=["lang", "range", "words", "paths"])


def _frequent_words(blobs: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, pa.Array, int]:
    """(hashes, counts, words) that occur `least` times in all shards of a range, and the words of the range."""
    hashes, counts, lengths, flat = [], [], [], []
    for raw in blobs:
        n, = struct.unpack_from("<I", raw)
        hashes.append(np.frombuffer(raw, np.uint64, n, 4))
        counts.append(np.frombuffer(raw, np.uint32, n, 4 + 8 * n))
        lengths.append(np.frombuffer(raw, np.uint32, n, 4 + 12 * n))
        flat.append(raw[4 + 16 * n:])
    if not blobs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([], pa.large_string()), 0
    h, n = np.concatenate(hashes), np.concatenate(counts).astype(np.int64)
    ends = np.r_[0, np.cumsum(np.concatenate(lengths).astype(np.int64))]
    words = pa.Array.from_buffers(pa.large_binary(), len(h), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(flat))])
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    sorted_words = words.take(pa.array(order))
    same = pc.equal(sorted_words[1:], sorted_words[:-1]).to_numpy(zero_copy_only=False)
    if len(same) and not same[h[1:] == h[:-1]].all():
        raise ValueError("two words have one hash; choose another seed")
    total = np.add.reduceat(n, head)
    keep = total >= least
    return h[head[keep]], total[keep], sorted_words.take(pa.array(head[keep])).cast(pa.large_string()), int(n.sum())


def _frequent_paths(blobs: list[bytes], depth: int, least: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(path, its depth, count) of the nodes that occur `least` times in all shards' tries of a range."""
    parts: list[list[np.ndarray]] = [[] for _ in range(depth + 1)]
    for raw in blobs:
        sizes, at = struct.unpack_from(f"<{depth}I", raw), 4 * depth
        nodes, below = [], []
        for n in sizes:
            nodes.append(np.frombuffer(raw, np.uint64, n, at))
            below.append(np.frombuffer(raw, np.uint32, n, at + 8 * n))
            at += 12 * n
        for d in range(depth):
            whole = nodes[d]
            for fan in below[d:-1]:
                whole = np.repeat(whole, fan)
            parts[d].append(whole)
        parts[depth].append(below[-1])
    none = [np.zeros(0, np.uint64)] * depth, np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not blobs:
        return none
    *path, count = map(np.concatenate, parts)
    count = count.astype(np.int64)
    # a bound from above by a hash of the first two words leaves few to sort in full
    lead = mix(path[0] * np.uint64(0x9E3779B97F4A7C15) + path[1])
    order = np.argsort(lead)
    head = np.flatnonzero(np.r_[True, lead[order][1:] != lead[order][:-1]])
    bound = np.add.reduceat(count[order], head)
    some = order[np.repeat(bound >= least, np.diff(np.r_[head, len(order)]))]
    if not len(some):
        return none
    path, count = [p[some] for p in path], count[some]
    order = np.lexsort(path[::-1])
    path, count = [p[order] for p in path], count[order]
    new = np.zeros(len(order), bool)
    new[0] = True
    paths, depths, counts = [], [], []
    for d, p in enumerate(path):
        new[1:] |= p[1:] != p[:-1]
        if d == 0:
            continue
        head = np.flatnonzero(new)
        total = np.add.reduceat(count, head)
        keep = head[(total >= least) & (p[head] != 0)]
        paths.append([q[keep] if i <= d else np.zeros(len(keep), np.uint64) for i, q in enumerate(path)])
        depths.append(np.full(len(keep), d + 1))
        counts.append(total[(total >= least) & (p[head] != 0)])
    return [np.concatenate(x) for x in zip(*paths)], np.concatenate(depths), np.concatenate(counts)


def _merge(depth: int, least: int):
    def told(key: tuple[str, int], words: list[bytes], paths: list[bytes]) -> pa.RecordBatch:
        lang = key[0]
        h, n, text, total = _frequent_words(words, least)
        path, size, count = _frequent_paths(paths, depth, least)
        first = np.r_[h, path[0]]
        flat = np.stack([first, *(np.r_[np.zeros(len(h), np.uint64), p] for p in path[1:])], 1).reshape(-1)
        sizes = np.r_[np.ones(len(h), np.int64), size]
        inside = (np.arange(depth)[None, :] < sizes[:, None]).reshape(-1)
        ends = np.r_[0, np.cumsum(sizes)]
        made = pa.ListArray.from_arrays(pa.array(np.r_[ends, ends[-1]].astype(np.int32)), pa.array(flat[inside].view(np.int64)))
        rows = len(sizes) + 1  # the last one, an empty path, has all words of the range
        return pa.RecordBatch.from_arrays([pa.array([lang] * rows, pa.string()), made, pa.array(np.r_[n, count, total].astype(np.int64)),
                                           pa.concat_arrays([text, pa.nulls(rows - len(h), pa.large_string())]).cast(pa.string())],
                                          names=["lang", "path", "f", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, paths = None, [], []
        for batch in batches:
            for lang, r, w, p in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (lang, r):
                    if key is not None:
                        yield told(key, words, paths)
                    key, words, paths = (lang, r), [], []
                if w is not None:
                    words.append(w)
                if p is not None:
                    paths.append(p)
        if key is not None:
            yield told(key, words, paths)

    return run


def phrase_counts(documents: DataFrame, longest: int = 3, least: int = 10, seed: int = 0) -> DataFrame:
    """(lang, path, f, word): word paths of up to `longest` words that occur `least` times; paths of one word have the word, empty ones count all words."""
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    bits = max(LEAST_RANGES, RANGES * docs.rdd.getNumPartitions() - 1).bit_length()
    shards = docs.mapInArrow(_grow(longest, min(bits, 24), seed, SHARD_WORDS), "lang string, range int, words binary, paths binary")
    merged = shards.repartition("lang", "range").sortWithinPartitions("lang", "range")
    return merged.mapInArrow(_merge(longest, least), "lang string, path array<long>, f long, word string")


def association(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in exact decimals."""
    a, left, right = (x.cast("decimal(38,0)") for x in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * a * a, left * right)


def weakest_cuts(phrases: DataFrame, candidates: DataFrame) -> DataFrame:
    """(lang, path, a, score, l, r) of every candidate, by the cut that scores lowest, of equal ones the first."""
    cuts = candidates.select("lang", "path", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("path", F.lit(1), F.col("k")).alias("left"), F.slice("path", F.col("k") + 1, F.size("path") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("path").alias(side), F.col("f").alias(name)), ["lang", side])
    told = F.min(F.struct(association(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "path", "a").agg(told).select("lang", "path", "a", "cut.score", "cut.l", "cut.r")


def not_inside(scored: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Without phrases that stand inside a longer candidate which has `percent` of their count."""
    longer = candidates.where(F.size("path") > 2)
    parts = longer.select("lang", "path", "f", F.explode(F.sequence(F.lit(2), F.size("path") - 1)).alias("n")) \
        .select("lang", "path", "f", "n", F.explode(F.sequence(F.lit(1), F.size("path") - F.col("n") + 1)).alias("i")) \
        .groupBy("lang", F.slice("path", F.col("i"), F.col("n")).alias("path")).agg(F.max("f").alias("around"))
    return scored.join(parts, ["lang", "path"], "left").where(F.coalesce(100 * F.col("around") < percent * F.col("a"), F.lit(True))).drop("around")


def collocations(documents: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000, seed: int = 0) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases by score, then count, then phrase."""
    counted = Table(phrase_counts(documents, longest, least, seed), "phrases").df
    totals = counted.where(F.size("path") == 0).groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = counted.where(F.size("path") > 0)
    candidates = phrases.where(F.size("path") > 1)
    kept = not_inside(weakest_cuts(phrases, candidates), candidates, percent)
    near = kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top).drop("place")
    words = phrases.where("word is not null").select("lang", F.col("path")[0].alias("hash"), "word")
    spelt = near.select("*", F.posexplode("path").alias("i", "hash")).join(words, ["lang", "hash"]) \
        .groupBy("lang", "path", "a", "score", "l", "r") \
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return spelt.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).join(F.broadcast(totals), "lang") \
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows by DuckDB.
ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
spans as (select lang, w, unnest(range(1, len(w) + 1)) as i from words),
grams as (select lang, w[i:i + k - 1] as p, count(*) as f from spans, (values (1), (2), (3)) as sizes(k) where i + k - 1 <= len(w) group by all),
totals as (select lang, sum(f)::bigint as n from grams where len(p) = 1 group by lang),
candidates as (select lang, p, f as a from grams where len(p) > 1 and f >= 10),
cuts as (
  select c.lang, c.p, c.a, k, x.f as l, y.f as r, ((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f))::bigint as score
  from (select *, unnest(range(1, len(p))) as k from candidates) c join grams x on x.lang = c.lang and x.p = c.p[1:k] join grams y on y.lang = c.lang and y.p = c.p[k + 1:len(c.p)]),
scored as (select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1),
inner_parts as (select lang, part, max(a) as around from (select lang, a, unnest([p[1:2], p[2:3]]) as part from candidates where len(p) = 3) group by all),
kept as (select s.* from scored s left join inner_parts i on i.lang = s.lang and i.part = s.p where i.around is null or 100 * i.around < 50 * s.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) as rank from kept)
select k.lang, rank::bigint as rank, array_to_string(p, ' ') as phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score
from ranked k join totals t on t.lang = k.lang where rank <= 2000
"""
