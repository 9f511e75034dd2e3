"""N-gram Jaccard join: documents whose 5-word shingle sets are similar, and their groups.

Heavy-light by set size.  Every set is read in one global order of shingles
(frequent ones last).  A pair of similarity t shares at least ceil(t*n) of n
shingles, so it shares k of the first n - ceil(t*n) + k of each:

* light sets (up to a boundary) enumerate all 2-subsets of that prefix, and
  meet where they have a whole subset in common;
* heavy sets post each shingle of their 1-prefix in an inverted list; light sets
  large enough to match a heavy one are posted there too, and a list is scanned
  for pairs with a heavy member only.

Two sets that first meet at some place share no more than what both have left
from there on; a list gives only pairs for which that is enough.

The boundary is where enumerating subsets starts to cost more than scanning
lists of the mean length that the shingle counts foretell.  Equal sets are one
node throughout.  A list longer than `SHORT` first links its members to their
neighbours and to the list's first; lists of one kind with the same first are then one, and
only members that are still in different groups are compared pair by pair.  Every candidate is verified on whole sets.

All links of a set lie in its group.  They are counted there without a row for each: a group is dealt into
blocks of bounded size, every two blocks meet in a task, and what all their sets share is counted at once in
a matrix, frequent shingles by a product and the others list by list.

Empty and null texts have no shingles and link with nothing.  Rows without a
doc_id cannot be named by a link and are left out.  Rows that repeat a doc_id
each give a row.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .arrowtext import batch_words, chunks, mix, signed
from .components import components, joined
from .scratch import Table, small_batches

WORDS = 5
#: Similarity as a fraction of integers: NUM * union <= DEN * intersection.
NUM, DEN = 3, 4
#: Lists up to this length give all their pairs at once.
SHORT = 6
#: Sets and shingles of a block (on average) within which links are counted.
BLOCK_SETS, BLOCK_SHINGLES = 4096, 1_000_000
#: A shingle that this share of all pairs of two blocks hold is counted by a matrix product; columns of one product; pairs listed at once.
_DENSE, _COLUMNS, _LISTED = 1 / 200, 2048, 4_000_000
#: Shingles counted together, and the count there from which one is told to the others.
COUNT_BLOCK, COUNT_TOLD = 4_000_000, 3
#: Total told count from which a shingle is frequent; bits of the bitmap of frequent shingles.
FREQUENT, FREQUENT_BITS = 48, 24
CANDIDATE_BITS = 27
#: Shingles of a sketch, and the share of equal ones that it takes.  A linked pair (0.75 or more) shows under
#: 0.4 of 96 with a chance below 1e-11.
SKETCH, SKETCH_NUM, SKETCH_DEN = 96, 2, 5
_SKETCH_SALT = np.uint64(0x5851F42D4C957F2D)
_SUBSET_SALT = np.uint64(0xA0761D6478BD642F)


def shingle_sets(batch: pa.RecordBatch, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 63-bit shingle hashes of each row, flat, and where each row's begin."""
    words = batch_words(batch, fold=True)
    doc, _, hashes = words.windows(k)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        doc = np.concatenate([doc, short])
        hashes = np.concatenate([hashes, words.whole()[short]])
        order = np.argsort(doc, kind="stable")
        doc, hashes = doc[order], hashes[order]
    hashes = hashes >> np.uint64(1)
    return _distinct(hashes, np.searchsorted(doc, np.arange(words.docs + 1)))


def _sort_rows(flat: np.ndarray, ptr: np.ndarray) -> None:
    for a, b in zip(ptr[:-1], ptr[1:]):
        flat[a:b].sort()


def _distinct(flat: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _sort_rows(flat, ptr)
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[ptr[:-1][np.diff(ptr) > 0]] = True
    return flat[new], np.concatenate([[0], np.cumsum(new)])[ptr]


def fingerprints(flat: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set; the empty set's is 0."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat + np.uint64(11)))])
    n = np.diff(ptr).astype(np.uint64)
    return np.where(n > 0, mix(total[ptr[1:]] - total[ptr[:-1]] + n), np.uint64(0))


def _docs(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (kind 0: doc_id, fingerprint, size) and told shingle counts (kind 1); kind 2 has sums for the mean list."""
    kept, size = [], 0

    def told():
        tokens, counts = np.unique(np.concatenate(kept), return_counts=True)
        many = counts >= COUNT_TOLD
        kind = np.r_[np.full(many.sum(), 1), 2].astype(np.int32)
        sums = np.array([(counts.astype(np.int64) ** 2).sum()], np.uint64)
        return _batch(kind=kind, a=signed(np.r_[tokens[many], sums]), b=signed(np.zeros(len(kind), np.uint64)),
                      n=np.r_[counts[many], counts.sum()].astype(np.int64))

    for batch in batches:
        for part in chunks(batch):
            flat, ptr = shingle_sets(part)
            n = np.diff(ptr)
            yield _batch(kind=np.zeros(len(n), np.int32), a=_docs(part), b=signed(fingerprints(flat, ptr)), n=n.astype(np.int64))
            kept.append(flat)
            size += len(flat)
            if size >= COUNT_BLOCK:
                yield told()
                kept, size = [], 0
    if size:
        yield told()


def need(n: np.ndarray) -> np.ndarray:
    """The least overlap that a set of n shingles has with any set that it links to."""
    return (NUM * n + DEN - 1) // DEN


def boundary(mean_list: float) -> int:
    """The largest set for which enumerating 2-subsets is no dearer than scanning lists of this mean length."""
    n = np.arange(3, 400)
    prefix = n - need(n) + 2
    cheaper = prefix * (prefix - 1) / 2 <= (prefix - 1) * (1 + mean_list)
    return int(n[cheaper].max(initial=3))


#: Bits of role and size in a packed place; the rank is above them, so that places sort by rank.
_ROLE_BITS, _SIZE_BITS = 2, 32


def packed(rank: np.ndarray, n: np.ndarray, role) -> np.ndarray:
    """How many shingles of the set come before a posting's (all but one, of a subset's two), its size and its role."""
    return (rank.astype(np.int64) << (_ROLE_BITS + _SIZE_BITS)) | (n.astype(np.int64) << _ROLE_BITS) | role


def may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets may link if what they share begins at these places: their sizes and what is left of both allow for it."""
    (ra, na, ka), (rb, nb, kb) = ((x >> (_ROLE_BITS + _SIZE_BITS), (x >> _ROLE_BITS) & ((1 << _SIZE_BITS) - 1), x & 3) for x in (a, b))
    return (np.minimum(na - ra, nb - rb) * (NUM + DEN) >= NUM * (na + nb)) & ((ka != 1) | (kb != 1))


def _post(light: int, frequent) -> callable:
    """Postings (key, fp, place) of subsets of light sets (role 0) and of shingles of light (1) and heavy (2) sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = frequent.value, set()
        for batch in batches:
            for part in chunks(batch):
                flat, ptr = shingle_sets(part)
                n, fp = np.diff(ptr), fingerprints(flat, ptr)
                fresh = np.fromiter((len(seen) != (seen.add(x) or len(seen)) for x in fp.tolist()), bool, len(fp))
                place = flat & np.uint64((1 << FREQUENT_BITS) - 1)
                often = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
                flat = flat | (often.astype(np.uint64) << np.uint64(63))
                _sort_rows(flat, ptr)
                keys, nodes, places = [], [], []
                row = np.repeat(np.arange(len(n)), n)
                rank = np.arange(len(flat)) - ptr[row]
                listed = fresh & (n >= 3) & ((n > light) | (n >= need(np.array(light + 1))))
                at = np.flatnonzero(listed[row] & (rank < (n - need(n) + 1)[row]))
                keys.append(flat[at])
                nodes.append(row[at])
                places.append(packed(rank[at], n[row[at]], np.where(n[row[at]] > light, 2, 1)))
                for size in np.unique(n[fresh & (n >= 3) & (n <= light)]):
                    these = np.flatnonzero(fresh & (n == size))
                    i, j = np.triu_indices(int(size - need(size) + 2), 1)
                    sets = flat[ptr[these][:, None] + np.arange(size)]
                    keys.append(mix(sets[:, i] * _SUBSET_SALT + sets[:, j]).ravel())
                    nodes.append(np.repeat(these, len(i)))
                    places.append(packed(np.tile(j - 1, len(these)), np.full(len(these) * len(i), size), 0))
                node = np.concatenate(nodes)
                yield _batch(key=signed(np.concatenate(keys)), fp=signed(fp[node]), place=np.concatenate(places))

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan postings sorted by (key, place, fp): candidate pairs (kind 0: a, b), and long lists' rows again (kind 1: fp, the list's first fp, place)."""
    forced = None

    def close(key, fp, place):
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        pairs = []
        long = size > SHORT
        if forced is not None:
            long |= key[first] == forced
        group = np.repeat(np.arange(len(first)), size)
        for step in range(1, SHORT):
            i = np.arange(len(key) - step)
            i = i[(group[i] == group[i + step]) & (~long[group[i]] | (step == 1))]
            pairs.append((i, i + step))
        led = np.flatnonzero(long[group] & (np.arange(len(key)) - first[group] >= 2))
        pairs.append((first[group[led]], led))
        a, b = (np.concatenate(x) for x in zip(*pairs))
        good = (fp[a] != fp[b]) & may_link(place[a], place[b])
        ends = np.sort(np.stack([fp[a[good]], fp[b[good]]], 1), axis=1)
        ends = np.unique(ends, axis=0) if len(ends) else ends
        # a member of a whole list that may not even link to the list's smallest set is done with this list
        n = (place >> _ROLE_BITS) & ((1 << _SIZE_BITS) - 1)
        smallest = np.minimum.reduceat(n, first)[group]
        useful = (n - (place >> (_ROLE_BITS + _SIZE_BITS))) * (NUM + DEN) >= NUM * (n + smallest)
        if forced is not None:
            useful |= key == forced
        again = np.flatnonzero(long[group] & useful)
        return pa.RecordBatch.from_pydict({
            "kind": np.r_[np.zeros(len(ends), np.int8), np.ones(len(again), np.int8)],
            "a": np.r_[ends[:, 0], fp[again]], "b": np.r_[ends[:, 1], fp[first[group[again]]]], "place": np.r_[np.zeros(len(ends), np.int64), place[again]]})

    held: list = []
    held_rows = 0

    def flush(final: bool):
        """Close all whole groups of the held rows; the last group stays open unless final."""
        nonlocal held, held_rows, forced
        rows = [np.concatenate(x) for x in zip(*held)]
        key = rows[0]
        cut = len(key) if final else int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield close(*(x[:cut] for x in rows))
        rest = [x[cut:] for x in rows]
        if len(rest[0]) > 4096:  # a list too long to hold: close what there is, keep its ends
            forced = rest[0][0]
            yield close(*rest)
            rest = [x[[0, -1]] for x in rest]
        held, held_rows = ([rest] if len(rest[0]) else []), len(rest[0])

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            held_rows += batch.num_rows
            if held_rows > 60_000:
                yield from flush(False)
    if held_rows:
        yield from flush(True)


def _across(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of long lists that lie in different groups and may link there: a join, which Spark splits where a list is very long."""
    parts = lists.select("key", "fp", "g", F.shiftright("place", _ROLE_BITS + _SIZE_BITS).alias("r"),
                         F.shiftright("place", _ROLE_BITS).bitwiseAND((1 << _SIZE_BITS) - 1).alias("n"), F.col("place").bitwiseAND(3).alias("role"))
    one, two = (parts.select(*[F.col(c).alias(c + end) for c in parts.columns]) for end in "12")
    may = (F.col("g1") < F.col("g2")) & ((F.col("role1") != 1) | (F.col("role2") != 1)) & \
        (F.least(F.col("n1") - F.col("r1"), F.col("n2") - F.col("r2")) * (NUM + DEN) >= NUM * (F.col("n1") + F.col("n2")))
    return one.join(two, (F.col("key1") == F.col("key2")) & may).select(F.least("fp1", "fp2").alias("a"), F.greatest("fp1", "fp2").alias("b")).distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            flat, ptr = shingle_sets(part)
            raw = [flat[i:j].tobytes() for i, j in zip(ptr[:-1], ptr[1:])]
            yield pa.RecordBatch.from_pydict({"fp": signed(fingerprints(flat, ptr)), "s": pa.array(raw, pa.binary())})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (batch.column(i) for i in range(4))
        same = np.empty(batch.num_rows, np.int64)
        union = np.empty(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            p, q = (np.frombuffer(v[i].as_buffer(), np.uint64) for v in (x, y))
            same[i] = len(np.intersect1d(p, q, assume_unique=True))
            union[i] = len(p) + len(q) - same[i]
        good = DEN * same >= NUM * union
        yield pa.RecordBatch.from_pydict({"a": a.filter(pa.array(good)), "b": b.filter(pa.array(good))})


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SKETCH least shingles of each set in a random order; of a smaller set, all."""
    for batch in batches:
        for part in chunks(batch):
            flat, ptr = shingle_sets(part)
            fp = fingerprints(flat, ptr)
            order = mix(flat ^ _SKETCH_SALT)
            _sort_rows(order, ptr)
            raw = [order[i:min(j, i + SKETCH)].tobytes() for i, j in zip(ptr[:-1], ptr[1:])]
            yield pa.RecordBatch.from_pydict({"fp": signed(fp), "s": pa.array(raw, pa.binary())})


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow for a link."""
    for batch in batches:
        a, b, x, y = (batch.column(i) for i in range(4))
        good = np.empty(batch.num_rows, bool)
        for i in range(batch.num_rows):
            p, q = (np.frombuffer(v[i].as_buffer(), np.uint64) for v in (x, y))
            least = np.union1d(p, q)[:SKETCH]
            same = len(np.intersect1d(np.intersect1d(p, q, assume_unique=True), least, assume_unique=True))
            good[i] = SKETCH_DEN * same >= SKETCH_NUM * len(least)
        yield pa.RecordBatch.from_pydict({"a": a.filter(pa.array(good)), "b": b.filter(pa.array(good))})


def _made(pairs: DataFrame, documents: DataFrame, nodes: DataFrame, make, name: str) -> Table:
    """(fp, s) of the pairs' ends, made again from the texts of those alone."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = ends.join(nodes, "fp").select("doc_id")
    texts = bitmap.keep(documents, "doc_id", bitmap.build(wanted, "doc_id", CANDIDATE_BITS), CANDIDATE_BITS)
    return Table(texts.mapInArrow(make, "fp long, s binary").join(ends, "fp", "left_semi").dropDuplicates(["fp"]), name)


def _tested(pairs: DataFrame, made: Table, test) -> DataFrame:
    one, two = (made.df.select(F.col("fp").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long")


def _linked(pairs: DataFrame, documents: DataFrame, nodes: DataFrame, name: str) -> Table:
    """The candidate pairs that link: those that their sketches allow for, verified on whole sets."""
    sketches = _made(pairs, documents, nodes, _sketches, "sketches")
    some = Table(_tested(pairs, sketches, _plausible), "plausible")
    sketches.drop()
    sets = _made(some.df, documents, nodes, _sets, "sets")
    links = Table(_tested(some.df, sets, _verify), name)
    sets.drop()
    some.drop()
    return links


def overlaps(x: np.ndarray, rows_x: np.ndarray, y: np.ndarray, rows_y: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """How many shingles each set of one block (shingles x of sets rows_x) shares with each of another, as a matrix of this shape."""
    tokens, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    at_x, at_y = at[:len(x)], at[len(x):]
    in_x, in_y = (np.bincount(a, minlength=len(tokens)) for a in (at_x, at_y))
    held = in_x * in_y
    often = held > max(shape[0] * shape[1] * _DENSE, 1)
    out = np.zeros(shape, np.float32)  # exact up to 2**24 shingles
    place = np.cumsum(often) - 1
    dense = [(place[a[often[a]]], rows[often[a]]) for a, rows in ((at_x, rows_x), (at_y, rows_y))]
    for low in range(0, int(often.sum()), _COLUMNS):
        two = []
        for (columns, rows), n in zip(dense, shape):
            here = (columns >= low) & (columns < low + _COLUMNS)
            m = np.zeros((n, _COLUMNS), np.float32)
            m[rows[here], columns[here] - low] = 1
            two.append(m)
        out += two[0] @ two[1].T
    few = (held > 0) & ~often
    order_x, order_y = (np.argsort(a, kind="stable") for a in (at_x, at_y))
    first_x, first_y = (np.concatenate([[0], np.cumsum(n)]) for n in (in_x, in_y))
    # each posting of x in a list meets the whole list of y
    posts = order_x[few[at_x[order_x]]]
    met = in_y[at_x[posts]]
    part = np.cumsum(met) // _LISTED
    flat = out.reshape(-1)
    for k in np.unique(part):
        those = posts[part == k]
        n = in_y[at_x[those]]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = rows_y[order_y[np.repeat(first_y[at_x[those]], n) + inside]]
        np.add.at(flat, np.repeat(rows_x[those], n) * shape[1] + other, np.float32(1))
    return out


def _block_links(rows: pa.Table) -> pa.RecordBatch:
    """(fp, n_links) of the sets of two blocks, or of one that meets itself: links between them."""
    low, own = rows["low"][0].as_py(), rows["own"].to_numpy()
    alone = rows["high"][0].as_py() == low
    raw = rows["s"].to_pylist()
    sides = [np.flatnonzero(own == low)] if alone else [np.flatnonzero(own == low), np.flatnonzero(own != low)]
    sets = []
    for side in sides:
        n = np.array([len(raw[i]) // 8 for i in side], np.int64)
        sets.append((np.frombuffer(b"".join(raw[i] for i in side), np.uint64), np.repeat(np.arange(len(side)), n), n))
    (x, rows_x, nx), (y, rows_y, ny) = sets[0], sets[-1]
    shared = overlaps(x, rows_x, y, rows_y, (len(nx), len(ny)))
    links = [np.zeros(len(n), np.int64) for n in (nx, ny)]
    for at in range(0, len(nx), 256):
        linked = shared[at:at + 256].astype(np.int64) * (NUM + DEN) >= NUM * (nx[at:at + 256, None] + ny[None, :])
        links[0][at:at + 256] = linked.sum(1) - alone  # a set is no link of its own
        links[1] += linked.sum(0)
    fp = rows["fp"].to_numpy()
    return _batch(fp=np.concatenate([fp[side] for side in sides]), n_links=np.concatenate(links[:len(sides)]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every (component, low, high) of rows sorted by them; one of them is held at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
        ends = np.r_[np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)] if len(keys) else []
        at = 0
        for end in ends:
            key = tuple(keys[at])
            if key != now and held:
                yield _block_links(pa.Table.from_batches(held))
                held = []
            now = key
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield _block_links(pa.Table.from_batches(held))


def _degrees(group: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, n_links) of every set in a group (node, component); a link is never a row."""
    members = nodes.join(group.withColumnRenamed("node", "fp"), "fp")
    of = members.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = Table(members.join(of, "component").select("fp", "doc_id", "component", "sets", blocks.alias("blocks")), "members")
    large = dealt.df.where("sets > 2")
    texts = bitmap.keep(documents, "doc_id", bitmap.build(large, "doc_id", CANDIDATE_BITS), CANDIDATE_BITS)
    made = texts.mapInArrow(_sets, "fp long, s binary").join(large.select("fp", "component", "blocks"), "fp").dropDuplicates(["fp"])
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = made.select("component", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "fp", "s")
    met = met.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "fp", "s")
    key = ("component", "low", "high")
    counted = met.repartition(*key).sortWithinPartitions(*key).mapInArrow(_blocks, "fp long, n_links long")
    return counted.groupBy("fp").agg(F.sum("n_links").alias("n_links")).unionByName(dealt.df.where("sets = 2").select("fp", F.lit(1).cast("long").alias("n_links")))


def ngram_jaccard_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row with a doc_id.

    component_id is the smallest doc_id reachable by links.  n_links counts the
    distinct other shingle sets that link to this one; equal sets are one.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    counted = Table(docs.mapInArrow(_count, "kind int, a long, b long, n long"), "counted")
    found = counted.df.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("fp"), "n")
    nodes = found.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))

    sums = counted.df.where("kind = 2").agg(F.sum("a").alias("squares"), F.sum("n").alias("total")).first()
    light = boundary((sums["squares"] or 0) / (sums["total"] or 1))
    often = counted.df.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    place = F.col("a").bitwiseAND((1 << FREQUENT_BITS) - 1)
    rows = often.groupBy(F.shiftright(place, 15).alias("_bucket")).agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("_bitmap"))
    frequent = spark.sparkContext.broadcast(bitmap.to_numpy(rows, FREQUENT_BITS))

    postings = docs.select("text", "doc_id").mapInArrow(_post(light, frequent), "key long, fp long, place long")
    scanned = Table(postings.repartition("key").sortWithinPartitions("key", "place", "fp")
                    .mapInArrow(_scan, "kind byte, a long, b long, place long"), "scanned")
    pairs = Table(scanned.df.where("kind = 0").select("a", "b").distinct(), "pairs")
    links = _linked(pairs.df, docs, nodes, "links")
    first = components(links.df)

    groups = F.coalesce("component", "fp").alias("g")
    # lists of one kind (subsets or inverted) with the same first set are one from here on, as near copies share many lists;
    # each member keeps its least place, which within one kind has one role
    kind = F.struct(F.col("b").alias("first"), (F.col("place").bitwiseAND(3) == 0).alias("subset"))
    open_lists = scanned.df.where("kind = 1").groupBy(kind.alias("key"), F.col("a").alias("fp")).agg(F.min("place").alias("place")) \
        .join(first.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "place", groups)
    mixed = open_lists.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("key")
    lists = Table(open_lists.join(mixed, "key", "left_semi"), "lists")
    cross = _across(lists.df).join(pairs.df, ["a", "b"], "left_anti")
    cross = Table(cross, "cross")
    further = _linked(cross.df, docs, nodes, "links").df

    group = Table(components(joined(first, further)), "groups").df
    degree = _degrees(group, docs, nodes)
    of_set = nodes.join(group.withColumnRenamed("node", "fp"), "fp", "left").join(degree, "fp", "left")
    of_set = of_set.withColumn("c", F.coalesce("component", "fp"))
    least = of_set.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    of_set = of_set.join(least, "c").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    empty = found.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return found.where("n > 0").join(of_set, "fp").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").unionByName(empty)
