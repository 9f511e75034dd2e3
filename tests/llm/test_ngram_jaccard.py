import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomspan.llm import ngram_jaccard, queries

from .helpers import documents, empty, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_force(docs):
    sets = {i: shingles(t) for i, t in docs}
    holders, parent = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op1_ngram_jaccard(spark, sf)) == brute_force(docs)


@pytest.mark.parametrize("short, frequent, light", [(6, 48, None), (2, 3, None), (2, 3, 0), (6, 48, 399)])
def test_groups_of_near_copies_of_all_sizes(spark, monkeypatch, short, frequent, light):
    monkeypatch.setattr(ngram_jaccard, "SHORT", short)
    monkeypatch.setattr(ngram_jaccard, "FREQUENT", frequent)
    if light is not None:
        monkeypatch.setattr(ngram_jaccard, "boundary", lambda mean: light)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    common = rng.choices(vocabulary, k=40)
    docs = []
    for n in (1, 3, 5, 6, 7, 8, 9, 12, 20, 60, 200):
        base = rng.choices(vocabulary, k=n)
        for i in range(14):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + n // 12)):
                words[rng.randrange(n)] = rng.choice(vocabulary)
            if i % 3 == 0:
                words += rng.choices(vocabulary, k=rng.randrange(0, 1 + n // 8))
            if i % 7 == 0:
                words += common
            docs.append((len(docs) * 2 - 60, " ".join(words)))
    docs += [(1000 + i, " ".join(common + rng.choices(vocabulary, k=i % 15))) for i in range(60)]
    assert got(ngram_jaccard.ngram_jaccard_groups(documents(spark, docs))) == brute_force(docs)


def test_odd_tables(spark):
    rows = ngram_jaccard.ngram_jaccard_groups(odd_documents(spark)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 5)]
    assert ngram_jaccard.ngram_jaccard_groups(empty(spark)).count() == 0


def test_a_place_allows_for_no_more_than_what_is_left():
    rng = np.random.default_rng(4)
    for _ in range(300):
        universe = rng.permutation(60)
        a, b = (np.sort(rng.choice(universe, rng.integers(3, 30), replace=False)) for _ in "ab")
        shared = np.intersect1d(a, b)
        if len(shared) and 4 * len(shared) >= 3 * len(np.union1d(a, b)):
            ra, rb = np.searchsorted(a, shared[0]), np.searchsorted(b, shared[0])
            assert ngram_jaccard.may_link(ngram_jaccard.packed(np.array([ra]), np.array([len(a)]), 2), ngram_jaccard.packed(np.array([rb]), np.array([len(b)]), 2)).all()


def sets_that_meet_in_both_kinds_of_lists(rng):
    """X of 80 and Y of 100 shingles, 78 shared; eight others share their least three shingles; all but one, which leads every list, have one of their own after the first."""
    def h(words):
        return int(ngram_jaccard.shingle_sets(pa.RecordBatch.from_pydict({"text": [" ".join(words)]}))[0][0])

    def grow(words, n, good):
        words = list(words)
        for _ in range(n):
            words.append(next(w for w in (f"w{rng.getrandbits(60)}" for _ in range(100_000)) if good(h([*words[-4:], w]))))
        return words

    base = [f"w{rng.getrandbits(60)}" for _ in range(82)]
    least = sorted((h(base[i:i + 5]), i) for i in range(78))[:3]
    one, two, three = (x for x, _ in least)
    docs = [grow(grow(base, 1, lambda x: one < x < two), k, lambda x: x > three) for k in (1, 21)]
    for n in (76, 78, 84, 88, 90, 92, 94, 96):
        while True:
            own = n > 76
            words = grow([f"w{rng.getrandbits(60)}" for _ in range(4)], own, lambda x: one < x < two)
            for _, i in least:
                words = grow(words, 3, lambda x: x > three) + base[i:i + 5]
            words = grow(words, n + 4 - len(words), lambda x: x > three)
            if sum(h(words[i:i + 5]) <= three for i in range(n)) == 3 + own:
                break
        docs.append(words)
    return [(i, " ".join(words)) for i, words in enumerate(docs)]


def test_a_subset_list_is_not_overwritten_by_an_inverted_one(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "boundary", lambda mean: 100)
    docs = sets_that_meet_in_both_kinds_of_lists(random.Random(5))
    want = brute_force(docs)
    assert [want[i] for i in (0, 1)] == [(80, 0), (100, 0)]
    assert got(ngram_jaccard.ngram_jaccard_groups(documents(spark, docs))) == want


def test_links_within_a_group_are_all_counted(spark):
    """Thirty near copies, most of which link to one another: as many links as brute force finds between different sets."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(30):
        words = list(base)
        words[i * 2 % 60] = f"own{i}"
        docs.append((i, " ".join(words + [f"end{i}"] * (i % 2))))
    docs.append((99, docs[3][1]))
    docs += [(100 + i, " ".join(rng.choices(base, k=30))) for i in range(20)]
    sets = {i: frozenset(shingles(t)) for i, t in docs}
    different = set(sets.values())
    want = {i: sum(s != o and 100 * len(s & o) >= 75 * len(s | o) for o in different) for i, s in sets.items()}
    found = {r.doc_id: r.n_links for r in ngram_jaccard.ngram_jaccard_groups(documents(spark, docs)).collect()}
    assert found == want and max(want.values()) > 10


def near_copies(rng, n):
    """Texts of one base of 200 words with a word of their own in one or two places: all of them link to one another."""
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(200), 1 + (i % 3 > 0)):
            words[at] = f"own{i}x{at}"
        docs.append((i, " ".join(words)))
    return docs


def test_links_of_a_group_are_counted_without_a_row_for_each(spark, monkeypatch):
    """Blocks of a few sets give the counts of brute force, and the pairs that are verified one by one grow with the sets, not with their square."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SETS", 20)
    verified, linked = [], ngram_jaccard._linked

    def counting(pairs, *rest):
        verified.append(pairs.count())
        return linked(pairs, *rest)

    monkeypatch.setattr(ngram_jaccard, "_linked", counting)
    docs = near_copies(random.Random(3), 90)
    sets = {i: frozenset(shingles(t)) for i, t in docs}
    want = {i: sum(i != j and 100 * len(s & o) >= 75 * len(s | o) for j, o in sets.items()) for i, s in sets.items()}
    assert {r.doc_id: r.n_links for r in ngram_jaccard.ngram_jaccard_groups(documents(spark, docs)).collect()} == want
    assert sum(want.values()) // 2 > 1500 and sum(verified) < 12 * len(docs)


@pytest.mark.parametrize("dense", [1 / 200, 0, 2])
def test_overlaps_of_blocks_equal_set_intersections(monkeypatch, dense):
    monkeypatch.setattr(ngram_jaccard, "_DENSE", dense)
    monkeypatch.setattr(ngram_jaccard, "_LISTED", 50)
    monkeypatch.setattr(ngram_jaccard, "_COLUMNS", 16)
    rng = np.random.default_rng(1)
    sides = [[np.unique(rng.integers(0, 300, rng.integers(0, 60))).astype(np.uint64) for _ in range(n)] for n in (13, 7)]
    x, y = ((np.concatenate(s), np.repeat(np.arange(len(s)), [len(v) for v in s])) for s in sides)
    assert ngram_jaccard.overlaps(*x, *y, (13, 7)).tolist() == [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]
