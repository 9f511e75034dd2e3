import hashlib
import random
import re

import pytest

from loomspan.llm import arrowtext, queries, substring_dedup

from .helpers import documents, empty, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(docs):
    """Every window of every document in a dict; docs are (doc_id, text) with distinct ids."""
    words = {i: WORD.findall(t or "") for i, t in docs}
    least = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            key = tuple(w[k:k + 50])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if least[tuple(w[k:k + 50])] < i:
                gone[k:k + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_cover_gives_every_difference():
    cover, period = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op5_substring_dedup(spark, sf)) == brute_force(docs)


@pytest.mark.parametrize("chunk", [1 << 20, 2000])
def test_planted_passages_at_all_offsets(spark, chunk, monkeypatch):
    monkeypatch.setattr(arrowtext, "CHUNK_BYTES", chunk)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [rng.choices(vocabulary, k=n) for n in (49, 50, 51, 80, 130)]
    docs = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(0, 70))
        for p in rng.sample(passages, 2):
            words += p + rng.choices(vocabulary, k=rng.randrange(0, 40))
        docs.append((i * 3 - 50, rng.choice([" ", "\n", " \t "]).join(words)))
    docs += [(900, docs[0][1]), (901, "x " * 60), (902, "x " * 200), (903, "")]
    assert got(substring_dedup.digests(documents(spark, docs))) == brute_force(docs)


def test_odd_tables(spark):
    rows = substring_dedup.digests(odd_documents(spark)).collect()
    assert len(rows) == 8 and all(r.n_removed == 0 for r in rows)
    assert substring_dedup.digests(empty(spark)).count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(70))
    rows = substring_dedup.dedup_substrings(documents(spark, [(1, one), (2, one), (2, two), (2, two), (3, two), (None, one)])).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in rows) == [
        (0, 60, 0), (1, 60, 0), (2, 60, 60), (2, 70, 0), (2, 70, 0), (3, 70, 70)]
