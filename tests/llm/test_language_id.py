import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.llm import language_id, queries

from .helpers import DOCUMENTS, empty, odd_documents

SF = "/root/testdata/sf0.01"
SYLLABLES = {"xa": ["ka", "lo", "mi", "tu", "re"], "xb": ["sch", "ung", "ber", "ka", "ig"], "xc": ["ño", "ció", "él", "lo", "que"], "xd": ["日本", "語", "の", "東", "京"]}


def write(rng, lang, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    return [(i, write(rng, lang), lang) for i, lang in enumerate(rng.choice(sorted(SYLLABLES)) for _ in range(n * 4))]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCUMENTS)


def naive_grams(text):
    """All n-grams of all words of a text, as (size or 0 for the word, bytes)."""
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        raw = b"<" + word.encode() + b">"
        yield 0, raw
        for n in language_id.GRAMS:
            yield from ((n, raw[i:i + n]) for i in range(len(raw) - n + 1))


def naive_counts(filters, text):
    """(hits, n-grams), one n-gram after another, by the filter's own rows."""
    hits, n = np.zeros(len(filters.langs), int), 0
    for size, gram in naive_grams(text):
        if size == 0:
            words, _ = language_id.letters(pa.array([gram[1:-1].decode()]))
            own = next(language_id.grams(words, words.start, words.end - words.start))[1]
        else:
            own = hash_of(gram, size)
        rows = [filters.table[int(at[0])] for at in language_id._rows_of(own)]
        hits += np.unpackbits(np.bitwise_and.reduce(rows), count=len(filters.langs))
        n += 1
    return hits, n


def hash_of(gram, size):
    from loomspan.llm.arrowtext import _BYTE_BASE, _M, mix
    value = sum((b + 1) * pow(_BYTE_BASE, i, 1 << 64) for i, b in enumerate(gram)) + size
    return mix(np.array([value & _M], np.uint64))


@pytest.fixture(scope="module")
def filters(spark):
    return language_id.learn(table(spark, corpus()))


def test_query_on_held_out_rows(spark):
    rows = queries.QUERIES["op11_language_id"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert {r.lang_pred for r in rows} <= {d.lang for d in docs.values()} | {"und"}
    held = [(r.lang_pred, docs[r.doc_id].lang) for r in rows if r.held_out and docs[r.doc_id].lang]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) >= 0.97


def test_counts_equal_brute_force(filters):
    rng = random.Random(3)
    texts = [write(rng, lang, rng.randrange(1, 30)) for lang in SYLLABLES for _ in range(5)] + ["", "ka! LO; mi-tu 77 ño", "Ünbekannt kaka kaka"]
    words, some = language_id.letters(pa.array(texts))
    hits, n = filters.counts(words)
    for i, text in enumerate(texts):
        want, size = naive_counts(filters, text)
        assert hits[i].tolist() == want.tolist() and n[i] == size, text
    assert some.tolist() == [bool(t) for t in texts]


def test_filters_have_every_learned_gram_and_few_others(spark, filters):
    seen = {lang: {g for _, t, x in corpus() if x == lang for g in naive_grams(t)} for lang in SYLLABLES}
    for i, lang in enumerate(filters.langs):
        own = [g for g in seen[lang] if g[0]]
        assert all(filters.languages(hash_of(g, n))[0][i] for n, g in own)
    other = np.random.default_rng(1).integers(0, 1 << 63, 200_000).astype(np.uint64)
    assert np.all(filters.languages(other).mean(0) <= 2 * filters.false + 1e-4)


def test_false_positives_are_taken_off():
    """A nearly full slice claims nearly everything, and still loses to the language that has the n-grams."""
    rng = np.random.default_rng(2)
    known = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    full = rng.integers(0, 1 << 63, 900_000).astype(np.uint64)
    filters = language_id.Filters(["full", "own"], [full, known])
    assert filters.false[0] > 0.9 and filters.false[1] < 1e-6
    hits = np.concatenate([filters.languages(known), filters.languages(rng.integers(0, 1 << 63, 2000).astype(np.uint64))])
    best, score = filters.decide(hits.sum(0)[None, :].astype(np.int64), np.array([2500]))
    assert hits[:, 0].sum() > hits[:, 1].sum() and filters.langs[best[0]] == "own" and 0.5 <= score[0] <= 1


def test_languages_beyond_one_byte_of_slices():
    rng = np.random.default_rng(4)
    own = [rng.integers(0, 1 << 63, 50).astype(np.uint64) for _ in range(19)]
    filters = language_id.Filters([f"l{i:02}" for i in range(19)], own)
    assert filters.table.shape[1] == 3
    for i, found in enumerate(own):
        assert filters.languages(found)[:, i].all() and filters.languages(found).sum() < 60


def test_sample_is_bounded_for_repeated_rows(spark):
    rows = [(7, "same text", "xa")] * 500 + [(i, f"text {i}", "xa") for i in range(300)] + [(None, "no id", "xa"), (1, "no language", None)]
    found = language_id.sampled(language_id._plain(table(spark, rows)), 100).collect()
    assert len(found) == 100 == len({r.text for r in found})


def test_unseen_languages_and_ties(spark, filters):
    rows = language_id.predict(table(spark, [(1, "ωωω ψψψ", None), (2, "12 34 !", None), (3, None, None), (4, "", None), (5, "kaka tutu mimi", "xd")]), filters).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert by[1] == (filters.langs[0], 0.0) and by[2] == by[3] == by[4] == ("und", 0.0) and by[5][0] == "xa"
    even = language_id.Filters(["b", "a"], [np.array([5], np.uint64)] * 2)
    assert even.decide(np.array([[3, 3]]), np.array([3]))[0].tolist() == [0]


def test_odd_tables(spark, filters):
    assert language_id.language_ids(empty(spark)).collect() == []
    rows = language_id.language_ids(odd_documents(spark).withColumn("SCORE", F.lit("x")).withColumn("hash", F.lit(1))).collect()
    assert len(rows) == 8 and all(r.held_out is not None and 0 <= r.score <= 1 for r in rows)
    nothing = language_id.learn(language_id._plain(empty(spark)))
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in language_id.predict(odd_documents(spark), nothing).collect())
    long = language_id.predict(table(spark, [(1, "schung berig " * 300_000, None)]), filters).first()
    assert long.lang_pred == "xb"


def test_labels_are_no_input_of_a_prediction(spark, filters):
    rows = corpus(9, 5)
    plain = language_id.predict(table(spark, rows), filters).orderBy("doc_id").collect()
    other = language_id.predict(table(spark, [(i, t, "zz") for i, t, _ in rows]), filters).orderBy("doc_id").collect()
    assert plain == other
