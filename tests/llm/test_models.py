import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomspan.llm import queries, subwords, toxicity

from .helpers import documents, empty, odd_documents

SF = "/root/testdata/sf0.01"
VOCABULARY = [a + b + c for a in ("ka", "lo", "mi", "su") for b in ("ren", "tal", "vos", "dim") for c in ("a", "eth", "or", "un")]


def held_out_rates(spark, rows, column, labels):
    truth = {r.doc_id: r[column] for r in labels.collect() if r[column] is not None}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    hit = sum(p == t for p, t in held)
    return hit / len(held), len(held)


@pytest.mark.parametrize("name, column, folds, fold, least", [("op6_quality", "quality", 5, 0, 0.95), ("op8_toxicity", "toxic", 4, 2, 0.85)])
def test_query_on_held_out_rows(spark, name, column, folds, fold, least):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)
    accuracy, n = held_out_rates(spark, rows, column, spark.read.parquet(f"{SF}/labels.parquet"))
    assert n > 50 and accuracy >= least


def labelled(spark, n=300):
    """Clean and toxic documents; toxic ones hold one of three terms, a stem with changing ends, or a misspelling."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(VOCABULARY, k=30)
        toxic = i % 3 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["grumbol", "snarvik", "blethered", "zaqqen" + rng.choice(VOCABULARY)])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = labelled(spark)
    return toxicity.fit(documents(spark, docs), spark.createDataFrame(labels, "doc_id long, label int"))


def test_lexicon_has_terms_and_stems(model):
    assert {"grumbol", "snarvik", "blethered"} <= set(model.terms) and any(t.startswith("zaqq") and t.endswith("*") for t in model.terms)
    assert len(model.terms) < 8


@pytest.mark.parametrize("text, toxic", [("karena grumbol lotala", 1), ("karena GRUMBOL! lotala", 1), ("a grumbo1 b", 1), ("a zaqqenxyz b", 1), ("karena lotala", 0), ("", 0), (None, 0), ("grum bol", 0)])
def test_exact_misspelled_and_stemmed_terms(spark, model, text, toxic):
    score = toxicity.score(documents(spark, [(1, text)]), model).first().score
    assert (score > max(0.05, model.rates[""])) == bool(toxic)


def test_quotation_scores_lower(spark, model):
    plain, quoted = (toxicity.score(documents(spark, [(1, t)]), model).first().score for t in ("you are a grumbol here", 'they said "you are a grumbol" here'))
    assert quoted < plain


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automata_equal_the_distance():
    rng = random.Random(4)
    terms = ["abcab", "abcde", "bcabcab", "aabb", "cabcabcabca", "abc*", "cabca*", "bbcab*"]
    lexicon = toxicity.Lexicon(terms)
    words = ["".join(rng.choices("abcde", k=rng.randrange(0, 16))) for _ in range(1500)] + [t.strip("*") for t in terms] + [""]
    found = {}
    for w, t, d in zip(*lexicon.match(words)):
        found[words[w], lexicon.terms[t]] = min(d, found.get((words[w], lexicon.terms[t]), 9))
    for word in set(words):
        for term in terms:
            body, stem = term.strip("*"), term.endswith("*")
            d = min((levenshtein(word[:k], body) for k in range(len(word) + 1)), default=9) if stem else levenshtein(word, body)
            assert found.get((word, term), 9) == (d if d <= toxicity.allowed(body, stem) else 9), (word, term, d)


def test_odd_tables(spark, model):
    rows = toxicity.score(odd_documents(spark).withColumn("SCORE", F.lit(1)), model).collect()
    assert len(rows) == 8 and all(r.score == model.rates[""] for r in rows)
    assert toxicity.score(empty(spark), model).count() == 0
    nothing = toxicity.fit(empty(spark), spark.createDataFrame([], "doc_id long, label int"))
    assert nothing.terms == [] and toxicity.score(odd_documents(spark), nothing).count() == 8
    quality = subwords.fit(empty(spark), spark.createDataFrame([(1, None)], "doc_id long, label int"))
    rows = subwords.score(odd_documents(spark), quality).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)


def test_quality_learns_subwords_and_repeats(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        words = rng.choices(VOCABULARY, k=40)
        if i % 4 == 0:
            words = [w + "##" for w in words] if i % 8 else [w for w in words[:8] for _ in range(5)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 > 0)))
    model = subwords.fit(documents(spark, docs[:300]), spark.createDataFrame(labels[:300], "doc_id long, label int"))
    scores = {r.doc_id: r.score for r in subwords.score(documents(spark, docs[300:]), model).collect()}
    assert all((scores[i] >= 0.3) == bool(label) for i, label in labels[300:])
