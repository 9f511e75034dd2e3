"""Toxicity: a learned lexicon, matched through Levenshtein automata and read in context.

The lexicon is learned from a bounded sample of labelled rows: words, and stems
that many different words begin with, which toxic documents hold far more often
than clean ones.  Its terms are one trie.  The distinct words of a batch walk the
trie together: at every node each word keeps the banded row of its Levenshtein
automaton, and words whose row is over the allowed distance leave the branch.

Around each match a window of words tells quotation from abuse: quotation marks
on both sides, or a verb of saying.  What a match says about its document is
learned for each (term, distance, quoted), and for each spelling that the sample
has often enough; both fall back on wider groups.  A document's score is that of
its strongest match, or the rate of toxic documents among those without one.

Whole texts are scored; null and empty texts have no match.  Extra columns are
ignored; rows that repeat, or that have no doc_id, are scored like others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import batch_words, chunks, mix, signed
from .scratch import Table, small_batches
from .subwords import THRESHOLD, distinct_words, fold, judged, sampled_texts

#: Labelled rows of each class that the lexicon and its scores are learned from at most.
SAMPLE = 4000
#: Letters of the shortest and longest stem, and of the shortest term that may be misspelled.
STEM, LONGEST, SPELLED = 4, 12, 5
#: How surprising a term's toxic documents must be, as minus the logarithm of Chernoff's bound on their chance at its
#: rate in clean ones; the sample has hundreds of thousands of forms, so some are in several toxic documents by chance.
EVIDENCE = 16.0
#: A form must be this many times likelier in toxic documents.
ODDS = 12.0
#: A longer form stands for a shorter one when it is in this share of its documents.
KEEPS = 0.9
WINDOW = 8
#: Rows of a group at which its own rate weighs as much as the wider group's.
WEIGHT = 4.0
# Marks that open or close a quotation, and verbs of saying.
QUOTES = "\"“”„«»‹›"
SAYING = frozenset("said says quote quoted quotes called wrote writes according dit écrit cité sagte schrieb zitat dijo escribió cita".split())
_EDGE = re.compile(r"^\W+|\W+$")


def plain(word: str) -> str:
    """A word in lower case without punctuation at its ends."""
    word = word.lower()
    return word if word.isalnum() else _EDGE.sub("", word)


def _texts(words, start, length) -> list[str]:
    raw = words.data.tobytes()
    return [plain(raw[a:a + n].decode("utf-8", "replace")) for a, n in zip(start.tolist(), length.tolist())]


def allowed(term: str, stem: bool) -> int:
    """The edit distance at which a word may match a term."""
    return 0 if len(term) < SPELLED + stem else 1 if len(term) < 10 else 2


class Lexicon:
    """A trie of terms; a term that ends with ``*`` is a stem and matches words that go on after it."""

    def __init__(self, terms: list[str]):
        self.terms = sorted(terms)
        self.root: dict = {}
        for i, term in enumerate(self.terms):
            node = self.root
            for letter in term.rstrip("*"):
                node = node.setdefault(letter, {})
            node.setdefault("", []).append(i)
        self.most = max([allowed(t.rstrip("*"), t.endswith("*")) for t in self.terms], default=0)
        self.longest = max(map(len, self.terms), default=0) + self.most + 1

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, distance) of every word and term within the term's distance."""
        k, width = self.most, self.longest + self.most + 1
        if not self.terms or not words:
            none = np.zeros(0, np.int64)
            return none, none, none
        letters = np.array([w[:self.longest] for w in words], dtype=f"<U{self.longest}").view(np.uint32).reshape(len(words), self.longest)
        padded = np.zeros((len(words), k + width), np.uint32)  # k cells before the word, zeros after it
        padded[:, k:k + self.longest] = letters
        size = (letters > 0).sum(1)
        found: list = []
        far = np.int8(k + 1)
        # cell j of a row at depth d: the distance between the d letters of the branch and the first d - k + j letters of the word
        row = np.full((len(words), 2 * k + 1), far, np.int8)
        row[:, k:] = np.arange(k + 1)
        for j in range(k + 1, 2 * k + 1):
            row[size < j - k, j] = far
        stack = [(self.root, 0, np.arange(len(words)), row)]
        while stack:
            node, depth, alive, row = stack.pop()
            for i in node.get("", ()):
                stem = self.terms[i].endswith("*")
                if stem:
                    distance = row.min(1)
                else:
                    at = size[alive] - depth + k
                    distance = np.where((at >= 0) & (at <= 2 * k), row[np.arange(len(alive)), np.clip(at, 0, 2 * k)], far)
                hit = np.flatnonzero(distance <= allowed(self.terms[i].rstrip("*"), stem))
                found.append((alive[hit], np.full(len(hit), i), distance[hit].astype(np.int64)))
            for letter, child in node.items():
                if not letter:
                    continue
                new = np.full_like(row, far)
                length = size[alive]
                for j in range(2 * k + 1):
                    end = depth + 1 - k + j  # letters of the word
                    if end < 0:
                        continue
                    best = np.minimum(row[:, j + 1] + 1 if j < 2 * k else far, far)  # the word lacks the letter
                    if end > 0:
                        same = padded[alive, k + end - 1] != ord(letter)
                        best = np.minimum(best, row[:, j] + same)
                        if j:
                            best = np.minimum(best, new[:, j - 1] + 1)  # the word has one more
                    new[:, j] = np.where(length >= end, np.minimum(best, far), far)
                stays = new.min(1) <= k
                if stays.any():
                    stack.append((child, depth + 1, alive[stays], new[stays]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *x]).astype(np.int64) for x in zip(*found)) if found else (none, none, none)


def _forms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in range(STEM, min(len(word), LONGEST + 1)))] if len(word) >= STEM else []


def _form_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, toxic, clean): in how many documents of a chunk each word and stem is."""
    for batch in batches:
        for part in chunks(batch):
            words = batch_words(part)
            start, length, which = distinct_words(words)
            forms = [_forms(w) for w in _texts(words, start, length)]
            counts = (Counter(), Counter())
            for i, label in enumerate(part.column(2).to_pylist()):
                own = set()
                for w in np.unique(which[words.ptr[i]:words.ptr[i + 1]]).tolist():
                    own.update(forms[w])
                counts[label].update(own)
            keys = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_pydict({"form": pa.array(keys, pa.string()), "toxic": pa.array([counts[1][x] for x in keys], pa.int64()),
                                              "clean": pa.array([counts[0][x] for x in keys], pa.int64())})


def choose(counts: dict[str, tuple[int, int]]) -> list[str]:
    """Of telling forms, those that no longer form stands for and no shorter one covers."""
    children: dict[str, list[str]] = {}
    for form in counts:
        body = form.rstrip("*")
        parents = [p for n in range(len(body) - form.endswith("*"), 0, -1) if (p := body[:n] + "*") in counts and p != form]
        children.setdefault(parents[0] if parents else "", []).append(form)
    chosen, todo = [], list(children.get("", []))
    while todo:
        form = todo.pop()
        own = [c for c in children.get(form, []) if counts[c][0] >= KEEPS * counts[form][0]]
        if own:
            todo.append(max(own, key=lambda c: (counts[c][0], len(c), c)))
        else:
            chosen.append(form)
    return sorted(chosen)


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with two minhashes of their word triples, by which near copies are mostly equal."""
    for batch in batches:
        for part in chunks(batch):
            words = batch_words(part)
            doc, _, hashes = words.windows(3)
            least = np.stack([words.whole(), words.whole()])
            for row, salt in zip(least, (0, 0x9E3779B97F4A7C15)):
                order = np.lexsort((mix(hashes ^ np.uint64(salt)), doc))
                some, first = np.unique(doc[order], return_index=True)
                row[some] = mix(hashes ^ np.uint64(salt))[order][first]
            yield pa.RecordBatch.from_arrays([*part.columns, signed(least[0]), signed(least[1])], names=[*part.schema.names, "m1", "m2"])


def without_copies(sampled: DataFrame) -> DataFrame:
    """One row of those that share a minhash, so that a group of copies counts once."""
    found = sampled.mapInArrow(_minima, "doc_id long, text string, label int, m1 long, m2 long")
    return found.dropDuplicates(["label", "m1"]).dropDuplicates(["label", "m2"]).drop("m1", "m2")


def learn_lexicon(sampled: DataFrame) -> list[str]:
    """The terms of (doc_id, text, label) rows."""
    size = {r.label: r.n for r in sampled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    rows = sampled.mapInArrow(_form_counts, "form string, toxic long, clean long").groupBy("form").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    expected = (F.col("clean") + 1) * (toxic + 1) / (clean + 1)
    evidence = F.col("toxic") * F.log(F.col("toxic") / expected) - (F.col("toxic") - expected)
    told = rows.where((F.col("toxic") >= ODDS * expected) & (evidence >= EVIDENCE))  # at most the words of the sample
    return choose({r.form: (r.toxic, r.clean) for r in told.toLocalIterator()})


def _quoted(raw: list[str], at: int) -> bool:
    before, after = raw[max(0, at - WINDOW):at], raw[at + 1:at + 1 + WINDOW]
    here = raw[at]
    opens = any(c in QUOTES for w in before for c in w) or here[:1] in QUOTES
    closes = any(c in QUOTES for w in after for c in w) or any(c in QUOTES for c in here[1:])
    return (opens and closes) or any(plain(w) in SAYING for w in before + after)


def matches(part: pa.RecordBatch, lexicon: Lexicon, text: str = "text"):
    """(row, spelling, term, distance, quoted) of every match in a batch, the nearest term of each word."""
    words = batch_words(part, text)
    start, length, which = distinct_words(words)
    texts = _texts(words, start, length)
    word, term, distance = lexicon.match(texts)
    if not len(word):
        return
    order = np.lexsort((term, distance, word))
    word, term, distance = word[order], term[order], distance[order]
    first = np.r_[True, word[1:] != word[:-1]]
    of = {w: (t, d) for w, t, d in zip(word[first].tolist(), term[first].tolist(), distance[first].tolist())}
    hit = np.flatnonzero(np.isin(which, word[first]))
    rows = np.searchsorted(words.ptr, hit, "right") - 1
    data = words.data.tobytes()
    for i, row in zip(hit.tolist(), rows.tolist()):
        low, high = max(words.ptr[row], i - WINDOW), min(words.ptr[row + 1], i + WINDOW + 1)
        raw = [data[a:b].decode("utf-8", "replace") for a, b in zip(words.start[low:high], words.end[low:high])]
        t, d = of[int(which[i])]
        yield row, texts[which[i]], t, d, _quoted(raw, i - low)


def _keys(spelling: str, term: str, distance: int, quoted: bool) -> list[str]:
    """The groups of a match, from the widest."""
    return [f"d{distance}{quoted:d}", f"t{distance}{quoted:d}{term}", f"s{distance}{quoted:d}{spelling}"]


def _group_counts(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(told.value)
        for batch in batches:
            for part in chunks(batch):
                own: list[set] = [set() for _ in range(part.num_rows)]
                for row, spelling, term, distance, quoted in matches(part, lexicon):
                    own[row].update(_keys(spelling, lexicon.terms[term], distance, quoted))
                counts = Counter((key, label) for x, label in zip(own, part.column(2).to_pylist()) for key in x or {""})
                yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in counts], pa.string()), "label": pa.array([k for _, k in counts], pa.int32()),
                                                  "n": pa.array(list(counts.values()), pa.int64())})

    return run


@dataclass
class Model:
    """The terms, and the chance of a toxic document for each group of matches; ``""`` has that without a match."""

    terms: list[str]
    rates: dict[str, float]

    def chance(self, spelling: str, term: str, distance: int, quoted: bool) -> float:
        for key in reversed(_keys(spelling, term, distance, quoted)):
            if key in self.rates:
                return self.rates[key]
        return 0.5 if distance == 0 and not quoted else 0.25


def fit(documents: DataFrame, labelled: DataFrame, size: int = SAMPLE) -> Model:
    """Lexicon and rates of (doc_id, label) rows, label 0 or 1."""
    spark = documents.sparkSession
    small_batches(spark)
    labelled = labelled.where("doc_id is not null and label in (0, 1)")
    sampled = Table(without_copies(sampled_texts(documents, labelled, size)), "sample")
    terms = learn_lexicon(sampled.df)
    # the sample holds the classes about evenly; a document counts as many times as its class is commoner among all labelled rows
    share, here = (np.array([found.get(k, 0) for k in (0, 1)], float) for found in (
        dict(df.groupBy("label").count().collect()) for df in (labelled, sampled.df)))
    clean_weight, toxic_weight = share / np.maximum(here, 1) * here.sum() / max(1, share.sum())
    counted = sampled.df.mapInArrow(_group_counts(spark.sparkContext.broadcast(terms)), "key string, label int, n long") \
        .groupBy("key").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum("n").alias("n"))
    groups = {r.key: (toxic_weight * r.toxic, toxic_weight * r.toxic + clean_weight * (r.n - r.toxic)) for r in counted.toLocalIterator()}
    toxic, n = groups.pop("", (0, 0))
    rates = {"": (toxic + 0.02) / (n + 1)}
    for wide in ("d", "t", "s"):
        for key, (toxic, n) in groups.items():
            if key[0] == wide:
                # a spelling's wider group is any term of its distance and context: the term's own rate holds other spellings
                prior = rates.get("d" + key[1:3], 0.5) if wide != "d" else 0.5 if key[1] == "0" else 0.2
                rates[key] = (toxic + WEIGHT * prior) / (n + WEIGHT)
    return Model(terms, rates)


def _scores(told, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = told.value
        lexicon = Lexicon(model.terms)
        for batch in batches:
            for part in chunks(batch, text):
                out = np.full(part.num_rows, model.rates[""])
                for row, spelling, term, distance, quoted in matches(part, lexicon, text):
                    out[row] = max(out[row], model.chance(spelling, lexicon.terms[term], distance, quoted))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], names=[*part.schema.names, "score"])

    return run


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All columns and the score of every row, from its whole text; a column of that name gives way."""
    spark = documents.sparkSession
    small_batches(spark)
    told = spark.sparkContext.broadcast(model)
    rows = documents.drop(*[c for c in documents.columns if c.lower() == "score"]).withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(_scores(told, "text"), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from: fold 2 of 4 is held out."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label")).where(fold(F.col("doc_id"), 4) != 2)


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    return score(documents, fit(documents, training_labels(labels))).where(F.col("score") < THRESHOLD).select(*documents.columns)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); fold 2 of 4 is held out."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judged(score(rows, fit(documents, training_labels(labels))), fold(F.col("doc_id"), 4) == 2)
