"""Quality classifier: supervised subword embeddings.

A word is its own hash and the hashes of its character n-grams (bytes of
``<word>``); each hash has a learned vector, and so has the mark of a word that
stood one to four words before.  A document's vector is the mean over its words of
the mean over each word's features and of its marks, and a softmax layer on it
gives the score.  Vectors and layer are trained together by numpy stochastic gradient
descent (Adagrad) on a sample of labelled rows, which is bounded by a parameter
and balanced by class; the classes' true shares are put back into the bias.

Scoring covers every whole text.  As the layer is linear, a feature's vector
enters a score as one number, so workers hold one number for each hash.  An empty
or null text has the score of the bias.  Extra columns are ignored; rows that
repeat, or that have no doc_id, are scored like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import Words, _bytes, _prefix, batch_words, chunks, mix
from .bpe import gather
from .scratch import Table, small_batches

BUCKET_BITS, DIMENSIONS = 17, 12
GRAMS = (3, 4)
#: A word that equals the one so many words before has a mark; marks come after the hash buckets.
LAGS = (1, 2, 3, 4)
#: Labelled rows of each class that a model is fitted on at most.
SAMPLE = 1500
EPOCHS, BATCH, RATE = 4, 16, 0.3
THRESHOLD = 0.3


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, length) of each distinct word, and which of them each word is."""
    _, one, which = np.unique(words.hashes, return_index=True, return_inverse=True)
    return words.start[one], (words.end - words.start)[one], which


def features(words: Words, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash bucket) of all features of some words."""
    size = length + 2
    ends = np.cumsum(size)
    flat = np.full(int(ends[-1]) if len(ends) else 0, ord("<"), np.uint8)
    inner = np.ones(len(flat), bool)
    inner[ends - 1] = inner[ends - size] = False
    flat[ends - 1] = ord(">")
    flat[inner] = gather(words.data, start, length)
    own = np.repeat(np.arange(len(size)), size)
    up, down = _bytes.get(max(1, len(flat)))
    total = _prefix(flat.astype(np.uint64) + np.uint64(1), up[:len(flat)])
    mask = np.uint64((1 << BUCKET_BITS) - 1)
    owners = [np.arange(len(size))]
    buckets = [mix((total[ends] - total[ends - size]) * down[ends - size]) & mask]
    for n in GRAMS:
        at = np.flatnonzero(own[:len(own) - n + 1] == own[n - 1:]) if len(own) >= n else np.zeros(0, np.int64)
        owners.append(own[at])
        buckets.append(mix((total[at + n] - total[at]) * down[at] + np.uint64(n)) & mask)
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def marks(words: Words) -> np.ndarray:
    """How many words of each document (axis 0) equal the one LAGS words before (axis 1)."""
    out = np.zeros((words.docs, len(LAGS)), np.int64)
    doc = words.doc_of()
    for i, lag in enumerate(LAGS):
        same = (words.hashes[lag:] == words.hashes[:-lag]) & (doc[lag:] == doc[:-lag])
        out[:, i] = np.bincount(doc[lag:][same], minlength=words.docs)
    return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, buckets, weights): each document's mean of features as a sparse vector."""
    for batch in batches:
        for part in chunks(batch):
            words = batch_words(part)
            start, length, which = distinct_words(words)
            owner, bucket = features(words, start, length)
            order = np.argsort(owner, kind="stable")
            bucket, count = bucket[order], np.bincount(owner, minlength=len(start))
            first = np.cumsum(count) - count
            ids, weights = [], []
            repeats = marks(words)
            for i, (a, b) in enumerate(zip(words.ptr[:-1], words.ptr[1:])):
                own, times = np.unique(which[a:b], return_counts=True)
                share = np.repeat(times / count[own] / max(1, b - a), count[own])
                found, back = np.unique(gather(bucket, first[own], count[own]), return_inverse=True)
                lags = np.flatnonzero(repeats[i])
                ids.append(np.r_[found, (1 << BUCKET_BITS) + lags].astype(np.uint32).tobytes())
                weights.append(np.r_[np.bincount(back, share, len(found)), repeats[i, lags] / max(1, b - a)].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(ids, pa.binary()), pa.array(weights, pa.binary())],
                                             names=["doc_id", "label", "ids", "weights"])


def sample(labelled: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most `size` rows of each label 0 and 1, picked by a hash of the doc_id."""
    order = F.xxhash64("doc_id", F.lit("sample"))
    parts = [labelled.where(F.col("label") == k).orderBy(order, "doc_id").limit(size) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def sampled_texts(documents: DataFrame, labelled: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of the sample; its ids are at most 2 * size rows, and so are broadcast."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.join(F.broadcast(sample(labelled, size)), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))


class Model:
    """Vectors and softmax layer, fitted on sparse vectors."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, shares: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1, 1, ((1 << BUCKET_BITS) + len(LAGS), DIMENSIONS)).astype(np.float32) / DIMENSIONS
        self.layer = np.zeros((DIMENSIONS, 2), np.float32)
        self.bias = np.zeros(2, np.float32)
        seen = [np.full_like(x, 1e-6) for x in (self.vectors, self.layer, self.bias)]
        for epoch in range(EPOCHS if len(set(labels.tolist())) == 2 else 0):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(labels))
            for i in range(0, len(order), BATCH):
                self._step([bags[j] for j in order[i:i + BATCH]], labels[order[i:i + BATCH]], seen, rate)
        # trained on even classes: the logarithm of their shares goes back into the bias
        self.bias += np.log(np.maximum(shares, 1e-9) / np.maximum(np.bincount(labels, minlength=2) / max(1, len(labels)), 1e-9)).astype(np.float32)

    def _step(self, bags, labels, seen, rate) -> None:
        ids = np.concatenate([x for x, _ in bags])
        weights = np.concatenate([x for _, x in bags])
        size = np.array([len(x) for x, _ in bags])
        row = np.repeat(np.arange(len(bags)), size)
        filled = np.flatnonzero(size)
        mean = np.zeros((len(bags), DIMENSIONS), np.float32)
        if len(filled):
            mean[filled] = np.add.reduceat(self.vectors[ids] * weights[:, None], (np.cumsum(size) - size)[filled])
        out = mean @ self.layer + self.bias
        out = np.exp(out - out.max(1, keepdims=True))
        error = (out / out.sum(1, keepdims=True) - np.eye(2, dtype=np.float32)[labels]) / len(labels)
        back = error @ self.layer.T
        order = np.argsort(ids, kind="stable")
        some, first = np.unique(ids[order], return_index=True)
        if len(some):
            slope = np.add.reduceat((back[row] * weights[:, None])[order], first)
            self._descend(self.vectors, seen[0], slope, rate, some)
        self._descend(self.layer, seen[1], mean.T @ error, rate, slice(None))
        self._descend(self.bias, seen[2], error.sum(0), rate, slice(None))

    @staticmethod
    def _descend(values, seen, slope, rate, at) -> None:
        seen[at] += slope * slope
        values[at] -= rate * slope / np.sqrt(seen[at])

    def numbers(self) -> tuple[np.ndarray, float]:
        """What each bucket and what the bias adds to the difference of the two outputs."""
        return self.vectors @ (self.layer[:, 1] - self.layer[:, 0]), float(self.bias[1] - self.bias[0])


def fit(documents: DataFrame, labelled: DataFrame, size: int = SAMPLE) -> Model:
    """A model of (doc_id, label) rows, label 0 or 1; documents without a label teach nothing."""
    small_batches(documents.sparkSession)
    labelled = labelled.where("doc_id is not null and label in (0, 1)")
    bags = Table(sampled_texts(documents, labelled, size).mapInArrow(_bags, "doc_id long, label int, ids binary, weights binary"), "bags")
    rows = sorted((r.doc_id, r.label, bytes(r.ids), bytes(r.weights)) for r in bags.df.toLocalIterator())
    count = dict(labelled.groupBy("label").count().collect())
    shares = np.array([count.get(k, 0) for k in (0, 1)], float)
    return Model([(np.frombuffer(i, np.uint32), np.frombuffer(w, np.float32)) for _, _, i, w in rows],
                 np.array([k for _, k, _, _ in rows], np.int64), shares / max(1, shares.sum()))


def _scores(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bias = told.value
        for batch in batches:
            for part in chunks(batch):
                words = batch_words(part)
                start, length, which = distinct_words(words)
                owner, bucket = features(words, start, length)
                word = np.bincount(owner, number[bucket], len(start)) / np.maximum(1, np.bincount(owner, minlength=len(start)))
                total = np.r_[0, np.cumsum(word[which])]
                whole = total[words.ptr[1:]] - total[words.ptr[:-1]] + marks(words) @ number[1 << BUCKET_BITS:]
                out = bias + whole / np.maximum(1, words.counts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-out)))], names=["doc_id", "score"])

    return run


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, from its whole text."""
    spark = documents.sparkSession
    small_batches(spark)
    told = spark.sparkContext.broadcast(model.numbers())
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(_scores(told), "doc_id long, score double")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(folds))


def judged(scores: DataFrame, held_out: Column) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); fold 0 of 5 is held out."""
    held_out = fold(F.col("doc_id"), 5) == 0
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(~held_out)
    return judged(score(documents, fit(documents, taught)), held_out)
