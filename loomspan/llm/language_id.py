"""Language identification: one Bloom filter of n-grams whose bits are language masks.

A row of the filter has one bit for each language (it is bit-sliced: slice l is language
l's own Bloom filter), so one look-up of an n-gram, the AND of its HASHES rows, gives all
languages that have it.  A document's hits are counted for each language over the n-grams
of all its words.  Slices are filled to different degrees; of n n-grams that a language
does not have, its slice claims n * fill ** HASHES, which is taken off before the largest
count decides.

An n-gram is a word, or GRAMS bytes of it in UTF-8 with a mark at each end; words are runs of
letters and combining marks in lower case.  A language has the KEPT n-grams that the most of its
sampled documents hold.  The sample is SAMPLE different texts of each language, picked by a
hash of id and text, so it does not grow with the table; scoring covers every whole text.

Null texts and texts without a letter are `und` with score 0, as is everything where nothing was
learned.  A text without a known n-gram gets the language with most sampled documents and score
0.  Ties go to the language with more sampled documents, then to the smaller name.  Rows
with a null language, or without a doc_id, teach nothing; repeated rows teach once.  Extra
columns are ignored; rows that repeat or have no doc_id are scored like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import Words, _bytes, _prefix, chunks, mix, split_words, text_bytes
from .bpe import gather
from .scratch import Table, small_batches
from .subwords import distinct_words, fold

GRAMS = (2, 3, 4)
#: Different texts of each language that are learned from at most, and n-grams that a language keeps at most.
SAMPLE, KEPT = 2_000, 20_000
#: Rows of the filter as a power of two, and rows that an n-gram sets.
ROW_BITS, HASHES = 19, 3
#: Picked rows (a language and a hash) that are broadcast at most, so that texts need no shuffle.
BROADCAST_ROWS = 500_000
UNKNOWN = "und"


def letters(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """The words of texts, in lower case, and which texts have a letter."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    some = pc.match_substring_regex(low, r"\pL").to_numpy(zero_copy_only=False)
    return split_words(*text_bytes(pc.replace_substring_regex(low, r"[^\pL\pM]+", " "))), some


def grams(words: Words, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, hash) of all n-grams of some words, for one size after the other, in order of words."""
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
    yield np.arange(len(size)), mix((total[ends] - total[ends - size]) * down[ends - size])
    for n in GRAMS:
        at = np.flatnonzero(own[:len(own) - n + 1] == own[n - 1:]) if len(own) >= n else np.zeros(0, np.int64)
        yield own[at], mix((total[at + n] - total[at]) * down[at] + np.uint64(n))


def _rows_of(gram: np.ndarray) -> Iterator[np.ndarray]:
    """The filter rows of n-grams, from different bits of their hashes."""
    for i in range(HASHES):
        yield (gram >> np.uint64(i * (ROW_BITS + 1)) & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64)


class Filters:
    """The bit-sliced filter; languages stand in the order that decides ties."""

    def __init__(self, langs: list[str], grams_of: list[np.ndarray]):
        self.langs = langs
        self.table = np.zeros((1 << ROW_BITS, (len(langs) + 7) // 8), np.uint8)
        for i, found in enumerate(grams_of):
            for at in _rows_of(found):
                self.table[at, i // 8] |= np.uint8(128 >> i % 8)
        fill = np.array([np.count_nonzero(self.table[:, i // 8] & (128 >> i % 8)) for i in range(len(langs))]) / (1 << ROW_BITS)
        self.false = fill ** HASHES

    def languages(self, gram: np.ndarray) -> np.ndarray:
        """One row of bits for each n-gram: the languages that have it."""
        rows = _rows_of(gram)
        mask = self.table[next(rows)]
        for at in rows:
            mask &= self.table[at]
        return np.unpackbits(mask, axis=1, count=len(self.langs))

    def counts(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(hits of each language, n-grams) of each document."""
        start, length, which = distinct_words(words)
        hits, size = np.zeros((len(start), len(self.langs)), np.int64), np.zeros(len(start), np.int64)
        for owner, gram in grams(words, start, length):
            if len(owner):
                head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                hits[owner[head]] += np.add.reduceat(self.languages(gram), head, axis=0, dtype=np.int64)
                size += np.bincount(owner, minlength=len(start))
        out, n = np.zeros((words.docs, len(self.langs)), np.int64), np.zeros(words.docs, np.int64)
        filled = np.flatnonzero(words.counts)
        if len(filled):
            out[filled] = np.add.reduceat(hits[which], words.ptr[filled], axis=0)
            n[filled] = np.add.reduceat(size[which], words.ptr[filled])
        return out, n

    def decide(self, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score): the largest corrected count, and its share of the two largest."""
        own = np.maximum(0, (hits - n[:, None] * self.false) / (1 - self.false))
        best = own.argmax(1)
        first = own.max(1)
        second = np.partition(own, -2, 1)[:, -2] if own.shape[1] > 1 else np.zeros(len(own))
        return best, np.divide(first, first + second, out=np.zeros(len(own)), where=first > 0)


def _document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): in how many documents of a batch each n-gram stands."""
    for batch in batches:
        for part in chunks(batch):
            words, _ = letters(part.column(1))
            start, length, which = distinct_words(words)
            owner, gram = map(np.concatenate, zip(*grams(words, start, length)))
            order = np.argsort(owner, kind="stable")
            gram, count = gram[order], np.bincount(owner, minlength=len(start))
            first = np.cumsum(count) - count
            found: dict[str, list[np.ndarray]] = {}
            for lang, a, b in zip(part.column(0).to_pylist(), words.ptr[:-1], words.ptr[1:]):
                own = np.unique(which[a:b])
                found.setdefault(lang, []).append(np.unique(gather(gram, first[own], count[own])))
            for lang, told in found.items():
                some, n = np.unique(np.concatenate(told), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def sampled(taught: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(lang, text): at most `size` different rows of each language, picked by a hash of id and text."""
    keyed = taught.where("doc_id is not null and lang is not null").withColumn("hash", F.xxhash64("doc_id", "text"))
    order = Window.partitionBy("lang").orderBy("hash")
    picked = Table(keyed.select("lang", "hash").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).drop("place"), "picked").df
    if picked.count() <= BROADCAST_ROWS:  # beyond it, for very many languages, Spark joins as it sees fit
        picked = F.broadcast(picked)
    return keyed.join(picked, ["lang", "hash"]).groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text")


def learn(taught: DataFrame, size: int = SAMPLE, kept: int = KEPT) -> Filters:
    """Filters of (doc_id, text, lang) rows: at most `kept` n-grams of each language come to the driver."""
    small_batches(taught.sparkSession)
    texts = Table(sampled(taught, size), "language-sample")
    docs = {r.lang: r["count"] for r in texts.df.groupBy("lang").count().collect()}
    counted = texts.df.mapInArrow(_document_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= kept).select("lang", "gram").toArrow()
    texts.drop()
    langs = sorted(docs, key=lambda x: (-docs[x], x))
    lang_of, gram = best.column("lang"), best.column("gram").to_numpy().view(np.uint64)
    return Filters(langs, [gram[pc.equal(lang_of, x).to_numpy()] for x in langs])


def _predict(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = told.value
        names = np.array(filters.langs, object)
        for batch in batches:
            for part in chunks(batch):
                words, some = letters(part.column(1))
                lang, score = np.full(len(some), UNKNOWN, object), np.zeros(len(some))
                if len(names):
                    best, own = filters.decide(*filters.counts(words))
                    lang[some], score[some] = names[best[some]], own[some]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(documents: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text."""
    spark = documents.sparkSession
    small_batches(spark)
    told = spark.sparkContext.broadcast(filters)
    return _plain(documents).select("doc_id", "text").mapInArrow(_predict(told), "doc_id long, lang_pred string, score double")


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(F.col("text").cast("string")).alias("text"),
                            F.col("lang").cast("string").alias("lang"))


def language_ids(documents: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); fold 0 of 5 is held out."""
    held_out = fold(F.col("doc_id"), 5) == 0 if held_out is None else held_out
    scores = predict(documents, learn(_plain(documents).where(~held_out)))
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
