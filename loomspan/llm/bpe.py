"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A batch of texts is cut into pieces (a run of white space and the run of other
characters after it), which the pre-tokenizer treats independently of each other.
Each distinct piece is pre-tokenized and encoded once; all words that are new to
a worker are encoded together: their symbols lie in one flat array, each round
finds the rank of every neighbouring pair by binary search over the sorted pair
keys, and merges the lowest-rank pair of every word at all its places.

Null texts count as empty.  An empty text has no ids.  Extra columns are kept by
`encode` and `decode`; rows are independent, so repeated rows give repeated results.
The text of a special token that stands in a document becomes its one id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import _bytes, _prefix, chunks, mix, text_bytes
from .scratch import small_batches

# The white space of the pre-tokenizer, ASCII first, and its pattern.
_SPACES = "\t\n\v\f\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^#\p{L}\p{N}]+|[#]+(?![^#])|[#]+".replace("#", _SPACES)

#: Pieces that a worker remembers (some 60 bytes each); when there are more, it starts anew.
REMEMBERED = 2_000_000
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, 9, 10, 11, 12, 13]] = True


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next one from 256."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start:start+length] of every span, end to end."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(start - (ends - length), length)]


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, length


class ByteBpe:
    """The vocabulary and merges of one tokenizer file, and what has been encoded with them."""

    def __init__(self, path: str, specials: bool = True):
        told = json.loads(Path(path).read_text(encoding="utf-8"))
        vocab, merges = told["model"]["vocab"], told["model"]["merges"]
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.special = {t["content"].encode(): t["id"] for t in told["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        token = [b""] * size
        for text, i in vocab.items():
            token[i] = bytes(byte_of[x] for x in text)
        for raw, i in self.special.items():
            token[i] = raw
        if not specials:
            self.special = {}
        self.token, self.token_start, self.token_length = _flat(token)
        self.byte_id = np.array([vocab[x] for x in byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        self.pattern = regex.compile(PATTERN)
        self._forget()

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length) of each of many words, by merge rounds over all their symbols."""
        data, _, length = _flat(words)
        symbols, word = self.byte_id[data], np.repeat(np.arange(len(words)), length)
        done_ids, done_words = [], []
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], self.none)
            rank = np.append(rank, self.none)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(symbols)])
            over = np.repeat(least == self.none, size)
            done_ids.append(symbols[over])
            done_words.append(word[over])
            place = np.flatnonzero((rank == np.repeat(least, size)) & (rank < self.none))
            if len(place):  # of pairs that overlap, every other one from the left
                head = np.r_[True, np.diff(place) != 1]
                run = np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))
                place = place[(np.arange(len(place)) - run) % 2 == 0]
            symbols[place] = self.made[rank[place]]
            stays = ~over
            stays[place + 1] = False
            symbols, word = symbols[stays], word[stays]
        if not done_ids:
            none = np.zeros(0, np.int64)
            return none.astype(np.int32), none, none
        owner = np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        count = np.bincount(owner, minlength=len(words))
        return np.concatenate(done_ids)[order].astype(np.int32), np.cumsum(count) - count, count

    def learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, length) of distinct pieces: words are cut by one pattern scan, and each distinct word is merged once."""
        texts = [p.decode() for p in pieces]
        alone = [p in self.special or t[-1] in _SPACES or t[0] not in _SPACES[:6] for p, t in zip(pieces, texts)]
        # pieces that begin with white space and do not end with it read the same side by side
        joined = [t for t, x in zip(texts, alone) if not x]
        size = np.zeros(len(pieces), np.int64)
        cut = self.pattern.findall("".join(joined))
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        upto = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined))), "right")
        size[np.flatnonzero(~np.array(alone))] = np.diff(np.r_[0, upto])
        words: dict[str, int] = {}
        found = np.fromiter((words.setdefault(w, len(words)) for w in cut), np.int64, len(cut))
        own, place = {}, np.cumsum(size) - size
        for i in np.flatnonzero(alone):
            own[i] = [] if pieces[i] in self.special else self.pattern.findall(texts[i])
        odd = {i: [words.setdefault(w, len(words)) for w in x] for i, x in own.items()}
        ids, start, length = self.merge([w.encode() for w in words])
        word_ids = gather(ids, start[found], length[found])
        word_ends = np.r_[0, np.cumsum(length[found])]
        total = word_ends[place + size] - word_ends[place]
        if not odd:
            return word_ids, total
        out, low = [], 0
        for i, x in odd.items():
            out.append(word_ids[low:word_ends[place[i]]])
            low = word_ends[place[i]]
            made = np.array([self.special[pieces[i]]], np.int32) if pieces[i] in self.special else \
                np.concatenate([ids[start[w]:start[w] + length[w]] for w in x])
            out.append(made)
            total[i] = len(made)
        return np.concatenate([*out, word_ids[low:]]), total

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        n = len(data)
        space = _SEPARATORS[data]
        begins = np.zeros(n + 1, bool)
        begins[1:n] = space[1:] & ~space[:-1]
        at = np.flatnonzero(begins)
        p1 = data[at - 1]
        p2 = np.where(at > 1, data[at - 2], 0)
        p3 = np.where(at > 2, data[at - 3], 0)
        # after white space beyond ASCII, a run goes on
        wide = ((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))) | ((p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)) \
            | ((p3 == 0xE2) & (p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF))) \
            | ((p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F)) | ((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80))
        begins[at[wide]] = False
        begins[offsets] = True
        raw = data.tobytes()
        for text in self.special:
            i = raw.find(text)
            while i >= 0:
                j = i + len(text)
                if offsets[np.searchsorted(offsets, i, "right")] >= j:  # within one document
                    begins[i] = begins[j] = True
                    i = raw.find(text, j)
                else:
                    i = raw.find(text, i + 1)
        return np.flatnonzero(begins[:n])

    def encode_batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each document's ids begin) of documents whose UTF-8 bytes lie end to end."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        start = self._starts(data, offsets)
        end = np.r_[start[1:], len(data)]
        up, down = _bytes.get(len(data))
        total = _prefix(data.astype(np.uint64) + np.uint64(1), up[:len(data)])
        found, one, which = np.unique(mix((total[end] - total[start]) * down[start]), return_index=True, return_inverse=True)
        ids, length = self._encode(data, start, end, found, one, which)
        doc = np.searchsorted(start, offsets)
        ptr = np.r_[0, np.cumsum(length)][doc]
        if not np.array_equal(self.decode_bytes(ids)[0], data):  # two pieces had one hash: number the pieces by their bytes
            seen: dict[bytes, int] = {}
            which = np.array([seen.setdefault(data[i:j].tobytes(), len(seen)) for i, j in zip(start, end)])
            ids, size = self.learn(list(seen))
            length = size[which]
            ids = gather(ids, (np.cumsum(size) - size)[which], length)
            ptr = np.r_[0, np.cumsum(length)][doc]
        return ids, ptr

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_at = np.zeros((2, 0), np.int64)
        self.ids = np.zeros(0, np.int32)

    def _encode(self, data, start, end, found, one, which):
        """Ids of all pieces, given the sorted distinct hashes; pieces with new hashes are learned first."""
        at = np.searchsorted(self.known, found)
        new = np.ones(len(found), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != found[inside]
        if new.any():
            if len(self.known) + new.sum() > REMEMBERED:
                self._forget()
                new[:] = True
            where = one[new]
            ids, size = self.learn([data[i:j].tobytes() for i, j in zip(start[where], end[where])])
            spans = np.stack([np.cumsum(size) - size + len(self.ids), size])
            self.ids = np.r_[self.ids, ids]
            known = np.r_[self.known, found[new]]
            order = np.argsort(known, kind="stable")
            self.known, self.known_at = known[order], np.concatenate([self.known_at, spans], 1)[:, order]
            at = np.searchsorted(self.known, found)
        first, size = self.known_at[:, at]
        length = size[which]
        return gather(self.ids, first[which], length), length

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each id's bytes begin, and the end)."""
        length = self.token_length[ids]
        return gather(self.token, self.token_start[ids], length), np.r_[0, np.cumsum(length)]


_loaded: dict[tuple[str, bool], ByteBpe] = {}


def tokenizer(path: str, specials: bool = True) -> ByteBpe:
    """The tokenizer of a file, loaded once for each worker; without specials, the texts of special tokens are plain text."""
    if (path, specials) not in _loaded:
        _loaded[path, specials] = ByteBpe(path, specials)
    return _loaded[path, specials]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of each text as array<int>; a column of that name gives way."""
    small_batches(df.sparkSession)
    df = df.drop(*[c for c in df.columns if c.lower() == ids.lower()])
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for part in chunks(batch, text):
                flat, ptr = own.encode_batch(*text_bytes(part.column(part.schema.get_field_index(text))))
                made = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of each array of ids; null ids give null, ids out of the vocabulary give nothing."""
    small_batches(df.sparkSession)
    df = df.drop(*[c for c in df.columns if c.lower() == text.lower()])
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            made = []
            for i in range(len(column)):
                one = column[i].values
                if one is None:
                    made.append(None)
                    continue
                flat = one.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = flat[(flat >= 0) & (flat < len(own.token_length))]
                made.append(own.decode_bytes(flat)[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(run, schema)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, from its ids and its decoded text."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = decode(encode(docs, path).select("doc_id", "ids"), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
