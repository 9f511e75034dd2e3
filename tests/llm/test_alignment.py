import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspan.llm import alignment, bpe, queries

from .helpers import documents, empty, odd_documents

A, B = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")
TEXTS = ["Hello world, this is a test.", "Hello world", "", None, "  two  spaces\n\nand\tlines\r\n", "naïve café — 日本語 текст 🤖🤖🤖", "<|endoftext|> and <s> </s> <unk> are plain",
         "a▁b", "x" * 400 + " " * 50 + "=" * 333, "\x00 nul", "Hello world", "1234567890 3.14159", "é ﻿ ﬁ", " leading", "trailing ", "\n", " "]


def token_sides():
    t, p = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    byte_of = {letter: i for i, letter in enumerate(bpe.byte_letters())}

    def a(text):
        ids = t.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(byte_of[x] for x in t.id_to_token(i))) for i in ids]

    def b(text):
        return [(i, bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()) for i in p.encode(text)]

    return a, b


def brute_force(docs):
    """Token by token, group by group, from (doc_id, text) pairs."""
    a_side, b_side = token_sides()
    told, linked = [], defaultdict(set)
    for place, (doc_id, text) in enumerate(docs):
        a, b = (a_side(text), b_side(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        if any(b"".join(x for _, x in side) != want for side in (a, b)):
            a = b = []
        ends = []
        for side in (a, b):
            at, own = 0, []
            for _, x in side:
                at += len(x)
                own.append(at)
            ends.append(own)
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            left, right = [], []
            while i < len(a) and ends[0][i] <= end:
                left.append(a[i][0])
                i += 1
            while j < len(b) and ends[1][j] <= end:
                right.append(b[j][0])
                j += 1
            groups.append((left, right))
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        for pair in links:
            linked[pair].add(place)
        told.append((doc_id, len(a), len(b), groups, links))
    most = Counter()
    for (x, y), where in linked.items():
        most[x] = max(most[x], len(where))
    out = []
    for doc_id, n_a, n_b, groups, links in told:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if len(linked[p]) == most[p[0]]),
                    sum(n * len(linked[p]) for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def test_equals_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    assert found(alignment.alignments(documents(spark, docs), A, B)) == brute_force(docs)


def test_random_texts_over_many_partitions(spark):
    rng = random.Random(2)
    words = ["the", "and", "über", "token", "日本", "...", "<s>", "\n", "  ", "123", "ing", "🤖", "'s", "é", "\x01"]
    docs = [(i, "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(40)))) for i in range(80)]
    assert found(alignment.alignments(documents(spark, docs).repartition(9), A, B)) == brute_force(docs)


def test_query_on_the_given_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(queries.QUERIES["op12_alignment"](spark, sf)) == brute_force(docs)


def test_hot_slots_are_split(spark, monkeypatch):
    """The counts of a slot go to each of its parts, so parts add up to the whole."""
    monkeypatch.setattr(alignment, "LEAST_PART", 3)
    monkeypatch.setattr(alignment, "MOST_PART", 7)
    docs = [(i, "the the cat " * (i % 3 + 1)) for i in range(30)]
    assert found(alignment.alignments(documents(spark, docs).repartition(10), A, B)) == brute_force(docs)


def test_large_groups_are_counted_by_their_ids(monkeypatch):
    both = alignment.sides(A, B)
    column = pa.array([t for t in TEXTS if t] * 2)
    want = [x.tolist() for x in alignment.Aligned(column, both).links(both[1].size)]
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    assert [x.tolist() for x in alignment.Aligned(column, both).links(both[1].size)] == want


def test_groups_and_pairs(spark):
    docs = documents(spark, [(1, "Hello world"), (2, "Hello hello"), (3, None)])
    rows = {r.doc_id: r.groups for r in alignment.groups(docs, A, B).collect()}
    digests = {r.doc_id: r.groups_sha256 for r in alignment.alignments(docs, A, B).collect()}
    assert rows[3] == "" == digests[3] and all(hashlib.sha256(rows[i].encode()).hexdigest() == digests[i] for i in (1, 2))
    a, b = (int(x) for x in rows[1].split(";")[0].split("|"))
    pairs = {(r.a, r.b): (r.n, r.best) for r in alignment.token_pairs(docs, A, B).collect()}
    assert pairs[a, b] == (2, True)


def test_packed_numbers():
    import numpy as np
    arrays = [np.array([], np.int64), np.array([0, 255]), np.array([256]), np.array([1 << 20, 3]), np.array([1 << 40])]
    assert [x.tolist() for x in alignment.unpack(alignment.pack(*arrays))] == [x.tolist() for x in arrays]


def test_odd_tables(spark):
    assert found(alignment.alignments(empty(spark), A, B)) == []
    odd = [(r.doc_id, r.text) for r in odd_documents(spark).collect()]
    more = odd_documents(spark).withColumn("pair", F.lit(1)).withColumn("UID", F.lit("x")).withColumn("n_a", F.lit(None))
    assert found(alignment.alignments(more, A, B)) == brute_force(odd)
    long = [(1, "word and wörd\n" * 30_000), (2, "word")]
    assert found(alignment.alignments(documents(spark, long), A, B)) == brute_force(long)


@pytest.mark.parametrize("text", [None, "", "a▁b"])
def test_texts_without_tokens(spark, text):
    assert found(alignment.alignments(documents(spark, [(4, text)]), A, B)) == [(4, 0, 0, 0, 0, 0, 0, "")]
