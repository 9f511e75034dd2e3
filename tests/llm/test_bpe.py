import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomspan.llm import bpe, elias_fano, queries, token_files
from loomspan.llm.arrowtext import text_bytes

from .helpers import documents, empty, odd_documents

ODD = ["", "a", "<|endoftext|>", " <|endoftext|><|endoftext|> x", "aaaa" * 50, "A" * 3000, " " * 50, "foo\xa0 bar", "x\x1cy \x1cz"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def random_texts(n):
    letters = list(" \n\t\r\x0b\x1c\x85\xa0 　áß日本'sS12½²٣!?-_\U0001F600é́") + ["<|endoftext|>", "  ", "'ll", "the"]
    rng = random.Random(7)
    return ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(n)]


def test_encoder_equals_the_library(library):
    texts = random_texts(1500) + ODD
    own = bpe.ByteBpe(queries.tokenizer_path())
    ids, ptr = own.encode_batch(*text_bytes(pa.array(texts)))
    for i, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        mine = ids[ptr[i]:ptr[i + 1]]
        assert mine.tolist() == want.ids, texts[i]
        assert own.decode_bytes(mine)[0].tobytes().decode("utf-8", "replace") == library.decode(want.ids, skip_special_tokens=False)


def test_hash_collisions_do_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "mix", lambda x: x % np.uint64(3))
    texts = ["one two three", "four five two one"]
    ids, ptr = bpe.ByteBpe(queries.tokenizer_path()).encode_batch(*text_bytes(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:])] == [library.encode(t).ids for t in texts]


def test_forgetting_does_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    own = bpe.ByteBpe(queries.tokenizer_path())
    for text in random_texts(40):
        ids, _ = own.encode_batch(*text_bytes(pa.array([text])))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_op9_query_equals_the_library(spark, sf, library):
    rows = queries.op9_bpe(spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_of_odd_tables(spark):
    rows = bpe.digests(odd_documents(spark), queries.tokenizer_path()).collect()
    assert len(rows) == 8 and sum(r.n_tokens == 0 and r.ids_sha256 == sha("") for r in rows) == 3
    assert bpe.digests(empty(spark), queries.tokenizer_path()).count() == 0
    clash = documents(spark, ["one"]).selectExpr("doc_id", "text", "1 as IDS", "2 as Decoded")
    both = bpe.decode(bpe.encode(clash, queries.tokenizer_path()), queries.tokenizer_path()).collect()
    assert both[0].decoded == "one"


def test_elias_fano_selects_what_was_stored():
    rng = np.random.default_rng(3)
    for n, top in [(0, 1), (1, 1), (1, 10**12), (5000, 10), (5000, 10**6), (3, 2**63), (10_000, 2**40)]:
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        code = elias_fano.encode(values)
        found = elias_fano.EliasFano(b"xx" + code, 2)
        assert found.size == len(code)
        assert np.array_equal(found.get(np.arange(n)), values)
        if n > 1000:
            assert len(code) * 8 <= n * (2 + max(0, np.log2(top / n))) + n + 4096


def test_op10_query_equals_the_library(spark, sf, library):
    rows = {r.doc_id: r for r in queries.op10_token_files(spark, sf).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        mine = rows.pop(r.doc_id)
        assert (mine.start, mine.n_tokens, mine.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not rows


def test_token_files_of_odd_tables_and_many_shards(spark, monkeypatch, library):
    path = queries.tokenizer_path()
    found = token_files.read_token_files(token_files.write_token_files(odd_documents(spark), path)).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, None, 1, 2, 3, 4, 4, 5]
    assert found[2].ids == [2] and found[5].ids == found[6].ids == library.encode("one two").ids + [2]
    assert token_files.read_token_files(token_files.write_token_files(empty(spark), path)).count() == 0
    monkeypatch.setattr(token_files, "SHARD_IDS", 50)
    manifest = token_files.write_token_files(documents(spark, ["some words here"] * 200, first=-5), path)
    rows = token_files.read_token_files(manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == list(range(-5, 195)) and [r.start for r in rows] == [4 * i for i in range(200)]


def test_a_shard_gives_single_documents():
    ids = np.arange(10, dtype=np.int32) + 70_000
    raw = b"".join(token_files.shard_bytes(np.array([-3, 8], np.int64), 1, np.array([0, 2, 2, 10]), ids))
    shard = token_files.Shard(raw)
    assert shard.doc_ids() == [None, -3, 8] and shard.document(2).tolist() == ids[2:].tolist() and len(shard.document(1)) == 0
