import random
import re
import struct
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from loomspan.llm import collocations, queries

from .helpers import DOCUMENTS, documents, empty, odd_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(docs, longest=3, least=10, percent=50, top=2000):
    """By counters of whole phrases, from (text, lang) pairs."""
    f = defaultdict(Counter)
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                f[lang or "und"].update(zip(*(words[i:] for i in range(n))))
    out = []
    for lang, count in f.items():
        n = sum(x for p, x in count.items() if len(p) == 1)
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(100 * b >= percent * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            cuts = [(1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n=60, words=7, length=60):
    rng = random.Random(seed)
    own = ["w%d" % i for i in range(words)] + ["É", "The", "the", "日本"]
    return [("".join(rng.choice(own) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ".", "\r\n"]) for _ in range(rng.randrange(length))), rng.choice(["en", "fr", None])) for _ in range(n)]


def table(spark, docs):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(docs)], DOCUMENTS)


@pytest.mark.parametrize("seed, longest, least, percent, top", [(1, 3, 10, 50, 2000), (2, 2, 3, 50, 7), (3, 4, 2, 80, 2000), (4, 3, 2, 1, 20)])
def test_equals_brute_force(spark, seed, longest, least, percent, top):
    docs = corpus(seed)
    assert found(collocations.collocations(table(spark, docs), longest, least, percent, top)) == brute_force(docs, longest, least, percent, top)


def test_many_shards_and_ranges():
    """Tries of many shards merge to the counts of one."""
    docs = corpus(5, n=120, words=5)
    local = collocations._Shard(0)
    blobs = defaultdict(lambda: ([], []))
    for text, lang in docs:
        local.add(pa.array([text]), pa.array([lang]))
        for name, r, words, paths in local.tries(3, 3):
            for blob, held in zip((words, paths), blobs[name, r]):
                if blob is not None:
                    held.append(blob)
        local.clear()
    counts = Counter()
    for (lang, r), (words, paths) in blobs.items():
        _, n, text, _ = collocations._frequent_words(words, 1)
        counts.update({(lang, w): x for w, x in zip(text.to_pylist(), n.tolist())})
        path, size, n = collocations._frequent_paths(paths, 3, 2)
        counts.update({(lang, tuple(int(p[i]) for p in path[:size[i]])): int(x) for i, x in enumerate(n)})
    whole = Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            whole.update((lang or "und", w) for w in words)
            whole.update((lang or "und", p) for k in (2, 3) for p in zip(*(words[i:] for i in range(k))))
    assert {k: v for k, v in counts.items() if isinstance(k[1], str)} == {k: v for k, v in whole.items() if isinstance(k[1], str)}
    assert sorted(v for k, v in counts.items() if not isinstance(k[1], str)) == sorted(v for k, v in whole.items() if not isinstance(k[1], str) and v >= 2)


def test_small_shards_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_WORDS", 50)
    docs = corpus(6)
    assert found(collocations.collocations(table(spark, docs).repartition(7))) == brute_force(docs)


def test_exact_arithmetic_beyond_64_bits(spark):
    a, left, right = 9_876_543_210_123, 99_876_543_210_127, 12_345_678_901_234
    phrases = spark.createDataFrame([("en", [1], left, "x"), ("en", [2], right, "y"), ("en", [1, 2], a, None)], "lang string, path array<long>, f long, word string")
    row = collocations.weakest_cuts(phrases, phrases.where("size(path) > 1")).first()
    assert row.score == 1_000_000 * a * a // (left * right) and (row.l, row.r) == (left, right)


def test_two_words_of_one_hash_fail():
    def blob(w):
        return struct.pack("<IQII", 1, 7, 3, len(w)) + w

    assert collocations._frequent_words([blob(b"one"), blob(b"one")], 5)[1].tolist() == [6]
    with pytest.raises(ValueError, match="another seed"):
        collocations._frequent_words([blob(b"one"), blob(b"two")], 5)


def test_odd_tables(spark):
    assert found(collocations.collocations(empty(spark))) == []
    odd = [(r.text, r.lang) for r in odd_documents(spark).collect()]
    assert found(collocations.collocations(odd_documents(spark), least=1)) == brute_force(odd, least=1)
    docs = [("Of the of the. of the", "en")] * 5 + [("Of the of the. of the", "und")] * 4 + [("Of the of the. of the", None)] * 3
    more = table(spark, docs).withColumn("phrase", collocations.F.lit("x")).withColumn("path", collocations.F.lit(1)).withColumn("A", collocations.F.lit(1))
    assert found(collocations.collocations(more)) == brute_force(docs)
    long = [("ab cd " * 200_000, "en")]
    assert found(collocations.collocations(table(spark, long))) == brute_force(long)


def test_phrases_of_two_words_at_least(spark):
    with pytest.raises(ValueError):
        collocations.collocations(documents(spark, ["x"]), longest=1)


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLES["op13_collocations"])
    assert want.columns == queries.QUERIES["op13_collocations"](spark, sf).columns
    assert found(queries.QUERIES["op13_collocations"](spark, sf)) == sorted(want.fetchall()) != []
