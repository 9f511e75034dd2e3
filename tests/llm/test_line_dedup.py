import random
import re

import pytest
from pyspark.sql import functions as F

from loomspan.llm import line_dedup, queries, simhash

from .helpers import documents, empty, odd_documents

WORD = re.compile(r"[^\W_]+")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def fingerprints(spark, lines):
    """SimHashes of lines, as simhash makes them for the operators that use it."""
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", simhash.of_words(F.array_distinct(F.split("line", " "))).alias("fp")).collect()
    return {r.line: r.fp for r in rows}


def brute_force(docs):
    """Which (doc_id, line number) go: all pairs of distinct normalised lines, by edit similarity alone."""
    at = {}
    for i, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            if words := " ".join(WORD.findall(line.lower())):
                at.setdefault(words, []).append((i, k))
    parent = {x: x for x in at}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(at)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            most = max(len(a), len(b)) // 10
            if abs(len(a) - len(b)) <= most and levenshtein(a, b) <= most:
                parent[root(a)] = root(b)
    groups = {}
    for x, places in at.items():
        groups.setdefault(root(x), []).extend(places)
    return {p for places in groups.values() for p in places if p != min(places)}


def got(df):
    return {(r.doc_id, r.line_no) for r in line_dedup.repeated_lines(df).collect()}


def planted(n):
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + i % 26)}{i}" for i in range(300)]
    base = [rng.choices(vocabulary, k=rng.randrange(3, 40)) for _ in range(6)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(3):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(words))
                words[at] = words[at][:-1] + rng.choice("xyz")
            lines.append(rng.choice([" ", ", ", "  - "]).join(words).title())
        docs.append((i * 2 - 9, "\n".join([*lines, "", "own line " + " ".join(rng.choices(vocabulary, k=8)), "---"])))
    return docs


@pytest.mark.parametrize("short", [8, 2])
def test_planted_lines_equal_brute_force(spark, short, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHORT", short)
    docs = planted(45)
    want = brute_force(docs)
    assert got(documents(spark, docs)) == want and len(want) > 30


def test_query_gives_texts_without_the_lines(spark, sf):
    docs = documents(spark, planted(12))
    gone = got(docs)
    for r in line_dedup.dedup_lines(docs).collect():
        text = dict(planted(12))[r.doc_id].split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(text) if (r.doc_id, k) not in gone)
        assert r.n_lines == len(text) and r.n_removed == sum(i == r.doc_id for i, _ in gone)
    assert queries.op3_line_dedup(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_odd_tables(spark):
    rows = line_dedup.dedup_lines(odd_documents(spark)).collect()
    assert len(rows) == 8 and all(r.n_removed == 0 for r in rows) and {r.text for r in rows} == {r.text for r in odd_documents(spark).collect()}
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    docs = documents(spark, [(1, "a b\n\n---\nA, b!"), (2, "c\na b\n---"), (2, "c\na b\n---"), (None, "a b")]).withColumn("n_lines", F.lit("clash"))
    assert sorted((r.doc_id or 0, r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()) == [
        (0, "a b", 0), (1, "a b\n\n---", 1), (2, "c\n---", 1), (2, "c\n---", 1)]


def test_edits_equal_the_distance_of_whole_lines(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(150):
        a = rng.choices(["a", "bb", "ccc", "ab"], k=rng.randrange(1, 9))
        b = list(a)
        for _ in range(rng.randrange(4)):
            b[rng.randrange(len(b)):][:1] = []
            at = rng.randrange(len(b) + 1)
            b = rng.choice([b[:at] + ["bb"] + b[at:], b[:at] + b[at + 1:] or ["a"], b[:at] + ["cc"] + b[at + 1:]])
        rows.append((a, b, rng.randrange(0, 6)))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, most int")
    for r in df.select("a", "b", "most", line_dedup._edits(F.col("a"), F.col("b"), F.col("most")).alias("d")).collect():
        d = levenshtein(" ".join(r.a), " ".join(r.b))
        assert r.d == (d if d <= r.most else -1), r


def test_fingerprints_equal_counting(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(50)]
    rows = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(50)]
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for line, fp in fingerprints(spark, rows).items():
        own = [hashes[w] for w in dict.fromkeys(line.split())]
        assert fp == sum(1 << i for i in range(63) if 2 * sum(h >> i & 1 for h in own) > len(own))


def test_blocks_meet_all_within_the_radius(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(63)
        b = a
        for bit in rng.sample(range(63), 3):
            b ^= 1 << bit
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a long, b long").select(*[simhash.block_keys(F.col(c), 5, 2).alias(c) for c in "ab"])
    assert df.where(~F.arrays_overlap("a", "b")).count() == 0


def test_rows_of_one_id_with_other_texts_keep_their_own_lines(spark):
    docs = documents(spark, [(0, "foo bar baz qux"), (1, "foo bar baz qux"), (1, "wholly different unique words"), (1, "wholly different unique words")])
    rows = sorted((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect())
    assert rows == [(0, "foo bar baz qux", 0), (1, "", 1), (1, "wholly different unique words", 0), (1, "wholly different unique words", 0)]


def test_clashing_columns_and_long_texts(spark):
    rng = random.Random(6)
    long = "\n".join(" ".join(f"{rng.getrandbits(40):x}" for _ in range(8)) for _ in range(4000))
    docs = documents(spark, [(1, long), (2, "a last line, all alone"), (3, long.split("\n")[5].upper() + "\nown")])
    for name in ("_id", "_gone", "tag", "lines", "node", "c0"):
        docs = docs.withColumn(name, F.lit("kept"))
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert rows[3].text == "own" and rows[2].n_removed == 0 and rows[1].n_lines == 4000
    assert all(r[name] == "kept" for r in rows.values() for name in ("_id", "_gone", "tag", "lines", "node", "c0"))


def test_counts_of_letters_rule_out_no_similar_lines(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        a = "".join(rng.choices("etaoin shrdlu19éz", k=rng.randrange(10, 400))).strip() or "x"
        b = list(a)
        for _ in range(max(len(a), 1) // 10):
            at = rng.randrange(len(b))
            rng.choice([lambda: b.__setitem__(at, rng.choice("etzq7é")), lambda: b.insert(at, "e"), lambda: b.pop(at)])()
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    sides = df.select("a", "b", *[F.length(c).alias(f"{c}_letters") for c in "ab"],
                      *[x.alias(f"{c}_{n}") for c in "ab" for x, n in zip(line_dedup._signs(F.col(c)), line_dedup._SIGNS)])
    pieces = line_dedup._pieces_missing(F.col("a"), F.col("b"))
    for r in sides.select("a", "b", (line_dedup._may_link("a_", "b_") & (pieces <= F.floor(F.greatest("a_letters", "b_letters") / 10))).alias("may")).collect():
        assert r.may or levenshtein(r.a, r.b) > max(len(r.a), len(r.b)) // 10
