import numpy as np
from pyspark.sql import functions as F

from loomspan.llm import hash_forest, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(ids, x, k=5, every=50):
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (x * x[i]).sum(1) / (norm[i] * norm)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(found, want):
    return sum(len({a for a, _ in found.get(q, [])} & {a for a, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_query_has_the_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding is not null").collect()
    want = brute_force(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float))
    found = got(queries.op4_hash_forest(spark, sf))
    assert found.keys() == want.keys() and recall(found, want) >= 0.9
    exact = {(q, a): s for q, w in want.items() for a, s in w}
    assert all(abs(exact.get((q, a), s) - s) < 1e-12 for q, w in found.items() for a, s in w)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def every_50(df):
    return hash_forest.nearest(df, F.col("vec_id") % 50 == 0)


def test_many_equal_vectors_tie_to_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(hash_forest, "LEAST_ROWS", 64)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x[50:300] = x[50]
    found = got(every_50(table(spark, list(enumerate(x.tolist())))))
    want = brute_force(np.arange(400), x.astype(float))
    assert [a for a, _ in found[100]] == [50, 51, 52, 53, 54] and [a for a, _ in found[50]] == [51, 52, 53, 54, 55]
    assert recall(found, want) >= 0.9


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [0.5, 0.5]), (2, None), (3, [0, 0]), (4, [1, None]), (5, [nan, 1]), (6, [inf, 1]), (50, [0, 0]), (100, None),
            (7, [1, 0, 0]), (150, [2, 0, 0]), (None, [1, 0]), (8, []), (1, [0.5, 0.5]), (200, [3e38, 3e38]), (9, [1e-40, 1e-40])]
    found = got(every_50(table(spark, rows)))
    assert {q: sorted(a for a, _ in w) for q, w in found.items()} == {0: [1, 1, 9, 200], 150: [7], 200: [0, 1, 1, 9]}
    assert every_50(table(spark, [])).count() == 0
    assert every_50(table(spark, [(50, [1, 2])])).count() == 0


def test_only_gathered_rows_are_scored():
    """Clusters of near vectors: a search scores a small part of all rows, and finds what brute force finds."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((300, 32))
    x = np.repeat(centres, 20, axis=0) + 0.05 * rng.standard_normal((6000, 32))
    forest = hash_forest.Forest(np.arange(6000), x)
    asked = np.arange(0, 6000, 100)
    query, row, score = forest.search(asked, x[asked], 5)
    assert forest.scored < 0.05 * 6000 * len(asked)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cosines = unit[asked] @ unit.T
    cosines[np.arange(len(asked)), asked] = -2
    want = np.sort(np.argpartition(-cosines, 5, axis=1)[:, :5], axis=1)
    same = sum(len(set(row[query == i]) & set(want[i])) for i in range(len(asked)))
    assert same >= 0.9 * want.size and len(query) == want.size


def test_longest_prefix_and_ranges():
    rng = np.random.default_rng(9)
    forest = hash_forest.Forest(np.arange(500), rng.standard_normal((500, 6)))
    strings = forest.strings(rng.standard_normal((20, 6)))
    own = np.take_along_axis(forest.sorted, np.argsort(forest.order, axis=0), 0)
    longest = forest.longest(strings)
    for i in range(20):
        for t in range(hash_forest.TREES):
            shared = [hash_forest.BITS - int(a ^ strings[i, t]).bit_length() for a in own[:, t]]
            assert longest[i, t] == max(shared)
            first, last = forest.ranges(strings[i:i + 1], 4)
            assert set(forest.order[first[0, t]:last[0, t], t]) == {r for r in range(500) if shared[r] >= 4}
