import random

from pyspark.sql import functions as F

from loomspan.llm import bitmap
from loomspan.llm.components import components, joined


def brute_force(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def got(df):
    return {r.node: r.component for r in df.collect()}


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    edges += [(7, 7), (None, 3), (2, None), (101, 100)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert got(components(df)) == brute_force(edges)
    first = components(df)
    more = [(160, 500), (1, 2)]
    assert got(components(joined(first, spark.createDataFrame(more, "a long, b long")))) == brute_force(edges + more)
    assert components(df.limit(0)).count() == 0


def test_bitmaps_lose_no_key(spark):
    keys = spark.range(0, 3000, 7).select(F.col("id").alias("k"))
    kept = {r.k for r in bitmap.keep(spark.range(3000).select(F.col("id").alias("k")), "k", bitmap.build(keys, "k", 20), 20).collect()}
    assert {r.k for r in keys.collect()} <= kept and len(kept) < 600
    assert bitmap.keep(keys, "k", bitmap.build(keys.limit(0), "k", 20), 20).count() == 0
