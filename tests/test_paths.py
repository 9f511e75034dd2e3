import random

import pytest

from loomspan.operators import paths

SCHEMA = "conversation_id string, node_id string, parent_id string, has_message boolean"


def climb(parent, node):
    """The nodes on the way up, until there is none or one repeats."""
    seen = []
    while node in parent and node not in seen:
        seen.append(node)
        node = parent[node]
    return seen, node in parent


def forest(rng, n):
    return {f"n{i}": rng.choice([None, "gone", *(f"n{rng.randrange(max(1, i))}" for _ in range(8)), f"n{rng.randrange(n)}"]) if i else None for i in range(n)}


@pytest.fixture(scope="module")
def trees(spark):
    rng = random.Random(3)
    found = {f"c{c}": forest(rng, rng.randrange(1, 30)) for c in range(40)} | {"chain": {f"n{i}": f"n{i - 1}" if i else None for i in range(700)}, "circle": {f"n{i}": f"n{(i + 1) % 5}" for i in range(5)}}
    has = {(c, n): rng.random() < 0.4 for c, parent in found.items() for n in parent}
    df = spark.createDataFrame([(c, n, p, has[c, n]) for c, parent in found.items() for n, p in parent.items()], SCHEMA)
    return found, has, df


def test_roots_and_paths(trees):
    found, _, df = trees
    levels = paths.levels(df)
    assert len(levels) <= 11
    rooted = {(r.conversation_id, r.node_id): r.reaches_root for r in paths.rooted(levels).collect()}
    assert rooted == {(c, n): not climb(parent, n)[1] for c, parent in found.items() for n in parent}
    starts = {c: list(parent)[-1] for c, parent in found.items()} | {"none": "n0"}
    start = df.sparkSession.createDataFrame(list(starts.items()), "conversation_id string, node_id string")
    got = {(r.conversation_id, r.node_id) for r in paths.ancestors(levels, start).collect()}
    assert got == {(c, n) for c, parent in found.items() for n in climb(parent, starts[c])[0]}


def test_nearest_messages(trees):
    found, has, df = trees
    got = {(r.conversation_id, r.node_id): r.message_ancestor for r in paths.message_ancestors(df).collect()}
    for (c, n), ancestor in got.items():
        above = climb(found[c], n)[0][1:]
        if not climb(found[c], n)[1]:
            assert ancestor == next((x for x in above if has[c, x]), None), (c, n)
    assert len(got) == len(has)
