import random

import pandas as pd
import pytest

from loomspan.operators import accumulator

SCHEMA = "conversation_id string, view long, place long, key string, observed_s long, representations array<struct<kind string, sha256 string>>"


def kahn(views):
    """One conversation's order by a plain priority queue over all messages, from lists of keys."""
    index, edges = {}, set()
    for view in views:
        for k in view:
            if k:
                index.setdefault(k, len(index))
        edges |= {(a, b) for a, b in zip(view, view[1:]) if a and b and a != b}
    waits = {k: sum(b == k for _, b in edges) for k in index}
    done = []
    ready = [k for k in index if waits[k] == 0]
    while ready:
        ready.sort(key=index.get)
        k = ready.pop(0)
        done.append(k)
        for a, b in edges:
            if a == k:
                waits[b] -= 1
                if waits[b] == 0:
                    ready.append(b)
    return done, [k for k in index if k not in done]


def table(spark, conversations):
    rows = [(c, v, p, k, v, []) for c, views in conversations.items() for v, view in enumerate(views) for p, k in enumerate(view)]
    return spark.createDataFrame(rows, SCHEMA)


def order(spark, conversations):
    rows = accumulator.ordered(table(spark, conversations).select("conversation_id", "view", "place", "key")).collect()
    out = {c: ([], []) for c in conversations}
    for r in sorted(rows, key=lambda r: r.sequence):
        out[r.conversation_id][not r.resolved].append(r.key)
    assert {c: sorted(r.sequence for r in rows if r.conversation_id == c) for c in conversations} == {c: list(range(len({k for v in views for k in v if k}))) for c, views in conversations.items()}
    return out


def random_views(rng):
    """Windows of a list, scrolled up, down and about, some with neighbours that are in the wrong order or missing."""
    names = [f"m{i}" for i in range(rng.randrange(1, 25))]
    rng.shuffle(names)
    views = []
    for _ in range(rng.randrange(1, 12)):
        at = rng.randrange(len(names))
        view = names[at:at + rng.randrange(1, 8)]
        fault = rng.random()
        if fault < 0.12:
            rng.shuffle(view)
        elif fault < 0.2:
            view.insert(rng.randrange(len(view) + 1), rng.choice(["", None, rng.choice(names)]))
        views.append(view)
    return views


def test_order_equals_a_plain_queue(spark):
    rng = random.Random(8)
    conversations = {f"c{i}": random_views(rng) for i in range(150)}
    found = order(spark, conversations)
    for c, views in conversations.items():
        assert found[c] == kahn(views), views
    assert sum(bool(x[1]) for x in found.values()) > 20  # cycles are among them


@pytest.mark.parametrize("views, done, stuck", [
    ([["d", "e", "f"], ["c", "d"], ["a", "b", "c"]], "abcdef", ""),
    ([["a", "b"], ["b", "a"], ["c", "d"]], "cd", "ab"),
    ([["a", "b", "c"], ["c", "a"], ["c", "d", "e"], ["x", "e"]], "x", "abcde"),
    ([["a", "b", "c"], ["c", "b"], ["a", "z"]], "az", "bc"),
    ([["a", "a", "b"]], "ab", ""),
    ([["a", "", "b"], ["b", "a"]], "ba", ""),
    ([["only"]], ["only"], ""),
])
def test_small_cases(spark, views, done, stuck):
    assert order(spark, {"c": views})["c"] == (list(done), list(stuck)) == kahn(views)


def test_long_scroll_is_few_runs(spark):
    """A list of 3,000 scrolled up from its end: no task orders more than the runs of a block."""
    names = [f"m{i:05}" for i in range(3000)]
    views = [names[i:i + 40] for i in range(2960, -1, -30)] + [names[:40]]
    t = table(spark, {"c": views})
    messages = accumulator.numbered(t)
    runs = accumulator._runs(messages, accumulator.neighbours(t, messages))
    assert runs.select("run").distinct().count() <= 2 * len(views)
    assert order(spark, {"c": views})["c"] == (names, [])


def test_times_and_drift(spark):
    one, two = [("text", "1"), ("html", "h")], [("text", "2"), ("html", "h")]
    rows = [("c", 0, 0, "a", 50, one), ("c", 1, 0, "a", 40, one), ("c", 2, 0, "a", 50, two), ("c", 0, 1, "b", 50, one), ("c", 1, 1, "b", 40, one[:1]), ("c", 0, 2, "d", 50, []), ("c", 1, 2, "d", 50, [])]
    found = {r.key: r for r in accumulator.accumulated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (found["a"].observation_count, found["a"].first_observed, found["a"].last_observed) == (2, 50, 40)
    assert [found[k].drift_kinds for k in "abd"] == [["text"], ["html"], []]
    codes = {(r.code, r.key) for r in accumulator.warnings(accumulator.accumulated(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert codes == {("representation_drift", "a"), ("representation_drift", "b")}


def test_empty(spark):
    assert accumulator.accumulated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_blocks_are_ordered_in_one_stream():
    """A block goes on in the next batch of rows; the next block's runs have numbers of their own."""
    rows = [("a", 0, 0, [2]), ("a", 0, 2, [1]), ("a", 0, 1, []), ("a", 5, 5, [6]), ("a", 5, 6, [5]), ("b", 0, 0, [])]
    frames = [pd.DataFrame(part, columns=["conversation_id", "block", "run", "after"]) for part in (rows[:2], rows[2:4], rows[4:])]
    found = [(c, r, None if pd.isna(p) else p) for f in accumulator._kahn(iter(frames)) for c, r, p in f.itertuples(index=False)]
    assert found == [("a", 0, 0), ("a", 2, 1), ("a", 1, 2), ("a", 5, None), ("a", 6, None), ("b", 0, 0)]
