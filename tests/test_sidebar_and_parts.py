import random

import pytest

from loomspan.operators import accumulator, halving, sidebar

PASSES = "inventory_id string, pass long, scroll_top long, scroll_height long, client_height long"
SEEN = "inventory_id string, pass long, place_in_pass long, identity string, title string, source_url string, order_hint long"


def parts(spark, sizes, bound, depth=32):
    rows = halving.split(spark.createDataFrame([("c", i, n) for i, n in enumerate(sizes)], "conversation_id string, sequence long, size long"), bound, depth).collect()
    return [(r.sequence, r.part_ref.replace("chunk0001", "").replace("__sub000", ""), r.part_size, r.status) for r in sorted(rows, key=lambda r: r.sequence)]


@pytest.mark.parametrize("sizes, bound, want", [
    ([5, 5], 10, [(0, "", 10, "fits"), (1, "", 10, "fits")]),
    ([5, 6], 10, [(0, "1", 5, "fits"), (1, "2", 6, "fits")]),
    ([99], 10, [(0, "", 99, "single_message")]),
    ([1, 99], 10, [(0, "1", 1, "fits"), (1, "2", 99, "single_message")]),
    ([0, 0, 50], 10, [(0, "1", 0, "fits"), (1, "1", 0, "fits"), (2, "2", 50, "single_message")]),
    ([50, 0, 0], 10, [(0, "1", 50, "single_message"), (1, "2", 0, "fits"), (2, "2", 0, "fits")]),
    ([], 10, []),
])
def test_small_parts(spark, sizes, bound, want):
    assert parts(spark, sizes, bound) == want


def test_every_message_once_and_no_part_over_the_bound(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 7, 30, 120]) for _ in range(90)]
    found = parts(spark, sizes, 60)
    assert [s for s, *_ in found] == list(range(90))
    held = {}
    for s, ref, size, status in found:
        held.setdefault((ref, size, status), []).append(s)
    for (_, size, status), members in held.items():
        assert members == list(range(members[0], members[-1] + 1)) and sum(sizes[m] for m in members) == size
        assert size <= 60 if status == "fits" else status == "single_message" and len(members) == 1


def test_depth_limit(spark):
    assert {x[3] for x in parts(spark, [10] * 64, 10, 2)} == {"split_depth_limit"} and len({x[1] for x in parts(spark, [10] * 64, 10, 2)}) == 4


def test_merge_prefixes_and_drops_open_links(spark):
    o = spark.createDataFrame([("c", "p1", "a"), ("c", "p1", "b"), ("c", "p2", "a")], "conversation_id string, part_ref string, ref string")
    k = spark.createDataFrame([("c", "p1", "a", "b"), ("c", "p1", "a", "z"), ("c", "p2", "a", "b")], "conversation_id string, part_ref string, from_ref string, to_ref string")
    refs, links = halving.merged(o, k)
    assert sorted(r.ref for r in refs.collect()) == ["p1__a", "p1__b", "p2__a"] and [(r.from_ref, r.to_ref) for r in links.collect()] == [("p1__a", "p1__b")]


def look(passes, rows, height=3):
    """The rows that each pass shows."""
    return [("i", p, i - top, rows[i], "t" + rows[i], "u", i) for p, top in enumerate(passes) for i in range(top, min(len(rows), top + height))]


def check(spark, passes, seen, n, height=3):
    told = spark.createDataFrame([("i", p, 10 * top, 10 * n, 10 * height) for p, top in enumerate(passes)], PASSES)
    r = sidebar.inventory(told, spark.createDataFrame(seen, SEEN)).first()
    return r.status, r.n_rows, r.warnings


UNSTABLE = ["earliest_sidebar_boundary_not_verified", "sidebar_scrolling_did_not_stabilize", "sidebar_observation_count_did_not_stabilize"]


@pytest.mark.parametrize("passes, warnings", [
    ([1, 0, 0, 2, 3, 3, 3, 3, 3, 1], []),
    ([1, 0, 0, 2, 3, 3, 3, 3, 1], UNSTABLE),
    ([1, 0, 0, 2, 3, 3, 3, 2, 3, 3, 3, 1], UNSTABLE),
    ([1, 1, 0, 2, 3, 3, 3, 3, 3, 1], ["latest_sidebar_boundary_not_reached"]),
    ([1, 0, 0, 2, 3, 3, 3, 3, 3, 3], ["initial_sidebar_position_not_restored"]),
])
def test_boundaries(spark, passes, warnings):
    rows = list("abcdef")
    assert check(spark, passes, look(passes, rows), 6) == ("needs_review" if warnings else "complete", 6, warnings)


def test_late_rows_and_collisions(spark):
    passes, rows = [1, 0, 0, 2, 3, 3, 3, 3, 3, 1], list("abcdef")
    seen = look(passes, rows)
    late = seen + [("i", 7, 9, "late", "t", "u", 9)]
    assert check(spark, passes, late, 6)[2] == UNSTABLE
    other = [(*x[:4], "other" if x[3] == "d" and x[1] == 4 else x[4], *x[5:]) for x in seen]
    assert check(spark, passes, other, 6)[2] == ["conversation_identity_collisions:1"]
    assert check(spark, passes, [("i", 0, 0, "", "t", "u", 0)], 6)[2] == ["no_conversation_rows_observed"]


def test_any_cut_into_overlapping_windows_gives_the_list_back(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for c in range(60):
        names = [f"r{i}" for i in range(rng.randrange(1, 40))]
        rng.shuffle(names)
        windows, at = [], 0
        while True:
            end = min(len(names), at + rng.randrange(2, 9))
            windows.append(names[at:end])
            if end == len(names):
                break
            at = rng.randrange(at + 1, end)  # the next one shares at least one row
        rng.shuffle(windows)
        want[f"c{c}"] = names
        rows += [(f"c{c}", v, p, k) for v, w in enumerate(windows) for p, k in enumerate(w)]
    found = accumulator.ordered(spark.createDataFrame(rows, "conversation_id string, view long, place long, key string")).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.sequence):
        got.setdefault(r.conversation_id, []).append(r.key)
    assert got == want and all(r.resolved for r in found)
