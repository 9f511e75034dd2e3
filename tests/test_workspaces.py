import threading

from pyspark.sql import functions as F

from loomspan.operators import workspaces
from loomspan.sinks.versions import Store

KEY = "core:org:01234567-89ab-cdef-0123-456789abcde"


def asked(spark, *rows):
    return spark.createDataFrame([(f"r{i}", i, key, name) for i, (key, name) in enumerate(rows)], "request_id string, place int, external_key string, name string")


def told(df):
    return [(r.name, r.status, r.created, r.error) for r in df.orderBy("request_id").collect()]


def test_first_request_names_the_workspace(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    first = workspaces.ensure(store, "t", asked(spark, (KEY + "0", "one"), (KEY + "0", "two"), (KEY + "1", "three"), (KEY + "X", "no"), (KEY + "2", "a\nb"), (None, None)))
    assert told(first) == [("one", "active", True, None), ("one", "active", False, None), ("three", "active", True, None)] + [(None, None, False, "invalid_body")] * 3
    again = workspaces.ensure(store, "u", asked(spark, (KEY + "0", "other")))
    assert told(again) == [("one", "active", False, None)] and store.table("workspaces").count() == 2


def test_stored_rows_are_verified(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    workspaces.ensure(store, "t", asked(spark, (KEY + "0", "a"), (KEY + "1", "b"), (KEY + "2", "c"), (KEY + "3", "d")))
    rows = {r.name: r.asDict() for r in store.table("workspaces").collect()}
    rows["a"]["status"], rows["b"]["name"], rows["c"]["status"] = "suspended", "changed", "deleted"
    stored = spark.createDataFrame([tuple(x.values()) for x in rows.values()], workspaces.ROW)
    found = workspaces.bound(asked(spark, *((KEY + str(i), "x") for i in range(4))), stored)
    assert told(found) == [("a", "suspended", False, None), (None, None, False, "immutable_workspace_conflict"), (None, None, False, "immutable_workspace_conflict"), ("d", "active", False, None)]


def test_equal_requests_at_once_make_one(spark, tmp_path):
    store, found, start = Store(spark, f"file://{tmp_path}/s"), {}, threading.Barrier(3)

    def run(w):
        start.wait()
        found[w] = told(workspaces.ensure(store, f"w{w}", asked(spark, (KEY + "0", f"n{w}"))))[0]

    threads = [threading.Thread(target=run, args=(w,)) for w in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = store.table("workspaces").collect()
    assert len(rows) == 1 and store.broken().isEmpty() and {x[0] for x in found.values()} == {rows[0].name}


def test_outcomes_are_computed_once(spark, tmp_path):
    """The requests' names are computed for the first of each key, whose filter takes them once more, and for the outcomes, but not again for the rows that are stored."""
    seen = spark.sparkContext.accumulator(0)

    def name(place):
        seen.add(1)
        return f"name {place}"

    requests = asked(spark, *((KEY + str(i % 2), "x") for i in range(6))).withColumn("name", F.udf(name)("place"))
    store = Store(spark, f"file://{tmp_path}/s")
    outcomes = workspaces.ensure(store, "t", requests)
    assert [x[:3] for x in told(outcomes)] == [(f"name {i % 2}", "active", i < 2) for i in range(6)]
    assert seen.value <= 3 * 6 and store.table("workspaces").count() == 2
