import json
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomspan.sinks import versions
from loomspan.sinks.versions import COLLISION, COMMITTED, CONFLICT, DRY_RUN, REPLAYED, Store
from loomspan.streaming import ingest_stream


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_tables_change_together(spark, store):
    assert store.version() == 0 and store.journal().count() == 0
    assert store.write("t1", {"a": rows(spark, 1, 2), "b": rows(spark, 7)}).outcome == COMMITTED
    assert store.write("t2", {"a": rows(spark, 3)}).version == 2
    assert ids(store.table("a")) == [1, 2, 3] and ids(store.table("a", 1)) == [1, 2] and ids(store.table("b")) == [7]
    assert store.broken().collect() == []
    with pytest.raises(ValueError):
        store.table("c")


def test_replay_collision_dry_run_and_stale_base(spark, store):
    first = rows(spark, 1, 2, 3)
    assert store.write("t", {"a": first}, dry_run=True).outcome == DRY_RUN and store.version() == 0
    store.write("t", {"a": first})
    assert store.write("t", {"a": first.repartition(3).orderBy(F.desc("id"))}).outcome == REPLAYED  # other files, the same rows
    assert store.write("t", {"a": rows(spark, 1, 2, 4)}).outcome == COLLISION
    assert store.write("u", {"a": rows(spark, 9)}, base=0).outcome == CONFLICT
    assert store.write("u", {"a": rows(spark, 9)}, base=1).outcome == COMMITTED
    assert ids(store.table("a")) == [1, 2, 3, 9] and store.version() == 2


def test_empty_and_null_rows(spark, store):
    store.write("t", {"a": rows(spark), "b": spark.createDataFrame([(None, None), (None, None)], "id long, v string")})
    assert store.table("a").count() == 0 and store.table("b").count() == 2


def test_failed_task_leaves_no_visible_row(spark, store):
    store.write("t", {"a": rows(spark, 1)})
    bad = spark.range(100, numPartitions=4).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("planted"))).otherwise(F.lit("v")).cast("string").alias("v"))
    with pytest.raises(PySparkException):
        store.write("u", {"b": rows(spark, 5), "a": bad})
    assert ids(store.table("a")) == [1] and store.version() == 1
    with pytest.raises(ValueError):
        store.table("b")
    assert store.vacuum(0) >= 1 and ids(store.table("a")) == [1] and store.broken().collect() == []


def test_of_two_writers_one_wins(spark, store):
    parts = {w: [store.stage(rows(spark, w), "a")] for w in (1, 2)}
    told, start = {}, threading.Barrier(2)

    def write(w):
        start.wait()
        told[w] = store.commit(f"w{w}", parts[w], base=0)

    threads = [threading.Thread(target=write, args=(w,)) for w in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    outcomes = sorted(x.outcome for x in told.values())
    winner = next(w for w, x in told.items() if x.outcome == COMMITTED)
    assert outcomes == [COMMITTED, CONFLICT] and ids(store.table("a")) == [winner]


def test_two_writers_without_a_base_both_get_in(spark, store):
    parts = {w: [store.stage(rows(spark, w), "a")] for w in range(4)}
    threads = [threading.Thread(target=store.commit, args=(f"w{w}", parts[w])) for w in parts]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert ids(store.table("a")) == [0, 1, 2, 3] and store.broken().collect() == []


def test_created_once(tmp_path):
    uri = f"file://{tmp_path}/x/y.json"
    assert versions.create_once(uri, b"1") and not versions.create_once(uri, b"2")
    assert (tmp_path / "x" / "y.json").read_bytes() == b"1" and len(list((tmp_path / "x").iterdir())) == 1


def test_changed_files_and_entries_are_found(spark, store, tmp_path):
    for i in (1, 2, 3):
        store.write(f"t{i}", {"a": rows(spark, i)})
    files = {r.version: r.uri for r in store.journal().select("version", F.explode("parts").alias("p")).select("version", F.concat_ws("/", "p.folder", F.col("p.files")[0]["name"]).alias("uri")).collect()}
    with open(files[3].removeprefix("file://"), "ab") as f:
        f.write(b"x")
    import os
    os.unlink(files[2].removeprefix("file://"))
    entry = tmp_path / "store" / "journal" / f"{1:020d}.json"
    entry.write_text(json.dumps(json.loads(entry.read_text()) | {"transaction_id": "other"}))
    assert sorted((r.code, r.version) for r in store.broken().collect()) == [("file_changed", 3), ("file_missing", 2), ("journal_chain_broken", 2)]


@pytest.mark.parametrize("stop", ["before", "after"])
def test_ingestion_resumes_with_every_chunk_once(spark, store, tmp_path, stop):
    for k in range(4):
        rows(spark, *range(10 * k, 10 * k + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def tables(batch):
        return {"rows": batch, "progress": batch.agg(F.count("*").alias("n"), F.max("id").alias("last"))}

    def run(**hooks):
        stream = spark.readStream.schema("id long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(ingest_stream.exactly_once(store, "in", tables, **hooks)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    def kill(n):
        if n == 2:
            raise RuntimeError("planted")

    with pytest.raises(PySparkException):
        run(**{stop: kill})
    seen = store.version()
    assert seen == {"before": 2, "after": 3}[stop]
    run()
    assert ids(store.table("rows")) == list(range(40)) and store.version() == 4
    assert sorted(r.n for r in store.table("progress").collect()) == [10] * 4 and store.broken().collect() == []


def test_replays_and_collisions_stage_nothing(spark, store, tmp_path):
    assert store.write("t", {"a": rows(spark, 1, 2)}).outcome == COMMITTED
    assert store.write("t", {"a": rows(spark, 2, 1)}) == versions.Outcome(REPLAYED, 1)
    assert store.write("t", {"a": rows(spark, 2, 3)}) == versions.Outcome(COLLISION, 1)
    assert store.write("t", {"b": rows(spark, 1, 2)}).outcome == COLLISION
    assert len(list((tmp_path / "store" / "data").glob("*/*"))) == 1 and ids(store.table("a")) == [1, 2]
