import random
from datetime import datetime, timedelta

import pytest

from loomspan import registry
from loomspan.operators import intents
from loomspan.plans import intent_queries
from loomspan.streaming import intent_stream

PATH = ("create", "verify", "confirm", "begin", "archive_written", "archive_verified", "comparing", "catalog_committed", "complete")


def command(workflow, n, at, intent, kind, identity="p/a/c", exact=True, reason="user"):
    known = kind in (*intents.FOUND, "create")
    return workflow, n, at, intent, kind if known else "checkpoint", identity, exact, None if known else kind, reason


def outcomes(spark, rows, now=10**9):
    return {(r.n, r.intent_id): (r.state, r.error) for r in intents.fold(spark.createDataFrame(rows, intents.COMMANDS), now).collect()}


def test_whole_path_and_repeats(spark):
    rows = [command("w", n, 100 + n, "i", kind) for n, kind in enumerate(PATH)]
    found = outcomes(spark, rows + rows[2:5])
    want = ["awaiting_manual_open", "awaiting_capture_confirmation", "authorized", "capturing", *PATH[4:]]
    assert [found[n, "i"] for n in range(9)] == [(s, None) for s in want]


@pytest.mark.parametrize("rows, want", [
    ([("verify", {})], (None, "unknown_intent")),
    ([("create", {}), ("create", {})], ("awaiting_manual_open", "intent_exists")),
    ([("create", {}), ("begin", {})], ("awaiting_manual_open", "prohibited_from_awaiting_manual_open")),
    ([("create", {}), ("verify", {"identity": "p/a/other"})], ("awaiting_manual_open", "identity_mismatch")),
    ([("create", {}), ("verify", {}), ("confirm", {"exact": False})], ("awaiting_capture_confirmation", "confirmation_required")),
    ([("create", {}), ("cancel", {"reason": "  "})], ("awaiting_manual_open", "reason_required")),
    ([("create", {}), ("cancel", {})], ("cancelled", None)),
    ([("create", {}), ("cancelled", {})], ("cancelled", None)),
    ([("create", {}), ("verify", {}), ("confirm", {}), ("begin", {"identity": "x"})], ("authorized", "identity_mismatch")),
    ([("create", {}), ("verify", {}), ("confirm", {}), ("begin", {}), ("failed", {}), ("complete", {})], ("failed", "prohibited_from_failed")),
    ([("create", {}), ("verify", {}), ("verify", {})], ("awaiting_capture_confirmation", None)),
])
def test_refusals(spark, rows, want):
    told = [command("w", n, 100 + n, "i", kind, **more) for n, (kind, more) in enumerate(rows)]
    assert outcomes(spark, told)[len(rows) - 1, "i"] == want


def test_time_to_live_and_cooldown(spark):
    used = [command("w", n, n, "a", kind) for n, kind in enumerate(PATH[:4])]
    rows = used + [command("w", 4, 3, "b", "create"), command("w", 5, 4, "b", "verify"), command("w", 6, 32, "b", "confirm"), command("w", 7, 33, "b", "confirm"),
                   command("w", 8, 904, "b", "begin"), command("w", 9, 905, "c", "create")]
    found = outcomes(spark, rows, 1806)
    assert found[6, "b"] == ("awaiting_capture_confirmation", "cooldown_active") and found[7, "b"] == ("authorized", None)
    assert found[8, "b"] == ("expired", "prohibited_from_expired") and found[None, "b"] == ("expired", None)
    assert found[None, "c"] == ("expired", None) and (None, "a") not in found
    assert (None, "c") not in outcomes(spark, rows, 1805)
    states = {r.intent_id: (r.state, r.refused) for r in intents.states(intents.fold(spark.createDataFrame(rows, intents.COMMANDS), 1806)).collect()}
    assert states == {"a": ("capturing", 0), "b": ("expired", 2), "c": ("expired", 0)}


def random_commands(seed, workflows=12, n=60):
    rng = random.Random(seed)
    rows = []
    for w in range(workflows):
        at = 10_000
        for i in range(n):
            at += rng.choice([1] * 40 + [2, 600])
            kind = PATH[min(8, i % 18 // 2)] if rng.random() < 0.85 else rng.choice([*intents.FOUND, *intents.CHECKPOINTS])
            rows.append(command(f"w{w}", i, at, f"i{i // 18}-{i % 2}", kind, rng.choice(["p/a/c"] * 9 + ["x"]), rng.random() < 0.9, rng.choice(["r", "r", ""])))
    return rows


def test_replayed_stream_equals_the_fold(spark, tmp_path):
    """Files of ten minutes each; some commands come a file late, some again."""
    rng, late = random.Random(3), 600
    rows = random_commands(5)
    files = {}
    for r in rows:
        k = (r[2] - 10_000) // late + (rng.random() < 0.2)
        files.setdefault(k, []).append(r)
        if rng.random() < 0.2:
            files[k].append(r)
    for k in sorted(files):
        rng.shuffle(files[k])
        spark.createDataFrame(files[k], intents.COMMANDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(intents.COMMANDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with intent_stream.rocksdb(spark):
        intent_stream.outcome_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")) \
            .trigger(availableNow=True).start().awaitTermination()
    now = max(r[2] for r in rows) - late
    found = sorted(map(tuple, spark.read.schema(intents.OUTCOMES).parquet(str(tmp_path / "out")).collect()), key=repr)
    assert found == sorted(map(tuple, intents.fold(spark.createDataFrame(rows, intents.COMMANDS), now).collect()), key=repr)
    assert {r[5] for r in found} >= {"expired", "cancelled", "authorized", "capturing"} and {r[6] for r in found} >= {"cooldown_active", "identity_mismatch", "confirmation_required"}


def test_batches_of_the_streamed_query_do_not_grow_with_its_time(spark, tmp_path, monkeypatch):
    """Two users over some twenty files of ten minutes: as many runs as stated, and the outcomes of the fold."""
    rows = [(i, i % 2, datetime(2024, 1, 1) + timedelta(seconds=i)) for i in range(800)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(intent_queries, "new_path", lambda spark, name: f"{tmp_path}/{name}")
    found = registry.QUERIES["i23_streamed_intents"](spark, str(tmp_path)).collect()
    assert len(list(tmp_path.glob("intent-stream/in/slot=*"))) > 10
    assert len([x for x in (tmp_path / "intent-stream/state/offsets").iterdir() if x.name.isdigit()]) <= 2 * 3
    want = registry.QUERIES["i23_intent_outcomes"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, want), key=repr)
