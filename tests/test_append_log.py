import itertools

from loomspan.operators import append_log as log

REQUESTS = "request_id string, arrival long, operation_id string, correlation_id string, event_type string, event_sequence long, event_us long, source_component string, metadata string, schema_version string, " \
    "idempotency_key string, submitted_sha256 string"
KEY = "a" * 64
OPEN = [("operation_created", 1), ("pairing_requested", 2), ("pairing_succeeded", 3)]


def request(arrival, event="operation_created", n=1, us=None, **more):
    base = {"request_id": f"r{arrival}", "arrival": arrival, "operation_id": "operation_1", "correlation_id": "correlation_1", "event_type": event, "event_sequence": n, "event_us": 10 * n if us is None else us,
            "source_component": "collector", "metadata": "{}", "schema_version": "v1", "idempotency_key": KEY, "submitted_sha256": None}
    return tuple((base | more).values())


def outcomes(spark, rows):
    operations = spark.createDataFrame([("operation_1", "correlation_1")], "operation_id string, correlation_id string")
    found = log.appended(spark.createDataFrame(rows, REQUESTS), operations, 1_000, "v1").collect()
    assert len(found) == len(rows)
    return {r.request_id: r for r in found}


def last(spark, *more):
    rows = [request(i, e, n) for i, (e, n) in enumerate(OPEN)]
    return outcomes(spark, rows + [request(10 + i, **x) for i, x in enumerate(more)])[f"r{9 + len(more)}"]


CASES = [

    ({"event": "capture_requested", "n": 4}, "accepted"), ({"event": "pairing_requested", "n": 2}, "replayed"), ({"event": "pairing_requested", "n": 2, "us": 21}, "sequence_conflict"),
    ({"event": "pairing_requested", "n": 2, "idempotency_key": "b" * 64}, "sequence_conflict"), ({"event": "pairing_requested", "n": 2, "submitted_sha256": "c" * 64}, "hash_mismatch"),
    ({"event": "capture_requested", "n": 4, "submitted_sha256": "c" * 64}, "hash_mismatch"), ({"event": "capture_requested", "n": 5}, "out_of_order"),
    ({"event": "capture_completed", "n": 4}, "invalid_transition"), ({"event": "capture_requested", "n": 4, "us": 29}, "backward_time"), ({"event": "capture_requested", "n": 4, "us": 30}, "accepted"),
    ({"event": "capture_requested", "n": 4, "us": 300_001_001}, "future_time"), ({"event": "capture_requested", "n": 4, "us": 300_001_000}, "accepted"),
    ({"operation_id": "operation_none"}, "operation_unknown"), ({"correlation_id": "correlation_none"}, "correlation_mismatch"), ({"schema_version": "v2"}, "schema_unsupported"), ({"n": 0}, "sequence_not_positive"),
    ({"metadata": '{"other":1}'}, "metadata_unsafe"), ({"metadata": "[]"}, "metadata_unsafe"), ({"event": "dance"}, "event_type_unknown"), ({"source_component": "me"}, "component_unknown"),
    ({"idempotency_key": "A" * 64}, "hash_malformed"), ({"operation_id": "x"}, "identifier_malformed"),
]


def test_one_request_after_three_events(spark):
    """Every case has an operation of its own; they are judged together."""
    rows, known = [], []
    for c, (more, _) in enumerate(CASES):
        own = {"operation_id": f"operation_{c:03}", "correlation_id": f"correlation_{c:03}"}
        known.append(tuple(own.values()))
        rows += [request(i, e, n, **own, request_id=f"{c}:{i}") for i, (e, n) in enumerate(OPEN)] + [request(10, **({"request_id": f"{c}:last"} | own | more))]
    found = {r.request_id: r.outcome for r in log.appended(spark.createDataFrame(rows, REQUESTS), spark.createDataFrame(known, "operation_id string, correlation_id string"), 1_000, "v1").collect()}
    assert len(found) == len(rows) and {o for r, o in found.items() if not r.endswith("last")} == {"accepted"}
    assert [(more, found[f"{c}:last"]) for c, (more, _) in enumerate(CASES)] == [(more, outcome) for more, outcome in CASES]


def test_closed_operations_and_replays_in_them(spark):
    assert last(spark, {"event": "operation_canceled", "n": 4}, {"event": "capture_requested", "n": 5}).outcome == "operation_closed"
    assert last(spark, {"event": "operation_canceled", "n": 4}, {"event": "operation_canceled", "n": 4}).outcome == "replayed"


def test_submitted_hashes_of_accepted_events_match(spark):
    first = last(spark, {"event": "capture_requested", "n": 4})
    again = last(spark, {"event": "capture_requested", "n": 4, "submitted_sha256": first.event_sha256})
    assert (again.outcome, again.status, again.event_sha256) == ("accepted", "prepared", first.event_sha256)
    assert last(spark, {"event": "capture_requested", "n": 4}, {"event": "capture_requested", "n": 4}).event_sha256 == first.event_sha256


def test_arrival_decides_and_not_the_row_order(spark):
    rows = [request(i, e, n) for i, (e, n) in enumerate(OPEN)]
    for order in itertools.permutations(rows):
        assert {r.outcome for r in outcomes(spark, list(order)).values()} == {"accepted"}
    late = outcomes(spark, [request(0, *OPEN[1]), request(1, *OPEN[0])])
    assert (late["r0"].outcome, late["r1"].outcome) == ("invalid_transition", "accepted")


def test_requests_for_new_operations(spark):
    schema = "request_id string, operation_id string, correlation_id string, platform string, account_reference string, conversation_reference string, operation_type string, source_component string, parent_operation_id string"
    good = ("g", "operation_1", "correlation_1", "web", "account:1", None, "capture", "collector", None)
    bad = [{"operation_id": "short"}, {"platform": "a/b"}, {"account_reference": "x y"}, {"conversation_reference": "http://x"}, {"operation_type": "other"}, {"operation_type": None}, {"source_component": "me"},
           {"parent_operation_id": "x"}, {"parent_operation_id": "operation_1"}, {"operation_id": "operation_1\n"}]
    names = [x.split(" ")[0] for x in schema.split(", ")]
    rows = [good] + [tuple({**dict(zip(names, good)), "request_id": str(i), **x}.values()) for i, x in enumerate(bad)]
    found = {r.request_id: r.error for r in log.create_errors(spark.createDataFrame(rows, schema)).collect()}
    assert "g" not in found and [found[str(i)] for i in range(len(bad))] == [
        "identifier_malformed", "reference_not_opaque", "reference_not_opaque", "reference_not_opaque", "operation_type_unknown", "operation_type_unknown", "component_unknown", "identifier_malformed", "retries_itself", "identifier_malformed"]


def test_requests_are_shuffled_once_and_narrow(spark):
    """What is read back was judged once: metadata and schema are looked at before any shuffle, and no plan reads a request again."""
    operations = spark.createDataFrame([("operation_1", "correlation_1")], "operation_id string, correlation_id string")
    rows = [request(i, e, n) for i, (e, n) in enumerate(OPEN)] + [request(9, n=1), request(10, n=None, us=5), request(11, n=2, event="pairing_requested", submitted_sha256="c" * 64)]
    found = log.appended(spark.createDataFrame(rows, REQUESTS), operations, 1_000, "v1")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "metadata" not in plan and "MapInPandas" not in plan
    assert {r.request_id: r.outcome for r in found.collect()} == {"r0": "accepted", "r1": "accepted", "r2": "accepted", "r9": "replayed", "r10": "sequence_not_positive", "r11": "hash_mismatch"}
