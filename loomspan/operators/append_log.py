"""The operation log in its strict form: an append is accepted, a replay, or refused for one reason.

Requests of an operation are judged in the order they came in.  Two steps keep memory at one row for each operation:

1. A sorted stream of each operation's requests keeps its status, number and time, and says what is next in line.
2. A request for a number that is taken is compared, by a join, with the event that took it: the same content and key is a
   replay, anything else a conflict.

Both see of a request its hash and what it says of its place; its columns are read once, and what was judged is written once.

An event's hash covers its content, its key and the status it led to.  A sequence is closed by a terminal status.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_object, sha256
from ..shared import written
from .operations import TERMINAL, TRANSITIONS
from .proposals import metadata_faults

# How far ahead a time may be, and the components that send events.
SKEW_US = 300_000_000
COMPONENTS = ("extension_popup", "extension_content", "extension_worker", "collector", "archive", "verifier", "reconciler")
IDENTIFIER, OPAQUE, SHA256 = r"^[a-zA-Z0-9][a-zA-Z0-9._:/-]{7,127}\z", r"^[a-zA-Z0-9][a-zA-Z0-9._:-]{2,255}\z", r"^[a-f0-9]{64}\z"
OPERATION_TYPES = ("capture", "recapture", "pairing")
ACCEPTED, REPLAYED, TAKEN = "accepted", "replayed", "taken"
_CONTENT = ("operation_id", "correlation_id", "event_type", "event_sequence", "event_us", "source_component", "metadata", "schema_version", "idempotency_key")
STATUSES = tuple(dict.fromkeys(to for _, to in TRANSITIONS.values()))
_JUDGED = "request_id string, outcome string, status string, operation_id string, event_sequence long, own binary, key string, meant string"


def event_sha256(status: Column) -> Column:
    """The hash of a request's columns and of the status that the event leads to."""
    return sha256(canonical_object(operation_status=status, **{c: F.col(c).cast("string") for c in _CONTENT}))


def leads_to(event_type: Column) -> Column:
    """The status after an event, whatever the one before; null for unknown events."""
    pairs = chain.from_iterable((F.lit(e), F.lit(to)) for e, (_, to) in TRANSITIONS.items())
    return F.try_element_at(F.create_map(*pairs), event_type)


def _form_error() -> Column:
    """Why the form alone refuses a request, or null; the first that holds."""
    return F.when(F.coalesce(F.col("event_sequence") < 1, F.lit(True)), "sequence_not_positive").when(~F.col("operation_id").rlike(IDENTIFIER) | ~F.col("correlation_id").rlike(IDENTIFIER), "identifier_malformed") \
        .when(~F.col("event_type").isin(*TRANSITIONS), "event_type_unknown").when(~F.col("source_component").isin(*COMPONENTS), "component_unknown") \
        .when(~F.col("idempotency_key").rlike(SHA256) | ~F.coalesce(F.col("submitted_sha256").rlike(SHA256), F.lit(True)), "hash_malformed").when(F.size(metadata_faults("metadata")) > 0, "metadata_unsafe")


def append_errors(requests: DataFrame) -> DataFrame:
    """(request_id, error) of requests whose form alone refuses them; the first that holds."""
    return requests.select("request_id", _form_error().alias("error")).where("error is not null")


def create_errors(requests: DataFrame) -> DataFrame:
    """(request_id, error) of requests for new operations that are refused: identities, types and parents must have their form, and no operation retries itself."""
    bad = F.when(~F.col("operation_id").rlike(IDENTIFIER) | ~F.col("correlation_id").rlike(IDENTIFIER), "identifier_malformed") \
        .when(~F.col("platform").rlike(OPAQUE) | ~F.col("account_reference").rlike(OPAQUE) | ~F.coalesce(F.col("conversation_reference").rlike(OPAQUE), F.lit(True)), "reference_not_opaque") \
        .when(~F.coalesce(F.col("operation_type").isin(*OPERATION_TYPES), F.lit(False)), "operation_type_unknown").when(~F.coalesce(F.col("source_component").isin(*COMPONENTS), F.lit(False)), "component_unknown") \
        .when(~F.coalesce(F.col("parent_operation_id").rlike(IDENTIFIER), F.lit(True)), "identifier_malformed").when(F.col("parent_operation_id") == F.col("operation_id"), "retries_itself")
    return requests.select("request_id", bad.alias("error")).where("error is not null")


def _next_in_line(now_us: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        operation, status, number, at = None, "", 0, None
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False, name=None):
                owner, request, event, n, us, matches, error, own, key, meant = row
                if owner != operation:
                    operation, status, number, at = owner, "", 0, None
                if error is not None:
                    rows.append((request, error, None, None, None, None, None, None))
                    continue
                before, to = TRANSITIONS[event]
                if n <= number:
                    outcome = TAKEN
                elif status in TERMINAL:
                    outcome = "operation_closed"
                elif status not in before:
                    outcome = "invalid_transition"
                elif not matches:
                    outcome = "hash_mismatch"
                elif n != number + 1:
                    outcome = "out_of_order"
                elif at is not None and us < at:
                    outcome = "backward_time"
                elif us > now_us + SKEW_US:
                    outcome = "future_time"
                else:
                    outcome, status, number, at = ACCEPTED, to, n, us
                kept = (owner, n, own, key) if outcome in (ACCEPTED, TAKEN) else (None,) * 4
                rows.append((request, outcome, to if outcome == ACCEPTED else None, *kept, meant if outcome == TAKEN else None))
            out = pd.DataFrame(rows, columns=[x.split(" ")[0] for x in _JUDGED.split(", ")])
            out["event_sequence"] = out["event_sequence"].astype("Int64")
            yield out

    return run


def appended(requests: DataFrame, operations: DataFrame, now_us: int, schema_version: str) -> DataFrame:
    """(request_id, outcome, status, event_sha256) of every request.

    requests has request_id, arrival, submitted_sha256 and an event's columns; operations has operation_id and correlation_id.  Status and hash are those
    of the event that was accepted, now or before; refused requests have none.
    """
    known = operations.select("operation_id", F.col("correlation_id").alias("_correlation"))
    own = event_sha256(leads_to(F.col("event_type")))
    submitted = F.col("submitted_sha256")
    # all that judging needs of a request: its content is its hash, and what it submitted is the status for which that is its hash
    slim = requests.select(
        "request_id", "arrival", "operation_id", "correlation_id", "event_type", "event_sequence", "event_us", "idempotency_key",
        F.coalesce(_form_error(), F.when(F.col("schema_version") != schema_version, "schema_unsupported")).alias("error"),
        F.unhex(own).alias("own"), F.coalesce(submitted == own, F.lit(True)).alias("matches"),
        F.when(submitted.isNotNull(), F.coalesce(*(F.when(submitted == event_sha256(F.lit(s)), s) for s in STATUSES), F.lit(""))).alias("meant"))
    told = slim.join(known, "operation_id", "left").withColumn("error", F.coalesce("error", F.when(F.col("_correlation").isNull(), "operation_unknown")
                                                                                  .when(F.col("_correlation") != F.col("correlation_id"), "correlation_mismatch")))
    line = told.repartition("operation_id").sortWithinPartitions("operation_id", "arrival", "request_id") \
        .select("operation_id", "request_id", "event_type", *(F.when(F.col("error").isNull(), F.col(c)).otherwise(0).alias(c) for c in ("event_sequence", "event_us")), "matches", "error", "own", F.col("idempotency_key").alias("key"), "meant")
    judged = written(line.mapInPandas(_next_in_line(now_us), _JUDGED), "judged")
    taken_by = judged.where(F.col("outcome") == ACCEPTED).select("operation_id", "event_sequence", F.col("own").alias("old"), F.col("key").alias("old_key"), F.col("status").alias("old_status"))
    again = judged.where(F.col("outcome") == TAKEN).drop("status").join(taken_by, ["operation_id", "event_sequence"])
    outcome = F.when(~F.coalesce(F.col("meant") == F.col("old_status"), F.col("meant").isNull()), "hash_mismatch").when((F.col("own") != F.col("old")) | (F.col("key") != F.col("old_key")), "sequence_conflict").otherwise(REPLAYED)
    again = again.withColumn("outcome", outcome)
    replayed = F.col("outcome") == REPLAYED
    return judged.where(F.col("outcome") != TAKEN).select("request_id", "outcome", "status", F.when(F.col("outcome") == ACCEPTED, F.lower(F.hex("own"))).alias("event_sha256")) \
        .unionByName(again.select("request_id", "outcome", F.when(replayed, F.col("old_status")).alias("status"), F.when(replayed, F.lower(F.hex("old"))).alias("event_sha256")))
