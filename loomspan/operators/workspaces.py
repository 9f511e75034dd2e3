"""Workspaces that are made once for every external key, whoever asks first and however often.

A workspace's id, isolation key and hash follow from the key and from the name that the first request gave; later names
change nothing.  A stored row must still have its hash and the identity of its key, else the request is a
conflict; a suspended workspace is as good as an active one.  Requests that ask at once are settled by the
store's journal: the writer that comes second reads again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_object, deterministic_id, idempotency_key, sha256
from ..shared import written
from ..sinks.versions import COMMITTED, CONFLICT, REPLAYED, Store
from .guards import ensure_request_errors

TABLE, NAMESPACE = "workspaces", "workspaces"
STATUSES = ("active", "suspended")
_MADE = ("isolation_key", "idempotency_key")
_COLUMNS = ("workspace_id", "name", "isolation_key", "status", "idempotency_key", "record_sha256")
ROW = ", ".join(f"{c} string" for c in _COLUMNS)


def _identity(df: DataFrame) -> DataFrame:
    key = F.col("external_key")
    told = df.withColumn("workspace_id", deterministic_id("workspace", F.lit(NAMESPACE), key)).withColumn("isolation_key", idempotency_key("workspace_isolation", F.lit(NAMESPACE), key))
    return told.withColumn("idempotency_key", idempotency_key("workspace", F.col("workspace_id"), key))


def record_sha256(name: str = "name"):
    """The hash of a row as it was made: a later status is no part of it."""
    return sha256(canonical_object(workspace_id=F.col("workspace_id"), name=F.col(name), isolation_key=F.col("isolation_key"), status=F.lit("active"), idempotency_key=F.col("idempotency_key")))


def _bound(requests: DataFrame, stored: DataFrame, prefix: str) -> DataFrame:
    """The rows of `bound`, and the whole identity of those that make a workspace.  Identities are hashed once for every key, not for every request."""
    told = requests.withColumn("error", ensure_request_errors(F.col("external_key"), F.col("name"), prefix))
    first = told.where("error is null").groupBy("external_key").agg(F.min_by(F.struct("request_id", "name"), F.struct("place", "request_id")).alias("first"))
    old = stored.select("workspace_id", *(F.col(c).alias(f"old_{c}") for c in _COLUMNS[1:]), (record_sha256() == F.col("record_sha256")).alias("sound"))
    met = told.join(_identity(first).join(old, "workspace_id", "left"), "external_key", "left")
    is_old = F.col("old_name").isNotNull()
    good = F.col("sound") & (F.col("isolation_key") == F.col("old_isolation_key")) & (F.col("idempotency_key") == F.col("old_idempotency_key")) & F.col("old_status").isin(*STATUSES)
    error = F.coalesce("error", F.when(is_old & ~F.coalesce(good, F.lit(False)), "immutable_workspace_conflict"))
    fine = error.isNull()
    created = fine & ~is_old & (F.col("request_id") == F.col("first.request_id"))
    return met.select("request_id", "external_key", F.when(fine, F.col("workspace_id")).alias("workspace_id"), F.when(fine, F.coalesce("old_name", "first.name")).alias("name"),
                      F.when(fine, F.coalesce("old_status", F.lit("active"))).alias("status"), created.alias("created"), error.alias("error"),
                      *(F.when(created, F.col(c)).alias(c) for c in _MADE))


def bound(requests: DataFrame, stored: DataFrame, prefix: str = "core") -> DataFrame:
    """(request_id, external_key, workspace_id, name, status, created, error) of (request_id, place, external_key, name) requests; of a key that is not stored the first sound request makes it."""
    return _bound(requests, stored, prefix).drop(*_MADE)


def ensure(store: Store, transaction_id: str, requests: DataFrame, prefix: str = "core") -> DataFrame:
    """Make the workspaces that are not there yet; the requests' outcomes, which are computed once and written to the shared folder."""
    while True:
        base = store.version()
        known = TABLE in {r.table for r in store.journal().select(F.explode("parts.table").alias("table")).distinct().collect()}
        stored = store.table(TABLE, base) if known else store.spark.createDataFrame([], ROW)
        told = written(_bound(requests, stored, prefix), "ensured")
        rows = told.where("created").withColumn("record_sha256", record_sha256()).select(*_COLUMNS)
        outcome = store.write(f"{transaction_id}:{base}", {TABLE: rows}, base=base).outcome
        if outcome in (COMMITTED, REPLAYED):
            return told.drop(*_MADE)
        if outcome != CONFLICT:
            raise ValueError(f"{transaction_id}: {outcome}")
