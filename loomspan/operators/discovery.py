"""Integrity of discovery runs, and what their silence means.

A run has containers, items in them, relationships between items, and evidence.  Every rule is a
join or an aggregation by run; issues are (code, record_id, run_id) rows.  That something was not
found is a finding only where the container was enumerated to its end by a verified run: other
absences say why nothing is known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_object, sha256

ABSENT, NOT_OBSERVED, NOT_ATTEMPTED, NO_CONTAINER = "absent", "not_observed", "not_attempted", "container_unknown"


def fingerprint(df: DataFrame) -> Column:
    """The hash of all columns of a row but its fingerprint; arrays count in their order."""
    def plain(c: str, kind: str) -> Column:
        return F.to_json(F.col(c)) if kind.startswith("array") else F.col(c).cast("string")

    return sha256(canonical_object(**{c: plain(c, kind) for c, kind in df.dtypes if c != "observation_fingerprint"}))


def snapshot(runs: DataFrame, *parts: DataFrame) -> DataFrame:
    """(run_id, snapshot_sha256): the hash of a run's own columns and, for every part, of its number of rows and the sum of their hashes."""
    told = runs
    for i, part in enumerate(parts):
        sums = part.groupBy("run_id").agg(F.concat_ws(":", F.count("*"), F.sum(F.xxhash64(*sorted(part.columns)).cast("decimal(38,0)"))).alias(f"part_{i}"))
        told = told.join(sums, "run_id", "left")
    return told.select("run_id", sha256(canonical_object(**{c: (F.to_json(c) if kind.startswith("array") else F.col(c).cast("string")) for c, kind in told.dtypes if c != "snapshot_sha256"})).alias("snapshot_sha256"))


def verified_complete(runs: DataFrame, containers: DataFrame) -> DataFrame:
    """(run_id, verified): complete, without a warning, both ends reached, stable, and every container enumerated to its end."""
    open_ = containers.where("enumeration_status <> 'complete'").select("run_id").distinct().withColumn("open", F.lit(True))
    good = (F.col("status") == "complete") & (F.size("warnings") == 0) & F.col("start_reached") & F.col("end_reached") & F.col("traversal_stabilized") & F.col("count_stabilized") & F.col("open").isNull()
    return runs.join(open_, "run_id", "left").select("run_id", F.coalesce(good, F.lit(False)).alias("verified"))


def _told(df: DataFrame, code: str, record_id: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), record_id.alias("record_id"), "run_id")


def _repeated(df: DataFrame, key: str, code: str) -> DataFrame:
    """Each row of a key after its first is one issue."""
    n = df.groupBy("run_id", key).agg(F.count("*").alias("n")).where("n > 1")
    return _told(n.select("run_id", key, F.explode(F.sequence(F.lit(2), F.col("n").cast("int")))), code, F.col(key))


def _missing_evidence(df: DataFrame, key: str, evidence: DataFrame) -> DataFrame:
    cited = df.select("run_id", key, F.explode("evidence_ids").alias("evidence_id"))
    return _told(cited.join(evidence.select("run_id", "evidence_id").distinct(), ["run_id", "evidence_id"], "left_anti"), "missing_evidence", F.concat_ws(":", key, "evidence_id"))


def _unresolved(df: DataFrame, key: str, reference: str, target: DataFrame, target_key: str, code: str) -> DataFrame:
    known = target.select("run_id", F.col(target_key).alias(reference)).distinct()
    return _told(df.where(F.col(reference).isNotNull()).join(known, ["run_id", reference], "left_anti"), code, F.col(key))


def integrity(runs: DataFrame, containers: DataFrame, items: DataFrame, relationships: DataFrame, evidence: DataFrame) -> DataFrame:
    """(code, record_id, run_id) of everything in runs that does not hold."""
    shot = snapshot(runs, containers, items, relationships, evidence).withColumnRenamed("snapshot_sha256", "own_sha256")
    counted = items.groupBy("run_id", "container_id").agg(F.count("*").alias("n"))
    held = containers.join(counted, ["run_id", "container_id"], "left")
    found = [
        _told(runs.join(shot, "run_id").where("snapshot_sha256 <> own_sha256"), "snapshot_hash_mismatch", F.col("run_id")),
        _told(runs.where("size(capabilities) = 0"), "capability_report_missing", F.col("run_id")),
        _told(runs.join(verified_complete(runs, containers), "run_id").where("status = 'complete' and not verified"), "complete_boundaries_not_verified", F.col("run_id")),
        _repeated(evidence, "evidence_id", "duplicate_evidence"), _repeated(containers, "container_id", "duplicate_container"),
        _repeated(items, "item_id", "duplicate_item"), _repeated(relationships, "relationship_id", "duplicate_relationship"),
        _told(evidence.where(sha256(F.col("value")) != F.col("sha256")), "evidence_hash_mismatch", F.col("evidence_id")),
        _told(containers.where("enumeration_status = 'not_attempted' and observed_item_count <> 0"), "not_attempted_container_reported_items", F.col("container_id")),
        _told(containers.where(fingerprint(containers) != F.col("observation_fingerprint")), "container_fingerprint_mismatch", F.col("container_id")),
        _told(items.where(fingerprint(items) != F.col("observation_fingerprint")), "item_fingerprint_mismatch", F.col("item_id")),
        _told(items.where("capture_feasibility = 'blocked' and blocked_reason is null"), "blocked_reason_required", F.col("item_id")),
        _told(held.where("observed_item_count <> coalesce(n, 0)"), "container_item_count_mismatch", F.col("container_id")),
        _unresolved(containers, "container_id", "parent_container_id", containers, "container_id", "unresolved_parent_container"),
        _unresolved(items, "item_id", "container_id", containers, "container_id", "unresolved_container"),
        _unresolved(relationships, "relationship_id", "from_item_id", items, "item_id", "unresolved_relationship_source"),
        _unresolved(relationships, "relationship_id", "to_item_id", items, "item_id", "unresolved_relationship_target"),
    ]
    for df, key in ((containers, "container_id"), (items, "item_id")):
        found.append(_told(df.where("review_status = 'needs_review' and size(review_reasons) = 0"), "review_reason_required", F.col(key)))
        found.append(_missing_evidence(df, key, evidence))
    return reduce(DataFrame.unionByName, found)


def absences(expected: DataFrame, runs: DataFrame, containers: DataFrame, items: DataFrame) -> DataFrame:
    """(run_id, container_id, item_id, absence) of expected (run_id, container_id, item_id) rows without an item.

    absent: a verified run enumerated the container to its end, so that there is none.  not_attempted and not_observed: the container was not, or only in part,
    or its run is not verified.  container_unknown: the run has no such container.
    """
    missing = expected.join(items.select("run_id", "container_id", "item_id").distinct(), ["run_id", "container_id", "item_id"], "left_anti")
    # of a container that is told twice, the least complete telling counts
    told = containers.groupBy("run_id", "container_id").agg(F.max(F.when(F.col("enumeration_status") == "complete", 0).when(F.col("enumeration_status") == "not_attempted", 2).otherwise(1)).alias("level"))
    known = missing.join(told, ["run_id", "container_id"], "left").join(verified_complete(runs, containers), "run_id", "left")
    kind = F.when(F.col("level").isNull(), NO_CONTAINER).when(F.col("level") == 2, NOT_ATTEMPTED).when((F.col("level") == 0) & F.coalesce("verified", F.lit(False)), ABSENT).otherwise(NOT_OBSERVED)
    return known.select("run_id", "container_id", "item_id", kind.alias("absence"))


def audit(runs: DataFrame, containers: DataFrame, items: DataFrame, relationships: DataFrame, evidence: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row for a run: what was observed, what is at fault, how its catalog entries are classed, and whether all of it is verified.

    catalog has run_id, item_id, classification and transaction_applied; items have a position.
    """
    faults = integrity(runs, containers, items, relationships, evidence)
    of = faults.groupBy("run_id").agg(*(F.count_if(F.col("code") == c).alias(c) for c in ("duplicate_item", "evidence_hash_mismatch", "snapshot_hash_mismatch")), F.count("*").alias("faults"))
    places = items.groupBy("run_id", "position").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.count_if(F.col("n") > 1).alias("duplicate_positions"))
    seen = items.groupBy("run_id").agg(F.count("*").alias("observed"), F.count_if(F.col("review_status") == "needs_review").alias("to_review"),
                                       F.min_by("item_id", F.struct("position", "item_id")).alias("first_item"), F.max_by("item_id", F.struct("position", "item_id")).alias("last_item"))
    classes = ("new", "possibly_changed", "unchanged", "missing", "needs_review")
    records = catalog.groupBy("run_id").agg(F.count("*").alias("records"), F.bool_and("transaction_applied").alias("applied"), *(F.count_if(F.col("classification") == c).alias(f"class_{c}") for c in classes))
    told = runs.select("run_id", "status").join(seen, "run_id", "left").join(places, "run_id", "left").join(of, "run_id", "left").join(records, "run_id", "left")
    numbers = [c for c, kind in told.dtypes if kind == "bigint"]
    told = told.select("run_id", "status", "first_item", "last_item", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), F.coalesce("applied", F.lit(False)).alias("applied"))
    sound = (F.col("duplicate_item") == 0) & (F.col("duplicate_positions") == 0) & (F.col("evidence_hash_mismatch") == 0) & (F.col("snapshot_hash_mismatch") == 0) & F.col("applied")
    return told.withColumn("verified", sound)
