"""Discovery runs over the conversations: every container, item, relationship and piece of evidence is whole but for planted faults."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Bundle
from ..operators import discovery
from ..registry import register

RUNS = 7
#: By the remainder of a conversation's number: the fault of its container, of its first item, or of its first item's evidence or relationship.
MODULUS = 31
RULES = """c AS (SELECT conv_id, conversation_id, conv_id % 7 r, conv_id % 31 k FROM captures), i AS (SELECT c.*, g.range_no, g.chunk_id, g.range_no = 0 first, lead(g.chunk_id) OVER (PARTITION BY c.conversation_id ORDER BY g.range_no) nxt
  FROM ranges g JOIN c ON c.conversation_id = g.conversation_id),
kept AS (SELECT * FROM i WHERE NOT (k IN (5, 22) AND first)),
found AS (SELECT 'duplicate_container' code, conversation_id record_id, r FROM c WHERE k = 1 UNION ALL SELECT 'review_reason_required', conversation_id, r FROM c WHERE k = 2
  UNION ALL SELECT 'missing_evidence', conversation_id || ':gone', r FROM c WHERE k = 3 UNION ALL SELECT 'not_attempted_container_reported_items', conversation_id, r FROM c WHERE k = 4
  UNION ALL SELECT 'container_item_count_mismatch', conversation_id, r FROM c WHERE k = 5 UNION ALL SELECT 'container_fingerprint_mismatch', conversation_id, r FROM c WHERE k = 6
  UNION ALL SELECT 'unresolved_parent_container', conversation_id, r FROM c WHERE k = 7 UNION ALL SELECT 'duplicate_item', chunk_id, r FROM i WHERE k = 8 AND first
  UNION ALL SELECT 'container_item_count_mismatch', conversation_id, r FROM c WHERE k = 8 UNION ALL SELECT 'unresolved_container', chunk_id, r FROM i WHERE k = 9 AND first
  UNION ALL SELECT 'container_item_count_mismatch', conversation_id, r FROM c WHERE k = 9 UNION ALL SELECT 'review_reason_required', chunk_id, r FROM i WHERE k = 10 AND first
  UNION ALL SELECT 'blocked_reason_required', chunk_id, r FROM i WHERE k = 11 AND first UNION ALL SELECT 'missing_evidence', chunk_id || ':gone', r FROM i WHERE k = 12 AND first
  UNION ALL SELECT 'item_fingerprint_mismatch', chunk_id, r FROM i WHERE k = 13 AND first UNION ALL SELECT 'duplicate_evidence', 'evidence_' || chunk_id, r FROM i WHERE k = 14 AND first
  UNION ALL SELECT 'evidence_hash_mismatch', 'evidence_' || chunk_id, r FROM i WHERE k = 15 AND first UNION ALL SELECT 'duplicate_relationship', 'relationship_' || chunk_id, r FROM kept WHERE k = 16 AND first
  UNION ALL SELECT 'unresolved_relationship_source', 'relationship_' || chunk_id, r FROM kept WHERE k = 17 AND first UNION ALL SELECT 'unresolved_relationship_target', 'relationship_' || chunk_id, r FROM kept WHERE k = 18 AND first
  UNION ALL SELECT 'snapshot_hash_mismatch', 'run_' || r, r FROM (SELECT DISTINCT r FROM c WHERE r = 1) UNION ALL SELECT 'capability_report_missing', 'run_' || r, r FROM (SELECT DISTINCT r FROM c WHERE r = 2)
  UNION ALL SELECT 'complete_boundaries_not_verified', 'run_' || r, r FROM (SELECT DISTINCT r FROM c WHERE r = 3 OR r NOT IN (4, 5) AND k IN (4, 20, 21)))"""


def _discovered(b: Bundle) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Runs, containers, items, relationships, evidence.  Runs 4 and 5 are not complete, run 3 did not reach the end, run 1's snapshot and run 2's capabilities are at fault."""
    run = F.concat(F.lit("run_"), (F.col("conv_id") % RUNS).cast("string")).alias("run_id")
    k = F.col("conv_id") % MODULUS
    none = F.array().cast("array<string>")
    ranges = b.ranges.select(run, "conv_id", "conversation_id", "chunk_id", "range_no", "range_sha256")
    first = F.col("range_no") == 0
    kept = ranges.where(~(k.isin(5, 22) & first))  # what a container told of and lacks, and what a whole container lacks
    counted = ranges.groupBy("conversation_id").agg(F.count("*").alias("n"))
    whole = F.col("n") - F.when(k == 22, 1).otherwise(0)
    containers = b.captures.select(run, "conv_id", "conversation_id").join(counted, "conversation_id").select(
        "run_id", F.col("conversation_id").alias("container_id"), F.when(k == 7, "gone").alias("parent_container_id"),
        F.when(k.isin(4, 20), "not_attempted").when(k == 21, "partial").otherwise("complete").alias("enumeration_status"), F.when(k == 20, 0).otherwise(whole).cast("long").alias("observed_item_count"),
        F.when(k.isin(2, 23), "needs_review").otherwise("clear").alias("review_status"), F.when(k == 23, F.array(F.lit("title"))).otherwise(none).alias("review_reasons"),
        F.when(k == 3, F.array(F.lit("gone"))).otherwise(none).alias("evidence_ids"), k.alias("k"))
    items = kept.where(k != 20).select(
        "run_id", F.when((k == 9) & first, "gone").otherwise(F.col("conversation_id")).alias("container_id"), F.col("chunk_id").alias("item_id"), (F.col("conv_id") * 1000 + F.col("range_no")).alias("position"),
        F.when(k.isin(10, 23) & first, "needs_review").otherwise("clear").alias("review_status"), F.when(k == 23, F.array(F.lit("title"))).otherwise(none).alias("review_reasons"),
        F.when(k.isin(11, 24) & first, "blocked").otherwise("feasible").alias("capture_feasibility"), F.when(k == 24, "sign-in").alias("blocked_reason"),
        F.array(F.when((k == 12) & first, "gone").otherwise(F.concat(F.lit("evidence_"), "chunk_id"))).alias("evidence_ids"), k.alias("k"), first.alias("first"))

    def signed(df: DataFrame, fault: int, *more: str) -> DataFrame:
        own = df.drop("k", *more)
        made = discovery.fingerprint(own)
        wrong = (F.col("k") == fault) & (F.col("first") if more else F.lit(True))
        return df.withColumn("observation_fingerprint", F.when(wrong, F.lit("0" * 64)).otherwise(made))

    containers, items = signed(containers, 6), signed(items, 13, "first")
    containers = containers.unionByName(containers.where("k = 1")).drop("k")
    items = items.unionByName(items.where("k = 8 and first")).drop("k", "first")
    twice = kept.where((k == 16) & first)
    relationships = kept.unionByName(twice).where(k != 20).select("run_id", F.concat(F.lit("relationship_"), "chunk_id").alias("relationship_id"), F.when((k == 17) & first, "gone").otherwise(F.col("chunk_id")).alias("from_item_id"),
                                                                F.when((k == 18) & first, "gone").otherwise(F.col("chunk_id")).alias("to_item_id"))
    evidence = ranges.unionByName(ranges.where((k == 14) & first)).select("run_id", F.concat(F.lit("evidence_"), "chunk_id").alias("evidence_id"), F.col("range_sha256").alias("value"),
                                                                         F.when((k == 15) & first, F.lit("0" * 64)).otherwise(F.sha2(F.col("range_sha256").cast("binary"), 256)).alias("sha256"))
    r = F.col("r")
    runs = b.captures.select((F.col("conv_id") % RUNS).alias("r")).distinct().select(
        F.concat(F.lit("run_"), r.cast("string")).alias("run_id"), F.when(r.isin(4, 5), "partial").otherwise("complete").alias("status"), none.alias("warnings"), F.when(r == 2, none).otherwise(F.array(F.lit("items"))).alias("capabilities"),
        F.lit(True).alias("start_reached"), (r != 3).alias("end_reached"), F.lit(True).alias("traversal_stabilized"), F.lit(True).alias("count_stabilized"))
    shot = discovery.snapshot(runs, containers, items, relationships, evidence)
    runs = runs.join(shot, "run_id").withColumn("snapshot_sha256", F.when(F.col("run_id") == "run_1", F.lit("0" * 64)).otherwise(F.col("snapshot_sha256")))
    return runs, containers, items, relationships, evidence


@register("v19_discovery_integrity", "SELECT code, record_id, 'run_' || r run_id FROM found", RULES)
def discovery_integrity(b: Bundle):
    return discovery.integrity(*_discovered(b))


@register("v19_typed_absence", """SELECT 'run_' || r run_id, container_id, item_id, CASE WHEN container_id = 'conversation_none' THEN 'container_unknown' WHEN k IN (20) THEN 'not_attempted'
  WHEN r IN (3, 4, 5) OR r IN (SELECT r FROM c WHERE k IN (4, 20, 21)) THEN 'not_observed' ELSE 'absent' END absence
FROM (SELECT r, k, conversation_id container_id, chunk_id item_id FROM i WHERE k IN (5, 22, 9) AND first OR k = 20 UNION ALL SELECT r, k, 'conversation_none', 'chunk_none_' || conv_id FROM c WHERE k = 25)""", RULES)
def typed_absence(b: Bundle):
    """Every range is expected in its conversation, and one in a conversation that no run knows."""
    runs, containers, items, _, _ = _discovered(b)
    run = F.concat(F.lit("run_"), (F.col("conv_id") % RUNS).cast("string")).alias("run_id")
    expected = b.ranges.select(run, F.col("conversation_id").alias("container_id"), F.col("chunk_id").alias("item_id"))
    strange = b.captures.where(F.col("conv_id") % MODULUS == 25).select(run, F.lit("conversation_none").alias("container_id"), F.concat(F.lit("chunk_none_"), F.col("conv_id").cast("string")).alias("item_id"))
    return discovery.absences(expected.unionByName(strange), runs, containers, items)


@register("v20_inventory_audit", """SELECT 'run_' || x.r run_id, CASE WHEN x.r IN (4, 5) THEN 'partial' ELSE 'complete' END status, x.observed, x.to_review, x.first_item, x.last_item, x.duplicate_positions,
  f.duplicate_item, f.evidence_hash_mismatch, f.snapshot_hash_mismatch, f.faults, x.records, x.class_new, x.class_possibly_changed, x.class_unchanged, x.class_missing, x.class_needs_review, x.r <> 6 applied,
  x.duplicate_positions = 0 AND f.duplicate_item = 0 AND f.evidence_hash_mismatch = 0 AND f.snapshot_hash_mismatch = 0 AND x.r <> 6 verified
FROM (SELECT r, count(*) + count(*) FILTER (WHERE k = 8 AND first) observed, count(*) FILTER (WHERE k IN (10, 23) AND first) to_review, arg_min(chunk_id, conv_id * 1000 + range_no) first_item, arg_max(chunk_id, conv_id * 1000 + range_no) last_item,
    count(*) FILTER (WHERE k = 8 AND first) duplicate_positions, count(*) records, count(*) FILTER (WHERE range_no % 5 = 0) class_new, count(*) FILTER (WHERE range_no % 5 = 1) class_possibly_changed, count(*) FILTER (WHERE range_no % 5 = 2) class_unchanged,
    count(*) FILTER (WHERE range_no % 5 = 3) class_missing, count(*) FILTER (WHERE range_no % 5 = 4) class_needs_review FROM kept WHERE k <> 20 GROUP BY 1) x
JOIN (SELECT c.r, count(DISTINCT record_id) FILTER (WHERE code = 'duplicate_item') duplicate_item, count(DISTINCT record_id) FILTER (WHERE code = 'evidence_hash_mismatch') evidence_hash_mismatch,
    count(DISTINCT record_id) FILTER (WHERE code = 'snapshot_hash_mismatch') snapshot_hash_mismatch, count(DISTINCT code || record_id) faults FROM (SELECT DISTINCT r FROM c) c LEFT JOIN found ON found.r = c.r GROUP BY 1) f ON f.r = x.r""", RULES)
def inventory_audit(b: Bundle):
    runs, containers, items, relationships, evidence = _discovered(b)
    classes = F.array(*map(F.lit, ("new", "possibly_changed", "unchanged", "missing", "needs_review")))
    catalog = items.dropDuplicates(["run_id", "item_id"]).select("run_id", "item_id", F.element_at(classes, (F.col("position") % 1000 % 5 + 1).cast("int")).alias("classification"), (F.col("run_id") != "run_6").alias("transaction_applied"))
    return discovery.audit(runs, containers, items, relationships, evidence, catalog)
