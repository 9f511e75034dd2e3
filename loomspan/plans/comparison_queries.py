"""A second capture of every conversation, in which a message may differ in one way from the first one."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha256
from ..model import Bundle
from ..operators import comparison
from ..registry import register

MODULUS = 19
#: By the remainder of a message's place: kind of change, method, confidence, reasons, dimensions; 14 is missing from the second capture.
FAULTS = {
    1: ("metadata_changed", "platform_message_id", "exact", "role_changed", "metadata"), 2: ("textual_edit", "platform_message_id", "exact", "canonical_text_changed", "text"),
    3: ("rendered_structure_changed", "platform_message_id", "exact", "sanitized_html_changed", "rendered_structure"), 4: ("content_blocks_changed", "platform_message_id", "exact", "content_blocks_changed", "content_blocks"),
    5: ("attachments_changed", "platform_message_id", "exact", "attachments_changed", "attachments"), 6: ("citations_changed", "platform_message_id", "exact", "citations_changed", "citations"),
    7: ("artifacts_changed", "platform_message_id", "exact", "artifacts_changed", "artifacts"), 8: ("tool_events_changed", "platform_message_id", "exact", "tool_events_changed", "tool_events"),
    9: ("branched", "platform_message_id", "exact", "branch_relationship_changed", "branch"), 10: ("unchanged", "canonical_message_id", "exact", "all_preserved_hashes_and_relationships_match", ""),
    11: ("unchanged", "exact_hash_context", "exact", "all_preserved_hashes_and_relationships_match", ""), 12: ("textual_edit", "platform_message_id", "exact", "canonical_text_changed,sanitized_html_changed", "text,rendered_structure"),
    13: ("branched", "platform_message_id", "exact", "parent_relationship_changed", "branch"),
    15: ("regenerated", "branch_parent", "conservative", "assistant_alternative_same_parent_with_branch_evidence", "text,branch"),
}
_VALUES = ", ".join("({}, '{}', '{}', '{}', '{}', '{}')".format(k, *v) for k, v in FAULTS.items())
CHANGED = f"""two AS (SELECT m.conversation_id, m.message_id, m.conv_id, (m.conv_id * 5 + m."sequence" * 3) % {MODULUS} k, m.conv_id % 6 <> 5 eligible FROM messages m),
faults(k, classification, match_method, confidence, reasons, dimensions) AS (VALUES {_VALUES}),
recs AS (SELECT conversation_id, coalesce(f.classification, 'unchanged') classification, message_id prior_message_id, CASE WHEN two.k IN (11, 15) THEN 'x' || message_id ELSE message_id END current_message_id, coalesce(f.match_method, 'platform_message_id') match_method,
    coalesce(f.confidence, 'exact') confidence, coalesce(f.reasons, 'all_preserved_hashes_and_relationships_match') reasons, coalesce(f.dimensions, '') dimensions FROM two LEFT JOIN faults f ON f.k = two.k WHERE two.k <> 14
  UNION ALL SELECT conversation_id, CASE WHEN eligible THEN 'removed_from_active_path' ELSE 'uncertain' END, message_id, NULL, 'none', CASE WHEN eligible THEN 'conservative' ELSE 'uncertain' END,
    CASE WHEN eligible THEN 'absent_from_new_verified_active_path' ELSE 'absence_not_confirmed_due_to_incomplete_evidence' END, '' FROM two WHERE k = 14
  UNION ALL SELECT conversation_id, CASE WHEN conv_id % 6 <> 5 THEN 'appended' ELSE 'uncertain' END, NULL, 'new_' || conversation_id, 'none', CASE WHEN conv_id % 6 <> 5 THEN 'conservative' ELSE 'uncertain' END,
    CASE WHEN conv_id % 6 <> 5 THEN 'new_message_after_prior_active_path_tail' ELSE 'unmatched_current_message' END, '' FROM captures WHERE conv_id % 4 = 1
  UNION ALL SELECT conversation_id, 'branched', NULL, 'branch_' || conversation_id, 'none', 'conservative', 'branch_graph_changed', 'branch' FROM captures WHERE conv_id % 9 = 0)"""


def _versions(b: Bundle) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    m = b.messages.withColumn("k", (F.col("conv_id") * 5 + F.col("sequence") * 3) % MODULUS)
    before = m.select("conversation_id", (F.col("sequence") + 1).alias("sequence"), F.col("message_id").alias("parent_message_id"))
    k = F.col("k")

    def side(changed: bool) -> DataFrame:
        def at(*kinds: int):
            return k.isin(*kinds) & F.lit(changed)

        named = F.when(at(11, 15), F.concat(F.lit("x"), "message_id")).otherwise(F.col("message_id"))
        text, html = (F.when(at(*kinds), sha256(F.lit("other"))).otherwise(F.col("text_sha256")) for kinds in ((2, 12, 15), (3, 12)))
        own = [F.when(at(5 + i), "other").otherwise("none").alias(c) for i, c in enumerate(("attachments", "citations", "artifacts", "tool_events"))]
        return m.join(before, ["conversation_id", "sequence"], "left").where(~at(14)).select(
            "conversation_id", named.alias("message_id"), F.when(~k.isin(10, 11, 15), F.concat(F.lit("p"), "message_id")).alias("platform_message_id"), "sequence",
            F.when(k == 15, "assistant").when(at(1), "tool").otherwise(F.concat(F.lit("r"), "role")).alias("role"), F.when(at(13), "message_other").otherwise(F.col("parent_message_id")).alias("parent_message_id"),
            F.when((k == 15) | at(9), F.lit("b2" if changed else "b1")).alias("branch_id"), F.create_map(F.lit("canonical_text"), text, F.lit("sanitized_html"), html).alias("representations"),
            F.create_map(F.lit("b0"), F.when(at(4), "other").otherwise(F.col("text_sha256"))).alias("blocks"), *own)

    last = m.groupBy("conversation_id", "conv_id").agg(F.max_by("message_id", "sequence").alias("parent_message_id"), F.count("*").alias("sequence")).where("conv_id % 4 = 1")
    none = F.lit("none")
    new = last.select("conversation_id", F.concat(F.lit("new_"), "conversation_id").alias("message_id"), F.lit(None).cast("string").alias("platform_message_id"), "sequence", F.lit("ruser").alias("role"), "parent_message_id",
                      F.lit(None).cast("string").alias("branch_id"), F.create_map(F.lit("canonical_text"), F.lit("new")).alias("representations"), F.create_map(F.lit("b0"), F.lit("new")).alias("blocks"),
                      *(none.alias(c) for c in ("attachments", "citations", "artifacts", "tool_events")))

    def capture(changed: bool) -> DataFrame:
        def branch(name: str):
            return F.struct(F.lit("captured").alias("status"), F.lit(name).alias("branch_sha256"), F.concat(F.lit("branch_"), "conversation_id").alias("message_id"))

        branches = F.when((F.col("conv_id") % 9 == 0) & F.lit(changed), F.array(branch("h1"), branch("h2"))).otherwise(F.array(branch("h1")))
        status = F.when((F.col("conv_id") % 6 == 5) & F.lit(changed), "partial").otherwise("complete")
        return b.captures.select("conversation_id", F.lit("web").alias("platform"), F.lit("me").alias("account"), status.alias("status"), branches.alias("branches"))

    return side(False), side(True).unionByName(new), capture(False), capture(True)


@register("i17_change_records", "SELECT * FROM recs", CHANGED)
def change_records(b: Bundle):
    return comparison.compare(*_versions(b)).withColumn("reasons", F.concat_ws(",", "reasons")).withColumn("dimensions", F.concat_ws(",", "dimensions"))


@register("i17_change_summaries", f"""SELECT c.conversation_id, CASE WHEN c.conv_id % 6 = 5 THEN '{comparison.NOT_ELIGIBLE}' ELSE '' END warnings, CASE WHEN c.conv_id % 6 = 5 THEN 'needs_review' ELSE 'complete' END status,
{", ".join(f"count(*) FILTER (WHERE classification = '{x}') n_{x}" for x in comparison.CLASSES)},
{", ".join(f"count(*) FILTER (WHERE list_contains(string_split(dimensions, ','), '{x}')) in_{x}" for x in ("text", "rendered_structure", "content_blocks", "attachments", "citations", "artifacts", "tool_events", "branch", "metadata"))}
FROM captures c JOIN recs r ON r.conversation_id = c.conversation_id GROUP BY c.conversation_id, c.conv_id""", CHANGED)
def change_summaries(b: Bundle):
    prior, current, a, c = _versions(b)
    return comparison.summary(comparison.compare(prior, current, a, c), comparison.inputs(a, c)).withColumn("warnings", F.concat_ws(",", "warnings"))
