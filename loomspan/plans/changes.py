"""Comparison, catalog and planning queries."""

from pyspark.sql import functions as F

from ..model import Bundle
from ..operators import changes
from ..registry import register

PAIRS = """later AS (SELECT m.conversation_id, m."sequence", m.role, CASE WHEN (m.conv_id + m."sequence") % 7 = 0 THEN sha256(m.text || '!') ELSE m.text_sha256 END text_sha256
  FROM messages m JOIN captures c ON c.conversation_id = m.conversation_id WHERE NOT (m.conv_id % 5 = 0 AND m."sequence" = c.n_messages - 1)
  UNION ALL SELECT conversation_id, n_messages, 'user', sha256('extra') FROM captures WHERE conv_id % 4 = 0),
diff AS (SELECT coalesce(a.conversation_id, b.conversation_id) conversation_id, coalesce(a."sequence", b."sequence") AS "sequence",
  CASE WHEN a.text_sha256 IS NULL THEN 'added' WHEN b.text_sha256 IS NULL THEN 'removed' WHEN a.role <> b.role THEN 'role_changed' WHEN a.text_sha256 <> b.text_sha256 THEN 'content_changed' ELSE 'unchanged' END change
  FROM messages a FULL JOIN later b ON a.conversation_id = b.conversation_id AND a."sequence" = b."sequence")"""


def later(b: Bundle):
    """A second capture: some last turns gone, some texts changed, some turns added."""
    m = b.messages.join(b.captures.select("conversation_id", "n_messages"), "conversation_id")
    digest = F.when((F.col("conv_id") + F.col("sequence")) % 7 == 0, F.sha2(F.concat("text", F.lit("!")).cast("binary"), 256)).otherwise(F.col("text_sha256"))
    kept = m.where(~((F.col("conv_id") % 5 == 0) & (F.col("sequence") == F.col("n_messages") - 1))).select("conversation_id", "sequence", "role", digest.alias("text_sha256"))
    extra = b.captures.where("conv_id % 4 = 0").select("conversation_id", F.col("n_messages").alias("sequence"), F.lit("user").alias("role"), F.sha2(F.lit(b"extra"), 256).alias("text_sha256"))
    return kept.unionByName(extra)


@register("i17_compare_captures", "SELECT * FROM diff", PAIRS)
def compare_captures(b: Bundle):
    return changes.compare_versions(b.messages, later(b))


@register("g14_change_counts", """SELECT c.conversation_id, k.change, coalesce(n, 0) n FROM captures c CROSS JOIN (SELECT unnest(['added','removed','role_changed','content_changed','unchanged']) change) k
LEFT JOIN (SELECT conversation_id, change, count(*) n FROM diff GROUP BY ALL) d ON d.conversation_id = c.conversation_id AND d.change = k.change""", PAIRS)
def change_counts(b: Bundle):
    kinds = F.explode(F.array(*map(F.lit, ("added", "removed", "role_changed", "content_changed", "unchanged"))))
    counted = changes.compare_versions(b.messages, later(b)).groupBy("conversation_id", "change").agg(F.count("*").alias("n"))
    return b.captures.select("conversation_id", kinds.alias("change")).join(counted, ["conversation_id", "change"], "left").select("conversation_id", "change", F.coalesce("n", F.lit(0)).alias("n"))


@register("u5_branch_difference", "SELECT conversation_id, count(*) lost FROM (SELECT conversation_id, text_sha256 FROM messages EXCEPT SELECT conversation_id, text_sha256 FROM later) GROUP BY 1", PAIRS)
def branch_difference(b: Bundle):
    """Hashes that a conversation has lost: an anti join of distinct hashes, so no conversation's hashes are gathered."""
    def hashes(df):
        return df.select("conversation_id", "text_sha256").distinct()

    lost = hashes(b.messages).join(hashes(later(b)), ["conversation_id", "text_sha256"], "left_anti")
    return lost.groupBy("conversation_id").agg(F.count("*").alias("lost"))


@register("f31_f32_map_changes", "SELECT conversation_id, count(*) changed FROM diff WHERE change <> 'unchanged' GROUP BY 1", PAIRS)
def map_changes(b: Bundle):
    """Changed keys between two maps of message hashes, each map as one row for each key."""
    def entries(df, name):
        return df.select("conversation_id", "sequence", F.col("text_sha256").alias(name))

    both = entries(b.messages, "x").join(entries(later(b), "y"), ["conversation_id", "sequence"], "full")
    changed = both.where(~F.col("x").eqNullSafe(F.col("y")))
    return changed.groupBy("conversation_id").agg(F.count_distinct("sequence").alias("changed"))


@register("c17_unique_matches", """SELECT p.message_id prior_id, c.message_id current_id, matched_by FROM (
  SELECT message_id, NULL FROM messages WHERE false) z RIGHT JOIN (SELECT 1) o ON true JOIN (SELECT * FROM messages) p ON true JOIN messages c ON c.message_id = p.message_id
  JOIN (SELECT 'message_id' matched_by) k ON true WHERE p.conv_id % 3 <> 0
UNION ALL SELECT p.i, c.i, 'text_sha256' FROM (SELECT text_sha256, min(message_id) i FROM messages WHERE conv_id % 3 = 0 GROUP BY 1 HAVING count(*) = 1) p
  JOIN (SELECT text_sha256, min('new_' || message_id) i FROM messages WHERE conv_id % 3 = 0 GROUP BY 1 HAVING count(*) = 1) c ON c.text_sha256 = p.text_sha256""")
def unique_matches(b: Bundle):
    prior = b.messages.select(F.col("message_id").alias("prior_id"), "message_id", "text_sha256")
    own = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("new_"), F.col("message_id"))).otherwise(F.col("message_id"))
    current = b.messages.select(own.alias("current_id"), own.alias("message_id"), "text_sha256")
    return changes.match_unique(prior, current, ["message_id", "text_sha256"], "prior_id", "current_id")


DISCOVERED = """disc AS (SELECT 'item_' || conv_id item_id, CASE WHEN conv_id % 23 = 0 THEN NULL ELSE conversation_id END source_native_id, 'title ' || (conv_id + CASE WHEN conv_id % 13 = 0 THEN 1 ELSE 0 END) title,
  CASE WHEN conv_id % 19 = 0 THEN 'needs_review' ELSE 'ok' END review_status FROM captures),
known AS (SELECT conversation_id source_native_id, CASE WHEN conv_id % 17 = 0 THEN NULL ELSE verification_status END verification_status, 'title ' || conv_id title, conv_id % 29 = 0 ambiguous FROM captures WHERE conv_id % 7 <> 0),
cls AS (SELECT d.item_id, CASE WHEN d.source_native_id IS NULL THEN ['needs_review', 'unstable_item_identity']
  WHEN k.source_native_id IS NULL AND f IS NOT NULL THEN ['needs_review', f || ',no_matching_source_record'] WHEN k.source_native_id IS NULL THEN ['never_captured', 'no_matching_source_record']
  WHEN k.ambiguous THEN ['needs_review', concat_ws(',', f, 'several_records')] WHEN k.verification_status IS NULL THEN ['needs_review', concat_ws(',', f, 'matched_without_capture_version')]
  WHEN k.verification_status IN ('failed', 'needs_review') THEN ['needs_review', concat_ws(',', f, 'capture_verification_status:' || k.verification_status)]
  WHEN f IS NOT NULL THEN ['needs_review', f] WHEN k.title <> d.title THEN ['possibly_changed', 'visible_title_differs_from_captured_title']
  WHEN k.verification_status = 'partial' THEN ['captured_partial', 'capture_verification_status:partial'] ELSE ['captured_verified', 'capture_verification_status:complete,visible_title_unchanged'] END r
  FROM (SELECT *, CASE WHEN review_status = 'needs_review' THEN 'discovery_flagged_item_for_review' END f FROM disc) d LEFT JOIN known k ON k.source_native_id = d.source_native_id)"""


def _classified(b: Bundle):
    c = b.captures
    title = F.concat(F.lit("title "), (F.col("conv_id") + F.when(F.col("conv_id") % 13 == 0, 1).otherwise(0)).cast("string"))
    disc = c.select(F.concat(F.lit("item_"), F.col("conv_id").cast("string")).alias("item_id"), F.when(F.col("conv_id") % 23 != 0, F.col("conversation_id")).alias("source_native_id"),
                    title.alias("title"), F.when(F.col("conv_id") % 19 == 0, "needs_review").otherwise("ok").alias("review_status"))
    known = c.where("conv_id % 7 <> 0").select(F.col("conversation_id").alias("source_native_id"), F.when(F.col("conv_id") % 17 != 0, F.col("verification_status")).alias("verification_status"),
                                              F.concat(F.lit("title "), F.col("conv_id").cast("string")).alias("title"), (F.col("conv_id") % 29 == 0).alias("ambiguous"))
    return changes.classify_discovered(disc, known)


@register("i18_classify_discovered", "SELECT item_id, r[1] classification, r[2] reasons FROM cls", DISCOVERED)
def classify_discovered(b: Bundle):
    return _classified(b)


@register("g11_comparison_rollup", """SELECT count(*) total_discovered, count(*) FILTER (WHERE r[1] <> 'never_captured') already_known, count(*) FILTER (WHERE r[1] = 'never_captured') never_captured,
count(*) FILTER (WHERE r[1] = 'possibly_changed') possibly_changed, count(*) FILTER (WHERE r[1] = 'captured_partial') captured_partial, count(*) FILTER (WHERE r[1] = 'captured_verified') captured_verified,
count(*) FILTER (WHERE r[1] = 'needs_review') needs_review FROM cls""", DISCOVERED)
def comparison_rollup(b: Bundle):
    kind = F.col("classification")
    counts = [F.count_if(kind == k).alias(k) for k in ("never_captured", "possibly_changed", "captured_partial", "captured_verified", "needs_review")]
    return _classified(b).agg(F.count("*").alias("total_discovered"), F.count_if(kind != "never_captured").alias("already_known"), *counts)


@register("i19_capture_plan", "SELECT sha256(string_agg(item_id, ',' ORDER BY item_id)) plan_sha256, count(*) n FROM cls WHERE r[1] IN ('never_captured', 'possibly_changed')", DISCOVERED)
def capture_plan(b: Bundle):
    chosen = _classified(b).where(F.col("classification").isin("never_captured", "possibly_changed"))
    return chosen.agg(F.expr("sha2(listagg(item_id, ',') WITHIN GROUP (ORDER BY item_id), 256)").alias("plan_sha256"), F.count("*").alias("n"))


@register("i14_catalog_changes", """SELECT coalesce(a.conversation_id, b.conversation_id) conversation_id, CASE WHEN b.f IS NULL THEN 'missing' WHEN b.review_status = 'needs_review' THEN 'needs_review' WHEN a.f IS NULL THEN 'new'
WHEN a.f = b.f THEN 'unchanged' ELSE 'possibly_changed' END classification FROM (SELECT conversation_id, sha256('t' || conv_id) f FROM captures WHERE conv_id % 7 <> 0) a
FULL JOIN (SELECT conversation_id, sha256('t' || (conv_id + CASE WHEN conv_id % 13 = 0 THEN 1000 ELSE 0 END)) f, CASE WHEN conv_id % 31 = 0 THEN 'needs_review' ELSE 'ok' END review_status FROM captures WHERE conv_id % 11 <> 0) b ON a.conversation_id = b.conversation_id""")
def catalog_changes(b: Bundle):
    def seen(where, moved):
        n = F.col("conv_id") + (F.when(F.col("conv_id") % 13 == 0, 1000).otherwise(0) if moved else 0)
        return b.captures.where(where).select("conversation_id", F.sha2(F.concat(F.lit("t"), n.cast("string")).cast("binary"), 256).alias("fingerprint"),
                                              F.when(F.col("conv_id") % 31 == 0, "needs_review").otherwise("ok").alias("review_status"))

    return changes.catalog_changes(seen("conv_id % 7 <> 0", False), seen("conv_id % 11 <> 0", True))


@register("u4_missing", "SELECT conversation_id FROM captures WHERE conv_id % 7 <> 0 EXCEPT SELECT conversation_id FROM captures WHERE conv_id % 11 <> 0")
def missing(b: Bundle):
    return b.captures.where("conv_id % 7 <> 0").select("conversation_id").join(b.captures.where("conv_id % 11 <> 0").select("conversation_id"), "conversation_id", "left_anti")


@register("i15_reconciliation_plan", """SELECT f.capture_version_id, CASE WHEN f.n > 1 THEN 'needs_review' WHEN k.m IS NULL THEN 'add' WHEN k.m = f.d THEN 'already_present' ELSE 'needs_review' END AS action FROM (
  SELECT capture_version_id, count(*) n, min(manifest_sha256) d FROM (SELECT * FROM captures UNION ALL SELECT * FROM captures WHERE conv_id % 10 = 3) GROUP BY 1) f
LEFT JOIN (SELECT capture_version_id, CASE WHEN conv_id % 6 = 0 THEN reverse(manifest_sha256) ELSE manifest_sha256 END m FROM captures WHERE conv_id % 4 <> 0) k ON k.capture_version_id = f.capture_version_id""")
def reconciliation_plan(b: Bundle):
    c = b.captures.select("capture_version_id", "manifest_sha256", "conv_id")
    digest = F.when(F.col("conv_id") % 6 == 0, F.reverse("manifest_sha256")).otherwise(F.col("manifest_sha256"))
    return changes.plan_reconciliation(c.unionByName(c.where("conv_id % 10 = 3")), c.where("conv_id % 4 <> 0").select("capture_version_id", digest.alias("manifest_sha256")), "capture_version_id", "manifest_sha256")


@register("u7_last_wins", "SELECT conversation_id, role, arg_max(message_id, \"sequence\") message_id FROM messages GROUP BY ALL")
def last_wins(b: Bundle):
    return b.messages.groupBy("conversation_id", "role").agg(F.max_by("message_id", "sequence").alias("message_id"))
