"""Predicates, fingerprints, receipts and reports that other queries build on."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing, textops
from ..model import Bundle
from ..operators import validators
from ..registry import register


@register("p2_p4_representations", """SELECT content_block_id, lower(value) = value has_pair, value preferred, sha256(lower(value)) = sha256(value) lower_is_same FROM blocks""")
def representations(b: Bundle):
    """Containment of a (kind, hash) pair in the array, and the canonical representation where there is one."""
    reps = F.col("representations")
    canonical = F.get(F.filter(reps, lambda r: r["representation_kind"] == "canonical_text"), F.lit(0))
    preferred = F.coalesce(canonical, F.get(reps, F.lit(0)))["value"]
    same = F.exists(reps, lambda r: (r["representation_kind"] == "lower_text") & (r["sha256"] == F.col("sha256")))
    pairs = F.transform(reps, lambda r: F.struct(r["representation_kind"].alias("kind"), r["sha256"].alias("sha256")))
    return b.representations.select("content_block_id", F.array_contains(pairs, F.struct(F.lit("lower_text").alias("kind"), F.col("sha256").alias("sha256"))).alias("has_pair"),
                                    preferred.alias("preferred"), same.alias("lower_is_same"))


@register("p3_p8_p9_filters", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view', 'purchase') AND json_exists(props, '$.k') UNION ALL SELECT event_id, event_type FROM events WHERE event_type LIKE 'p%' AND NOT json_exists(props, '$.k')")
def filters(b: Bundle):
    """Key existence, membership in a list and a prefix."""
    e = b.raw("events").withColumn("keyed", F.coalesce(F.array_contains(F.json_object_keys("props"), "k"), F.lit(False)))
    return e.where(F.col("event_type").isin("click", "view", "purchase") & F.col("keyed")).unionByName(e.where(F.startswith("event_type", F.lit("p")) & ~F.col("keyed"))).select("event_id", "event_type")


@register("p7_p14_row_values", "SELECT a.message_id FROM messages a JOIN messages b ON a.conversation_id = b.conversation_id AND a.role = b.role AND a.\"sequence\" = b.\"sequence\" + 2 WHERE a.text_sha256 IS DISTINCT FROM b.text_sha256")
def row_values(b: Bundle):
    before = b.messages.select("conversation_id", "role", (F.col("sequence") + 2).alias("sequence"), F.col("text_sha256").alias("h"))
    return b.messages.join(before, ["conversation_id", "role", "sequence"]).where(~F.col("text_sha256").eqNullSafe(F.col("h"))).select("message_id")


@register("p11_p13_p15_p17", """SELECT c.chunk_id, nullif(c.n_messages, 5) odd_size, coalesce(nullif(c.range_no, 0), -1) later FROM ranges c WHERE regexp_matches(c.chunk_id, '(?i)^CHUNK_[0-9a-f]+$') AND c.start_sequence BETWEEN 0 AND 9""")
def mixed_predicates(b: Bundle):
    return b.ranges.where(F.col("chunk_id").rlike("(?i)^CHUNK_[0-9a-f]+$")).where(F.col("start_sequence").between(0, 9)).select(
        "chunk_id", F.nullif("n_messages", F.lit(5)).alias("odd_size"), F.coalesce(F.nullif("range_no", F.lit(0)), F.lit(-1)).alias("later"))


@register("p18_authorized_corpus", "SELECT capture_version_id FROM captures WHERE source_family = 'native_export' OR verification_status = 'complete'")
def authorized_corpus(b: Bundle):
    return b.captures.where("source_family = 'native_export' or verification_status = 'complete'").select("capture_version_id")


@register("p24_state_labels", "SELECT capture_version_id, CASE WHEN verification_status = 'complete' THEN 'archived' WHEN verification_status = 'failed' THEN 'stopped' ELSE 'waiting' END archive_state, CASE WHEN n_messages % 2 = 0 THEN 'paired' ELSE 'unpaired' END pairing_state FROM captures")
def state_labels(b: Bundle):
    s = F.col("verification_status")
    return b.captures.select("capture_version_id", F.when(s == "complete", "archived").when(s == "failed", "stopped").otherwise("waiting").alias("archive_state"),
                             F.when(F.col("n_messages") % 2 == 0, "paired").otherwise("unpaired").alias("pairing_state"))


@register("f14_f15_f24_text_flags", """SELECT message_id, regexp_matches(text, '(?i)\\b(user|operator)\\b.{0,80}\\b(decid|requir|prefer|instruct|commit|directive)') OR regexp_matches(text, '(?i)\\b(decid|requir|prefer|instruct|commit|directive)\\w*\\b.{0,80}\\b(user|operator)\\b') claims,
starts_with(ltrim(text), 'The') the_first, CASE WHEN length(text) < 5000 THEN 'short' WHEN length(text) < 30000 THEN 'medium' ELSE 'long' END bucket FROM messages""")
def text_flags(b: Bundle):
    t = F.col("text")
    return b.messages.select("message_id", textops.claims_authority(t).alias("claims"), F.startswith(F.ltrim(t), F.lit("The")).alias("the_first"), textops.length_bucket(F.length(t)).alias("bucket"))


@register("f18_base64", "SELECT message_id, replace(replace(replace(base64(encode(text)), '+', '-'), '/', '_'), '=', '') payload FROM messages")
def base64_payloads(b: Bundle):
    plain = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"[\r\n]", "")
    return b.messages.select("message_id", F.regexp_replace(F.translate(plain, "+/", "-_"), "=", "").alias("payload"))


@register("f26_f29_f30_numbers", """SELECT conversation_id, CAST(n_messages // 4 AS BIGINT) fourth, CAST(n_messages % 4 AS BIGINT) rest, CAST(least(greatest(n_messages, 3), 6) AS BIGINT) clamped,
concat_ws(',', CASE WHEN n_messages < 4 THEN 'few' END, CASE WHEN conv_id % 2 = 0 THEN 'even' END) errors FROM captures""")
def numbers(b: Bundle):
    n = F.col("n_messages")
    errors = F.array_compact(F.array(F.when(n < 4, "few"), F.when(F.col("conv_id") % 2 == 0, "even")))
    return b.captures.select("conversation_id", F.floor(n / 4).alias("fourth"), (n % 4).alias("rest"), F.least(F.greatest(n, F.lit(3)), F.lit(6)).cast("long").alias("clamped"), F.array_join(errors, ",").alias("errors"))


@register("f33_merged_metadata", """SELECT user_id, string_agg(k || '=' || v, ',' ORDER BY k) merged FROM (SELECT user_id, k, arg_max(v, event_id) v FROM (
SELECT user_id, event_id, 'last' k, event_type v FROM events UNION ALL SELECT user_id, event_id, 'even', event_type FROM events WHERE event_id % 2 = 0
UNION ALL SELECT user_id, event_id, 'p' || (event_id % 3), CAST(event_id AS VARCHAR) FROM events) GROUP BY 1, 2) GROUP BY 1""")
def merged_metadata(b: Bundle):
    """A shallow merge of the maps of a key's rows, later ones winning entry by entry."""
    e = b.raw("events")
    odd = F.create_map(F.lit("last"), "event_type", F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")), F.col("event_id").cast("string"))
    maps = e.select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.map_concat(odd, F.create_map(F.lit("even"), "event_type"))).otherwise(odd).alias("m"))
    entries = maps.select("user_id", "event_id", F.explode("m").alias("k", "v")).groupBy("user_id", "k").agg(F.max_by("v", "event_id").alias("v"))
    merged = entries.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("m"))  # one entry a name
    return merged.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("merged"))


@register("k4_fingerprints", """SELECT page_id, sha256('{"n":"' || length(html) || '","url":' || CAST(to_json(url) AS VARCHAR) || '}') fingerprint FROM pages""")
def fingerprints(b: Bundle):
    return b.raw("pages").select("page_id", hashing.sha256(hashing.canonical_object(n=F.length("html"), url=F.col("url"))).alias("fingerprint"))


@register("k10_event_hashes", """SELECT event_id, sha256('{"event_id": ' || event_id || ', "event_type": "' || event_type || '", "event_timestamp": "' || strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%fZ') || '"}') event_sha256 FROM events""")
def event_hashes(b: Bundle):
    """The text form of a binary JSON object: keys by length and then bytes, a space after each colon and comma."""
    text = F.format_string('{"event_id": %d, "event_type": "%s", "event_timestamp": "%s"}', "event_id", "event_type", textops.iso_micros(F.col("ts").cast("timestamp")))
    return b.raw("events").select("event_id", hashing.sha256(text).alias("event_sha256"))


@register("i24_review_queue", "SELECT 'review_' || substr(sha256('capture:' || capture_version_id), 1, 32) queue_id, capture_version_id, verification_status reason FROM captures WHERE verification_status IN ('partial', 'needs_review')")
def review_queue(b: Bundle):
    rows = b.captures.where(F.col("verification_status").isin("partial", "needs_review"))
    return rows.select(hashing.hashed_id("review", F.lit("capture"), F.col("capture_version_id")).alias("queue_id"), "capture_version_id", F.col("verification_status").alias("reason"))


@register("i5_quarantine", """SELECT 'quarantine_' || substr(sha256(message_id || ':hash_mismatch'), 1, 32) quarantine_item_id, message_id record_id, 'hash_mismatch' reason_code FROM messages WHERE conv_id % 12 = 0 AND "sequence" = 2""")
def quarantine(b: Bundle):
    from .quality_checks import faulty

    bad = validators.wrong_hash(faulty(b), "message_id", "text", "text_sha256")
    return bad.select(hashing.hashed_id("quarantine", F.col("record_id"), F.col("code")).alias("quarantine_item_id"), "record_id", F.col("code").alias("reason_code"))


@register("c22_merged_bundles", "SELECT message_id, count(*) copies, count(DISTINCT h) > 1 collides FROM (SELECT message_id, text_sha256 h FROM messages WHERE conv_id % 2 = 0 UNION ALL SELECT message_id, CASE WHEN conv_id % 10 = 0 THEN reverse(text_sha256) ELSE text_sha256 END FROM messages WHERE conv_id % 5 = 0) GROUP BY 1")
def merged_bundles(b: Bundle):
    one = b.messages.where("conv_id % 2 = 0").select("message_id", F.col("text_sha256").alias("h"))
    two = b.messages.where("conv_id % 5 = 0").select("message_id", F.when(F.col("conv_id") % 10 == 0, F.reverse("text_sha256")).otherwise(F.col("text_sha256")).alias("h"))
    return one.unionByName(two).groupBy("message_id").agg(F.count("*").alias("copies"), (F.count_distinct("h") > 1).alias("collides"))


@register("g7_import_report", """SELECT c.source_family, c.verification_status, count(*) captures, CAST(sum(n_messages) AS BIGINT) messages, CAST(sum(k.approved) AS BIGINT) approved, CAST(sum(k.pending) AS BIGINT) pending FROM captures c
JOIN (SELECT conversation_id, count(*) FILTER (WHERE decision = 'approved') approved, count(*) FILTER (WHERE decision IS NULL) pending FROM candidates GROUP BY 1) k ON k.conversation_id = c.conversation_id GROUP BY ALL""")
def import_report(b: Bundle):
    k = b.candidates.groupBy("conversation_id").agg(F.count_if(F.col("decision") == "approved").alias("approved"), F.count_if(F.col("decision").isNull()).alias("pending"))
    return b.captures.join(k, "conversation_id").groupBy("source_family", "verification_status").agg(
        F.count("*").alias("captures"), F.sum("n_messages").alias("messages"), F.sum("approved").alias("approved"), F.sum("pending").alias("pending"))


@register("g19_declared_observed", "SELECT c.conversation_id, c.n_messages + CASE WHEN c.conv_id % 6 = 0 THEN 1 ELSE 0 END declared, count(m.message_id) observed FROM captures c LEFT JOIN messages m ON m.conversation_id = c.conversation_id GROUP BY ALL HAVING count(m.message_id) <> c.n_messages + CASE WHEN c.conv_id % 6 = 0 THEN 1 ELSE 0 END")
def declared_observed(b: Bundle):
    seen = b.messages.groupBy("conversation_id").agg(F.count("*").alias("observed"))
    declared = (F.col("n_messages") + F.when(F.col("conv_id") % 6 == 0, 1).otherwise(0)).alias("declared")
    return b.captures.select("conversation_id", declared).join(seen, "conversation_id", "left").withColumn("observed", F.coalesce("observed", F.lit(0))).where("declared <> observed")


@register("o5_priority_queue", "SELECT capture_version_id, n_messages FROM captures c WHERE n_messages <= 8 AND NOT EXISTS (SELECT 1 FROM approved a JOIN candidates k ON k.knowledge_candidate_id = a.knowledge_candidate_id WHERE k.conversation_id = c.conversation_id) ORDER BY n_messages DESC, capture_version_id LIMIT 10")
def priority_queue(b: Bundle):
    done = b.approved.join(b.candidates.select("knowledge_candidate_id", "conversation_id"), "knowledge_candidate_id").select("conversation_id")
    return b.captures.where("n_messages <= 8").join(done, "conversation_id", "left_anti").select("capture_version_id", "n_messages").orderBy(F.desc("n_messages"), "capture_version_id").limit(10)


@register("v5_export_errors", "SELECT conversation_id, concat_ws(',', CASE WHEN n_messages <> want THEN 'message_count' END, CASE WHEN verification_status <> 'complete' THEN 'not_verified' END) errors FROM (SELECT *, CASE WHEN conv_id % 8 = 0 THEN n_messages + 1 ELSE n_messages END want FROM captures WHERE source_family = 'native_export')")
def export_errors(b: Bundle):
    rows = b.captures.where("source_family = 'native_export'").withColumn("want", F.when(F.col("conv_id") % 8 == 0, F.col("n_messages") + 1).otherwise(F.col("n_messages")))
    codes = F.array_compact(F.array(F.when(F.col("n_messages") != F.col("want"), "message_count"), F.when(F.col("verification_status") != "complete", "not_verified")))
    return rows.select("conversation_id", F.array_join(codes, ",").alias("errors"))


@register("v7_attested_generations", "SELECT c.capture_version_id, sha256(string_agg(e.provenance_edge_id, ',' ORDER BY e.provenance_edge_id)) body_sha256 FROM captures c JOIN edges e ON e.conversation_id = c.conversation_id WHERE c.verification_status = 'complete' GROUP BY 1")
def attested_generations(b: Bundle):
    done = b.captures.where("verification_status = 'complete'").select("conversation_id", "capture_version_id")
    return b.edges.join(done, "conversation_id").groupBy("capture_version_id").agg(hashing.ordered_digest("provenance_edge_id", "provenance_edge_id").alias("body_sha256"))


@register("v11_repairs", "SELECT provenance_edge_id, 'repair_' || substr(sha256(provenance_edge_id || ':' || representation_sha256), 1, 32) repair_id FROM edges e JOIN captures c ON c.conversation_id = e.conversation_id WHERE c.verification_status = 'partial'")
def repairs(b: Bundle):
    old = b.captures.where("verification_status = 'partial'").select("conversation_id")
    return b.edges.join(old, "conversation_id", "left_semi").select("provenance_edge_id", hashing.hashed_id("repair", F.col("provenance_edge_id"), F.col("representation_sha256")).alias("repair_id"))


@register("k1_knowledge_detail", "SELECT a.approved_knowledge_id, r.reviewer_id, count(e.provenance_edge_id) n_evidence, string_agg(e.provenance_edge_id, ',' ORDER BY e.provenance_edge_id) edges FROM approved a JOIN reviews r ON r.human_review_event_id = a.approval_event_id JOIN edges e ON e.knowledge_candidate_id = a.knowledge_candidate_id GROUP BY ALL")
def knowledge_detail(b: Bundle):
    r = b.reviews.select(F.col("human_review_event_id").alias("approval_event_id"), "reviewer_id")
    rows = b.approved.select("approved_knowledge_id", "approval_event_id", "knowledge_candidate_id").join(r, "approval_event_id").join(b.edges.select("knowledge_candidate_id", "provenance_edge_id"), "knowledge_candidate_id")
    return rows.groupBy("approved_knowledge_id", "reviewer_id").agg(F.count("*").alias("n_evidence"), F.expr("listagg(provenance_edge_id, ',') WITHIN GROUP (ORDER BY provenance_edge_id)").alias("edges"))


@register("k2_loaded_evidence", "SELECT m.conversation_id, m.\"sequence\", string_agg(b.value, chr(10) ORDER BY b.block_sequence) evidence FROM messages m JOIN captures c ON c.conversation_id = m.conversation_id AND c.verification_status = 'complete' JOIN blocks b ON b.message_id = m.message_id AND b.block_kind <> 'empty' GROUP BY ALL")
def loaded_evidence(b: Bundle):
    done = b.captures.where("verification_status = 'complete'").select("conversation_id")
    rows = b.blocks.where("block_kind <> 'empty'").join(done, "conversation_id", "left_semi")
    return rows.groupBy("conversation_id", "sequence").agg(F.expr("listagg(value, '\n') WITHIN GROUP (ORDER BY block_sequence)").alias("evidence"))


@register("k9_evidence_references", "SELECT content_block_id, 'evidence_' || (row_number() OVER (PARTITION BY conversation_id ORDER BY \"sequence\", block_sequence)) evidence_ref FROM blocks")
def evidence_references(b: Bundle):
    n = F.row_number().over(Window.partitionBy("conversation_id").orderBy("sequence", "block_sequence"))
    return b.blocks.select("content_block_id", F.concat(F.lit("evidence_"), n.cast("string")).alias("evidence_ref"))


@register("c19_references", "SELECT 'reference_unresolved' code, message_id record_id, conversation_id || 'x' message FROM messages WHERE conv_id % 40 = 0")
def references(b: Bundle):
    moved = F.when(F.col("conv_id") % 40 == 0, F.concat("conversation_id", F.lit("x"))).otherwise(F.col("conversation_id"))
    return validators.unresolved(b.messages.withColumn("conversation_id", moved), "message_id", "conversation_id", b.captures, "conversation_id")


@register("b6_proof_receipts", "SELECT capture_version_id, sha256(capture_version_id || chr(10) || manifest_sha256 || chr(10) || n_messages) receipt_sha256 FROM captures WHERE verification_status = 'complete'")
def proof_receipts(b: Bundle):
    return b.captures.where("verification_status = 'complete'").select("capture_version_id", hashing.sha256(F.concat_ws("\n", "capture_version_id", "manifest_sha256", "n_messages")).alias("receipt_sha256"))


@register("u6_concatenated", "SELECT kind, count(*) n FROM (SELECT 'message' kind FROM messages UNION ALL SELECT 'block' FROM blocks UNION ALL SELECT 'range' FROM ranges) GROUP BY 1")
def concatenated(b: Bundle):
    parts = [df.select(F.lit(k).alias("kind")) for k, df in (("message", b.messages), ("block", b.blocks), ("range", b.ranges))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"))


@register("c10_doubly_nested", """SELECT knowledge_candidate_id FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.knowledge_candidate_id = c.knowledge_candidate_id AND NOT EXISTS (
SELECT 1 FROM captures v WHERE v.conversation_id = e.conversation_id AND v.verification_status = 'complete'))""")
def doubly_nested(b: Bundle):
    good = b.captures.where("verification_status = 'complete'").select("conversation_id")
    untrusted = b.edges.join(good, "conversation_id", "left_anti").select("knowledge_candidate_id")
    return b.candidates.join(untrusted, "knowledge_candidate_id", "left_anti").select("knowledge_candidate_id")

