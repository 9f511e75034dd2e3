"""Validators and audits over the model; some run over tables with injected faults."""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..model import Bundle
from ..operators import validators
from ..registry import register

FAULTS = """bad AS (SELECT message_id, CASE WHEN conv_id % 15 = 0 AND "sequence" = 1 THEN 'ws_other' ELSE workspace_id END workspace_id, CASE WHEN conv_id % 21 = 0 AND "sequence" = 0 THEN 'conversation_none' ELSE conversation_id END conversation_id,
  "sequence", text, CASE WHEN conv_id % 12 = 0 AND "sequence" = 2 THEN reverse(text_sha256) ELSE text_sha256 END text_sha256, role FROM messages
  UNION ALL SELECT message_id, workspace_id, conversation_id, "sequence", text, text_sha256, role FROM messages WHERE conv_id % 25 = 0 AND "sequence" = 0)"""


def faulty(b: Bundle):
    """Messages with foreign workspaces, unresolved conversations, wrong hashes and repeated ids."""
    def at(mod, seq):
        return (F.col("conv_id") % mod == 0) & (F.col("sequence") == seq)

    m = b.messages
    bad = m.select("message_id", F.when(at(15, 1), "ws_other").otherwise(F.col("workspace_id")).alias("workspace_id"), F.when(at(21, 0), "conversation_none").otherwise(F.col("conversation_id")).alias("conversation_id"),
                   "sequence", "text", F.when(at(12, 2), F.reverse("text_sha256")).otherwise(F.col("text_sha256")).alias("text_sha256"), "role")
    return bad.unionByName(m.where(at(25, 0)).select(*bad.columns))


@register("v1_invariants", """SELECT 'duplicate_id' code, message_id record_id, CAST(count(*) AS VARCHAR) message FROM bad GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'hash_mismatch', message_id, text_sha256 FROM bad WHERE sha256(text) <> text_sha256
UNION ALL SELECT CASE WHEN c.conversation_id IS NULL THEN 'reference_unresolved' ELSE 'cross_workspace_reference' END, b.message_id, b.conversation_id FROM bad b LEFT JOIN captures c ON c.conversation_id = b.conversation_id
  WHERE c.conversation_id IS NULL OR c.workspace_id <> b.workspace_id""", FAULTS)
def invariants(b: Bundle):
    bad = faulty(b)
    return validators.union(validators.duplicates(bad, "message_id"), validators.wrong_hash(bad, "message_id", "text", "text_sha256"),
                            validators.unresolved(bad, "message_id", "conversation_id", b.captures, "conversation_id"))


@register("v2_sound_model", """SELECT 'sequence_not_contiguous' code, message_id record_id, CAST("sequence" AS VARCHAR) message FROM messages WHERE conv_id % 9 = 0 AND "sequence" > 1
UNION ALL SELECT 'reference_unresolved', provenance_edge_id, content_block_id FROM edges WHERE message_id IN (SELECT message_id FROM messages WHERE conv_id % 19 = 0 AND "sequence" = 0)""")
def sound_model(b: Bundle):
    """Of the model's rules, those hold that no fault was planted for: one turn in nine conversations and the blocks of some first messages are missing."""
    gone = b.messages.where("conv_id % 19 = 0 and sequence = 0").select("message_id")
    return validators.union(
        validators.duplicates(b.blocks, "content_block_id"), validators.wrong_hash(b.blocks, "content_block_id", "value", "sha256"), validators.not_contiguous(b.messages.where("not (conv_id % 9 = 0 and sequence = 1)"), "conversation_id", "sequence", "message_id"),
        validators.unresolved(b.edges, "provenance_edge_id", "content_block_id", b.blocks.join(gone, "message_id", "left_anti"), "content_block_id"), validators.unresolved(b.approved, "approved_knowledge_id", "approval_event_id", b.reviews, "human_review_event_id"))


@register("v3_completion_errors", """SELECT capture_version_id, concat_ws(',', CASE WHEN n_messages < 3 THEN 'too_few_messages' END, CASE WHEN verification_status = 'failed' THEN 'capture_failed' END,
CASE WHEN NOT EXISTS (SELECT 1 FROM candidates k WHERE k.conversation_id = c.conversation_id AND k.decision IS NOT NULL) THEN 'no_decision' END) errors FROM captures c""")
def completion_errors(b: Bundle):
    """One ordered list of error codes for each generation, from one-row aggregates."""
    decided = b.candidates.groupBy("conversation_id").agg(F.count("decision").alias("decided"))
    codes = F.array_compact(F.array(F.when(F.col("n_messages") < 3, "too_few_messages"), F.when(F.col("verification_status") == "failed", "capture_failed"),
                                    F.when(F.coalesce("decided", F.lit(0)) == 0, "no_decision")))
    return b.captures.join(decided, "conversation_id", "left").select("capture_version_id", F.array_join(codes, ",").alias("errors"))


@register("v8_trust_states", "SELECT capture_version_id, CASE verification_status WHEN 'complete' THEN 'trusted' WHEN 'partial' THEN 'repaired' WHEN 'failed' THEN 'retired' ELSE 'quarantined' END state FROM captures")
def trust_states(b: Bundle):
    s = F.col("verification_status")
    return b.captures.select("capture_version_id", F.when(s == "complete", "trusted").when(s == "partial", "repaired").when(s == "failed", "retired").otherwise("quarantined").alias("state"))


@register("v12_illegal_transitions", """SELECT 'illegal_transition' code, message_id record_id, p || '>' || role message FROM (SELECT message_id, role, lag(role) OVER (PARTITION BY conversation_id ORDER BY "sequence") p
FROM messages WHERE NOT (conv_id % 7 = 0 AND "sequence" = 1)) WHERE p IS NOT NULL AND (p || '>' || role) NOT IN ('user>assistant', 'assistant>user', 'system_visible>user')""")
def illegal_transitions(b: Bundle):
    """Of one conversation in seven, the second message is missing."""
    from pyspark.sql import Window

    steps = b.messages.where("not (conv_id % 7 = 0 and sequence = 1)").withColumn("p", F.lag("role").over(Window.partitionBy("conversation_id").orderBy("sequence"))).where("p is not null")
    return validators.illegal_transitions(steps, "message_id", "p", "role", {("user", "assistant"), ("assistant", "user"), ("system_visible", "user")})


@register("v16_exactly_one_version", "SELECT 'exactly_one_required' code, message_id record_id, CAST(n AS VARCHAR) message FROM (SELECT message_id, CAST(conv_id % 2 = 0 AS INTEGER) + CAST(conv_id % 3 = 0 AS INTEGER) n FROM messages) WHERE n <> 1")
def exactly_one_version(b: Bundle):
    m = b.messages.select("message_id", F.when(F.col("conv_id") % 2 == 0, F.lit("s")).alias("source_version_id"), F.when(F.col("conv_id") % 3 == 0, F.lit("c")).alias("capture_version_id"))
    return validators.not_exactly_one(m, "message_id", "source_version_id", "capture_version_id")


@register("p25_value_domains", "SELECT 'value_not_allowed' code, message_id record_id, role message FROM messages WHERE role NOT IN ('user', 'assistant')")
def value_domains(b: Bundle):
    return validators.outside_domain(b.messages, "message_id", "role", ["user", "assistant"])


CHECKS = """checks AS (SELECT conversation_id, 'has_messages' check_id, CASE WHEN n_messages > 2 THEN 'pass' ELSE 'fail' END status, 'material' severity FROM captures
UNION ALL SELECT conversation_id, 'even_turns', CASE WHEN n_messages % 2 = 0 THEN 'pass' ELSE 'fail' END, 'warning' FROM captures
UNION ALL SELECT conversation_id, 'branches', CASE WHEN conv_id % 4 = 0 THEN 'not_observed' ELSE 'pass' END, 'warning' FROM captures)"""


@register("v22_g17_verdicts", """SELECT conversation_id, CASE WHEN bool_or(status = 'fail' AND severity = 'material') THEN 'failed' WHEN bool_or(status = 'fail') THEN 'needs_review' WHEN bool_or(status = 'not_observed') THEN 'partial' ELSE 'complete' END status
FROM checks GROUP BY 1""", CHECKS)
def verdicts(b: Bundle):
    c = b.captures

    def check(name, status, severity):
        return c.select("conversation_id", F.lit(name).alias("check_id"), status.alias("status"), F.lit(severity).alias("severity"))

    rows = validators.union(
        check("has_messages", F.when(F.col("n_messages") > 2, "pass").otherwise("fail"), "material"), check("even_turns", F.when(F.col("n_messages") % 2 == 0, "pass").otherwise("fail"), "warning"),
        check("branches", F.when(F.col("conv_id") % 4 == 0, "not_observed").otherwise("pass"), "warning"))
    return validators.verdict(rows, "conversation_id")


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, n, ids) of (k, content_block_id) rows sorted by both: the number of ids and the hash of their list, of texts that stand more than once."""
    text, n, digest = None, 0, hashlib.sha256()
    for batch in batches:
        told = []
        for k, block in zip(batch.column("k").to_pylist(), batch.column("content_block_id").to_pylist()):
            if k != text:
                if n > 1:
                    told.append((text, n, digest.hexdigest()))
                text, n, digest = k, 0, hashlib.sha256()
            digest.update(("," + block if n else block).encode())
            n += 1
        yield _digest_rows(told)
    yield _digest_rows([(text, n, digest.hexdigest())] if n > 1 else [])


def _digest_rows(told: list[tuple]) -> pa.RecordBatch:
    k, n, ids = zip(*told) if told else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(n, pa.int64()), pa.array(ids, pa.string())], ["k", "n", "ids"])


@register("g6_duplicate_statements", """SELECT k, n, ids FROM (SELECT trim(regexp_replace(lower(value), '\\s+', ' ', 'g')) k, count(*) n, sha256(string_agg(content_block_id, ',' ORDER BY content_block_id)) ids FROM blocks GROUP BY 1) WHERE n > 1""")
def duplicate_statements(b: Bundle):
    """Statements that stand in several blocks, empty ones too, with the hash of their blocks' ids in order.  The ids are hashed as a sorted stream: no list of them is
    gathered, as one text may be in a third of all blocks.  That text's stream is one task's, as the hash of one list can only be taken in order."""
    from ..functions.textops import normalized

    rows = b.blocks.select(normalized(F.col("value")).alias("k"), "content_block_id")
    return rows.repartition("k").sortWithinPartitions("k", "content_block_id").mapInArrow(_id_digests, "k string, n long, ids string")


@register("g20_quality_audit", """SELECT (SELECT count(*) FROM candidates) candidates, (SELECT count(*) FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.knowledge_candidate_id = c.knowledge_candidate_id)) without_evidence,
(SELECT count(*) FROM (SELECT 1 FROM blocks WHERE block_kind <> 'empty' GROUP BY lower(value) HAVING count(*) > 1)) repeated_statements""")
def quality_audit(b: Bundle):
    bare = b.candidates.join(b.edges.select("knowledge_candidate_id"), "knowledge_candidate_id", "left_anti").agg(F.count("*").alias("without_evidence"))
    repeated = b.blocks.where("block_kind <> 'empty'").groupBy(F.lower("value")).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated_statements"))
    return b.candidates.agg(F.count("*").alias("candidates")).crossJoin(bare).crossJoin(repeated)  # single rows


@register("v18_inventory_integrity", """SELECT 'duplicate_id' code, url record_id, CAST(count(*) AS VARCHAR) message FROM (SELECT url FROM pages UNION ALL SELECT url FROM pages WHERE page_id % 20 = 0) GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'hash_mismatch', CAST(page_id AS VARCHAR), reverse(sha256(html)) FROM pages WHERE page_id % 25 = 0""")
def inventory_integrity(b: Bundle):
    """Repeated addresses and wrong evidence hashes of an inventory, in which some of both are planted."""
    pages = b.raw("pages")
    digest = F.sha2(F.col("html").cast("binary"), 256)
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.when(F.col("page_id") % 25 == 0, F.reverse(digest)).otherwise(digest).alias("evidence_sha256"))
    return validators.union(validators.duplicates(rows.select("url").unionByName(pages.where("page_id % 20 = 0").select("url")), "url"),
                            validators.wrong_hash(rows, "page_id", "html", "evidence_sha256"))
