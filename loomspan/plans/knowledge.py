"""Queries over knowledge, its evidence and its reviews."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import Bundle
from ..operators import provenance
from ..registry import register

TERM = "there"
LINES = """lines AS (SELECT e.*, b.role, b.value text_value FROM edges e JOIN blocks b ON b.content_block_id = e.content_block_id AND b.sha256 = e.representation_sha256),
support AS (SELECT a.approved_knowledge_id, a.knowledge_candidate_id, a.approved_s, r.reviewer_id, r.to_status review_status, cv.capture_version_id, l.conversation_id,
  l.message_id, l."sequence", l.role, l.provenance_edge_id, l.text_value FROM approved a JOIN reviews r ON r.human_review_event_id = a.approval_event_id
  JOIN lines l ON l.knowledge_candidate_id = a.knowledge_candidate_id JOIN captures cv ON cv.conversation_id = l.conversation_id)"""


@register("c1_approved_knowledge", "SELECT DISTINCT * FROM support WHERE contains(lower(text_value), 'th') ORDER BY approved_s DESC, \"sequence\", provenance_edge_id LIMIT 100", LINES)
def approved_knowledge(b: Bundle):
    return provenance.approved_query(b, "th", 100)


@register("c2_approved_evidence", "SELECT approved_knowledge_id, provenance_edge_id, conversation_id, message_id, \"sequence\", role, capture_version_id, text_value FROM support", LINES)
def approved_evidence(b: Bundle):
    return provenance.approved_evidence(b).select("approved_knowledge_id", "provenance_edge_id", "conversation_id", "message_id", "sequence", "role", "capture_version_id", "text_value")


@register("c3_candidate_evidence", "SELECT knowledge_candidate_id, provenance_edge_id, representation_kind, representation_sha256, \"sequence\", text_value FROM lines", LINES)
def candidate_evidence(b: Bundle):
    return provenance.evidence_lines(b).select("knowledge_candidate_id", "provenance_edge_id", "representation_kind", "representation_sha256", "sequence", "text_value")


@register("c4_known_conversations", """SELECT m.conversation_id, c.capture_version_id, c.verification_status, c.captured_s FROM (SELECT DISTINCT conversation_id FROM messages) m
LEFT JOIN (SELECT * FROM captures WHERE source_family = 'browser_capture') c ON c.conversation_id = m.conversation_id""")
def known_conversations(b: Bundle):
    browser = b.captures.where("source_family = 'browser_capture'").select("conversation_id", "capture_version_id", "verification_status", "captured_s")
    return b.messages.select("conversation_id").distinct().join(browser, "conversation_id", "left")


@register("c5_either_evidence_key", """SELECT content_block_id, min(via) via FROM (
  SELECT b.content_block_id, 'source' via FROM blocks b JOIN captures c ON c.conversation_id = b.conversation_id WHERE c.source_family = 'native_export'
  UNION ALL SELECT b.content_block_id, 'capture' via FROM blocks b JOIN captures c ON c.conversation_id = b.conversation_id WHERE c.verification_status = 'complete') GROUP BY 1""")
def either_evidence_key(b: Bundle):
    """An OR of two keys as two equi-joins, so that none becomes a nested loop."""
    def side(condition: str, via: str):
        keys = b.captures.where(condition).select("conversation_id")
        return b.blocks.join(keys, "conversation_id", "left_semi").select("content_block_id", F.lit(via).alias("via"))

    both = side("source_family = 'native_export'", "source").unionByName(side("verification_status = 'complete'", "capture"))
    return both.groupBy("content_block_id").agg(F.min("via").alias("via"))


@register("c6_unnest_representations", """SELECT content_block_id, kind, sha256(v) sha256 FROM (SELECT content_block_id, 'canonical_text' kind, value v FROM blocks UNION ALL SELECT content_block_id, 'lower_text', lower(value) FROM blocks)""")
def unnest_representations(b: Bundle):
    return b.representations.select("content_block_id", F.explode("representations").alias("r")).select("content_block_id", F.col("r.representation_kind").alias("kind"), "r.sha256")


@register("c7_left_unnest", "SELECT m.message_id, b.block_sequence FROM messages m LEFT JOIN (SELECT * FROM blocks WHERE block_kind = 'paragraph') b ON b.message_id = m.message_id")
def left_unnest(b: Bundle):
    blocks = F.transform(F.split("text", "\n"), lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    kept = F.filter(blocks, lambda x: F.length(x["v"]) >= 40)
    return b.messages.select("message_id", F.explode_outer(kept).alias("x")).select("message_id", F.col("x.i").cast("long").alias("block_sequence"))


@register("c9_undecided_candidates", "SELECT knowledge_candidate_id, kind, status FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.knowledge_candidate_id = c.knowledge_candidate_id)")
def undecided_candidates(b: Bundle):
    return provenance.undecided(b).select("knowledge_candidate_id", "kind", "status")


@register("v10_trusted_candidates", """SELECT knowledge_candidate_id, kind FROM candidates c WHERE EXISTS (SELECT 1 FROM edges e WHERE e.knowledge_candidate_id = c.knowledge_candidate_id)
AND NOT EXISTS (SELECT 1 FROM edges e JOIN captures v ON v.conversation_id = e.conversation_id WHERE e.knowledge_candidate_id = c.knowledge_candidate_id AND v.verification_status = 'failed')""")
def trusted_candidates(b: Bundle):
    return provenance.trusted_candidates(b).select("knowledge_candidate_id", "kind")


@register("v9_trusted_edges", """SELECT e.provenance_edge_id, e.knowledge_candidate_id FROM edges e JOIN captures v ON v.conversation_id = e.conversation_id AND v.verification_status <> 'failed'
JOIN blocks b ON b.content_block_id = e.content_block_id AND b.sha256 = e.representation_sha256""")
def trusted_edges(b: Bundle):
    good = b.captures.where("verification_status <> 'failed'").select("conversation_id")
    return provenance.evidence_lines(b).join(good, "conversation_id", "left_semi").select("provenance_edge_id", "knowledge_candidate_id")


@register("c11_first_evidence", "SELECT knowledge_candidate_id, provenance_edge_id, \"sequence\" FROM (SELECT *, row_number() OVER (PARTITION BY knowledge_candidate_id ORDER BY \"sequence\", provenance_edge_id) rn FROM edges) WHERE rn = 1")
def first_evidence(b: Bundle):
    return provenance.first_evidence(b.edges, "knowledge_candidate_id").select("knowledge_candidate_id", "provenance_edge_id", "sequence")


@register("c12_capture_counts", """SELECT c.capture_version_id, c.n_messages, (SELECT count(*) FROM blocks b WHERE b.conversation_id = c.conversation_id) n_blocks,
(SELECT count(*) FROM candidates k WHERE k.conversation_id = c.conversation_id AND k.decision = 'approved') n_approved FROM captures c""")
def capture_counts(b: Bundle):
    blocks = b.blocks.groupBy("conversation_id").agg(F.count("*").alias("n_blocks"))
    approved = b.candidates.groupBy("conversation_id").agg(F.count_if(F.col("decision") == "approved").alias("n_approved"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return b.captures.join(blocks, "conversation_id", "left").join(approved, "conversation_id", "left").select("capture_version_id", "n_messages", zero("n_blocks"), zero("n_approved"))


@register("c16_endpoint_links", """SELECT conversation_id, count(DISTINCT link) n_links FROM (SELECT conversation_id, chunk_id || '>' || nxt link FROM (
  SELECT conversation_id, chunk_id, lead(chunk_id) OVER (ORDER BY conv_id, range_no) nxt FROM ranges) WHERE nxt IS NOT NULL
  UNION ALL SELECT nc, chunk_id || '>' || nxt FROM (SELECT chunk_id, lead(chunk_id) OVER (ORDER BY conv_id, range_no) nxt, lead(conversation_id) OVER (ORDER BY conv_id, range_no) nc FROM ranges) WHERE nxt IS NOT NULL) GROUP BY 1""")
def endpoint_links(b: Bundle):
    """Links between one range and the next, within a conversation and from its last range to the first of the conversation after it; a link counts
    once for each distinct conversation at its ends."""
    own = Window.partitionBy("conversation_id").orderBy("range_no")
    within = b.ranges.select("conversation_id", "chunk_id", F.lead("chunk_id").over(own).alias("nxt"), F.col("conversation_id").alias("nc")).where("nxt is not null")
    ends = b.ranges.groupBy("conv_id", "conversation_id").agg(F.min_by("chunk_id", "range_no").alias("first"), F.max_by("chunk_id", "range_no").alias("last"))
    after = ends.select((F.col("conv_id") - 1).alias("conv_id"), F.col("first").alias("nxt"), F.col("conversation_id").alias("nc"))
    links = within.unionByName(ends.join(after, "conv_id").select("conversation_id", F.col("last").alias("chunk_id"), "nxt", "nc"))
    ends = links.select(F.concat_ws(">", "chunk_id", "nxt").alias("link"), F.explode(F.array_distinct(F.array("conversation_id", "nc"))).alias("conversation_id"))
    return ends.groupBy("conversation_id").agg(F.count_distinct("link").alias("n_links"))


@register("c21_approved_list", "SELECT approved_knowledge_id, knowledge_candidate_id, reviewer_id, provenance_edge_id, substr(text_value, 1, 80) line FROM (SELECT *, row_number() OVER (PARTITION BY approved_knowledge_id ORDER BY \"sequence\", provenance_edge_id) rn FROM support) WHERE rn = 1", LINES)
def approved_list(b: Bundle):
    lines = provenance.first_evidence(provenance.approved_evidence(b), "approved_knowledge_id")
    return lines.select("approved_knowledge_id", "knowledge_candidate_id", "reviewer_id", "provenance_edge_id", F.substring("text_value", 1, 80).alias("line"))


@register("b1_insert_or_verify", """SELECT message_id, CASE WHEN conv_id % 5 = 0 THEN 'inserted' WHEN conv_id % 7 = 0 AND "sequence" % 2 = 0 THEN 'conflict' ELSE 'existing' END outcome FROM messages""")
def insert_or_verify(b: Bundle):
    digest = F.when((F.col("conv_id") % 7 == 0) & (F.col("sequence") % 2 == 0), F.reverse("text_sha256")).otherwise(F.col("text_sha256"))
    stored = b.messages.where("conv_id % 5 <> 0").select("message_id", digest.alias("text_sha256"))
    return provenance.insert_or_verify(stored, b.messages, "message_id", "text_sha256")


@register("b4_transcript", """SELECT conversation_id, sha256(string_agg('----- ' || "sequence" || ' ' || role || ' -----' || chr(10) || text, chr(10) ORDER BY "sequence")) transcript_sha256, count(*) n FROM messages GROUP BY 1""")
def transcript(b: Bundle):
    lines = b.messages.withColumn("part", F.concat(F.lit("----- "), F.col("sequence"), F.lit(" "), F.col("role"), F.lit(" -----\n"), F.col("text")))
    return lines.groupBy("conversation_id").agg(F.expr("sha2(listagg(part, '\n') WITHIN GROUP (ORDER BY sequence), 256)").alias("transcript_sha256"), F.count("*").alias("n"))


@register("b5_hash_index", "SELECT conversation_id, sha256(string_agg(sha256 || '  ' || content_block_id, chr(10) ORDER BY content_block_id)) index_sha256 FROM blocks GROUP BY 1")
def hash_index(b: Bundle):
    rows = b.blocks.withColumn("row", F.concat_ws("  ", "sha256", "content_block_id"))
    return rows.groupBy("conversation_id").agg(F.expr("sha2(listagg(row, '\n') WITHIN GROUP (ORDER BY content_block_id), 256)").alias("index_sha256"))


@register("k3_hash_resolution", """SELECT capture_version_id record_id, 'capture' kind, manifest_sha256 sha256 FROM captures UNION ALL SELECT message_id, 'message', text_sha256 FROM messages UNION ALL SELECT content_block_id, 'block', sha256 FROM blocks""")
def hash_resolution(b: Bundle):
    return b.captures.select(F.col("capture_version_id").alias("record_id"), F.lit("capture").alias("kind"), F.col("manifest_sha256").alias("sha256")) \
        .unionByName(b.messages.select(F.col("message_id").alias("record_id"), F.lit("message").alias("kind"), F.col("text_sha256").alias("sha256"))) \
        .unionByName(b.blocks.select(F.col("content_block_id").alias("record_id"), F.lit("block").alias("kind"), "sha256"))


@register("u1_review_inbox", """SELECT * FROM (SELECT 'capture_verification' kind, capture_version_id raw_id, verification_status status, CAST(NULL AS BIGINT) occurred_s FROM captures WHERE verification_status IN ('needs_review', 'partial', 'failed')
  UNION ALL SELECT 'knowledge_candidate', c.knowledge_candidate_id, c.status, 1767225600 + c.conv_id * 60 FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.knowledge_candidate_id = c.knowledge_candidate_id)
  UNION ALL SELECT 'quarantine', message_id, 'open', created_s FROM messages WHERE length(text) < 60) ORDER BY occurred_s DESC NULLS LAST, kind, raw_id LIMIT 100""")
def review_inbox(b: Bundle):
    captures = b.captures.where(F.col("verification_status").isin("needs_review", "partial", "failed")).select(
        F.lit("capture_verification").alias("kind"), F.col("capture_version_id").alias("raw_id"), F.col("verification_status").alias("status"), F.lit(None).cast("long").alias("occurred_s"))
    open_ = provenance.undecided(b).select(F.lit("knowledge_candidate").alias("kind"), F.col("knowledge_candidate_id").alias("raw_id"), "status", (F.lit(1_767_225_600) + F.col("conv_id") * 60).alias("occurred_s"))
    held = b.messages.where(F.length("text") < 60).select(F.lit("quarantine").alias("kind"), F.col("message_id").alias("raw_id"), F.lit("open").alias("status"), F.col("created_s").alias("occurred_s"))
    return captures.unionByName(open_).unionByName(held).orderBy(F.col("occurred_s").desc_nulls_last(), "kind", "raw_id").limit(100)


@register("u2_search_corpus", f"SELECT kind, id, n FROM (SELECT 'block' kind, content_block_id id, length(value) n FROM blocks WHERE contains(lower(value), '{TERM}') UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), length(text) FROM documents WHERE contains(lower(text), '{TERM}'))")
def search_corpus(b: Bundle):
    blocks = b.blocks.where(F.contains(F.lower("value"), F.lit(TERM))).select(F.lit("block").alias("kind"), F.col("content_block_id").alias("id"), F.length("value").cast("long").alias("n"))
    docs = b.raw("documents").where(F.contains(F.lower("text"), F.lit(TERM))).select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.length("text").cast("long").alias("n"))
    return blocks.unionByName(docs)


@register("g8_provenance_report", "SELECT c.source_family, count(*) edges, count(b.content_block_id) resolved FROM edges e JOIN captures c ON c.conversation_id = e.conversation_id LEFT JOIN blocks b ON b.content_block_id = e.content_block_id AND b.sha256 = e.representation_sha256 GROUP BY 1")
def provenance_report(b: Bundle):
    found = provenance.evidence_lines(b).select("provenance_edge_id", F.lit(1).alias("hit"))
    return b.edges.join(found, "provenance_edge_id", "left").join(b.captures.select("conversation_id", "source_family"), "conversation_id") \
        .groupBy("source_family").agg(F.count("*").alias("edges"), F.count("hit").alias("resolved"))


@register("g9_status_counts", "SELECT kind, coalesce(decision, 'pending') state, count(*) n FROM candidates GROUP BY ALL")
def status_counts(b: Bundle):
    return b.candidates.groupBy("kind", F.coalesce("decision", F.lit("pending")).alias("state")).agg(F.count("*").alias("n"))


@register("g5_attestation", "SELECT conversation_id, sha256(string_agg(provenance_edge_id || ':' || representation_sha256, ',' ORDER BY provenance_edge_id)) evidence_sha256, count(*) n_edges FROM edges GROUP BY 1")
def attestation(b: Bundle):
    rows = b.edges.withColumn("item", F.concat_ws(":", "provenance_edge_id", "representation_sha256"))
    return rows.groupBy("conversation_id").agg(F.expr("sha2(listagg(item, ',') WITHIN GROUP (ORDER BY provenance_edge_id), 256)").alias("evidence_sha256"), F.count("*").alias("n_edges"))


@register("g10_snapshot", """SELECT (SELECT count(*) FROM messages) messages, (SELECT count(*) FROM blocks) blocks, (SELECT count(*) FROM candidates) candidates, (SELECT count(*) FROM approved) approved,
(SELECT count(*) FROM captures WHERE verification_status <> 'complete') open_captures, (SELECT max(occurred_s) FROM reviews) latest_review_s, (SELECT max(created_s) FROM messages) latest_message_s""")
def snapshot(b: Bundle):
    """One row of counters; each is an aggregate of its own table, so the cross joins join single rows."""
    one = lambda df, *aggs: df.agg(*aggs)
    parts = [one(b.messages, F.count("*").alias("messages"), F.max("created_s").alias("latest_message_s")), one(b.blocks, F.count("*").alias("blocks")),
             one(b.candidates, F.count("*").alias("candidates")), one(b.approved, F.count("*").alias("approved")),
             one(b.captures, F.count_if(F.col("verification_status") != "complete").alias("open_captures")), one(b.reviews, F.max("occurred_s").alias("latest_review_s"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out
