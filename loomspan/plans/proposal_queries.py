"""Queries over proposals, observations, links and topics, made from the message ranges."""

from pyspark.sql import functions as F

from ..model import Bundle
from ..operators import proposals
from ..registry import register

PROPOSED = """prop AS (SELECT knowledge_candidate_id proposal_id, conversation_id, start_sequence, range_no AS "position", conv_id, CASE WHEN conv_id % 9 = 0 THEN 'The user has decided' WHEN conv_id % 5 = 0 THEN 'Same  Statement' ELSE 'statement ' || knowledge_candidate_id END statement FROM candidates),
cit AS (SELECT p.proposal_id, m."sequence" - p.start_sequence citation_no, m.message_id, CASE WHEN (m.conv_id + m."sequence") % 6 = 0 THEN 'no such quote here' ELSE substr(m.text, 2, 12) END quote
  FROM prop p JOIN messages m ON m.conversation_id = p.conversation_id AND m."sequence" BETWEEN p.start_sequence AND p.start_sequence + 1),
found AS (SELECT c.proposal_id, c.citation_no, min_by(b.content_block_id, b.block_sequence) content_block_id FROM cit c JOIN blocks b ON b.message_id = c.message_id AND contains(b.value, c.quote) GROUP BY ALL)"""


def _proposed(b: Bundle):
    statement = F.when(F.col("conv_id") % 9 == 0, "The user has decided").when(F.col("conv_id") % 5 == 0, "Same  Statement").otherwise(F.concat(F.lit("statement "), F.col("knowledge_candidate_id")))
    p = b.candidates.select(F.col("knowledge_candidate_id").alias("proposal_id"), "conversation_id", "start_sequence", F.concat_ws(":", F.lpad(F.col("conv_id").cast("string"), 9, "0"), "range_no").alias("position"), "conv_id", statement.alias("statement"))
    m = b.messages.select("conversation_id", "message_id", "sequence", "text", F.col("conv_id").alias("c"))
    cited = p.select("proposal_id", "conversation_id", "start_sequence").join(m, "conversation_id").where(F.col("sequence").between(F.col("start_sequence"), F.col("start_sequence") + 1))
    quote = F.when((F.col("c") + F.col("sequence")) % 6 == 0, "no such quote here").otherwise(F.substring("text", 2, 12))
    return p, cited.select("proposal_id", (F.col("sequence") - F.col("start_sequence")).alias("citation_no"), "message_id", quote.alias("quote"))


@register("i6_cited_blocks", "SELECT c.proposal_id, c.citation_no, f.content_block_id FROM cit c LEFT JOIN found f ON f.proposal_id = c.proposal_id AND f.citation_no = c.citation_no", PROPOSED)
def cited_blocks(b: Bundle):
    return proposals.cited_blocks(_proposed(b)[1], b.blocks)


@register("i6_proposal_issues", """SELECT 'quote_not_found' code, c.proposal_id record_id, CAST(c.citation_no AS VARCHAR) message FROM cit c WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.proposal_id = c.proposal_id AND f.citation_no = c.citation_no)
UNION ALL SELECT 'duplicate_statement', proposal_id, first_id FROM (SELECT proposal_id, first_value(proposal_id) OVER w first_id, row_number() OVER w n FROM prop WINDOW w AS (PARTITION BY trim(regexp_replace(lower(statement), '\\s+', ' ', 'g')) ORDER BY lpad(CAST(conv_id AS VARCHAR), 9, '0') || ':' || "position")) WHERE n > 1
UNION ALL SELECT 'authority_without_user', proposal_id, '' FROM prop p WHERE statement = 'The user has decided' AND NOT EXISTS (SELECT 1 FROM cit c JOIN messages m ON m.message_id = c.message_id WHERE c.proposal_id = p.proposal_id AND m.role = 'user')""", PROPOSED)
def proposal_issues(b: Bundle):
    p, c = _proposed(b)
    return proposals.proposal_issues(p, c, b.blocks)


@register("i10_accumulated", "SELECT url, min(page_id) page_id, count(*) n, count(DISTINCT length(html)) > 1 conflict FROM pages GROUP BY 1")
def accumulated(b: Bundle):
    return proposals.accumulate(b.raw("pages").withColumn("size", F.length("html")), "url", "page_id", "size")


LINKS = """lk0 AS (SELECT *, lag(chunk_id) OVER (PARTITION BY conversation_id ORDER BY range_no) prev, chunk_id || '#' other FROM ranges),
lk AS (SELECT conv_id, range_no, chunk_id from_id, unnest([prev, prev, chunk_id, 'none', prev, prev]) to_id, unnest([' follows', 'follows', 'follows', 'follows', '  ', 'cites']) kind,
  unnest([CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 3 = 1 THEN 1.5 ELSE 0.25 END, 0.75, 0.5, 0.5, 0.5, CASE WHEN range_no % 2 = 0 THEN -0.5 ELSE 1.0 END]) confidence,
  unnest(['{"first":true}', '{"first":false}', '{}', '{}', '{}', CASE WHEN conv_id % 2 = 0 THEN '[1]' ELSE '{"n":' || range_no || '}' END]) payload, unnest([0, 1, 2, 3, 4, 5]) pos FROM lk0)"""


@register("i30_clean_links", """SELECT from_id, to_id, trim(kind) kind, CASE WHEN starts_with(arg_min(payload, pos), '{') THEN arg_min(payload, pos) ELSE '{}' END payload,
CAST(CASE WHEN arg_min(coalesce(confidence, -1), pos) BETWEEN 0 AND 1 THEN arg_min(coalesce(confidence, -1), pos) ELSE 0.8 END AS DOUBLE) confidence FROM lk WHERE to_id IN (SELECT chunk_id FROM ranges) AND from_id <> to_id AND trim(kind) <> '' GROUP BY 1, 2, 3""", LINKS)
def clean_links(b: Bundle):
    """Six links from every range: the same one twice, to itself, to nothing, of no kind, and of another kind with other payloads."""
    r = b.ranges.select("conversation_id", "conv_id", "range_no", "chunk_id")
    before = r.select("conversation_id", (F.col("range_no") + 1).alias("range_no"), F.col("chunk_id").alias("prev"))
    r = r.join(before, ["conversation_id", "range_no"], "left")

    def link(to, kind: str, confidence, payload):
        return F.struct(to.alias("to_id"), F.lit(kind).alias("kind"), confidence.cast("double").alias("confidence"), payload.alias("payload"))

    half, none = F.lit(0.5), F.lit("{}")
    first = F.when(F.col("conv_id") % 3 == 1, 1.5).when(F.col("conv_id") % 3 == 2, 0.25)
    other = F.when(F.col("conv_id") % 2 == 0, "[1]").otherwise(F.concat(F.lit('{"n":'), F.col("range_no").cast("string"), F.lit("}")))
    links = F.array(link(F.col("prev"), " follows", first, F.lit('{"first":true}')), link(F.col("prev"), "follows", F.lit(0.75), F.lit('{"first":false}')), link(F.col("chunk_id"), "follows", half, none),
                    link(F.lit("none"), "follows", half, none), link(F.col("prev"), "  ", half, none), link(F.col("prev"), "cites", F.when(F.col("range_no") % 2 == 0, -0.5).otherwise(1.0), other))
    told = r.select(F.col("chunk_id").alias("from_id"), F.posexplode(links).alias("position", "l")).select("from_id", "position", "l.*")
    return proposals.clean_links(told, b.ranges, "chunk_id")


@register("i25_topic_coverage", """SELECT CASE n WHEN 0 THEN 'message_not_covered' ELSE 'message_covered_twice' END code, message_id record_id, CAST(n AS VARCHAR) message FROM (
SELECT m.message_id, count(t.chunk_id) n FROM messages m LEFT JOIN (SELECT conversation_id, chunk_id, start_sequence, CASE WHEN range_no % 2 = 0 THEN end_sequence + 1 ELSE end_sequence END e FROM ranges WHERE conv_id % 8 <> 0 OR range_no > 0) t
ON t.conversation_id = m.conversation_id AND m."sequence" BETWEEN t.start_sequence AND t.e GROUP BY 1) WHERE n <> 1""")
def topic_coverage(b: Bundle):
    end = F.when(F.col("range_no") % 2 == 0, F.col("end_sequence") + 1).otherwise(F.col("end_sequence"))
    topics = b.ranges.where("conv_id % 8 <> 0 or range_no > 0").select("conversation_id", F.col("chunk_id").alias("topic_id"), "start_sequence", end.alias("end_sequence"))
    return proposals.uncovered(topics, b.messages)


_SHA = "0" * 64
#: Metadata by the remainder of an event's id, and the faults that it has as (code, key).
METADATA = [
    ('{"stage":"capture","progress_current":3,"retry_safe":true,"archive_manifest_sha256":"' + _SHA + '"}', []),
    ('{"attempt":1}', [("metadata_key_not_allowed", "attempt")]),
    ('{"stage":{"a":1}}', [("metadata_value_not_scalar", "stage")]),
    ('{"message_count":-1}', [("metadata_number_required", "message_count")]),
    ('{"message_count":1.5,"timeout_seconds":"9"}', [("metadata_number_required", "message_count"), ("metadata_number_required", "timeout_seconds")]),
    ('{"retry_safe":"yes"}', [("metadata_boolean_required", "retry_safe")]),
    ('{"delivery_receipt_sha256":"' + "A" * 64 + '"}', [("metadata_sha256_required", "delivery_receipt_sha256")]),
    ('{"stage":"' + "x" * 241 + '"}', [("metadata_text_too_long", "stage")]),
    ('{"stage":"a\\nb"}', [("metadata_text_too_long", "stage")]),
    ('{"stage":"C:/x"}', [("metadata_private_path", "stage")]),
    ('{"stage":"see /home/me"}', [("metadata_private_path", "stage")]),
    ('{"reason_code":"HTTPS://x"}', [("metadata_address", "reason_code")]),
    ('{"reason_code":"Bearer x"}', [("metadata_sensitive", "reason_code")]),
    ('{"reason_code":"file:///etc/Cookie"}', [("metadata_private_path", "reason_code"), ("metadata_address", "reason_code"), ("metadata_sensitive", "reason_code")]),
    ('{"safe_error_code":"boom"}', [("error_code_not_allowed", "safe_error_code")]),
    ('{"safe_error_code":"stale_timeout","safe_error_summary":"' + proposals.ERROR_SUMMARIES["stale_timeout"] + '"}', []),
    ('{"safe_error_code":"stale_timeout","safe_error_summary":"other"}', [("error_summary_differs", "safe_error_summary")]),
    ('{"safe_error_summary":"other"}', [("error_summary_without_code", "safe_error_summary")]),
    ("[1]", [("metadata_not_an_object", "")]),
    ("{", [("metadata_not_an_object", "")]),
    ('{"stage":null,"identity_verified":null,"message_count":null}', [("metadata_boolean_required", "identity_verified"), ("metadata_number_required", "message_count")]),
    ('{"progress_total":9007199254740992}', [("metadata_number_required", "progress_total")]),
    ('{"stage":"' + "é" * 240 + '","progress_total":9007199254740991}', []),
]


@register("v25_metadata_issues", f"""SELECT f.code, CAST(e.event_id AS VARCHAR) record_id, f.key message FROM events e JOIN (VALUES {", ".join(f"({i}, '{c}', '{k}')" for i, (_, faults) in enumerate(METADATA) for c, k in faults)}) f(n, code, key) ON e.event_id % {len(METADATA)} = f.n""")
def metadata_issues(b: Bundle):
    text = F.element_at(F.array(*(F.lit(t) for t, _ in METADATA)), (F.col("event_id") % len(METADATA) + 1).cast("int"))
    return proposals.metadata_issues(b.raw("events").select(F.col("event_id").cast("string").alias("event_id"), text.alias("metadata")), "event_id", "metadata")


@register("c20_resolved_provenance", """SELECT e.provenance_edge_id, coalesce('source:' || s.conversation_id, 'capture:' || c.capture_version_id) source_identity FROM edges e
LEFT JOIN (SELECT conversation_id FROM captures WHERE source_family = 'native_export') s ON s.conversation_id = e.conversation_id LEFT JOIN (SELECT conversation_id, capture_version_id FROM captures WHERE conv_id % 3 <> 0) c ON c.conversation_id = e.conversation_id""")
def resolved_provenance(b: Bundle):
    s = b.captures.where("source_family = 'native_export'").select("conversation_id", F.concat(F.lit("source:"), "conversation_id").alias("s"))
    c = b.captures.where("conv_id % 3 <> 0").select("conversation_id", F.concat(F.lit("capture:"), "capture_version_id").alias("c"))
    return b.edges.join(s, "conversation_id", "left").join(c, "conversation_id", "left").select("provenance_edge_id", F.coalesce("s", "c").alias("source_identity"))


@register("g18_link_counts", "SELECT source, count(DISTINCT link) n_links FROM (SELECT unnest(list_distinct([c.source_family, CASE WHEN c.conv_id % 3 = 0 THEN 'native_export' ELSE 'browser_capture' END])) source, r.chunk_id link FROM ranges r JOIN captures c ON c.conversation_id = r.conversation_id) GROUP BY 1")
def link_counts(b: Bundle):
    other = F.when(F.col("conv_id") % 3 == 0, "native_export").otherwise("browser_capture")
    both = b.ranges.select("conversation_id", "chunk_id").join(b.captures.select("conversation_id", "source_family", "conv_id"), "conversation_id")
    return both.select("chunk_id", F.explode(F.array_distinct(F.array("source_family", other))).alias("source")).groupBy("source").agg(F.count_distinct("chunk_id").alias("n_links"))


@register("g3_message_spans", "SELECT conversation_id, min(created_s) first_s, max(coalesce(CASE WHEN role = 'assistant' THEN created_s END, 0)) latest_answer_s, count(DISTINCT message_id) FILTER (WHERE role = 'user') asked, count(*) FILTER (WHERE text = '') empty_texts FROM messages GROUP BY 1")
def message_spans(b: Bundle):
    return b.messages.groupBy("conversation_id").agg(
        F.min("created_s").alias("first_s"), F.max(F.coalesce(F.when(F.col("role") == "assistant", F.col("created_s")), F.lit(0))).alias("latest_answer_s"),
        F.count_distinct(F.when(F.col("role") == "user", F.col("message_id"))).alias("asked"), F.count_if(F.col("text") == "").alias("empty_texts"))
