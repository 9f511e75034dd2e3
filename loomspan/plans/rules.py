"""Completion, transition and request rules, bounded listings and projections over whole tables; faults are planted for every code."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing, textops
from ..model import Bundle
from ..operators import guards
from ..registry import register

RUNS = """runs AS (SELECT c.conversation_id, c.conv_id, c.conv_id % 23 k, c.verification_status, c.n_messages, nb.n_blocks, nr.n_chunks FROM captures c
 JOIN (SELECT conversation_id, count(*) n_blocks FROM blocks GROUP BY 1) nb ON nb.conversation_id = c.conversation_id
 JOIN (SELECT conversation_id, count(*) n_chunks FROM ranges GROUP BY 1) nr ON nr.conversation_id = c.conversation_id),
ex AS (SELECT *, CASE WHEN k <> 1 THEN n_messages + CASE WHEN k = 6 THEN 1 ELSE 0 END END em, CASE WHEN k <> 2 THEN n_blocks + CASE WHEN k = 7 THEN 1 ELSE 0 END END eb,
 CASE WHEN k <> 3 THEN n_chunks + CASE WHEN k = 9 THEN 1 ELSE 0 END END ec FROM runs),
cov AS (SELECT conversation_id, count(*) chunks, bool_and(CASE WHEN p IS NULL THEN s = 0 ELSE s = p + 1 END) gapless, max(e) last FROM (
  SELECT conversation_id, start_sequence s, end_sequence e, lag(end_sequence) OVER (PARTITION BY conversation_id ORDER BY start_sequence) p FROM ranges WHERE NOT (conv_id % 23 = 10 AND range_no = 0)) GROUP BY 1),
st AS (SELECT e.*, coalesce(cov.chunks, 0) chunks, coalesce(cov.gapless, true) AND coalesce(cov.last, -1) = coalesce(e.em, 0) - 1 covered,
  (SELECT count(*) FROM candidates c WHERE c.conversation_id = e.conversation_id AND NOT (e.k = 11 AND c.range_no = 0) AND NOT (e.k = 10 AND c.range_no = 0)) proposed,
  n_blocks - (SELECT count(*) FROM blocks b WHERE b.conversation_id = e.conversation_id AND (e.k = 12 AND b."sequence" = 0 OR e.k = 10 AND floor(b."sequence" / 5) = 0)) resolved,
  1 + n_messages + n_blocks - CASE WHEN k = 13 THEN 1 ELSE 0 END resolutions, CASE WHEN em = n_messages AND ec = n_chunks AND k <> 8 THEN 1 ELSE 0 END checkpoints
  FROM ex e LEFT JOIN cov ON cov.conversation_id = e.conversation_id),
errs AS (SELECT conversation_id, k, verification_status, CASE WHEN k = 0 THEN 'run_missing' WHEN k = 5 THEN 'capture_missing' ELSE concat_ws(',', CASE WHEN em IS NULL THEN 'expected_message_count_missing' END,
 CASE WHEN eb IS NULL THEN 'expected_content_block_count_missing' END, CASE WHEN ec IS NULL THEN 'expected_chunk_count_missing' END, CASE WHEN k = 4 THEN 'fatal_error_count_nonzero' END,
 CASE WHEN em IS DISTINCT FROM n_messages THEN 'message_count_mismatch' END, CASE WHEN eb IS DISTINCT FROM n_blocks THEN 'content_block_count_mismatch' END,
 CASE WHEN checkpoints <> 1 THEN 'checkpoint_incomplete' END, CASE WHEN ec IS DISTINCT FROM chunks THEN 'chunk_count_mismatch' END, CASE WHEN NOT covered THEN 'chunk_coverage_invalid' END,
 CASE WHEN ec IS DISTINCT FROM proposed THEN 'candidate_count_or_status_invalid' END, CASE WHEN eb IS DISTINCT FROM resolved THEN 'provenance_resolution_invalid' END,
 CASE WHEN 1 + coalesce(em, 0) + coalesce(eb, 0) <> resolutions THEN 'source_hash_resolution_invalid' END, CASE WHEN k = 14 THEN 'fatal_quarantine_open' END,
 CASE WHEN k = 15 THEN 'fatal_dead_letter_present' END, CASE WHEN verification_status <> 'complete' THEN 'capture_verification_incomplete' END) END errors FROM st)"""


def counted_runs(b: Bundle):
    """One run a conversation with its expected and actual counts; every code has planted conversations (k is conv_id % 23)."""
    k, none = F.col("conv_id") % 23, F.lit(None).cast("long")
    at = lambda n: (k == n).cast("int")
    ranges = b.ranges.where(~((k == 10) & (F.col("range_no") == 0)))
    before = F.lag("end_sequence").over(Window.partitionBy("conversation_id").orderBy("start_sequence"))
    chunks = ranges.withColumn("p", before).groupBy("conversation_id").agg(
        F.count("*").alias("chunks"), F.bool_and(F.col("start_sequence") == F.coalesce(F.col("p") + 1, F.lit(0))).alias("gapless"), F.max("end_sequence").alias("last"))
    every = b.ranges.groupBy("conversation_id").agg(F.count("*").alias("all_chunks"))
    blocks = b.blocks.groupBy("conversation_id").agg(F.count("*").alias("blocks"))
    proposed = b.candidates.withColumn("status", F.when((k == 11) & (F.col("range_no") == 0), "withdrawn").otherwise(F.col("status"))) \
        .join(ranges.select("chunk_id"), "chunk_id", "left_semi").where("status = 'proposed'").groupBy("conversation_id").agg(F.count("*").alias("proposed"))
    hashes = b.edges.withColumn("conv", F.col("conversation_id")).join(b.captures.select("conversation_id", "conv_id"), "conversation_id").withColumn(
        "representation_sha256", F.when((k == 12) & (F.col("sequence") == 0), F.reverse("representation_sha256")).otherwise(F.col("representation_sha256")))
    whole = b.blocks.select("content_block_id", F.col("sha256").alias("representation_sha256"))
    edges = hashes.where(~((k == 10) & (F.col("range_no") == 0))).join(whole, ["content_block_id", "representation_sha256"]).groupBy("conversation_id").agg(F.count("*").alias("resolved_edges"))
    rows = b.captures
    for side in (every, chunks, blocks, proposed, edges):
        rows = rows.join(side, "conversation_id", "left")
    expected = lambda c, null, more: F.when(k != null, F.col(c) + at(more)).otherwise(none)
    rows = rows.withColumn("messages", F.col("n_messages")).withColumn("expected_messages", expected("n_messages", 1, 6)) \
        .withColumn("expected_blocks", expected("blocks", 2, 7)).withColumn("expected_chunks", expected("all_chunks", 3, 9))
    done = F.col("expected_messages").eqNullSafe(F.col("n_messages")) & F.col("expected_chunks").eqNullSafe(F.col("all_chunks")) & (k != 8)
    return rows.withColumn("has_run", k != 0).withColumn("has_capture", k != 5).withColumn("fatal_errors", at(4)).withColumn("checkpoints", done.cast("int")) \
        .withColumn("covered", F.coalesce("gapless", F.lit(True)) & (F.coalesce("last", F.lit(-1)) == F.coalesce("expected_messages", F.lit(0)) - 1)) \
        .withColumn("resolutions", 1 + F.col("n_messages") + F.col("blocks") - at(13)).withColumn("open_quarantine", at(14)).withColumn("dead_letters", at(15)) \
        .withColumn("complete", F.col("verification_status") == "complete")


@register("v3_capture_completion", "SELECT conversation_id, errors FROM errs", RUNS)
def capture_completion(b: Bundle):
    return guards.completion_errors(counted_runs(b)).select("conversation_id", F.array_join("errors", ",").alias("errors"))


@register("v6_completion_by_run_type", """SELECT conversation_id, CASE WHEN conv_id % 5 = 0 THEN 'extraction' WHEN source_family = 'native_export' THEN 'export' ELSE 'capture' END rules FROM captures""")
def completion_by_run_type(b: Bundle):
    """Which rules hold for a run: extraction runs first, then native exports, then captures; two semi-joins as flags."""
    extraction = b.captures.where("conv_id % 5 = 0").select("conversation_id", F.lit(True).alias("extraction"))
    export = b.captures.where("source_family = 'native_export'").select("conversation_id", F.lit(True).alias("export"))
    rows = b.captures.join(extraction, "conversation_id", "left").join(export, "conversation_id", "left")
    return rows.select("conversation_id", F.when(F.col("extraction"), "extraction").when(F.col("export"), "export").otherwise("capture").alias("rules"))


@register("v15_fatal_quarantine", """SELECT conversation_id, CASE WHEN k = 0 THEN 'missing' WHEN k IN (14, 15) THEN 'failed' WHEN errors = '' THEN 'completed' ELSE 'running' END run_status,
CASE WHEN k IN (14, 15) AND replace(replace(errors, 'fatal_quarantine_open', ''), 'fatal_dead_letter_present', '') = '' THEN 'fatal_after_completion' END error FROM errs""", RUNS)
def fatal_quarantine(b: Bundle):
    """A run with fatal evidence is failed; fatal evidence on a run that is complete but for it is an error."""
    rows = guards.completion_errors(counted_runs(b))
    fatal = (F.col("open_quarantine") > 0) | (F.col("dead_letters") > 0)
    rest = F.array_except("errors", F.array(F.lit("fatal_quarantine_open"), F.lit("fatal_dead_letter_present")))
    return rows.select("conversation_id", F.when(~F.col("has_run"), "missing").when(fatal, "failed").when(F.size("errors") == 0, "completed").otherwise("running").alias("run_status"),
                       F.when(fatal & (F.size(rest) == 0), "fatal_after_completion").alias("error"))


PAIRS = """pairs AS (SELECT list_extract(['workspace', 'quarantine', 'dead_letter', 'checkpoint'], CAST(s_suppkey % 4 + 1 AS INTEGER)) kind, s_suppkey row_id, s_suppkey % 7 k FROM supplier)"""


def row_pairs(b: Bundle):
    k = F.col("k")
    s = b.raw("supplier").select(F.element_at(F.array(*map(F.lit, ("workspace", "quarantine", "dead_letter", "checkpoint"))), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("kind"),
                                 F.col("s_suppkey").alias("row_id"), "s_name", (F.col("s_suppkey") % 7).alias("k"))
    first = F.when(F.col("kind") == "workspace", "suspended").when(F.col("kind") == "quarantine", "released").otherwise("open")
    return s.select("kind", "row_id", F.col("s_name").alias("old_name"), F.when(k == 0, None).when(k == 1, F.lower("s_name")).otherwise(F.col("s_name")).alias("new_name"),
                    F.lit("a").alias("old_record_sha256"), F.when(k == 2, "b").otherwise("a").alias("new_record_sha256"),
                    first.alias("old_status"), F.when((k == 3) & (first == "suspended"), "active").when(k == 3, "open").otherwise(first).alias("new_status"),
                    F.lit(5).alias("old_progress"), F.when(k == 4, 4).otherwise(6).alias("new_progress"))


@register("v13_transition_guards", """SELECT kind, row_id, error FROM (SELECT kind, row_id, CASE WHEN k = 0 THEN 'row_deleted' WHEN k = 1 THEN 'content_immutable' WHEN k = 2 AND kind <> 'checkpoint' THEN 'content_immutable'
WHEN k = 3 AND kind IN ('workspace', 'quarantine') THEN 'status_invalid' WHEN k = 4 AND kind IN ('dead_letter', 'checkpoint') THEN 'moved_backward' END error FROM pairs) WHERE error IS NOT NULL""", PAIRS)
def transition_guards(b: Bundle):
    return guards.guarded(row_pairs(b))


@register("v14_append_only", """SELECT content_block_id, 'row_changed_or_removed' error FROM blocks WHERE conv_id % 13 = 0 AND block_sequence = 0 OR conv_id % 17 = 0 AND block_sequence = 1""")
def append_only(b: Bundle):
    """Rows of an earlier snapshot that a later one no longer holds as they were; the later one may have more."""
    columns = ("content_block_id", "message_id", "sha256")
    later = b.blocks.where(~((F.col("conv_id") % 13 == 0) & (F.col("block_sequence") == 0))) \
        .withColumn("sha256", F.when((F.col("conv_id") % 17 == 0) & (F.col("block_sequence") == 1), F.reverse("sha256")).otherwise(F.col("sha256"))).select(*columns)
    return b.blocks.select(*columns).exceptAll(later).select("content_block_id", F.lit("row_changed_or_removed").alias("error"))


@register("v21_capture_hashes", """SELECT capture_version_id, n_messages, conv_id % 11 <> 0 verified FROM captures""")
def capture_hashes(b: Bundle):
    """Every stored manifest hash against the one made again from the messages; those of one capture in eleven are damaged."""
    stored = b.captures.withColumn("stored", F.when(F.col("conv_id") % 11 == 0, F.reverse("manifest_sha256")).otherwise(F.col("manifest_sha256")))
    again = b.messages.groupBy("conversation_id").agg(hashing.ordered_digest("text_sha256", "sequence").alias("again"))
    return stored.join(again, "conversation_id").select("capture_version_id", "n_messages", (F.col("stored") == F.col("again")).alias("verified"))


_TYPES = ", ".join(f"'{t}'" for t in guards.KIND_OF_TYPE)
_KINDS = " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in guards.KIND_OF_TYPE.items())


@register("p6_candidate_kinds", f"""SELECT message_id, t extraction_type, CASE t {_KINDS} END kind FROM (SELECT message_id, CASE WHEN "sequence" % 12 < 10 THEN list_extract([{_TYPES}], CAST("sequence" % 12 + 1 AS INTEGER)) ELSE 'other' END t FROM messages)""")
def candidate_kinds(b: Bundle):
    types = F.array(*map(F.lit, guards.KIND_OF_TYPE))
    t = F.coalesce(F.get(types, (F.col("sequence") % 12).cast("int")), F.lit("other"))
    return b.messages.select("message_id", t.alias("extraction_type")).withColumn("kind", guards.candidate_kind(F.col("extraction_type")))


@register("p19_public_columns", "SELECT c_name, CAST(c_acctbal AS DOUBLE) c_acctbal, c_mktsegment FROM customer")
def public_columns(b: Bundle):
    """Columns whose names mark private ids are dropped, numbers are doubles."""
    c = b.raw("customer")
    public = [f.name for f in c.schema.fields if f.name in ("c_name", "c_acctbal", "c_mktsegment") and not f.name.endswith(("key", "_id"))]
    return c.select(*[F.col(n).cast("double").alias(n) if n == "c_acctbal" else F.col(n) for n in public])


@register("p21_approved_statements", """SELECT knowledge_candidate_id, CASE WHEN range_no % 3 = 0 THEN 'statement ' || conv_id WHEN range_no % 3 = 1 THEN 'Approved message range ' || start_sequence || '–' || end_sequence || ' (' || n_messages || ' messages) of the preserved capture.'
ELSE substr('{"candidate_type":"other","note":"' || repeat('x', CAST(conv_id AS INTEGER) % 500) || '"}', 1, 400) END statement FROM candidates WHERE decision = 'approved'""")
def approved_statements(b: Bundle):
    kind = F.col("range_no") % 3
    value = b.candidates.where("decision = 'approved'").select(
        "knowledge_candidate_id", F.when(kind == 0, F.concat(F.lit("statement "), F.col("conv_id").cast("string"))).when(kind == 1, " ").alias("statement"),
        F.when(kind == 1, "message_range").otherwise("other").alias("candidate_type"), "start_sequence", "end_sequence", "n_messages",
        F.concat(F.lit('{"candidate_type":"other","note":"'), F.repeat(F.lit("x"), (F.col("conv_id") % 500).cast("int")), F.lit('"}')).alias("json"))
    return value.select("knowledge_candidate_id", textops.approved_statement(*map(F.col, ("statement", "candidate_type", "start_sequence", "end_sequence", "n_messages", "json"))).alias("statement"))


@register("c13_scalar_top", """SELECT c.conversation_id, (SELECT m.message_id FROM messages m WHERE m.conversation_id = c.conversation_id AND m.role = 'assistant' ORDER BY m."sequence" DESC LIMIT 1) latest FROM captures c""")
def scalar_top(b: Bundle):
    top = b.messages.where("role = 'assistant'").groupBy("conversation_id").agg(F.max_by("message_id", "sequence").alias("latest"))
    return b.captures.select("conversation_id").join(top, "conversation_id", "left")


@register("c18_branch_parents", """SELECT a.message_id, min(p.message_id) parent_id FROM messages a JOIN messages p ON p.conversation_id = a.conversation_id AND floor(p."sequence" / 2) = floor(a."sequence" / 2) - 1 AND p.role = a.role
GROUP BY 1 HAVING count(*) = 1""")
def branch_parents(b: Bundle):
    """The parent of every message, where its branch has just one candidate."""
    step = F.floor(F.col("sequence") / 2)
    parents = b.messages.select("conversation_id", "role", (step + 1).alias("step"), F.col("message_id").alias("parent_id"))
    both = b.messages.select("conversation_id", "role", step.alias("step"), "message_id").join(parents, ["conversation_id", "role", "step"])
    return both.groupBy("message_id").agg(F.count("*").alias("n"), F.min("parent_id").alias("parent_id")).where("n = 1").drop("n")


@register("f12_sanitized_output")
def sanitized_output(b: Bundle):
    """Whole texts; a negative lookahead has no DuckDB counterpart, so literal cases are tested."""
    return b.raw("documents").select("doc_id", hashing.sha256(textops.sanitized(F.col("text"))).alias("h"))


@register("k7_known_rows", """SELECT conversation_id, CASE WHEN conv_id % 7 <> 0 THEN verification_status END verification_status, strftime(to_timestamp(captured_s), '%Y-%m-%dT%H:%M:%S.000Z') captured_at FROM captures""")
def known_rows(b: Bundle):
    """Statuses outside the known ones become null."""
    status = F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("odd_"), F.col("verification_status"))).otherwise(F.col("verification_status"))
    known = F.when(status.isin("complete", "partial", "needs_review", "failed"), status)
    return b.captures.select("conversation_id", known.alias("verification_status"), F.date_format(F.timestamp_seconds("captured_s"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("captured_at"))


@register("k5_capture_references", """SELECT capture_version_id, conversation_id, manifest_sha256, captured_s, 'capture-' || substr(sha256(capture_version_id), 1, 24) reference FROM captures""")
def capture_references(b: Bundle):
    return b.captures.select("capture_version_id", "conversation_id", "manifest_sha256", "captured_s", hashing.capture_reference(F.col("capture_version_id")).alias("reference"))


@register("k20_ensure_requests", """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'invalid_body' END error FROM customer""")
def ensure_requests(b: Bundle):
    h, k = F.sha2(F.col("c_custkey").cast("string"), 256), F.col("c_custkey") % 5
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    key = F.concat(F.when(k == 1, "core:team:").otherwise("core:user:"), F.when(k == 2, F.concat(F.lit("A"), F.substring(uuid, 2, 40))).otherwise(uuid))
    name = F.when(k == 3, F.concat(F.lit(" "), F.col("c_name"))).when(k == 4, F.concat(F.col("c_name"), F.lit("\t-"))).otherwise(F.col("c_name"))
    return b.raw("customer").select("c_custkey", guards.ensure_request_errors(key, name).alias("error"))


@register("k22_next_attempts", """SELECT chunk, CAST(max(attempt) + 1 AS BIGINT) next_attempt FROM (SELECT o_custkey chunk, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE o_orderkey % 90 + 1 END attempt FROM orders) GROUP BY 1""")
def next_attempts(b: Bundle):
    """The attempt after the highest one that a chunk's file names mention; other names do not count."""
    kind = F.element_at(F.array(*map(F.lit, ("output", "error", "openrouter-raw", "notes"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    names = b.raw("orders").select(F.col("o_custkey").alias("chunk"), F.format_string("chunk-%d-attempt-%d-%s.json", F.col("o_custkey"), F.col("o_orderkey") % 90 + 1, kind).alias("name"))
    n = F.regexp_extract("name", r"^chunk-\d+-attempt-(\d+)-(?:openrouter-raw|output|error)\.json$", 1)
    return names.groupBy("chunk").agg((F.max(F.when(n == "", 0).otherwise(n.try_cast("long"))) + 1).alias("next_attempt"))


@register("k24_evidence_version_keys", """SELECT conversation_id, CASE WHEN conv_id % 2 = 0 THEN 'source_' || conv_id ELSE capture_version_id END version_key FROM captures""")
def evidence_version_keys(b: Bundle):
    source = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("source_"), F.col("conv_id").cast("string")))
    return b.captures.select("conversation_id", F.coalesce(source, "capture_version_id").alias("version_key"))


@register("k25_archive_failures", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'archive_failed_before_archive_started' WHEN event_id % 3 = 1 THEN 'archive_failed_' || event_type || '_io_error_cleanup_done' END stage FROM events""")
def archive_failures(b: Bundle):
    k = F.col("event_id") % 3
    return b.raw("events").select("event_id", F.when(k == 0, "archive_failed_before_archive_started").when(k == 1, F.concat(F.lit("archive_failed_"), "event_type", F.lit("_io_error_cleanup_done"))).alias("stage"))


@register("i33_discovery_summary", """SELECT source_family, count(*) items, count(*) FILTER (WHERE verification_status = 'needs_review') needing_review, CAST(sum(n_messages) AS BIGINT) observed, count(*) > 25 sample_truncated FROM captures GROUP BY 1""")
def discovery_summary(b: Bundle):
    return b.captures.groupBy("source_family").agg(F.count("*").alias("items"), F.count_if(F.col("verification_status") == "needs_review").alias("needing_review"),
                                                   F.sum("n_messages").alias("observed"), (F.count("*") > 25).alias("sample_truncated"))


@register("a16_project_urls", """SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]+)/', 1), '') container, nullif(regexp_extract(url, '([^/?#]+)$', 1), '') item FROM pages""")
def project_urls(b: Bundle):
    """The container and the item that an address names."""
    part = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return b.raw("pages").select("page_id", part(r"^[a-z]+://[^/?#]+/([^/?#]+)/").alias("container"), part(r"([^/?#]+)$").alias("item"))
