"""Proposed knowledge: citations checked against evidence, repeated observations merged, links cleaned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textops import claims_authority, normalized


def cited_blocks(citations: DataFrame, blocks: DataFrame) -> DataFrame:
    """(proposal_id, citation_no, content_block_id): the first block of the cited message that holds the quote verbatim; null if none does.

    citations has proposal_id, citation_no, message_id, quote; blocks has message_id, block_sequence, content_block_id, value.
    """
    b = blocks.select("message_id", "block_sequence", "content_block_id", "value")
    hits = citations.join(b, "message_id", "left").where(F.contains("value", "quote"))
    first = hits.groupBy("proposal_id", "citation_no").agg(F.min_by("content_block_id", "block_sequence").alias("content_block_id"))
    return citations.select("proposal_id", "citation_no").join(first, ["proposal_id", "citation_no"], "left")


def proposal_issues(proposals: DataFrame, citations: DataFrame, blocks: DataFrame) -> DataFrame:
    """(code, record_id, message): quotes that are not in the evidence, repeated statements, claims of the user's authority without a user message."""
    unfound = cited_blocks(citations, blocks).where("content_block_id is null").select(
        F.lit("quote_not_found").alias("code"), F.col("proposal_id").alias("record_id"), F.col("citation_no").cast("string").alias("message"))
    order = Window.partitionBy("_k").orderBy("position")
    repeated = proposals.withColumn("_k", normalized(F.col("statement"))).withColumn("_n", F.row_number().over(order)).withColumn("_first", F.first("proposal_id").over(order)) \
        .where("_n > 1").select(F.lit("duplicate_statement").alias("code"), F.col("proposal_id").alias("record_id"), F.col("_first").alias("message"))
    users = citations.join(blocks.where("role = 'user'").select("message_id").distinct(), "message_id", "left_semi").select("proposal_id")
    claims = proposals.where(claims_authority(F.col("statement"))).join(users, "proposal_id", "left_anti").select(
        F.lit("authority_without_user").alias("code"), F.col("proposal_id").alias("record_id"), F.lit("").alias("message"))
    return unfound.unionByName(repeated).unionByName(claims)


def accumulate(observations: DataFrame, key: str, order_hint: str, *described: str) -> DataFrame:
    """(key, order_hint, n, conflict): repeated sightings of one thing; it conflicts if its description changed between them."""
    return observations.groupBy(key).agg(F.min(order_hint).alias(order_hint), F.count("*").alias("n"), (F.count_distinct(F.struct(*described)) > 1).alias("conflict"))


def clean_links(links: DataFrame, known: DataFrame, key: str, confidence: float = 0.8) -> DataFrame:
    """Links (group, position, from_id, to_id, kind, payload, confidence) between known things, not to themselves and of a kind that is not blank.

    Of links of one kind between the same two the first by position stays, with its payload; a payload that is no object is empty, and a confidence that
    is no share has the default.
    """
    ends = known.select(F.col(key).alias("_k")).distinct()
    named = links.withColumn("kind", F.trim("kind")).where("kind <> '' and from_id <> to_id")
    kept = named.join(ends, F.col("from_id") == F.col("_k"), "left_semi").join(ends, F.col("to_id") == F.col("_k"), "left_semi")
    c = F.col("confidence")
    sound: Column = F.when(c.isNull() | F.isnan(c) | (c < 0) | (c > 1), F.lit(confidence)).otherwise(c)
    whole = F.when(F.try_variant_get(F.try_parse_json("payload"), "$", "map<string, variant>").isNotNull(), F.col("payload")).otherwise("{}")
    first = F.min_by(F.struct(whole.alias("payload"), sound.alias("confidence")), "position")
    return kept.groupBy("from_id", "to_id", "kind").agg(first.alias("l")).select("from_id", "to_id", "kind", "l.payload", "l.confidence")


def uncovered(topics: DataFrame, messages: DataFrame) -> DataFrame:
    """(code, record_id, message) of messages in no topic's range or in several; topics has conversation_id, topic_id, start_sequence, end_sequence."""
    spread = topics.select("conversation_id", "topic_id", F.explode(F.sequence("start_sequence", "end_sequence")).alias("sequence"))
    n = messages.select("conversation_id", "sequence", "message_id").join(spread, ["conversation_id", "sequence"], "left").groupBy("message_id").agg(F.count("topic_id").alias("n"))
    code = F.when(F.col("n") == 0, "message_not_covered").when(F.col("n") > 1, "message_covered_twice")
    return n.where("n <> 1").select(code.alias("code"), F.col("message_id").alias("record_id"), F.col("n").cast("string").alias("message"))


# Keys that metadata may have, and what they hold; error codes and their summaries; what a text must not look like.
METADATA_KEYS = (
    "stage", "progress_current", "progress_total", "message_count", "content_block_count", "safe_error_code", "safe_error_summary", "verification_status", "delivery_receipt_sha256",
    "archive_manifest_sha256", "safe_capture_reference", "reason_code", "timeout_seconds", "last_successful_stage", "identity_verified", "archive_created", "retry_safe")
HASH_KEYS = ("delivery_receipt_sha256", "archive_manifest_sha256")
NUMBER_KEYS = ("progress_current", "progress_total", "message_count", "content_block_count", "timeout_seconds")
BOOLEAN_KEYS = ("identity_verified", "archive_created", "retry_safe")
ERROR_SUMMARIES = {
    "pairing_failed": "The local collector did not accept the pairing request.",
    "identity_mismatch": "The active conversation identity changed or did not match.",
    "delivery_failed": "The capture could not be delivered to the local collector.",
    "archive_failed": "The collector could not finish the immutable archive.",
    "verification_failed": "Capture verification did not finish successfully.",
    "stream_interrupted": "The local capture stream stopped before completion.",
    "user_canceled": "The contributor canceled the operation.",
    "stale_timeout": "The operation stopped making progress and was classified as interrupted.",
    "collector_unavailable": "The local collector could not be reached.",
    "validation_failed": "The collector rejected invalid operation data.",
    "internal_error": "A local component reported a safe internal failure.",
}
PRIVATE_PATH = r"(?i)^[a-z]:[\\/]|^\\\\|/(users|home|var|etc)/"
ADDRESS = r"(?i)(https?|file|postgres(ql)?)://"
SENSITIVE = r"(?i)authorization|bearer|password|pairing secret|collector token|cookie|private key|transcript|<html|<body"
LONGEST_TEXT, LARGEST_INTEGER = 240, 9_007_199_254_740_991


def metadata_issues(events: DataFrame, key: str, metadata: str) -> DataFrame:
    """(code, record_id, message) of metadata, a JSON text; message is the key at fault.  Every rule that an entry breaks is told."""
    return events.select(F.col(key).alias("record_id"), F.explode(metadata_faults(metadata)).alias("c")).select("c.code", "record_id", "c.message")


def metadata_faults(metadata: str) -> Column:
    """An array of (code, message) of a metadata text, row by row."""
    m = F.try_variant_get(F.try_parse_json(metadata), "$", "map<string, variant>")

    def entry(e: Column) -> Column:
        k, v = e["key"], e["value"]
        t = F.schema_of_variant(v)
        text = F.when(t == "STRING", F.try_variant_get(v, "$", "string"))
        number = F.when(t.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
        whole = F.coalesce((number == F.floor(number)) & number.between(0, LARGEST_INTEGER), F.lit(False))
        hashed = F.coalesce(text.rlike("^[a-f0-9]{64}$"), F.lit(False))
        codes = F.array_compact(F.array(
            F.when(~k.isin(*METADATA_KEYS), "metadata_key_not_allowed"),
            F.when(t.rlike("^(OBJECT|ARRAY)"), "metadata_value_not_scalar"),
            F.when(k.isin(*NUMBER_KEYS) & ~whole, "metadata_number_required"),
            F.when(k.isin(*BOOLEAN_KEYS) & (t != "BOOLEAN"), "metadata_boolean_required"),
            F.when(k.isin(*HASH_KEYS) & ~hashed, "metadata_sha256_required"),
            F.when((F.char_length(text) > LONGEST_TEXT) | text.rlike(r"[\x00-\x1f]"), "metadata_text_too_long"),
            F.when(text.rlike(PRIVATE_PATH), "metadata_private_path"), F.when(text.rlike(ADDRESS), "metadata_address"), F.when(text.rlike(SENSITIVE), "metadata_sensitive")))
        return F.transform(codes, lambda c: F.struct(c.alias("code"), k.alias("message")))

    def said(name: str) -> Column:
        return F.try_element_at(m, F.lit(name))

    def told(name: str) -> Column:
        return F.when(F.schema_of_variant(said(name)) == "STRING", F.try_variant_get(said(name), "$", "string"))

    summaries = F.create_map(*[F.lit(x) for pair in ERROR_SUMMARIES.items() for x in pair])
    expected = F.try_element_at(summaries, told("safe_error_code"))
    has_code, has_summary = said("safe_error_code").isNotNull(), said("safe_error_summary").isNotNull()

    def fault(condition: Column, code: str, at: str) -> Column:
        return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(at).alias("message")))

    whole_codes = F.array_compact(F.array(
        fault(m.isNull(), "metadata_not_an_object", ""), fault(has_code & expected.isNull(), "error_code_not_allowed", "safe_error_code"),
        fault(has_code & expected.isNotNull() & has_summary & ~expected.eqNullSafe(told("safe_error_summary")), "error_summary_differs", "safe_error_summary"),
        fault(~has_code & has_summary, "error_summary_without_code", "safe_error_summary")))
    return F.concat(F.coalesce(F.flatten(F.transform(F.map_entries(m), entry)), F.array().cast("array<struct<code: string, message: string>>")), whole_codes)
