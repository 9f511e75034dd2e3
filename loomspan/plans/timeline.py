"""Inventory, batches, sequences and top-k queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.textops import length_bucket
from ..model import Bundle
from ..operators.inventory import chronological
from ..registry import register

BATCH = 10
CAPTURES = "cap AS (SELECT c.*, l.content_characters FROM captures c JOIN (SELECT conversation_id, sum(length(text)) content_characters FROM messages GROUP BY 1) l ON l.conversation_id = c.conversation_id)"


def _captures(b: Bundle):
    size = b.messages.groupBy("conversation_id").agg(F.sum(F.length("text")).alias("content_characters"))
    return b.captures.join(size, "conversation_id")


def _numbered(b: Bundle):
    return chronological(b.captures, ["captured_s", "capture_version_id"])


SEQ = "seq AS (SELECT *, row_number() OVER (ORDER BY captured_s, capture_version_id) chronological_sequence FROM captures)"


@register("w2_w3_chronological_batches", f"SELECT capture_version_id, chronological_sequence, CAST((chronological_sequence - 1) // {BATCH} + 1 AS BIGINT) batch_number, CAST((chronological_sequence - 1) % {BATCH} + 1 AS BIGINT) batch_position FROM seq", SEQ)
def chronological_batches(b: Bundle):
    n = F.col("chronological_sequence") - 1
    return _numbered(b).select("capture_version_id", "chronological_sequence", F.floor(n / BATCH + 1).alias("batch_number"), (n % BATCH + 1).alias("batch_position"))


@register("g13_batch_rollup", f"""SELECT batch_number, count(*) n, count(*) FILTER (WHERE verification_status = 'complete') processed,
CASE WHEN count(*) FILTER (WHERE verification_status = 'complete') = 0 THEN 'pending' WHEN count(*) FILTER (WHERE verification_status = 'complete') = count(*) THEN 'complete' ELSE 'partial' END status
FROM (SELECT *, CAST((chronological_sequence - 1) // {BATCH} + 1 AS BIGINT) batch_number FROM seq) GROUP BY 1""", SEQ)
def batch_rollup(b: Bundle):
    done = F.count_if(F.col("verification_status") == "complete")
    rows = _numbered(b).withColumn("batch_number", F.floor((F.col("chronological_sequence") - 1) / BATCH + 1))
    return rows.groupBy("batch_number").agg(F.count("*").alias("n"), done.alias("processed")).withColumn(
        "status", F.when(F.col("processed") == 0, "pending").when(F.col("processed") == F.col("n"), "complete").otherwise("partial"))


@register("g12_inventory_summary", f"""SELECT count(*) conversations, count(*) FILTER (WHERE source_family = 'native_export') exports, CAST(sum(n_messages) AS BIGINT) messages,
min(CASE WHEN verification_status <> 'complete' THEN CAST((chronological_sequence - 1) // {BATCH} + 1 AS BIGINT) END) next_batch, max(CAST((chronological_sequence - 1) // {BATCH} + 1 AS BIGINT)) batches FROM seq""", SEQ)
def inventory_summary(b: Bundle):
    batch = F.floor((F.col("chronological_sequence") - 1) / BATCH + 1)
    return _numbered(b).agg(
        F.count("*").alias("conversations"), F.count_if(F.col("source_family") == "native_export").alias("exports"), F.sum("n_messages").alias("messages"),
        F.min(F.when(F.col("verification_status") != "complete", batch)).alias("next_batch"), F.max(batch).alias("batches"))


@register("i20_reconstruction_inventory", """SELECT s.capture_version_id, s.chronological_sequence, s.source_family, count(DISTINCT b.message_id) messages, count(*) FILTER (WHERE b.block_kind <> 'empty') nonempty_blocks,
count(*) FILTER (WHERE b.block_kind = 'empty') empty_blocks, CAST(sum(length(b.value)) AS BIGINT) characters, min(b."sequence") first_sequence, max(b."sequence") last_sequence
FROM seq s JOIN blocks b ON b.conversation_id = s.conversation_id GROUP BY ALL""", SEQ)
def reconstruction_inventory(b: Bundle):
    rows = b.blocks.groupBy("conversation_id").agg(
        F.count_distinct("message_id").alias("messages"), F.count_if(F.col("block_kind") != "empty").alias("nonempty_blocks"), F.count_if(F.col("block_kind") == "empty").alias("empty_blocks"),
        F.sum(F.length("value")).alias("characters"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))
    return _numbered(b).select("conversation_id", "capture_version_id", "chronological_sequence", "source_family").join(rows, "conversation_id").drop("conversation_id")


@register("g4_pilot_candidates", "SELECT source_family, verification_status, CAST(sum(content_characters) FILTER (WHERE n_messages > 2) AS BIGINT) characters, count(*) n FROM cap GROUP BY ALL", CAPTURES)
def pilot_candidates(b: Bundle):
    return _captures(b).groupBy("source_family", "verification_status").agg(
        F.sum(F.when(F.col("n_messages") > 2, F.col("content_characters"))).alias("characters"), F.count("*").alias("n"))


@register("w9_round_robin", """SELECT capture_version_id, bucket, rn FROM (SELECT capture_version_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY captured_s, capture_version_id) rn FROM (
SELECT *, source_family || ':' || CASE WHEN content_characters < 5000 THEN 'short' WHEN content_characters < 30000 THEN 'medium' ELSE 'long' END bucket FROM cap)) ORDER BY rn, bucket LIMIT 20""", CAPTURES)
def round_robin(b: Bundle):
    bucket = F.concat_ws(":", "source_family", length_bucket(F.col("content_characters")))
    n = F.row_number().over(Window.partitionBy("bucket").orderBy("captured_s", "capture_version_id"))
    return _captures(b).withColumn("bucket", bucket).select("capture_version_id", "bucket", n.alias("rn")).where("rn <= 20") \
        .withColumn("rn", F.col("rn").cast("long")).orderBy("rn", "bucket").limit(20)


@register("w1_range_gaps", """SELECT conversation_id, range_no, prev_end, start_sequence FROM (SELECT *, lag(end_sequence) OVER (PARTITION BY conversation_id ORDER BY start_sequence) prev_end FROM (
SELECT conversation_id, "sequence" // 2 range_no, min("sequence") start_sequence, max("sequence") end_sequence FROM messages GROUP BY 1, 2) WHERE range_no % 3 <> 1) WHERE prev_end IS NOT NULL AND start_sequence <> prev_end + 1""")
def range_gaps(b: Bundle):
    """Ranges of two messages, of which every third is missing."""
    w = Window.partitionBy("conversation_id").orderBy("start_sequence")
    ranges = b.messages.groupBy("conversation_id", F.floor(F.col("sequence") / 2).alias("range_no")).agg(F.min("sequence").alias("start_sequence"), F.max("sequence").alias("end_sequence"))
    return ranges.where("range_no % 3 <> 1").withColumn("prev_end", F.lag("end_sequence").over(w)) \
        .where("prev_end is not null and start_sequence <> prev_end + 1").select("conversation_id", "range_no", "prev_end", "start_sequence")


@register("w4_message_ranges", "SELECT chunk_id, range_no, start_sequence, end_sequence, n_messages, range_sha256 FROM ranges")
def message_ranges(b: Bundle):
    return b.ranges.select("chunk_id", "range_no", "start_sequence", "end_sequence", "n_messages", "range_sha256")


@register("w5_contiguity", "SELECT conversation_id, message_id FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY \"sequence\") - 1 want FROM messages WHERE (conv_id + \"sequence\") % 9 <> 4) WHERE \"sequence\" <> want")
def contiguity(b: Bundle):
    n = F.row_number().over(Window.partitionBy("conversation_id").orderBy("sequence")) - 1
    return b.messages.where("(conv_id + sequence) % 9 <> 4").withColumn("want", n).where("sequence <> want").select("conversation_id", "message_id")


@register("w6_latest_by_key", """SELECT reviewer_id, arg_max(knowledge_candidate_id, occurred_s || ':' || knowledge_candidate_id) latest, count(DISTINCT to_status) > 1 ambiguous FROM reviews GROUP BY 1""")
def latest_by_key(b: Bundle):
    order = F.concat_ws(":", "occurred_s", "knowledge_candidate_id")
    return b.reviews.groupBy("reviewer_id").agg(F.max_by("knowledge_candidate_id", order).alias("latest"), (F.count_distinct("to_status") > 1).alias("ambiguous"))


@register("w10_first_occurrence", """SELECT message_id, first_id FROM (SELECT message_id, first_value(message_id) OVER w first_id, row_number() OVER w rn FROM (
SELECT *, trim(regexp_replace(lower(substr(text, 1, 3)), '\\s+', ' ', 'g')) k FROM messages) WINDOW w AS (PARTITION BY conversation_id, k ORDER BY "sequence")) WHERE rn > 1""")
def first_occurrence(b: Bundle):
    w = Window.partitionBy("conversation_id", "k").orderBy("sequence")
    key = F.trim(F.regexp_replace(F.lower(F.substring("text", 1, 3)), r"\s+", " "))
    return b.messages.withColumn("k", key).select("message_id", F.first("message_id").over(w).alias("first_id"), F.row_number().over(w).alias("rn")).where("rn > 1").drop("rn")


@register("w12_latest_complete", "SELECT source_family, arg_max(capture_version_id, captured_s || capture_version_id) FILTER (WHERE verification_status = 'complete') capture_version_id FROM captures GROUP BY 1")
def latest_complete(b: Bundle):
    ok = F.col("verification_status") == "complete"
    return b.captures.groupBy("source_family").agg(F.max_by(F.when(ok, F.col("capture_version_id")), F.when(ok, F.concat("captured_s", "capture_version_id"))).alias("capture_version_id"))


@register("w13_stable_positions", "SELECT content_block_id, row_number() OVER (PARTITION BY conversation_id ORDER BY block_kind, content_block_id) - 1 AS position FROM blocks")
def stable_positions(b: Bundle):
    n = F.row_number().over(Window.partitionBy("conversation_id").orderBy("block_kind", "content_block_id")) - 1
    return b.blocks.select("content_block_id", n.cast("long").alias("position"))


@register("w11_source_order", "SELECT conversation_id, count(*) n FROM (SELECT *, lag(length(text)) OVER (PARTITION BY conversation_id ORDER BY \"sequence\") p FROM messages) WHERE length(text) < p GROUP BY 1")
def source_order(b: Bundle):
    p = F.lag(F.length("text")).over(Window.partitionBy("conversation_id").orderBy("sequence"))
    return b.messages.withColumn("p", p).where(F.length("text") < F.col("p")).groupBy("conversation_id").agg(F.count("*").alias("n"))


@register("o1_bounded_top", "SELECT message_id, \"sequence\", length(text) n FROM messages ORDER BY n DESC, message_id LIMIT 20")
def bounded_top(b: Bundle):
    return b.messages.select("message_id", "sequence", F.length("text").cast("long").alias("n")).orderBy(F.desc("n"), "message_id").limit(20)


@register("o3_requested_order", "SELECT conversation_id, list_position([30, 10, 20, 5], conv_id) place FROM captures WHERE conv_id IN (30, 10, 20, 5)")
def requested_order(b: Bundle):
    wanted = F.array(*map(F.lit, (30, 10, 20, 5)))
    return b.captures.where(F.col("conv_id").isin(30, 10, 20, 5)).select("conversation_id", F.array_position(wanted, F.col("conv_id").cast("int")).cast("int").alias("place")).orderBy("place")


@register("o4_paging", "SELECT message_id, (SELECT count(*) FROM messages WHERE role = 'user') total FROM messages WHERE role = 'user' ORDER BY message_id LIMIT 25 OFFSET 50")
def paging(b: Bundle):
    own = b.messages.where("role = 'user'")
    total = own.agg(F.count("*").alias("total"))
    return own.select("message_id").orderBy("message_id").offset(50).limit(25).crossJoin(F.broadcast(total))  # total is one row


@register("g15_frequencies", "SELECT 'role' kind, role AS value, count(*) n FROM messages GROUP BY 2 UNION ALL SELECT 'block', block_kind, count(*) FROM blocks GROUP BY 2")
def frequencies(b: Bundle):
    roles = b.messages.groupBy(F.lit("role").alias("kind"), F.col("role").alias("value")).agg(F.count("*").alias("n"))
    return roles.unionByName(b.blocks.groupBy(F.lit("block").alias("kind"), F.col("block_kind").alias("value")).agg(F.count("*").alias("n")))


@register("g21_container_facts", "SELECT count(*) n, count(DISTINCT url) distinct_urls, count(*) - count(DISTINCT url) duplicates, count(*) FILTER (WHERE url IS NULL) null_urls FROM pages")
def container_facts(b: Bundle):
    return b.raw("pages").agg(F.count("*").alias("n"), F.count_distinct("url").alias("distinct_urls"), (F.count("*") - F.count_distinct("url")).alias("duplicates"), F.count_if(F.col("url").isNull()).alias("null_urls"))
