"""Bounded listings, latest children, counts with zeros and small checks of values."""

from pyspark.sql import functions as F

from ..functions import identifiers
from ..model import Bundle
from ..registry import register

CLASSES = ("new", "possibly_changed", "unchanged", "missing", "needs_review")


@register("c13_latest_retry", """SELECT c.capture_version_id, (SELECT r.capture_version_id FROM captures r WHERE r.conv_id % 4 > 0 AND r.conv_id - r.conv_id % 4 = c.conv_id
  ORDER BY r.captured_s DESC, r.capture_version_id DESC LIMIT 1) retry FROM captures c""")
def latest_retry(b: Bundle):
    """Each capture with the latest of the captures that retry it, or null: one aggregation in place of a lookup for each row."""
    children = b.captures.where("conv_id % 4 > 0").groupBy((F.col("conv_id") - F.col("conv_id") % 4).alias("conv_id")) \
        .agg(F.max(F.struct("captured_s", "capture_version_id"))["capture_version_id"].alias("retry"))
    return b.captures.select("conv_id", "capture_version_id").join(children, "conv_id", "left").select("capture_version_id", "retry")


@register("c14_using_joins", """SELECT knowledge_candidate_id, kind, reviewer_id, approved_s FROM candidates JOIN reviews USING (workspace_id, knowledge_candidate_id)
JOIN approved USING (workspace_id, knowledge_candidate_id)""")
def using_joins(b: Bundle):
    on = ["workspace_id", "knowledge_candidate_id"]
    return b.candidates.select(*on, "kind").join(b.reviews, on).join(b.approved, on).select("knowledge_candidate_id", "kind", "reviewer_id", "approved_s")


@register("o6_samples", """(SELECT 'needs_review' sample, conversation_id, n_messages FROM captures WHERE verification_status = 'needs_review' ORDER BY captured_s, conversation_id LIMIT 10)
UNION ALL (SELECT 'items', conversation_id, n_messages FROM captures ORDER BY captured_s, conversation_id LIMIT 25)""")
def samples(b: Bundle):
    """The first ten captures that need a review and the first 25 of all; the limits are the feature."""
    def first(rows, name: str, most: int):
        return rows.orderBy("captured_s", "conversation_id").limit(most).select(F.lit(name).alias("sample"), "conversation_id", "n_messages")

    return first(b.captures.where("verification_status = 'needs_review'"), "needs_review", 10).unionByName(first(b.captures, "items", 25))


@register("o7_bounded_listings", """(SELECT 'operations' listing, capture_version_id id FROM captures ORDER BY captured_s DESC, capture_version_id DESC LIMIT 50)
UNION ALL (SELECT 'events', CAST(event_id AS VARCHAR) FROM events ORDER BY CAST(ts AS TIMESTAMP) DESC, event_id DESC LIMIT 2000)
UNION ALL (SELECT 'reviews', human_review_event_id FROM reviews ORDER BY occurred_s DESC, human_review_event_id DESC LIMIT 200)
UNION ALL (SELECT 'approved', approved_knowledge_id FROM approved ORDER BY approved_s DESC, approved_knowledge_id DESC LIMIT 100)""")
def bounded_listings(b: Bundle):
    """The latest 50 operations, 2,000 events, 200 reviews and 100 approvals; the limits are the feature."""
    def latest(rows, name: str, at: str, key: str, most: int):
        return rows.orderBy(F.desc(at), F.desc(key)).limit(most).select(F.lit(name).alias("listing"), F.col(key).cast("string").alias("id"))

    events = b.raw("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return latest(b.captures, "operations", "captured_s", "capture_version_id", 50).unionByName(latest(events, "events", "ts", "event_id", 2000)) \
        .unionByName(latest(b.reviews, "reviews", "occurred_s", "human_review_event_id", 200)).unionByName(latest(b.approved, "approved", "approved_s", "approved_knowledge_id", 100))


@register("f17_identifiers", f"""SELECT message_id, regexp_full_match(message_id, '{identifiers.IDENTIFIER}') id_ok, regexp_full_match(split_part(text, ' ', 1), '{identifiers.IDENTIFIER}') word_ok,
regexp_full_match(text_sha256, '{identifiers.SHA256}') hash_ok, regexp_full_match(upper(text_sha256), '{identifiers.SHA256}') upper_ok FROM messages""")
def identifier_checks(b: Bundle):
    ok = identifiers.matches
    return b.messages.select("message_id", ok(F.col("message_id"), identifiers.IDENTIFIER).alias("id_ok"), ok(F.split_part("text", F.lit(" "), F.lit(1)), identifiers.IDENTIFIER).alias("word_ok"),
                             ok(F.col("text_sha256"), identifiers.SHA256).alias("hash_ok"), ok(F.upper("text_sha256"), identifiers.SHA256).alias("upper_ok"))


@register("f20_loopback", """SELECT page_id, address, CASE WHEN page_id % 7 IN (0, 1, 3, 4) THEN true ELSE false END loopback, page_id % 7 IN (0, 5) database_host FROM (
SELECT page_id, CASE page_id % 7 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN ' [::1] ' WHEN 2 THEN '127.0.0.2' WHEN 3 THEN '0:0:0:0:0:0:0:1' WHEN 4 THEN '::FFFF:127.0.0.1' WHEN 5 THEN 'localhost'
ELSE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) END address FROM pages)""")
def loopback(b: Bundle):
    """Planted addresses and the hosts of pages: is one this machine's own, may it be a database's."""
    planted = ("127.0.0.1", " [::1] ", "127.0.0.2", "0:0:0:0:0:0:0:1", "::FFFF:127.0.0.1", "localhost")
    k = (F.col("page_id") % 7).cast("int")
    address = F.when(k < 6, F.get(F.array(*map(F.lit, planted)), k)).otherwise(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    return b.raw("pages").select("page_id", address.alias("address")).withColumns({"loopback": identifiers.is_loopback(F.col("address")),
                                                                                     "database_host": F.col("address").isin(*identifiers.DATABASE_HOSTS)})


@register("g16_classification_counts", f"""SELECT source_family, class, count(conv_id) n FROM (SELECT DISTINCT source_family FROM captures) CROSS JOIN (SELECT unnest({list(CLASSES)}) AS class)
LEFT JOIN (SELECT source_family, conv_id, list_extract({list(CLASSES)}, CAST(conv_id % 3 + 1 AS INTEGER)) AS class FROM captures) USING (source_family, class) GROUP BY 1, 2""")
def classification_counts(b: Bundle):
    """Captures of every class by source family, 0 where there are none."""
    of = F.get(F.array(*map(F.lit, CLASSES)), (F.col("conv_id") % 3).cast("int"))
    counts = b.captures.groupBy("source_family").agg(*[F.count_if(of == c).alias(c) for c in CLASSES])
    return counts.unpivot(["source_family"], list(CLASSES), "class", "n")


@register("k12_structure_stability", """SELECT message_id, CASE WHEN "sequence" % 3 <> 0 THEN true WHEN conv_id % 5 = 0 THEN false ELSE conv_id % 2 = 0 END stable FROM messages""")
def structure_stability(b: Bundle):
    """A message whose rendered structure drifted is stable only if its structure hashes are known and one."""
    drift = F.when(F.col("sequence") % 3 == 0, F.array(F.lit("sanitized_html"))).otherwise(F.array(F.lit("plain_text")))
    other = F.when(F.col("conv_id") % 2 == 0, F.col("text_sha256")).otherwise(F.reverse("text_sha256"))
    hashes = F.when(F.col("conv_id") % 5 != 0, F.array("text_sha256", other, F.lit(None)))
    one = F.coalesce(F.size(F.array_distinct(F.array_compact(hashes))) <= 1, F.lit(False)) & hashes.isNotNull()
    return b.messages.select("message_id", (~F.array_contains(drift, "sanitized_html") | one).alias("stable"))


@register("k14_part_texts", """SELECT message_id, sha256(array_to_string(p, chr(10))) content_sha256, sha256(array_to_string(p, '')) output_sha256 FROM (
SELECT message_id, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) % 3 = 0 THEN '' ELSE x END) p FROM messages)""")
def part_texts(b: Bundle):
    """Texts of content parts (joined by line feeds) and of output parts (joined by nothing); some parts have no text."""
    parts = F.transform(F.split("text", "\n"), lambda x: F.struct(F.when(F.length(x) % 3 != 0, x).alias("text")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return b.messages.select("message_id", digest(identifiers.parts_text(parts, "\n")).alias("content_sha256"), digest(identifiers.parts_text(parts, "")).alias("output_sha256"))
