"""Text, URL, hash, date and array operators applied to whole tables."""

from pyspark.sql import functions as F

from ..functions import hashing, textops
from ..model import Bundle
from ..registry import register


def nested(rules, text: str = "text") -> str:
    """DuckDB SQL that makes the replacements of (pattern, replacement) rules in order."""
    for pattern, to in rules:
        found, to = pattern.replace("'", "''"), to.replace("$1", "\\1").replace("'", "''")
        text = f"regexp_replace({text}, '{found}', '{to}', 'g')"
    return text


REDACTED = nested([(p, ("$1=" if n == "env_secret_assignment" else "") + f"[REDACTED:{n}]") for n, p in textops.SECRETS])
PRIVATE = nested(textops.PRIVATE)


@register("f1_hashes", "SELECT message_id, sha256(text) sha256, substr(sha256(text), 1, 12) short, 'capture-' || substr(sha256(message_id), 1, 24) reference, 'message-' || substr(sha256(text), 1, 12) safe FROM messages")
def hashes(b: Bundle):
    return b.messages.select("message_id", hashing.sha256(F.col("text")).alias("sha256"), F.substring(hashing.sha256(F.col("text")), 1, 12).alias("short"),
                             hashing.capture_reference(F.col("message_id")).alias("reference"), hashing.safe_reference("message", F.col("text")).alias("safe"))


@register("f3_hash_uuid", "SELECT message_id, substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS uuid FROM (SELECT message_id, sha256(message_id) h FROM messages)")
def hash_uuid(b: Bundle):
    return b.messages.select("message_id", hashing.hash_uuid(F.col("message_id")).alias("uuid"))


@register("f34_canonical_ids", """SELECT conversation_id, 'record_' || substr(sha256('{"natural_key":"' || conversation_id || '","workspace_id":"ws_main"}'), 1, 32) record_id,
sha256('{"kind":"record","natural_key":"' || conversation_id || '","workspace_id":"ws_main"}') idempotency_key FROM captures""")
def canonical_ids(b: Bundle):
    return b.captures.select("conversation_id", hashing.deterministic_id("record", F.col("workspace_id"), F.col("conversation_id")).alias("record_id"),
                             hashing.idempotency_key("record", F.col("workspace_id"), F.col("conversation_id")).alias("idempotency_key"))


@register("f5_normalized", "SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) h, CAST(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS BIGINT) n FROM documents")
def normalized(b: Bundle):
    return b.raw("documents").select("doc_id", hashing.sha256(textops.normalized(F.col("text"))).alias("h"), F.length(F.trim(F.regexp_replace("text", r"\s+", " "))).cast("long").alias("n"))


@register("f7_titles", "SELECT doc_id, substr(string_split(trim(text, chr(10) || ' '), chr(10))[1], 1, 120) title FROM documents")
def titles(b: Bundle):
    return b.raw("documents").select("doc_id", textops.first_line_title(F.trim("text", F.lit("\n "))).alias("title"))


@register("f8_path_segments", "SELECT page_id, substr(regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g'), 1, 120) segment FROM pages")
def path_segments(b: Bundle):
    return b.raw("pages").select("page_id", textops.path_segment(F.col("url")).alias("segment"))


@register("f10_redaction", f"SELECT doc_id, sha256({REDACTED}) h FROM documents")
def redaction(b: Bundle):
    return b.raw("documents").select("doc_id", hashing.sha256(textops.redact_secrets(F.col("text"))).alias("h"))


@register("f11_private_projection", f"SELECT doc_id, sha256({PRIVATE}) h FROM documents")
def private_projection(b: Bundle):
    return b.raw("documents").select("doc_id", hashing.sha256(textops.private_projection(F.col("text"))).alias("h"))


@register("f13_statement_kinds", """SELECT message_id, CASE WHEN regexp_matches(substr(trim(text), 1, 160), '(?i)pasted (?:text|markdown)|\\b(?:document|file)\\s*$') THEN 'pasted_external_material'
WHEN role = 'assistant' THEN 'assistant_suggestion' WHEN role <> 'user' THEN 'user_statement' WHEN regexp_matches(text, '(?i)\\b(?:approved|agreed|yes for sure|for sure|that is the plan)\\b') THEN 'decision'
WHEN regexp_matches(text, '(?i)\\b(?:must|do not|don''t|never|i want|i don''t want|needs? to|have to)\\b') THEN 'requirement' WHEN regexp_matches(text, '(?i)^\\s*(?:no\\b|that''s not|that is not|why are we|what are we even|i''m not saying)') THEN 'correction'
WHEN regexp_matches(text, '(?i)[?]|\\b(?:what|how|why|where|when|should|could|can we|is there)\\b') THEN 'unresolved_question' ELSE 'user_statement' END kind FROM messages""")
def statement_kinds(b: Bundle):
    return b.messages.select("message_id", textops.statement_kind(F.col("role"), F.col("text")).alias("kind"))


@register("f16_probe_words", "SELECT doc_id, nullif(list_reduce(list_prepend('', list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda w: length(w) >= 5)), lambda a, w: CASE WHEN length(w) > length(a) THEN w ELSE a END), '') word FROM documents")
def probe_words(b: Bundle):
    return b.raw("documents").select("doc_id", textops.probe_word(F.col("text")).alias("word"))


@register("f19_urls", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) host, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) path FROM pages")
def urls(b: Bundle):
    part = lambda p: F.coalesce(F.parse_url("url", F.lit(p)), F.lit(""))
    return b.raw("pages").select("page_id", part("HOST").alias("host"), part("PATH").alias("path"))


@register("f21_iso_dates", "SELECT event_id, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%fZ') iso, strftime(CAST(ts AS TIMESTAMP), '%Y-%m') AS month, regexp_replace(strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%fZ'), '[-:.]', '', 'g') segment FROM events")
def iso_dates(b: Bundle):
    iso = textops.iso_micros(F.col("ts").cast("timestamp"))
    return b.raw("events").select("event_id", iso.alias("iso"), F.date_format("ts", "yyyy-MM").alias("month"), F.regexp_replace(iso, "[-:.]", "").alias("segment"))


@register("f22_epoch_numbers", "SELECT event_id, CAST(CASE WHEN v > 253402300799 THEN v / 1000 ELSE v END AS BIGINT) s FROM (SELECT event_id, epoch_ms(CAST(ts AS TIMESTAMP)) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END + (epoch_ms(CAST(ts AS TIMESTAMP)) // 1000) * CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END v FROM (SELECT event_id, date_trunc('second', CAST(ts AS TIMESTAMP)) ts FROM events))")
def epoch_numbers(b: Bundle):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    mixed = F.when(F.col("event_id") % 2 == 0, s * 1000).otherwise(s)
    return b.raw("events").select("event_id", textops.epoch_seconds(mixed).cast("long").alias("s"))


@register("f23_age", "SELECT event_id, CAST(epoch(TIMESTAMP '2030-01-01') AS BIGINT) - CAST(floor(epoch(CAST(ts AS TIMESTAMP))) AS BIGINT) > 900 stale FROM events")
def age(b: Bundle):
    now = F.unix_seconds(F.lit("2030-01-01 00:00:00").cast("timestamp"))
    return b.raw("events").select("event_id", (now - F.unix_seconds(F.col("ts").cast("timestamp")) > 900).alias("stale"))


@register("f28_arrays", "SELECT conversation_id, array_to_string(list_sort(list_distinct(list(role))), ',') roles, CAST(len(list(role)) AS BIGINT) n, arg_max(role, \"sequence\") last_role FROM messages GROUP BY 1")
def arrays(b: Bundle):
    return b.messages.groupBy("conversation_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count("*").alias("n"), F.max_by("role", "sequence").alias("last_role"))


@register("f4_strings", "SELECT supplier_key, lpad(CAST(supplier_key AS VARCHAR), 8, '0') padded, supplier_key % 3 = 0 flagged FROM (SELECT s_suppkey supplier_key FROM supplier)")
def strings(b: Bundle):
    s = b.raw("supplier").select(F.col("s_suppkey").alias("supplier_key"))
    return s.select("supplier_key", F.lpad(F.col("supplier_key").cast("string"), 8, "0").alias("padded"), (F.col("supplier_key") % 3 == 0).alias("flagged"))


@register("p1_json_fields", "SELECT event_id, json_extract_string(props, '$.' || k) v, k FROM (SELECT event_id, props, unnest(json_keys(props)) k FROM events)")
def json_fields(b: Bundle):
    e = b.raw("events").select("event_id", "props", F.explode(F.json_object_keys("props")).alias("k"))
    return e.select("event_id", F.get(F.map_values(F.map_filter(F.from_json("props", "map<string,string>"), lambda k, _: k == F.col("k"))), F.lit(0)).alias("v"), "k")


@register("p10_substring_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
def substring_search(b: Bundle):
    return b.raw("documents").where(F.contains(F.lower("text"), F.lit("the"))).select("doc_id")


@register("p20_safe_references", "SELECT user_id, 'user-' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 12) reference, count(*) n FROM events GROUP BY ALL")
def safe_references(b: Bundle):
    return b.raw("events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("reference", hashing.safe_reference("user", F.col("user_id")))


@register("p22_excerpts", "SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE substr(t, 1, 217) || '…' END excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) t FROM documents)")
def excerpts(b: Bundle):
    return b.raw("documents").select("doc_id", textops.excerpt(F.col("text")).alias("excerpt"))


@register("i26_message_projection", f"SELECT message_id, trim(regexp_replace(regexp_replace({PRIVATE}, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g'))[:200] AS excerpt, length(text) n FROM messages")
def message_projection(b: Bundle):
    return b.messages.select("message_id", textops.derived(F.col("text"), 200).alias("excerpt"), F.length("text").cast("long").alias("n"))


@register("p12_full_text")
def full_text(b: Bundle):
    """Blocks that have all lexemes of a query; the stemmer has no SQL counterpart."""
    from ..functions.lexemes import english_lexemes, matches

    return b.blocks.select("content_block_id", english_lexemes("value").alias("lexemes")).where(matches(F.col("lexemes"), "the thtions")) \
        .select("content_block_id", F.size("lexemes").alias("n_lexemes"))
