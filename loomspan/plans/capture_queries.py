"""The checks of captures, each failing in some conversation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Bundle
from ..operators import capture_rules
from ..registry import register

MODULUS = 23
#: Checks that fail by the remainder of a conversation's number.
FAILS = {1: ["messages.present"], 2: ["messages.sequenced"], 3: ["roles.known"], 4: ["representations.hashed"], 5: ["representations.text_stable"], 6: ["representations.structure_stable"], 7: ["content_blocks.hashed"],
         8: ["messages.sequenced", "transcript.count_matches"], 9: ["code.preserved"], 10: ["tables.preserved"], 11: ["citations.recorded"], 12: ["attachments.recorded"], 13: ["artifacts.recorded"], 14: ["branches.complete"],
         15: ["branches.complete"], 16: ["evidence.initial"], 17: ["evidence.earliest"], 18: ["evidence.latest"], 19: ["representations.hashed"], 20: ["evidence.initial", "roles.known"]}
CHECKED = f"""bad(k, check_id) AS (VALUES {", ".join(f"({k}, '{c}')" for k, cs in FAILS.items() for c in cs)}),
chk AS (SELECT conversation_id, c check_id, CASE WHEN (conv_id % {MODULUS}, c) IN (SELECT (k, check_id) FROM bad) THEN 'fail' ELSE 'pass' END status, CASE WHEN c IN ({", ".join(f"'{x}'" for x in capture_rules.WARNINGS)}) THEN 'warning' ELSE 'material' END severity
  FROM captures CROSS JOIN (SELECT unnest({list(capture_rules.MATERIAL + capture_rules.WARNINGS)}) c))"""


def _facts(b: Bundle) -> dict[str, DataFrame]:
    k, first = F.col("conv_id") % MODULUS, F.col("sequence") == 0

    def four(hash_, *lost: str):
        return F.array(*(F.struct(F.lit(x).alias("kind"), hash_.alias("sha256")) for x in ("inner_text", "text_content", "canonical_text", "sanitized_html") if x not in lost))

    m = b.messages
    words = F.array().cast("array<string>")
    hashes = F.when((k == 6) & first, F.array("text_sha256", F.sha2("text_sha256", 256))).when((k == 21) & first, F.array("text_sha256", "text_sha256")).otherwise(words)
    messages = m.where(k != 1).select(
        "conversation_id", (F.col("sequence") + F.when(k == 2, 1).otherwise(0)).alias("sequence"), F.when(k.isin(3, 20) & first, "unknown").otherwise(F.col("role")).alias("role"),
        F.when((k == 4) & first, four(F.upper("text_sha256"))).when((k == 19) & first, four(F.col("text_sha256"), "inner_text")).otherwise(four(F.col("text_sha256"))).alias("representations"),
        F.when((k == 5) & first, F.array(F.lit("inner_text"))).when(k.isin(6, 21) & first, F.array(F.lit("sanitized_html"))).otherwise(words).alias("drift_kinds"), hashes.alias("structure_hashes"))
    twice = messages.join(b.captures.where(k == 8).select("conversation_id"), "conversation_id", "left_semi").where("sequence = 0")
    messages = messages.unionByName(twice)
    kind = F.element_at(F.array(*map(F.lit, ("paragraph", "code", "table", "link"))), (F.col("sequence") % 4 + 1).cast("int"))
    at = (F.col("sequence") < 4) & (F.col("block_sequence") == 0)
    text_hash = F.when((k == 7) & (F.col("sequence") == 0) & at, F.lit("none")).otherwise(F.col("sha256"))
    # every conversation has one block of each kind, whatever its turns
    one = b.captures.select("conversation_id", "conv_id", F.explode(F.array(*map(F.lit, range(4)))).alias("sequence"), F.lit(0).alias("block_sequence"), F.sha2("conversation_id", 256).alias("sha256"))
    blocks = one.withColumn("type", kind).withColumn("h", text_hash).select("conversation_id", "type", F.when((k == 9) & (F.col("type") == "code"), F.concat(four(F.col("h"), "text_content"), F.array(F.struct(F.lit("other").alias("kind"), F.col("h").alias("sha256")))))
                                                                             .when((k == 10) & (F.col("type") == "table"), F.concat(four(F.col("h"), "sanitized_html"), F.array(F.struct(F.lit("other").alias("kind"), F.col("h").alias("sha256"))))).otherwise(four(F.col("h"))).alias("representations"))
    c = b.captures
    text = F.lit("x")
    return {
        "captures": c, "messages": messages, "blocks": blocks, "citations": c.where(k != 11).select("conversation_id"),
        "attachments": c.select("conversation_id", F.when(k != 12, text).alias("message_id"), text.alias("locator"), text.alias("availability")), "artifacts": c.select("conversation_id", text.alias("message_id"), F.when(k == 13, "").otherwise("x").alias("locator")),
        "branches": c.where(k != 22).select("conversation_id", F.lit("captured").alias("status"), F.lit(2).alias("indicated"), F.when(k == 14, 1).otherwise(2).alias("captured"), (k != 15).alias("restored")),
        "evidence": c.select("conversation_id", "conv_id", F.explode(F.array(*map(F.lit, capture_rules.PORTIONS.values()))).alias("portion"))
        .where(~(k.isin(16, 20) & (F.col("portion") == "initial_viewport")) & ~((k == 17) & (F.col("portion") == "earliest_boundary")) & ~((k == 18) & (F.col("portion") == "latest_boundary"))).drop("conv_id"),
    }


@register("v22_capture_checks", "SELECT conversation_id, check_id, status, severity FROM chk", CHECKED)
def capture_checks(b: Bundle):
    return capture_rules.checks(_facts(b))


@register("v22_capture_status", """SELECT conversation_id, CASE WHEN count(*) FILTER (WHERE status = 'fail' AND severity = 'material') > 0 THEN 'needs_review' WHEN count(*) FILTER (WHERE status = 'fail') > 0 THEN 'partial' ELSE 'complete' END status,
count(*) FILTER (WHERE status = 'fail') n_failed FROM chk GROUP BY 1""", CHECKED)
def capture_status(b: Bundle):
    return capture_rules.status(capture_rules.checks(_facts(b)))
