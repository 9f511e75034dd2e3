"""Session logs: JSON-lines files of two shapes, read to records and normalised to messages.

Shape A has {timestamp, ordinal, type, payload} lines, shape B {type, uuid, parentUuid,
timestamp, sessionId, isMeta, message} lines.  A file's lines keep their numbers;
lines that are not JSON become rows with an error and never vanish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.textops import redact_secrets, redaction_counts

# What scaffolding texts of either shape begin with.
SCAFFOLDING_A = ("<environment_context>", "<user_instructions>", "<skills_instructions>", "<multi_agent_mode>")
SCAFFOLDING_B = ("<environment_context", "<user_instructions", "<system-reminder", "<command-name>", "<local-command", "# AGENTS.md", "Caveat:")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw, json, error) of every line that is not blank; files are read whole, as a line's number counts from its start."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "raw"))
    parsed = F.try_parse_json("raw")
    return text.where(F.trim("raw") != "").select("file", (F.col("n") + 1).alias("line_no"), "raw", parsed.alias("json"),
                                                 F.when(parsed.isNull(), "malformed_line").alias("error"))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("json", path, kind)


def type_counts(records: DataFrame) -> DataFrame:
    """(file, type, n): records by type, and by type/payload type where the payload has one."""
    whole = F.concat_ws("/", F.coalesce(_get("$.type"), F.lit("unknown")), _text("$.payload.type"))
    return records.groupBy("file", F.when(F.col("error").isNotNull(), F.col("error")).otherwise(whole).alias("type")).agg(F.count("*").alias("n"))


def _text(path: str) -> Column:
    """A string; anything else is null."""
    found = F.try_variant_get("json", path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", _get(path))


def _scaffolding(text: Column, prefixes: tuple[str, ...]) -> Column:
    left = F.regexp_replace(text, r"^\s+", "")
    out = F.lit(False)
    for prefix in prefixes:
        out = out | F.startswith(left, F.lit(prefix))
    return out


def _parts(path: str, between: str) -> Column:
    """The texts of an array's parts; a part without one is empty, and what is no array is null."""
    parts = F.try_variant_get("json", path, "array<variant>")
    texts = F.transform(parts, lambda p: F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")) == "STRING", F.try_variant_get(p, "$.text", "string")), F.lit("")))
    return F.array_join(texts, between)


def _classified(records: DataFrame) -> DataFrame:
    """Shape A's records with a role, a text and, where they are not promoted, a reason."""
    kind, role = _text("$.payload.type"), _get("$.payload.role")
    item = F.coalesce(_get("$.type") == "response_item", F.lit(False))
    message = item & F.coalesce(kind == "message", F.lit(False))
    call, output = (item & F.coalesce(kind == k, F.lit(False)) for k in ("custom_tool_call", "custom_tool_call_output"))
    told = F.coalesce(_parts("$.payload.content", "\n"), F.lit(""))
    text = F.when(message, told).when(call, F.concat(F.lit("tool_call "), F.coalesce(_get("$.payload.name"), F.lit("tool")), F.lit("\n"), F.coalesce(_get("$.payload.input"), F.lit("null")))) \
        .when(output, F.coalesce(_text("$.payload.output"), _parts("$.payload.output", ""), F.lit("")))
    promoted = F.when(message & (role == "user"), F.when(_scaffolding(told, SCAFFOLDING_A), "system_visible").otherwise("user")).when(message & (role == "assistant"), "assistant").when(call | output, "tool")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(message & (role == "developer"), "developer_scaffolding") \
        .when(message, F.concat(F.lit("unrecognized_message_role:"), F.coalesce(role, F.lit("")))).when(item & (kind == "reasoning"), "encrypted_reasoning_ciphertext").otherwise("non_message_record")
    return records.withColumn("role", promoted).withColumn("kind", kind).withColumn("text", text).withColumn("reason", F.when(promoted.isNull(), reason))


def messages_a(records: DataFrame) -> DataFrame:
    """(file, sequence, line_no, role, kind, text, redactions) of shape A: user and assistant messages, tool calls and their outputs are promoted."""
    return _numbered(_classified(records).where("reason is null"))


def excluded_a(records: DataFrame) -> DataFrame:
    """(file, line_no, reason) of what shape A does not promote."""
    return _classified(records).where("reason is not null").select("file", "line_no", "reason")


def sessions_a(records: DataFrame) -> DataFrame:
    """(file, session_id, session_timestamp, originator, client_version, workspace, n_records) by the first record that tells of the session."""
    meta = F.when(_get("$.type") == "session_meta", F.struct(
        F.coalesce(_get("$.payload.session_id"), _get("$.payload.id")).alias("session_id"), F.coalesce(_get("$.payload.timestamp"), _get("$.timestamp")).alias("session_timestamp"),
        _get("$.payload.originator").alias("originator"), F.coalesce(_get("$.payload.cli_version"), F.lit("unknown")).alias("client_version"), _text("$.payload.cwd").alias("workspace")))
    told = records.groupBy("file").agg(F.min_by(meta, F.when(meta.isNotNull(), F.col("line_no"))).alias("m"), F.count("*").alias("n_records"))
    return told.select("file", "m.*", "n_records")


def session_a_issues(records: DataFrame) -> DataFrame:
    """(code, record_id, message): files of shape A with a line that is no JSON, without a record of the session, or without its id."""
    told = sessions_a(records)
    has_meta = records.where(_get("$.type") == "session_meta").select("file").distinct()
    none = told.join(has_meta, "file", "left_anti").select(F.lit("no_session_meta").alias("code"), F.col("file").alias("record_id"), F.lit("").alias("message"))
    no_id = told.join(has_meta, "file", "left_semi").where("coalesce(session_id, '') = ''").select(F.lit("no_session_id").alias("code"), F.col("file").alias("record_id"), F.lit("").alias("message"))
    malformed = records.where("error is not null").select(F.col("error").alias("code"), F.col("file").alias("record_id"), F.col("line_no").cast("string").alias("message"))
    return none.unionByName(no_id).unionByName(malformed)


def messages_b(records: DataFrame) -> DataFrame:
    """The same of shape B: text, tool_use and tool_result blocks are promoted in order, thinking blocks are not."""
    blocks = F.try_variant_get("json", "$.message.content", "array<struct<type:string,text:string,name:string,content:string>>")
    plain = F.array(F.struct(F.lit("text").alias("type"), _get("$.message.content").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("content")))
    rows = records.where(_get("$.type").isin("user", "assistant")).select("file", "line_no", "json", F.posexplode(F.coalesce(blocks, plain)).alias("block", "b"))
    kept = rows.where(F.col("b.type").isin("text", "tool_use", "tool_result"))
    role = F.when(F.col("b.type") == "tool_result", "tool").otherwise(_get("$.message.role"))
    found = kept.withColumn("text", F.coalesce("b.text", "b.content", "b.name")).withColumn("kind", F.col("b.type"))
    return _numbered(found.withColumn("role", F.when((role == "user") & _scaffolding(F.col("text"), SCAFFOLDING_B), "system_visible").otherwise(role)))


def _numbered(found: DataFrame) -> DataFrame:
    order = [c for c in ("line_no", "block") if c in found.columns]
    n = F.row_number().over(Window.partitionBy("file").orderBy(*order)) - 1
    return found.select("file", n.cast("long").alias("sequence"), "line_no", "role", "kind", redact_secrets(F.col("text")).alias("text"), redaction_counts(F.col("text")).alias("redactions"))


def session_issues(records: DataFrame) -> DataFrame:
    """(code, record_id, message): files of shape B with none or several session ids."""
    ids = records.groupBy("file").agg(F.count_distinct(_get("$.sessionId")).alias("n"))
    return ids.where("n <> 1").select(F.lit("session_id_not_unique").alias("code"), F.col("file").alias("record_id"), F.col("n").cast("string").alias("message"))
