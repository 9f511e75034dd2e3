"""The evidence model over the test tables: typed DataFrames of one workspace.

`Bundle` projects the raw tables to messages, content blocks, message ranges,
knowledge candidates, provenance edges, review events and approvals.  `PRELUDE`
has the same projection as DuckDB common table expressions, for the oracles.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import hashed_id, ordered_digest, sha256

WORKSPACE = "ws_main"
EPOCH = 1_767_225_600
RANGE = 5
KINDS = ("idea", "claim", "decision", "task")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Bundle:
    """One workspace's tables; every table carries workspace_id."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def messages(self) -> DataFrame:
        c = self.raw("conversations")
        role = F.when(F.col("role") == "system", "system_visible").otherwise(F.col("role"))
        return c.select(
            F.lit(WORKSPACE).alias("workspace_id"), hashed_id("conversation", F.lit("conv"), F.col("conv_id")).alias("conversation_id"),
            "conv_id", hashed_id("message", F.col("conv_id"), F.col("turn")).alias("message_id"), F.col("turn").alias("sequence"),
            role.alias("role"), "text", sha256(F.col("text")).alias("text_sha256"), (F.lit(EPOCH) + F.col("conv_id") * 60 + F.col("turn")).alias("created_s"))

    @cached_property
    def blocks(self) -> DataFrame:
        b = self.messages.select("workspace_id", "conversation_id", "conv_id", "message_id", "sequence", "role", F.posexplode(F.split("text", "\n")).alias("block_sequence", "value"))
        kind = F.when(F.col("value") == "", "empty").when(F.length("value") < 40, "heading").otherwise("paragraph")
        return b.withColumn("content_block_id", hashed_id("content_block", F.col("message_id"), F.lit("block"), F.col("block_sequence"))) \
            .withColumn("block_kind", kind).withColumn("sha256", sha256(F.col("value")))

    @cached_property
    def representations(self) -> DataFrame:
        """content blocks with their array of representations: canonical text, and the same in lower case."""
        def one(kind: str, value) -> F.Column:
            return F.struct(F.lit(kind).alias("representation_kind"), value.alias("value"), sha256(value).alias("sha256"))

        return self.blocks.withColumn("representations", F.array(one("canonical_text", F.col("value")), one("lower_text", F.lower("value"))))

    @cached_property
    def ranges(self) -> DataFrame:
        r = self.messages.withColumn("range_no", F.floor(F.col("sequence") / RANGE))
        return r.groupBy("workspace_id", "conversation_id", "conv_id", "range_no").agg(
            F.min("sequence").alias("start_sequence"), F.max("sequence").alias("end_sequence"), F.count("*").alias("n_messages"),
            ordered_digest("text_sha256", "sequence").alias("range_sha256")).withColumn("chunk_id", hashed_id("chunk", F.col("conversation_id"), F.col("range_no")))

    @cached_property
    def candidates(self) -> DataFrame:
        kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("range_no") % len(KINDS) + 1).cast("int"))
        rest = (F.col("conv_id") + F.col("range_no")) % 3
        return self.ranges.withColumn("knowledge_candidate_id", hashed_id("knowledge_candidate", F.col("conversation_id"), F.col("range_no"))) \
            .withColumn("kind", kind).withColumn("status", F.lit("proposed")) \
            .withColumn("decision", F.when(rest == 0, "approved").when(rest == 1, "rejected"))

    @cached_property
    def edges(self) -> DataFrame:
        c = self.candidates.select("workspace_id", "conversation_id", "range_no", "knowledge_candidate_id")
        b = self.blocks.select("conversation_id", "message_id", "sequence", "content_block_id", F.col("sha256").alias("representation_sha256"),
                               F.floor(F.col("sequence") / RANGE).alias("range_no"))
        return c.join(b, ["conversation_id", "range_no"]).withColumn("provenance_edge_id", hashed_id("provenance_edge", F.col("knowledge_candidate_id"), F.col("content_block_id"))) \
            .withColumn("representation_kind", F.lit("canonical_text"))

    @cached_property
    def reviews(self) -> DataFrame:
        return self.candidates.where("decision is not null").select(
            "workspace_id", "conversation_id", "knowledge_candidate_id", hashed_id("human_review_event", F.col("knowledge_candidate_id")).alias("human_review_event_id"),
            F.concat(F.lit("reviewer_"), (F.col("conv_id") % 4).cast("string")).alias("reviewer_id"), F.col("decision").alias("to_status"),
            (F.lit(EPOCH) + F.col("conv_id") * 60).alias("occurred_s"))

    @cached_property
    def approved(self) -> DataFrame:
        return self.reviews.where("to_status = 'approved'").select(
            "workspace_id", "knowledge_candidate_id", hashed_id("approved_knowledge", F.col("knowledge_candidate_id")).alias("approved_knowledge_id"),
            F.col("human_review_event_id").alias("approval_event_id"), F.col("occurred_s").alias("approved_s"))

    @cached_property
    def captures(self) -> DataFrame:
        status = F.col("conv_id") % 10
        return self.messages.groupBy("workspace_id", "conversation_id", "conv_id").agg(
            F.count("*").alias("n_messages"), ordered_digest("text_sha256", "sequence").alias("manifest_sha256")) \
            .withColumn("capture_version_id", hashed_id("capture_version", F.col("conversation_id"))) \
            .withColumn("verification_status", F.when(status == 0, "partial").when(status == 1, "needs_review").when(status == 2, "failed").otherwise("complete")) \
            .withColumn("source_family", F.when(F.col("conv_id") % 2 == 0, "native_export").otherwise("browser_capture")) \
            .withColumn("captured_s", F.lit(EPOCH) + F.col("conv_id") * 60 + 30)

    @cached_property
    def operation_events(self) -> DataFrame:
        """The steps of success lifecycles at the times of a user's events: each run of as many events as there are steps is one operation, the last one as far as
        its events go; some have a fault."""
        from .operators.operations import LIFECYCLE

        e = self.raw("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
        from pyspark.sql import Window

        n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
        steps = F.array(*map(F.lit, LIFECYCLE))
        e = e.withColumn("n", n).withColumn("cycle", F.floor(F.col("n") / len(LIFECYCLE))).withColumn("event_sequence", (F.col("n") % len(LIFECYCLE) + 1).cast("int"))
        kind = F.when((F.col("user_id") % 17 == 0) & (F.col("event_sequence") == 4), "capture_completed").otherwise(F.element_at(steps, F.col("event_sequence")))
        return e.select(hashed_id("operation", F.col("user_id"), F.col("cycle")).alias("operation_id"), F.col("event_sequence").cast("long").alias("event_sequence"), kind.alias("event_type"),
                        F.unix_micros("ts").alias("event_us"), F.concat(F.lit("component_"), (F.col("event_sequence") % 3).cast("string")).alias("source_component"))


#: The same projection for DuckDB; an oracle is PRELUDE and a SELECT.
PRELUDE = f"""WITH messages AS (
  SELECT '{WORKSPACE}' workspace_id, 'conversation_' || substr(sha256('conv:' || conv_id), 1, 32) conversation_id, conv_id,
    'message_' || substr(sha256(conv_id || ':' || turn), 1, 32) message_id, turn AS "sequence",
    CASE role WHEN 'system' THEN 'system_visible' ELSE role END AS role, text, sha256(text) text_sha256, {EPOCH} + conv_id * 60 + turn created_s
  FROM conversations),
blocks0 AS (SELECT workspace_id, conversation_id, conv_id, message_id, "sequence", role, unnest(string_split(text, chr(10))) AS value,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_sequence FROM messages),
blocks AS (SELECT *, 'content_block_' || substr(sha256(message_id || ':block:' || block_sequence), 1, 32) content_block_id,
    CASE WHEN value = '' THEN 'empty' WHEN length(value) < 40 THEN 'heading' ELSE 'paragraph' END block_kind, sha256(value) sha256 FROM blocks0),
ranges0 AS (SELECT workspace_id, conversation_id, conv_id, CAST(floor("sequence" / {RANGE}) AS BIGINT) range_no, min("sequence") start_sequence, max("sequence") end_sequence,
    count(*) n_messages, sha256(string_agg(text_sha256, ',' ORDER BY "sequence")) range_sha256 FROM messages GROUP BY ALL),
ranges AS (SELECT *, 'chunk_' || substr(sha256(conversation_id || ':' || range_no), 1, 32) chunk_id FROM ranges0),
candidates AS (SELECT *, 'knowledge_candidate_' || substr(sha256(conversation_id || ':' || range_no), 1, 32) knowledge_candidate_id,
    list_extract(['idea', 'claim', 'decision', 'task'], CAST(range_no % 4 + 1 AS INTEGER)) kind, 'proposed' status,
    CASE (conv_id + range_no) % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' END decision FROM ranges),
edges AS (SELECT c.workspace_id, c.conversation_id, c.range_no, c.knowledge_candidate_id, b.message_id, b."sequence", b.content_block_id, b.sha256 representation_sha256,
    'provenance_edge_' || substr(sha256(c.knowledge_candidate_id || ':' || b.content_block_id), 1, 32) provenance_edge_id, 'canonical_text' representation_kind
  FROM candidates c JOIN blocks b ON b.conversation_id = c.conversation_id AND floor(b."sequence" / {RANGE}) = c.range_no),
reviews AS (SELECT workspace_id, conversation_id, knowledge_candidate_id, 'human_review_event_' || substr(sha256(knowledge_candidate_id), 1, 32) human_review_event_id,
    'reviewer_' || (conv_id % 4) reviewer_id, decision to_status, {EPOCH} + conv_id * 60 occurred_s FROM candidates WHERE decision IS NOT NULL),
approved AS (SELECT workspace_id, knowledge_candidate_id, 'approved_knowledge_' || substr(sha256(knowledge_candidate_id), 1, 32) approved_knowledge_id,
    human_review_event_id approval_event_id, occurred_s approved_s FROM reviews WHERE to_status = 'approved'),
captures AS (SELECT workspace_id, conversation_id, conv_id, count(*) n_messages, sha256(string_agg(text_sha256, ',' ORDER BY "sequence")) manifest_sha256,
    'capture_version_' || substr(sha256(conversation_id), 1, 32) capture_version_id,
    CASE conv_id % 10 WHEN 0 THEN 'partial' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'failed' ELSE 'complete' END verification_status,
    CASE WHEN conv_id % 2 = 0 THEN 'native_export' ELSE 'browser_capture' END source_family, {EPOCH} + conv_id * 60 + 30 captured_s
  FROM messages GROUP BY workspace_id, conversation_id, conv_id)
"""
