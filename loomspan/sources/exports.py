"""Native exports: conversations whose messages hang in a mapping of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.textops import epoch_seconds
from ..operators.trees import walk

SCHEMA = """conversation_id string, title string, create_time double, update_time double, current_node string, mapping map<string, struct<parent: string, children: array<string>,
message: struct<author: struct<role: string>, create_time: double, content: struct<content_type: string, parts: array<string>, text: string>>>>"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each conversation of JSON files that hold arrays or lines of them."""
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(path)


def nodes(conversations: DataFrame) -> DataFrame:
    """All nodes of every mapping, on the active path or not, as `walk` takes them."""
    c = conversations.select("conversation_id", "current_node", "mapping", F.explode("mapping").alias("node_id", "n"))
    siblings = F.try_element_at("mapping", F.col("n.parent"))["children"]
    order = F.coalesce(F.array_position(siblings, F.col("node_id")), F.lit(0)).cast("long")
    return c.select("conversation_id", "node_id", F.col("n.parent").alias("parent_id"), order.alias("child_order"), F.col("n.message").isNotNull().alias("has_message"), "current_node")


def messages(conversations: DataFrame) -> DataFrame:
    """(conversation_id, node_id, sequence, role, text, created_s, on_active_path, parent_message_id) in tree order; any content type gives text."""
    flat = conversations.select("conversation_id", F.explode("mapping").alias("node_id", "n")).where("n.message is not null").select("conversation_id", "node_id", "n.message")
    content = F.col("message.content")
    text = F.when(F.size(content["parts"]) > 0, F.array_join(content["parts"], "\n")).otherwise(F.coalesce(content["text"], F.to_json(content)))
    role = F.col("message.author.role")
    rows = flat.select("conversation_id", "node_id", F.when(role == "system", "system_visible").otherwise(F.coalesce(role, F.lit("unknown"))).alias("role"), text.alias("text"),
                       epoch_seconds(F.col("message.create_time")).alias("created_s"))
    return rows.join(walk(nodes(conversations)), ["conversation_id", "node_id"]).select(
        "conversation_id", "node_id", F.col("position").alias("sequence"), "role", "text", "created_s", "on_active_path", F.col("message_ancestor").alias("parent_message_id"))
