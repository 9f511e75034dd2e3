"""Tree, splitting, streaming and HTML queries."""

from pyspark.sql import functions as F

from ..model import Bundle
from ..operators import operations, paths, splitting, trees
from ..registry import register
from ..shared import new_path
from ..sources import html
from ..streaming import operation_stream
from ..streaming.intent_stream import rocksdb
from .operation_log import FOLD

TREE = """nodes AS (SELECT conversation_id, message_id node_id, "sequence" s, CASE WHEN "sequence" > 0 THEN ("sequence" - 1) // 2 END p, "sequence" = max("sequence") OVER (PARTITION BY conversation_id) cur FROM messages)"""


def _nodes(b: Bundle):
    """A binary tree over each conversation's turns, as the export would hold after edits."""
    m = b.messages.select("conversation_id", "message_id", "sequence", "conv_id")
    parent = m.select("conversation_id", F.col("message_id").alias("parent_id"), F.col("sequence").alias("ps"))
    last = m.groupBy("conversation_id").agg(F.max_by("message_id", "sequence").alias("current_node"))
    up = F.when(F.col("sequence") > 0, F.floor((F.col("sequence") - 1) / 2))
    return m.withColumn("ps", up).join(parent, ["conversation_id", "ps"], "left").join(last, "conversation_id").select(
        "conversation_id", F.col("message_id").alias("node_id"), "parent_id", F.col("sequence").alias("child_order"), (F.col("sequence") % 3 != 1).alias("has_message"), "current_node")


@register("i1_preorder", """SELECT conversation_id, node_id, row_number() OVER (PARTITION BY conversation_id ORDER BY path) - 1 AS position, depth FROM (WITH RECURSIVE t AS (
SELECT conversation_id, node_id, s, lpad(CAST(s AS VARCHAR), 6, '0') path, CAST(0 AS BIGINT) depth FROM nodes WHERE p IS NULL
UNION ALL SELECT n.conversation_id, n.node_id, n.s, t.path || '/' || lpad(CAST(n.s AS VARCHAR), 6, '0'), t.depth + 1 FROM nodes n JOIN t ON t.conversation_id = n.conversation_id AND t.s = n.p) SELECT * FROM t)""", TREE)
def preorder(b: Bundle):
    return trees.walk(_nodes(b)).select("conversation_id", "node_id", "position", "depth")


@register("i2_active_path", """SELECT conversation_id, node_id FROM (WITH RECURSIVE t AS (SELECT conversation_id, node_id, p FROM nodes WHERE cur
UNION ALL SELECT n.conversation_id, n.node_id, n.p FROM nodes n JOIN t ON t.conversation_id = n.conversation_id AND n.s = t.p) SELECT * FROM t)""", TREE)
def active_path(b: Bundle):
    nodes = _nodes(b)
    return paths.ancestors(paths.levels(nodes), nodes.select("conversation_id", F.col("current_node").alias("node_id")))


@register("i3_message_ancestor", """SELECT a.conversation_id, a.node_id, n.node_id message_ancestor FROM (WITH RECURSIVE t AS (SELECT conversation_id, node_id, p AS up FROM nodes
UNION ALL SELECT t.conversation_id, t.node_id, n.p FROM t JOIN nodes n ON n.conversation_id = t.conversation_id AND n.s = t.up WHERE t.up % 3 = 1)
SELECT conversation_id, node_id, max(up) FILTER (WHERE up % 3 <> 1) anc FROM t GROUP BY ALL) a LEFT JOIN nodes n ON n.conversation_id = a.conversation_id AND n.s = a.anc""", TREE)
def message_ancestor(b: Bundle):
    return paths.message_ancestors(_nodes(b))


@register("i12_split_by_size", """SELECT conversation_id, s AS "sequence", no chunk_no, n > 700 oversize FROM (WITH RECURSIVE z AS (SELECT conversation_id, "sequence" s, length(text) n FROM messages),
t AS (SELECT conversation_id, s, n, CAST(0 AS BIGINT) no, n used FROM z WHERE s = 0 UNION ALL
SELECT z.conversation_id, z.s, z.n, CASE WHEN t.used > 0 AND t.used + z.n > 700 THEN t.no + 1 ELSE t.no END, CASE WHEN t.used > 0 AND t.used + z.n > 700 THEN z.n ELSE t.used + z.n END FROM z JOIN t ON t.conversation_id = z.conversation_id AND z.s = t.s + 1) SELECT * FROM t)""")
def split_by_size(b: Bundle):
    return splitting.split_by_size(b.messages, 700)


@register("j2_streamed_fold", """SELECT f.operation_id, f.status, f.error, f.n_events, e.event_type last_event_type
FROM (SELECT operation_id, arg_max(status, seen) status, max(error) error, max(seen) n_events FROM walk GROUP BY 1) f
JOIN ev e ON e.operation_id = f.operation_id AND e.event_sequence = f.n_events""", FOLD)
def streamed_fold(b: Bundle):
    """The log as files, of every third number each, read as a stream in three batches and folded with state; the last state of each operation."""
    spark = b.spark
    root, tasks = new_path(spark, "log"), spark.sparkContext.defaultParallelism
    part = F.col("event_sequence") % 3
    b.operation_events.withColumn("third", part).repartition(3 * tasks, "third", F.pmod(F.hash("operation_id"), F.lit(tasks))).drop("third").write.parquet(f"{root}/in")
    files = spark.read.parquet(f"{root}/in").select(F.input_file_name().alias("f")).distinct().count()
    events = spark.readStream.schema(b.operation_events.schema).option("maxFilesPerTrigger", max(1, -(-files // 3))).parquet(f"{root}/in")

    def put(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/part={number}")

    with rocksdb(spark):
        operation_stream.fold_stream(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{root}/out").groupBy("operation_id").agg(F.max_by(F.struct("status", "error", "n_events", "last_event_type"), "batch").alias("s"))
    return rows.select("operation_id", "s.*")


@register("j3_stale_operations")
def stale_operations(b: Bundle):
    report = operations.status_report(b.operation_events, 1_800_000_000_000_000)
    return operation_stream.stale(report, 1_800_000_000_000_000, 900)


@register("a12_html_blocks")
def html_blocks(b: Bundle):
    return html.blocks(b.raw("pages"))


@register("a13_sanitized_html")
def sanitized_html(b: Bundle):
    return html.sanitized(b.raw("pages"))


@register("a14_structure_hash")
def structure_hash(b: Bundle):
    return html.structure_hashes(b.raw("pages"))
