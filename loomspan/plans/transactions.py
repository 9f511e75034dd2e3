"""Ingestion, extraction and discovery written to a versioned store, and read back from what is visible there."""

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KINDS, Bundle
from ..operators import workspaces
from ..operators.validators import issues, union
from ..registry import register
from ..shared import new_path, written
from ..sinks.versions import Store
from ..streaming import ingest_stream

_IDS = {"captures": "capture_version_id", "messages": "message_id", "content_blocks": "content_block_id", "message_range_chunks": "chunk_id",
        "knowledge_candidates": "knowledge_candidate_id", "provenance_edges": "provenance_edge_id", "checkpoints": "conversation_id"}


def _store(b: Bundle, name: str) -> Store:
    return Store(b.spark, new_path(b.spark, name))


def _ingested(b: Bundle) -> dict[str, DataFrame]:
    """The tables of an ingestion run over all captures; a checkpoint says how many of its chunks a conversation has."""
    chunks = b.ranges.groupBy("conversation_id").agg(F.count("*").alias("completed_chunk_count"), F.max("end_sequence").alias("last_sequence"))
    return {"captures": b.captures, "messages": b.messages, "content_blocks": b.blocks, "message_range_chunks": b.ranges, "knowledge_candidates": b.candidates,
            "provenance_edges": b.edges, "checkpoints": chunks}


@register("i4_ingested_tables", """SELECT t.*, 'committed,replayed' outcomes FROM (SELECT 'captures' "table", count(*) n_rows, count(DISTINCT capture_version_id) n_ids FROM captures
UNION ALL SELECT 'messages', count(*), count(DISTINCT message_id) FROM messages UNION ALL SELECT 'content_blocks', count(*), count(DISTINCT content_block_id) FROM blocks
UNION ALL SELECT 'message_range_chunks', count(*), count(DISTINCT chunk_id) FROM ranges UNION ALL SELECT 'knowledge_candidates', count(*), count(DISTINCT knowledge_candidate_id) FROM candidates
UNION ALL SELECT 'provenance_edges', count(*), count(DISTINCT provenance_edge_id) FROM edges UNION ALL SELECT 'checkpoints', count(*), count(DISTINCT conversation_id) FROM ranges WHERE range_no = 0) t""")
def ingested_tables(b: Bundle):
    """One transaction over seven tables; the same run again is a replay and adds nothing."""
    store, tables = _store(b, "ingestion"), _ingested(b)
    outcomes = ",".join(store.write("ingestion_run", tables).outcome for _ in range(2))
    return union(*(store.table(name).agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_ids")).select(F.lit(name).alias("table"), "n_rows", "n_ids", F.lit(outcomes).alias("outcomes"))
                   for name, key in _IDS.items()))


@register("i7_extraction_outcomes", """SELECT n AS attempt, o AS outcome, CAST(c * (SELECT count(*) FROM candidates) AS BIGINT) candidates, CAST(c * (SELECT count(*) FROM edges) AS BIGINT) edges
FROM (VALUES (1, 'dry_run', 0), (2, 'committed', 1), (3, 'replayed', 1), (4, 'collision', 1), (5, 'conflict', 1), (6, 'rejected', 1), (7, 'committed', 2)) t(n, o, c)""")
def extraction_outcomes(b: Bundle):
    """Seven attempts to persist an extraction, and what is visible after each: all of it or nothing."""
    store = _store(b, "extraction")
    candidates, edges = b.candidates.where("status = 'proposed'"), b.edges
    whole = {"candidates": candidates, "edges": edges}
    other = {"candidates": candidates.where("decision is null"), "edges": edges}
    told = []

    def attempt(action) -> None:
        outcome = action()
        seen = [store.table(t).count() if store.version() else 0 for t in ("candidates", "edges")]
        told.append((len(told) + 1, outcome, *seen))

    def checked(tables) -> str:
        """Edges that cite no candidate reject the whole input before anything is written."""
        if not tables["edges"].join(tables["candidates"], "knowledge_candidate_id", "left_anti").isEmpty():
            return "rejected"
        return store.write("extraction:2", tables).outcome

    attempt(lambda: store.write("extraction:1", whole, dry_run=True).outcome)
    attempt(lambda: store.write("extraction:1", whole).outcome)
    attempt(lambda: store.write("extraction:1", whole).outcome)
    attempt(lambda: store.write("extraction:1", other).outcome)
    attempt(lambda: store.write("extraction:2", whole, base=0).outcome)
    attempt(lambda: checked(other))
    attempt(lambda: checked(whole))
    return b.spark.createDataFrame(told, "attempt int, outcome string, candidates long, edges long")


FOUND = """bad AS (SELECT conversation_id, 'edge_outside_conversation' code, knowledge_candidate_id record_id FROM candidates WHERE conv_id % 7 = 3 AND range_no = 0
  UNION ALL SELECT conversation_id, 'link_to_itself', chunk_id FROM ranges WHERE conv_id % 11 = 5 AND range_no > 0
  UNION ALL SELECT conversation_id, 'observation_without_edge', knowledge_candidate_id FROM candidates WHERE conv_id % 13 = 4 AND range_no = 1)"""


def _discovered(b: Bundle) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations, edges and links of every conversation's discovery output; some cite a block of another conversation, link a range to itself, or cite nothing."""
    observations = b.candidates.select("conversation_id", "conv_id", "range_no", F.col("knowledge_candidate_id").alias("observation_id"), "kind")
    e = b.edges.join(observations.select("conversation_id", "range_no", "conv_id"), ["conversation_id", "range_no"])
    e = e.where(~((F.col("conv_id") % 13 == 4) & (F.col("range_no") == 1)))
    strange = (F.col("conv_id") % 7 == 3) & (F.col("range_no") == 0)
    edges = e.select("conversation_id", F.col("knowledge_candidate_id").alias("observation_id"),
                     F.when(strange, F.concat(F.lit("other_"), "content_block_id")).otherwise(F.col("content_block_id")).alias("content_block_id"), "provenance_edge_id")
    r = b.ranges.select("conversation_id", "conv_id", "range_no", "chunk_id")
    before = r.select("conversation_id", (F.col("range_no") + 1).alias("range_no"), F.col("chunk_id").alias("previous"))
    links = r.join(before, ["conversation_id", "range_no"]).select("conversation_id", F.col("chunk_id").alias("from_id"),
                                                                  F.when(F.col("conv_id") % 11 == 5, F.col("chunk_id")).otherwise(F.col("previous")).alias("to_id"))
    return observations, edges, links


def discovery_issues(b: Bundle, observations: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """(code, record_id, message), message being the conversation whose output is at fault."""
    own = b.blocks.select("conversation_id", "content_block_id")
    outside = edges.join(own, ["conversation_id", "content_block_id"], "left_anti").dropDuplicates(["observation_id"])
    return union(issues(outside, "edge_outside_conversation", "observation_id", F.col("conversation_id")),
                 issues(links.where("from_id = to_id"), "link_to_itself", "from_id", F.col("conversation_id")),
                 issues(observations.join(edges, "observation_id", "left_anti"), "observation_without_edge", "observation_id", F.col("conversation_id")))


@register("i13_discovery_issues", "SELECT code, record_id, conversation_id message FROM bad", FOUND)
def discovery_output_issues(b: Bundle):
    return discovery_issues(b, *_discovered(b))


@register("i13_persisted_discovery", """SELECT r.conversation_id, CAST(CASE WHEN x.n IS NULL THEN r.n ELSE 0 END AS BIGINT) observations, CAST(CASE WHEN x.n IS NULL THEN e.n ELSE 0 END AS BIGINT) edges,
  CAST(CASE WHEN x.n IS NULL THEN r.n - 1 ELSE 0 END AS BIGINT) links, CAST(coalesce(x.n, 0) AS BIGINT) issues, 'committed,replayed' outcomes FROM (SELECT conversation_id, count(*) n FROM candidates GROUP BY 1) r
JOIN (SELECT conversation_id, count(*) n FROM edges GROUP BY 1) e ON e.conversation_id = r.conversation_id LEFT JOIN (SELECT conversation_id, count(*) n FROM bad GROUP BY 1) x ON x.conversation_id = r.conversation_id""", FOUND)
def persisted_discovery(b: Bundle):
    """An output with any issue is rejected whole; the others are persisted in one transaction, and a second time as a replay."""
    told = {name: written(df, name) for name, df in zip(("observations", "edges", "links"), _discovered(b))}
    found = written(discovery_issues(b, *told.values()).groupBy(F.col("message").alias("conversation_id")).agg(F.count("*").alias("issues")), "issues")
    store = _store(b, "discovery")
    accepted = {name: df.join(found, "conversation_id", "left_anti") for name, df in told.items()}
    outcomes = ",".join(store.write("discovery", accepted).outcome for _ in range(2))
    rows = told["observations"].select("conversation_id").distinct().join(found, "conversation_id", "left")
    for name in told:
        rows = rows.join(store.table(name).groupBy("conversation_id").agg(F.count("*").alias(name)), "conversation_id", "left")
    return rows.select("conversation_id", *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in (*told, "issues")), F.lit(outcomes).alias("outcomes"))


@register("b9_journal", """SELECT CAST(i AS BIGINT) "version", 'kind:' || k transaction_id, n n_rows, CAST(sum(n) OVER (ORDER BY i) AS BIGINT) visible, true chained FROM (
SELECT i, k, (SELECT count(*) FROM candidates WHERE kind = k) n FROM (VALUES (1, 'idea'), (2, 'claim'), (3, 'decision'), (4, 'task')) t(i, k))""")
def journal(b: Bundle):
    """A transaction for each kind of knowledge; the journal, what each version shows, and whether it continues the chain."""
    store = _store(b, "catalog")
    for kind in KINDS:
        store.write(f"kind:{kind}", {"candidates": b.candidates.where(F.col("kind") == kind)})
    seen = union(*(store.table("candidates", v).agg(F.count("*").alias("visible")).withColumn("version", F.lit(v).cast("long")) for v in range(1, len(KINDS) + 1)))
    broken = store.broken().select("version", F.lit(False).alias("sound")).distinct()
    return store.journal().select("version", "transaction_id", F.col("parts")[0]["rows"].alias("n_rows")).join(seen, "version").join(broken, "version", "left") \
        .select("version", "transaction_id", "n_rows", "visible", F.coalesce("sound", F.lit(True)).alias("chained"))


@register("j7_resumed_ingestion", """SELECT conversation_id, count(*) chunks, CAST(sum(n_messages) AS BIGINT) messages, max(end_sequence) last_sequence FROM ranges GROUP BY 1""")
def resumed_ingestion(b: Bundle):
    """Message ranges as a stream of files; the run stops once before a batch's commit and once after one, and goes on to the end."""
    spark, root, store = b.spark, new_path(b.spark, "ranges"), _store(b, "chunks")
    chunks = b.ranges.select("conversation_id", "chunk_id", "range_no", "end_sequence", "n_messages")
    for k in range(4):
        chunks.where(F.col("range_no") % 4 == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stops = {("before", 1), ("after", 2)}

    def stop(where: str):
        def at(number: int) -> None:
            if (where, number) in stops:
                stops.remove((where, number))
                raise InterruptedError(f"{where} commit {number}")

        return at

    sink = ingest_stream.exactly_once(store, "chunks", lambda batch: {"chunks": batch}, stop("before"), stop("after"))
    while True:
        stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        try:
            stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
            break
        except StreamingQueryException as error:
            if "InterruptedError" not in str(error):
                raise
    return store.table("chunks").groupBy("conversation_id").agg(F.count("*").alias("chunks"), F.sum("n_messages").alias("messages"), F.max("end_sequence").alias("last_sequence"))


@register("i28_ensured_workspaces", """SELECT r.n AS batch, request_id, CASE WHEN k < 8 THEN 'name 1' END AS name, k < 8 AND r.n = 1 AND copy = 0 created,
CASE WHEN k >= 8 THEN 'invalid_body' END error FROM (VALUES (1), (2)) r(n), (SELECT c_custkey, c_custkey % 10 k, copy, c_custkey || ':' || copy request_id FROM customer, (VALUES (0), (1)) t(copy))""")
def ensured_workspaces(b: Bundle):
    """Every customer asks twice in a batch, and again in a second one by another name; a fifth of the requests have no proper key or name."""
    store, k = _store(b, "workspaces"), F.col("c_custkey") % 10
    h = F.sha2(F.col("c_custkey").cast("string"), 256)
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    asked = b.raw("customer").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.concat_ws(":", "c_custkey", "copy").alias("request_id"), F.col("copy").alias("place"), F.concat(F.when(k == 8, "core:team:").otherwise("core:user:"), uuid).alias("external_key"), k.alias("k"))
    told = []
    for batch in (1, 2):
        name = F.when(F.col("k") == 9, F.lit(" padded")).otherwise(F.lit(f"name {batch}"))
        outcomes = workspaces.ensure(store, f"batch:{batch}", asked.withColumn("name", name).drop("k"))
        told.append(outcomes.select(F.lit(batch).alias("batch"), "request_id", "name", "created", "error"))
    return union(*told)
