"""Checks of what was imported from exports and session logs: (source_id, check_id, status, severity) rows, computed and not asserted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha256
from ..functions.textops import redact_secrets
from . import paths

MATERIAL, ADVISORY = "material", "advisory"
REDACTED = "[REDACTED:"


def _checks(df: DataFrame, key: str, material: dict[str, Column], advisory: dict[str, Column]) -> DataFrame:
    """One row for each check whose condition is known; a material one fails, an advisory one warns."""
    told = [F.struct(F.lit(c).alias("check_id"), F.when(ok, "pass").when(~ok, bad).alias("status"), F.lit(severity).alias("severity"))
            for checks, bad, severity in ((material, "fail", MATERIAL), (advisory, "warning", ADVISORY)) for c, ok in checks.items()]
    return df.select(F.col(key).alias("source_id"), F.explode(F.array(*told)).alias("c")).select("source_id", "c.*").where("status is not null")


def container_checks(containers: DataFrame, conversations: DataFrame) -> DataFrame:
    """Checks of export containers (container_id, sha256_expected, sha256_observed, parsed, expected_count, manifest_count, manifest_ids) and of their conversations (container_id, conversation_id).

    The manifest is derived from the export and so only advises; it is left out where there is none.
    """
    counted = conversations.groupBy("container_id").agg(F.count("*").alias("n"), F.count_distinct("conversation_id").alias("n_ids"), F.count_if(F.coalesce(F.col("conversation_id"), F.lit("")) == "").alias("n_null"))
    repeated = conversations.where("conversation_id <> ''").groupBy("container_id", "conversation_id").agg(F.count("*").alias("k")).where("k > 1").groupBy("container_id").agg(F.count("*").alias("n_repeated"))
    listed = containers.select("container_id", F.explode_outer("manifest_ids").alias("conversation_id")).where("conversation_id is not null").distinct().withColumn("listed", F.lit(1))
    own = conversations.where("conversation_id is not null").select("container_id", "conversation_id").distinct().withColumn("own", F.lit(1))
    unlike = listed.join(own, ["container_id", "conversation_id"], "full").where("listed is null or own is null").groupBy("container_id").agg(F.count("*").alias("n_unlike"))
    told = containers
    for df in (counted, repeated, unlike):
        told = told.join(df, "container_id", "left")

    def n(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    return _checks(told, "container_id", {
        "source.container_hash_verified": F.col("sha256_expected").eqNullSafe(F.col("sha256_observed")), "source.json_parsed": F.coalesce("parsed", F.lit(False)),
        "source.expected_conversation_count": n("n").eqNullSafe(F.col("expected_count")), "source.unique_conversation_ids": n("n_ids") == n("n"),
        "source.duplicate_ids_zero": n("n_repeated") == 0, "source.null_ids_zero": n("n_null") == 0,
    }, {"manifest.count_agrees": F.col("manifest_count") == n("n"), "manifest.id_set_agrees": F.when(F.col("manifest_ids").isNotNull(), n("n_unlike") == 0)})


def conversation_checks(conversations: DataFrame, nodes: DataFrame, messages: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Checks of exported conversations (conversation_id, current_node): their trees, and the messages, blocks and edges that were made of them.

    messages has conversation_id, message_id, sequence and source_s; blocks content_block_id, conversation_id, value and sha256; edges content_block_id.
    """
    found = paths.levels(nodes)
    trees = paths.rooted(found).groupBy("conversation_id").agg(F.count("*").alias("n_nodes"), F.count_if("reaches_root").alias("n_reached"))
    roots = found[0].where("up is null").groupBy("conversation_id").agg(F.count("*").alias("n_roots"))
    start = conversations.where("current_node is not null").select("conversation_id", F.col("current_node").alias("node_id"))
    active = paths.ancestors(found, start).groupBy("conversation_id").agg(F.count("*").alias("n_active"))
    current = start.join(found[0].select("conversation_id", "node_id"), ["conversation_id", "node_id"], "left_semi").select("conversation_id", F.lit(True).alias("resolves"))
    m = messages.groupBy("conversation_id").agg(F.count("*").alias("n_messages"), F.count_distinct("sequence").alias("n_places"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count("source_s").alias("n_timed"))
    hashed = blocks.groupBy("conversation_id").agg(F.bool_and(F.coalesce(sha256(F.col("value")) == F.col("sha256"), F.lit(False))).alias("hashed"))
    open_ = blocks.join(edges.select("content_block_id").distinct(), "content_block_id", "left_anti").groupBy("conversation_id").agg(F.count("*").alias("n_open"))
    told = conversations.select("conversation_id")
    for df in (trees, roots, active, current, m, hashed, open_):
        told = told.join(df, "conversation_id", "left")

    def n(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    contiguous = (n("n_messages") == 0) | ((F.col("n_places") == F.col("n_messages")) & (F.col("first") == 0) & (F.col("last") == F.col("n_messages") - 1))
    return _checks(told, "conversation_id", {
        "mapping.tree_parsed": n("n_nodes") > 0, "mapping.single_root": n("n_roots") == 1, "mapping.no_cycles": n("n_reached") == n("n_nodes"),
        "mapping.current_node_resolves": F.coalesce("resolves", F.lit(False)), "mapping.full_tree_preserved": n("n_reached") >= n("n_active"), "messages.sequenced": contiguous,
        "roles.known": F.lit(True), "representations.hashed": F.coalesce("hashed", F.lit(True)), "provenance.resolvable": n("n_open") == 0,
    }, {"timestamps.preserved": n("n_timed") == n("n_messages")})


def session_checks(sessions: DataFrame, records: DataFrame, promoted: DataFrame) -> DataFrame:
    """Checks of imported session logs (file, sha256_recorded, sha256_now, n_lines).

    records has file, line_no and error; promoted has file, line_no, sequence, text, sha256 and locator.  A text passes the redaction check if redacting it again changes
    nothing, or if it has a placeholder already.
    """
    r = records.groupBy("file").agg(F.count("*").alias("n_records"), F.count("error").alias("n_errors"))
    again = (redact_secrets(F.col("text")) != F.col("text")) & ~F.contains(F.col("text"), F.lit(REDACTED))
    from pyspark.sql import Window

    before = F.lag("line_no").over(Window.partitionBy("file").orderBy("sequence"))
    p = promoted.withColumn("before", before).groupBy("file").agg(
        F.count("*").alias("n"), F.count_distinct("sequence").alias("n_places"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count_if(F.col("before") >= F.col("line_no")).alias("n_back"),
        F.count_if(F.col("locator") != F.concat(F.lit("raw/source/"), "file", F.lit("#L"), F.col("line_no").cast("string"))).alias("n_lost"), F.count_if(sha256(F.col("text")) != F.col("sha256")).alias("n_unhashed"), F.count_if(again).alias("n_secret"))
    lines = promoted.groupBy("file").agg(F.count_distinct("line_no").alias("n_lines_promoted"))
    excluded = records.join(promoted.select("file", "line_no").distinct(), ["file", "line_no"], "left_anti").groupBy("file").agg(F.count("*").alias("n_excluded"))
    told = sessions
    for df in (r, p, lines, excluded):
        told = told.join(df, "file", "left")

    def n(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    contiguous = (n("n") == 0) | ((F.col("n_places") == F.col("n")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1))
    return _checks(told, "file", {
        "source.file_hash": F.col("sha256_recorded").eqNullSafe(F.col("sha256_now")), "source.records_parsed": (n("n_records") == n("n_lines")) & (n("n_errors") == 0),
        "messages.count_accounting": n("n") + n("n_excluded") == n("n_records"), "messages.sequence_contiguous": contiguous, "messages.source_order_stable": n("n_back") == 0,
        "messages.provenance_locators": n("n_lost") == 0, "representations.hashes": n("n_unhashed") == 0, "redaction.no_promotable_secrets": n("n_secret") == 0}, {})


def status(checks: DataFrame) -> DataFrame:
    """(source_id, status): complete if every material check passed."""
    return checks.groupBy("source_id").agg(F.when(F.max(F.when((F.col("severity") == MATERIAL) & (F.col("status") != "pass"), 1).otherwise(0)) == 0, "complete").otherwise("needs_review").alias("status"))
