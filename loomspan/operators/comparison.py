"""Two captures of a conversation compared message by message: fourteen kinds of change, how a message was found again, and in which dimensions it changed.

Messages are matched by keys that are unique on both sides, one kind of key after the other, and by
joins only; what is left is an alternative answer, an addition, a removal, or uncertain.  A removal is
certain only where both captures are verified, all branches were captured, and nothing of the conversation is
uncertain.

Messages have conversation_id, message_id, platform_message_id, sequence, role, parent_message_id, branch_id, representations (map of kind to
hash), blocks (map of id to hash), and attachments, citations, artifacts and tool_events (one hash for each).  Captures have conversation_id, platform,
account, status and branches (array of status, branch_sha256 and message_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

# The kinds of change and the dimensions, and the kind that each dimension gives, the first that holds.
CLASSES = ("unchanged", "appended", "removed_from_active_path", "regenerated", "branched", "textual_edit", "rendered_structure_changed", "content_blocks_changed", "attachments_changed", "citations_changed",
           "artifacts_changed", "tool_events_changed", "metadata_changed", "uncertain")
PRIMARY = (("text", "textual_edit"), ("rendered_structure", "rendered_structure_changed"), ("content_blocks", "content_blocks_changed"), ("attachments", "attachments_changed"), ("citations", "citations_changed"),
           ("artifacts", "artifacts_changed"), ("tool_events", "tool_events_changed"), ("branch", "branched"))
NOT_ELIGIBLE, BRANCHES_OPEN = "comparison_inputs_not_both_verified_complete_same_conversation", "branch_coverage_incomplete"
RENDERED = "sanitized_html"
_ASSETS = ("attachments", "citations", "artifacts", "tool_events")


def signature(df: DataFrame) -> DataFrame:
    """With the hash of what identifies a message that has no id in common: role, parent, branch, and all its hashes."""
    def entries(c: str) -> Column:
        return F.to_json(F.array_sort(F.map_entries(c)))

    whole = F.struct("role", "parent_message_id", "branch_id", entries("representations").alias("r"), F.to_json(F.array_sort(F.map_values("blocks"))).alias("b"))
    return df.withColumn("signature", F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}).cast("binary"), 256))


def inputs(prior: DataFrame, current: DataFrame) -> DataFrame:
    """(conversation_id, eligible, warnings) of conversations that both sides have."""
    c = current.select("conversation_id", *(F.col(x).alias(f"new_{x}") for x in ("platform", "account", "status", "branches")))
    same = (F.col("platform") == F.col("new_platform")) & (F.col("account") == F.col("new_account")) & (F.col("status") == "complete") & (F.col("new_status") == "complete")
    captured = F.forall(F.concat("branches", "new_branches"), lambda b: b["status"] == "captured")
    told = prior.join(c, "conversation_id").withColumn("eligible", F.coalesce(same, F.lit(False)))
    return told.select("conversation_id", "eligible", F.array_compact(F.array(F.when(~F.col("eligible"), NOT_ELIGIBLE), F.when(~captured, BRANCHES_OPEN))).alias("warnings"))


def _unique(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy("conversation_id", key).agg(F.count("*").alias("n"), F.min("message_id").alias(name)).where("n = 1").drop("n")


def _left(df: DataFrame, matched: DataFrame, name: str) -> DataFrame:
    return df.join(matched.select("conversation_id", F.col(name).alias("message_id")), ["conversation_id", "message_id"], "left_anti")


def matches(prior: DataFrame, current: DataFrame) -> DataFrame:
    """(conversation_id, prior_message_id, current_message_id, match_method), each message at most once."""
    out = None
    for key, method in (("platform_message_id", "platform_message_id"), ("message_id", "canonical_message_id"), ("signature", "exact_hash_context")):
        a, b = (prior, current) if out is None else (_left(prior, out, "prior_message_id"), _left(current, out, "current_message_id"))
        keyed = [df.withColumn("k", F.col(key)) for df in (a, b)]
        found = _unique(keyed[0], "k", "prior_message_id").join(_unique(keyed[1], "k", "current_message_id"), ["conversation_id", "k"]).drop("k").withColumn("match_method", F.lit(method))
        out = written(found if out is None else out.unionByName(found), "matches")
    return out


def _changed(found: DataFrame, prior: DataFrame, current: DataFrame) -> DataFrame:
    """The records of matched messages."""
    def side(df: DataFrame, p: str, name: str) -> DataFrame:
        return df.select("conversation_id", F.col("message_id").alias(name), *(F.col(c).alias(p + c) for c in ("role", "sequence", "parent_message_id", "branch_id", "representations", "blocks", *_ASSETS)))

    both = found.join(side(prior, "a_", "prior_message_id"), ["conversation_id", "prior_message_id"]).join(side(current, "b_", "current_message_id"), ["conversation_id", "current_message_id"])

    def differs(c: str) -> Column:
        return ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))

    kinds = F.array_sort(F.array_union(F.map_keys("a_representations"), F.map_keys("b_representations")))
    other = F.filter(kinds, lambda k: ~F.try_element_at("a_representations", k).eqNullSafe(F.try_element_at("b_representations", k)))
    blocks = ~F.array_sort(F.map_entries("a_blocks")).eqNullSafe(F.array_sort(F.map_entries("b_blocks")))
    plain = (("role", "role_changed", "metadata"), ("sequence", "sequence_changed", "metadata"), ("parent_message_id", "parent_relationship_changed", "branch"), ("branch_id", "branch_relationship_changed", "branch"))
    first = F.array_compact(F.array(*(F.when(differs(c), F.struct(F.lit(r).alias("reason"), F.lit(d).alias("dimension"))) for c, r, d in plain)))
    middle = F.transform("other", lambda k: F.struct(F.concat(k, F.lit("_changed")).alias("reason"), F.when(k == RENDERED, "rendered_structure").otherwise("text").alias("dimension")))
    last = [F.when(blocks, F.struct(F.lit("content_blocks_changed").alias("reason"), F.lit("content_blocks").alias("dimension")))]
    last += [F.when(differs(c), F.struct(F.lit(f"{c}_changed").alias("reason"), F.lit(c).alias("dimension"))) for c in _ASSETS]
    told = both.withColumn("other", other).withColumn("all", F.concat(first, middle, F.array_compact(F.array(*last))))
    told = told.withColumn("reasons", F.transform("all", lambda x: x["reason"])).withColumn("dimensions", F.array_distinct(F.transform("all", lambda x: x["dimension"])))
    kind = F.when(F.size("reasons") == 0, "unchanged")
    for dimension, classification in PRIMARY:
        kind = kind.when(F.array_contains("dimensions", dimension), classification)
    reasons = F.when(F.size("reasons") == 0, F.array(F.lit("all_preserved_hashes_and_relationships_match"))).otherwise(F.col("reasons"))
    return told.select("conversation_id", kind.otherwise("metadata_changed").alias("classification"), "prior_message_id", "current_message_id", "match_method", F.lit("exact").alias("confidence"), reasons.alias("reasons"), "dimensions")


def _regenerated(prior: DataFrame, current: DataFrame) -> DataFrame:
    """(conversation_id, prior_message_id, current_message_id): the first new answer on a branch meets the only unmatched old one of its parent."""
    answer = (F.col("role") == "assistant") & (F.coalesce(F.col("branch_id"), F.lit("")) != "")
    parent = F.coalesce("parent_message_id", F.lit("")).alias("parent")
    old = prior.where(answer).groupBy("conversation_id", parent).agg(F.count("*").alias("n"), F.min("message_id").alias("prior_message_id")).where("n = 1").drop("n")
    new = current.where(answer).groupBy("conversation_id", parent).agg(F.min_by("message_id", F.struct("sequence", "message_id")).alias("current_message_id"))
    return old.join(new, ["conversation_id", "parent"]).drop("parent")


def _record(df: DataFrame, kind: Column, confidence: Column, reason: Column, dimensions: list[str], method: str = "none") -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select("conversation_id", kind.alias("classification"), *(F.col(c) if c in df.columns else none.alias(c) for c in ("prior_message_id", "current_message_id")), F.lit(method).alias("match_method"),
                     confidence.alias("confidence"), F.array(reason).alias("reasons"), F.array(*map(F.lit, dimensions)).cast("array<string>").alias("dimensions"))


def compare(prior: DataFrame, current: DataFrame, prior_captures: DataFrame, current_captures: DataFrame) -> DataFrame:
    """The records of all conversations that both sides have."""
    told = written(inputs(prior_captures, current_captures), "inputs")
    known = told.select("conversation_id")
    prior, current = (written(signature(df).join(known, "conversation_id"), "messages") for df in (prior, current))
    found = matches(prior, current)
    records = _changed(found, prior, current)
    old, new = _left(prior, found, "prior_message_id"), _left(current, found, "current_message_id")
    again = written(_regenerated(old, new), "matches")
    records = records.unionByName(_record(again, F.lit("regenerated"), F.lit("conservative"), F.lit("assistant_alternative_same_parent_with_branch_evidence"), ["text", "branch"], "branch_parent"))
    old, new = (written(df, "unmatched") for df in (_left(old, again, "prior_message_id"), _left(new, again, "current_message_id")))

    tail = prior.groupBy("conversation_id").agg(F.max("sequence").alias("tail"))
    ids = prior.select("conversation_id", "message_id").unionByName(current.select("conversation_id", "message_id")).distinct().select("conversation_id", F.col("message_id").alias("parent_message_id"), F.lit(True).alias("known_parent"))
    alike = old.groupBy("conversation_id", "signature").agg(F.count("*").alias("alike"))
    n = new.join(told, "conversation_id").join(tail, "conversation_id", "left").join(ids, ["conversation_id", "parent_message_id"], "left").join(alike, ["conversation_id", "signature"], "left")
    at_end = F.col("eligible") & (F.col("sequence") > F.coalesce("tail", F.lit(-1))) & ((F.coalesce("parent_message_id", F.lit("")) == "") | F.coalesce("known_parent", F.lit(False)))
    branch = F.coalesce(F.col("branch_id"), F.lit("")) != ""
    case = F.when(F.col("alike") > 1, "ambiguous_fallback_candidates").when(branch, "new_message_on_captured_branch").when(at_end, "new_message_after_prior_active_path_tail").otherwise("unmatched_current_message")
    n = written(n.withColumn("current_message_id", F.col("message_id")).withColumn("case", case).select("conversation_id", "current_message_id", "case"), "added")
    added = n.where("case = 'new_message_on_captured_branch'")
    records = records.unionByName(_record(added, F.lit("branched"), F.lit("conservative"), F.col("case"), ["branch"])) \
        .unionByName(_record(n.where("case = 'new_message_after_prior_active_path_tail'"), F.lit("appended"), F.lit("conservative"), F.col("case"), [])) \
        .unionByName(_record(n.where("case in ('ambiguous_fallback_candidates', 'unmatched_current_message')"), F.lit("uncertain"), F.lit("uncertain"), F.col("case"), []))
    records = written(records, "records")

    doubtful = records.where("classification = 'uncertain'").select("conversation_id").distinct().withColumn("doubtful", F.lit(True))
    gone = old.withColumn("prior_message_id", F.col("message_id")).join(told, "conversation_id").join(doubtful, "conversation_id", "left")
    certain = F.col("eligible") & (F.size("warnings") == 0) & F.col("doubtful").isNull()
    records = records.unionByName(_record(gone, F.when(certain, "removed_from_active_path").otherwise("uncertain"), F.when(certain, "conservative").otherwise("uncertain"),
                                          F.when(certain, "absent_from_new_verified_active_path").otherwise("absence_not_confirmed_due_to_incomplete_evidence"), []))
    a, b = (df.join(known, "conversation_id").select("conversation_id", F.explode("branches").alias("b")) for df in (prior_captures, current_captures))
    grown = b.join(a.select("conversation_id", F.col("b.branch_sha256").alias("h")), (b["conversation_id"] == a["conversation_id"]) & (F.col("b.branch_sha256") == F.col("h")), "left_anti") \
        .select("conversation_id", F.col("b.message_id").alias("current_message_id"))
    return records.unionByName(_record(grown, F.lit("branched"), F.lit("conservative"), F.lit("branch_graph_changed"), ["branch"]))


def summary(records: DataFrame, told: DataFrame) -> DataFrame:
    """(conversation_id, status, warnings, and a number for every kind of change and every dimension)."""
    dimensions = ("text", "rendered_structure", "content_blocks", "attachments", "citations", "artifacts", "tool_events", "branch", "metadata")
    counts = records.groupBy("conversation_id").agg(*(F.count_if(F.col("classification") == c).alias(f"n_{c}") for c in CLASSES),
                                                    *(F.count_if(F.array_contains("dimensions", d)).alias(f"in_{d}") for d in dimensions))
    names = [f"n_{c}" for c in CLASSES] + [f"in_{d}" for d in dimensions]
    all_ = told.join(counts, "conversation_id", "left").select("conversation_id", "warnings", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))
    return all_.withColumn("status", F.when((F.size("warnings") > 0) | (F.col("n_uncertain") > 0), "needs_review").otherwise("complete"))
