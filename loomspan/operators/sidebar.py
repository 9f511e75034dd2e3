"""A list that is read while it is scrolled: its rows once each, and whether both its ends were seen.

Rows are told apart by identity; of repeated ones the first gives title and address, the least place
is kept, and any other title or address is a collision.  A pass (number, scroll_top, scroll_height,
client_height) is one look at the list; pass 0 is where it stood, pass 1 its top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
STABLE_PASSES, SLACK = 4, 2
CONFLICT = "conflicting_observations_for_stable_identity"


def rows(seen: DataFrame) -> DataFrame:
    """(inventory_id, identity, title, source_url, place, n_seen, collisions, position) of (inventory_id, pass, place_in_pass, identity, title, source_url, order_hint)."""
    named = seen.where("identity <> ''")
    first = F.min_by(F.struct("title", "source_url"), F.struct("pass", "place_in_pass"))
    told = named.groupBy("inventory_id", "identity").agg(first.alias("first"), F.min("order_hint").alias("place"), F.count("*").alias("n_seen"))
    # a row collides with the first one, not with the one before it
    other = named.join(told, ["inventory_id", "identity"]).where(~F.col("title").eqNullSafe(F.col("first.title")) | ~F.col("source_url").eqNullSafe(F.col("first.source_url")))
    collisions = other.groupBy("inventory_id", "identity").agg(F.count("*").alias("collisions"))
    position = F.row_number().over(Window.partitionBy("inventory_id").orderBy("place", "identity")) - 1
    return told.join(collisions, ["inventory_id", "identity"], "left").select(
        "inventory_id", "identity", "first.title", "first.source_url", "place", "n_seen", F.coalesce("collisions", F.lit(0)).cast("long").alias("collisions"), position.alias("position"))


def boundaries(passes: DataFrame, seen: DataFrame, stable: int = STABLE_PASSES) -> DataFrame:
    """(inventory_id, latest_reached, stabilized, restored): the top was seen, the bottom stood still with no new row for `stable` passes in a row, the list was put back."""
    order = Window.partitionBy("inventory_id").orderBy("pass")
    new = seen.where("identity <> ''").groupBy("inventory_id", "identity").agg(F.min("pass").alias("pass")).groupBy("inventory_id", "pass").agg(F.count("*").alias("new_rows"))
    last = F.max("pass").over(Window.partitionBy("inventory_id"))
    p = passes.withColumn("last", last).join(new, ["inventory_id", "pass"], "left").withColumn("new_rows", F.coalesce("new_rows", F.lit(0))).withColumn("before", F.lag("scroll_top").over(order))
    scan = p.where("pass > 1 and pass < last")
    # the scan's first pass has nothing to stand still against; the top that was looked at before it is not part of the scan
    before = F.when(F.col("pass") > 2, F.col("before"))
    still = (F.col("scroll_top") + F.col("client_height") >= F.col("scroll_height") - SLACK) & (F.abs(F.col("scroll_top") - F.coalesce(before, F.lit(-1))) <= SLACK) & (F.col("new_rows") == 0)
    # a run of passes that stand still is numbered by the last one that did not
    moved = F.max(F.when(~still, F.col("pass"))).over(order)
    runs = scan.withColumn("still", still).withColumn("run", F.col("pass") - F.coalesce(moved, F.lit(1)))
    stable_of = runs.groupBy("inventory_id").agg((F.max(F.when(F.col("still"), F.col("run")).otherwise(0)) >= stable).alias("stabilized"))
    ends = p.groupBy("inventory_id").agg(F.coalesce(F.max(F.when(F.col("pass") == 1, F.col("scroll_top"))) <= SLACK, F.lit(False)).alias("latest_reached"),
                                         (F.abs(F.min_by("scroll_top", "pass") - F.max_by("scroll_top", "pass")) <= SLACK).alias("restored"))
    return ends.join(stable_of, "inventory_id", "left").withColumn("stabilized", F.coalesce("stabilized", F.lit(False)))


def inventory(passes: DataFrame, seen: DataFrame, stable: int = STABLE_PASSES) -> DataFrame:
    """(inventory_id, status, n_rows, collisions, warnings)."""
    found = rows(seen).groupBy("inventory_id").agg(F.count("*").alias("n_rows"), F.sum("collisions").alias("collisions"))
    told = boundaries(passes, seen, stable).join(found, "inventory_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).withColumn("collisions", F.coalesce("collisions", F.lit(0)))
    warned = F.array_compact(F.array(
        F.when(~F.col("latest_reached"), "latest_sidebar_boundary_not_reached"), F.when(~F.col("stabilized"), "earliest_sidebar_boundary_not_verified"),
        F.when(~F.col("stabilized"), "sidebar_scrolling_did_not_stabilize"), F.when(~F.col("stabilized"), "sidebar_observation_count_did_not_stabilize"),
        F.when(F.col("collisions") > 0, F.concat(F.lit("conversation_identity_collisions:"), F.col("collisions").cast("string"))),
        F.when(~F.col("restored"), "initial_sidebar_position_not_restored"), F.when(F.col("n_rows") == 0, "no_conversation_rows_observed")))
    return told.withColumn("warnings", warned).select("inventory_id", F.when(F.size("warnings") == 0, "complete").otherwise("needs_review").alias("status"), "n_rows", "collisions", "warnings")
