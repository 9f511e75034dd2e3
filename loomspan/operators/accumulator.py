"""Messages from overlapping ordered views, as a virtualised list shows them while it is scrolled.

Every view lists neighbours; the messages' order is the topological order of all these
neighbourhoods in which, of the messages that may come next, the one seen first does.  Messages on
a cycle, and those that only follow from one, come last, in the order they were seen in.

That order is made without gathering a conversation:

1. Messages are numbered by when they were first seen.
2. A message that can only follow the one numbered before it, which releases nothing
   earlier, is part of that one's run.  A list that is scrolled through has few runs.
3. Where no neighbourhood leads back over a place, all runs before it come before all
   after it: such places cut a conversation into blocks.
4. Only the runs of one block are ordered together, in a task of their own.
5. What follows from a cycle is found by joins along the neighbourhoods, one step a round.

Rows without a message key part the rows beside them and are not messages.  A view may show a
message more than once.  Equal times count once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

CYCLE = "ordering_cycle"


def _placed(after: dict[int, list[int]]) -> dict[int, int]:
    """The place of every run of a block that an order reaches; after tells what follows each, in order of the runs."""
    waits = dict.fromkeys(after, 0)
    for a in after.values():
        for r in a:
            waits[r] += 1
    ready = [r for r in after if waits[r] == 0]
    heapq.heapify(ready)
    place: dict[int, int] = {}
    while ready:
        r = heapq.heappop(ready)
        place[r] = len(place)
        for x in after[r]:
            waits[x] -= 1
            if waits[x] == 0:
                heapq.heappush(ready, x)
    return place


def _kahn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(conversation_id, run, position) of blocks in a sorted stream, one block at a time; runs that no order reaches have none."""
    block, after = None, {}

    def told() -> list[tuple]:
        place = _placed(after)
        return [(block[0], r, place.get(r)) for r in after]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["conversation_id", "run", "position"])
        out["position"] = out["position"].astype("Int64")
        return out

    for batch in frames:
        rows = []
        for c, k, r, a in zip(batch["conversation_id"], batch["block"].tolist(), batch["run"].tolist(), batch["after"]):
            if block != (c, k):
                rows += told() if after else []
                block, after = (c, k), {}
            after[r] = [int(x) for x in a]
        yield frame(rows)
    yield frame(told() if after else [])


def numbered(views: DataFrame) -> DataFrame:
    """(conversation_id, key, i): messages in the order they were first seen in."""
    first = views.where("key <> ''").groupBy("conversation_id", "key").agg(F.min(F.struct("view", "place")).alias("seen"))
    return first.select("conversation_id", "key", (F.row_number().over(Window.partitionBy("conversation_id").orderBy("seen")) - 1).alias("i"))


def neighbours(views: DataFrame, messages: DataFrame) -> DataFrame:
    """(conversation_id, before, after): distinct pairs of numbers that some view shows one after the other."""
    within = Window.partitionBy("conversation_id", "view").orderBy("place")
    pairs = views.select("conversation_id", F.col("key").alias("left"), F.lead("key").over(within).alias("right")).where("left <> '' and right <> '' and left <> right").distinct()
    for side, name in (("left", "before"), ("right", "after")):
        pairs = pairs.join(messages.select("conversation_id", F.col("key").alias(side), F.col("i").alias(name)), ["conversation_id", side])
    return pairs.select("conversation_id", "before", "after")


def _runs(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """(conversation_id, i, run): a run is named by its first message's number."""
    into = edges.groupBy("conversation_id", F.col("after").alias("i")).agg(F.count("*").alias("n_before"), F.max("before").alias("last_before"))
    out = edges.groupBy("conversation_id", (F.col("before") + 1).alias("i")).agg(F.min("after").alias("released"))
    told = messages.select("conversation_id", "i").join(into, ["conversation_id", "i"], "left").join(out, ["conversation_id", "i"], "left")
    follows = (F.col("n_before") == 1) & (F.col("last_before") == F.col("i") - 1) & (F.col("released") == F.col("i"))
    head = F.when(~F.coalesce(follows, F.lit(False)), F.col("i"))
    return told.select("conversation_id", "i", F.max(head).over(Window.partitionBy("conversation_id").orderBy("i")).alias("run"))


def _blocks(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """(conversation_id, run, block): no neighbourhood leads from a block to one before it."""
    back = edges.where("before > after").groupBy("conversation_id", F.col("after").alias("run")).agg(F.max("before").alias("reach"))
    order = Window.partitionBy("conversation_id").orderBy("run")
    told = runs.join(back, ["conversation_id", "run"], "left")
    reached = F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("cut", F.when(F.coalesce(reached, F.lit(-1)) < F.col("run"), F.col("run")))
    return told.select("conversation_id", "run", F.max("cut").over(order).alias("block"))


def _beyond(edges: DataFrame, stuck: DataFrame) -> DataFrame:
    """stuck, and every run that is reached from it: a frontier a round."""
    found = front = written(stuck, "unordered")
    while True:
        step = edges.join(front.withColumnRenamed("run", "before"), ["conversation_id", "before"]).select("conversation_id", F.col("after").alias("run")).distinct()
        front = written(step.join(found, ["conversation_id", "run"], "left_anti"), "unordered")
        if front.isEmpty():
            return found
        found = written(found.unionByName(front), "unordered")


def ordered(views: DataFrame) -> DataFrame:
    """(conversation_id, key, sequence, resolved) of (conversation_id, view, place, key) rows."""
    messages = written(numbered(views), "messages")
    edges = written(neighbours(views, messages), "neighbours")
    run_of = written(_runs(messages, edges), "runs")
    for name in ("before", "after"):
        edges = edges.join(run_of.select("conversation_id", F.col("i").alias(name), F.col("run").alias(f"{name}_run")), ["conversation_id", name])
    # within a run, only what leads back to its first message is more than the run itself
    between = edges.where("before_run <> after_run or before >= after").select("conversation_id", F.col("before_run").alias("before"), F.col("after_run").alias("after")).distinct()
    between = written(between, "run-neighbours")
    blocks = written(_blocks(run_of.select("conversation_id", "run").distinct(), between), "blocks")
    block_of_after = blocks.withColumnRenamed("run", "after")
    inside = between.join(blocks.withColumnRenamed("run", "before"), ["conversation_id", "before"]).join(block_of_after, ["conversation_id", "after", "block"]) \
        .groupBy("conversation_id", F.col("before").alias("run")).agg(F.collect_list("after").alias("after"))
    mixed = between.where("before >= after").select("conversation_id", F.col("after").alias("run")).distinct().join(blocks, ["conversation_id", "run"]).select("conversation_id", "block").distinct()
    placed = blocks.join(mixed, ["conversation_id", "block"]).join(inside, ["conversation_id", "run"], "left") \
        .select("conversation_id", "block", "run", F.coalesce("after", F.array().cast("array<bigint>")).alias("after")) \
        .repartition("conversation_id", "block").sortWithinPartitions("conversation_id", "block", "run").mapInPandas(_kahn, "conversation_id string, run long, position long")
    placed = written(placed, "placed")
    stuck = _beyond(between, placed.where("position is null").select("conversation_id", "run"))
    known = run_of.join(blocks, ["conversation_id", "run"]).join(placed, ["conversation_id", "run"], "left") \
        .join(stuck.withColumn("stuck", F.lit(True)), ["conversation_id", "run"], "left").withColumn("stuck", F.coalesce("stuck", F.lit(False)))
    free = ~F.col("stuck")
    order = Window.partitionBy("conversation_id").orderBy("stuck", F.when(free, F.col("block")), F.when(free, F.coalesce("position", F.lit(0))), "i")
    return known.withColumn("sequence", F.row_number().over(order) - 1).join(messages, ["conversation_id", "i"]) \
        .select("conversation_id", "key", "sequence", free.alias("resolved"))


def drift(observations: DataFrame) -> DataFrame:
    """(conversation_id, key, drift_kinds): kinds of representation whose hashes were not the same in every observation."""
    seen = observations.where("key <> ''").select("conversation_id", "key", "view", "place", F.explode("representations").alias("r")) \
        .groupBy("conversation_id", "key", "view", "place", F.col("r.kind").alias("kind")).agg(F.array_sort(F.collect_set("r.sha256")).alias("hashes"))
    total = observations.where("key <> ''").groupBy("conversation_id", "key").agg(F.count("*").alias("n"))
    kinds = seen.groupBy("conversation_id", "key", "kind").agg(F.count("*").alias("with_kind"), F.min("hashes").alias("least"), F.max("hashes").alias("most"))
    differs = (F.col("least") != F.col("most")) | (F.col("with_kind") < F.col("n"))
    return kinds.join(total, ["conversation_id", "key"]).where(differs).groupBy("conversation_id", "key").agg(F.array_sort(F.collect_list("kind")).alias("drift_kinds"))


def accumulated(observations: DataFrame) -> DataFrame:
    """(conversation_id, key, sequence, resolved, observation_count, first_observed, last_observed, drift_kinds).

    observations has conversation_id string, view long, place long, key string, observed_s long and representations, an array of (kind, sha256).
    The last time is the one that appeared last, not the largest.
    """
    times = observations.where("key <> ''").groupBy("conversation_id", "key", "observed_s").agg(F.min(F.struct("view", "place")).alias("at")) \
        .groupBy("conversation_id", "key").agg(F.count("*").alias("observation_count"), F.min_by("observed_s", "at").alias("first_observed"), F.max_by("observed_s", "at").alias("last_observed"))
    return ordered(observations.select("conversation_id", "view", "place", "key")).join(times, ["conversation_id", "key"]).join(drift(observations), ["conversation_id", "key"], "left") \
        .withColumn("drift_kinds", F.coalesce("drift_kinds", F.array().cast("array<string>")))


def warnings(messages: DataFrame) -> DataFrame:
    """(conversation_id, code, key) of accumulated messages: one row for a conversation with a cycle, one for each message that drifted."""
    cycles = messages.where("not resolved").select("conversation_id", F.lit(CYCLE).alias("code"), F.lit(None).cast("string").alias("key")).distinct()
    return cycles.unionByName(messages.where("size(drift_kinds) > 0").select("conversation_id", F.lit("representation_drift").alias("code"), "key"))
