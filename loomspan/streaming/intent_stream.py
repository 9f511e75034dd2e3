"""Recapture intents as a stream: state for every workflow, and a timer for every intent's time to live.

Commands may come late, within the watermark's delay, and more than once.  They take effect in the order of
their numbers: what comes early waits in the state.  A timer fires when the watermark has passed an
intent's time, that is when no command from before it can still come.  State comes and goes with a batch's
rows: a call for each intent's own state took more time than the commands.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intents import COMMANDS, OUTCOMES, UNUSED, Command, Intent, expiry, outcome, overdue, step

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_STATE = "next_n long, last_capture_s long, held string"
_NAMES = [x.split(" ")[0] for x in COMMANDS.split(", ")]
_OUT = [x.split(" ")[0] for x in OUTCOMES.split(", ")]


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One workflow: its intents, the commands that wait, the next number and the last capture; its timer is that of the unused intent that expires first."""
    next_n, last, held = state.get if state.exists else (0, None, "[{}, {}]")
    intents, waiting = json.loads(held)
    intents = {k: Intent(*x) for k, x in intents.items()}
    waiting = {int(n): x for n, x in waiting.items()}
    told = []
    for batch in batches:
        columns = [batch[c].tolist() for c in _NAMES[1:]]
        for n, at_s, *rest in zip(*columns):
            if n >= next_n:  # of commands of one number, the first that came counts
                waiting.setdefault(n, (at_s, *(None if pd.isna(x) else x for x in rest)))
        while next_n in waiting:
            c = Command(next_n, *waiting.pop(next_n))
            intent = intents.get(c.intent_id)
            if intent and overdue(intent, c.at_s):  # its timer waits for the watermark; the command's own time has passed it
                told.append(expiry(key[0], c.intent_id, intent))
                intent = intent._replace(state="expired")
            after, error = step(intent, c, last)
            if after:
                intents[c.intent_id] = after
            if c.command == "begin" and error is None:
                last = c.at_s
            told.append(outcome(key[0], c, after, error))
            next_n += 1
    now_ms, timer = state.getCurrentWatermarkMs(), None
    for k, x in intents.items():
        if x.state in UNUSED and x.expires_s * 1000 < now_ms:
            told.append(expiry(key[0], k, x))
            intents[k] = x._replace(state="expired")
        elif x.state in UNUSED:
            timer = min(x.expires_s, timer or x.expires_s)
    state.update((next_n, last, json.dumps([intents, waiting])))
    if timer is not None:
        state.setTimeoutTimestamp(timer * 1000)
    out = pd.DataFrame(told, columns=_OUT)
    out["n"] = out["n"].astype("Int64")
    yield out


def outcome_stream(commands: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Outcomes of a stream of commands."""
    timed = commands.withColumn("at", F.timestamp_seconds("at_s")).withWatermark("at", late)
    return timed.groupBy("workflow_id").applyInPandasWithState(_advance, OUTCOMES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that keeps large states outside of the heap."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)
