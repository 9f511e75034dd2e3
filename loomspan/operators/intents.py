"""Recapture intents: one manually selected conversation each, confirmed once, captured once.

Commands of a workflow are numbered from 0 and take effect in that order.  An intent that is not
yet used expires TTL_S seconds after it was made; a confirmation is refused within COOLDOWN_S seconds of
the workflow's last capture, whichever intent that was for.  A refused command changes nothing.

`fold` reads each workflow as one sorted stream and keeps only its open intents; a final sweep
at `now_s` expires what is left over.  `streaming.intent_stream` is the same fold with state and timers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seconds, states, and the states that a command may find.
TTL_S, COOLDOWN_S = 900, 30
UNUSED = ("awaiting_manual_open", "identity_verified", "awaiting_capture_confirmation", "authorized")
TERMINAL = ("complete", "needs_review", "failed", "cancelled", "expired")
CHECKPOINTS = {
    "archive_written": ("capturing",),
    "archive_verified": ("archive_written",),
    "comparing": ("archive_verified",),
    "catalog_committed": ("comparing",),
    "complete": ("catalog_committed",),
    "needs_review": ("archive_verified", "comparing", "catalog_committed"),
    "failed": ("capturing", "archive_written", "archive_verified", "comparing"),
    "cancelled": UNUSED,
}
FOUND = {"verify": UNUSED[:3], "confirm": UNUSED[2:3], "begin": UNUSED[3:], "cancel": UNUSED}
LEADS = {"verify": "awaiting_capture_confirmation", "confirm": "authorized", "begin": "capturing", "cancel": "cancelled"}

COMMANDS = "workflow_id string, n long, at_s long, intent_id string, command string, identity string, exact boolean, next string, reason string"
OUTCOMES = "workflow_id string, n long, at_s long, intent_id string, command string, state string, error string"


class Intent(NamedTuple):
    state: str
    identity: str
    expires_s: int


class Command(NamedTuple):
    n: int
    at_s: int
    intent_id: str
    command: str
    identity: str | None
    exact: bool | None
    next: str | None
    reason: str | None


def overdue(intent: Intent, now_s: int) -> bool:
    return intent.state in UNUSED and intent.expires_s < now_s


def step(intent: Intent | None, c: Command, last_capture_s: int | None) -> tuple[Intent | None, str | None]:
    """(the intent after the command, why it was refused); the intent is as of the command's time, so not overdue."""
    if c.command == "create":
        return (intent, "intent_exists") if intent else (Intent("awaiting_manual_open", c.identity or "", c.at_s + TTL_S), None)
    if c.command == "confirm" and not c.exact:
        return intent, "confirmation_required"
    if c.command == "cancel" and not (c.reason or "").strip():
        return intent, "reason_required"
    if intent is None:
        return None, "unknown_intent"
    found = CHECKPOINTS.get(c.next or "", ()) if c.command == "checkpoint" else FOUND.get(c.command, ())
    if intent.state not in found:
        return intent, "prohibited_from_" + intent.state
    if c.command in ("verify", "begin") and c.identity != intent.identity:
        return intent, "identity_mismatch"
    if c.command == "confirm" and last_capture_s is not None and c.at_s - last_capture_s < COOLDOWN_S:
        return intent, "cooldown_active"
    return intent._replace(state=c.next if c.command == "checkpoint" else LEADS[c.command]), None


def outcome(workflow: str, c: Command, intent: Intent | None, error: str | None) -> tuple:
    return workflow, c.n, c.at_s, c.intent_id, c.command, intent.state if intent else None, error


def expiry(workflow: str, intent_id: str, intent: Intent) -> tuple:
    """The outcome of an intent that expires: one second after its time, by no command of the workflow."""
    return workflow, None, intent.expires_s + 1, intent_id, "expire", "expired", None


def _folded(now_s: int):
    names = [x.split(" ")[0] for x in OUTCOMES.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        out["n"] = out["n"].astype("Int64")
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        workflow, intents, last = None, {}, None

        def left() -> list[tuple]:
            return [expiry(workflow, k, x) for k, x in intents.items() if overdue(x, now_s)]

        for batch in frames:
            rows = []
            for own, *fields in batch.itertuples(index=False):
                if own != workflow:
                    rows += left()
                    workflow, intents, last = own, {}, None
                c = Command(*fields)
                intent = intents.get(c.intent_id)
                if intent and overdue(intent, c.at_s):
                    rows.append(expiry(workflow, c.intent_id, intent))
                    intent = intent._replace(state="expired")
                after, error = step(intent, c, last)
                if after:
                    intents[c.intent_id] = after
                if c.command == "begin" and error is None:
                    last = c.at_s
                rows.append(outcome(workflow, c, after, error))
            yield frame(rows)
        yield frame(left())

    return run


def fold(commands: DataFrame, now_s: int) -> DataFrame:
    """An outcome for every command and every expiry up to now_s; repeated numbers of a workflow count once."""
    names = [x.split(" ")[0] for x in COMMANDS.split(", ")]
    once = commands.select(*names).dropDuplicates(["workflow_id", "n"])
    return once.repartition("workflow_id").sortWithinPartitions("workflow_id", "n").mapInPandas(_folded(now_s), OUTCOMES)


def states(outcomes: DataFrame) -> DataFrame:
    """(workflow_id, intent_id, state, refused): every intent's last state, and how many of its commands were refused."""
    # an expiry has no number: it is after all that was accepted, and before what was refused for it
    accepted = F.when(F.col("error").isNull(), F.coalesce(F.col("n"), F.lit(1 << 62)))
    return outcomes.groupBy("workflow_id", "intent_id").agg(F.max_by("state", accepted).alias("state"), F.count("error").alias("refused")).where("state is not null")
