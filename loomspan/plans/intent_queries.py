"""Recapture intents over the commands of every user's events: folded in batch, and as a stream with timers."""

from itertools import pairwise

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import EPOCH, Bundle
from ..operators import intents
from ..registry import register
from ..shared import new_path
from ..streaming import intent_stream

LATE_S = 600
#: How often the stream of `i23_streamed_intents` runs: its cost beside the commands' own does not grow with the time that they cover.
RUNS = 3
_PATH = ("create", "verify", "confirm", "begin", "archive_written", "archive_verified", "comparing", "catalog_committed", "complete")
#: Remainders of an event's id by 23, and the command that it becomes instead.
_INSTEAD = {2: "cancel", 3: "cancel", 4: "needs_review", 5: "failed", 6: "verify", 9: "create", 10: "cancelled"}
_NAMED = ("create", "verify", "confirm", "begin", "cancel")
_ALLOWED = {**{k: v for k, v in intents.FOUND.items()}, **intents.CHECKPOINTS}


def _sql_list(values) -> str:
    return "(" + ", ".join(f"'{x}'" for x in values) + ")"


_UNUSED = _sql_list(intents.UNUSED)
COMMANDS = f"""cmd0 AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 n FROM events),
cmd1 AS (SELECT 'workflow_' || user_id workflow_id, n, event_id % 23 fault, {EPOCH} + CAST(sum(CASE WHEN event_id % 31 = 0 THEN 1000 ELSE event_id % 7 END) OVER (PARTITION BY user_id ORDER BY n) AS BIGINT) at_s,
  n // 18 * 2 + n % 2 k, list_extract([{", ".join(f"'{x}'" for x in _PATH)}], n % 18 // 2 + 1) usual FROM cmd0),
cmd AS (SELECT workflow_id, n, at_s, CASE WHEN fault = 7 THEN 'intent_unknown' ELSE 'intent_' || k END intent_id,
  CASE fault {" ".join(f"WHEN {i} THEN '{x}'" for i, x in _INSTEAD.items())} ELSE usual END told, CASE WHEN fault = 0 THEN 'other' ELSE 'conversation_' || k END identity, fault <> 1 exact, CASE WHEN fault = 3 THEN ' ' ELSE 'user' END reason FROM cmd1),
walked AS (SELECT * FROM (WITH RECURSIVE r AS (
  SELECT DISTINCT workflow_id, CAST(-1 AS BIGINT) n, intent_id, CAST(NULL AS VARCHAR) state, CAST(NULL AS VARCHAR) identity, CAST(NULL AS BIGINT) expires_s, CAST(NULL AS BIGINT) last_s, CAST(NULL AS VARCHAR) error, false hit, false gone FROM cmd
  UNION ALL
  SELECT workflow_id, n, intent_id,
    CASE WHEN NOT hit OR error IS NOT NULL THEN cur WHEN told = 'create' THEN 'awaiting_manual_open' WHEN told = 'verify' THEN 'awaiting_capture_confirmation' WHEN told = 'confirm' THEN 'authorized' WHEN told = 'begin' THEN 'capturing' WHEN told = 'cancel' THEN 'cancelled' ELSE told END,
    CASE WHEN hit AND error IS NULL AND told = 'create' THEN asked ELSE identity END, CASE WHEN hit AND error IS NULL AND told = 'create' THEN at_s + {intents.TTL_S} ELSE expires_s END,
    coalesce(max(CASE WHEN hit AND error IS NULL AND told = 'begin' THEN at_s END) OVER (PARTITION BY workflow_id), last_s), error, hit, gone
  FROM (SELECT *, CASE WHEN NOT hit THEN NULL WHEN told = 'create' THEN CASE WHEN cur IS NOT NULL THEN 'intent_exists' END
      WHEN told = 'confirm' AND NOT exact THEN 'confirmation_required' WHEN told = 'cancel' AND trim(reason) = '' THEN 'reason_required' WHEN cur IS NULL THEN 'unknown_intent'
      WHEN NOT CASE told {" ".join(f"WHEN '{k}' THEN cur IN {_sql_list(v)}" for k, v in _ALLOWED.items())} ELSE false END THEN 'prohibited_from_' || cur
      WHEN told IN ('verify', 'begin') AND asked <> identity THEN 'identity_mismatch' WHEN told = 'confirm' AND at_s - last_s < {intents.COOLDOWN_S} THEN 'cooldown_active' END error
    FROM (SELECT r.workflow_id, e.n, r.intent_id, r.identity, r.expires_s, r.last_s, e.at_s, e.told, e.identity asked, e.exact, e.reason, e.intent_id = r.intent_id hit,
        e.intent_id = r.intent_id AND r.state IN {_UNUSED} AND r.expires_s < e.at_s gone,
        CASE WHEN e.intent_id = r.intent_id AND r.state IN {_UNUSED} AND r.expires_s < e.at_s THEN 'expired' ELSE r.state END cur
      FROM r JOIN cmd e ON e.workflow_id = r.workflow_id AND e.n = r.n + 1)))
  SELECT * FROM r)),
swept AS (SELECT workflow_id, intent_id, expires_s FROM walked WHERE hit AND gone UNION ALL
  SELECT workflow_id, intent_id, expires_s FROM walked w WHERE state IN {_UNUSED} AND n = (SELECT max(n) FROM cmd c WHERE c.workflow_id = w.workflow_id) AND expires_s < (SELECT max(at_s) - {LATE_S} FROM cmd)),
outcomes AS (SELECT w.workflow_id, w.n, c.at_s, w.intent_id, CASE WHEN c.told IN {_sql_list(_NAMED)} THEN c.told ELSE 'checkpoint' END command, w.state, w.error
    FROM walked w JOIN cmd c ON c.workflow_id = w.workflow_id AND c.n = w.n WHERE w.hit
  UNION ALL SELECT workflow_id, NULL, expires_s + 1, intent_id, 'expire', 'expired', NULL FROM swept)"""


def commands(b: Bundle) -> DataFrame:
    """A user's events as commands for two intents at a time; some are refused by each rule, and some come long after the one before."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = b.raw("events").select("user_id", "ts", "event_id").withColumn("n", (F.row_number().over(order) - 1).cast("long")).withColumn("fault", F.col("event_id") % 23)
    gap = F.when(F.col("event_id") % 31 == 0, 1000).otherwise(F.col("event_id") % 7)
    k = (F.floor(F.col("n") / 18) * 2 + F.col("n") % 2).cast("string")
    told = F.element_at(F.array(*map(F.lit, _PATH)), (F.floor(F.col("n") % 18 / 2) + 1).cast("int"))
    for i, x in _INSTEAD.items():
        told = F.when(F.col("fault") == i, x).otherwise(told)
    named = F.col("told").isin(*_NAMED)
    return e.withColumn("at_s", (F.lit(EPOCH) + F.sum(gap).over(order)).cast("long")).withColumn("told", told).select(
        F.concat(F.lit("workflow_"), F.col("user_id").cast("string")).alias("workflow_id"), "n", "at_s",
        F.when(F.col("fault") == 7, "intent_unknown").otherwise(F.concat(F.lit("intent_"), k)).alias("intent_id"),
        F.when(named, F.col("told")).otherwise("checkpoint").alias("command"),
        F.when(F.col("fault") == 0, "other").otherwise(F.concat(F.lit("conversation_"), k)).alias("identity"),
        (F.col("fault") != 1).alias("exact"), F.when(~named, F.col("told")).alias("next"), F.when(F.col("fault") == 3, " ").otherwise("user").alias("reason"))


def _outcomes(b: Bundle) -> DataFrame:
    told = commands(b)
    return intents.fold(told, told.agg(F.max("at_s")).first()[0] - LATE_S)


@register("i23_intent_outcomes", "SELECT workflow_id, n, at_s, intent_id, command, state, error FROM outcomes", COMMANDS)
def intent_outcomes(b: Bundle):
    return _outcomes(b)


@register("i23_intent_states", """SELECT o.workflow_id, o.intent_id, arg_max(state, coalesce(n, 1::BIGINT << 62)) FILTER (WHERE error IS NULL) state, count(error) refused FROM outcomes o
GROUP BY 1, 2 HAVING count(*) FILTER (WHERE error IS NULL) > 0""", COMMANDS)
def intent_states(b: Bundle):
    return intents.states(_outcomes(b))


@register("j5_expired_intents", """SELECT o.workflow_id, o.intent_id, o.at_s expired_s, (SELECT count(*) FROM outcomes c WHERE c.workflow_id = o.workflow_id AND c.error = 'cooldown_active') cooling FROM outcomes o WHERE command = 'expire'""", COMMANDS)
def expired_intents(b: Bundle):
    """Unused intents that outlived their time, and how often their workflow was refused for its cooldown."""
    told = _outcomes(b)
    cooling = told.where("error = 'cooldown_active'").groupBy("workflow_id").agg(F.count("*").alias("cooling"))
    return told.where("command = 'expire'").join(cooling, "workflow_id", "left") \
        .select("workflow_id", "intent_id", F.col("at_s").alias("expired_s"), F.coalesce("cooling", F.lit(0)).cast("long").alias("cooling"))


@register("i23_streamed_intents", "SELECT workflow_id, n, at_s, intent_id, command, state, error FROM outcomes", COMMANDS)
def streamed_intents(b: Bundle):
    """The same commands as files of ten minutes each, a tenth of them one file late and a tenth told twice, folded with state and timers.

    The stream runs RUNS times, each time over the files of an equal share of the whole time that have come since, and takes up its state where it stopped.
    """
    spark, root = b.spark, new_path(b.spark, "intent-stream")
    told = commands(b).withColumn("slot", F.floor((F.col("at_s") - EPOCH) / LATE_S) + (F.col("n") % 10 == 3).cast("long"))
    told = told.withColumn("copy", F.explode(F.when(F.col("n") % 10 == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")
    share = F.pmod(F.hash("workflow_id"), F.lit(spark.sparkContext.defaultParallelism))
    told.repartition("slot", share).write.partitionBy("slot").parquet(f"{root}/commands")
    told = spark.read.schema(told.schema).parquet(f"{root}/commands")
    slots = (told.agg(F.max("slot")).first()[0] or 0) + 1
    with intent_stream.rocksdb(spark):
        for first, after in pairwise(sorted({slots * k // RUNS for k in range(RUNS + 1)})):
            told.where((F.col("slot") >= first) & (F.col("slot") < after)).repartition("slot", share).write.mode("append").partitionBy("slot").parquet(f"{root}/in")
            stream = spark.readStream.schema(told.schema).parquet(f"{root}/in").drop("slot")
            intent_stream.outcome_stream(stream, f"{LATE_S} seconds").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state") \
                .trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(intents.OUTCOMES).parquet(f"{root}/out")
