"""Messages out of overlapping views of a conversation."""

from pyspark.sql import functions as F

from ..functions.hashing import sha256
from ..model import EPOCH, Bundle
from ..operators import accumulator
from ..registry import register

VIEWS = f"""turns AS (SELECT conversation_id, conv_id, message_id, "sequence" s, max("sequence") OVER (PARTITION BY conversation_id) m, text_sha256 FROM messages),
shown AS (SELECT *, unnest(range(0, m // 3 + 1)) j FROM turns),
plain AS (SELECT conversation_id, conv_id, message_id, s, text_sha256, j, CASE WHEN conv_id % 3 = 1 THEN m // 3 - j ELSE j END "view", s - 3 * j place FROM shown WHERE s BETWEEN 3 * j AND 3 * j + 4),
late AS (SELECT conversation_id, conv_id, message_id, s, text_sha256, 0 j, 1000 "view", 2 - s place FROM turns WHERE conv_id % 5 = 0 AND s IN (1, 2)),
early AS (SELECT conversation_id, conv_id, message_id, s, text_sha256, 0 j, -1 "view", (4 - s) // 4 place FROM turns WHERE conv_id % 4 = 3 AND s IN (0, 4)),
obs AS (SELECT conversation_id, message_id AS key, "view", place, {EPOCH} + conv_id * 60 + (("view" + 2) // 2) * 10 observed_s,
  CASE WHEN (conv_id + s) % 4 = 0 AND j % 2 = 1 THEN sha256(text_sha256) ELSE text_sha256 END text_hash, (s + "view" + 5) % 5 <> 0 has_html, text_sha256 FROM (FROM plain UNION ALL FROM late UNION ALL FROM early)),
nodes AS (SELECT conversation_id, key, row_number() OVER (PARTITION BY conversation_id ORDER BY min("view" * 100 + place)) - 1 i FROM obs GROUP BY 1, 2),
near AS (SELECT DISTINCT a.conversation_id, x.i f, y.i t FROM (SELECT *, lead(key) OVER (PARTITION BY conversation_id, "view" ORDER BY place) nx FROM obs) a
  JOIN nodes x ON x.conversation_id = a.conversation_id AND x.key = a.key JOIN nodes y ON y.conversation_id = a.conversation_id AND y.key = a.nx WHERE a.key <> a.nx),
keys AS (SELECT n.*, coalesce(p.before, []) before FROM nodes n LEFT JOIN (SELECT conversation_id, t, list(f) before FROM near GROUP BY 1, 2) p ON p.conversation_id = n.conversation_id AND p.t = n.i),
steps AS (SELECT * FROM (WITH RECURSIVE k AS (SELECT DISTINCT conversation_id, CAST([] AS BIGINT[]) done FROM keys
  UNION ALL SELECT k.conversation_id, list_append(any_value(k.done), min(keys.i)) FROM k JOIN keys ON keys.conversation_id = k.conversation_id
    WHERE NOT list_contains(k.done, keys.i) AND list_has_all(k.done, keys.before) GROUP BY k.conversation_id, len(k.done)) SELECT * FROM k)),
final AS (SELECT conversation_id, arg_max(done, len(done)) done FROM steps GROUP BY 1),
line AS (SELECT k.conversation_id, k.key, list_contains(done, i) resolved, row_number() OVER (PARTITION BY k.conversation_id ORDER BY coalesce(list_position(done, i), 1000000), i) - 1 "sequence" FROM keys k JOIN final f ON f.conversation_id = k.conversation_id),
first_times AS (SELECT conversation_id, key, observed_s, min("view" * 100 + place) first_at FROM obs GROUP BY ALL),
times AS (SELECT conversation_id, key, count(*) observation_count, arg_min(observed_s, first_at) first_observed, arg_max(observed_s, first_at) last_observed FROM first_times GROUP BY 1, 2),
drifts AS (SELECT conversation_id, key, concat_ws(',', CASE WHEN bool_or(has_html) AND NOT bool_and(has_html) THEN 'html' END, CASE WHEN count(DISTINCT text_hash) > 1 THEN 'text' END) drift_kinds FROM obs GROUP BY 1, 2)"""


def views(b: Bundle):
    """Views of five turns each, every third turn a new one: scrolled down, in every third conversation up; some show two turns in the wrong order, before all others or at the end."""
    m = b.messages.select("conversation_id", "conv_id", "message_id", F.col("sequence").alias("s"), "text_sha256")
    most = m.groupBy("conversation_id").agg(F.max("s").alias("m"))
    plain = m.join(most, "conversation_id").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / 3)))).where("s between 3 * j and 3 * j + 4") \
        .withColumn("view", F.when(F.col("conv_id") % 3 == 1, F.floor(F.col("m") / 3) - F.col("j")).otherwise(F.col("j"))).withColumn("place", F.col("s") - 3 * F.col("j")).drop("m")
    late = m.where("conv_id % 5 = 0 and s in (1, 2)").withColumn("j", F.lit(0).cast("long")).withColumn("view", F.lit(1000).cast("long")).withColumn("place", 2 - F.col("s"))
    early = m.where("conv_id % 4 = 3 and s in (0, 4)").withColumn("j", F.lit(0).cast("long")).withColumn("view", F.lit(-1).cast("long")).withColumn("place", F.floor((4 - F.col("s")) / 4))
    seen = plain.unionByName(late).unionByName(early)
    other = ((F.col("conv_id") + F.col("s")) % 4 == 0) & (F.col("j") % 2 == 1)
    text = F.struct(F.lit("text").alias("kind"), F.when(other, sha256(F.col("text_sha256"))).otherwise(F.col("text_sha256")).alias("sha256"))
    html = F.struct(F.lit("html").alias("kind"), F.col("text_sha256").alias("sha256"))
    return seen.select("conversation_id", F.col("view").cast("long").alias("view"), F.col("place").cast("long").alias("place"), F.col("message_id").alias("key"),
                       (F.lit(EPOCH) + F.col("conv_id") * 60 + F.floor((F.col("view") + 2) / 2) * 10).cast("long").alias("observed_s"),
                       F.when((F.col("s") + F.col("view") + 5) % 5 != 0, F.array(text, html)).otherwise(F.array(text)).alias("representations"))


@register("i11_accumulated_messages", """SELECT l.conversation_id, l.key message_id, l."sequence", l.resolved, t.observation_count, t.first_observed, t.last_observed, d.drift_kinds
FROM line l JOIN times t ON t.conversation_id = l.conversation_id AND t.key = l.key JOIN drifts d ON d.conversation_id = l.conversation_id AND d.key = l.key""", VIEWS)
def accumulated_messages(b: Bundle):
    return accumulator.accumulated(views(b)).withColumnRenamed("key", "message_id").withColumn("drift_kinds", F.concat_ws(",", "drift_kinds"))


@register("i11_accumulator_warnings", """SELECT DISTINCT conversation_id, 'ordering_cycle' code, CAST(NULL AS VARCHAR) message_id FROM line WHERE NOT resolved
UNION ALL SELECT conversation_id, 'representation_drift', key FROM drifts WHERE drift_kinds <> ''""", VIEWS)
def accumulator_warnings(b: Bundle):
    return accumulator.warnings(accumulator.accumulated(views(b))).withColumnRenamed("key", "message_id")
