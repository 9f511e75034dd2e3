"""Gates on what comes in: schemas of bundles, parts of bounded size, lists that were read to both ends."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Bundle
from ..operators import accumulator, halving, json_schema, sidebar
from ..registry import register

# Statuses, roles and the version of a bundle.
_STATUS, _ROLES, _VERSION = ["complete", "partial", "failed", "needs_review"], ["user", "assistant", "tool", "system_visible", "unknown"], "0.1.0"
_TEXT = {"type": "string", "minLength": 1}
SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["schema_version", "capture", "messages", "warnings"],
    "properties": {
        "schema_version": {"const": _VERSION},
        "capture": {"type": "object", "additionalProperties": False, "required": ["capture_id", "status"], "properties": {"capture_id": _TEXT, "status": {"enum": _STATUS}}},
        "messages": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/message"}},
        "warnings": {"type": "array", "items": {"type": "string"}},
    },
    "$defs": {
        "message": {"type": "object", "additionalProperties": False, "required": ["message_id", "sequence", "role", "representations"], "properties": {
            "message_id": _TEXT, "sequence": {"type": "integer", "minimum": 0}, "role": {"enum": _ROLES}, "representations": {"type": "array", "items": {"$ref": "#/$defs/representation"}}}},
        "representation": {"type": "object", "additionalProperties": False, "required": ["kind", "value", "sha256"], "properties": {
            "kind": {"enum": ["inner_text", "text_content", "sanitized_html", "canonical_text"]}, "value": {"type": "string"}, "sha256": {"type": "string", "pattern": "^[a-f0-9]{64}$"}}},
    },
}
FAULTS = """faults(k, path, keyword) AS (VALUES (1, '/schema_version', 'const'), (2, '/capture/status', 'required'), (3, '/capture/status', 'enum'), (4, '/extra', 'additionalProperties'),
 (5, '/messages/0/sequence', 'type'), (6, '/messages/0/sequence', 'minimum'), (7, '/messages/0/representations/0/sha256', 'pattern'), (8, '/capture/capture_id', 'minLength'), (9, '/messages', 'type'),
 (10, '', 'json'), (11, '/messages/*/role', 'enum'), (12, '/capture', 'type'), (13, '/warnings/0', 'type'), (14, '/messages', 'minItems'), (15, '/messages', 'required'), (15, '/warnings', 'required'))"""


def _bundles(b: Bundle) -> DataFrame:
    """A bundle as JSON for every message range; one in seventeen of each kind has a fault of that kind."""
    m = b.messages.withColumn("range_no", F.floor(F.col("sequence") / 5)).withColumn("k", (F.col("conv_id") * 3 + F.col("range_no")) % 17)
    k, first = F.col("k"), F.col("sequence") % 5 == 0
    sha = F.when((k == 7) & first, F.upper(F.concat("text_sha256", F.lit("x")))).otherwise(F.col("text_sha256"))
    role = F.when(k == 11, "bot").otherwise(F.col("role"))
    sequence = F.when((k == 6) & first, -1).otherwise(F.col("sequence")).cast("string")
    sequence = F.when((k == 5) & first, F.concat(F.lit('"'), sequence, F.lit('"'))).otherwise(sequence)
    one = F.concat(F.lit('{"message_id":"'), "message_id", F.lit('","sequence":'), sequence, F.lit(',"role":"'), role,
                   F.lit('","representations":[{"kind":"canonical_text","value":'), F.get(F.split(F.to_json(F.array("text")), "^\\[|\\]$"), F.lit(1)), F.lit(',"sha256":"'), sha, F.lit('"}]}'))
    g = m.withColumn("one", one).groupBy("conv_id", "range_no", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "one"))), lambda x: x["one"]), ",").alias("list"))
    g = g.withColumn("chunk", F.concat_ws(":", "conv_id", "range_no"))
    capture = F.when(k == 12, "null").when(k == 2, F.concat(F.lit('{"capture_id":"'), "chunk", F.lit('"}'))).otherwise(
        F.concat(F.lit('{"capture_id":"'), F.when(k == 8, "").otherwise(F.col("chunk")), F.lit('","status":"'), F.when(k == 3, "done").otherwise("complete"), F.lit('"}')))
    messages = F.when(k == 9, "{}").when(k == 14, "[]").otherwise(F.concat(F.lit("["), "list", F.lit("]")))
    tail = F.when(k == 15, "").otherwise(F.concat(F.lit(',"messages":'), messages, F.lit(',"warnings":['), F.when(k == 13, "1").otherwise(""), F.lit("]")))
    body = F.concat(F.lit('{"schema_version":"'), F.when(k == 1, "0.2.0").otherwise(_VERSION), F.lit('"'), F.when(k == 4, ',"extra":1').otherwise(""), F.lit(',"capture":'), capture, tail, F.when(k == 10, "").otherwise("}"))
    return g.select("chunk", body.alias("body"))


@register("a19_schema_violations", """SELECT r.conv_id || ':' || r.range_no record_id, CASE WHEN f.k = 11 THEN '/messages/' || i || '/role' ELSE f.path END path, f.keyword
FROM ranges r JOIN faults f ON f.k = (r.conv_id * 3 + r.range_no) % 17 CROSS JOIN range(5) t(i) WHERE CASE WHEN f.k = 11 THEN i < r.n_messages ELSE i = 0 END""", FAULTS)
def schema_violations(b: Bundle):
    return json_schema.violations(_bundles(b), "chunk", "body", SCHEMA)


BOUND, DEPTH = 600, 6
PARTS = f"""cut AS (SELECT * FROM (WITH RECURSIVE t AS (
  SELECT conversation_id, "sequence" s, CAST(length(text) AS BIGINT) n, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conversation_id ORDER BY "sequence" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) a,
    'chunk0001' ref, 0 depth FROM messages
  UNION ALL SELECT conversation_id, s, n, a, ref || CASE WHEN a - low >= ceil(size / 2) OR s = last THEN '__sub0002' ELSE '__sub0001' END, depth + 1 FROM (
    SELECT *, sum(n) OVER w size, count(*) OVER w k, min(a) OVER w low, max(s) OVER w last FROM t WINDOW w AS (PARTITION BY conversation_id, ref)) WHERE size > {BOUND} AND k > 1 AND depth < {DEPTH}) SELECT * FROM t)),
ends AS (SELECT conversation_id, s, arg_max(ref, depth) part_ref, max(depth) depth, any_value(n) n FROM cut GROUP BY 1, 2),
parts AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) part_size, count(*) OVER w k, row_number() OVER (PARTITION BY conversation_id, part_ref ORDER BY s) i FROM ends WINDOW w AS (PARTITION BY conversation_id, part_ref))"""


def _parts(b: Bundle) -> DataFrame:
    return halving.split(b.messages.select("conversation_id", "sequence", F.length("text").alias("size")), BOUND, DEPTH)


@register("i29_bounded_parts", f"""SELECT conversation_id, s "sequence", part_ref, part_size, CASE WHEN part_size <= {BOUND} THEN 'fits' WHEN k = 1 THEN 'single_message' ELSE 'split_depth_limit' END status FROM parts""", PARTS)
def bounded_parts(b: Bundle):
    return _parts(b)


@register("i29_merged_links", """SELECT a.conversation_id, a.part_ref || '__o' || a.i from_ref, b.part_ref || '__o' || b.i to_ref FROM parts a JOIN parts b ON b.conversation_id = a.conversation_id AND b.part_ref = a.part_ref AND b.i = a.i + 1""", PARTS)
def merged_links(b: Bundle):
    """Each message of a part is an observation, linked with the next one; the last one's link leads nowhere and goes."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conversation_id", "part_ref").orderBy("sequence"))
    told = _parts(b).withColumn("n", n).select("conversation_id", "part_ref", F.concat(F.lit("o"), F.col("n").cast("string")).alias("ref"), F.concat(F.lit("o"), (F.col("n") + 1).cast("string")).alias("next"))
    links = told.select("conversation_id", "part_ref", F.col("ref").alias("from_ref"), F.col("next").alias("to_ref"))
    return halving.merged(told.drop("next"), links)[1].select("conversation_id", "from_ref", "to_ref")


SIDEBAR = """convs AS (SELECT DISTINCT conv_id FROM conversations), acc AS (SELECT conv_id % 9 a, conv_id, row_number() OVER (PARTITION BY conv_id % 9 ORDER BY conv_id DESC) - 1 r, count(*) OVER (PARTITION BY conv_id % 9) n FROM convs),
sizes AS (SELECT DISTINCT a, n, 50 * n h, greatest(50 * n - 300, 0) bottom FROM acc),
pas0 AS (SELECT *, unnest(range(0, bottom // 200 + 9)) p FROM sizes),
pas AS (SELECT a, p "pass", h, bottom, CASE WHEN p = 0 THEN least(100, bottom) WHEN p = 1 THEN CASE WHEN a = 3 THEN least(120, bottom) ELSE 0 END WHEN p = bottom // 200 + 8 THEN CASE WHEN a = 6 THEN bottom ELSE least(100, bottom) END
  ELSE least((p - 2) * 200, CASE WHEN a = 2 THEN greatest(bottom - 50, 0) ELSE bottom END) END top FROM pas0 WHERE NOT (a = 5 AND p IN (bottom // 200 + 6, bottom // 200 + 7))),
look AS (SELECT p.a, p."pass", p.top, x.conv_id, x.r, CASE WHEN x.a = 4 AND x.r % 3 = 0 AND p."pass" % 2 = 1 THEN 'other' ELSE 'title ' || x.conv_id END title FROM pas p JOIN acc x ON x.a = p.a AND x.r * 50 BETWEEN p.top AND p.top + 299)"""


def _sidebar(b: Bundle) -> tuple[DataFrame, DataFrame]:
    """Nine accounts' lists of 50-pixel rows, looked at 300 pixels at a time; some are not read to an end, put back, or name a row in two ways."""
    from pyspark.sql import Window

    acc = b.raw("conversations").select("conv_id").distinct().withColumn("a", F.col("conv_id") % 9)
    acc = acc.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("conv_id"))) - 1)
    sizes = acc.groupBy("a").agg((F.count("*") * 50).alias("h")).withColumn("bottom", F.greatest(F.col("h") - 300, F.lit(0)))
    last = F.floor(F.col("bottom") / 200) + 8
    rest = F.least(F.lit(100).cast("long"), F.col("bottom"))
    top = F.when(F.col("pass") == 0, rest).when(F.col("pass") == 1, F.when(F.col("a") == 3, F.least(F.lit(120).cast("long"), F.col("bottom"))).otherwise(0)) \
        .when(F.col("pass") == last, F.when(F.col("a") == 6, F.col("bottom")).otherwise(rest)) \
        .otherwise(F.least((F.col("pass") - 2) * 200, F.when(F.col("a") == 2, F.greatest(F.col("bottom") - 50, F.lit(0))).otherwise(F.col("bottom"))))
    passes = sizes.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), last))).where(~((F.col("a") == 5) & F.col("pass").between(last - 2, last - 1)))
    passes = passes.withColumn("scroll_top", top).withColumn("inventory_id", F.concat(F.lit("inventory_"), F.col("a").cast("string")))
    seen = passes.join(acc, "a").where((F.col("r") * 50).between(F.col("scroll_top"), F.col("scroll_top") + 299))
    title = F.when((F.col("a") == 4) & (F.col("r") % 3 == 0) & (F.col("pass") % 2 == 1), "other").otherwise(F.concat(F.lit("title "), F.col("conv_id").cast("string")))
    told = seen.select("inventory_id", "pass", (F.col("r") * 50 - F.col("scroll_top")).alias("place_in_pass"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("identity"), title.alias("title"),
                       F.lit("https://example.org").alias("source_url"), (F.col("r") * 50).alias("order_hint"))
    return passes.select("inventory_id", "pass", "scroll_top", F.col("h").alias("scroll_height"), F.lit(300).alias("client_height")), told


@register("a15_sidebar_rows", """SELECT 'inventory_' || a inventory_id, 'c' || conv_id identity, arg_min(title, "pass") title, count(*) n_seen, count(*) FILTER (WHERE title <> first) collisions, r - (SELECT min(r) FROM look y WHERE y.a = z.a) AS "position"
FROM (SELECT *, first_value(title) OVER (PARTITION BY a, conv_id ORDER BY "pass") first FROM look) z GROUP BY a, conv_id, r""", SIDEBAR)
def sidebar_rows(b: Bundle):
    return sidebar.rows(_sidebar(b)[1]).select("inventory_id", "identity", "title", "n_seen", "collisions", "position")


@register("a15_sidebar_inventories", """SELECT 'inventory_' || s.a inventory_id, CASE WHEN w = '' THEN 'complete' ELSE 'needs_review' END status, n_rows, collisions, w warnings FROM (
SELECT s.a, n_rows, collisions, concat_ws(',', CASE WHEN s.a = 3 AND bottom > 2 THEN 'latest_sidebar_boundary_not_reached' END,
  CASE WHEN s.a = 5 AND bottom > 0 OR s.a = 2 AND bottom > 50 THEN 'earliest_sidebar_boundary_not_verified,sidebar_scrolling_did_not_stabilize,sidebar_observation_count_did_not_stabilize' END,
  CASE WHEN collisions > 0 THEN 'conversation_identity_collisions:' || collisions END, CASE WHEN s.a = 6 AND bottom > 102 THEN 'initial_sidebar_position_not_restored' END) w
FROM sizes s JOIN (SELECT a, count(DISTINCT conv_id) n_rows, count(*) FILTER (WHERE title <> first) collisions FROM (SELECT *, first_value(title) OVER (PARTITION BY a, conv_id ORDER BY "pass") first FROM look) GROUP BY 1) c ON c.a = s.a) s""", SIDEBAR)
def sidebar_inventories(b: Bundle):
    return sidebar.inventory(*_sidebar(b)).withColumn("warnings", F.concat_ws(",", "warnings"))


@register("a15_stitched_order", """SELECT 'inventory_' || a inventory_id, 'c' || conv_id identity, row_number() OVER (PARTITION BY a ORDER BY r) - 1 AS "sequence" FROM (SELECT DISTINCT a, conv_id, r FROM look)""", SIDEBAR)
def stitched_order(b: Bundle):
    """The same lists without any pixel: their order from which rows were seen beside each other."""
    seen = _sidebar(b)[1].select(F.col("inventory_id").alias("conversation_id"), F.col("pass").alias("view"), F.col("place_in_pass").alias("place"), F.col("identity").alias("key"))
    return accumulator.ordered(seen).select(F.col("conversation_id").alias("inventory_id"), F.col("key").alias("identity"), "sequence")
