"""Ledger, window and history queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators import ledger, lines
from tesserae.plans.registry import query
from tesserae.sources.tables import table


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def latest_event_per_key(spark, sf):
    return ledger.latest(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""SELECT event_id, user_id FROM events e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'error' AND r.event_id - 3 = e.event_id)""")
def active_events(spark, sf):
    events = table(spark, sf, "events").withColumn("target", F.col("event_id") - 3)
    return ledger.active(events, "event_id", "event_type", "target", "purchase", "error").select("event_id", "user_id")


@query("""WITH pairs AS (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY ALL),
blocked AS (SELECT user_id FROM pairs WHERE event_type = 'error'), lifted AS (SELECT e.user_id FROM events e JOIN pairs p ON p.user_id = e.user_id AND p.event_type = 'error' AND e.event_type = 'signup' AND e.event_id > p.last)
SELECT user_id FROM blocked EXCEPT SELECT user_id FROM lifted""")
def blocked_pairs(spark, sf):
    events = table(spark, sf, "events")
    last = ledger.latest(events.where(F.col("event_type").isin("error", "signup")).select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])
    return last.where("event_type = 'error'").select("user_id")


@query("""WITH d AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN props->>'k' END AS after FROM events)
SELECT user_id, arg_max(after, (ts, event_id)) FILTER (after IS NOT NULL) AS value, count(after) AS depth, 0::BIGINT AS violations FROM d GROUP BY user_id""")
def field_state_fold(spark, sf):
    k = F.get_json_object("props", "$.k")
    d = table(spark, sf, "events").select(
        "user_id", F.struct("ts", "event_id").alias("revision"), "event_id",
        F.when(F.col("event_type").isin("purchase", "signup"), "approve").otherwise("reject").alias("action"),
        F.lit(None).cast("long").alias("target"), F.lit(None).cast("string").alias("before"), k.alias("after"),
    )
    return ledger.field_states(d, ["user_id"])


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN 'approve' WHEN event_type = 'error' THEN 'reverse' ELSE 'reject' END AS action FROM events),
n AS (SELECT *, lead(action) OVER w AS next, lag(action) OVER w AS last FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT user_id, arg_max(event_id, event_id) FILTER (action = 'approve') AS id, arg_max(next, event_id) FILTER (action = 'approve') AS after FROM (SELECT user_id, event_id, action, coalesce(next, 'end') AS next FROM n) GROUP BY 1)
SELECT user_id, CASE WHEN after = 'reverse' THEN 'b' || id ELSE 'a' || id END AS value, count_if(action = 'approve' AND coalesce(next, '') <> 'reverse')::BIGINT AS depth, count_if(action = 'reverse' AND coalesce(last, '') <> 'approve')::BIGINT AS violations FROM n JOIN s USING (user_id) GROUP BY ALL""")
def field_state_reversals(spark, sf):
    """Errors reverse the event before them: an approval is taken back, anything else is a violation."""
    before = F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id"))
    text = lambda p: F.concat(F.lit(p), F.col("event_id").cast("string"))
    action = F.when(F.col("event_type").isin("purchase", "signup", "click"), "approve").when(F.col("event_type") == "error", "reverse").otherwise("reject")
    rows = table(spark, sf, "events").select("user_id", F.col("event_id").alias("revision"), "event_id", action.alias("action"), before.alias("target"), text("b").alias("before"), text("a").alias("after"))
    return ledger.field_states(rows, ["user_id"])


@query("""SELECT user_id, coalesce(arg_max(event_id, (ts, event_id)) FILTER (event_type = 'purchase'), arg_max(event_id, (ts, event_id))) AS event_id FROM events GROUP BY 1""")
def human_over_automatic(spark, sf):
    events = table(spark, sf, "events").withColumn("actor", F.when(F.col("event_type") == "purchase", "human").otherwise("rule"))
    return ledger.preferred(events, ["user_id"], "actor", ["ts", "event_id"]).select("user_id", "event_id")


@query("""WITH t AS (SELECT conv_id, turn + 1 + CASE WHEN conv_id % 5 = 0 AND turn > 1 THEN 1 ELSE 0 END AS revision FROM conversations),
x AS (SELECT *, coalesce(lag(revision) OVER (PARTITION BY conv_id ORDER BY revision), 0) + 1 AS expected FROM t)
SELECT conv_id, revision, expected FROM x WHERE revision <> expected""")
def revision_gaps(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1 + F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") > 1), 1).otherwise(0)).alias("revision"))
    return ledger.gaps(turns, ["conv_id"], "revision")


@query("""WITH r AS (SELECT conv_id, turn, sha256(conv_id::VARCHAR || ':' || turn::VARCHAR) AS head, CASE WHEN turn > 0 AND turn % 7 <> 3 THEN sha256(conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR) END AS previous FROM conversations),
x AS (SELECT *, lag(head) OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM r)
SELECT conv_id, turn FROM x WHERE previous IS DISTINCT FROM expected""")
def hash_chain(spark, sf):
    head = lambda t: F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string")), 256)
    turn = F.col("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", head(turn).alias("head"), F.when((turn > 0) & (turn % 7 != 3), head(turn - 1)).alias("previous"))
    return ledger.broken_links(rows, ["conv_id"], ["turn"], "previous", "head").select("conv_id", "turn")


@query("""SELECT user_id, event_id, (sum(round(value * 100)::BIGINT) OVER w)::BIGINT AS spent, sum(round(value * 100)::BIGINT) OVER w < 20000 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def budget_ledger(spark, sf):
    events = table(spark, sf, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return ledger.running_budget(events, ["user_id"], ["ts", "event_id"], "cents", 20000).select("user_id", "event_id", "spent", "allowed")


@query("""WITH c AS (SELECT doc_id, source, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END AS digest FROM documents),
x AS (SELECT *, last_value(digest IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT doc_id, CASE WHEN digest IS NULL THEN 'gap' WHEN before IS NULL THEN 'first_version' WHEN digest = before THEN 'unchanged_bytes' ELSE 'changed_bytes' END AS version_status FROM x""")
def version_history(spark, sf):
    checks = table(spark, sf, "documents").withColumn("digest", F.when(F.col("doc_id") % 6 != 0, F.col("lang")))
    return ledger.version_history(checks, ["source"], ["doc_id"], "digest").select("doc_id", "version_status")


@query("""WITH x AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, before, event_type FROM x WHERE before IS NOT NULL AND (before, event_type) NOT IN (('view', 'click'), ('click', 'purchase'), ('signup', 'view'), ('view', 'view'))""")
def status_transitions(spark, sf):
    allowed = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("signup", "view"), ("view", "view")], "before string, after string")
    return ledger.forbidden_transitions(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", allowed).select("user_id", "event_id", "before", "event_type")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
w AS (SELECT user_id, event_id, i, t, t AS opened, 1 AS place FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, e.t, CASE WHEN e.t >= w.opened + 86400000000 THEN e.t ELSE w.opened END, CASE WHEN e.t >= w.opened + 86400000000 THEN 1 ELSE w.place + 1 END FROM e JOIN w ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, event_id, place <= 2 AS allowed FROM w""")
def rate_limit(spark, sf):
    return ledger.fixed_windows(table(spark, sf, "events"), "user_id", "ts", "event_id", 86400, 2).select("user_id", "event_id", "allowed")


@query("""SELECT p_name AS key, count(*) AS requests, count(DISTINCT p_type) AS fingerprints, count(DISTINCT p_type) > 1 AS conflict FROM part GROUP BY 1""")
def idempotency_conflicts(spark, sf):
    return ledger.conflicts(table(spark, sf, "part").withColumnRenamed("p_name", "key"), "key", "p_type")


@query("""SELECT n_nationkey, n_name FROM nation WHERE (SELECT count(*) FROM region) = 5 AND (SELECT count(*) FROM nation) = 25""")
def cache_fence(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    counts = nation.agg(F.count("*").alias("nations")).crossJoin(region.agg(F.count("*").alias("regions")))  # one row each
    return ledger.fence(nation.select("n_nationkey", "n_name"), counts, spark.createDataFrame([(25, 5)], "nations long, regions long"))


@query("""WITH x AS (SELECT user_id, event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before,
 first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS after FROM events) SELECT * FROM x""")
def lookback_status(spark, sf):
    value = F.when(F.col("event_type") == "error", F.col("event_id"))
    return lines.nearby(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], value, 2, 3).select("user_id", "event_id", "before", "after")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM conversations""")
def carried_heading(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("h", F.when(F.col("role") == "user", F.col("turn")))
    return lines.carried(rows, ["conv_id"], ["turn"], "h", "heading").select("conv_id", "turn", "heading")


@query("""WITH m AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
SELECT conv_id, min(turn) AS turn, string_agg(role, ' ' ORDER BY turn) AS role FROM m WHERE r > 0 GROUP BY conv_id, r""")
def continued_rows(spark, sf):
    return lines.continued(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role", F.col("role") == "user").select("conv_id", "turn", "role")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY source, lang) AS anchor FROM documents")
def representatives(spark, sf):
    return lines.representative(table(spark, sf, "documents"), ["source", "lang"], "doc_id").select("doc_id", "anchor")
