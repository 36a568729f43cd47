"""Decision, gate and precedence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import decisions, routing
from tesserae.plans.registry import query
from tesserae.sources.tables import table


@query("""WITH e AS (SELECT event_id AS i, CASE event_id % 5 WHEN 0 THEN 'row-semantics' WHEN 1 THEN 'other' ELSE 'identity' END AS family, (96 + event_id % 5) / 100.0 AS p, (97 + user_id % 4) / 100.0 AS confidence FROM events)
SELECT i AS event_id, CASE WHEN i % 97 = 0 THEN 'invalid-policy' WHEN family = 'other' THEN 'unsupported-action' WHEN i % 31 = 0 THEN 'stale-evidence' WHEN i % 29 = 0 THEN 'provider-error' WHEN i % 23 = 0 THEN 'unknown-answer'
  WHEN i % 19 = 0 THEN 'inadequate-evidence' WHEN i % 17 = 0 THEN 'conflicting-evidence' WHEN i % 13 = 0 THEN 'unexpected-answer' WHEN i % 11 = 0 OR confidence > 1 OR (family = 'row-semantics' AND i % 2 = 0) THEN 'invalid-answer'
  WHEN family = 'row-semantics' THEN 'no-canonical-role-ledger' WHEN confidence < 0.98 THEN 'low-confidence' WHEN i % 7 = 0 THEN 'low-probability' WHEN p < 0.97 THEN 'low-probability' ELSE 'thresholds-met' END AS gate FROM e""")
def approval_gate(spark, sf):
    i = F.col("event_id")
    family = F.when(i % 5 == 0, "row-semantics").when(i % 5 == 1, "other").otherwise("identity")
    action = F.when(i % 5 == 0, "attempt").otherwise("same-person")
    p = F.when(i % 7 == 0, 0.5).otherwise((96 + i % 5) / 100.0)
    rest = F.when(i % 11 == 0, 1.5 - p).otherwise(1 - p)
    zero = F.lit(0.0)
    rows = F.create_map(F.lit("attempt"), p, F.lit("aggregate"), rest, F.lit("summary"), zero, F.lit("not-result"), zero, F.lit("unknown"), zero)
    pair = F.create_map(F.lit("same-person"), p, F.lit("different-person"), rest, F.lit("unknown"), zero)
    gate = decisions.approval(
        {
            "version": F.when(i % 97 != 0, "v2"), "family": family, "action": action, "stale": i % 31 == 0, "error": i % 29 == 0, "evidence_adequate": i % 19 != 0,
            "outcome": F.when(i % 23 == 0, "unknown").when(i % 13 == 0, "neither").otherwise(action), "conflicts": F.when(i % 17 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")),
            "probabilities": F.when((i % 5 == 0) & (i % 2 == 1), rows).otherwise(pair), "confidence": (97 + F.col("user_id") % 4) / 100.0,
        }
    )
    return table(spark, sf, "events").select("event_id", gate.alias("gate"))


@query("""WITH e AS (SELECT conv_id, turn + 1 + CASE WHEN conv_id % 4 = 0 AND turn >= 2 THEN 1 ELSE 0 END AS revision FROM conversations WHERE turn >= 1)
SELECT conv_id, revision, CASE WHEN conv_id % 4 = 0 AND revision >= 4 THEN 'rejected' ELSE 'accepted' END AS verdict FROM e""")
def append_validation(spark, sf):
    turns = table(spark, sf, "conversations")
    state = turns.where("turn = 0").select("conv_id", (F.col("turn") + 1).alias("revision"))
    revision = F.col("turn") + 1 + F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") >= 2), 1).otherwise(0)
    return decisions.appended(state, turns.where("turn >= 1").select("conv_id", revision.alias("revision")), "conv_id", "revision")


@query("""SELECT user_id, arg_min(event_id, (CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END, event_id)) AS event_id FROM events WHERE event_type IN ('purchase', 'signup', 'click') AND event_id IN
 (SELECT min(event_id) FROM events GROUP BY user_id, event_type) GROUP BY 1""")
def route_precedence(spark, sf):
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return decisions.by_precedence(first, "user_id", "event_type", ["purchase", "signup", "click"]).select("user_id", "event_id")


_DECIDED = """WITH RECURSIVE d AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN 'reversed' ELSE 'accepted' END AS status, conv_id % 5 = 0 AND turn = 2 AS lost FROM conversations),
n AS (SELECT conv_id * 1000 + turn AS id, conv_id * 1000 + turn - 1 AS needs FROM conversations WHERE turn > 0),
bad AS (SELECT id FROM d WHERE lost UNION SELECT n.id FROM n JOIN d ON d.id = n.needs WHERE d.status <> 'accepted' OR d.lost UNION SELECT n.id FROM n JOIN bad ON bad.id = n.needs)"""


def _decided(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    status = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1), "reversed").otherwise("accepted")
    needs = turns.where("turn > 0").select("id", (F.col("id") - 1).alias("needs"))
    return turns.select("id", status.alias("status")), needs, turns.where("not (conv_id % 5 = 0 and turn = 2)").select("id")


@query(_DECIDED + "SELECT id, CASE WHEN status = 'accepted' AND id IN (SELECT id FROM bad) THEN 'invalidated' ELSE status END AS status FROM d")
def effective_decisions(spark, sf):
    return decisions.effective(*_decided(spark, sf))


@query(_DECIDED + "SELECT d.id FROM d WHERE d.status = 'accepted' AND d.id > 3000 AND d.id < 4000")
def reversal_impact(spark, sf):
    decided, needs, _ = _decided(spark, sf)
    return decisions.impact(decided, needs, 3000)


@query(_DECIDED + "SELECT id, status FROM d WHERE status = 'accepted' AND id NOT IN (SELECT n.id FROM n JOIN d ON d.id = n.needs WHERE d.status <> 'accepted') AND id // 1000 % 7 <> 0 OR (status = 'accepted' AND id % 1000 = 0)")
def eligibility_fixpoint(spark, sf):
    decided, needs, _ = _decided(spark, sf)
    return decisions.stable(decided, needs, F.col("status") == "accepted", "id")


@query("""WITH r AS (SELECT o_custkey AS id, l_suppkey AS candidate, CASE WHEN l_returnflag = 'N' THEN 'publisher-id' ELSE 'name' END AS route, l_discount >= 0.1 AS contradicts, l_tax < 0.08 AS supported FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
k AS (SELECT id, count(DISTINCT candidate) AS n, bool_or(contradicts) AS bad, bool_and(supported) AS known, bool_or(route = 'publisher-id') AS strong FROM r GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN n IS NULL THEN 'no-candidate' WHEN NOT known THEN 'unsupported' WHEN bad THEN 'contradiction' WHEN n > 1 THEN 'ambiguous' WHEN NOT strong THEN 'weak-route' ELSE 'link' END AS decision FROM customer LEFT JOIN k ON id = c_custkey""")
def identity_decisions(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = lines.select(F.col("o_custkey").alias("id"), F.col("l_suppkey").alias("candidate"), F.when(F.col("l_returnflag") == "N", "publisher-id").otherwise("name").alias("route"), (F.col("l_discount") >= 0.1).alias("contradicts"), (F.col("l_tax") < 0.08).alias("supported"))
    return decisions.identity_decision(found, table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id")


@query("""WITH c AS (SELECT o_custkey AS id, sha256(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority)) AS now FROM orders GROUP BY 1),
l AS (SELECT o_custkey AS id, sha256(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority)) AS h FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT id, 'reverse' AS action FROM l LEFT JOIN c USING (id) WHERE h IS DISTINCT FROM now""")
def links_to_recheck(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("candidate"), "o_orderstatus")
    digest = F.sha2(F.array_join(F.array_sort(F.collect_set("candidate")), ","), 256)
    links = orders.where("o_orderstatus <> 'P'").groupBy("id").agg(digest.alias("candidates_hash")).withColumn("actor", F.lit("automatic"))
    return decisions.recheck(links, orders)


@query("""WITH x AS (SELECT p_partkey AS id, p_size AS s, p_brand AS b, p_type AS t FROM part WHERE p_partkey % 2 = 0), y AS (SELECT p_partkey AS o, p_size AS s, p_brand AS b, p_type AS t FROM part WHERE p_partkey % 2 = 1),
e AS (SELECT id, count(*) AS n1, min(o) AS m1 FROM x JOIN y USING (s, b, t) GROUP BY 1), l AS (SELECT id, count(*) AS n2, min(o) AS m2 FROM x JOIN y USING (t) GROUP BY 1)
SELECT id, CASE WHEN n1 = 1 THEN m1 WHEN n1 IS NULL AND n2 = 1 THEN m2 END AS match, CASE WHEN n1 > 1 THEN 'ambiguous' WHEN n1 = 1 THEN 'possible-revision' WHEN n2 > 1 THEN 'ambiguous' WHEN n2 = 1 THEN 'name-only' ELSE 'unmatched' END AS class FROM x LEFT JOIN e USING (id) LEFT JOIN l USING (id)""")
def revision_matches(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("s"), F.col("p_brand").alias("b"), F.col("p_type").alias("t"))
    return decisions.revision_match(parts.where("id % 2 = 0"), parts.where("id % 2 = 1").withColumnRenamed("id", "o"), ["s", "b"], "t", "id", "o")


@query("""SELECT p_type AS digest, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS sources, coalesce(max(CASE WHEN p_type = 'SMALL' THEN 'acquired' WHEN p_type = 'ECONOMY' THEN 'blocked' END), 'unchecked') AS state FROM part GROUP BY 1""")
def discovery_frontier(spark, sf):
    done = spark.createDataFrame([("SMALL", 1, "blocked"), ("SMALL", 2, "acquired"), ("ECONOMY", 1, "blocked")], "digest string, revision int, state string")
    return decisions.frontier(table(spark, sf, "part").select(F.col("p_type").alias("digest"), F.col("p_brand").alias("source")), done)


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'missing' WHEN event_id % 7 = 0 THEN 'not-json' WHEN event_id % 5 = 0 THEN 'no-choice' WHEN event_type = 'error' THEN 'unknown-choice' WHEN event_id % 3 = 0 THEN 'confidence-out-of-range' WHEN event_id % 2 = 0 THEN 'no-evidence' END AS error FROM events""")
def answer_validation(spark, sf):
    i = F.col("event_id")
    body = F.concat(
        F.lit('{"'), F.when(i % 5 == 0, "other").otherwise("choice"), F.lit('": "'), F.col("event_type"), F.lit('", "confidence": '), F.when(i % 3 == 0, "1.5").otherwise("0.5"),
        F.lit(', "evidence": ['), F.when(i % 2 == 0, "").otherwise('"x"'), F.lit("]}"),
    )
    answers = table(spark, sf, "events").select("event_id", F.when(i % 11 != 0, F.when(i % 7 == 0, "{broken").otherwise(body)).alias("body"))
    return decisions.checked_answers(answers, "body", ["view", "click", "purchase", "signup"]).select("event_id", "error")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 OR p_size % 5 = 0 THEN 'abstain' WHEN p_size % 4 = p_size % 5 THEN 'match' ELSE 'no-match' END AS outcome FROM part""")
def provider_outcomes(spark, sf):
    size = F.col("p_size")
    return decisions.provider_rules(table(spark, sf, "part").select("p_partkey", F.when(size % 4 != 0, size % 4).alias("a"), F.when(size % 5 != 0, size % 5).alias("b")), "a", "b").select("p_partkey", "outcome")


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p AS (SELECT conv_id, turn, i, s AS total, 1 AS n, 0 AS batch FROM r WHERE i = 1 UNION ALL SELECT r.conv_id, r.turn, r.i, CASE WHEN p.n = 3 OR p.total + r.s > 600 THEN r.s ELSE p.total + r.s END,
  CASE WHEN p.n = 3 OR p.total + r.s > 600 THEN 1 ELSE p.n + 1 END, CASE WHEN p.n = 3 OR p.total + r.s > 600 THEN p.batch + 1 ELSE p.batch END FROM r JOIN p ON r.conv_id = p.conv_id AND r.i = p.i + 1) SELECT conv_id, turn, batch::BIGINT AS batch FROM p""")
def request_batches(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("size"))
    return decisions.packed(turns, "conv_id", "turn", "size", 3, 600).select("conv_id", "turn", "batch")


@query("""WITH src AS (SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) SELECT l_orderkey AS source_id, count(*) AS positions FROM lineitem WHERE l_orderkey IN (SELECT id FROM src) GROUP BY 1""")
def census_cascade(spark, sf):
    events = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    sources = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_custkey").alias("event_ids"))
    _, positions = routing.cascade(events, sources, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_id")))
    return positions.groupBy("source_id").agg(F.count("*").alias("positions"))


@query("""WITH e AS (SELECT o_custkey AS "left", l_suppkey AS "right", CASE WHEN l_discount = 0.1 THEN 'refuted' WHEN l_returnflag = 'A' THEN 'same-bytes' WHEN l_returnflag = 'N' THEN 'same-position' WHEN l_linestatus = 'F' THEN 'cited' ELSE 'other' END AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
k AS (SELECT "left", "right", list(DISTINCT kind) AS kinds FROM e GROUP BY 1, 2)
SELECT "left", "right", CASE WHEN list_contains(kinds, 'refuted') AND len(kinds) > 1 THEN 'unknown' WHEN list_contains(kinds, 'same-bytes') THEN 'equivalent' WHEN list_contains(kinds, 'same-position') THEN 'same-attempt' WHEN list_contains(kinds, 'cited') THEN 'dependent' ELSE 'unknown' END AS kind FROM k""")
def relationship_kinds(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    kind = F.when(F.col("l_discount") == 0.1, "refuted").when(F.col("l_returnflag") == "A", "same-bytes").when(F.col("l_returnflag") == "N", "same-position").when(F.col("l_linestatus") == "F", "cited").otherwise("other")
    return decisions.relationship(lines.select(F.col("o_custkey").alias("left"), F.col("l_suppkey").alias("right"), kind.alias("kind")))


@query("""WITH b AS (SELECT p_brand, p_size, count(DISTINCT p_type) AS n, min(p_type) AS t FROM part GROUP BY 1, 2) SELECT p_brand, p_size, n AS payloads FROM b WHERE n > 1""")
def stage_conflicts(spark, sf):
    parts = table(spark, sf, "part").select("p_brand", "p_size", "p_type")
    return decisions.upserted(parts.limit(0), parts, ["p_brand", "p_size"], "p_type")[1]


@query("""WITH RECURSIVE last AS (SELECT p_partkey % 400 AS pair, arg_max(CASE WHEN p_size % 10 = 0 THEN 'unknown' WHEN p_size % 2 = 0 THEN 'match' ELSE 'no-match' END, p_partkey) AS label FROM part GROUP BY 1),
k AS (SELECT pair, pair // 3 AS key FROM last), e AS (SELECT DISTINCT a.pair AS a, b.pair AS b FROM k a JOIN k b USING (key)), g AS (SELECT a AS pair, min(b) AS "group" FROM e GROUP BY 1),
x AS (SELECT pair, label, "group", label IN ('match', 'no-match') AS usable FROM last JOIN g USING (pair))
SELECT pair, label, "group", CASE WHEN NOT usable THEN 'excluded' WHEN min(label) OVER w <> max(label) OVER w THEN 'conflict' WHEN pair <> min(pair) OVER w THEN 'duplicate' ELSE 'exported' END AS status FROM x WINDOW w AS (PARTITION BY "group", usable)""")
def label_export(spark, sf):
    size = F.col("p_size")
    label = F.when(size % 10 == 0, "unknown").when(size % 2 == 0, "match").otherwise("no-match")
    labels = table(spark, sf, "part").select((F.col("p_partkey") % 400).alias("pair"), F.col("p_partkey").alias("revision"), label.alias("label"))
    names = labels.select("pair").distinct().withColumn("names", F.array(F.floor(F.col("pair") / 3).cast("string")))
    return decisions.exported_labels(labels, names)
