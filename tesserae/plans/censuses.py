"""Census, audit and accounting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import census, decisions, matching, summaries
from tesserae.plans.registry import query
from tesserae.sources.tables import table


@query("""SELECT o_custkey AS key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_totalprice >= 50000 GROUP BY 1""")
def reusable_acquisitions(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("verified"), F.col("o_orderpriority").alias("mime"), F.floor("o_totalprice").alias("bytes"), F.col("o_orderdate").alias("retrieved_at"))
    return census.reusable(rows, "key", "2-HIGH", 50000).select("key", "id")


@query("""SELECT l_orderkey, l_linenumber, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS refs, count(*) AS versions, count(DISTINCT l_quantity) > 1 AS conflict FROM lineitem GROUP BY 1, 2""")
def position_versions(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("position", F.struct("l_orderkey", "l_linenumber"))
    return census.position_versions(lines, "position", "l_partkey", "l_quantity").select("position.l_orderkey", "position.l_linenumber", "refs", "versions", "conflict")


@query("""SELECT p_name, p_brand, min(p_partkey) AS citation, count(*) AS copies, min(p_type || p_size::VARCHAR) <> max(p_type || p_size::VARCHAR) AS conflict FROM part GROUP BY 1, 2""")
def canonical_results(spark, sf):
    return census.canonical_rows(table(spark, sf, "part"), ["p_name", "p_brand"], "p_partkey", F.concat("p_type", F.col("p_size").cast("string")))


@query("""SELECT event_id, props->>'k' AS k, CASE WHEN event_type = 'view' THEN 'v' END AS t, CASE WHEN event_type = 'view' THEN 'complete' ELSE 'partial' END AS import_status FROM events""")
def legacy_import(spark, sf):
    fields = F.create_map(F.lit("k"), F.lit(""), F.lit("kk"), F.get_json_object("props", "$.k"), F.lit("t"), F.when(F.col("event_type") == "view", "v").otherwise(""))
    return census.legacy_fields(table(spark, sf, "events").select("event_id", fields.alias("f")), {"k": ["k", "kk"], "t": ["t"]}, "f")


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey, o_orderstatus AS s2, o_orderpriority AS p2 FROM orders WHERE o_orderkey % 2 = 1 AND o_orderstatus <> 'P'),
j AS (SELECT o_orderkey, min(CASE WHEN s = s2 AND p = p2 THEN 0 WHEN s = s2 THEN 1 WHEN p = p2 THEN 2 ELSE 3 END) AS r FROM a JOIN b USING (o_custkey) GROUP BY 1)
SELECT o_orderkey, CASE r WHEN 0 THEN 'exact' WHEN 1 THEN 'same-status' WHEN 2 THEN 'same-priority' WHEN 3 THEN 'different' ELSE 'absent' END AS class FROM a LEFT JOIN j USING (o_orderkey)""")
def publication_ladder(spark, sf):
    orders = table(spark, sf, "orders")
    a = orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    b = orders.where("o_orderkey % 2 = 1 and o_orderstatus <> 'P'").select("o_custkey", F.col("o_orderstatus").alias("s2"), F.col("o_orderpriority").alias("p2"))
    same, rank = F.col("s") == F.col("s2"), F.col("p") == F.col("p2")
    return census.classified(a, b, ["o_custkey"], [("exact", same & rank), ("same-status", same), ("same-priority", rank)], "o_orderkey")


@query("""WITH e AS (SELECT doc_id AS "left", doc_id * 2 AS "right" FROM documents)
SELECT e."left", e."right", CASE WHEN b.doc_id IS NULL THEN 'missing-end' WHEN e."left" = e."right" THEN 'loop' ELSE 'scope' END AS problem FROM e JOIN documents a ON a.doc_id = e."left" LEFT JOIN documents b ON b.doc_id = e."right"
WHERE b.doc_id IS NULL OR e."left" = e."right" OR a.lang <> b.lang""")
def edge_audit(spark, sf):
    docs = table(spark, sf, "documents")
    edges = docs.select(F.col("doc_id").alias("left"), (F.col("doc_id") * 2).alias("right"))
    return census.edge_problems(edges, docs, "doc_id", "lang")


@query("""WITH s AS (SELECT o_custkey AS event, o_orderpriority AS member, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS revision FROM orders GROUP BY ALL), l AS (SELECT event, max(revision) AS last FROM s GROUP BY 1),
n AS (SELECT s.event, member FROM s JOIN l ON l.event = s.event AND revision = last), b AS (SELECT s.event, member FROM s JOIN l ON l.event = s.event AND revision = last - 1),
f AS (SELECT coalesce(n.event, b.event) AS event, n.member AS now, b.member AS before FROM n FULL JOIN b ON n.event = b.event AND n.member = b.member)
SELECT event, count(*) FILTER (now IS NOT NULL AND before IS NOT NULL) AS retained, count(*) FILTER (before IS NULL) AS added, count(*) FILTER (now IS NULL) AS dropped FROM f GROUP BY 1""")
def selection_plan(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("event"), F.col("o_orderpriority").alias("member"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("revision")).distinct()
    return census.selection(rows.where("revision = 1"), rows.where("revision = 2"), "event", "member", "revision")


@query("""WITH g AS (SELECT c_nationkey AS g, min(c_custkey) AS "left" FROM customer GROUP BY 1), f AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey IN (7, 8, 20, 21))
SELECT "left", c_custkey AS "right" FROM customer JOIN g ON g = c_nationkey WHERE c_custkey <> "left" AND c_nationkey NOT IN (SELECT * FROM f) AND c_custkey % 3 <> 0""")
def spanning_edges(spark, sf):
    people = table(spark, sf, "customer")
    blocked = spark.createDataFrame([(7, 8), (20, 21)], "left long, right long")
    active = people.select("c_nationkey", F.col("c_custkey").alias("right")).join(people.groupBy("c_nationkey").agg(F.min("c_custkey").alias("left")), "c_nationkey").where("right % 3 = 0").select("left", "right")
    return census.spanning_edges(people, "c_nationkey", "c_custkey", blocked, active)


@query("""SELECT * FROM (VALUES ('rows', 25::BIGINT, (SELECT count(*) FROM nation)), ('regions', 5, (SELECT count(DISTINCT n_regionkey) FROM nation)), ('first', 1, (SELECT min(n_nationkey)::BIGINT FROM nation))) t(rule, expected, actual), LATERAL (SELECT expected = actual AS holds)""")
def packet_accounting(spark, sf):
    return census.accounting(table(spark, sf, "nation"), ("rows", 25, F.count("*")), ("regions", 5, F.count_distinct("n_regionkey")), ("first", 1, F.min("n_nationkey")))


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('blind:' || doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source FROM r WHERE r <= ceil(n / 10)""")
def agreement_sample(spark, sf):
    return census.agreement_sample(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "source", "blind")


@query("""SELECT l_returnflag, count(*) AS rows, count(*) FILTER (l_linestatus IS DISTINCT FROM CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'O' END) AS a_differs, count(*) FILTER (l_partkey % 7 = 0) AS b_differs FROM lineitem GROUP BY 1""")
def difference_counters(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_linestatus").alias("a"), F.when(F.col("l_partkey") % 5 == 0, "").otherwise("O").alias("a2"), F.lit(None).cast("string").alias("b"), F.when(F.col("l_partkey") % 7 == 0, "x").otherwise("").alias("b2"))
    return census.disagreements(rows, ["a", "b"], ["a2", "b2"], "l_returnflag")


@query("""SELECT r_name AS target, coalesce(max(CASE WHEN s_suppkey % 2 = 0 AND n_regionkey < 3 THEN s_suppkey END), 0) AS revision FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def delivery_checkpoints(spark, sf):
    done = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").join(F.broadcast(table(spark, sf, "nation").where("n_regionkey < 3")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    counts = done.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.max("s_suppkey").alias("revision"))
    region = table(spark, sf, "region")
    return summaries.zero_filled(counts, region, ["r_regionkey"], "revision").join(F.broadcast(region), "r_regionkey").select(F.col("r_name").alias("target"), "revision")


@query("""SELECT event_type, count(*) AS requests, sum((props->>'k')::BIGINT)::BIGINT AS used, string_agg(DISTINCT CASE WHEN value > 90 THEN 'slow' WHEN value < 5 THEN 'fast' END, ',' ORDER BY CASE WHEN value > 90 THEN 'slow' WHEN value < 5 THEN 'fast' END) AS flags FROM events GROUP BY 1""")
def request_metrics(spark, sf):
    flag = F.when(F.col("value") > 90, "slow").when(F.col("value") < 5, "fast")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("requests"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("used"), F.array_join(F.array_sort(F.collect_set(flag)), ",").alias("flags"))


@query("""SELECT g AS "group", count(*) AS decisions, count(*) FILTER (event_type = 'error') AS errors FROM (SELECT event_type, unnest(CASE WHEN value > 50 THEN ['high', 'all'] ELSE ['all'] END) AS g FROM events) GROUP BY 1""")
def overlay_counts(spark, sf):
    groups = F.when(F.col("value") > 50, F.array(F.lit("high"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    return table(spark, sf, "events").select("event_type", F.explode(groups).alias("group")).groupBy("group").agg(F.count("*").alias("decisions"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query()
def attempt_groups(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("position"), F.concat_ws("/", "p_name", "p_type").alias("scope"))
    star = lambda key: matching.pair_edges(parts, key, "p_partkey", key)
    return decisions.attempt_groups(parts, "p_partkey", star("position"), star("scope"), star("scope").limit(0))


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders), m AS (SELECT o_custkey, max(o_orderkey) AS newest FROM orders GROUP BY 1)
SELECT o.o_orderkey, o.o_orderkey = m.newest AS effective FROM orders o JOIN m USING (o_custkey)""")
def audit_effective(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    newest = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("newest"))
    return orders.join(newest, "o_custkey").select("o_orderkey", (F.col("o_orderkey") == F.col("newest")).alias("effective"))
