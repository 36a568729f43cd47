"""Matching, edge and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import matching
from tesserae.plans.registry import query
from tesserae.sources.tables import table

_PEOPLE = """WITH people AS (
  SELECT 'p' || p_partkey::VARCHAR AS id, p_brand AS source, CASE WHEN p_size <> 17 THEN p_name WHEN p_partkey % 2 = 0 THEN '17' END AS name FROM part
), folded AS (
  SELECT id, source, trim(regexp_replace(lower(strip_accents(name)), '[^\\p{L}]+', ' ', 'g')) AS name FROM people
), worded AS (
  SELECT *, array_to_string(list_sort(string_split(name, ' ')), ' ') AS ordered FROM folded WHERE name <> ''
), one AS (SELECT source, ordered, min(id) AS id, arg_min(name, id) AS name FROM worded GROUP BY source, ordered),
keys AS (
  SELECT id, 1 AS signal, name AS key FROM one UNION ALL SELECT id, 2, ordered FROM one
  UNION ALL SELECT id, 3, w FROM (SELECT id, len(string_split(name, ' ')) AS n, unnest(list_distinct(string_split(name, ' '))) AS w FROM one) WHERE n >= 2 AND length(w) >= 4
)"""


def _people(spark, sf):
    """All parts by name; listings of one brand with one name are one person, so pairs grow with the names, not the rows."""
    name = F.when(F.col("p_size") != 17, F.col("p_name")).when(F.col("p_partkey") % 2 == 0, "17")  # some have no name, some one without letters
    return table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("source"), name.alias("name"))


@query(_PEOPLE + """ SELECT l.id AS "left", r.id AS "right", min(l.signal) AS signal FROM keys l JOIN keys r ON l.signal = r.signal AND l.key = r.key AND l.id < r.id GROUP BY 1, 2""")
def name_candidates(spark, sf):
    return matching.name_candidates(_people(spark, sf), "id", "name", "source")


@query(_PEOPLE + """, pairs AS (SELECT l.id AS a, r.id AS b, min(l.signal) AS signal FROM keys l JOIN keys r ON l.signal = r.signal AND l.key = r.key AND l.id < r.id GROUP BY 1, 2),
found AS (SELECT id AS "group", count(*) AS candidates, min(signal) AS best FROM (SELECT a AS id, signal FROM pairs UNION ALL SELECT b, signal FROM pairs) GROUP BY 1),
grouped AS (SELECT p.id, w.ordered IS NOT NULL AS named, coalesce(one.id, p.id) AS "group" FROM people p LEFT JOIN worded w ON w.id = p.id LEFT JOIN one ON one.source = w.source AND one.ordered = w.ordered)
SELECT id, "group", coalesce(candidates, 0) AS candidates,
  CASE WHEN NOT named THEN 'unknown' WHEN candidates IS NULL THEN 'no-candidate' WHEN candidates > 1 OR best = 3 THEN 'ambiguous' ELSE 'candidate' END AS outcome FROM grouped LEFT JOIN found USING ("group")""")
def candidate_outcome(spark, sf):
    return matching.candidate_outcome(_people(spark, sf), "id", "name", "source")


@query(_PEOPLE + """ SELECT p.id, coalesce(one.id, p.id) AS "group", one.name FROM people p LEFT JOIN worded w ON w.id = p.id LEFT JOIN one ON one.source = w.source AND one.ordered = w.ordered""")
def name_groups(spark, sf):
    return matching.name_groups(_people(spark, sf), "id", "name", "source")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2), r AS (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1)
SELECT l.part AS l_partkey, r.o_orderkey FROM l JOIN r ON l.l_orderkey = r.o_orderkey WHERE l.n = 1 AND r.n = 1 AND l_linenumber = 1""")
def unique_match(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_linenumber = 1").withColumn("o_key", F.col("l_orderkey"))
    orders = table(spark, sf, "orders").withColumn("o_key", F.col("o_orderkey"))
    return matching.unique_matches(lines, orders, ["o_key"], "l_partkey", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1996)")
def unmatched_anti(spark, sf):
    urgent = table(spark, sf, "orders").where((F.col("o_orderpriority") == "1-URGENT") & (F.year("o_orderdate") == 1996)).withColumnRenamed("o_custkey", "c_custkey")
    return matching.unmatched(table(spark, sf, "customer"), urgent, ["c_custkey"]).select("c_custkey", "c_name")


@query("""WITH h AS (SELECT sha256(text) AS k, doc_id FROM documents), a AS (SELECT k, min(doc_id) AS "left" FROM h GROUP BY k)
SELECT "left", doc_id AS "right", 'same-bytes' AS kind FROM h JOIN a USING (k) WHERE doc_id <> "left" """)
def pair_edges(spark, sf):
    return matching.pair_edges(table(spark, sf, "documents"), F.sha2("text", 256), "doc_id", "same-bytes")


@query("""WITH e AS (SELECT least(o_custkey, l_suppkey) AS "left", greatest(o_custkey, l_suppkey) AS "right", CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT "left", "right", CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'unknown' END AS kind FROM e GROUP BY 1, 2""")
def edge_conflicts(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = lines.select(F.col("o_custkey").alias("left"), F.col("l_suppkey").alias("right"), F.when(F.col("l_returnflag") == "R", "returned").otherwise("kept").alias("kind"))
    return matching.agreed_edges(edges)


@query("""WITH daily AS (SELECT event_id, user_id, event_type, round(value)::BIGINT AS v FROM events WHERE event_id % 2 = 0), ranked AS (SELECT event_id AS other, user_id, event_type, round(value)::BIGINT AS v FROM events WHERE event_id % 2 = 1),
d AS (SELECT user_id, event_type, v, count(*) AS n, min(event_id) AS event_id FROM daily GROUP BY ALL), r AS (SELECT user_id, event_type, v, count(*) AS n, min(other) AS other FROM ranked GROUP BY ALL),
m AS (SELECT event_id, other FROM d JOIN r USING (user_id, event_type, v) WHERE d.n = 1 AND r.n = 1),
near AS (SELECT user_id, event_type, string_agg(other::VARCHAR, ',' ORDER BY other) AS near FROM ranked GROUP BY ALL)
SELECT event_id, other AS match, NULL AS near FROM m UNION ALL SELECT event_id, NULL, near FROM daily LEFT JOIN near USING (user_id, event_type) WHERE event_id NOT IN (SELECT event_id FROM m)""")
def near_misses(spark, sf):
    events = table(spark, sf, "events").withColumn("v", F.round("value").cast("long"))
    out = matching.near_misses(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1").withColumnRenamed("event_id", "other"), ["user_id", "event_type", "v"], ["user_id", "event_type"], "event_id", "other")
    return out.select("event_id", "match", F.array_join(F.col("near").cast("array<string>"), ",").alias("near"))


@query("""WITH k AS (SELECT 'nation' AS route, c_nationkey::VARCHAR || c_mktsegment AS key, 'c' || c_custkey::VARCHAR AS id FROM customer
  UNION ALL SELECT 'balance', floor(c_acctbal / 10)::BIGINT::VARCHAR, 'c' || c_custkey::VARCHAR FROM customer),
a AS (SELECT 'nation' AS route, s_nationkey::VARCHAR || 'BUILDING' AS key, 's' || s_suppkey::VARCHAR AS id FROM supplier UNION ALL SELECT 'balance', floor(s_acctbal / 10)::BIGINT::VARCHAR, 's' || s_suppkey::VARCHAR FROM supplier)
SELECT a.id AS asked, k.id AS found, string_agg(DISTINCT a.route, ',' ORDER BY a.route) AS routes FROM a JOIN k USING (route, key) GROUP BY 1, 2""")
def multi_route_retrieval(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    ident = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    tens = lambda col: F.floor(F.col(col) / 10).cast("string")
    index = c.select(F.lit("nation").alias("route"), F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment").alias("key"), ident("c", "c_custkey").alias("id")).unionByName(c.select(F.lit("balance").alias("route"), tens("c_acctbal").alias("key"), ident("c", "c_custkey").alias("id")))
    asked = s.select(F.lit("nation").alias("route"), F.concat(F.col("s_nationkey").cast("string"), F.lit("BUILDING")).alias("key"), ident("s", "s_suppkey").alias("id")).unionByName(s.select(F.lit("balance").alias("route"), tens("s_acctbal").alias("key"), ident("s", "s_suppkey").alias("id")))
    return matching.routes(index, asked)


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'left' WHEN a.o_orderkey IS NULL THEN 'right' ELSE 'both' END AS side, a.status AS a1, b.status AS b1, a.priority AS a2, b.priority AS b2 FROM a FULL JOIN b USING (o_orderkey)),
u AS (SELECT o_orderkey, side, 'status' AS field, nullif(a1, '') AS before, nullif(b1, '') AS after FROM j UNION ALL SELECT o_orderkey, side, 'priority', nullif(a2, ''), nullif(b2, '') FROM j)
SELECT * FROM u WHERE side <> 'both' OR before IS DISTINCT FROM after""")
def field_differences(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    second = orders.where("o_orderkey % 3 = 0 or o_orderkey % 5 <> 0")  # no order is in neither
    second = second.withColumn("status", F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("status"))).withColumn("priority", F.when(F.col("o_orderkey") % 11 != 0, F.col("priority")))
    return matching.compared(orders.where("o_orderkey % 3 <> 0"), second, ["o_orderkey"], ["status", "priority"])


@query("""WITH n AS (SELECT p_partkey AS id, p_brand AS source, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 4 END AS d, p_name || p_type || p_size::VARCHAR AS name FROM part)
SELECT l.id AS "left", r.id AS "right", min(l.name) AS name FROM n l JOIN n r ON l.name = r.name AND l.source <> r.source AND l.id < r.id WHERE l.d IS NULL OR r.d IS NULL OR l.d = r.d GROUP BY 1, 2""")
def overlapping_leads(spark, sf):
    key = F.col("p_partkey")
    parts = table(spark, sf, "part").withColumn("d", F.when(key % 4 != 0, key % 4)).withColumn("names", F.array(F.concat("p_name", "p_type", F.col("p_size").cast("string"))))
    return matching.overlapping_leads(parts, "p_partkey", "p_brand", "names", "d")


@query("""SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3""")
def key_difference(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").subtract(table(spark, sf, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey")))


@query("""SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS statuses, bool_and(o_orderstatus IN ('F', 'O')) AS within, bool_or(o_orderstatus = 'P') AS touches FROM orders GROUP BY 1""")
def subset_checks(spark, sf):
    sets = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("s"))
    known, asked = F.array(F.lit("F"), F.lit("O")), F.array(F.lit("P"))
    return sets.select("o_custkey", F.array_join("s", "").alias("statuses"), (F.size(F.array_except("s", known)) == 0).alias("within"), F.arrays_overlap("s", asked).alias("touches"))


@query("""WITH o AS (SELECT *, p_size AS x, p_size + 4 AS x2, (p_partkey % 5)::DOUBLE AS dx FROM part)
SELECT p_partkey, CASE WHEN (4 - dx) / (4 + dx) >= 0.5 AND p_partkey % 3 <> 0 THEN 'agreed' WHEN (4 - dx) / (4 + dx) >= 0.5 THEN 'inspected' ELSE 'unresolved' END AS outcome FROM o""")
def verified_readings(spark, sf):
    box = lambda dx: F.struct((F.col("p_size") + dx).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("p_size") + dx + 4).cast("double").alias("x1"), F.lit(1.0).alias("y1"))
    parts = table(spark, sf, "part")
    first = parts.select("p_partkey", F.col("p_name").alias("v"), box(F.lit(0)).alias("box"))
    second = parts.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).otherwise("?").alias("v"), box(F.col("p_partkey") % 5).alias("box"))
    return matching.verified_readings(first, second, ["p_partkey"], "v", "box")
