"""Score, rank and cohort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.reasons import reasons
from tesserae.operators import ranking
from tesserae.plans.registry import query
from tesserae.sources.tables import table

_ATTEMPTS = """WITH attempts AS (
  SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR AS id,
    CASE l_returnflag WHEN 'A' THEN 'sta' WHEN 'N' THEN 'dynamic' ELSE 'depth' END AS discipline,
    CASE WHEN l_returnflag = 'R' THEN l_linestatus ELSE 'u' END AS unit, CAST(l_quantity AS DECIMAL(18,6)) AS value, l_discount < 0.09 AS reviewed
  FROM lineitem
), checked AS (
  SELECT *, count(*) OVER (PARTITION BY id) > 1 AS repeated FROM attempts
), judged AS (
  SELECT *, NOT repeated AND coalesce(reviewed, false) AND value > 0 AS ranked,
    CASE WHEN NOT repeated AND coalesce(reviewed, false) AND value > 0 THEN floor(value)::BIGINT * CASE discipline WHEN 'sta' THEN 2 WHEN 'dynamic' THEN 5 ELSE 10 END END AS tenths,
    concat_ws(',', CASE WHEN repeated THEN 'duplicate-id' END, CASE WHEN NOT reviewed THEN 'not-reviewed' END, CASE WHEN value <= 0 THEN 'final-not-positive' END) AS found
  FROM checked
), mixed AS (SELECT discipline, min(unit) <> max(unit) AS mixed FROM judged WHERE ranked GROUP BY 1)
SELECT id, discipline, (tenths / 10.0)::DOUBLE AS score,
  CASE WHEN ranked THEN rank() OVER (PARTITION BY ranked ORDER BY tenths DESC) END AS common_rank,
  CASE WHEN ranked AND NOT mixed THEN rank() OVER (PARTITION BY discipline, ranked ORDER BY value DESC) END AS discipline_rank,
  CASE WHEN ranked AND mixed THEN 'mixed-final-units' ELSE found END AS reasons
FROM judged LEFT JOIN mixed USING (discipline)"""


@query(_ATTEMPTS)
def comparison_score(spark, sf):
    discipline = F.when(F.col("l_returnflag") == "A", "sta").when(F.col("l_returnflag") == "N", "dynamic").otherwise("depth")
    attempts = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"),
        discipline.alias("discipline"),
        F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).otherwise("u").alias("unit"),
        F.col("l_quantity").cast("decimal(18,6)").alias("value"),
        (F.col("l_discount") < 0.09).alias("reviewed"),
    )
    out = ranking.comparison_score(attempts)
    return out.select("id", "discipline", F.col("score").cast("double").alias("score"), "common_rank", "discipline_rank", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH j AS (SELECT *, o_orderstatus = 'P' AS filtered, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'other-scope' END, CASE WHEN o_totalprice < 50000 THEN 'imprecise' END,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'unreviewed' END) AS reasons FROM orders),
s AS (SELECT *, CASE WHEN filtered THEN 'excluded' WHEN reasons <> '' THEN 'withheld' ELSE 'ranked' END AS status, floor(o_totalprice / 1000) AS v FROM j)
SELECT o_orderkey, status, reasons, CASE WHEN status = 'ranked' THEN rank() OVER (PARTITION BY o_orderpriority, status ORDER BY v DESC) END AS rank,
  CASE WHEN status = 'ranked' THEN row_number() OVER (PARTITION BY o_orderpriority, status ORDER BY v DESC, o_custkey, o_orderkey) END AS position FROM s""")
def attempt_comparison(spark, sf):
    orders = table(spark, sf, "orders").withColumn("v", F.floor(F.col("o_totalprice") / 1000))
    rules = [("imprecise", F.col("o_totalprice") < 50000), ("unreviewed", F.col("o_orderpriority") == "5-LOW")]
    out = ranking.attempt_comparison(orders, rules, [("other-scope", F.col("o_orderstatus") == "P")], "v", ["o_custkey", "o_orderkey"], "o_orderpriority")
    return out.select("o_orderkey", "status", F.array_join("reasons", ",").alias("reasons"), "rank", "position")


@query("""SELECT c_custkey, n_name AS nation, r_name AS region, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS peer_rank, count(c_acctbal) OVER (PARTITION BY c_nationkey) AS peers
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def peer_rank_denominator(spark, sf):
    places = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return ranking.peer_ranks(rows, "c_acctbal", "c_nationkey").select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "peer_rank", "peers")


@query("""SELECT q.p_partkey, 1 + (SELECT count(*) FROM part p WHERE p.p_brand = q.p_brand AND p.p_retailprice > q.p_size * 20.0) AS hypothetical_rank FROM part q""")
def hypothetical_rank(spark, sf):
    parts = table(spark, sf, "part")
    asked = parts.withColumn("asked", F.col("p_size") * 20.0)
    return ranking.hypothetical_rank(parts, asked, "p_retailprice", "asked", "p_brand").select("p_partkey", "hypothetical_rank")


@query("""SELECT s_suppkey, s_acctbal, (SELECT count(*) + 1 FROM supplier b WHERE b.s_acctbal < a.s_acctbal) AS ascending_rank FROM supplier a""")
def ascending_rank(spark, sf):
    return ranking.global_rank(table(spark, sf, "supplier"), "s_acctbal", "ascending_rank", descending=False).select("s_suppkey", "s_acctbal", "ascending_rank")


@query("""SELECT a.c_custkey, count(b.c_custkey) AS peers_in_scope FROM customer a JOIN nation na ON na.n_nationkey = a.c_nationkey
JOIN nation nb ON CASE a.c_mktsegment WHEN 'BUILDING' THEN nb.n_nationkey = na.n_nationkey WHEN 'MACHINERY' THEN nb.n_regionkey = na.n_regionkey ELSE true END
JOIN customer b ON b.c_nationkey = nb.n_nationkey GROUP BY 1""")
def peers_in_scope(spark, sf):
    nations = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    people = table(spark, sf, "customer")
    scope = F.when(F.col("c_mktsegment") == "BUILDING", "national").when(F.col("c_mktsegment") == "MACHINERY", "continental").otherwise("international")
    counts = people.groupBy(F.col("c_nationkey").alias("country")).agg(F.count("*").alias("n")).join(F.broadcast(nations), F.col("country") == F.col("n_nationkey")).select("country", F.col("n_regionkey").alias("continent"), "n")
    pairs = nations.crossJoin(F.broadcast(counts)).crossJoin(spark.createDataFrame([("national",), ("continental",), ("international",)], "scope string"))  # 25 by 25 by 3
    sizes = pairs.where(ranking.scope_match(F.col("scope"), F.col("n_nationkey"), F.col("country"), F.col("n_regionkey"), F.col("continent"))).groupBy("scope", "n_nationkey").agg(F.sum("n").alias("peers_in_scope"))
    return people.select("c_custkey", scope.alias("scope"), F.col("c_nationkey").alias("n_nationkey")).join(F.broadcast(sizes), ["scope", "n_nationkey"]).select("c_custkey", "peers_in_scope")


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_retailprice <= 0 THEN 'no-price' END, CASE WHEN p_size > 40 THEN 'oversize' END, CASE WHEN p_retailprice > 1500 THEN 'expensive' END,
 CASE WHEN p_brand = 'Brand#11' THEN 'brand' END) AS failed FROM part""")
def eligibility_reasons(spark, sf):
    found = reasons(("no-price", F.col("p_retailprice") <= 0), ("oversize", F.col("p_size") > 40), ("expensive", F.col("p_retailprice") > 1500), ("brand", F.col("p_brand") == "Brand#11"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(found, ",").alias("failed"))
