"""Count, rate, routing and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.scalars import backoff, compatible, decimal_comma, iso_date, performance
from tesserae.operators import routing, summaries
from tesserae.plans.registry import query
from tesserae.sources.tables import table


@query("""SELECT o_orderstatus, count(*) AS orders, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())""")
def status_counts_total(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.groupingSets([["o_orderstatus"], []], "o_orderstatus").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("""SELECT user_id % 100 AS route, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'refund') AS refund FROM events GROUP BY 1""")
def pivot_zero_filled(spark, sf):
    return summaries.pivoted(table(spark, sf, "events").withColumn("route", F.col("user_id") % 100), ["route"], "event_type", ["view", "click", "refund"])


@query("""SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY 1""")
def zero_filled_counts(spark, sf):
    counts = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    nation = table(spark, sf, "nation")
    return summaries.zero_filled(counts, nation, ["n_nationkey"], "suppliers").join(nation.select("n_nationkey", "n_name"), "n_nationkey").select("n_name", "suppliers")


@query("""SELECT nation AS key, sum(n)::BIGINT AS n FROM (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY 1""")
def merged_counts(spark, sf):
    one = lambda t, c: table(spark, sf, t).groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n"))
    return summaries.merged_counts(one("customer", "c_nationkey"), one("supplier", "s_nationkey"), key="key", value="n")


_CASES = """WITH c AS (SELECT lang, CASE WHEN quality = 1 THEN 'match' ELSE 'no-match' END AS truth,
  CASE WHEN n_chars < 300 THEN 'abstain' WHEN n_chars > 15000 THEN 'error' WHEN contains(text, '%') OR contains(text, '!!') OR contains(text, '|') THEN 'no-match' ELSE 'match' END AS outcome FROM documents JOIN labels USING (doc_id))"""


@query(_CASES + """, k AS (SELECT lang, count(*) AS cases, count(*) FILTER (truth = 'match' AND outcome = 'match') AS true_match, count(*) FILTER (truth = 'no-match' AND outcome = 'match') AS false_match,
  count(*) FILTER (truth = 'no-match' AND outcome = 'no-match') AS true_no_match, count(*) FILTER (truth = 'match' AND outcome = 'no-match') AS false_no_match, count(*) FILTER (outcome = 'abstain') AS abstained,
  count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (truth = 'match') AS positives FROM c GROUP BY 1)
SELECT *, CASE WHEN positives > 0 THEN true_match::DOUBLE / positives END AS recall, CASE WHEN true_match + false_match > 0 THEN true_match::DOUBLE / (true_match + false_match) END AS precision,
  CASE WHEN cases > 0 THEN (cases - abstained - errors)::DOUBLE / cases END AS coverage FROM k""")
def confusion_metrics(spark, sf):
    n = F.col("n_chars")
    junk = F.contains("text", F.lit("%")) | F.contains("text", F.lit("!!")) | F.contains("text", F.lit("|"))
    outcome = F.when(n < 300, "abstain").when(n > 15000, "error").when(junk, "no-match").otherwise("match")
    cases = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", F.when(F.col("quality") == 1, "match").otherwise("no-match").alias("truth"), outcome.alias("outcome"))
    return summaries.confusion(cases, "truth", "outcome", "lang")


@query("""SELECT event_type, count(v) AS measured, count(*) FILTER (v IS NULL) AS unknown, sum(v)::BIGINT AS total, avg(v) AS mean, quantile_disc(v, 0.5) AS median, quantile_disc(v, 0.95) AS p95
FROM (SELECT event_type, CASE WHEN event_id % 9 <> 0 THEN floor(value * 10)::BIGINT END AS v FROM events) GROUP BY 1""")
def percentile_nearest_rank(spark, sf):
    v = F.when(F.col("event_id") % 9 != 0, F.floor(F.col("value") * 10))
    return summaries.latency(table(spark, sf, "events").withColumn("v", v), "v", "event_type")


@query("""SELECT user_id, CASE WHEN count(*) FILTER (a IS NULL) = 0 AND count(DISTINCT c) = 1 THEN sum(a)::BIGINT END AS total, CASE WHEN count(*) FILTER (a IS NULL) = 0 AND count(DISTINCT c) = 1 THEN min(c) END AS currency
FROM (SELECT user_id, CASE WHEN event_type <> 'error' THEN round(value)::BIGINT END AS a, CASE WHEN event_id % 4 = 0 THEN 'EUR' ELSE 'USD' END AS c FROM events) GROUP BY 1""")
def cost_by_currency(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.when(F.col("event_type") != "error", F.round("value").cast("long")).alias("a"), F.when(F.col("event_id") % 4 == 0, "EUR").otherwise("USD").alias("c"))
    return summaries.cost(rows, "a", "c", "user_id")


@query("""WITH b AS (SELECT o_custkey, o_orderpriority, max(v) AS n, count(DISTINCT v) > 1 AS bad FROM (SELECT *, floor(o_totalprice / 100000)::BIGINT AS v FROM orders) GROUP BY 1, 2) SELECT o_custkey, sum(n)::BIGINT AS total, bool_or(bad) AS conflict FROM b GROUP BY 1""")
def once_per_basis(spark, sf):
    return summaries.once_per_basis(table(spark, sf, "orders").withColumn("v", F.floor(F.col("o_totalprice") / 100000)), ["o_custkey"], "o_orderpriority", "v")


@query("SELECT r_name, sha256(string_agg(n_name, ',' ORDER BY n_name)) AS digest, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']' AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def state_digest(spark, sf):
    rows = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    names = rows.groupBy("r_name").agg(F.to_json(F.array_sort(F.collect_list("n_name"))).alias("names"))
    return summaries.ordered_digest(rows, "n_name", "r_name").join(names, "r_name")


@query("SELECT count(*) AS groups, sum(n)::BIGINT AS members, sum(n * (n - 1) // 2)::BIGINT AS pairs FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def pair_denominators(spark, sf):
    return summaries.pairs_within(table(spark, sf, "orders"), "o_custkey")


@query("""WITH claims AS (SELECT page_id, 'com' AS parser, contains(url, '.com/') AS claimed FROM pages WHERE contains(url, 'example') UNION ALL SELECT page_id, 'numbered', regexp_matches(url, '[0-9]{3}') FROM pages WHERE page_id % 4 <> 0),
k AS (SELECT page_id, count(*) AS n, count(*) FILTER (claimed) AS c FROM claims GROUP BY 1)
SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'unexamined' WHEN n IS NULL THEN 'unsupported' WHEN c = 0 THEN 'unclaimed' WHEN c = 1 THEN 'routed' ELSE 'ambiguous' END AS status FROM pages LEFT JOIN k USING (page_id)""")
def routing_status(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", (F.col("page_id") % 10 != 0).alias("examined"))
    one = pages.where(F.contains("url", F.lit("example"))).select("page_id", F.lit("com").alias("parser"), F.contains("url", F.lit(".com/")).alias("claimed"))
    two = pages.where("page_id % 4 <> 0").select("page_id", F.lit("numbered").alias("parser"), F.col("url").rlike("[0-9]{3}").alias("claimed"))
    return routing.routed(pages, one.unionByName(two), ["page_id"]).select("page_id", "status")


@query("""SELECT p_brand || p_name || p_size::VARCHAR AS batch, count(*) AS batches, CASE WHEN count(DISTINCT p_type) = 1 THEN 'merged' ELSE 'conflict' END AS status FROM part GROUP BY 1""")
def batch_merge(spark, sf):
    return routing.merged_batches(table(spark, sf, "part").withColumn("batch", F.concat("p_brand", "p_name", F.col("p_size").cast("string"))), "batch", "p_type")


@query("""SELECT 'lineitem-order' AS rule, l_partkey::VARCHAR AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 'label-document', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'es') UNION ALL SELECT 'empty-text', doc_id::VARCHAR FROM documents WHERE n_chars < 20""")
def referential_violations(spark, sf):
    lines, orders, docs, labels = (table(spark, sf, t) for t in ("lineitem", "orders", "documents", "labels"))
    return routing.violations(
        ("lineitem-order", routing.dangling(lines, orders.where("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey", "l_partkey")),
        ("label-document", routing.dangling(labels, docs.where("lang <> 'es'"), "doc_id", "doc_id", "doc_id")),
        ("empty-text", docs.where("n_chars < 20").select("doc_id")),
    )


@query("""SELECT event_id, coalesce(a >= 0.6 AND a - greatest(b, c) >= 0.2, false) AS clear FROM (SELECT event_id, (event_id % 101) / 100.0 AS a, (1 - (event_id % 101) / 100.0) * 0.75 AS b, (1 - (event_id % 101) / 100.0) * 0.25 AS c FROM events)""")
def clear_choices(spark, sf):
    a = (F.col("event_id") % 101) / 100.0
    chances = F.create_map(F.lit("a"), a, F.lit("b"), (1 - a) * 0.75, F.lit("c"), (1 - a) * 0.25)
    return table(spark, sf, "events").select("event_id", routing.clear_choice(chances, F.lit("a"), 0.6, 0.2).alias("clear"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso, o_custkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_custkey % 7 = o_orderkey % 5 AS agrees FROM orders""")
def date_rules(spark, sf):
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    written = F.when(F.col("o_orderkey") % 4 != 0, day).otherwise(F.concat(F.lit("99"), F.substring(day, 3, 8)))
    a, b = F.col("o_custkey") % 7, F.col("o_orderkey") % 5
    return table(spark, sf, "orders").select("o_orderkey", iso_date(written, "dd/MM/yyyy").alias("iso"), compatible(F.when(a != 0, a), F.when(b != 0, b)).alias("agrees"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE + 0.5 ELSE (p_size % 60)::DOUBLE END AS amount, CASE WHEN p_size % 2 = 0 THEN 'm' ELSE 's' END AS unit, CASE WHEN p_size % 2 = 1 THEN p_partkey % 10 END::INTEGER AS minutes,
  CASE WHEN p_size % 3 = 0 THEN 'NR' END AS badge, CASE WHEN p_size <= 1 THEN 0.0 ELSE 30.0 * pow(2, p_size - 2) END AS delay FROM part""")
def performances(spark, sf):
    size = F.col("p_size")
    badge = F.when(size % 3 == 0, " NR").otherwise("")
    text = F.when(size % 2 == 0, F.concat(size.cast("string"), F.lit(",5 m"), badge)).otherwise(F.concat((F.col("p_partkey") % 10).cast("string"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"), badge))
    p = performance(text)
    return table(spark, sf, "part").withColumn("p", p).select("p_partkey", F.col("p.amount").cast("double").alias("amount"), "p.unit", "p.minutes", "p.badge", backoff(size, 30.0).alias("delay"))


@query("""SELECT c_custkey, replace(replace(c_acctbal::DECIMAL(12,2)::VARCHAR, '.', ','), ',', '.')::DOUBLE AS amount FROM customer""")
def decimal_commas(spark, sf):
    written = F.translate(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), ".", ",")
    return table(spark, sf, "customer").select("c_custkey", decimal_comma(written).cast("double").alias("amount"))
