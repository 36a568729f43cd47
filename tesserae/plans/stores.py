"""Queries over versioned tables, memoised derivations and projections kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.operators import sporting
from tesserae.plans.registry import query
from tesserae.sources import derived
from tesserae.sources.stored import shared_folder
from tesserae.sources.tables import table
from tesserae.sources.versions import Store, corpus


def _store(spark, name):
    return Store(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


@query("""SELECT c_custkey AS job_id, count_if(o_orderstatus <> 'P')::BIGINT AS pinned, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus <> 'P'), 0), 2) AS pinned_total, count(*) AS now
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def pinned_load(spark, sf):
    """Customers and orders are loaded as of a commit, while the pending orders are appended after it."""
    store = _store(spark, "corpus")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("ordinal"), "o_orderstatus", "o_totalprice")
    first = store.commit(store.pin(), append={"extractions": table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), "c_name"), "observations": orders.where("o_orderstatus <> 'P'")})
    second = store.commit(first, append={"observations": orders.where("o_orderstatus = 'P'")})
    seen = lambda pinned: corpus(pinned, second.rows("observations"))
    old = seen(first).groupBy("job_id").agg(F.count("*").alias("pinned"), F.round(F.sum("o_totalprice"), 2).alias("pinned_total"))
    new = seen(second).groupBy("job_id").agg(F.count("*").alias("now"))
    return new.join(old, "job_id", "left").fillna(0, ["pinned", "pinned_total"]).select("job_id", "pinned", "pinned_total", "now")


@query("""SELECT doc_id, CASE WHEN length(text) < 400 THEN 'failed' ELSE 'committed' END AS status, CASE WHEN length(text) >= 400 THEN length(text) || ' characters' END AS value,
  CASE WHEN length(text) < 400 THEN 'too short' END AS error, CASE WHEN length(text) >= 400 THEN sha256(length(text) || ' characters') END AS value_sha256 FROM documents""")
def derived_results(spark, sf):
    """Documents are derived by language first, then all: only texts without a receipt are computed the second time."""
    store = _store(spark, "derived")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    size = F.char_length("text")
    produce = lambda jobs: jobs.select("job", F.when(size >= 400, F.concat(size.cast("string"), F.lit(" characters"))).alias("value"), F.when(size < 400, "too short").alias("error"))
    derived.derive(store, docs.where("lang = 'en'"), ["text"], "length/1", "text/1", produce)
    _, results = derived.derive(store, docs, ["text"], "length/1", "text/1", produce)
    return results.select("doc_id", "status", "value", "error", "value_sha256")


@query("""WITH d AS (SELECT user_id, arg_max(event_type, event_id) AS last, arg_max(value, event_id) AS score, max(event_id) AS revision FROM events WHERE event_type <> 'view' GROUP BY 1),
r AS (SELECT user_id, count(*) AS reviews FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, revision, score, coalesce(reviews, 0) AS reviews FROM d LEFT JOIN r USING (user_id) WHERE last <> 'error' AND score >= 5""")
def public_projection(spark, sf):
    """A view of users by their last decision and their reviews, refreshed after each of three batches of events."""
    events = table(spark, sf, "events").select("user_id", F.col("event_id").alias("revision"), "event_type", F.col("value").alias("score"))
    policies = spark.range(1).select(F.col("id").alias("revision"), F.lit(5.0).alias("least"))

    def compute(ledgers):
        newest = ledgers["decisions"].groupBy("user_id").agg(F.max(F.struct("revision", "event_type", "score")).alias("d"))
        notes = ledgers["reviews"].groupBy("user_id").agg(F.count("*").alias("reviews"))
        least = F.broadcast(ledgers["policies"].agg(F.max_by("least", "revision").alias("least")))  # one row
        return newest.join(notes, "user_id", "left").join(least).where("d.event_type <> 'error' and d.score >= least").select("user_id", "d.revision", "d.score", F.coalesce("reviews", F.lit(0).cast("long")).alias("reviews"))

    view = sporting.Projection(_store(spark, "view"), "users", "user_id", ("decisions", "reviews"), compute)
    end = events.agg(F.max("revision")).first()[0]
    for share in (0.5, 0.99, 1.0):
        now = events.where(F.col("revision") <= int((end or 0) * share))
        view.refresh({"decisions": now.where("event_type <> 'view'"), "reviews": now.where("event_type = 'view'"), "policies": policies})
    return view.rows()


@query("""WITH d AS (SELECT 'd' || o_orderkey AS id, o_custkey AS job_id, o_orderkey % 2 AS ordinal, o_orderkey AS revision, CASE WHEN o_orderstatus = 'P' THEN 'revoke' ELSE 'validate' END AS action,
  CASE WHEN o_orderpriority LIKE '5%' THEN 'extraction-publication/1' ELSE 'extraction-publication/2' END AS policy, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS seen FROM orders),
r AS (SELECT c_custkey AS job_id, 0 AS ordinal, 1 AS revision FROM customer WHERE c_acctbal < 0),
t AS (SELECT sha256('decisions:' || (SELECT count(*) || ':' || max(revision) FROM d) || ',reviews:' || (SELECT count(*) || ':' || coalesce(max(revision), 0) FROM r)) AS token),
last AS (SELECT *, max(revision) OVER (PARTITION BY job_id, ordinal) = revision AS newest FROM d)
SELECT 'r' || o_orderkey AS result_id, sha256(id) AS correction_version, (SELECT token FROM t) AS token FROM orders JOIN last ON id = 'd' || o_orderkey
LEFT JOIN r ON r.job_id = last.job_id AND r.ordinal = last.ordinal WHERE newest AND action = 'validate' AND policy = 'extraction-publication/2' AND seen = coalesce(r.revision, 0) AND o_orderkey % 7 <> 0""")
def public_results_current(spark, sf):
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    policy = F.when(F.col("o_orderpriority").startswith("5"), sporting.POLICIES[0]).otherwise(sporting.POLICIES[1]).alias("policy_version")
    name = F.concat(F.lit("d"), key.cast("string"))
    decisions = orders.select(
        name.alias("id"), F.col("o_custkey").alias("job_id"), (key % 2).alias("ordinal"), key.alias("revision"), F.when(F.col("o_orderstatus") == "P", "revoke").otherwise("validate").alias("action"), policy,
        F.when(key % 5 == 0, 1).otherwise(0).cast("long").alias("review_revision"),
    )
    reviews = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("job_id"), F.lit(0).cast("long").alias("ordinal"), F.lit(1).cast("long").alias("revision"))
    policies = spark.range(2).select(F.col("id").alias("revision"), F.element_at(F.array(*map(F.lit, sporting.POLICIES)), (F.col("id") + 1).cast("int")).alias("policy_version"))
    token = sporting.freshness({"decisions": decisions, "reviews": reviews})
    cache = orders.join(F.broadcast(token)).select(
        F.concat(F.lit("r"), key.cast("string")).alias("result_id"), F.lit("n").alias("source_name"), F.lit("i").alias("identity_id"), F.lit("b").alias("body"), name.alias("validation_id"), policy, F.when(key % 7 == 0, "stale").otherwise(F.col("token")).alias("token")
    )
    return sporting.public_results(cache, decisions, reviews, policies, token).join(F.broadcast(token)).select("result_id", "correction_version", "token")


@query("""WITH c AS (SELECT c_mktsegment AS cohort_id, 'c' || c_custkey AS result_id, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS score, CASE WHEN c_custkey % 9 <> 0 THEN n_name END AS country, CASE WHEN c_custkey % 9 <> 0 THEN r_name END AS continent
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')),
n AS (SELECT cohort_id, country, score, rank() OVER (PARTITION BY cohort_id, country ORDER BY score DESC) AS k, result_id FROM c WHERE score IS NOT NULL AND country IS NOT NULL),
t AS (SELECT cohort_id, continent, score, rank() OVER (PARTITION BY cohort_id, continent ORDER BY score DESC) AS k, result_id FROM c WHERE score IS NOT NULL AND continent IS NOT NULL),
w AS (SELECT cohort_id, rank() OVER (PARTITION BY cohort_id ORDER BY score DESC) AS k, result_id FROM c WHERE score IS NOT NULL)
SELECT c.cohort_id, c.result_id, CASE WHEN w.k IS NULL THEN 'withheld' ELSE 'ranked' END AS status, n.k AS national_rank, CASE WHEN c.country IS NOT NULL THEN (SELECT count(*) FROM c x WHERE x.cohort_id = c.cohort_id AND x.country = c.country AND x.score IS NOT NULL) END AS national_peers,
  t.k AS continental_rank, CASE WHEN c.country IS NOT NULL THEN (SELECT count(*) FROM c x WHERE x.cohort_id = c.cohort_id AND x.continent = c.continent AND x.score IS NOT NULL) END AS continental_peers, w.k AS international_rank,
  (SELECT count(*) FROM c x WHERE x.cohort_id = c.cohort_id AND x.score IS NOT NULL) AS international_peers, sha256(c.cohort_id || chr(31) || (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = c.cohort_id) || chr(31) || 'sanction_scope=default') AS authority
FROM c LEFT JOIN n USING (result_id) LEFT JOIN t USING (result_id) LEFT JOIN w USING (result_id)""")
def sporting_comparison(spark, sf):
    """Customers as results, market segments as cohorts: one is withdrawn, one has a member whose text has changed."""
    customers = table(spark, sf, "customer")
    places = F.broadcast(table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    known = F.col("c_custkey") % 9 != 0
    results = customers.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("result_id"), F.col("c_name").alias("body"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("score"), F.when(known, F.col("n_name")).alias("country"), F.when(known, F.col("r_name")).alias("continent"),
    )
    token = sporting.freshness({"customers": customers.select(F.col("c_custkey").alias("revision"))})
    # the publication of each cohort, and the withdrawal of one
    published = customers.groupBy(F.col("c_mktsegment").alias("cohort_id")).agg(F.count("*").cast("int").alias("expected_members"), F.min("c_custkey").alias("revision")).withColumn("action", F.lit("publish"))
    withdrawn = published.where("cohort_id = 'MACHINERY'").withColumns({"revision": F.col("revision") + 10**12, "action": F.lit("withdraw")})
    events = published.unionByName(withdrawn).join(F.broadcast(token)).withColumns({"policy_version": F.lit("v1"), "policy_revision": F.lit(1), "publication_revision": F.lit(1)})
    body = F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_custkey") % 10 == 0), "as it was").otherwise(F.col("c_name"))
    named = customers.select(F.col("c_mktsegment").alias("cohort_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("result_id"), body.alias("source_body"))
    members = named.join(published.select("cohort_id", "revision"), "cohort_id").select("revision", "result_id", "source_body")
    ledger = spark.range(1, 2).withColumnRenamed("id", "revision")
    shown = sporting.sporting_view(events, members, results, ledger, ledger, token, "v1")
    ranked = sporting.sporting_ranks(shown.select("cohort_id", "revision", "result_id").join(results.drop("body"), "result_id"))
    ranks = [f"{s}_{c}" for s in sporting.SCOPES for c in ("rank", "peers")]
    return ranked.select("cohort_id", "result_id", "status", *ranks, sporting.authority_token(F.col("cohort_id"), F.col("revision"), {"sanction_scope": "default"}).alias("authority"))
