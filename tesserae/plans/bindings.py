"""Queries of attempts' eligibility, rosters of routes and leads, and decisions bound to evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import scalars
from tesserae.operators import eligibility, evidence, inspector, matching, paging, roster
from tesserae.plans.registry import query
from tesserae.sources.tables import table

_SCOPE = eligibility.Scope(
    2026, "DNF", "pool", ("CMAS", "AIDA"), ("FRA", "ITA"), {"CMAS": ("category", "SENIORS [–—-] WOMEN"), "AIDA": ("gender", "Women")}, {"CMAS": "2026-06-11"}, ("AIDA",), {"AIDA": "attempts"}
)
#: Each reason of the query and the rows (DuckDB condition) that the stand-in breaks for it, in the operator's order.
_BROKEN = [
    ("missing-exact-reference", "k % 41 = 0"), ("unselected-source-view", "k % 37 = 0"), ("source-context-conflict", "k % 31 = 0 OR (k % 43 = 0 AND f <> 'FIPSAS')"),
    ("federation-filter", "f = 'FIPSAS'"), ("environment-filter", "k % 29 = 0"), ("discipline-filter", "k % 23 = 0"), ("year-filter", "k % 43 = 0"),
    ("category-filter", "f = 'FIPSAS' OR k % 19 = 0"), ("representation-filter", "k % 47 = 0"), ("unparsed", "k % 53 = 0"), ("not-attempt-view", "k % 59 = 0 AND f = 'AIDA'"),
    ("unverified-source-authority", "k % 61 = 0"), ("unverified-source-finality", "k % 67 = 0"), ("unverified-sanction", "k % 71 = 0"), ("unverified-review", "k % 73 = 0"),
    ("unverified-outcome", "k % 79 = 0"), ("unresolved-attempt-relationship", "k % 83 = 0"), ("unverified-final-distance", "q = 1"),
    ("unverified-final-precision", "q % 7 = 0"), ("unverified-final-conversion", "k % 89 = 0"), ("source-status-conflict", "k % 97 = 0"), ("source-conflict", "k % 17 = 0"),
]
_FILTERED = " OR ".join(f"({condition})" for name, condition in _BROKEN if name in eligibility.FILTERS)
_REASONS = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in _BROKEN)


def _attempts(spark, sf):
    """Order lines as attempts; each rule of eligibility is broken by some."""
    k = F.col("l_orderkey")
    broken = lambda n, good, bad=None: F.when(k % n != 0, good).otherwise(F.lit(bad).cast("string"))
    federation = F.when(k % 3 == 0, "CMAS").when(k % 3 == 1, "AIDA").otherwise("FIPSAS")
    sha = F.lit("0" * 64)
    quantity = F.col("l_quantity").cast("decimal(12,2)")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", broken(41, "job", " ").alias("job_id"), F.col("l_linenumber").alias("ordinal"), F.lit("c").alias("candidate_id"), sha.alias("source_sha256"), sha.alias("artifact_sha256"),
        federation.alias("federation"), F.lit("2026-06-11").alias("view_id"), (k % 37 != 0).alias("view_selected"), broken(29, "pool", "sea").alias("environment"), broken(61, "official-results").alias("authority"),
        broken(67, "verified-final", "provisional").alias("finality"), broken(71, "eligible").alias("sanction"), F.when(k % 31 != 0, federation).alias("parsed_federation"), broken(43, "2026-06-11", "2025-06-11").alias("event_date"),
        broken(23, "DNF", "DYN").alias("discipline"), broken(19, "SENIORS – WOMEN", "JUNIORS").alias("category"), broken(19, "Women", "Men").alias("gender"), broken(47, "ITA").alias("representation"),
        broken(53, "parsed", "unparsed").alias("parse_status"), broken(59, "attempts", "ranking").alias("source_family"), F.when(k % 97 == 0, "DQ").alias("source_status"), broken(73, "verified").alias("review"),
        broken(79, "finally-valid", "disqualified").alias("outcome"), broken(83, "distinct", "unknown").alias("relationship"), (k % 17 != 0).alias("conflict_resolved"),
        F.when(F.col("l_quantity") % 7 == 0, quantity + F.lit("0.55").cast("decimal(12,2)")).otherwise(quantity).alias("final_value"), F.when(F.col("l_quantity") != 1, "m").alias("final_unit"),
        F.lit("verified-post-penalty").alias("final_basis"), F.lit(1).alias("final_places"), broken(89, "verified").alias("conversion"),
    )


@query(f"""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_quantity::BIGINT AS q, CASE l_orderkey % 3 WHEN 0 THEN 'CMAS' WHEN 1 THEN 'AIDA' ELSE 'FIPSAS' END AS f FROM lineitem),
c AS (SELECT *, count(*) OVER (PARTITION BY k, n, p) > 1 AS twice, k % 13 = 0 AND n = 1 AS other FROM a)
SELECT k AS l_orderkey, n AS l_linenumber, p AS l_partkey, concat_ws(',', {_REASONS}, CASE WHEN twice THEN 'duplicate-reference' END, CASE WHEN other THEN 'non-selected-source-claim' END) AS reasons,
  CASE WHEN {_FILTERED} THEN 'excluded' WHEN concat_ws(',', {_REASONS}) <> '' OR twice OR other THEN 'withheld' ELSE 'ranked' END AS status FROM c""")
def attempt_eligibility(spark, sf):
    rows = _attempts(spark, sf)
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    others = rows.where("l_orderkey % 13 = 0 and l_linenumber = 1").select(*key)
    return eligibility.attempt_accounts(rows, _SCOPE, key, others).select(*key, F.array_join("reasons", ",").alias("reasons"), "status")


@query(f"""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_extendedprice AS price, l_quantity AS qty, l_quantity::BIGINT AS q, CASE l_orderkey % 3 WHEN 0 THEN 'CMAS' WHEN 1 THEN 'AIDA' ELSE 'FIPSAS' END AS f FROM lineitem),
j AS (SELECT *, CASE WHEN {_FILTERED} THEN 'excluded' WHEN concat_ws(',', {_REASONS}) <> '' THEN 'withheld' ELSE 'ranked' END AS comparison, CASE n % 4 WHEN 1 THEN 'ITA' WHEN 2 THEN 'FRA' WHEN 3 THEN 'JPN' END AS country, CASE n % 4 WHEN 1 THEN 'Europe' WHEN 2 THEN 'Europe' WHEN 3 THEN 'Asia' END AS continent FROM a WHERE k % 19 <> 0),
v AS (SELECT *, CASE WHEN comparison = 'ranked' THEN q * 0.5 END AS score FROM j)
SELECT k, n, p, s, price, qty, comparison, score::DOUBLE AS score, CASE WHEN score IS NOT NULL AND country IS NOT NULL THEN rank() OVER (PARTITION BY country ORDER BY score DESC NULLS LAST) END AS national_rank, CASE WHEN country IS NOT NULL THEN count(score) OVER (PARTITION BY country) END AS national_peers,
  CASE WHEN score IS NOT NULL AND country IS NOT NULL THEN rank() OVER (PARTITION BY continent ORDER BY score DESC NULLS LAST) END AS continental_rank, CASE WHEN country IS NOT NULL THEN count(score) OVER (PARTITION BY continent) END AS continental_peers,
  CASE WHEN score IS NOT NULL THEN rank() OVER (ORDER BY score DESC NULLS LAST) END AS international_rank, count(score) OVER () AS international_peers FROM v""")
def attempt_inspection(spark, sf):
    """Attempts with their claims apart, bound by full reference, compared, scored and ranked in three scopes; women only."""
    n = F.col("l_linenumber")
    own = F.concat_ws("/", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")))
    rows = _attempts(spark, sf).withColumn("candidate_id", own)
    observations = rows.drop(*(c for c in inspector.CLAIM if c in rows.columns))
    claims = rows.select(
        *inspector.REFERENCE, *(c for c in inspector.CLAIM if c not in ("country", "continent")), F.when(n % 4 == 1, "ITA").when(n % 4 == 2, "FRA").when(n % 4 == 3, "JPN").alias("country"), F.when(n % 4 == 3, "Asia").when(n % 4 > 0, "Europe").alias("continent")
    )
    out = inspector.inspect(observations, claims, _SCOPE, "dynamic", {"gender": "Women", "review": "all"}).all
    part = lambda i, kind: F.split("candidate_id", "/")[i].cast(kind)
    kinds = (("k", "long"), ("n", rows.schema["l_linenumber"].dataType), ("p", "long"), ("s", "long"), ("price", "double"), ("qty", "double"))
    return out.select(*(part(i, kind).alias(c) for i, (c, kind) in enumerate(kinds)), "comparison", F.col("score").cast("double").alias("score"), *(f"{s}_{c}" for s in ("national", "continental", "international") for c in ("rank", "peers")))


def _roster(spark, sf):
    """Customers as routes of the newest roster, orders as their leads."""
    routes = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"))
    year = F.when(F.col("o_orderkey") % 5 != 0, F.year("o_orderdate"))
    leads = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("route_id"), F.col("o_orderstatus").alias("status"), year.alias("competition_year"),
        F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("competition_date"), F.col("o_orderpriority").alias("event_key"),
    )
    return routes, leads


_LEADS = """WITH l AS (SELECT o_orderkey AS id, o_custkey AS route_id, o_orderstatus AS status, CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate) END AS competition_year,
 CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS competition_date, o_orderpriority AS event_key FROM orders)"""


@query(_LEADS + """ SELECT c_custkey AS route_id, count(id) AS lead_count, count(*) FILTER (status = 'O') AS open_leads, count(*) FILTER (status = 'X') AS other_leads,
 count(*) FILTER (competition_year = 1996) AS y1996, count(*) FILTER (id IS NOT NULL AND competition_year IS NULL) AS unknown_year FROM customer LEFT JOIN l ON route_id = c_custkey GROUP BY 1""")  # fmt: skip
def roster_summary(spark, sf):
    found = roster.roster_summary(*_roster(spark, sf), ["F", "O", "P", "X"], ["1996", "unknown"])
    status, year = F.col("by_status"), F.col("by_year")
    return found.select("route_id", "lead_count", status["O"].alias("open_leads"), status["X"].alias("other_leads"), year["1996"].alias("y1996"), year["unknown"].alias("unknown_year"))


@query(_LEADS + """ SELECT id, route_id, row_number() OVER (ORDER BY route_id, coalesce(competition_year, 9999), coalesce(competition_date, ''), event_key, id) AS place FROM l
 WHERE status = 'O' AND competition_year IS NULL QUALIFY place <= 40""")  # fmt: skip
def roster_leads_page(spark, sf):
    from pyspark.sql import Window as W

    leads = roster.filtered_leads(_roster(spark, sf)[1], year="unknown", status="O", route_id=None)
    order = roster.lead_order()
    page = paging.page(leads, order, 40)  # a page's rows are numbered, 40 at most
    return page.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long")).select("id", "route_id", "place")


@query("""SELECT 'repeated-lead' AS problem, l_orderkey AS id FROM lineitem GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'unknown-route', l_orderkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0)""")
def roster_problems(spark, sf):
    routes = table(spark, sf, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("id"))  # the routes left out are the problem to find
    return roster.roster_problems(routes, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("route_id")))


@query("""WITH n AS (SELECT max(CASE WHEN source LIKE 'src%' THEN substr(source, 4)::BIGINT END) AS newest FROM documents) SELECT doc_id, source FROM documents, n WHERE source = 'src' || newest""")
def newest_roster(spark, sf):
    return roster.newest_roster(table(spark, sf, "documents").select("doc_id", "source"), "source", "src")


@query("""WITH r AS (SELECT l_partkey AS p, l_suppkey AS s, count(*) AS n, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2),
c AS (SELECT event_id, user_id AS p, event_id % 10 AS s, count(*) OVER (PARTITION BY user_id, event_id % 10) AS uses FROM events)
SELECT event_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN uses > 1 THEN 'reused' END AS problem, CASE WHEN n = 1 AND uses = 1 THEN o END AS record FROM c LEFT JOIN r USING (p, s)""")
def bound_evidence(spark, sf):
    cited = table(spark, sf, "events").select("event_id", F.col("user_id").alias("p"), (F.col("event_id") % 10).alias("s"))
    known = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_orderkey").alias("record"))
    return evidence.bound_evidence(cited, known, ["p", "s"], "event_id", "record")


@query("""SELECT c_custkey, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1""")
def current_events(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"), "event_id", "event_type")
    return evidence.current_events(events, table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], "event_id", ["event_type"])


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 OR o_custkey % 7 = 1 THEN 'invalidated' ELSE o_orderstatus END AS state FROM orders""")
def rebased_history(spark, sf):
    customers = table(spark, sf, "customer").withColumnRenamed("c_custkey", "subject")
    fresh = customers.where("subject % 7 <> 1").select("subject", F.when(F.col("subject") % 3 == 0, "new").otherwise("old").alias("digest"))  # evidence that is gone
    history = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("subject"), F.lit("old").alias("digest"), F.col("o_orderstatus").alias("state"))
    return evidence.rebased(history, fresh, "subject", "digest", "state").select("o_orderkey", "state")


@query("""SELECT 'unexpected-count' AS problem, count(*) AS rows FROM part UNION ALL SELECT 'unparsed', count(*) FILTER (p_size % 10 = 0) FROM part UNION ALL SELECT 'versions-differ', count(*) FILTER (p_partkey % 9 = 0) FROM part""")
def view_census(spark, sf):
    parts = table(spark, sf, "part")
    view = parts.select("p_partkey", F.when(F.col("p_size") % 10 != 0, "parsed").alias("parse_status"))
    second = parts.select("p_partkey", "p_name", (F.col("p_size") + F.when(F.col("p_partkey") % 9 == 0, 1).otherwise(0)).alias("p_size"))
    return evidence.view_census(view, -1, parts.select("p_partkey", "p_name", "p_size"), second, ["p_partkey"], ["p_name", "p_size"])


@query("""SELECT 'jobs' AS counter, count(DISTINCT v) AS n FROM (SELECT l_orderkey AS v FROM lineitem UNION ALL SELECT l_partkey FROM lineitem) UNION ALL
SELECT 'hashes', count(DISTINCT v) FROM (SELECT l_suppkey AS v FROM lineitem UNION ALL SELECT l_linenumber FROM lineitem) UNION ALL SELECT 'edges:' || l_returnflag, count(*) FROM lineitem GROUP BY 1""")
def audit_counts(spark, sf):
    return evidence.audit_counts(table(spark, sf, "lineitem").withColumn("kind", F.col("l_returnflag")), ["l_orderkey", "l_partkey"], ["l_suppkey", "l_linenumber"])


@query("""SELECT (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT count(*) FROM (SELECT DISTINCT source, lang FROM documents)) AS versions,
 (SELECT count(*) FROM (SELECT DISTINCT source, lang, n_chars FROM documents)) AS positions, (SELECT count(DISTINCT CASE WHEN n_chars % 2 = 0 THEN n_chars END) FROM documents) AS attempts""")
def multi_grain_counts(spark, sf):
    docs = table(spark, sf, "documents").withColumn("attempt", F.when(F.col("n_chars") % 2 == 0, F.col("n_chars")))
    return evidence.multi_grain_counts(docs, "source", "lang", "n_chars", "attempt")


@query("""SELECT count(*) AS rows, sum(strlen(text))::BIGINT AS bytes, count(*) <= 100 AS within FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)""")
def history_bound(spark, sf):
    return evidence.within_bound(table(spark, sf, "documents"), table(spark, sf, "conversations"), text="text", most_bytes=1 << 50, most_rows=100)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.25 WHEN event_id % 3 = 1 THEN NULL ELSE 1.0 END::DOUBLE AS p FROM events""")
def chance_maps(spark, sf):
    text = F.get(F.array(F.lit('{"match": 0.25, "no-match": 0.75}'), F.lit('{"match": 0.9, "no-match": 0.3}'), F.lit('{"match": 1}')), F.col("event_id") % 3)
    return table(spark, sf, "events").select("event_id", scalars.probabilities(text, 0.001)["match"].alias("p"))


@query("""SELECT p_partkey, p_brand, p_size FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_size) = 1""")
def exactly_one_binding(spark, sf):
    return matching.exactly_one(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", "p_size")


@query("""SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, ceil((SELECT count(*) FROM orders) / 50)::BIGINT AS pages FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100""")
def numbered_page(spark, sf):
    rows, total, pages = paging.numbered_page(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 3, 50)
    return rows.select("o_orderkey", F.lit(total).cast("long").alias("total"), F.lit(pages).cast("long").alias("pages"))


@query("""SELECT n_nationkey, n_name FROM nation""")
def bounded_rows(spark, sf):
    return paging.bounded(table(spark, sf, "nation").select("n_nationkey", "n_name"), 100)


@query("""SELECT true AS same, false AS shuffled_same, (SELECT max(c_custkey) FROM customer) < 0 AS disjoint""")
def key_set_checks(spark, sf):
    keys = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    found = (matching.same_rows(keys, keys.orderBy("id")), matching.same_rows(keys, keys.distinct()), matching.disjoint(own, keys, "id"))
    return spark.createDataFrame([found], "same boolean, shuffled_same boolean, disjoint boolean")
