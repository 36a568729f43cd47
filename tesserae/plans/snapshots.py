"""Snapshot, filter, paging and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.reasons import reasons
from tesserae.functions.scalars import canonical_hash, composite_id, first_filled, safe_url
from tesserae.operators import paging, snapshot
from tesserae.operators.ordering import numbered
from tesserae.plans.registry import query
from tesserae.sources.tables import table


@query("""SELECT d.source, d.lang, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'labelled' END AS kind, count(*) AS records,
  count(DISTINCT d.text) AS texts, sum(d.n_chars)::BIGINT AS chars
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY ALL""")
def snapshot_overview(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id").distinct().withColumn("has", F.lit(True))
    docs = table(spark, sf, "documents").join(labels, "doc_id", "left").withColumn("kind", F.when(F.col("has"), "labelled").otherwise("unlabelled"))
    return docs.groupBy("source", "lang", "kind").agg(F.count("*").alias("records"), F.count_distinct("text").alias("texts"), F.sum("n_chars").alias("chars"))


@query("""SELECT count(*) AS records, count(DISTINCT source) AS sources, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars > 2000) AS long_texts FROM documents""")
def snapshot_totals(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("records"), F.count_distinct("source").alias("sources"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("n_chars") > 2000).alias("long_texts"))


_SPAN = """WITH spans AS (SELECT l_orderkey, min(l_shipdate) AS date_from, max(l_shipdate) AS date_to FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderdate, date_from, date_to FROM orders LEFT JOIN spans ON o_orderkey = l_orderkey
WHERE coalesce(date_to, o_orderdate) >= TIMESTAMP '1996-02-01' AND coalesce(date_from, o_orderdate) <= TIMESTAMP '1996-02-29'"""


def _spans(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("date_from"), F.max("l_shipdate").alias("date_to"))
    orders = table(spark, sf, "orders").join(lines, "o_orderkey", "left")
    low, high = F.lit("1996-02-01").cast("timestamp_ntz"), F.lit("1996-02-29").cast("timestamp_ntz")
    return orders.where(snapshot.overlaps(F.col("date_from"), F.col("date_to"), F.col("o_orderdate"), low, high)).select("o_orderkey", "o_orderdate", "date_from", "date_to")


@query(_SPAN)
def browse_overlap(spark, sf):
    return _spans(spark, sf)


@query(f"{_SPAN} ORDER BY o_orderdate, date_from, date_to, o_orderkey LIMIT 50 OFFSET 100")
def browse_overlap_page(spark, sf):
    return paging.page(_spans(spark, sf), ["o_orderdate", "date_from", "date_to", "o_orderkey"], 50, 100)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def browse_equal(spark, sf):
    return snapshot.browse(table(spark, sf, "orders"), o_orderstatus="O", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey", "o_custkey")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def federation_semi(spark, sf):
    mapping = table(spark, sf, "labels").withColumn("label", F.when(F.col("quality") == 1, "good").otherwise("poor"))
    return snapshot.mapped(table(spark, sf, "documents"), mapping, ["doc_id"], "label", "good").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def federation_unknown_anti(spark, sf):
    return snapshot.mapped(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"], "quality", "unknown").select("doc_id", "source")


@query("SELECT d.doc_id, d.source, l.quality::INTEGER AS quality, l.toxic::INTEGER AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def decision_lookup(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "source", F.col("quality").cast("int"), F.col("toxic").cast("int"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'failure' WHEN event_type = 'error' THEN 'warning'
  WHEN event_type IN ('view', 'click') THEN 'visit' WHEN value IS NULL THEN 'unknown' ELSE event_type END AS kind FROM events""")
def classify_kind(spark, sf):
    kind = F.when((F.col("event_type") == "error") & (F.col("value") > 50), "failure").when(F.col("event_type") == "error", "warning")
    kind = kind.when(F.col("event_type").isin("view", "click"), "visit").when(F.col("value").isNull(), "unknown").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", kind.alias("kind"))


@query("""SELECT doc_id, 'sha256:' || sha256(text) AS text_hash, sha256(source || chr(31) || doc_id::VARCHAR) AS record_id FROM documents""")
def source_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", canonical_hash(F.sha2("text", 256)).alias("text_hash"), composite_id(F.col("source"), F.col("doc_id")).alias("record_id"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'review' WHEN value IS NULL OR value < 10 THEN 'evidence' WHEN event_type = 'purchase' THEN 'identity' ELSE 'routine' END AS queue_group,
  concat_ws(',', CASE WHEN event_type = 'error' THEN 'error' END, CASE WHEN value < 10 THEN 'low-value' END, CASE WHEN user_id % 10 = 0 THEN 'watched-user' END) AS triggers FROM events""")
def queue_groups(spark, sf):
    low = F.col("value") < 10
    group = F.when(F.col("event_type") == "error", "review").when(F.col("value").isNull() | low, "evidence").when(F.col("event_type") == "purchase", "identity").otherwise("routine")
    found = reasons(("error", F.col("event_type") == "error"), ("low-value", low), ("watched-user", F.col("user_id") % 10 == 0))
    return table(spark, sf, "events").select("event_id", group.alias("queue_group"), F.array_join(found, ",").alias("triggers"))


@query("""SELECT event_id, (props->>'k')::BIGINT AS k, coalesce(nullif(props->>'missing', ''), nullif(props->>'k', '')) AS label FROM events""")
def json_props_project(spark, sf):
    fields = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").withColumn("fields", fields).select("event_id", F.col("fields")["k"].cast("long").alias("k"), first_filled(F.col("fields"), ["missing", "k"]).alias("label"))


@query("""SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN value > 90 THEN NULL ELSE value END ASC NULLS LAST, event_id) AS queue_position FROM events""")
def queue_scored_first(spark, sf):
    scored = table(spark, sf, "events").withColumn("score", F.when(F.col("value") <= 90, F.col("value")))
    return paging.queue(scored, "score", "event_type", "event_id").select("event_id", "user_id", "event_type", "queue_position")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN year(o_orderdate) END, 9999), o_orderpriority, o_orderkey) AS place FROM orders""")
def null_last_order(spark, sf):
    year = F.coalesce(F.when(F.col("o_orderpriority") != "5-LOW", F.year("o_orderdate")), F.lit(9999))
    return numbered(table(spark, sf, "orders").withColumn("year", year), ["o_orderstatus"], ["year", "o_orderpriority", "o_orderkey"], "place").select("o_orderkey", "place")


@query("SELECT doc_id, lang FROM documents ORDER BY sha256('audit:' || doc_id::VARCHAR), doc_id LIMIT 40")
def hash_sample(spark, sf):
    return paging.hash_sample(table(spark, sf, "documents"), "doc_id", "audit", 40).select("doc_id", "lang")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 20 OFFSET 5)")
def page_of_groups(spark, sf):
    return paging.page_of_groups(table(spark, sf, "conversations"), "conv_id", 20, 5).select("conv_id", "turn", "role")


@query("SELECT source, max(doc_id) AS doc_id, arg_max(lang, (n_chars, doc_id)) AS longest_lang FROM documents GROUP BY source")
def newest_verified(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.max("doc_id").alias("doc_id"), F.max_by("lang", F.struct("n_chars", "doc_id")).alias("longest_lang"))


@query("SELECT o_custkey, arg_max('v' || (o_orderkey % 1000)::VARCHAR, (o_orderkey % 1000, o_orderkey)) AS latest FROM orders GROUP BY 1")
def max_version(spark, sf):
    named = table(spark, sf, "orders").withColumn("name", F.concat(F.lit("v"), (F.col("o_orderkey") % 1000).cast("string")))
    number = F.regexp_extract("name", "([0-9]+)$", 1).cast("long")
    return named.groupBy("o_custkey").agg(F.max_by("name", F.struct(number, "o_orderkey")).alias("latest"))


@query("""SELECT 'lang' AS facet, array_to_string(list_sort(list(DISTINCT lang)), ',') AS choices FROM documents
UNION ALL SELECT 'source', array_to_string(list_sort(list(DISTINCT source)), ',') FROM documents""")
def facets(spark, sf):
    docs = table(spark, sf, "documents")
    one = lambda c: docs.agg(F.lit(c).alias("facet"), F.array_join(F.array_sort(F.collect_set(c)), ",").alias("choices"))
    return one("lang").unionByName(one("source"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN n_chars < 200 THEN 'too-short' END, CASE WHEN lang = 'es' THEN 'unsupported-language' END, CASE WHEN l.doc_id IS NULL THEN 'unreviewed' END,
  CASE WHEN quality = 0 THEN 'low-quality' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS blockers FROM documents d LEFT JOIN labels l USING (doc_id)""")
def publication_blockers(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    found = reasons(("too-short", F.col("n_chars") < 200), ("unsupported-language", F.col("lang") == "es"), ("unreviewed", F.col("seen").isNull()), ("low-quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1))
    return docs.select("doc_id", F.array_join(F.array_distinct(found), ",").alias("blockers"))


@query("""SELECT c_custkey, c_name FROM customer WHERE (contains(lower(c_name), lower('000001')) OR contains(lower(c_mktsegment), lower('000001'))) AND c_nationkey < 20""")
def public_listing_filter(spark, sf):
    ask = F.lower(F.lit("000001"))
    either = F.contains(F.lower("c_name"), ask) | F.contains(F.lower("c_mktsegment"), ask)
    return table(spark, sf, "customer").where(either & (F.col("c_nationkey") < 20)).select("c_custkey", "c_name")


@query(r"""SELECT page_id, coalesce(regexp_matches(url, '^https?://[^/@\s]+(/|$)') AND NOT regexp_matches(url, '[\x00-\x20\x7f]') AND NOT regexp_matches(url, '(?i)[?&](token|key|password|secret)='), false) AS safe,
  coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ''), '') AS host FROM pages""")
def safe_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", safe_url(F.col("url")).alias("safe"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS links, coalesce(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)[1], '') AS first_link,
  len(regexp_extract_all(html, '<li>')) AS items FROM pages""")
def html_links(spark, sf):
    links = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").withColumn("found", links).select("page_id", F.size("found").cast("long").alias("links"), F.coalesce(F.try_element_at("found", F.lit(1)), F.lit("")).alias("first_link"), F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0))).cast("long").alias("items"))


@query("SELECT r_regionkey AS key, r_name AS name, 'region' AS namespace FROM region UNION ALL SELECT n_nationkey, n_name, 'nation' FROM nation")
def union_namespaces(spark, sf):
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit("region").alias("namespace"))
    return regions.unionByName(table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit("nation").alias("namespace")))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN year(o_orderdate) = 1995 THEN '1995' WHEN year(o_orderdate) = 1996 THEN '1996' ELSE 'outside_scope' END AS bucket FROM orders""")
def year_bucket(spark, sf):
    year = F.year("o_orderdate")
    bucket = F.when(F.col("o_orderstatus") == "P", "unknown").when(year == 1995, "1995").when(year == 1996, "1996").otherwise("outside_scope")
    return table(spark, sf, "orders").select("o_orderkey", bucket.alias("bucket"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 7 WHEN 'O' THEN 30 ELSE 90 END AS cadence,
  date_diff('day', o_orderdate::DATE, DATE '1998-12-01') >= CASE o_orderstatus WHEN 'F' THEN 7 WHEN 'O' THEN 30 ELSE 90 END AS due FROM orders""")
def refresh_due(spark, sf):
    cadence = F.when(F.col("o_orderstatus") == "F", 7).when(F.col("o_orderstatus") == "O", 30).otherwise(90)
    return table(spark, sf, "orders").select("o_orderkey", cadence.alias("cadence"), (F.datediff(F.lit("1998-12-01").cast("date"), F.col("o_orderdate").cast("date")) >= cadence).alias("due"))
